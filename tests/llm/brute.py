"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_measures(text):
    ws, lines, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    again = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(again)


def repeated_bytes(rows, width):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) for (doc_id, text) rows with distinct ids."""
    data = {d: (t or "").encode() for d, t in rows}
    seen = Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(rows, width):
    ws = {d: words(t) for d, t in rows}
    least = {}
    for d in sorted(ws):
        for i in range(len(ws[d]) - width + 1):
            least.setdefault(tuple(ws[d][i : i + width]), d)
    out = {}
    for d, w in ws.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def near_classes(rows, n, top, bottom):
    """doc_id -> (set size, class)."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(fold))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and bottom * both >= top * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
