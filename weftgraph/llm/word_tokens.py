"""The tokenizers library, one call a new word: texts are cut at ASCII white space and known words come from a bounded table.

Right only for tokenizers whose normalisation and splitting don't look across ASCII white
space, which is what ``WordTokenizer`` checks for when it is made: white space must be
dropped by the split, and no added token may contain any.  For others whole texts go to the library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from weftgraph.llm.kernel import Texts, fold_ascii
from weftgraph.llm.word_table import WordTable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = np.zeros(256, bool)  # ASCII letters and digits
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class WordTokenizer:
    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" and "\\s" in s["pattern"].get("Regex", "") for s in steps) and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
        added = [t for t in spec.get("added_tokens", []) if t.get("special")]
        self.mark = added[0] if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = self.by_word and any(n.get("type") == "Lowercase" for n in normal)
        #: letters and digits never share a token with a full stop or comma after them
        self.loose = self.by_word and any("[^\\s\\p{L}\\p{N}]+" in s["pattern"].get("Regex", "") for s in steps if "pattern" in s)
        self.table = WordTable(self._encode, bits=21)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        #: a word of letters is one piece of the split, and its last token ends a word
        self.letters = bool(
            self.lower and suffix and model.get("type") == "BPE" and any("[\\p{L}]+" in x["pattern"].get("Regex", "") for x in steps if "pattern" in x)
            and {x.get("type") for x in normal} <= {"NFC", "Replace", "Lowercase"} and {x.get("type") for x in steps} == {"Split", "ByteLevel"}
        )
        if self.letters:
            self.model = self.tokenizer.model
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin among them, how many it has)."""
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat: list[int] = []
        spaced: list[int] = []
        rest: list[int] = []
        texts = [w.decode("utf-8", "replace") for w in words]
        for i, text in enumerate(texts):
            if not self.letters or not text.isalpha():
                rest.append(i)
            elif not text.isascii() or not text.islower():
                spaced.append(i)
            else:  # nothing to normalise or split: the model's own merges
                first[i] = len(flat)
                flat += [t.id for t in self.model.tokenize(text)]
                count[i] = len(flat) - first[i]
        parts = [np.array(flat, np.int32)]
        for group, encode in ((spaced, self._spaced), (rest, self._marked)):
            for at in range(0, len(group), 2000):
                which = np.array(group[at : at + 2000])
                ids, edge = encode([texts[i] for i in which.tolist()])
                first[which], count[which] = edge[:-1] + sum(map(len, parts)), np.diff(edge)
                parts.append(ids)
        return np.concatenate(parts), first, count

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, and their edges: all go through the library in one text, and each word's last token is one that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        return (ids, np.append(0, ends)) if len(ends) == len(words) else self._marked(words)

    def _marked(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and their edges: all go through the library in one text, a special token between them."""
        if self.mark is None or any(self.mark["content"] in w for w in plain):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
            return np.array([x for ids in found for x in ids], np.int32), np.cumsum([0, *map(len, found)])
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark['content']} ".join(plain)], add_special_tokens=False)[0].ids, np.int32)
        marks = np.flatnonzero(ids == self.mark["id"])
        edges = np.concatenate([[0], marks - np.arange(len(marks)), [len(ids) - len(marks)]])
        return np.delete(ids, marks), edges

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many are each text's), without special tokens; null: none."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([part.text(i) for i in range(part.n)], add_special_tokens=False)
            return np.array([x for e in found for x in e.ids], np.int32), np.array([len(e.ids) for e in found], np.int64)
        part.words()
        data, starts, ends, first_word = part.data, part.starts, part.ends, part.word_offsets
        if self.lower:
            folded = fold_ascii(data)
            marked = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # the case of <|...|> counts
            for i in np.unique(np.searchsorted(part.offsets, marked, "right") - 1).tolist():
                folded[part.offsets[i] : part.offsets[i + 1]] = data[part.offsets[i] : part.offsets[i + 1]]
            data = folded
        if self.loose and len(ends):
            last = data[ends - 1]
            tail = ((last == 46) | (last == 44)) & (ends - starts > 1) & _PLAIN[data[np.maximum(ends - 2, 0)]]
            place = np.arange(len(ends)) + np.cumsum(tail)  # of each word's last part
            pieces = np.empty((2, len(ends) + int(tail.sum())), np.int64)
            pieces[0, place], pieces[1, place] = np.where(tail, ends - 1, starts), ends
            pieces[0, place[tail] - 1], pieces[1, place[tail] - 1] = starts[tail], ends[tail] - 1
            first_word = np.append(0, np.cumsum(tail))[first_word] + first_word
            starts, ends = pieces
        first, count = self.table.look_up(data, starts, ends)
        upto = np.append(0, np.cumsum(count))[first_word]
        return self.table.ids(first, count), np.diff(upto)
