"""Rust source files to rows: what a file declares, uses and names.

A small scanner runs over each file in Arrow-fed tasks; everything that relates files is done by joins
afterwards.  It knows comments, strings, characters and lifetimes, attributes, nested ``use`` trees and inline
modules; bodies of macros are opaque to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = (
    "crate string, file string, fact string, name string, segments array<string>, alias string, line int, is_test boolean, "
    "visibility string, inline array<string>, detail string"
)
ARROW = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[t]) for c, t in (x.split(" ") for x in FACTS.split(", "))])
BATCH = 4096  # facts that go out together
LONG = 1 << 16  # characters from which a file's facts are not held together
TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|b?'(?:\\[^']*|[^'\\\n])'|'[A-Za-z_]\w*)|(?P<raw>b?r(?P<hash>\#*)".*?"(?P=hash))|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<word>(?:r\#)?[A-Za-z_]\w*)|(?P<sign>::|->|=>|\#!?\[|[^\s\w])|(?P<rest>\w+|\s+)""",
    re.S | re.X,
)
QUOTE = re.compile("[/'\"]")  # without one of these no comment, character or string begins
PLAIN = re.compile(r"((?:r\#)?[A-Za-z_]\w*|::|->|=>|\#!?\[|[^\s\w]|\n)|\w+")
NAME = re.compile("[A-Za-z_]").match
DEFINITIONS = {"fn", "struct", "enum", "trait", "const", "static", "type"}
CLOSE = {"(": ")", "[": "]", "{": "}", "#[": "]", "#![": "]"}


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, line) without comments and white space; strings keep their quotes.

    Lines up to the next one that may begin a comment, a character or a string are split in one call; such a line goes token by token.
    """
    out, line, at = [], 1, 0
    while at < len(text):
        stop = min(len(text), at + LONG)
        quote = QUOTE.search(text, at, stop)
        end = stop if stop == len(text) and not quote else text.rfind("\n", at, quote.start() if quote else stop) + 1
        if end > at:
            for word in PLAIN.findall(text, at, end):
                if word == "\n":
                    line += 1
                elif word:
                    out.append((word.removeprefix("r#"), line))
            at = end
        for m in TOKEN.finditer(text, at):
            kind, word, at = m.lastgroup, m.group(), m.end()
            if kind == "word":
                out.append((word.removeprefix("r#"), line))
            elif kind == "sign":
                out.append((word, line))
            else:
                if kind == "str" or kind == "raw":
                    out.append((word.removeprefix("r#"), line))
                line += word.count("\n")
                if kind == "rest" and "\n" in word:
                    break
    return out


def matching(toks: list[tuple[str, int]], at: int) -> int:
    """The place of the token that closes the bracket at ``at``."""
    depth = 0
    for i in range(at, len(toks)):
        t = toks[i][0]
        depth += t in CLOSE
        depth -= t in ")]}"
        if depth == 0:
            return i
    return len(toks) - 1


def is_test_attribute(words: list[str]) -> bool:
    """``cfg`` with ``test`` in it, also inside ``all`` and ``any``, but not inside ``not``."""
    if not words or words[0] != "cfg":
        return False
    inside: list[str] = []
    for i, w in enumerate(words):
        if w == "(":
            inside.append(words[i - 1])
        elif w == ")":
            inside.pop()
        elif w == "test" and "not" not in inside:
            return True
    return False


def use_tree(toks: list[str], prefix: list[str]) -> list[tuple[list[str], str | None]]:
    """(segments, alias) of each leaf of a ``use`` tree; a last ``self`` is the prefix itself, ``*`` stays."""
    if "{" not in toks and "as" not in toks:  # most are one path
        path = prefix + [t for t in toks if t != "::"]
        return [(path[:-1] if path[-1:] == ["self"] and len(path) > 1 else path, None)]
    path, i = list(prefix), 0
    while i < len(toks):
        t = toks[i]
        if t == "{":
            parts, depth, start, out = [], 0, i + 1, []
            for j in range(i, len(toks)):
                depth += toks[j] == "{"
                depth -= toks[j] == "}"
                if depth == 0 or (depth == 1 and toks[j] == ","):
                    parts.append(toks[start:j])
                    start = j + 1
                    if depth == 0:
                        break
            for p in parts:
                if p:
                    out += use_tree(p, path)
            return out
        if t == "as":
            return [(path[:-1] if path[-1:] == ["self"] and len(path) > 1 else path, toks[i + 1])]
        if t != "::":
            path.append(t)
        i += 1
    return [(path[:-1] if path[-1:] == ["self"] and len(path) > 1 else path, None)]


def scan(text: str) -> list[dict]:
    """Facts of one file: mod, use, path, def."""
    return [dict(zip(ARROW.names[2:], row, strict=True)) for row in found(text)]


def found(text: str) -> Iterator[tuple]:
    """The facts of ``scan`` one by one, as ``FACTS`` has them from ``fact`` on."""
    toks = tokens(text)
    scopes: list[tuple[str | None, bool]] = []  # (inline module's name, tests only)
    test_next, visibility, path_attribute, i = False, "", None, 0

    def row(fact: str, line: int, is_test: bool = False, name: str | None = None, segments: list[str] | None = None, alias: str | None = None, detail: str | None = None) -> tuple:
        if scopes:
            return fact, name, segments or [], alias, line, is_test or any([t for _, t in scopes]), visibility, [n for n, _ in scopes if n], detail
        return fact, name, segments or [], alias, line, is_test, visibility, [], detail

    def at_module_level() -> bool:
        return all([n is not None for n, _ in scopes])

    while i < len(toks):
        t, line = toks[i]
        if t in ("#[", "#!["):
            end = matching(toks, i)
            words = [w for w, _ in toks[i + 1 : end]]
            test_next |= is_test_attribute(words)
            if words[:2] == ["path", "="]:
                path_attribute = words[2].strip('"')
            i = end + 1
            continue
        if t == "pub":
            visibility, i = "pub", i + 1
            if i < len(toks) and toks[i][0] == "(":
                end = matching(toks, i)
                inner = [w for w, _ in toks[i + 1 : end]]
                if inner[:1] in (["crate"], ["super"], ["in"], ["self"]):
                    visibility, i = f"pub({' '.join(inner[:1])})", end + 1
            continue
        if t == "mod" and i + 2 < len(toks) and toks[i + 2][0] in (";", "{"):
            name = toks[i + 1][0]
            if toks[i + 2][0] == ";":
                if not scopes:
                    yield row("mod", line, test_next, name=name, detail=path_attribute)
            else:
                scopes.append((name, test_next))
            i, test_next, visibility, path_attribute = i + 3, False, "", None
            continue
        if t == "use":
            end = i + 1
            while end < len(toks) and toks[end][0] != ";":
                end += 1
            words = [w for w, _ in toks[i + 1 : end]]
            for segments, alias in use_tree(words, []):
                if segments:
                    yield row("use", line, test_next, segments=segments, alias=alias, detail="item" if at_module_level() else "body")
            i, test_next, visibility = end + 1, False, ""
            continue
        if t in DEFINITIONS and at_module_level() and i + 1 < len(toks) and NAME(toks[i + 1][0]) and toks[i + 1][0] not in DEFINITIONS:
            yield row("def", line, test_next, name=toks[i + 1][0], detail=t)
            i, test_next, visibility = i + 2, False, ""
            continue
        if NAME(t):
            if i + 1 < len(toks) and toks[i + 1][0] == "!" and (i + 2 < len(toks) and (toks[i + 2][0] in CLOSE or t == "macro_rules")):
                open_ = next((j for j in range(i + 2, len(toks)) if toks[j][0] in CLOSE), len(toks) - 1)
                i, visibility = matching(toks, open_) + 1, ""
                continue
            segments, j = [t], i + 1
            while j + 1 < len(toks) and toks[j][0] == "::":
                if NAME(toks[j + 1][0]):
                    segments.append(toks[j + 1][0])
                    j += 2
                elif toks[j + 1][0] == "<":  # generic arguments: what is inside is looked at on its own
                    depth, k = 0, j + 1
                    while k < len(toks):
                        depth += (toks[k][0] == "<") - (toks[k][0] == ">")
                        k += 1
                        if depth == 0:
                            break
                    if k < len(toks) and toks[k][0] == "::":
                        segments.append(toks[k + 1][0] if k + 1 < len(toks) else "")
                    break
                else:
                    break
            if len(segments) > 1:
                yield row("path", line, segments=segments)
            i = j
            continue
        if t == "{":
            scopes.append((None, False))
            test_next, visibility = False, ""
        elif t == "}" and scopes:
            scopes.pop()
        elif t == ";":
            test_next, visibility = False, ""
        i += 1


def facts(files: DataFrame) -> DataFrame:
    """Facts of all files (crate, file, text); a file that can't be scanned gives one row with fact ``error``.

    They go out ``BATCH`` at a time.  A long file is scanned twice, first to see that it can be, so that a task never holds all its facts.
    """

    def of_file(text: str) -> Iterator[tuple]:
        try:
            rows = list(found(text)) if len(text) < LONG else None
            if rows is None:
                for _ in found(text):
                    pass
        except (IndexError, ValueError, RecursionError) as e:
            rows = [("error", None, [], None, None, None, None, [], str(e))]
        return found(text) if rows is None else iter(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=ARROW)

        for batch in batches:
            for crate, file, text in zip(batch.column("crate").to_pylist(), batch.column("file").to_pylist(), batch.column("text"), strict=True):
                for fact in of_file(text.as_py() or ""):
                    held.append((crate, file, *fact))
                    if len(held) == BATCH:
                        yield close()
        if held:
            yield close()

    return files.select("crate", "file", "text").mapInArrow(run, FACTS)
