"""License scans: Aho-Corasick over normalised words, shunting-yard over licence expressions.

Words are the maximal runs of bytes that the contract's class allows, after A-Z were
lower-cased; a phrase stands where its words stand consecutively. Licence expressions after
an SPDX tag are turned into reverse Polish order by the shunting-yard rule and evaluated:
`or` leaves the choice to the user (the larger permissiveness), `and` binds both (the
smaller), `with` attaches an exception that loosens its licence.

Defined results: a null or empty text has no words, no labels ('' in both label columns),
null first and last word and score 0. Long texts are read whole, one text at a time.
Repeated rows give repeated results. Columns other than doc_id and text are not read.
A broken expression keeps the licences before the break and gets the label `malformed`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import eased, utf8

#: Phrase -> label.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE_PHRASES = {
    "spdx license identifier": "spdx",
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "apache license": "apache",
    "licensed under the apache": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
    "do not distribute": "proprietary",
    "unlicense": "unlicense",
}
#: Label or licence family -> how freely the text may be used, 0 to 1.
PERMISSIVENESS = {
    "public-domain": 1.0, "unlicense": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "0bsd": 1.0, "zlib": 0.95,
    "bsd": 0.9, "apache": 0.9, "cc-by": 0.85, "mpl": 0.6, "epl": 0.55, "cc-by-sa": 0.55, "lgpl": 0.5,
    "gpl": 0.35, "agpl": 0.25, "cc-by-nc": 0.15, "cc-by-nd": 0.1, "reserved": 0.05, "proprietary": 0.0,
}
UNKNOWN = 0.3
EXCEPTION_BONUS = 0.1

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: One byte to one byte: lower case, and a space for whatever stands between words.
FOLD = bytes(c if _WORD.match(bytes([c])) else 32 for c in (ord(chr(b).lower()) if b < 128 else b for b in range(256)))
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_PIECE = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+\-:]*|[()]")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(text: str) -> tuple[list[str], bool]:
    """The expression in reverse Polish order, and whether all of it was well formed.

    The expression ends where an operand follows an operand, as comments may follow it."""
    out: list[str] = []
    stack: list[str] = []
    operand, sound = False, True
    for piece in _PIECE.findall(text):
        low = piece.lower()
        if low in _RANK:
            if not operand:
                sound = False
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif piece == "(":
            if operand:
                break
            stack.append("(")
        elif piece == ")":
            if not operand or "(" not in stack:
                sound = False
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
    if not operand and out:
        sound = False
    while stack:
        op = stack.pop()
        if op == "(":
            sound = False
        else:
            out.append(op)
    return out, sound and bool(out)


def family(identifier: str) -> str:
    """The longest known family that the identifier begins with, else the identifier itself."""
    found = [k for k in PERMISSIVENESS if identifier == k or identifier.startswith((f"{k}-", f"{k}+"))]
    return max(found, key=len, default=identifier)


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Permissiveness and licence labels; operators that lack operands are passed over."""
    stack: list[float] = []
    labels: set[str] = set()
    exceptions = {postfix[i - 1] for i, x in enumerate(postfix) if x == "with" and i}
    for x in postfix:
        if x not in _RANK:
            stack.append(PERMISSIVENESS.get(family(x), UNKNOWN))
            if x not in exceptions:
                labels.add(family(x))
        elif len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if x == "or" else min(a, b) if x == "and" else min(1.0, a + EXCEPTION_BONUS))
    return (stack[-1] if stack else 0.0), labels


class Scanner:
    """The automaton over all phrases; one per Python worker."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        both: dict[str, list[tuple[bool, str]]] = {}
        for base, phrases in ((True, BASE_PHRASES), (False, NOTICE_PHRASES)):
            for phrase, label in phrases.items():
                both.setdefault(f" {phrase} ", []).append((base, label))
        for phrase, what in both.items():
            self.automaton.add_word(phrase, (len(phrase), what))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(FOLD).split()
        n = len(words)
        if not n:
            return 0, 0, None, None, "", "", 0.0
        line = f" {b' '.join(words).decode('latin-1')} "
        hits = list(self.automaton.iter(line))
        if not hits:
            return n, 0, None, None, "", "", 0.0
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        places = np.searchsorted(gaps, [end - size + 1 for end, (size, _) in hits])
        base_labels, labels, at, spdx = set(), set(), [], False
        for place, (_, (_, what)) in zip(places, hits, strict=True):
            for base, label in what:
                if base:
                    base_labels.add(label)
                    at.append(int(place))
                spdx |= label == "spdx"
                labels.add(label)
        scores = [PERMISSIVENESS[x] for x in labels if x in PERMISSIVENESS]
        if spdx:
            for expression in _TAG.findall(raw.decode("utf-8", "replace")):
                postfix, sound = to_postfix(expression)
                value, named = evaluate(postfix)
                labels |= named if sound else named | {"malformed"}
                if postfix:
                    scores.append(value)
        # labels are joined by commas, and so none may hold one: pieces of an expression never do
        return n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(min(scores, default=UNKNOWN))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        data, off = utf8(batch.column("text"))
        rows = [scanner.scan(data[off[i] : off[i + 1]].tobytes()) for i in range(batch.num_rows)]
        cols = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    One pass without a shuffle. `score` is the permissiveness of what binds the text most;
    a text that names no licence grants nothing and has 0."""
    return docs.select("doc_id", "text").mapInArrow(eased(_scan), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
