"""Language ID by cross-parsing entropy.

Each language has a suffix automaton over a sample of its labelled text. A text is parsed
into the longest pieces that occur in a language's sample, one after the other; the language
that needs the fewest pieces, normalised by the text's length and the sample's, wins. The
automata of all languages are one transition table, and many stretches of text walk it in
step, so a whole text costs a few array operations a symbol. Every letter of the samples is
a symbol of its own; transitions by the SYMBOLS - 2 most frequent ones are a dense table, by
all others sorted keys. Texts are parsed in stretches of STRETCH symbols, each from the
automaton's root.

The sample is bounded by documented parameters (languages, texts and symbols per language). It
is taken by hash order of the ids, repeated texts once. Predictions read whole texts.

Defined results: a null text or one without a letter is `und` with score 0. With no labelled
rows every text is `und`, and keep_identified keeps those with a letter. Ties go to the language that sorts first. Repeated rows get
repeated results; null labels are not learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import eased, kept, slices, utf8

SYMBOLS = 64  # symbols of the dense table; 0: no letter; 1: a letter that the samples never have
STRETCH = 512


class SuffixAutomaton:
    """Online construction; state 0 is the root. Every path from it spells a substring."""

    def __init__(self, text: np.ndarray):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = cur
        self.nexts = nexts

    def table(self) -> np.ndarray:
        out = np.full((len(self.nexts), SYMBOLS), -1, np.int32)
        for i, row in enumerate(self.nexts):
            for c, to in row.items():
                if c < SYMBOLS:
                    out[i, c] = to
        return out

    def others(self) -> np.ndarray:
        """State, symbol and next state of the transitions that the table has no place for."""
        return np.array([(i, c, to) for i, row in enumerate(self.nexts) for c, to in row.items() if c >= SYMBOLS], np.int64).reshape(-1, 3)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter; its lower case where that is one code point."""
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(is_letter).tolist():
        if len(x := chr(i).lower()) == 1:
            lower[i] = ord(x)
    return is_letter, lower


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    samples: list[str]

    def build(self) -> Model:
        """Makes the tables; done once by each Python worker."""
        is_letter, lower = _letters()
        points = [lower[p] for s in self.samples if (p := code_points(s.encode("utf-8", "replace"))) is not None]
        often = Counter()
        for p in points:
            u, c = np.unique(p[is_letter[p]], return_counts=True)
            often.update(dict(zip(u.tolist(), c.tolist(), strict=True)))
        chosen = [p for p, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))]
        symbol = is_letter.astype(np.int32)
        symbol[np.array(chosen, np.int64)] = np.arange(2, 2 + len(chosen))
        self.symbol = symbol[lower]
        self.size = max(SYMBOLS, 2 + len(chosen))
        tables, others, base = [], [], 0
        self.roots, self.weight = [], []
        for p in points:
            t = self.squeeze(self.symbol[p])
            automaton = SuffixAutomaton(t)
            table = automaton.table()
            others.append(automaton.others() + [base, 0, base])
            tables.append(np.where(table >= 0, table + base, -1))
            self.roots.append(base)
            self.weight.append(np.log2(max(len(t), 2)))
            base += len(table)
        self.table = np.concatenate(tables).ravel().astype(np.int32)
        self.roots = np.array(self.roots, np.int32)
        rest = np.concatenate(others)
        keys = rest[:, 0] * self.size + rest[:, 1]
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], rest[order, 2].astype(np.int32)
        self.first = np.repeat(self.roots[:, None], self.size, axis=1)
        for first, r, more in zip(self.first, self.roots, others, strict=True):
            first[:SYMBOLS] = np.where((row := self.table[r * SYMBOLS : (r + 1) * SYMBOLS]) >= 0, row, r)
            more = more[more[:, 0] == r]
            first[more[:, 1]] = more[:, 2]
        return self

    @staticmethod
    def squeeze(symbols: np.ndarray) -> np.ndarray:
        """Runs of what is no letter are one such symbol."""
        if not len(symbols):
            return symbols
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        return symbols[keep]

    def phrases(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Pieces per text and language; symbols of all texts end to end."""
        n, size = len(off) - 1, np.diff(off)
        per = -(-size // STRETCH)
        doc = np.repeat(np.arange(n), per)
        start = off[:-1][doc] + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        length = np.minimum(STRETCH, off[1:][doc] - start)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        lanes = len(doc)
        state = np.repeat(self.roots[:, None], lanes, axis=1)
        count = np.ones((len(self.roots), lanes), np.int64)
        active = np.searchsorted(-length, -np.arange(1, STRETCH + 1), "right")
        for t in range(STRETCH if lanes else 0):
            m = active[t]
            if not m:
                break
            sym = symbols[start[:m] + t].astype(np.int32)
            other = np.flatnonzero(sym >= SYMBOLS)
            if len(other):
                # the table has no transition by symbol 1
                now = self.table[state[:, :m] * SYMBOLS + np.where(sym < SYMBOLS, sym, 1)]
                key = state[:, other].astype(np.int64) * self.size + sym[other]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                now[:, other] = np.where(self.keys[k] == key, self.targets[k], -1)
            else:
                now = self.table[state[:, :m] * SYMBOLS + sym]
            miss = now < 0
            if t:
                count[:, :m] += miss
            state[:, :m] = np.where(miss, self.first[:, sym], now)
        out = np.zeros((n, len(self.roots)))
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(doc, count[k], minlength=n)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        points = code_points(b"\x00".join(texts))
        raw = self.symbol[points]
        sizes = np.array([len(t.decode("utf-8", "replace")) for t in texts])
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        keep = raw > 0
        keep[1:] |= raw[:-1] > 0
        at = np.concatenate([[0], np.cumsum(keep)])
        off = np.append(at[bounds], at[-1])
        letters = np.concatenate([[0], np.cumsum(raw > 0)])
        some = letters[np.append(bounds[1:], len(raw))] > letters[bounds]
        rate = self.phrases(raw[keep], off) * np.array(self.weight) / np.maximum(np.diff(off), 1)[:, None]
        best = rate.argmin(axis=1)
        low = rate.min(axis=1)
        rest = rate.copy()
        rest[np.arange(len(best)), best] = np.inf
        second = rest.min(axis=1)
        score = np.where(np.isinf(second), 1.0, np.where(np.isinf(second), 1.0, second) / np.maximum(low + np.where(np.isinf(second), 1.0, second), 1e-12))
        return [self.languages[b] if x else "und" for b, x in zip(best, some, strict=True)], np.where(some, score, 0.0)


def fit(docs: DataFrame, learn: F.Column, texts: int = 256, symbols: int = 100_000, each: int = 24_000, per_text: int = 2_000, languages: int = 256) -> Model:
    """The samples of the `languages` most frequent languages among rows where `learn` holds: of
    up to `texts` texts in hash order of their ids, `per_text` code points each from a place
    that the text's hash names, `each` a language, `symbols` in all.
    A task keeps `texts` rows of a language before anything is shuffled; what the driver gets
    is cut to the samples' length first: `symbols` and a text a language at most."""
    known = docs.where(learn).where("lang is not null and text is not null")
    names = sorted(r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect())
    most = min(each, symbols // max(1, len(names)))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - per_text, F.lit(0)) + 1) + 1
    rows = known.where(F.col("lang").isin(names)).select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", start.cast("int"), F.lit(per_text)).alias("t"))
    w = Window.partitionBy("lang").orderBy("h", "t")
    first = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= texts)
    # repeated texts once, then as many as fill the sample
    once = first.groupBy("lang", "t").agg(F.min("k").alias("k"))
    before = F.coalesce(F.sum(F.length("t") + 1).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = once.withColumn("before", before).where(F.col("before") < most).select("lang", "k", "t").collect()
    by: dict[str, list[str]] = {x: [] for x in names}
    for r in sorted(got, key=lambda r: r["k"]):
        by[r["lang"]].append(r["t"])
    return Model(names, ["\x00".join(by[x])[:most] for x in names])


def _model_of(model: Model) -> Model | None:
    """The worker's built model; None where there is nothing to tell apart."""
    if not model.languages:
        return None
    return kept((Model, *model.languages, *model.samples), lambda: Model(model.languages, model.samples).build())


def _predict(model: Model, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    data, off = utf8(batch.column("text"))
    texts = [data[off[i] : off[i + 1]].tobytes() for i in range(batch.num_rows)]
    built = _model_of(model)
    return built.predict(texts) if built and texts else (["und"] * len(texts), np.zeros(len(texts)))


def identify_language(docs: DataFrame, learn: F.Column | None = None, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; one pass over the texts without a shuffle."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0 if learn is None else learn
    model = fit(docs, learn, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2 << 20):
                names, score = _predict(model, b)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = docs.select("doc_id", F.coalesce(~learn, F.lit(True)).alias("held_out"), "text")
    return held.mapInArrow(eased(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, learn: F.Column | None = None, **bounds: int) -> DataFrame:
    """The rows of `docs`, all columns, whose text has letters, so that a language can be told; the others go.

    A null `lang` becomes the language that the text is in. No shuffle."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0 if learn is None else learn
    model = fit(docs, learn, **bounds)
    lang = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2 << 20):
                if not model.languages:
                    yield b.filter(pa.array([any(map(str.isalpha, t or "")) for t in b.column("text").to_pylist()], pa.bool_()))
                    continue
                names = pa.array(_predict(model, b)[0], pa.string())
                filled = b.set_column(lang, b.schema.field(lang), pc.coalesce(b.column(lang), names.cast(b.schema.field(lang).type)))
                yield filled.filter(pc.not_equal(names, "und"))

    return docs.mapInArrow(eased(run), docs.schema)
