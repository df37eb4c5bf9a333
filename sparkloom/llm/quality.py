"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a fixed vector of transformed statistics, computed over its whole bytes.
Class moments are summed over all learning rows where they lie and combined as d x d
matrices, so the driver sees a few hundred numbers. Class covariances are shrunk towards
the pooled one and that towards its diagonal; the inverse Cholesky factors are made once,
and a score is the logistic of the difference of the two Mahalanobis log-densities.

Defined results: a null or empty text has the vector of an empty text and is scored like
any other. Repeated rows get repeated scores; a repeated labelled row counts as often. Where
no or only one class is labelled, the prior (with one added to each class) is the score.
Null labels are not learned. Labels, language, source and ids never enter a vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NO_WORD, WHITE, eased, runs, slices, span_hash, utf8, word_spans, written

#: Byte classes counted per document.
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": (46, 33, 63),
    "comma": (44, 59, 58), "quote": (34, 39, 96), "bracket": (40, 41, 91, 93, 123, 125), "mark": (35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 124, 126, 92, 47, 60, 62), "dash": (45,), "control": (*range(9), *range(14, 32), 11, 12, 127),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k
_N_CLASS = len(_CLASSES) + 1  # the last: beyond ASCII
NAMES = [*_CLASSES, "beyond", "length", "words", "word_length", "word_spread", "short", "long", "distinct", "distinct_lines", "line_length", "capital", "packed", "top_word"]
DIM = len(NAMES)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of DIM transformed statistics for each text."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    share = (counts + 0.0) / np.maximum(size, 1)[:, None]
    out = np.zeros((n, DIM))
    out[:, :_N_CLASS] = np.log(share + 1e-3)
    s, e, per = word_spans(data, WHITE, off)
    of = np.repeat(np.arange(n), per)
    length = (e - s).astype(float)
    words = np.maximum(per, 1)
    total = lambda x: np.bincount(of, x, minlength=n)
    mean = total(length) / words
    # words without marks and case count as one
    s2, e2, per2 = word_spans(data, NO_WORD, off)
    of2 = np.repeat(np.arange(n), per2)
    h = span_hash(data, s2, e2)
    order = np.lexsort((h, of2))
    hs, ds = h[order], of2[order]
    cut = runs(hs ^ (ds.astype(np.uint64) << np.uint64(40)))
    kinds, most = np.zeros(n), np.zeros(n)
    if len(hs):
        np.add.at(kinds, ds[cut[:-1]], 1)
        np.maximum.at(most, ds[cut[:-1]], np.diff(cut))
    extra = [
        np.log1p(size), np.log1p(per), np.log1p(mean), np.sqrt(np.maximum(total(length**2) / words - mean**2, 0)),
        total(length <= 3) / words, total(length > 12) / words, kinds / np.maximum(per2, 1), np.ones(n), np.zeros(n),
        np.bincount(of, ((data[s] >= 65) & (data[s] <= 90)) if len(s) else None, minlength=n) / words, np.zeros(n), most / np.maximum(per2, 1),
    ]
    out[:, _N_CLASS:] = np.stack(extra, axis=1)
    raw = data.tobytes()
    for i in range(n):
        text = raw[off[i] : off[i + 1]]
        lines = text.split(b"\n")
        out[i, NAMES.index("distinct_lines")] = len(set(lines)) / len(lines)
        out[i, NAMES.index("line_length")] = np.log1p(len(text) / len(lines))
        out[i, NAMES.index("packed")] = len(zlib.compress(text, 1)) / (len(text) + 20)
    return out


@dataclass
class Moments:
    """Per class: number, sum, sum of outer products."""

    n: np.ndarray
    sum: np.ndarray
    outer: np.ndarray


@dataclass
class Discriminant:
    """Two Gaussians with shrunk covariances; factors are inverse Cholesky factors."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray

    @classmethod
    def fit(cls, m: Moments, shrink: float = 0.3, diagonal: float = 0.1) -> Discriminant:
        d = m.sum.shape[1]
        total = max(m.n.sum(), 1)
        prior = np.log((m.n + 1) / (m.n.sum() + 2))
        if (m.n < 2).any():
            return cls(np.zeros((2, d)), np.zeros((2, d, d)), prior)
        mean = m.sum / m.n[:, None]
        cov = m.outer / m.n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * m.n[:, None, None]).sum(0) / total
        factor, constant = np.zeros((2, d, d)), np.zeros(2)
        for k in range(2):
            lam = max(shrink, d / (d + m.n[k]))
            c = (1 - lam) * cov[k] + lam * pooled
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
            low = np.linalg.cholesky(c)
            factor[k] = np.linalg.inv(low)
            constant[k] = prior[k] - np.log(np.diag(low)).sum()
        return cls(mean, factor, constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in range(2)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


_VECTOR = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def document_vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the vector of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 4 << 20):
                x = statistics(*utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(np.arange(0, x.size + 1, DIM, dtype=np.int32), x.ravel())], schema=_VECTOR)

    return docs.select("doc_id", "text").mapInArrow(eased(run), "doc_id long, x array<double>")


def moments(labelled: DataFrame) -> Moments:
    """Of rows (x, label 0 or 1); partial sums leave the executors, a row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, o = np.zeros(2), np.zeros((2, DIM)), np.zeros((2, DIM, DIM))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            y = b.column("label").to_numpy(zero_copy_only=False)
            for k in range(2):
                part = x[y == k]
                n[k] += len(part)
                s[k] += part.sum(0)
                o[k] += part.T @ part
        flat = np.concatenate([n, s.ravel(), o.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    rows = labelled.mapInArrow(eased(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * DIM + 2 * DIM * DIM)
    for r in rows:
        flat[r["i"]] = r["v"]
    return Moments(flat[:2], flat[2 : 2 + 2 * DIM].reshape(2, DIM), flat[2 + 2 * DIM :].reshape(2, DIM, DIM))


def classify_quality(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    `labels` has doc_id and quality; `learn` says of a doc_id whether its label may be
    learned (default: crc32 of the id as text is not 0 modulo 5). The default threshold
    suits the contract's cut."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0 if learn is None else learn
    vectors = written(document_vectors(docs))
    known = labels.select(F.col("doc_id"), F.col("quality").alias("label")).where("label in (0, 1)").where(learn)
    model = Discriminant.fit(moments(vectors.join(known, "doc_id").select("x", "label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = vectors.select("doc_id", "x", F.coalesce(~learn, F.lit(True)).alias("held_out"))
    return held.mapInArrow(eased(run), "doc_id long, held_out boolean, score double, predicted int")
