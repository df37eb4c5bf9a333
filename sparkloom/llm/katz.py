"""LM scoring: a Katz backoff model of words and word grams, trained and evaluated in shards.

Counts are discounted by Good-Turing's estimate up to CUT; what the discounts leave goes to
words not seen behind a context, by backoff weights that are exact: for each context,
(1 - sum of its discounted probabilities) / (1 - sum of the lower order's probabilities of
the same words). P(w | h) is the gram's discounted probability where the gram was seen, else
the context's weight times P(w | h without its first word), and so on down to P(w), which is
the word's discounted probability where it was seen, else the mass of unknown words; a context
that was never seen has weight 1. A text's first word follows an end, and no context reaches
beyond that.

Where a context's discounts leave nothing (it has been seen with frequent followers alone),
one more, unseen, follower is added to its count, so that its backoff weight is not zero.

The tables are partitioned by hash and never meet in one place. A block of documents sends
each shard the different words (then pairs) that it holds, combined and counted, and gets
back what the shard knows of them, in the same order; so an exchange carries each different
word or pair of a block once, and no row per token. Contexts that hold a large share of all
tokens are salted over several shards by the word that follows; their sums are added up and
travel to all executors, at most HOT_CONTEXTS of them. That is a matter of the route alone:
all contexts get their probabilities and weights by one rule. Words go by 96-bit hashes.

Defined results: null and empty texts are one end. Rows with a null id are scored and not
learned. With nothing to learn from, every token is unknown with probability 1. Repeated rows
count as often as they stand there. Texts are read whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, WHITE, dealt, eased, mix64, pack, runs, shard_count, slices, span_hash, table, text_volume, unpack, utf8, word_spans, written

CUT = 5
#: Words of the longest grams.
ORDER = 2
BLOCK_BYTES = 4 << 20
WORD_SHARD_BYTES = 24 << 20
PAIR_SHARD_BYTES = 8 << 20
HOT_CONTEXTS = 1_000_000
HOT_LEAST = 1 << 18
#: Text bytes whose words, pairs and blocks go to one task.
TASK_WORDS, TASK_PAIRS, TASK_BLOCKS = 96 << 20, 32 << 20, 32 << 20
_END = (0x5851F42D4C957F2D, 0x14057B7E)


# ---------------------------------------------------------------- the model's numbers


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's discount ratios of counts 0..CUT from the numbers n[r] of things seen r times (r up to CUT + 1); 1 beyond.

    Where the raw counts of counts give no sound ratio (copies in a corpus make them uneven),
    they are smoothed by a line through their logarithms; where that fails as well, all ratios
    are the absolute discount's (r - 1/2) / r."""
    d = np.ones(CUT + 1)
    r = np.arange(1, CUT + 2)

    def ratios(n: np.ndarray) -> np.ndarray | None:
        top = (CUT + 1) * n[CUT] / n[0]
        ratio = ((r[:-1] + 1) * n[1:] / n[:-1] / r[:-1] - top) / (1 - top) if top < 1 else np.zeros(CUT)
        return ratio if ((ratio > 0) & (ratio < 1)).all() else None

    seen = np.asarray(n[1 : CUT + 2], float)
    found = None
    if (seen > 0).all():
        found = ratios(seen)
        if found is None:
            found = ratios(np.exp(np.polyval(np.polyfit(np.log(r), np.log(seen), 1), np.log(r))))
    d[1:] = (r[:-1] - 0.5) / r[:-1] if found is None else found
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * np.where(count <= CUT, d[np.minimum(count, CUT)], 1.0)


@dataclass
class Words:
    """The lower order: total N, kinds V, discounts, and the probability of unknown words."""

    total: int
    kinds: int
    d: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def of(cls, n: np.ndarray, total: int, kinds: int) -> Words:
        d = discounts(n)
        if not total:
            return cls(0, 0, d, 1.0, 0.0)
        kept = (total - (n[1 : CUT + 1] * np.arange(1, CUT + 1) * (1 - d[1:])).sum()) / total
        scale = 1.0 if kept < 1 - 1e-12 else total / (total + 1)
        return cls(total, kinds, d, 1 - kept * scale, scale)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) * self.scale / max(self.total, 1), self.unknown)


# ---------------------------------------------------------------- blocks of documents


_ROW = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())])
_ROW_DDL = "block long, shard long, blob binary"
STATE = -1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _ROW, strict=True)], schema=_ROW)


def _by_shard(block: int, shard: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Messages; rows are sorted by shard already."""
    cut = runs(shard) if len(shard) else [0]
    return [(block, int(shard[a]), pack(*(c[a:b] for c in columns))) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the hash, so that sorted words are sorted by shard."""
    return ((h >> np.uint64(34)) * np.uint64(shards) >> np.uint64(30)).astype(np.int64)


def _different(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in two parts: where each different one stands first, sorted by the high parts, and which one each is."""
    _, one, which = np.unique(high, return_index=True, return_inverse=True)
    if (low != low[one][which]).any():
        _, one, which = np.unique(np.stack([high, low.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
    return one, which


def _read(shards: int):
    """Documents to blocks: a state row with its tokens as numbers of the block's words, and the words' messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, BLOCK_BYTES):
                data, off = utf8(b.column("text"))
                low = LOWER[data]
                s, e, per = word_spans(low, WHITE, off)
                ends = np.cumsum(per + 1) - 1
                real = np.ones(len(s) + len(per), bool)
                real[ends] = False
                high, rest = np.full(len(real), _END[0], np.uint64), np.full(len(real), _END[1], np.uint32)
                high[real], rest[real] = span_hash(low, s, e), span_hash(low, s, e, 1)
                learn = b.column("learn").to_numpy(zero_copy_only=False).astype(bool)
                one, token = _different(high, rest)
                words = high[one]
                count = np.bincount(token[np.repeat(learn, per + 1)], minlength=len(words))
                ids = b.column("doc_id")
                state = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_valid()).astype(np.uint8), learn.astype(np.uint8), (per + 1).astype(np.uint64), token.astype(np.uint32), token[ends[:1]].astype(np.uint32))
                shard = _word_shard(words, shards)
                step = np.where(np.diff(shard, prepend=-1) != 0, words, np.diff(words, prepend=np.uint64(0)))
                yield _rows([(block, STATE, state), *_by_shard(block, shard, step, rest[one], count)])
                block += 1

    return run


_ANSWER = pa.schema([*_ROW, ("stats", pa.list_(pa.int64()))])
_ANSWER_DDL = _ROW_DDL + ", stats array<long>"


def _stats(count: np.ndarray) -> list[int]:
    """How many were seen 0..CUT + 1 times, then the total and the kinds."""
    return [*np.bincount(count[count <= CUT + 1], minlength=CUT + 2).tolist(), int(count.sum()), int((count > 0).sum())]


def _count_words(group: pa.Table) -> pa.Table:
    """A word shard: every block gets its words' numbers and total counts."""
    shard = group.column("shard")[0].as_py()
    parts = [unpack(b) for b in group.column("blob").to_pylist()]
    one, at = _different(np.concatenate([np.cumsum(x[0]) for x in parts]), np.concatenate([x[1] for x in parts]))
    total = np.zeros(len(one), np.int64)
    np.add.at(total, at, np.concatenate([x[2] for x in parts]))
    rows, end = [], 0
    for block, x in zip(group.column("block").to_pylist(), parts, strict=True):
        own = at[end : end + len(x[0])]
        end += len(x[0])
        rows.append((block, shard, pack(np.diff(own, prepend=0), total[own].astype(np.uint64)), None))
    rows[0] = (*rows[0][:3], _stats(total))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER)


def _add_up(answers: DataFrame) -> np.ndarray:
    """The shards' statistics added up: a fixed number of rows."""
    got = answers.where("stats is not null").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(CUT + 4, np.int64)
    for r in got:
        out[r["i"]] = r["v"]
    return out


@dataclass
class Level:
    """One order of the model: its discounts, where its grams lie, and up to which count a context lies in one shard."""

    order: int
    words: Words
    d: np.ndarray
    shards: int
    hot: int

    def lower(self, low: np.ndarray) -> np.ndarray:
        """The lower order's probabilities, from the words' counts or as they are."""
        return self.words.p(low.astype(np.int64)) if low.dtype.kind == "u" else low

    def weigh(self, blob: bytes) -> tuple[np.ndarray, ...]:
        """Of the shard's contexts: number, count, sums of discounted and of lower-order probabilities; of its grams: how many each context has, and their counts."""
        step, n, low, of_context = unpack(blob)[:4]
        context = np.cumsum(step)
        n, of_context = n.astype(np.int64), of_context.astype(np.int64)
        cut = runs(context)
        first, each = cut[:-1], np.diff(cut)
        p = discounted(n, self.d) / np.maximum(of_context, 1)
        return context[first], of_context[first], np.add.reduceat(p, first), np.add.reduceat(self.lower(low) * (n > 0), first), each, n

    def settle(self, size: np.ndarray, seen: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By context, from its count and whole sums: whether one more follower is reserved, and its backoff weight."""
        full = (size > 0) & (seen > 1 - 1e-9)
        seen = np.where(full, seen * size / (size + 1), seen)
        least = self.words.unknown if self.order == 2 else 1e-12
        return full, np.where(size > 0, np.maximum(1 - seen, 0) / np.maximum(1 - below, least), 1.0)

    def p(self, n: np.ndarray, lower: np.ndarray, of_context: np.ndarray, full: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """P(w | h) of grams, from their counts, the lower order's probabilities, their contexts' counts and what settle says."""
        return np.where(n > 0, discounted(n, self.d) / np.maximum(of_context + full, 1), weight * lower)


@dataclass
class Grams:
    """Different grams of a block, in message order, and each token's; `use`: the tokens that have a whole context."""

    shard: np.ndarray
    context: np.ndarray
    of_context: np.ndarray
    word: np.ndarray
    n: np.ndarray
    one: np.ndarray
    use: np.ndarray
    at: np.ndarray


#: A row of level k has its shard's number beyond k times this.
LEVEL = 1 << 40


class Block:
    """A block's tokens with what the shards of words and of shorter grams have answered."""

    def __init__(self, rows: list[tuple[int, bytes]], words: Words | None = None):
        self.ids, self.valid, self.learn, per, self.token, end = unpack(next(x for s, x in rows if s == STATE))
        self.per = per.astype(np.int64)
        answers = sorted((s, x) for s, x in rows if 0 <= s < LEVEL)
        self.replies = sorted((s, x) for s, x in rows if s >= LEVEL)
        parts = [unpack(x) for _, x in answers]
        self.number = np.concatenate([np.cumsum(x[0]).astype(np.uint64) + np.uint64(s << 32) for (s, _), x in zip(answers, parts, strict=True)])
        self.count = np.concatenate([x[1] for x in parts]).astype(np.int64)
        self.end = int(end[0])
        self.place = np.arange(len(self.token)) - np.repeat(np.cumsum(self.per) - self.per, self.per)
        # of each token, by the orders climbed so far
        self.p = None if words is None else words.p(self.count)[self.token]
        self.gram = self.n = np.zeros(0, np.int64)

    def grams(self, order: int, shards: int, hot: int) -> Grams:
        use = np.flatnonzero(self.place >= order - 2)
        if order == 2:
            known, of_known = self.number, self.count
            context = np.empty_like(self.token, np.int64)
            context[1:] = self.token[:-1]
            context[self.place == 0] = self.end
        else:
            known, one, context = np.unique(self.gram[use - 1], return_index=True, return_inverse=True)
            of_known = self.n[use - 1][one]
        words = np.uint64(len(self.number))
        code, one, at = np.unique(context.astype(np.uint64) * words + self.token[use], return_index=True, return_inverse=True)
        n = np.bincount(at[np.repeat(self.learn.astype(bool), self.per)[use]], minlength=len(code))
        context, word = (code // words).astype(np.int64), (code % words).astype(np.int64)
        salts = np.maximum(-(-of_known[context] // hot), 1).astype(np.uint64)
        salt = mix64(self.number[word]) % salts
        shard = (mix64(known[context] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
        by = np.lexsort((self.number[word], known[context], shard))
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        return Grams(shard[by], known[context[by]], of_known[context[by]], word[by], n[by], use[one[by]], use, back[at])

    def climb(self, level: Level) -> None:
        """Takes in what the shards of one more order have answered."""
        g = self.grams(level.order, level.shards, level.hot)
        low, high = level.order * LEVEL, (level.order + 1) * LEVEL
        parts = [(s - low, unpack(x)) for s, x in self.replies if low <= s < high]
        n, weight, full = (np.concatenate([x[i] for _, x in parts] or [np.zeros(0)]) for i in range(3))
        new = np.ones(len(n), bool)
        new[1:] = (g.shard[1:] != g.shard[:-1]) | (g.context[1:] != g.context[:-1])
        of, n = np.cumsum(new) - 1, n.astype(np.int64)
        self.p[g.use] = level.p(n, self.p[g.one], g.of_context, full[of], weight[of])[g.at] if len(n) else self.p[g.use]
        self.gram, self.n = np.zeros(len(self.token), np.uint64), np.zeros(len(self.token), np.int64)
        self.n[g.use] = n[g.at]
        if parts and len(parts[0][1]) > 3:
            self.gram[g.use] = np.concatenate([np.cumsum(x[3]).astype(np.uint64) + np.uint64(s << 32) for s, x in parts])[g.at]


def _table_rows(*tables: pa.Table) -> list[tuple[int, bytes]]:
    return [(s, x) for t in tables for s, x in zip(t.column("shard").to_pylist(), t.column("blob").to_pylist(), strict=True)]


def _send_grams(order: int, words: Words, below: list[Level], shards: int, hot: int):
    def run(group: pa.Table) -> pa.Table:
        b = Block(_table_rows(group), words)
        for level in below:
            b.climb(level)
        g = b.grams(order, shards, hot)
        low = b.count[g.word].astype(np.uint64) if order == 2 else b.p[g.one]
        rows = _by_shard(group.column("block")[0].as_py(), g.shard, np.diff(g.context, prepend=np.uint64(0)), b.number[g.word], g.n.astype(np.uint32), low, g.of_context.astype(np.uint64), g.context * (np.diff(g.shard, prepend=-1) != 0))
        return pa.Table.from_batches([_rows(rows)])

    return run


_GRAMS = pa.schema([("shard", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _count_grams(group: pa.Table) -> pa.Table:
    """A shard of grams: counts by context, and where each block's grams stand among them."""
    parts = [unpack(b) for b in group.column("blob").to_pylist()]
    context = np.concatenate([np.cumsum(np.concatenate([x[5][:1], x[0][1:]])) for x in parts])
    word, n, low, of_context = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3, 4))
    order = np.lexsort((word, context))
    new = np.ones(len(order), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    total = np.zeros(int(new.sum()), np.int64)
    np.add.at(total, at, n.astype(np.int64))
    first = order[new]
    sizes = np.array([len(x[0]) for x in parts], np.int64)
    blob = pack(np.diff(context[first], prepend=np.uint64(0)), total.astype(np.uint64), low[first], of_context[first], np.array(group.column("block").to_pylist(), np.int64), sizes, np.diff(at, prepend=0).astype(np.int64))
    return pa.Table.from_arrays([group.column("shard").slice(0, 1), pa.array([blob], pa.binary()), pa.array([_stats(total)], pa.list_(pa.int64()))], schema=_GRAMS)


def _answer_grams(level: Level, salted: tuple[np.ndarray, np.ndarray, np.ndarray], numbered: bool):
    """Every block gets the counts of its grams, of each of their contexts the backoff weight and whether a
    follower is reserved, and, as contexts of the next order, the grams' numbers.

    `salted`: numbers and whole sums of the contexts that lie in several shards."""
    numbers, seen_of, below_of = salted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                context, size, seen, below, each, n = level.weigh(blob)
                hot = size > level.hot
                at = np.searchsorted(numbers, context[hot])
                seen[hot], below[hot] = seen_of[at], below_of[at]
                full, weight = level.settle(size, seen, below)
                of = np.repeat(np.arange(len(size)), each)
                *_, blocks, sizes, at = unpack(blob)
                at = np.cumsum(at)
                ends = np.cumsum(sizes)
                for b, k, e in zip(blocks.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                    own = at[e - k : e]
                    first = of[own][runs(of[own])[:-1]]
                    steps = [np.diff(own, prepend=0)] if numbered else []
                    yield _rows([(b, level.order * LEVEL + shard, pack(n[own].astype(np.uint64), weight[first], full[first].astype(np.uint8), *steps))])

    return run


def _salted_sums(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                context, size, seen, below, *_ = level.weigh(blob)
                k = size > level.hot
                yield pa.RecordBatch.from_arrays([pa.array(context[k].view(np.int64)), pa.array(seen[k]), pa.array(below[k])], names=["context", "seen", "below"])

    return run


_SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(words: Words, levels: list[Level]):
    def run(group: pa.Table) -> pa.Table:
        b = Block(_table_rows(group), words)
        for level in levels:
            b.climb(level)
        doc = np.repeat(np.arange(len(b.per)), b.per)
        total = lambda x: np.bincount(doc, x, minlength=len(b.per))
        count = b.count[b.token]
        base = np.log10((count + 0.1) / (words.total + 0.1 * (words.kinds + 1)))
        columns = [
            pa.array(b.ids, mask=b.valid == 0), pa.array(b.learn == 0), pa.array(b.per), pa.array(total(count > 0).astype(np.int64)),
            pa.array(np.full(len(b.per), words.total, np.int64)), pa.array(total(base)), pa.array(total(np.log10(b.p))),
        ]
        return pa.Table.from_arrays(columns, schema=_SCORE)

    return run


def score_documents(docs: DataFrame, learn: Column | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    score: log10 probability of the text, its end included, under the model of the rows where
    `learn` holds (default: crc32 of the id as text is not 0 modulo 10), of grams of up to
    `order` words; base_score: the add-0.1 unigram model's."""
    if order < 2:
        raise ValueError("a backoff model needs an order of 2 at least")
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0 if learn is None else learn
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    rows, size = text_volume(own)
    if not rows:
        return docs.sparkSession.createDataFrame([], _SCORE_DDL)
    word_shards, gram_shards = shard_count(size, WORD_SHARD_BYTES), shard_count(size, PAIR_SHARD_BYTES)
    first = table(own.mapInArrow(eased(_read(word_shards)), _ROW_DDL).withColumn("message", F.col("shard") != STATE), "message")
    state, messages = (first.df.where(F.col("message") == m).select("block", "shard", "blob") for m in (False, True))
    answers = written(dealt(messages, "shard", size, TASK_WORDS).groupBy("shard").applyInArrow(_count_words, _ANSWER_DDL))
    first.drop("message=true")
    got = _add_up(answers)
    words = Words.of(got[: CUT + 2], int(got[CUT + 2]), int(got[CUT + 3]))
    hot = max(HOT_LEAST, words.total // HOT_CONTEXTS)
    blocks, levels = state.unionAll(answers.drop("stats")), []
    for k in range(2, order + 1):
        sent = dealt(blocks, "block", size, TASK_BLOCKS).groupBy("block").applyInArrow(_send_grams(k, words, list(levels), gram_shards, hot), _ROW_DDL)
        grams = table(dealt(sent, "shard", size, TASK_PAIRS).groupBy("shard").applyInArrow(_count_grams, "shard long, blob binary, stats array<long>"))
        level = Level(k, words, discounts(_add_up(grams.df)[: CUT + 2]), gram_shards, hot)
        # HOT_CONTEXTS rows of 24 bytes at most
        sums = grams.df.mapInArrow(eased(_salted_sums(level)), "context long, seen double, below double").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("below").alias("below")).toArrow()
        numbers = sums.column("context").to_numpy().view(np.uint64)
        by = np.argsort(numbers)
        replies = grams.df.mapInArrow(eased(_answer_grams(level, (numbers[by], sums.column("seen").to_numpy()[by], sums.column("below").to_numpy()[by]), k < order)), _ROW_DDL)
        if k < order:  # read again by the next orders
            replies = written(replies)
            grams.drop()
        levels.append(level)
        blocks = blocks.unionAll(replies)
    return dealt(blocks, "block", size, TASK_BLOCKS).groupBy("block").applyInArrow(_score(words, levels), _SCORE_DDL)
