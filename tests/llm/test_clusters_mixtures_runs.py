"""Centroid clustering, mixtures and periodic runs against brute force, on tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import clustering, mixing, periodic

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(7, [0.25] * 64), (7, [0.25] * 64), (None, [0.5] * 64), (None, None), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [1.0] * 63 + [float("nan")]), (204, [float("inf")] * 64), (205, [0.0] * 64), (206, [5000.0] * 64), (207, [])]


def _clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    now = [c for _, c in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(now)]
    found = [(i, *near(v)) for i, v in kept]
    own = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return sorted(((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, d, n in found), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (30, 3)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rng = random.Random(k)
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(base)]) for i in range(150)] + ODD
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, blob int").repartition(4)
    assert sorted(map(tuple, clustering.cluster_vectors(df, centroids=k, rounds=rounds).collect()), key=str) == _clusters(rows, k, rounds)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    few = clustering.cluster_vectors(df.where("vec_id in (205, 206)")).collect()
    assert {r.cluster for r in few} == {0, 1} and all(r.distance == 0 for r in few)
    assert clustering.cluster_vectors(df.where("vec_id = 204")).count() == 0 and clustering.cluster_vectors(df.where("false")).count() == 0
    assert clustering.cluster_vectors(df.where("vec_id is null")).count() == 1
    huge = spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r.distance for r in clustering.cluster_vectors(huge, centroids=1, rounds=0).collect()) == [0, clustering.LARGEST, clustering.LARGEST]
    assert clustering.cluster_vectors(huge, centroids=1).count() == 3


@pytest.mark.parametrize("spread", [5, 1 << 30])
def test_ring_holds_the_nearest_and_ties(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread, (40, 3)).tolist() + [[1, 1, 1], [1, 1, 1], [-1, -1, -1]]
    q = np.concatenate([rng.integers(-spread, spread, (500, 3)), np.array([[0, 0, 0], [1, 1, 1]])])
    cluster, distance = clustering.Annulus(centres).assign(q)
    for v, c, d in zip(q.tolist(), cluster.tolist(), distance.tolist(), strict=True):
        assert (int(d), c) == min((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), n) for n, w in enumerate(centres))


def _targets(size):
    names = sorted((x for x in size if x is not None), key=lambda x: x.encode()) + ([None] if None in size else [])
    weight = {n: Fraction((3, 1, 2)[i % 3]) for i, n in enumerate(names)}
    target, free, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(3 * sum(size.values()), 2)
    while left > 0 and free:
        whole = sum(weight[n] for n in free)
        for n in free:
            target[n] += left * weight[n] / whole
        left = Fraction(0)
        for n in [n for n in free if target[n] >= 2 * size[n]]:
            left += target[n] - 2 * size[n]
            target[n] = Fraction(2 * size[n])
            free.discard(n)
    return target


def _mixture(rows, weight):
    docs = [(i, len(WORD.findall(t or "")), s, t) for i, t, s in rows]
    size = {}
    for _, n, s, _ in docs:
        size[s] = size.get(s, 0) + n
    target, out = _targets(size), []
    for s in size:
        budget, run = round(float(target[s])), 0
        epochs = budget // size[s] if size[s] else 0
        drawn = lambda d: hashlib.md5(f"12:{d[0] if d[0] is not None else hashlib.md5((d[3] or '').encode()).hexdigest()}".encode()).hexdigest()
        key = lambda d: (-math.log((int(drawn(d)[:12], 16) + 0.5) / 2**48) / weight.get(d[0], 1), d[0] if d[0] is not None else -1, d[1])
        for d in sorted((d for d in docs if d[2] == s), key=key):
            some = max(0, min(d[1], budget - epochs * size[s] - run))
            run += d[1]
            out.append((d[0], s, d[1], size[s], float(target[s]), epochs * d[1] + some))
    return sorted(out, key=str)


def test_mixture_equals_brute_force_and_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 300]))) if rng.random() < 0.97 else None, rng.choice(["a", "b", "b", "b", "b", "B", "é", "z", None, "~tiny"])) for i in range(700)]
    rows += [(5, "x y", "a"), (5, "x y", "a"), (None, "n o p", "b"), (None, "n o p", "b"), (None, None, None), (1000, "big " * 20000, "one"), (1001, "w", "t3"), (1002, "", "empty")]
    weight = {i: rng.choice([4.0, 0.5]) for i in range(0, 700, 3)}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, target int").repartition(5)
    given = spark.createDataFrame([*weight.items(), (3, 0.1), (4, -1.0), (None, 2.0)], "doc_id long, weight double")
    plan = mixing.plan_mixture(df, given)
    got = [tuple(r[c] for c in ("doc_id", "source", "size", "source_size", "target", "taken")) for r in plan.collect()]
    assert sorted(got, key=str) == _mixture(rows, weight)
    for s in {r[1] for r in got}:
        own = [r for r in got if r[1] == s]
        assert abs(sum(r[5] for r in own) - own[0][4]) <= 0.5 and all(r[5] <= 2 * r[2] for r in own)
    assert sorted(map(tuple, mixing.plan_mixture(df.repartition(2), given).collect()), key=str) == sorted(map(tuple, plan.collect()), key=str)


def test_mixed_texts_hold_the_words_taken(spark, docs):
    known = docs.where("doc_id is not null")
    plan = mixing.plan_mixture(known)
    taken = {r.doc_id: r.taken for r in plan.collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixing.mixed_texts(known, plan).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == taken
    assert mixing.plan_mixture(docs).count() == docs.count()


def test_better_documents_come_first(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id < 2000 THEN 'p' ELSE 'q' END AS source")
    weight = df.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN 9.0 ELSE 1.0 END AS weight")
    got = mixing.plan_mixture(df, weight, weights=(1, 3), share=(1, 2)).where("source = 'p' AND taken > 0").selectExpr("count(*) n", "count_if(doc_id % 2 = 0) good").first()
    assert got.n == 500 and got.good > 400


def test_mixture_of_nothing(spark, no_docs):
    assert mixing.plan_mixture(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.plan_mixture(blank).collect()] == [(0, 0.0, 0)] * 2


def _runs(w, exponent=4, least=6):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p) and not any((i, j - i + p) == x[:2] for x in out):
                out.append((i, j - i + p, p))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 3, 6, 8, 12, 40, 90]), rng.choice([1, 2, 3, 10])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n > 5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        exponent = rng.choice([2, 3, 4, 5])
        words = np.array(sum(texts, []), np.int64)
        if len(words):
            got = list(zip(*[x.tolist() for x in periodic.find_runs(words, np.array([len(w) for w in texts]), exponent, 6)], strict=True))
            assert got == [(d, *r) for d, w in enumerate(texts) for r in _runs(w, exponent)]


def test_long_extensions():
    t = np.array([9, *([1, 2, 3] * 700), 8, *([1] * 500), 7, *([1, 2, 3] * 300), 6])
    ask = periodic.Extensions(t)
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, len(t), (2, 3000))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), ask(i, j).tolist(), strict=True):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert n == k


def test_documents_with_planted_runs(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ka", "lo", "mi é", "tu"]) for _ in range(rng.choice([0, 4, 30, 200]))) for _ in range(150)] + [None, "", " \t ", "ab " * 30000, "a b\x0bc d " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x y " * 9), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, collapsed int").repartition(3)
    import zlib

    expected = []
    for i, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        found = _runs(w) if len(w) < 5000 else [(0, len(w), 1)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        gone = set().union(*[range(s + p, s + n) for s, n, p in found]) if found else set()
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(df)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert got.where("false").count() == 0


def test_runs_of_any_table(docs, no_docs):
    assert periodic.periodic_runs(docs).count() == docs.count() and periodic.periodic_runs(no_docs).count() == 0
    runs = {r.doc_id: r for r in periodic.periodic_runs(docs).where("size(runs) > 0").collect()}
    assert any(len(r.collapsed.split()) < r.n_words for r in runs.values())
