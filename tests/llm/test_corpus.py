"""Operators over documents against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, jaccard, katz, langid, licenses, packing, quality, sharding, substrings, suffix_array
from sparkloom.llm.common import components, rolling_hash, same_spans, span_hash, utf8

from tests.llm.conftest import words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates(docs, no_docs, corpus):
    sets = [frozenset(x.tolist()) for x in jaccard.shingle_sets(*utf8(pa.array([t[1] for t in corpus], pa.string())))]
    links, root = collections.Counter(), list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(jaccard.near_duplicates(docs))
    assert {d: (r["class_id"], r["n_links"]) for d, r in got.items()} == {i: (find(i), links[i]) for i in range(len(sets))}
    assert any(links.values()) and jaccard.near_duplicates(no_docs).count() == 0
    forest = jaccard.Forest()
    assert forest.shortest == 4 and forest.found(0.8, 4) >= forest.recall > forest.found(0.8, 5)
    with pytest.raises(ValueError):
        jaccard.Forest(0.05, 0.99999).shortest


def test_large_groups_are_cut_into_blocks(spark, monkeypatch, docs):
    want = {d: tuple(r) for d, r in by_id(jaccard.near_duplicates(docs)).items()}
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 1)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 1)
    assert {d: tuple(r) for d, r in by_id(jaccard.near_duplicates(docs)).items()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def repeats(texts, length):
    seen, out = set(), {}
    for d, t in texts:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                mask[i : i + length] = True
            seen.add(b[i : i + length])
        out[d] = (len(b), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_repeated_substrings(docs, no_docs, corpus, hot):
    got = {d: tuple(r)[1:] for d, r in by_id(substrings.remove_repeats(docs, hot=hot)).items()}
    want = repeats([x[:2] for x in corpus], 100)
    assert {d: v for d, v in got.items() if d is not None} == want and sum(v[1] for v in want.values()) > 0
    if hot == 1:
        return
    cleaned = by_id(substrings.without_repeats(docs))
    assert set(cleaned[0].asDict()) == set(docs.columns)
    for d, r in cleaned.items():
        if d is not None and want[d][1] == 0:
            assert r["text"] == corpus[d][1]
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert substrings.remove_repeats(no_docs).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(150):
        b = np.tile(rng.integers(0, rng.integers(1, 4), rng.integers(1, 40)).astype(np.uint8), rng.integers(1, 4))
        raw = b.tobytes()
        sa = suffix_array.suffix_array(b)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        common = suffix_array.permuted_common_prefixes(b, sa, 25)
        for x, y in zip(sa[:-1], sa[1:], strict=True):
            n = next((k for k, (p, q) in enumerate(zip(raw[x:], raw[y:])) if p != q), min(len(raw) - x, len(raw) - y))
            assert common[y] == min(n, 25)


def test_decontamination(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "A farmer sells 12 apples to Berta for 3 dollars each and keeps 12 more apples at home"), (2, "short one here now"), (3, None), (4, "")], "item_id long, text string")
    rows = [
        (1, "x y z. a farmer sells 12 apples to Berta for 3 dollars each and keeps 12 more apples at home. end"), (2, "So a farmer sells 40 apples to Clara for 5 dollars each and keeps 40 more apples at home!"),
        (3, "So a farmer sells 40 apples to Clara for 5 dollars each and keeps 77 more apples at home!"), (4, "nothing of the kind stands in this text at all, it is quite clean and long enough"), (5, "they said: short one here now. yes"), (6, None), (7, ""),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(d, items).collect())
    assert got == [(1, 1), (2, 1), (5, 2)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(d, items, most_broadcast=0).collect()) == got
    assert decontamination.find_contamination(no_docs, items).count() == 0 == decontamination.find_contamination(docs, items.where("item_id > 2")).count()


def contaminated(spark, docs, items, **kw):
    d, b = (spark.createDataFrame(list(x.items()), f"{k}_id long, text string") for k, x in (("doc", docs), ("item", items)))
    return sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(d, b, **kw).collect())


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_decontamination_of_slot_heavy_and_short_items(spark, most):
    items = {1: "What is 12 + 7 + 9 + 13 + 45 + 6?", 2: "Berta Clara Dora Emil Fritz Gustav Hans Ida Jakob", 3: "blue whale", 4: "Plain words make up this whole question, señor, do they not", 5: "quux"}
    texts = {1: f"Then: {items[1]} Yes", 2: "So: " + items[2], 3: "a Blue Whale. A blue whale swims", 4: items[4].upper(), 5: items[4].title(), 6: "What is 3 + 8 + 1 + 2 + 4 + 5?", 7: "blue and whale", 8: "Quux", 9: "quuxes"}
    assert contaminated(spark, texts, items, most_broadcast=most) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (8, 5)]


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_decontamination_of_names_that_begin_sentences(spark, most):
    items = {
        1: "Tom has 3 red apples. Anna has 5 green apples. Tom gives Anna 2 apples. How many apples does Tom have?", 2: "Tom has 3 apples and buys 5 more",
        3: "The train leaves Paris with 40 guests. Paris lies far behind when it reaches Rome with 30 of them", 4: "If Emma paints 4 walls each day. When is her house with 48 walls done",
    }
    texts = {
        1: "Ben has 7 red apples. Carla has 9 green apples. Ben gives Carla 4 apples. How many apples does Ben have?", 2: "Yesterday Mary Ann has 8 apples and buys 2 more", 3: "Dave has 4 apples and buys 6 more",
        4: "Ben has 7 red apples. Carla has 9 green apples. Dora gives Carla 4 apples. How many apples does Emil have?",
        5: "So the train leaves New York with 50 guests. New York lies far behind when it reaches San Jose with 20 of them!", 6: "if Mary Ann paints 5 walls each day. When is her house with 60 walls done", 7: "Dave has four apples and buys 6 more",
    }
    assert contaminated(spark, texts, items, most_broadcast=most) == [(1, 1), (2, 2), (3, 2), (5, 3), (6, 4)]


def test_template_windows_against_every_reading():
    text = "Tom Lee has 3 cm. Ann-Marie Poe, Bo ran. In Rome It is 4 pm. Up. Do. If. so it was in New York then"
    w = decontamination.template(*utf8(pa.array([text, "Al. x y", ""])))
    want = set()

    def walk(start, p, read, slots, k):
        if k in (2, 4) and 2 * slots <= k:
            want.add((k, start, p, read))
        if k < 4 and p < (len(w.own) - 3 if start < len(w.own) - 3 else len(w.own)):
            walk(start, int(w.after[p]), read, slots + bool(w.slot[p] and k), k + 1)
            if w.opener[p]:
                walk(start, int(w.run[p]), read | 1 << k, slots + (k > 0), k + 1)

    for i in np.flatnonzero(~w.inner).tolist():
        walk(i, i, 0, 0, 0)
    for block in (1 << 19, 8):
        decontamination.BLOCK, before = block, decontamination.BLOCK
        got = [(k, *x) for k, a, p, _, r in decontamination.template_windows(w, [2, 4]) for x in zip(a.tolist(), p.tolist(), r.tolist(), strict=True)]
        decontamination.BLOCK = before
        assert len(got) == len(set(got)) and set(got) == want


def test_licenses(spark, docs, no_docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rows = [(1, "GNU General-Public License. All rights reserved; all RIGHTS reserved"), (2, "cc by by cc by"), (3, None), (4, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH x-exception) AND Apache-2.0 */"), (5, "SPDX-License-Identifier: MIT OR"), (6, "éall rights reserved")]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    for d, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if [x.decode() for x in w[i : i + len(p.split())]] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    assert got[4]["labels"] == "apache,gpl,mit,spdx" and got[4]["score"] == pytest.approx(0.9) and "malformed" in got[5]["labels"]
    assert licenses.evaluate(["gpl-2.0", "x", "with"])[0] == pytest.approx(0.45)
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(no_docs).count() == 0


def test_quality(spark, docs, no_docs):
    good, bad = "Plain words stand in a row here, and more of them follow. ", "#### $$ %% 12 !! ## "
    d = spark.createDataFrame([(i, (good if i % 3 else bad) * (1 + i % 7) + str(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(7, None)], "doc_id long, quality int")
    got = by_id(quality.classify_quality(d, labels))
    held = [i for i in got if got[i]["held_out"]]
    assert sorted(held) == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0] and all(got[i]["predicted"] == int(i % 3 > 0) for i in held)
    none = quality.classify_quality(docs, labels.where("doc_id < 0")).collect()
    assert len(none) == docs.count() and all(r["score"] == 0.5 for r in none) and quality.classify_quality(no_docs, labels).count() == 0


def test_packing(docs, no_docs, corpus):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(VOCABULARY)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in corpus} | {None: [*tok.encode("no id at all here", add_special_tokens=False).ids, 1]}
    pieces = packing.pack_documents(docs, VOCABULARY)
    bins, back = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces.collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        back[r["doc_id"]].append((r["start"], r["length"]))
    for pieces_ in (*bins.values(), *back.values()):
        at = 0
        for start, n in sorted(pieces_):
            assert start == at
            at += n
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values()) and {d: sum(n for _, n in x) for d, x in back.items()} == {d: len(x) for d, x in ids.items()}
    assert packing.padding(pieces).first()["padding"] == 0 and packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_limits_of_packing():
    rng = np.random.default_rng(1)
    p, got = packing.Packer(packing.Limits(64, 3, 20), window=16), []
    sizes = rng.integers(1, 150, 80)
    for i, n in enumerate(sizes):
        got += p.add(packing.Item(i, 0, np.arange(n, dtype=np.uint32), rng.random(n) < 0.4, n))
    got += p.close()
    for _, b in got:
        assert sum(len(x.ids) for x in b) <= 64 and len(b) <= 3 and sum(x.n_loss() for x in b) <= 20
    assert sum(len(x.ids) for _, b in got for x in b) == sizes.sum()


def test_language(spark, docs, no_docs):
    rng = np.random.default_rng(2)
    parts = {"aa": ["ing", "the", "er", "wh"], "bb": ["ção", "que", "os", "lh"], "cc": ["сто", "ния", "пр"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(25))
    rows = [(i, make(k), k) for i in range(240) for k in [list(parts)[i % 3]]]
    got = by_id(langid.identify_language(spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, "", None)], "doc_id long, text string, lang string")))
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and langid.identify_language(no_docs).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    text, sample = "abcabxcab", "xcabc"
    phrases, at = 0, 0
    while at < len(text):
        n = max([k for k in range(1, len(text) - at + 1) if text[at : at + k] in sample], default=1)
        phrases, at = phrases + 1, at + n
    m = langid.Model(["x"], [sample]).build()
    s = m.symbol[langid.code_points(text.encode())]
    assert m.phrases(s, np.array([0, len(s)]))[0, 0] == phrases


def test_language_of_large_alphabets(spark):
    rng = np.random.default_rng(3)
    # four scripts of which the first two have most letters; the last two differ in letters alone
    letters = {"la": (97, 26), "cy": (0x430, 32), "k1": (0xAC00, 200), "k2": (0xB000, 200)}
    make = lambda k, n: " ".join("".join(chr(letters[k][0] + i) for i in rng.integers(0, letters[k][1], 3)) for _ in range(n))
    rows = [(i, make(k, 60 if k in ("la", "cy") else 25), k) for i in range(400) for k in [list(letters)[i % 4]]]
    got = by_id(langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    sample, text = make("k1", 300) + "".join(chr(0xAC00 + i) for i in range(200)), make("k1", 40) + "zz"
    m = langid.Model(["x", "y"], [make("k2", 50), sample]).build()
    assert m.size > langid.SYMBOLS
    phrases, at = 0, 0
    while at < len(text):
        n = max([k for k in range(1, len(text) - at + 1) if text[at : at + k] in sample], default=1)
        phrases, at = phrases + 1, at + n
    s = m.symbol[langid.code_points(text.encode())]
    assert m.phrases(s, np.array([0, len(s)]))[0, 1] == phrases


@pytest.mark.parametrize("hot, order", [(katz.HOT_LEAST, 2), (3, 2), (katz.HOT_LEAST, 3), (2, 4)])
def test_katz(docs, no_docs, corpus, monkeypatch, hot, order):
    monkeypatch.setattr(katz, "HOT_LEAST", hot)
    streams = {d: [None, *(t or "").encode().lower().split(), None] for d, t, *_ in corpus}
    learn = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in streams}
    grams = {k: collections.Counter(tuple(w[i - k + 1 : i + 1]) for d, w in streams.items() if learn[d] for i in range(1, len(w)) if i - k + 1 >= 0) for k in range(1, order + 1)}
    uni = grams[1]
    count_of = lambda c: np.bincount([min(x, 7) for x in c.values()], minlength=8)[:7]
    words = katz.Words.of(count_of(uni), sum(uni.values()), len(uni))
    p1 = lambda w: float(words.p(np.array([uni[(w,)]]))[0])
    assert sum(p1(w) for (w,) in uni) + words.unknown == pytest.approx(1)
    known, weight = {}, {}

    def p(h, w):
        return p1(w) if not h else known[(*h, w)] if (*h, w) in known else weight.get(h, 1.0) * p(h[1:], w)

    for k in range(2, order + 1):
        d = katz.discounts(count_of(grams[k]))
        followers = collections.defaultdict(dict)
        for g, n in grams[k].items():
            followers[g[:-1]][g[-1]] = n
        for h, seen in followers.items():
            size = sum(seen.values())
            probs = {w: float(katz.discounted(np.array([n]), d)[0]) / size for w, n in seen.items()}
            scale = size / (size + 1) if sum(probs.values()) > 1 - 1e-9 else 1
            known |= {(*h, w): x * scale for w, x in probs.items()}
            weight[h] = (1 - sum(probs.values()) * scale) / (1 - sum(p(h[1:], w) for w in seen))
            if k == 2 and len(h) == 1:
                assert sum(probs.values()) * scale + weight[h] * (1 - sum(p1(w) for w in seen)) == pytest.approx(1)

    got = by_id(katz.score_documents(docs, order=order))
    for d, w in streams.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn[d], len(w) - 1, sum((x,) in uni for x in w[1:]), sum(uni.values()))
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[(x,)] + 0.1) / (words.total + 0.1 * (words.kinds + 1))) for x in w[1:]))
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))), rel=1e-9)
    assert katz.score_documents(no_docs).count() == 0


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    at = {n: (int.from_bytes((h := hashlib.md5(n.encode()).digest())[:8], "big") % 101, int.from_bytes(h[8:], "big") % 100 + 1) for n in names}
    want, step = [None] * 101, dict.fromkeys(names, 0)
    while None in want:
        for n in names:
            if None not in want:
                break
            while want[k := (at[n][0] + step[n] * at[n][1]) % 101] is not None:
                step[n] += 1
            want[k] = n
    assert [names[i] for i in table] == want and max(collections.Counter(table).values()) - min(collections.Counter(table).values()) <= 1
    d = spark.createDataFrame([(i, "k") for i in range(300)] + [(None, "k")], "doc_id long, k string")
    got = sharding.assign_shards(d, "doc_id", names, 101).collect()
    assert len(got) == 301 and all(r["shard"] == want[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % 101] for r in got if r["doc_id"] is not None)
    assert sharding.assign_shards(d, "k", names, 101).select("shard").distinct().count() == 1 and sharding.assign_shards(d, "k", names, 101, spread=20).select("slot").distinct().count() > 5
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


@pytest.mark.parametrize("block", [None, 64])
def test_neighbours(spark, monkeypatch, block):
    from sparkloom.llm import neighbours

    if block:
        monkeypatch.setattr(neighbours, "CELL_ROWS", 300)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        monkeypatch.setattr(neighbours, "BLOCK_ASKED", 7)

    rng = np.random.default_rng(4)
    v = rng.standard_normal((1200, 16)).round(3)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] * 3, 1), (None, [1.0] * 16, 1), (5, [float(x) for x in v[5]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hit = total = 0
    for q in range(0, 1200, 20):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = [(d[i], i) for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q]) and all(s == pytest.approx(d[i]) for s, i in got[q])
        hit, total = hit + len({i for _, i in best} & {i for _, i in got[q]}), total + 10
    assert hit >= 0.9 * total and [i for _, i in got[100]] == list(range(101, 111)) and [i for _, i in got[120]] == list(range(100, 110)) and set(got) == set(range(0, 1200, 20))
    twice = neighbours.nearest_neighbours(df.unionByName(df.where("vec_id < 50").withColumn("embedding", F.lit([9.0] * 16).cast("array<double>"))), F.col("vec_id") % 20 == 0)
    assert twice.count() == 600 == twice.select("query_id", "vec_id").distinct().count()
    few = neighbours.nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2] and neighbours.nearest_neighbours(df.where("vec_id = 2001"), F.lit(True)).count() == 0


def parity_words(n):
    """Two words of n letters, letter i by the parity of the set bits of i: polynomials modulo 2^64 take them for one."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hashes_that_collide_decide_nothing(spark):
    rng = np.random.default_rng(9)
    some = rng.integers(97, 123, (50_000, 48)).astype(np.uint8)
    anchor = some[int(np.argmin([int(rolling_hash(x, 48)[0]) for x in some]))].tobytes().decode()
    texts = ["".join(anchor + w[i] + f"{i:03d}" for i in range(512)) + anchor for w in parity_words(512)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = repeats(enumerate(texts), 100)
    assert want[1][1] == 0 and {i: tuple(r)[1:] for i, r in by_id(substrings.remove_repeats(d)).items()} == want
    one, two = parity_words(4096)
    h = span_hash(np.frombuffer((one + two).encode(), np.uint8), np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(VOCABULARY)
    words = packing.WordPieces(VOCABULARY)
    got, edge = words.ids(*utf8(pa.array([one, two, f"{two} {one}"])), 1)
    assert [got[a : b - 1].tolist() for a, b in zip(edge[:-1], edge[1:])] == [tok.encode(x, add_special_tokens=False).ids for x in (one, two, f"{two} {one}")]
    rows = [(i, one) for i in range(1, 9)] + [(100, two)]
    learn = F.col("doc_id") < 100
    got = by_id(katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), learn))
    assert got[100]["n_known"] == 1 and got[1]["n_known"] == 2 and got[1]["train_tokens"] == 16
    same = by_id(jaccard.near_duplicates(spark.createDataFrame([(1, one + " x y z q"), (2, two + " x y z q")], "doc_id long, text string")))
    assert [same[i]["class_id"] for i in (1, 2)] == [1, 2]


def test_spans_are_told_apart():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 3000)
    size = rng.integers(0, 90, 3000)
    h = span_hash(data, start, start + size)
    raw = data.tobytes()
    by = {}
    for i, (s, n) in enumerate(zip(start.tolist(), size.tolist())):
        assert by.setdefault(raw[s : s + n], h[i]) == h[i]
    assert len(set(by.values())) == len(by)
    other = rng.integers(0, 4000, 3000)
    assert same_spans(data, start, other, size).tolist() == [raw[a : a + n] == raw[b : b + n] for a, b, n in zip(start, other, size)]


def test_packing_with_another_kind_of_vocabulary():
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    words, tok = packing.WordPieces(path), tokenizers.Tokenizer.from_file(path)
    texts = ["Case Matters here  and  spaces", None, "a b"]
    got, edge = words.ids(*utf8(pa.array(texts)), 7)
    assert words.whole and [got[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [[*tok.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_repeats_in_long_texts_and_hot_passages(spark, monkeypatch):
    rng = random.Random(3)
    passage = words(rng, 40)[:140]
    texts = ["a" * 300_000, "xy" * 3000, *(words(rng, 6) + passage + words(rng, 6) for _ in range(300)), "b" * 150 + "a" * 120]
    want = repeats(enumerate(texts), 100)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert want[0][1] == 299_999
    for windows in (substrings.WINDOWS, 700):
        monkeypatch.setattr(substrings, "WINDOWS", windows)
        assert {i: tuple(r)[1:] for i, r in by_id(substrings.remove_repeats(d, hot=20_000)).items()} == want


def test_forest_finds_pairs_at_the_threshold(spark):
    rng = random.Random(8)
    texts = []
    for k in range(60):
        w = words(rng, 160).split()
        texts.append(" ".join(w))
        for n in (1, 2, 3, 4):  # similarities of 0.94 down to 0.77
            v = list(w)
            for i in rng.sample(range(10, 150), n):
                v[i] = f"q{rng.random()}"
            texts.append(" ".join(v))
    sets = [frozenset(x.tolist()) for x in jaccard.shingle_sets(*utf8(pa.array(texts)))]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if i // 5 == j // 5 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = collections.Counter(x for pair in near for x in pair)
    got = by_id(jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert len(near) > 200 and {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in range(len(texts))}


def test_prefixes_shrink_only_where_recall_is_short():
    forest = jaccard.Forest(recall=0.999)
    assert forest.shortest == 6 and forest.estimate(np.array([0, 1, 50]), np.array([1.0, 0.95, 0.95]), 7).tolist() == sorted(forest.estimate(np.array([0, 1, 50]), np.array([1.0, 0.95, 0.95]), 7))
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, jaccard.TREES * jaccard.DEPTH).astype(np.uint16)
    close = np.tile(base, (40, 1))
    close[:, 100:] = np.where(rng.random((40, 96)) < 0.05, 7, close[:, 100:])  # near copies; equal in the first tries
    edge = base.copy()
    edge[6], edge[60:90] = 1, 2  # shares six values of the first trie, and 0.84 of all
    all_ = np.vstack([close, edge])
    links = jaccard.walk_trie(forest, np.arange(41), all_, 0)
    assert len(links) == 40 and forest.estimate(np.array([39]), np.array([0.9]), 7)[0] >= forest.recall > forest.estimate(np.array([0]), np.array([1.0]), 7)[0]
    strict = jaccard.Forest(recall=0.9)
    assert strict.shortest == 7 and len(jaccard.walk_trie(strict, np.arange(41), all_, 0)) == 39


def test_sharding_keeps_columns_of_any_name(spark):
    names = [f"s{i}" for i in range(3)]
    d = spark.createDataFrame([(1, "a", 5, "x", "y"), (2, "b", 6, None, "z")], "doc_id long, shard string, slot int, __k string, key_of_row string")
    got = sharding.assign_shards(d, "doc_id", names, 101, spread=1)
    assert got.columns == ["doc_id", "__k", "key_of_row", "slot", "shard"] and {r["shard"] for r in got.collect()} <= set(names)
    by_shard = sharding.assign_shards(d, "shard", names, 101).collect()
    assert {r["doc_id"]: r["slot"] for r in by_shard} == {i: int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % 101 for i, k in ((1, "a"), (2, "b"))}
    assert sharding.assign_shards(d.where("doc_id < 0"), "doc_id", names, 101).count() == 0


def test_decontamination_against_brute_force(spark):
    """Every item against every document: whole items that stand in a document word for word, in any case, are found; documents without a window of an item's words or its frame are not."""
    rng = random.Random(12)
    items = {i: words(rng, rng.choice([1, 2, 3, 5, 9, 14, 30])) + (" 7 of 9" if i % 4 == 0 else "") for i in range(60)}
    texts, planted = {}, set()
    for d in range(200):
        t = [words(rng, rng.randint(0, 40))]
        for i in rng.sample(sorted(items), rng.choice([0, 0, 1, 2])):
            t += [items[i].upper() if rng.random() < 0.3 else items[i], words(rng, rng.randint(0, 9))]
        texts[d] = ". ".join(t)
    split = lambda t: re.findall(r"[0-9a-zé]+", t.lower())
    spans = {d: {tuple(w[k : k + n]) for n in range(1, 9) for k in range(len(w) - n + 1)} for d, t in texts.items() for w in [split(t)]}
    want = {(d, i) for i, t in items.items() for w in [split(t)] for n in [min(len(w), 8)] for d in texts if any(tuple(w[k : k + n]) in spans[d] for k in range(len(w) - n + 1))}
    got = set(contaminated(spark, texts, items)) | planted
    assert want <= got and len(want) > 100
    frame = lambda w: tuple("#" if x[0].isdigit() else x for x in w)
    frames = {d: {frame(s) for s in x} for d, x in spans.items()}
    for d, i in got - want:  # template hits: the frame has to stand there
        w = split(items[i])
        assert any(frame(w[k : k + min(len(w), 8)]) in frames[d] for k in range(len(w)))
    doubled = spark.createDataFrame([(i, t, "x", 1) for i, t in [*texts.items(), *texts.items()]], "doc_id long, text string, item_id string, h long")
    clash = spark.createDataFrame([(i, t, "d", True) for i, t in items.items()], "item_id long, text string, doc_id string, lit boolean")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(doubled, clash).collect()} == got


def test_quality_against_a_plain_discriminant(spark, corpus):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(1, 60)) + ("!! $$ 12 " * rng.randint(0, 3) if i % 2 else ". ")) for i in range(240)] + [(500, words(rng, 20_000)), (501, ""), (502, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 2 == 0)) for i in range(240)] + [(4, 1)] * 3  # a repeated labelled row counts as often
    got = by_id(quality.classify_quality(d, spark.createDataFrame(labels, "doc_id long, quality int")))
    x = quality.statistics(*utf8(pa.array([t for _, t in rows], pa.string())))
    at = {i: k for k, (i, _) in enumerate(rows)}
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    part = [np.array([x[at[i]] for i, y in learned if y == k]) for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in part]
    n = [len(p) for p in part]
    pooled = sum(c * m for c, m in zip(cov, n)) / sum(n)
    log = []
    for k in (0, 1):
        lam = max(0.3, quality.DIM / (quality.DIM + n[k]))
        c = (1 - lam) * cov[k] + lam * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-4 * np.eye(quality.DIM)
        z = x - part[k].mean(0)
        log.append(np.log((n[k] + 1) / (sum(n) + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    assert all(got[i]["score"] == pytest.approx(want[k], rel=1e-5, abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.3) for i, k in at.items())


def test_language_by_plain_parsing(spark):
    """Whole predictions against longest matches found by substring search."""
    rng = random.Random(6)
    alphabet = {"aa": ["ka", "lo", "mi"], "bb": ["ko", "la", "me"], "cc": ["ki", "lu", "ma"]}
    rows = [(i, " ".join("".join(rng.choice(alphabet[k]) for _ in range(3)) for _ in range(rng.randint(2, 30))), k) for i in range(150) for k in [list(alphabet)[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = langid.fit(d, learn, each=400)
    assert all(len(s) <= 400 for s in model.samples) and len(langid.fit(d, learn, languages=2).languages) == 2
    got = by_id(langid.identify_language(d, each=400))
    for i, t, _ in rows:
        rate = []
        for s in model.samples:
            s = re.sub("[^a-z]+", " ", s)
            pieces = 0
            for at in range(0, len(t), langid.STRETCH):
                part, p = t[at : at + langid.STRETCH], 0
                while p < len(part):
                    p, pieces = p + max([n for n in range(1, len(part) - p + 1) if part[p : p + n] in s], default=1), pieces + 1
            rate.append(pieces * math.log2(max(len(s), 2)) / len(t))
        assert got[i]["lang_pred"] == model.languages[int(np.argmin(rate))]


def test_what_language_keeps(spark):
    rows = [(1, "plain words", None), (2, "12 !!", None), (3, None, "aa"), (4, "ß", "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.keep_identified(d.where("doc_id < 3").withColumn("lang", F.lit(None).cast("string"))).collect()} == {1}
    learned = d.unionByName(spark.createDataFrame([(i, "plain words of this language", "aa") for i in range(10, 30)], d.schema))
    got = by_id(langid.keep_identified(learned))
    assert {1, 4} <= set(got) and not {2, 3} & set(got) and got[1]["lang"] == "aa" and got[4]["lang"] == "zz"
