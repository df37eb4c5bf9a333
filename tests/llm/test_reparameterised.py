"""Benchmark items with other numbers and names: how many are found, and that inconsistent ones and clean texts are not."""

import random

from sparkloom.llm import decontamination

NAMES = ["Tom", "Anna", "Berlin", "Okoro", "Lima", "Sofia", "Kiel", "Ravi", "Oslo", "Mina"]


def _items(rng, n, slots):
    """(tokens, names used): words, numbers as {k} and names as [k]; each placeholder stands at two places or more."""
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(24, 40))]
        holes = [f"{{{k}}}" for k in range(3)] * 2 + [f"[{k}]" for k in range(2)] * 2
        for hole, at in zip(holes[: int(slots * len(words))], rng.sample(range(1, len(words)), min(len(holes), int(slots * len(words)))), strict=False):
            words[at] = hole
        out.append(words)
    return out


def _filled(words, numbers, names):
    return " ".join(str(numbers[int(w[1:-1])]) if w[0] == "{" else names[int(w[1:-1])] if w[0] == "[" else w for w in words) + "."


def test_recall_of_reparameterised_items(spark):
    rng = random.Random(21)
    items = _items(rng, 200, 0.25)
    draw = lambda: (rng.sample(range(2, 999), 3), rng.sample(NAMES, 2))
    noise = lambda: " ".join("".join(rng.choice("vwxzhjc") + rng.choice("aeiou") for _ in range(3)) for _ in range(30))
    benchmark = [(i, _filled(x, *draw())) for i, x in enumerate(items)]
    docs = [(i, f"{noise()}. {_filled(x, *draw())} {noise()}") for i, x in enumerate(items)]

    def mixed(words):  # every place its own value, so that no one value stands for one value
        return " ".join(str(rng.randrange(2, 999)) if w[0] == "{" else rng.choice(NAMES) if w[0] == "[" else w for w in words) + "."

    docs += [(1000 + i, f"{noise()}. {mixed(x)} {noise()}") for i, x in enumerate(items)] + [(2000 + i, noise()) for i in range(100)]
    found = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(benchmark, "item_id long, text string"))
    rows = found.collect()
    right = {r.doc_id for r in rows if r.doc_id == r.item_id}
    assert len(right) >= 0.95 * len(items), len(right) / len(items)
    assert all(r.doc_id % 1000 == r.item_id for r in rows) and not [r for r in rows if r.doc_id >= 2000]
    # what is found of the mixed ones is found by its words, not by its template
    loose = [r for r in rows if 1000 <= r.doc_id < 2000]
    assert all(r.n_exact > 0 for r in loose) and len(loose) < len(right)
    print(f"recall {len(right) / len(items):.3f}, inconsistent copies found by their words {len(loose) / len(items):.3f}")
