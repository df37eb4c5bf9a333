import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, z string, group string, c0 string"


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, ties, blanks and a very long one; extra columns whose names operators use."""
    rng = random.Random(5)
    texts = [words(rng, rng.choice([3, 20, 80, 200])) for _ in range(60)]
    passage = words(rng, 70)
    texts += [texts[1], texts[1], texts[7], None, "", "   ", "12 34 !!", words(rng, 30) + ". " + passage, passage + " " + words(rng, 12), words(rng, 9000)]
    for k in (2, 3, 5):
        w = texts[k].split()
        w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
        texts.append(" ".join(w))
    texts += ["ab ab " * 60, "SE!! CI!! NI!! SE!! CI!! " * 12]
    return [(i, t, rng.choice(["aa", "bb", None]), "s", len(t or ""), "x", "y", "g", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus + [(None, "no id at all here", None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
