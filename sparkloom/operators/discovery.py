"""Test files: discovery by path, and relation to sources by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.session import merged, spread

MOST_TESTS = 500
SHORTEST_STEM = 4
#: Lengths of the stretches by which texts are looked up, each twice the one before.
SIZES = (SHORTEST_STEM, 2 * SHORTEST_STEM, 4 * SHORTEST_STEM, 8 * SHORTEST_STEM)


def discover_tests(files: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """Paths of test files in test folders no deeper than the third, the first `most` by path (a feature: discovery is capped)."""
    folders = "|".join(paths.TEST_FOLDERS)
    return files.select("file_path").where(F.col("file_path").rlike(rf"^([^/]+/){{0,2}}({folders})/") & F.col("file_path").rlike(paths.TEST_FILE)).distinct().orderBy("file_path").limit(most)


def _grams(text: Column, size: int | Column) -> Column:
    """The distinct stretches of `size` letters; none where the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size))))


def candidates(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) pairs of texts, all in which the whole holds the part and few others; both sides distinct, parts of SHORTEST_STEM letters at least.

    A whole that holds a part holds all of its grams, so a part is looked up by one of them:
    the one that the fewest wholes have. A part's grams have more than half of its letters
    (SIZES; beyond the last one, that many), as short ones become common where there are many
    texts: of numbered ones each fourth digit string stands in a part of all. Grams that stand
    nearly everywhere are looked up by those parts alone that have no other, whose lookups are
    matches."""
    parts, wholes = spread(parts, "part"), spread(wholes, "whole")
    held = wholes.select("whole", F.explode(F.concat(*[_grams(F.col("whole"), n) for n in SIZES])).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    size = F.lit(SIZES[0])
    for n in SIZES[1:]:
        size = F.when(F.length("part") >= n, n).otherwise(size)
    rarest = parts.select("part", F.explode(_grams(F.col("part"), size)).alias("gram"))
    rarest = rarest.join(merged(often), "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    asked = rarest.where("r.n > 0").select("part", "r.gram")
    return asked.join(merged(held), "gram").select("part", "whole")


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) pairs of texts where the whole holds the part; see `candidates`."""
    return candidates(parts, wholes).where(F.col("whole").contains(F.col("part")))


def related_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """(file_path, test_path) pairs: the source's stem stands in the test's name, or the stems hold one another.

    Stems and names are matched once each, however many files have them; see `contained`."""
    s = sources.select("file_path", F.lower(paths.stem(F.col("file_path"))).alias("s")).where(F.length("s") >= SHORTEST_STEM).distinct()
    low = F.lower(paths.stem(F.col("file_path")))
    t = tests.select(F.col("file_path").alias("test_path"), F.lower(paths.file_name(F.col("file_path"))).alias("name"), F.regexp_replace(F.regexp_replace(low, r"^test_|_test$|^test|test$|\.test$|\.spec$", ""), "^_+|_+$", "").alias("t")).distinct()
    stems = s.select(F.col("s").alias("part")).distinct()
    clean = t.where(F.length("t") >= SHORTEST_STEM)
    # what a test goes by: its name and its own stem
    texts = t.select(F.col("name").alias("whole"), "test_path").unionAll(clean.select("t", "test_path")).distinct()
    in_tests = contained(stems, texts.select("whole").distinct()).join(texts, "whole").select(F.col("part").alias("s"), "test_path")
    in_stems = contained(clean.select(F.col("t").alias("part")).distinct(), stems.select(F.col("part").alias("whole")))
    in_stems = in_stems.join(clean.select(F.col("t").alias("part"), "test_path"), "part").select(F.col("whole").alias("s"), "test_path")
    return in_tests.unionAll(in_stems).distinct().join(merged(s), "s").select("file_path", "test_path")


def matching_test_names(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(target_id, name) where a name begins with one of the target's prefixes."""
    p = prefixes.groupBy("target_id").agg(F.collect_set("prefix").alias("p"))
    return names.join(p, "target_id").where(F.exists("p", lambda x: F.col("name").startswith(x))).select("target_id", "name")
