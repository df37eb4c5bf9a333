"""Sources mixed to target weights: whole epochs, then a weighted sample without replacement up to each source's budget of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and the most often that a source is gone through.
SHARE, MOST_EPOCHS = (3, 2), 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(name: Column, seed: int) -> Column:
    """A number in (0, 1) from a digest of the name."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """`sizes` (source, source_size, ...) with `target`: a share of all sizes by weight, at most `most` times the source's size, the excess dealt again by weight until none is above.

    Sources take the weights in turn, by code point, null last. Where excess goes on and on,
    it ends with the sources of the least size a weight held at their limits and all others at
    one level a weight; so running sums in that order find the level at once. There is one row
    a source, so these windows are over sources, not documents."""
    a, b = share
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    every = Window.orderBy(F.col("source_size") / F.col("__w"), F.asc_nulls_last("source"))
    upto = every.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__all", F.sum("source_size").over(Window.partitionBy())).withColumn("__held", F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    rows = rows.withColumn("__rest", F.sum("__w").over(Window.partitionBy()) - F.coalesce(F.sum("__w").over(upto), F.lit(0)))
    # b times what is left once all before are held, against what this source's limit a weight takes of it
    left = a * F.col("__all") - b * most * F.col("__held")
    rows = rows.withColumn("__left", left).withColumn("__over", F.col("__left").cast("double") * F.col("__w") >= (b * most * F.col("source_size")).cast("double") * F.col("__rest"))
    first = F.min(F.when(~F.col("__over"), F.struct(F.col("source_size") / F.col("__w"), F.col("source").isNull(), F.col("source"), F.col("__left"), F.col("__rest")))).over(Window.partitionBy())
    level = F.col("__w") * first["__left"] / (b * first["__rest"])
    return rows.withColumn("target", F.when(F.col("__over"), (most * F.col("source_size")).cast("double")).otherwise(level.cast("double"))).drop("__w", "__all", "__held", "__rest", "__left", "__over")


def plan_mixture(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_EPOCHS, seed: int = 12) -> DataFrame:
    """`docs` (doc_id, text, source, ...) to a row each: doc_id, source, size, source_size, target, taken, epochs, cut.

    `size` are the text's words. A source's budget is its target in whole words: complete
    epochs take every document once each, what is left of the budget goes to documents in the
    order of their exponential keys, -ln(u) / weight (ties: the smaller id, then the smaller
    size), and the last of these gives its leading words only, so that the budget is met to the
    word. `taken` are all words the mix has of the document; `epochs` how often it is in whole,
    `cut` how many words of it are in besides. `quality` (doc_id, weight) makes documents
    likelier to come into the last, partial epoch; where it has none, or none above 0, a
    document weighs 1; of several for one id the largest counts.

    A source is cut into cells by ranges of keys, as many as the root of its documents. Running
    sums go over the cells of a source and then over the documents of a cell, so a source that
    holds most of all documents is many tasks. Documents meet their cell's sum by an equality
    join on source and cell. Texts are read once; ids, sizes and keys go to the shared folder.

    Null and empty texts have size 0 and nothing is taken; a null source is a source of its own;
    repeated rows are documents of their own; rows without id draw by their texts; an empty
    table gives no row. Other columns are left behind, whatever their names."""
    # the name of a source as one string without null, so that joins and windows share a key
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("__s")
    text = F.col("text").cast("string")
    drawn = uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), seed)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), name, word_count(text).alias("size"), drawn.alias("__u"))
    w = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("weight").cast("double")).alias("__w")), "doc_id", "left")
        w = F.when((F.col("__w") > 0) & (F.col("__w") < float("inf")), F.col("__w")).otherwise(1.0)
    rows = written(rows.select("doc_id", "source", "__s", "size", (-F.log("__u") / w).alias("__key")))
    per = rows.groupBy("source", "__s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    plan = written(source_targets(per, weights, share, most))
    largest = plan.agg(F.max("__rows").alias("n")).first()["n"] or 1
    cells = math.isqrt(largest)
    # 1 - exp(-key) goes from 0 to 1 as keys grow
    cell = F.least(F.floor((1 - F.exp(-F.col("__key"))) * cells), F.lit(cells - 1)).alias("__cell")
    rows = rows.select("doc_id", "__s", "size", "__key", cell)
    sums = rows.groupBy("__s", "__cell").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    about = sums.select("__s", "__cell", before.alias("__before")).join(plan, "__s")
    about = about.select("__s", "__cell", "__before", "source", "source_size", "target", whole.alias("__whole"), (budget - whole * F.col("source_size")).alias("__part"))
    met = rows.join(about, ["__s", "__cell"])
    inside = Window.partitionBy("__s", "__cell").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__before") + F.sum("size").over(inside) - F.col("size")
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__part") - upto)).cast("long")
    out = met.withColumn("__some", some)
    full = (F.col("__some") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("__whole") * F.col("size") + F.col("__some")).alias("taken"),
        (F.col("__whole") + full.cast("long")).alias("epochs"), F.when(full, F.lit(0)).otherwise(F.col("__some")).cast("long").alias("cut"),
    )


def mixed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: (doc_id, epoch, text), a row for each time a document is in; the last one of a cut document holds its leading words, joined by one space.

    `docs` are to have one row an id; rows without id are left out, as no plan tells them apart."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    both = docs.select("doc_id", "text").join(plan.where("taken > 0").select("doc_id", "epochs", "cut"), "doc_id")
    whole = both.where("epochs > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "epochs")).alias("epoch"), "text")
    return whole.unionByName(both.where("cut > 0").select("doc_id", (F.col("epochs") + 1).alias("epoch"), F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), " ").alias("text")))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents: 4 where the label is good, 1/2 where it is not. Documents without a label weigh 1 beside them."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") >= 1, 4.0).otherwise(0.5).alias("weight"))
