"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key. Within a source, documents are ordered
by key: the key's range is cut into equal slices, each (source, slice) is
sorted on its own, and the running word count of a document is the sum of the
slices before its own plus the running sum inside it: a distributed prefix sum
in which no source, however large, is gathered in one task. The cut falls at
the exact word of the source's budget: whole epochs first, then the rest of the
budget in key order, the last document in part.

Null text has size 0; a null source is a source of its own, the last; rows of
size 0 take 0 words; equal rows share a key and are cut in turn. An empty table
gives an empty result. Columns other than doc_id, source and text may have any
names. Sizes count runs of characters other than space and
U+0009..U+000D.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.store import free_names, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.char_length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Slim rows: doc_id, source, source key (null-safe), size, random key."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: src, source_size, target.

    The budget (``share`` of all sizes) is split by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by
    weight. In order of cap / weight the capped sources come first, so the
    common level is found by running sums over the small table of sources.
    """
    totals = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    totals = totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    totals = totals.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.col("cap") > F.col("level") * F.col("weight")
    first = F.min(F.when(free, F.struct("place", "level"))).over(every)  # from here on no source is capped
    target = F.when(first.isNull() | (F.col("place") < first["place"]), F.col("cap")).otherwise(first["level"] * F.col("weight"))
    return totals.select("src", "source_size", target.alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, key.

    ``taken`` counts the words that the mix takes of the document, repeats
    included; per source they add up to the target, rounded down.
    """
    sizes = written(spark, sized(docs, seed), "sizes")
    targets = written(spark, source_targets(sizes, weights, share, most), "targets")
    slices = math.isqrt(sizes.count()) + 1  # both a slice's rows and a source's slices grow as the root of the table
    sliced = sizes.withColumn("slice", F.floor((F.shiftrightunsigned("key", 1) / F.lit(2.0**63)) * slices))
    per_slice = sliced.groupBy("src", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).drop("slice_size")
    per_slice = per_slice.join(targets, "src")
    inside = Window.partitionBy("src", "slice").orderBy(F.shiftrightunsigned("key", 1), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per_slice, ["src", "slice"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("ahead")))
    return placed.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), "key"
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    upto = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each part ends with its word
    return F.array_join(F.slice(upto, F.lit(1), n.cast("int")), "")


def mixed_documents(spark: SparkSession, docs: DataFrame, **options: object) -> DataFrame:
    """The documents that the mix takes, one row per epoch, columns as they were.

    A document that the mix takes in part has its text cut after the last word
    taken; documents of which no word is taken go. Fully repeated rows all take
    as much as the one of them that takes most.
    """
    taken = mix(spark, docs, **options).where("taken > 0")
    own_key, key, doc_id, size, words, left = free_names(docs, "own_key", "mix_key", "mix_id", "mix_size", "mix_taken", "mix_left")
    taken = taken.groupBy(F.col("doc_id").alias(doc_id), F.col("key").alias(key)).agg(F.max("size").alias(size), F.max("taken").alias(words))
    rows = docs.withColumn(own_key, F.xxhash64(F.lit(options.get("seed", 0)), "doc_id", "text"))
    rows = rows.join(taken.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(own_key) == F.col(key)))
    rows = rows.withColumn(left, F.explode(F.expr(f"transform(sequence(0L, ({words} - 1) div {size}), i -> {words} - i * {size})")))
    cut = F.when(F.col(left) < F.col(size), first_words(F.col("text"), F.col(left))).otherwise(F.col("text"))
    return rows.withColumn("text", cut).select(*docs.columns)
