"""Exact deduplication by heavy-hitter split (DataFrame functions only).

1. Every text is reduced to a slim fingerprint (digest, length, id).
2. Spark's ``approx_top_k`` (a Misra-Gries summary with a fixed number of
   counters, merged across partitions) names the digests that may be frequent.
3. Those candidates are verified exactly: count and winner of each, by partial
   aggregation. They are at most ``HEAVY`` rows, so they are broadcast, and the
   rows of heavy digests are settled on the map side without a shuffle.
4. All other digests are too rare to be hot; they take an ordinary shuffle.

Texts are equal when identical after deleting space and U+0009..U+000D. The
winner of a group has the most code points in its original text, then the
smallest id (null ids last), then the first row of fully repeated ones.
Null text counts as empty; an empty table gives an empty result. Columns other
than the id and the text may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.store import free_names, written

#: Most digests that are treated as heavy, and counters of the summary. A digest with more than
#: 3.5 / COUNTERS of all rows is sure to be among the summary's items.
HEAVY, COUNTERS = 1024, 8192


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per row of ``docs``: id, digest, code points of the original text, row number."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text_digest(F.col(text_col)).alias("text_sha256"),
        F.coalesce(F.char_length(text_col), F.lit(0)).alias("n_points"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _standing(*more: Column) -> Column:
    """Smaller is better: longest text, then smallest id, nulls last."""
    return F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *more)


def heavy_winners(prints: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Exact count and winner of each digest that the Misra-Gries summary names; at most ``heavy`` rows."""
    candidates = prints.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {counters})").alias("top")).select(
        F.explode("top.item").alias("text_sha256")
    )
    return (
        prints.join(F.broadcast(candidates), "text_sha256")  # bounded by heavy
        .groupBy("text_sha256")
        .agg(F.count("*").alias("size"), F.min(_standing("row_no")).alias("best"))
        .where("size > 1")
    )


def duplicate_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = written(spark, fingerprints(docs, id_col, text_col), "fingerprints")
    winners = written(spark, heavy_winners(prints), "heavy")
    marked = prints.join(F.broadcast(winners), "text_sha256", "left")  # bounded by HEAVY
    heavy = marked.where("best IS NOT NULL").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
    )
    group = Window.partitionBy("text_sha256")
    ordered = group.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"), "row_no")
    light = marked.where("best IS NULL").select(
        "doc_id",
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"),
        "text_sha256",
    )
    return heavy.unionByName(light)


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Copies of heavy digests are dropped on the map side; what is left is
    shuffled once by digest. Working columns get names that ``docs`` does not have.
    """
    own_digest, own_points, heavy_neg, heavy_id, rank = free_names(docs, "digest", "points", "heavy_neg", "heavy_id", "rank")
    prints = fingerprints(docs, id_col, text_col)
    winners = written(spark, heavy_winners(written(spark, prints, "fingerprints")), "heavy")
    winners = winners.select(
        F.col("text_sha256").alias(own_digest), F.col("best.neg").alias(heavy_neg), F.col("best.doc_id").alias(heavy_id)
    )
    rows = docs.withColumn(own_digest, text_digest(F.col(text_col))).withColumn(
        own_points, -F.coalesce(F.char_length(text_col), F.lit(0))
    )
    rows = rows.join(F.broadcast(winners), own_digest, "left")  # bounded by HEAVY
    rows = rows.where(
        F.col(heavy_neg).isNull()
        | ((F.col(own_points) == F.col(heavy_neg)) & F.col(id_col).eqNullSafe(F.col(heavy_id)))
    )
    order = Window.partitionBy(own_digest).orderBy(own_points, F.asc_nulls_last(id_col))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
