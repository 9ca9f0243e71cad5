"""Reading and writing: note folders, store tables, manifests, golden queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions import rules as R

MANIFEST = (
    "vault_id string, device_id string, last_sync_cursor long, "
    "files map<string, struct<server_revision: long, content_hash: string, last_synced_at: string>>, "
    "conflicts map<string, struct<server_revision: long, server_content_hash: string, local_content_hash: string, server_deleted: boolean>>"
)


def scan_notes(spark: SparkSession, root: str, sync_attachments: bool = False, attachment_max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of a note folder to sync (source_path, size, mtime, content_hash), and oversized attachments that are left out.

    Spark's listing leaves out names that begin with ``_``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"^[a-z]+:/*", "/")), F.concat(F.lit("^"), base, F.lit("/")), F.lit(""))
    rows = files.select(path.alias("source_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_hash"))
    rows = rows.where(R.should_sync(F.col("source_path"), sync_attachments))
    big = F.lit(False) if attachment_max_bytes is None else ~F.endswith("source_path", F.lit(".md")) & (F.col("size") > attachment_max_bytes)
    return rows.where(~big), rows.where(big).select("source_path", "size")


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A store table, partitioned by vault."""
    rows.write.mode(mode).partitionBy("vault_id").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", False).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an existing relational store."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def manifest_tables(manifests: DataFrame, json_col: str = "manifest") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cursor, tracked-file and open-conflict tables from manifest JSON; what is no object or lacks a field counts as empty."""
    m = manifests.select(F.from_json(json_col, MANIFEST, {"mode": "PERMISSIVE"}).alias("parsed_manifest")).select("parsed_manifest.*").where("vault_id IS NOT NULL AND device_id IS NOT NULL")
    two = ["vault_id", "device_id"]
    cursors = m.select(*two, F.coalesce("last_sync_cursor", F.lit(0)).alias("cursor"))
    files = m.select(*two, F.explode("files").alias("source_path", "f")).select(*two, "source_path", "f.*")
    conflicts = m.select(*two, F.explode("conflicts").alias("source_path", "c")).select(*two, "source_path", "c.*")
    return cursors, files, conflicts.withColumn("server_deleted", F.coalesce("server_deleted", F.lit(False)))


def manifest_json(cursors: DataFrame, files: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One manifest per device, paths sorted."""
    two = ["vault_id", "device_id"]
    packed = lambda rows, name: rows.groupBy(*two).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_path", F.struct(*[c for c in rows.columns if c not in (*two, "source_path")]))))).alias(name))
    out = cursors.join(packed(files, "files"), two, "left").join(packed(conflicts, "conflicts"), two, "left")
    return out.select(*two, F.to_json(F.struct(*two, F.col("cursor").alias("last_sync_cursor"), "files", "conflicts")).alias("manifest"))


def golden_error() -> Column:
    """Null for a good golden query (query, vault_id, expected_sources)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank("query"), "query is required").when(blank("vault_id"), "vault_id is required").when(F.coalesce(F.size("expected_sources"), F.lit(0)) < 1, "expected_sources is required")
