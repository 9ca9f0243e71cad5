"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The
ledger is a table of scanned (blob, rule version) pairs with their spans,
appended to by each run. A run finds the blobs that no ledger row has for this
rule version, chooses one row per such blob, scans those texts only, appends,
and joins the ledger's findings back to all paths. A blob's ledger row is its
scan result, so a lost run leaves nothing half recorded; a blob scanned twice
gives equal rows, of which one is read.

Null text counts as empty; null paths are paths like any other; repeated rows
are each reported. Clashing extra columns are not read. An empty table leaves
the ledger as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm.store import new_folder, written

# The base rules, in the order in which equal starts are listed.
RULES_VERSION = 1
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: A run of hexadecimal digits too short to count is skipped at once: the runs found are the same.
HEX_LONG = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
WORDS = ("passw", "secret", "token", "api")

SCAN_SCHEMA = "blob string, rule_version int, n_assign long, n_access long, n_hex long, spans string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, in order."""
    found = []
    small = text.lower()
    if any(w in small for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for blob, text in zip(batch["blob"], batch["text"]):
            spans = find_spans(text)
            count = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
            rows.append((blob, RULES_VERSION, *count, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)))
        yield pd.DataFrame(rows, columns=["blob", "rule_version", "n_assign", "n_access", "n_hex", "spans"])


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in ``folder``; one without rows is begun where there is none."""
    try:
        return spark.read.schema(SCAN_SCHEMA).parquet(folder)
    except Exception as error:  # AnalysisException
        if "PATH_NOT_FOUND" not in str(error):
            raise
    spark.createDataFrame([], SCAN_SCHEMA).write.mode("append").parquet(folder)
    return spark.read.schema(SCAN_SCHEMA).parquet(folder)


def scan_versions(spark: SparkSession, versions: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Scan what the ledger has not seen and report each row of ``versions``.

    Returns path, blob, n_assign, n_access, n_hex, spans.
    """
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    paths = written(spark, rows.select("path", "blob"), "paths")
    known = open_ledger(spark, ledger).where(F.col("rule_version") == RULES_VERSION)
    unseen = paths.groupBy("blob").agg(F.min("path").alias("one")).join(known.select("blob"), "blob", "left_anti")
    unseen = written(spark, unseen.withColumnRenamed("blob", "key"), "unseen")
    # the slim side is the build side, so that texts are shuffled once and not sorted
    match = (F.col("blob") == F.col("key")) & F.col("path").eqNullSafe(F.col("one"))
    texts = rows.join(unseen.hint("shuffle_hash"), match, "left_semi")
    texts.select("blob", "text").mapInPandas(_scan, SCAN_SCHEMA).write.mode("append").parquet(ledger)
    found = open_ledger(spark, ledger).where((F.col("rule_version") == RULES_VERSION) & (F.col("spans") != ""))
    # a table of its own: the join below then has no aggregate in its stage, and Spark may split the rows of a hot blob
    found = written(spark, found.dropDuplicates(["blob"]).drop("rule_version"), "found")
    out = paths.join(found, "blob", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return out.select("path", "blob", *zero, F.coalesce("spans", F.lit("")).alias("spans"))


def fresh_ledger(spark: SparkSession) -> str:
    """A folder for a new ledger."""
    return new_folder(spark, "ledger")


def brute_force(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans, straight from the rules; for tests."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    spans = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(spans.encode()).hexdigest(), spans)
