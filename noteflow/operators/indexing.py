"""Index notes: gate, parse and chunk, embed, replace chunks, commit the file state, report."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions import notes as N
from noteflow.functions import text as T
from noteflow.operators import maintenance as M
from noteflow.sources.scratch import written

PATH = ["vault_id", "source_path"]
Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> Embed:
    """A deterministic stand-in for a model: signed hashed words, normalised."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return embed


def embedded(rows: DataFrame, text_col: str, embed: Embed, dimension: int) -> DataFrame:
    """Adds embedding and embedding_error; one call of the model per batch and one client per task."""

    @F.pandas_udf("embedding array<float>, embedding_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors = embed(texts.tolist())
            good = vectors.ndim == 2 and vectors.shape == (len(texts), dimension)
            yield pd.DataFrame({"embedding": list(vectors) if good else [None] * len(texts), "embedding_error": None if good else "embedding has the wrong dimension"})

    out = rows.withColumn("__e", run(F.col(text_col)))
    return out.select(*rows.columns, "__e.embedding", "__e.embedding_error")


def index_notes(files: DataFrame, notes: DataFrame, old_chunks: DataFrame, embed: Embed, dimension: int, model: str, changed_only: bool = False, current: DataFrame | None = None) -> dict[str, DataFrame]:
    """chunks, files (path, index_status, index_error), failures and report.

    files: keys, status, index_status, vectorize, deleted, content_hash; notes: keys, content.
    ``current``: the file rows at commit time; a file that changed meanwhile stays pending.
    """
    wanted = M.reindex_candidates(files, changed_only).select(*PATH, "vectorize", "deleted")
    texts = wanted.join(notes, PATH, "left")
    unread = texts.where("content IS NULL").select(*PATH, F.lit("unknown").alias("phase"), F.lit("note is unreadable").alias("error"))
    known = texts.where("content IS NOT NULL")
    gated = M.index_gate(F.col("source_path"), F.col("vectorize"), F.col("deleted"), F.lit(True), F.lit("current"))
    skipped_early = known.where(gated == "skipped").select(*PATH)
    # parsing and embedding run once: several results start from each of them
    parsed = written(files.sparkSession, N.chunk_notes(known.where(gated == "index"), PATH), "parsed")
    hashes = known.select(*PATH, F.sha2("content", 256).alias("content_hash"))
    late = (~F.coalesce("vectorize", F.lit(True))) | (F.col("status") != "current")
    skipped = skipped_early.unionByName(parsed.where(F.col("error").isNull() & late).select(*PATH)).distinct()
    good = parsed.where(F.col("error").isNull() & ~late)
    good = good.withColumn("embedding_input", T.embedding_input(*(F.col(c) for c in ("title", "type", "project", "domain", "heading_path", "tags", "content"))))
    vectors = written(files.sparkSession, embedded(good, "embedding_input", embed, dimension), "embedded")
    failures = parsed.where("error IS NOT NULL").select(*PATH, "phase", "error").unionByName(unread)
    failures = failures.unionByName(vectors.where("embedding_error IS NOT NULL").select(*PATH, F.lit("embedding").alias("phase"), F.col("embedding_error").alias("error")).distinct())
    new = vectors.join(failures.select(*PATH), PATH, "left_anti").join(hashes, PATH)
    hint = T.agent_hint(*(F.col(c) for c in ("type", "priority", "project", "domain", "heading_path", "tags")))
    new = new.withColumns({"agent_hint": hint, "embedding_model": F.lit(model)}).drop("phase", "error", "embedding_error", "embedding_input")
    touched = new.select(*PATH).distinct()
    chunks, counts = M.replaced_chunks(old_chunks, new, touched.unionByName(skipped).distinct())
    now = (files if current is None else current).select(*PATH, F.col("content_hash").alias("now_hash"), F.col("deleted").alias("now_deleted"))
    state = new.select(*PATH, "content_hash").distinct().join(now, PATH, "left")
    raced = F.col("now_hash").isNull() | F.col("now_deleted") | (F.col("now_hash") != F.col("content_hash"))
    no_error = F.lit(None).cast("string").alias("index_error")
    status = state.select(*PATH, F.when(raced, "pending").otherwise("indexed").alias("index_status"), no_error)
    status = status.unionByName(skipped.select(*PATH, F.lit("skipped").alias("index_status"), no_error))
    status = status.unionByName(failures.groupBy(*PATH).agg(F.min("error").alias("index_error")).select(*PATH, F.lit("failed").alias("index_status"), "index_error"))
    return {"chunks": chunks, "files": status, "failures": failures, "report": index_report(status, counts)}


CODES = {"frontmatter": "VALIDATION_ERROR", "embedding": "EMBEDDING_FAILED", "unknown": "INDEXING_FAILED"}


def failure_log(failures: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """Rows to append to the failure log: keys, content_hash of the file, phase, code, message, details (JSON or null), clock as given.

    The details name the field that the frontmatter check stopped at, and what
    is missing.
    """
    code = F.coalesce(*[F.when(F.col("phase") == phase, code) for phase, code in CODES.items()])
    field, missing = F.regexp_extract("error", r"frontmatter field (\w+)", 1), F.regexp_extract("error", r"missing required fields: (.+)$", 1)
    details = F.when(missing != "", F.to_json(F.struct(F.split(missing, ", ").alias("missing_fields")))).when(field != "", F.to_json(F.struct(field.alias("field"))))
    rows = failures.join(files.select(*PATH, "content_hash"), PATH, "left")
    return rows.select(*PATH, "content_hash", "phase", code.alias("error_code"), F.col("error").alias("error_message"), details.alias("error_details"), at.alias("created_at"))


def append_failures(log: DataFrame, path: str) -> None:
    """Add rows to the stored failure log, in files by the day of their clock."""
    log.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def index_report(status: DataFrame, counts: DataFrame) -> DataFrame:
    """Per vault: indexed, skipped and failed files, created, updated and deleted chunks. Raced files count nowhere; the failed paths are the rows of the failure log."""
    of = lambda s: F.count_if(F.col("index_status") == s)
    files = status.groupBy("vault_id").agg(of("indexed").alias("indexed"), of("skipped").alias("skipped"), of("failed").alias("failed"))
    return files.join(counts, "vault_id", "left").fillna(0, ["created", "updated", "deleted"])
