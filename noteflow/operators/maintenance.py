"""Retention, version pruning, stale conflicts, status, search logs, chunk replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflow.functions import rules as R
from noteflow.functions import text as T
from noteflow.operators.revisions import events_after

PATH = ["vault_id", "source_path"]


def expired_files(files: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Deleted files past retention."""
    return files.where(F.col("deleted") & (F.col("deleted_at") < T.retention_cutoff(as_of, days)))


def apply_retention(files: DataFrame, chunks: DataFrame, as_of: Column, days: int) -> dict[str, DataFrame]:
    """Kept and archived files and chunks; archived rows carry a reason and the raw record. No row is lost or doubled."""
    old = expired_files(files, as_of, days)
    keys = old.select(*PATH)
    archive = lambda rows: rows.withColumns({"archived_reason": F.lit("retention_expired"), "raw_record": F.to_json(F.struct(*rows.columns))})
    return {
        "files": files.join(keys, PATH, "left_anti"), "chunks": chunks.join(keys, PATH, "left_anti"),
        "archived_files": archive(old), "archived_chunks": archive(chunks.join(keys, PATH, "left_semi")),
    }


def prunable_versions(versions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Versions older than the cut-off that are not the latest of their path. Only slim columns are grouped; texts stay out."""
    latest = versions.groupBy(*PATH).agg(F.max("revision").alias("max_revision"))
    rows = versions.where(F.col("created_at") < T.retention_cutoff(as_of, days)).join(latest, PATH)
    return rows.where(F.col("revision") < F.col("max_revision")).select(*PATH, "revision")


def retention_rows(archived: DataFrame, pruned: DataFrame) -> DataFrame:
    """What a retention run does, as rows: kind (archived, pruned), vault_id, source_path, revision (of pruned versions)."""
    a = archived.select(F.lit("archived").alias("kind"), *PATH, F.lit(None).cast("long").alias("revision"))
    return a.unionByName(pruned.select(F.lit("pruned").alias("kind"), *PATH, F.col("revision").cast("long")))


def retention_summary(rows: DataFrame) -> DataFrame:
    """Archived files and pruned versions of each vault that has any."""
    return rows.groupBy("vault_id").agg(F.count_if(F.col("kind") == "archived").alias("archived"), F.count_if(F.col("kind") == "pruned").alias("pruned"))


def retention(files: DataFrame, chunks: DataFrame, versions: DataFrame, as_of: Column, days: int, version_days: int, dry_run: bool = False) -> dict[str, DataFrame]:
    """The whole retention job: files, chunks and versions after it, what it archives and prunes, and the summary per vault.

    A dry run gives the same rows and summary, and leaves files, chunks and
    versions as they are. The archives are what a run would add to.
    """
    done = apply_retention(files, chunks, as_of, days)
    pruned = prunable_versions(versions, as_of, version_days)
    rows = retention_rows(done["archived_files"], pruned)
    kept = {"files": done["files"], "chunks": done["chunks"], "versions": versions.join(pruned, [*PATH, "revision"], "left_anti")}
    if dry_run:
        kept = {"files": files, "chunks": chunks, "versions": versions}
    return kept | {"archived_files": done["archived_files"], "archived_chunks": done["archived_chunks"], "rows": rows, "summary": retention_summary(rows)}


def stale_conflicts(conflicts: DataFrame, files: DataFrame) -> DataFrame:
    """Open conflicts whose file is gone, deleted or newer, with the reason."""
    state = files.select(*PATH, F.col("revision").alias("file_revision"), F.col("deleted").alias("file_deleted"), F.lit(True).alias("there"))
    rows = conflicts.where("status = 'OPEN'").join(state, PATH, "left")
    reason = F.when(F.col("there").isNull(), "file_missing").when(F.col("file_deleted"), "file_deleted").when(F.col("file_revision") > F.col("server_revision"), "newer_revision")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("id", *PATH, "server_revision", "file_revision", "reason")


def stale_counts(stale: DataFrame) -> DataFrame:
    return stale.groupBy("vault_id", "reason").agg(F.count("*").alias("conflicts")).orderBy("vault_id", "reason")


def stale_detail(stale: DataFrame, n: int = 50) -> DataFrame:
    return stale.orderBy(*PATH, "id").limit(n)


def still_open(conflicts: DataFrame, stale: DataFrame) -> DataFrame:
    rows = conflicts.where("status = 'OPEN'").join(stale.select("id"), "id", "left_anti")
    return rows.groupBy("vault_id").agg(F.count("*").alias("open_conflicts"))


def resolve_stale_conflicts(conflicts: DataFrame, files: DataFrame, apply: bool = False) -> dict[str, DataFrame]:
    """The job on stale conflicts: the rows, their counts, what stays open, and the conflicts, of which the stale ones are resolved if ``apply``."""
    stale = stale_conflicts(conflicts, files)
    found = stale.select("id", F.lit(True).alias("is_stale"))
    after = conflicts
    if apply:
        after = conflicts.join(found, "id", "left")
        after = after.withColumn("status", F.when(F.col("is_stale"), "RESOLVED").otherwise(F.col("status"))).select(*conflicts.columns)
    return {"stale": stale, "counts": stale_counts(stale), "open": still_open(conflicts, stale), "conflicts": after}


def vault_status(vaults: DataFrame, files: DataFrame, chunks: DataFrame, conflicts: DataFrame, devices: DataFrame, events: DataFrame, model: str) -> DataFrame:
    """One row per vault and device, and per vault without devices: server revision, cursor, events after it, open conflicts, index counts.

    A vault without devices, or a device without a cursor, has all events before it.
    """
    asked = vaults.select("vault_id", F.col("current_revision").alias("server_revision")).join(devices.select("vault_id", "device_id", "cursor"), "vault_id", "left")
    asked = asked.withColumn("since", F.coalesce("cursor", F.lit(0)))
    ahead = events_after(events, asked.select("vault_id", F.col("since").alias("cursor"))).withColumnRenamed("cursor", "since")
    open_ = conflicts.where("status = 'OPEN'").groupBy("vault_id").agg(F.count("*").alias("open_conflicts"))
    rows = asked.join(ahead, ["vault_id", "since"], "left").join(open_, "vault_id", "left").join(index_status(vaults, files, chunks, model), "vault_id")
    return rows.drop("since").fillna(0, ["events_after", "open_conflicts"])


def index_status(vaults: DataFrame, files: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """pending, failed, model-stale counts and freshness of each vault, zeros included."""
    live = files.where("vectorize AND NOT deleted")
    counts = live.groupBy("vault_id").agg(F.count_if(F.col("index_status") == "pending").alias("pending"), F.count_if(F.col("index_status") == "failed").alias("failed"))
    stale = model_stale(files, chunks, model).groupBy("vault_id").agg(F.count("*").alias("model_stale"))
    out = vaults.select("vault_id").join(counts, "vault_id", "left").join(stale, "vault_id", "left").fillna(0)
    return out.withColumn("index_fresh", F.col("pending") + F.col("failed") + F.col("model_stale") == 0)


def model_stale(files: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """Live indexed files that have a chunk of another model."""
    other = chunks.where(F.col("embedding_model") != model).select(*PATH, "content_hash")
    return files.where("vectorize AND NOT deleted AND index_status = 'indexed'").join(other, [*PATH, "content_hash"], "left_semi")


def sync_status(vaults: DataFrame, devices: DataFrame, events: DataFrame, conflicts: DataFrame, files: DataFrame) -> DataFrame:
    """Per device: server revision, cursor, events after it, open conflicts, pending files; each table is counted before it is joined."""
    ahead = events_after(events, devices)
    open_ = conflicts.where("status = 'OPEN'").groupBy("vault_id").agg(F.count("*").alias("open_conflicts"))
    pending = files.where("vectorize AND NOT deleted AND index_status = 'pending'").groupBy("vault_id").agg(F.count("*").alias("pending_files"))
    out = devices.select("vault_id", "device_id", "cursor").join(vaults.select("vault_id", F.col("current_revision").alias("server_revision")), "vault_id")
    out = out.join(ahead, ["vault_id", "cursor"], "left").join(open_, "vault_id", "left").join(pending, "vault_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("events_after", "open_conflicts", "pending_files")}
    return out.withColumns(zero)


def upserted_devices(old: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per device: name kept unless a name is given, clock and cursor of the last sight. Both: vault_id, device_id, name, last_seen_at, cursor."""
    rows = old.unionByName(seen)
    return rows.groupBy("vault_id", "device_id").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("last_seen_at"))).alias("name"), F.max("last_seen_at").alias("last_seen_at"), F.max_by("cursor", "last_seen_at").alias("cursor")
    )


def search_log_rows(queries: DataFrame, results: DataFrame, at: Column, latency_ms: Column | None = None, min_score: float = 0.0) -> DataFrame:
    """One log row per query: effective filters and least score as JSON, top_k, result count, latency and clock as given.

    Filters are the query's f_ columns (``search.effective_filters``); a query
    without such columns logs none.
    """
    counts = results.groupBy("query_id").agg(F.count("*").alias("result_count"))
    names = sorted(c for c in queries.columns if c.startswith("f_"))
    least = [F.coalesce(F.col("min_score").cast("double"), F.lit(min_score)).alias("min_score")] if "min_score" in queries.columns else []
    filters = F.to_json(F.struct(*[F.col(c).alias(c[2:]) for c in names], *least)) if names else F.lit("{}")
    out = queries.join(counts, "query_id", "left")
    more = [F.col("top_k")] if "top_k" in queries.columns else []
    more += [latency_ms.cast("long").alias("latency_ms")] if latency_ms is not None else []
    return out.select(F.col("query_id").cast("string").alias("request_id"), "vault_id", "query", filters.alias("filters"), F.coalesce("result_count", F.lit(0)).alias("result_count"), at.alias("created_at"), *more)


def append_search_log(log: DataFrame, path: str) -> None:
    """Add log rows to the stored ones, in files by the day of their clock."""
    log.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def browse_logs(logs: DataFrame, vault_id: str, from_time: Column, to_time: Column, like: str | None = None, limit: int = 100) -> DataFrame:
    rows = logs.where((F.col("vault_id") == vault_id) & F.col("created_at").between(from_time, to_time))
    if like:
        rows = rows.where(F.contains(F.lower("query"), F.lit(like.lower())))
    return rows.orderBy(F.desc("created_at"), "request_id").limit(max(1, min(limit, 100)))


FEEDBACK = ["helpful", "selected_source_path", "selected_chunk_rank", "expected_missing", "comment"]


def attach_feedback(logs: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs with the last feedback on each request (all its fields, nulls too), and rejected feedback with the reason."""
    given = F.coalesce(*[F.col(c).cast("string") for c in FEEDBACK]).isNotNull()
    known = logs.select("request_id", "vault_id", F.lit(True).alias("known"))
    rows = feedback.join(known, ["request_id", "vault_id"], "left")
    reason = F.when(~given, "feedback is empty").when(F.col("known").isNull(), "request not found")
    rows = rows.withColumn("reason", reason)
    last = rows.where("reason IS NULL").groupBy("request_id", "vault_id").agg(F.max_by(F.struct(*FEEDBACK), "seq").alias("f"))
    out = logs.join(last, ["request_id", "vault_id"], "left")
    return out.select(*logs.columns, *[F.col(f"f.{c}").alias(f"feedback_{c}") for c in FEEDBACK]), rows.where("reason IS NOT NULL").select("request_id", "vault_id", "seq", "reason")


def reindex_candidates(files: DataFrame, changed_only: bool = False) -> DataFrame:
    rows = files.where((F.col("status") != "archived") & F.endswith("source_path", F.lit(".md")))
    return rows.where("index_status != 'indexed'") if changed_only else rows


def index_gate(path: Column, vectorize: Column, deleted: Column, note_vectorize: Column, note_status: Column) -> Column:
    """``index`` or ``skipped``."""
    good = vectorize & ~deleted & R.is_vectorizable(path) & F.coalesce(note_vectorize, F.lit(True)) & (F.coalesce(note_status, F.lit("current")) == "current")
    return F.when(good, "index").otherwise("skipped")


def replaced_chunks(old: DataFrame, new: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk table with the touched files' chunks replaced, and (created, updated, deleted) per vault."""
    keys = touched.select(*PATH).distinct()
    kept = old.join(keys, PATH, "left_anti")
    deleted = old.join(keys, PATH, "left_semi").groupBy("vault_id").agg(F.count("*").alias("deleted"))
    created = new.groupBy("vault_id").agg(F.count("*").alias("created"))
    report = created.join(deleted, "vault_id", "full_outer").fillna(0, ["created", "deleted"]).withColumn("updated", F.lit(0).cast("long"))
    return kept.unionByName(new, allowMissingColumns=True), report
