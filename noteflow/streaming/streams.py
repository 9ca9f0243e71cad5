"""Structured Streaming jobs over the event log and over watch events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from noteflow.functions import notes as N
from noteflow.functions import rules as R
from noteflow.operators import indexing as I
from noteflow.operators import revisions as V
from noteflow.sources.scratch import written
from noteflow.sources.state import PARTS, KeyedTable

KEYS = ["vault_id", "source_path"]
FILES = "vault_id string, source_path string, revision long, content_hash string, deleted boolean, index_status string"
VERSIONS = "vault_id string, source_path string, revision long, content_hash string"
COUNTERS = "vault_id string, current_revision long"
CHUNKS = f"vault_id string, source_path string, {N.CHUNK_SCHEMA.replace(', phase string, error string', '')}, embedding array<float>, content_hash string, agent_hint string, embedding_model string"


def merged_snapshot(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Newest revision per path; older or repeated revisions never win."""
    rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
    rest = [c for c in batch.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "revision").alias("s")).select(*KEYS, *[F.col(f"s.{c}").alias(c) for c in rest])


def follow_log(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest event of every path in a ``KeyedTable``: a batch writes the paths that it changes.

    State grows with paths, not with events.
    """

    def write(batch: DataFrame, number: int) -> None:
        state = KeyedTable(batch.sparkSession, folder, _ddl(batch), KEYS)
        head = state.head(number)
        batch = merged_snapshot(None, batch)
        old = state.rows(head, state.touched(batch)).join(batch.select(*KEYS), KEYS, "left_semi")
        known = old.select(*KEYS, F.col("revision").alias("known"))
        newer = batch.join(known, KEYS, "left").where(F.col("known").isNull() | (F.col("revision") > F.col("known"))).drop("known")
        state.write(number, head, newer)

    return each_batch(events, write, checkpoint)


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in frame.dtypes)


def latest_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows that a stream's table holds now."""
    state = KeyedTable(spark, folder, schema, KEYS)
    return state.rows(state.head())


def relevant(events: DataFrame, sync_attachments: bool = False) -> DataFrame:
    return events.where(R.is_relevant_event(F.col("source_path"), F.col("is_directory"), sync_attachments))


def debounced(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One firing per vault after ``gap`` of quiet: a session window. events: vault_id, ts."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    fired = rows.groupBy("vault_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return fired.select("vault_id", F.col("w.start").alias("first_event"), F.col("w.end").alias("fires_at"), "n_events")


def marked(events: DataFrame, runs: DataFrame, drain_seconds: int) -> DataFrame:
    """Events (kind 1) and the begins of runs (kind 0, with the time until which they suppress) as rows of one table."""
    rows = events.select("vault_id", F.col("event_id").cast("long"), "ts", F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("kind"))
    until = F.col("end") + F.make_interval(secs=F.lit(drain_seconds))
    return rows.unionByName(runs.select("vault_id", F.lit(None).cast("long").alias("event_id"), F.col("begin").alias("ts"), until.alias("until"), F.lit(0).alias("kind")))


def unsuppressed(events: DataFrame, runs: DataFrame, drain_seconds: int = 1, slice_seconds: int = 3600) -> DataFrame:
    """Events outside every ``[begin, end + drain)`` of their vault's sync runs.

    Runs of a vault do not overlap, so the only run that can hold an event is
    the last one begun. It is found inside slices of a vault's time; what a slice
    takes over from the ones before it comes from one row a slice, so a vault's
    events never meet in one task.
    """
    both = marked(events, runs, drain_seconds).withColumn("slice", F.floor(F.unix_seconds("ts") / slice_seconds))
    last = F.max_by("until", F.when(F.col("kind") == 0, F.col("ts")))
    before = Window.partitionBy("vault_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("vault_id", "slice").agg(last.alias("last")).select("vault_id", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("vault_id", "slice").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("inside", F.last("until", ignorenulls=True).over(upto)).join(carried, ["vault_id", "slice"])
    until = F.coalesce("inside", "carried")
    return both.where((F.col("kind") == 1) & (until.isNull() | (F.col("ts") >= until))).select("vault_id", "event_id", "ts")


class Suppression(StatefulProcessor):
    """Per vault: rows that the watermark has not passed, and the time until which the last run begun suppresses (in microseconds)."""

    ROW = ["event_id", "at", "until_at", "kind"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long, until_at long, kind int")
        self.until = handle.getValueState("until", "until_at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by Spark
        first = None
        for batch in rows:
            self.waiting.appendList([tuple(None if pd.isna(v) else int(v) for v in r) for r in batch[self.ROW].itertuples(index=False, name=None)])
            first = min(batch["at"].min(), first or batch["at"].min())
        if first is not None:
            self.handle.registerTimer(_millis(int(first)))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        until = self.until.get()[0] if self.until.exists() else None
        waiting, kept, out = list(self.waiting.get()) if self.waiting.exists() else [], [], []
        for event, at, until_at, kind in sorted(map(tuple, waiting), key=lambda r: (r[1], r[3])):
            if _millis(at) > now:
                kept.append((event, at, until_at, kind))
            elif kind == 0:
                until = until_at
            elif until is None or at >= until:
                out.append((key[0], event, at))
        if kept:
            self.waiting.put(kept)
            self.handle.registerTimer(_millis(kept[0][1]))
        else:
            self.waiting.clear()
        if until is not None:
            self.until.update((until,))
        yield pd.DataFrame(out, columns=["vault_id", "event_id", "at"])

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first whole millisecond at which a time has passed."""
    return -(-micros // 1000)


def unsuppressed_stream(events: DataFrame, runs: DataFrame, drain_seconds: int = 1, late: str = "1 minute") -> DataFrame:
    """The same on streams: an event is let through, or not, when the watermark passes it, however late it and the begin of its run came within ``late``.

    State is what came in the last ``late`` and one time a vault; it needs the
    session's RocksDB state store. Rows later than the watermark are dropped.
    """
    both = marked(events, runs, drain_seconds).withWatermark("ts", late)
    both = both.withColumns({"at": F.unix_micros("ts"), "until_at": F.unix_micros("until")})
    passed = both.groupBy("vault_id").transformWithStateInPandas(Suppression(), "vault_id string, event_id long, at long", outputMode="Append", timeMode="EventTime")
    return passed.select("vault_id", "event_id", F.timestamp_micros("at").alias("ts"))


def coalesced_jobs(requests: DataFrame) -> DataFrame:
    """One index job per path of a table of requests."""
    return requests.groupBy(*KEYS).agg(F.min("ts").alias("ts"), F.count("*").alias("requests"))


def job_stream(requests: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``job`` on the coalesced jobs of each micro-batch.

    Requests that come while a batch runs wait for the next one, so however
    many they are, their path runs once more, and none is lost.
    """
    return each_batch(requests, lambda batch, number: job(coalesced_jobs(batch), number), checkpoint)


def safety_runs(runs: DataFrame, interval_seconds: int) -> DataFrame:
    """Gaps between runs of a vault that call for a run of their own. runs: vault_id, ts."""
    before = F.lag("ts").over(Window.partitionBy("vault_id").orderBy("ts"))
    gap = F.unix_micros("ts") - F.unix_micros(before)
    rows = runs.withColumn("gap_seconds", F.floor(gap / 1_000_000))
    return rows.where((F.lit(interval_seconds) > 0) & (F.col("gap_seconds") >= interval_seconds))


def each_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch job on every micro-batch."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit_stream(requests: DataFrame, vaults: Callable[[], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Continuous write admission; decisions go to ``folder/decisions/v=<batch>``.

    State: the files (a ``KeyedTable`` by path) and the counter of each vault,
    of which a batch reads and writes what it touches, and the hashes of all
    accepted versions, to which a batch adds its own. ``vaults()`` gives the
    vaults that exist (vault_id, current_revision), read again for each batch;
    requests of others are not admitted.
    """

    def admit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files, counters = KeyedTable(spark, f"{folder}/files", FILES, KEYS), KeyedTable(spark, f"{folder}/counters", COUNTERS, ["vault_id"])
        heads = [t.head(number) for t in (files, counters)]
        paths, of_vault = batch.select(*KEYS).distinct(), batch.select("vault_id").distinct()
        old = files.rows(heads[0], files.touched(paths)).join(paths, KEYS, "left_semi")
        stored = versions_before(spark, f"{folder}/versions", number, versions_part(paths)).join(paths, KEYS, "left_semi")
        top = counters.rows(heads[1], counters.touched(of_vault)).withColumnRenamed("current_revision", "top")
        known = vaults().join(top, "vault_id", "left")
        known = known.select("vault_id", F.greatest("current_revision", F.coalesce("top", F.lit(0))).alias("current_revision"))
        V.admit_writes(batch, old, stored, known).write.mode("overwrite").parquet(f"{folder}/decisions/v={number}")
        decisions = spark.read.parquet(f"{folder}/decisions/v={number}")
        accepted = decisions.where("decision = 'accepted'")
        kept = accepted.where("event_type != 'DELETE' AND source_path LIKE '%.md'").select(*KEYS, "revision", "content_hash")
        kept.withColumn("part", versions_hash()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/versions/v={number}")
        files.write(number, heads[0], V.applied_state(old, decisions).join(accepted.select(*KEYS).distinct(), KEYS, "left_semi"))
        counters.write(number, heads[1], accepted.groupBy("vault_id").agg(F.max("revision").alias("current_revision")))

    return each_batch(requests, admit, checkpoint)


def versions_hash() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)).cast("int")


def versions_part(paths: DataFrame) -> list[int]:
    return [r[0] for r in paths.select(versions_hash()).distinct().collect()]  # at most PARTS numbers


def versions_before(spark: SparkSession, folder: str, number: int, parts: list[int]) -> DataFrame:
    """Versions that earlier batches accepted, of some parts; each lies where its batch wrote it once."""
    try:
        rows = spark.read.parquet(folder)
    except Exception as error:  # AnalysisException: nothing was written yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], VERSIONS)
        raise
    if "part" not in rows.columns:
        return spark.createDataFrame([], VERSIONS)
    return rows.where((F.col("v") < number) & F.col("part").isin(parts)).select("vault_id", "source_path", "revision", "content_hash")


def index_stream(changes: DataFrame, files: Callable[[], DataFrame], embed: I.Embed, dimension: int, model: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Index the notes of each micro-batch (vault_id, source_path, content) and drop the chunks of deleted ones (null content).

    The chunk table is a ``KeyedTable`` by path: a batch writes the chunks of the notes that it indexed.
    """

    def index(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = KeyedTable(spark, folder, CHUNKS, KEYS)
        head, keys = state.head(number), batch.select(*KEYS).distinct()
        old = state.rows(head, state.touched(keys)).join(keys, KEYS, "left_semi")
        notes = batch.where("content IS NOT NULL")
        done = I.index_notes(files().join(keys, KEYS, "left_semi"), notes, old, embed, dimension, model)
        settled = done["files"].where("index_status IN ('indexed', 'pending', 'skipped')").select(*KEYS)
        chunks = written(spark, done["chunks"].join(settled, KEYS, "left_semi"), "chunks")
        empty = settled.join(chunks.select(*KEYS).distinct(), KEYS, "left_anti")
        state.write(number, head, chunks, gone=batch.where("content IS NULL").select(*KEYS).unionByName(empty))

    return each_batch(changes, index, checkpoint)
