"""Revision log: change feed, snapshots, write admission, conflict resolution, back-fill."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflow.functions import rules as R
from noteflow.sources.scratch import written

PAGE, MOST_PAGE = 500, 1000
#: Revisions of a slice in which a vault's log is counted for its feeds.
FEED_SLICE = 256
KEYS = ["vault_id", "source_path"]
#: Length of a slice of a vault's sequence in which requests are numbered by one task.
SLICE = 100_000


def change_feed(events: DataFrame, cursors: DataFrame, limit: int = PAGE) -> DataFrame:
    """The next page of each device's feed: events after its cursor in revision order.

    The log is counted in slices of FEED_SLICE revisions; from the counts follows
    the last slice that a page can reach, wherever revisions are missing. Events
    are joined by slice, so a device meets its page and two slices at most, and
    never the rest of its vault's log.
    """
    limit = min(limit, MOST_PAGE)
    devices = cursors.select("vault_id", F.col("device_id").alias("to_device"), "cursor").where("cursor IS NOT NULL")
    slices = feed_slices(events)
    reach = feed_reach(devices, slices, limit)
    pages = reach.join(slices.select("vault_id", "rank", "slice"), ["vault_id", "rank"]).select("vault_id", "to_device", "cursor", "slice")
    after = events.withColumn("slice", F.floor(F.col("revision") / FEED_SLICE)).join(pages, ["vault_id", "slice"]).where(F.col("revision") > F.col("cursor")).drop("slice")
    place = F.row_number().over(Window.partitionBy("vault_id", "to_device").orderBy("revision"))
    return after.withColumn("n", place).where(F.col("n") <= limit).drop("n")


def feed_slices(events: DataFrame) -> DataFrame:
    """vault_id, slice, upto (events up to the slice's end), rank: the slices of each vault's log that hold events."""
    counts = events.groupBy("vault_id", F.floor(F.col("revision") / FEED_SLICE).alias("slice")).agg(F.count("*").alias("n"))
    line = Window.partitionBy("vault_id").orderBy("slice")
    counts = counts.select("vault_id", "slice", F.sum("n").over(line).alias("upto"), F.row_number().over(line).alias("rank"))
    return written(events.sparkSession, counts, "feed_slices")


def feed_reach(devices: DataFrame, slices: DataFrame, limit: int) -> DataFrame:
    """vault_id, to_device, cursor, rank: the slices from a device's cursor to where its page ends at the latest.

    Both ends are found by lining up devices and slices of a vault, first by
    slice and then by counts; there are as many ranks as the page has events,
    and two, at most.
    """
    none = lambda kind: F.lit(None).cast(kind)
    marks = devices.select("vault_id", "to_device", "cursor", F.floor(F.col("cursor") / FEED_SLICE).alias("slice"), none("long").alias("upto"), none("int").alias("rank"))
    rows = slices.select("vault_id", none("string").alias("to_device"), none("long").alias("cursor"), "slice", "upto", "rank").unionByName(marks)
    by_slice = Window.partitionBy("vault_id").orderBy("slice", F.col("rank").isNull())
    last = lambda c: F.last(c, ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"first": F.coalesce(last("rank"), F.lit(1)), "seen": F.coalesce(last("upto"), F.lit(0)), "ranks": F.max("rank").over(Window.partitionBy("vault_id"))})
    rows = rows.withColumn("line", F.when(F.col("rank").isNull(), F.col("seen") + limit).otherwise(F.col("upto")))
    by_count = Window.partitionBy("vault_id").orderBy(F.desc("line"), F.col("rank").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.coalesce(F.last("rank", ignorenulls=True).over(by_count), "ranks"))
    return rows.where("rank IS NULL AND ranks IS NOT NULL").select("vault_id", "to_device", "cursor", F.explode(F.sequence("first", "end")).alias("rank"))


def advanced_cursors(page: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursors after a page: the last revision returned, else as before."""
    last = page.groupBy("vault_id", F.col("to_device").alias("device_id")).agg(F.max("revision").alias("to_cursor"))
    out = cursors.join(last, ["vault_id", "device_id"], "left")
    return out.select("vault_id", "device_id", F.coalesce("to_cursor", "cursor").alias("to_cursor"))


def latest_per_path(events: DataFrame, until: int | None = None) -> DataFrame:
    """The last event of each path (up to a revision): a snapshot. Partial aggregation, no sort of the history."""
    rows = events if until is None else events.where(F.col("revision") <= until)
    rest = [c for c in events.columns if c not in KEYS]
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "revision").alias("last"))
    return last.select(*KEYS, *[F.col(f"last.{c}").alias(c) for c in rest])


def version_lookup(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """Versions that (vault_id, source_path, revision or null) name; null: the latest."""
    wanted = asked.withColumnRenamed("revision", "wanted")
    rows = versions.join(wanted, KEYS).where(F.col("wanted").isNull() | (F.col("wanted") == F.col("revision")))
    rest = [c for c in versions.columns if c not in KEYS]
    last = rows.groupBy(*KEYS, "wanted").agg(F.max_by(F.struct(*rest), "revision").alias("v"))
    return last.select(*KEYS, "wanted", *[F.col(f"v.{c}").alias(c) for c in rest])


def verified_read(files: DataFrame, stored: DataFrame, versions: DataFrame) -> DataFrame:
    """Where the verified content of each live file comes from: disk, version or error.

    stored: vault_id, source_path, stored_hash. Bytes that are missing are an
    error; bytes of another hash fall back to the latest version for markdown.
    """
    latest = versions.groupBy(*KEYS).agg(F.max("revision").alias("version_revision"))
    rows = files.join(stored, KEYS, "left").join(latest, KEYS, "left")
    source = (
        F.when(F.col("deleted"), "not_found").when(F.col("stored_hash").isNull(), "missing").when(F.col("stored_hash") == F.col("content_hash"), "disk")
        .when(F.endswith("source_path", F.lit(".md")) & F.col("version_revision").isNotNull(), "version").otherwise("mismatch")
    )
    return rows.select(*KEYS, source.alias("source"), F.when(source == "version", F.col("version_revision")).alias("version_revision"))


def backfill(files: DataFrame, vaults: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revisions for the live files of each vault in id order, one CREATE event each, and the new counters."""
    live = files.where("NOT deleted").join(vaults.select("vault_id", "current_revision"), "vault_id")
    placed = consecutive(live.withColumns({"seq": F.col("id"), "slice": F.floor(F.col("id") / SLICE)}), F.lit(True))
    numbered = placed.withColumn("revision", F.col("current_revision") + F.col("number")).drop("current_revision", "seq", "slice", "number")
    events = numbered.select("vault_id", "revision", "source_path", F.lit("CREATE").alias("event_type"), "content_hash", F.lit(False).alias("deleted"))
    top = numbered.groupBy("vault_id").agg(F.max("revision").alias("top"))
    counters = vaults.join(top, "vault_id", "left").select("vault_id", F.coalesce("top", "current_revision").alias("current_revision"))
    return numbered, events, counters


def request_error(kind: Column, path: Column, n_bytes: Column) -> Column:
    """First row check that fails: path, ignored folder and file kind of puts, size."""
    checked = R.checked_path(path)
    put = kind.isin("PUT", "FORCE")
    return (
        F.when(checked["error"].isNotNull(), checked["error"]).when(put & R.is_ignored(path), "source path is ignored")
        .when(put & R.file_policy(path)["error"].isNotNull(), R.file_policy(path)["error"])
        .when(put, R.size_error(path, n_bytes, R.REVISION_MARKDOWN_BYTES))
    )


DECISIONS = "vault_id string, source_path string, seq long, kind string, decision string, event_type string, content_hash string, server_seen long, base_revision long"
DECIDED = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in DECISIONS.split(", "))])


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the requests of each path in arrival order; only the state of the current path is carried from batch to batch.

    Rows in order of path and seq: seq, kind (PUT, FORCE, DELETE, RESTORE), base_revision, content_hash, restore_revision,
    the path's state at the start: s_revision (null: absent), s_hash, s_deleted, s_latest (struct of its latest version's
    hash, null: none), and s_restore (struct of the hash of the version that the request names, null: none).
    A revision given in this batch is not known yet: it is written as -seq.
    """
    path = state = latest = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if path != (r["vault_id"], r["source_path"]):
                path = r["vault_id"], r["source_path"]
                state = None if r["s_revision"] is None else (r["s_revision"], r["s_hash"], bool(r["s_deleted"]))
                latest = r["s_latest"]
            kind, base = r["kind"], r["base_revision"] or 0
            live = state is not None and not state[2]
            at = state[0] if state else 0
            event = content = None
            if kind == "PUT":
                if not live and base == 0:
                    decision, event, content = "accepted", "CREATE", r["content_hash"]
                elif not live or base != at:
                    decision = "conflict"
                elif r["content_hash"] == state[1]:
                    decision = "replay"
                else:
                    decision, event, content = "accepted", "UPDATE", r["content_hash"]
            elif kind == "FORCE":
                if live and r["content_hash"] == state[1]:
                    decision = "noop"
                else:
                    decision, event, content = "accepted", "UPDATE" if live else "CREATE", r["content_hash"]
            elif kind == "DELETE":
                if not live:
                    decision = "not_found"
                elif base != at:
                    decision = "conflict"
                else:
                    decision, event, content = "accepted", "DELETE", state[1]
            elif live:
                decision = "rejected"
            else:
                # versions of this batch are the newest; a client cannot name them yet
                wanted = latest if r["restore_revision"] is None else r["s_restore"]
                if state is None or wanted is None:
                    decision = "not_found"
                else:
                    decision, event, content = "accepted", "RESTORE", wanted["hash"]
            out.append((*path, r["seq"], kind, decision, event, content, at if decision == "conflict" else None, base))
            if event:
                state = (-r["seq"], content, event == "DELETE")
                if event != "DELETE" and path[1].endswith(".md"):  # other files have no versions
                    latest = {"hash": content}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), DECIDED.types)] if out else [pa.array([], t) for t in DECIDED.types], schema=DECIDED)


def admit_writes(requests: DataFrame, files: DataFrame, versions: DataFrame, vaults: DataFrame) -> DataFrame:
    """Decide every request and number the accepted ones.

    requests: vault_id, source_path, seq (> 0, arrival order), kind, base_revision,
    content_hash, restore_revision. Bases must not exceed the vault's counter at
    the start (a client knows issued revisions only). The fold runs on hashes;
    content stays out of it. Versions stay rows: a request meets the one that it
    names and its path's latest. A path's requests are one ordered stream, read
    in batches, so that no path has to fit in memory. Returns the decisions with revision (accepted)
    and server_revision (conflicts).
    """
    state = files.select(*KEYS, F.col("revision").alias("s_revision"), F.col("content_hash").alias("s_hash"), F.col("deleted").alias("s_deleted"))
    one = F.struct(F.col("content_hash").alias("hash"))
    latest = versions.groupBy(*KEYS).agg(F.max_by(one, "revision").alias("s_latest"))
    named = versions.groupBy(*KEYS, F.col("revision").alias("restore_revision")).agg(F.max(one).alias("s_restore"))
    known = requests.join(vaults.select("vault_id"), "vault_id", "left_semi")
    rows = known.join(state, KEYS, "left").join(latest, KEYS, "left").join(named, [*KEYS, "restore_revision"], "left")
    # dealt by a hash of the path and not by the path itself, so that no join above, which may be split, serves as this exchange
    ordered = rows.repartition(F.xxhash64(*KEYS)).sortWithinPartitions(*KEYS, "seq")
    decided = written(requests.sparkSession, ordered.mapInArrow(decide, DECISIONS), "decided")
    numbered = consecutive(decided.withColumn("slice", F.floor(F.col("seq") / SLICE)), F.col("decision") == "accepted")
    rows = numbered.join(vaults.select("vault_id", "current_revision"), "vault_id")
    rows = rows.withColumn("revision", F.when(F.col("decision") == "accepted", F.col("current_revision") + F.col("number")))
    # a state of this batch (negative) is the revision that the request of that seq was given
    given = rows.where("decision = 'accepted'").select("vault_id", (-F.col("seq")).alias("server_seen"), F.col("revision").alias("seen_revision"))
    rows = rows.join(given, ["vault_id", "server_seen"], "left").withColumn("server_revision", F.coalesce("seen_revision", "server_seen"))
    return rows.drop("server_seen", "seen_revision", "current_revision", "number", "slice")


def admission(requests: DataFrame, files: DataFrame, versions: DataFrame, vaults: DataFrame) -> dict[str, DataFrame]:
    """The whole of a batch of writes: decisions, events, versions, conflicts and the files after it.

    requests: as in ``admit_writes``, with n_bytes, device_id and origin. A
    request of no known vault, or one that fails a check of its path, kind of
    file or size, is decided as ``invalid`` with the first error and changes
    nothing. Conflicts are rows of their own: open, unless a later accepted
    write of the batch on their path has settled them. Only markdown has
    versions; the origin is kept of puts.
    """
    spark = requests.sparkSession
    error = request_error(F.col("kind"), F.col("source_path"), F.col("n_bytes"))
    known = vaults.select("vault_id", F.lit(True).alias("known"))
    rows = requests.join(known, "vault_id", "left").withColumn("error", F.when(F.col("known").isNull(), "vault not found").otherwise(error)).drop("known")
    rows = written(spark, rows, "checked")
    good = rows.where("error IS NULL").withColumn("source_path", R.checked_path(F.col("source_path"))["path"])
    decided = admit_writes(good.drop("error"), files, versions, vaults)
    about = good.select("vault_id", "seq", "device_id", "origin")
    decided = written(spark, decided.join(about, ["vault_id", "seq"]), "decisions")
    none = lambda kind: F.lit(None).cast(kind)
    outcome = ["vault_id", "source_path", "seq", "kind", "decision", "error", "event_type", "content_hash", "revision", "server_revision"]
    bad = rows.where("error IS NOT NULL").select(
        "vault_id", "source_path", "seq", "kind", F.lit("invalid").alias("decision"), "error", none("string").alias("event_type"), none("string").alias("content_hash"), none("long").alias("revision"), none("long").alias("server_revision")
    )
    accepted = decided.where("decision = 'accepted'")
    deleted = F.col("event_type") == "DELETE"
    put = F.when(F.col("kind").isin("PUT", "FORCE"), F.col("origin"))
    events = accepted.select("vault_id", "revision", "source_path", "event_type", "content_hash", deleted.alias("deleted"), "device_id", put.alias("origin"))
    new = accepted.where(~deleted & F.endswith("source_path", F.lit(".md"))).select("vault_id", "source_path", "revision", "content_hash", "event_type", "device_id")
    conflicts = decided.where("decision = 'conflict'").select("vault_id", "source_path", "seq", "server_revision", F.col("base_revision").alias("client_base_revision"), "device_id", F.lit("OPEN").alias("status"))
    conflicts = resolved_conflicts(conflicts, accepted.select(*KEYS, "seq"))
    return {"decisions": decided.withColumn("error", none("string")).select(*outcome).unionByName(bad), "events": events, "versions": new, "conflicts": conflicts, "files": applied_state(files, decided)}


def consecutive(rows: DataFrame, counted: Column) -> DataFrame:
    """Adds ``number``: how many counted rows of the vault come up to a row in order of seq.

    A vault's log is numbered in slices of its sequence: counts before a slice
    plus the running count inside it, so that one large vault does not end in
    one task.
    """
    one = F.when(counted, 1).otherwise(0)
    before = Window.partitionBy("vault_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("vault_id", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    per_slice = rows.groupBy("vault_id", "slice").agg(F.sum(one).alias("n"))
    per_slice = per_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = rows.withColumn("number", F.sum(one).over(inside)).join(per_slice, ["vault_id", "slice"])
    return out.withColumn("number", F.col("number") + F.col("before")).drop("before")


def events_after(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """vault_id, cursor, events_after: how many events of the vault follow each cursor that is given.

    Cursors take their places in the log and both are counted backwards in
    slices, so the log is never joined with every device. A cursor stands just
    before the event of its own revision, which does not count.
    """
    asked = cursors.select("vault_id", "cursor").where("cursor IS NOT NULL").distinct()
    rows = events.select("vault_id", F.lit(None).cast("long").alias("cursor"), (-2 * F.col("revision")).alias("seq"))
    rows = rows.unionByName(asked.withColumn("seq", -2 * F.col("cursor") - 1))
    counted = consecutive(rows.withColumn("slice", F.floor(F.col("seq") / SLICE)), F.col("cursor").isNull())
    return counted.where("cursor IS NOT NULL").select("vault_id", "cursor", F.col("number").alias("events_after"))


def resolved_conflicts(conflicts: DataFrame, accepted: DataFrame) -> DataFrame:
    """Open conflicts are resolved by any later accepted write on their path. conflicts: id, keys, seq, status; accepted: keys, seq."""
    last = accepted.groupBy(*KEYS).agg(F.max("seq").alias("last_seq"))
    later = F.coalesce(F.col("last_seq") > F.col("seq"), F.lit(False))
    out = conflicts.join(last, KEYS, "left")
    return out.withColumn("status", F.when((F.col("status") == "OPEN") & later, "RESOLVED").otherwise(F.col("status"))).drop("last_seq")


def applied_state(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """File rows after the accepted decisions: vault_id, source_path, revision, content_hash, deleted, index_status."""
    done = decisions.where("decision = 'accepted'")
    new = done.groupBy(*KEYS).agg(F.max_by(F.struct("revision", "content_hash", "event_type"), "revision").alias("n"))
    deleted = F.col("n.event_type") == "DELETE"
    pending = ~deleted & R.is_vectorizable(F.col("source_path"))
    new = new.select(*KEYS, F.col("n.revision").alias("revision"), F.col("n.content_hash").alias("content_hash"), deleted.alias("deleted"), F.when(pending, "pending").otherwise("skipped").alias("index_status"))
    old = files.join(new, KEYS, "left_anti").select(*new.columns)
    return old.unionByName(new)


def precheck_saves(requests: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Agent saves, first match wins: invalid, forbidden, put (with base), conflict, skipped or force put.

    requests: keys, seq, overwrite, allowed, base_revision, content_hash, n_bytes; stored: keys, stored_hash.
    """
    live = files.where("NOT deleted").select(*KEYS, F.col("content_hash").alias("live_hash"))
    rows = requests.join(live, KEYS, "left").join(stored.select(*KEYS, "stored_hash"), KEYS, "left")
    path = F.col("source_path")
    bad = R.checked_path(path)["error"].isNotNull() | ~F.endswith(path, F.lit(".md")) | (F.col("n_bytes") > R.MAX_BYTES["markdown"])
    decision = (
        F.when(F.col("overwrite") & F.col("base_revision").isNotNull(), "invalid").when(F.col("overwrite") & ~F.col("allowed"), "forbidden").when(bad, "invalid")
        .when(F.col("base_revision").isNotNull(), "put").when(F.col("live_hash").isNotNull() & (F.coalesce("stored_hash", F.lit("")) != F.col("live_hash")), "conflict")
        .when(F.col("live_hash") == F.col("content_hash"), "skipped").when(F.col("live_hash").isNotNull() & ~F.col("overwrite"), "conflict").otherwise("force_put")
    )
    origin = F.when(decision == "force_put", F.when(F.col("overwrite"), "mcp_overwrite").otherwise("mcp"))
    return rows.select(*KEYS, "seq", decision.alias("decision"), origin.alias("origin"))
