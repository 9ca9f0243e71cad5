"""Three-way device sync: scan x manifest x server events to one action per path.

Keys: ``vault_id``, ``device_id``, ``source_path``; every input shares them, so
one shuffle serves all joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflow.functions import rules as R
from noteflow.operators.revisions import events_after, latest_per_path
from noteflow.sources.scratch import written

KEYS = ["vault_id", "device_id", "source_path"]
POLICIES = ("manual", "local-wins", "remote-wins")


def local_changes(scan: DataFrame, manifest: DataFrame, excluded: DataFrame | None = None, sync_attachments: bool = True) -> DataFrame:
    """new, modified or deleted paths of each device.

    Excluded attachments, and all attachments where they are off, are never deleted.
    """
    here, known = scan.select(*KEYS, F.col("content_hash").alias("local_hash")), manifest.select(*KEYS, F.col("content_hash").alias("known_hash"), "server_revision")
    rows = here.join(known, KEYS, "full_outer")
    change = F.when(F.col("known_hash").isNull(), "new").when(F.col("local_hash").isNull(), "deleted").when(F.col("local_hash") != F.col("known_hash"), "modified")
    rows = rows.withColumn("change", change).where("change IS NOT NULL")
    if not sync_attachments:
        rows = rows.where((F.col("change") != "deleted") | F.endswith("source_path", F.lit(".md")))
    if excluded is not None:
        gone = excluded.select(*KEYS).withColumn("change", F.lit("deleted"))
        rows = rows.join(gone, [*KEYS, "change"], "left_anti")
    return rows.select(*KEYS, "change", "local_hash", "server_revision")


def pull_plan(
    events: DataFrame, cursors: DataFrame, manifest: DataFrame, scan: DataFrame, policy: str = "manual", sync_attachments: bool = True, stored: DataFrame | None = None,
) -> DataFrame:
    """The pull action for the last event of each path after the device's cursor.

    stored: vault_id, source_path, stored_hash of the bytes that the server
    holds. A file that would be written is a ``mismatch`` if they are missing
    or have another hash than the event tells; it is left as it is.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    # a path's last event is its last one after a cursor too, if it comes after the cursor: one row a path meets the devices
    last = latest_per_path(events.select("vault_id", "source_path", "revision", F.col("content_hash").alias("server_hash"), "deleted"))
    torn = F.lit(False)
    if stored is not None:
        last = last.join(stored.select("vault_id", "source_path", "stored_hash"), ["vault_id", "source_path"], "left")
        torn = ~F.col("stored_hash").eqNullSafe(F.col("server_hash"))
    rows = last.join(cursors.select("vault_id", "device_id", "cursor"), "vault_id").where("revision > cursor")
    rows = rows.join(manifest.select(*KEYS, F.col("content_hash").alias("m_hash")), KEYS, "left").join(scan.select(*KEYS, F.col("content_hash").alias("l_hash")), KEYS, "left")
    attachment = ~F.endswith("source_path", F.lit(".md"))
    same = F.coalesce(F.col("l_hash") == F.col("m_hash"), F.lit(False))
    diverged = F.when(F.col("m_hash").isNotNull(), F.col("l_hash") != F.col("m_hash")).otherwise(F.col("l_hash") != F.col("server_hash"))
    action = (
        F.when(R.checked_path(F.col("source_path"))["error"].isNotNull(), "reject").when(attachment & F.lit(not sync_attachments), "ignore")
        .when(~F.col("deleted") & F.coalesce(F.col("m_hash") == F.col("server_hash"), F.lit(False)), "bump").when(F.col("deleted") & F.col("l_hash").isNull(), "forget")
        .when(F.col("deleted") & F.col("m_hash").isNotNull() & same, "delete_local").when(F.col("deleted"), "delete_conflict")
        .when(torn, "mismatch").when(F.col("l_hash").isNotNull() & diverged, "write_conflict").otherwise("apply")
    )
    settled = {
        "manual": {"write_conflict": "report", "delete_conflict": "report_deleted"},
        "local-wins": {"write_conflict": "put_server_revision", "delete_conflict": "put_zero"},
        "remote-wins": {"write_conflict": "backup_and_adopt", "delete_conflict": "backup_and_delete"},
    }[policy]
    resolution = F.when(action == "write_conflict", settled["write_conflict"]).when(action == "delete_conflict", settled["delete_conflict"])
    return rows.select(*KEYS, "revision", action.alias("action"), resolution.alias("resolution"))


def push_plan(changes: DataFrame, conflicts: DataFrame, pulled: DataFrame) -> DataFrame:
    """PUT, DELETE, drop or skip with its base revision, for each local change.

    conflicts (tracked): keys, server_revision, local_content_hash, server_deleted; pulled: the pull plan, whose conflicts are skipped.
    """
    busy = pulled.where("action IN ('write_conflict', 'delete_conflict')").select(*KEYS)
    tracked = conflicts.select(*KEYS, F.col("server_revision").alias("c_revision"), "local_content_hash", "server_deleted")
    rows = changes.join(busy, KEYS, "left_anti").join(tracked, KEYS, "left")
    open_, gone = F.col("c_revision").isNotNull(), F.col("change") == "deleted"
    action = (
        F.when(gone & open_ & F.col("server_deleted"), "drop_conflict").when(gone, "DELETE")
        .when(open_ & (F.col("local_content_hash") == F.col("local_hash")), "skip").otherwise("PUT")
    )
    base = F.when(F.col("change") == "new", F.coalesce("c_revision", F.lit(0))).otherwise(F.coalesce("c_revision", "server_revision"))
    return rows.select(*KEYS, "change", action.alias("action"), F.when(action.isin("PUT", "DELETE"), base).alias("base_revision"))


def sync_summary(pull: DataFrame, push: DataFrame, devices: DataFrame, events: DataFrame) -> DataFrame:
    """Counts per device: events after its cursor (``pulled``, each event of a path counts), and rows of both plans by action."""
    two = ["vault_id", "device_id"]
    pulled = events_after(events, devices).withColumnRenamed("events_after", "pulled")
    a = pull.groupBy(*two).agg(
        F.count_if(F.col("action") == "apply").alias("applied"), F.count_if(F.col("action") == "delete_local").alias("locally_deleted"),
        F.count_if(F.col("action").isin("write_conflict", "delete_conflict")).alias("conflicts"), F.count_if(F.col("action").isin("reject", "mismatch")).alias("warnings"),
    )
    b = push.groupBy(*two).agg(F.count_if(F.col("action") == "PUT").alias("pushed"), F.count_if(F.col("action") == "DELETE").alias("remotely_deleted"))
    rows = devices.select(*two, "cursor").join(pulled, ["vault_id", "cursor"], "left").drop("cursor")
    return rows.join(a, two, "left").join(b, two, "left").fillna(0)


def new_reports(conflicts: DataFrame, existing: DataFrame) -> DataFrame:
    """One conflict report per (path, device, server revision), attachments per (path, device, content hash); not those that exist."""
    attachment = ~F.endswith("source_path", F.lit(".md"))
    mark = F.when(attachment, F.col("content_hash")).otherwise(F.col("server_revision").cast("string"))
    rows = conflicts.withColumn("mark", mark)
    first = F.row_number().over(Window.partitionBy(*KEYS, "mark").orderBy("server_revision", "content_hash"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n")
    return rows.join(existing.select(*KEYS, "mark"), [*KEYS, "mark"], "left_anti")


def plan_sync(
    events: DataFrame, cursors: DataFrame, manifest: DataFrame, scan: DataFrame, tracked: DataFrame, reports: DataFrame, policy: str = "manual", sync_attachments: bool = True, stored: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """A whole sync of each device: pull and push plans as one, the conflict reports that are new, and the summary.

    tracked: conflicts that the device knows of; reports: those that were
    reported (keys, mark). Only the manual policy reports conflicts. The two
    plans are written once, since reports and summary start from them.
    """
    spark = events.sparkSession
    pull = written(spark, pull_plan(events, cursors, manifest, scan, policy, sync_attachments, stored), "pull")
    push = written(spark, push_plan(local_changes(scan, manifest, sync_attachments=sync_attachments), tracked, pull), "push")
    none = lambda kind: F.lit(None).cast(kind)
    plan = pull.select(*KEYS, F.lit("pull").alias("side"), "action", "resolution", "revision", none("long").alias("base_revision"))
    plan = plan.unionByName(push.select(*KEYS, F.lit("push").alias("side"), "action", none("string").alias("resolution"), none("long").alias("revision"), F.col("base_revision").cast("long")))
    local = scan.select(*KEYS, "content_hash")
    found = pull.where("resolution IN ('report', 'report_deleted')").select(*KEYS, F.col("revision").alias("server_revision")).join(local, KEYS, "left")
    return {"plan": plan, "reports": new_reports(found, reports), "summary": sync_summary(pull, push, cursors, events)}
