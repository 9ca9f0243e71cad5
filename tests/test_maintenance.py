from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noteflow.operators import maintenance as M
from noteflow.operators import reconcile as C

NOW = datetime(2024, 2, 1)


def test_retention_moves_rows_once(spark):
    files = spark.createDataFrame([("v", "a.md", True, NOW - timedelta(days=8)), ("v", "b.md", True, NOW - timedelta(days=6)), ("v", "c.md", False, None)], "vault_id string, source_path string, deleted boolean, deleted_at timestamp")
    chunks = spark.createDataFrame([("v", "a.md", 0), ("v", "b.md", 0)], "vault_id string, source_path string, chunk_index int")
    r = M.apply_retention(files, chunks, F.lit(NOW), 7)
    assert {k: [x.source_path for x in v.orderBy("source_path").collect()] for k, v in r.items()} == {"files": ["b.md", "c.md"], "chunks": ["b.md"], "archived_files": ["a.md"], "archived_chunks": ["a.md"]}


def test_latest_version_is_never_pruned(spark):
    rows = [("v", "a.md", 1, NOW - timedelta(days=100)), ("v", "a.md", 2, NOW), ("v", "b.md", 3, NOW - timedelta(days=100))]
    got = M.prunable_versions(spark.createDataFrame(rows, "vault_id string, source_path string, revision long, created_at timestamp"), F.lit(NOW), 90).collect()
    assert [(r.source_path, r.revision) for r in got] == [("a.md", 1)]


def test_pull_and_push_tables(spark):
    e = spark.createDataFrame([("v", p, r, h, d) for p, r, h, d in [("same.md", 5, "h", False), ("gone.md", 6, "h", True), ("edit.md", 7, "n", False), ("new.md", 8, "n", False), ("kept.md", 9, "h", True), ("../x.md", 10, "h", False), ("mine.md", 11, "n", False)]], "vault_id string, source_path string, revision long, content_hash string, deleted boolean")
    cur = spark.createDataFrame([("v", "d", 4)], "vault_id string, device_id string, cursor long")
    m = spark.createDataFrame([("v", "d", p, h, 1) for p, h in [("same.md", "h"), ("gone.md", "h"), ("edit.md", "o"), ("kept.md", "o")]], "vault_id string, device_id string, source_path string, content_hash string, server_revision long")
    s = spark.createDataFrame([("v", "d", p, h) for p, h in [("same.md", "h"), ("gone.md", "h"), ("edit.md", "local"), ("kept.md", "x"), ("mine.md", "n")]], "vault_id string, device_id string, source_path string, content_hash string")
    plan = C.pull_plan(e, cur, m, s, "local-wins")
    got = {r.source_path: (r.action, r.resolution) for r in plan.collect()}
    assert got == {
        "same.md": ("bump", None), "gone.md": ("delete_local", None), "edit.md": ("write_conflict", "put_server_revision"), "new.md": ("apply", None), "kept.md": ("delete_conflict", "put_zero"),
        "../x.md": ("reject", None), "mine.md": ("apply", None),
    }
    none = spark.createDataFrame([], "vault_id string, device_id string, source_path string, server_revision long, local_content_hash string, server_deleted boolean")
    push = {r.source_path: (r.action, r.base_revision) for r in C.push_plan(C.local_changes(s, m), none, plan).collect()}
    assert push == {"mine.md": ("PUT", 0)}


def test_stored_bytes_of_another_hash_are_not_written(spark):
    e = spark.createDataFrame([("v", p, r, h, d) for p, r, h, d in [("good.md", 5, "h", False), ("torn.md", 6, "h", False), ("none.md", 7, "h", False), ("gone.md", 8, "h", True), ("same.md", 9, "h", False)]], "vault_id string, source_path string, revision long, content_hash string, deleted boolean")
    cur = spark.createDataFrame([("v", "d", 4)], "vault_id string, device_id string, cursor long")
    m = spark.createDataFrame([("v", "d", "same.md", "h", 1)], "vault_id string, device_id string, source_path string, content_hash string, server_revision long")
    s = m.drop("server_revision")
    stored = spark.createDataFrame([("v", "good.md", "h"), ("v", "torn.md", "x"), ("v", "same.md", "x")], "vault_id string, source_path string, stored_hash string")
    got = {r.source_path: r.action for r in C.pull_plan(e, cur, m, s, stored=stored).collect()}
    assert got == {"good.md": "apply", "torn.md": "mismatch", "none.md": "mismatch", "gone.md": "forget", "same.md": "bump"}


def test_summary_counts_every_event_after_the_cursor(spark, monkeypatch):
    from noteflow.operators import revisions as V

    monkeypatch.setattr(V, "SLICE", 7)  # many slices in a short log
    n = 100
    e = spark.createDataFrame([("v", f"n{r % 3}.md", r, f"h{r}", False) for r in range(1, n + 1)] + [("w", "a.md", 1, "h", False)], "vault_id string, source_path string, revision long, content_hash string, deleted boolean")
    at = {("v", "d0"): 0, ("v", "d1"): 7, ("v", "d2"): 50, ("v", "d3"): 50, ("v", "d4"): n, ("v", "d5"): n + 9, ("v", "d6"): None, ("w", "d0"): 0}
    cur = spark.createDataFrame([(*k, c) for k, c in at.items()], "vault_id string, device_id string, cursor long")
    m = spark.createDataFrame([], "vault_id string, device_id string, source_path string, content_hash string, server_revision long")
    plan = C.pull_plan(e, cur, m, m.drop("server_revision"))
    push = spark.createDataFrame([], "vault_id string, device_id string, action string")
    got = {(r.vault_id, r.device_id): (r.pulled, r.applied) for r in C.sync_summary(plan, push, cur, e).collect()}
    assert got == {("v", "d0"): (100, 3), ("v", "d1"): (93, 3), ("v", "d2"): (50, 3), ("v", "d3"): (50, 3), ("v", "d4"): (0, 0), ("v", "d5"): (0, 0), ("v", "d6"): (0, 0), ("w", "d0"): (1, 1)}


def test_excluded_attachments_are_not_deleted(spark):
    m = spark.createDataFrame([("v", "d", p, "h", 1) for p in ("a.png", "b.png", "c.md")], "vault_id string, device_id string, source_path string, content_hash string, server_revision long")
    s = spark.createDataFrame([], "vault_id string, device_id string, source_path string, content_hash string")
    x = spark.createDataFrame([("v", "d", "a.png")], "vault_id string, device_id string, source_path string")
    assert sorted(r.source_path for r in C.local_changes(s, m, x).collect()) == ["b.png", "c.md"]
    assert [r.source_path for r in C.local_changes(s, m, sync_attachments=False).collect()] == ["c.md"]


def test_later_feedback_overwrites_with_nulls(spark):
    logs = spark.createDataFrame([("r", "v")], "request_id string, vault_id string")
    schema = "request_id string, vault_id string, seq long, helpful boolean, selected_source_path string, selected_chunk_rank int, expected_missing boolean, comment string"
    fb = spark.createDataFrame([("r", "v", 1, True, None, None, None, "good"), ("r", "v", 2, False, None, None, None, None), ("x", "v", 3, True, None, None, None, None), ("r", "v", 4, None, None, None, None, None)], schema)
    done, bad = M.attach_feedback(logs, fb)
    assert (done.first().feedback_helpful, done.first().feedback_comment) == (False, None)
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [(3, "request not found"), (4, "feedback is empty")]


def test_dry_run_and_run_tell_the_same(spark):
    from pyspark.sql import functions as F

    from noteflow.operators import maintenance as M

    old, new = "2024-01-01 00:00:00", "2024-03-01 00:00:00"
    files = spark.createDataFrame([("v", "a.md", True, old), ("v", "b.md", True, new), ("w", "c.md", False, None)], "vault_id string, source_path string, deleted boolean, deleted_at string").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    chunks = spark.createDataFrame([("v", "a.md", 0), ("v", "a.md", 1), ("w", "c.md", 0)], "vault_id string, source_path string, chunk_index int")
    versions = spark.createDataFrame([("v", "a.md", 1, old), ("v", "a.md", 2, old), ("w", "c.md", 1, old), ("w", "c.md", 5, new)], "vault_id string, source_path string, revision long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    as_of = F.lit("2024-03-02 00:00:00").cast("timestamp")
    real, dry = (M.retention(files, chunks, versions, as_of, 7, 30, dry_run=d) for d in (False, True))
    for name in ("summary", "rows", "archived_files", "archived_chunks"):
        assert sorted(map(str, real[name].collect())) == sorted(map(str, dry[name].collect()))
    assert sorted((r.vault_id, r.archived, r.pruned) for r in dry["summary"].collect()) == [("v", 1, 1), ("w", 0, 1)]
    assert [real[n].count() for n in ("files", "chunks", "versions")] == [2, 1, 2] and [dry[n].count() for n in ("files", "chunks", "versions")] == [3, 3, 4]


def test_tags_text_in_sql(spark):
    from noteflow.functions import text as T

    T.register_sql(spark)
    rows = spark.sql("SELECT immutable_tags_text(t) AS x FROM VALUES (array('a', 'b c')), (array()), (cast(null AS array<string>)), (array('a', null)) AS v(t)").collect()
    assert [r.x for r in rows] == ["a b c", "", "", "a"]
