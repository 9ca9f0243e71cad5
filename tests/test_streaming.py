from __future__ import annotations

from noteflow.operators.revisions import latest_per_path
from noteflow.sources import tables as IO
from noteflow.streaming import streams as ST

EVENT = "vault_id string, source_path string, revision long, content_hash string"


def test_followed_log_equals_the_batch_fold(spark, tmp_path):
    source, folder = str(tmp_path / "log"), str(tmp_path / "snapshot")
    rows = [("v", f"n{i % 7}.md", i, f"h{i}") for i in range(1, 60)]
    for part in (rows[:20], rows[10:40], rows[30:], rows[:5]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        assert ST.follow_log(stream, folder, str(tmp_path / "cp")).awaitTermination(120)
    key = lambda d: sorted((r.source_path, r.revision, r.content_hash) for r in d.collect())
    assert key(ST.latest_snapshot(spark, folder, EVENT)) == key(latest_per_path(spark.createDataFrame(rows, EVENT)))


def test_debounce_stream_fires_once_a_burst(spark, tmp_path):
    source = str(tmp_path / "watch")
    rows = [("v", f"2024-01-01 00:00:0{s}") for s in (0, 1, 2, 7)] + [("v", "2024-01-01 00:10:00")]
    spark.createDataFrame(rows, "vault_id string, ts string").selectExpr("vault_id", "cast(ts AS timestamp) AS ts").write.parquet(source)
    stream = spark.readStream.schema("vault_id string, ts timestamp").parquet(source)
    fired = ST.debounced(stream, "2 seconds", "1 second")
    q = fired.writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.n_events for r in spark.sql("SELECT * FROM fired").collect()) == [1, 3]


def test_scan_of_a_note_folder(spark, tmp_path):
    for name, size in (("a.md", 3), ("sub/b c.md", 4), (".editor/x.md", 1), ("p.png", 5), ("big.png", 50), ("n.conflict.d.1.md", 1)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * size)
    kept, big = IO.scan_notes(spark, str(tmp_path), True, 10)
    assert sorted((r.source_path, r.size) for r in kept.collect()) == [("a.md", 3), ("p.png", 5), ("sub/b c.md", 4)]
    assert [r.source_path for r in big.collect()] == ["big.png"]


def test_tolerant_manifests(spark):
    rows = ['{"vault_id":"v","device_id":"d","files":{"a.md":{"server_revision":3,"content_hash":"h"}}}', "[1]", "nonsense", None]
    cursors, files, conflicts = IO.manifest_tables(spark.createDataFrame([(r,) for r in rows], "manifest string"))
    assert [tuple(r) for r in cursors.collect()] == [("v", "d", 0)] and files.count() == 1 and conflicts.count() == 0


def test_admission_stream_equals_one_batch_per_file(spark, tmp_path):
    schema = "vault_id string, source_path string, seq long, kind string, base_revision long, content_hash string, restore_revision long"
    source, folder = str(tmp_path / "requests"), str(tmp_path / "out")
    vaults = lambda: spark.createDataFrame([("v", 0)], "vault_id string, current_revision long")
    parts = [[("v", "a.md", 1, "PUT", 0, "h1", None), ("v", "b.md", 2, "PUT", 0, "h2", None), ("unknown", "b.md", 7, "PUT", 0, "h2", None)], [("v", "a.md", 3, "PUT", 1, "h3", None), ("v", "a.md", 4, "PUT", 1, "h4", None)], [("v", "b.md", 5, "DELETE", 2, None, None), ("v", "b.md", 6, "RESTORE", None, None, None)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        assert ST.admit_stream(spark.readStream.schema(schema).parquet(source), vaults, folder, str(tmp_path / "cp")).awaitTermination(120)
    got = {r.seq: (r.decision, r.revision, r.server_revision) for r in spark.read.parquet(f"{folder}/decisions").collect()}
    assert got == {1: ("accepted", 1, None), 2: ("accepted", 2, None), 3: ("accepted", 3, None), 4: ("conflict", None, 3), 5: ("accepted", 4, None), 6: ("accepted", 5, None)}


def test_requests_after_a_job_give_one_more_run(spark, tmp_path):
    source, out = str(tmp_path / "requests"), str(tmp_path / "jobs")
    schema = "vault_id string, source_path string, ts timestamp"
    for second, paths in ((1, ["a.md", "a.md", "b.md"]), (2, ["a.md", "a.md"]), (3, [])):
        rows = spark.createDataFrame([("v", p, f"2024-01-01 00:00:0{second}") for p in paths], "vault_id string, source_path string, ts string")
        rows.selectExpr("vault_id", "source_path", "cast(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        job = lambda jobs, n: jobs.write.mode("overwrite").parquet(f"{out}/n={n}")
        assert ST.job_stream(stream, job, str(tmp_path / "cp")).awaitTermination(120)
    ran = sorted((r.n, r.source_path, r.requests) for r in spark.read.parquet(out).collect())
    assert ran == [(0, "a.md", 2), (0, "b.md", 1), (1, "a.md", 2)]


def test_index_stream_replaces_and_drops(spark, tmp_path):
    from noteflow.operators.indexing import hashing_embedder
    from tests.test_notes import HEAD

    source, folder = str(tmp_path / "changes"), str(tmp_path / "chunks")
    schema = "vault_id string, source_path string, content string"
    files = lambda: spark.createDataFrame([("v", p, "current", "pending", True, False, "h") for p in ("a.md", "b.md")], "vault_id string, source_path string, status string, index_status string, vectorize boolean, deleted boolean, content_hash string")
    for part in ([("v", "a.md", HEAD + "one"), ("v", "b.md", HEAD + "two")], [("v", "a.md", HEAD + "three"), ("v", "b.md", None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        assert ST.index_stream(spark.readStream.schema(schema).parquet(source), files, hashing_embedder(8), 8, "m", folder, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.source_path, r.content) for r in ST.latest_snapshot(spark, folder, ST.CHUNKS).collect()] == [("a.md", "three")]


def test_sql_table_function(spark):
    from noteflow.functions.notes import register_sql
    from tests.test_notes import HEAD

    register_sql(spark)
    rows = spark.sql("SELECT c.chunk_index, c.content, c.error FROM VALUES (:note), ('x') AS t(note), LATERAL chunk_note(t.note) c", args={"note": HEAD + "body"}).collect()
    assert sorted((r.content or "", r.error or "") for r in rows) == [("", "markdown frontmatter is required"), ("body", "")]


def test_suppression_stream_equals_the_batch(spark, tmp_path):
    """Events and runs that come out of order, over several batches, with begins of runs after the events that they hold."""
    import random

    rng = random.Random(4)
    moment = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    events, runs = [], []
    for v in ("v0", "v1"):
        events += [(v, i, rng.randrange(0, 4000)) for i in range(150)]
        begin = 30
        while begin < 4000:
            runs.append((v, begin, begin + rng.randrange(5, 60)))
            begin = runs[-1][2] + rng.randrange(3, 200)
    end = 20000
    stamped = lambda rows, *c: spark.createDataFrame([(r[0], *[x if n == "event_id" else moment(x) for n, x in zip(c, r[1:])]) for r in rows], "vault_id string, " + ", ".join(f"{n} {'long' if n == 'event_id' else 'string'}" for n in c)).selectExpr("vault_id", *[n if n == "event_id" else f"cast(`{n}` AS timestamp) AS `{n}`" for n in c])
    asked = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    old = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        for upto in (900, 1900, 2900, 4100, end + 1):
            part = lambda rows, at: [r for r in rows if upto - 1000 - 100 * rng.random() <= r[at] < upto or upto > end]
            new = [e for e in events if e[2] < upto - 100 * (e[1] % 2) and e not in done] if upto != 900 else [e for e in events if e[2] < 900]
            done = (done if upto != 900 else []) + new
            new = new + ([("v0", -1, end), ("v1", -1, end)] if upto > end else [])
            rng.shuffle(new)
            stamped(new, "event_id", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            late = [r for r in runs if r[1] < upto - 50 and r not in (begun if upto != 900 else [])]
            begun = (begun if upto != 900 else []) + late
            stamped(late or runs[:0], "begin", "end").coalesce(1).write.mode("append").parquet(str(tmp_path / "runs")) if late else None
            read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
            out = ST.unsuppressed_stream(read("events", "vault_id string, event_id long, ts timestamp"), read("runs", "vault_id string, begin timestamp, end timestamp"), 1, "200 seconds")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(180)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = sorted((r.vault_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.event_id >= 0)
    batch = ST.unsuppressed(stamped(events, "event_id", "ts"), stamped(runs, "begin", "end"), 1, 600)
    want = sorted((v, i) for v, i, t in events if not any(w == v and a <= t < b + 1 for w, a, b in runs))
    assert sorted((r.vault_id, r.event_id) for r in batch.collect()) == want
    assert got == want


def _bytes(folder) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """Files of a small batch do not grow with the table; runs that repeat a batch, deletions and whole rewrites keep the rows right."""
    from noteflow.sources.state import KeyedTable

    schema = "k string, i int, x string"
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], parts=8, most=3)
    want = {f"k{i}": [(i, f"first {i}"), (i + 1, "second")] for i in range(3000)}
    rows = lambda d: spark.createDataFrame([(k, *r) for k, v in d.items() for r in v], schema)
    table.write(0, {}, rows(want))
    whole = _bytes(tmp_path / "t/data/v=0")
    for n in range(1, 12):
        change = {f"k{n}": [(n, f"changed {n}")], "k7": [(n, "hot"), (n, "hot")], f"new{n}": [(0, None)]}
        gone = spark.createDataFrame([(f"k{100 + n}",)], "k string")
        for _ in range(2 if n % 3 == 0 else 1):  # a batch that ran twice
            table.write(n, table.head(n), rows(change), gone)
        want |= change
        del want[f"k{100 + n}"]
        assert _bytes(tmp_path / f"t/data/v={n}") < whole / 8
    assert any((tmp_path / f"t/data/v={n}w").exists() for n in range(12))
    got = {}
    for r in table.rows(table.head()).collect():
        got.setdefault(r.k, []).append((r.i, r.x))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert all(len(v) <= 3 for v in table.head().values())
    some = table.rows(table.head(), [0, 3])
    assert 0 < some.select("k").distinct().count() < 1500


def test_follow_log_writes_deltas(spark, tmp_path):
    source, folder = str(tmp_path / "log"), tmp_path / "snapshot"
    big = [("v", f"n{i}.md", i, f"hash of {i}" * 9) for i in range(1, 8000)]
    for part in (big, [("v", "n3.md", 9000, "x"), ("v", "n5.md", 2, "too old")]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
        assert ST.follow_log(spark.readStream.schema(EVENT).parquet(source), str(folder), str(tmp_path / "cp")).awaitTermination(120)
    assert _bytes(folder / "data/v=1") < _bytes(folder / "data/v=0") / 20
    now = {r.source_path: r.revision for r in ST.latest_snapshot(spark, str(folder), EVENT).collect()}
    assert len(now) == 7999 and now["n3.md"] == 9000 and now["n5.md"] == 5
