from __future__ import annotations

import random

from noteflow.operators import revisions as V

REQUEST = "vault_id string, source_path string, seq long, kind string, base_revision long, content_hash string, restore_revision long"
FILE = "vault_id string, source_path string, revision long, content_hash string, deleted boolean, index_status string"
VERSION = "vault_id string, source_path string, revision long, content_hash string"


def replay(requests, files, versions, counters):
    """One request after the other, as a single server would."""
    state = {(v, p): [r, h, d] for v, p, r, h, d, _ in files}
    held = {}
    for v, p, r, h in versions:
        held.setdefault((v, p), {})[r] = h
    counters, out = dict(counters), {}
    for v, p, seq, kind, base, h, restore in sorted(requests, key=lambda r: r[2]):
        at = state.get((v, p))
        live = at is not None and not at[2]
        base = base or 0
        event, server, decision, content = None, None, "accepted", h
        if kind == "PUT":
            if not live and base == 0:
                event = "CREATE"
            elif not live or base != at[0]:
                decision, server = "conflict", at[0] if at else 0
            elif at[1] == h:
                decision = "replay"
            else:
                event = "UPDATE"
        elif kind == "FORCE":
            if live and at[1] == h:
                decision = "noop"
            else:
                event = "UPDATE" if live else "CREATE"
        elif kind == "DELETE":
            if not live:
                decision = "not_found"
            elif base != at[0]:
                decision, server = "conflict", at[0]
            else:
                event, content = "DELETE", at[1]
        elif live:
            decision = "rejected"
        else:
            known = held.get((v, p), {})
            r = max(known, default=None) if restore is None else restore if restore in known else None
            if at is None or r is None:
                decision = "not_found"
            else:
                event, content = "RESTORE", known[r]
        revision = None
        if event:
            revision = counters[v] = counters[v] + 1
            state[v, p] = [revision, content, event == "DELETE"]
            if event != "DELETE":
                held.setdefault((v, p), {})[revision] = content
        out[v, seq] = (decision, event, revision, server)
    return out


def test_admission_equals_sequential_replay(spark):
    rng = random.Random(5)
    for _ in range(3):
        counters = {"a": 40, "b": 7}
        files, versions = [], []
        for v, top in counters.items():
            for i in range(6):
                r = rng.randint(1, top)
                files.append((v, f"n{i}.md", r, f"h{rng.randint(0, 2)}", rng.random() < 0.3, "indexed"))
                versions += [(v, f"n{i}.md", k, f"h{rng.randint(0, 2)}") for k in {r, max(1, r - 3)}]
        at = {(f[0], f[1]): f[2] for f in files}
        requests = []
        for seq in range(1, 300):
            v, i = rng.choice("ab"), rng.randint(0, 8)
            base = rng.choice([0, 0, at.get((v, f"n{i}.md"), 0), rng.randint(0, counters[v])])
            requests.append((v, f"n{i}.md", seq, rng.choice(["PUT", "PUT", "PUT", "FORCE", "DELETE", "RESTORE"]), base, f"h{rng.randint(0, 2)}", rng.choice([None, None, rng.randint(1, 7)])))
        got = V.admit_writes(
            spark.createDataFrame(requests, REQUEST), spark.createDataFrame(files, FILE), spark.createDataFrame(versions, VERSION),
            spark.createDataFrame(list(counters.items()), "vault_id string, current_revision long"),
        )
        got = {(r.vault_id, r.seq): (r.decision, r.event_type, r.revision, r.server_revision) for r in got.collect()}
        assert got == replay(requests, files, versions, counters)


def test_one_winner_of_eight(spark):
    requests = [("a", "n.md", i, "PUT", 3, f"h{i}", None) for i in range(1, 9)]
    got = V.admit_writes(
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame([("a", "n.md", 3, "x", False, "indexed")], FILE), spark.createDataFrame([], VERSION),
        spark.createDataFrame([("a", 3)], "vault_id string, current_revision long"),
    ).collect()
    assert sorted(r.decision for r in got) == ["accepted"] + ["conflict"] * 7
    assert {r.server_revision for r in got if r.decision == "conflict"} == {4}


def test_empty_requests(spark):
    empty = V.admit_writes(spark.createDataFrame([], REQUEST), spark.createDataFrame([], FILE), spark.createDataFrame([], VERSION), spark.createDataFrame([], "vault_id string, current_revision long"))
    assert empty.count() == 0


def test_a_dominant_path_is_folded_in_batches(spark, monkeypatch):
    """Most requests and many versions on one path: no list of versions, no group in memory, and state goes on from batch to batch."""
    plans, keep = [], V.written
    monkeypatch.setattr(V, "written", lambda s, frame, *a: plans.append(frame._jdf.queryExecution().toString()) or keep(s, frame, *a))
    rng = random.Random(7)
    files = [("a", "hot.md", 400, "h1", True, "indexed"), ("a", "cold.md", 7, "h2", False, "indexed")]
    versions = [("a", "hot.md", k, f"h{k % 5}") for k in range(1, 400)] + [("a", "cold.md", 7, "h2")]
    requests = []
    for seq in range(1, 400):
        kind = rng.choice(["PUT", "FORCE", "DELETE", "DELETE", "RESTORE", "RESTORE"])
        requests.append(("a", "cold.md" if seq % 9 == 0 else "hot.md", seq, kind, rng.choice([0, 7, 400]), f"h{rng.randint(0, 4)}", rng.choice([None, rng.randint(1, 450)])))
    # a request may only name revisions that were issued before the batch
    requests = [(*r[:6], r[6] if r[6] is None or r[6] <= 400 else 400) for r in requests]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 7)
    try:
        got = V.admit_writes(
            spark.createDataFrame(requests, REQUEST), spark.createDataFrame(files, FILE), spark.createDataFrame(versions, VERSION),
            spark.createDataFrame([("a", 400)], "vault_id string, current_revision long"),
        ).collect()
    finally:
        spark.conf.unset(batch)
    got = {(r.vault_id, r.seq): (r.decision, r.event_type, r.revision, r.server_revision) for r in got}
    assert got == replay(requests, files, versions, {"a": 400})
    assert {"accepted", "rejected", "not_found"} <= {x[0] for x in got.values()}
    assert plans and not any("FlatMapGroups" in p or "collect_list" in p for p in plans)


def test_whole_admission(spark):
    """Bad requests change nothing; only markdown has versions to restore; later writes settle conflicts."""
    schema = "vault_id string, source_path string, seq long, kind string, base_revision long, content_hash string, restore_revision long, n_bytes long, device_id string, origin string"
    rows = [
        ("v", " a.md", 1, "PUT", 0, "h1", None, 5, "d1", "mcp"), ("v", "b.png", 2, "PUT", 0, "h2", None, 5, "d1", None), ("v", "../a.md", 3, "PUT", 0, "h3", None, 5, "d1", None), ("gone", "a.md", 4, "PUT", 0, "h3", None, 5, "d1", None),
        ("v", "a.md", 5, "PUT", 0, "h5", None, 5, "d2", None), ("v", "a.exe", 6, "PUT", 0, "h5", None, 5, "d2", None), ("v", "a.md", 7, "FORCE", None, "h7", None, 5, "d2", "mcp"), ("v", "a.md", 8, "PUT", 1, "h8", None, 5, "d1", None),
        ("v", "c.png", 9, "FORCE", None, "h9", None, 99_000_000, "d1", None), ("w", "a.md", 1, "DELETE", 4, None, None, None, "d1", "mcp"), ("w", "a.md", 2, "RESTORE", None, None, None, None, "d1", "mcp"), ("w", "b.png", 3, "DELETE", 3, None, None, None, "d1", None), ("w", "b.png", 4, "RESTORE", None, None, None, None, "d1", None),
    ]
    files = spark.createDataFrame([("w", "a.md", 4, "x4", False, "indexed"), ("w", "b.png", 3, "x3", False, "skipped")], "vault_id string, source_path string, revision long, content_hash string, deleted boolean, index_status string")
    versions = spark.createDataFrame([("w", "a.md", 4, "x4")], "vault_id string, source_path string, revision long, content_hash string")
    vaults = spark.createDataFrame([("v", 0), ("w", 4)], "vault_id string, current_revision long")
    out = V.admission(spark.createDataFrame(rows, schema), files, versions, vaults)
    got = {(r.vault_id, r.seq): (r.decision, r.error, r.revision, r.server_revision) for r in out["decisions"].collect()}
    assert got == {
        ("v", 1): ("accepted", None, 1, None), ("v", 2): ("accepted", None, 2, None), ("v", 3): ("invalid", "source path cannot contain empty or traversal parts", None, None), ("gone", 4): ("invalid", "vault not found", None, None),
        ("v", 5): ("conflict", None, None, 1), ("v", 6): ("invalid", got["v", 6][1], None, None), ("v", 7): ("accepted", None, 3, None), ("v", 8): ("conflict", None, None, 3), ("v", 9): ("invalid", "file exceeds size limit", None, None),
        ("w", 1): ("accepted", None, 5, None), ("w", 2): ("accepted", None, 6, None), ("w", 3): ("accepted", None, 7, None), ("w", 4): ("not_found", None, None, None),
    }
    assert "extension" in got["v", 6][1]
    assert sorted((r.source_path, r.seq, r.status, r.client_base_revision) for r in out["conflicts"].collect()) == [("a.md", 5, "RESOLVED", 0), ("a.md", 8, "OPEN", 1)]
    assert sorted((r.vault_id, r.revision, r.event_type, r.origin) for r in out["events"].collect()) == [("v", 1, "CREATE", "mcp"), ("v", 2, "CREATE", None), ("v", 3, "UPDATE", "mcp"), ("w", 5, "DELETE", None), ("w", 6, "RESTORE", None), ("w", 7, "DELETE", None)]
    assert sorted((r.vault_id, r.revision, r.content_hash) for r in out["versions"].collect()) == [("v", 1, "h1"), ("v", 3, "h7"), ("w", 6, "x4")]
    assert sorted((r.vault_id, r.source_path, r.deleted) for r in out["files"].collect()) == [("v", "a.md", False), ("v", "b.png", False), ("w", "a.md", False), ("w", "b.png", True)]


def test_change_feed_is_exact_and_bounded(spark):
    """Missing revisions, cursors beyond both ends, vaults without devices and one large vault: pages as by definition, slices no more than pages need."""
    rng = random.Random(3)
    logs = {"big": sorted(rng.sample(range(1, 40_000), 9000)), "thin": sorted(rng.sample(range(1, 3_000_000), 300)), "dense": list(range(1, 2001)), "idle": [1, 2], "one": [77]}
    events = spark.createDataFrame([(v, r, f"n{r % 9}.md") for v, log in logs.items() for r in log], "vault_id string, revision long, source_path string")
    cursors = [(v, f"{v}{i}", c) for v, log in logs.items() if v != "idle" for i, c in enumerate([0, log[-1], log[0], log[len(log) // 2], log[-1] + 5000, log[len(log) // 3] + 1])] + [("none", "x", 0), ("big", "null", None)]
    devices = spark.createDataFrame(cursors, "vault_id string, device_id string, cursor long")
    for limit in (3, 200, 1000):
        got = {}
        for r in V.change_feed(events, devices, limit).collect():
            got.setdefault((r.vault_id, r.to_device), []).append(r.revision)
        want = {(v, d): page for v, d, c in cursors if c is not None and (page := [r for r in logs.get(v, []) if r > c][:limit])}
        assert {k: sorted(v) for k, v in got.items()} == want
        marks = devices.where("cursor IS NOT NULL").withColumnRenamed("device_id", "to_device")
        reach = V.feed_reach(marks.select("vault_id", "to_device", "cursor"), V.feed_slices(events), limit)
        slices = V.feed_slices(events).select("vault_id", "rank", "slice")
        met = reach.join(slices, ["vault_id", "rank"]).join(events.selectExpr("vault_id AS vault_id", f"floor(revision / {V.FEED_SLICE}) AS slice"), ["vault_id", "slice"])
        assert max(r["count"] for r in met.groupBy("to_device").count().collect()) <= limit + 2 * V.FEED_SLICE
