from __future__ import annotations

import math

import pytest

from noteflow.operators import search as S

CHUNK = "chunk_id long, vault_id string, source_path string, title string, content string, project string, domain string, tags array<string>, status string, type string, priority string, visibility string, embedding_model string, content_hash string, embedding array<float>"
FILE = "vault_id string, source_path string, content_hash string, index_status string, deleted boolean"


def chunk(i, vector, content="text", path=None, model="m", tags=None, hash_="h"):
    return (i, "v", path or f"n{i}.md", "t", content, "p", "d", tags, "current", "rule", "low", "public", model, hash_, vector)


def search(spark, chunks, query="text", files=None, **options):
    files = files or [("v", c[2], "h", "indexed", False) for c in {x[2]: x for x in chunks}.values()]
    q = spark.createDataFrame([(1, "v", query, [1.0, 0.0])], "query_id long, vault_id string, query string, query_embedding array<float>")
    return S.hybrid_search(q, spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(files, FILE), "m", **options)


def test_ranking_by_cosine(spark):
    vectors = [(1, 0), (3, 1), (1, 1), (1, 3), (0, 1)]
    rows, _ = search(spark, [chunk(i, [float(a), float(b)]) for i, (a, b) in enumerate(vectors)], hybrid=False)
    got = [(r.chunk_id, r.score) for r in rows.orderBy("rank").collect()]
    assert [i for i, _ in got] == [0, 1, 2, 3, 4]
    assert all(abs(s - a / math.hypot(a, b)) < 1e-3 for (_, s), (a, b) in zip(got, vectors))


def test_lexical_leg_finds_what_the_vector_leg_misses(spark):
    chunks = [chunk(i, [1.0, 0.0]) for i in range(3)] + [chunk(9, [0.0, 1.0], "zebra here")]
    rows, out = search(spark, chunks, "zebra", candidates=2, min_score=0.9, top_k=5)
    got = {r.chunk_id: (r.matched_by, r.score) for r in rows.collect()}
    assert got[9] == ("lexical", 0.0) and out.first().notice == "ok"
    rows, _ = search(spark, chunks, "zebra", candidates=2, min_score=0.9, hybrid=False, per_source=2)
    assert 9 not in [r.chunk_id for r in rows.collect()]


def test_threshold_and_no_candidates(spark):
    _, out = search(spark, [chunk(1, [0.0, 1.0])], "absent", min_score=0.9)
    assert out.first().low_confidence
    _, out = search(spark, [chunk(1, None)], "absent")
    assert out.first().no_candidates


def test_stale_deleted_and_other_model_are_hidden(spark):
    chunks = [chunk(1, [1.0, 0.0]), chunk(2, [1.0, 0.0], hash_="old"), chunk(3, [1.0, 0.0]), chunk(4, [1.0, 0.0], model="x"), chunk(5, [0.0, 0.0])]
    files = [("v", f"n{i}.md", "h", "indexed", i == 3) for i in range(1, 6)]
    rows, _ = search(spark, chunks, "none", files)
    assert [r.chunk_id for r in rows.collect()] == [1]


def test_null_tags_match_no_tag_filter(spark):
    chunks = [chunk(1, [1.0, 0.0]), chunk(2, [1.0, 0.0], tags=["a"]), chunk(3, [1.0, 0.0], tags=[])]
    rows, _ = search(spark, chunks, where=S.metadata_filter(tags=["a", "b"]))
    assert [r.chunk_id for r in rows.collect()] == [2]


def test_source_cap_backfills(spark):
    chunks = [chunk(i, [1.0, i / 100], path="a.md") for i in range(4)] + [chunk(9, [0.5, 0.5], path="b.md")]
    rows, _ = search(spark, chunks, "none", per_source=2, top_k=3)
    assert [r.chunk_id for r in rows.orderBy("rank").collect()] == [0, 1, 9]


def test_rrf_ties_by_first_sight(spark):
    v = spark.createDataFrame([(1, 10, 1)], "query_id long, chunk_id long, vector_rank int")
    x = spark.createDataFrame([(1, 20, 1)], "query_id long, chunk_id long, lexical_rank int")
    assert [r.chunk_id for r in S.fused(v, x).orderBy("fused_rank").collect()] == [10, 20]


@pytest.mark.parametrize("reply", ["boom", ""])
def test_failing_rerank_keeps_the_order(spark, reply):
    def model(query, texts):
        if reply:
            raise RuntimeError(reply)
        return ""

    rows = spark.createDataFrame([(1, "q", 5, "a", 1), (1, "q", 6, "b", 2)], "query_id long, query string, chunk_id long, content string, fused_rank int")
    got = S.reranked(rows, model).orderBy("rank").collect()
    assert [(r.chunk_id, r.reranked) for r in got] == [(5, False), (6, False)]


def test_rerank_keeps_the_rows_behind_its_candidates(spark):
    rows = spark.createDataFrame([(1, "q", 500 + i, f"t{i}", i) for i in range(1, 251)], "query_id long, query string, chunk_id long, content string, fused_rank int")
    got = S.reranked(rows, lambda query, texts: "[2, 1]").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [502, 501, *range(503, 751)] and [r.rank for r in got] == list(range(1, 251))


def test_block_leg_equals_join_leg(spark):
    import random

    rng = random.Random(1)
    chunks = spark.createDataFrame([chunk(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(200)] + [chunk(900, None), chunk(901, [0.0, 0.0])], CHUNK).repartition(5)
    q = spark.createDataFrame([(i, "v", "x", [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(4)], "query_id long, vault_id string, query string, query_embedding array<float>")
    key = lambda rows: sorted((r.query_id, r.vector_rank, r.chunk_id) for r in rows.collect())
    assert key(S.vector_leg(q, chunks, 7)) == key(S.block_vector_leg(q, chunks, 7))


def test_evaluation_counts_duplicates(spark):
    g = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"])], "query_id long, expected_sources array<string>")
    r = spark.createDataFrame([(1, 2, "a"), (1, 1, "x")], "query_id long, rank int, source_path string")
    got = {x.query_id: (x.recall, x.reciprocal_rank) for x in S.evaluate(g, r).collect()}
    assert got == {1: (0.6667, 0.5), 2: (0.0, 0.0)}


def test_query_syntax(spark):
    texts = ["red fox runs", "fox is red", "the hound", "red fox and hound", "well-known fox", "x"]
    chunks = [chunk(i, [0.0, 1.0], c) for i, c in enumerate(texts)]
    wanted = {'"red fox"': [0, 3], "red fox": [0, 1, 3], "fox or hound": [0, 1, 2, 3, 4], "fox -hound": [0, 1, 4], '-"red fox" fox': [1, 4], '"is red" or hound': [1, 2, 3], "-fox": [2, 5], "well-known": [4], '"known fox"': [4], "": [], "fox or -red": [0, 1, 2, 3, 4, 5]}
    q = spark.createDataFrame([(i, "v", text, None) for i, text in enumerate(wanted)], "query_id long, vault_id string, query string, query_embedding array<float>")
    found = {i: set() for i in range(len(wanted))}
    for r in S.lexical_leg(q, spark.createDataFrame(chunks, CHUNK)).collect():
        found[r.query_id].add(r.chunk_id)
    assert [sorted(found[i]) for i in range(len(wanted))] == list(wanted.values())


@pytest.mark.parametrize("tiles", [(4, 3), (16384, 1024)])
def test_tiles_equal_the_join(spark, tiles, monkeypatch):
    """Tiles of any size give what the pair join gives, with ties, other widths, zero vectors and vaults of their own."""
    monkeypatch.setattr(S, "TILE_CHUNKS", tiles[0])
    monkeypatch.setattr(S, "TILE_QUERIES", tiles[1])
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.6, 0.8], [0.0, 0.0], [1.0, 0.0, 0.0], None, [-1.0, 0.5], [2.0, 0.0]]
    chunks = [(i, f"v{i % 3}", *chunk(i, vectors[i % 8])[2:]) for i in range(60)]
    q = [(i, f"v{i % 4}", "x", [[1.0, 0.2], [0.0, 1.0], [0.0, 0.0], [1.0, 1.0, 1.0]][i % 4 if i < 8 else 0]) for i in range(20)]
    asked = spark.createDataFrame(q, "query_id long, vault_id string, query string, query_embedding array<float>")
    pool = spark.createDataFrame(chunks, CHUNK)
    rows = lambda frame: sorted((r.query_id, r.vector_rank, r.chunk_id, round(r.score, 9)) for r in frame.collect())
    got, want = rows(S.block_vector_leg(asked, pool, 7)), rows(S.vector_leg(asked, pool, 7))
    assert len(got) == len(want) and [x[:2] for x in got] == [x[:2] for x in want] and [x[3] for x in got] == [x[3] for x in want]


def test_rejected_queries_and_notices(spark):
    chunks = [chunk(1, [1.0, 0.0]), chunk(2, [1.0, 0.0], model="old"), chunk(3, [1.0, 0.0])]
    files = [("v", "n1.md", "h", "indexed", False, True), ("v", "n2.md", "h", "indexed", False, True), ("v", "n3.md", "h", "failed", False, True)]
    asked = [(1, "v", "text", [1.0, 0.0], None, None, None), (2, "v", " ", [1.0, 0.0], None, None, None), (3, "gone", "text", [1.0, 0.0], None, None, None), (4, "v", "text", [1.0, 0.0], None, None, ["song"]), (5, "v", "zzz", None, None, None, None)]
    q = spark.createDataFrame(asked, "query_id long, vault_id string, query string, query_embedding array<float>, top_k int, min_score double, f_type array<string>")
    vaults = spark.createDataFrame([("v", True), ("gone", False)], "vault_id string, is_active boolean")
    from pyspark.sql import functions as F

    out = S.answer_queries(q, spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(files, FILE + ", vectorize boolean"), vaults, "m", F.lit("2024-01-01").cast("timestamp"))
    rows = {r.query_id: r for r in out["outcomes"].collect()}
    assert [r.chunk_id for r in out["results"].collect()] == [1]
    assert {i: r.error for i, r in rows.items()} == {1: None, 2: "query is required", 3: "vault not found", 4: "filter type has an unsupported value", 5: None}
    assert (rows[1].failed, rows[1].model_stale, rows[1].reindex_mode, len(rows[1].notices)) == (1, 1, "full", 2)
    assert rows[5].no_candidates and len(rows[5].notices) == 2 and rows[3].candidate_count is None
    assert sorted(r.request_id for r in out["log"].collect()) == ["1", "5"]


@pytest.mark.parametrize("name", ["tk01_vector_leg", "wn04_source_cap", "wn02_leg_ranks", "ud04_rerank", "fn18_cosine", "tk02_query_syntax"])
def test_no_table_of_all_pairs(spark, name):
    """Queries meet chunks in tiles (co-groups), never in a join on the vault that makes a row of each pair."""
    from noteflow.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_equal_scores_are_ties(spark):
    """Copies of a vector, scaled or not, have one score of at most 1 in every place of a tile, so the smaller chunk_id comes first."""
    import random

    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(3)]
    chunks = spark.createDataFrame([chunk(i, [x * 2.0 ** (i % 5) for x in base[i % 3]]) for i in range(301)], CHUNK)
    q = spark.createDataFrame([(i, "v", "x", base[i]) for i in range(3)], "query_id long, vault_id string, query string, query_embedding array<float>")
    for leg in (S.vector_leg, S.block_vector_leg):
        rows = leg(q, chunks, 60).collect()
        assert len(rows) == 180 and max(r.score for r in rows) <= 1.0
        assert all(sorted(r.chunk_id for r in rows if r.query_id == i) == list(range(i, 180, 3)) for i in range(3))


@pytest.mark.parametrize("name", ["jb02_many_queries", "jb02_answers", "so01_union_of_legs", "ag10_evidence", "io10_search_log", "ag08_fusion", "pr12_threshold"])
def test_both_legs_go_by_tiles(spark, name, monkeypatch):
    """Neither leg of a search writes or shuffles a row for each query and chunk."""
    from noteflow.plans import QUERIES

    seen, real = [], S._tiled
    monkeypatch.setattr(S, "_tiled", lambda *a: seen.append(a[3].split()[4]) or real(*a))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(seen) == ["rank_value", "score"]


@pytest.mark.parametrize("sizes", [(4, 1000, 3), (1000, 60, 2)])
def test_keyword_tiles_of_any_size(spark, sizes, monkeypatch):
    """Small tiles give what one gives: phrases end with their chunk, ties go to the smaller chunk_id, counts of words add up."""
    texts = ["red fox", "fox red", "red", "fox runs", "red red fox", "", "well-known fox", "the red fox and the red fox"]
    chunks = spark.createDataFrame([chunk(i, [0.0, 1.0], texts[i % 8], tags=["x"] if i % 3 else None) for i in range(48)], CHUNK)
    asks = ['"red fox"', "red fox", "fox or runs", "-fox", '-"red fox" red', '"fox red"', "known -red", "absent", '"well-known fox"']
    q = spark.createDataFrame([(i, "v", text, ["x"] if i % 2 else []) for i, text in enumerate(asks)], "query_id long, vault_id string, query string, f_tags array<string>")
    rows = lambda: sorted(map(tuple, S.lexical_leg(S.effective_filters(q), chunks, 7).select("query_id", "lexical_rank", "chunk_id", "rank_value").collect()))
    wanted = rows()
    for name, size in zip(("LEXICAL_CHUNKS", "LEXICAL_CHARS", "LEXICAL_QUERIES"), sizes):
        monkeypatch.setattr(S, name, size)
    assert rows() == wanted
    assert [r[2:] for r in wanted if r[0] == 0] == [(i, 1.25) for i in range(7, 48, 8)] + [(4, 1.125)]
    assert [r[2] for r in wanted if r[0] == 5] == [i for i in range(48) if i % 8 == 1 and i % 3] and not [r for r in wanted if r[0] == 7]
