from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noteflow.functions import rules as R
from noteflow.functions import text as T

PATHS = [
    ("notes/a.md", None), (" notes/a.md", None), ("", "required"), ("   ", "required"), ("a\0b.md", "NUL"), ("a\\b.md", "forward"), ("/a.md", "relative"), ("a//b.md", "traversal"),
    ("a/../b.md", "traversal"), ("a./b.md", "dot or space"), ("a.md ", "dot or space"), ("é" * 126 + ".md", None), ("é" * 127 + ".md", "255"), ("a/con.txt", "reserved"),
    ("COM10.md", None), ("lpt9", "reserved"), ("c:/a.md", "drive"), ("a/c:b.md", None), (None, "required"),
]


@pytest.mark.parametrize("raw, error", PATHS)
def test_checked_path(spark, raw, error):
    row = spark.createDataFrame([(raw,)], "p string").select(R.checked_path(F.col("p")).alias("c")).first().c
    assert (row.error is None) == (error is None)
    if error:
        assert error in row.error and row.path is None
    else:
        assert row.path == raw.strip()


def test_file_rules(spark):
    rows = [
        ("a/b.md", True, False, True), ("b.MD", False, False, False), ("x/.editor/a.md", False, False, False), (".trash/a.md", False, False, False), ("a.conflict.dev.1.md", False, True, False),
        ("i.sync-conflict-2.png", False, True, False), (".DS_Store", False, False, False), ("a/.b/c.md", True, False, False), ("p.JPG", False, False, True), ("p.exe", False, False, False),
    ]
    d = spark.createDataFrame([(r[0],) for r in rows], "p string")
    got = d.select(R.is_vectorizable(F.col("p")), R.is_conflict_file(F.col("p")), R.should_sync(F.col("p"), True)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_folders_of_another_editor(spark, monkeypatch):
    monkeypatch.setattr(R, "IGNORED_SEGMENTS", [*R.IGNORED_SEGMENTS, ".other"])
    d = spark.createDataFrame([("x/.other/a.md",), ("x/.trash/a.md",), ("x/a.md",)], "p string")
    assert [r.v for r in d.select(R.is_vectorizable(F.col("p")).alias("v")).collect()] == [False, False, True]


def test_policy_of_bare_dot_name(spark):
    d = spark.createDataFrame([(".env",), ("a.env",), ("a.Png",)], "p string").select(R.file_policy(F.col("p")).alias("c"))
    assert [(r.c.error or r.c.kind) for r in d.collect()] == ["file extension is not allowed", "file extension is explicitly excluded", "image"]


def test_strict_base64(spark):
    d = spark.createDataFrame([("image", "QUJD"), ("image", "QUI"), ("image", "!!!!"), ("markdown", "é")], "k string, s string")
    got = d.select(R.decoded_content(F.col("k"), F.col("s")).alias("d")).collect()
    assert [(r.d.error is None, bytes(r.d.content) if r.d.content is not None else None) for r in got] == [(True, b"ABC"), (False, None), (False, None), (True, "é".encode())]


@pytest.mark.parametrize("reply, order", [("[2,1,3]", [2, 1, 3]), ("```\n[3]\n```", [3, 1, 2]), ("[9,0,-1,2,2]", [2, 1, 3]), ("none", [1, 2, 3]), ("[true, 3]", [3, 1, 2]), ("[1, 2", [1, 2, 3]), ('["2", 2.5, 3]', [3, 1, 2])])
def test_rerank_order(spark, reply, order):
    assert spark.createDataFrame([(reply,)], "r string").select(T.rerank_order(F.col("r"), F.lit(3)).alias("o")).first().o == order


def test_query_terms(spark):
    d = spark.createDataFrame([("Foo-Bar  -baz qux",)], "q string").select(T.query_terms(F.col("q")).alias("t")).first().t
    assert d.must == ["foo-bar", "qux"] and d.must_not == ["baz"]


@pytest.mark.parametrize(
    "query, tree",
    [
        ("red fox", "red fox"), ('"red fox"', "red_fox"), ("fox OR hound", "fox | hound"), ("a -b", "a -b"), ("a - b", "a -b"), ("--a", "a"), ("or a", "or a"), ("a or", "a or"), ("a or or b", "a | or b"),
        ('"x y" -"p q" or Foo-Bar baz', "x_y -p_q | foo-bar_foo_bar baz"), ("a|b", "a b"), ("", ""), (None, ""), ("-a", "-a"), ('"open phrase here', "open_phrase_here"), ('a"b c"d', "a b_c d"), ("-or x", "-or x"), ("?? a or -- ..", "a"),
    ],
)
def test_query_tree(spark, query, tree):
    got = spark.createDataFrame([(query,)], "q string").select(T.query_tree(F.col("q")).alias("t")).first().t
    assert " | ".join(" ".join("-" * x.barred + "_".join(x.phrase) for x in group) for group in got) == tree


def test_whole_columns(spark, tmp_path):
    """Words after any prefix count: slugs, note paths and query terms of whole texts."""
    from noteflow.plans import QUERIES

    late = "!" * 130 + "Late Title"
    spark.createDataFrame([(1, late)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turn = " ".join(f"w{i}" for i in range(100)) + " -gone"
    spark.createDataFrame([(1, 0, "user", turn)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    first = lambda name: QUERIES[name](spark, str(tmp_path)).first()
    assert first("fn07_slug").slug == "late-title"
    assert first("io09_whole_note_path").path == "Agent Notes/2024-02-01-late-title.md"
    r = first("fn16_whole_query_terms")
    assert r.must == [f"w{i}" for i in range(100)] and r.must_not == ["gone", "user"]


def test_embedding_input_without_tags(spark):
    d = spark.createDataFrame([("t", ["a"], None, " c "), ("t", ["a"], ["x", "y"], "c")], "t string, h array<string>, g array<string>, c string")
    got = d.select(T.embedding_input(*[F.col("t")] * 4, F.col("h"), F.col("g"), F.col("c")).alias("i")).collect()
    assert [r.i for r in got] == [f"Title: t\nType: t\nProject: t\nDomain: t\nHeading: a\nTags: {g}\n\nContent:\nc" for g in ("", "x, y")]


def test_vector_codec_rounds_halves_as_its_sql(spark, tmp_path):
    """A component times 1000 that is a half in single precision (319.5) is rounded up in SQL."""
    import duckdb

    from noteflow.plans import QUERIES, oracles

    rows = [(1, [0.31949999928474426, -0.13349999487400055, 0.19249999523162842]), (2, [0.0005, -0.0005, 0.25])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["io03_vector_codec"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(oracles()["io03_vector_codec"]).fetchall())
    assert got[0][2] == "[320,-134,193]"
