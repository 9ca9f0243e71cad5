"""Merkle dataset manifest by sibling-shift self-joins.

Every row of a dataset is a leaf (digest of its fields). The leaves of a
partition (here: of a language) form one tree, and the roots of those trees
another, whose root stands for the whole dataset:

1. Leaves get their places by one range sort; places inside a tree come from
   counts per range, so no tree, however large, meets in one task.
2. Every level joins the nodes of slot zero with the nodes at the computed
   places of their siblings (place XOR 1 in a binary tree, place plus offset
   otherwise). A joined row holds a whole run of siblings and emits the parent.
3. Proofs go down the same written rows: a run that knows the siblings above it
   gives each of its nodes those of the others in front, in one chain of joins.
4. A proof folds with the digest of a row as it is now; if what comes out is not
   the root, the row was tampered with.

Digests travel as 32 bytes and are concatenated as lower-case hex. Ties of the
order are broken by digest; fully repeated rows are interchangeable leaves, and
are split over tasks. A null field is ``-``, a null partition comes first, a null
key before other keys; a null key is never tampered with, and neither is a null
field. Texts of any length are hashed whole; empty ones are ``0:``. A dataset of
one row is its own root; an empty one has no rows. Other columns are not read,
and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from noteflow.llm.store import new_folder, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
FAN = 2
#: Places are numbered inside ranges in the low bits of Spark's increasing ids.
ROW_BITS = 33
ONLY = "all"
#: Levels that proofs go down in one job.
STEP = 3


def field(value: Column) -> Column:
    """``-`` for null, otherwise the UTF-8 bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaves(docs: DataFrame, key: str = "doc_id", part: str = "lang", fields: tuple[str, ...] = FIELDS, changed: str = "n_chars") -> DataFrame:
    """Slim rows: key, tree, leaf, and ``now``: the digest of the row as it is now.

    Rows whose key's checksum is divisible by 7 are tampered with: ``changed``
    is one more (null stays null; the largest long has no successor, it becomes null).
    """
    values = {f: F.col(f) for f in fields}
    one_more = digest(*[field(F.try_add(v, F.lit(1).cast("long")) if f == changed else v) for f, v in values.items()])
    leaf = digest(*[field(v) for v in values.values()])
    hit = (F.crc32(F.col(key).cast("string")) % 7 == 0) & F.col(changed).isNotNull()
    tree = F.coalesce(F.concat(F.lit("s"), F.col(part).cast("string")), F.lit("n"))  # null sorts first, and is equal to itself
    return docs.select(F.col(key).alias("key"), tree.alias("tree"), leaf.alias("leaf"), F.when(hit, one_more).alias("now"))


def placed(spark: SparkSession, nodes: DataFrame, *order: Column) -> DataFrame:
    """``nodes`` (tree, ...) with ``idx``, the place inside the tree by ``order``, and ``size``, the tree's nodes."""
    tie = F.xxhash64(F.monotonically_increasing_id())
    ranged = nodes.withColumn("tie", tie).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    rows = written(spark, ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()), "placed")
    chunk, row = F.shiftright("at", ROW_BITS), F.col("at").bitwiseAND((1 << ROW_BITS) - 1)
    rows = rows.withColumn("chunk", chunk).withColumn("row", row)
    counts = rows.groupBy("tree", "chunk").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("n").over(tree.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "chunk", (ahead - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return rows.join(counts, ["tree", "chunk"]).withColumn("idx", F.col("row") + F.col("shift")).drop("chunk", "row", "shift", "at")


def runs_of_siblings(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """One level: tree, idx of the parent, size of the parent's level, kids (digests of a run in order); trees of one node rest."""
    active = nodes.where("size > 1")
    slot = F.col("idx") % fan
    runs, more = active.where(slot == 0).select("tree", "idx", "size", "digest"), []
    for offset in range(1, fan):
        zero = F.col("idx").bitwiseXOR(1) if fan == 2 else F.col("idx") - offset
        shifted = active.where(slot == offset).select("tree", zero.alias("idx"), F.col("digest").alias(f"kid{offset}"))
        runs = runs.join(shifted.hint("shuffle_hash"), ["tree", "idx"], "left")
        more.append(f"kid{offset}")
    return runs.select("tree", F.floor(F.col("idx") / fan).alias("idx"), F.ceil(F.col("size") / fan).alias("size"), F.array_compact(F.array("digest", *more)).alias("kids"))


def parents(runs: DataFrame, *more: str) -> DataFrame:
    """The nodes of the next level: tree, idx, size, digest."""
    return runs.select("tree", "idx", "size", *more, digest(F.array_join(F.transform("kids", hexed), "")).alias("digest"))


def built(spark: SparkSession, nodes: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """Levels of sibling runs, lowest first, and the roots: tree, digest, depth. The levels are parts of one written table."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    roots = nodes.where("size = 1").select("tree", "digest", F.lit(0).alias("depth"))
    levels: list[DataFrame] = []
    folder = new_folder(spark, "levels")
    while most > 1:
        runs, path = runs_of_siblings(nodes, fan), f"{folder}/level={len(levels)}"
        runs.write.parquet(path)
        levels.append(spark.read.schema(runs.schema).parquet(path))
        nodes, most = parents(levels[-1]), -(-most // fan)
    if levels:
        every = spark.read.schema(StructType([*levels[0].schema.fields, StructField("level", IntegerType())])).parquet(folder).where("size = 1")
        roots = roots.unionByName(parents(every.withColumn("level", F.col("level") + 1), "level").select("tree", "digest", F.col("level").alias("depth")))
    return levels, roots


def paths(spark: SparkSession, levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame | None:
    """The lowest sibling runs, each with the siblings above it: tree, idx, kids, path, carried columns of ``tops``.

    ``tops``: tree, depth, path (what follows the root's own proof), and columns
    that go along. Trees of one node have no run; None where no tree has one.
    """
    runs = None
    for level in reversed(range(len(levels))):
        here = tops.where(F.col("depth") == level + 1).withColumn("idx", F.lit(0).cast("long"))
        if runs is not None:
            kid = runs.select("*", F.posexplode("kids").alias("slot", "kid"))
            kid = kid.withColumn("path", F.concat(siblings("kids", F.col("slot")), "path")).withColumn("idx", F.col("idx") * fan + F.col("slot"))
            here = kid.drop("kids", "slot", "kid").unionByName(here)
        runs = levels[level].select("tree", "idx", "kids").join(here, ["tree", "idx"])
        if level and level % STEP == 0:
            runs = written(spark, runs, "paths")
    return runs


def siblings(kids: str, slot: Column) -> Column:
    """The digests of a run but for that of a slot, one after the other."""
    return F.aggregate(F.filter(kids, lambda x, i: i != slot), F.unhex(F.lit("")), lambda sofar, x: F.concat(sofar, x))


def proofs(spark: SparkSession, nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """``nodes`` (tree, idx, size, ...) with ``path``, all siblings up to the root and what ``tops`` has above it, and columns of ``tops``."""
    alone = nodes.where("size = 1").join(tops, "tree")
    runs = paths(spark, levels, tops, fan)
    if runs is None:
        return alone
    parent = nodes.where("size > 1").withColumn("parent", F.floor(F.col("idx") / fan))
    inside = parent.join(runs.withColumnRenamed("idx", "parent"), ["tree", "parent"])
    return inside.withColumn("path", F.concat(siblings("kids", F.col("idx") % fan), "path")).drop("parent", "kids").unionByName(alone)


def folded(leaf: Column, path: Column, idx: Column, size: Column, depth: Column, fan: int = FAN) -> Column:
    """Struct (digest as hex, used: bytes of the path read): ``leaf`` (hex) with its siblings up to the root of a tree of ``size`` leaves."""
    start = F.struct(leaf.alias("digest"), F.lit(0).alias("used"), idx.alias("idx"), size.alias("size"))

    def step(state: Column, _: Column) -> Column:
        at, slot = state["used"], (state["idx"] % fan).cast("int")
        others = F.least(F.lit(fan).cast("long"), state["size"] - state["idx"] + slot).cast("int") - 1
        near = hexed(F.substring(path, at + 1, others * 32))
        whole = F.concat(F.substring(near, F.lit(1), slot * 64), state["digest"], F.substring(near, slot * 64 + 1, (others - slot) * 64))
        return F.struct(F.sha2(whole, 256).alias("digest"), (at + others * 32).alias("used"), F.floor(state["idx"] / fan).alias("idx"), F.ceil(state["size"] / fan).alias("size"))

    return F.aggregate(F.array_repeat(F.lit(0), depth), start, step)


def manifest(spark: SparkSession, docs: DataFrame, key: str = "doc_id", part: str = "lang", fields: tuple[str, ...] = FIELDS, changed: str = "n_chars", fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: the key, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself.

    ``proof`` holds the siblings' digests level by level, from the leaf's to the
    subroot's and on to the root's, each run's from left to right, 32 bytes each.
    """
    rows = written(spark, leaves(docs, key, part, fields, changed), "leaves")
    rows = placed(spark, rows, F.asc_nulls_first("key"), F.asc("leaf"))
    levels, roots = built(spark, rows.select("tree", "idx", "size", F.col("leaf").alias("digest")), fan)
    subroots = written(spark, placed(spark, roots.select(F.lit(ONLY).alias("tree"), F.col("tree").alias("of"), "digest", "depth"), F.asc("of")), "subroots")
    top_levels, top = built(spark, subroots.select("tree", "idx", "size", "digest"), fan)
    whole = top.first()
    root, top_depth = (hexed(F.lit(bytes(whole["digest"]))), whole["depth"]) if whole else (F.lit(""), 0)
    above = spark.range(1).select(F.lit(ONLY).alias("tree"), F.lit(top_depth).alias("depth"), F.unhex(F.lit("")).alias("path"))
    tops = proofs(spark, subroots.withColumnRenamed("depth", "own"), top_levels, above, fan)
    tops = written(spark, tops.select(F.col("of").alias("tree"), F.col("own").alias("depth"), "path", F.col("digest").alias("subroot"), F.col("idx").alias("place"), F.col("size").alias("trees")), "tops")
    found = proofs(spark, rows, levels, tops, fan)
    now = hexed(F.coalesce("now", "leaf"))
    inside = folded(now, F.col("path"), F.col("idx"), F.col("size"), F.col("depth"), fan)
    found = found.withColumn("inside", inside)
    rest = F.substring(F.col("path"), F.col("inside.used") + 1, F.octet_length("path"))
    found = found.withColumn("up", folded(F.col("inside.digest"), rest, F.col("place"), F.col("trees"), F.lit(top_depth), fan)["digest"])
    return found.select(
        F.col("key").alias(key), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(hexed(F.col("path")), 256).alias("proof_sha256"), F.col("up").alias("folded_root"), (F.col("up") == root).alias("verified"), F.col("path").alias("proof"),
    )
