"""Embedding near-duplicates by NN-descent.

Equal vectors form one class, and the classes are the nodes of a graph in which
every node lists its nearest nodes so far:

1. The graph begins with lists from sorted random projections: nodes are sorted
   by the signs of random hyperplanes, several times, and compared with their
   neighbours in blocks.
2. Every round joins neighbours of neighbours: the nodes that a node lists, and
   those that list it, are compared with each other where one of them is new,
   and what is nearer than the last of a list gets into it. Nodes that many
   lists hold are split into groups of a bounded size. A list that holds links
   only is saturated and gets twice the room, up to ``MOST_ROOM``.
3. When a round finds hardly any new link of a list with room, the links found
   are joined to components. Inside a component all nodes are compared in
   blocks, so whatever a full list could not hold is counted exactly. Blocks that
   lie close together as a whole, or apart, are told by their centres and radii
   (angles obey the triangle inequality), so dense groups are not multiplied out.
4. An audit compares a bounded sample of nodes with all nodes. Where too few of
   their links were found, the descent goes on from more projections and with
   twice the room.

A link is a pair of vectors of the same length with a cosine of at least
``THRESHOLD`` in double precision. Vectors that are null, empty or zero or hold
null or non-finite components have no links. Repeated rows are linked with each
other; rows that share an id are told apart by their vectors, and all rows of a
component whose id is its smallest are kept; null ids come after all others. An
empty table gives an empty result. Other columns are not read, and may have any
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.jaccard_join import components
from noteflow.llm.manifest import placed
from noteflow.llm.store import lookup, written
from noteflow.sources.splits import spread

THRESHOLD = 0.9
#: Places of a list at first, and at most before its rest is left to the blocks.
ROOM, MOST_ROOM = 10, 40
#: Sorted projections that the lists begin with, and nodes of a block of them.
TABLES, WINDOW = 6, 64
#: Most nodes that one group takes of those that list its node.
GROUP = 64
#: A descent ends when a round adds no more than this share of the links, or after so many rounds.
SETTLED, ROUNDS = 0.002, 8
#: Nodes of a block inside a component.
BLOCK = 512
#: Nodes of the audit, the recall that it asks for, and how often the descent goes on for it.
AUDIT, RECALL, AGAIN = 512, 0.995, 3

ENTRY = "node long, near long, sim double"


def units(vectors: list[bytes], dtype: str) -> np.ndarray:
    """Unit vectors in double precision, one a row."""
    x = np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1).astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """vec_id, vec (bytes of the components; null where the vector links with nothing), and the components' type."""
    double = "array<double>" in dict(vectors.dtypes)[vec_col]
    dtype, arrow = ("f8", pa.float64()) if double else ("f4", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            out: list[bytes | None] = []
            for i in range(len(column)):
                values = column[i].values
                x = None if values is None or not len(values) or values.null_count else np.asarray(values.cast(arrow)) + 0.0
                out.append(x.astype(dtype).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = spread(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{'double' if double else 'float'}>").alias("vec")))
    return rows.mapInArrow(run, "vec_id long, vec binary"), dtype


def starting_lists(nodes: DataFrame, dtype: str, tables: range, room: int) -> DataFrame:
    """node, near, sim: the nearest of the nodes that lie beside a node in any of the sorted projections."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            node, vec = batch.column("node"), batch.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vec])
            for size in np.unique(sizes).tolist():
                at = np.nonzero(sizes == size)[0]
                x = units([vec[i] for i in at], dtype)
                for t in tables:
                    if (t, size) not in planes:
                        planes[t, size] = np.random.default_rng([t, size]).standard_normal((x.shape[1], 62))
                    code = ((x @ planes[t, size] > 0) * (np.int64(1) << np.arange(61, -1, -1))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(at), pa.int32()), pa.array([size] * len(at), pa.int32()), pa.array(code, pa.int64()), node.take(pa.array(at)), pa.array([vec[i] for i in at], pa.binary())],
                        ["table", "bytes", "code", "node", "vec"],
                    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, ["table", "bytes"], WINDOW):
            node, vec = batch.column("node").to_numpy(zero_copy_only=False), batch.column("vec").to_pylist()
            a, b, s = [], [], []
            for begin in range(0, len(node), WINDOW):
                ids = node[begin : begin + WINDOW]
                if len(ids) < 2:
                    continue
                x = units(vec[begin : begin + WINDOW], dtype)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                k = min(room, len(ids) - 1)
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                a.append(np.repeat(ids, k)), b.append(ids[best.ravel()]), s.append(np.take_along_axis(sims, best, 1).ravel())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, s)], ["node", "near", "sim"])

    rows = nodes.select("node", "vec").mapInArrow(coded, "table int, bytes int, code long, node long, vec binary")
    order = ["table", "bytes", "code", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near, ENTRY)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew where the keys change (one group a batch, ``most`` given) or between groups (many groups a batch).

    With ``most``, a long group comes in pieces of a multiple of it.
    """
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = joined()
        cut = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            c = rows.column(k).to_numpy(zero_copy_only=False)
            cut |= c[1:] != c[:-1]
        ends = np.nonzero(cut)[0] + 1
        if most is None:
            last = int(ends[-1]) if len(ends) else 0
            if last:
                yield rows.slice(0, last)
        else:
            last = 0
            for end in ends.tolist():
                yield rows.slice(last, end - last)
                last = end
            if size := (rows.num_rows - last) // most * most:
                yield rows.slice(last, size)
                last += size
        held = [rows.slice(last)] if last < rows.num_rows else []
    if held:
        yield joined()


def local_joins(members: DataFrame, dtype: str) -> DataFrame:
    """node, near, sim: of each group (g, chunk) the pairs with a new member that are nearer than the last of a member's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, ["g", "chunk"]):
            g, chunk, node, worst = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "chunk", "node", "worst"))
            fresh, vec = batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("vec").to_pylist()
            edges = np.concatenate([[0], np.nonzero((g[1:] != g[:-1]) | (chunk[1:] != chunk[:-1]))[0] + 1, [len(g)]])
            a, b, s = [], [], []
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                new = fresh[begin:end]
                if end - begin < 2 or not new.any():
                    continue
                x, ids = units(vec[begin:end], dtype), node[begin:end]
                sims = x @ x.T
                wanted = (new[:, None] | new[None, :]) & (sims > worst[begin:end][:, None]) & (ids[:, None] != ids[None, :])
                i, j = np.nonzero(wanted)
                a.append(ids[i]), b.append(ids[j]), s.append(sims[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, s)], ["node", "near", "sim"])

    return members.repartition("g", "chunk").sortWithinPartitions("g", "chunk").mapInArrow(run, ENTRY)


def merged(entries: DataFrame, room: int, most: int, threshold: float) -> DataFrame:
    """The lists: node, near, sim, fresh, worst, room. Entries of known pairs have ``fresh`` false, of lists their ``room``."""
    node = Window.partitionBy("node")
    best = entries.repartition("node").groupBy("node", "near").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("room").alias("room"))
    best = best.withColumn("room", F.coalesce(F.max("room").over(node), F.lit(room)))
    best = best.withColumn("place", F.row_number().over(node.orderBy(F.desc("sim"), "near"))).where(F.col("place") <= most)
    last = F.max(F.when(F.col("place") == F.col("room"), F.col("sim"))).over(node)  # null where the list is not full
    saturated = F.coalesce(last >= threshold, F.lit(False))
    wider = F.when(saturated, F.least(F.col("room") * 2, F.greatest(F.col("room"), F.lit(most)))).otherwise(F.col("room"))
    best = best.withColumn("room", wider.cast("int")).where(F.col("place") <= F.col("room"))
    worst = F.coalesce(F.max(F.when(F.col("place") == F.col("room"), F.col("sim"))).over(node), F.lit(-2.0))
    return best.withColumn("worst", worst).drop("place")


def groups(spark: SparkSession, nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """The members of each local join: g, chunk, node, fresh, worst, vec."""
    listed = lists.select(F.col("node").alias("g"), F.col("near").alias("node"), "fresh")
    by = lists.select(F.col("near").alias("g"), "node", "fresh")
    load = listed.withColumn("by", F.lit(0)).unionByName(by.withColumn("by", F.lit(1))).groupBy("g").agg(F.sum("by").alias("by"), F.max("fresh").alias("any"))
    load = load.where("any").select("g", F.greatest(F.ceil(F.col("by") / GROUP), F.lit(1)).cast("int").alias("chunks"))
    load = written(spark, load, "groups")
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    listed = listed.join(load, "g").select("g", each.alias("chunk"), "node", "fresh")
    by = by.join(load, "g").select("g", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node", "fresh")
    own = load.select("g", each.alias("chunk"), F.col("g").alias("node"), F.lit(False).alias("fresh"))
    members = own.unionByName(listed).unionByName(by).groupBy("g", "chunk", "node").agg(F.max("fresh").alias("fresh"))
    worst = lists.groupBy("node").agg(F.max("worst").alias("worst"))
    known = nodes.select("node", "vec").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    return members.join(known, "node").select("g", "chunk", "node", "fresh", "worst", "vec")


def descended(spark: SparkSession, nodes: DataFrame, dtype: str, entries: DataFrame, room: int, threshold: float) -> DataFrame:
    """The lists (written) when rounds of local joins add hardly any link to lists with room."""
    most = max(MOST_ROOM, room)
    lists = written(spark, merged(entries, room, most, threshold), "lists")
    for _ in range(ROUNDS):
        found = local_joins(groups(spark, nodes, lists), dtype).withColumn("fresh", F.lit(True)).withColumn("room", F.lit(None).cast("int"))
        old = lists.select("node", "near", "sim", F.lit(False).alias("fresh"), "room")
        lists = written(spark, merged(old.unionByName(found), room, most, threshold), "lists")
        link = F.col("sim") >= threshold
        new = F.count_if(link & F.col("fresh") & (F.col("worst") < threshold))
        links, more = lists.agg(F.count_if(link), new).first()
        if more <= SETTLED * links:
            break
    return lists


def blocks(spark: SparkSession, nodes: DataFrame, dtype: str, roots: DataFrame) -> DataFrame:
    """Components in blocks of nodes that lie near each other: tree, block, of (blocks of the component), node, n, vec (lists), total, centre, radius, links (of a block alone in its component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                x = units([m["vec"] for m in r["members"]], dtype)
                n = np.array([m["n"] for m in r["members"]])
                centre = x.sum(axis=0)
                centre /= max(np.sqrt(centre @ centre), 1e-300)
                r |= {"centre": centre.tolist(), "radius": float(np.arccos(np.clip(x @ centre, -1, 1)).max()), "total": int(n.sum()), "node": [m["node"] for m in r["members"]], "n": n.tolist(), "vec": [m["vec"] for m in r.pop("members")]}
            yield pa.RecordBatch.from_pylist(rows, schema)

    floats, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
    schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("of", pa.int64()), ("node", longs), ("n", longs), ("vec", pa.list_(pa.binary())), ("total", pa.int64()), ("centre", floats), ("radius", pa.float64())])

    def axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, codes = batch.column("vec").to_pylist(), []
            for v in vec:
                x = units([v], dtype)[0]
                codes.append(float(x @ np.random.default_rng([7, len(x)]).standard_normal(len(x))))
            yield batch.append_column("code", pa.array(codes, pa.float64()))

    inside = roots.select(F.col("cls").alias("node"), F.col("root").alias("tree")).join(nodes.select("node", "n", "vec"), "node")
    inside = inside.mapInArrow(axis, "node long, tree long, n long, vec binary, code double")
    inside = placed(spark, inside, F.asc("code"), F.asc("node"))
    members = inside.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block"), F.ceil(F.col("size") / BLOCK).alias("of")).agg(F.collect_list(F.struct("node", "n", "vec")).alias("members"))
    return written(spark, members.mapInArrow(run, "tree long, block long, of long, node array<long>, n array<long>, vec array<binary>, total long, centre array<double>, radius double"), "blocks")


def compared(pairs: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """node, links: of pairs of blocks (a, b; b null: a with itself) how many vectors each node of either is linked with, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, n = units(r["a_vec"], dtype), np.array(r["a_n"])
                if r["b_vec"] is None:
                    hit = x @ x.T >= threshold
                    np.fill_diagonal(hit, True)
                    node, links = r["a_node"], hit @ n
                else:
                    hit = x @ units(r["b_vec"], dtype).T >= threshold
                    node, links = r["a_node"] + r["b_node"], np.concatenate([hit @ np.array(r["b_n"]), n @ hit])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

    return pairs.mapInArrow(run, "node long, links long")


def link_counts(spark: SparkSession, nodes: DataFrame, dtype: str, roots: DataFrame, threshold: float) -> DataFrame:
    """node, links: all vectors of its component that a node is linked with, itself included."""
    rows = blocks(spark, nodes, dtype, roots)
    side = lambda s: rows.select("tree", F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "vec")])
    slim = rows.select("tree", "block", "of", "total", "centre", "radius")
    pairs = slim.select("tree", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("of") - 1)).alias("b"), "total", "centre", "radius")
    other = slim.select("tree", F.col("block").alias("b"), F.col("total").alias("b_total"), F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
    pairs = pairs.join(other, ["tree", "b"])
    dot = F.aggregate(F.zip_with("centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    reach, margin = float(np.arccos(threshold)), 1e-6
    spread_ = F.col("radius") + F.col("b_radius")
    kind = F.when(between + spread_ <= reach - margin, "all").when(between - spread_ > reach + margin, "none").otherwise("some")
    pairs = written(spark, pairs.select("tree", "a", "b", "total", "b_total", kind.alias("kind")), "block_pairs")
    whole = pairs.where("kind = 'all'")
    whole = whole.select("tree", F.col("a").alias("block"), F.col("b_total").alias("links")).unionByName(whole.where("a != b").select("tree", F.col("b").alias("block"), F.col("total").alias("links")))
    whole = whole.groupBy("tree", "block").agg(F.sum("links").alias("links")).join(rows.select("tree", "block", "node"), ["tree", "block"])
    whole = whole.select(F.explode("node").alias("node"), "links")
    some = pairs.where("kind = 'some'").select("tree", "a", "b").join(side("a"), ["tree", "a"])
    two = some.where("a != b").join(side("b"), ["tree", "b"])
    one = some.where("a = b").withColumns({"b_node": F.lit(None).cast("array<long>"), "b_n": F.lit(None).cast("array<long>"), "b_vec": F.lit(None).cast("array<binary>")})
    counts = compared(two.unionByName(one), dtype, threshold).unionByName(whole)
    return counts.groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, dtype: str, found: DataFrame, threshold: float) -> float:
    """Share of the links of at most AUDIT nodes (those of the smallest hashes), compared with all nodes, that were found."""
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "n", "vec").collect()  # bounded
    by_size: dict[int, list] = {}
    for r in asked:
        by_size.setdefault(len(r.vec), []).append(r)
    blocks_ = {size: (np.array([r.node for r in rows]), units([bytes(r.vec) for r in rows], dtype)) for size, rows in by_size.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(blocks_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            vec = batch.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vec])
            for size, (ids, x) in shared.value.items():
                at = np.nonzero(sizes == size)[0]
                if len(at):
                    hit = (units([vec[i] for i in at], dtype) @ x.T >= threshold) & (node[at][:, None] != ids[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[at] @ hit, pa.int64())], ["node", "links"])

    true = nodes.select("node", "n", "vec").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    both = F.broadcast(true).join(found, "node", "left").join(nodes.select("node", "n"), "node")
    all_, got = both.agg(F.sum("true"), F.sum(F.coalesce(F.col("links") - F.col("n"), F.lit(0)))).first()
    return 1.0 if not all_ else got / all_


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, room: int = ROOM, tables: int = TABLES,
    report: Callable[[float], None] | None = None,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept. ``report`` is called with the recall of each audit."""
    rows, dtype = packed(vectors, id_col, vec_col)
    rows = written(spark, rows.withColumn("digest", F.unhex(F.sha2("vec", 256))), "vectors")
    nodes = rows.where("vec IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.any_value("vec").alias("vec"))
    nodes = written(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists, have = None, 0
    for _ in range(AGAIN):
        entries = starting_lists(nodes, dtype, range(have, have + tables), room).withColumn("fresh", F.lit(True)).withColumn("room", F.lit(None).cast("int"))
        if lists is not None:
            entries = entries.unionByName(lists.select("node", "near", "sim", F.lit(False).alias("fresh"), "room"))
        lists, have = descended(spark, nodes, dtype, entries, room, threshold), have + tables
        edges = lists.where(F.col("sim") >= threshold).select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
        roots = components(spark, edges)
        counts = written(spark, link_counts(spark, nodes, dtype, roots, threshold), "counts")
        recall = audit(nodes, dtype, counts, threshold)
        if report:
            report(recall)
        if recall >= RECALL:
            break
        room *= 2
    heads = roots.join(nodes.select(F.col("node").alias("cls"), "first"), "cls").groupBy("root").agg(F.min("first").alias("head"))
    heads = lookup(spark, roots, written(spark, heads, "heads"), "root").select(F.col("cls").alias("node"), "head")
    of_class = nodes.select("digest", "node", "n", "first").join(counts, "node", "left").join(heads, "node", "left")
    of_class = of_class.select("digest", (F.coalesce("links", "n") - 1).alias("n_links"), F.coalesce("head", "first").alias("component_id"))
    found = lookup(spark, rows.select("vec_id", "digest"), written(spark, of_class, "of_class"), "digest", stable=True)
    alone = F.col("n_links").isNull()
    found = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
