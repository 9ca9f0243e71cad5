"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles (five words in a row; all words if fewer).
Texts with equal sets form one class, and classes are joined: a link is a pair
of classes whose sets have a Jaccard similarity of at least ``SIMILARITY``.

Every run splits the classes on sampled shared tokens: a set of n shingles
follows each token whose hash for the node is below 1 / (SIMILARITY * n), so
similar sets expect to share at least one branch. Buckets of at most ``SMALL``
classes are compared by brute force; larger ones are split again, to ``DEPTH``
levels. What is still larger then is mostly alike, and its common tokens tell
nothing: from there on sets are described by what they do not share with the
centre of their bucket (``measured``). Links of sets near a centre follow from
a few numbers, which are counted, not listed (``group_links``); all others are
split on, by sampled tokens of what sets them apart, until no large bucket is
left. Runs are independent; their number follows from the recall that a pair at
the threshold must have at level ``DEPTH``. No step forms the pairs of a group.

Every link is verified on the sets themselves, as 32-bit shingle hashes (two
sets of n shingles are expected to share n * n / 2**32 by accident). Null text
counts as empty; texts without words form one class without links. Rows repeat
their class if they are repeated; rows with a null id are told apart by their
text only; an empty table gives an empty result. Other columns of ``docs`` are
not read, and may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.llm.quality import batches_of
from noteflow.llm.store import COUNTERS, HOT_KEYS, free_names, lookup, written
from noteflow.sources.splits import spread

SHINGLE_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99
DEPTH, SMALL = 3, 8
#: Largest bucket below level DEPTH that is compared by brute force.
LATER = 64
#: Similarity to a bucket's smallest set from which on a set has a say in the centre.
LIKE = 0.25
#: Sets of a group per copy of its centre; nodes per block; members of a group that share a rare token.
PART, NODES, RARE = 1024, 512, 32
#: Columns and elements that are counted at a time, whatever the length of the texts.
COLUMNS, ELEMENTS = 8192, 1 << 20
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    A pair shares a Poisson number of branches (mean 1 at the threshold, more
    above it) at each node, so it is lost by level d with probability
    q(d) = exp(q(d - 1) - 1), q(0) = 0.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    per_text = [t.split() for t in texts]
    every = [w for words in per_text for w in words]
    hashes = pd.util.hash_array(np.array(every, dtype=object), categorize=False) if every else np.zeros(0, np.uint64)
    whole = np.zeros(max(0, len(hashes) - SHINGLE_WORDS + 1), np.uint64)
    for k in range(SHINGLE_WORDS):
        whole += _mix(hashes[k : k + len(whole)] + ODD[k])
    whole = _mix(whole)
    out, at = [], 0
    for words in per_text:
        n = len(words)
        if n >= SHINGLE_WORDS:
            out.append(_distinct(whole[at : at + n - SHINGLE_WORDS + 1]))
        else:
            short = np.array([_mix(sum((_mix(hashes[at + k : at + k + 1] + ODD[k]) for k in range(n)), np.zeros(1, np.uint64)))[0]] if n else [], np.uint64)
            out.append(short)
        at += n
    return out


def set_digest(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def drawn(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents and keys of the nodes one level below ``nodes`` that a set (of well-mixed tokens) reaches."""
    if not len(nodes) or not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    limit = np.uint64(min(2.0**64 - 2048, 2.0**64 / (SIMILARITY * len(tokens))))
    # tokens are well mixed already, so one product is hash enough to draw them by
    at = [np.nonzero((tokens ^ node) * ODD[4] < limit)[0] for node in nodes]
    parents = np.repeat(nodes, [len(x) for x in at])
    return parents, _mix(parents * ODD[3] + tokens[np.concatenate(at)])


def prints(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """Slim rows: doc_id, text_key, digest (of the shingle set), n, and keys (its nodes at level 1)."""
    roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) * ODD[2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of(texts):
                sets = shingle_sets(texts[a:b])
                keys = [drawn(s, roots)[1].view(np.int64) for s in sets]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").array, "text_key": batch["text_key"].iloc[a:b].array, "digest": [set_digest(s) for s in sets], "n": [len(s) for s in sets], "keys": keys})

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_key long, digest string, n long, keys array<long>")


def _alike_sizes(members: str) -> str:
    """Members whose set could be similar to another's, by size."""
    return f"filter({members}, x -> exists({members}, y -> y.cls != x.cls AND least(x.n, y.n) >= {SIMILARITY} * greatest(x.n, y.n)))"


def bucketed(spark: SparkSession, rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows (key, cls, n; the same when read again) by bucket: key, members (structs of cls and n), large.

    A bucket of 2 to ``most`` rows is one row with all its members; each row of a
    larger one stays a row, ``large``, with itself as its only member. Rows are
    shuffled by key once: counted there, and listed where they stand. Keys that a
    Misra-Gries summary names and a count confirms (at most HOT_KEYS, broadcast)
    do not take part in it; no other key has more than one in HOT_KEYS of the rows.
    """
    top = rows.agg(F.expr(f"approx_top_k(key, {HOT_KEYS}, {COUNTERS})").alias("top")).select(F.explode("top.item").alias("key"))
    top = written(spark, top, "top")
    hot = rows.join(F.broadcast(top), "key", "left_semi").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
    hot = F.broadcast(written(spark, hot.select("key"), "hot_keys"))
    rest = rows.join(hot, "key", "left_anti").withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    alone = F.when(F.col("size") > most, F.col("cls"))
    rest = rest.groupBy("key", alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("members"))
    rest = rest.select("key", "members", F.col("alone").isNotNull().alias("large"))
    apart = rows.join(hot, "key").select("key", F.array(F.struct("cls", "n")).alias("members"), F.lit(True).alias("large"))
    return written(spark, rest.unionByName(apart), name)


def member_lists(found: DataFrame) -> DataFrame:
    """Members (an array of cls) of each small bucket that could hold a link."""
    members = found.where("NOT large").select(F.expr(f"transform({_alike_sizes('members')}, x -> x.cls)").alias("members"))
    return members.where(F.size("members") > 1)


def large_rows(found: DataFrame) -> DataFrame:
    """Rows (key, cls, n) of the large buckets."""
    return found.where("large").select("key", F.inline("members"))


def paths_below(rows: DataFrame) -> DataFrame:
    """(cls, tokens, keys) to cls, n, and the parents and keys of the nodes of levels 2 to DEPTH below ``keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            levels = {f"{c}{d}": [] for d in range(2, DEPTH + 1) for c in "pk"}
            for tokens, nodes in zip(batch["tokens"], batch["keys"]):
                mixed, nodes = _mix(tokens.view(np.uint32).astype(np.uint64) + ODD[2]), nodes.view(np.uint64)
                for d in range(2, DEPTH + 1):
                    parents, nodes = drawn(mixed, nodes)
                    levels[f"p{d}"].append(parents.view(np.int64))
                    levels[f"k{d}"].append(nodes.view(np.int64))
            yield pd.DataFrame({"cls": batch["cls"], "n": batch["tokens"].map(len)} | levels)

    return rows.mapInPandas(run, "cls long, n long" + "".join(f", p{d} array<long>, k{d} array<long>" for d in range(2, DEPTH + 1)))


def buckets(spark: SparkSession, large: DataFrame, sets: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Split large buckets (key, cls, n) of level 1: member lists of small ones, and what is large at level DEPTH (key, cls, n)."""
    keys = large.groupBy("cls").agg(F.collect_set("key").alias("keys"))  # a few a run
    paths = written(spark, paths_below(sets.join(keys.hint("shuffle_hash"), "cls").select("cls", "tokens", "keys").dropDuplicates(["cls"])), "paths")
    lists = []
    for level in range(2, DEPTH + 1):
        rows = paths.select("cls", "n", F.explode(F.arrays_zip(f"p{level}", f"k{level}")).alias("x")).select("cls", "n", F.col(f"x.p{level}").alias("parent"), F.col(f"x.k{level}").alias("key"))
        if level > 2:
            rows = written(spark, rows.join(large.select(F.col("key").alias("parent")).distinct(), "parent", "left_semi"), "below")
        found = bucketed(spark, rows.select("key", "cls", "n"), SMALL, f"level{level}")
        lists.append(member_lists(found))
        large = large_rows(found)
    return lists, large


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def measured(spark: SparkSession, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Large buckets (key, cls, n) measured against a centre: cls, grp, u, n_c, near, around, diff, children.

    A bucket's group is named by its smallest set; the centre of a group holds
    the tokens that most of the sets like that one have. ``diff`` is what a set
    and the centre do not share, u = 5 * (tokens it lacks) + 4 * (tokens it has
    besides): two sets are linked exactly if u + u' - 9 * |diff & diff'| <= n_c.
    So a set is linked to the centre if u <= n_c (``near``), and what is linked
    to such a set is ``around`` (similarity 0.6 to the centre, by the triangle
    inequality). Sets that are not near go on, split on sampled tokens of
    ``diff``, two levels at once: of two that are linked, each shares a ninth of
    its u at least.
    """
    heads = rows.groupBy("key").agg(F.min(F.struct("n", "cls"))["cls"].alias("grp"), F.count("*").alias("size"))
    parts = F.ceil(F.sum("size").over(Window.partitionBy("grp")) / PART)
    heads = written(spark, heads.select("key", "grp", parts.alias("parts")), "heads")
    pairs = lookup(spark, rows, heads, "key").groupBy("cls", "grp", "parts").agg(F.collect_set("key").alias("keys"))
    pairs = written(spark, pairs.withColumn("part", F.pmod(F.xxhash64("cls"), "parts")).drop("parts"), "in_groups")
    parts = heads.select("grp", "parts").distinct()
    # a group's wide row is copied once per PART of its sets, so that no task has to hold a group
    copies = lambda wide: wide.join(parts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    first = sets.select(F.col("cls").alias("grp"), F.col("tokens").alias("head"))
    wide = pairs.join(sets.select("cls", "tokens"), "cls").join(copies(first), ["grp", "part"]).dropDuplicates(["grp", "part", "cls"])
    both = F.size(F.array_intersect("tokens", "head"))
    alike = both >= LIKE * (F.size("tokens") + F.size("head") - both)
    gone, more = F.array_except("head", "tokens"), F.array_except("tokens", "head")
    wide = wide.select("cls", "grp", "part", "keys", "tokens", alike.alias("alike"), F.when(alike, gone).alias("gone"), F.when(alike, more).alias("more"))
    wide = written(spark, wide, "against_heads")
    sizes = written(spark, wide.where("alike").groupBy("grp").agg(F.count("*").alias("size")), "alike")
    changes = wide.where("alike").select("grp", F.explode(F.concat(F.transform("gone", lambda t: F.struct(t.alias("token"), F.lit(False).alias("new"))), F.transform("more", lambda t: F.struct(t.alias("token"), F.lit(True).alias("new"))))).alias("x"))
    changes = changes.groupBy("grp", "x.token", "x.new").agg(F.count("*").alias("times")).where("times > 1")
    changes = lookup(spark, changes, sizes, "grp").where("2 * times > size")
    changes = changes.groupBy("grp").agg(F.collect_list(F.when(F.col("new"), F.col("token"))).alias("add"), F.collect_list(F.when(~F.col("new"), F.col("token"))).alias("drop"))
    empty = F.array().cast("array<int>")
    centres = parts.select("grp").join(first, "grp").dropDuplicates(["grp"]).join(changes, "grp", "left")
    centres = centres.select("grp", F.concat(F.array_except("head", F.coalesce("drop", empty)), F.coalesce("add", empty)).alias("centre"))
    centres = written(spark, centres, "centres")
    found = wide.select("cls", "grp", "part", "keys", "tokens").join(copies(centres), ["grp", "part"])
    found = found.withColumn("gone", F.array_except("centre", "tokens")).withColumn("more", F.array_except("tokens", "centre"))
    found = found.withColumn("n_c", F.size("centre")).withColumn("u", 5 * F.size("gone") + 4 * F.size("more")).withColumn("diff", F.concat("gone", "more"))
    around = 5 * (F.col("n_c") - F.size("gone")) >= 3 * (F.col("n_c") + F.size("more"))
    step = "transform(filter(diff, t -> shiftrightunsigned(xxhash64({0}, t), 1) / 9223372036854775808D < 9 / u), t -> xxhash64(t, {0}))"
    children = F.expr(f"flatten(transform(flatten(transform(keys, k -> {step.format('k')})), k2 -> {step.format('k2')}))")  # two levels
    far = F.col("u") > F.col("n_c")
    found = found.select("cls", "grp", "u", "n_c", (~far).alias("near"), around.alias("around"), F.when(around, F.col("diff")).alias("diff"), F.when(far, children).alias("children"))
    return written(spark, found, "measured")


def settled(spark: SparkSession, large: DataFrame, sets: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Split large buckets (key, cls, n) until none is left: lists of members of small ones; members of groups (cls, gid, u, n_c, near, diff)."""
    lists, groups, level = [], None, DEPTH
    while large.limit(1).count():
        level += 2
        found = measured(spark, large, sets)
        group = found.where("around").select("cls", F.xxhash64(F.lit(level), "grp").alias("gid"), "u", "n_c", "near", "diff")
        groups = group if groups is None else groups.unionByName(group)
        below = found.where("NOT near").select("cls", F.explode("children").alias("key")).distinct().join(sets.select("cls", F.size("tokens").alias("n")), "cls")
        found = bucketed(spark, written(spark, below.select("key", "cls", "n"), "below"), LATER, f"level{level}")
        lists.append(member_lists(found))
        large = large_rows(found)
    return lists, groups


def group_members(spark: SparkSession, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with what decides their links, and tokens of ``diff`` that few of a group have.

    Members: gid, cls, u, n_c, near, hot (tokens of ``diff`` that more than RARE
    of the group have), seen, seen_near (groups before this one), node (its
    hash: members of one node have the same links to all that share no rare
    token with them). Rare tokens: gid, key, cls, u, n_c, near.
    """
    # a set shares at most u / 4 tokens of its diff, so what is linked to a near set has u <= n_c + 9 / 4 * u' - u'
    near = F.when(F.col("near"), F.col("u"))
    reach = written(spark, groups.groupBy("gid").agg(F.count("*").alias("size"), F.max(near).alias("most")).where("most IS NOT NULL AND size > 1").drop("size"), "reach")
    rows = lookup(spark, groups, reach, "gid", "inner").where("u <= n_c + 1.25 * most").drop("most")
    tokens = rows.select("gid", "cls", "u", "n_c", "near", F.explode("diff").alias("token")).withColumn("key", F.xxhash64("gid", "token")).drop("token")
    shared = tokens.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("near").alias("met")).where("met AND size > 1").drop("met")
    tokens = written(spark, lookup(spark, tokens, written(spark, shared, "shared_sizes"), "key", "inner"), "shared_diffs")
    hot = tokens.where(F.col("size") > RARE).groupBy("gid", "cls").agg(F.sort_array(F.collect_set("key")).alias("hot"))
    of_class = rows.groupBy("cls").agg(F.collect_set("gid").alias("all"), F.collect_set(F.when(F.col("near"), F.col("gid"))).alias("all_near"))
    members = rows.drop("diff").join(hot, ["gid", "cls"], "left").join(of_class, "cls")
    before = lambda c: F.sort_array(F.filter(c, lambda g: g < F.col("gid")))
    members = members.select("gid", "cls", "u", "n_c", "near", F.coalesce("hot", F.array().cast("array<long>")).alias("hot"), before("all").alias("seen"), before("all_near").alias("seen_near"), "all", "all_near")
    members = members.withColumn("node", F.xxhash64("gid", "u", "hot", "seen", "seen_near"))
    return written(spark, members, "members"), tokens.where(F.col("size") <= RARE)


def _compare_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of the nodes of a block of a group: (node, links, partner) of each, and edges (a, b) of a spanning forest."""
    u, size, near, own = (rows[c].to_numpy() for c in ("u", "size", "near", "own"))
    hit = u[:, None] + u[None, :] - 9 * shared_counts(rows["hot"].tolist()) <= rows["n_c"].iloc[0]
    hit &= near[:, None] | near[None, :]
    seen, seen_near = rows["seen"].tolist(), rows["seen_near"].tolist()
    if any(map(len, seen_near)):
        both = shared_counts(seen_near + seen)[: len(rows), len(rows) :]
        hit &= ~((both > 0) | (both.T > 0))
    if rows["low"].iloc[0] != rows["high"].iloc[0]:
        hit &= own[:, None] != own[None, :]
    hit &= ~(np.eye(len(rows), dtype=bool) & (size < 2))
    reps = rows["rep"].to_numpy()
    any_hit = hit.any(axis=1)
    out = pd.DataFrame({"node": rows["node"], "links": hit @ size - hit.diagonal(), "partner": reps[hit.argmax(axis=1)]})[any_hit]
    edges = pd.DataFrame([(reps[i], reps[j]) for i, j in _forest(hit)], columns=["a", "b"])
    return pd.concat([out.assign(a=None, b=None), edges.assign(node=None, links=None, partner=None)], ignore_index=True).astype(dict.fromkeys(("node", "links", "partner", "a", "b"), "Int64"))


def group_links(spark: SparkSession, members: DataFrame, rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links inside groups: counts (cls, links), and edges (a, b) with the same components as all the links."""
    nodes = members.groupBy("node", "gid", "u", "n_c", "near", "hot", "seen", "seen_near").agg(F.count("*").alias("size"), F.min("cls").alias("rep"))
    nodes = written(spark, nodes, "nodes")
    blocks = written(spark, nodes.groupBy("gid").agg(F.ceil(F.count("*") / NODES).alias("blocks")), "blocks")
    units = lookup(spark, nodes, blocks, "gid").withColumn("own", F.pmod("node", F.col("blocks")))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")
    found = units.groupBy("gid", "low", "high").applyInPandas(_compare_nodes, "node long, links long, partner long, a long, b long")
    found = written(spark, found, "node_links")
    of_node = written(spark, found.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"), F.min("partner").alias("partner")), "of_node")
    linked = written(spark, lookup(spark, members.select("node", "cls"), of_node, "node").where("links > 0"), "linked")
    edges = found.where("a IS NOT NULL").select("a", "b").unionByName(linked.where("cls != partner").select(F.col("cls").alias("a"), F.col("partner").alias("b")))

    # pairs that only rare tokens link: RARE members at most share each of them
    lists = rare.groupBy("gid", "key").agg(F.first("n_c").alias("n_c"), F.sort_array(F.collect_list(F.struct("cls", "u", "near"))).alias("members"))
    ahead = lists.select("gid", "n_c", "members", F.posexplode("members").alias("i", "x"))
    ahead = ahead.select("gid", "n_c", "x", F.explode(F.expr("filter(slice(members, i + 2, size(members)), y -> (x.near OR y.near) AND x.u + y.u > n_c)")).alias("y"))
    pairs = ahead.groupBy("gid", F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("times"))
    side = lambda s: members.select("gid", F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("u", "n_c", "hot", "seen", "seen_near")])
    pairs = pairs.join(side("a"), ["gid", "a"]).join(side("b").drop("n_c_b"), ["gid", "b"])
    apart = F.expr("u_a + u_b - 9 * size(array_intersect(hot_a, hot_b))")
    met = F.arrays_overlap("seen_a", "seen_near_b") | F.arrays_overlap("seen_near_a", "seen_b")
    pairs = pairs.where((apart > F.col("n_c_a")) & (apart - 9 * F.col("times") <= F.col("n_c_a")) & ~met)
    pairs = written(spark, pairs.select("a", "b"), "rare_links")
    counts = linked.select("cls", "links").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("links")))
    return counts, edges.unionByName(pairs)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of elements that each two of the sets (of distinct well-mixed elements) share."""
    both = np.zeros((len(sets), len(sets)), np.float32)
    parts = -(-sum(map(len, sets)) // ELEMENTS)
    for k in range(parts):
        _add_shared(both, [s[s % parts == k] for s in sets] if parts > 1 else sets)
    return both


def _add_shared(both: np.ndarray, sets: list[np.ndarray]) -> None:
    if not sum(map(len, sets)):
        return
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # only elements of two sets or more count
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[number >= 0]
    number = number[number >= 0]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(number, [first, first + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(number[b - 1]) - first + 1)), np.float32)
        part[owner[a:b], number[a:b] - first] = 1
        both += part @ part.T


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    left, edges = np.ones(len(hit), bool), []
    for root in range(len(hit)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            i = front.pop()
            for j in np.nonzero(hit[i] & left)[0].tolist():
                left[j] = False
                edges.append((i, j))
                front.append(j)
    return edges


def _compare(rows: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Linked pairs of a small bucket."""
    names, sets = zip(*rows)
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(list(sets)) if len(sets) > 2 else np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)) if len(sets) == 2 else 0)
    hit = 9 * both >= 4 * (sizes[:, None] + sizes[None, :])
    return [(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(hit, 1)))]


def compare_units(units: DataFrame) -> DataFrame:
    """Brute force inside each unit (unit, cls, tokens); the rows of a unit stand together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
        unit, rows, out = None, [], []
        for batch in batches:
            tokens = batch.column("tokens")
            flat, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            for i, (own, cls) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("cls").to_pylist())):
                if own != unit and rows:
                    out += _compare(rows)
                    rows = []
                    if len(out) > 10_000:
                        yield table(out)
                        out = []
                unit = own
                if not rows or rows[-1][0] != cls:  # repeated rows give a set twice, side by side
                    rows.append((cls, flat[ends[i] : ends[i + 1]].copy()))
        if rows:
            out += _compare(rows)
        if out:
            yield table(out)

    return units.mapInArrow(run, "a long, b long")


def token_sets(rows: DataFrame) -> DataFrame:
    """(cls, text) to (cls, tokens): sorted 32-bit hashes of the shingles. Rows that repeat a document in full repeat its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of(texts):
                sets = [_distinct((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in shingle_sets(texts[a:b])]
                yield pd.DataFrame({"cls": batch["cls"].iloc[a:b].array, "tokens": sets})

    return rows.mapInPandas(run, "cls long, tokens array<int>")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(cls, root): the smallest class of each connected component of ``edges`` (a, b).

    Labels spread along edges and jump to their label's label; a written table
    per round, until no label changes. Classes with many edges and labels that
    many have are looked up on the map side.
    """
    both = written(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.col("cls")).alias("root")), "labels")
    while True:
        near = lookup(spark, both, labels.select(F.col("cls").alias("b"), "root"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "cls").select("cls", F.least("root", "near").alias("step"), F.col("root").alias("old"))
        found = lookup(spark, spread, labels.select(F.col("cls").alias("step"), F.col("root").alias("top")), "step")
        found = written(spark, found.select("cls", F.least("step", F.coalesce("top", "step")).alias("root"), "old"), "labels")
        if not found.where("root != old").limit(1).count():
            return found.select("cls", "root")
        labels = found.select("cls", "root")


def links_of_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Counts (cls, links) that add up to each class's links, and edges (a, b) with the same components as all links."""
    found = bucketed(spark, classes.select(F.explode("keys").alias("key"), "cls", "n"), SMALL, "level1")
    members = written(spark, member_lists(found).distinct(), "lists")  # a list is often the same in many buckets
    large = large_rows(found)

    # the sets of the classes that met another; the slim side is built, so that texts are shuffled once and not sorted
    met = members.select(F.explode("members").alias("cls")).unionByName(large.select("cls")).distinct()
    met = written(spark, met.join(classes, "cls").select("cls", F.col("first.doc_id").alias("met_id"), F.col("first.text_key").alias("met_key")), "met")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row_key"))
    rows = rows.join(met.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("met_id")) & (F.col("row_key") == F.col("met_key")))
    sets = written(spark, token_sets(rows.select("cls", F.coalesce("text", F.lit("")).alias("text"))), "sets")
    lists, large = buckets(spark, large, sets)
    more, groups = settled(spark, large, sets)
    members = written(spark, union_of([members, *lists, *more]).distinct(), "lists")

    # lists with the same hash are one unit: all their pairs are compared
    units = members.select(F.xxhash64("members").alias("unit"), F.explode("members").alias("cls"))
    units = units.join(sets.hint("shuffle_hash"), "cls").repartition("unit").sortWithinPartitions("unit", "cls")
    pairs = compare_units(units).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = edges = written(spark, pairs, "pairs")
    if groups is None:
        return pairs.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("links")), edges
    inside, rare = group_members(spark, groups)
    counts, more_edges = group_links(spark, inside, rare)
    # pairs of small buckets that a group has counted do not count again
    side = lambda s: inside.select(F.col("cls").alias(s), F.col("all").alias(f"all_{s}"), F.col("all_near").alias(f"near_{s}")).dropDuplicates([s])
    counted = F.arrays_overlap("all_a", "near_b") | F.arrays_overlap("near_a", "all_b")
    alone = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(~F.coalesce(counted, F.lit(False)))
    counts = counts.unionByName(alone.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("links")))
    return counts, edges.unionByName(more_edges)


def join_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, n_links, first_key.

    class_id is the smallest doc_id of the connected component of links;
    n_links counts the different shingle sets that are linked to the row's own;
    first_key tells the rows of the text that class_id stands for.
    """
    seen = written(spark, prints(docs, id_col, text_col, runs_for(recall)), "prints")
    # classes go by numbers, half as wide as digests in all that is shuffled; they hold in the written table
    classes = seen.groupBy("digest", "n").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"), F.any_value("keys").alias("keys"))
    classes = written(spark, classes.sortWithinPartitions("digest").withColumn("cls", F.monotonically_increasing_id()), "classes")
    counts, edges = links_of_classes(spark, docs, classes, id_col, text_col)
    counts = counts.groupBy("cls").agg(F.sum("links").alias("n_links"))
    of_class = classes.select("cls", "digest", "first").join(components(spark, edges), "cls", "left").join(counts, "cls", "left")
    of_class = written(spark, of_class.select("digest", "first", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "rooted")
    heads = written(spark, of_class.groupBy("root").agg(F.min("first").alias("head")), "roots")
    of_class = lookup(spark, of_class, heads, "root").select("digest", F.col("head.doc_id").alias("class_id"), F.col("head.text_key").alias("first_key"), "n_links")
    of_class = written(spark, of_class, "of_class")
    return lookup(spark, seen.select("doc_id", "text_key", "digest"), of_class, "digest").select("doc_id", "text_key", "class_id", "n_links", "first_key")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that have an earlier document in their class, columns as they were."""
    found = join_classes(spark, docs, id_col, text_col)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("first_key"))
    gone_id, gone_key = free_names(docs, "gone_id", "gone_key")
    gone = written(spark, found.where(~stays).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), "gone")
    match = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.col(text_col)) == F.col(gone_key))
    return docs.join(gone.hint("shuffle_hash"), match, "left_anti")
