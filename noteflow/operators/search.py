"""Hybrid search of many queries at once: vector and keyword legs, fusion, threshold, cap, outcome.

Keys: ``vault_id`` and ``query_id``. Chunks carry chunk_id, vault_id, source_path,
content_hash, embedding_model, embedding and metadata; files carry their state.
Every ranking ends with chunk_id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteflow.functions import text as T
from noteflow.functions.notes import ENUMS
from noteflow.operators import maintenance as M
from noteflow.sources.scratch import written

RRF_K, CANDIDATES, TOP_K, MOST_TOP_K, PER_SOURCE, RERANK_CANDIDATES = 60, 50, 5, 10, 2, 15
DEFAULT_STATUS = ("current",)
#: Filter lists of a query, in the order of their checks (a query has them as f_type and so on).
LISTS = ("type", "status", "priority", "visibility")
FILTERS = (*(f"f_{c}" for c in LISTS), "f_tags", "f_project", "f_domain")
META = (*LISTS, "tags", "project", "domain")
#: Chunks and queries of a tile of the vector leg.
TILE_CHUNKS, TILE_QUERIES = 16_384, 1024
#: Chunks, characters of their texts and queries of a tile of the keyword leg.
LEXICAL_CHUNKS, LEXICAL_CHARS, LEXICAL_QUERIES = 16_384, 48_000_000, 16_384
#: Chunks and queries of a tile that gives all pairs.
PAIR_CHUNKS, PAIR_QUERIES = 1024, 1024
#: What a matrix product may be off the cosine that is summed in order.
MARGIN = 1e-9


def fresh_chunks(chunks: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """Chunks of the current model that still show the text of a live, indexed file."""
    live = files.where("NOT deleted AND index_status = 'indexed'").select("vault_id", "source_path", "content_hash")
    usable = chunks.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model))
    return usable.join(live, ["vault_id", "source_path", "content_hash"])


def metadata_filter(
    status: list[str] | None = None, types: list[str] | None = None, priorities: list[str] | None = None, visibility: list[str] | None = None,
    project: str | None = None, domain: str | None = None, tags: list[str] | None = None,
) -> Column:
    """A predicate on chunk columns. No status given: the default; an empty list: any. Null tags match no tag filter."""
    wanted = F.lit(True)
    for name, values in (("status", list(DEFAULT_STATUS) if status is None else status), ("type", types), ("priority", priorities), ("visibility", visibility)):
        if values:
            wanted &= F.col(name).isin(list(dict.fromkeys(values)))
    for name, value in (("project", project), ("domain", domain)):
        if value is not None:
            wanted &= F.col(name) == value
    if tags:
        wanted &= F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, dict.fromkeys(tags)))), F.lit(False))
    return wanted


def query_filter(lists: tuple[str, ...] = ("status",)) -> Column:
    """The same for a pair row whose query has f_<list> for the given lists and f_tags (arrays; empty: any), f_project and f_domain (null: any)."""
    wanted = F.lit(True)
    for c in lists:
        wanted &= (F.size(f"f_{c}") == 0) | F.coalesce(F.array_contains(F.col(f"f_{c}"), F.col(c)), F.lit(False))
    for c in ("project", "domain"):
        wanted &= F.col(f"f_{c}").isNull() | F.coalesce(F.col(f"f_{c}") == F.col(c), F.lit(False))
    return wanted & ((F.size("f_tags") == 0) | F.coalesce(F.arrays_overlap("f_tags", "tags"), F.lit(False)))


def effective_filters(queries: DataFrame) -> DataFrame:
    """``queries`` with all filter columns: missing ones and nulls take the default (status: current, others: any); lists without repeats, texts trimmed, blank ones null."""
    given = lambda c, kind: F.col(c).cast(kind) if c in queries.columns else F.lit(None).cast(kind)
    usual = {"status": F.array(*map(F.lit, DEFAULT_STATUS))}
    none = F.array().cast("array<string>")
    lists = {f"f_{c}": F.array_distinct(F.coalesce(given(f"f_{c}", "array<string>"), usual.get(c, none))) for c in LISTS}
    tags = F.array_distinct(F.filter(F.transform(F.coalesce(given("f_tags", "array<string>"), none), lambda t: F.trim(t)), lambda t: t != ""))
    texts = {f"f_{c}": F.nullif(F.trim(given(f"f_{c}", "string")), F.lit("")) for c in ("project", "domain")}
    return queries.withColumns({**lists, "f_tags": tags, **texts})


def filter_error() -> Column:
    """The first filter list of a query with a value that the frontmatter does not have; null where all are known."""
    bad = lambda c: F.exists(F.col(f"f_{c}"), lambda v: v.isNull() | ~v.isin(*sorted(ENUMS[c])))
    return F.coalesce(*[F.when(bad(c), f"filter {c} has an unsupported value") for c in LISTS])


def checked_queries(queries: DataFrame, vaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good queries and rejected ones with their first error: blank text or vault, an unknown value in a filter, top_k outside 1..10, min_score outside 0..1, no active vault."""
    active = vaults.where("is_active").select(F.col("vault_id").alias("known_vault"))
    rows = queries.withColumns({"query": F.trim("query"), "vault_id": F.trim("vault_id"), "top_k": F.coalesce("top_k", F.lit(TOP_K))})
    rows = rows.join(active, F.col("vault_id") == F.col("known_vault"), "left")
    filtered = filter_error() if all(f"f_{c}" in queries.columns for c in LISTS) else F.lit(None).cast("string")
    error = (
        F.when(F.coalesce("query", F.lit("")) == "", "query is required").when(F.coalesce("vault_id", F.lit("")) == "", "vault is required")
        .when(filtered.isNotNull(), filtered).when(~F.col("top_k").between(1, MOST_TOP_K), f"top_k must be between 1 and {MOST_TOP_K}").when(~F.col("min_score").between(0, 1), "min_score must be between 0 and 1")
        .when(F.col("known_vault").isNull(), "vault not found")
    )
    rows = rows.withColumn("error", error).drop("known_vault")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def _top(rows: DataFrame, order: list[Column], n: int, rank: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn(rank, place).where(F.col(rank) <= n)


def vector_leg(queries: DataFrame, chunks: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """query_id, chunk_id, score, vector_rank: the n nearest chunks of the query's vault, by a join of all pairs. ``block_vector_leg`` gives the same in blocks."""
    pairs = chunks.join(queries.select("query_id", "vault_id", "query_embedding"), "vault_id")
    scored = pairs.select("query_id", "chunk_id", T.cosine(F.col("embedding"), F.col("query_embedding")).alias("score")).where("score IS NOT NULL")
    return _top(scored, [F.desc("score"), F.asc("chunk_id")], n, "vector_rank")


def _tiled(asked: DataFrame, chunks: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, parts: Column, n_queries: int) -> DataFrame:
    """``run(chunks, queries)`` of all pairs of a part of a vault's chunks and a block of its queries.

    Parts and blocks are dealt by hash; ``parts`` is an aggregate over a vault's chunks.
    """
    tiles = asked.groupBy("vault_id").agg(F.ceil(F.count("*") / n_queries).cast("int").alias("blocks"))
    tiles = tiles.join(chunks.groupBy("vault_id").agg(parts.cast("int").alias("parts")), "vault_id")
    tiles = written(asked.sparkSession, tiles, "tiles")  # a row a vault
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda key, c: F.pmod(F.xxhash64(key), c).cast("int")
    left = chunks.join(tiles, "vault_id").withColumn("part", one_of("chunk_id", "parts")).withColumn("block", all_of("blocks")).drop("parts", "blocks")
    right = asked.join(tiles, "vault_id").withColumn("block", one_of("query_id", "blocks")).withColumn("part", all_of("parts")).drop("parts", "blocks")
    keys = ["vault_id", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def block_vector_leg(queries: DataFrame, chunks: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The same by matrix products of tiles: the chunks of a vault in parts, its queries in blocks, a task for each pair of them.

    Parts and blocks are dealt by hash and have a bounded number of rows, so a
    vault of any size is many tiles; chunks are shuffled once for every block
    of queries of their vault (one, mostly), and each tile keeps n chunks a
    query. What a product leaves near a query's n best is scored again in the
    order of the components, so ties are ties. Queries with filters
    (``FILTERS``) get chunks that pass them.
    """
    own = [c for c in FILTERS if c in queries.columns]
    asked = queries.select("query_id", "vault_id", "query_embedding", *own).where("query_embedding IS NOT NULL")
    chunks = chunks.select("chunk_id", "vault_id", "embedding", *(META if own else ()))
    best = _tiled(asked, chunks, lambda a, b: _tile(a, b, n, own), "query_id long, chunk_id long, score double", F.ceil(F.count("*") / TILE_CHUNKS), TILE_QUERIES)
    return _top(best, [F.desc("score"), F.asc("chunk_id")], n, "vector_rank")


def pair_cosines(queries: DataFrame, chunks: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score: the rounded cosine of every query with every chunk of its vault, null where there is none; in tiles."""
    asked = queries.select("query_id", "vault_id", "query_embedding")
    chunks = chunks.select("chunk_id", "vault_id", "embedding")
    return _tiled(asked, chunks, lambda a, b: _pairs(a, b, digits), "query_id long, chunk_id long, score double", F.ceil(F.count("*") / PAIR_CHUNKS), PAIR_QUERIES)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**digits


class _Vectors:
    """Vectors of one width with a norm over 0: their rows in the column, components (one a row), squared norms; sums go in the order of the components."""

    def __init__(self, column: pa.ChunkedArray, width: int) -> None:
        column = column.combine_chunks()
        rows = np.nonzero(pc.equal(pc.fill_null(pc.list_value_length(column), -1), width).to_numpy(zero_copy_only=False))[0]
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
        squares = np.zeros(len(rows))
        for c in x.T:
            squares += np.square(c, dtype=np.float64)
        good = squares > 0
        self.rows, self.at, self.squares = rows[good], np.ascontiguousarray(x[good].T), squares[good]

    def sorted(self, key: np.ndarray) -> _Vectors:
        order = np.argsort(key[self.rows], kind="stable")
        self.rows, self.at, self.squares = self.rows[order], self.at[:, order], self.squares[order]
        return self

    def units(self) -> np.ndarray:
        return self.at.T / np.sqrt(self.squares)[:, None]

    def cosines(self, i, other: _Vectors, j) -> np.ndarray:
        """Of the vectors i with the vectors j of ``other`` (indices that broadcast)."""
        squares = self.squares[i] * other.squares[j]
        dot = np.zeros(squares.shape)
        for a, b in zip(self.at, other.at):
            dot += a[i].astype(np.float64) * b[j]
        return np.clip(dot / np.sqrt(squares), -1.0, 1.0)


def _pairs(chunks: pa.Table, queries: pa.Table, digits: int) -> pa.Table:
    """query_id, chunk_id, score of all pairs of a tile."""
    scores = np.zeros((queries.num_rows, chunks.num_rows))
    known = np.zeros(scores.shape, bool)
    for width in np.unique(pc.list_value_length(queries.column("query_embedding").drop_null()).to_numpy()).tolist():
        x, q = _Vectors(chunks.column("embedding"), width), _Vectors(queries.column("query_embedding"), width)
        if not len(x.rows):
            continue
        for begin in range(0, len(q.rows), 64):
            part = np.arange(begin, min(begin + 64, len(q.rows)))
            at = np.ix_(q.rows[part], x.rows)
            scores[at], known[at] = _rounded(q.cosines(part[:, None], x, np.arange(len(x.rows))[None, :]), digits), True
    query = np.repeat(queries.column("query_id").to_numpy(), chunks.num_rows)
    chunk = np.tile(chunks.column("chunk_id").to_numpy(), queries.num_rows)
    return pa.table([pa.array(query, pa.int64()), pa.array(chunk, pa.int64()), pa.array(scores.ravel(), pa.float64(), mask=~known.ravel())], ["query_id", "chunk_id", "score"])


def _passing(filters: tuple, meta: dict[str, list]) -> np.ndarray:
    """Which chunks pass a query's filters."""
    wanted = dict(filters)
    out = np.ones(len(meta["status"]), bool)
    for c in LISTS:
        if wanted[f"f_{c}"]:
            given = set(wanted[f"f_{c}"]) - {None}
            out &= np.array([v in given for v in meta[c]], bool)
    for c in ("project", "domain"):
        if wanted[f"f_{c}"] is not None:
            out &= np.array([v == wanted[f"f_{c}"] for v in meta[c]], bool)
    if wanted["f_tags"]:
        tags = set(wanted["f_tags"]) - {None}
        out &= np.array([bool(tags.intersection(v or ())) for v in meta["tags"]], bool)
    return out


def _tile(chunks: pa.Table, queries: pa.Table, n: int, own: list[str]) -> pa.Table:
    """query_id, chunk_id, score: the n best chunks of a tile for each of its queries; ties go to the smaller chunk_id."""
    meta = {c: chunks.column(c).to_pylist() for c in META} if own else {}
    asked = [tuple(sorted((c, tuple(v) if isinstance(v, list) else v) for c, v in r.items())) for r in queries.select(own).to_pylist()] if own else [()] * queries.num_rows
    masks: dict[tuple, np.ndarray] = {}
    chunk, query = chunks.column("chunk_id").to_numpy(), queries.column("query_id").to_numpy()
    widths = np.unique(pc.list_value_length(queries.column("query_embedding")).to_numpy())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for width in widths.tolist():
        x, q = _Vectors(chunks.column("embedding"), width).sorted(chunk), _Vectors(queries.column("query_embedding"), width)
        at, asks = x.rows, q.rows
        near, far = q.units(), x.units()
        for begin in range(0, len(asks) if len(at) else 0, 128):
            scores = near[begin : begin + 128] @ far.T
            if own:
                for i, row in enumerate(asks[begin : begin + 128]):
                    if asked[row] not in masks:
                        masks[asked[row]] = _passing(asked[row], meta)
                    scores[i, ~masks[asked[row]][at]] = -np.inf
            last = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n] if len(at) > n else np.full((len(scores), 1), -np.inf)
            i, j = np.nonzero((scores >= last - MARGIN) & (scores > -np.inf))
            exact = q.cosines(begin + i, x, j)
            best = np.lexsort((chunk[at[j]], -exact, i))
            i, j, exact = i[best], j[best], exact[best]
            firsts = np.searchsorted(i, np.arange(len(scores)))
            head = np.arange(len(i)) - firsts[i] < n
            found.append((query[asks[begin + i[head]]], chunk[at[j[head]]], exact[head]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "chunk_id", "score"])


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, vault_id, term, tf of each chunk's lexical document."""
    terms = T.terms(T.lexical_document(F.col("title"), F.col("source_path"), F.col("tags"), F.col("content")))
    exploded = chunks.select("chunk_id", "vault_id", F.explode(terms).alias("term"))
    return exploded.groupBy("chunk_id", "vault_id", "term").agg(F.count("*").alias("tf"))


def lexical_leg(queries: DataFrame, chunks: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """query_id, chunk_id, rank_value, lexical_rank: chunks for which the query's tree (``text.query_tree``) holds.

    In tiles, as the vector leg: the terms of a part of a vault's chunks, as one
    text each, meet a block of its queries in one task, which keeps n chunks a
    query, so no table holds a row for each query and chunk. The rank is the mean,
    over the distinct words of literals that are not barred, of the sum of 1 / i**2
    for i up to the word's count. Queries with filters get chunks that pass them.
    """
    own = [c for c in FILTERS if c in queries.columns]
    tree = T.query_tree(F.col("query"))
    # texts and trees are made once, since tiles are counted before they are dealt; a filter on trees before that could move ahead of the joins that give the queries
    asked = written(queries.sparkSession, queries.select("query_id", "vault_id", tree.alias("tree"), *own), "trees").where(F.size("tree") > 0)
    asked = asked.select("query_id", "vault_id", "tree", T.tree_terms(F.col("tree"), barred=False).alias("of"), *own)
    terms = T.positioned(T.lexical_document(F.col("title"), F.col("source_path"), F.col("tags"), F.col("content")))
    texts = chunks.select("chunk_id", "vault_id", F.array_join(terms, " ").alias("terms"), *(META if own else ()))
    texts = written(queries.sparkSession, texts.withColumn("chars", F.length("terms")), "terms")
    parts = F.ceil(F.greatest(F.count("*") / LEXICAL_CHUNKS, F.coalesce(F.sum("chars"), F.lit(0)) / LEXICAL_CHARS))
    best = _tiled(asked, texts, lambda a, b: _lexical_tile(a, b, n, own), "query_id long, chunk_id long, rank_value double", parts, LEXICAL_QUERIES)
    return _top(best, [F.desc("rank_value"), F.asc("chunk_id")], n, "lexical_rank")


class _Postings:
    """Where the words that are asked for stand in the chunks of a tile."""

    def __init__(self, texts: pa.ChunkedArray, words: set[str], longest: int) -> None:
        self.code = {w: i for i, w in enumerate(words)}
        blank, pieces, sizes = np.full(longest, -1, np.int32), [], []
        for text in texts:
            text = text.as_py()
            found = text.split(" ") if text else []
            # blanks after each text: no phrase goes on in the next one
            pieces += [np.fromiter((self.code.get(w, -1) for w in found), np.int32, len(found)), blank]
            sizes.append(len(found) + longest)
        self.stream = np.concatenate([blank, *pieces, blank])
        at = np.nonzero(self.stream >= 0)[0]
        codes = self.stream[at]
        order = np.argsort(codes, kind="stable")
        at, codes = at[order], codes[order]
        self.starts = np.cumsum([longest, *sizes])[:-1]
        self.at, self.ends = at, np.searchsorted(codes, np.arange(len(self.code) + 1))
        # per word and chunk: 1 + 1/4 + 1/9 ... up to the count
        key = codes.astype(np.int64) * max(len(sizes), 1) + self.chunks(at)
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        count = np.diff(first, append=len(key))
        self.chunk = key[first] % max(len(sizes), 1)
        gains = np.concatenate([[0.0], np.cumsum(1.0 / np.square(np.arange(1.0, count.max(initial=0) + 1)))])
        self.gain, self.firsts = gains[count], np.searchsorted(key[first], np.arange(len(self.code) + 1) * max(len(sizes), 1))

    def chunks(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def word(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that hold the word, and its gain in each."""
        at = slice(self.firsts[self.code[word]], self.firsts[self.code[word] + 1])
        return self.chunk[at], self.gain[at]

    def holding(self, phrase: list[str]) -> np.ndarray:
        """Chunks that hold the words in that order with nothing in between (repeats where a chunk holds them twice)."""
        if len(phrase) == 1:
            return self.word(phrase[0])[0]
        codes = [self.code[w] for w in phrase]
        rarest = min(range(len(codes)), key=lambda i: self.ends[codes[i] + 1] - self.ends[codes[i]])
        at = self.at[self.ends[codes[rarest]] : self.ends[codes[rarest] + 1]] - rarest
        for i, code in enumerate(codes):
            if i != rarest:
                at = at[self.stream[at + i] == code]
        return self.chunks(at)


def _lexical_tile(chunks: pa.Table, queries: pa.Table, n: int, own: list[str]) -> pa.Table:
    """query_id, chunk_id, rank_value: the n best chunks of a tile for each of its queries; ties go to the smaller chunk_id."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if chunks.num_rows and queries.num_rows:
        chunks = chunks.sort_by("chunk_id")
        meta = {c: chunks.column(c).to_pylist() for c in META} if own else {}
        masks: dict[tuple, np.ndarray] = {}
        chunk, size = chunks.column("chunk_id").to_numpy(), chunks.num_rows
        asked = queries.to_pylist()
        phrases = [x["phrase"] for r in asked for group in r["tree"] for x in group]
        held = _Postings(chunks.column("terms"), {w for p in phrases for w in p}, max(map(len, phrases)))
        for r in asked:
            holds = np.zeros(size, bool)
            for group in r["tree"]:
                every = np.ones(size, bool)
                for x in group:
                    has = np.zeros(size, bool)
                    has[held.holding(x["phrase"])] = True
                    every &= has != x["barred"]
                holds |= every
            if own:
                filters = tuple(sorted((c, tuple(r[c]) if isinstance(r[c], list) else r[c]) for c in own))
                if filters not in masks:
                    masks[filters] = _passing(filters, meta)
                holds &= masks[filters]
            hits = np.nonzero(holds)[0]
            if r["of"]:
                total = np.zeros(size)
                for w in r["of"]:
                    at, gain = held.word(w)
                    total[at] += gain
                ranks = _rounded(total[hits] / len(r["of"]), 9)
                if len(hits) > n:
                    near = ranks >= -np.partition(-ranks, n - 1)[n - 1]
                    hits, ranks = hits[near], ranks[near]
                best = np.argsort(-ranks, kind="stable")[:n]
                hits, ranks = hits[best], ranks[best]
            else:
                hits = hits[:n]
                ranks = np.zeros(len(hits))
            found.append((np.full(len(hits), r["query_id"], np.int64), chunk[hits], ranks))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "chunk_id", "rank_value"])


def fused(vector: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf, matched_by, fused_rank by reciprocal rank fusion; ties by order of first sight. A score of ``vector`` is kept."""
    both = vector.select("query_id", "chunk_id", "vector_rank", *[c for c in ("score",) if c in vector.columns]).join(lexical.select("query_id", "chunk_id", "lexical_rank"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.when(F.col(c).isNotNull(), F.lit(1.0) / (k + F.col(c))).otherwise(F.lit(0.0))
    by = F.when(F.col("lexical_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "lexical").otherwise("both")
    both = both.withColumns({"rrf": F.round(part("vector_rank") + part("lexical_rank"), 12), "matched_by": by})
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank"), "chunk_id")
    return both.withColumn("fused_rank", F.row_number().over(order))


def passing(rows: DataFrame, least: float | Column) -> DataFrame:
    """Rows that only the vector leg matched need the score; others always pass. ``least`` <= 0 disables."""
    bar = least if isinstance(least, Column) else F.lit(float(least))
    return rows.where((bar <= 0) | (F.col("matched_by") != "vector") | (F.col("score") >= bar))


def capped(rows: DataFrame, per_source: int = PER_SOURCE, order: str = "fused_rank") -> DataFrame:
    """The first ``per_source`` rows of each (query, source) in the given order."""
    if per_source <= 0:
        return rows
    place = F.row_number().over(Window.partitionBy("query_id", "source_path").orderBy(order))
    return rows.withColumn("__place", place).where(F.col("__place") <= per_source).drop("__place")


def reranked(rows: DataFrame, rerank, n: int = RERANK_CANDIDATES) -> DataFrame:
    """``rerank(query, texts) -> reply`` reorders each query's first n rows; failures and empty replies keep the order.

    rows: query_id, query, chunk_id, content, fused_rank. Adds rank and reranked.
    """
    import pandas as pd

    def order_of(reply: str, size: int) -> list[int]:
        import json
        import re

        found = re.search(r"\[[^\[\]]*\]", reply)
        try:
            ranks = json.loads(found[0]) if found else []
        except ValueError:
            ranks = []
        good = [r for r in ranks if type(r) is int and 1 <= r <= size]
        return list(dict.fromkeys([*good, *range(1, size + 1)]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fused_rank").reset_index(drop=True)
        head, done = rows.head(n), False
        order = list(range(len(head)))
        try:
            reply = rerank(rows["query"].iloc[0], head["content"].tolist())
            if reply:
                order, done = [r - 1 for r in order_of(reply, len(head))], True
        except Exception:  # noqa: BLE001  the model is not ours: any failure keeps the order
            done = False
        out = pd.concat([head.iloc[order], rows.iloc[len(head) :]])
        return out.assign(rank=np.arange(1, len(out) + 1), reranked=done)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", rank int, reranked boolean"
    return rows.groupBy("query_id").applyInPandas(run, schema)


def outcome(queries: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: candidate_count, result_count, no_candidates, low_confidence, notice."""
    counted = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    kept = results.groupBy("query_id").agg(F.count("*").alias("result_count"))
    out = queries.select("query_id").join(counted, "query_id", "left").join(kept, "query_id", "left").fillna(0)
    none = F.col("candidate_count") == 0
    low = ~none & (F.col("result_count") == 0)
    notice = F.when(none, "no_candidates").when(low, "low_confidence").otherwise("ok")
    return out.withColumns({"no_candidates": none, "low_confidence": low, "notice": notice})


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, files: DataFrame, model: str, *, where: Column | None = None, candidates: int = CANDIDATES, min_score: float = 0.0,
    per_source: int = PER_SOURCE, top_k: int = TOP_K, hybrid: bool = True, rerank=None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked rows (query_id, rank, chunk_id, source_path, score, matched_by, rrf) and the outcome per query.

    A query's own ``top_k`` (1 to MOST_TOP_K), ``min_score`` and filters (FILTERS,
    see ``effective_filters``) come before the arguments, if ``queries`` has such
    columns and they are not null.
    """
    own = lambda c, usual: F.coalesce(c, F.lit(usual)) if c in queries.columns else F.lit(usual)
    filtered = [c for c in FILTERS if c in queries.columns]
    if filtered:
        queries, where = effective_filters(queries), F.lit(True) if where is None else where
    spark, where = queries.sparkSession, metadata_filter() if where is None else where
    # queries and the chunks that count are found once, these without their texts, which only the keyword leg and a rerank read
    queries = written(spark, queries, "queries")
    slim = ("chunk_id", "vault_id", "source_path", "embedding", *(META if filtered else ()))
    pool = chunks.where(where).select(*dict.fromkeys([*slim, "content_hash", "embedding_model"]))
    pool = written(spark, fresh_chunks(pool, files, model).select(*slim), "pool")
    texts = chunks.select("chunk_id", "vault_id", "title", "source_path", "tags", "content", *[c for c in META if filtered and c != "tags"]).join(pool.select("chunk_id"), "chunk_id")
    budget = candidates if hybrid or per_source > 0 else max(top_k, MOST_TOP_K) if "top_k" in queries.columns else top_k
    vector = block_vector_leg(queries, pool, budget)
    lexical = lexical_leg(queries, texts, candidates) if hybrid else vector.limit(0).select("query_id", "chunk_id", F.lit(0.0).alias("rank_value"), F.lit(0).alias("lexical_rank"))
    # at most two legs of candidates a query: written once, since ranking and outcome both start from it
    merged = written(spark, fused(vector, lexical).withColumn("score", F.round("score", 6)), "fused")
    asked = queries.select("query_id", "query", own("top_k", top_k).alias("own_top_k"), own("min_score", float(min_score)).alias("own_min_score"))
    # the bar is for rows of the vector leg alone, which has their score; vectors come in again for what is left at the end
    found = merged.join(pool.select("chunk_id", "source_path"), "chunk_id").join(asked, "query_id")
    found = found if rerank is None else found.join(texts.select("chunk_id", "content"), "chunk_id")
    kept = passing(found, F.col("own_min_score"))
    order = "fused_rank"
    if rerank is not None:
        kept, order = reranked(kept, rerank), "rank"
    kept = capped(kept, per_source, order)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    # the constant lets each task drop what no query can keep before the shuffle
    most = max(top_k, MOST_TOP_K) if "top_k" in queries.columns else top_k
    ranked = kept.withColumn("rank", place).where((F.col("rank") <= most) & (F.col("rank") <= F.col("own_top_k")))
    ranked = written(spark, ranked.select("query_id", "rank", "chunk_id", "source_path", "score", "matched_by", "rrf"), "ranked")
    unknown = ranked.where("score IS NULL").drop("score").join(pool.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", "query_embedding"), "query_id")
    unknown = unknown.withColumn("score", F.round(T.cosine(F.col("embedding"), F.col("query_embedding")), 6)).select(*ranked.columns)
    ranked = ranked.where("score IS NOT NULL").unionByName(unknown)
    return ranked, outcome(queries, merged, ranked)


def evidence(outcomes: DataFrame, status: DataFrame) -> DataFrame:
    """``outcomes`` (with vault_id, error) and the index status of their vaults: notices in the order pending, failed, stale, and the reindex that they call for.

    Where nothing was found the notices say why; only an outcome without
    candidates tells of files of another model, since they may hold the answer.
    """
    rows = outcomes.join(status, "vault_id", "left").fillna(0, ["pending", "failed", "model_stale"])
    some = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    stale = some("model_stale", " files have chunks of another embedding model and are left out: reindex in full")
    parts = F.array(some("pending", " files are not indexed yet: results may be incomplete"), some("failed", " files could not be indexed and are missing: see the failure log"), stale)
    notices = (
        F.when(F.col("error").isNotNull(), F.array("error"))
        .when(F.col("notice") == "no_candidates", F.array_compact(F.array(F.lit("no chunk matches the query by meaning or by word"), stale)))
        .when(F.col("result_count") == 0, F.array(F.lit("chunks match, but none passes the least score")))
        .otherwise(F.array_compact(parts))
    )
    mode = F.when(F.col("error").isNotNull() | (F.col("result_count") == 0), F.lit(None)).when(F.col("model_stale") > 0, "full").when(F.col("pending") + F.col("failed") > 0, "changed_only")
    return rows.withColumns({"notices": notices, "reindex_mode": mode, "index_fresh": F.coalesce("index_fresh", F.lit(False))})


def answer_queries(queries: DataFrame, chunks: DataFrame, files: DataFrame, vaults: DataFrame, model: str, at: Column, latency_ms: Column | None = None, min_score: float = 0.0, **options) -> dict[str, DataFrame]:
    """The whole search: checks, hybrid search, evidence notices, log rows.

    queries: query_id, vault_id, query, query_embedding, top_k, min_score and any
    of FILTERS. Gives ``results``, ``outcomes`` (a row per query, rejected ones
    with their error and no counts) and ``log`` (a row per query that was
    searched; clock and latency as given).
    """
    good, bad = checked_queries(effective_filters(queries), vaults)
    good = written(queries.sparkSession, good, "asked")
    results, counted = hybrid_search(good, chunks, files, model, min_score=min_score, **options)
    results = written(queries.sparkSession, results, "results")
    done = good.select("query_id", "vault_id", F.lit(None).cast("string").alias("error")).join(counted, "query_id")
    refused = bad.select("query_id", "vault_id", "error", *[F.lit(None).cast(t).alias(c) for c, t in counted.dtypes if c not in ("query_id", "notice")], F.lit("rejected").alias("notice"))
    outcomes = evidence(done.unionByName(refused), M.index_status(vaults, files, chunks, model))
    return {"results": results, "outcomes": outcomes, "log": M.search_log_rows(good, results, at, latency_ms, min_score)}


def evaluate(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Per golden query (query_id, expected_sources): recall and reciprocal rank of results (query_id, rank, source_path).

    Expected sources that are named twice count twice; queries without results score 0.
    """
    expected = golden.select("query_id", F.posexplode("expected_sources").alias("i", "source_path"))
    best = results.groupBy("query_id", "source_path").agg(F.min("rank").alias("rank"))
    joined = expected.join(best, ["query_id", "source_path"], "left")
    return joined.groupBy("query_id").agg(
        F.round(F.count("rank") / F.count("*"), 4).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)), 4).alias("reciprocal_rank")
    )


def evaluation_report(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("mean_recall"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"))
