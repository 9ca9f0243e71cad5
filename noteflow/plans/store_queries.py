"""Queries of search, evaluation, the revision log, device sync, maintenance and indexing with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.functions import notes as N
from noteflow.operators import indexing as I
from noteflow.operators import maintenance as M
from noteflow.operators import reconcile as C
from noteflow.operators import revisions as V
from noteflow.operators import search as S
from noteflow.plans.registry import query
from noteflow.sources import tables as IO
from noteflow.sources.scratch import new_folder
from noteflow.streaming import streams as ST

MODEL = "bge-m3"
FRESH = """fresh AS (SELECT c.* FROM fx_chunks c JOIN fx_files f ON f.vault_id = c.vault_id AND f.source_path = c.source_path AND f.content_hash = c.content_hash
  WHERE c.embedding IS NOT NULL AND c.embedding_model = 'bge-m3' AND NOT f.deleted AND f.index_status = 'indexed')"""
POOL = FRESH + ", pool AS (SELECT * FROM fresh WHERE status = 'current')"
SCORED = """scored AS (SELECT query_id, chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query_embedding AS DOUBLE[])) AS score FROM fx_asked q JOIN pool c ON c.vault_id = q.vault_id),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS vector_rank FROM scored WHERE score IS NOT NULL) WHERE vector_rank <= 50)"""
TERMS = r"""words AS (SELECT chunk_id, vault_id, regexp_extract_all(lower(concat_ws(' ', title, translate(source_path, '/.', '  '), array_to_string(coalesce(tags, []), ' '), content)), '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*') AS w FROM pool),
terms AS (SELECT chunk_id, vault_id, unnest(w || flatten([string_split(x, '-') for x in w if contains(x, '-')])) AS term FROM words),
tf AS (SELECT q.query_id, t.chunk_id, count(*) AS n FROM terms t JOIN fx_asked q ON q.vault_id = t.vault_id AND q.query = t.term GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_value DESC, chunk_id) AS lexical_rank FROM (SELECT query_id, chunk_id, round(list_sum([1.0 / (i * i) for i in range(1, n + 1)]), 9) AS rank_value FROM tf)) WHERE lexical_rank <= 50)"""
FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vector_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id) AS fused_rank FROM (
  SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id, vector_rank, lexical_rank,
  round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 12) AS rrf, CASE WHEN lexical_rank IS NULL THEN 'vector' WHEN vector_rank IS NULL THEN 'lexical' ELSE 'both' END AS matched_by
  FROM vec v FULL JOIN lex l ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id))"""
RANKED = """kept AS (SELECT f.*, p.source_path, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query_embedding AS DOUBLE[])), 6) AS score FROM fused f JOIN pool p ON p.chunk_id = f.chunk_id JOIN fx_asked q ON q.query_id = f.query_id),
passed AS (SELECT * FROM kept WHERE matched_by <> 'vector' OR score >= 0.05),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY fused_rank) AS place FROM passed) WHERE place <= 2),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM cap) WHERE rank <= 5)"""
ALL_LEGS = f"WITH {POOL}, {SCORED}, {TERMS}, {FUSED}"
AT = ("chunks", "files", "asked")


def pool(t) -> DataFrame:
    return S.fresh_chunks(t("chunks"), t("files"), MODEL).where(S.metadata_filter())


def searched(t) -> tuple[DataFrame, DataFrame]:
    return S.hybrid_search(t("asked"), t("chunks"), t("files"), MODEL, min_score=0.05)


@query("jn01_fresh_chunks", "chunks", "files", sql=f"WITH {FRESH} SELECT chunk_id, source_path FROM fresh")
def _(t):
    return S.fresh_chunks(t("chunks"), t("files"), MODEL).select("chunk_id", "source_path")


@query("tk01_vector_leg", *AT, sql=f"WITH {POOL}, {SCORED} SELECT query_id, chunk_id, round(score, 6) AS score, vector_rank FROM vec")
def _(t):
    return S.block_vector_leg(t("asked"), pool(t)).withColumn("score", F.round("score", 6))


@query("ud03_block_vector_leg", *AT, sql=f"WITH {POOL}, {SCORED} SELECT query_id, chunk_id, round(score, 6) AS score, vector_rank FROM vec")
def _(t):
    return S.block_vector_leg(t("asked"), pool(t)).withColumn("score", F.round("score", 6))


@query("tk02_lexical_leg", *AT, sql=f"WITH {POOL}, {TERMS} SELECT query_id, chunk_id, rank_value, lexical_rank FROM lex")
def _(t):
    return S.lexical_leg(t("asked"), pool(t))


@query("ag08_fusion", *AT, sql=ALL_LEGS + " SELECT query_id, chunk_id, rrf, matched_by, fused_rank FROM fused")
def _(t):
    p = pool(t)
    return S.fused(S.block_vector_leg(t("asked"), p), S.lexical_leg(t("asked"), p)).select("query_id", "chunk_id", "rrf", "matched_by", "fused_rank")


@query("jb02_hybrid_search", *AT, sql=f"{ALL_LEGS}, {RANKED} SELECT query_id, rank, chunk_id, source_path, score, matched_by, rrf FROM ranked")
def _(t):
    return searched(t)[0]


OWN_LIMITS = RANKED.replace("score >= 0.05", "query_id // 50 % 3 = 0 OR score >= query_id // 50 % 3 * 0.05").replace("rank <= 5", "rank <= query_id // 50 % 10 + 1")


@query("jb02_own_limits", *AT, sql=f"{ALL_LEGS}, {OWN_LIMITS} SELECT query_id, rank, chunk_id, source_path, score, matched_by, rrf FROM ranked")
def _(t):
    queries = t("asked").withColumns({"top_k": F.expr("query_id div 50 % 10 + 1"), "min_score": F.expr("query_id div 50 % 3 * 0.05D")})
    return S.hybrid_search(queries, t("chunks"), t("files"), MODEL)[0]


def syntax(pool: str = "pool") -> str:
    """Lexical leg of fx_asks in SQL: each form of query tried on the terms as one text, so that phrases are parts of it."""
    gain = lambda w: f"coalesce(list_sum([1.0 / (i * i) for i in range(1, 1 + len(list_filter(t, lambda x: x = {w})))]), 0)"
    total = lambda *w: f"(SELECT coalesce(sum(g), 0) / greatest(count(*), 1) FROM (SELECT DISTINCT w, {gain('w')} AS g FROM (SELECT unnest([{', '.join(w)}]) AS w)))"
    return rf"""words AS (SELECT chunk_id, vault_id, regexp_extract_all(lower(concat_ws(' ', title, translate(source_path, '/.', '  '), array_to_string(coalesce(tags, []), ' '), content)), '[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)*') AS w FROM {pool}),
placed AS (SELECT chunk_id, vault_id, t, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT chunk_id, vault_id, flatten([CASE WHEN contains(x, '-') THEN [x] || string_split(x, '-') ELSE [x] END for x in w]) AS t FROM words)),
hits AS (SELECT q.*, p.chunk_id, t, s, contains(s, ' ' || w1 || ' ') AS h1, contains(s, ' ' || w2 || ' ') AS h2, contains(s, ' ' || w3 || ' ') AS h3, contains(s, ' ' || w1 || ' ' || w2 || ' ') AS h12, contains(s, ' ' || w2 || ' ' || w1 || ' ') AS h21
  FROM fx_asks q JOIN placed p ON p.vault_id = q.vault_id),
held AS (SELECT query_id, chunk_id, round(CASE query_id % 6 WHEN 2 THEN {total("w1", "w3")} WHEN 3 THEN {total("w1")} WHEN 4 THEN {total("w1", "w2", "w3")} WHEN 5 THEN 0 ELSE {total("w1", "w2")} END, 9) AS rank_value FROM hits
  WHERE CASE query_id % 6 WHEN 0 THEN h1 AND h2 WHEN 1 THEN h12 WHEN 2 THEN h1 OR h3 WHEN 3 THEN h1 AND NOT h2 WHEN 4 THEN h21 OR (NOT h12 AND h3) ELSE NOT h1 END)"""


LEX = "lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_value DESC, chunk_id) AS lexical_rank FROM held) WHERE lexical_rank <= 50)"
ASKS = ("chunks", "files", "asks")
MANY = f"WITH {POOL}, {SCORED}, {syntax()}, {LEX}, {FUSED}, {RANKED}".replace("fx_asked", "fx_asks")


def plain_asks(t) -> DataFrame:
    return t("asks").select("query_id", "vault_id", "query", "query_embedding")


@query("tk02_query_syntax", *ASKS, sql=f"WITH {POOL}, {syntax()}, {LEX} SELECT query_id, chunk_id, rank_value, lexical_rank FROM lex")
def _(t):
    return S.lexical_leg(plain_asks(t), pool(t))


@query("jb02_many_queries", *ASKS, sql=f"{MANY} SELECT query_id, rank, chunk_id, source_path, score, matched_by, rrf FROM ranked")
def _(t):
    return S.hybrid_search(plain_asks(t), t("chunks"), t("files"), MODEL, min_score=0.05)[0]


# Queries with filters, limits and errors: the legs over what each query's filters leave.
CHECKED = """asked AS (SELECT q.* REPLACE (coalesce(top_k, 5) AS top_k), coalesce(min_score, 0.05) AS least, list_distinct(list_filter([trim(x) for x in coalesce(f_tags, [])], lambda x: x <> '')) AS tags, nullif(trim(f_domain), '') AS dom,
    coalesce(f_status, ['current']) AS sts, v.vault_id IS NOT NULL AS known,
    CASE WHEN list_contains(coalesce(f_visibility, []), 'secret') THEN 'filter visibility has an unsupported value' WHEN coalesce(top_k, 5) NOT BETWEEN 1 AND 10 THEN 'top_k must be between 1 and 10'
         WHEN min_score NOT BETWEEN 0 AND 1 THEN 'min_score must be between 0 and 1' WHEN v.vault_id IS NULL THEN 'vault not found' END AS error
  FROM fx_asks q LEFT JOIN (SELECT vault_id FROM fx_vaults WHERE is_active) v ON v.vault_id = q.vault_id),
good AS (SELECT * FROM asked WHERE error IS NULL),
allowed AS (SELECT query_id, chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query_embedding AS DOUBLE[])) AS score, c.source_path FROM good q JOIN fresh c ON c.vault_id = q.vault_id
  WHERE (len(sts) = 0 OR list_contains(sts, c.status)) AND (f_type IS NULL OR list_contains(f_type, c.type)) AND (f_priority IS NULL OR list_contains(f_priority, c.priority)) AND (f_visibility IS NULL OR list_contains(f_visibility, c.visibility))
    AND (len(q.tags) = 0 OR coalesce(list_has_any(q.tags, c.tags), false)) AND (dom IS NULL OR dom = c.domain) AND (f_project IS NULL OR f_project = c.project)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS vector_rank FROM allowed WHERE score IS NOT NULL) WHERE vector_rank <= 50)"""
ANSWERED = f"""WITH {FRESH}, {CHECKED}, {syntax("fresh")}, {LEX.replace("FROM held", "FROM held JOIN (SELECT query_id, chunk_id FROM allowed) USING (query_id, chunk_id)")}, {FUSED},
passed AS (SELECT f.*, a.source_path, round(a.score, 6) AS score FROM fused f JOIN allowed a ON a.query_id = f.query_id AND a.chunk_id = f.chunk_id JOIN good q ON q.query_id = f.query_id WHERE least <= 0 OR matched_by <> 'vector' OR round(a.score, 6) >= least),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY fused_rank) AS place FROM passed) WHERE place <= 2),
ranked AS (SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM cap) r JOIN good q ON q.query_id = r.query_id WHERE rank <= top_k)"""
ANSWERS = (*ASKS, "vaults")


def answered(t) -> dict[str, DataFrame]:
    at = F.timestamp_seconds(F.lit(1706745600) + F.col("query_id") % 1000)
    return S.answer_queries(t("asks"), t("chunks"), t("files"), t("vaults"), MODEL, at, F.col("query_id") % 997, min_score=0.05)


@query("jb02_answers", *ANSWERS, sql=f"{ANSWERED} SELECT query_id, rank, chunk_id, source_path, score, matched_by, rrf FROM ranked")
def _(t):
    return answered(t)["results"]


@query("ag10_evidence", *ANSWERS, sql=f"""{ANSWERED},
live AS (SELECT vault_id, count(*) FILTER (index_status = 'pending') AS pending, count(*) FILTER (index_status = 'failed') AS failed FROM fx_files WHERE vectorize AND NOT deleted GROUP BY vault_id),
stale AS (SELECT vault_id, count(*) AS model_stale FROM fx_files f WHERE vectorize AND NOT deleted AND index_status = 'indexed' AND EXISTS (SELECT 1 FROM fx_chunks c WHERE c.vault_id = f.vault_id AND c.source_path = f.source_path AND c.content_hash = f.content_hash AND c.embedding_model <> 'bge-m3') GROUP BY vault_id),
counted AS (SELECT q.query_id, q.vault_id, q.error, v.vault_id IS NOT NULL AS any_vault, coalesce(pending, 0) AS pending, coalesce(failed, 0) AS failed, coalesce(model_stale, 0) AS model_stale,
  CASE WHEN error IS NULL THEN (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) END AS candidate_count, CASE WHEN error IS NULL THEN (SELECT count(*) FROM ranked r WHERE r.query_id = q.query_id) END AS result_count
  FROM asked q LEFT JOIN fx_vaults v ON v.vault_id = q.vault_id LEFT JOIN live l ON l.vault_id = v.vault_id LEFT JOIN stale s ON s.vault_id = v.vault_id)
SELECT query_id, vault_id, error, candidate_count, result_count, pending, failed, model_stale, any_vault AND pending + failed + model_stale = 0 AS index_fresh, candidate_count = 0 AS no_candidates, candidate_count > 0 AND result_count = 0 AS low_confidence,
  CASE WHEN error IS NOT NULL THEN 'rejected' WHEN candidate_count = 0 THEN 'no_candidates' WHEN result_count = 0 THEN 'low_confidence' ELSE 'ok' END AS notice,
  CASE WHEN result_count > 0 THEN CASE WHEN model_stale > 0 THEN 'full' WHEN pending + failed > 0 THEN 'changed_only' END END AS reindex_mode,
  list_filter(CASE WHEN error IS NOT NULL THEN [error] WHEN candidate_count = 0 THEN ['no chunk matches the query by meaning or by word', CASE WHEN model_stale > 0 THEN model_stale || ' files have chunks of another embedding model and are left out: reindex in full' END]
    WHEN result_count = 0 THEN ['chunks match, but none passes the least score'] ELSE [CASE WHEN pending > 0 THEN pending || ' files are not indexed yet: results may be incomplete' END, CASE WHEN failed > 0 THEN failed || ' files could not be indexed and are missing: see the failure log' END,
      CASE WHEN model_stale > 0 THEN model_stale || ' files have chunks of another embedding model and are left out: reindex in full' END] END, lambda x: x IS NOT NULL) AS notices FROM counted""")
def _(t):
    return answered(t)["outcomes"]


@query("io10_search_log", *ANSWERS, sql=f"""{ANSWERED} SELECT CAST(query_id AS VARCHAR) AS request_id, vault_id, query, top_k, query_id % 997 AS latency_ms, (SELECT count(*) FROM ranked r WHERE r.query_id = q.query_id) AS result_count,
  TIMESTAMP '2024-02-01 00:00:00' + to_seconds(query_id % 1000) AS created_at, sts AS status, coalesce(f_priority, []) AS priority, tags AS tag_list, dom AS domain, f_project AS project, CAST(least AS DOUBLE) AS min_score
  FROM (SELECT * REPLACE (list_distinct(sts) AS sts) FROM good) q""".replace("list_distinct(sts)", "CASE WHEN len(sts) = 3 THEN ['current', 'draft'] ELSE sts END").replace("tags AS tag_list", "CASE WHEN len(tags) = 2 THEN ['en', 'fr'] ELSE [] END AS tag_list"))
def _(t):
    log = answered(t)["log"]
    path = new_folder(log.sparkSession, "search_log")
    M.append_search_log(log.where("query_id % 2 = 0" if "query_id" in log.columns else "CAST(request_id AS LONG) % 2 = 0"), path)
    M.append_search_log(log.where("CAST(request_id AS LONG) % 2 = 1"), path)
    filters = F.from_json("filters", "status array<string>, priority array<string>, tags array<string>, domain string, project string, min_score double")
    rows = log.sparkSession.read.parquet(path).withColumn("f", filters)
    return rows.select("request_id", "vault_id", "query", "top_k", "latency_ms", "result_count", "created_at", "f.status", "f.priority", F.col("f.tags").alias("tag_list"), "f.domain", "f.project", "f.min_score")


@query("ag10_outcome", *AT, sql=f"""{ALL_LEGS}, {RANKED} SELECT query_id, candidate_count, result_count, candidate_count = 0 AS no_candidates, candidate_count > 0 AND result_count = 0 AS low_confidence,
  CASE WHEN candidate_count = 0 THEN 'no_candidates' WHEN result_count = 0 THEN 'low_confidence' ELSE 'ok' END AS notice FROM (
  SELECT q.query_id, (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) AS candidate_count, (SELECT count(*) FROM ranked r WHERE r.query_id = q.query_id) AS result_count FROM fx_asked q)""")
def _(t):
    return searched(t)[1]


@query("wn04_source_cap", *AT, sql=f"WITH {POOL}, {SCORED} SELECT query_id, chunk_id FROM (SELECT v.*, row_number() OVER (PARTITION BY query_id, source_path ORDER BY vector_rank) AS n FROM vec v JOIN pool p ON p.chunk_id = v.chunk_id) WHERE n <= 2")
def _(t):
    p = pool(t)
    rows = S.block_vector_leg(t("asked"), p).join(p.select("chunk_id", "source_path"), "chunk_id")
    return S.capped(rows, 2, "vector_rank").select("query_id", "chunk_id")


@query("ud04_rerank", *AT, sql=f"WITH {POOL}, {SCORED} SELECT query_id, chunk_id, CAST(CASE WHEN vector_rank <= m THEN m + 1 - vector_rank ELSE vector_rank END AS INT) AS rank FROM (SELECT *, least(15, count(*) OVER (PARTITION BY query_id)) AS m FROM vec)")
def _(t):
    backwards = lambda q, texts: str(list(range(len(texts), 0, -1)))
    rows = S.block_vector_leg(t("asked"), pool(t)).withColumnRenamed("vector_rank", "fused_rank").join(t("chunks").select("chunk_id", "content"), "chunk_id").withColumn("query", F.lit("q"))
    return S.reranked(rows, backwards).select("query_id", "chunk_id", "rank")


@query("jb03_evaluate", "golden", sql="""WITH expected AS (SELECT query_id, expected_source FROM fx_golden),
results AS (SELECT query_id, expected_source AS source_path, doc_id % 4 + 1 AS rank FROM fx_golden WHERE doc_id % 3 <> 0)
SELECT query_id, round(count(rank) / count(*), 4) AS recall, round(coalesce(1.0 / min(rank), 0), 4) AS reciprocal_rank FROM expected e LEFT JOIN results r USING (query_id) WHERE r.source_path IS NULL OR true GROUP BY query_id""".replace(
    "LEFT JOIN results r USING (query_id) WHERE r.source_path IS NULL OR true", "LEFT JOIN (SELECT query_id AS q, source_path, min(rank) AS rank FROM results GROUP BY ALL) r ON r.q = e.query_id AND r.source_path = e.expected_source"))
def _(t):
    return S.evaluate(*golden_results(t))


def golden_results(t) -> tuple[DataFrame, DataFrame]:
    g = t("golden")
    results = g.where("doc_id % 3 <> 0").select("query_id", F.col("expected_source").alias("source_path"), (F.col("doc_id") % 4 + 1).alias("rank"))
    return g.groupBy("query_id").agg(F.collect_list("expected_source").alias("expected_sources")), results


@query("ag06_evaluation_report", "golden", sql="""WITH per AS (SELECT query_id, round(count(rank) / count(*), 4) AS recall, round(coalesce(1.0 / min(rank), 0), 4) AS rr FROM (
  SELECT query_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 + 1 END AS rank FROM fx_golden) GROUP BY query_id) SELECT count(*) AS queries, round(avg(recall), 4) AS mean_recall, round(avg(rr), 4) AS mrr FROM per""")
def _(t):
    return S.evaluation_report(S.evaluate(*golden_results(t)))


@query("jn17_active_vaults", "asked", "vaults", sql="SELECT query_id FROM fx_asked q WHERE EXISTS (SELECT 1 FROM fx_vaults v WHERE v.vault_id = q.vault_id AND v.is_active)")
def _(t):
    return t("asked").join(t("vaults").where("is_active"), "vault_id", "left_semi").select("query_id")


# revision log


@query("wn05_latest_per_path", "sync_events", sql="SELECT vault_id, source_path, revision, event_type, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, source_path ORDER BY revision DESC) AS n FROM fx_sync_events) WHERE n = 1")
def _(t):
    return V.latest_per_path(t("sync_events")).select("vault_id", "source_path", "revision", "event_type", "content_hash")


@query("jb05_snapshot_at", "sync_events", sql="SELECT vault_id, source_path, revision, deleted FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, source_path ORDER BY revision DESC) AS n FROM fx_sync_events WHERE revision <= 300) WHERE n = 1")
def _(t):
    return V.latest_per_path(t("sync_events"), 300).select("vault_id", "source_path", "revision", "deleted")


@query("tk04_change_feed", "sync_events", "cursors", sql="SELECT vault_id, to_device, revision, source_path FROM (SELECT e.vault_id, c.device_id AS to_device, e.revision, e.source_path, row_number() OVER (PARTITION BY e.vault_id, c.device_id ORDER BY e.revision) AS n FROM fx_sync_events e JOIN fx_cursors c ON c.vault_id = e.vault_id WHERE e.revision > c.cursor) WHERE n <= 100")
def _(t):
    return V.change_feed(t("sync_events"), t("cursors"), 100).select("vault_id", "to_device", "revision", "source_path")


@query("tk04_cursors", "sync_events", "cursors", sql="SELECT c.vault_id, c.device_id, least(c.cursor + 100, top) AS to_cursor FROM fx_cursors c JOIN (SELECT vault_id, max(revision) AS top FROM fx_sync_events GROUP BY vault_id) m ON m.vault_id = c.vault_id")
def _(t):
    return V.advanced_cursors(V.change_feed(t("sync_events"), t("cursors"), 100), t("cursors"))


@query("jn08_version_lookup", "versions", sql="SELECT vault_id, source_path, revision, content FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, source_path ORDER BY revision DESC) AS n FROM fx_versions) WHERE n = 1")
def _(t):
    asked = t("versions").select("vault_id", "source_path").distinct().withColumn("revision", F.lit(None).cast("long"))
    return V.version_lookup(t("versions"), asked).select("vault_id", "source_path", "revision", "content")


@query("jn09_verified_read", "half_log", "versions", sql="""WITH stored AS (SELECT vault_id, source_path, CASE WHEN revision % 3 = 0 THEN sha256('torn') ELSE content_hash END AS stored_hash FROM fx_half_log WHERE revision % 5 <> 0),
latest AS (SELECT vault_id, source_path, max(revision) AS v FROM fx_versions GROUP BY ALL), r AS (SELECT f.*, stored_hash, v FROM fx_half_log f LEFT JOIN stored s USING (vault_id, source_path) LEFT JOIN latest l USING (vault_id, source_path)),
o AS (SELECT *, CASE WHEN deleted THEN 'not_found' WHEN stored_hash IS NULL THEN 'missing' WHEN stored_hash = content_hash THEN 'disk' WHEN source_path LIKE '%.md' AND v IS NOT NULL THEN 'version' ELSE 'mismatch' END AS source FROM r)
SELECT vault_id, source_path, source, CASE WHEN source = 'version' THEN v END AS version_revision FROM o""")
def _(t):
    files = t("half_log")
    stored = files.where("revision % 5 <> 0").select("vault_id", "source_path", F.expr("CASE WHEN revision % 3 = 0 THEN sha2('torn', 256) ELSE content_hash END").alias("stored_hash"))
    return V.verified_read(files, stored, t("versions"))


@query("wn01_backfill", "files", "vaults", sql="SELECT f.id, f.vault_id, v.current_revision + row_number() OVER (PARTITION BY f.vault_id ORDER BY f.id) AS revision FROM fx_files f JOIN fx_vaults v ON v.vault_id = f.vault_id WHERE NOT f.deleted")
def _(t):
    return V.backfill(t("files").drop("revision"), t("vaults"))[0].select("id", "vault_id", "revision")


@query("jb09_backfill_counters", "files", "vaults", sql="SELECT v.vault_id, v.current_revision + coalesce(n, 0) AS current_revision FROM fx_vaults v LEFT JOIN (SELECT vault_id, count(*) AS n FROM fx_files WHERE NOT deleted GROUP BY vault_id) f ON f.vault_id = v.vault_id")
def _(t):
    return V.backfill(t("files").drop("revision"), t("vaults"))[2]


def half_vaults(t) -> DataFrame:
    return t("sync_events").groupBy("vault_id").agg(F.floor(F.max("revision") / 2).alias("current_revision"))


def admitted(t) -> DataFrame:
    known = t("versions").join(half_vaults(t), "vault_id").where("revision <= current_revision").drop("current_revision")
    return V.admit_writes(t("requests"), t("half_log"), known, half_vaults(t))


def fold_sql(good: str) -> str:
    """The fold of the requests in ``good`` as a recursion over each path's requests, and the numbers of the accepted ones."""
    return f"""half AS (SELECT vault_id, CAST(floor(max(revision) / 2) AS BIGINT) AS current_revision FROM fx_sync_events GROUP BY vault_id),
stored AS (SELECT v.vault_id, v.source_path, v.revision, v.content_hash FROM fx_versions v JOIN half USING (vault_id) WHERE v.revision <= half.current_revision),
lined AS (SELECT *, row_number() OVER (PARTITION BY vault_id, source_path ORDER BY seq) AS k FROM {good}),
fold(vault_id, source_path, k, rev, hash, gone, latest, seq, kind, base, decision, event_type, content, seen) AS (
  SELECT p.vault_id, p.source_path, 0::BIGINT, h.revision, h.content_hash, coalesce(h.deleted, false), (SELECT arg_max(s.content_hash, s.revision) FROM stored s WHERE s.vault_id = p.vault_id AND s.source_path = p.source_path), NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT
  FROM (SELECT DISTINCT vault_id, source_path FROM lined) p LEFT JOIN fx_half_log h ON h.vault_id = p.vault_id AND h.source_path = p.source_path
  UNION ALL
  SELECT vault_id, source_path, k, CASE WHEN event_type IS NULL THEN rev ELSE -seq END, CASE WHEN event_type IS NULL THEN hash ELSE content END, CASE WHEN event_type IS NULL THEN gone ELSE event_type = 'DELETE' END,
    CASE WHEN event_type <> 'DELETE' AND source_path LIKE '%.md' THEN content ELSE latest END, seq, kind, base, decision, event_type, content, CASE WHEN decision = 'conflict' THEN coalesce(rev, 0) END FROM (
    SELECT *, CASE WHEN decision <> 'accepted' THEN NULL WHEN kind IN ('DELETE', 'RESTORE') THEN kind WHEN live THEN 'UPDATE' ELSE 'CREATE' END AS event_type,
      CASE WHEN decision <> 'accepted' THEN NULL WHEN kind = 'DELETE' THEN hash WHEN kind = 'RESTORE' THEN wanted ELSE asked END AS content FROM (
      SELECT *, CASE kind WHEN 'PUT' THEN CASE WHEN base = 0 AND NOT live THEN 'accepted' WHEN NOT live OR base <> rev THEN 'conflict' WHEN asked = hash THEN 'replay' ELSE 'accepted' END
          WHEN 'FORCE' THEN CASE WHEN live AND asked = hash THEN 'noop' ELSE 'accepted' END
          WHEN 'DELETE' THEN CASE WHEN NOT live THEN 'not_found' WHEN base <> rev THEN 'conflict' ELSE 'accepted' END
          ELSE CASE WHEN live THEN 'rejected' WHEN rev IS NULL OR wanted IS NULL THEN 'not_found' ELSE 'accepted' END END AS decision FROM (
        SELECT f.vault_id, f.source_path, l.k, f.rev, f.hash, f.gone, f.latest, l.seq, l.kind, coalesce(l.base_revision, 0) AS base, l.content_hash AS asked, f.rev IS NOT NULL AND NOT f.gone AS live,
          CASE WHEN l.restore_revision IS NULL THEN f.latest ELSE (SELECT max(s.content_hash) FROM stored s WHERE s.vault_id = f.vault_id AND s.source_path = f.source_path AND s.revision = l.restore_revision) END AS wanted
        FROM fold f JOIN lined l ON l.vault_id = f.vault_id AND l.source_path = f.source_path AND l.k = f.k + 1) a) b) c),
given AS (SELECT f.*, current_revision + row_number() OVER (PARTITION BY vault_id ORDER BY seq) AS revision FROM fold f JOIN half USING (vault_id) WHERE decision = 'accepted'),
decided AS (SELECT f.vault_id, f.source_path, f.seq, f.kind, f.base, f.decision, f.event_type, f.content AS content_hash, g.revision, CASE WHEN f.seen < 0 THEN s.revision ELSE f.seen END AS server_revision
  FROM fold f LEFT JOIN given g ON g.vault_id = f.vault_id AND g.seq = f.seq LEFT JOIN given s ON s.vault_id = f.vault_id AND s.seq = -f.seen WHERE f.k > 0),
after AS (SELECT vault_id, source_path, max(revision) AS revision, arg_max(content_hash, revision) AS content_hash, arg_max(event_type, revision) = 'DELETE' AS deleted FROM decided WHERE decision = 'accepted' GROUP BY ALL),
state AS (SELECT vault_id, source_path, revision, content_hash, deleted, CASE WHEN deleted OR NOT source_path LIKE '%.md' THEN 'skipped' ELSE 'pending' END AS index_status FROM after
  UNION ALL SELECT vault_id, source_path, revision, content_hash, deleted, 'indexed' FROM fx_half_log h WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.vault_id = h.vault_id AND a.source_path = h.source_path))"""


LOG = ("sync_events", "half_log", "versions")
PLAIN = f"WITH RECURSIVE {fold_sql('fx_requests')}"
CHECKED_WRITES = """checked AS (SELECT *, trim(source_path) AS path, CASE WHEN vault_id = 'v99' THEN 'vault not found' WHEN source_path LIKE '../%' THEN 'source path cannot contain empty or traversal parts'
    WHEN kind IN ('PUT', 'FORCE') THEN CASE WHEN source_path LIKE '.trash/%' THEN 'source path is ignored' WHEN source_path LIKE '%.zip' THEN 'file extension is explicitly excluded' WHEN n_bytes < 0 THEN 'file size cannot be negative' WHEN n_bytes > 50000000 THEN 'file exceeds size limit' END END AS error FROM fx_writes),
fit AS (SELECT * REPLACE (path AS source_path) FROM checked WHERE error IS NULL)"""
WHOLE = f"WITH RECURSIVE {CHECKED_WRITES}, {fold_sql('fit')}"
WRITES = (*LOG, "writes")


@query("jb04_admit_writes", *LOG, "requests", sql=f"{PLAIN} SELECT vault_id, source_path, seq, kind, decision, event_type, content_hash, base AS base_revision, revision, server_revision FROM decided")
def _(t):
    return admitted(t)


@query("jb04_applied_state", *LOG, "requests", sql=f"{PLAIN} SELECT * FROM state")
def _(t):
    return V.applied_state(t("half_log").withColumn("index_status", F.lit("indexed")), admitted(t))


def admission(t) -> dict[str, DataFrame]:
    known = t("versions").join(half_vaults(t), "vault_id").where("revision <= current_revision").drop("current_revision")
    return V.admission(t("writes"), t("half_log").withColumn("index_status", F.lit("indexed")), known, half_vaults(t))


@query("jb04_decisions", *WRITES, sql=f"{WHOLE} SELECT vault_id, source_path, seq, kind, decision, NULL AS error, event_type, content_hash, revision, server_revision FROM decided UNION ALL SELECT vault_id, source_path, seq, kind, 'invalid', error, NULL, NULL, NULL, NULL FROM checked WHERE error IS NOT NULL")
def _(t):
    return admission(t)["decisions"]


@query("jb04_events", *WRITES, sql=f"""{WHOLE} SELECT d.vault_id, d.revision, d.source_path, d.event_type, d.content_hash, d.event_type = 'DELETE' AS deleted, w.device_id, CASE WHEN d.kind IN ('PUT', 'FORCE') THEN w.origin END AS origin
  FROM decided d JOIN fx_writes w ON w.vault_id = d.vault_id AND w.seq = d.seq WHERE decision = 'accepted'""")
def _(t):
    return admission(t)["events"]


@query("jb04_versions", *WRITES, sql=f"""{WHOLE} SELECT d.vault_id, d.revision, d.source_path, d.event_type, d.content_hash, w.device_id FROM decided d JOIN fx_writes w ON w.vault_id = d.vault_id AND w.seq = d.seq
  WHERE decision = 'accepted' AND d.event_type <> 'DELETE' AND d.source_path LIKE '%.md'""")
def _(t):
    return admission(t)["versions"]


@query("jb04_conflicts", *WRITES, sql=f"""{WHOLE} SELECT d.vault_id, d.source_path, d.seq, d.server_revision, d.base AS client_base_revision, w.device_id,
  CASE WHEN EXISTS (SELECT 1 FROM decided a WHERE a.vault_id = d.vault_id AND a.source_path = d.source_path AND a.decision = 'accepted' AND a.seq > d.seq) THEN 'RESOLVED' ELSE 'OPEN' END AS status
  FROM decided d JOIN fx_writes w ON w.vault_id = d.vault_id AND w.seq = d.seq WHERE decision = 'conflict'""")
def _(t):
    return admission(t)["conflicts"]


@query("jb04_files", *WRITES, sql=f"{WHOLE} SELECT * FROM state")
def _(t):
    return admission(t)["files"]


@query("wn08_resolved_conflicts", "conflicts", "sync_events", sql="""SELECT c.id, CASE WHEN c.status = 'OPEN' AND last > c.seq THEN 'RESOLVED' ELSE c.status END AS status FROM fx_conflicts c
  LEFT JOIN (SELECT vault_id, source_path, max(revision) AS last FROM fx_sync_events WHERE event_type IN ('CREATE', 'DELETE') GROUP BY ALL) a ON a.vault_id = c.vault_id AND a.source_path = c.source_path""")
def _(t):
    accepted = t("sync_events").where("event_type IN ('CREATE', 'DELETE')").withColumnRenamed("revision", "seq")
    return V.resolved_conflicts(t("conflicts"), accepted).select("id", "status")


@query("jn15_precheck_saves", "requests", "half_log", sql="""WITH r AS (SELECT q.vault_id, q.source_path, q.seq, seq % 5 = 0 AS overwrite, seq % 10 = 0 AS allowed, CASE WHEN seq % 3 = 0 THEN base_revision END AS base_revision, q.content_hash, CAST(seq % 50 * 100000 AS BIGINT) AS n_bytes FROM fx_requests q),
j AS (SELECT r.*, f.content_hash AS live_hash, CASE WHEN f.revision % 7 = 0 THEN 'x' ELSE f.content_hash END AS stored_hash FROM r LEFT JOIN (SELECT * FROM fx_half_log WHERE NOT deleted) f ON f.vault_id = r.vault_id AND f.source_path = r.source_path),
d AS (SELECT *, CASE WHEN overwrite AND base_revision IS NOT NULL THEN 'invalid' WHEN overwrite AND NOT allowed THEN 'forbidden' WHEN source_path NOT LIKE '%.md' OR n_bytes > 2097152 THEN 'invalid' WHEN base_revision IS NOT NULL THEN 'put'
  WHEN live_hash IS NOT NULL AND stored_hash <> live_hash THEN 'conflict' WHEN live_hash = content_hash THEN 'skipped' WHEN live_hash IS NOT NULL AND NOT overwrite THEN 'conflict' ELSE 'force_put' END AS decision FROM j)
SELECT vault_id, source_path, seq, decision, CASE WHEN decision = 'force_put' THEN CASE WHEN overwrite THEN 'mcp_overwrite' ELSE 'mcp' END END AS origin FROM d""")
def _(t):
    r = t("requests").select("vault_id", "source_path", "seq", F.expr("seq % 5 = 0").alias("overwrite"), F.expr("seq % 10 = 0").alias("allowed"), F.expr("CASE WHEN seq % 3 = 0 THEN base_revision END").alias("base_revision"), "content_hash", F.expr("seq % 50 * 100000").alias("n_bytes"))
    stored = t("half_log").where("NOT deleted").select("vault_id", "source_path", F.expr("CASE WHEN revision % 7 = 0 THEN 'x' ELSE content_hash END").alias("stored_hash"))
    return V.precheck_saves(r, t("half_log"), stored)


# device sync

LOCAL = """local AS (SELECT coalesce(s.vault_id, m.vault_id) AS vault_id, coalesce(s.device_id, m.device_id) AS device_id, coalesce(s.source_path, m.source_path) AS source_path,
  CASE WHEN m.content_hash IS NULL THEN 'new' WHEN s.content_hash IS NULL THEN 'deleted' WHEN s.content_hash <> m.content_hash THEN 'modified' END AS change, s.content_hash AS local_hash, m.server_revision
  FROM fx_scan s FULL JOIN fx_manifest m ON m.vault_id = s.vault_id AND m.device_id = s.device_id AND m.source_path = s.source_path)"""
PULL = """last AS (SELECT * FROM (SELECT e.vault_id, c.device_id, e.source_path, e.revision, e.content_hash AS s_hash, e.deleted, row_number() OVER (PARTITION BY e.vault_id, c.device_id, e.source_path ORDER BY e.revision DESC) AS n FROM fx_sync_events e JOIN fx_cursors c ON c.vault_id = e.vault_id WHERE e.revision > c.cursor) WHERE n = 1),
pull AS (SELECT l.vault_id, l.device_id, l.source_path, l.revision, CASE WHEN NOT l.deleted AND m.content_hash IS NOT DISTINCT FROM l.s_hash THEN 'bump' WHEN l.deleted AND s.content_hash IS NULL THEN 'forget'
  WHEN l.deleted AND m.content_hash IS NOT NULL AND s.content_hash = m.content_hash THEN 'delete_local' WHEN l.deleted THEN 'delete_conflict'
  WHEN s.content_hash IS NOT NULL AND s.content_hash <> coalesce(m.content_hash, l.s_hash) THEN 'write_conflict' ELSE 'apply' END AS action
  FROM last l LEFT JOIN fx_manifest m ON m.vault_id = l.vault_id AND m.device_id = l.device_id AND m.source_path = l.source_path LEFT JOIN fx_scan s ON s.vault_id = l.vault_id AND s.device_id = l.device_id AND s.source_path = l.source_path)"""
PUSH = """push AS (SELECT l.vault_id, l.device_id, l.source_path, l.change, CASE WHEN change = 'deleted' AND t.server_deleted THEN 'drop_conflict' WHEN change = 'deleted' THEN 'DELETE' WHEN t.server_revision IS NOT NULL AND t.local_content_hash = l.local_hash THEN 'skip' ELSE 'PUT' END AS action,
  CASE WHEN change = 'new' THEN coalesce(t.server_revision, 0) ELSE coalesce(t.server_revision, l.server_revision) END AS base FROM local l LEFT JOIN fx_tracked t ON t.vault_id = l.vault_id AND t.device_id = l.device_id AND t.source_path = l.source_path
  WHERE change IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pull p WHERE p.vault_id = l.vault_id AND p.device_id = l.device_id AND p.source_path = l.source_path AND p.action IN ('write_conflict', 'delete_conflict')))"""
SYNC = ("sync_events", "cursors", "manifest", "scan", "tracked")


def pulled(t, policy: str = "manual") -> DataFrame:
    return C.pull_plan(t("sync_events"), t("cursors"), t("manifest"), t("scan"), policy)


def pushed(t) -> DataFrame:
    return C.push_plan(C.local_changes(t("scan"), t("manifest")), t("tracked"), pulled(t))


@query("jn03_local_changes", "scan", "manifest", sql=f"WITH {LOCAL} SELECT * FROM local WHERE change IS NOT NULL AND (change <> 'deleted' OR source_path LIKE '%.md')")
def _(t):
    return C.local_changes(t("scan"), t("manifest"), sync_attachments=False)


@query("jn13_pull_plan", *SYNC, sql=f"WITH {PULL} SELECT *, CASE action WHEN 'write_conflict' THEN 'report' WHEN 'delete_conflict' THEN 'report_deleted' END AS resolution FROM pull")
def _(t):
    return pulled(t)


@query("jn13_pull_plan_remote_wins", *SYNC, sql=f"WITH {PULL} SELECT *, CASE action WHEN 'write_conflict' THEN 'backup_and_adopt' WHEN 'delete_conflict' THEN 'backup_and_delete' END AS resolution FROM pull")
def _(t):
    return pulled(t, "remote-wins")


@query("jn14_push_plan", *SYNC, sql=f"WITH {LOCAL}, {PULL}, {PUSH} SELECT vault_id, device_id, source_path, change, action, CASE WHEN action IN ('PUT', 'DELETE') THEN base END AS base_revision FROM push")
def _(t):
    return pushed(t)


@query("ag12_sync_summary", *SYNC, sql=f"""WITH {LOCAL}, {PULL}, {PUSH} SELECT c.vault_id, c.device_id, (SELECT count(*) FROM fx_sync_events e WHERE e.vault_id = c.vault_id AND e.revision > c.cursor) AS pulled, coalesce(applied, 0) AS applied, coalesce(locally_deleted, 0) AS locally_deleted, coalesce(conflicts, 0) AS conflicts, coalesce(warnings, 0) AS warnings, coalesce(pushed, 0) AS pushed, coalesce(remotely_deleted, 0) AS remotely_deleted
  FROM fx_cursors c LEFT JOIN (SELECT vault_id, device_id, count(*) FILTER (action = 'apply') AS applied, count(*) FILTER (action = 'delete_local') AS locally_deleted, count(*) FILTER (action LIKE '%conflict') AS conflicts, 0 AS warnings FROM pull GROUP BY ALL) a USING (vault_id, device_id)
  LEFT JOIN (SELECT vault_id, device_id, count(*) FILTER (action = 'PUT') AS pushed, count(*) FILTER (action = 'DELETE') AS remotely_deleted FROM push GROUP BY ALL) b USING (vault_id, device_id)""")
def _(t):
    return C.sync_summary(pulled(t), pushed(t), t("cursors"), t("sync_events"))


@query("jn13_pull_plan_stored", *SYNC, sql=f"""WITH {PULL}, stored AS (SELECT vault_id, source_path, revision, CASE WHEN revision % 3 = 0 THEN 'torn' ELSE content_hash END AS stored_hash FROM fx_sync_events WHERE revision % 7 <> 0)
  SELECT p.vault_id, p.device_id, p.source_path, p.revision, CASE WHEN p.action IN ('write_conflict', 'apply') AND s.stored_hash IS DISTINCT FROM e.content_hash THEN 'mismatch' ELSE p.action END AS action
  FROM pull p JOIN fx_sync_events e ON e.vault_id = p.vault_id AND e.revision = p.revision LEFT JOIN stored s ON s.vault_id = p.vault_id AND s.source_path = p.source_path AND s.revision = p.revision""")
def _(t):
    last = V.latest_per_path(t("sync_events")).where("revision % 7 <> 0")
    stored = last.select("vault_id", "source_path", F.expr("CASE WHEN revision % 3 = 0 THEN 'torn' ELSE content_hash END").alias("stored_hash"))
    return C.pull_plan(t("sync_events"), t("cursors"), t("manifest"), t("scan"), stored=stored).drop("resolution")


@query("wn07_new_reports", "conflicts", sql="""WITH m AS (SELECT *, CASE WHEN source_path LIKE '%.md' THEN CAST(server_revision AS VARCHAR) ELSE content_hash END AS mark FROM fx_conflicts), d AS (SELECT DISTINCT vault_id, device_id, source_path, mark FROM m)
  SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.id % 2 = 0 AND e.vault_id = d.vault_id AND e.device_id = d.device_id AND e.source_path = d.source_path AND e.mark = d.mark)""")
def _(t):
    marked = t("conflicts").withColumn("mark", F.expr("CASE WHEN source_path LIKE '%.md' THEN cast(server_revision AS string) ELSE content_hash END"))
    return C.new_reports(t("conflicts"), marked.where("id % 2 = 0")).select("vault_id", "device_id", "source_path", "mark")


# maintenance

STALE = """stale AS (SELECT * FROM (SELECT c.id, c.vault_id, c.source_path, c.server_revision, f.revision AS file_revision, CASE WHEN f.revision IS NULL THEN 'file_missing' WHEN f.deleted THEN 'file_deleted' WHEN f.revision > c.server_revision THEN 'newer_revision' END AS reason
  FROM fx_conflicts c LEFT JOIN fx_half_log f ON f.vault_id = c.vault_id AND f.source_path = c.source_path WHERE c.status = 'OPEN') WHERE reason IS NOT NULL)"""


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def stale(t) -> DataFrame:
    return M.stale_conflicts(t("conflicts"), t("half_log"))


@query("jn04_stale_conflicts", "conflicts", "half_log", sql=f"WITH {STALE} SELECT * FROM stale")
def _(t):
    return stale(t)


@query("ag03_stale_counts", "conflicts", "half_log", sql=f"WITH {STALE} SELECT vault_id, reason, count(*) AS conflicts FROM stale GROUP BY ALL")
def _(t):
    return M.stale_counts(stale(t))


@query("tk06_stale_detail", "conflicts", "half_log", sql=f"WITH {STALE} SELECT * FROM stale ORDER BY vault_id, source_path, id LIMIT 50")
def _(t):
    return M.stale_detail(stale(t))


@query("jn05_still_open", "conflicts", "half_log", sql=f"WITH {STALE} SELECT vault_id, count(*) AS open_conflicts FROM fx_conflicts WHERE status = 'OPEN' AND id NOT IN (SELECT id FROM stale) GROUP BY vault_id")
def _(t):
    return M.still_open(t("conflicts"), stale(t))


@query("jn06_prunable_versions", "versions", sql="""SELECT v.vault_id, v.source_path, v.revision FROM fx_versions v JOIN (SELECT vault_id, source_path, max(revision) AS top FROM fx_versions GROUP BY ALL) m USING (vault_id, source_path)
  WHERE v.revision < m.top AND v.created_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY""")
def _(t):
    return M.prunable_versions(t("versions"), now(), 20)


@query("ag04_max_revisions", "sync_events", sql="SELECT vault_id, source_path, max(revision) AS max_revision FROM fx_sync_events GROUP BY ALL")
def _(t):
    return t("sync_events").groupBy("vault_id", "source_path").agg(F.max("revision").alias("max_revision"))


OLD = "old AS (SELECT * FROM fx_files WHERE deleted AND deleted_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 DAY)"


def retained(t) -> dict[str, DataFrame]:
    return M.apply_retention(t("files"), t("chunks"), now(), 7)


@query("jb07_retention_files", "files", "chunks", sql=f"WITH {OLD} SELECT id, id IN (SELECT id FROM old) AS archived FROM fx_files")
def _(t):
    r = retained(t)
    return r["files"].select("id", F.lit(False).alias("archived")).unionByName(r["archived_files"].select("id", F.lit(True).alias("archived")))


@query("jn07_retention_chunks", "files", "chunks", sql=f"WITH {OLD} SELECT chunk_id, EXISTS (SELECT 1 FROM old o WHERE o.vault_id = c.vault_id AND o.source_path = c.source_path) AS archived FROM fx_chunks c")
def _(t):
    r = retained(t)
    return r["chunks"].select("chunk_id", F.lit(False).alias("archived")).unionByName(r["archived_chunks"].select("chunk_id", F.lit(True).alias("archived")))


@query("fn24_raw_record", "files", "chunks", sql=f"""WITH {OLD} SELECT id, 'retention_expired' AS archived_reason, concat('{{"id":', id, ',"vault_id":"', vault_id, '","source_path":"', source_path, '","revision":', revision, ',"deleted_at":"', strftime(deleted_at, '%Y-%m-%dT%H:%M:%S.000Z'), '"}}') AS raw_record FROM old""")
def _(t):
    slim = t("files").select("id", "vault_id", "source_path", "revision", "deleted_at", "deleted")
    old = M.expired_files(slim, now(), 7).select("id", "vault_id", "source_path", "revision", "deleted_at")
    return old.select("id", F.lit("retention_expired").alias("archived_reason"), F.to_json(F.struct(*old.columns)).alias("raw_record"))


@query("ag11_retention_summary", "files", "versions", sql=f"""WITH {OLD} SELECT (SELECT count(*) FROM old) AS archived, (SELECT list_sort(list(concat(vault_id, '/', source_path))) FROM old) AS archived_paths,
  (SELECT count(*) FROM fx_versions v JOIN (SELECT vault_id, source_path, max(revision) AS top FROM fx_versions GROUP BY ALL) m USING (vault_id, source_path) WHERE v.revision < m.top AND v.created_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY) AS pruned""")
def _(t):
    rows = M.retention_rows(M.expired_files(t("files"), now(), 7), M.prunable_versions(t("versions"), now(), 20))
    archived = F.col("kind") == "archived"
    # the operator gives rows; this query lists the paths in one row, as its SQL does
    paths = F.sort_array(F.collect_list(F.when(archived, F.concat_ws("/", "vault_id", "source_path"))))
    return rows.agg(F.count_if(archived).alias("archived"), paths.alias("archived_paths"), F.count_if(~archived).alias("pruned"))


PRUNED = "pruned AS (SELECT v.vault_id, v.source_path, v.revision FROM fx_versions v JOIN (SELECT vault_id, source_path, max(revision) AS top FROM fx_versions GROUP BY ALL) m USING (vault_id, source_path) WHERE v.revision < m.top AND v.created_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY)"
RETAINED = f"WITH {OLD}, {PRUNED}, done AS (SELECT 'archived' AS kind, vault_id, source_path, NULL AS revision FROM old UNION ALL SELECT 'pruned', vault_id, source_path, revision FROM pruned)"
RETENTION = ("files", "chunks", "versions")


@query("ag11_retention_rows", *RETENTION, sql=f"{RETAINED} SELECT * FROM done")
def _(t):
    return M.retention(t("files"), t("chunks"), t("versions"), now(), 7, 20, dry_run=True)["rows"]


@query("jb07_retention_job", *RETENTION, sql=f"""{RETAINED}, s AS (SELECT vault_id, count(*) FILTER (kind = 'archived') AS archived, count(*) FILTER (kind = 'pruned') AS pruned FROM done GROUP BY vault_id),
  after AS (SELECT vault_id, count(*) AS n FROM fx_versions GROUP BY vault_id)
  SELECT s.vault_id, archived, pruned, dry, n - CASE WHEN dry THEN 0 ELSE pruned END AS versions_after FROM s LEFT JOIN after USING (vault_id) CROSS JOIN (SELECT true AS dry UNION ALL SELECT false) d""")
def _(t):
    def run(dry: bool) -> DataFrame:
        done = M.retention(t("files"), t("chunks"), t("versions"), now(), 7, 20, dry_run=dry)
        left = done["versions"].groupBy("vault_id").agg(F.count("*").alias("versions_after"))
        return done["summary"].join(left, "vault_id", "left").withColumn("dry", F.lit(dry))

    return run(True).unionByName(run(False))


@query("ag01_index_status", "vaults", "files", "chunks", sql="""WITH s AS (SELECT vault_id, count(*) AS n FROM fx_files f WHERE vectorize AND NOT deleted AND index_status = 'indexed' AND EXISTS (SELECT 1 FROM fx_chunks c WHERE c.vault_id = f.vault_id AND c.source_path = f.source_path AND c.content_hash = f.content_hash AND c.embedding_model <> 'bge-m3') GROUP BY vault_id),
p AS (SELECT vault_id, count(*) FILTER (index_status = 'pending') AS pending, count(*) FILTER (index_status = 'failed') AS failed FROM fx_files WHERE vectorize AND NOT deleted GROUP BY vault_id)
SELECT v.vault_id, coalesce(pending, 0) AS pending, coalesce(failed, 0) AS failed, coalesce(n, 0) AS model_stale, coalesce(pending, 0) + coalesce(failed, 0) + coalesce(n, 0) = 0 AS index_fresh FROM fx_vaults v LEFT JOIN p USING (vault_id) LEFT JOIN s USING (vault_id)""")
def _(t):
    return M.index_status(t("vaults"), t("files"), t("chunks"), MODEL)


@query("jn02_model_stale", "files", "chunks", sql="SELECT id FROM fx_files f WHERE vectorize AND NOT deleted AND index_status = 'indexed' AND EXISTS (SELECT 1 FROM fx_chunks c WHERE c.vault_id = f.vault_id AND c.source_path = f.source_path AND c.content_hash = f.content_hash AND c.embedding_model <> 'bge-m3')")
def _(t):
    return M.model_stale(t("files"), t("chunks"), MODEL).select("id")


@query("ag02_sync_status", "vaults", "cursors", "sync_events", "conflicts", "files", sql="""SELECT c.vault_id, c.device_id, c.cursor, v.current_revision AS server_revision, (SELECT count(*) FROM fx_sync_events e WHERE e.vault_id = c.vault_id AND e.revision > c.cursor) AS events_after,
  (SELECT count(*) FROM fx_conflicts x WHERE x.vault_id = c.vault_id AND x.status = 'OPEN') AS open_conflicts, (SELECT count(*) FROM fx_files f WHERE f.vault_id = c.vault_id AND vectorize AND NOT deleted AND index_status = 'pending') AS pending_files
  FROM fx_cursors c JOIN fx_vaults v ON v.vault_id = c.vault_id""")
def _(t):
    return M.sync_status(t("vaults"), t("cursors"), t("sync_events"), t("conflicts"), t("files"))


@query("jn16_device_upsert", "sync_events", sql="SELECT vault_id, device_id, CASE WHEN max(CASE WHEN revision % 3 = 0 THEN revision END) IS NOT NULL THEN concat('n', max(CASE WHEN revision % 3 = 0 THEN revision END)) END AS name, max(revision) AS cursor FROM fx_sync_events GROUP BY vault_id, device_id")
def _(t):
    rows = t("sync_events").select("vault_id", "device_id", F.expr("CASE WHEN revision % 3 = 0 THEN concat('n', revision) END").alias("name"), F.expr("timestamp_seconds(revision)").alias("last_seen_at"), F.col("revision").alias("cursor"))
    return M.upserted_devices(rows.where("revision % 2 = 0"), rows.where("revision % 2 = 1")).select("vault_id", "device_id", "name", "cursor")


@query("tk05_vault_listing", "vaults", sql="SELECT vault_id, is_active, current_revision FROM fx_vaults ORDER BY created_at DESC, vault_id")
def _(t):
    return t("vaults").orderBy(F.desc("created_at"), "vault_id").select("vault_id", "is_active", "current_revision")


@query("io10_search_log_rows", *AT, sql=f"{ALL_LEGS}, {RANKED} SELECT CAST(q.query_id AS VARCHAR) AS request_id, vault_id, query, '{{}}' AS filters, (SELECT count(*) FROM ranked r WHERE r.query_id = q.query_id) AS result_count, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM fx_asked q")
def _(t):
    return M.search_log_rows(t("asked"), searched(t)[0], now())


FEEDBACK = """feedback AS (SELECT request_id, CASE WHEN result_count = 3 THEN 'vX' ELSE vault_id END AS vault_id, latency_ms AS seq, CASE WHEN result_count = 5 THEN NULL ELSE result_count % 2 = 0 END AS helpful, CASE WHEN result_count % 3 = 1 THEN query END AS comment FROM fx_search_logs WHERE latency_ms % 4 = 0)"""


def feedback(t) -> DataFrame:
    return t("search_logs").where("latency_ms % 4 = 0").select(
        "request_id", F.expr("CASE WHEN result_count = 3 THEN 'vX' ELSE vault_id END").alias("vault_id"), F.col("latency_ms").alias("seq"), F.expr("CASE WHEN result_count = 5 THEN NULL ELSE result_count % 2 = 0 END").alias("helpful"),
        F.lit(None).cast("string").alias("selected_source_path"), F.lit(None).cast("int").alias("selected_chunk_rank"), F.lit(None).cast("boolean").alias("expected_missing"), F.expr("CASE WHEN result_count % 3 = 1 THEN query END").alias("comment"),
    )


@query("jn11_feedback_attached", "search_logs", sql=f"WITH {FEEDBACK} SELECT l.request_id, f.helpful AS feedback_helpful, f.comment AS feedback_comment FROM fx_search_logs l LEFT JOIN (SELECT * FROM feedback WHERE helpful IS NOT NULL OR comment IS NOT NULL) f ON f.request_id = l.request_id AND f.vault_id = l.vault_id")
def _(t):
    return M.attach_feedback(t("search_logs"), feedback(t))[0].select("request_id", "feedback_helpful", "feedback_comment")


@query("jn11_feedback_rejected", "search_logs", sql=f"WITH {FEEDBACK} SELECT request_id, CASE WHEN helpful IS NULL AND comment IS NULL THEN 'feedback is empty' ELSE 'request not found' END AS reason FROM feedback WHERE (helpful IS NULL AND comment IS NULL) OR vault_id = 'vX'")
def _(t):
    return M.attach_feedback(t("search_logs"), feedback(t))[1].select("request_id", "reason")


@query("io08_replace_chunks", "chunks", sql="SELECT chunk_id, CASE WHEN chunk_id % 15 < 5 THEN 'new' ELSE 'old' END AS origin FROM fx_chunks")
def _(t):
    old = t("chunks").select("chunk_id", "vault_id", "source_path", F.lit("old").alias("origin"))
    new = old.where("chunk_id % 15 < 5").withColumn("origin", F.lit("new"))
    return M.replaced_chunks(old, new, new)[0].select("chunk_id", "origin")


@query("io08_replace_report", "chunks", sql="SELECT vault_id, count(*) AS created, count(*) AS deleted, 0 AS updated FROM fx_chunks WHERE chunk_id % 15 < 5 GROUP BY vault_id")
def _(t):
    old = t("chunks").select("chunk_id", "vault_id", "source_path")
    new = old.where("chunk_id % 15 < 5")
    return M.replaced_chunks(old, new, new)[1]


@query("io05_manifest_round_trip", "manifest", "cursors", "tracked", sql="SELECT vault_id, device_id, source_path, server_revision, content_hash FROM fx_manifest")
def _(t):
    files = t("manifest").withColumn("last_synced_at", F.lit("2024-01-01T00:00:00"))
    conflicts = t("tracked").withColumn("server_content_hash", F.lit(None).cast("string"))
    packed = IO.manifest_json(t("cursors").where("device_id = 'devA'"), files, conflicts)
    return IO.manifest_tables(packed)[1].select("vault_id", "device_id", "source_path", "server_revision", "content_hash")


# notes and indexing


# Notes of the fixture hold one heading; their paragraphs are single lines. A part is a list of tokens, each with the white space after it.
CHUNKED = r"""body AS (SELECT vault_id, source_path, doc_id, content, trim(regexp_extract(content, '(?s)^---\n.*?\n---\n(.*)$', 1), chr(32) || chr(10) || chr(9) || chr(13)) AS s FROM fx_notes WHERE doc_id % 20 NOT IN (3, 7)),
lists AS (SELECT *, [regexp_extract_all(x, '(?:^\s*)?(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])\s*') for x in regexp_split_to_array(s, '\n\s*\n')] AS ps FROM body),
cuts AS (SELECT *, list_filter(flatten([[u[k * 1200 + 1 : (k + 1) * 1200] for k in range(0, (len(u) + 1199) // 1200)] for u in ps]), lambda u: len(u) > 0) AS p, list_sum([len(u) for u in ps]) AS n FROM lists),
parts AS (SELECT *, len(p) AS c, [coalesce(list_sum([len(u) for u in p[1:t]]), 0) for t in range(0, len(p) + 1)] AS upto FROM cuts),
pieces(doc_id, k, j, ends, done) AS (
  SELECT doc_id, -1, 0::BIGINT, []::VARCHAR[][], []::VARCHAR[][] FROM parts WHERE n > 1200
  UNION ALL
  SELECT doc_id, k + 1, j2, CASE WHEN rest > 0 AND m > 0 THEN [last[m][greatest(1, len(last[m]) - rest + 1):]] ELSE [] END || last[m + 1:], last FROM (
    SELECT *, coalesce(list_max([t for t in range(1, len(last) + 1) if sizes[t] > 100]), 0) AS m, 100 - coalesce(sizes[m + 1], 0) AS rest FROM (
      SELECT *, [list_sum([len(u) for u in last[t:]]) for t in range(1, len(last) + 1)] AS sizes FROM (
        SELECT r.doc_id, r.k, j2, all_[1:len(all_) - 1] || [all_[len(all_)][1:len(all_[len(all_)]) - 1] || [rtrim(all_[len(all_)][len(all_[len(all_)])], chr(32) || chr(10) || chr(9))]] AS last FROM (
          SELECT r.doc_id, r.k, greatest(r.j + 1, coalesce(list_max([t for t in range(r.j + 1, c + 1) if upto[t + 1] - upto[r.j + 1] <= 1200 - coalesce(list_sum([len(u) for u in r.ends]), 0)]), 0)) AS j2, r.ends || p[r.j + 1 : j2] AS all_
          FROM pieces r JOIN parts USING (doc_id) WHERE r.j < c) r)))),
chunked AS (
  SELECT vault_id, source_path, doc_id, 0 AS chunk_index, s AS content FROM parts WHERE n <= 1200
  UNION ALL
  SELECT vault_id, source_path, doc_id, k, trim(array_to_string([array_to_string(u, '') for u in done], chr(10) || chr(10)), chr(32) || chr(10) || chr(9)) FROM pieces JOIN parts USING (doc_id) WHERE k >= 0)"""
COUNTED = r"len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query("fn12_chunk_notes", "notes", sql=f"""WITH RECURSIVE {CHUNKED} SELECT vault_id, source_path, chunk_index, [concat('D', doc_id)] AS heading_path, {COUNTED} AS token_count, sha256(content) AS content_hash, NULL AS error FROM chunked
  UNION ALL SELECT vault_id, source_path, NULL, NULL, NULL, NULL, CASE doc_id % 20 WHEN 3 THEN 'frontmatter is missing required fields: type' ELSE 'frontmatter field priority has an unsupported value' END FROM fx_notes WHERE doc_id % 20 IN (3, 7)""")
def _(t):
    return N.chunk_notes(t("notes"), ["vault_id", "source_path"]).select("vault_id", "source_path", "chunk_index", "heading_path", "token_count", F.sha2("content", 256).alias("content_hash"), "error")


@query("fn06_note_errors", "notes", sql="""SELECT source_path, CASE doc_id % 20 WHEN 3 THEN 'frontmatter is missing required fields: type' WHEN 7 THEN 'frontmatter field priority has an unsupported value' END AS error FROM fx_notes WHERE doc_id % 20 IN (3, 7)""")
def _(t):
    return N.chunk_notes(t("notes"), ["source_path"]).where("error IS NOT NULL").select("source_path", "error")


def note_files(notes: DataFrame) -> DataFrame:
    return notes.select("vault_id", "source_path", F.expr("CASE WHEN doc_id % 30 = 1 THEN 'older' ELSE sha2(content, 256) END").alias("content_hash"), F.lit("current").alias("status"), F.lit("pending").alias("index_status"),
                        F.expr("doc_id % 11 <> 0").alias("vectorize"), F.expr("doc_id % 13 = 0").alias("deleted"))


def indexed(t, old: DataFrame | None = None) -> dict[str, DataFrame]:
    notes = t("notes")
    files = note_files(notes)
    old = t("documents").sparkSession.createDataFrame([], "vault_id string, source_path string, chunk_index int") if old is None else old
    return I.index_notes(files, notes.select("vault_id", "source_path", "content"), old, I.hashing_embedder(16), 16, MODEL)


@query("jb01_file_status", "notes", sql="""SELECT vault_id, source_path, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'skipped' WHEN doc_id % 20 IN (3, 7) THEN 'failed' WHEN doc_id % 30 = 1 THEN 'pending' ELSE 'indexed' END AS index_status FROM fx_notes""")
def _(t):
    return indexed(t)["files"].select("vault_id", "source_path", "index_status")


@query("ag05_index_report", "notes", sql="""WITH s AS (SELECT *, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'skipped' WHEN doc_id % 20 IN (3, 7) THEN 'failed' WHEN doc_id % 30 = 1 THEN 'pending' ELSE 'indexed' END AS st FROM fx_notes)
SELECT vault_id, count(*) FILTER (st = 'indexed') AS indexed, count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'failed') AS failed, list_sort(list(source_path) FILTER (st = 'failed')) AS failed_paths FROM s GROUP BY vault_id""")
def _(t):
    done = indexed(t)
    failed = done["files"].groupBy("vault_id").agg(F.sort_array(F.collect_list(F.when(F.col("index_status") == "failed", F.col("source_path")))).alias("failed_paths"))
    return done["report"].join(failed, "vault_id").select("vault_id", "indexed", "skipped", "failed", "failed_paths")


@query("ag05_chunk_counts", "notes", sql=f"""WITH RECURSIVE {CHUNKED}, wanted AS (SELECT c.vault_id, c.source_path, c.doc_id, c.chunk_index FROM chunked c WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0),
  stored AS (SELECT vault_id, source_path, doc_id, i AS chunk_index FROM fx_notes, (SELECT unnest([0, 1, 2]) AS i) WHERE doc_id % 4 = 0),
  failing AS (SELECT vault_id, source_path FROM fx_notes WHERE doc_id % 20 IN (3, 7) AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)
  SELECT v.vault_id, (SELECT count(*) FROM wanted w WHERE w.vault_id = v.vault_id) AS created, 0 AS updated,
    (SELECT count(*) FROM stored s WHERE s.vault_id = v.vault_id AND NOT EXISTS (SELECT 1 FROM failing f WHERE f.vault_id = s.vault_id AND f.source_path = s.source_path)) AS deleted FROM (SELECT DISTINCT vault_id FROM fx_notes) v""")
def _(t):
    stored = t("notes").where("doc_id % 4 = 0").select("vault_id", "source_path", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("chunk_index"))
    return indexed(t, stored)["report"].select("vault_id", "created", "updated", "deleted")


@query("jb01_chunks", "notes", sql=f"""WITH RECURSIVE {CHUNKED} SELECT vault_id, source_path, chunk_index, sha256(b.content) AS content_hash, concat('[reference] priority:high project:', source, ' domain:', lang, ' section:D', doc_id, ' tags:', lang, ',', source) AS agent_hint, 16 AS dimension
  FROM chunked JOIN (SELECT doc_id, content FROM body) b USING (doc_id) JOIN documents USING (doc_id) WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def _(t):
    return indexed(t)["chunks"].select("vault_id", "source_path", "chunk_index", "content_hash", "agent_hint", F.size("embedding").alias("dimension"))


@query("io11_failures", "notes", sql="SELECT vault_id, source_path, 'frontmatter' AS phase FROM fx_notes WHERE doc_id % 20 IN (3, 7) AND NOT (doc_id % 11 = 0 OR doc_id % 13 = 0)")
def _(t):
    return indexed(t)["failures"].select("vault_id", "source_path", "phase")


@query("io11_failure_log", "notes", sql="""SELECT vault_id, source_path, CASE WHEN doc_id % 30 = 1 THEN 'older' ELSE sha256(content) END AS content_hash, 'frontmatter' AS phase, 'VALIDATION_ERROR' AS error_code, TIMESTAMP '2024-02-01 00:00:00' AS created_at,
  CASE doc_id % 20 WHEN 3 THEN 'frontmatter is missing required fields: type' ELSE 'frontmatter field priority has an unsupported value' END AS error_message, CASE doc_id % 20 WHEN 3 THEN '{"missing_fields":["type"]}' ELSE '{"field":"priority"}' END AS error_details
  FROM fx_notes WHERE doc_id % 20 IN (3, 7) AND doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def _(t):
    log = I.failure_log(indexed(t)["failures"], note_files(t("notes")), now())
    path = new_folder(log.sparkSession, "failure_log")
    I.append_failures(log, path)
    return log.sparkSession.read.parquet(path).drop("day")


# watch events and streams, as batches


@query("ss01_snapshot_fold", "sync_events", sql="SELECT vault_id, source_path, max(revision) AS revision FROM fx_sync_events GROUP BY ALL")
def _(t):
    e = t("sync_events").select("vault_id", "source_path", "revision", "content_hash")
    first = ST.merged_snapshot(None, e.where("revision % 2 = 0"))
    return ST.merged_snapshot(first, e).select("vault_id", "source_path", "revision")


@query("ss02_debounce", "watch", sql="""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY vault_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM fx_watch), i AS (SELECT *, sum(fresh) OVER (PARTITION BY vault_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT vault_id, min(ts) AS first_event, max(ts) + INTERVAL 10 MINUTE AS fires_at, count(*) AS n_events FROM i GROUP BY vault_id, island""")
def _(t):
    return ST.debounced(t("watch"), "10 minutes")


@query("ss03_suppressed", "watch", "runs", sql="""SELECT vault_id, event_id, ts FROM fx_watch w WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE r.vault_id = w.vault_id AND w.ts >= r.begin AND w.ts < r."end" + INTERVAL 1 SECOND)""")
def _(t):
    return ST.unsuppressed(t("watch"), t("runs"), 1)


@query("ss04_coalesced_jobs", "watch", sql="SELECT vault_id, source_path, min(ts) AS ts, count(*) AS requests FROM fx_watch GROUP BY ALL")
def _(t):
    return ST.coalesced_jobs(t("watch"))


@query("ss06_safety_runs", "runs", sql="""SELECT vault_id, ts, gap_seconds FROM (SELECT vault_id, begin AS ts, CAST(floor((epoch_us(begin) - epoch_us(lag(begin) OVER (PARTITION BY vault_id ORDER BY begin))) / 1000000) AS BIGINT) AS gap_seconds FROM fx_runs) WHERE gap_seconds >= 14400""")
def _(t):
    return ST.safety_runs(t("runs").select("vault_id", F.col("begin").alias("ts")), 14400)


# jobs by name


@query("jb06_plan_sync", *SYNC, sql=f"""WITH {LOCAL}, {PULL}, {PUSH} SELECT vault_id, device_id, source_path, 'pull' AS side, action FROM pull UNION ALL SELECT vault_id, device_id, source_path, 'push' AS side, action FROM push""")
def _(t):
    return sync(t)["plan"].select(*C.KEYS, "side", "action")


def sync(t) -> dict[str, DataFrame]:
    known = t("sync_events").where("revision % 3 = 0").select("vault_id", F.lit("devA").alias("device_id"), "source_path", F.col("revision").cast("string").alias("mark"))
    return C.plan_sync(t("sync_events"), t("cursors"), t("manifest"), t("scan"), t("tracked"), known)


@query("jb06_reports", *SYNC, sql=f"""WITH {PULL}, r AS (SELECT p.vault_id, p.device_id, p.source_path, p.revision AS server_revision, s.content_hash, CASE WHEN p.source_path LIKE '%.md' THEN CAST(p.revision AS VARCHAR) ELSE s.content_hash END AS mark
    FROM pull p LEFT JOIN fx_scan s ON s.vault_id = p.vault_id AND s.device_id = p.device_id AND s.source_path = p.source_path WHERE p.action LIKE '%conflict')
  SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM fx_sync_events e WHERE e.revision % 3 = 0 AND r.device_id = 'devA' AND e.vault_id = r.vault_id AND e.source_path = r.source_path AND CAST(e.revision AS VARCHAR) = r.mark)""")
def _(t):
    return sync(t)["reports"]


@query("jb08_resolve_stale", "conflicts", "half_log", sql=f"WITH {STALE} SELECT id, CASE WHEN id IN (SELECT id FROM stale) THEN 'RESOLVED' ELSE status END AS status FROM fx_conflicts")
def _(t):
    return M.resolve_stale_conflicts(t("conflicts"), t("half_log"), apply=True)["conflicts"].select("id", "status")


@query("jb08_dry_run", "conflicts", "half_log", sql=f"WITH {STALE} SELECT vault_id, reason, count(*) AS conflicts, (SELECT count(*) FROM fx_conflicts c WHERE c.vault_id = stale.vault_id AND c.status = 'OPEN') AS still_listed_open FROM stale GROUP BY ALL")
def _(t):
    done = M.resolve_stale_conflicts(t("conflicts"), t("half_log"))
    left = done["conflicts"].where("status = 'OPEN'").groupBy("vault_id").agg(F.count("*").alias("still_listed_open"))
    return done["counts"].join(left, "vault_id")


STATUS = ("vaults", "files", "chunks", "conflicts", "cursors", "sync_events")


def status(t) -> DataFrame:
    return M.vault_status(t("vaults"), t("files"), t("chunks"), t("conflicts"), t("cursors"), t("sync_events"), MODEL)


@query("jb10_vault_status", *STATUS, sql="""SELECT v.vault_id, v.current_revision, (SELECT count(*) FROM fx_files f WHERE f.vault_id = v.vault_id AND vectorize AND NOT deleted AND index_status = 'pending') AS pending,
  (SELECT count(*) FROM fx_conflicts c WHERE c.vault_id = v.vault_id AND c.status = 'OPEN') AS open_conflicts FROM fx_vaults v""")
def _(t):
    return status(t).select("vault_id", F.col("server_revision").alias("current_revision"), "pending", "open_conflicts").distinct()


@query("jb10_device_status", *STATUS, sql="""SELECT v.vault_id, v.current_revision AS server_revision, d.device_id, d.cursor, (SELECT count(*) FROM fx_sync_events e WHERE e.vault_id = v.vault_id AND e.revision > coalesce(d.cursor, 0)) AS events_after,
  (SELECT count(*) FROM fx_conflicts c WHERE c.vault_id = v.vault_id AND c.status = 'OPEN') AS open_conflicts FROM fx_vaults v LEFT JOIN fx_cursors d ON d.vault_id = v.vault_id""")
def _(t):
    return status(t).select("vault_id", "server_revision", "device_id", "cursor", "events_after", "open_conflicts")


@query("so01_union_of_legs", *AT, sql=f"{ALL_LEGS} SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, chunk_id FROM vec UNION SELECT query_id, chunk_id FROM lex)")
def _(t):
    p = pool(t)
    return S.block_vector_leg(t("asked"), p).select("query_id", "chunk_id").unionByName(S.lexical_leg(t("asked"), p).select("query_id", "chunk_id")).distinct()


@query("so02_move", "files", sql=f"WITH {OLD} SELECT (SELECT count(*) FROM fx_files) - (SELECT count(*) FROM old) AS live, (SELECT count(*) FROM old) AS archived")
def _(t):
    r = M.apply_retention(t("files"), t("chunks"), now(), 7)
    return r["files"].agg(F.count("*").alias("live")).crossJoin(r["archived_files"].agg(F.count("*").alias("archived")))  # one row each


@query("wn02_leg_ranks", *AT, sql=f"WITH {POOL}, {SCORED} SELECT query_id, max(vector_rank) AS last_rank, count(*) AS n FROM vec GROUP BY query_id")
def _(t):
    return S.block_vector_leg(t("asked"), pool(t)).groupBy("query_id").agg(F.max("vector_rank").alias("last_rank"), F.count("*").alias("n"))


@query("pr12_threshold", *AT, sql=f"{ALL_LEGS}, kept AS (SELECT f.*, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query_embedding AS DOUBLE[])), 6) AS score FROM fused f JOIN pool p ON p.chunk_id = f.chunk_id JOIN fx_asked q ON q.query_id = f.query_id) SELECT query_id, chunk_id, score FROM kept WHERE matched_by <> 'vector' OR score >= 0.1")
def _(t):
    from noteflow.functions import text as T

    p = pool(t)
    rows = S.fused(S.block_vector_leg(t("asked"), p), S.lexical_leg(t("asked"), p)).join(p.select("chunk_id", "embedding"), "chunk_id").join(t("asked").select("query_id", "query_embedding"), "query_id")
    return S.passing(rows.withColumn("score", F.round(T.cosine(F.col("embedding"), F.col("query_embedding")), 6)), 0.1).select("query_id", "chunk_id", "score")


@query("fn09_heading_sections", "notes", sql="""SELECT source_path, concat('D', CAST(doc_id AS VARCHAR)) AS heading FROM fx_notes WHERE doc_id % 20 NOT IN (3, 7)""")
def _(t):
    rows = N.chunk_notes(t("notes"), ["source_path"]).where("chunk_index = 0")
    return rows.select("source_path", F.col("heading_path")[0].alias("heading"))


@query("io02_partitioned_table", "files", sql="SELECT id, vault_id, source_path, index_status FROM fx_files WHERE vault_id = 'v1'")
def _(t):
    rows = t("files")
    folder = new_folder(rows.sparkSession, "files")
    IO.write_table(rows, folder)
    return IO.read_table(rows.sparkSession, folder).where("vault_id = 'v1'").select("id", "vault_id", "source_path", "index_status")


@query("io04_manifest_conflicts", "manifest", "tracked", "cursors", sql="SELECT vault_id, device_id, source_path, server_revision, local_content_hash, server_deleted FROM fx_tracked")
def _(t):
    files = t("manifest").withColumn("last_synced_at", F.lit("2024-01-01T00:00:00"))
    packed = IO.manifest_json(t("cursors").where("device_id = 'devA'"), files, t("tracked").withColumn("server_content_hash", F.lit(None).cast("string")))
    return IO.manifest_tables(packed)[2].select("vault_id", "device_id", "source_path", "server_revision", "local_content_hash", "server_deleted")


@query("io04_manifest_cursors", "cursors", sql="SELECT vault_id, device_id, cursor FROM fx_cursors")
def _(t):
    cursors = t("cursors")
    empty = cursors.limit(0).select("vault_id", "device_id", F.lit("").alias("source_path"), F.lit(0).cast("long").alias("server_revision"))
    return IO.manifest_tables(IO.manifest_json(cursors, empty, empty))[0]
