"""The thin queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm import exact_dedup, jaccard_join, licences, manifest, mixing, nn_descent, pieces, quality, runs, secret_ledger, telephony, toxicity, warc
from noteflow.llm.store import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.records(warc.read_chunks(spark, folder, keep_data=False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_ledger.scan_versions(spark, docs, secret_ledger.fresh_ledger(spark), "doc_id", "text")
    return found.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(spark, _table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(spark, _table(spark, sf_dir, "documents"))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = telephony.stored_media(spark, _table(spark, sf_dir, "documents"))
    return telephony.features(telephony.stored_pcm(spark, media))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), change=runs.looped)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(spark, _table(spark, sf_dir, "documents")).drop("proof")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_pieces": op5_pieces,
    "op6_licences": op6_licences,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_telephony": op9_telephony,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_near_vectors": op12_near_vectors,
    "op13_manifest": op13_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
     g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NULL OR winner IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN winner IS NOT NULL AND winner IS DISTINCT FROM page_id THEN winner END AS refers_to
FROM g
""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
                  length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
""",
    "op12_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
        AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
""",
    "op13_manifest": """
WITH RECURSIVE crc AS (  -- CRC-32 of the decimal id, byte by byte
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
         list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS folded,
         xor(folded, 4294967295) AS c
  FROM (SELECT DISTINCT doc_id FROM documents)),
d AS (
  SELECT doc_id, lang, crc.c % 7 = 0 AND n_chars IS NOT NULL AS hit, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
         coalesce(strlen(text) || ':' || text, '-') AS back
  FROM documents JOIN crc USING (doc_id)),
leaf AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || back) AS leaf,
         CASE WHEN hit THEN sha256(front || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR || back) END AS now
  FROM d),
node(tree, lvl, idx, n, h) AS (
  SELECT coalesce('s' || lang, 'n'), 0, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1, count(*) OVER (PARTITION BY lang), leaf FROM leaf
  UNION ALL
  SELECT tree, any_value(lvl) + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, idx // 2),
top(lvl, idx, n, h, tree) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, count(*) OVER (), h, tree FROM node WHERE n = 1
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)), NULL FROM top WHERE n > 1 GROUP BY idx // 2),
placed AS (
  SELECT doc_id, leaf, coalesce(now, leaf) AS now, coalesce('s' || lang, 'n') AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
up(doc_id, leaf, tree, lvl, idx, proof, f, done) AS (
  SELECT doc_id, leaf, tree, 0, idx, '', now, false FROM placed
  UNION ALL
  SELECT u.doc_id, u.leaf, u.tree, u.lvl + 1, u.idx // 2, u.proof || coalesce(s.h, ''),
         CASE WHEN u.idx % 2 = 0 THEN sha256(u.f || coalesce(s.h, '')) ELSE sha256(s.h || u.f) END, false
  FROM up u JOIN node me ON me.tree = u.tree AND me.lvl = u.lvl AND me.idx = u.idx AND me.n > 1
       LEFT JOIN node s ON s.tree = u.tree AND s.lvl = u.lvl AND s.idx = xor(u.idx, 1)),
sub AS (SELECT u.*, r.h AS subroot, t.idx AS place FROM up u JOIN node r ON r.tree = u.tree AND r.n = 1 AND r.lvl = u.lvl JOIN top t ON t.tree = u.tree AND t.lvl = 0),
over(doc_id, leaf, subroot, lvl, idx, proof, f) AS (
  SELECT doc_id, leaf, subroot, 0, place, proof, f FROM sub
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.lvl + 1, u.idx // 2, u.proof || coalesce(s.h, ''),
         CASE WHEN u.idx % 2 = 0 THEN sha256(u.f || coalesce(s.h, '')) ELSE sha256(s.h || u.f) END
  FROM over u JOIN top me ON me.lvl = u.lvl AND me.idx = u.idx AND me.n > 1 LEFT JOIN top s ON s.lvl = u.lvl AND s.idx = xor(u.idx, 1))
SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.f AS folded_root, o.f = r.h AS verified
FROM over o JOIN top r ON r.n = 1 AND r.lvl = o.lvl
""",
}
