"""Note-store tables derived from the driver's tables, as SQL that both engines read.

Each fixture is a function of a dialect and gives a SELECT; ``table`` makes it a
DataFrame over a folder of tables and ``ctes`` puts it before an oracle's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASES = ("documents", "embeddings", "events", "benchmark", "pages", "labels", "conversations")
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def arr(self, *x: str) -> str:
        return f"array({', '.join(x)})" if self.spark else f"[{', '.join(x)}]"

    def num(self, x: str) -> str:
        """The number in a JSON text like {"k": 5}."""
        return f"CAST(regexp_extract({x}, '([0-9]+)', 1) AS BIGINT)"

    def texts(self, *x: str) -> str:
        """A list of texts, which may be empty."""
        return f"CAST(array({', '.join(x)}) AS ARRAY<STRING>)" if self.spark else f"CAST([{', '.join(x)}] AS VARCHAR[])"

    def word(self, i: int) -> str:
        """The i-th word of small ASCII letters of a document's text; null if it has fewer."""
        if self.spark:  # reads a text no further than to that word
            return f"nullif(regexp_extract(lower(d.text), '(?s)^(?>.*?[a-z]{{2,}}+){{{i - 1}}}.*?([a-z]{{2,}})', 1), '')"
        return f"regexp_extract_all(lower(d.text), '[a-z]{{2,}}')[{i}]"

    @property
    def newline(self) -> str:
        return "'\\n'" if self.spark else "chr(10)"


def sync_events(d: Dialect) -> str:
    return f"""SELECT concat('v', CAST(user_id % 8 AS STRING)) AS vault_id,
       CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS BIGINT) AS revision,
       concat('notes/n', CAST({d.num('props')} % 25 AS STRING), CASE WHEN {d.num('props')} % 9 = 0 THEN '.png' ELSE '.md' END) AS source_path,
       CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'RESTORE' ELSE 'UPDATE' END AS event_type,
       {d.sha('CAST(event_id % 13 AS STRING)')} AS content_hash, event_type = 'error' AS deleted, CAST(ts AS TIMESTAMP) AS created_at,
       concat('dev', CAST(user_id AS STRING)) AS device_id, event_id FROM events"""


def chunks(d: Dialect) -> str:
    return f"""SELECT e.vec_id AS chunk_id, concat('v', CAST(g % 4 AS STRING)) AS vault_id, concat('notes/s', CAST(g AS STRING), '.md') AS source_path,
       CAST(e.vec_id % 5 AS INT) AS chunk_index, concat('Note ', CAST(g AS STRING)) AS title, d.text AS content, concat('p', CAST(e.label AS STRING)) AS project,
       d.lang AS domain, CASE WHEN e.vec_id % 19 = 0 THEN NULL ELSE {d.arr('d.lang', 'd.source')} END AS tags,
       CASE WHEN e.vec_id % 10 = 0 THEN 'draft' ELSE 'current' END AS status, CASE WHEN e.vec_id % 3 = 0 THEN 'high' ELSE 'medium' END AS priority,
       CASE WHEN e.vec_id % 4 = 0 THEN 'rule' ELSE 'reference' END AS type, 'personal' AS visibility,
       CASE WHEN g % 7 = 0 THEN 'old-model' ELSE 'bge-m3' END AS embedding_model, {d.sha('CAST(g AS STRING)')} AS content_hash, e.embedding
FROM (SELECT *, CAST(floor(vec_id / 5) AS BIGINT) AS g FROM embeddings) e JOIN documents d ON d.doc_id = e.vec_id"""


def files(d: Dialect) -> str:
    return f"""SELECT DISTINCT g AS id, concat('v', CAST(g % 4 AS STRING)) AS vault_id, concat('notes/s', CAST(g AS STRING), '.md') AS source_path,
       CASE WHEN g % 11 = 0 THEN {d.sha("'newer'")} ELSE {d.sha('CAST(g AS STRING)')} END AS content_hash,
       CASE g % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'indexed' END AS index_status, CASE WHEN g % 23 = 0 THEN 'archived' ELSE 'current' END AS status,
       g % 17 <> 0 AS vectorize, g % 13 = 0 AS deleted, g + 1 AS revision,
       CASE WHEN g % 13 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' + make_interval(0, 0, 0, CAST(g % 12 AS INT)) END AS deleted_at
FROM (SELECT CAST(floor(vec_id / 5) AS BIGINT) AS g FROM embeddings) x"""


def vaults(d: Dialect) -> str:
    return """SELECT concat('v', CAST(u AS STRING)) AS vault_id, u % 7 <> 6 AS is_active, CAST(1000 * u AS BIGINT) AS current_revision,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM (SELECT DISTINCT user_id % 9 AS u FROM events) x"""


def asked(d: Dialect) -> str:
    return f"""SELECT e.vec_id AS query_id, concat('v', CAST(CAST(floor(e.vec_id / 5) AS BIGINT) % 4 AS STRING)) AS vault_id, e.embedding AS query_embedding,
       regexp_extract(d.text, '([a-z]{{5,}})', 1) AS query FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 1"""


def asks(d: Dialect) -> str:
    """A query for every vector whose document has three words: six forms of the query syntax, filters of all kinds, some of them bad."""
    return f"""SELECT query_id, CASE WHEN query_id % 13 = 5 THEN 'v6' WHEN query_id % 29 = 7 THEN 'v77' ELSE vault_id END AS vault_id, query_embedding, w1, w2, w3, vault_id AS own_vault,
       CASE query_id % 6 WHEN 0 THEN concat(w1, ' ', w2) WHEN 1 THEN concat('"', w1, ' ', w2, '"') WHEN 2 THEN concat(w1, ' or ', w3) WHEN 3 THEN concat(w1, ' -', w2)
         WHEN 4 THEN concat('"', w2, ' ', w1, '" OR -"', w1, ' ', w2, '" ', w3) ELSE concat('-', w1) END AS query,
       CAST(CASE WHEN query_id % 37 = 1 THEN query_id % 2 * 11 ELSE query_id % 9 + 1 END AS INT) AS top_k, CASE query_id % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 0.0 WHEN 2 THEN CASE WHEN query_id % 31 = 2 THEN 1.5 ELSE 0.02 END END AS min_score,
       CASE query_id % 4 WHEN 0 THEN {d.texts("'current'", "'draft'", "'current'")} WHEN 1 THEN {d.texts()} END AS f_status, CASE query_id % 7 WHEN 2 THEN {d.texts("'rule'")} WHEN 3 THEN {d.texts("'rule'", "'reference'")} END AS f_type,
       CASE query_id % 5 WHEN 4 THEN {d.texts("'high'")} END AS f_priority, CASE query_id % 11 WHEN 6 THEN {d.texts("'personal'")} WHEN 7 THEN {d.texts("'personal'", "'secret'")} END AS f_visibility,
       CASE query_id % 8 WHEN 3 THEN {d.texts("' en '", "'fr'", "' '")} WHEN 5 THEN {d.texts("''")} END AS f_tags, CASE query_id % 10 WHEN 9 THEN 'en' WHEN 8 THEN ' ' END AS f_domain, CASE query_id % 12 WHEN 7 THEN 'p2' END AS f_project
FROM (SELECT e.vec_id AS query_id, concat('v', CAST(CAST(floor(e.vec_id / 5) AS BIGINT) % 4 AS STRING)) AS vault_id, e.embedding AS query_embedding, {d.word(1)} AS w1, {d.word(2)} AS w2, {d.word(3)} AS w3
      FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) x WHERE w3 IS NOT NULL"""


def golden(d: Dialect) -> str:
    return """SELECT b.item_id AS query_id, b.text AS query, concat('notes/', d.source, '/d', CAST(d.doc_id AS STRING), '.md') AS expected_source, d.doc_id
FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


def search_logs(d: Dialect) -> str:
    return f"""SELECT CAST(event_id AS STRING) AS request_id, concat('v', CAST(user_id % 8 AS STRING)) AS vault_id,
       concat(event_type, ' ', regexp_extract(props, '([0-9]+)', 1)) AS query, CAST(event_id % 11 AS INT) AS result_count,
       CAST(event_id % 997 AS INT) AS latency_ms, CAST(ts AS TIMESTAMP) AS created_at FROM events"""


def versions(d: Dialect) -> str:
    return f"""SELECT vault_id, source_path, revision, content_hash, concat('body ', CAST(event_id % 13 AS STRING)) AS content, created_at
FROM ({sync_events(d)}) e WHERE NOT deleted AND source_path LIKE '%.md'"""


def conflicts(d: Dialect) -> str:
    return f"""SELECT event_id AS id, vault_id, device_id, source_path, revision - 1 - revision % 7 AS server_revision, content_hash,
       CASE WHEN revision % 4 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, revision AS seq
FROM ({sync_events(d)}) e WHERE event_type = 'UPDATE' AND revision % 5 = 0"""


def half_log(d: Dialect) -> str:
    """State of each path after the first half of its vault's log."""
    return f"""SELECT vault_id, source_path, revision, content_hash, deleted FROM (
  SELECT *, row_number() OVER (PARTITION BY vault_id, source_path ORDER BY revision DESC) AS n FROM (
    SELECT *, max(revision) OVER (PARTITION BY vault_id) AS top FROM ({sync_events(d)}) e) a WHERE revision <= top / 2) b WHERE n = 1"""


def cursors(d: Dialect) -> str:
    """Two devices per vault: one at the half of the log, one near its end."""
    return f"""SELECT vault_id, device_id, CAST(CASE WHEN device_id = 'devA' THEN floor(top / 2) ELSE top - 20 END AS BIGINT) AS cursor
FROM (SELECT vault_id, max(revision) AS top FROM ({sync_events(d)}) e GROUP BY vault_id) t CROSS JOIN (SELECT 'devA' AS device_id UNION ALL SELECT 'devB') x"""


def manifest(d: Dialect) -> str:
    return f"SELECT vault_id, 'devA' AS device_id, source_path, revision AS server_revision, content_hash FROM ({half_log(d)}) h WHERE NOT deleted"


def path_number(c: str = "source_path") -> str:
    return f"CAST(regexp_extract({c}, 'n([0-9]+)', 1) AS BIGINT)"


def scan(d: Dialect) -> str:
    return f"""SELECT vault_id, device_id, source_path, CASE WHEN {path_number()} % 4 = 1 THEN {d.sha("'edited'")} ELSE content_hash END AS content_hash
FROM ({manifest(d)}) m WHERE {path_number()} % 5 <> 0
UNION ALL SELECT vault_id, device_id, replace(source_path, 'notes/n', 'notes/x') AS source_path, {d.sha("'added'")} AS content_hash FROM ({manifest(d)}) m WHERE {path_number()} % 6 = 0"""


def tracked(d: Dialect) -> str:
    """Conflicts that the device knows of."""
    return f"""SELECT vault_id, device_id, source_path, server_revision + 3 AS server_revision, CASE WHEN {path_number()} % 2 = 0 THEN {d.sha("'edited'")} ELSE {d.sha("'other'")} END AS local_content_hash,
       {path_number()} % 5 = 0 AS server_deleted FROM ({manifest(d)}) m WHERE {path_number()} % 3 = 0"""


def requests(d: Dialect) -> str:
    """The second half of each log, read as requests."""
    return f"""SELECT e.vault_id, e.source_path, e.revision AS seq,
       CASE e.event_type WHEN 'CREATE' THEN 'PUT' WHEN 'DELETE' THEN 'DELETE' WHEN 'RESTORE' THEN 'RESTORE' ELSE CASE WHEN e.event_id % 3 = 0 THEN 'FORCE' ELSE 'PUT' END END AS kind,
       CASE e.event_type WHEN 'CREATE' THEN CAST(0 AS BIGINT) ELSE h.revision END AS base_revision, e.content_hash, CAST(NULL AS BIGINT) AS restore_revision
FROM (SELECT *, max(revision) OVER (PARTITION BY vault_id) AS top FROM ({sync_events(d)}) x) e
LEFT JOIN ({half_log(d)}) h ON h.vault_id = e.vault_id AND h.source_path = e.source_path WHERE e.revision > e.top / 2"""


def writes(d: Dialect) -> str:
    """Requests as they come in: bad paths, unknown vaults and large files among them, and restores that name a revision."""
    return f"""SELECT CASE WHEN seq % 83 = 0 THEN 'v99' ELSE vault_id END AS vault_id, CASE WHEN seq % 97 = 0 THEN concat('../', source_path) WHEN seq % 89 = 0 THEN concat(source_path, '.zip') WHEN seq % 79 = 0 THEN concat('.trash/', source_path)
         WHEN seq % 5 = 0 THEN concat(' ', source_path) ELSE source_path END AS source_path, seq, kind, base_revision, content_hash, CASE WHEN seq % 3 = 0 THEN base_revision WHEN seq % 3 = 1 THEN seq + 100000 END AS restore_revision,
       CAST(CASE WHEN seq % 71 = 0 THEN 60000000 WHEN seq % 73 = 0 THEN -1 ELSE seq % 900 END AS BIGINT) AS n_bytes, concat('dev', CAST(seq % 5 AS STRING)) AS device_id, CASE WHEN seq % 2 = 0 THEN 'mcp' END AS origin
FROM ({requests(d)}) q"""


def paths(d: Dialect) -> str:
    """Good and bad paths; sizes; a directory flag."""
    kinds = [
        "concat('notes/d', k, '.md')", "concat(' notes/d', k, '.md')", "''", "concat('a\\\\', k, '.md')" if d.spark else "concat('a\\', k, '.md')", "concat('/abs/', k, '.md')", "concat('a//', k, '.md')",
        "concat('../', k, '.md')", "concat('dir./', k, '.md')", "concat('x', k, '.md ')", "concat(repeat('é', 126 + CAST(doc_id % 4 AS INT)), '.md')", "'sub/con.md'", "'COM10.md'", "'com1.x.md'",
        "concat('C:/', k, '.md')", "concat('.editor/', k, '.md')", "concat('a/.trash/', k, '.md')", "concat('n', k, '.conflict.dev.2024.md')", "concat('img', k, '.sync-conflict-1.png')",
        "concat('photo', k, '.JPG')", "concat('doc', k, '.pdf')", "'.env'", "concat('a', k, '.env')", "concat('x', k, '.zip')", "'a/.DS_Store'", "'Thumbs.db'", "concat('.hidden/', k, '.md')", "concat('note', k, '.MD')", "concat('data', k, '.csv')",
    ]
    cases = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds))
    return f"""SELECT doc_id, CASE doc_id % {len(kinds)} {cases} END AS path, doc_id % 7 = 0 AS is_directory,
       CASE WHEN doc_id % 31 = 0 THEN -1 ELSE (doc_id % 40) * 1048576 END AS n_bytes, doc_id % 28 AS k
FROM (SELECT *, CAST(doc_id AS STRING) AS k FROM documents) x"""


def notes(d: Dialect) -> str:
    """Documents as notes: frontmatter (some broken), a heading, the text as one paragraph."""
    nl = d.newline
    return f"""SELECT doc_id, concat('v', CAST(doc_id % 3 AS STRING)) AS vault_id, concat('notes/d', CAST(doc_id AS STRING), '.md') AS source_path,
       concat('---', {nl}, 'title: D', CAST(doc_id AS STRING), {nl}, CASE WHEN doc_id % 20 = 3 THEN '' ELSE concat('type: reference', {nl}) END, 'project: ', source, {nl}, 'domain: ', lang, {nl}, 'status: current', {nl},
              'priority: ', CASE WHEN doc_id % 20 = 7 THEN 'urgent' ELSE 'high' END, {nl}, 'visibility: personal', {nl}, 'tags: [', lang, ', ', source, ']', {nl}, 'vectorize: true', {nl}, 'created: 2024-01-01', {nl}, 'updated: 2024-01-02', {nl},
              '---', {nl}, '# D', CAST(doc_id AS STRING), {nl}, {nl}, replace(text, {nl}, concat({nl}, {nl}))) AS content FROM documents"""


def watch(d: Dialect) -> str:
    return f"""SELECT concat('v', CAST(user_id % 8 AS STRING)) AS vault_id, event_id, CAST(ts AS TIMESTAMP) AS ts, concat('notes/n', CAST({d.num('props')} % 25 AS STRING), '.md') AS source_path, event_id % 10 = 0 AS is_directory FROM events"""


def runs(d: Dialect) -> str:
    """Sync runs: one per purchase event, as long as fits before the vault's next one."""
    return f"""SELECT vault_id, ts AS begin, CASE WHEN nxt IS NOT NULL AND nxt < ts + INTERVAL '90' MINUTE THEN nxt ELSE ts + INTERVAL '90' MINUTE END - INTERVAL '1' SECOND AS {'`end`' if d.spark else '"end"'}
FROM (SELECT concat('v', CAST(user_id % 8 AS STRING)) AS vault_id, CAST(ts AS TIMESTAMP) AS ts, lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase') p
WHERE nxt IS NULL OR nxt > ts + INTERVAL '2' SECOND"""


SPARK, DUCK = Dialect(True), Dialect(False)
ALL = {f.__name__: f for f in (sync_events, chunks, files, vaults, asked, asks, golden, search_logs, versions, conflicts, half_log, cursors, manifest, scan, tracked, requests, writes, paths, notes, watch, runs)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture (or a table of the driver) over a folder of tables."""
    if name in BASES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ALL[name](SPARK)
    used = [b for b in BASES if re.search(rf"\b(FROM|JOIN) {b}\b", text)]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASES)})\b", r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{b: table(spark, sf_dir, b) for b in used})


def ctes(*names: str) -> str:
    """``WITH fx_<name> AS (...)`` in the oracle's dialect."""
    text = ",\n".join(f"fx_{n} AS ({ALL[n](DUCK)})" for n in names)
    return f"WITH {text}\n".replace("make_interval(0, 0, 0, CAST(g % 12 AS INT))", "to_days(CAST(g % 12 AS INT))")
