"""Queries of the path, file, hash and text rules with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteflow.functions import rules as R
from noteflow.functions import text as T
from noteflow.operators import maintenance as M
from noteflow.operators import search as S
from noteflow.plans.registry import sql_list, query
from noteflow.sources import tables as IO

PATH_ERROR = """CASE WHEN path IS NULL OR trim(path) = '' THEN 'source path is required' WHEN contains(path, chr(92)) THEN 'source path must use forward slashes'
  WHEN starts_with(trim(path), '/') THEN 'source path must be relative'
  WHEN len(list_filter(string_split(path, '/'), lambda s: s IN ('.', '..') OR trim(s) = '')) > 0 THEN 'source path cannot contain empty or traversal parts'
  WHEN len(list_filter(string_split(path, '/'), lambda s: s LIKE '%.' OR s LIKE '% ')) > 0 THEN 'source path segments cannot end with a dot or space'
  WHEN len(list_filter(string_split(path, '/'), lambda s: strlen(s) > 255)) > 0 THEN 'source path segments cannot exceed 255 bytes'
  WHEN len(list_filter(string_split(path, '/'), lambda s: regexp_matches(upper(split_part(s, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$'))) > 0 THEN 'source path cannot contain a reserved Windows filename'
  WHEN contains(string_split(trim(path), '/')[1], ':') THEN 'source path cannot include a drive prefix' END"""
IGNORED = "len(list_intersect(string_split(path, '/'), ['.editor', '.sync-agent', '.trash'])) > 0"
CONFLICT = r"regexp_matches(string_split(path, '/')[-1], '(?s)^.*(\.conflict\..*|\.sync-conflict.*)\.(md|png|jpg|jpeg|gif|webp|pdf)$')"
HIDDEN = "len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.'))) > 0"
EXT = r"lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\.[^.]+)$', 1))"
SYNC = f"NOT ({HIDDEN}) AND string_split(path, '/')[-1] NOT IN ('.DS_Store', 'Thumbs.db') AND NOT ({IGNORED}) AND NOT {CONFLICT} AND (path LIKE '%.md' OR {EXT} IN {sql_list(R.IMAGE_EXTENSIONS + ['.pdf'])})"
KIND = f"CASE WHEN ext = '.md' THEN 'markdown' WHEN ext IN {sql_list(R.IMAGE_EXTENSIONS)} THEN 'image' WHEN ext = '.pdf' THEN 'pdf' END"
POLICY_ERROR = f"CASE WHEN ext IN {sql_list(R.EXCLUDED_EXTENSIONS)} THEN 'file extension is explicitly excluded' WHEN ext NOT IN {sql_list(R.ALLOWED_EXTENSIONS)} THEN 'file extension is not allowed' END"


@query("pr01_checked_path", "paths", sql=f"SELECT doc_id, CASE WHEN error IS NULL THEN trim(path) END AS path, error FROM (SELECT *, {PATH_ERROR} AS error FROM fx_paths)")
def _(t):
    return t("paths").select("doc_id", R.checked_path(F.col("path")).alias("c")).select("doc_id", "c.path", "c.error")


@query("pr02_ignored", "paths", sql=f"SELECT doc_id, {IGNORED} AS ignored FROM fx_paths")
def _(t):
    return t("paths").select("doc_id", R.is_ignored(F.col("path")).alias("ignored"))


@query("pr03_conflict_file", "paths", sql=f"SELECT doc_id, {CONFLICT} AS conflict FROM fx_paths")
def _(t):
    return t("paths").select("doc_id", R.is_conflict_file(F.col("path")).alias("conflict"))


@query("pr04_vectorizable", "paths", sql=f"SELECT doc_id, path LIKE '%.md' AND NOT {CONFLICT} AND NOT ({IGNORED}) AS vectorizable FROM fx_paths")
def _(t):
    return t("paths").select("doc_id", R.is_vectorizable(F.col("path")).alias("vectorizable"))


@query("pr05_should_sync", "paths", sql=f"SELECT doc_id, {SYNC} AS sync FROM fx_paths")
def _(t):
    return t("paths").select("doc_id", R.should_sync(F.col("path"), True).alias("sync"))


@query("pr06_relevant_event", "paths", sql=f"SELECT doc_id, CASE WHEN is_directory THEN NOT ({HIDDEN}) AND NOT ({IGNORED}) ELSE {SYNC} END AS relevant FROM fx_paths")
def _(t):
    return t("paths").select("doc_id", R.is_relevant_event(F.col("path"), F.col("is_directory"), True).alias("relevant"))


@query("pr07_file_policy", "paths", sql=f"""SELECT doc_id, ext AS extension, {KIND} AS kind,
  CAST(CASE {KIND} WHEN 'markdown' THEN 2097152 WHEN 'image' THEN 10485760 WHEN 'pdf' THEN 31457280 END AS BIGINT) AS max_bytes, {KIND} = 'markdown' AS vectorize,
  CASE ext WHEN '.md' THEN 'text/markdown' WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' END AS mime, {POLICY_ERROR} AS error
  FROM (SELECT *, {EXT} AS ext FROM fx_paths)""")
def _(t):
    return t("paths").select("doc_id", R.file_policy(F.col("path")).alias("p")).select("doc_id", "p.*")


@query("pr08_size_error", "paths", sql=f"""SELECT doc_id, CASE WHEN n_bytes < 0 THEN 'file size cannot be negative' WHEN {POLICY_ERROR} IS NOT NULL THEN {POLICY_ERROR}
  WHEN n_bytes > CASE {KIND} WHEN 'markdown' THEN 2097152 WHEN 'image' THEN 10485760 ELSE 31457280 END THEN 'file exceeds size limit' END AS error,
  CASE WHEN n_bytes < 0 THEN 'file size cannot be negative' WHEN {POLICY_ERROR} IS NOT NULL THEN {POLICY_ERROR}
  WHEN n_bytes > CASE {KIND} WHEN 'pdf' THEN 31457280 ELSE 10485760 END THEN 'file exceeds size limit' END AS revision_error FROM (SELECT *, {EXT} AS ext FROM fx_paths)""")
def _(t):
    n = F.col("n_bytes")
    return t("paths").select("doc_id", R.size_error(F.col("path"), n).alias("error"), R.size_error(F.col("path"), n, R.REVISION_MARKDOWN_BYTES).alias("revision_error"))


@query("pr09_vault_id", "paths", sql="SELECT doc_id, CASE WHEN regexp_matches(trim(v), '^[a-z0-9-]+$') THEN trim(v) END AS vault_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(' v-', lang) WHEN 1 THEN concat(lang, '_x') WHEN 2 THEN upper(lang) ELSE source END AS v FROM documents)")
def _(t):
    v = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(' v-', lang) WHEN 1 THEN concat(lang, '_x') WHEN 2 THEN upper(lang) ELSE source END")
    return t("documents").select("doc_id", R.checked_vault_id(v).alias("vault_id"))


@query("pr10_metadata_filter", "chunks", sql="SELECT chunk_id FROM fx_chunks WHERE status = 'current' AND priority IN ('high', 'low') AND project IN ('p1', 'p2', 'p3') AND list_has_any(tags, ['en', 'src3'])")
def _(t):
    where = S.metadata_filter(priorities=["high", "low", "high"], tags=["en", "src3"]) & F.col("project").isin("p1", "p2", "p3")
    return t("chunks").where(where).select("chunk_id")


@query("pr10_query_filter", "chunks", "asked", sql="""SELECT q.query_id, c.chunk_id FROM (SELECT *, CASE WHEN query_id % 100 = 1 THEN ['current'] ELSE [] END AS f_status, CASE WHEN query_id % 150 = 1 THEN 'en' END AS f_domain FROM fx_asked) q
  JOIN fx_chunks c ON c.vault_id = q.vault_id WHERE (len(f_status) = 0 OR list_contains(f_status, c.status)) AND (f_domain IS NULL OR f_domain = c.domain) AND list_has_any(c.tags, ['en', 'fr'])""")
def _(t):
    q = t("asked").select("query_id", "vault_id", F.expr("CASE WHEN query_id % 100 = 1 THEN array('current') ELSE cast(array() AS array<string>) END").alias("f_status"),
                          F.expr("CASE WHEN query_id % 150 = 1 THEN 'en' END").alias("f_domain"), F.lit(None).cast("string").alias("f_project"), F.array(F.lit("en"), F.lit("fr")).alias("f_tags"))
    return t("chunks").join(q, "vault_id").where(S.query_filter()).select("query_id", "chunk_id")


@query("pr11_checked_queries", "asked", "vaults", sql="""SELECT query_id, CASE WHEN coalesce(query, '') = '' THEN 'query is required' WHEN top_k NOT BETWEEN 1 AND 10 THEN 'top_k must be between 1 and 10'
  WHEN min_score NOT BETWEEN 0 AND 1 THEN 'min_score must be between 0 and 1' WHEN v.vault_id IS NULL THEN 'vault not found' END AS error
  FROM (SELECT query_id, query, CASE WHEN query_id % 150 = 1 THEN 'v6' ELSE vault_id END AS vault_id, query_id % 13 AS top_k, (query_id % 120) / 100.0 AS min_score FROM fx_asked) q LEFT JOIN (SELECT * FROM fx_vaults WHERE is_active) v ON v.vault_id = q.vault_id""")
def _(t):
    q = t("asked").select("query_id", "query", F.expr("CASE WHEN query_id % 150 = 1 THEN 'v6' ELSE vault_id END").alias("vault_id"), (F.col("query_id") % 13).alias("top_k"), F.expr("(query_id % 120) / 100D").alias("min_score"))
    good, bad = S.checked_queries(q, t("vaults"))
    return good.select("query_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("query_id", "error"))


@query("pr13_reindex_candidates", "files", sql="SELECT id, index_status FROM fx_files WHERE status <> 'archived' AND source_path LIKE '%.md' AND index_status <> 'indexed'")
def _(t):
    return M.reindex_candidates(t("files"), changed_only=True).select("id", "index_status")


@query("pr14_index_gate", "files", sql="SELECT id, CASE WHEN vectorize AND NOT deleted AND status = 'current' THEN 'index' ELSE 'skipped' END AS gate FROM fx_files")
def _(t):
    return t("files").select("id", M.index_gate(F.col("source_path"), F.col("vectorize"), F.col("deleted"), F.lit(True), F.col("status")).alias("gate"))


@query("pr15_browse_logs", "search_logs", sql="""SELECT request_id, query, created_at FROM fx_search_logs WHERE vault_id = 'v3' AND created_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
  AND query ILIKE '%CLICK%' ORDER BY created_at DESC, request_id LIMIT 40""")
def _(t):
    at = lambda x: F.lit(x).cast("timestamp")
    return M.browse_logs(t("search_logs"), "v3", at("2024-01-03 00:00:00"), at("2024-01-20 00:00:00"), "CLICK", 40).select("request_id", "query", "created_at")


@query("pr16_attachment_events", "sync_events", sql="SELECT vault_id, revision FROM fx_sync_events WHERE source_path LIKE '%.md'")
def _(t):
    return t("sync_events").where(R.file_policy(F.col("source_path"))["kind"] == "markdown").select("vault_id", "revision")


@query("io03_vector_codec", sql="SELECT vec_id, len(embedding) AS n, concat('[', array_to_string([CAST(CAST(round(x * 1000) AS INT) AS VARCHAR) for x in embedding], ','), ']') AS literal, true AS round_trip FROM embeddings")
def _(t):
    # a float times an int is a double in Spark: 0.3195 would be 319.49999... there and 319.5 in SQL
    whole = F.transform("embedding", lambda x: F.round(x * F.lit(1000.0).cast("float")).cast("int"))
    back = T.parsed_vector(T.vector_literal(F.col("embedding")))
    return t("embeddings").select("vec_id", F.size(back).alias("n"), T.vector_literal(whole).alias("literal"), (back == F.col("embedding")).alias("round_trip"))


@query("io06_golden_errors", sql="""SELECT conv_id, turn, CASE WHEN trim(q) = '' THEN 'query is required' WHEN trim(v) = '' THEN 'vault_id is required' WHEN n = 0 THEN 'expected_sources is required' END AS error
  FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END AS q, CASE WHEN conv_id % 7 = 0 THEN '' ELSE role END AS v, conv_id % 3 AS n FROM conversations)""")
def _(t):
    rows = t("conversations").select("conv_id", "turn", F.expr("CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END").alias("query"), F.expr("CASE WHEN conv_id % 7 = 0 THEN '' ELSE role END").alias("vault_id"), F.expr("array_repeat('a.md', cast(conv_id % 3 AS int))").alias("expected_sources"))
    return rows.select("conv_id", "turn", IO.golden_error().alias("error"))


@query("io07_transport", sql="SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE base64(encode(text)) END AS sent, doc_id % 4 = 1 AS error, doc_id % 4 <> 1 AS same FROM documents")
def _(t):
    kind = F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("image")
    content = F.encode("text", "UTF-8")
    sent = F.regexp_replace(R.encoded_content(kind, content), "\r\n", "")
    broken = F.when(F.col("doc_id") % 4 == 1, F.concat(sent, F.lit("!"))).otherwise(sent)
    rows = t("documents").select("doc_id", sent.alias("sent"), content.alias("content"), R.decoded_content(kind, broken).alias("d"))
    return rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.decode("content", "UTF-8")).otherwise(F.col("sent")).alias("sent"), F.col("d.error").isNotNull().alias("error"), F.coalesce(F.col("d.content") == F.col("content"), F.lit(False)).alias("same"))


@query("io09_note_assembly", sql=r"""SELECT doc_id, concat('Agent Notes/2024-02-01-', left(regexp_replace(regexp_replace(regexp_replace(lower(left(text, 90)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '.md') AS path,
  sha256(concat('---', chr(10), 'title: "', left(text, 20), '"', chr(10), 'type: study-note', chr(10), 'project: ', source, chr(10), 'domain: knowledge-management', chr(10), 'status: current', chr(10), 'priority: medium', chr(10), 'visibility: personal', chr(10),
  'tags: [', lang, ', ', source, ']', chr(10), 'vectorize: true', chr(10), 'created: 2024-02-01', chr(10), 'updated: 2024-02-01', chr(10), 'source: agent', chr(10), '---', chr(10), chr(10), '# ', left(text, 20), chr(10), chr(10), trim(text, ' '), chr(10))) AS note FROM documents""")
def _(t):
    day = F.lit("2024-02-01")
    note = T.note_markdown(F.substring("text", 1, 20), F.array("lang", "source"), F.col("source"), day, F.col("text"))
    return t("documents").select("doc_id", T.note_path(F.substring("text", 1, 90), day).alias("path"), F.sha2(note, 256).alias("note"))


# The SQL of io09, fn13 and fn16 reads a prefix or leaves rows out, and so do those queries; these three take the whole columns.
@query("io09_whole_note_path")
def _(t):
    return t("documents").select("doc_id", T.note_path(F.col("text"), F.lit("2024-02-01")).alias("path"))


@query("fn13_every_embedding_input", "chunks")
def _(t):
    text = T.embedding_input(*(F.col(c) for c in ("title", "type", "project", "domain")), F.array("title", "domain"), F.col("tags"), F.col("content"))
    return t("chunks").select("chunk_id", F.sha2(text, 256).alias("input"))


@query("fn16_whole_query_terms")
def _(t):
    rows = t("conversations").select("conv_id", "turn", T.query_terms(F.concat("text", F.lit(" -"), "role")).alias("q"))
    return rows.select("conv_id", "turn", "q.must", "q.must_not")


@query("fn01_sha256", sql="SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t("documents").select("doc_id", R.sha256_text(F.col("text")).alias("hash"))


@query("fn02_checked_hash", sql="""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text) END AS hash,
  CASE doc_id % 4 WHEN 2 THEN 'content hash does not match the content' WHEN 3 THEN 'content hash must be 64 hex digits' END AS error FROM documents""")
def _(t):
    given = F.expr("CASE doc_id % 4 WHEN 0 THEN sha2(text, 256) WHEN 1 THEN concat('  ', upper(sha2(text, 256)), ' ') WHEN 2 THEN sha2(lang, 256) ELSE 'abc' END")
    return t("documents").select("doc_id", R.checked_hash(given, F.col("text")).alias("c")).select("doc_id", "c.hash", "c.error")


@query("fn03_base64_size", sql="SELECT doc_id, CAST(ceil(strlen(text) / 3.0) * 4 AS BIGINT) AS size FROM documents")
def _(t):
    return t("documents").select("doc_id", R.base64_size(F.octet_length("text")).alias("size"))


@query("fn07_slug", sql=r"SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(lower(left(text, 120)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM documents")
def _(t):
    return t("documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("fn08_token_count", sql=r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


@query("fn13_embedding_input", "chunks", sql="""SELECT chunk_id, sha256(concat('Title: ', title, chr(10), 'Type: ', type, chr(10), 'Project: ', project, chr(10), 'Domain: ', domain, chr(10), 'Heading: ', title, ' > ', domain, chr(10),
  'Tags: ', array_to_string(tags, ', '), chr(10), chr(10), 'Content:', chr(10), trim(content, ' '))) AS input FROM fx_chunks WHERE tags IS NOT NULL""")
def _(t):
    text = T.embedding_input(*(F.col(c) for c in ("title", "type", "project", "domain")), F.array("title", "domain"), F.col("tags"), F.col("content"))
    return t("chunks").where("tags IS NOT NULL").select("chunk_id", F.sha2(text, 256).alias("input"))


@query("fn14_agent_hint", "chunks", sql="""SELECT chunk_id, concat('[', type, ']', CASE WHEN priority <> 'medium' THEN concat(' priority:', priority) ELSE '' END, ' project:', project, ' domain:', domain, ' section:', title,
  CASE WHEN tags IS NOT NULL THEN concat(' tags:', array_to_string(tags, ',')) ELSE '' END) AS hint FROM fx_chunks""")
def _(t):
    return t("chunks").select("chunk_id", T.agent_hint(*(F.col(c) for c in ("type", "priority", "project", "domain")), F.array("title"), F.col("tags")).alias("hint"))


DOC_TERMS = r"regexp_extract_all(lower(concat_ws(' ', title, translate(source_path, '/.', '  '), array_to_string(coalesce(tags, []), ' '), content)), '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*')"


@query("fn15_postings", "chunks", sql=f"""SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w || flatten([string_split(x, '-') for x in w if contains(x, '-')])) AS term FROM (SELECT chunk_id, {DOC_TERMS} AS w FROM fx_chunks)) GROUP BY ALL""")
def _(t):
    return S.postings(t("chunks")).select("chunk_id", "term", "tf")


@query("fn16_query_tree", sql=r"""WITH q AS (SELECT conv_id, turn, lower(translate(concat(role, ' "', text, '" -', role, ' or "', left(text, 40), ' --', text), '&|!()', '     ')) AS q FROM conversations),
  tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(q, '((?:-\s*)*)("[^"]*"?|[^\s"-][^\s"]*)', 1)) AS sign, unnest(regexp_extract_all(q, '((?:-\s*)*)("[^"]*"?|[^\s"-][^\s"]*)', 2)) AS value, unnest(range(1, 1 + len(regexp_extract_all(q, '((?:-\s*)*)("[^"]*"?|[^\s"-][^\s"]*)')))) AS i FROM q),
  bare AS (SELECT *, sign = '' AND value = 'or' AS is_or, max(i) OVER (PARTITION BY conv_id, turn) AS n FROM tok),
  run AS (SELECT *, i - coalesce(max(CASE WHEN NOT is_or THEN i END) OVER (PARTITION BY conv_id, turn ORDER BY i), 1) AS k, max(CASE WHEN NOT is_or THEN i END) OVER (PARTITION BY conv_id, turn ORDER BY i) IS NULL AS leads FROM bare),
  marked AS (SELECT *, is_or AND i < n AND k % 2 = 1 AS splits FROM run),
  grouped AS (SELECT *, sum(splits::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g, regexp_extract_all(value, '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*') AS w FROM marked),
  lits AS (SELECT conv_id, turn, g, i, CASE WHEN len(replace(sign, ' ', '')) % 2 = 1 THEN '-' ELSE '' END || array_to_string(flatten([CASE WHEN contains(x, '-') THEN [x] || string_split(x, '-') ELSE [x] END for x in w]), '_') AS lit FROM grouped WHERE NOT splits AND len(w) > 0),
  alts AS (SELECT conv_id, turn, g, string_agg(lit, ' ' ORDER BY i) AS alt FROM lits GROUP BY ALL)
SELECT conv_id, turn, string_agg(alt, ' | ' ORDER BY g) AS tree FROM alts GROUP BY ALL""".replace("\\\\", "\\"))
def _(t):
    """Whole turns read as queries: a word, the turn in quotes, a barred word, and the turn again behind an ``or``."""
    text = F.concat("role", F.lit(' "'), "text", F.lit('" -'), "role", F.lit(' or "'), F.substring("text", 1, 40), F.lit(" --"), "text")
    shown = F.array_join(F.transform(T.query_tree(text), lambda g: F.array_join(F.transform(g, lambda x: F.concat(F.when(x["barred"], "-").otherwise(""), F.array_join(x["phrase"], "_"))), " ")), " | ")
    return t("conversations").select("conv_id", "turn", shown.alias("tree"))


@query("fn16_query_terms", sql=r"""SELECT conv_id, turn, list_filter(a, lambda x, i: list_position(a, x) = i) AS must, list_filter(b, lambda x, i: list_position(b, x) = i) AS must_not
  FROM (SELECT conv_id, turn, flatten([regexp_extract_all(w, '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*') for w in ws if NOT starts_with(w, '-')]) AS a,
  flatten([regexp_extract_all(w, '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*') for w in ws if starts_with(w, '-')]) AS b
  FROM (SELECT conv_id, turn, [w for w in regexp_split_to_array(lower(concat(left(text, 60), ' -', role)), '\s+') if w <> ''] AS ws FROM conversations))""")
def _(t):
    rows = t("conversations").select("conv_id", "turn", T.query_terms(F.concat(F.substring("text", 1, 60), F.lit(" -"), "role")).alias("q"))
    return rows.select("conv_id", "turn", "q.must", "q.must_not")


@query("fn18_cosine", "chunks", "asked", sql="SELECT query_id, chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query_embedding AS DOUBLE[])), 6) AS score FROM fx_asked q JOIN fx_chunks c ON c.vault_id = q.vault_id")
def _(t):
    return S.pair_cosines(t("asked"), t("chunks"))


@query("fn19_report_names", "conflicts", sql="""SELECT id, concat(regexp_replace(source_path, '\\.[^./]+$', ''), '.conflict.', device_id, '.20240201-000000', regexp_extract(source_path, '(\\.[^./]+)$', 1)) AS name,
  concat(regexp_replace(source_path, '\\.[^./]+$', ''), '.local-backup.conflict.', device_id, '.20240201-000000', regexp_extract(source_path, '(\\.[^./]+)$', 1)) AS backup,
  concat('# Sync Conflict', chr(10), chr(10), '- Path: ', source_path, chr(10), '- Device: ', device_id, chr(10), '- Client base revision: ', CAST(seq AS VARCHAR), chr(10), '- Server revision: ', CAST(server_revision AS VARCHAR), chr(10),
  '- Created at: 2024-02-01T00:00:00Z', chr(10), chr(10), '## Local Version', chr(10), chr(10), 'mine', chr(10), chr(10), '## Server Version', chr(10), chr(10), content_hash, chr(10)) AS body FROM fx_conflicts""")
def _(t):
    path, device, at = F.col("source_path"), F.col("device_id"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    body = T.conflict_body(path, device, F.col("seq"), F.col("server_revision"), at, F.lit("mine"), F.col("content_hash"))
    return t("conflicts").select("id", T.conflict_name(path, device, at).alias("name"), T.backup_name(path, device, at).alias("backup"), body.alias("body"))


@query("fn20_backoff", sql="SELECT event_id, least(0.5 * pow(2, event_id % 12), 60.0) AS delay FROM events")
def _(t):
    return t("events").select("event_id", T.backoff_seconds(F.col("event_id") % 12 + 1, 0.5, 60.0).alias("delay"))


@query("fn21_rerank_prompt", "chunks", sql="""SELECT source_path, concat('You are ranking search results by relevance to a query.', chr(10), 'Query: ', source_path, chr(10), chr(10), 'Candidates:', chr(10), string_agg(concat(CAST(n AS VARCHAR), '. [', source_path, '] ', CASE WHEN h <> '' THEN h ELSE '(no heading)' END, chr(10), left(content, 500)), chr(10) ORDER BY n),
  chr(10), chr(10), 'Return ONLY a JSON array of the candidate numbers above, ordered from most to least relevant to the query. Output nothing else -- no explanation, no code fences.') AS prompt
  FROM (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN '' ELSE title END AS h, row_number() OVER (PARTITION BY source_path ORDER BY chunk_id) AS n FROM fx_chunks) GROUP BY source_path""")
def _(t):
    from pyspark.sql import Window

    rows = t("chunks").withColumn("n", F.row_number().over(Window.partitionBy("source_path").orderBy("chunk_id")))
    heading = F.when(F.col("chunk_id") % 2 == 0, F.lit("")).otherwise(F.col("title"))
    line = T.rerank_candidate(F.col("n"), F.col("source_path"), heading, F.col("content"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("source_path").agg(lines.alias("lines")).select("source_path", T.rerank_prompt(F.col("source_path"), F.col("lines")).alias("prompt"))


@query("fn22_rerank_order", sql="""SELECT event_id, CASE event_id % 6 WHEN 0 THEN [3, 1, 2, 4] WHEN 1 THEN [2, 1, 3, 4] WHEN 2 THEN [4, 1, 2, 3] WHEN 3 THEN [1, 2, 3, 4] WHEN 4 THEN [2, 1, 3, 4] ELSE [1, 2, 3, 4] END AS ranks FROM events""")
def _(t):
    reply = F.expr("CASE event_id % 6 WHEN 0 THEN 'Sure: [3, 1, 2, 4].' WHEN 1 THEN '```json\\n[2, 2, 9, 0]\\n```' WHEN 2 THEN '[4, true, \"1\"]' WHEN 3 THEN 'no idea' WHEN 4 THEN '[2] then [1]' ELSE '[1, 2' END")
    return t("events").select("event_id", T.rerank_order(reply, F.lit(4)).alias("ranks"))


@query("fn23_cutoff", sql="SELECT event_id, CAST(ts AS TIMESTAMP) - INTERVAL 90 DAY AS cutoff FROM events")
def _(t):
    return t("events").select("event_id", T.retention_cutoff(F.col("ts").cast("timestamp"), 90).alias("cutoff"))


@query("ud_tags_text", "chunks", sql="SELECT chunk_id, coalesce(array_to_string(tags, ' '), '') AS tags_text FROM fx_chunks")
def _(t):
    chunks = t("chunks")
    T.register_sql(chunks.sparkSession)
    return chunks.selectExpr("chunk_id", "immutable_tags_text(tags) AS tags_text")


@query("so03_missing_fields", sql="SELECT doc_id, list_sort(list_filter(['created', 'domain', 'priority', 'project', 'status', 'tags', 'title', 'type', 'updated', 'vectorize', 'visibility'], lambda f: NOT list_contains(['title', 'type', lang, 'tags', CASE WHEN doc_id % 2 = 0 THEN 'status' ELSE 'domain' END], f))) AS missing FROM documents")
def _(t):
    from noteflow.functions.notes import FIELDS

    have = F.array(F.lit("title"), F.lit("type"), "lang", F.lit("tags"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'status' ELSE 'domain' END"))
    return t("documents").select("doc_id", F.sort_array(F.array_except(F.array(*map(F.lit, FIELDS)), have)).alias("missing"))


@query("so04_ordered_distinct", sql="SELECT doc_id, CASE WHEN lang = source THEN [lang, 'x'] ELSE [lang, 'x', source] END AS tags FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_distinct(F.array("lang", F.lit("x"), "lang", "source", F.lit("x"))).alias("tags"))
