"""Text functions of notes, queries and reports (``Column`` in, ``Column`` out)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A word (letters, digits, underscore) or one other visible character, in Unicode.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"
TERM = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
PREVIEW_CHARS, SLUG_CHARS, HINT_TAGS = 500, 60, 5


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def slug(title: Column) -> Column:
    out = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", "")
    out = F.regexp_replace(out, r"[\s_-]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, SLUG_CHARS)


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parsed_vector(literal: Column) -> Column:
    return F.from_json(literal, "array<float>")


def embedding_input(title: Column, kind: Column, project: Column, domain: Column, headings: Column, tags: Column, content: Column) -> Column:
    """Null tags are no tags."""
    return F.concat(
        F.lit("Title: "), title, F.lit("\nType: "), kind, F.lit("\nProject: "), project, F.lit("\nDomain: "), domain,
        F.lit("\nHeading: "), F.array_join(headings, " > "), F.lit("\nTags: "), F.coalesce(F.array_join(tags, ", "), F.lit("")), F.lit("\n\nContent:\n"), F.trim(content),
    )


def agent_hint(kind: Column, priority: Column, project: Column, domain: Column, headings: Column, tags: Column) -> Column:
    """Parts that are blank or usual are left out."""
    given = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), kind, F.lit("]")),
        F.when(priority != "medium", F.concat(F.lit("priority:"), priority)),
        given("project:", project),
        given("domain:", domain),
        given("section:", F.try_element_at(headings, F.lit(-1))),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags:"), F.array_join(F.slice(tags, 1, HINT_TAGS), ","))),
    )


def lexical_document(title: Column, path: Column, tags: Column, content: Column) -> Column:
    tag_text = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.translate(path, "/.", "  "), tag_text, content)


def terms(document: Column) -> Column:
    """Lower-case terms; a hyphenated word gives itself and its parts."""
    words = F.regexp_extract_all(F.lower(document), F.lit(TERM), 0)
    parts = F.flatten(F.transform(F.filter(words, lambda w: F.contains(w, F.lit("-"))), lambda w: F.split(w, "-")))
    return F.concat(words, parts)


def positioned(document: Column) -> Column:
    """Lower-case terms in the order of the text; a hyphenated word is followed by its parts. A term's index is its position."""
    words = F.regexp_extract_all(F.lower(document), F.lit(TERM), 0)
    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))))


#: A quoted phrase or a word of a query, with the minus signs before it.
OPERAND = r"((?:-\s*)*)(\"[^\"]*\"?|[^\s\"-][^\s\"]*)"
LITERAL = "struct<phrase: array<string>, barred: boolean>"


def query_tree(query: Column) -> Column:
    """array<array<struct(phrase, barred)>>: alternatives of literals that all must hold.

    The syntax of a web search box: words side by side must all be there, quoted
    words in that order with nothing in between, ``or`` between two operands
    begins an alternative, a minus bars what follows it (two minuses cancel
    out). What else could be an operator (``&|!()``) is a space. An ``or``
    that has no operand on one of its sides is a word; an operand without a term
    is left out, and so is an alternative without any.
    """
    plain = F.translate(F.coalesce(query, F.lit("")), "&|!()", "     ")
    signs, values = (F.regexp_extract_all(F.lower(plain), F.lit(OPERAND), i) for i in (1, 2))
    pairs = F.arrays_zip(signs.alias("sign"), values.alias("value"), F.sequence(F.lit(1), F.size(values)).alias("place"))
    pairs = F.when(F.size(values) > 0, pairs).otherwise(F.array().cast("array<struct<sign: string, value: string, place: int>>"))
    start = F.struct(
        F.array().cast(f"array<array<{LITERAL}>>").alias("done"), F.array().cast(f"array<{LITERAL}>").alias("now"), F.lit(False).alias("operand"), F.size(values).alias("n"),
    )

    def step(state: Column, token: Column) -> Column:
        splits = state["operand"] & (token["sign"] == "") & (token["value"] == "or") & (token["place"] < state["n"])
        barred = F.length(F.regexp_replace(token["sign"], "[^-]", "")) % 2 == 1
        literal = F.struct(positioned(token["value"]).alias("phrase"), barred.alias("barred"))
        return F.struct(
            F.when(splits, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
            F.when(splits, F.array().cast(f"array<{LITERAL}>")).otherwise(F.concat(state["now"], F.array(literal))).alias("now"),
            (~splits).alias("operand"), state["n"].alias("n"),
        )

    every = F.aggregate(pairs, start, step, lambda state: F.concat(state["done"], F.array(state["now"])))
    return F.filter(F.transform(every, lambda group: F.filter(group, lambda x: F.size(x["phrase"]) > 0)), lambda group: F.size(group) > 0)


def tree_terms(tree: Column, barred: bool | None = None) -> Column:
    """The distinct terms of a query tree: all, those of barred literals, or those of the others."""
    literals = F.flatten(tree)
    if barred is not None:
        literals = F.filter(literals, lambda x: x["barred"] == barred)
    return F.array_distinct(F.flatten(F.transform(literals, lambda x: x["phrase"])))


def tree_holds(tree: Column, places: Column) -> Column:
    """Whether a document holds for a tree; ``places``: map of the document's terms to their positions."""

    def phrase(words: Column) -> Column:
        rest = F.slice(words, F.lit(2), F.size(words))
        follows = lambda p: F.forall(F.transform(rest, lambda w, i: F.coalesce(F.array_contains(F.try_element_at(places, w), p + i + 1), F.lit(False))), lambda x: x)
        return F.coalesce(F.exists(F.try_element_at(places, F.element_at(words, 1)), follows), F.lit(False))

    return F.exists(tree, lambda group: F.forall(group, lambda x: phrase(x["phrase"]) != x["barred"]))


def query_terms(query: Column) -> Column:
    """struct(must, must_not): the words of a query without quotes and ``or``; ``query_tree`` reads the whole syntax."""
    pieces = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    minus = lambda w: F.startswith(w, F.lit("-"))
    words = lambda a: F.array_distinct(F.flatten(F.transform(a, lambda w: F.regexp_extract_all(w, F.lit(TERM), 0))))
    return F.struct(words(F.filter(pieces, lambda w: ~minus(w))).alias("must"), words(F.filter(pieces, minus)).alias("must_not"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double, from -1 to 1; null where a norm is 0 or the lengths differ.

    Summed in the order of the components and divided by the root of the product
    of the squared norms, so that it is the same to the last bit in SQL.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    bounded = F.transform(F.array(dot(a, b) / norms), lambda s: F.when(F.isnan(s), s).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), bounded[0])


def _stamp(clock: Column) -> Column:
    return F.date_format(clock, "yyyyMMdd-HHmmss")


def conflict_name(path: Column, device: Column, clock: Column, label: str = ".conflict.") -> Column:
    """``<stem>.conflict.<device>.<stamp><extension>`` beside the file."""
    stem, ext = F.regexp_replace(path, r"\.[^./]+$", ""), F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return F.concat(stem, F.lit(label), device, F.lit("."), _stamp(clock), ext)


def backup_name(path: Column, device: Column, clock: Column) -> Column:
    return conflict_name(path, device, clock, ".local-backup.conflict.")


def conflict_body(path: Column, device: Column, base: Column, server: Column, clock: Column, local_text: Column, server_text: Column) -> Column:
    return F.format_string(
        "# Sync Conflict\n\n- Path: %s\n- Device: %s\n- Client base revision: %s\n- Server revision: %s\n- Created at: %s\n\n## Local Version\n\n%s\n\n## Server Version\n\n%s\n",
        path, device, base.cast("string"), server.cast("string"), F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ssXXX"), local_text, server_text,
    )


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def rerank_candidate(rank: Column, path: Column, heading: Column, content: Column) -> Column:
    name = F.when(F.coalesce(heading, F.lit("")) != "", heading).otherwise(F.lit("(no heading)"))
    return F.concat(rank.cast("string"), F.lit(". ["), path, F.lit("] "), name, F.lit("\n"), F.substring(content, 1, PREVIEW_CHARS))


def rerank_prompt(query: Column, candidates: Column) -> Column:
    """The listwise prompt from an array of candidate lines in rank order."""
    return F.concat(
        F.lit("You are ranking search results by relevance to a query.\nQuery: "), query, F.lit("\n\nCandidates:\n"), F.array_join(candidates, "\n"),
        F.lit("\n\nReturn ONLY a JSON array of the candidate numbers above, ordered from most to least relevant to the query. Output nothing else -- no explanation, no code fences."),
    )


def rerank_order(reply: Column, n: Column) -> Column:
    """Ranks (from 1) in the order of a reply; what it leaves out follows in the old order."""
    found = F.regexp_extract(reply, r"(?s)(\[[^\[\]]*\])", 1)
    items = F.try_variant_get(F.try_parse_json(found), "$", "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "BIGINT")
    ranks = F.transform(kept, lambda v: F.variant_get(v, "$", "long"))
    ranks = F.array_distinct(F.filter(ranks, lambda r: (r >= 1) & (r <= n)))
    every = F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.array_union(F.coalesce(ranks, F.array().cast("array<long>")), every)


def retention_cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.make_interval(days=F.lit(days))


def note_markdown(title: Column, tags: Column, project: Column, day: Column, body: Column) -> Column:
    """A saved note: frontmatter, the title as heading, the body."""
    return F.format_string(
        '---\ntitle: "%s"\ntype: study-note\nproject: %s\ndomain: knowledge-management\nstatus: current\npriority: medium\nvisibility: personal\n'
        "tags: [%s]\nvectorize: true\ncreated: %s\nupdated: %s\nsource: agent\n---\n\n# %s\n\n%s\n",
        title, F.when(project != "", project).otherwise(F.lit("agent-knowledge")), F.array_join(tags, ", "), day, day, title, F.trim(body),
    )


def note_path(title: Column, day: Column) -> Column:
    return F.concat(F.lit("Agent Notes/"), day, F.lit("-"), slug(title), F.lit(".md"))


def register_sql(spark: SparkSession) -> None:
    """``immutable_tags_text(tags)`` for SQL users: the tags with spaces between; null tags give an empty text, null elements none."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION immutable_tags_text(tags ARRAY<STRING>) RETURNS STRING RETURN array_join(coalesce(tags, array()), ' ')")
