"""Every registered query of the terminology and ledger operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import cache, glossary, ledger, matching, packing, responses, review, units
from loomspan.plans import chapters, jobs
from loomspan.sources import books, files, strict
from loomspan.storage import materialize, spread
from loomspan.streaming import ledger as live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "j1_term_matches"

#: A small glossary that occurs in the synthetic prose: ord, term, translation, approved, status, source_chapter.
TERMS = [
    (0, "the", "le", True, "verified", None), (1, "of the", "du", True, "verified", 1), (2, "in the", "dans le", True, "verified", 3),
    (3, "and the", "et le", False, "provisional", 2), (4, "la", "the", True, "verified", 6), (5, "de la", "of the", True, "verified", 2),
    (6, "MIT license", "licence MIT", True, "verified", 4), (7, "Apache  License", "licence Apache", False, "rejected", 5), (8, "éç", "x", True, "verified", None),
    (9, "the", "la", True, "verified", 1), (10, "und", "and", True, "verified", 8), (11, "", "nothing", True, "verified", None),
]
TERM_SCHEMA = "ord long, term string, translation string, approved boolean, status string, source_chapter int"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    own = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(own) if name in ("documents", "pages") else own  # texts are worth a task on every core


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, TERM_SCHEMA)


def _q(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return units.units(table(spark, sf, "documents"))


def _part_terms(spark: SparkSession, sf: str) -> DataFrame:
    second = F.element_at(F.split("p_name", " "), 2)
    term = F.when(F.col("p_partkey") % 5 == 0, second).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("  "), F.upper("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), term.alias("term"), F.col("p_type").alias("translation"), (F.col("p_size") % 4 != 0).alias("approved"))


def _glossary(spark: SparkSession, sf: str) -> DataFrame:
    """The parts as a glossary with states and chapters."""
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "provisional").when(k % 9 == 0, "rejected").otherwise("verified")
    extra = table(spark, sf, "part").select(k.alias("ord"), status.alias("status"), F.nullif(k % 12, F.lit(0)).cast("int").alias("source_chapter"))
    return _part_terms(spark, sf).join(extra, "ord")


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of two-word terms: neighbouring words of the benchmark's texts."""
    words = F.split(F.trim("text"), r"\s+")
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    own = table(spark, sf, "benchmark").select(words.alias("_w")).where(F.size("_w") > 1)
    return own.select(F.explode(pairs).alias("term")).distinct()


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.col("ts").cast("timestamp").alias("sent"), F.floor(F.col("value") * 100).cast("long").alias("tokens"), "event_type")


# ---- SQL shared by the oracles ----------------------------------------------------------------------

S_TERMS = "terms(ord, term, translation, approved, status, source_chapter) AS (VALUES " + ", ".join("(" + ", ".join([f"{t[0]}::BIGINT", *map(_q, t[1:])]) + ")" for t in TERMS) + ")"
S_UNITS = r"units AS (SELECT doc_id, source, i - 1 AS unit_ord, doc_id::VARCHAR || ':' || (i - 1)::VARCHAR AS unit_id, l[i] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l[i], '\S'))"
WORD = r"[\p{L}\p{N}_]"
S_NORM = r"lower(trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), ' '))"


def _match_sql(term: str) -> str:
    """One constant regex per term: engines compile it once."""
    words = r"[\s\p{Z}]+".join(term.split())
    edge = r"[^\p{L}\p{N}_]"
    return f"SELECT unit_id, source, {_q(term)} AS term FROM units WHERE regexp_matches(text, {_q(f'(?i)(^|{edge}){words}($|{edge})')})"


S_MATCH = "m AS (" + " UNION ALL ".join(_match_sql(t) for t in dict.fromkeys(t[1] for t in TERMS if t[1])) + ")"
S_PARTS = "parts AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 7 = 0 THEN '  ' || upper(p_name) ELSE p_name END AS term, p_type AS translation, p_size % 4 <> 0 AS approved FROM part)"
S_REQ = "req AS (SELECT event_id AS request_id, 'u' || user_id::VARCHAR AS scope, ts AS sent, floor(value * 100)::BIGINT AS tokens, event_type FROM events)"
S_TOKENS = rf"""list_sum(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda w: CASE WHEN strlen(w) <> length(w) THEN ceil(strlen(w) / 2.0) WHEN regexp_matches(w, '^[A-Za-z0-9_]') THEN ceil(length(w) / 5.0) ELSE 1 END))"""
S_FAST = f"{S_REQ}, fast AS (SELECT request_id, scope, tokens, TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(sent) - 1704067200000000) // 1000) AS sent FROM req)"
S_GLOSSARY = f"{S_PARTS}, glossary AS (SELECT ord, term, translation, approved, CASE WHEN ord % 4 = 0 THEN 'provisional' WHEN ord % 9 = 0 THEN 'rejected' ELSE 'verified' END AS status, nullif(ord % 12, 0)::INTEGER AS source_chapter FROM parts)"
S_KEYS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]')"
S_TOKENISED = "tok AS (SELECT unit_id, " + S_KEYS.format(x=S_NORM.format(x="text")) + " AS t FROM units)"


def _occurrences_sql(terms: str) -> str:
    """``occ(unit_id, term, i, n)``: places of the tokens of each term of the table ``terms``, by comparing lists."""
    inside = r"[\p{L}\p{N}_]"
    return f"""{S_TOKENISED}, known AS (SELECT term, k, len(k) AS n, k[1] AS k1, coalesce(k[3], '') AS k3 FROM (SELECT DISTINCT term, {S_KEYS.format(x=S_NORM.format(x='term'))} AS k FROM {terms} WHERE term <> '')),
here AS (SELECT unit_id, t, i, t[i] AS t1, coalesce(t[i + 2], '') AS t3 FROM (SELECT unit_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok)),
met AS (SELECT unit_id, term, t, k, i, n FROM here JOIN known ON t1 = k1 AND n = 1 UNION ALL SELECT unit_id, term, t, k, i, n FROM here JOIN known ON t1 = k1 AND t3 = k3 AND n >= 3 AND t[i:i + n - 1] = k UNION ALL SELECT unit_id, term, t, k, i, n FROM here JOIN known ON t1 = k1 AND n = 2 AND t[i + 1] = k[2]),
occ AS (SELECT unit_id, term, i, n FROM met WHERE (regexp_matches(k[1], '{inside}') OR NOT regexp_matches(coalesce(t[i - 1], ''), '{inside}')) AND (regexp_matches(k[n], '{inside}') OR NOT regexp_matches(coalesce(t[i + n], ''), '{inside}')))"""


S_MIDNIGHT = "(date_trunc('day', (sent AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC'"


# ---- texts and units --------------------------------------------------------------------------------


@query("b_units", f"WITH {S_UNITS} SELECT doc_id, unit_ord::INTEGER AS unit_ord, unit_id, sha256(text) AS digest FROM units")
def _(spark, sf):
    return _units(spark, sf).select("doc_id", "unit_ord", "unit_id", T.digest("text").alias("digest"))


@query("d5_chapters", "SELECT source AS book, chapter, doc_id FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS chapter, doc_id, text FROM documents) WHERE length(text) > 0")
def _(spark, sf):
    return units.chapters(table(spark, sf, "documents")).select("book", "chapter", "doc_id")


@query("a7_block_texts", r"""WITH b AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:title|p|h[1-3])(?:\s[^>]*)?>(.*?)</(?:title|p|h[1-3])>', 1) AS l FROM pages),
o AS (SELECT page_id, i - 1 AS block_ord, trim(regexp_replace(regexp_replace(l[i], '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM b))
SELECT page_id, block_ord::INTEGER AS block_ord, text FROM o WHERE text <> ''""")
def _(spark, sf):
    return books.block_texts(table(spark, sf, "pages"))


@query("d3_slots", r"""WITH p AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<(style|script)>.*?</(style|script)>', '<x>', 'g'), '>([^<]*)', 1) AS l FROM pages WHERE starts_with(html, '<!DOCTYPE html><html lang="en"')),
r AS (SELECT page_id, list_filter(l, lambda x: regexp_matches(x, '[A-Za-z]')) AS l FROM p)
SELECT page_id, (i - 1)::INTEGER AS run_ord, l[i] AS text FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM r)""")
def _(spark, sf):
    return books.slots(table(spark, sf, "pages")).select("page_id", "run_ord", "text")


@query("s1_render", r"""WITH m AS (SELECT page_id, html, regexp_replace(html, '>([^<]*[A-Za-z][^<]*)', '>«\1»', 'g') AS h FROM pages),
u AS (SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE html><html lang="en"') THEN regexp_replace(regexp_replace(h, '<style>«([^<]*)»', '<style>\1', 'g'), '<script>«([^<]*)»</p>«([^<]*)»', '<script>\1</p>\2', 'g') ELSE html END AS h FROM m)
SELECT page_id, sha256(h) AS digest FROM u""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    other = books.slots(pages).select("page_id", "run_ord", F.concat(F.lit("«"), "text", F.lit("»")).alias("target"))
    return books.rendered(pages, other).select("page_id", T.digest("html").alias("digest"))


@query("j16_broken_links", r"""WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
e AS (SELECT DISTINCT '/' || split_part(lower(split_part(html, '<title>', 2)), ' ', 1) AS name FROM pages) SELECT page_id::VARCHAR AS base, href FROM r WHERE href NOT IN (SELECT name FROM e WHERE page_id % 2 = 0 OR length(name) % 2 = 0)""")
def _(spark, sf):
    # odd pages link to a place in the other page, and only names of even length have that place
    pages = table(spark, sf, "pages")
    hrefs, _ = books.links(pages)
    refs = hrefs.select(F.col("page_id").cast("string").alias("base"), "href", F.col("href").alias("target"), F.when(F.col("page_id") % 2 == 1, "top").otherwise("").alias("fragment"))
    entries = pages.select(F.concat(F.lit("/"), F.get(F.split(F.lower(F.get(F.split("html", "<title>"), F.lit(1))), " "), F.lit(0))).alias("name"))
    return books.broken_links(refs, entries, entries.where(F.length("name") % 2 == 0).select("name", F.lit("top").alias("anchor")))


@query("b3_exact_parts", r"""WITH RECURSIVE c(doc_id, part_ord, part, rest) AS (SELECT doc_id, -1, '', text FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, part_ord + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT *, CASE WHEN length(rest) <= 1800 THEN length(rest) WHEN length(regexp_extract(left(rest, 1801), '^(?s:.*)[ \n]')) > 600 THEN length(regexp_extract(left(rest, 1801), '^(?s:.*)[ \n]')) ELSE 1800 END::INTEGER AS n FROM c WHERE rest <> ''))
SELECT doc_id, part_ord::INTEGER AS part_ord, sha256(part) AS digest FROM c WHERE part_ord >= 0""")
def _(spark, sf):
    parts = units.exact_parts(table(spark, sf, "documents").select("doc_id", "text"))
    return parts.select("doc_id", "part_ord", T.digest("part").alias("digest"))


@query("b4_affixes", rf"""WITH {S_UNITS}, a AS (SELECT unit_id, text, regexp_extract(text, '^([\s\p{{Z}}]*)', 1) AS prefix, regexp_extract(text, '([\s\p{{Z}}]*)$', 1) AS suffix FROM units)
SELECT unit_id, length(prefix) AS n_prefix, length(suffix) AS n_suffix, sha256(substr(text, length(prefix)::INTEGER + 1, (length(text) - length(prefix) - length(suffix))::INTEGER)) AS core FROM a""")
def _(spark, sf):
    return units.affixes(_units(spark, sf)).select("unit_id", F.length("prefix").cast("long").alias("n_prefix"), F.length("suffix").cast("long").alias("n_suffix"), T.digest("core").alias("core"))


@query("b8_chapter_texts", rf"""WITH {S_UNITS} SELECT doc_id, sha256(string_agg(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), chr(10) || chr(10) ORDER BY unit_ord)) AS digest FROM units GROUP BY doc_id""")
def _(spark, sf):
    return units.chapter_texts(_units(spark, sf)).select("doc_id", T.digest("text").alias("digest"))


@query("e6_first_marks", f"""WITH {S_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id, unit_ord) AS n, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id, unit_ord) AS before FROM units),
c AS (SELECT *, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id, unit_ord) - 1 AS k FROM o)
SELECT unit_id, before IS DISTINCT FROM doc_id AS names_document, first_value(k) OVER (PARTITION BY source, text ORDER BY doc_id, unit_ord)::BIGINT AS context_no FROM c""")
def _(spark, sf):
    return units.first_marks(_units(spark, sf)).select("unit_id", "names_document", "context_no")


@query("e7_grouped_units", f"""WITH RECURSIVE {S_UNITS}, r AS (SELECT doc_id AS block, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) AS i, length(text) AS n FROM units),
st(block, i, size, c, no, n) AS (SELECT DISTINCT block, 0::BIGINT, 0::BIGINT, 0, 0, 0::BIGINT FROM r UNION ALL
SELECT block, i, CASE WHEN closes THEN n ELSE size + n END, CASE WHEN closes THEN 1 ELSE c + 1 END, CASE WHEN closes THEN no + 1 ELSE no END, n FROM (SELECT r.block, r.i, r.n, st.size, st.c, st.no, st.c > 0 AND (st.size + r.n > 2400 OR st.c >= 40) AS closes FROM st JOIN r ON r.block = st.block AND r.i = st.i + 1))
SELECT block, no AS unit_no, count(*) AS runs, sum(n)::BIGINT AS chars FROM st WHERE i > 0 GROUP BY block, no""")
def _(spark, sf):
    runs = _units(spark, sf).select(F.col("doc_id").alias("block"), F.col("unit_ord").alias("run_ord"), "text")
    return units.grouped_units(runs).groupBy("block", "unit_no").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"))


@query("g9_book_ids", """WITH d AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT source, doc_id // 1024 AS b, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS h FROM d GROUP BY ALL)
SELECT source, 'bm_' || left(sha256(string_agg(h, '' ORDER BY b)), 16) AS book_id FROM b GROUP BY source""")
def _(spark, sf):
    return units.book_ids(table(spark, sf, "documents"))


@query("f7_text_tokens", rf"SELECT doc_id, greatest(1, coalesce({S_TOKENS}, 0)::BIGINT + (length(text) - length(replace(text, chr(10), ''))) // 4)::BIGINT AS tokens FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_tokens("text").alias("tokens"))


@query("f8_word_count", rf"SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:[''’-][\p{{L}}\p{{N}}_]+)*'))::BIGINT AS words FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("words"))


@query("g7_progress", rf"""WITH {S_UNITS}, a AS (SELECT length(text) AS c, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:[''’-][\p{{L}}\p{{N}}_]+)*')) AS w, greatest(1, coalesce({S_TOKENS}, 0))::BIGINT AS t, doc_id % 3 = 0 AS done FROM units)
SELECT sum(c)::BIGINT AS total_chars, sum(c) FILTER (done)::BIGINT AS done_chars, sum(w)::BIGINT AS total_words, sum(w) FILTER (done)::BIGINT AS done_words, sum(t)::BIGINT AS total_tokens, sum(t) FILTER (done)::BIGINT AS done_tokens FROM a""")
def _(spark, sf):
    return units.progress(_units(spark, sf).withColumn("done", F.col("doc_id") % 3 == 0))


@query("f9_text_fault", rf"""WITH {S_UNITS}, p AS (SELECT unit_id, text, CASE unit_ord % 5 WHEN 0 THEN '   ' WHEN 1 THEN repeat(text || ' ', 9) WHEN 2 THEN left(text, 20) WHEN 3 THEN text || chr(1) ELSE text END AS target FROM units),
t AS (SELECT *, regexp_replace(target, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS s FROM p)
SELECT unit_id, CASE WHEN s = '' THEN 'empty' WHEN contains(target, chr(1)) THEN 'illegal_character' WHEN length(s) > greatest(300, length(text) * 8) THEN 'too_long' WHEN length(text) > 160 AND length(s) < length(text) * 0.25 THEN 'too_short' END AS fault FROM t""")
def _(spark, sf):
    k = F.col("unit_ord") % 5
    target = F.when(k == 0, F.lit("   ")).when(k == 1, F.repeat(F.concat("text", F.lit(" ")), F.lit(9))).when(k == 2, F.left("text", F.lit(20))).when(k == 3, F.concat("text", F.lit("\x01"))).otherwise(F.col("text"))
    return _units(spark, sf).withColumn("target", target).select("unit_id", T.text_fault("text", "target").alias("fault"))


@query("f3_norm_term", f"WITH {S_PARTS} SELECT ord, {S_NORM.format(x='term')} AS key, length(term) AS n FROM parts")
def _(spark, sf):
    return _part_terms(spark, sf).select("ord", T.norm_term("term").alias("key"), F.length("term").cast("long").alias("n"))


@query("f_identity", """SELECT c_custkey, sha256('{"id":' || c_custkey::VARCHAR || ',"name":"' || c_name || '"}') AS digest, 'model:' || left(sha256(c_name), 16) AS scope, '#' || c_custkey::VARCHAR || ' (' || left(sha256(c_name), 8) || '…)' AS label,
left(regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g'), 60) AS safe, left(replace('key ' || c_name || ' used', c_name, '***'), 1200) AS redacted, try_cast(nullif(regexp_extract(c_name, '(\\d{1,9})', 1), '') AS INTEGER) AS known, least(120.0::DOUBLE, 5 * pow(2.0::DOUBLE, c_custkey % 7)) AS backoff FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", T.digest(T.canonical(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("digest"), T.scope_key("model", "c_name").alias("scope"), T.key_label("c_custkey", "c_name").alias("label"),
        T.safe_name("c_name").alias("safe"), T.redacted(F.concat(F.lit("key "), F.col("c_name"), F.lit(" used")), "c_name").alias("redacted"), T.known_from("c_name").alias("known"), T.backoff(F.col("c_custkey") % 7).alias("backoff"),
    )


@query("f16_quota_kind", """SELECT event_id, CASE event_type WHEN 'view' THEN 'daily' WHEN 'click' THEN 'tpm' WHEN 'signup' THEN 'rpm' WHEN 'error' THEN 'zero' END AS kind, CASE WHEN event_id % 3 = 0 THEN value ELSE greatest(0.0, (event_id % 9)::DOUBLE) END AS wait FROM events""")
def _(spark, sf):
    e = F.col("event_type")
    label = F.when(e == "view", "GenerateRequestsPerDayPerProject x").when(e == "click", "input_token_count").when(e == "signup", "requests per minute").when(e == "error", "other").otherwise("nothing known")
    raw = table(spark, sf, "events").withColumns({"labels": F.array(label), "zero": e == "error", "delays": F.array(F.concat((F.col("event_id") % 9).cast("string"), F.lit("s")), F.lit("junk")), "head": F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string"))})
    waits = F.when(F.col("event_id") % 3 == 0, T.retry_after("head", F.lit(None).cast("array<string>"), F.lit(0.0))).otherwise(T.retry_after(F.lit("x"), "delays", F.lit(0.0)))
    return raw.select("event_id", T.quota_kind(F.lit(""), "labels", "zero").alias("kind"), waits.alias("wait"))


@query("f18_pacific_midnight", f"WITH {S_REQ} SELECT request_id, epoch_us({S_MIDNIGHT}) AS midnight FROM req")
def _(spark, sf):
    return _requests(spark, sf).select("request_id", F.unix_micros(T.pacific_midnight("sent")).alias("midnight"))


@query("f30_languages", "SELECT doc_id, lang IS NULL OR lang = '' OR regexp_matches(lang, '(?i)^en([-_].*)?$') AS english, CASE WHEN regexp_matches(lang, '(?i)^en([-_].*)?$') THEN 'id' ELSE lang END AS out_lang FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_english("lang").alias("english"), T.rewritten_lang("lang").alias("out_lang"))


# ---- terms ------------------------------------------------------------------------------------------


@query("j1_term_matches", f"WITH {S_TERMS}, {S_UNITS}, {S_MATCH} SELECT unit_id, term FROM m")
def _(spark, sf):
    return matching.matches(_units(spark, sf), _terms(spark))


@query("j2_relevant_glossary", f"WITH {S_TERMS}, {S_UNITS}, {S_MATCH} SELECT source AS batch, array_to_string(list_sort(list(DISTINCT term)), '|') AS terms FROM m GROUP BY source")
def _(spark, sf):
    own = matching.relevant_glossary(_units(spark, sf).withColumnRenamed("source", "batch"), _terms(spark))
    return own.select("batch", F.array_join("terms", "|").alias("terms"))


@query("j1_large_glossary", rf"""WITH {S_UNITS}, w AS (SELECT string_split_regex(trim(text, ' '), '\s+') AS l FROM benchmark), phrases AS (SELECT DISTINCT l[i] || ' ' || l[i + 1] AS term FROM (SELECT l, unnest(range(1, len(l))) AS i FROM w)), {_occurrences_sql('phrases')} SELECT DISTINCT unit_id, term FROM occ""")
def _(spark, sf):
    return matching.matches(_units(spark, sf), _phrases(spark, sf))


@query("g11_occurrences", f"WITH {S_TERMS}, {S_UNITS}, {_occurrences_sql('terms')} SELECT unit_id, term, count(*) AS n FROM occ GROUP BY ALL")
def _(spark, sf):
    return matching.occurrence_counts(_units(spark, sf), _terms(spark))


@query("j3_affected_units", f"WITH {S_TERMS}, {S_UNITS}, {S_MATCH} SELECT DISTINCT unit_id FROM m WHERE term IN ('in the', 'und', 'MIT license')")
def _(spark, sf):
    watched = _terms(spark).where("term in ('in the', 'und', 'MIT license')")
    return matching.affected_units(_units(spark, sf), watched).select("unit_id")


@query("j5_inheritance", f"WITH {S_TERMS}, {S_UNITS}, {S_MATCH} SELECT unit_id AS run_id, sha256(text || '!') AS digest FROM units WHERE unit_id NOT IN (SELECT unit_id FROM m WHERE term IN ('the', 'la'))")
def _(spark, sf):
    own = _units(spark, sf)
    runs = own.select(F.col("unit_id").alias("run_id"), "unit_id")
    targets = own.select(F.col("unit_id").alias("run_id"), T.digest(F.concat("text", F.lit("!"))).alias("digest"))
    kept, _redo = matching.inheritance(targets, runs, matching.affected_units(own, _terms(spark).where("term in ('the', 'la')")))
    return kept


@query("g12_violations", f"""WITH {S_TERMS}, {S_UNITS}, us AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord) AS rank FROM terms WHERE approved AND term <> '' AND translation <> '') WHERE rank = 1), {_occurrences_sql('us')},
o AS (SELECT occ.*, ord, translation, -length(occ.term) AS size FROM occ JOIN us ON us.term = occ.term),
free AS (SELECT o.* FROM o ANTI JOIN o x ON x.unit_id = o.unit_id AND (x.size < o.size OR x.size = o.size AND x.ord < o.ord) AND x.i <= o.i AND o.i + o.n <= x.i + x.n),
s AS (SELECT unit_id, term, translation AS expected, count(*) AS src_count FROM free GROUP BY ALL),
tt AS (SELECT unit_id, {S_KEYS.format(x="lower(replace(text, 'of the', 'du'))")} AS t FROM units), e AS (SELECT DISTINCT translation AS expected, {S_KEYS.format(x='lower(translation)')} AS k FROM us),
d AS (SELECT s.unit_id, s.expected, (SELECT count(*) FROM (SELECT unnest(range(1, len(t) + 1)) AS i) WHERE t[i:i + len(k) - 1] = k) AS n FROM (SELECT DISTINCT unit_id, expected FROM s) s JOIN tt USING (unit_id) JOIN e USING (expected))
SELECT unit_id, term, expected, src_count, n AS tgt_count FROM s JOIN d USING (unit_id, expected) WHERE n < src_count""")
def _(spark, sf):
    own = _units(spark, sf)
    targets = own.select("unit_id", F.replace("text", F.lit("of the"), F.lit("du")).alias("target"))
    return matching.violations(own, targets, glossary.usable(_terms(spark)))


@query("j12_alignment", f"WITH {S_UNITS}, s AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 50 = 0 AND unit_ord = 0) AS off FROM units GROUP BY source) SELECT CASE WHEN sum(off) = 0 THEN 'verified' ELSE 'unverifiable' END AS status, sum(n)::BIGINT AS source_units, sum(n)::BIGINT AS output_units FROM s")
def _(spark, sf):
    own = _units(spark, sf).select(F.col("unit_id").alias("unit_ord"), F.col("doc_id").alias("document"), "text")
    other = own.withColumn("document", F.when((F.col("document") % 50 == 0) & F.col("unit_ord").endswith(":0"), -1).otherwise(F.col("document")))
    return matching.aligned(own, other)


@query("b16_unchanged_long", f"WITH {S_UNITS} SELECT unit_id FROM units WHERE length(text) > 100 AND doc_id % 4 = 0")
def _(spark, sf):
    pairs = _units(spark, sf).withColumn("target", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))))
    return matching.unchanged_long(pairs).select("unit_id")


@query("a8_parse_glossary", """WITH l AS (SELECT p_partkey AS n, p_name AS k, p_type AS v, p_partkey % 11 AS m FROM part), p AS (SELECT n, CASE WHEN m = 1 THEN NULL WHEN m = 2 THEN '' ELSE k END AS term, CASE WHEN m = 1 THEN NULL ELSE v END AS translation FROM l WHERE m <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n) AS i FROM p) SELECT n AS line_no, term, translation, CASE WHEN term IS NULL THEN 'form' WHEN term = '' THEN 'empty' WHEN i > 1 THEN 'duplicate' END AS fault FROM s""")
def _(spark, sf):
    m = F.col("p_partkey") % 11
    value = F.when(m == 0, F.lit("  # comment = x")).when(m == 1, F.col("p_name")).when(m == 2, F.concat(F.lit(" = "), "p_type")).when(m == 3, F.concat("p_name", F.lit(" => "), "p_type")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" = "), "p_type", F.lit("  ")))
    return glossary.parse_lines(table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), value.alias("value")))


@query("a16_key_list", "SELECT c_custkey, array_to_string(list_distinct_ordered, '|') AS keys FROM (SELECT c_custkey, CASE WHEN c_mktsegment = c_name THEN [c_name] ELSE [c_name, c_mktsegment] END AS list_distinct_ordered FROM customer)")
def _(spark, sf):
    raw = F.concat(F.lit(" "), "c_name", F.lit(",,\n"), "c_mktsegment", F.lit(" , "), "c_name")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(T.keep_list(raw), "|").alias("keys"))


@query("b9_usable_terms", f"WITH {S_GLOSSARY} SELECT ord, term, translation FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord) AS n FROM glossary WHERE approved AND term <> '' AND translation <> '') WHERE n = 1")
def _(spark, sf):
    return glossary.usable(_glossary(spark, sf)).select("ord", "term", "translation")


@query("b10_as_of", f"WITH {S_GLOSSARY}, c AS (SELECT DISTINCT turn AS chapter FROM conversations) SELECT chapter, ord, term, translation FROM (SELECT *, row_number() OVER (PARTITION BY chapter, term ORDER BY ord) AS n FROM glossary JOIN c ON source_chapter IS NULL OR source_chapter < chapter WHERE approved AND term <> '' AND translation <> '') WHERE n = 1")
def _(spark, sf):
    chapters = table(spark, sf, "conversations").select(F.col("turn").alias("chapter"))
    return glossary.as_of(chapters, _glossary(spark, sf)).select("chapter", "ord", "term", "translation")


@query("b11_pending", f"WITH {S_GLOSSARY}, r AS (SELECT {S_NORM.format(x='term')} AS key FROM glossary WHERE status = 'rejected') SELECT ord, term FROM glossary WHERE NOT approved AND status <> 'rejected' AND {S_NORM.format(x='term')} NOT IN (SELECT key FROM r)")
def _(spark, sf):
    own = _glossary(spark, sf)
    return glossary.pending(own, own.where("status = 'rejected'").select(T.norm_term("term").alias("key"))).select("ord", "term")


@query("b12_visible", f"WITH {S_GLOSSARY} SELECT 'unset' AS progress, ord FROM glossary WHERE source_chapter IS NULL OR source_chapter <= 1 UNION ALL SELECT '3', ord FROM glossary WHERE source_chapter IS NULL OR source_chapter <= 3 UNION ALL SELECT 'all', ord FROM glossary")
def _(spark, sf):
    t = _glossary(spark, sf)
    parts = [("unset", glossary.visible(t)), ("3", glossary.visible(t, 3)), ("all", glossary.visible(t, show_all=True))]
    out = [df.select(F.lit(name).alias("progress"), "ord") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("b13_notes", r"""WITH n AS (SELECT c_custkey AS ord, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'bab ' || (c_custkey % 10)::VARCHAR WHEN 2 THEN 'unclear' ELSE (c_custkey % 7)::VARCHAR || '-9' END AS k FROM customer),
s AS (SELECT *, try_cast(nullif(regexp_extract(k, '(\d{1,9})', 1), '') AS INTEGER) AS start FROM n) SELECT ord, name, k <> '' AND start IS NULL AS warning FROM s WHERE start IS NULL OR start <= 4""")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "").when(k == 1, F.concat(F.lit("bab "), (F.col("c_custkey") % 10).cast("string"))).when(k == 2, "unclear").otherwise(F.concat((F.col("c_custkey") % 7).cast("string"), F.lit("-9")))
    notes = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), raw.alias("known_from"))
    return glossary.notes_for_chapter(notes, 4).select("ord", "name", "warning")


@query("j4_glossary_diff", f"""WITH {S_PARTS}, o AS (SELECT ord, term, {S_NORM.format(x='term')} AS key, {S_NORM.format(x='translation')} AS t, approved FROM parts WHERE key NOT IN ('red plate', 'ring')),
n AS (SELECT ord, term, {S_NORM.format(x='term')} AS key, CASE WHEN {S_NORM.format(x='term')} LIKE 'hot%' THEN 'new' ELSE {S_NORM.format(x='translation')} END AS t, approved FROM parts WHERE key NOT IN ('old rod')),
om AS (SELECT key, max_by((t, approved), ord) AS sig FROM o GROUP BY key), nm AS (SELECT key, max_by((t, approved), ord) AS sig FROM n GROUP BY key),
d AS (SELECT coalesce(om.key, nm.key) AS key, CASE WHEN om.key IS NULL THEN 'added' WHEN nm.key IS NULL THEN 'removed' WHEN om.sig IS DISTINCT FROM nm.sig THEN 'changed' END AS change FROM om FULL JOIN nm ON om.key = nm.key)
SELECT change, ord, term FROM d JOIN n USING (key) WHERE change IN ('added', 'changed') UNION ALL SELECT change, ord, term FROM d JOIN o USING (key) WHERE change = 'removed'""")
def _(spark, sf):
    parts = _part_terms(spark, sf)
    key = T.norm_term("term")
    old = parts.where(~key.isin("red plate", "ring"))
    new = parts.where(key != "old rod").withColumn("translation", F.when(key.startswith("hot"), "new").otherwise(F.col("translation")))
    return glossary.difference(old, new)


@query("j9_conflicts", rf"""WITH {S_PARTS}, k AS (SELECT *, {S_NORM.format(x='term')} AS key, {S_NORM.format(x='translation')} AS t FROM parts),
r AS (SELECT *, row_number() OVER w AS n, first_value(term) OVER w AS f, first_value(t) OVER w AS ft FROM k WHERE key <> '' WINDOW w AS (PARTITION BY key ORDER BY ord)), u AS (SELECT * FROM r WHERE n = 1)
SELECT CASE WHEN ft = t THEN 'duplicate' ELSE 'translation_mismatch' END AS kind, f AS term_a, term AS term_b FROM r WHERE n > 1
UNION ALL SELECT 'overlap', CASE WHEN s.ord < l.ord THEN s.term ELSE l.term END, CASE WHEN s.ord < l.ord THEN l.term ELSE s.term END FROM u s JOIN u l ON s.key <> l.key AND length(s.key) <= length(l.key) AND contains(' ' || l.key || ' ', ' ' || s.key || ' ')""")
def _(spark, sf):
    return glossary.conflicts(_part_terms(spark, sf))


@query("j15_manual_wins", f"WITH {S_PARTS}, a AS (SELECT * FROM parts WHERE ord % 10 <> 1), m AS (SELECT * FROM parts WHERE ord % 10 = 1) SELECT ord, term FROM a WHERE lower(term) NOT IN (SELECT lower(term) FROM m) UNION ALL SELECT ord, term FROM m")
def _(spark, sf):
    parts = _part_terms(spark, sf)
    return glossary.manual_wins(parts.where("ord % 10 <> 1"), parts.where("ord % 10 = 1")).select("ord", "term")


@query("j17_unknown_candidates", f"WITH {S_PARTS}, k AS (SELECT *, {S_NORM.format(x='term')} AS key FROM parts) SELECT ord, source_term FROM (SELECT ord, term AS source_term, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM k WHERE ord % 10 <> 1 AND key NOT IN (SELECT key FROM k WHERE ord % 10 = 1)) WHERE n = 1")
def _(spark, sf):
    parts = _part_terms(spark, sf)
    return glossary.unknown_candidates(parts.where("ord % 10 <> 1").withColumnRenamed("term", "source_term"), parts.where("ord % 10 = 1")).select("ord", "source_term")


@query("g10_fingerprint", f"""WITH {S_PARTS}, u AS (SELECT lower(term) AS term, translation FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord) AS n FROM parts WHERE term <> '' AND translation <> '') WHERE n = 1)
SELECT left(sha256('[' || string_agg('["' || term || '","' || translation || '"]', ',' ORDER BY term, translation) || ']'), 16) AS fingerprint FROM u""")
def _(spark, sf):
    return glossary.fingerprint(_part_terms(spark, sf))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as candidates: the first word is the term, its line the quote."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("length(text) > 0")
    line = F.get(F.split("text", "\\n"), F.lit(0))
    first = F.get(F.split(line, " "), F.lit(0))
    k = F.col("doc_id")
    return docs.select(
        k.alias("ord"), k.alias("chapter"), "text", first.alias("source_term"),
        F.when(k % 3 == 0, first).when(k % 3 == 1, F.lower(first)).otherwise("sebuah naga").alias("proposed"), F.when(k % 5 == 0, F.lit("not in the text at all")).otherwise(line).alias("supporting_text"),
        F.when(k % 2 == 0, "person").otherwise("artifact").alias("category"), F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "verified").otherwise("ambiguous")).otherwise("provisional").alias("verdict"), F.lit(None).cast("string").alias("corrected"),
    )


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in table.items()) + "}"


def _plain_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-zà-ÿ]+')"


S_CANDIDATES = rf"""{S_TERMS}, c AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN term WHEN 1 THEN lower(term) ELSE 'sebuah naga' END AS proposed, CASE WHEN doc_id % 5 = 0 THEN 'not in the text at all' ELSE line END AS quote
FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS line, split_part(split_part(text, chr(10), 1), ' ', 1) AS term FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0)),
a AS (SELECT array_to_string({_plain_sql('term')}, ' ') AS key, min(lower(trim(translation))) AS approved FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord) AS i FROM terms WHERE approved AND term <> '' AND translation <> '') WHERE i = 1 GROUP BY ALL),
w AS (SELECT *, array_to_string({_plain_sql('term')}, ' ') AS key, {_plain_sql('term')} AS src, {_plain_sql('proposed')} AS prop, regexp_extract_all(lower(proposed), '[a-zà-ÿ'']+') AS words, array_to_string({_plain_sql('quote')}, ' ') AS said, array_to_string({_plain_sql('text')}, ' ') AS chapter,
list_filter(regexp_extract_all(term, '[A-Za-zÀ-ÿ'']+'), lambda x: left(x, 1) = upper(left(x, 1)) AND left(x, 1) <> '''' AND NOT list_contains({list(review.HONORIFICS)!r}, lower(x))) AS names FROM c),
j AS (SELECT w.*, approved, row_number() OVER (PARTITION BY w.key ORDER BY doc_id) AS seen, {_map_sql(review.WORD_MAP)} AS m, {_map_sql(review.TITLES)} AS t FROM w LEFT JOIN a USING (key))"""


def _block_sql() -> str:
    """The longest common block of ``w`` from ``alo`` to ``ahi`` and ``p`` from ``blo`` to ``bhi``, of equally long ones the first in ``w``, then in ``p``."""
    size = "len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(w, i + 1, n) = substr(p, j + 1, n)))"
    return f"list_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {{'k': {size}, 'i': -i, 'j': -j}}))), 'DESC')[1]"


S_CLOSE = f"""pairs AS (SELECT DISTINCT w, p FROM (SELECT doc_id, lower(unnest(list_filter(names, lambda x: NOT list_contains(words, lower(x)) AND NOT (m[lower(x)] IS NOT NULL AND len(list_filter({_plain_sql('m[lower(x)]')}, lambda y: NOT list_contains(prop, y))) = 0)))) AS w FROM j) JOIN (SELECT doc_id, unnest(words) AS p FROM j) USING (doc_id)),
parts(w, p, alo, ahi, blo, bhi) AS (SELECT w, p, 0::BIGINT, length(w)::BIGINT, 0::BIGINT, length(p)::BIGINT FROM pairs UNION ALL
SELECT w, p, c[1], c[2], c[3], c[4] FROM (SELECT w, p, unnest([[alo, -b.i, blo, -b.j], [b.k - b.i, ahi, b.k - b.j, bhi]]) AS c FROM (SELECT *, {_block_sql()} AS b FROM parts WHERE alo < ahi AND blo < bhi) WHERE b.k > 0)),
near AS (SELECT w, p FROM (SELECT w, p, {_block_sql()}.k AS k FROM parts WHERE alo < ahi AND blo < bhi) GROUP BY w, p HAVING 2.0::DOUBLE * sum(k) / (length(w) + length(p)) > 0.6::DOUBLE AND 2.0::DOUBLE * sum(k) / (length(w) + length(p)) < 1),
close AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, lower(unnest(names)) AS w, words FROM j) JOIN near USING (w) WHERE list_contains(words, p) AND NOT list_contains(words, w))"""


def _rules_sql(r6: str) -> str:
    return rf"""SELECT doc_id AS ord, array_to_string(list_filter([
CASE WHEN said = '' OR NOT contains(chapter, said) THEN 'R1' END,
CASE WHEN len(list_filter(names, lambda x: NOT list_contains(prop, lower(x)) AND NOT (m[lower(x)] IS NOT NULL AND len(list_filter({_plain_sql('m[lower(x)]')}, lambda y: NOT list_contains(prop, y))) = 0))) > 0 THEN 'R2' END,
CASE WHEN len(list_filter(prop, lambda x: NOT list_contains({list(review.STOPWORDS)!r}, x) AND NOT list_contains(src, x) AND NOT list_contains(flatten(list_transform(src, lambda y: {_plain_sql('m[y]')})), x))) > 0 THEN 'R3' END,
CASE WHEN seen > 1 THEN 'R4' END,
CASE WHEN approved <> lower(trim(proposed)) THEN 'R5' END,
{r6},
CASE WHEN len(list_filter(names, lambda x: NOT list_contains(words, lower(x)) AND NOT coalesce(contains(lower(proposed), t[lower(x)]), false))) > 0 THEN 'R7' END,
CASE WHEN trim(term) <> '' AND NOT regexp_matches(quote, '(?i)(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(term) || '($|[^\p{{L}}\p{{N}}_])') THEN 'R8' END], lambda x: x IS NOT NULL), ',') AS rules FROM j"""


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    return review.findings(c.drop("text"), c.select("chapter", "text"), glossary.usable(_terms(spark)))


@query("v_rules", f"WITH RECURSIVE {S_CANDIDATES}, {S_CLOSE} {_rules_sql('CASE WHEN doc_id IN (SELECT doc_id FROM close) THEN ' + chr(39) + 'R6' + chr(39) + ' END')}")
def _(spark, sf):
    return _rules(spark, sf).select("ord", F.array_join("rules", ",").alias("rules"))


@query("v_rules_exact", f"WITH {S_CANDIDATES} {_rules_sql('NULL')}")
def _(spark, sf):
    # all rules but R6, the one that matches sequences
    return _rules(spark, sf).select("ord", F.array_join(F.array_remove("rules", "R6"), ",").alias("rules"))


@query("v9_router", """WITH c AS (SELECT l.doc_id AS ord, l.doc_id % 10 = 0 AS conflict, l.doc_id % 4 = 0 AS dirty, CASE WHEN l.doc_id % 2 = 0 THEN 'person' ELSE 'artifact' END AS category, CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'verified' ELSE 'ambiguous' END ELSE 'provisional' END AS v FROM labels l)
SELECT ord, CASE WHEN ord % 50 = 30 THEN false WHEN conflict OR v = 'ambiguous' THEN false WHEN dirty OR v <> 'verified' OR category <> 'person' THEN false ELSE true END AS approved,
CASE WHEN ord % 50 = 30 THEN 'rejected' WHEN conflict OR v = 'ambiguous' THEN 'ambiguous' WHEN dirty OR v <> 'verified' OR category <> 'person' THEN CASE WHEN v <> 'verified' THEN v ELSE 'provisional' END ELSE 'verified' END AS status FROM c""")
def _(spark, sf):
    k = F.col("doc_id")
    rules = F.array_compact(F.array(F.when(k % 4 == 0, "R1"), F.when(k % 10 == 0, "R5")))
    verdict = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "verified").otherwise("ambiguous")).otherwise("provisional")
    judged = table(spark, sf, "labels").select(k.alias("ord"), F.when(k % 50 == 30, F.lit("Not  wanted")).otherwise(F.concat(F.lit("term "), k.cast("string"))).alias("source_term"), rules.alias("rules"), F.when(k % 2 == 0, "person").otherwise("artifact").alias("category"), verdict.alias("verdict"), F.lit(None).cast("string").alias("corrected"))
    return review.routed(judged, spark.createDataFrame([("not wanted",)], "key string")).select("ord", "decision.approved", "decision.status")


@query("g14_discovery_counts", """WITH c AS (SELECT doc_id % 20 AS chapter, doc_id % 4 = 0 AS approved, doc_id % 3 = 0 AS rejected FROM labels) SELECT chapter, count(*)::BIGINT AS discovered, count(*) FILTER (approved)::BIGINT AS auto_approved, count(*) FILTER (NOT approved AND NOT rejected)::BIGINT AS pending, count(*) FILTER (rejected AND NOT approved)::BIGINT AS rejected FROM c GROUP BY chapter""")
def _(spark, sf):
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "verified").when(k % 3 == 0, "rejected").otherwise("provisional")
    return review.discovery_counts(table(spark, sf, "labels").select((k % 20).alias("chapter"), F.struct((k % 4 == 0).alias("approved"), status.alias("status")).alias("decision")))


# ---- ledger -----------------------------------------------------------------------------------------


@query("e1_rolling_usage", f"WITH {S_REQ} SELECT request_id, count(*) OVER w AS window_requests, sum(tokens) OVER w::BIGINT AS window_tokens FROM req WINDOW w AS (PARTITION BY scope ORDER BY sent RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return ledger.rolling_usage(_requests(spark, sf)).select("request_id", "window_requests", "window_tokens")


@query("e2_rpm_waits", f"WITH {S_FAST} SELECT request_id, greatest(0.0::DOUBLE, coalesce((epoch_us(lag(sent, 2) OVER w) + 60000000 - epoch_us(sent)) / 1e6::DOUBLE, 0.0::DOUBLE)) AS wait FROM fast WINDOW w AS (PARTITION BY scope ORDER BY sent, request_id)")
def _(spark, sf):
    # the month squeezed into three quarters of an hour, so that limits are reached
    fast = F.timestamp_micros(F.lit(1704067200000000) + F.floor((F.unix_micros("sent") - 1704067200000000) / 1000).cast("long"))
    return ledger.rpm_waits(_requests(spark, sf).withColumn("sent", fast), 2).select("request_id", "wait")


@query("e3_tpm_waits", f"""WITH {S_FAST}, f AS (SELECT *, epoch_us(sent) AS us, least(10000, greatest(tokens, floor(8000 + least(160.0::DOUBLE, tokens * 0.05::DOUBLE)))) AS soft FROM fast),
p AS (SELECT a.request_id, a.us AS now, a.tokens AS n, a.soft, b.us, sum(b.tokens) OVER (PARTITION BY a.request_id ORDER BY b.us, b.request_id) AS gone, sum(b.tokens) OVER (PARTITION BY a.request_id) AS total
FROM f a JOIN f b ON a.scope = b.scope AND b.us > a.us - 60000000 AND (b.us < a.us OR b.us = a.us AND b.request_id < a.request_id)),
w AS (SELECT request_id, coalesce(min(us) FILTER (total - gone + n <= soft), max(us)) + 60000000 - any_value(now) AS us FROM p WHERE total + n > soft GROUP BY request_id)
SELECT f.request_id, greatest(0.0::DOUBLE, coalesce(w.us / 1e6::DOUBLE, 0.0::DOUBLE)) AS wait FROM f LEFT JOIN w USING (request_id)""")
def _(spark, sf):
    fast = F.timestamp_micros(F.lit(1704067200000000) + F.floor((F.unix_micros("sent") - 1704067200000000) / 1000).cast("long"))
    return ledger.tpm_waits(_requests(spark, sf).withColumn("sent", fast), 8000, 10000).select("request_id", "wait")


@query("g1_daily_usage", f"WITH {S_REQ} SELECT scope, epoch_us({S_MIDNIGHT}) AS day_start, count(*) AS used FROM req GROUP BY ALL")
def _(spark, sf):
    return ledger.daily_usage(_requests(spark, sf)).select("scope", F.unix_micros("day_start").alias("day_start"), "used")


@query("g2_adjusted_usage", f"WITH {S_REQ}, d AS (SELECT scope, {S_MIDNIGHT} AS day, count(*) AS used FROM req GROUP BY ALL), c AS (SELECT scope, max(day) AS day, -2 AS off FROM d GROUP BY scope) SELECT d.scope, epoch_us(d.day) AS day_start, greatest(0, used + coalesce(c.off, 0))::BIGINT AS used FROM d LEFT JOIN c ON d.scope = c.scope AND d.day = c.day")
def _(spark, sf):
    daily = ledger.daily_usage(_requests(spark, sf))
    stated = daily.groupBy("scope").agg(F.max("day_start").alias("day_start"), F.lit(-2).alias("offset"))
    return ledger.adjusted_usage(daily, stated).select("scope", F.unix_micros("day_start").alias("day_start"), "used")


@query("g4_latest", f"WITH {S_REQ} SELECT scope, epoch_us(max(sent)) AS latest FROM req GROUP BY scope")
def _(spark, sf):
    return ledger.latest(_requests(spark, sf)).select("scope", F.unix_micros("latest").alias("latest"))


@query("g5_session_averages", f"WITH {S_REQ}, c AS (SELECT CASE WHEN event_type = 'view' THEN 'count' ELSE 'generate' END AS kind, event_type <> 'error' AS success, tokens AS i, CASE WHEN request_id % 3 = 0 THEN NULL ELSE tokens * 2 END AS o, request_id % 2 = 0 AS a FROM req) SELECT avg(i) FILTER (kind = 'generate' AND success) AS avg_input, avg(o) FILTER (kind = 'generate' AND success) AS avg_output, count(*) FILTER (kind = 'generate' AND success AND a) AS measured, count(*) FILTER (kind = 'count') AS count_calls FROM c")
def _(spark, sf):
    k = F.col("request_id")
    calls = _requests(spark, sf).select(F.when(F.col("event_type") == "view", "count").otherwise("generate").alias("kind"), (F.col("event_type") != "error").alias("success"), F.col("tokens").alias("input"), F.when(k % 3 != 0, F.col("tokens") * 2).alias("output"), (k % 2 == 0).alias("actual"))
    return ledger.session_averages(calls)


@query("j7_generation_requests", f"WITH {S_REQ} SELECT request_id FROM req WHERE request_id % 3 = 0 OR event_type <> 'view'")
def _(spark, sf):
    r = _requests(spark, sf)
    metrics = r.where("request_id % 3 <> 0").select("request_id", F.when(F.col("event_type") == "view", "count").otherwise("generate").alias("kind"))
    return ledger.generation_requests(r, metrics).select("request_id")


@query("j8_orphaned_metrics", f"WITH {S_REQ} SELECT request_id FROM req WHERE sent < TIMESTAMP '2024-01-28 12:00:00'")
def _(spark, sf):
    r = _requests(spark, sf)
    return ledger.orphaned_metrics(r.select("request_id"), ledger.retained(r, "2024-01-30 12:00:00"))


@query("w7_cooldowns", f"WITH {S_REQ} SELECT scope, epoch_us(max(sent + to_seconds(tokens::INTEGER))) AS until FROM req WHERE event_type = 'error' GROUP BY scope HAVING max(sent + to_seconds(tokens::INTEGER)) > TIMESTAMP '2024-01-30 00:00:00'")
def _(spark, sf):
    stated = _requests(spark, sf).where("event_type = 'error'").select("scope", F.timestamp_micros(F.unix_micros("sent") + F.col("tokens") * 1_000_000).alias("until"))
    return ledger.cooldowns(stated, "2024-01-30 00:00:00").select("scope", F.unix_micros("until").alias("until"))


@query("w5_corrected", f"WITH {S_REQ} SELECT request_id, CASE WHEN request_id % 4 = 0 THEN tokens + 2 ELSE tokens END AS tokens FROM req")
def _(spark, sf):
    r = _requests(spark, sf)
    late = r.where("request_id % 4 = 0")
    actual = late.select("request_id", F.lit(1).alias("version"), (F.col("tokens") + 1).alias("tokens")).union(late.select("request_id", F.lit(2), F.col("tokens") + 2))
    return ledger.corrected(r, actual).select("request_id", "tokens")


@query("w15_budget_stop", f"WITH {S_REQ} SELECT request_id, coalesce(sum(tokens) OVER w, 0)::BIGINT AS spent, coalesce(sum(tokens) OVER w, 0) + tokens > 50000 AS paused FROM req WINDOW w AS (PARTITION BY scope ORDER BY sent, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, sf):
    return ledger.budget_stop(_requests(spark, sf), 50_000).select("request_id", "spent", "paused")


@query("e17_next_key", f"WITH {S_REQ}, d AS (SELECT scope, count(*) AS used FROM req GROUP BY scope) SELECT min_by(scope, (substr(scope, 2)::BIGINT - 20 + 300) % (SELECT count(*) FROM d)) AS scope FROM d WHERE used < (SELECT avg(used) FROM d)")
def _(spark, sf):
    daily = _requests(spark, sf).groupBy("scope").agg(F.count("*").alias("used"))
    limit = daily.agg(F.avg("used")).first()[0]
    keys = daily.select("scope", F.substring("scope", 2, 9).cast("long").alias("key_no"))
    n = max(keys.count(), 1)
    return ledger.next_key(keys, daily, limit or 0, 20 - 300 % n)


@query("g13_api_usage", f"WITH {S_REQ} SELECT event_type AS kind, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS requests FROM req GROUP BY event_type")
def _(spark, sf):
    return ledger.api_usage(_requests(spark, sf).select(F.col("event_type").alias("kind"), "tokens", F.lit(1).alias("requests")))


@query("w4_admissions", f"""WITH RECURSIVE {S_REQ}, r AS (SELECT scope, epoch_us(sent) / 1e9::DOUBLE AS "at", tokens, row_number() OVER (PARTITION BY scope ORDER BY sent, tokens) AS i FROM req),
st(scope, i, past, "at", tokens, admitted) AS (SELECT DISTINCT scope, 0::BIGINT, []::STRUCT(t DOUBLE, i BIGINT, n BIGINT)[], 0.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE FROM r UNION ALL
SELECT scope, i, CASE WHEN tokens > 10000 THEN past ELSE list_sort(list_append(q, {{'t': w, 'i': i, 'n': tokens}})) END, "at", tokens, CASE WHEN tokens > 10000 THEN 'Infinity'::DOUBLE ELSE w END FROM (
SELECT *, greatest("at", coalesce(CASE WHEN len(q) >= 2 THEN q[len(q) - 1].t + 60 END, "at"), coalesce(CASE WHEN excess > 0 THEN list_min(list_transform(range(1, len(q) + 1), lambda k: CASE WHEN list_sum(list_transform(q[1:k], lambda x: x.n)) >= excess THEN q[k].t END)) + 60 END, "at")) AS w FROM (
SELECT *, coalesce(list_sum(list_transform(q, lambda x: x.n)), 0) + tokens - 10000 AS excess FROM (
SELECT r.scope, r.i, r."at", r.tokens, st.past, list_filter(st.past, lambda x: x.t > r."at" - 60) AS q FROM st JOIN r ON r.scope = st.scope AND r.i = st.i + 1))))
SELECT scope, "at", tokens, admitted, admitted - "at" AS waited FROM st WHERE i > 0""")
def _(spark, sf):
    r = _requests(spark, sf).select("scope", (F.unix_micros("sent") / 1e9).alias("at"), "tokens")
    return live.admission_replay(r, 2, 10_000)


@query("e15_controller", f"""WITH RECURSIVE {S_REQ}, ev AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY request_id) AS i, CASE event_type WHEN 'error' THEN 'quota' WHEN 'view' THEN 'invalid' ELSE 'success' END AS e, CASE WHEN request_id % 2 = 0 THEN 'tpm' ELSE 'rpm' END AS k, tokens AS n FROM req),
st(scope, i, tpm, rpm, workers, batch, br, qr, th, ratio) AS (SELECT DISTINCT scope, 0::BIGINT, 250000::BIGINT, 15::BIGINT, 4::BIGINT, 12000::BIGINT, 0, 0, false, 1.65::DOUBLE FROM ev UNION ALL
SELECT scope, i, t2, r2, CASE WHEN back THEN least(4, workers + 1) WHEN e = 'quota' AND k = 'rpm' THEN greatest(1, workers - 1) ELSE workers END,
CASE WHEN ok AND br + 1 >= 10 AND n >= batch * 0.8::DOUBLE THEN least(40000, batch + 2000) WHEN e = 'invalid' THEN greatest(512, floor(batch * 0.9::DOUBLE)::BIGINT) ELSE batch END,
CASE WHEN ok AND br + 1 < 10 THEN br + 1 ELSE 0 END, CASE WHEN ok AND NOT eased THEN qr + 1 ELSE 0 END, CASE WHEN e = 'quota' THEN true WHEN back THEN t2 < 250000 OR r2 < 15 ELSE th END,
CASE WHEN ok AND n > 0 THEN greatest(1.5::DOUBLE, least(4.0::DOUBLE, greatest(greatest(0, 2 * n - 10) / n::DOUBLE * 1.1::DOUBLE, ratio * 0.98::DOUBLE))) ELSE ratio END FROM (
SELECT *, CASE WHEN eased THEN least(250000, ceil(tpm * 1.04::DOUBLE)::BIGINT) WHEN e = 'quota' AND k = 'tpm' THEN greatest(512, floor(tpm * 0.9::DOUBLE)::BIGINT) ELSE tpm END AS t2,
CASE WHEN back THEN least(15, rpm + 1) WHEN e = 'quota' AND k = 'rpm' THEN greatest(1, floor(rpm * 0.8::DOUBLE)::BIGINT) ELSE rpm END AS r2 FROM (
SELECT *, eased AND th AS back FROM (SELECT ev.*, st.tpm, st.rpm, st.workers, st.batch, st.br, st.qr, st.th, st.ratio, e = 'success' AS ok, e = 'success' AND qr + 1 >= CASE WHEN th THEN 20 ELSE 10 END AS eased FROM st JOIN ev ON ev.scope = st.scope AND ev.i = st.i + 1))))
SELECT scope, tpm, rpm, workers, batch, round(ratio, 6) AS ratio FROM st QUALIFY row_number() OVER (PARTITION BY scope ORDER BY i DESC) = 1""")
def _(spark, sf):
    e = F.col("event_type")
    events = _requests(spark, sf).select("scope", F.col("request_id").alias("at"), F.when(e == "error", "quota").when(e == "view", "invalid").otherwise("success").alias("event"), F.when(F.col("request_id") % 2 == 0, "tpm").otherwise("rpm").alias("kind"), F.col("tokens").alias("source"), (F.col("tokens") * 2).alias("output"), F.lit(10).alias("overhead"), F.col("tokens").alias("size"))
    return live.controller_replay(events, ceiling_tpm=250_000, ceiling_rpm=15, ceiling_workers=4, batch=12_000, max_batch=40_000).withColumn("ratio", F.round("ratio", 6))


@query("e16_calibration", f"""WITH RECURSIVE {S_REQ}, m AS (SELECT CASE WHEN substr(scope, 2)::BIGINT % 10 = 0 THEN 'hot' ELSE scope END AS scope, request_id, (CASE WHEN event_type <> 'error' THEN tokens * (80 + request_id % 60) // 100 + 90 END / (tokens + 128)::DOUBLE) AS r FROM req),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY request_id) AS i FROM m),
st(scope, i, request_id, factor, samples) AS (SELECT DISTINCT scope, 0::BIGINT, NULL::BIGINT, 1.0::DOUBLE, 0 FROM o UNION ALL
SELECT o.scope, o.i, o.request_id, CASE WHEN r IS NULL THEN factor ELSE greatest(0.1::DOUBLE, least(10.0::DOUBLE, CASE WHEN samples = 0 THEN r ELSE greatest(r, factor * 0.9::DOUBLE + r * 0.1::DOUBLE) END)) END, CASE WHEN r IS NULL THEN samples ELSE samples + 1 END FROM st JOIN o ON o.scope = st.scope AND o.i = st.i + 1)
SELECT request_id, round(factor, 6) AS factor FROM st WHERE i > 0""")
def _(spark, sf):
    r = _requests(spark, sf)
    hot = F.when(F.substring("scope", 2, 9).cast("long") % 10 == 0, "hot").otherwise(F.col("scope"))
    actual = F.when(F.col("event_type") != "error", F.floor(F.col("tokens") * (F.lit(80) + F.col("request_id") % 60) / 100) + 90)
    measured = r.select(hot.alias("scope"), F.col("request_id").alias("at"), (F.col("tokens") + 128).alias("raw"), actual.alias("actual"))
    return ledger.calibration(measured).select(F.col("at").alias("request_id"), F.round("factor", 6).alias("factor"))


# ---- cache, batches and responses -------------------------------------------------------------------


@query("t1_recent_jobs", "SELECT o_orderkey AS id, o_totalprice AS updated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def _(spark, sf):
    return cache.recent_jobs(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("updated")))


@query("s2_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.lit(0).alias("version"))
    fresh = o.where("id % 2 = 0")
    twice = fresh.withColumn("state", F.lit("old")).withColumn("version", F.lit(1)).union(fresh.withColumn("state", F.lit("new")).withColumn("version", F.lit(2)))
    return cache.upsert(o.where("id % 3 <> 0 or id % 2 = 1"), twice, ["id"]).select("id", "state")


@query("j6_cache_lookup", f"WITH {S_UNITS} SELECT unit_id AS run_id, sha256(text) AS digest FROM units WHERE doc_id % 5 NOT IN (0, 1) AND regexp_matches(text, '[^\\s\\p{{Z}}]')")
def _(spark, sf):
    runs = _units(spark, sf).select("unit_id", F.col("unit_id").alias("run_id"), "text", F.lit(None).cast("string").alias("context"), "doc_id")
    marked = cache.fingerprints(runs)
    k = F.col("doc_id") % 5  # 0: another fingerprint, 1: a damaged text
    stored = marked.select(F.lit("j").alias("job"), F.col("run_id").alias("run"), F.when(k == 0, F.lit("x")).otherwise(F.col("fingerprint")).alias("fingerprint"), F.col("text").alias("target"), F.when(k == 1, F.lit("y")).otherwise(T.digest("text")).alias("checksum"))
    return cache.lookup(marked, stored, "j").select("run_id", T.digest("target").alias("digest"))


@query("b15_pending_runs", f"WITH {S_UNITS} SELECT unit_id AS run_id FROM units WHERE doc_id % 3 <> 0")
def _(spark, sf):
    runs = _units(spark, sf).select(F.col("unit_id").alias("run_id"), "doc_id")
    return cache.pending_runs(runs, runs.where("doc_id % 3 = 0")).select("run_id")


@query("u2_coverage", f"WITH {S_UNITS} SELECT 'missing' AS side, unit_id AS run_id FROM units WHERE doc_id % 9 = 0 UNION ALL SELECT 'unknown', 'x' || unit_id FROM units WHERE doc_id % 10 = 0")
def _(spark, sf):
    runs = _units(spark, sf).select(F.col("unit_id").alias("run_id"), "doc_id")
    targets = runs.where("doc_id % 9 <> 0").select("run_id").union(runs.where("doc_id % 10 = 0").select(F.concat(F.lit("x"), "run_id")))
    return cache.coverage(runs, targets)


@query("s5_failure_stats", "SELECT event_type AS kind, count(*) AS failures, sum(event_id % 10)::BIGINT AS units, sum(event_id % 20)::BIGINT AS runs, sum(floor(value * 100)::BIGINT)::BIGINT AS est_input_tokens FROM events GROUP BY event_type")
def _(spark, sf):
    r = _requests(spark, sf)
    return cache.failure_stats(r.select(F.col("event_type").alias("kind"), (F.col("request_id") % 10).alias("units"), (F.col("request_id") % 20).alias("runs"), F.col("tokens").alias("est_input_tokens")))


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What was asked, and the bodies of answers with units and runs that are missing or come twice, fences and stray quotes."""
    own = _units(spark, sf).select(F.col("doc_id").cast("string").alias("batch"), "unit_id", F.col("unit_id").alias("run_id"), "unit_ord", "text")
    k = F.col("unit_ord") % 7
    run = F.struct(F.col("run_id").alias("id"), F.col("text"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    unit = F.struct(F.col("unit_id").alias("id"), F.when(k == 5, none).when(k == 6, F.array(run, run)).otherwise(F.array(run)).alias("runs"))
    rows = own.where(k != 3).select("batch", F.explode(F.when(k == 4, F.array(unit, unit)).otherwise(F.array(unit))).alias("u"))
    body = F.concat(F.lit('```json\n{"data": '), F.to_json(F.collect_list("u")), F.lit("}\n```"))
    # every third answer carries a note with quotes that are not escaped
    broken = F.when(F.col("batch").cast("long") % 3 == 0, F.replace(body, F.lit('{"data": '), F.lit('{"note": "he said "no" and left", "data": '))).otherwise(body)
    return own, rows.groupBy("batch").agg(broken.alias("body"))


@query("j11_reconcile", rf"""WITH {S_UNITS} SELECT unit_id AS run_id, CASE WHEN unit_ord % 7 = 3 THEN 'unit_missing' WHEN unit_ord % 7 = 4 THEN 'unit_duplicate' WHEN unit_ord % 7 = 5 THEN 'run_missing' WHEN unit_ord % 7 = 6 THEN 'run_duplicate'
WHEN NOT regexp_matches(text, '[^\s\p{{Z}}]') THEN 'empty' END AS fault FROM units""")
def _(spark, sf):
    own, bodies = _answers(spark, sf)
    return responses.reconciled(own, responses.decoded(bodies)).select("run_id", "fault")


S_JUDGED = rf"""judged AS (SELECT doc_id::VARCHAR AS batch, unit_id, text, CASE WHEN unit_ord % 7 = 3 THEN 'unit_missing' WHEN unit_ord % 7 = 4 THEN 'unit_duplicate' WHEN unit_ord % 7 = 5 THEN 'run_missing' WHEN unit_ord % 7 = 6 THEN 'run_duplicate'
WHEN NOT regexp_matches(text, '[^\s\p{{Z}}]') THEN 'empty' END AS fault FROM units)"""


@query("w11_salvage", rf"WITH {S_UNITS}, {S_JUDGED} SELECT unit_id AS run_id, fault IS NULL AS kept, coalesce(fault, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS detail FROM judged")
def _(spark, sf):
    own, bodies = _answers(spark, sf)
    good, bad = responses.salvaged(materialize(responses.reconciled(own, responses.decoded(bodies)).drop("text")))
    return good.select("run_id", F.lit(True).alias("kept"), T.digest("target").alias("detail")).unionByName(bad.select("run_id", F.lit(False).alias("kept"), F.col("fault").alias("detail")))


@query("g17_reasons", rf"WITH {S_UNITS}, {S_JUDGED}, f AS (SELECT batch, fault, min(unit_id) AS first_id FROM judged WHERE fault IS NOT NULL GROUP BY ALL) SELECT batch, string_agg(fault, ',' ORDER BY first_id) AS reasons FROM f GROUP BY batch")
def _(spark, sf):
    own, bodies = _answers(spark, sf)
    return responses.reasons(responses.reconciled(own, responses.decoded(bodies))).select("batch", F.array_join("reasons", ",").alias("reasons"))


@query("b17_unknown_units", f"WITH {S_UNITS} SELECT doc_id::VARCHAR AS batch, unit_id FROM units WHERE unit_ord % 7 <> 3 AND unit_ord % 11 = 0")
def _(spark, sf):
    own, bodies = _answers(spark, sf)
    return responses.unknown_units(own.where("unit_ord % 11 <> 0"), responses.decoded(bodies))


@query("j14_aliases", f"WITH {S_UNITS} SELECT unit_id, 'u' || (dense_rank() OVER (PARTITION BY doc_id ORDER BY unit_ord) - 1)::VARCHAR AS unit_alias, 'r' || (row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) - 1)::VARCHAR AS run_alias FROM units")
def _(spark, sf):
    own = _units(spark, sf).withColumn("batch", F.col("doc_id")).withColumn("run_ord", F.lit(0))
    return responses.aliases(own).select("unit_id", "unit_alias", "run_alias")


S_PACKED = f"""{S_UNITS}, u AS (SELECT source AS book, doc_id, doc_id * 100000 + unit_ord AS ord, unit_ord // 3 AS para, greatest(1, coalesce({S_TOKENS}, 0))::BIGINT AS n FROM units),
p AS (SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY ord) AS i, (lag(doc_id) OVER (PARTITION BY book ORDER BY ord), lag(para) OVER (PARTITION BY book ORDER BY ord)) IS DISTINCT FROM (doc_id, para) AS starts, sum(n) OVER w::BIGINT AS pn, count(*) OVER w AS pc FROM u WINDOW w AS (PARTITION BY book, doc_id, para))"""


def _fits_sql(n: str, c: str) -> str:
    return f"(ceil(({n} + 12 * ({c}) + 128) * 1.12::DOUBLE) + 64 <= 2000 AND ceil(({n}) * 1.65::DOUBLE) + 12 * ({c}) + 2048 <= 14400)"


@query("e8_packing", f"""WITH RECURSIVE {S_PACKED}, st(book, i, no, n, c) AS (SELECT DISTINCT book, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT FROM p UNION ALL
SELECT book, i, CASE WHEN b2 THEN no1 + 1 ELSE no1 END, CASE WHEN b2 THEN n ELSE n1 + n END, CASE WHEN b2 THEN 1 ELSE c1 + 1 END FROM (
SELECT *, c1 > 0 AND NOT {_fits_sql('n1 + n', 'c1 + 1')} AS b2 FROM (
SELECT *, CASE WHEN b1 THEN no + 1 ELSE no END AS no1, CASE WHEN b1 THEN 0 ELSE sn END AS n1, CASE WHEN b1 THEN 0 ELSE c END AS c1 FROM (
SELECT p.*, st.no, st.n AS sn, st.c, p.starts AND st.c > 0 AND ceil((st.n + 12 * st.c + 128) * 1.12::DOUBLE) + 64 >= 2000 * 0.85::DOUBLE AND NOT {_fits_sql('st.n + p.pn', 'st.c + p.pc')} AS b1 FROM st JOIN p ON p.book IS NOT DISTINCT FROM st.book AND p.i = st.i + 1))))
SELECT book, no AS batch_no, count(*) AS units, max(ceil((n + 12 * c + 128) * 1.12::DOUBLE) + 64)::BIGINT AS est_input FROM st WHERE i > 0 GROUP BY book, no""")
def _(spark, sf):
    # a book is a source: batches go on over its documents, paragraphs are three lines
    k = F.concat_ws(":", F.col("doc_id").cast("string"), F.floor(F.col("unit_ord") / 3).cast("string"))
    own = _units(spark, sf).select(F.col("source").alias("book"), "doc_id", "unit_ord", "unit_id", F.col("doc_id").cast("string").alias("document"), k.alias("block_key"), F.col("unit_id").alias("run_stem"), T.text_tokens("text").alias("tokens"))
    placed = packing.placed(materialize(own), "doc_id", "unit_ord").withColumn("unit_ord", F.col("place"))
    return packing.pack(packing.paragraph_marks(placed), 2000, 16_000).groupBy("book", "batch_no").agg(F.count("*").alias("units"), F.max("est_input").alias("est_input"))


@query("e11_halves", f"""WITH {S_UNITS}, u AS (SELECT doc_id, unit_id, unit_ord, greatest(1, coalesce({S_TOKENS}, 0))::BIGINT AS n FROM units),
c AS (SELECT *, row_number() OVER w AS i, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS c FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY unit_ord)),
b AS (SELECT doc_id, arg_min(i, (abs(before - total / 2.0::DOUBLE), i)) FILTER (i > 1 AND unit_ord % 3 = 0) AS by_paragraph, min(i) FILTER (i > 1 AND before >= total / 2.0::DOUBLE) AS by_half FROM c GROUP BY doc_id)
SELECT unit_id, CASE WHEN c > 1 AND i >= coalesce(by_paragraph, by_half, c) THEN 1 ELSE 0 END AS half FROM c JOIN b USING (doc_id)""")
def _(spark, sf):
    own = _units(spark, sf).select(F.col("doc_id").alias("batch"), "unit_ord", "unit_id", T.text_tokens("text").alias("tokens"), (F.col("unit_ord") % 3 == 0).alias("starts_paragraph"))
    return packing.halves(own).select("unit_id", "half")


@query("w1_job", rf"WITH {S_UNITS} SELECT unit_id AS run_id, sha256('«' || text || '»') AS digest FROM units WHERE regexp_matches(text, '[^\s\p{{Z}}]')")
def _(spark, sf):
    runs = _units(spark, sf).select(F.col("source").alias("book"), F.struct("doc_id", "unit_ord").alias("unit_ord"), "unit_id", F.col("unit_id").alias("run_id"), F.lit(0).alias("run_ord"), "text", F.lit(None).cast("string").alias("context"))
    done, _kept = jobs.run_job(runs, jobs.echo, "job", target=20_000, output_limit=65_536)
    return done.select("run_id", T.digest("target").alias("digest"))


def _unsteady(units: list[dict], glossary: dict[str, str]) -> str:
    """A stand-in for a remote model that knows its glossary and fails now and then: answers for many units leave out some of them."""
    import json
    import re
    import zlib

    marks = [zlib.crc32(f"{u['id']}/{len(units)}".encode()) for u in units]
    if len(units) > 2:
        units = [u for u, m in zip(units, marks) if m % 23]

    def said(text: str) -> str:
        for term, to in sorted(glossary.items()):
            text = re.sub(rf"(?<!\w){re.escape(term)}(?!\w)", to, text, flags=re.I)
        return f"«{text}»"

    return json.dumps([{"id": u["id"], "runs": [{"id": r["id"], "text": said(r["text"])} for r in u["runs"]]} for u in units], ensure_ascii=False)


def _usual_first_word(_: int, targets: DataFrame) -> DataFrame:
    """What a chapter adds to the glossary: the plain first word that most of its units share (of those, the first by the alphabet)."""
    word = F.regexp_extract(F.lower("text"), "^([a-z]{4,12})([^\\p{L}\\p{N}_]|$)", 1)
    best = targets.select(word.alias("term")).where("term <> ''").groupBy("term").count().orderBy(F.desc("count"), "term").limit(1)
    return best.select("term", F.upper(F.reverse("term")).alias("translation"))


def _said_sql(x: str, chapter: int) -> str:
    """``x`` with the terms of all chapters before in place; twice, as matches may share the character between them."""
    for c in range(1, chapter):
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || (SELECT term FROM t{c}) || '($|[^\\p{{L}}\\p{{N}}_])', '\\1' || (SELECT upper(reverse(term)) FROM t{c}) || '\\2', 'g')"
    return x


def _first_word_sql(c: int) -> str:
    return f"t{c} AS (SELECT coalesce((SELECT w FROM (SELECT regexp_extract(lower(text), '^([a-z]{{4,12}})([^\\p{{L}}\\p{{N}}_]|$)', 1) AS w FROM u WHERE chapter = {c}) WHERE w <> '' GROUP BY w ORDER BY count(*) DESC, w LIMIT 1), 'no such word') AS term)"


@query("w2_chapters", rf"""WITH {S_UNITS}, u AS (SELECT 1 + doc_id % 2 AS chapter, unit_id, text FROM units WHERE regexp_matches(text, '[^\s\p{{Z}}]')), {_first_word_sql(1)}
SELECT chapter::INTEGER AS chapter, unit_id AS run_id, sha256('«' || CASE chapter WHEN 1 THEN {_said_sql('text', 1)} ELSE {_said_sql('text', 2)} END || '»') AS digest FROM u""")
def _(spark, sf):
    # every second document is of the first chapter; the word found there is replaced in the second
    place = F.struct("doc_id", "unit_ord").alias("unit_ord")
    runs = _units(spark, sf).select((F.col("doc_id") % 2 + 1).cast("int").alias("chapter"), F.col("source").alias("book"), place, "unit_id", F.col("unit_id").alias("run_id"), F.lit(0).alias("run_ord"), "text", F.lit(None).cast("string").alias("context"))
    job = chapters.Chapters(runs, _unsteady, chapters.job_store(spark), "w2", _usual_first_word, target=20_000, output_limit=65_536)
    job.publish()
    return job.targets().select("chapter", "run_id", T.digest("target").alias("digest"))


# ---- requests, estimates, logs ----------------------------------------------------------------------


def _tokens_sql(x: str) -> str:
    """Estimated tokens of a text without line ends."""
    return "greatest(1, coalesce(" + S_TOKENS.replace("regexp_extract_all(text,", f"regexp_extract_all({x},") + ", 0))::BIGINT"


S_PLAIN = r"regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("b7_payloads", rf"""WITH {S_UNITS}, p AS (SELECT unit_id, unit_ord, source, text AS line, i - 1 AS run_ord, l[i] AS piece FROM (SELECT *, string_split(text, ', ') AS l, unnest(range(1, len(string_split(text, ', ')) + 1)) AS i FROM units)),
a AS (SELECT *, regexp_extract(piece, '^([\s\p{{Z}}]*)', 1) AS prefix, regexp_extract(piece, '([\s\p{{Z}}]*)$', 1) AS suffix FROM p WHERE regexp_matches(piece, '[^\s\p{{Z}}]')),
r AS (SELECT *, substr(piece, length(prefix)::INTEGER + 1, (length(piece) - length(prefix) - length(suffix))::INTEGER) AS core FROM a),
j AS (SELECT unit_id, any_value(CASE unit_ord % 3 WHEN 1 THEN '  ' || line || ' ' WHEN 2 THEN source || ': ' || line END) AS context, string_agg(prefix || core || suffix, '' ORDER BY run_ord) AS text,
 string_agg('{{"id":"' || unit_id || '#' || run_ord || '","text":' || to_json(core)::VARCHAR || CASE WHEN run_ord % 2 = 1 THEN ',"format":"b"' ELSE '' END || CASE WHEN prefix <> '' THEN ',"space_before":true' ELSE '' END || CASE WHEN suffix <> '' THEN ',"space_after":true' ELSE '' END || '}}', ',' ORDER BY run_ord) AS runs,
 string_agg('{{"id":"' || unit_id || '#' || run_ord || '","text":""}}', ',' ORDER BY run_ord) AS bare FROM r GROUP BY unit_id),
y AS (SELECT unit_id, text, '{{"id":"' || unit_id || '","runs":[' || runs || ']' || CASE WHEN {S_PLAIN.format(x="context")} <> {S_PLAIN.format(x="text")} THEN ',"context":' || to_json(context)::VARCHAR ELSE '' END || '}}' AS payload, '{{"id":"' || unit_id || '","runs":[' || bare || ']}}' AS bare FROM j)
SELECT unit_id, sha256(text) AS text, sha256(payload) AS payload, {_tokens_sql("payload")} AS tokens, {_tokens_sql("text")} AS source_tokens, {_tokens_sql("bare")} AS overhead_tokens FROM y""")
def _(spark, sf):
    own = _units(spark, sf)
    k = F.col("unit_ord") % 3
    context = F.when(k == 1, F.concat(F.lit("  "), "text", F.lit(" "))).when(k == 2, F.concat("source", F.lit(": "), "text"))
    pieces = own.select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("document"), "unit_ord", "unit_id", context.alias("context"), F.posexplode(F.split("text", ", ")).alias("run_ord", "piece"))
    parts = units.affixes(pieces, "piece").where("core <> ''")
    runs = parts.withColumns({"run_id": F.concat("unit_id", F.lit("#"), F.col("run_ord").cast("string")), "text": F.col("core"), "style": F.when(F.col("run_ord") % 2 == 1, "b").otherwise("")})
    return packing.payloads(runs).select("unit_id", T.digest("text").alias("text"), T.digest("payload").alias("payload"), "tokens", "source_tokens", "overhead_tokens")


@query("b5_context", rf"""WITH {S_UNITS}, w AS MATERIALIZED (SELECT unit_id, {S_PLAIN.format(x="text")} AS whole, list_transform(range(0, (length(text) + 999) // 1000), lambda i: substr(text, 1 + 1000 * i, 1000)) AS l FROM units),
o AS MATERIALIZED (SELECT unit_id, generate_subscripts(l, 1) - 1 AS part_ord, unnest(l) AS part FROM w), p AS (SELECT o.unit_id, part_ord, {S_PLAIN.format(x="part")} AS own, whole FROM o JOIN w USING (unit_id))
SELECT unit_id, part_ord::INTEGER AS part_ord, CASE WHEN whole <> own THEN sha256(CASE WHEN length(whole) > 400 THEN substr(whole, greatest(1, strpos(whole, own) - 50)::INTEGER, 400) ELSE whole END) END AS context FROM p""")
def _(spark, sf):
    own = _units(spark, sf)
    slots = own.select(F.col("unit_id").alias("owner"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,1000}"), F.lit(0))).alias("part_ord", "text"))
    told = units.with_context(slots, own.select(F.col("unit_id").alias("owner"), F.col("text").alias("owner_text")), most=400, before=50)
    return told.select(F.col("owner").alias("unit_id"), "part_ord", T.digest("context").alias("context"))


@query("f27_estimates", rf"""WITH t AS (SELECT doc_id, length(text) AS c, greatest(1, coalesce({S_TOKENS}, 0)::BIGINT + (length(text) - length(replace(text, chr(10), ''))) // 4)::BIGINT AS n FROM documents)
SELECT doc_id, (ceil((n + 128) * 1.1::DOUBLE * 1.05::DOUBLE) + 64)::BIGINT AS measured, (ceil((n + 128) * 1.0::DOUBLE * 1.12::DOUBLE) + 64)::BIGINT AS unmeasured, (ceil(n * 1.35::DOUBLE) + 40 + 2048)::BIGINT AS output, greatest(64, c // 4)::BIGINT AS simple, n <= {T.output_driven_target(16_000, 1.35)} AS fits FROM t""")
def _(spark, sf):
    n = T.text_tokens("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.estimated_input(n, 1.1, samples=3).alias("measured"), T.estimated_input(n).alias("unmeasured"), T.predicted_output(n, F.lit(40), 1.35).alias("output"),
        T.simple_estimate("text").alias("simple"), (n <= T.output_driven_target(16_000, 1.35)).alias("fits"),
    )


@query("f26_instructions", rf"""WITH i(profile, instruction) AS (VALUES ('BUILDING', 'Keep names of places, and dialogue short.'), ('MACHINERY', 'Prefer plain terms; keep units like kW.')),
m AS (SELECT c_custkey, coalesce(instruction, '') AS instruction FROM customer LEFT JOIN i ON profile = c_mktsegment) SELECT c_custkey, instruction, CASE WHEN instruction = '' THEN 0 ELSE {_tokens_sql("instruction")} END::BIGINT AS instruction_tokens FROM m""")
def _(spark, sf):
    texts = spark.createDataFrame([("BUILDING", "Keep names of places, and dialogue short."), ("MACHINERY", "Prefer plain terms; keep units like kW.")], "name string, text string")
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("profile"))
    return review.with_instructions(rows, texts).select("c_custkey", "instruction", F.col("instruction_tokens").cast("long").alias("instruction_tokens"))


@query("g8_outlook", rf"""WITH {S_UNITS}, a AS (SELECT length(text) AS c, greatest(1, coalesce({S_TOKENS}, 0))::BIGINT AS t, doc_id % 3 = 0 AS done FROM units),
s AS (SELECT sum(t) AS total, sum(t) FILTER (done) AS done, sum(c) FILTER (done) AS chars FROM a), n AS (SELECT *, greatest(0, total - done) AS rest, ceil(greatest(0, total - done) / greatest(1.0::DOUBLE, done::DOUBLE / 120)) AS need FROM s)
SELECT done::DOUBLE * 60 / 3600::DOUBLE AS tokens_per_minute, chars::DOUBLE * 60 / 3600::DOUBLE AS characters_per_minute, need::BIGINT AS requests_remaining, ceil(need * (1 + 6::DOUBLE / 114))::BIGINT AS requests_needed, rest::DOUBLE * 3600 / done::DOUBLE AS eta_seconds, ceil(need * (1 + 6::DOUBLE / 114)) > 250 AS quota_short FROM n""")
def _(spark, sf):
    totals = units.progress(_units(spark, sf).withColumn("done", F.col("doc_id") % 3 == 0))
    told = units.outlook(totals, requests=120, elapsed=3600.0, batch_target=2000, retries=6, successes=114, remaining_quota=250)
    return told.select("tokens_per_minute", "characters_per_minute", "requests_remaining", "requests_needed", "eta_seconds", "quota_short")


@query("t7_discovery_text", r"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), h AS (SELECT doc_id, length(text) > 1500 AS long, left(text, 1500) AS short FROM d),
c AS (SELECT doc_id, CASE WHEN long AND contains(short, chr(10) || chr(10)) THEN regexp_extract(short, '(?s)^(.*)\n\n', 1) ELSE short END AS t FROM h),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda p: p <> '') AS l FROM c)
SELECT doc_id AS chapter, coalesce(array_to_string(list_transform(l, lambda p, i: '[P' || i::VARCHAR || '] ' || p), chr(10) || chr(10)), '') AS paragraphs FROM p""")
def _(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return review.discovery_text(texts, most=1500)


@query("f10_adds_markup", "SELECT page_id, regexp_matches(t, '</?[A-Za-z][^>]*>') AND NOT regexp_matches(s, '</?[A-Za-z][^>]*>') AS adds FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html ELSE url END AS s, CASE page_id % 2 WHEN 0 THEN html ELSE url || ' a < b > c' END AS t FROM pages)")
def _(spark, sf):
    source = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.col("url"))
    target = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat("url", F.lit(" a < b > c")))
    return table(spark, sf, "pages").select("page_id", T.adds_markup(source, target).alias("adds"))


@query("f17_effective_status", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 3 THEN 429 ELSE 200 END AS status, CASE event_type WHEN 'error' THEN (400 + event_id % 300)::VARCHAR WHEN 'view' THEN 'none' END AS code, CASE WHEN event_type IN ('error', 'view') THEN CASE event_id % 5 WHEN 0 THEN 'Rate exceeded' ELSE 'bad' END END AS message FROM events)
SELECT event_id, CASE WHEN status = 200 AND (code IS NOT NULL OR message IS NOT NULL) THEN CASE WHEN try_cast(code AS INTEGER) BETWEEN 400 AND 599 THEN try_cast(code AS INTEGER) WHEN regexp_matches(message, '(?i)rate|quota|limit') THEN 429 ELSE 502 END ELSE status END::INTEGER AS status FROM e""")
def _(spark, sf):
    e, kind = F.col("event_id"), F.col("event_type")
    code = F.when(kind == "error", (400 + e % 300).cast("string")).when(kind == "view", "none")
    message = F.when(kind.isin("error", "view"), F.when(e % 5 == 0, "Rate exceeded").otherwise("bad"))
    return table(spark, sf, "events").select("event_id", T.effective_status(F.when(e % 4 == 3, 429).otherwise(200), code, message).alias("status"))


@query("j13_verdicts", """WITH c AS (SELECT p_partkey AS ord, split_part(p_name, ' ', 2) AS source_term FROM part), v AS (SELECT source_term, arg_max(CASE p_size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'ambiguous' ELSE 'rejected' END, p_partkey) AS verdict, arg_max(struct_pack(x := CASE WHEN p_size % 2 = 0 THEN p_type END), p_partkey).x AS corrected FROM c JOIN part ON p_partkey = ord WHERE p_partkey % 5 = 0 AND source_term LIKE '%e%' GROUP BY source_term)
SELECT ord, c.source_term, coalesce(verdict, 'provisional') AS verdict, corrected FROM c LEFT JOIN v USING (source_term)""")
def _(spark, sf):
    own = table(spark, sf, "part").withColumns({"ord": F.col("p_partkey"), "source_term": F.split_part("p_name", F.lit(" "), F.lit(2))})
    k = F.col("p_size") % 3
    said = own.where("p_partkey % 5 = 0 and source_term like '%e%'").select("ord", "source_term", F.when(k == 0, "verified").when(k == 1, "ambiguous").otherwise("rejected").alias("verdict"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("corrected"))
    return review.with_verdicts(own.select("ord", "source_term"), said).select("ord", "source_term", "verdict", "corrected")


@query("b21_reviewed", """WITH t AS (SELECT p_name || '#' || p_partkey AS term, p_type AS translation, p_size % 4 <> 0 AS approved, CASE p_partkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'suggest' END AS action, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS fix FROM part)
SELECT term, CASE WHEN action = 'suggest' AND fix IS NOT NULL THEN fix ELSE translation END AS translation, CASE WHEN action IN ('approve', 'suggest') THEN true WHEN action = 'reject' THEN false ELSE approved END AS approved, CASE WHEN action IN ('approve', 'suggest') THEN 'verified' WHEN action = 'reject' THEN 'rejected' ELSE 'provisional' END AS status,
CASE WHEN action IS NOT NULL THEN translation || '|' || approved::VARCHAR || '|provisional|2024-01-01|review' ELSE '' END AS past FROM t""")
def _(spark, sf):
    key = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("term")
    own = table(spark, sf, "part")
    terms = own.select(key, F.col("p_type").alias("translation"), (F.col("p_size") % 4 != 0).alias("approved"), F.lit("provisional").alias("status"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("suggested_fix"), F.lit(None).cast("array<struct<translation:string,approved:boolean,status:string,at:string,by:string>>").alias("history"))
    k = F.col("p_partkey") % 4
    acts = own.where(k < 3).select(key, F.when(k == 0, "approve").when(k == 1, "reject").otherwise("suggest").alias("action"))
    past = F.array_join(F.transform(F.coalesce("history", F.array().cast("array<struct<translation:string,approved:boolean,status:string,at:string,by:string>>")), lambda h: F.concat_ws("|", h["translation"], h["approved"].cast("string"), h["status"], h["at"], h["by"])), ",")
    return glossary.reviewed(terms, acts, "2024-01-01").select("term", "translation", "approved", "status", past.alias("past"))


@query("w3_unpublished", "SELECT o_orderkey AS chapter, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def _(spark, sf):
    stages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.when(F.col("l_linestatus") == "F", "published").otherwise("failed").alias("status"))
    return review.unpublished(table(spark, sf, "orders").select(F.col("o_orderkey").alias("chapter"), "o_custkey"), stages)


@query("g6_keys_available", "WITH d AS (SELECT user_id, count(*) FILTER (event_type <> 'view') AS used FROM events GROUP BY user_id) SELECT count(*) FILTER (used < (SELECT avg(used) FROM d)::INTEGER) AS available, count(*) AS total FROM d")
def _(spark, sf):
    own = table(spark, sf, "events").select(F.col("user_id").alias("scope"), (F.col("event_type") != "view").cast("int").alias("used"))
    daily = own.groupBy("scope").agg(F.sum("used").alias("used"))
    limit = daily.agg(F.round(F.avg("used")).cast("int").alias("n")).first()["n"] or 0
    return ledger.keys_available(own.select("scope").distinct(), daily.where("used > 0"), limit)


@query("u3_overlap", f"WITH {S_UNITS} SELECT unit_id AS run_id FROM units WHERE unit_ord % 2 = 0 AND doc_id % 3 = 0")
def _(spark, sf):
    runs = _units(spark, sf).withColumn("run_id", F.col("unit_id"))
    return cache.overlap(runs.where("unit_ord % 2 = 0"), runs.where("doc_id % 3 = 0"))


@query("d16_failure_log", """SELECT event_id AS at, event_type AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE left(repeat(event_type || ' ', 90), 300) END AS error, (event_id % 8)::BIGINT AS units, least(5, user_id % 9)::INTEGER AS n_samples, json_extract(props, '$.k')::INTEGER AS k, CASE WHEN event_id % 3 = 0 THEN 'retry' END AS note, CASE WHEN event_id % 3 = 0 THEN 'k,note' ELSE 'k' END AS extra_keys FROM events""")
def _(spark, sf):
    """Events as failures, their properties as extra keys: written as lines of JSON and read again. Extras try to take the place of a key."""
    e = F.col("event_id")
    samples = F.slice(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("s"), i.cast("string"))), F.lit(1), (F.col("user_id") % 9).cast("int"))
    more = F.when(e % 3 == 0, F.concat(F.left("props", F.length("props") - 1), F.lit(', "kind": "other", "error": "other", "note": "retry"}'))).otherwise(F.col("props"))
    failures = table(spark, sf, "events").select(e.cast("double").alias("ts"), F.col("event_type").alias("kind"), (e % 8).alias("units"), F.when(e % 7 != 0, F.repeat(F.concat("event_type", F.lit(" ")), F.lit(90))).alias("error"), samples.alias("sample_ids"), F.try_parse_json(more).alias("extra"))
    read = files.read_failures(files.failure_events(failures, "extra"))
    keys = F.array_join(F.array_sort(F.map_keys(F.col("extra").cast("map<string,variant>"))), ",")
    return read.select(F.col("ts").cast("long").alias("at"), "kind", "error", "units", F.size("sample_ids").alias("n_samples"), F.try_variant_get("extra", "$.k", "int").alias("k"), F.try_variant_get("extra", "$.note", "string").alias("note"), keys.alias("extra_keys"))


@query("b6_node_render", r"""WITH l AS (SELECT doc_id, coalesce(lang, 'en') AS lang, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', ' ', 'g'), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, lang, list_transform(l, lambda t: '<p>' || CASE WHEN regexp_matches(lang, '(?i)^en([-_].*)?$') AND regexp_matches(t, '[A-Za-z]') THEN '«' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '»' ELSE replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END || '</p>') AS l FROM l)
SELECT doc_id, sha256('<html lang="' || lang || '"><body>' || array_to_string(l, chr(10)) || '</body></html>') AS html, NULL::VARCHAR AS fault FROM x""")
def _(spark, sf):
    """Documents as strict markup, a paragraph a line: read by node, and every readable node put between guillemets."""
    sound = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]", " ")
    plain = F.replace(F.replace(F.replace(sound, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(plain, "\n"), lambda t: F.concat(F.lit("<p>"), t, F.lit("</p>"))), "\n")
    pages = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('<html lang="'), F.coalesce("lang", F.lit("en")), F.lit('"><body>'), lines, F.lit("</body></html>")).alias("html"))
    targets = strict.node_slots(pages, "doc_id").select("doc_id", "node", F.concat(F.lit("«"), "text", F.lit("»")).alias("target"))
    return strict.rendered_by_node(pages, targets, "doc_id").select("doc_id", T.digest("html").alias("html"), "fault")
