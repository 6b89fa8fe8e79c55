"""Queries of the search operators over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import index, search
from threadloom.util import ensure_checkpoint_dir, table

NOW = 1_780_000_000


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        "doc_id", "text", "title", "lang", "source", "session_id", F.col("session_id").alias("cwd"), F.unix_timestamp("created_at").alias("modified_ts"),
        F.split_part("source", F.lit("/"), F.lit(1)).alias("agent"), F.split_part("source", F.lit("/"), F.lit(2)).alias("working_dir"), F.array("source").alias("source_paths"),
        F.size(F.split("text", "\n")).cast("bigint").alias("lines"),
    )
    return search.indexed(d, {"content": "text", "user": "title"}, {"dirs": "source_paths"})


# Each query text beside the SQL condition over (text words as a padded string c, title words u, source, modified_ts).
MATCHES: dict[str, tuple[str, str]] = {
    "q04_term": ("observability", "c LIKE '% observability %'"),
    "q05_implicit_and": ("parser ledger", "c LIKE '% parser %' AND c LIKE '% ledger %'"),
    "q06_boolean": ("parser AND (ledger OR router) NOT cache", "c LIKE '% parser %' AND (c LIKE '% ledger %' OR c LIKE '% router %') AND NOT c LIKE '% cache %'"),
    "q06_plus_minus": ("+parser -cache", "c LIKE '% parser %' AND NOT c LIKE '% cache %'"),
    "q07_pure_negative": ("NOT parser", "NOT c LIKE '% parser %'"),
    "q03_field": ("user:harborline OR user:sweep", "u LIKE '% harborline %' OR u LIKE '% sweep %'"),
    "q09_phrase": ('"trash folder"', "c LIKE '% trash folder %'"),
    "q10_sloppy": ('"trash folder report"~2 OR "folder trash"~3', "regexp_matches(c, ' trash (?:\\S+ ){0,2}folder (?:\\S+ ){0,2}report ') OR regexp_matches(c, ' folder (?:\\S+ ){0,3}trash ') OR regexp_matches(c, ' trash (?:\\S+ ){0,1}folder ')"),
    "q11_phrase_prefix": ('"search ind"*', "c LIKE '% search ind%'"),
    "q12_wildcard": ("mat*isation", "regexp_matches(c, ' mat[^ ]*isation ')"),
    "q13_term_regex": ("<(ledg|rout)er> AND /cach.+/", "regexp_matches(c, ' (?:ledg|rout)er ') AND regexp_matches(c, ' cach[^ ]+ ')"),
    "q15_working_dir": ("wd:HARBOR", "lower(w) LIKE '%harbor%'"),
    "q16_path": ("dirs:harborline", "'/' || lower(source) LIKE '%/harborline%'"),
    "q17_range": ("modified_ts:[1770000000 TO 1775000000}", "modified_ts >= 1770000000 AND modified_ts < 1775000000"),
    "q17_term_range": ("user:[harbor TO index]", "len(list_filter(string_split(trim(u), ' '), lambda t: t >= 'harbor' AND t <= 'index' AND t <> '')) > 0"),
    "q18_set": ("content: IN [ledger router]", "c LIKE '% ledger %' OR c LIKE '% router %'"),
    "q19_exists": ("parser user:* content:*", "c LIKE '% parser %'"),
    "q20_all": ("*", "true"),
}

_CORPUS = r"""
WITH d AS (
  SELECT doc_id, text, title, source, lang, CAST(floor(epoch(created_at)) AS BIGINT) AS modified_ts, split_part(source, '/', 2) AS w, split_part(source, '/', 1) AS agent,
         ' ' || array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: CASE WHEN strlen(lower(x)) < 40 THEN lower(x) ELSE chr(1) END), ' ') || ' ' AS c,
         ' ' || array_to_string(list_transform(regexp_extract_all(coalesce(title, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)), ' ') || ' ' AS u
  FROM documents
)"""


def _match(text: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.matching(corpus(spark, sf), text).select("doc_id")

    return run


QUERIES = {name: _match(text) for name, (text, _) in MATCHES.items()}
ORACLE = {name: f"{_CORPUS} SELECT doc_id FROM d WHERE {condition}" for name, (_, condition) in MATCHES.items()}

RANKED = "ledger observability"


def search_relevance(spark: SparkSession, sf: str) -> DataFrame:
    request = search.Request(f"{RANKED.split()[0]} OR {RANKED.split()[1]}", sort="relevance", limit=20, now=NOW)
    hits = search.search(corpus(spark, sf), request)
    return search.with_snippets(hits, request.query).select("doc_id", F.round("score", 6).alias("score"), "modified_ts", "snippet")


def s11_bm25(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.scored(corpus(spark, sf), "ledger OR observability")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def s02_relevance(spark: SparkSession, sf: str) -> DataFrame:
    request = search.Request("ledger OR observability", sort="relevance", limit=50, now=NOW)
    return search.search(corpus(spark, sf), request).select("doc_id", F.round("score", 6).alias("score"))


def s04_time(spark: SparkSession, sf: str) -> DataFrame:
    request = search.Request("parser NOT ledger", search.Filters(agent="wiki", after=1_768_000_000), limit=25)
    return search.search(corpus(spark, sf), request).select("doc_id", "modified_ts")


def s05_recent(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(corpus(spark, sf), search.Request(limit=30)).select("doc_id", "modified_ts", tx.compact(F.col("text"), 120).alias("preview"))


def s08_filters(spark: SparkSession, sf: str) -> DataFrame:
    f = search.Filters(agent="faq", after=search.parse_date("2026-01-10", False), before=search.parse_date("2026-03-31", True), min_lines=3)
    return corpus(spark, sf).where(search.filter_condition(f, ["lines"])).select("doc_id")


def s07_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "basic_session").select("row_id", "cwd")
    return rows.where(search.scope_condition("/SRV//agents/./harborline/", ["cwd"])).select("row_id")


def q24_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return search.occurrences(corpus(spark, sf), "ledger AND router").select("doc_id", "field", "term", "position")


# Each query text beside the field's words, the condition on its document, and the SQL list of (first, last) places over the list of words t.
PLACES: dict[str, tuple[str, str, str, str, str]] = {
    "q24_regex": ("mat*isation OR <(ledg|rout)er>", "content", "c", "true", "[{'i': i, 'e': i} FOR i IN range(1, len(t) + 1) IF regexp_full_match(t[i], 'mat.*isation|(?:ledg|rout)er')]"),
    "q24_range": ("user:[harbor TO index]", "user", "u", "true", "[{'i': i, 'e': i} FOR i IN range(1, len(t) + 1) IF t[i] >= 'harbor' AND t[i] <= 'index' AND t[i] <> '']"),
    "q24_phrase": ('"trash folder" NOT router', "content", "c", "NOT c LIKE '% router %'", "[{'i': i, 'e': i + 1} FOR i IN range(1, len(t)) IF t[i] = 'trash' AND t[i + 1] = 'folder']"),
    "q24_phrase_prefix": ('"search ind"*', "content", "c", "true", "[{'i': i, 'e': i + 1} FOR i IN range(1, len(t)) IF t[i] = 'search' AND starts_with(t[i + 1], 'ind')]"),
    "q24_sloppy": (
        '"folder trash"~3', "content", "c", "true",
        "flatten([[{'i': i, 'e': e} FOR e IN range(i + 1, i + 5) IF e <= len(t) AND (t[i] = 'folder' AND t[e] = 'trash' OR t[i] = 'trash' AND t[e] = 'folder' AND e <= i + 2)] FOR i IN range(1, len(t) + 1)])",
    ),
}


def _places(text: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.occurrences(corpus(spark, sf), text)

    return run


def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index of the corpus, one row for each term with its document frequency."""
    p = search.postings(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def q09_by_postings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return search.by_postings(search.postings(d, "doc_id", F.col("text")), d, "doc_id", '"trash folder" AND (ledger OR cache) NOT router')


def j11_compact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.compact(F.col("text"), 100).alias("brief"))


def j13_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "basic_session").where("cwd IS NOT NULL").select("cwd").distinct()
    return paths.select("cwd", F.explode(tx.path_suffixes(F.col("cwd"))).alias("suffix"))


def k10_find(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of a regular expression in each text, without letter case."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?i)time ?stamp|ledger\w*")).cast("bigint").alias("n")).where("n > 0")


def _stored(spark: SparkSession, sf: str) -> index.Index:
    """The index of the documents in the shared folder, built once for a session: all documents, then an update by which those of the first half
    are replaced by themselves."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/index-{zlib.crc32(f'{spark.sparkContext.applicationId} {sf}'.encode()):08x}"
    stored = index.Index(spark, at, "doc_id", {"content": "text", "user": "title"})
    if not stored.manifest()["segments"]:
        d = table(spark, sf, "documents").select("doc_id", "text", "title", "lang", F.unix_timestamp("created_at").alias("modified_ts"), F.split_part("source", F.lit("/"), F.lit(1)).alias("agent"))
        half = d.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0] or 0
        stored.update(d.withColumn("title", F.when(F.col("doc_id") > half, F.col("title")).otherwise("old title")))
        stored.update(d.where(F.col("doc_id") <= half))
    return stored


def _indexed(text: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _stored(spark, sf).matching(text).select("doc_id")

    return run


# The queries that are answered from the stored index as well, with the same SQL.
STORED = ("q04_term", "q06_boolean", "q07_pure_negative", "q03_field", "q09_phrase", "q10_sloppy", "q11_phrase_prefix", "q12_wildcard", "q13_term_regex", "q17_term_range", "q18_set", "q20_all")


def i_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """S1-S3 and S11 from the stored index."""
    request = search.Request("ledger OR observability", sort="relevance", limit=50, now=NOW)
    return _stored(spark, sf).search(request).select("doc_id", F.round("score", 6).alias("score"))


def i_time(spark: SparkSession, sf: str) -> DataFrame:
    """S4 and S8 from the stored index."""
    request = search.Request("parser NOT ledger", search.Filters(agent="wiki", after=1_768_000_000), limit=25)
    return _stored(spark, sf).search(request).select("doc_id", "modified_ts")


def i_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and words that the index holds after an update."""
    m = _stored(spark, sf).manifest()
    return spark.createDataFrame([(m["version"], m["n"], m["total"]["content"])], "version bigint, n bigint, total bigint")


def q21_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Q21: a boosted word."""
    return search.scored(corpus(spark, sf), "ledger^3 OR observability").select("doc_id", F.round("score", 6).alias("score"))


def q22_phrase_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Q22: two bare words; documents that hold them as a phrase rank higher."""
    return search.scored(corpus(spark, sf), "trash folder").select("doc_id", F.round("score", 6).alias("score"))


def k10_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges of a literal, without letter case, and of a regular expression, with it."""
    d = table(spark, sf, "documents")
    literal = search.find(d, "(?-j)The Ledger").withColumn("how", F.lit("literal"))
    return literal.unionByName(search.find(d, "led(g)er\\w*", regex=True, case_sensitive=True).withColumn("how", F.lit("regex")))


def s10_document(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the newest document that names the parser matches."""
    d = corpus(spark, sf)
    newest = d.where(F.col("norm_content").contains(" parser ")).agg(F.max("doc_id")).first()[0]
    return search.matches_document(d, "parser", "doc_id", newest).select("doc_id").unionByName(search.matches_document(d, "NOT parser", "doc_id", newest).select("doc_id"))


_EXTRA = (i_relevance, i_time, i_manifest, q21_boost, q22_phrase_boost, k10_ranges, s10_document, search_relevance, s11_bm25, s02_relevance, s04_time, s05_recent, s08_filters, s07_scope, q24_occurrences, index_postings, q09_by_postings, j11_compact, j13_suffixes, k10_find)
QUERIES |= {f.__name__: f for f in _EXTRA} | {name: _places(text) for name, (text, *_) in PLACES.items()}
QUERIES |= {f"i{name[1:]}": _indexed(MATCHES[name][0]) for name in STORED}

_BM25 = (
    _CORPUS
    + r""", e AS (SELECT *, len(list_filter(string_split(trim(c), ' '), lambda t: t <> '' AND t <> chr(1))) AS dl FROM d),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS al, CAST(count(*) FILTER (c LIKE '% ledger %') AS DOUBLE) AS da, CAST(count(*) FILTER (c LIKE '% observability %') AS DOUBLE) AS db FROM e),
t AS (SELECT e.*, s.*, CAST(len(list_filter(string_split(trim(c), ' '), lambda t: t = 'ledger')) AS DOUBLE) AS ta, CAST(len(list_filter(string_split(trim(c), ' '), lambda t: t = 'observability')) AS DOUBLE) AS tb FROM e, s),
b AS (SELECT doc_id, modified_ts,
   CASE WHEN ta > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * ta * 2.2 / (ta + 1.2 * (0.25 + 0.75 * dl / al)) ELSE 0 END
 + CASE WHEN tb > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * tb * 2.2 / (tb + 1.2 * (0.25 + 0.75 * dl / al)) ELSE 0 END AS score FROM t WHERE ta > 0 OR tb > 0)"""
)
ORACLE |= {f"i{name[1:]}": ORACLE[name] for name in STORED}


def _two_words(a: str, b: str, boost: float) -> str:
    return _BM25.replace("ledger", a).replace("observability", b).replace("CASE WHEN ta > 0 THEN ln", f"CASE WHEN ta > 0 THEN {boost} * ln")


ORACLE |= {
    "q21_boost": _two_words("ledger", "observability", 3.0) + " SELECT doc_id, round(score, 6) AS score FROM b",
    "q22_phrase_boost": _two_words("trash", "folder", 1.0).replace("WHERE ta > 0 OR tb > 0", "WHERE ta > 0 AND tb > 0")
    + """, h AS (SELECT doc_id, CAST(len(regexp_extract_all(c, ' trash folder(?: |$)')) AS DOUBLE) AS tp, dl, al, n, da, db FROM t)
SELECT b.doc_id, round(b.score + CASE WHEN tp > 0 THEN 5 * (ln(1 + (n - da + 0.5) / (da + 0.5)) + ln(1 + (n - db + 0.5) / (db + 0.5))) * tp * 2.2 / (tp + 1.2 * (0.25 + 0.75 * dl / al)) ELSE 0 END, 6) AS score FROM b JOIN h ON b.doc_id = h.doc_id""",
    "i_manifest": _CORPUS + " SELECT CAST(2 AS BIGINT) AS version, count(*) AS n, CAST(sum(len(list_filter(string_split(trim(c), ' '), lambda t: t <> '' AND t <> chr(1)))) AS BIGINT) AS total FROM d",
    "s10_document": _CORPUS + " SELECT max(doc_id) AS doc_id FROM d WHERE c LIKE '% parser %'",
    "k10_ranges": r"""
WITH m AS (SELECT doc_id, 'literal' AS how, regexp_extract_all(text, '(?i)the ledger') AS h, regexp_split_to_array(text, '(?i)the ledger') AS b FROM documents
  UNION ALL SELECT doc_id, 'regex', regexp_extract_all(text, 'ledger\w*'), regexp_split_to_array(text, 'ledger\w*') FROM documents),
u AS (SELECT doc_id, how, h, b, unnest(range(1, len(h) + 1)) AS k FROM m),
z AS (SELECT doc_id, how, k, strlen(h[k]) AS size, list_sum(list_transform(b[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: strlen(x))), 0) AS s FROM u)
SELECT doc_id, how, CAST(k - 1 AS INT) AS nth, CAST(s AS INT) AS start, CAST(s + size AS INT) AS "end" FROM z""",
    "s11_bm25": _BM25 + " SELECT doc_id, round(score, 6) AS score FROM b",
    "s02_relevance": _BM25
    + f", r AS (SELECT doc_id, modified_ts, score * (1 + exp(-greatest({NOW} - modified_ts, 0) / 604800.0)) AS score FROM b) SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM r ORDER BY score DESC, modified_ts DESC, doc_id LIMIT 50)",
    "s04_time": _CORPUS + " SELECT doc_id, modified_ts FROM d WHERE c LIKE '% parser %' AND NOT c LIKE '% ledger %' AND agent = 'wiki' AND modified_ts >= 1768000000 ORDER BY modified_ts DESC, doc_id LIMIT 25",
    "s05_recent": _CORPUS
    + r""", r AS (SELECT doc_id, modified_ts, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM d ORDER BY modified_ts DESC NULLS LAST, doc_id LIMIT 30)
SELECT doc_id, modified_ts, CASE WHEN length(f) > 120 THEN left(f, 119) || '…' ELSE f END AS preview FROM r""",
    "s08_filters": _CORPUS + f" SELECT doc_id FROM d WHERE agent = 'faq' AND modified_ts BETWEEN {search.parse_date('2026-01-10', False)} AND {search.parse_date('2026-03-31', True)} AND len(string_split(text, chr(10))) >= 3",
    "s07_scope": "SELECT row_id FROM basic_session WHERE lower(cwd) = '/srv/agents/harborline'",
    "q24_occurrences": _CORPUS
    + """ SELECT doc_id, 'content' AS field, term, CAST(p - 1 AS INT) AS position FROM (
SELECT doc_id, unnest(string_split(trim(c), ' ')) AS term, unnest(range(1, len(string_split(trim(c), ' ')) + 1)) AS p FROM d WHERE c LIKE '% ledger %' AND c LIKE '% router %') WHERE term IN ('ledger', 'router')""",
    "index_postings": r"""SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM (
SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM documents) WHERE strlen(term) < 40 GROUP BY 1""",
    "q09_by_postings": _CORPUS + " SELECT doc_id FROM d WHERE c LIKE '% trash folder %' AND (c LIKE '% ledger %' OR c LIKE '% cache %') AND NOT c LIKE '% router %'",
    "j11_compact": r"SELECT doc_id, CASE WHEN length(f) > 100 THEN left(f, 99) || '…' ELSE f END AS brief FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)",
    "j13_suffixes": """SELECT DISTINCT cwd, suffix FROM (SELECT cwd, array_to_string(p[i:], '/') AS suffix FROM (
SELECT cwd, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT cwd, string_split(regexp_replace(cwd, '/+$', ''), '/') AS p FROM basic_session WHERE cwd IS NOT NULL))) WHERE suffix <> ''""",
    "k10_find": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)time ?stamp|ledger\w*')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?i)time ?stamp|ledger\w*')",
}
ORACLE |= {"i_relevance": ORACLE["s02_relevance"], "i_time": ORACLE["s04_time"]}
ORACLE |= {
    name: f"""{_CORPUS}, w AS (SELECT doc_id, string_split(trim({words}), ' ') AS t FROM d WHERE {condition}), o AS (SELECT doc_id, t, unnest({places}) AS r FROM w)
SELECT doc_id, '{field}' AS field, array_to_string(t[r.i:r.e], ' ') AS term, CAST(r.i - 1 AS INT) AS position, CAST(r.e - r.i + 1 AS INT) AS words FROM o"""
    for name, (_, field, words, condition, places) in PLACES.items()
}
