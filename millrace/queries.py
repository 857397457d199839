"""Queries of the core by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields as listing
from millrace.functions import text, urls
from millrace.functions.html import read_pages
from millrace.operators import fuzzy, index, rank, search, time_normalise
from millrace.plans import crawl
from millrace.session import scratch
from millrace.sources.tables import newest, table
from millrace.streaming import increment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Times. The SQL reads the forms apart from the plan, and takes offsets from DuckDB's own zone data.

_SP = r"[\s\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ABBR = "MAP {'gmt': 0, 'utc': 0, 'z': 0, 'bst': 60, 'wet': 0, 'west': 60, 'cet': 60, 'cest': 120, 'eet': 120, 'eest': 180, 'ist': 330, 'jst': 540, 'sgt': 480, 'aest': 600, 'aedt': 660, 'est': -300, 'edt': -240, 'cst': -360, 'cdt': -300, 'mst': -420, 'mdt': -360, 'pst': -480, 'pdt': -420}"
_MONTH = "MAP {'jan': 1, 'feb': 2, 'fev': 2, 'mar': 3, 'mae': 3, 'apr': 4, 'avr': 4, 'may': 5, 'mai': 5, 'jun': 6, 'juin': 6, 'jul': 7, 'juil': 7, 'aug': 8, 'aou': 8, 'sep': 9, 'oct': 10, 'okt': 10, 'nov': 11, 'dec': 12, 'dez': 12}"
_DAY = {  # by form: the pattern, and which groups are year, month, day and the rest
    "iso": (r"^(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})(?:(?:t|,? )(.*))?$", "1234"), "mdy": (r"^([a-zà-ÿ]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:,? (?:at )?(.*))?$", "3124"),
    "dmy": (r"^(\d{1,2})(?:st|nd|rd|th|er|\.)?[ -](?:of )?([a-zà-ÿ]+)\.?,?[ -](\d{4}|\d{2})(?:,? (?:at |à |um )?(.*))?$", "3214"), "num": (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?:,? (?:at |à |um )?(.*))?$", "3004"),
}
_FORM = "CASE WHEN regexp_matches(s, '^-?\\d{9,19}$') THEN 'epoch' " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, (p, _) in _DAY.items()) + " END"
_PART = lambda i: "CASE form " + " ".join(f"WHEN '{k}' THEN regexp_extract(s, '{p}', {g[i]})" for k, (p, g) in _DAY.items()) + " END"
_NUM = lambda i: f"regexp_extract(s, '{_DAY['num'][0]}', {i})"
_CLOCK = r"^(\d{1,2})(?:[:.h]?(\d{2})|h)?(?:[:.]?(\d{2})(?:[.,](\d+))?)? ?(?:([ap]\.?m\.?)(?: |$))?(?: ?uhr)? ?(.*)$"
_TIMES = rf"""v4 AS (SELECT page_id, unnest([struct_pack(field := 'posted_at', v := s.p), struct_pack(field := 'deadline_at', v := s.d)]) AS x, s.z AS zone, lower(replace(coalesce(s.l, ''), '_', '-')) AS locale
  FROM (SELECT page_id, arg_max(struct_pack(p := posted_at, d := deadline_at, z := site_zone, l := site_locale), last_crawled_at) AS s FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id)),
s4 AS (SELECT page_id, x.field AS field, zone, locale, regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(x.v, '{_SP}', ' ', 'g'))), '^[a-z]+(?: [a-z]+){{0,3}} ?: ?', ''),
  '^(?:posted|published|updated|apply|applications?|closes?|closing|due|deadline|open|ends?|starts?)(?: (?:on|by|until|before|from))? ', ''), '^(?:mo|di|mi|do|fr|sa|so|(?:mon|tue|wed|thu|fri|sat|sun|die|mit|don|son)[a-z]*|(?:lun|mar|mercre|jeu|vendre|same)di|dimanche)[.,]? ', '') AS s FROM v4 WHERE x.v IS NOT NULL),
f4 AS (SELECT *, {_FORM} AS form FROM s4),
d4 AS (SELECT *, {_PART(0)} AS y, CASE WHEN form = 'num' THEN CASE WHEN locale = 'en-us' THEN {_NUM(1)} ELSE {_NUM(2)} END ELSE {_PART(1)} END AS mo,
  CASE WHEN form = 'num' THEN CASE WHEN locale = 'en-us' THEN {_NUM(2)} ELSE {_NUM(1)} END ELSE {_PART(2)} END AS dd, trim(coalesce({_PART(3)}, '')) AS rest FROM f4 WHERE form IS NOT NULL),
c4 AS (SELECT *, CASE WHEN length(y) = 2 THEN '20' || y ELSE y END AS yy, coalesce(TRY_CAST(mo AS INT), {_MONTH}[CASE WHEN strip_accents(mo) LIKE 'jui%' THEN left(strip_accents(mo), 4) ELSE left(strip_accents(mo), 3) END]) AS mm,
  coalesce(TRY_CAST(regexp_extract(rest, '{_CLOCK}', 1) AS INT), 0) AS h, coalesce(TRY_CAST(regexp_extract(rest, '{_CLOCK}', 2) AS INT), 0) AS mi, coalesce(TRY_CAST(regexp_extract(rest, '{_CLOCK}', 3) AS INT), 0) AS sec,
  CAST(left(regexp_extract(rest, '{_CLOCK}', 4) || '000000', 6) AS INT) AS us, replace(regexp_extract(rest, '{_CLOCK}', 5), '.', '') AS half, trim(regexp_replace(regexp_extract(rest, '{_CLOCK}', 6), '[\[\]()]', ' ', 'g')) AS z FROM d4),
l4 AS (SELECT *, CASE WHEN form <> 'epoch' AND (rest = '' OR regexp_matches(rest, '^\d')) THEN TRY_CAST(format('{{}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', yy, mm, TRY_CAST(dd AS INT), CASE WHEN half IN ('am', 'pm') THEN h % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END ELSE h END, mi, sec) AS TIMESTAMP) END AS loc,
  CASE WHEN z LIKE '%/%' THEN z ELSE lower(zone) END AS tz FROM c4),
n4 AS (SELECT l.*, n.name AS zname FROM l4 l LEFT JOIN (SELECT lower(name) AS low, any_value(name) AS name FROM pg_timezone_names() GROUP BY 1) n ON n.low = l.tz),
o4 AS (SELECT *, CASE WHEN regexp_matches(z, '^(?:utc|gmt)?[+-]\d{{1,2}}:?(\d{{2}})?$') THEN CASE WHEN z LIKE '%-%' THEN -1 ELSE 1 END * (CAST(regexp_extract(z, '[+-](\d{{1,2}})', 1) AS INT) * 60 + coalesce(TRY_CAST(regexp_extract(z, '[+-]\d{{1,2}}:?(\d{{2}})', 1) AS INT), 0))
  WHEN z <> '' AND z NOT LIKE '%/%' THEN {_ABBR}[z] END AS off, timezone(zname, loc) AS inst FROM n4),
t4 AS (SELECT page_id, field, CASE WHEN form = 'epoch' THEN CASE WHEN length(s) <= 11 THEN CAST(s AS BIGINT) * 1000000 WHEN length(s) <= 14 THEN CAST(s AS BIGINT) * 1000 WHEN length(s) <= 17 THEN CAST(s AS BIGINT) ELSE CAST(s AS BIGINT) // 1000 END
  WHEN off IS NOT NULL THEN epoch_us(loc) + us - CAST(off AS BIGINT) * 60000000 WHEN timezone(zname, inst - INTERVAL 1 HOUR) = loc THEN epoch_us(inst) - 3600000000 + us ELSE epoch_us(inst) + us END AS epoch_us FROM o4)"""


@query(f"WITH {_TIMES} SELECT page_id, field, CAST(epoch_us AS BIGINT) AS epoch_us FROM t4 WHERE epoch_us IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each time of a web page that stands for an instant, in microseconds since 1970 UTC."""
    return time_normalise.page_times(table(spark, d, "web_pages")).filter("epoch_us IS NOT NULL").select("page_id", "field", "epoch_us")


@query()
def p4_times(spark: SparkSession, d: str) -> DataFrame:
    """Every time of a web page with the way it was resolved, also where it stands for no instant."""
    return time_normalise.page_times(table(spark, d, "web_pages"))


# Indexing and search. The SQL is written apart from the plans, for DuckDB.

NOW = "2026-07-01 00:00:00"
_STOP = ["the", "and", "of", "to", "in", "for", "on", "at", "with", "is"]


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _sql_words(text: str, keep: str = "") -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '{_SP}'), lambda w: lower(regexp_replace(w, '[^a-zA-Z0-9{keep}]+', '', 'g'))), lambda w: w <> '')"


def _sql_terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{_SP}'), lambda w: w <> '')"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL")


@query(f"SELECT doc_id, CAST(unnest(range(len(t))) AS INT) AS position, unnest(t) AS token FROM (SELECT doc_id, {_sql_words('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokenize_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of every document with their positions."""
    return _documents(spark, d).select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("position", "token"))


@query(f"SELECT doc_id, list_filter({_sql_words('text')}, lambda w: NOT list_contains({_STOP!r}, w)) AS tokens FROM documents WHERE text IS NOT NULL")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of every document without those of a stop list."""
    return _documents(spark, d).select("doc_id", text.tokens(F.col("text"), stop=_STOP).alias("tokens"))


@query("SELECT doc_id, CASE lower(trim(lang)) " + " ".join(f"WHEN '{c}' THEN {_sql_words('text', text.LETTERS[n])}" for c, n in text.LANGUAGE_OF_CODE.items() if text.LETTERS[n]) + f" ELSE {_sql_words('text')} END AS tokens FROM documents WHERE text IS NOT NULL")
def sanitize_multilang(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document cleaned by its language, also of those whose language is unknown or has no code."""
    language = F.element_at(F.create_map(*[F.lit(x) for kv in text.LANGUAGE_OF_CODE.items() for x in kv]), F.lower(F.trim("lang")))
    return _documents(spark, d).select("doc_id", text.tokens_by(F.col("text"), F.coalesce(language, F.lit("unknown"))).alias("tokens"))


@query()
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The stem of each distinct token of the documents."""
    words = _documents(spark, d).select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")).distinct()
    return words.withColumn("stem", text.stem(F.col("word")))


@query()
def stem_languages(spark: SparkSession, d: str) -> DataFrame:
    """The stem of each distinct token of the documents by each document's language, as it is detected."""
    docs = _documents(spark, d).withColumn("language", text.detected(F.col("text")))
    words = docs.select("language", F.explode(F.array_distinct(text.tokens_by(F.col("text"), F.col("language")))).alias("word")).distinct()
    return words.withColumn("stem", text.stem_by(F.struct("word", "language")))


@query()
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document."""
    return _documents(spark, d).select("doc_id", text.detected(F.col("text")).alias("language"))


_ELEMENTS = "SELECT doc_id AS page_id, 0 AS elem_idx, 20 AS score, coalesce(title, '') AS text FROM documents UNION ALL SELECT doc_id, 1, 1, coalesce(text, '') FROM documents"
_WORDS = f"""WITH e AS ({_ELEMENTS}), t AS (SELECT *, {_sql_words('text')} AS toks FROM e),
b AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY page_id ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
o AS (SELECT page_id, elem_idx, score, before + unnest(range(len(toks))) AS position, unnest(toks) AS word FROM b),
words AS (SELECT page_id, elem_idx, word, max(score) AS score, CAST(max(position) AS INT) AS position FROM o GROUP BY page_id, elem_idx, word) """


def _document_elements(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.struct(F.lit(score).alias("score"), text.tokens(F.coalesce(c, F.lit(""))).alias("tokens")) for score, c in ((20, F.col("title")), (1, F.col("text")))]
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.array(*parts).alias("elements"))


def _document_words(spark: SparkSession, d: str) -> DataFrame:
    return index.place_nested(_document_elements(spark, d))


@query(_WORDS + "SELECT * FROM words")
def weighted_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of the documents' titles and texts with weights and positions."""
    return _document_words(spark, d)


@query(_WORDS + "SELECT word, page_id, arg_max(score, position) AS score, max(position) AS position FROM words GROUP BY word, page_id")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of the documents."""
    return index.postings(_document_words(spark, d))


@query(_WORDS + "SELECT word, count(*) AS frequency FROM words GROUP BY word")
def dictionary_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of the documents."""
    return index.dictionary_of(_document_elements(spark, d).select(F.explode("elements").alias("e")), "e.tokens")


# Search over the tables of the project's domain

_CLEAN = "post AS (SELECT word, page_id, arg_max(score, position * 1000 + score) AS score, max(position) AS position FROM postings WHERE word IS NOT NULL AND page_id IS NOT NULL AND position IS NOT NULL GROUP BY word, page_id)"
_DICT = "dict AS (SELECT word, count(*) AS frequency FROM post GROUP BY word)"
_TRIM = lambda c: f"regexp_replace({c}, '^{_SP}|{_SP}$', '', 'g')"
_Q = f"""q AS (SELECT query_id, any_value({_TRIM('q')}) AS q, any_value(coalesce(page, 1)) AS page, any_value(coalesce(size, 10)) AS size, any_value({_TRIM("coalesce(major, '')")}) AS major
  FROM queries WHERE {_TRIM('q')} <> '' AND length({_TRIM('q')}) <= 200 AND coalesce(page, 1) >= 1 AND coalesce(size, 10) BETWEEN 1 AND 50 GROUP BY query_id)"""
_TOK = f"tok AS (SELECT DISTINCT query_id, unnest({_sql_words('q')}) AS token FROM q)"
_NEAR = """miss AS (SELECT * FROM tok WHERE token NOT IN (SELECT word FROM dict)),
pairs AS (SELECT m.token, d.word, d.frequency, levenshtein(m.token, lower(d.word)) AS distance FROM (SELECT DISTINCT token FROM miss) m, dict d WHERE levenshtein(m.token, lower(d.word)) <= 2),
near AS (SELECT * FROM pairs QUALIFY distance = min(distance) OVER (PARTITION BY token)),
fix AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, word) = 1)"""
_HITS = """hits AS (SELECT query_id, token, page_id, score, position FROM tok JOIN post ON token = word
  UNION ALL SELECT query_id, m.token, page_id, score, position FROM miss m JOIN fix USING (token) JOIN post ON fix.word = post.word)"""
_MERGED = "merged AS (SELECT query_id, page_id, count(*) AS hits_count, sum(score) AS hits_sum, sum(position) AS positional_distance FROM hits GROUP BY query_id, page_id)"
_PAGES = f"""{_TIMES}, pg AS (SELECT o.*, make_timestamp(p.epoch_us) AS posted, make_timestamp(c.epoch_us) AS closes FROM (
  SELECT page_id, {', '.join(f'arg_max({c}, last_crawled_at) AS {c}' for c in ('title', 'organization', 'trust_tier', 'location', 'remote', 'abstract', 'url'))}, max(last_crawled_at) AS crawled,
  arg_max(struct_pack(f := fields_of_study), last_crawled_at).f AS studies, arg_max(struct_pack(f := degree_levels), last_crawled_at).f AS levels FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id) o
  LEFT JOIN (SELECT * FROM t4 WHERE field = 'posted_at') p USING (page_id) LEFT JOIN (SELECT * FROM t4 WHERE field = 'deadline_at') c USING (page_id))"""
_BASE = f"WITH {_CLEAN}, {_DICT}, {_Q}, {_TOK}, {_NEAR}, {_HITS}, {_MERGED} "
_SHARE = lambda words: f"len(list_filter(terms, lambda t: list_contains({words}, t))) / len(terms)"
_FLAT = lambda a: f"flatten(list_transform(coalesce({a}, []), lambda x: {_sql_terms('coalesce(x, chr(32))')}))"
_SIGNALS = f""", cand AS (SELECT merged.*, q.q, q.major, q.page, q.size, pg.*, 100 * hits_count + hits_sum AS raw, {_sql_terms('q.q')} AS terms FROM merged JOIN q USING (query_id) JOIN pg ON pg.page_id = merged.page_id),
sig AS (SELECT query_id, page_id, page, size, title, url, abstract, raw, CAST(CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1 ELSE (raw - min(raw) OVER w) / CAST(max(raw) OVER w - min(raw) OVER w AS DOUBLE) END AS DOUBLE) AS relevance,
  CASE WHEN len(terms) = 0 THEN 0 ELSE least(1.0, 0.6 * {_SHARE(_sql_terms("coalesce(title, '')"))} + 0.25 * {_SHARE(_FLAT("list_concat(coalesce(studies, []), coalesce(levels, []))"))} + 0.15 * {_SHARE(_sql_terms("coalesce(organization, '')"))}) END AS field_match,
  CASE WHEN major = '' OR studies IS NULL OR len(studies) = 0 THEN 0.5 WHEN list_has_any({_sql_terms('major')}, {_FLAT('studies')}) THEN 1.0 ELSE 0.15 END AS study,
  1 - (greatest(1, least(3, coalesce(trust_tier, 3))) - 1) / 2.0 AS trust,
  CASE WHEN coalesce(posted, crawled) IS NULL THEN 0.5 ELSE pow(0.5, greatest(0, date_diff('microsecond', coalesce(posted, crawled), TIMESTAMP '{NOW}') / 3.6e9) / 336.0) END AS freshness,
  CASE WHEN closes IS NULL THEN 0.5 WHEN date_diff('microsecond', TIMESTAMP '{NOW}', closes) < 0 OR date_diff('microsecond', TIMESTAMP '{NOW}', closes) / 3.6e9 >= 1440 THEN 0 ELSE 1 - date_diff('microsecond', TIMESTAMP '{NOW}', closes) / 3.6e9 / 1440.0 END AS urgency
  FROM cand WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT *, round(0.35 * relevance + 0.15 * field_match + 0.15 * study + 0.10 * trust + 0.15 * freshness + 0.10 * urgency, 9) AS final FROM sig) """
_ROUND = lambda *names: ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def _search_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return search.valid_queries(table(spark, d, "queries")), *search.search_index(table(spark, d, "postings"))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every candidate with its scores, and the pages."""
    _, post, words = _search_tables(spark, d)
    pages = search.listings(table(spark, d, "web_pages"))
    return search.rank_queries(table(spark, d, "queries"), post, words, pages, _now()).withColumn("final", rank.rounded(F.col("final"), 9)), pages


@query(_BASE + "SELECT query_id, token, page_id, score, position FROM tok JOIN post ON token = word")
def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The postings of every query's tokens, without corrections."""
    q, post, words = _search_tables(spark, d)
    return search.find_hits(search.query_tokens(q), post, words, tolerance=0)


@query(_BASE + "SELECT * FROM hits")
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The hits of every query's tokens, unknown tokens corrected."""
    q, post, words = _search_tables(spark, d)
    return search.find_hits(search.query_tokens(q), post, words)


@query(_BASE + "SELECT query_id, page_id, hits_count, CAST(hits_sum AS BIGINT) AS hits_sum, CAST(positional_distance AS BIGINT) AS positional_distance FROM merged")
def merge_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hits merged by query and page."""
    q, post, words = _search_tables(spark, d)
    return search.merge_hits(search.find_hits(search.query_tokens(q), post, words))


@query(_BASE + ", r AS (SELECT query_id, page_id, CAST(100 * hits_count + hits_sum AS BIGINT) AS raw FROM merged) SELECT query_id, page_id, raw, round(CAST(CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1 ELSE (raw - min(raw) OVER w) / CAST(max(raw) OVER w - min(raw) OVER w AS DOUBLE) END AS DOUBLE), 6) AS relevance FROM r WINDOW w AS (PARTITION BY query_id)")
def relevance_minmax(spark: SparkSession, d: str) -> DataFrame:
    """Raw and scaled relevance of every hit page."""
    merged = merge_hits(spark, d).withColumn("raw", rank.raw_relevance(F.col("hits_count"), F.col("hits_sum")))
    return rank.min_max(merged, ["query_id"], "raw", "relevance").select("query_id", "page_id", "raw", F.round("relevance", 6).alias("relevance"))


@query(_BASE + f", {_PAGES}" + _SIGNALS + "SELECT query_id, page_id, " + _ROUND("relevance", "field_match", "study", "trust", "freshness", "urgency", "final") + " FROM ranked")
def score_signals(spark: SparkSession, d: str) -> DataFrame:
    """The six signals and the composite score of every candidate."""
    names = ("relevance", "field_match", "study", "trust", "freshness", "urgency", "final")
    return _ranked(spark, d)[0].select("query_id", "page_id", *[rank.rounded(F.col(n), 6).alias(n) for n in names])


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, page_id) AS place FROM ranked) "


@query(_BASE + f", {_PAGES}" + _SIGNALS + ", " + _PLACED + "SELECT query_id, page_id, CAST(place AS INT) AS place, title, url, round(final, 6) AS final FROM placed WHERE place > (page - 1) * size AND place <= page * size")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every query answered with its page of results."""
    most = search.last_place(search.valid_queries(table(spark, d, "queries")))
    ranked, pages = _ranked(spark, d)
    best = search.result_page(search.within_reach(ranked, most).select("query_id", "page_id", "page", "size", "final"), most)
    return best.join(pages.select("page_id", "title", "url"), "page_id").select("query_id", "page_id", "place", "title", "url", rank.rounded(F.col("final"), 6).alias("final"))


@query(_BASE + f", {_PAGES}" + _SIGNALS + "SELECT query_id, count(*) AS total_results, CAST(ceil(count(*) / any_value(size)) AS BIGINT) AS pages_count FROM ranked GROUP BY query_id")
def search_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of results and pages of every query."""
    return search.counts(_ranked(spark, d)[0])


@query()
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The hits of every query's stemmed tokens in the index of stemmed words that the documents' titles make."""
    e = table(spark, d, "documents").filter("title IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("elem_idx"), F.lit("title").alias("tag"), F.col("title").alias("text"))
    post = index.postings(index.element_words(e, "english"))
    q = search.valid_queries(table(spark, d, "queries"))
    return search.merge_hits(search.find_hits(search.query_tokens(q, stemmed=True), *search.search_index(post)))


@query("SELECT page_id, any_value(title) AS title FROM web_pages WHERE page_id = (SELECT min(page_id) FROM web_pages) GROUP BY page_id")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The page of the least id, looked up by it."""
    pages = table(spark, d, "web_pages")
    least = pages.agg(F.min("page_id")).first()[0]  # one number
    return search.page_by_id(pages, least).select("page_id", "title")


@query(_BASE + "SELECT token, word, frequency, CAST(distance AS INT) AS distance FROM near")
def fuzzy_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest dictionary words of unknown tokens."""
    q, post, words = _search_tables(spark, d)
    missing = search.query_tokens(q).join(words.select(F.col("word").alias("token")), "token", "left_anti")
    return fuzzy.near_words(missing, words).select("token", "word", "frequency", "distance")


@query(_BASE + ", s AS (SELECT token, list(word ORDER BY place) AS suggestions FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, word) AS place FROM near) WHERE place <= 5 GROUP BY token) SELECT query_id, token, suggestions FROM miss JOIN s USING (token)")
def suggest_topn(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for the unknown tokens of every query."""
    _, post, words = _search_tables(spark, d)
    return search.suggest(table(spark, d, "queries"), words)


@query(_BASE + ", s AS (SELECT token, list(word ORDER BY place) AS suggestions FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, word) AS place FROM near) WHERE place <= 5 GROUP BY token) SELECT query_id, to_json(map_from_entries(list((token, suggestions) ORDER BY token)))::VARCHAR AS response FROM miss JOIN s USING (token) GROUP BY query_id")
def suggest_response(spark: SparkSession, d: str) -> DataFrame:
    """The suggestions of every query as one map, written as JSON."""
    _, post, words = _search_tables(spark, d)
    return fuzzy.suggestion_map(search.suggest(table(spark, d, "queries"), words)).select("query_id", F.to_json("suggestions").alias("response"))


@query(f"WITH {_CLEAN}, {_DICT}, w AS (SELECT word FROM dict) SELECT a.word AS a, b.word AS b, CAST(levenshtein(lower(a.word), lower(b.word)) AS INT) AS distance FROM w a JOIN w b ON a.word < b.word AND levenshtein(lower(a.word), lower(b.word)) <= 2")
def edit_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of dictionary words within two edits, wherever these are, with its distance."""
    words = table(spark, d, "postings").filter("word IS NOT NULL AND page_id IS NOT NULL AND position IS NOT NULL").select("word").distinct()
    return fuzzy.near_pairs(words).select("a", "b", "distance")


# Fields of listings

_ONE = "one AS (SELECT page_id, arg_max(struct_pack(t := title, a := abstract, c := content), last_crawled_at) AS s FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id), txt AS (SELECT page_id, concat(coalesce(s.t, ''), ' . ', coalesce(s.a, ''), ' . ', coalesce(s.c, '')) AS text FROM one)"


def _sql_mentions(word: str) -> str:
    quoted = "".join("\\" + c if not c.isalnum() and c not in " '" else c for c in word).replace("'", "''")
    return f"regexp_matches(text, '(?i)\\b{quoted}s?\\b')"


def _page_text(spark: SparkSession, d: str) -> DataFrame:
    one = newest(table(spark, d, "web_pages"), "page_id", "last_crawled_at", ["title", "abstract", "content"])
    return one.select("page_id", listing.combined_text(F.col("title"), F.col("abstract"), F.col("content")).alias("text"))


@query(f"WITH {_ONE} SELECT page_id, list_filter([" + ", ".join(f"CASE WHEN {_sql_mentions(k)} THEN '{k}' END" for k in listing.FIELDS_OF_STUDY) + "], lambda x: x IS NOT NULL) AS fields_of_study, list_filter(["
       + ", ".join(f"CASE WHEN {' OR '.join(map(_sql_mentions, ws))} THEN '{k}' END" for k, ws in listing.DEGREE_LEVELS.items()) + "], lambda x: x IS NOT NULL) AS degree_levels, (" + " OR ".join(map(_sql_mentions, listing.REMOTE)) + ") AS remote FROM txt")
def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of study, degree levels and remote work that the pages' texts name."""
    w = F.col("words")
    words = _page_text(spark, d).select("page_id", listing.named(F.col("text")).alias("words"))
    return words.select("page_id", listing.studies_of(w).alias("fields_of_study"), listing.levels_of(w).alias("degree_levels"), listing.remote_of(w).alias("remote"))


_ORDER_TEXT = "SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN concat('Apply by ', strftime(o_orderdate, '%B %-d, %Y'), ' please') WHEN 1 THEN concat('The deadline: ', strftime(o_orderdate, '%-m/%-d/%Y')) ELSE concat('Founded ', strftime(o_orderdate, '%B %-d, %Y')) END AS text FROM orders"


def _order_texts(spark: SparkSession, d: str) -> DataFrame:
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    long, short = F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "M/d/yyyy")
    kind = F.col("o_orderkey") % 3
    return o.select("o_orderkey", day.alias("o_orderdate"), F.when(kind == 0, F.concat(F.lit("Apply by "), long, F.lit(" please"))).when(kind == 1, F.concat(F.lit("The deadline: "), short)).otherwise(F.concat(F.lit("Founded "), long)).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deadline FROM orders")
def extract_deadline(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines in texts made of the orders' dates: written in two ways, or without a phrase."""
    return _order_texts(spark, d).select("o_orderkey", F.date_format(listing.deadline(F.col("text")), "yyyy-MM-dd").alias("deadline"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 30 DAY, '%Y-%m-%d') AS rolled FROM orders")
def date_rollover(spark: SparkSession, d: str) -> DataFrame:
    """The 31st of each order's month, which rolls over where there is none."""
    return table(spark, d, "orders").select("o_orderkey", F.date_format(listing.free_date(F.date_format("o_orderdate", "'on 'M'/31/'yyyy")), "yyyy-MM-dd").alias("rolled"))


def _json_rows(spark: SparkSession, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    place = F.concat(F.lit('{"address":{"addressLocality":"Town '), (key % 7).cast("string"), F.lit('"'), F.when(key % 2 == 0, F.lit(',"addressRegion":"R"')).otherwise(""), F.lit("}}"))
    places = F.when(key % 5 == 0, F.concat(F.lit('[{"address":{}},'), place, F.lit("]"))).otherwise(place)
    taught = F.when(key % 3 == 0, F.lit('"PhD in progress"')).when(key % 3 == 1, F.lit('{"credentialCategory":"bachelor degree"}')).otherwise(F.lit('{"name":"any"}'))
    body = F.concat(F.lit('{"@type":"'), F.when(key % 11 == 0, "Person").otherwise("JobPosting"), F.lit('","datePosted":"'), day, F.lit('","jobLocationType":"'), F.when(key % 4 == 0, "telecommute").otherwise("onsite"), F.lit('","hiringOrganization":{"name":"Org '), (key % 13).cast("string"), F.lit('"},"jobLocation":'), places, F.lit(',"educationRequirements":'), taught, F.lit("}"))
    return o.select("o_orderkey", F.when(key % 6 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(key % 17 == 0, F.lit("{broken")).otherwise(body).alias("block"))


@query("""SELECT o_orderkey, o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0) AS is_posting,
  CASE WHEN o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0) THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS posted_at,
  CASE WHEN o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0) THEN concat('Town ', o_orderkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN ', R' ELSE '' END) ELSE '' END AS location,
  CASE WHEN o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0) THEN CASE o_orderkey % 3 WHEN 0 THEN 'PhD in progress' WHEN 1 THEN 'bachelor degree' ELSE 'any' END ELSE '' END AS education,
  CASE WHEN o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0) THEN concat('Org ', o_orderkey % 13) ELSE '' END AS organization,
  o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0) AND o_orderkey % 4 = 0 AS remote FROM orders""")
def jsonld_posting(spark: SparkSession, d: str) -> DataFrame:
    """The fields of JSON-LD postings made of the orders: objects, arrays, other types and broken ones."""
    p = F.col("p")
    return _json_rows(spark, d).withColumn("p", listing.job_posting(F.col("block"))).select(
        "o_orderkey", p.isNotNull().alias("is_posting"), listing.json_date(F.try_variant_get(p, "$.datePosted", "string")).alias("posted_at"), listing.job_location(p).alias("location"),
        listing.education(p).alias("education"), listing.organization(p).alias("organization"), listing.telecommute(p).alias("remote"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['phd'] WHEN 1 THEN ['undergraduate'] ELSE ['graduate'] END AS degree_levels, o_orderkey % 4 = 0 OR o_orderkey % 10 = 0 AS remote
  FROM orders WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 17 <> 0)""")
def field_precedence(spark: SparkSession, d: str) -> DataFrame:
    """A posting's own values before those of the text, for the same postings with a text for master's students."""
    rows = _json_rows(spark, d).filter(listing.job_posting(F.col("block")).isNotNull())
    pages = rows.select("o_orderkey", F.lit("A place").alias("title"), F.when(F.col("o_orderkey") % 10 == 0, "work from home").otherwise("").alias("abstract"), F.lit("For a master's student").alias("content"), F.array("block").alias("json_ld"))
    return listing.with_listing_fields(pages).select("o_orderkey", "degree_levels", "remote")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Second' ELSE 'First' END AS organization,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 10 HOUR WHEN 1 THEN INTERVAL 8 HOUR WHEN 2 THEN INTERVAL 36000500 MILLISECOND ELSE INTERVAL 0 HOUR END END AS posted_at FROM orders""")
def jsonld_several(spark: SparkSession, d: str) -> DataFrame:
    """The first posting among several blocks of the orders, with dates with an offset, without one, with fractions, and without a time."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    time = F.when(key % 4 == 0, "T10:00:00").when(key % 4 == 1, "T10:00:00+02:00").when(key % 4 == 2, "T10:00:00.5Z").otherwise("")
    first = F.concat(F.lit('{"@type":"JobPosting","datePosted":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), time, F.lit('","hiringOrganization":{"name":"First"}}'))
    blocks = F.array(F.lit("{broken"), F.lit('{"@type":"Person"}'), F.when(key % 3 > 0, first), F.lit('[{"@type":"JobPosting","hiringOrganization":{"name":"Second"}}]'))
    pages = o.select("o_orderkey", F.lit("t").alias("title"), F.lit("a").alias("abstract"), F.lit("c").alias("content"), blocks.alias("json_ld"))
    return listing.with_listing_fields(pages).select("o_orderkey", "organization", "posted_at")


# Web pages, links and the crawl


def _raw_pages(spark: SparkSession, d: str) -> DataFrame:
    one = newest(table(spark, d, "web_pages"), "page_id", "last_crawled_at", ["url", "title", "abstract", "content", "links"])
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    anchors = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit('<a href="'), x, F.lit('#part">x</a>'))), "")
    body = F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("<p>"), esc(x))), "")
    html = F.concat(F.lit("<html><head><title> </title><title>"), esc(F.col("title")), F.lit('</title><meta property="og:description" content="'), F.replace(esc(F.col("abstract")), F.lit('"'), F.lit("&quot;")), F.lit('"><script>"</p><b>"</script></head><body><h1>'), esc(F.col("title")), F.lit("</h1>"), body, F.lit("<div>"), anchors, F.lit("</div></body></html>"))
    return one.select("page_id", "url", html.alias("html"))


@query(f"WITH one AS (SELECT page_id, arg_max(struct_pack(t := title), last_crawled_at).t AS title FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id) SELECT page_id, {_TRIM('title')} AS title FROM one")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """The titles read from the pages written as HTML."""
    return read_pages(_raw_pages(spark, d), ["page_id"], ["title"])


@query("WITH one AS (SELECT page_id, arg_max(struct_pack(l := links), last_crawled_at).l AS links FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id) SELECT page_id, unnest(links) AS link FROM one WHERE len(links) > 0")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """The links read from the pages written as HTML, resolved, without fragments."""
    return read_pages(_raw_pages(spark, d), ["page_id"], ["links"]).select("page_id", F.explode("links").alias("link"))


@query("""WITH one AS (SELECT page_id, arg_max(struct_pack(t := title, c := content), last_crawled_at) AS s FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id),
  e AS (SELECT page_id, list_concat([struct_pack(tag := 'title', text := ' '), struct_pack(tag := 'title', text := coalesce(s.t, '')), struct_pack(tag := 'h1', text := coalesce(s.t, ''))], list_transform(string_split(coalesce(s.c, ''), chr(10)), lambda x: struct_pack(tag := 'p', text := x))) AS l FROM one)
  SELECT page_id, CAST(i - 1 AS INT) AS elem_idx, l[i].tag AS tag, l[i].text AS text FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM e)""")
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements read from the pages written as HTML."""
    return read_pages(_raw_pages(spark, d), ["page_id"], ["elements"]).select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")


_CUT = lambda t, n: f"CASE WHEN strlen({t}) <= {n} THEN {t} ELSE left({t}, k{n}) || CASE WHEN strlen(left({t}, k{n})) < {n} THEN chr(65533) ELSE '' END END"
_FITS = lambda t, n: f"CASE WHEN strlen({t}) > {n} THEN list_max(list_filter(range({n} // 4, {n} + 1), lambda k: strlen(left({t}, k)) <= {n})) END AS k{n}"


@query(f"""WITH one AS (SELECT page_id, arg_max(struct_pack(t := title, a := abstract, c := content), last_crawled_at) AS s FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id),
  e AS (SELECT page_id, {_TRIM("coalesce(s.a, '')")} AS meta, list_transform(string_split(coalesce(s.c, ''), chr(10)), lambda x: x) AS p, coalesce(s.t, '') AS t FROM one),
  g AS (SELECT page_id, CASE WHEN meta <> '' THEN meta ELSE coalesce(list_filter(list_transform(p, lambda x: {_TRIM('x')}), lambda x: strlen(x) > 20)[1], '') END AS a, '  ' || t || ' ' || t || ' ' || array_to_string(p, ' ') AS c FROM e),
  k AS (SELECT *, {_FITS('a', 150)}, {_FITS('c', 20000)} FROM g)
  SELECT page_id, {_CUT('a', 150)} AS abstract, {_CUT('c', 20000)} AS content FROM k""")
def html_page(spark: SparkSession, d: str) -> DataFrame:
    """The abstracts and contents read from the pages written as HTML, cut to their bytes."""
    return read_pages(_raw_pages(spark, d), ["page_id"], ["abstract", "content"])


@query()
def crawl_index(spark: SparkSession, d: str) -> DataFrame:
    """The postings of the pages written as HTML: each element's language found, English words stemmed."""
    return crawl.build_index(crawl.extract(_raw_pages(spark, d), _now(), table(spark, d, "allowlist")))["postings"]


_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_TWO = "regexp_extract(h, '([^.]+\\.[^.]+)$', 1)"
_SUFFIX = f"(regexp_matches({_TWO}, '^(ac|asn|com?|edu|gob?|gouv|govt?|gub|gv|ltd|mil|net?|nhs|nom|org?|plc|police|sch|school)[.][a-z][a-z]$') AND NOT list_contains(['be', 'ca', 'cc', 'ch', 'cz', 'de', 'dk', 'eu', 'fi', 'li', 'lu', 'nl', 'no', 'si', 'tv', 'us'], right({_TWO}, 2)) OR {_TWO} IN ('ac.be', 'gc.ca', 'github.io', 'blogspot.com'))"
_DOMAIN = f"nullif(CASE WHEN {_SUFFIX} THEN regexp_extract(h, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE {_TWO} END, '')"


@query(f"SELECT url, h AS host, {_DOMAIN} AS domain FROM (SELECT DISTINCT url, {_HOST} AS h FROM web_pages)")
def url_domains(spark: SparkSession, d: str) -> DataFrame:
    """Host and registrable domain of every url."""
    return table(spark, d, "web_pages").select("url").distinct().select("url", urls.host(F.col("url")).alias("host"), urls.registrable_domain(F.col("url")).alias("domain"))


@query(f"WITH u AS (SELECT DISTINCT page_id, url, {_HOST} AS h FROM web_pages), e AS (SELECT page_id, url, {_DOMAIN} AS domain FROM u) SELECT page_id, url, CAST(coalesce(tier, 3) AS INT) AS trust_tier FROM e LEFT JOIN (SELECT lower(domain) AS domain, max(tier) AS tier FROM allowlist GROUP BY 1) USING (domain)")
def allowlist_tier(spark: SparkSession, d: str) -> DataFrame:
    """The trust tier of every page by its domain."""
    return crawl.with_tier(table(spark, d, "web_pages").select("page_id", "url").distinct(), table(spark, d, "allowlist")).select("page_id", "url", "trust_tier")


@query(f"WITH l AS (SELECT DISTINCT page_id, unnest(links) AS url FROM web_pages), u AS (SELECT *, {_HOST} AS h FROM l), e AS (SELECT page_id, url, {_DOMAIN} AS domain FROM u) SELECT page_id, url FROM e WHERE domain IN (SELECT lower(domain) FROM allowlist WHERE tier <= 2)")
def allowlist_semi(spark: SparkSession, d: str) -> DataFrame:
    """The links of all pages to domains of the first two tiers."""
    links = table(spark, d, "web_pages").select("page_id", F.explode("links").alias("url")).distinct()
    return crawl.allowed(links, table(spark, d, "allowlist").filter("tier <= 2")).select("page_id", "url")


_FIRST = "SELECT page_id, url FROM (SELECT DISTINCT page_id, url FROM web_pages WHERE url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1"


@query(f"SELECT * FROM ({_FIRST}) WHERE url NOT IN (SELECT url FROM web_pages WHERE url IS NOT NULL AND trust_tier = 1)")
def page_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """The pages that are new to a store of the first tier's, each url once."""
    pages = table(spark, d, "web_pages").select("page_id", "url", "trust_tier").distinct()
    return index.insert_if_absent(pages.select("page_id", "url").distinct(), pages.filter("trust_tier = 1")).select("page_id", "url")


@query("SELECT count(*) AS n, count(DISTINCT url) AS urls, 1 AS least, count(*) AS most FROM (SELECT DISTINCT url FROM (SELECT url FROM web_pages UNION ALL SELECT unnest(links) FROM web_pages) WHERE url IS NOT NULL)")
def page_ids(spark: SparkSession, d: str) -> DataFrame:
    """That the ids of all urls and link targets are dense and distinct."""
    w = table(spark, d, "web_pages")
    ids = index.assign_ids(w.select("url").union(w.select(F.explode("links"))))
    return ids.agg(F.count_distinct("page_id").alias("n"), F.count_distinct("url").alias("urls"), F.min("page_id").cast("int").alias("least"), F.max("page_id").alias("most"))


@query("""WITH k AS (SELECT url, min(page_id) AS page_id FROM web_pages WHERE trust_tier = 1 AND url IS NOT NULL GROUP BY url), u AS (SELECT DISTINCT url FROM (SELECT url FROM web_pages UNION ALL SELECT unnest(links) FROM web_pages) WHERE url IS NOT NULL),
  n AS (SELECT count(*) AS n FROM u ANTI JOIN k USING (url)), t AS (SELECT count(*) AS kept, max(page_id) AS top FROM k) SELECT kept, n AS added, top + 1 AS least, top + n AS most FROM n, t""")
def page_ids_added(spark: SparkSession, d: str) -> DataFrame:
    """That known urls, those of tier 1, keep their ids and the others' follow the greatest of them without gaps."""
    w = table(spark, d, "web_pages")
    known = w.filter("trust_tier = 1 AND url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id"))
    ids = index.assign_ids(w.select("url").union(w.select(F.explode("links"))), known).join(known.select("url", F.col("page_id").alias("old")), "url", "left")
    new = F.when(F.col("old").isNull(), F.col("page_id"))
    return ids.agg(F.count(F.when(F.col("page_id") == F.col("old"), 1)).alias("kept"), F.count_distinct(new).alias("added"), F.min(new).alias("least"), F.max(new).alias("most"))


@query("WITH t AS (SELECT url, min(page_id) AS dst_id FROM web_pages WHERE url IS NOT NULL GROUP BY url), l AS (SELECT DISTINCT page_id AS src_id, unnest(links) AS url FROM web_pages) SELECT DISTINCT src_id, dst_id FROM l JOIN t USING (url)")
def outbound_edges(spark: SparkSession, d: str) -> DataFrame:
    """The links between stored pages."""
    w = table(spark, d, "web_pages")
    return index.outbound_edges(w.select("page_id", "links"), w.filter("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src_id, dst_id FROM link_edges WHERE src_id <> dst_id), r(node) AS (SELECT DISTINCT page_id FROM web_pages WHERE trust_tier = 1 AND page_id IS NOT NULL UNION SELECT e.dst_id FROM r JOIN e ON e.src_id = r.node)
  SELECT node, 0 AS least FROM r""")
def frontier_reached(spark: SparkSession, d: str) -> DataFrame:
    """Every page that links lead to from the pages of tier 1."""
    return frontier_bfs(spark, d).select("node", F.lit(0).alias("least"))


_ROUNDS = 30  # of the SQL, which needs a number; the plan ends with an empty frontier


@query("WITH e AS MATERIALIZED (SELECT DISTINCT src_id, dst_id FROM link_edges WHERE src_id <> dst_id), r0 AS MATERIALIZED (SELECT DISTINCT page_id AS node, 0 AS depth FROM web_pages WHERE trust_tier = 1 AND page_id IS NOT NULL)"
       + "".join(f", r{k} AS MATERIALIZED (SELECT node, depth FROM r{k - 1} UNION ALL SELECT DISTINCT dst_id, {k} FROM e JOIN r{k - 1} ON src_id = node WHERE depth = {k - 1} AND dst_id NOT IN (SELECT node FROM r{k - 1}))" for k in range(1, _ROUNDS + 1)) + f" SELECT * FROM r{_ROUNDS}")
def frontier_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Every page that links lead to from the pages of tier 1, with the number of links to it."""
    seeds = table(spark, d, "web_pages").filter("trust_tier = 1").select(F.col("page_id").alias("node"))
    e = table(spark, d, "link_edges").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return crawl.breadth_first(e, seeds, 1 << 30)


_LIMIT = 40  # the feature: pages a crawl takes at most


@query("WITH e AS (SELECT DISTINCT src_id, dst_id FROM link_edges WHERE src_id <> dst_id), r0 AS (SELECT min(src_id) AS node, 0 AS depth FROM link_edges), r1 AS (SELECT * FROM r0 UNION ALL SELECT DISTINCT dst_id, 1 FROM e JOIN r0 ON src_id = node), "
       f"r2 AS (SELECT * FROM r1 UNION ALL SELECT DISTINCT dst_id, 2 FROM e JOIN r1 ON src_id = node WHERE depth = 1 AND dst_id NOT IN (SELECT node FROM r1)), r3 AS (SELECT * FROM r2 UNION ALL SELECT DISTINCT dst_id, 3 FROM e JOIN r2 ON src_id = node WHERE depth = 2 AND dst_id NOT IN (SELECT node FROM r2)) SELECT * FROM r3 ORDER BY depth, node LIMIT {_LIMIT}")  # fmt: skip
def frontier_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first pages of a crawl from the least page that links, in order of depth and id, up to a limit of pages."""
    e = table(spark, d, "link_edges").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return crawl.breadth_first(e, e.agg(F.min("src").alias("node")), 3, _LIMIT)


@query("SELECT page_id, to_json(struct_pack(url := url, title := title, trust_tier := trust_tier))::VARCHAR AS json FROM (SELECT page_id, url, title, trust_tier FROM web_pages WHERE url IS NOT NULL AND title IS NOT NULL AND trust_tier IS NOT NULL GROUP BY ALL)")
def page_json(spark: SparkSession, d: str) -> DataFrame:
    """The pages as the JSON texts that are stored of them."""
    w = table(spark, d, "web_pages").filter("url IS NOT NULL AND title IS NOT NULL AND trust_tier IS NOT NULL").select("page_id", "url", "title", "trust_tier").distinct()
    return index.page_json(w)


@query("SELECT count(*) AS pages FROM (SELECT DISTINCT page_id FROM web_pages WHERE page_id IS NOT NULL)")
def page_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of stored pages."""
    return table(spark, d, "web_pages").agg(F.count_distinct("page_id").alias("pages"))


@query("SELECT DISTINCT src_id AS page_id, dst_id FROM link_edges WHERE src_id = (SELECT min(src_id) FROM link_edges)")
def outbound_scan(spark: SparkSession, d: str) -> DataFrame:
    """The outbound links of the first page that has any."""
    e = table(spark, d, "link_edges")
    return e.join(e.agg(F.min("src_id").alias("src_id")), "src_id", "left_semi").select(F.col("src_id").alias("page_id"), "dst_id").distinct()


@query("WITH e AS MATERIALIZED (SELECT DISTINCT src_id, dst_id FROM link_edges WHERE src_id IS NOT NULL AND dst_id IS NOT NULL), n AS MATERIALIZED (SELECT src_id AS page_id FROM e UNION SELECT dst_id FROM e), m AS (SELECT count(*) AS n FROM n), s AS MATERIALIZED (SELECT src_id, dst_id, count(*) OVER (PARTITION BY src_id) AS k FROM e), r0 AS MATERIALIZED (SELECT page_id, 1.0::DOUBLE / n AS rank FROM n, m)"
       + "".join(f", g{k} AS MATERIALIZED (SELECT dst_id AS page_id, sum(rank / k) AS got FROM s JOIN r{k - 1} ON src_id = page_id GROUP BY dst_id), r{k} AS MATERIALIZED (SELECT page_id, 0.15 / n + 0.85 * (coalesce(got, 0) + (1 - (SELECT sum(got) FROM g{k})) / n) AS rank FROM n CROSS JOIN m LEFT JOIN g{k} USING (page_id))" for k in range(1, 11))
       + " SELECT page_id, round(rank, 9) AS rank FROM r10")
def link_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank of each page of the link graph."""
    return index.page_rank(table(spark, d, "link_edges")).withColumn("rank", F.round("rank", 9))


@query("""WITH one AS (SELECT page_id, arg_max(struct_pack(f := fields_of_study, g := degree_levels, r := remote), last_crawled_at) AS s FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id)
  SELECT page_id, coalesce(s.f[1], s.g[1], CASE WHEN s.r THEN 'Remote' END, 'Opportunity') AS badge FROM one""")
def result_badge(spark: SparkSession, d: str) -> DataFrame:
    """The badge of every page."""
    one = newest(table(spark, d, "web_pages"), "page_id", "last_crawled_at", ["fields_of_study", "degree_levels", "remote"])
    return one.select("page_id", search.badge(one).alias("badge"))


@query("SELECT DISTINCT url FROM web_pages WHERE url IS NOT NULL")
def stream_increment(spark: SparkSession, d: str) -> DataFrame:
    """The urls of a store to which the pages were streamed."""
    folder = scratch(spark, "stream")
    pages = table(spark, d, "web_pages").select("page_id", "url")
    pages.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    increment.follow(stream, f"{folder}/store", f"{folder}/state").awaitTermination()
    return spark.read.schema(pages.schema).parquet(f"{folder}/store").select("url")
