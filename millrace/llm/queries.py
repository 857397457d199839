"""Queries of the operators for text corpora, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import body, canonical, mixing, ranking, residue, site_lines, spam, splitting, tokens
from millrace.llm.page_scan import scan_pages
from millrace.session import durable
from millrace.sources.tables import table

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


# Problem 1


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The titles and contents that hold residue."""
    return residue.find_residue(table(spark, d, "web_pages"))


# Problem 3

_SPACE = r"[\s\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_P3 = rf"""WITH one AS (SELECT page_id, max_by(content, last_crawled_at) AS content,
    regexp_extract(rtrim(lower(regexp_extract(max_by(url, last_crawled_at), '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@\\]*@)?([^/?#:\\]+)', 1)), '.'), '([^.]+(?:\.[^.]+)?)$', 1) AS site
  FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id),
sites AS (SELECT site, count(*) AS n FROM one WHERE site <> '' GROUP BY site),
parts AS (SELECT page_id, site, string_split(content, chr(10)) AS l FROM one WHERE site <> '' AND content IS NOT NULL),
lines AS (SELECT page_id, site, unnest(range(1, len(l) + 1)) AS line_no, lower(trim(regexp_replace(unnest(l), '{_SPACE}', ' ', 'g'))) AS line FROM parts),
often AS (SELECT site, line FROM (SELECT site, line, count(DISTINCT page_id) AS k FROM lines WHERE line <> '' GROUP BY site, line) JOIN sites USING (site) WHERE k >= 5 AND k * 5 >= n)
"""


@query(_P3 + "SELECT page_id, CAST(line_no AS INT) AS line_no FROM lines JOIN often USING (site, line)")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines repeated across their site."""
    return site_lines.find_repeated_lines(table(spark, d, "web_pages")).select("page_id", "line_no")


@query(_P3 + """, paged AS (SELECT page_id, site, line_no, line, lead(line) OVER w AS nxt, lead(line_no) OVER w AS next_no FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY page_id ORDER BY line_no)),
linked AS (SELECT site, line, nxt FROM (SELECT site, line, nxt, count(DISTINCT page_id) AS k FROM paged SEMI JOIN often USING (site, line) WHERE nxt IS NOT NULL GROUP BY ALL) JOIN sites USING (site) WHERE k >= 5 AND k * 5 >= n),
gone AS (SELECT page_id, line_no FROM lines SEMI JOIN often USING (site, line) UNION SELECT page_id, unnest(range(line_no + 1, next_no)) FROM paged JOIN linked USING (site, line, nxt) WHERE next_no > line_no + 1),
outs AS (SELECT page_id, list(line_no) AS out FROM gone GROUP BY page_id)
SELECT page_id, CASE WHEN out IS NULL THEN content ELSE list_aggregate(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(out, i)), lambda i: l[i]), 'string_agg', chr(10)) END AS content, CAST(coalesce(len(out), 0) AS INT) AS removed
FROM (SELECT page_id, content, string_split(content, chr(10)) AS l FROM one) LEFT JOIN outs USING (page_id)""")
def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each page's content without the lines repeated across its site."""
    return site_lines.without_repeated_lines(table(spark, d, "web_pages"))


@query()
def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of lines repeated across each site."""
    return site_lines.repeated_blocks(table(spark, d, "web_pages"))


# Problem 5


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pages of repeated keywords, tags or links instead of sentences."""
    return spam.find_spam(table(spark, d, "web_pages"))


# Problem 6


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """What stands outside the main body of the pages that are neither spam nor residue."""
    pages = table(spark, d, "web_pages")
    scan = durable(scan_pages(pages, units=True, features=True, field=body.train(pages)), "scan")  # one pass for problems 1, 5 and 6
    other = spam.spam_pages(scan).union(residue.residue_fields(scan).filter("field = 'content'").select("page_id")).distinct()
    return body.outside_rows(scan).join(other, "page_id", "left_anti")


@query()
def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every page."""
    return body.main_bodies(table(spark, d, "web_pages"))


# Problem 7

_SCORES = ["bm25", "trust_tier", "freshness", "deadline_urgency"]
_ITEMS = "SELECT query_id, page_id, " + ", ".join(f"max(CASE WHEN NOT isnan({s}) THEN {s} END) AS {s}" for s in _SCORES) + " FROM score_breakdown WHERE query_id IS NOT NULL AND page_id IS NOT NULL GROUP BY query_id, page_id"
_RANKS = "SELECT query_id, page_id, " + ", ".join(
    f"rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, {s}) - 1) / 2.0 AS r{k}" for k, s in enumerate(_SCORES)
) + " FROM items"
_MEDIANS = "SELECT *, (list_sort([r0, r1, r2, r3])[2] + list_sort([r0, r1, r2, r3])[3]) / 2.0 AS median_rank, (r0 + r1 + r2 + r3) / 4.0 AS mean_rank FROM ranks"
_P7 = f"WITH items AS ({_ITEMS}), ranks AS ({_RANKS}), medians AS ({_MEDIANS}) "


@query(_P7 + "SELECT query_id, page_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, page_id) AS place FROM medians) WHERE place <= 3")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The first three places of each query by median rank."""
    return ranking.first_places(ranking.rank_items(table(spark, d, "score_breakdown"), "query_id", "page_id", _SCORES), "query_id", "page_id")


@query(_P7 + "SELECT query_id, page_id, " + ", ".join(f"CAST(r{k} AS DOUBLE) AS rank_{s}" for k, s in enumerate(_SCORES)) + ", CAST(median_rank AS DOUBLE) AS median_rank, CAST(mean_rank AS DOUBLE) AS mean_rank FROM medians")
def p7_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with its rank in each score, the median and the mean."""
    return ranking.rank_items(table(spark, d, "score_breakdown"), "query_id", "page_id", _SCORES)


# Problem 8


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents"))


# Problem 9


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with the times each is repeated."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual share of each source in each mix."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query()
def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix by tempered weights, of the entropy that its targets have."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), weights="entropy")[0]


@query()
def p9_tempered_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the sources in the mixes by tempered weights."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), weights="entropy")[1]


@query()
def p9_temperatures(spark: SparkSession, d: str) -> DataFrame:
    """The exponents and weights of temperature mixing for the sources of each mix."""
    sized = tokens.count_tokens(table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.temperatures(mixing.plan_mix(mixing.source_sizes(sized), table(spark, d, "mix_targets")))


# Problem 10


def _limits(spark: SparkSession, d: str) -> list[tuple[str, int, int]]:
    """The limits: a table of settings, refused beyond splitting.MOST_LIMITS rows."""
    rows = table(spark, d, "split_limits").select("limit_name", "max_tokens", "overlap_tokens").orderBy("limit_name").limit(splitting.MOST_LIMITS + 1).collect()
    return [tuple(r) for r in rows]


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the splitting cuts under the limit `main`."""
    main = [x for x in _limits(spark, d) if x[0] == "main"]
    pieces = splitting.split_oversized(table(spark, d, "documents"), main, with_text=False)
    return pieces.filter("piece_no = 1").select("doc_id").distinct()


@query()
def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document that is larger than a limit."""
    return splitting.split_oversized(table(spark, d, "documents"), _limits(spark, d))


# Problem 2. The SQL writes the forms again and compares every form with every entry, without the segments.

_LET = lambda x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_PLAIN = lambda x: f"translate(regexp_replace(lower(trim(regexp_replace(replace({x}, '&', ' and '), '{_SPACE}', ' ', 'g'))), '\\p{{M}}+', '', 'g'), '{canonical.ACCENTED}', '{canonical.PLAIN}')"
_SPLIT = lambda x: f"list_filter(string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SAYS = "any candidate course degree education fellow licence license programme program qualification qualified researcher short taught"
_LEVEL = lambda ws: f"list_filter({ws}, lambda w: NOT list_has_any([w, regexp_replace(w, 's$', '')], {[w[:k] for w in _SAYS.split() for k in range(min(3, len(w)), len(w) + 1)]!r}))"
_JOIN = lambda ws: f"coalesce(array_to_string({ws}, ''), '')"
_P2 = rf"""WITH one AS (SELECT page_id, arg_max(struct_pack(l := location, d := degree_levels, f := fields_of_study), last_crawled_at) AS s FROM web_pages WHERE page_id IS NOT NULL GROUP BY page_id),
occ AS (SELECT * FROM (SELECT page_id, 'location' AS field, 1 AS value_pos, s.l AS value FROM one UNION ALL SELECT page_id, 'degree_levels', i, s.d[i] FROM (SELECT page_id, s, unnest(range(1, len(s.d) + 1)) AS i FROM one)
  UNION ALL SELECT page_id, 'fields_of_study', i, s.f[i] FROM (SELECT page_id, s, unnest(range(1, len(s.f) + 1)) AS i FROM one)) WHERE regexp_replace(value, '{_SPACE}', '', 'g') <> ''),
v AS (SELECT field, value, {_PLAIN('value')} AS s FROM (SELECT DISTINCT field, value FROM occ)),
place AS (SELECT field, value, list_filter({_SPLIT("regexp_replace(s, '^[0-9]+[^,;]*[,;]', ' ')")}, lambda w: NOT list_contains({canonical.PLACE_WORDS!r}, w) AND NOT regexp_matches(w, '[0-9]')) AS w FROM v WHERE field = 'location'),
core AS (SELECT field, value, regexp_replace(regexp_replace(s, '{canonical.FIELD_AFTER}', ''), '{canonical.FIELD_BEFORE}', '') AS c FROM v WHERE field = 'fields_of_study'),
lev AS (SELECT field, value, s, CASE WHEN len(own) > 0 THEN own ELSE w END AS w FROM (SELECT *, {_LEVEL('w')} AS own FROM (SELECT *, {_SPLIT("regexp_replace(s, '[''’.]', '', 'g')")} AS w FROM v WHERE field = 'degree_levels'))),
forms AS (SELECT * FROM (
  SELECT field, value, CASE WHEN len(w) > 1 AND length(w[-1]) = 2 THEN w[-1] WHEN len(w) > 1 AND length(w[1]) = 2 THEN w[1] END AS region, 0 AS pref,
    {_JOIN("CASE WHEN len(w) > 1 AND length(w[-1]) = 2 THEN w[1:len(w) - 1] WHEN len(w) > 1 AND length(w[1]) = 2 THEN w[2:] ELSE w END")} AS form FROM place
  UNION ALL SELECT field, value, NULL, 0, {_LET('c')} FROM core
  UNION ALL SELECT field, value, NULL, 1, {_LET(r"regexp_replace(regexp_replace(c, '^(.*), (.*)$', '\2 \1'), '^(.*?) ?\((.*)\)$', '\2 \1')")} FROM core
  UNION ALL SELECT field, value, NULL, 2, {_LET("regexp_replace(c, ' studies$', '')")} FROM core
  UNION ALL SELECT field, value, NULL, 0, {_LET('s')} FROM lev UNION ALL SELECT field, value, NULL, 1, {_LET(r"regexp_replace(s, '\(.*\)', '')")} FROM lev
  UNION ALL SELECT field, value, NULL, 2, {_JOIN('w')} FROM lev UNION ALL SELECT field, value, NULL, 3, CASE WHEN length(w[1]) >= 3 THEN w[1] END FROM lev UNION ALL SELECT field, value, NULL, 4, CASE WHEN length(w[-1]) >= 3 THEN w[-1] END FROM lev) WHERE form <> ''),
c AS (SELECT DISTINCT field, CAST(canon_id AS BIGINT) AS canon_id, {_PLAIN('label')} AS s FROM canon_values WHERE canon_id IS NOT NULL AND label IS NOT NULL),
lc AS (SELECT canon_id, s, {_LET('s')} AS n, {_JOIN('CASE WHEN len(own) > 0 THEN own ELSE w END')} AS core FROM (SELECT *, {_LEVEL('w')} AS own FROM (SELECT *, list_transform(regexp_split_to_array(s, ' +'), lambda x: {_LET('x')}) AS w FROM c WHERE field = 'degree_levels'))),
cw AS (SELECT canon_id, unnest([{_SPLIT('s')}, list_transform(regexp_split_to_array(s, ' +'), lambda x: {_LET('x')})]) AS w FROM c WHERE field = 'fields_of_study'),
raw AS (SELECT field, canon_id, CASE WHEN field = 'location' THEN nullif(regexp_extract(s, ',\s*([^,]+)$', 1), '') END AS region, CASE WHEN field = 'location' THEN {_LET(r"regexp_replace(s, ',\s*[^,]+$', '')")} ELSE {_LET('s')} END AS name, true AS fuzzy FROM c
  UNION ALL SELECT 'degree_levels', canon_id, NULL, core, true FROM lc
  UNION ALL SELECT 'degree_levels', canon_id, NULL, unnest(CASE n {' '.join(f"WHEN '{k}' THEN {[x.replace(' ', '') for x in ns]!r}" for k, ns in canonical.DEGREE_NAMES.items())} ELSE [] END), true FROM lc
  UNION ALL SELECT 'degree_levels', canon_id, NULL, unnest(list_transform(range(4, greatest(length(core) - 1, 4) + 1), lambda i: left(core, i))), false FROM lc
  UNION ALL SELECT 'fields_of_study', canon_id, NULL, unnest([{_JOIN('list_transform(w, lambda x: left(x, 4))')}, left(w[1], 4) || {_JOIN('w[2:]')}, {_JOIN('w[1:len(w) - 1]')} || left(w[-1], 4)]), false FROM cw WHERE len(w) > 1),
ent AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY field, region, name) AS owners FROM (SELECT field, canon_id, region, name, bool_or(fuzzy) AS fuzzy FROM raw GROUP BY ALL)) WHERE name <> '' AND (owners = 1 OR fuzzy)),
near AS (SELECT f.field, f.value, f.pref, f.region, e.region AS r, e.canon_id, levenshtein(f.form, e.name) AS edits, CASE WHEN length(e.name) >= 6 THEN 2 WHEN length(e.name) = 5 THEN 1 ELSE 0 END AS k, f.form = e.name AS same, e.fuzzy FROM forms f JOIN ent e USING (field)),
found AS (SELECT *, region IS NOT NULL AND region IN (SELECT region FROM ent WHERE region IS NOT NULL) AS known FROM near WHERE same OR (fuzzy AND edits <= k AND (field <> 'degree_levels' OR pref < 3))),
good AS (SELECT * FROM found WHERE NOT known OR r IS NULL OR region = r),
tied AS (SELECT field, value, edits FROM good WHERE field = 'location' AND NOT known GROUP BY ALL HAVING count(DISTINCT canon_id) > 1),
best AS (SELECT field, value, canon_id, edits FROM good QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY edits, pref, canon_id) = 1),
matched AS (SELECT b.* FROM best b ANTI JOIN tied t USING (field, value, edits)),
p2 AS (SELECT o.page_id, o.field, CAST(o.value_pos AS INT) AS value_pos, o.value, coalesce(m.canon_id, -1) AS canon_id FROM occ o LEFT JOIN matched m USING (field, value)) """


@query(_P2 + "SELECT page_id, field, value_pos, canon_id FROM p2")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The canonical entry of each freely typed value of the web pages, -1 for none."""
    found = canonical.map_values(canonical.page_values(table(spark, d, "web_pages")), table(spark, d, "canon_values"))
    return found.select("page_id", "field", "value_pos", "canon_id")


@query(_P2 + "SELECT field, value, count(*) AS occurrences FROM p2 WHERE canon_id = -1 GROUP BY field, value")
def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, with the number of their occurrences."""
    found = canonical.map_values(canonical.page_values(table(spark, d, "web_pages")), table(spark, d, "canon_values"))
    return found.filter("canon_id = -1").groupBy("field", "value").count().withColumnRenamed("count", "occurrences")
