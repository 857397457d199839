"""Full-text search: one query or a table of queries through the same plan."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.config import RankerConfig, SearchConfig, page_number, page_size, profile_text, query_text
from millrace.functions.text import stems, trimmed
from millrace.functions.text import tokens as tokens_of
from millrace.operators import fuzzy, rank
from millrace.operators.time_normalise import times_of
from millrace.session import drop, durable, within_seconds
from millrace.sources.tables import newest


#: Parts over which the postings of one word are spread.
WORD_PARTS = 16

#: Hits that one task merges, about: its table of queries and pages stays in memory.
PART_HITS = 1_000_000

#: Queries up to so many are sent to every task, so that hits are never shuffled; joins with more are left to Spark's size checks.
SENT_QUERIES = 200_000

#: One in so many pages is placed first, for the bounds of `within_reach`.
BOUND_PARTS = 32


def clean_postings(postings: DataFrame) -> DataFrame:
    """One posting for each word and page, that with the last position; rows without word, page or position are left out."""
    p = postings.filter("word IS NOT NULL AND page_id IS NOT NULL AND position IS NOT NULL")
    return p.groupBy("word", "page_id").agg(F.max_by("score", F.struct("position", "score")).alias("score"), F.max("position").alias("position"))


def search_index(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings as a search reads them, cleaned and written once, and their dictionary (word, frequency).

    Rows are clustered by word and, so that a frequent word is no hot group, by a hash of the page: a reader prunes by the words' bounds
    in each file.
    """
    clean = clean_postings(postings).repartition("word", F.pmod(F.xxhash64("page_id"), F.lit(WORD_PARTS))).sortWithinPartitions("word")
    stored = durable(clean, "index")
    return stored, durable(word_frequencies(stored), "dictionary")


def word_frequencies(postings: DataFrame) -> DataFrame:
    """A dictionary where none is stored: word, frequency (pages)."""
    return postings.groupBy("word").agg(F.count("*").alias("frequency"))


def valid_queries(queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The queries that can be answered: query_id, q, page, size, major. Blank or too long texts, and pages and sizes out of range, are left out; null pages and sizes have the defaults."""
    q = trimmed(F.col("q"))
    ok = queries.select("query_id", q.alias("q"), F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("size", F.lit(config.default_page_size)).alias("size"), F.substring(trimmed(F.coalesce("major", F.lit(""))), 1, config.max_query_length).alias("major"))
    return ok.filter((F.col("q") != "") & (F.char_length("q") <= config.max_query_length) & (F.col("page") >= 1) & F.col("size").between(1, config.max_page_size)).dropDuplicates(["query_id"])


def query_tokens(queries: DataFrame, language: str = "english", stemmed: bool = False) -> DataFrame:
    """The distinct tokens of each query: query_id, token."""
    t = tokens_of(F.col("q"), language)
    if stemmed:
        t = stems(t)
    return queries.select("query_id", F.explode(F.array_distinct(t)).alias("token"))


def query_words(tokens: DataFrame, dictionary: DataFrame, tolerance: int = 2) -> DataFrame:
    """The words that tokens stand for, as a durable table: query_id, token, word. A token that is no word stands for its first correction."""
    known = dictionary.select("word")
    words = tokens.join(known, F.col("token") == F.col("word")).select("query_id", "token", "word")
    if tolerance > 0:
        missing = durable(tokens.join(known.withColumnRenamed("word", "token"), "token", "left_anti"), "missing")
        fixes = fuzzy.first_words(fuzzy.near_words(missing, dictionary, tolerance), 1).select("token", "word")
        words = words.unionByName(missing.join(fixes, "token").select("query_id", "token", "word"))
    return durable(words, "words")


def find_hits(tokens: DataFrame, postings: DataFrame, dictionary: DataFrame, tolerance: int = 2) -> DataFrame:
    """The hits of tokens: query_id, token, page_id, score, position. A token without postings stands for its first correction.

    Tokens are brought to words first, so the postings are read once; they are joined with the queries' words, which are few beside
    them, by a broadcast where their size allows it, else the rows of a hot word are split at run time.
    """
    return query_words(tokens, dictionary, tolerance).join(postings, "word").select("query_id", "token", "page_id", "score", "position")


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits by query and page: hits_count, hits_sum, positional_distance."""
    return hits.groupBy("query_id", "page_id").agg(F.count("*").alias("hits_count"), F.sum("score").alias("hits_sum"), F.sum("position").alias("positional_distance"))


def listings(pages: DataFrame) -> DataFrame:
    """Pages as the ranking sees them, one row for each page_id; times, in whatever form, are normalised to UTC, null where they stand for no instant."""
    cols = ["url", "title", "abstract", "organization", "trust_tier", "posted_at", "deadline_at", "site_zone", "site_locale", "last_crawled_at", "fields_of_study", "degree_levels", "location", "remote"]
    one = newest(pages, "page_id", "last_crawled_at", [c for c in cols if c in pages.columns])
    one = durable(one.withColumns({c: F.lit(None).cast("string") for c in ("site_zone", "site_locale") if c not in one.columns}), "listings")
    micros = lambda c: F.max(F.when(F.col("field") == c, F.col("epoch_us")))
    stamp = lambda c: F.timestamp_micros(micros(c)).cast("timestamp_ntz").alias(c)
    times = times_of(one).groupBy("page_id").agg(stamp("posted_at"), stamp("deadline_at"))
    empty = F.array().cast("array<string>")
    tagged = one.drop("site_zone", "site_locale", "posted_at", "deadline_at").join(times, "page_id", "left").withColumn("tags", F.concat(F.coalesce("fields_of_study", empty), F.coalesce("degree_levels", empty)))
    stored = durable(rank.with_page_terms(tagged), "pages")  # a batch of queries reads them again and again
    drop(one)
    return stored


def wordings_of(queries: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that look for the same words in the same terms have the same hits, so these are merged once for each such wording.

    Two durable tables: the queries (with their terms, as `rank.with_query_terms` gives them) that have words, with `wording`; and the
    words of the wordings: wording, word, _tokens (how many tokens stand for it, null for none) and _terms (how many raw terms it is).
    """
    own = words.groupBy("query_id").agg(F.sort_array(F.collect_list("word")).alias("_words"))
    alike = Window.partitionBy("_words", F.sort_array("_terms"))  # the queries of one wording
    asked = durable(queries.join(own, "query_id").withColumn("wording", F.min("query_id").over(alike)), "asked")
    one = asked.filter("query_id = wording")
    tokens = one.select("wording", F.explode("_words").alias("word"), F.lit(1).alias("_tokens"), F.lit(0).alias("_terms"))
    terms = one.select("wording", F.explode("_terms").alias("word"), F.lit(None).cast("int").alias("_tokens"), F.lit(1).alias("_terms"))
    sums = [F.sum(c).cast("int").alias(c) for c in ("_tokens", "_terms")]
    return asked.drop("_words"), durable(tokens.unionByName(terms).groupBy("wording", "word").agg(*sums), "wordings")


def page_words(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """What stored pages have of each word: page_id, word, _hit (its postings), their score and position, _title, _tags, _organization (whether it is among these terms)."""
    no, own = F.lit(0), ("_title", "_tags", "_organization")
    hits = postings.join(pages.select("page_id"), "page_id", "left_semi").select("page_id", "word", F.lit(1).alias("_hit"), "score", "position", *[no.alias(c) for c in own])
    every = pages.select("page_id", *own, F.explode(F.array_distinct(F.concat(*own))).alias("word"))
    null = F.lit(None)
    terms = every.select("page_id", "word", no.alias("_hit"), null.cast(postings.schema["score"].dataType).alias("score"), null.cast(postings.schema["position"].dataType).alias("position"), *[F.array_contains(c, F.col("word")).cast("int").alias(c) for c in own])
    sums = [F.sum(c).alias(c) for c in ("_hit", "score", "position")]  # of one posting where they are clean
    return hits.unionByName(terms).groupBy("page_id", "word").agg(*sums, *[F.max(c).alias(c) for c in own])


def merge_wordings(held: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates by wording and page: wording, page_id, hits_count, hits_sum, positional_distance and the terms found in title, tags and organization.

    `held` is partitioned by page_id: with words that are sent to it, each task merges the hits of its own pages and shuffles none.
    """
    both = held.join(words, "word")
    found = [F.sum(F.col(c) * F.col("_terms")).alias(c) for c in ("_title", "_tags", "_organization")]
    times = lambda c, to: F.sum(F.col(c) * F.col("_tokens")).alias(to)
    return both.groupBy("page_id", "wording").agg(times("_hit", "hits_count"), times("score", "hits_sum"), times("position", "positional_distance"), *found).filter("hits_count > 0")


def rank_queries(queries: DataFrame, postings: DataFrame, dictionary: DataFrame, pages: DataFrame, now: Column, ranker: RankerConfig = RankerConfig(), config: SearchConfig = SearchConfig(), stemmed: bool = False) -> DataFrame:
    """Every candidate of every valid query with its signals and final score. Pages that are not stored vanish; a query without tokens has no rows.

    Candidates grow as queries times pages, beyond any store: they are neither written nor shuffled but merged from the pages' words, which
    are partitioned by page, once for the extremes of relevance and again by whoever reads the result.
    """
    pages = pages if "_title" in pages.columns else rank.with_page_terms(pages)
    q = rank.with_query_terms(valid_queries(queries, config))
    asked, words = wordings_of(q, query_words(query_tokens(q, stemmed=stemmed), dictionary, config.fuzzy_tolerance))
    sent = F.broadcast if asked.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES else lambda df: df
    wanted = words.groupBy("word").agg(F.count("*").alias("_wordings"))
    held = durable(page_words(postings, pages).join(sent(wanted), "word"), "held")
    hits = held.agg(F.coalesce(F.sum("_wordings"), F.lit(0))).first()[0]  # one number
    parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-hits // PART_HITS))
    merged = merge_wordings(held.repartition(parts, "page_id"), sent(words)).withColumn("raw", rank.raw_relevance(F.col("hits_count"), F.col("hits_sum")))
    ends = durable(merged.groupBy("wording").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")), "ends")
    signalled = rank.with_page_signals(pages, now, ranker).drop("_title", "_tags", "_organization")
    cands = merged.join(signalled.repartition(parts, "page_id").hint("shuffle_hash"), "page_id")
    return rank.score_candidates(cands.join(sent(asked.join(ends, "wording")), "wording"), ranker).drop("wording")


def last_place(queries: DataFrame) -> int:
    """The last place that any of the queries (page, size) asks for: one number."""
    return int(queries.agg(F.coalesce(F.max(F.col("page").cast("bigint") * F.col("size")), F.lit(0))).first()[0])


def result_page(ranked: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of each query's page, with their place; order: final score, then page_id. Pages out of range are empty.

    With `most`, the last place asked for (`last_place`), each task keeps only that many of its own first rows of a query before the
    shuffle, so a query with many candidates is no hot group.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("final").desc(), "page_id")
    placed = ranked.withColumn("place", F.row_number().over(order))
    if most is not None:
        placed = placed.filter(F.col("place") <= min(most, 2**31 - 1))
    return placed.filter((F.col("place") > (F.col("page") - 1) * F.col("size")) & (F.col("place") <= F.col("page") * F.col("size")))


def within_reach(ranked: DataFrame, most: int) -> DataFrame:
    """The rows of `ranked` that may be on their query's page: all that are on it and not many more, so that few are sorted and shuffled.

    The candidates among one page in BOUND_PARTS are placed first. What comes after the last place asked for of these, comes after that
    place of all candidates too. `most` is the last place that any query asks for.
    """
    some = ranked.filter(F.pmod(F.xxhash64("page_id"), F.lit(BOUND_PARTS)) == 0).select("query_id", "page_id", "page", "size", "final")
    last = result_page(some, most).filter(F.col("place") == F.col("page") * F.col("size")).select("query_id", F.col("final").alias("_final"), F.col("page_id").alias("_page_id"))
    last = durable(last, "bounds")
    sent = F.broadcast(last) if last.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES else last
    ahead = (F.col("final") > F.col("_final")) | ((F.col("final") == F.col("_final")) & (F.col("page_id") <= F.col("_page_id")))
    return ranked.join(sent, "query_id", "left").filter(F.col("_final").isNull() | ahead).drop("_final", "_page_id")


def counts(ranked: DataFrame) -> DataFrame:
    """Results and pages of each query: query_id, total_results, pages_count."""
    return ranked.groupBy("query_id", "size").agg(F.count("*").alias("total_results")).select("query_id", "total_results", F.ceil(F.col("total_results") / F.col("size")).cast("bigint").alias("pages_count"))


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    """The page of an id, its newest crawl; no row where it isn't stored. The filter reaches the scan."""
    return newest(pages.filter(F.col("page_id") == page_id), "page_id", "last_crawled_at", [c for c in pages.columns if c != "page_id"])


def badge(page: DataFrame) -> Column:
    """What a result is labelled with: a field of study, else a degree level, else whether it is remote."""
    return F.coalesce(F.try_element_at("fields_of_study", F.lit(1)), F.try_element_at("degree_levels", F.lit(1)), F.when(F.col("remote"), "Remote"), F.lit("Opportunity"))


def search(q: str, postings: DataFrame, dictionary: DataFrame, pages: DataFrame, now: dt.datetime, page: str | int | None = None, size: str | int | None = None, major: str | None = None, ranker: RankerConfig = RankerConfig(), config: SearchConfig = SearchConfig(), stemmed: bool = False) -> dict:
    """One search: pages (rows of the result page), totalResults, pagesCount, query, page, size, timeMs. The driver receives only one page.

    A search that takes longer than config.search_timeout_seconds is cancelled and raises TimeoutError; the first one of a session, whose
    plans are yet to be compiled, may need more than the default of five.
    """
    text, no, many = query_text(q, config), page_number(page), page_size(size, config)
    spark, start = postings.sparkSession, time.monotonic()
    one = spark.createDataFrame([(1, text, no, many, profile_text(major, config))], "query_id long, q string, page int, size int, major string")

    def run() -> tuple[int, list[dict]]:
        ranked = durable(rank_queries(one, postings, dictionary, pages, F.lit(now).cast("timestamp_ntz"), ranker, config, stemmed), "ranked")
        return ranked.count(), [r.asDict() for r in ranked.orderBy(F.col("final").desc(), "page_id").offset((no - 1) * many).limit(many).collect()]

    total, rows = within_seconds(spark, config.search_timeout_seconds, run)
    return {"query": text, "page": no, "size": many, "totalResults": total, "pagesCount": -(-total // many), "pages": rows, "timeMs": int((time.monotonic() - start) * 1000)}


def health(spark: SparkSession, stored: str | None = None, seconds: float = 2.0) -> dict[str, str]:
    """Whether the session runs a job, and reads a stored table where one is named, within some seconds: status `ok` or `degraded`."""
    try:
        within_seconds(spark, seconds, lambda: (spark.read.parquet(stored) if stored else spark.range(1)).limit(1).count())
        return {"status": "ok"}
    except Exception as e:  # whatever keeps it from answering
        return {"status": "degraded", "error": type(e).__name__}


def client_request(q: str, major: str = "", degree_level: str = "", location: str = "") -> dict[str, str | int]:
    """The parameters of a client's search: its first page of ten, with the profile's values that aren't blank."""
    given = {"q": q, "page": 1, "size": 10, "major": major, "degree": degree_level, "location": location}
    return {k: v for k, v in given.items() if not isinstance(v, str) or v.strip()}


def is_empty_profile(major: Column, degree_level: Column, location: Column) -> Column:
    """Whether all three values of a profile are null or blank."""
    return (F.coalesce(trimmed(major), F.lit("")) == "") & (F.coalesce(trimmed(degree_level), F.lit("")) == "") & (F.coalesce(trimmed(location), F.lit("")) == "")


def suggest(queries: DataFrame, dictionary: DataFrame, config: SearchConfig = SearchConfig(), stemmed: bool = False) -> DataFrame:
    """Suggestions for the tokens of each query that no page holds: query_id, token, suggestions."""
    t = query_tokens(valid_queries(queries, config), stemmed=stemmed)
    missing = t.join(dictionary.select(F.col("word").alias("token")), "token", "left_anti")
    return missing.join(fuzzy.suggestions(fuzzy.near_words(missing, dictionary, config.fuzzy_tolerance), config.suggest_limit), "token").select("query_id", "token", "suggestions")
