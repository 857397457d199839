"""The signals of a listing for a query, and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import RankerConfig
from millrace.functions.text import fields


def terms(text: Column) -> Column:
    """Lower-cased words between white space; repeated ones stay."""
    return fields(F.lower(text))


def words_of(text: Column) -> Column:
    """The terms of a text, none for null."""
    return terms(F.coalesce(text, F.lit("")))


def words_of_all(texts: Column) -> Column:
    """The terms of all texts of an array, none for null ones."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), words_of)))


def field_match(terms: Column, title: Column, tags: Column, organization: Column) -> Column:
    """Raw query terms (how many there are) found in title, tags and organization (how many are in each), weighted .6, .25 and .15; 0 without terms."""
    score = 0.6 * (title / terms) + 0.25 * (tags / terms) + 0.15 * (organization / terms)
    return F.when(terms == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def field_of_study(major_terms: Column, studies: Column, study_terms: Column) -> Column:
    """1 if the terms of major and studies have one in common, .15 if not, .5 if either is missing."""
    none = (F.size(major_terms) == 0) | studies.isNull() | (F.size(studies) == 0)
    return F.when(none, 0.5).when(F.arrays_overlap(major_terms, study_terms), 1.0).otherwise(0.15)


def with_page_terms(pages: DataFrame) -> DataFrame:
    """Pages with the terms by which they are ranked, so that each page is split once and not for every query that finds it."""
    return pages.withColumns({"_title": words_of(F.col("title")), "_tags": words_of_all(F.col("tags")), "_organization": words_of(F.col("organization")), "_studies": words_of_all(F.col("fields_of_study"))})


def with_query_terms(queries: DataFrame) -> DataFrame:
    """Queries with the terms of q and major."""
    return queries.withColumns({"_terms": terms(F.col("q")), "_major": words_of(F.col("major"))})


def trust(tier: Column, most: int = 3) -> Column:
    """From 1 for the first tier down to 0 for the last."""
    if most <= 1:
        return F.lit(1.0)
    return 1 - (F.greatest(F.lit(1), F.least(F.lit(most), tier)) - 1) / (most - 1)


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, timestamps without zone."""
    return F.timestamp_diff("MICROSECOND", a, b) / 3.6e9


def freshness(posted: Column, crawled: Column, now: Column, half_life: float = 336.0) -> Column:
    """A half for every half-life (hours) since a listing was posted, else crawled; .5 if neither is known; 1 for the future."""
    at = F.coalesce(posted, crawled)
    return F.when(at.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours_between(at, now)) / half_life))


def urgency(deadline: Column, now: Column, window: float = 1440.0, none: float = 0.5) -> Column:
    """From 0 at the window (hours) before a deadline up to 1 at it; 0 when it has passed; `none` without one."""
    left = hours_between(now, deadline)
    return F.when(deadline.isNull(), none).when((left < 0) | (left >= window), 0.0).otherwise(1 - left / window)


def raw_relevance(hits: Column, score: Column) -> Column:
    """A hundred for every token that hit, and the hits' scores."""
    return 100 * hits + score


def scaled(value: Column, lo: Column, hi: Column) -> Column:
    """A value scaled to [0, 1] between two ends; 1 where they are equal."""
    return F.when(hi == lo, 1.0).otherwise((value - lo) / (hi - lo))


def min_max(df: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    """`df` with `value` scaled to [0, 1] within each group; 1 where all are equal. Only minima and maxima are shuffled by group."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, by).withColumn(to, scaled(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def rounded(value: Column, digits: int) -> Column:
    """A double that is not negative, rounded half up to some digits: by arithmetic, as SQL does it, and not by decimals, which cost more than all else of a score."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.5) / scale


def composite(relevance: Column, match: Column, study: Column, trusted: Column, fresh: Column, urgent: Column, config: RankerConfig = RankerConfig()) -> Column:
    """The weighted sum of the six signals."""
    w = config.weights
    return w.relevance * relevance + w.field_match * match + w.field_of_study * study + w.trust * trusted + w.freshness * fresh + w.urgency * urgent


def with_page_signals(pages: DataFrame, now: Column, config: RankerConfig = RankerConfig()) -> DataFrame:
    """Pages with the signals that no query changes: trust, freshness, urgency."""
    return pages.withColumns({
        "trust": trust(F.coalesce("trust_tier", F.lit(config.max_trust_tier)), config.max_trust_tier),
        "freshness": freshness(F.col("posted_at"), F.col("last_crawled_at"), now, config.half_life_hours),
        "urgency": urgency(F.col("deadline_at"), now, config.urgency_window_hours, config.no_deadline_urgency),
    })


def score_candidates(cands: DataFrame, config: RankerConfig = RankerConfig()) -> DataFrame:
    """Candidates of queries with their signals and `final`.

    `cands`: the query's _terms and _major, as `with_query_terms` gives them; raw relevance and its ends (_lo, _hi) among the query's
    candidates; the numbers of terms found in _title, _tags and _organization; and a page's fields_of_study, _studies, trust, freshness, urgency.
    """
    c = cands.withColumns({
        "relevance": scaled(F.col("raw"), F.col("_lo"), F.col("_hi")),
        "field_match": field_match(F.size("_terms"), F.col("_title"), F.col("_tags"), F.col("_organization")),
        "study": field_of_study(F.col("_major"), F.col("fields_of_study"), F.col("_studies")),
    }).drop("_terms", "_major", "_lo", "_hi", "_title", "_tags", "_organization", "_studies")
    return c.withColumn("final", composite(*[F.col(x) for x in ("relevance", "field_match", "study", "trust", "freshness", "urgency")], config=config))
