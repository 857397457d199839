"""Dictionary words nearest to a token by edit distance over bytes, through a pigeonhole join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import pigeonhole


def raw(word: Column) -> Column:
    """A word's lower-cased UTF-8 bytes, each as one character."""
    return F.decode(F.encode(F.lower(word), "UTF-8"), "ISO-8859-1")


def _within(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of `left` (_a) and `right` (_b), byte strings, within the tolerance, with the columns of both and distance."""
    return pigeonhole.near_pairs(left, right, "_a", "_b", lambda _: F.lit(tolerance), tolerance, least=0).withColumnRenamed("edits", "distance")


def near_words(tokens: DataFrame, words: DataFrame, tolerance: int = 2) -> DataFrame:
    """All dictionary words at the least distance from each token, within the tolerance: token, word, frequency, distance.

    `words`: word, frequency. No pair of all tokens and words is made, and a word costs its length, however long it is.
    """
    t = tokens.select("token").filter("token IS NOT NULL").distinct().withColumn("_a", raw(F.col("token")))
    pairs = _within(t, words.select("word", "frequency").filter("word IS NOT NULL").withColumn("_b", raw(F.col("word"))), tolerance).drop("_a", "_b")
    least = pairs.groupBy("token").agg(F.min(F.struct("distance")).alias("_l"))
    return pairs.join(least, "token").filter("distance = _l.distance").select("token", "word", "frequency", "distance")


def near_pairs(words: DataFrame, tolerance: int = 2) -> DataFrame:
    """All pairs of different words within the tolerance: a, b (a < b), distance. Found as in `near_words`; `words`: word."""
    w = words.select("word").filter("word IS NOT NULL").distinct()
    pairs = _within(w.select(F.col("word").alias("a"), raw(F.col("word")).alias("_a")), w.select(F.col("word").alias("b"), raw(F.col("word")).alias("_b")), tolerance)
    return pairs.filter("a < b").select("a", "b", "distance")


def first_words(near: DataFrame, limit: int) -> DataFrame:
    """The first corrections of each token: by distance, frequency and the word: token, word, frequency, distance, place."""
    order = Window.partitionBy("token").orderBy("distance", F.col("frequency").desc(), "word")
    ranked = near.withColumn("place", F.row_number().over(order))
    return ranked if limit <= 0 else ranked.filter(F.col("place") <= limit)


def suggestions(near: DataFrame, limit: int = 5) -> DataFrame:
    """A token's suggestions in order: token, suggestions (ARRAY<STRING>). Tokens without any have no row."""
    rows = first_words(near, limit).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("_s"))
    return rows.select("token", F.transform("_s", lambda x: x["word"]).alias("suggestions"))


def suggestion_map(suggested: DataFrame, by: str = "query_id") -> DataFrame:
    """The suggestions of each query as one map: by, suggestions (MAP<STRING, ARRAY<STRING>>)."""
    return suggested.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "suggestions")))).alias("suggestions"))
