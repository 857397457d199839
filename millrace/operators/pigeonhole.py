"""All pairs of texts within a few edits, by a partition-based pigeonhole join.

An entry is cut into k + 1 segments. Within k edits of it a text holds one segment unchanged, at a place that moved by few characters; so
an equality join on positional substrings finds every candidate, and the built-in levenshtein verifies them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Edits = Callable[[Column], Column]


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of k + 1: the first ones are shorter where the length doesn't divide."""
    size, more = F.floor(length / (k + 1)), length % (k + 1)
    first = k + 1 - more
    return size * i + F.greatest(i - first, F.lit(0)), size + F.when(i >= first, 1).otherwise(0)


def near_pairs(texts: DataFrame, entries: DataFrame, text: str, entry: str, edits: Edits, most: int, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """All pairs of a row of `texts` and one of `entries` that agree in the columns `by` and whose texts are within edits(length of the entry).

    The columns of both, and `edits`, the distance. Names must not clash but for `by`. `edits` gives the edits allowed, `most` at most; entries
    with fewer than `least` edits allowed are left out, so 0 finds equal texts too. A segment of an entry of few characters may be
    empty; then all texts of at most 2 * most characters meet it, whose number the alphabet bounds. Rows with a null text have no
    pairs.
    """
    by = by or []
    length = F.length(entry)
    cut = entries.filter(F.col(entry).isNotNull()).withColumn("_len", length).withColumn("_k", edits(length)).filter(F.col("_k") >= least).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    start, size = _segment(F.col("_len"), F.col("_k"), F.col("_i"))
    cut = cut.withColumn("_part", F.substring(F.col(entry), start + 1, size))
    probe = texts.filter(F.col(text).isNotNull()).withColumn("_n", F.length(text))
    probe = probe.withColumn("_len", F.explode(F.sequence(F.greatest(F.col("_n") - most, F.lit(0)), F.col("_n") + most))).withColumn("_k", edits(F.col("_len")))
    probe = probe.withColumn("_d", F.col("_n") - F.col("_len")).filter(F.col("_k") >= least).filter("abs(_d) <= _k").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    start, size = _segment(F.col("_len"), F.col("_k"), F.col("_i"))
    probe = probe.withColumn("_p", start.cast("int")).withColumn("_size", size.cast("int"))
    low = F.greatest(F.expr("_p - _i"), F.expr("_p + _d - (_k - _i)"), F.lit(0))
    high = F.least(F.expr("_p + _i"), F.expr("_p + _d + (_k - _i)"), F.expr("_n - _size"))
    probe = probe.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").withColumn("_at", F.explode(F.sequence("_low", "_high")))
    probe = probe.select(*texts.columns, "_len", "_i", F.substring(F.col(text), F.col("_at") + 1, F.col("_size")).alias("_part"))
    near = probe.join(cut, [*by, "_len", "_i", "_part"]).select(*texts.columns, *[c for c in entries.columns if c not in by], "_k").distinct()
    return near.withColumn("edits", F.expr(f"levenshtein(`{text}`, `{entry}`, _k)")).filter("edits >= 0").drop("_k")
