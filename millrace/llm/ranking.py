"""One ranking from scores on different scales: median rank aggregation (problem 7).

Only an item's rank in each score counts, so no score prevails by its range. Ties share their mean rank; an item without a score
has the last rank of it. Items are ordered by the weighted median of their ranks, then by the mean rank, then by identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group of more rows than this is ranked in ranges of values, so that no task holds all of it.
GROUP_ROWS = 200_000


def weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """The weighted median of a few columns: the mean of the lower and the upper one."""
    half = sum(weights) / 2
    items = F.array(*[F.struct(r.alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)])
    upto = lambda x: F.aggregate(F.filter(items, lambda y: y["r"] <= x["r"]), F.lit(0.0), lambda a, y: a + y["w"])
    low = F.array_min(F.transform(F.filter(items, lambda x: upto(x) >= half - 1e-12), lambda x: x["r"]))
    high = F.array_min(F.transform(F.filter(items, lambda x: upto(x) > half + 1e-12), lambda x: x["r"]))
    return (low + high) / 2


def _small(items: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """Ranks within groups that fit a task: one shuffle by group serves every window."""
    for s in scores:
        ahead = Window.partitionBy(group).orderBy(F.col(s).desc_nulls_last())
        ties = Window.partitionBy(group, s)
        items = items.withColumn(f"_r_{s}", F.rank().over(ahead) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    return items


def _large(items: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """The same ranks for groups of any size, from counts of values in ranges between approximate quantiles."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).alias("v")) for k, s in enumerate(scores)])).alias("_x")
    long = items.select(group, item, pairs).select(group, item, "_x.k", "_x.v")  # null, no merit, is below -infinity
    cuts = long.groupBy(group, "k").agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 10_000).alias("_cuts"))
    counted = long.groupBy(group, "k", "v").agg(F.count("*").alias("n")).join(cuts, [group, "k"])
    counted = counted.withColumn("_part", F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter(F.array_distinct(F.coalesce("_cuts", F.array().cast("array<double>"))), lambda c: c < F.col("v"))))).drop("_cuts")
    sums = counted.groupBy(group, "k", "_part").agg(F.sum("n").alias("_n"))
    above = Window.partitionBy(group, "k").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(group, "k", "_part", (F.sum("_n").over(above) - F.col("_n")).alias("_above"))
    inside = Window.partitionBy(group, "k", "_part").orderBy(F.col("v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_upto", F.sum("n").over(inside)).join(sums, [group, "k", "_part"])
    ranked = ranked.select(F.col(group).alias("_g"), F.col("k").alias("_k"), F.col("v").alias("_v"), (F.col("_above") + F.col("_upto") - F.col("n") + 1 + (F.col("n") - 1) / 2).alias("_rank"))
    each = [F.max(F.when(F.col("k") == k, F.col("_rank"))).alias(f"_r_{s}") for k, s in enumerate(scores)]
    same = (F.col(group) == F.col("_g")) & (F.col("k") == F.col("_k")) & F.col("v").eqNullSafe(F.col("_v"))
    return long.join(ranked, same).groupBy(group, item).agg(*each)


def rank_items(df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each item of each group with its rank in every score: group, item, rank_<score>, median_rank, mean_rank (all DOUBLE).

    Higher is better in every score. Null and NaN are no merit: they rank below every value, tied. Rows of one group and item count
    once, with the best of each score. Weights default to 1 and must be positive. Rows with a null group or item are left out;
    an empty table gives an empty table; other columns are not read.
    """
    weights = weights or [1.0] * len(scores)
    if len(weights) != len(scores) or min(weights) <= 0:
        raise ValueError("one positive weight for each score")
    value = lambda s: F.when(~F.isnan(F.col(f"`{s}`").cast("double")), F.col(f"`{s}`").cast("double") + F.lit(0.0))
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    items = rows.groupBy(group, item).agg(*[F.max(value(s)).alias(s) for s in scores])
    large = rows.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows).select(group)
    names = [f"_r_{s}" for s in scores]
    both = _small(items.join(large, group, "left_anti"), group, scores).select(group, item, *names).unionByName(
        _large(items.join(large, group, "left_semi"), group, item, scores).select(group, item, *names)
    )
    ranks = [F.col(n) for n in names]
    mean = sum((r * w for r, w in zip(ranks, weights)), F.lit(0.0)) / sum(weights)
    return both.select(group, item, *[r.alias(f"rank_{s}") for r, s in zip(ranks, scores)], weighted_median(ranks, weights).alias("median_rank"), mean.alias("mean_rank"))


def first_places(ranked: DataFrame, group: str, item: str, places: int = 3) -> DataFrame:
    """The first places of each group: group, item, place (INT). Each task keeps only its own first places before the shuffle."""
    order = Window.partitionBy(group).orderBy("median_rank", "mean_rank", item)
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= places).select(group, item, "place")
