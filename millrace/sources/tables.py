"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A table of this many bytes or more that is stored in fewer splits than there are cores is spread over them.
SPREAD_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, in at least as many partitions as there are cores if it isn't tiny.

    A table of many files or row groups, as any large one, is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    if int(plan.optimizedPlan().stats().sizeInBytes()) >= SPREAD_BYTES and plan.toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def newest(df: DataFrame, key: str, by: str, cols: list[str | Column]) -> DataFrame:
    """One row for each `key`: `cols` of its row with the greatest `by`.

    Rows that agree in `by` are told apart by a hash of `cols`, so the choice doesn't depend on the order of rows;
    rows whose `by` is null come last; rows whose `key` is null are left out. Only `cols` are shuffled,
    after a partial aggregation.
    """
    kept = F.struct(*cols)
    order = F.struct(F.col(by), F.xxhash64(kept))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(kept, order).alias("_kept")).select(key, "_kept.*")
