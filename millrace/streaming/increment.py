"""Pages added to a store as they arrive, each url once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stored(spark: SparkSession, store: str, like: DataFrame) -> DataFrame:
    """The pages of a store, none where it doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(like.schema).parquet(store) if there else like.filter(F.lit(False))


def add_pages(batch: DataFrame, batch_id: int, store: str, key: str = "url") -> None:
    """Writes the rows of a batch whose key is not stored, one for each key, as the batch's own part of the store.

    A batch that is run again replaces its part, after being compared with the other batches' parts only, so the outcome is the same. Of the
    store only the keys are read.
    """
    spark = batch.sparkSession
    others = stored(spark, store, batch.withColumn("batch", F.lit(0))).filter(F.col("batch") != batch_id)
    new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(others.select(key), key, "left_anti").select(*batch.columns)
    new.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


def follow(pages: DataFrame, store: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Adds the pages of a stream to a store, until what is there now is read."""
    return pages.writeStream.foreachBatch(lambda df, i: add_pages(df, i, store, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
