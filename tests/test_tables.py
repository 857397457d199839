from pyspark.sql import functions as F

from millrace.sources import tables


def test_tables_of_few_splits_are_spread(spark, tmp_path, monkeypatch):
    spark.range(2000).withColumn("t", F.repeat(F.lit("x"), F.col("id").cast("int") % 50)).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    df = tables.table(spark, str(tmp_path), "one")
    assert df.rdd.getNumPartitions() == 1  # tiny
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1)
    df = tables.table(spark, str(tmp_path), "one")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 2000
    plan = df.filter("id < 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), LessThan(id,5)]" in plan and "ReadSchema: struct<id:bigint>" in plan  # still reach the scan
    spark.range(2000).repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/many.parquet")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # each file is a split
    try:
        assert "Exchange" not in tables.table(spark, str(tmp_path), "many")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
