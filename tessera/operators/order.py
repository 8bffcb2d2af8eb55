"""Places in a total order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in ``order``: range partitions, numbered inside and offset by the rows of the partitions before.

    The ranges are written first, as they come from a sample, so that counts and places see the same ones. An order without ties lets Spark split any value."""
    spark = df.sparkSession
    path = scratch(spark, "ordered")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
