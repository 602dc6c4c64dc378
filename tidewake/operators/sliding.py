"""Sliding totals of a series in buckets (an addition to the query language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_total(rows: DataFrame, keys: list[str], value: Column, span_ns: int, bucket_ns: int) -> DataFrame:
    """keys, bucket_ns, bucket_total and total: the sum of a bucket and of all buckets within the span that ends with it.

    Buckets start at multiples of their length. Values are summed by bucket before anything is
    ordered, so a window sees a row for each bucket and not for each record.
    """
    bucket = (F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(bucket_ns))).alias("bucket_ns")
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("bucket_total"))
    frame = Window.partitionBy(*keys).orderBy("bucket_ns").rangeBetween(-(span_ns - bucket_ns), 0)
    return sums.withColumn("total", F.sum("bucket_total").over(frame))
