"""Which chunks and partitions a TRUNCATE takes, from the table of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_plan(chunks: DataFrame, min_size: int = 0, max_size: int | None = None, before_ns: int | None = None) -> DataFrame:
    """chunks with `dropped`, whether truncating each partition takes the chunk.

    The oldest chunks go while a partition is larger than max_size (if that is above min_size), then
    while all their times are at or before before_ns; what remains is never below min_size.
    """
    upto = Window.partitionBy("src").orderBy("chunk_id")
    whole = Window.partitionBy("src")
    left = F.sum("bytes").over(whole) - F.sum("bytes").over(upto)
    rows = chunks.withColumn("__left", left)
    by_size = F.lit(False)
    if max_size and max_size > min_size:
        by_size = (F.col("__left") + F.col("bytes") > max_size) & (F.col("__left") >= min_size)
    rows = rows.withColumn("__by_size", by_size)
    old = F.lit(False)
    if before_ns:
        # The run by time starts where the run by size ended, and stops at the first chunk that is too young.
        old = F.min(F.col("__by_size") | (F.col("max_ts_ns") <= before_ns)).over(upto) & (F.col("__left") >= min_size)
    return rows.withColumn("dropped", F.col("__by_size") | old).drop("__left", "__by_size")


def partition_plan(planned: DataFrame, max_db_size: int | None = None, oldest_first: bool = False) -> DataFrame:
    """A row for each partition that a truncation changes.

    With max_db_size whole partitions go until the rest is within it, those with the latest record
    first (or, with oldest_first, last).
    """
    dropped = F.col("dropped")
    each = planned.groupBy("src", "tag_line").agg(
        F.max("max_ts_ns").alias("latest_ns"),
        F.sum("bytes").alias("before_size"),
        F.sum(F.when(dropped, 0).otherwise(F.col("bytes"))).alias("after_size"),
        F.sum("records").alias("before_records"),
        F.sum(F.when(dropped, 0).otherwise(F.col("records"))).alias("after_records"),
        F.sum(dropped.cast("long")).alias("chunks_dropped"),
        F.count("*").alias("__chunks"),
    )
    gone = F.lit(False)
    if max_db_size is not None:
        # A row for each partition: as small as the catalog.
        latest = F.col("latest_ns") if oldest_first else F.col("latest_ns").desc()
        earlier = F.coalesce(F.sum("after_size").over(Window.orderBy(latest, "tag_line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("after_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        each = each.withColumn("__earlier", earlier).withColumn("__total", total)
        gone = (F.col("after_size") > 0) & (F.col("__total") - F.col("__earlier") > max_db_size)
    each = each.withColumn("__gone", gone)
    kept = lambda c: F.when(F.col("__gone"), F.lit(0).cast("long")).otherwise(F.col(c))
    out = each.select(
        "src",
        "tag_line",
        "latest_ns",
        "before_size",
        kept("after_size").alias("after_size"),
        "before_records",
        kept("after_records").alias("after_records"),
        F.when(F.col("__gone"), F.col("__chunks")).otherwise(F.col("chunks_dropped")).alias("chunks_dropped"),
        (F.col("__gone") | (F.col("after_size") == 0)).alias("deleted"),
    )
    return out.filter((F.col("before_size") != F.col("after_size")) | (F.col("before_size") == 0))
