"""Sizes, counts and times of partitions and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.kvtext import fields_line_column


def record_bytes() -> Column:
    """Bytes of a record: its time, its message and the text of its fields."""
    return F.lit(8) + F.octet_length("msg") + F.octet_length(fields_line_column(F.col("fields_kv")))


def chunk_stats(rows: DataFrame) -> DataFrame:
    """A row for each chunk; one pass with partial aggregation, nothing is null but for empty input."""
    return rows.groupBy("src", "tag_line", "chunk_id").agg(
        F.count("*").alias("records"), F.sum(record_bytes()).alias("bytes"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns")
    )


def show_partitions(chunks: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Partitions by size, the largest first, with the totals over all of them.

    chunks: rows as of chunk_stats; the table is as small as the number of chunks.
    """
    limit = min(limit, 1000) if limit is not None else None
    each = chunks.groupBy("src", "tag_line").agg(F.sum("bytes").alias("size"), F.sum("records").alias("records"))
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"), F.count_distinct("src").alias("total_partitions"))
    out = each.crossJoin(F.broadcast(total)).orderBy(F.col("size").desc(), "tag_line")  # one row of totals
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def describe_partition(chunks: DataFrame, tag_line: str) -> DataFrame:
    """The chunks of the partition with exactly these tags."""
    return chunks.filter(F.col("tag_line") == tag_line).select("chunk_id", "records", F.col("bytes").alias("size"), "min_ts_ns", "max_ts_ns").orderBy("chunk_id")


def monotonic(rows: DataFrame) -> DataFrame:
    """src, chunk_id and whether the chunk's times never go back."""
    return _by_blocks(rows.withColumns({"tag_line": F.lit(""), "__bytes": F.lit(0)})).select("src", "chunk_id", "monotonic")


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Rows of chunk_stats with whether the chunk's times never go back; records are read once."""
    return _by_blocks(rows.withColumn("__bytes", record_bytes()))


def _by_blocks(rows: DataFrame) -> DataFrame:
    """Counts and times within blocks of bounded size, then from block to block."""
    from pyspark.sql import Window

    from .merge import BLOCK, block_of

    block = ["src", "chunk_id", BLOCK]
    rows = rows.select("src", "tag_line", "chunk_id", "idx", "ts_ns", "__bytes")  # before the exchange
    earlier = F.lag("ts_ns").over(Window.partitionBy(*block).orderBy("idx"))
    marked = rows.withColumn(BLOCK, block_of(F.col("idx"))).withColumn("__back", F.coalesce(F.col("ts_ns") < earlier, F.lit(False)))
    blocks = marked.groupBy(*block, "tag_line").agg(
        F.bool_or("__back").alias("__back"), F.min("ts_ns").alias("__min"), F.max("ts_ns").alias("__max"), F.count("*").alias("records"), F.sum("__bytes").alias("__bytes")
    )
    before = F.max("__max").over(Window.partitionBy("src", "chunk_id").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    back = F.col("__back") | F.coalesce(F.col("__min") < before, F.lit(False))
    return blocks.withColumn("__back", back).groupBy("src", "tag_line", "chunk_id").agg(
        F.sum("records").alias("records"), F.sum("__bytes").alias("bytes"), F.min("__min").alias("min_ts_ns"), F.max("__max").alias("max_ts_ns"), (~F.bool_or("__back")).alias("monotonic")
    )
