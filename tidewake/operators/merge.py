"""Order of records across partitions, positions, offsets and limits.

Within a partition records keep the order in which they were appended, even where times go back.
Merging partitions head by head, the smaller time first, then gives the order of the largest time so
far in the partition. Where a partition's times never go back that is the record's own time, and no
window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "__key"
#: Positions of more partitions than this are joined, not spelled out in a condition.
MOST_LITERALS = 100
BLOCK = "__block"


def block_of(idx: Column) -> Column:
    """Number of a record's block within its chunk: blocks hold 65,536 places and keep their order."""
    return F.shiftright(idx, 16)


def with_merge_key(rows: DataFrame, monotonic: bool = False, backward: bool = False) -> DataFrame:
    """rows with the time at which a merge takes them.

    The running maximum is taken block by block of 65,536 places of a chunk and joined to the maxima
    of the blocks before, so no task holds more than a block, however large a chunk or a partition
    is. Backward it is a running minimum from the end: the order is turned, since a frame that reaches
    to the end of its partition is summed up anew for each row.
    """
    if monotonic:
        return rows.withColumn(KEY, F.col("ts_ns"))
    best, turned = (F.min, F.desc) if backward else (F.max, F.asc)
    block = ["src", "chunk_id", BLOCK]
    rows = rows.withColumn(BLOCK, block_of(F.col("idx")))
    own = Window.partitionBy(*block).orderBy(turned("idx")).rowsBetween(Window.unboundedPreceding, 0)
    others = Window.partitionBy("src").orderBy(turned("chunk_id"), turned(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(best("ts_ns").alias("__m"))
    carried = blocks.select(*block, best("__m").over(others).alias("__carried"))
    joined = rows.withColumn("__own", best("ts_ns").over(own)).join(carried, block)
    both = F.least("__own", "__carried") if backward else F.greatest("__own", "__carried")
    return joined.withColumn(KEY, both).drop("__own", "__carried", BLOCK)


def order(backward: bool = False) -> list[Column]:
    """Sort keys of merged rows; equal times go by tag line, so the order is total."""
    by = (KEY, "tag_line", "chunk_id", "idx")
    # Backward only times turn round between partitions; ties still go by tag line, and records of one partition from its end.
    return [F.col(KEY).desc(), F.col("tag_line"), F.col("chunk_id").desc(), F.col("idx").desc()] if backward else [F.col(c) for c in by]


def _reversed_order() -> list[Column]:
    return [F.col(c).desc() for c in (KEY, "tag_line", "chunk_id", "idx")]


def at_or_after(position: str | dict[str, tuple[int, int]] | None) -> Column | None:
    """Whether a record is at or after a position: head, tail, or (chunk, index) by partition; None: all are.

    Partitions that a position doesn't list start at their head; listed ones that don't exist count
    for nothing.
    """
    if position is None or position == "head":
        return None
    if position == "tail":
        return F.lit(False)
    out = F.lit(True)
    for src, (chunk_id, idx) in position.items():
        passed = (F.col("chunk_id") > chunk_id) | ((F.col("chunk_id") == chunk_id) & (F.col("idx") >= idx))
        out = out & ((F.col("src") != src) | passed)
    return out


def window(
    rows: DataFrame, position: str | dict[str, tuple[int, int]] | None = None, offset: int | None = None, limit: int | None = None, backward: bool = False, after: Column | None = None
) -> DataFrame:
    """Merged rows from a position on, `offset` further (or back), at most `limit`, in order.

    A negative offset steps back over the merged sequence, at most to its beginning, so with the
    position tail the last rows come. With a limit Spark keeps only the top rows of each task.
    `after` may say in place of a position which rows are at or after it.
    """
    if limit is not None and limit < 0:
        raise ValueError(f"a limit of {limit}")
    if isinstance(position, dict) and len(position) > MOST_LITERALS:
        starts = rows.sparkSession.createDataFrame([(s, c, i) for s, (c, i) in position.items()], "src string, __chunk bigint, __idx bigint")
        rows = rows.join(starts, "src", "left")
        after = F.coalesce((F.col("chunk_id") > F.col("__chunk")) | ((F.col("chunk_id") == F.col("__chunk")) & (F.col("idx") >= F.col("__idx"))), F.lit(True))
        return window(rows.withColumn("__after", after), None, offset, limit, backward, F.col("__after")).drop("__chunk", "__idx", "__after")
    after = at_or_after(position) if after is None else after
    offset = offset or 0
    chosen = rows if after is None else rows.filter(after)
    if offset < 0 and after is not None:
        before = rows.filter(~after).orderBy(*(order() if backward else _reversed_order())).limit(-offset)
        chosen = before.unionByName(chosen)
    out = chosen.orderBy(*order(backward))
    if offset > 0:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out
