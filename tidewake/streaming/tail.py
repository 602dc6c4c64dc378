"""Following a SELECT: new records go to a handler as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..language.compile import range_bounds, range_condition, source_condition, where_condition
from ..language.parser import parse
from ..operators import merge


def tail(engine, statement: str, handler, checkpoint: str, **trigger):
    """Run handler(rows) on each batch of new records that a SELECT takes, in merge order.

    Partitions that come later are followed too: FROM is resolved for each batch. The checkpoint
    resumes; after a failure a batch may come again. Without a trigger what there is is taken once.
    Sorting is within a batch, since what was handed over can't be taken back.
    """
    from ..plans.store import CHUNKS

    select = parse(statement)
    store = engine.store
    chunks = store.spark.readStream.schema(CHUNKS).parquet(store.path("chunks"))

    def handle(batch: DataFrame, number: int) -> None:
        listed = batch.select("src", "chunk_id").distinct()
        rows = store.records(store.chunks().join(listed, ["src", "chunk_id"], "left_semi")).filter(source_condition(select.source))
        in_range = range_condition(range_bounds(select.range, zone=engine.zone))
        if in_range is not None:
            rows = rows.filter(in_range)
        keyed = merge.with_merge_key(rows).filter(where_condition(select.where, zone=engine.zone))
        ordered = keyed.orderBy(*merge.order()).drop(merge.KEY)
        handler(engine.project(ordered, select.format))

    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(handle).start()


def sliding_stream(records: DataFrame, keys: list[str], value, span: str, bucket: str, late: str = "0 seconds") -> DataFrame:
    """Sliding totals of a stream with a column `ts`: sums over `span`, moving by `bucket`, final after `late`."""
    return records.withWatermark("ts", late).groupBy(*keys, F.window("ts", span, bucket)).agg(F.sum(value).alias("total"))
