"""Forwarding a pipe's records to a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..language.compile import source_condition
from ..operators import merge
from .pipes import destination


def forward(engine, pipe: str, sink, checkpoint: str, **trigger):
    """Pass what a pipe copies to sink(rows), at least once: progress is kept after the sink has taken a batch."""
    from ..plans.store import CHUNKS

    store = engine.store
    where = source_condition(destination(pipe))
    chunks = store.spark.readStream.schema(CHUNKS).parquet(store.path("chunks"))

    def send(batch: DataFrame, number: int) -> None:
        listed = batch.select("src", "chunk_id").distinct()
        rows = store.records(store.chunks().join(listed, ["src", "chunk_id"], "left_semi")).filter(where)
        sink(merge.with_merge_key(rows).orderBy(*merge.order()).drop(merge.KEY))

    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(send).start()


class Forwarder:
    """Keeps one forwarding query for each configured sink: a new configuration starts and stops them."""

    def __init__(self, engine, checkpoints: str, **trigger):
        self.engine, self.checkpoints, self.trigger = engine, checkpoints, trigger
        self.running: dict[str, tuple[tuple, object]] = {}

    def sync(self, config: dict[str, tuple[str, object]]) -> None:
        """config: by worker name, the pipe and its sink."""
        for name in [n for n in self.running if n not in config or self.running[n][0] != config[n]]:
            self.running.pop(name)[1].stop()
        for name, (pipe, sink) in config.items():
            if name not in self.running:
                query = forward(self.engine, pipe, sink, f"{self.checkpoints}/{name}", **self.trigger)
                self.running[name] = ((pipe, sink), query)

    def stop(self) -> None:
        self.sync({})
