"""Log files as a stream into the store."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import LogFiles


def collect(engine, collector, checkpoint: str, idle: float | None = None, **trigger):
    """Read what is new in the files of a collector and append its records; lines that can't be read are left out.

    Of all files of all include globs the whole lines behind those taken before are taken; rotated
    and rewritten files from their start. A last line without a line feed waits for it, or until its
    file has not changed for `idle` seconds. After a failure a batch comes again, takes the same bytes
    and replaces its own chunk. Without a trigger what there is is taken once. Lines without a date
    get the time of their batch; dates are not carried on from one batch to the next. Offsets and
    fingerprints of the files are in the checkpoint.
    """
    spark = engine.spark
    spark.dataSource.register(LogFiles)
    options = collector.options() | ({} if idle is None else {"idle": str(idle)})
    lines = spark.readStream.format(LogFiles.name()).options(**options).load()
    note = f"collectors/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def time_of(number: int) -> int:
        """When the batch was first tried: the id of its chunk, also where it comes again."""
        noted = json.loads(engine.store.read_text(note) or "{}")
        if noted.get("number") != number:
            noted = {"number": number, "time": time.time_ns()}
            engine.store.write_text(note, json.dumps(noted))
        return noted["time"]

    def take(batch: DataFrame, number: int) -> None:
        now = time_of(number)
        # Sorting reads its input twice, so what was parsed is held on disk.
        rows = collector.read(batch).filter("corrupt IS NULL").select("file", "line_no", "tags", F.coalesce("ts_ns", F.lit(now)).alias("ts_ns"), "msg", "fields_kv").persist(StorageLevel.DISK_ONLY)
        try:
            engine.store.append(rows.orderBy("file", "line_no").select("tags", "ts_ns", "msg", "fields_kv"), chunk_id=now)
        finally:
            rows.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(take).start()
