"""The stored log: partitions by tag set, chunks by write, and tables about both.

Records are Parquet files under events/src=../chunk_id=..; a write is one chunk for each partition it
touches. Partitions and chunks are noted in tables that are only appended to; what was dropped is
noted as well, and its files are deleted. Writers take a lock, in the process and as a file of the
store, so there is one at a time whichever application it belongs to.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..language import ast
from ..language.compile import source_condition
from ..model.kvtext import pairs_literal, parse_fields, parse_tags, tag_line_column
from ..model.schema import LOG_SCHEMA
from ..operators import stats
from ..sources.parsers import field_texts

PARTITIONS = "src string, tags map<string,string>, tag_line string, created_ns bigint, by_pipe boolean"
CHUNKS = "src string, tag_line string, chunk_id bigint, records bigint, bytes bigint, min_ts_ns bigint, max_ts_ns bigint, monotonic boolean"
DROPPED = "src string, chunk_id bigint"
STORED = "src string, chunk_id bigint, idx bigint, ts_ns bigint, msg string, fields_kv array<struct<k:string,v:string>>"


def src_of(tag_line):
    """Id of a partition: a hash of its tag line, so writers need not agree on one."""
    return F.substr(F.sha2(tag_line, 256), F.lit(1), F.lit(16))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])))
def _fields_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [{"k": k, "v": v} for k, v in field_texts(text)] if text else [])


#: Chunks up to this many are spelled out in a condition, which prunes their folders; beyond it they are joined.
MOST_CHUNKS = 1000


class Lock:
    """The writers' lock: reentrant within a thread, and a file that only one application can create.

    Its holder touches the file; one that was not touched for `stale` seconds was left by an
    application that is gone, and is taken over.
    """

    def __init__(self, store: Store, stale: float = 60, patience: float = 3600):
        self.store, self.stale, self.patience = store, stale, patience
        self.own, self.depth, self.token = threading.RLock(), 0, uuid.uuid4().hex

    def __enter__(self) -> None:
        self.own.acquire()
        self.depth += 1
        if self.depth > 1:
            return
        try:
            self._create()
        except BaseException:
            self.depth -= 1
            self.own.release()
            raise
        self.done = threading.Event()
        self.keeper = threading.Thread(target=self._keep, args=(self.done,), daemon=True)
        self.keeper.start()

    def _create(self) -> None:
        from py4j.protocol import Py4JJavaError

        fs, path = self.store._fs(self.store.path("lock"))
        until = time.monotonic() + self.patience
        while True:
            try:
                fs.create(path, False).close()
                return
            except Py4JJavaError:
                if not fs.exists(path):
                    if time.monotonic() > until:
                        raise
                elif time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > self.stale:
                    fs.delete(path, False)
                elif time.monotonic() > until:
                    raise TimeoutError(f"another application holds {path}") from None
            time.sleep(0.2)

    def _keep(self, done: threading.Event) -> None:
        fs, path = self.store._fs(self.store.path("lock"))
        while not done.wait(self.stale / 4):
            fs.setTimes(path, int(time.time() * 1000), -1)

    def __exit__(self, *_) -> None:
        self.depth -= 1
        if not self.depth:
            self.done.set()
            self.keeper.join()
            self.store.delete("lock")
        self.own.release()


@dataclass
class Store:
    spark: SparkSession
    root: str
    lock: Lock = field(init=False)

    def __post_init__(self):
        self.lock = Lock(self)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def delete(self, name: str) -> None:
        fs, p = self._fs(self.path(name))
        fs.delete(p, True)

    def _move(self, name: str, to: str) -> None:
        """A folder in the place of another."""
        (fs, a), (_, b) = self._fs(self.path(name)), self._fs(self.path(to))
        fs.delete(b, True)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"can't move {a} to {b}")

    def read_text(self, name: str) -> str | None:
        """A small text file, None where there is none."""
        if not self.exists(name):
            return None
        fs, path = self._fs(self.path(name))
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        fs, path = self._fs(self.path(name))
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def table(self, name: str, schema: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def chunks(self) -> DataFrame:
        """Chunks that are there."""
        return self.table("chunks", CHUNKS).join(self.table("dropped", DROPPED), ["src", "chunk_id"], "left_anti")

    def partitions(self) -> DataFrame:
        """Partitions that hold a chunk."""
        rows = self.table("partitions", PARTITIONS).groupBy("src", "tag_line").agg(F.first("tags").alias("tags"), F.min("created_ns").alias("created_ns"), F.bool_or("by_pipe").alias("by_pipe"))
        return rows.join(self.chunks().select("src").distinct(), "src", "left_semi")

    def chosen(self, source: ast.Source | None = None, bounds: tuple[int | None, int | None] = (None, None), src: str | None = None) -> DataFrame:
        """Chunks of the partitions of a source, or of one by its id, that may hold times within inclusive bounds."""
        out = self.chunks()
        if src is not None:
            out = out.filter(F.col("src") == src)
        elif source is not None:
            out = out.join(self.partitions().filter(source_condition(source)).select("src"), "src", "left_semi")
        low, high = bounds
        if low is not None:
            out = out.filter(F.col("max_ts_ns") >= low)
        return out.filter(F.col("min_ts_ns") <= high) if high is not None else out

    def records(self, chunks: DataFrame | None = None) -> DataFrame:
        """Records of chunks (None: all there are) in the columns of the log; only their folders are listed."""
        chunks = (self.chunks() if chunks is None else chunks).select("src", "chunk_id")
        listed = chunks.limit(MOST_CHUNKS + 1).collect() if self.exists("events") else []
        if not listed:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows = self.spark.read.schema(STORED).parquet(self.path("events"))
        if len(listed) <= MOST_CHUNKS:
            by_id: dict[int, set[str]] = {}
            for r in listed:
                by_id.setdefault(r["chunk_id"], set()).add(r["src"])
            rows = rows.filter(reduce(or_, ((F.col("chunk_id") == c) & F.col("src").isin(*sorted(srcs)) for c, srcs in sorted(by_id.items()))))
        else:
            rows = rows.join(chunks, ["src", "chunk_id"], "left_semi")
        names = self.table("partitions", PARTITIONS).groupBy("src").agg(F.first("tag_line").alias("tag_line"), F.first("tags").alias("tags"))
        return rows.join(names, "src").select(*[c.split()[0] for c in LOG_SCHEMA.replace("<k:string,v:string>", "").replace("<string,string>", "").split(", ")])

    def is_monotonic(self, chunks: DataFrame | None = None) -> bool:
        """Whether times never go back in these chunks, within them and from one to the next of their partition."""
        from pyspark.sql import Window

        chunks = self.chunks() if chunks is None else chunks
        earlier = F.max("max_ts_ns").over(Window.partitionBy("src").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1))
        row = chunks.withColumn("fine", F.col("monotonic") & F.coalesce(F.col("min_ts_ns") >= earlier, F.lit(True))).agg(F.bool_and("fine").alias("fine")).first()
        return row["fine"] is not False

    def append(self, rows: DataFrame, by_pipe: bool = False, chunk_id: int | None = None) -> DataFrame:
        """Append records (tags, ts_ns, msg, fields_kv), in the order of the DataFrame, to their partitions.

        Returns the new chunks' rows. chunk_id may be given so that a repeated write replaces itself.
        """
        with self.lock:
            if chunk_id is None:
                chunk_id = time.time_ns()
            lined = rows.withColumn("tag_line", tag_line_column(F.col("tags"))).withColumn("src", src_of(F.col("tag_line")))
            staged = lined.select(
                "src", "tag_line", "tags", F.lit(chunk_id).cast("bigint").alias("chunk_id"), F.monotonically_increasing_id().alias("idx"), F.col("ts_ns").cast("bigint").alias("ts_ns"),
                F.coalesce("msg", F.lit("")).alias("msg"), F.coalesce("fields_kv", F.array().cast("array<struct<k:string,v:string>>")).alias("fields_kv"),
            )
            stage = self.path(f"staging/{chunk_id}")
            # The input is read and its records are written once: what is staged is what is counted, and its folders become those of the chunks.
            staged.write.mode("overwrite").partitionBy("src", "chunk_id").parquet(stage)
            fs, at = self._fs(stage)
            folders = [f"{x.getPath().getName()}/chunk_id={chunk_id}" for x in fs.listStatus(at) if x.getPath().getName().startswith("src=")]
            if not folders:
                self.delete(f"staging/{chunk_id}")
                return self.spark.createDataFrame([], CHUNKS)
            kept = self.spark.read.schema(LOG_SCHEMA).parquet(stage)
            # A row for each chunk: it is counted once, and held while the tables are written.
            counted = stats.chunk_rows(kept).persist()
            counted.count()
            # Tags as keys, since the first of a group of maps would take a sort of all records.
            entries = kept.select("src", "tag_line", F.array_sort(F.map_entries("tags")).alias("tags")).distinct()
            named = entries.select("src", F.map_from_entries("tags").alias("tags"), "tag_line", F.lit(time.time_ns()).cast("bigint").alias("created_ns"), F.lit(by_pipe).alias("by_pipe"))
            # A partition is noted once: the catalog grows with partitions, not with writes.
            new = named.join(self.table("partitions", PARTITIONS).select("src"), "src", "left_anti") if self.exists("partitions") else named
            new.write.mode("append").parquet(self.path("partitions"))
            for folder in folders:
                self._move(f"staging/{chunk_id}/{folder}", f"events/{folder}")
            known = self.table("chunks", CHUNKS).filter(F.col("chunk_id") == chunk_id).select("src", "chunk_id")
            new = counted.join(known, ["src", "chunk_id"], "left_anti") if self.exists("chunks") else counted
            new.select(*[c.split()[0] for c in CHUNKS.split(", ")]).write.mode("append").parquet(self.path("chunks"))
            counted.unpersist()
            self.delete(f"staging/{chunk_id}")
            return self.table("chunks", CHUNKS).filter(F.col("chunk_id") == chunk_id)

    def write(self, tags: str, fields: str, records: DataFrame) -> DataFrame:
        """Write records under tags; the fields given come before a record's own.

        records: ts_ns, msg, and perhaps fields_kv or `fields`, a text; a text that can't be read counts as empty.
        """
        if not parse_tags(tags):
            raise ValueError("a partition needs a tag")
        own = F.col("fields_kv") if "fields_kv" in records.columns else _fields_of("fields") if "fields" in records.columns else F.array()
        tag_map = F.create_map(*(F.lit(x) for kv in sorted(parse_tags(tags).items()) for x in kv))
        given = F.concat(pairs_literal(parse_fields(fields)), F.coalesce(own.cast("array<struct<k:string,v:string>>"), pairs_literal([])))
        return self.append(records.select(tag_map.alias("tags"), "ts_ns", "msg", given.alias("fields_kv")))

    def drop_chunks(self, chunks: DataFrame) -> None:
        """Note chunks as dropped, then delete their files: a reader never meets a chunk half gone."""
        with self.lock:
            doomed = [(r["src"], r["chunk_id"]) for r in chunks.select("src", "chunk_id").toLocalIterator()]
            if not doomed:
                return
            self.spark.createDataFrame(doomed, DROPPED).write.mode("append").parquet(self.path("dropped"))
            for src, chunk_id in doomed:
                self.delete(f"events/src={src}/chunk_id={chunk_id}")
            held = {r["src"] for r in self.chunks().filter(F.col("src").isin(*{src for src, _ in doomed})).select("src").distinct().collect()}
            for src in {src for src, _ in doomed} - held:
                self.delete(f"events/src={src}")  # nothing is left of the partition
