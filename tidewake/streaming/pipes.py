"""Pipes: named, continuous, filtered copies of partitions into a partition of their own."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatementError
from ..language import ast
from ..language.compile import source_condition, where_condition
from ..language.parser import parse_expression, parse_source
from ..model.kvtext import parse_tags, tag_line

#: The tag that names the pipe of a destination partition.
PIPE_TAG = "stream.pipe"
SCHEMA = "name string, tags_cond string, flt_cond string, dest_tag_line string, created_ns bigint"


@dataclass(frozen=True)
class Pipe:
    name: str
    tags_cond: str
    flt_cond: str
    created_ns: int

    @property
    def dest_tag_line(self) -> str:
        return tag_line({PIPE_TAG: self.name})


def piped(rows: DataFrame, pipe: Pipe) -> DataFrame:
    """What a pipe makes of records: those of its source that meet its condition, the source's tags added as fields.

    Tags come in the order of the tag line, after the record's own fields.
    """
    met = rows.filter(source_condition(parse_source(pipe.tags_cond))).filter(where_condition(parse_expression(pipe.flt_cond)))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    dest = F.create_map(F.lit(PIPE_TAG), F.lit(pipe.name))
    return met.select(dest.alias("tags"), "ts_ns", "msg", F.concat("fields_kv", tags).alias("fields_kv"), "src", "tag_line", "chunk_id", "idx")


class Pipes:
    """Registry of an engine's pipes; definitions are saved as they change, progress in checkpoints."""

    def __init__(self, engine):
        if engine.store is None:
            raise StatementError("pipes need a store")
        self.engine, self.store = engine, engine.store
        self.running: dict[str, object] = {}

    def _load(self) -> dict[str, Pipe]:
        text = self.store.read_text("pipes.json")
        return {p["name"]: Pipe(**p) for p in json.loads(text)} if text else {}

    def _save(self, pipes: dict[str, Pipe]) -> None:
        self.store.write_text("pipes.json", json.dumps([p.__dict__ for p in pipes.values()]))

    def _frame(self, pipes: list[Pipe]) -> DataFrame:
        return self.store.spark.createDataFrame([(p.name, p.tags_cond, p.flt_cond, p.dest_tag_line, p.created_ns) for p in pipes], SCHEMA)

    def create(self, name: str, source: ast.Source | None = None, where: ast.Any_ | None = None) -> DataFrame:
        """A new pipe; it copies what is written from now on."""
        with self.store.lock:
            pipes = self._load()
            if name in pipes:
                raise StatementError(f"there is a pipe {name} already")
            where_condition(where), source_condition(source)  # errors show before anything is saved
            pipes[name] = Pipe(name, str(source) if source else "", str(where) if where else "", time.time_ns())
            self._save(pipes)
            return self._frame([pipes[name]])

    def ensure(self, name: str, source: str = "", where: str = "", recreate: bool = False) -> DataFrame:
        """The pipe of that name, made if there is none; other conditions are an error, or with recreate replace it."""
        with self.store.lock:
            s, w = parse_source(source), parse_expression(where)
            have = self._load().get(name)
            if have and (have.tags_cond, have.flt_cond) == (str(s) if s else "", str(w) if w else ""):
                return self._frame([have])
            if have and not recreate:
                raise StatementError(f"pipe {name} has other conditions")
            if have:
                self.delete(name)
            return self.create(name, s, w)

    def get(self, name: str) -> Pipe:
        found = self._load().get(name)
        if not found:
            raise StatementError(f"no pipe {name}")
        return found

    def delete(self, name: str) -> DataFrame:
        """Stop and forget a pipe; what it has copied stays."""
        with self.store.lock:
            pipes = self._load()
            gone = self.get(name)
            query = self.running.pop(name, None)
            if query is not None:
                query.stop()
            del pipes[name]
            self._save(pipes)
            self.store.delete(f"checkpoints/{name}-{gone.created_ns}")
            return self._frame([gone])

    def show(self, offset: int | None = None, limit: int | None = None) -> DataFrame:
        out = self._frame(list(self._load().values())).select("name").orderBy("name")
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit is not None else out

    def describe(self, name: str) -> DataFrame:
        return self._frame([self.get(name)])

    def sources(self, pipe: Pipe, listed: DataFrame) -> DataFrame:
        """Those of the listed chunks' records that a pipe listens to: written after it was made, and not by a pipe."""
        own = self.store.partitions().filter(~F.col("by_pipe")).select("src")
        chunks = self.store.chunks().filter(F.col("chunk_id") >= pipe.created_ns)
        return self.store.records(chunks.join(own, "src", "left_semi").join(listed, ["src", "chunk_id"], "left_semi"))

    def start(self, name: str, **trigger):
        """Run a pipe as a streaming query over the list of chunks; by default it takes what there is and ends.

        Each batch of new chunks is copied as one chunk whose id follows from the batch, so a batch
        that is repeated after a failure replaces itself.
        """
        pipe = self.get(name)
        spark = self.store.spark
        if not self.store.exists("chunks"):
            return None
        from ..plans.store import CHUNKS

        chunks = spark.readStream.schema(CHUNKS).parquet(self.store.path("chunks")).filter(F.col("chunk_id") >= pipe.created_ns)

        def copy(batch: DataFrame, number: int) -> None:
            listed = batch.select("src", "chunk_id").distinct()
            ordered = piped(self.sources(pipe, listed), pipe).orderBy("tag_line", "chunk_id", "idx")
            self.store.append(ordered.select("tags", "ts_ns", "msg", "fields_kv"), by_pipe=True, chunk_id=pipe.created_ns + 1 + number)

        query = (
            chunks.writeStream.queryName(f"pipe-{name}")
            .option("checkpointLocation", self.store.path(f"checkpoints/{name}-{pipe.created_ns}"))
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(copy)
            .start()
        )
        self.running[name] = query
        return query


def destination(name: str) -> ast.Tags:
    """The partition that a pipe writes to, as a source."""
    return ast.Tags(tuple(sorted(parse_tags(tag_line({PIPE_TAG: name})).items())))
