"""The engine: statements over stored logs or over any table seen as one."""

from __future__ import annotations

import base64
import json
from datetime import UTC, datetime, tzinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StatementError
from ..functions import formatter
from ..language import ast
from ..language.compile import range_bounds, range_condition, source_condition, where_condition
from ..language.datetime import parse_literal
from ..language.parser import parse
from ..model.kvtext import fields_line_column, tag_line
from ..operators import merge, stats, truncate
from .store import Store


def zone_name(zone: tzinfo) -> str:
    return getattr(zone, "key", None) or "UTC"


def encode_token(positions: dict[str, tuple[int, int]]) -> str:
    """A resume token: the next (chunk, index) of each partition."""
    return base64.urlsafe_b64encode(json.dumps(positions, separators=(",", ":"), sort_keys=True).encode()).decode()


def decode_token(token: str) -> str | dict[str, tuple[int, int]]:
    """Position of a POSITION clause: head, tail, or a token."""
    if token.lower() in ("head", "tail", ""):
        return token.lower() or "head"
    try:
        found = json.loads(base64.urlsafe_b64decode(token.encode()))
        return {str(k): (int(v[0]), int(v[1])) for k, v in found.items()}
    except Exception as e:
        raise StatementError(f"not a position: {token}") from e


class Engine:
    """Runs statements. Names of views stand beside the store and are chosen by `view`."""

    def __init__(self, spark: SparkSession, root: str | None = None, zone: tzinfo = UTC, max_sources: int | None = None, oldest_first: bool = False):
        self.spark, self.zone, self.max_sources, self.oldest_first = spark, zone, max_sources, oldest_first
        self.store = Store(spark, root) if root else None
        self.views: dict[str, tuple[DataFrame, bool]] = {}
        self._pipes = None

    def register_view(self, name: str, df: DataFrame, monotonic: bool = False) -> None:
        """Let df, with the columns of the log, be queried as `name`; monotonic: times never go back in its partitions."""
        self.views[name] = (df, monotonic)

    @property
    def pipes(self):
        from ..streaming.pipes import Pipes

        if self._pipes is None:
            self._pipes = Pipes(self)
        return self._pipes

    def _rows(self, source: ast.Source | None, view: str | None, src: str | None = None, bounds: tuple[int | None, int | None] = (None, None)) -> tuple[DataFrame, bool]:
        if view is not None:
            df, monotonic = self.views[view]
            condition = source_condition(source)
            if src is not None:
                df = df.filter(F.col("src") == src)
            elif source is not None:
                if self.max_sources is not None and df.filter(condition).select("src").distinct().limit(self.max_sources).count() >= self.max_sources:
                    raise StatementError(f"{self.max_sources} partitions or more match")
                df = df.filter(condition)
            return df, monotonic
        if self.store is None:
            raise StatementError("there is no store: give a root or a view")
        if src is None and self.max_sources is not None:
            found = self.store.chosen(source).select("src").distinct().limit(self.max_sources).count()
            if found >= self.max_sources:
                raise StatementError(f"{self.max_sources} partitions or more match")
        chunks = self.store.chosen(source, bounds, src)
        return self.store.records(chunks), self.store.is_monotonic(chunks)

    def rows(self, statement: ast.Select | str, view: str | None = None, now: datetime | None = None, position=None, offset: int | None = None, limit: int | None = None, backward: bool = False, src: str | None = None) -> DataFrame:
        """Records of a SELECT in merge order, with all columns of the log.

        FROM prunes partitions and RANGE chunks; both and WHERE reach the scan as far as Parquet
        takes them; the sort comes after. Arguments go before the clauses of the text: `src`, the id
        of a partition, before FROM.
        """
        select = parse(statement) if isinstance(statement, str) else statement
        if not isinstance(select, ast.Select):
            raise StatementError(f"not a SELECT: {select}")
        now = now or datetime.now(UTC)  # once for the whole statement
        bounds = range_bounds(select.range, now, self.zone)
        df, monotonic = self._rows(select.source, view, src, bounds or (None, None))
        in_range = range_condition(bounds)
        if in_range is not None:
            df = df.filter(in_range)
        # The merge sees what is in range; WHERE decides after it, by which only monotone partitions may be filtered first.
        met = where_condition(select.where, now, self.zone)
        keyed = merge.with_merge_key(df.filter(met), True) if monotonic else merge.with_merge_key(df, False, backward).filter(met)
        where_to = position if position is not None else select.position
        where_to = decode_token(where_to) if isinstance(where_to, str) else where_to
        steps = offset if offset is not None else select.offset
        most = limit if limit is not None else select.limit
        if most is not None and most < 0:
            if limit is not None:
                raise StatementError(f"a limit of {most}")
            most = None  # in a text a negative limit is none
        return merge.window(keyed, where_to, steps, most, backward).drop(merge.KEY)

    def sql(self, statement: str, view: str | None = None, now: datetime | None = None, position=None, offset: int | None = None, limit: int | None = None, backward: bool = False, src: str | None = None) -> DataFrame:
        """A SELECT: the column `line` where it has a format, else ts_ns, msg, tag_line and fields_line. Other statements go to execute."""
        select = parse(statement)
        if not isinstance(select, ast.Select):
            return self.execute(statement, view=view, now=now)
        return self.project(self.rows(select, view, now, position, offset, limit, backward, src), select.format)

    def project(self, rows: DataFrame, template: str | None) -> DataFrame:
        if template is not None:
            return rows.select(formatter.render(template, zone_name(self.zone)).alias("line"))
        return rows.select("ts_ns", "msg", "tag_line", fields_line_column(F.col("fields_kv")).alias("fields_line"))

    def page(self, statement: str, token: str | None = None, limit: int = 100, view: str | None = None, src: str | None = None) -> tuple[list, str]:
        """The next rows of a SELECT and the token to go on with; new partitions start at their head.

        Rows of one page, `limit` of them, come to the driver; the token has an entry for each
        partition that was read from.
        """
        select = parse(statement)
        before = decode_token(token) if token else (decode_token(select.position) if select.position else "head")
        steps = 0 if token else select.offset
        got = self.rows(select, view, None, before, steps, limit, src=src).collect()
        nexts = dict(before) if isinstance(before, dict) else {}
        if before == "tail" and not got:
            df, _ = self._rows(select.source, view, src)
            ends = df.groupBy("src").agg(F.max(F.struct("chunk_id", "idx")).alias("e")).collect()
            nexts = {r["src"]: (r["e"]["chunk_id"], r["e"]["idx"] + 1) for r in ends}
        for r in got:
            nexts[r["src"]] = max(nexts.get(r["src"], (r["chunk_id"], r["idx"] + 1)), (r["chunk_id"], r["idx"] + 1))
        return got, encode_token(nexts)

    def chunk_table(self, view: str | None = None) -> DataFrame:
        if view is not None:
            return stats.chunk_stats(self.views[view][0])
        return self.store.chunks()

    def execute(self, statement: str, view: str | None = None, now: datetime | None = None) -> DataFrame:
        """Any statement, as a DataFrame."""
        what = parse(statement)
        match what:
            case ast.Select():
                return self.sql(statement, view, now)
            case ast.Show(what="PARTITIONS"):
                return stats.show_partitions(self._chosen(what.source, view), what.offset, what.limit)
            case ast.Show():
                return self.pipes.show(what.offset, what.limit)
            case ast.Describe(pipe=str() as name):
                return self.pipes.describe(name)
            case ast.Describe():
                return stats.describe_partition(self.chunk_table(view), tag_line(dict(what.tags.tags)))
            case ast.Truncate():
                return self.truncate(what, view, now)
            case ast.CreatePipe():
                return self.pipes.create(what.name, what.source, what.where)
            case ast.DeletePipe():
                return self.pipes.delete(what.name)
        raise StatementError(f"can't run {what}")

    def _chosen(self, source: ast.Source | None, view: str | None) -> DataFrame:
        chunks = self.chunk_table(view)
        if source is None:
            return chunks
        names = self.views[view][0].select("src", "tags").dropDuplicates(["src"]) if view is not None else self.store.partitions()
        return chunks.join(names.filter(source_condition(source)).select("src"), "src", "left_semi")

    def truncate(self, what: ast.Truncate, view: str | None = None, now: datetime | None = None) -> DataFrame:
        """What a TRUNCATE changes; over the store, unless it is a dry run, it is done as well."""
        before = parse_literal(what.before, now, self.zone) if what.before is not None else None
        planned = truncate.chunk_plan(self._chosen(what.source, view), what.min_size or 0, what.max_size, before)
        changed = truncate.partition_plan(planned, what.max_db_size, self.oldest_first)
        if what.dry_run or view is not None:
            return changed
        rows = changed.collect()  # a row for each partition that changes
        gone = [r["src"] for r in rows if r["deleted"]]
        doomed = planned.filter(F.col("dropped") | F.col("src").isin(*gone)) if gone else planned.filter("dropped")
        self.store.drop_chunks(doomed)
        return self.spark.createDataFrame(rows, changed.schema)

    def write(self, tags: str, fields: str, records: DataFrame) -> DataFrame:
        """Append records (ts_ns, msg, perhaps fields_kv) and pass them to the pipes that listen."""
        return self.store.write(tags, fields, records)

    def tail(self, statement: str, handler, checkpoint: str, **trigger):
        from ..streaming.tail import tail

        return tail(self, statement, handler, checkpoint, **trigger)

    def forward(self, pipe: str, sink, checkpoint: str, **trigger):
        from ..streaming.forward import forward

        return forward(self, pipe, sink, checkpoint, **trigger)

    def collect(self, collector, checkpoint: str, idle: float | None = None, **trigger):
        from ..streaming.collect import collect

        return collect(self, collector, checkpoint, idle, **trigger)
