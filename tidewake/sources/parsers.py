"""Log lines as records: pure, text with dates, JSON lines of container logs, and logfmt within them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..language.datetime import DateFinder
from ..model.kvtext import parse_pairs

#: A parsed line: file, its place there, time (null where the line has none), message, fields, and the raw line where it could not be read.
PARSED = "file string, line_no long, ts_ns long, msg string, fields_kv array<struct<k:string,v:string>>, corrupt string"
_JSON = "log string, stream string, time string"
_RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 time with up to nine digits of fraction; null for anything else."""
    whole = F.concat(F.regexp_extract(text, _RFC3339, 1), F.regexp_extract(text, _RFC3339, 3))
    seconds = F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    fraction = F.rpad(F.regexp_extract(text, _RFC3339, 2), 9, "0")
    return F.when(text.rlike(_RFC3339), seconds * 1_000_000_000 + F.when(fraction == "", F.lit("0")).otherwise(fraction).cast("long"))


def _none() -> Column:
    return F.array().cast("array<struct<k:string,v:string>>")


def _pair(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("k"), value.alias("v"))


def parse_pure(lines: DataFrame, now_ns: int | None = None) -> DataFrame:
    """Each line a record of now."""
    now = F.lit(now_ns) if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    return lines.select("file", "line_no", now.alias("ts_ns"), F.col("line").alias("msg"), _none().alias("fields_kv"), F.lit(None).cast("string").alias("corrupt"))


def _json_records(lines: DataFrame) -> DataFrame:
    parsed = F.from_json(F.col("line"), _JSON, {"mode": "PERMISSIVE", "maxStringLen": str(2**31 - 1)})
    rows = lines.withColumn("r", parsed).withColumn("t", rfc3339_ns(F.col("r.time")))
    # A line that is no JSON object, or whose time is none, is set aside and stops nothing.
    bad = F.col("r").isNull() | (F.col("r.time").isNotNull() & F.col("t").isNull()) | F.coalesce(~F.trim("line").startswith("{"), F.lit(True))
    return rows.withColumn("bad", bad)


def parse_k8json(lines: DataFrame) -> DataFrame:
    """JSON lines {log, stream, time}: message, field stream, time."""
    rows = _json_records(lines)
    stream = F.array(_pair("stream", F.coalesce("r.stream", F.lit(""))))
    return rows.select(
        "file", "line_no", F.when(~F.col("bad"), F.col("t")).alias("ts_ns"), F.when(~F.col("bad"), F.coalesce("r.log", F.lit(""))).alias("msg"),
        F.when(~F.col("bad"), stream).otherwise(_none()).alias("fields_kv"), F.when(F.col("bad"), F.col("line")).alias("corrupt"),
    )


_LOGFMT_PAIR = r'([^\s="\x00-\x20]+)(?:=("(?:[^"\\]|\\.)*"|[^\s"]*))?'


def logfmt_pairs(text: Column) -> Column:
    """Keys and values of logfmt text, in order; a key without `=` has the value ""."""

    def pair(p: Column) -> Column:
        at = F.locate("=", p)
        raw = F.when(at > 0, F.substr(p, at + 1)).otherwise("")
        inner = F.replace(F.replace(F.substr(raw, F.lit(2), F.char_length(raw) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        return F.struct(F.when(at > 0, F.substr(p, F.lit(1), at - 1)).otherwise(p).alias("k"), F.when(raw.startswith('"'), inner).otherwise(raw).alias("v"))

    return F.transform(F.regexp_extract_all(text, F.lit(_LOGFMT_PAIR), F.lit(0)), pair)


def parse_logfmt(lines: DataFrame, keys: list[str]) -> DataFrame:
    """As k8json, and keys of logfmt in the message become fields, each with its last value; a valid time key is the record's time.

    A message whose quotes don't close is not logfmt: it gives no fields of its own.
    """
    rows = _json_records(lines).withColumn("msg", F.coalesce("r.log", F.lit("")))
    quotes = F.char_length(F.regexp_replace(F.regexp_replace("msg", r"\\.", ""), '[^"]', ""))
    wanted = F.filter(logfmt_pairs(F.rtrim("msg")), lambda p: p["k"].isin(*keys)) if keys else _none()
    # Each step is a projection of its own, so the patterns run once for all keys.
    rows = rows.withColumn("pairs", F.when(quotes % 2 == 0, wanted).otherwise(_none()))
    rows = rows.withColumn("own", F.array_compact(F.array(*(_last(F.col("pairs"), k) for k in keys))) if keys else _none())
    time = rfc3339_ns(F.get(F.filter("own", lambda p: p["k"] == "time"), F.lit(0))["v"])
    fields = F.concat(F.array(_pair("stream", F.coalesce("r.stream", F.lit("")))), F.col("own"))
    return rows.select(
        "file", "line_no", F.when(~F.col("bad"), F.coalesce(time, F.col("t"))).alias("ts_ns"), F.when(~F.col("bad"), F.col("msg")).alias("msg"),
        F.when(~F.col("bad"), fields).otherwise(_none()).alias("fields_kv"), F.when(F.col("bad"), F.col("line")).alias("corrupt"),
    )


def _last(pairs: Column, key: str) -> Column:
    """The last pair of a key, null without one."""
    mine = F.filter(pairs, lambda p: p["k"] == key)
    return F.try_element_at(mine, F.lit(-1))


@dataclass
class DatedLines:
    """Finds the date of each line of one file, in order.

    The pattern that matched last is tried first. Lines without a date carry the last one seen. Where
    `skips` is set, after ten failures in a row lines are skipped unsearched, ten at first and twice as
    many each time, up to 160; the parsers of this module search every line.
    """

    finder: DateFinder
    skips: bool = True
    pattern: object = None
    last: int | None = None
    failed: int = 0
    skipping: bool = False
    skip: int = 10
    hits: dict[str, int] = field(default_factory=dict)

    def date(self, line: str) -> int | None:
        if self.pattern is not None:
            ns = self.pattern.find(line, self.finder.now)
            if ns is not None:
                return self._hit(ns, self.pattern)
        if self.skipping:
            self.failed += 1
            if self.failed >= self.skip:
                self.skipping, self.failed = False, 0
                if self.skip < 100:
                    self.skip *= 2
            self._count("")
            return self.last
        found = self.finder.find(line)
        if found:
            self.skip, self.failed = 10, 0
            return self._hit(*found)
        self.pattern = None
        self.failed += 1
        if self.skips and self.failed >= 10:
            self.skipping, self.failed = True, 0
        self._count("")
        return self.last

    def _hit(self, ns: int, pattern) -> int:
        self.pattern, self.last = pattern, ns
        self._count(pattern.text)
        return ns

    def _count(self, name: str) -> None:
        self.hits[name] = self.hits.get(name, 0) + 1


def parse_text(lines: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Lines of text with dates somewhere in them; each file is read in order by one task, streaming.

    A file's lines are sorted, not gathered: memory doesn't follow the file.
    """

    def dates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, state, file = DateFinder(patterns), None, None
        for batch in batches:
            found = []
            for name, line in zip(batch["file"], batch["line"], strict=True):
                if state is None or name != file:
                    state, file = DatedLines(finder, skips=False), name
                found.append(state.date(line))
            yield pd.DataFrame({"file": batch["file"], "line_no": batch["line_no"], "ts_ns": pd.array(found, dtype="Int64"), "msg": batch["line"]})

    ordered = lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no")
    rows = ordered.mapInPandas(dates, "file string, line_no long, ts_ns long, msg string")
    return rows.select("*", _none().alias("fields_kv"), F.lit(None).cast("string").alias("corrupt"))


def date_statistics(lines: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Hits of each date pattern over all lines; the pattern "" counts lines without a date."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, state, file = DateFinder(patterns), None, None
        total: dict[str, int] = {}

        def add() -> None:
            for k, v in state.hits.items() if state else ():
                total[k] = total.get(k, 0) + v

        for batch in batches:
            for name, line in zip(batch["file"], batch["line"], strict=True):
                if state is None or name != file:
                    add()
                    state, file = DatedLines(finder, skips=False), name
                state.date(line)
        add()
        yield pd.DataFrame({"pattern": list(total), "hits": list(total.values())}, columns=["pattern", "hits"])

    ordered = lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no")
    return ordered.mapInPandas(counts, "pattern string, hits long").groupBy("pattern").agg(F.sum("hits").alias("hits"))


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """Lines of each file: all, those read, and those that could not be; and of those read how many have no time."""
    failed = F.col("corrupt").isNotNull()
    return parsed.groupBy("file").agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"), F.count_if(~failed & F.col("ts_ns").isNull()).alias("undated")
    )


#: Parsers by the name of their format.
FORMATS: dict[str, Callable[..., DataFrame]] = {"pure": parse_pure, "text": parse_text, "k8json": parse_k8json, "logfmt": parse_logfmt}


def parser(fmt: str, date_patterns: list[str] | None = None, keys: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The parser of a configuration; date patterns are for text alone, keys for logfmt."""
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt}: there are {', '.join(FORMATS)}")
    if date_patterns and fmt != "text":
        raise ValueError(f"date patterns don't apply to {fmt}")
    if fmt == "text":
        return lambda lines: parse_text(lines, date_patterns)
    if fmt == "logfmt":
        return lambda lines: parse_logfmt(lines, keys or [])
    return FORMATS[fmt]


def field_texts(text: str) -> list[tuple[str, str]]:
    """Fields of a request's text; text that can't be read gives none."""
    try:
        return parse_pairs(text)
    except ValueError:
        return []
