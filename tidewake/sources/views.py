"""Tables seen as log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.kvtext import tag_line_of
from ..model.schema import LOG_COLUMNS

CHUNK_RECORDS = 250_000


def micros_ns(ts: Column) -> Column:
    """Nanoseconds of a timestamp column, with or without zone (then UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def log_view(df: DataFrame, tags: dict[str, Column], ts_ns: Column, msg: Column, fields: list[tuple[str, Column]], idx: Column, chunk_id: Column | None = None) -> DataFrame:
    """df as log records; nulls in tags and fields read as "", so records are never lost to them.

    The tag line also serves as the partition's id. Without a chunk_id, chunks are stretches of idx.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), text(v).alias("v")) for k, v in fields)) if fields else F.array()
    tag_map = F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), text(v))))
    chunk = chunk_id if chunk_id is not None else F.floor(idx / CHUNK_RECORDS)
    rows = df.select(
        tag_map.alias("tags"), tag_line_of({k: text(v) for k, v in tags.items()}).alias("tag_line"), chunk.cast("bigint").alias("chunk_id"), idx.cast("bigint").alias("idx"), ts_ns.cast("bigint").alias("ts_ns"), text(msg).alias("msg"),
        pairs.cast("array<struct<k:string,v:string>>").alias("fields_kv"),
    )
    return rows.withColumn("src", F.col("tag_line")).select(*LOG_COLUMNS)


def events_view(events: DataFrame, by_user: bool = False, disorder: bool = False) -> DataFrame:
    """The table `events` as log records: tags app (and user), message `type props`, fields user and k.

    disorder: records are appended in an order of their own, so times go back within partitions.
    """
    tags = {"app": F.col("event_type")} | ({"user": F.col("user_id")} if by_user else {})
    idx = F.pmod(F.col("event_id") * 7919, F.lit(10007)) * 1_000_000 + F.col("event_id") if disorder else F.col("event_id")
    fields = [("user", F.col("user_id")), ("k", F.get_json_object("props", "$.k"))]
    chunk = F.floor(idx / 1_000_000_000) if disorder else None
    return log_view(events, tags, micros_ns(F.col("ts")), F.concat_ws(" ", "event_type", "props"), fields, idx, chunk)


def documents_view(documents: DataFrame) -> DataFrame:
    """Documents as messages of many lines; their time is their number."""
    return log_view(documents, {"lang": F.col("lang"), "source": F.col("source")}, F.col("doc_id"), F.col("text"), [("n_chars", F.col("n_chars"))], F.col("doc_id"))


def conversations_view(conversations: DataFrame) -> DataFrame:
    """Turns as records, a partition for each conversation."""
    return log_view(conversations, {"conv": F.col("conv_id")}, F.col("turn"), F.col("text"), [("role", F.col("role"))], F.col("turn"))


def pages_view(pages: DataFrame) -> DataFrame:
    """Pages as records whose message is the address."""
    return log_view(pages, {"kind": F.lit("page")}, F.col("page_id"), F.col("url"), [("page", F.col("page_id"))], F.col("page_id"))
