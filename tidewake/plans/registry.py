"""Named queries over the driver's tables, each with its DuckDB counterpart.

Every query runs over its whole tables. Limits stand only where paging is what is shown; the order is
then total, so the rows are the same on both sides.
"""

from __future__ import annotations

import io
import socketserver
import tempfile
import threading
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..errors import StatementError
from ..functions.syslog import FACILITIES, SEVERITIES, syslog_line
from ..model.kvtext import fields_line_column
from ..language.compile import range_bounds
from ..language.parser import parse
from ..operators import merge, sliding, stats
from ..sinks.stdout import Stdout
from ..sinks.syslog import Syslog, Target
from ..sources import parsers, views
from ..sources.collector import Collector, PathSchema
from ..streaming.forward import Forwarder
from ..streaming.pipes import Pipe, piped
from .engine import Engine
from .store import src_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 20, 12, 30, 45, tzinfo=UTC)

#: The log views in DuckDB.
_EVENTS = """ev AS (
  SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, ts, event_type AS app, user_id::VARCHAR AS usr, event_type || ' ' || props AS msg,
    coalesce(json_extract_string(props, '$.k'), '') AS k, 'app=' || event_type AS tag_line
  FROM events
), e AS (SELECT *, 'user=' || usr || ',k=' || k AS fields_line, tag_line || ',user=' || usr AS user_line FROM ev)"""
_ROW = "ts_ns, msg, tag_line, fields_line"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the tables as views: events by type, by type and user, and with disorder; documents, conversations, pages."""
    out = Engine(spark)
    events = table(spark, sf_dir, "events")
    out.register_view("events", views.events_view(events), monotonic=True)
    out.register_view("user_events", views.events_view(events, by_user=True), monotonic=True)
    out.register_view("disordered", views.events_view(events, disorder=True))
    out.register_view("documents", views.documents_view(table(spark, sf_dir, "documents")), monotonic=True)
    out.register_view("conversations", views.conversations_view(table(spark, sf_dir, "conversations")), monotonic=True)
    out.register_view("pages", views.pages_view(table(spark, sf_dir, "pages")), monotonic=True)
    return out


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def statement(name: str, text: str, oracle: str, view: str = "events", **arguments) -> None:
    """A query that is one statement."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).sql(text, view=view, now=NOW, **arguments)

    run.__name__ = name
    query(oracle)(run)


def events_where(name: str, text: str, condition: str, view: str = "events") -> None:
    """A query for the rows of events that meet a condition."""
    row = _ROW.replace("tag_line", "user_line AS tag_line") if view == "user_events" else _ROW
    statement(name, text, f"WITH {_EVENTS} SELECT {row} FROM e WHERE {condition}", view)


def events_counts(name: str, text: str) -> None:
    """How many of all rows a statement gives that gives none, and in which columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir)
        none, every = out.sql(text, view="events", now=NOW), out.sql("SELECT", view="events", now=NOW)
        return none.agg(F.count("*").alias("rows"), F.lit(",".join(none.columns)).alias("columns")).crossJoin(every.agg(F.count("*").alias("all_rows")))

    run.__name__ = name
    query(f"SELECT 0 AS rows, '{_ROW.replace(' ', '')}' AS columns, count(*) AS all_rows FROM events")(run)


# FROM
events_where("scan_api_projection", "SELECT", "true")
events_where("from_tags_subset", "SELECT FROM {app=error}", "app = 'error'")
events_where("from_two_tags", "SELECT FROM {app=click,user=7}", "app = 'click' AND usr = '7'", "user_events")
events_where("from_expr_cmp", "SELECT FROM app >= d AND app < s", "app >= 'd' AND app < 's'")
events_where("from_expr_ne_le_gt", "SELECT FROM app != error AND app <= view AND app > a", "app <> 'error' AND app <= 'view' AND app > 'a'")
events_where("from_like", "SELECT FROM app LIKE '[^a-d]*r?*'", "regexp_full_match(app, '[^a-d][^/]*r[^/][^/]*', 's')")
events_where("from_contains_prefix_suffix", "SELECT FROM app CONTAINS i OR app PREFIX 'er' OR app SUFFIX 'se'", "contains(app, 'i') OR starts_with(app, 'er') OR ends_with(app, 'se')")
events_where("from_upper", "SELECT FROM upper(app) = ERROR OR lower(Upper(app)) = click", "upper(app) = 'ERROR' OR app = 'click'")
events_where("from_missing_tag_empty", "SELECT FROM c = '' AND NOT d != ''", "true")
events_counts("from_missing_tag_braces", "SELECT FROM {c=\"\"}")
events_counts("from_no_match_is_empty", "SELECT FROM app = nothing_like_it")
events_where("from_user_like_number", "SELECT FROM user LIKE '1?' AND NOT app = view", "regexp_full_match(usr, '1[^/]', 's') AND app <> 'view'", "user_events")

# WHERE
events_where("where_ts", "SELECT WHERE ts >= '2024-01-05 06:00:00' AND ts < '2024-01-09T12:00:00Z' AND NOT ts <= 1704600000000000000", "ts_ns >= epoch_us(TIMESTAMP '2024-01-05 06:00:00') * 1000 AND ts_ns < epoch_us(TIMESTAMP '2024-01-09 12:00:00') * 1000 AND NOT ts_ns <= 1704600000000000000")
events_where("where_ts_relative", "SELECT WHERE ts > '-12.5d' OR ts > 'week'", "ts_ns > epoch_us(TIMESTAMP '2024-01-20 12:30:45' - INTERVAL 300 HOUR) * 1000 OR ts_ns > epoch_us(TIMESTAMP '2024-01-14') * 1000")
events_where("where_msg_contains", "SELECT WHERE msg CONTAINS \"7\"", "contains(msg, '7')")
events_where("where_msg_prefix", "SELECT WHERE msg PREFIX 'cl'", "starts_with(msg, 'cl')")
events_where("where_msg_suffix", "SELECT WHERE msg SUFFIX '5}'", "ends_with(msg, '5}')")
events_where("where_msg_like", "SELECT WHERE msg LIKE '*\"k\": ?[0-3]}'", "regexp_full_match(msg, '[^/]*\"k\": [^/][0-3]\\}', 's')")
events_where("where_msg_upper_like", "SELECT WHERE upper(msg) LIKE 'ERR*'", "starts_with(upper(msg), 'ERR') AND NOT contains(msg, '/')")
for _op, _word in (("=", "eq"), ("!=", "ne"), ("<", "lt"), (">", "gt"), ("<=", "le"), (">=", "ge")):
    events_where(f"where_fields_{_word}", f"SELECT WHERE fields:k {_op} 42", f"k {_op} '42'")
events_where("where_fields_contains", "SELECT WHERE fields:k CONTAINS 4", "contains(k, '4')")
events_where("where_fields_prefix", "SELECT WHERE Fields:user PREFIX 1", "starts_with(usr, '1')")
events_where("where_fields_suffix", "SELECT WHERE fields:user SUFFIX 3", "ends_with(usr, '3')")
events_where("where_fields_like", "SELECT WHERE fields:k LIKE '[1-4]?'", "regexp_full_match(k, '[1-4][^/]', 's')")
events_where("where_fields_lower", "SELECT WHERE lower(fields:k) = '42' OR upper(fields:user) = 5", "k = '42' OR usr = '5'")
events_where("where_not_or_and", "SELECT WHERE NOT (fields:k = '42' AND msg PREFIX c) AND (fields:user = 3 OR NOT msg CONTAINS 1) OR fields:k = 9", "NOT (k = '42' AND starts_with(msg, 'c')) AND (usr = '3' OR NOT contains(msg, '1')) OR k = '9'")
events_where("where_missing_field_ne", "SELECT WHERE fields:none != aaa AND fields:other = ''", "true")

# RANGE
events_where("range_both", 'SELECT RANGE ["2024-01-05":"2024-01-07 12:00:00"]', "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 12:00:00'")
events_where("range_from", 'SELECT RANGE "2024-01-10"', "ts >= TIMESTAMP '2024-01-10'")
events_where("range_to", 'SELECT RANGE [:"2024-01-03 00:00:00"]', "ts <= TIMESTAMP '2024-01-03'")
events_where("range_where_from", 'SELECT FROM app="error" RANGE ["2024-01-05":"2024-01-12"] WHERE msg CONTAINS "7"', "app = 'error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND contains(msg, '7')")

# Merge, position, offset, limit
_ORDERED = f"WITH {_EVENTS} SELECT {_ROW} FROM e ORDER BY ts_ns"
statement("merge_order_limit", "SELECT LIMIT 500", f"{_ORDERED}, tag_line, event_id LIMIT 500")
statement("offset_limit", "SELECT OFFSET 250 LIMIT 100", f"{_ORDERED}, tag_line, event_id LIMIT 100 OFFSET 250")
statement("tail_negative_offset", "SELECT POSITION tail OFFSET -75 LIMIT 50", f"WITH {_EVENTS}, l AS (SELECT * FROM e ORDER BY ts_ns DESC, tag_line DESC, event_id DESC LIMIT 75) SELECT {_ROW} FROM l ORDER BY ts_ns, tag_line, event_id LIMIT 50")
events_counts("position_tail_is_end", "SELECT POSITION tail")
statement("head_negative_offset", "SELECT POSITION head OFFSET -10 LIMIT 20", f"{_ORDERED}, tag_line, event_id LIMIT 20")
statement("position_token", "SELECT LIMIT 200", f"WITH {_EVENTS} SELECT {_ROW} FROM e WHERE (app <> 'error' OR event_id >= 300) AND (app <> 'click' OR event_id >= 500) ORDER BY ts_ns, tag_line, event_id LIMIT 200", position={"app=error": (0, 300), "app=click": (0, 500), "app=unknown": (7, 7)})
statement("position_token_step_back", "SELECT OFFSET -40 LIMIT 60", f"""WITH {_EVENTS}, p AS (SELECT *, (app <> 'error' OR event_id >= 300) AS later FROM e),
b AS (SELECT * FROM p WHERE NOT later ORDER BY ts_ns DESC, tag_line DESC, event_id DESC LIMIT 40), u AS (SELECT * FROM b UNION ALL SELECT * FROM p WHERE later)
SELECT {_ROW} FROM u ORDER BY ts_ns, tag_line, event_id LIMIT 60""", position={"app=error": (0, 300)})
statement("backward_limit", "SELECT LIMIT 80", f"WITH {_EVENTS} SELECT {_ROW} FROM e ORDER BY ts_ns DESC, tag_line, event_id DESC LIMIT 80", backward=True)
_DISORDER = f"""WITH {_EVENTS}, d AS (SELECT *, ((event_id * 7919) % 10007) * 1000000 + event_id AS idx FROM e),
m AS (SELECT *, max(ts_ns) OVER (PARTITION BY tag_line ORDER BY idx ROWS UNBOUNDED PRECEDING) AS key, min(ts_ns) OVER (PARTITION BY tag_line ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM d)"""
statement("merge_out_of_order", "SELECT LIMIT 300", f"{_DISORDER} SELECT {_ROW} FROM m ORDER BY key, tag_line, idx LIMIT 300", "disordered")
statement("merge_out_of_order_backward", "SELECT OFFSET 20 LIMIT 300", f"{_DISORDER} SELECT {_ROW} FROM m ORDER BY back DESC, tag_line, idx DESC LIMIT 300 OFFSET 20", "disordered", backward=True)


@query(f"{_DISORDER} SELECT idx, tag_line, key AS merge_key FROM m")
def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.with_merge_key(views.events_view(table(spark, sf_dir, "events"), disorder=True))
    return rows.select("idx", "tag_line", F.col(merge.KEY).alias("merge_key"))


# Formats
def event_format(name: str, template: str, oracle: str, view: str = "events") -> None:
    quoted = template.replace('"', '\\"')
    statement(name, f'SELECT "{quoted}"', f"WITH {_EVENTS} SELECT {oracle} AS line FROM e", view)


event_format("format_msg", "{msg}\\n", "msg || chr(10)")
event_format("format_msg_json", "{Msg.Json()}", "to_json(msg)::VARCHAR")
event_format("format_ts", "{ts}", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")
event_format("format_ts_layout", "{ts.format(Mon, 02 Jan 2006 03:04:05.000000000 PM -0700)}", "strftime(ts, '%a, %d %b %Y %I:%M:%S.') || lpad(((ts_ns % 1000000000))::VARCHAR, 9, '0') || strftime(ts, ' %p +0000')")
event_format("format_vars", "{vars}", "tag_line || ',' || fields_line")
event_format("format_var_lookup", "{vars:app}/{vars:k}/{vars:none}", "app || '/' || k || '/'")
event_format("format_braces_and_text", "{{{vars:user}{}: constant", "'{' || usr || '}: constant'")


@query(f"WITH {_EVENTS} SELECT strftime(ts, '%Y-%m-%d') || ' ' || app || ' ' || msg AS line FROM e WHERE app = 'error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND contains(msg, '7') ORDER BY ts_ns, event_id LIMIT 10")
def flagship_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'SELECT "{ts.format(2006-01-02)} {vars:app} {msg}" FROM app="error" RANGE ["2024-01-05":"2024-01-12"] WHERE msg CONTAINS "7" LIMIT 10'
    return engine(spark, sf_dir).sql(text, view="events", now=NOW)


@query("SELECT to_json(text)::VARCHAR AS line FROM documents WHERE lang = 'en'")
def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT '{msg.json()}' FROM lang=en", view="documents")


statement("documents_like_spans_lines", "SELECT '{vars:n_chars}' FROM {lang=en} WHERE msg LIKE '*The*.*'", "SELECT n_chars::VARCHAR AS line FROM documents WHERE lang = 'en' AND regexp_full_match(text, '[^/]*The[^/]*\\.[^/]*', 's')", "documents")
statement("pages_like_stops_at_slash", "SELECT WHERE msg LIKE 'https://*/??/*' AND NOT msg LIKE 'https://*'", "SELECT page_id AS ts_ns, url AS msg, 'kind=page' AS tag_line, 'page=' || page_id AS fields_line FROM pages WHERE regexp_full_match(url, 'https://[^/]*/[^/][^/]/[^/]*', 's') AND NOT regexp_full_match(url, 'https://[^/]*', 's')", "pages")
statement("conversations_by_role", "SELECT '{vars:conv} {vars:role} {msg}' FROM conv < 5 WHERE fields:role != user", "SELECT conv_id || ' ' || role || ' ' || text AS line FROM conversations WHERE conv_id::VARCHAR < '5' AND role <> 'user'", "conversations")

# Catalog and truncation. The size of a record: eight bytes, its message and the text of its fields.
_CHUNKS = f"""{_EVENTS}, c AS (
  SELECT tag_line, event_id // 1000 AS chunk_id, count(*) AS records, sum(8 + strlen(msg) + strlen(fields_line)) AS bytes, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM e GROUP BY ALL
)"""


def chunked(spark: SparkSession, sf_dir: str) -> Engine:
    """The events in chunks of 1,000 numbers, so that truncation has chunks to take."""
    out = Engine(spark)
    rows = views.events_view(table(spark, sf_dir, "events")).withColumn("chunk_id", F.floor(F.col("idx") / 1000).cast("bigint"))
    out.register_view("events", rows, monotonic=True)
    return out


def chunked_statement(name: str, text: str, oracle: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunked(spark, sf_dir).execute(text, view="events", now=NOW).select(*columns)

    run.__name__ = name
    query(f"WITH {_CHUNKS} {oracle}")(run)


chunked_statement("show_partitions", "SHOW PARTITIONS", ", t AS (SELECT sum(bytes)::BIGINT AS ts, sum(records)::BIGINT AS tr, count(DISTINCT tag_line) AS tp FROM c) SELECT tag_line, sum(bytes)::BIGINT AS size, sum(records)::BIGINT AS records, ts AS total_size, tr AS total_records, tp AS total_partitions FROM c, t GROUP BY tag_line, ts, tr, tp", ["tag_line", "size", "records", "total_size", "total_records", "total_partitions"])
chunked_statement("show_partitions_page", "SHOW PARTITIONS app != error OFFSET 1 LIMIT 2", "SELECT tag_line, sum(bytes)::BIGINT AS size, sum(records)::BIGINT AS records FROM c WHERE tag_line <> 'app=error' GROUP BY tag_line ORDER BY size DESC, tag_line LIMIT 2 OFFSET 1", ["tag_line", "size", "records"])
chunked_statement("describe_partition", "DESCRIBE PARTITION {app=click}", "SELECT chunk_id, records, bytes::BIGINT AS size, min_ts_ns, max_ts_ns FROM c WHERE tag_line = 'app=click'", ["chunk_id", "records", "size", "min_ts_ns", "max_ts_ns"])
_REPORT = ["tag_line", "before_size", "after_size", "before_records", "after_records", "chunks_dropped", "deleted"]
_PLAN = """, p AS (SELECT *, sum(bytes) OVER (PARTITION BY tag_line) - sum(bytes) OVER (PARTITION BY tag_line ORDER BY chunk_id) AS rest FROM c),
q AS (SELECT *, {size} AS by_size FROM p), d AS (SELECT *, by_size OR ({time}) AS gone FROM q),
r AS (SELECT tag_line, max(max_ts_ns) AS latest, sum(bytes)::BIGINT AS before_size, coalesce(sum(bytes) FILTER (NOT gone), 0)::BIGINT AS after_size, sum(records)::BIGINT AS before_records, coalesce(sum(records) FILTER (NOT gone), 0)::BIGINT AS after_records, count(*) FILTER (gone) AS chunks_dropped, count(*) AS chunks FROM d GROUP BY tag_line)
"""
_SIMPLE = "SELECT tag_line, before_size, after_size, before_records, after_records, chunks_dropped, after_size = 0 AS deleted FROM r WHERE before_size <> after_size"
_TIME = "min(by_size OR max_ts_ns <= epoch_us(TIMESTAMP '2024-01-04') * 1000) OVER (PARTITION BY tag_line ORDER BY chunk_id) AND rest >= {}"
chunked_statement("truncate_plan_size", "TRUNCATE DRYRUN MINSIZE 5000 MAXSIZE 20000", _PLAN.format(size="rest + bytes > 20000 AND rest >= 5000", time="false") + _SIMPLE, _REPORT)
chunked_statement("truncate_plan_before", "TRUNCATE DRYRUN app != view MINSIZE 1000 BEFORE '2024-01-04 00:00:00'", _PLAN.format(size="false", time=_TIME.format(1000)) + _SIMPLE + " AND tag_line <> 'app=view'", _REPORT)
chunked_statement("truncate_plan_both", "TRUNCATE DRYRUN MAXSIZE 40000 BEFORE '2024-01-04 00:00:00'", _PLAN.format(size="rest + bytes > 40000", time=_TIME.format(0)) + _SIMPLE, _REPORT)
_GLOBAL = """, g AS (SELECT *, sum(after_size) OVER () - coalesce(sum(after_size) OVER (ORDER BY latest DESC, tag_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 100000 AND after_size > 0 AS whole FROM r)
SELECT tag_line, before_size, CASE WHEN whole THEN 0 ELSE after_size END AS after_size, before_records, CASE WHEN whole THEN 0 ELSE after_records END AS after_records,
CASE WHEN whole THEN chunks ELSE chunks_dropped END AS chunks_dropped, whole OR after_size = 0 AS deleted FROM g WHERE whole OR before_size <> after_size"""
chunked_statement("truncate_plan_maxdb", "TRUNCATE DRYRUN MAXSIZE 60000 MAXDBSIZE 100000", _PLAN.format(size="rest + bytes > 60000", time="false") + _GLOBAL, _REPORT)


@query(f"WITH {_CHUNKS} SELECT tag_line, chunk_id, records, bytes::BIGINT AS bytes, min_ts_ns, max_ts_ns FROM c")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).chunk_table("events").drop("src")


# Pipes and sinks
@query(f"WITH {_EVENTS} SELECT ts_ns, msg, 'stream.pipe=errors' AS tag_line, fields_line || ',app=' || app || ',user=' || usr AS fields_line FROM e WHERE app = 'error' AND contains(msg, '7')")
def pipe_batch_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events_view(table(spark, sf_dir, "events"), by_user=True)
    out = piped(rows, Pipe("errors", "{app=error}", "msg CONTAINS 7", 0))
    return out.select("ts_ns", "msg", F.lit("stream.pipe=errors").alias("tag_line"), fields_line_column(F.col("fields_kv")).alias("fields_line"))


_FRACTION = "CASE WHEN ts_ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(((ts_ns // 1000) % 1000000)::VARCHAR, 6, '0'), '0') END"


@query(f"WITH {_EVENTS} SELECT '<' || CASE app WHEN 'error' THEN {(FACILITIES.index('local6') << 3) | SEVERITIES.index('err')} ELSE {(FACILITIES.index('local6') << 3) | SEVERITIES.index('info')} END || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || {_FRACTION} || 'Z host-' || usr || ' ' || tag_line || ' - - - ' || msg AS line FROM e")
def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events_view(table(spark, sf_dir, "events")).withColumn("fields_kv", F.concat("fields_kv", F.array(F.struct(F.lit("sev").alias("k"), F.when(F.col("tags")["app"] == "error", "err").otherwise("x").alias("v")))))
    return rows.select(syslog_line(severity="{vars:sev}", hostname="host-{vars:user}").alias("line"))


#: Over 200 bytes, the most first characters that take no more: as many as the largest number of them that fits.
_CUT = "CASE WHEN strlen(t) <= 200 THEN t ELSE left(t, (SELECT max(n) FROM range(0, 201) r(n) WHERE strlen(left(t, n)) <= 200)) || '... [truncated]' || chr(10) END"


@query(f"WITH d AS (SELECT doc_id, replace(text, chr(10), '') AS t FROM documents) SELECT doc_id AS ts_ns, '<182>1 1970-01-01T00:00:00Z localhost d - - - ' || {_CUT} AS line FROM d")
def syslog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.documents_view(table(spark, sf_dir, "documents")).withColumn("doc", F.col("ts_ns"))
    return rows.withColumn("ts_ns", F.lit(0).cast("long")).select(F.col("doc").alias("ts_ns"), syslog_line(tags="d", limit=200).alias("line"))


# Sources
def _lines(df: DataFrame, line: Column, number: Column, file: Column | None = None) -> DataFrame:
    return df.select((file if file is not None else F.lit("/var/log/x.log")).alias("file"), number.alias("line_no"), line.alias("line"))


def _time_text(pattern: str) -> Column:
    return F.date_format(F.col("ts").cast("timestamp"), pattern)


@query("SELECT event_id AS line_no, epoch_us(ts) * 1000 + 789 AS ts_ns, props || chr(10) AS msg, 'stream=' || event_type AS fields_line FROM events")
def k8json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.concat("props", F.lit("\n")).alias("log"), F.col("event_type").alias("stream"), F.concat(_time_text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z")).alias("time")))
    return parsers.parse_k8json(_lines(events, record, F.col("event_id"))).select("line_no", "ts_ns", "msg", fields_line_column(F.col("fields_kv")).alias("fields_line"))


@query("""SELECT event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000000) * 1000000000 ELSE epoch_us(ts) * 1000 END AS ts_ns,
'stream=stdout' || CASE WHEN event_id % 2 = 0 THEN ',time=' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE ',time=never' END || ',type=a ' || event_type || ',user=' || user_id AS fields_line FROM events""")
def logfmt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 2 == 0, _time_text("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never")
    text = F.concat(F.lit("time="), time, F.lit(" other user="), F.col("user_id").cast("string"), F.lit(' type="a '), "event_type", F.lit('" left=1\n'))
    record = F.to_json(F.struct(text.alias("log"), F.lit("stdout").alias("stream"), F.concat(_time_text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("time")))
    out = parsers.parse_logfmt(_lines(events, record, F.col("event_id")), ["time", "type", "user", "missing"])
    return out.select("line_no", "ts_ns", fields_line_column(F.col("fields_kv")).alias("fields_line"))


@query("""WITH l AS (SELECT event_id AS line_no, user_id, CASE WHEN event_id % 3 <> 1 THEN (epoch_us(ts) // 1000000) * 1000000000 END AS t FROM events)
SELECT line_no, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line_no), -1) AS ts_ns FROM l""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    dated = F.when(F.col("event_id") % 3 == 0, F.concat(_time_text("yyyy-MM-dd HH:mm:ss"), F.lit(" msg"))).when(F.col("event_id") % 3 == 2, F.concat(F.lit("at ["), _time_text("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] x"))).otherwise("no date here")
    lines = _lines(events, dated, F.col("event_id"), F.concat(F.lit("/var/log/u"), F.col("user_id").cast("string")))
    return parsers.parse_text(lines).select("line_no", F.coalesce("ts_ns", F.lit(-1)).alias("ts_ns"))


@query("SELECT event_id AS line_no, 5 AS ts_ns, props AS msg, 'app=' || event_type || ',kind=k' || user_id AS tag_line, 'file=' || event_type || '.log' AS fields_line FROM events WHERE user_id % 2 = 0")
def path_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    file = F.concat(F.lit("/logs/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".log"))
    lines = _lines(events, F.col("props"), F.col("event_id"), file).filter(F.col("line_no").isNotNull())
    schemas = [PathSchema(r"/logs/(?P<user>\d*[02468])/(?P<app>\w+)\.log$", {"app": "{app}", "kind": "k{user}"}, {"file": "{app}.log"})]
    out = Collector([], schemas).read(lines).withColumn("ts_ns", F.lit(5).cast("long"))
    return out.select("line_no", "ts_ns", "msg", "tag_line", fields_line_column(F.col("fields_kv")).alias("fields_line"))


# Totals
@query(f"""WITH {_EVENTS}, b AS (SELECT tag_line, ts_ns - ts_ns % 3600000000000 AS bucket_ns, sum(k::BIGINT)::BIGINT AS bucket_total FROM e GROUP BY ALL)
SELECT tag_line, bucket_ns, bucket_total, sum(bucket_total) OVER (PARTITION BY tag_line ORDER BY bucket_ns RANGE BETWEEN 82800000000000 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM b""")
def sliding_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events_view(table(spark, sf_dir, "events"))
    value = F.get(F.filter("fields_kv", lambda e: e["k"] == "k"), F.lit(0))["v"].cast("bigint")
    return sliding.sliding_total(rows, ["tag_line"], value, 24 * 3600 * 10**9, 3600 * 10**9)


@query(f"WITH {_EVENTS} SELECT tag_line, count(*) AS records, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM e GROUP BY tag_line")
def totals_of_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stats.chunk_stats(views.events_view(table(spark, sf_dir, "events")))
    return chunks.groupBy("tag_line").agg(F.sum("records").alias("records"), F.min("min_ts_ns").alias("first_ns"), F.max("max_ts_ns").alias("last_ns"))


@query("SELECT o_orderkey AS idx, epoch_us(o_orderdate) * 1000 AS ts_ns, max(epoch_us(o_orderdate) * 1000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS merge_key FROM orders")
def merge_keys_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = views.log_view(orders, {"priority": F.col("o_orderpriority")}, views.micros_ns(F.col("o_orderdate")), F.col("o_comment") if "o_comment" in orders.columns else F.lit(""), [], F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 5000))
    return merge.with_merge_key(rows).select("idx", "ts_ns", F.col(merge.KEY).alias("merge_key"))


# The store and its streams. Each query writes a store of its own in the shared folder.
def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, as in tests, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it names the folder that driver and executors share")
    shared = shared or f"file://{tempfile.gettempdir()}/tidewake-shared"
    return f"{shared.rstrip('/')}/tidewake/store-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, *prepare: str, chunks: list[Column] | None = None) -> Engine:
    """An engine whose store holds the events, one chunk for each condition; statements may be run before they are written."""
    out = Engine(spark, scratch(spark))
    for text in prepare:
        out.execute(text)
    rows = views.events_view(table(spark, sf_dir, "events"))
    for condition in chunks or [F.lit(True)]:
        out.store.append(rows.filter(condition).orderBy("idx").select("tags", "ts_ns", "msg", "fields_kv"))
    return out


@query(f"WITH {_EVENTS} SELECT {_ROW} FROM e WHERE app IN ('click', 'error') AND k < '5' AND ts >= TIMESTAMP '2024-01-03'")
def store_write_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).sql("SELECT FROM app=click OR app=error RANGE '2024-01-03' WHERE fields:k < 5", now=NOW)


@query(f"WITH {_CHUNKS} SELECT tag_line, sum(bytes)::BIGINT AS size, sum(records)::BIGINT AS records FROM c GROUP BY tag_line")
def store_show_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).execute("SHOW PARTITIONS").select("tag_line", "size", "records")


@query(f"WITH {_EVENTS} SELECT {_ROW} FROM e WHERE ts >= TIMESTAMP '2024-01-10' OR app = 'view'")
def store_truncate_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.col("ts_ns") < 1704844800000000000, F.col("ts_ns") >= 1705708800000000000
    out = stored(spark, sf_dir, chunks=[first, ~first & ~last, last])
    out.execute("TRUNCATE app != view BEFORE '2024-01-15 00:00:00'", now=NOW)
    return out.sql("SELECT", now=NOW)


@query(f"WITH {_EVENTS} SELECT ts_ns, msg, 'stream.pipe=sevens' AS tag_line, fields_line || ',app=' || app AS fields_line FROM e WHERE app <> 'view' AND contains(msg, '7')")
def pipe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(spark, sf_dir, "CREATE PIPE sevens FROM app != view WHERE msg CONTAINS 7")
    out.pipes.start("sevens").awaitTermination()
    return out.sql("SELECT FROM {stream.pipe=sevens}", now=NOW)


@query(f"WITH {_EVENTS} SELECT app || ' ' || msg AS line FROM e WHERE k >= '9'")
def tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(spark, sf_dir)
    taken = out.store.path("taken")
    out.tail("SELECT '{vars:app} {msg}' WHERE fields:k >= 9", lambda rows: rows.write.mode("append").parquet(taken), out.store.path("checkpoints/tail")).awaitTermination()
    return spark.read.schema("line string").parquet(taken)


def _put(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """Write one file of lines at a path, in the place of what is there."""
    folder = f"{path}-{uuid.uuid4().hex}"
    lines.write.text(folder)  # by all tasks, in the order of their names
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = {x.getPath().getName(): x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))}
    parts = [found[name] for name in sorted(found) if name.startswith("part-")]
    fs.mkdirs(to.getParent())
    fs.delete(to, False)
    out = fs.create(to, True)
    try:
        for part in parts:
            piece = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
            finally:
                piece.close()
    finally:
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || chr(10) AS msg, (epoch_us(ts) // 1000000) * 1000000000 AS ts_ns, 'app=' || CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END || ',kind=text' AS tag_line FROM events")
def collect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two globs: one grows between two runs, the other is rotated."""
    out = Engine(spark, scratch(spark))
    events = table(spark, sf_dir, "events").orderBy("event_id")
    text = F.concat_ws(" ", _time_text("yyyy-MM-dd HH:mm:ss"), "event_type")
    early, even = F.col("ts") < "2024-01-10", F.col("event_id") % 2 == 0
    paths = [out.store.path("incoming/even/one.log"), out.store.path("incoming/odd/two.txt")]
    collector = Collector([out.store.path("incoming/e*/*.log"), out.store.path("incoming/odd/*.txt")], [PathSchema(r"/incoming/(?P<app>\w+)/[^/]*$", {"app": "{app}", "kind": "text"}, {}, "text")])
    for growing, rotated in ((even & early, ~even & early), (even, ~even & ~early)):
        # Lines stand in order of (time came, event_id), so that the first run's file begins the second's.
        _put(spark, events.filter(growing).orderBy(~early, "event_id").select(text), paths[0])
        _put(spark, events.filter(rotated).select(text), paths[1])
        out.collect(collector, out.store.path("checkpoints/collect")).awaitTermination()
    return out.sql("SELECT", now=NOW).select("msg", "ts_ns", "tag_line")


@query(f"WITH {_EVENTS} SELECT {_ROW} FROM e WHERE app = 'click' AND k < '5'")
def source_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(spark, sf_dir)
    src = spark.range(1).select(src_of(F.lit("app=click"))).first()[0]
    return out.sql("SELECT FROM app=error WHERE fields:k < 5", now=NOW, src=src)


@query("SELECT 'app=' || event_type AS tag_line, event_id AS ts_ns, event_type || '!' AS msg, 'dc=1,user=' || user_id || ',note=\"a,b\"' AS fields_line FROM events WHERE event_type = 'click'")
def write_with_field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spark, scratch(spark))
    fields = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(', note="a,b"'))
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'")
    out.write("app=click", "dc=1", clicks.select(F.col("event_id").alias("ts_ns"), F.concat("event_type", F.lit("!")).alias("msg"), fields.alias("fields")))
    return out.sql("SELECT", now=NOW)


_BY_DAY = "WITH d AS (SELECT 'app=' || event_type AS tag_line, epoch_us(ts) * 1000 AS ts_ns, date_diff('day', DATE '2024-01-01', ts::DATE) // 10 AS part FROM events)"


@query(f"{_BY_DAY} SELECT tag_line, count(*) AS records, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM d GROUP BY tag_line, part HAVING max(ts_ns) >= epoch_us(TIMESTAMP '2024-01-12') * 1000 AND min(ts_ns) <= epoch_us(TIMESTAMP '2024-01-13') * 1000")
def range_prunes_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that a RANGE reads."""
    part = F.floor((F.col("ts_ns") / 86400000000000 - 19723) / 10)
    parts = [r[0] for r in views.events_view(table(spark, sf_dir, "events")).select(part).distinct().collect()]  # one for each ten days
    out = stored(spark, sf_dir, chunks=[part == p for p in sorted(parts)])
    bounds = range_bounds(parse('SELECT RANGE ["2024-01-12":"2024-01-13"]').range, NOW)
    return out.store.chosen(bounds=bounds).select("tag_line", "records", "min_ts_ns", "max_ts_ns")


@query(f"{_ORDERED}, tag_line, event_id LIMIT 500")
def pages_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of a hundred rows, each from the token of the one before."""
    out, token, rows = engine(spark, sf_dir), None, []
    for _ in range(5):
        got, token = out.page("SELECT", token, 100, "events")
        rows += [(r["ts_ns"], r["msg"], r["tag_line"], r["fields_kv"]) for r in got]
    frame = spark.createDataFrame(rows, "ts_ns long, msg string, tag_line string, fields_kv array<struct<k:string,v:string>>")
    return frame.select("ts_ns", "msg", "tag_line", fields_line_column(F.col("fields_kv")).alias("fields_line"))


@query("SELECT unnest(['all', 'late']) AS name")
def pipes_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made, made sure of, deleted and shown."""
    out = Engine(spark, scratch(spark))
    for text in ("CREATE PIPE all", "CREATE PIPE gone FROM app=view", "CREATE PIPE errors FROM app=error"):
        out.execute(text)
    out.pipes.ensure("late", "app=view", "msg CONTAINS x")
    out.pipes.ensure("late", "app=click", recreate=True)
    out.execute("DELETE PIPE gone")
    out.execute("DELETE PIPE errors")
    return out.execute("SHOW PIPES")


@query("SELECT 'late' AS name, 'app=click' AS tags_cond, 'msg CONTAINS x' AS flt_cond, 'stream.pipe=late' AS dest_tag_line")
def pipe_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spark, scratch(spark))
    for _ in range(2):
        out.pipes.ensure("late", "app = click", "msg contains x")
    frame = out.execute("DESCRIBE PIPE late")
    return frame.select("name", F.regexp_replace("tags_cond", '[" ]', "").alias("tags_cond"), F.replace("flt_cond", F.lit('"'), F.lit("")).alias("flt_cond"), "dest_tag_line")


@query(f"WITH {_EVENTS} SELECT ts_ns, msg, 'stream.pipe=all' AS tag_line, fields_line || ',app=' || app AS fields_line FROM e")
def pipe_takes_no_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe of everything next to another pipe: what that one writes is not copied."""
    out = stored(spark, sf_dir, "CREATE PIPE all", "CREATE PIPE views FROM app=view")
    for name in ("views", "all", "all"):
        out.pipes.start(name).awaitTermination()
    return out.sql("SELECT FROM {stream.pipe=all}", now=NOW)


@query(f"WITH {_EVENTS} SELECT msg, ts_ns FROM e WHERE app = 'error'")
def forward_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forwarder's worker, kept, replaced and stopped as its configuration says."""
    out = stored(spark, sf_dir, "CREATE PIPE errors FROM app=error")
    out.pipes.start("errors").awaitTermination()
    taken = out.store.path("taken")
    forwarder = Forwarder(out, out.store.path("checkpoints/forward"))
    sink = lambda rows: rows.select("msg", "ts_ns").write.mode("append").parquet(taken)
    for _ in range(2):
        forwarder.sync({"worker": ("errors", sink)})
        forwarder.running["worker"][1].awaitTermination()
    forwarder.stop()
    return spark.read.schema("msg string, ts_ns long").parquet(taken)


@query(f"WITH {_EVENTS} SELECT row_number() OVER (ORDER BY ts_ns, event_id) - 1 AS n, msg AS line FROM e WHERE app = 'error'")
def stdout_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = io.StringIO()
    Stdout(written)(engine(spark, sf_dir).rows("SELECT FROM app=error", "events", NOW))
    return spark.createDataFrame(list(enumerate(written.getvalue().splitlines())), "n long, line string")


@query(f"WITH {_EVENTS} SELECT row_number() OVER (ORDER BY ts_ns, event_id) - 1 AS n, msg FROM e WHERE app = 'click'")
def syslog_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a server of this process hears them, in order."""
    heard: list[str] = []

    class Hear(socketserver.StreamRequestHandler):
        def handle(self):
            heard.extend(x.decode().rstrip("\n") for x in self.rfile)

    with socketserver.TCPServer(("0.0.0.0", 0), Hear) as server:
        server.timeout = 60
        listener = threading.Thread(target=server.handle_request)
        listener.start()
        address = f"{spark.conf.get('spark.driver.host', '127.0.0.1')}:{server.server_address[1]}"
        Syslog(Target("tcp", address))(engine(spark, sf_dir).rows("SELECT FROM app=click", "events", NOW))
        listener.join()
    return spark.createDataFrame([(k, x.split(" - - - ", 1)[1]) for k, x in enumerate(heard)], "n long, msg string")


@query("SELECT '/var/log/' || event_type AS file, count(*) AS total, count(*) FILTER (event_id % 7 <> 0) AS successful, count(*) FILTER (event_id % 7 = 0) AS failed, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 = 0) AS undated FROM events GROUP BY event_type")
def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the registry's parser of container logs: one line in seven is no JSON, one in five has no time."""
    events = table(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 5 != 0, F.concat(_time_text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    record = F.to_json(F.struct(F.col("props").alias("log"), F.lit("stdout").alias("stream"), time.alias("time")))
    line = F.when(F.col("event_id") % 7 == 0, "no json").otherwise(record)
    lines = _lines(events, line, F.col("event_id"), F.concat(F.lit("/var/log/"), "event_type"))
    return parsers.parse_statistics(parsers.parser("k8json")(lines))


@query("SELECT unnest(['YYYY-MM-DD HH:mm:ss', '']) AS pattern, unnest([count(*) FILTER (event_id % 3 <> 1), count(*) FILTER (event_id % 3 = 1)]) AS hits FROM events")
def date_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    dated = F.when(F.col("event_id") % 3 != 1, F.concat(_time_text("yyyy-MM-dd HH:mm:ss"), F.lit(" msg"))).otherwise("no date here")
    return parsers.date_statistics(_lines(events, dated, F.col("event_id"), F.concat(F.lit("/var/log/u"), F.col("user_id").cast("string"))))


@query(f"WITH {_CHUNKS} SELECT tag_line, sum(records)::BIGINT AS records, false AS left_behind FROM c WHERE tag_line <> 'app=view' GROUP BY tag_line")
def store_drop_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition that is truncated whole: neither its entry nor its folder stays."""
    out = stored(spark, sf_dir)
    out.execute("TRUNCATE app=view BEFORE '2030-01-01'", now=NOW)
    src = spark.range(1).select(src_of(F.lit("app=view"))).first()[0]
    return out.execute("SHOW PARTITIONS").select("tag_line", "records", F.lit(out.store.exists(f"events/src={src}")).alias("left_behind"))


@query(f"WITH {_EVENTS} SELECT row_number() OVER (ORDER BY ts_ns, tag_line, event_id) - 1 AS n, msg AS line FROM e ORDER BY n LIMIT 50")
def shell_default_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shell prints for a SELECT without a format and a limit."""
    written = io.StringIO()
    cli.run(stored(spark, sf_dir), "SELECT", written)
    return spark.createDataFrame(list(enumerate(written.getvalue().splitlines())), "n long, line string")


_ERRORS = {
    "SELECT WHERE ts = 5": "UnsupportedOperatorError", "SELECT WHERE msg = x": "UnsupportedOperatorError", "SELECT WHERE size > 5": "UnknownOperandError", "SELECT WHERE fields: = x": "UnknownOperandError",
    "SELECT WHERE trim(msg) CONTAINS x": "UnknownOperandError", "SELECT WHERE ts < someday": "DateTimeError", "SELECT WHERE msg LIKE '[x'": "PatternError", "SELECT FROM": "StatementSyntaxError", "SELECT POSITION 'none'": "StatementError",
}


@query("SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in _ERRORS) + "]) AS statement, unnest([" + ", ".join(f"'{e}'" for e in _ERRORS.values()) + "]) AS error")
def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors show before a job runs."""
    out, rows = engine(spark, sf_dir), []
    for text in _ERRORS:
        try:
            out.sql(text, "events", NOW)
        except StatementError as e:
            rows.append((text, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, error string")
