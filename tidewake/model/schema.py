"""Columns of the log store."""

from __future__ import annotations

#: One row for each record. ts_ns is the time; order within a partition is (chunk_id, idx).
LOG_SCHEMA = "src string, tag_line string, tags map<string,string>, chunk_id bigint, idx bigint, ts_ns bigint, msg string, fields_kv array<struct<k:string,v:string>>"
LOG_COLUMNS = [c.split()[0] for c in ("src", "tag_line", "tags", "chunk_id", "idx", "ts_ns", "msg", "fields_kv")]
MIN_NS, MAX_NS = -(1 << 63), (1 << 63) - 1
