"""Syslog lines as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formatter

#: Severities and facilities in the order of their codes.
SEVERITIES = "emerg alert crit err warn notice info debug".split()
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert at local0 local1 local2 local3 local4 local5 local6 local7".split()
TIME_LAYOUT = "2006-01-02T15:04:05.999999Z07:00"


def severity(name: str) -> int:
    if name not in SEVERITIES:
        raise ValueError(f"unknown severity: {name}")
    return SEVERITIES.index(name)


def facility(name: str) -> int:
    if name not in FACILITIES:
        raise ValueError(f"unknown facility: {name}")
    return FACILITIES.index(name) << 3


def _code(name: Column, names: list[str], shift: int, default: int) -> Column:
    codes = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k << shift))))
    return F.coalesce(codes[name], F.lit(default))


def cut_bytes(text: Column, most: int, mark: str = "... [truncated]\n") -> Column:
    """At most the first `most` bytes, to the last whole character, and a mark where the text is longer."""
    head = F.encode(F.substr(text, F.lit(1), F.lit(most)), "UTF-8")
    # A byte 10xxxxxx right after the cut belongs to the character before: up to three bytes go back.
    starts = lambda n: ~F.substring(F.hex(F.substring(head, n + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    cut = F.substring(head, 1, max(most - 3, 0))
    for n in (max(most - 2, 0), max(most - 1, 0), most):
        cut = F.when((F.length(head) <= n) | starts(n), F.substring(head, 1, n)).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut.cast("string"), F.lit(mark)))


def syslog_line(
    facility: str | None = None,
    severity: str | None = None,
    hostname: str | None = None,
    tags: str | None = None,
    msg: str | None = None,
    replace_newlines: bool = True,
    limit: int = 1024,
    zone: str = "UTC",
) -> Column:
    """`<pri>1 time host tag - - - msg` of a record.

    Each part is a format template; without one the facility is local6, the severity info, the host
    localhost, the tag the tag line and the message the record's. Unknown names fall back too.
    """
    render = lambda template, default: formatter.render(template, zone) if template is not None else default
    facility_code = _code(render(facility, F.lit("local6")), FACILITIES, 3, FACILITIES.index("local6") << 3)
    severity_code = _code(render(severity, F.lit("info")), SEVERITIES, 0, SEVERITIES.index("info"))
    text = render(msg, F.col("msg"))
    if replace_newlines:
        text = F.replace(text, F.lit("\n"), F.lit(""))
    if limit > 0:
        text = cut_bytes(text, limit)
    time = formatter.time_text(F.col("ts_ns"), TIME_LAYOUT, zone)
    return F.concat(
        F.lit("<"), facility_code.bitwiseOR(severity_code).cast("string"), F.lit(">1 "), time, F.lit(" "), render(hostname, F.lit("localhost")), F.lit(" "), render(tags, F.col("tag_line")), F.lit(" - - - "), text
    )
