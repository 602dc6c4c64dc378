"""Format templates: `{msg}`, `{ts.format(2006-01-02)}`, `{vars:name}` and the like, as one column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError
from ..model.kvtext import field_texts_column, field_value, tag_value

RFC3339 = "2006-01-02T15:04:05Z07:00"
#: Elements of layouts by reference time, the longer first, and Spark's letters for them.
LAYOUT = [
    ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("MST", "zzz"), ("2006", "yyyy"), ("-07:00", "xxx"), ("-0700", "xx"),
    ("Z07:00", "XXX"), ("Z0700", "XX"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("_2", "_2"),
    ("PM", "a"), ("pm", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]
_FRACTION = re.compile(r"[.,](0+|9+)(?!\d)")


def parse(template: str) -> list[tuple[str, str]]:
    """(kind, argument) of the parts of a template: const, msg, json, ts, vars, var. `{{` is a brace, `{}` a closing one."""
    parts: list[tuple[str, str]] = []
    constant, i = "", 0
    while i < len(template):
        c = template[i]
        if c != "{":
            constant += c
            i += 1
            continue
        if template[i + 1 : i + 2] in ("{", "}") and i + 1 < len(template):
            constant += template[i + 1]
            i += 2
            continue
        end = template.find("}", i)
        if end < 0:
            raise FormatError(f"a brace does not close in {template!r}")
        if "{" in template[i + 1 : end]:
            raise FormatError(f"a brace within braces in {template!r}")
        if constant:
            parts.append(("const", constant))
            constant = ""
        parts.append(_term(template[i + 1 : end].strip(" ")))
        i = end + 1
    return [*parts, ("const", constant)] if constant else parts


def _term(text: str) -> tuple[str, str]:
    name = text.lower()
    if name in ("msg", "vars"):
        return name, ""
    if name == "msg.json()":
        return "json", ""
    if name == "ts":
        return "ts", RFC3339
    if name.startswith("ts.format(") and name.endswith(")"):
        return "ts", text[len("ts.format(") : -1]
    if name.startswith("vars:") and len(text) > len("vars:"):
        return "var", text[len("vars:") :]
    raise FormatError(f"unknown term {{{text}}}: there are msg, msg.json(), vars, ts, ts.format(layout) and vars:name")


def json_text(text: Column) -> Column:
    """A quoted JSON string: quotes, backslashes and characters below a space are escaped, nothing else."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(0x20):
        name = {0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _moment(ts_ns: Column) -> Column:
    """The time to the microsecond below; exact, as a division of whole numbers."""
    return F.timestamp_micros(((ts_ns - F.pmod(ts_ns, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long"))


def time_text(ts_ns: Column, layout: str, zone: str = "UTC") -> Column:
    """A time in a layout that shows how 2 January 2006, 15:04:05 would be written.

    Spark's times are of microseconds; the last three digits of a fraction come from ts_ns itself.
    """
    moment = _moment(ts_ns)
    shown = moment if zone == "UTC" else F.from_utc_timestamp(moment, zone)
    parts: list[Column] = []
    i = 0
    while i < len(layout):
        fraction = _FRACTION.match(layout, i) if i and layout[i - 1] == "5" else None
        if fraction:
            digits = F.lpad(F.pmod(ts_ns, F.lit(1_000_000_000)).cast("string"), 9, "0").substr(1, len(fraction[1]))
            if fraction[1][0] == "9":  # trailing zeros go, and the point with them
                digits = F.regexp_replace(digits, "0+$", "")
                parts.append(F.when(digits == "", "").otherwise(F.concat(F.lit(layout[i]), digits)))
            else:
                parts.append(F.concat(F.lit(layout[i]), digits))
            i = fraction.end()
            continue
        for element, letters in LAYOUT:
            if layout.startswith(element, i):
                if letters == "_2":
                    parts.append(F.lpad(F.date_format(shown, "d"), 2, " "))
                elif letters == "a":
                    parts.append(F.lower(F.date_format(shown, "a")) if element == "pm" else F.upper(F.date_format(shown, "a")))
                elif letters in ("xxx", "xx", "XXX", "XX", "zzz") and zone != "UTC":
                    parts.append(_offset(ts_ns, letters, zone))
                else:
                    parts.append({"zzz": F.lit("UTC")}.get(letters, F.date_format(shown, letters)))
                i += len(element)
                break
        else:
            parts.append(F.lit(layout[i]))
            i += 1
    return F.concat(*parts) if parts else F.lit("")


def _offset(ts_ns: Column, letters: str, zone: str) -> Column:
    """The offset of a zone at a time, or its name."""
    if letters == "zzz":
        return F.lit(zone)
    moment = _moment(ts_ns)
    minutes = ((F.unix_micros(F.from_utc_timestamp(moment, zone)) - F.unix_micros(moment)) / 60_000_000).cast("int")
    size = F.abs(minutes)
    colon = ":" if len(letters) == 3 else ""
    text = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(colon), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.when(minutes == 0, "Z").otherwise(text) if letters[0] == "X" else text


def vars_text() -> Column:
    return F.concat_ws(",", F.col("tag_line"), field_texts_column(F.col("fields_kv")))


def render(template: str, zone: str = "UTC", trim_msg: bool = False) -> Column:
    """A template over the columns of the store; trim_msg: line feeds around the message go."""
    msg = F.regexp_replace(F.col("msg"), r"\A\n+|\n+\z", "") if trim_msg else F.col("msg")
    made = []
    for kind, argument in parse(template):
        match kind:
            case "const":
                made.append(F.lit(argument))
            case "msg":
                made.append(msg)
            case "json":
                made.append(json_text(msg))
            case "ts":
                made.append(time_text(F.col("ts_ns"), argument, zone))
            case "vars":
                made.append(vars_text())
            case "var":
                field = field_value(F.col("fields_kv"), argument)
                made.append(F.when(field != "", field).otherwise(tag_value(F.col("tags"), argument)))
    return F.concat(*made) if made else F.lit("")
