"""Text forms of tags and fields: `k=v,k2="v 2"`, optionally within braces."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pairs = list[tuple[str, str]]
#: Names and values of fields are limited, in bytes of UTF-8.
FIELD_BYTES = 255
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)
_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}


def unquote(text: str) -> str:
    """A literal in double quotes, backticks or single quotes without them, escapes resolved."""
    quote = text[:1]
    if len(text) < 2 or text[-1] != quote or quote not in "\"`'":
        raise ValueError(f"not a quoted literal: {text}")
    body = text[1:-1]
    if quote == "`":
        if "`" in body:
            raise ValueError(f"a backtick within backticks: {text}")
        return body
    if quote == '"' and ("\n" in body or re.search(r'(?<!\\)(?:\\\\)*"', body)):
        raise ValueError(f"a bare quote or line feed within quotes: {text}")

    def resolve(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16))
        if m[4]:
            return chr(int(m[4], 8))
        if m[5] not in _SIMPLE:
            raise ValueError(f"unknown escape \\{m[5]}")
        return _SIMPLE[m[5]]

    if re.search(r"(?<!\\)(?:\\\\)*\\\Z", body):
        raise ValueError(f"an escape is not finished: {text}")
    return _ESCAPE.sub(resolve, body)


def strip_braces(text: str) -> str:
    """text without the braces and spaces around it; braces must pair up."""
    head = re.match(r"[ {]*", text)[0]
    opened = head.count("{")
    rest = text[len(head) :]
    while rest and opened >= 0 and rest[-1] in " }":
        opened -= rest[-1] == "}"
        rest = rest[:-1]
    if opened:
        raise ValueError(f"braces don't pair up in {text!r}")
    return rest


def split_pairs(text: str) -> list[str]:
    """Keys and values in turn, as they stand; separators within double quotes don't count."""
    parts, start, quoted, expected, i = [], 0, False, "=", 0
    while i < len(text):
        c = text[i]
        if c == '"':
            quoted = not quoted
        elif c == "\\" and quoted:
            i += 1
        elif c in "=," and not quoted:
            if c != expected:
                raise ValueError(f"{c!r} where {expected!r} belongs, at {i} of {text!r}")
            expected = "," if c == "=" else "="
            parts.append(text[start:i])
            start = i + 1
        i += 1
    if quoted:
        raise ValueError(f"a quote does not close in {text!r}")
    return [*parts, text[start:]]


def parse_pairs(text: str) -> Pairs:
    """Pairs in the order of the text; duplicates stay."""
    body = strip_braces(text)
    if not body:
        return []
    parts = split_pairs(body)
    if len(parts) % 2:
        raise ValueError(f"a key without a value in {text!r}")
    pairs = []
    for key, value in zip(parts[::2], parts[1::2], strict=True):
        key, value = key.strip(" "), value.strip(" ")
        if not key:
            raise ValueError(f"an empty key in {text!r}")
        pairs.append((key, unquote(value) if value[:1] in ('"', "`") else value))
    return pairs


def parse_tags(text: str) -> dict[str, str]:
    """Tags of a text; a key that comes again replaces the earlier value."""
    return dict(parse_pairs(text))


def parse_fields(text: str) -> Pairs:
    """Fields of a text, in order; names and values over the limit are errors."""
    pairs = parse_pairs(text)
    for part in (x for pair in pairs for x in pair):
        if len(part.encode()) > FIELD_BYTES:
            raise ValueError(f"over {FIELD_BYTES} bytes: {part[:40]!r}...")
    return pairs


def quoted(text: str) -> str:
    plain = {v: k for k, v in _SIMPLE.items() if k != "'"}
    return '"' + "".join(f"\\{plain[c]}" if c in plain else c if c.isprintable() else f"\\u{ord(c):04x}" if ord(c) < 1 << 16 else f"\\U{ord(c):08x}" for c in text) + '"'


def tag_line(tags: dict[str, str]) -> str:
    """Canonical text of tags: keys sorted, values quoted where empty or holding a separator."""
    return ",".join(f"{k}={quoted(v) if not v or '=' in v or ',' in v else v}" for k, v in sorted(tags.items(), key=lambda x: x[0].encode()))


def fields_line(pairs: Iterable[tuple[str, str]]) -> str:
    """Text of fields in their order; values are quoted only where they hold a separator."""
    return ",".join(f"{k}={quoted(v) if '=' in v or ',' in v else v}" for k, v in pairs)


def is_subset(part: dict[str, str], whole: dict[str, str]) -> bool:
    return all(whole.get(k) == v for k, v in part.items())


def merge(pairs: Pairs, over: dict[str, str]) -> Pairs:
    """Fields with the given values put in place of their own, new names at the end."""
    return [*((k, over.get(k, v)) for k, v in pairs), *((k, v) for k, v in over.items() if k not in dict(pairs))]


def _quoted_column(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _separates(value: Column) -> Column:
    return value.contains("=") | value.contains(",")


def tag_line_column(tags: Column) -> Column:
    """tag_line of a map column, in Spark."""
    entries = F.array_sort(F.map_entries(tags))
    text = lambda e: F.concat(e["key"], F.lit("="), F.when((e["value"] == "") | _separates(e["value"]), _quoted_column(e["value"])).otherwise(e["value"]))
    return F.array_join(F.transform(entries, text), ",")


def tag_line_of(tags: dict[str, Column]) -> Column:
    """tag_line of columns by name. The names are known, so this is one concatenation that stays in generated code."""
    parts: list[Column] = []
    for k in sorted(tags, key=str.encode):
        v = tags[k]
        parts += [F.lit(("," if parts else "") + f"{k}="), F.when((v == "") | _separates(v), _quoted_column(v)).otherwise(v)]
    return F.concat(*parts)


def field_texts_column(fields: Column) -> Column:
    """Texts of an array of (k, v), one for each."""
    return F.transform(fields, lambda e: F.concat(e["k"], F.lit("="), F.when(_separates(e["v"]), _quoted_column(e["v"])).otherwise(e["v"])))


def fields_line_column(fields: Column) -> Column:
    """fields_line of an array of (k, v), in Spark."""
    return F.coalesce(F.array_join(field_texts_column(fields), ","), F.lit(""))


def field_value(fields: Column, name: str) -> Column:
    """Value of the first field of that name, "" where there is none."""
    return F.coalesce(F.get(F.filter(fields, lambda e: e["k"] == name), F.lit(0))["v"], F.lit(""))


def tag_value(tags: Column, name: str) -> Column:
    return F.coalesce(tags[name], F.lit(""))


def pairs_literal(pairs: Iterable[tuple[str, str]]) -> Column:
    """A literal array of (k, v)."""
    rows = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs]
    return (F.array(*rows) if rows else F.array()).cast("array<struct<k:string,v:string>>")
