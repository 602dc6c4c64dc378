import random
import re
from datetime import UTC, datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.errors import DateTimeError, StatementError, StatementSyntaxError, PatternError, UnknownOperandError, UnsupportedOperatorError
from tidewake.functions.glob import to_regex
from tidewake.language import compile as conditions
from tidewake.language.datetime import DateFinder, parse_literal, to_ns
from tidewake.language.parser import parse, parse_expression, parse_size, parse_source
from tidewake.model.kvtext import pairs_literal

# Statements put together from the grammar.
NAMES = st.sampled_from(["host", "zone", "fields:rack", "unit7", "msg", "lower(host)", "upper(fields:rack)"])
VALUES = st.sampled_from(["oslo", "'two words'", '"it\'s"', "'a\\\\b'", "42", "'from'", "'}'", "''", '"x,y=z"'])
COMPARISONS = st.builds("{} {} {}".format, NAMES, st.sampled_from(["=", "!=", "<", ">", "<=", ">=", "LIKE", "contains", "Prefix", "SUFFIX"]), VALUES)
EXPRESSIONS = st.recursive(COMPARISONS, lambda inner: st.one_of(st.builds("NOT ({})".format, inner), st.builds("{} and {}".format, inner, inner), st.builds("({} OR {})".format, inner, inner), st.builds("{} or not ({})".format, inner, inner)), max_leaves=5)
SOURCES_ = st.one_of(EXPRESSIONS, st.sampled_from(["{host=oslo}", "{host=oslo,zone='n w'}".replace("'", '"'), '{zone="}{"}']))
NUMBERS, TIMES = st.integers(0, 9999).map(str), st.sampled_from(["-3h", "-0.25d", "day", "2031-07-08 09:10:11", "1700000000000000000"])
SIZES = st.builds("{}{}".format, st.integers(1, 900), st.sampled_from(["", "k", "MiB", "Gb", "T"]))
PIPES = st.sampled_from(["nightly", "p2", "audit_log"])


def clause(word, what):
    return st.one_of(st.just(""), st.builds(f" {word} {{}}".format, what))


RANGES = st.one_of(st.builds("'{}'".format, TIMES), st.builds("['{}':'{}']".format, TIMES, TIMES), st.builds("[:'{}']".format, TIMES))
SELECTS = st.builds(
    "{}{}{}{}{}{}{}{}".format, st.sampled_from(["select", "SELECT", "Select '{ts} {msg}'", 'select "row: {vars:host}"']), clause("from", SOURCES_), clause("RANGE", RANGES), clause("where", EXPRESSIONS),
    clause("position", st.sampled_from(["head", "TAIL", "'abc_123'"])), clause("offset", st.one_of(NUMBERS, st.just("-15"))), clause("limit", st.one_of(NUMBERS, st.just("-2"))), st.just(""),
)
OTHERS = st.one_of(
    st.builds("show partitions{}{}{}".format, clause("", SOURCES_), clause("offset", NUMBERS), clause("limit", NUMBERS)), st.builds("Show PIPES{}{}".format, clause("offset", NUMBERS), clause("limit", NUMBERS)),
    st.builds("describe partition {}".format, st.sampled_from(["{host=oslo}", "{host=oslo,zone=3}"])), st.builds("{} pipe {}".format, st.sampled_from(["describe", "DELETE"]), PIPES),
    st.builds("create pipe {}{}{}".format, PIPES, clause("from", SOURCES_), clause("where", EXPRESSIONS)),
    st.builds("truncate{}{}{}{}{}{}".format, st.sampled_from(["", " dryrun"]), clause("", SOURCES_), clause("minsize", SIZES), clause("maxsize", SIZES), clause("before", TIMES.map("'{}'".format)), clause("maxdbsize", SIZES)),
)


@settings(max_examples=400, deadline=None)
@given(st.one_of(SELECTS, OTHERS))
def test_statements_survive_printing(text):
    once = parse(text)
    assert parse(str(once)) == once and str(parse(str(once))) == str(once)


def test_clauses():
    s = parse("seLECT 'fmt' from zone = n where rack = '7' Position TAIL offset -4 LIMIT 9")
    assert (s.format, s.position.lower(), s.offset, s.limit) == ("fmt", "tail", -4, 9)
    t = parse("truncate zone=n minsize 2M maxsize 12kib before '-4d' maxdbsize 1T")
    assert (t.min_size, t.max_size, t.before, t.max_db_size, t.dry_run) == (2 * 10**6, 12 << 10, "-4d", 10**12, False)
    assert [parse_size(x) for x in ("5G", "2Tb", "6GiB", "2.5k", "11")] == [5 * 10**9, 2 * 10**12, 6 << 30, 2500, 11]


@pytest.mark.parametrize("text", ["", "selec", "select where", "select where a", "select where a=", "select limit x", "show", "describe", "select from {a=b", "select where (a=b", "delete pipe", "select limit 1 offset 1", "select ?"])
def test_bad_statements(text):
    with pytest.raises(StatementSyntaxError):
        parse(text)


# Conditions against a plain evaluation of the same parts.
RECORD = {"ts": 5000, "msg": "Disk sda1 is FULL", "fields": [("rack", "r12"), ("unit", ""), ("twice", "one"), ("twice", "two")]}
TESTS = {"=": str.__eq__, "!=": str.__ne__, "<": str.__lt__, ">": str.__gt__, "<=": str.__le__, ">=": str.__ge__, "contains": str.__contains__, "prefix": str.startswith, "suffix": str.endswith}


def _first(pairs, name):
    return next((v for k, v in pairs if k == name), "")


def _cases(pairs, operands, words):
    rng = random.Random(11)
    out = []
    for _ in range(120):
        name, change = rng.choice(operands), rng.choice(["", "", "upper", "lower"])
        value = _first(pairs, name.removeprefix("fields:"))
        value = value.upper() if change == "upper" else value.lower() if change == "lower" else value
        op = rng.choice(["contains", "prefix", "suffix"] if name == "msg" else list(TESTS))
        word = rng.choice([w for w in words if w or op in ("=", "!=")])
        out.append((f"{change}({name}) {op} '{word}'" if change else f"{name} {op} '{word}'", TESTS[op](value, word)))
    return out


def _joined(cases):
    """Pairs of conditions under AND, OR and NOT."""
    return [
        *cases, *((f"{p} and {q}", x and y) for (p, x), (q, y) in zip(cases, cases[7:], strict=False)), *((f"not ({p} or {q})", not (x or y)) for (p, x), (q, y) in zip(cases, cases[3:], strict=False)),
        *((f"{p} or {q} and not {r}", x or (y and not z)) for (p, x), (q, y), (r, z) in zip(cases, cases[1:], cases[5:], strict=False)),
    ]


def _settled(row, condition, cases):
    for k in range(0, len(cases), 60):
        part = cases[k : k + 60]
        got = row.select(*(condition(e).alias(f"c{j}") for j, (e, _) in enumerate(part))).first()
        assert [(e, got[j]) for j, (e, _) in enumerate(part)] == part


def test_where_is_what_its_parts_are(spark):
    row = spark.range(1).select(F.lit(RECORD["ts"]).cast("long").alias("ts_ns"), F.lit(RECORD["msg"]).alias("msg"), pairs_literal(RECORD["fields"]).alias("fields_kv"))
    pairs = [("msg", RECORD["msg"]), *RECORD["fields"]]
    cases = _cases(pairs, ["msg", "fields:rack", "fields:unit", "fields:twice", "fields:nowhere"], ["Disk", "disk", "FULL", "full", "r12", "R12", "one", "two", "s", ""])
    times = [(f"ts {op} {n}", test(5000, n)) for op, test in (("<", int.__lt__), (">", int.__gt__), ("<=", int.__le__), (">=", int.__ge__)) for n in (4999, 5000, 5001)]
    globs = [("msg like 'Disk*'", True), ("msg LIKE 'disk*'", False), ("lower(msg) like '*full'", True), ("fields:rack like 'r[0-3]?'", True), ("fields:nowhere like '?*'", False)]
    _settled(row, lambda e: conditions.where_condition(parse_expression(e)), _joined(cases + times + globs))


def test_sources_are_what_their_parts_are(spark):
    tags = {"zone": "north", "host": "Ab-3", "tier": "2"}
    row = spark.range(1).select(F.create_map(*(F.lit(x) for kv in tags.items() for x in kv)).alias("tags"))
    cases = _cases(list(tags.items()), ["zone", "host", "tier", "nowhere"], ["north", "NORTH", "Ab-3", "ab-3", "n", "2", "3", ""])
    sets = [(sorted(x), all(tags.get(k) == v for k, v in x)) for x in ([("zone", "north")], [("tier", "2"), ("host", "Ab-3")], [*tags.items()], [("zone", "north"), ("tier", "3")], [("other", "north")])]
    braces = [("{" + ",".join(f"{k}={v}" for k, v in x) + "}", met) for x, met in sets]
    for cases_ in (_joined(cases), [*braces, ("nowhere=''", True), ('{nowhere=""}', False), ("host like '[A-C]?-[0-9]'", True)]):
        _settled(row, lambda e: conditions.source_condition(parse_source(e)), cases_)


@pytest.mark.parametrize(
    "text,error",
    [("ts = 1", UnsupportedOperatorError), ("upper(ts) < 1", UnsupportedOperatorError), ("msg = x", UnsupportedOperatorError), ("other = x", UnknownOperandError), ("fields: = x", UnknownOperandError), ("trim(msg) like x", UnknownOperandError), ("upper(msg, msg) like x", UnknownOperandError), ("ts < nonsense", DateTimeError), ("msg like '[a'", PatternError)],
)
def test_errors_show_before_a_job(spark, text, error):
    with pytest.raises(error) as e:
        conditions.where_condition(parse_expression(text))
    assert isinstance(e.value, StatementError)


def _matches(glob: str, text: str) -> bool:
    """Plain backtracking matcher of globs."""
    if not glob:
        return not text
    c = glob[0]
    if c == "*":
        return _matches(glob[1:], text) or (bool(text) and text[0] != "/" and _matches(glob, text[1:]))
    if not text:
        return False
    if c == "?":
        return text[0] != "/" and _matches(glob[1:], text[1:])
    if c == "\\":
        return text[0] == glob[1] and _matches(glob[2:], text[1:])
    return c == text[0] and _matches(glob[1:], text[1:])


@settings(max_examples=400)
@given(st.text("ab*?/.\n$^", max_size=7), st.text("ab/.\n$^", max_size=8))
def test_globs(glob, text):
    assert bool(re.search(to_regex(glob).replace(r"\z", r"\Z"), text)) == _matches(glob, text)


@pytest.mark.parametrize("glob,text,expected", [("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "/x", True), ("a[]", "a", None), ("a[", "a", None), ("a\\", "a", None), ("[\\]]", "]", True), ("[a-]", "a", None), ("*", "a\n", True)])
def test_glob_classes(glob, text, expected):
    if expected is None:
        with pytest.raises(PatternError):
            to_regex(glob)
    else:
        assert bool(re.search(to_regex(glob).replace(r"\z", r"\Z"), text)) is expected


NOW = datetime(2026, 10, 22, 17, 8, 31, 250000, tzinfo=UTC)  # a Thursday


def utc(*parts):
    return datetime(*parts, tzinfo=UTC)


LITERALS = [
    ("-0.5d", NOW - timedelta(hours=12)), ("-90M", NOW - timedelta(minutes=90)), ("-3h", NOW - timedelta(hours=3)), ("Minute", utc(2026, 10, 22, 17, 8)), ("  hour ", utc(2026, 10, 22, 17)), ("DAY", utc(2026, 10, 22)), ("Week", utc(2026, 10, 18)),
    ("2021-12-31 23:59:58", utc(2021, 12, 31, 23, 59, 58)), ("2021-12-31T23:59:58Z", utc(2021, 12, 31, 23, 59, 58)), ("2022-03-01 01:00:00 -0330", utc(2022, 3, 1, 4, 30)), ("09:40 +0200", utc(2026, 10, 22, 7, 40)), ("2020-02-29", utc(2020, 2, 29)),
    ("Jan 30 06:07:08", utc(2026, 1, 30, 6, 7, 8)), ("Nov 30 06:07:08", utc(2025, 11, 30, 6, 7, 8)), ("05/Jul/2023:00:10:20 +0100", utc(2023, 7, 4, 23, 10, 20)),
]


@pytest.mark.parametrize("text,moment", LITERALS)
def test_literals(text, moment):
    assert parse_literal(text, NOW) == to_ns(moment)


def test_literal_kinds():
    assert parse_literal("123", NOW) == 123
    assert parse_literal("2021-06-07 08:09:10.987654321 +0000", NOW) % 10**9 == 987654321
    assert parse_literal("day", NOW, timezone(timedelta(hours=-9))) == to_ns(utc(2026, 10, 22, 9))
    for bad in ("- 7 d", "-7 D", "someday", ""):
        with pytest.raises(DateTimeError):
            parse_literal(bad, NOW)


def test_dates_within_lines():
    finder = DateFinder(["YYYY.MM.DD"], NOW)
    assert finder.find("x 2020.02.03 y")[1].text == "YYYY.MM.DD"
    assert finder.find('192.0.2.9 - - [03/Sep/2022:04:05:06 +0000] "PUT /x"')[0] == to_ns(utc(2022, 9, 3, 4, 5, 6))
    assert finder.find("Mar  4 05:06:07 box daemon: x")[0] == to_ns(utc(2026, 3, 4, 5, 6, 7))
    assert finder.find("no date") is None
