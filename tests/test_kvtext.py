import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.model import kvtext

KEYS = st.text("klmNOP_9", min_size=1, max_size=6)
BARE = st.text("uvwXYZ-./ 0", min_size=1, max_size=8).map(lambda v: v.strip(" ") or "u")
SPACE = st.sampled_from(["", " ", "   "])


@given(st.text("ghij k", min_size=1, max_size=9).map(lambda t: t.strip(" ") or "g"), st.integers(0, 3), SPACE, SPACE, SPACE)
def test_braces(body, depth, before, between, behind):
    text = before + f"{{{between}" * depth + body + f"{between}}}" * depth + behind
    assert kvtext.strip_braces(text) == body
    for broken in ("{" + text, text + "}"):
        with pytest.raises(ValueError):
            kvtext.strip_braces(broken)


@given(st.lists(st.tuples(KEYS, st.one_of(BARE, st.text(max_size=9))), min_size=1, max_size=5), SPACE)
@settings(max_examples=300)
def test_pairs_as_they_are_written(pairs, space):
    """Quoted wherever a bare value would not read back."""

    def written(value):
        return value if value and set(value) <= set("uvwXYZ-./0 ") and value == value.strip(" ") else kvtext.quoted(value)

    text = f",{space}".join(f"{k}{space}={space}{written(v)}" for k, v in pairs)
    assert kvtext.parse_pairs(text) == pairs == kvtext.parse_pairs("{ " + text + "}")
    assert kvtext.parse_tags(text) == dict(pairs)
    assert [x.strip(" ") for x in kvtext.split_pairs(text)] == [x for k, v in pairs for x in (k, written(v))]
    with pytest.raises(ValueError):
        kvtext.parse_pairs(text + ",loose")
    with pytest.raises(ValueError):
        kvtext.parse_pairs(text + ',k="open')


@pytest.mark.parametrize("text", ["=v", "k=1,=2", "k", "k=1=2", "k,l=1", 'k="1', 'k=1"2', 'k="a"b"'])
def test_bad_pairs(text):
    with pytest.raises(ValueError):
        kvtext.parse_pairs(text)


@pytest.mark.parametrize("text,pairs", [("", []), ("k=", [("k", "")]), ("k=`a\\b`", [("k", "a\\b")]), ('k="\\u00e9\\n"', [("k", "é\n")]), ("k=/'v'", [("k", "/'v'")]), ('k=x"y,z"', [("k", 'x"y,z"')])])
def test_pairs(text, pairs):
    assert kvtext.parse_pairs(text) == pairs


@given(st.dictionaries(KEYS, st.sampled_from(["plain", "", "w=1", "left,right", "two words"]), max_size=5))
def test_tag_lines_are_sorted_and_quoted_where_needed(tags):
    line = kvtext.tag_line(tags)
    assert kvtext.parse_tags(line) == tags and line == kvtext.tag_line(dict(reversed(tags.items())))
    assert line.count('"') == 2 * sum(v == "" or "=" in v or "," in v for v in tags.values())
    assert [k for k, _ in kvtext.parse_pairs(line)] == sorted(tags)


def test_fields_keep_order_and_duplicates():
    pairs = [("zeta", "9"), ("alpha", "x,y=z"), ("zeta", "8"), ("none", "")]
    assert kvtext.fields_line(pairs) == 'zeta=9,alpha="x,y=z",zeta=8,none='
    assert kvtext.parse_fields(kvtext.fields_line(pairs)) == pairs
    assert kvtext.parse_fields("k=" + "é" * 127)[0][1] == "é" * 127
    for over in ("k=" + "é" * 128, "k" * 256 + "=v"):
        with pytest.raises(ValueError):
            kvtext.parse_fields(over)


@given(st.dictionaries(KEYS, BARE, max_size=4), st.dictionaries(KEYS, BARE, max_size=4))
def test_subset_and_merge(a, b):
    assert kvtext.is_subset(a, a | {}) and kvtext.is_subset(a, b | a) and kvtext.is_subset(a, b) == (set(a.items()) <= set(b.items()))
    merged = kvtext.merge(list(a.items()), b)
    assert dict(merged) == a | b and [k for k, _ in merged] == [*a, *(k for k in b if k not in a)]


@given(st.dictionaries(st.text("abcXYZ_", min_size=1, max_size=5), st.text(max_size=8), max_size=4))
def test_tag_line_round_trip(tags):
    # Bare values can't hold outer spaces, quotes or braces: those are only kept where a separator makes them quoted.
    if all("=" in v or "," in v or not v or v.isalnum() for v in tags.values()):
        assert kvtext.parse_tags(kvtext.tag_line(tags)) == tags


def test_columns_agree(spark):
    from pyspark.sql import functions as F

    values = ["plain", "", "a=b", "a,b", 'q"u=', "back\\sl,ash", "line\n,feed"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v string")
    out = rows.select("v", kvtext.tag_line_column(F.create_map(F.lit("t"), "v", F.lit("a"), F.lit("x"))).alias("line"), kvtext.fields_line_column(F.array(F.struct(F.lit("f").alias("k"), F.col("v").alias("v")))).alias("fields")).collect()
    for r in out:
        assert r["line"] == kvtext.tag_line({"t": r["v"], "a": "x"})
        assert r["fields"] == kvtext.fields_line([("f", r["v"])])
