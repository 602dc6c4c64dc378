"""FROM and WHERE as Spark conditions.

Logic is two-valued: a tag or field that is missing reads as "", so no condition is ever null.
"""

from __future__ import annotations

from datetime import datetime, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnknownOperandError, UnsupportedOperatorError
from ..functions.glob import to_regex
from ..model.kvtext import field_value, tag_value
from ..model.schema import MAX_NS, MIN_NS
from . import ast
from .datetime import parse_literal

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    ">=": lambda c, v: c >= v,
}
_TEXT = {
    "CONTAINS": lambda c, v: c.contains(v),
    "PREFIX": lambda c, v: c.startswith(v),
    "SUFFIX": lambda c, v: c.endswith(v),
    "LIKE": lambda c, v: c.rlike(to_regex(v)),
}


def _holds(what, condition) -> Column:
    """An expression tree, with `condition` for its leaves."""
    match what:
        case ast.Condition():
            return condition(what)
        case ast.Not(inner):
            return ~_holds(inner, condition)
        case ast.All(parts) | ast.Any_(parts):
            found = [_holds(p, condition) for p in parts]
            out = found[0]
            for other in found[1:]:
                out = out & other if isinstance(what, ast.All) else out | other
            return out
    raise TypeError(f"not an expression: {what!r}")


def _applied(operand: ast.Operand, leaf) -> Column:
    """An operand with its functions applied; `leaf` makes the column of a name."""
    if not operand.args:
        return leaf(operand.name)
    function = {"upper": F.upper, "lower": F.lower}.get(operand.name.lower())
    if not function:
        raise UnknownOperandError(f"no function {operand.name}: there are upper and lower")
    if len(operand.args) != 1:
        raise UnknownOperandError(f"{operand.name} takes one argument")
    return function(_applied(operand.args[0], leaf))


def source_condition(source: ast.Source | None, tags: str = "tags") -> Column:
    """Whether a partition belongs to a source."""
    column = F.col(tags)
    if source is None:
        return F.lit(True)
    if isinstance(source, ast.Tags):
        out = F.lit(True)
        for k, v in source.tags:  # a tag that is missing is not the same as an empty one here
            out = out & F.coalesce(column[k] == v, F.lit(False))
        return out

    def condition(c: ast.Condition) -> Column:
        value = _applied(c.operand, lambda name: tag_value(column, name))
        return {**_COMPARE, **_TEXT}[c.op](value, c.value)

    return _holds(source, condition)


def where_condition(where: ast.Any_ | None, now: datetime | None = None, zone: tzinfo | None = None) -> Column:
    """Whether a record meets the conditions on ts, msg and fields."""
    if where is None:
        return F.lit(True)
    times = {k: v for k, v in (("now", now), ("zone", zone)) if v is not None}

    def leaf(name: str) -> Column:
        if name.lower() == "msg":
            return F.col("msg")
        if name.lower().startswith("fields:") and len(name) > len("fields:"):
            return field_value(F.col("fields_kv"), name[len("fields:") :])
        raise UnknownOperandError(f"no operand {name}: there are ts, msg and fields:<name>")

    def innermost(operand: ast.Operand) -> str:
        return innermost(operand.args[0]) if operand.args else operand.name

    def condition(c: ast.Condition) -> Column:
        name = innermost(c.operand).lower()
        if name == "ts":
            if c.operand.args:
                raise UnsupportedOperatorError("functions don't apply to ts")
            if c.op not in ("<", ">", "<=", ">="):
                raise UnsupportedOperatorError(f"ts has no operator {c.op}: there are <, >, <= and >=")
            return _COMPARE[c.op](F.col("ts_ns"), F.lit(parse_literal(c.value, **times)))
        value = _applied(c.operand, leaf)
        if name == "msg" and c.op not in _TEXT:
            raise UnsupportedOperatorError(f"msg has no operator {c.op}: there are {', '.join(_TEXT)}")
        return {**_COMPARE, **_TEXT}[c.op](value, c.value)

    return _holds(where, condition)


def range_bounds(range_: ast.Range | None, now: datetime | None = None, zone: tzinfo | None = None) -> tuple[int, int]:
    """Inclusive bounds in nanoseconds; an absent start is 0, an absent end the largest time; no range has no bounds."""
    if range_ is None:
        return MIN_NS, MAX_NS
    times = {k: v for k, v in (("now", now), ("zone", zone)) if v is not None}
    start = parse_literal(range_.start, **times) if range_.start is not None else 0
    return start, parse_literal(range_.end, **times) if range_.end is not None else MAX_NS


def range_condition(bounds: tuple[int, int]) -> Column | None:
    """The bounds on the stored time, so that they reach the scan; None without any."""
    low, high = bounds
    parts = [*([F.col("ts_ns") >= low] if low != MIN_NS else []), *([F.col("ts_ns") <= high] if high != MAX_NS else [])]
    return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else None
