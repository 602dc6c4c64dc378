"""Shell globs as regular expressions."""

from __future__ import annotations

from ..errors import PatternError

_SPECIAL = set(r"\^$.|?*+()[]{}&~-#")


def _literal(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def to_regex(glob: str) -> str:
    """A Java (and Python) regular expression that takes what the glob takes, as a whole.

    `*` is any run without `/`, `?` one character but `/`, `[a-z]` and `[^a-z]` classes, and a
    backslash makes the next character literal. A line feed is a character as any other.
    """
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i >= n:
                raise PatternError(f"a backslash ends the pattern {glob!r}")
            out.append(_literal(glob[i]))
            i += 1
        elif c == "[":
            part, i = _class(glob, i)
            out.append(part)
        else:
            out.append(_literal(c))
    return r"\A(?:" + "".join(out) + r")\z"


def _class(glob: str, i: int) -> tuple[str, int]:
    """The class that opened before i, and where it ends."""

    def char(i: int) -> tuple[str, int]:
        if i >= len(glob) or glob[i] in "-]":
            raise PatternError(f"a class is malformed in {glob!r}")
        if glob[i] == "\\":
            i += 1
            if i >= len(glob):
                raise PatternError(f"a backslash ends the pattern {glob!r}")
        return glob[i], i + 1

    negated = i < len(glob) and glob[i] == "^"
    i += negated
    parts = []
    while True:
        if i >= len(glob):
            raise PatternError(f"a class does not close in {glob!r}")
        if glob[i] == "]" and parts:
            break
        low, i = char(i)
        high = low
        if i < len(glob) and glob[i] == "-":
            high, i = char(i + 1)
        if low <= high:
            parts.append(_literal(low) if low == high else f"{_literal(low)}-{_literal(high)}")
        else:
            parts.append("")  # an empty span holds nothing
    body = "".join(parts)
    if not body:
        return (r"[\s\S]" if negated else r"(?!)"), i + 1
    return f"[{'^' if negated else ''}{body}]", i + 1
