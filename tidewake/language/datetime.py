"""Date-time literals and the dates of log lines.

A pattern such as `YYYY-MM-DD HH:mm:ss.SSS` becomes a regular expression with named parts. Texts are
matched with their case kept; a literal prefers a pattern that takes all of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta, timezone, tzinfo
from functools import lru_cache

from ..errors import DateTimeError

NS = 1_000_000_000
#: Date patterns of log lines, in the order in which they are tried.
LINE_PATTERNS = """
MMM D, YYYY h:mm:ss P
DDD MMM _D HH:mm:ss YYYY
DDD MMM _D HH:mm:ss MST YYYY
DDD MMM DD HH:mm:ss ZZZZ YYYY
DDDD, YY-MMM-DD HH:mm:ss ZZZ
DDD, DD MMM YYYY HH:mm:ss ZZZ
DDD, DD MMM YYYY HH:mm:ss ZZZZ
DDD, D MMM YYYY HH:mm:ss ZZZZ
DD MMM YYYY, HH:mm
YYYY-MMM-DD
DD MMMM YYYY
DD/MM/YYYY HH:mm:ss.SSS
DD/MM/YYYY HH:mm:ss
D/MM/YYYY HH:mm:ss
DD/M/YYYY HH:mm:ss
D/M/YYYY HH:mm:ss
D/M/YYYY hh:mm:ss P
DD/MM/YYYY HH:mm
D/M/YYYY HH:mm
D/M/YY HH:mm
D/M/YYYY hh:mm P
D/M/YYYY h:mm P
DD/MMM/YYYY:HH:mm:ss ZZZZ
DD/MM/YYYY
D/MM/YYYY
DD/MM/YY
D/M/YY
YYYY/MM/DD HH:mm:ss.SSS
YYYY/MM/DD HH:mm:ss
YYYY/MM/D HH:mm:ss
YYYY/M/DD HH:mm:ss
YYYY/MM/DD HH:mm
YYYY/M/D HH:mm
YYYY/MM/DD
YYYY/M/DD
YYYY-MM-DDTHH:mm:ss.SSSZZZZ
YYYY-MM-DDTHH:mm:ss.SSSZ
YYYY-MM-DDTHH:mm:ssZZZZZ
YYYY-MM-DDTHH:mm:ssZZZZ
YYYY-MM-DDTHH:mm:ssZ
YYYY-MM-DDTHH:mm:ss
YYYY-MM-DD HH:mm:ss.SSS ZZZZ ZZZ
YYYY-MM-DD HH:mm:ss.SSS
YYYY-MM-DD HH:mm:ss ZZZZZ
YYYY-MM-DD HH:mm:ssZZZZZ
YYYY-MM-DD HH:mm:ss ZZZZ ZZZ
YYYY-MM-DD HH:mm:ss ZZZZ
YYYY-MM-DD HH:mm:ss ZZZ
YYYY-MM-DD hh:mm:ss P
YYYY-MM-DD HH:mm:ss
YYYY-MM-DD  HH:mm:ss
YYYY-MM-DD HH:mm
YYYY-MM-DD
MM.DD.YYYY
MM.DD.YY
DDD MMM _D HH:mm:ss.SSS
DDD MMM DD HH:mm:ss.SSS
MMM DD HH:mm:ss
MMM _D HH:mm:ss
""".strip("\n").split("\n")
#: What literals take besides.
LITERAL_PATTERNS = """
YYYY-MM-DD HH:mm:ss.SSS ZZZZ
HH:mm:ss.SSS ZZZZ
HH:mm:ss ZZZZ
HH:mm ZZZZ
HH:mm:ss.SSS ZZZ
HH:mm:ss ZZZ
HH:mm ZZZ
HH:mm:ss.SSS
HH:mm:ss
HH:mm
""".strip("\n").split("\n")

_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_names = lambda names: "|".join(names)
#: Terms of patterns, the longer first: part, expression.
_TERMS = [
    ("YYYY", "year", r"[12]\d{3}"),
    ("YY", "year2", r"\d{2}"),
    ("MST", "zone", r"[A-Z]{3}"),
    ("MMMM", "month_name", _names(_MONTHS)),
    ("MMM", "month_name", _names([m[:3] for m in _MONTHS])),
    ("MM", "month", r"[0-3]\d"),
    ("M", "month", r"\d{1,2}"),
    ("DDDD", "day_name", _names(_DAYS)),
    ("DDD", "day_name", _names([d[:3] for d in _DAYS])),
    ("DD", "day", r"\d{2}"),
    ("_D", "day", r" \d|\d{2}"),
    ("D", "day", r"\d{1,2}"),
    ("HH", "hour", r"\d{2}"),
    ("hh", "hour12", r"\d{2}"),
    ("h", "hour12", r"\d{1,2}"),
    ("mm", "minute", r"\d{2}"),
    ("m", "minute", r"\d{1,2}"),
    ("ss", "second", r"\d{2}"),
    ("s", "second", r"\d{1,2}"),
    (".SSS", "fraction", r"[.,]\d{3,9}"),
    ("P", "half", r"[aApP][mM]"),
    ("ZZZZZ", "offset", r"[+-]\d{2}:\d{2}"),
    ("ZZZZ", "offset", r"[+-]\d{4}"),
    ("ZZZ", "zone", r"[A-Z]{3}"),
    ("ZZ", "offset", r"Z\d{2}:\d{2}"),
    ("Z", "zulu", r"Z"),
]
#: Hours from UTC of zone names that are no regions; others count as UTC.
_ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "EET": 2}


@dataclass(frozen=True)
class Pattern:
    """A compiled date pattern."""

    text: str
    regex: re.Pattern
    has_date: bool
    has_year: bool
    literals: frozenset[str] = frozenset()
    has_digit: bool = False

    def find(self, text: str, now: datetime, whole: bool = False) -> int | None:
        """Nanoseconds of the leftmost match, None without one or where it is no date."""
        match = self.regex.fullmatch(text) if whole else self.regex.search(text)
        return _nanoseconds({k: v for k, v in match.groupdict().items() if v is not None}, self, now) if match else None


@lru_cache(maxsize=512)
def compile_pattern(text: str) -> Pattern:
    parts, at, seen, literals = [], 0, set(), set()
    while at < len(text):
        for term, part, expression in _TERMS:
            if text.startswith(term, at):
                parts.append(f"(?P<{part}>{expression})" if part not in seen else f"(?:{expression})")
                seen.add(part)
                at += len(term)
                break
        else:
            parts.append(re.escape(text[at]))
            literals.add(text[at])
            at += 1
    has_date, has_year = bool(seen & {"year", "year2", "month", "month_name", "day"}), bool(seen & {"year", "year2"})
    return Pattern(text, re.compile("".join(parts)), has_date, has_year, frozenset(literals), bool(seen - {"month_name", "day_name", "zone", "half", "zulu"}))


def _nanoseconds(parts: dict[str, str], pattern: Pattern, now: datetime) -> int | None:
    hour = int(parts.get("hour", 0))
    if "hour12" in parts:
        hour = int(parts["hour12"])
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (parts.get("half", "am").lower() == "pm")
    month = int(parts.get("month", 1))
    if "month_name" in parts:
        month = 1 + next(i for i, m in enumerate(_MONTHS) if m.startswith(parts["month_name"]))
    year = int(parts.get("year", 1970))
    if "year2" in parts:
        year = int(parts["year2"])
        year += 1900 if year >= 69 else 2000
    zone: tzinfo = UTC
    if "offset" in parts:
        digits = parts["offset"][1:].replace(":", "")
        minutes = int(digits[:2]) * 60 + int(digits[2:])
        zone = timezone(timedelta(minutes=-minutes if parts["offset"][0] == "-" else minutes))
    elif "zone" in parts:
        zone = timezone(timedelta(hours=_ZONES.get(parts["zone"], 0)))
    day = int(parts.get("day", 1))
    try:
        if not pattern.has_date:
            today = now.astimezone(zone)
            year, month, day = today.year, today.month, today.day
        elif not pattern.has_year:
            year = now.year
            if datetime(year, month, day, hour, tzinfo=zone) > now + timedelta(days=1):
                year -= 1  # a date without a year that is still to come was last year's
        moment = datetime(year, month, day, hour, int(parts.get("minute", 0)), int(parts.get("second", 0)), tzinfo=zone)
    except (ValueError, OverflowError):
        return None
    fraction = int(parts["fraction"][1:].ljust(9, "0")) if "fraction" in parts else 0
    return to_ns(moment) + fraction


def to_ns(moment: datetime) -> int:
    """Nanoseconds since 1970 of an aware date-time."""
    d = moment - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * NS + d.microseconds * 1000


class DateFinder:
    """Finds dates in lines: the caller's patterns are tried first.

    A pattern is left out where the line has none of a character that the pattern always takes, or
    no digit at all: it can't match there.
    """

    def __init__(self, patterns: list[str] | None = None, now: datetime | None = None):
        self.patterns = [compile_pattern(p) for p in [*(patterns or []), *LINE_PATTERNS]]
        self.now = now or datetime.now(UTC)
        self._literals = sorted(set().union(*(p.literals for p in self.patterns)))
        self._digit = re.compile(r"\d")
        self._possible: dict[tuple[bool, ...], list[Pattern]] = {}

    def possible(self, line: str) -> list[Pattern]:
        """The patterns that may match a line, in order."""
        has = (self._digit.search(line) is not None, *[c in line for c in self._literals])
        if has not in self._possible:
            there = {c for c, y in zip(self._literals, has[1:], strict=True) if y}
            self._possible[has] = [p for p in self.patterns if p.literals <= there and has[0] >= p.has_digit]
        return self._possible[has]

    def find(self, line: str) -> tuple[int, Pattern] | None:
        for pattern in self.possible(line):
            ns = pattern.find(line, self.now)
            if ns is not None:
                return ns, pattern
        return None


_UNIT_NS = {"m": 60 * NS, "h": 3600 * NS, "d": 86400 * NS}


def _floor(word: str, now: datetime) -> datetime | None:
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    match word:
        case "minute":
            return now.replace(second=0, microsecond=0)
        case "hour":
            return now.replace(minute=0, second=0, microsecond=0)
        case "day":
            return day
        case "week":  # weeks start on Sunday
            return day - timedelta(days=(now.weekday() + 1) % 7)
    return None


def parse_literal(text: str, now: datetime | None = None, zone: tzinfo = UTC) -> int:
    """Nanoseconds of a literal: relative (-1.5h), named (minute, hour, day, week), a date, or an integer of nanoseconds."""
    now = (now or datetime.now(UTC)).astimezone(zone)
    given = text.strip()
    relative = re.fullmatch(r"-(\d*\.?\d+)([mhd])", given.lower())
    if relative:
        return to_ns(now) - int(float(relative[1]) * _UNIT_NS[relative[2]])
    named = _floor(given.lower(), now)
    if named:
        return to_ns(named)
    patterns = [compile_pattern(p) for p in (*LINE_PATTERNS, *LITERAL_PATTERNS)]
    for whole in (True, False):
        if not whole and re.fullmatch(r"-?\d+", given):
            return int(given)
        for pattern in patterns:
            ns = pattern.find(given, now, whole)
            if ns is not None:
                return ns
    raise DateTimeError(f"not a date-time: {text!r}")
