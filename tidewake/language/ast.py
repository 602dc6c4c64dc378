"""Statements of the query language; str() of each is a statement that parses to an equal one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import kvtext


def quote(text: str) -> str:
    """A string literal of the language."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


@dataclass(frozen=True)
class Operand:
    """A name, or a function of operands."""

    name: str
    args: tuple[Operand, ...] = ()

    def __str__(self) -> str:
        return self.name + (f"({', '.join(map(str, self.args))})" if self.args else "")


@dataclass(frozen=True)
class Condition:
    operand: Operand
    op: str
    value: str

    def __str__(self) -> str:
        return f"{self.operand} {self.op} {quote(self.value)}"


@dataclass(frozen=True)
class Not:
    what: Condition | Any_

    def __str__(self) -> str:
        return f"NOT {self.what if isinstance(self.what, Condition) else f'({self.what})'}"


@dataclass(frozen=True)
class All:
    """Parts joined by AND."""

    parts: tuple

    def __str__(self) -> str:
        return " AND ".join(f"({p})" if isinstance(p, Any_) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Any_:
    """Alternatives joined by OR."""

    parts: tuple

    def __str__(self) -> str:
        return " OR ".join(map(str, self.parts))


@dataclass(frozen=True)
class Tags:
    """A set of tags within braces."""

    tags: tuple[tuple[str, str], ...]

    def __str__(self) -> str:
        return "{" + ",".join(f"{k}={v if re.fullmatch(r'[\w./:-]+', v) else kvtext.quoted(v)}" for k, v in self.tags) + "}"


Source = Tags | Any_


@dataclass(frozen=True)
class Range:
    """Date-time literals; both ends are included."""

    start: str | None = None
    end: str | None = None

    def __str__(self) -> str:
        if self.end is None:
            return f"RANGE {quote(self.start)}" if self.start is not None else "RANGE"
        return f"RANGE [{quote(self.start) if self.start is not None else ''}:{quote(self.end)}]"


def _clauses(*parts: tuple[str, object]) -> str:
    return "".join(f" {name} {value}" for name, value in parts if value is not None)


@dataclass(frozen=True)
class Select:
    format: str | None = None
    source: Source | None = None
    range: Range | None = None
    where: Any_ | None = None
    position: str | None = None
    offset: int | None = None
    limit: int | None = None

    def __str__(self) -> str:
        head = "SELECT" + (f" {quote(self.format)}" if self.format is not None else "") + _clauses(("FROM", self.source))
        head += f" {self.range}" if self.range else ""
        position = None if self.position is None else quote(self.position)
        return head + _clauses(("WHERE", self.where), ("POSITION", position), ("OFFSET", self.offset), ("LIMIT", self.limit))


@dataclass(frozen=True)
class Describe:
    tags: Tags | None = None
    pipe: str | None = None

    def __str__(self) -> str:
        return f"DESCRIBE PIPE {self.pipe}" if self.pipe is not None else f"DESCRIBE PARTITION {self.tags}"


@dataclass(frozen=True)
class Show:
    what: str = "PARTITIONS"
    source: Source | None = None
    offset: int | None = None
    limit: int | None = None

    def __str__(self) -> str:
        return f"SHOW {self.what}" + (f" {self.source}" if self.source else "") + _clauses(("OFFSET", self.offset), ("LIMIT", self.limit))


@dataclass(frozen=True)
class Truncate:
    dry_run: bool = False
    source: Source | None = None
    min_size: int | None = None
    max_size: int | None = None
    before: str | None = None
    max_db_size: int | None = None

    def __str__(self) -> str:
        head = "TRUNCATE" + (" DRYRUN" if self.dry_run else "") + (f" {self.source}" if self.source else "")
        before = None if self.before is None else quote(self.before)
        return head + _clauses(("MINSIZE", self.min_size), ("MAXSIZE", self.max_size), ("BEFORE", before), ("MAXDBSIZE", self.max_db_size))


@dataclass(frozen=True)
class CreatePipe:
    name: str
    source: Source | None = None
    where: Any_ | None = None

    def __str__(self) -> str:
        return f"CREATE PIPE {self.name}" + _clauses(("FROM", self.source), ("WHERE", self.where))


@dataclass(frozen=True)
class DeletePipe:
    name: str

    def __str__(self) -> str:
        return f"DELETE PIPE {self.name}"


Statement = Select | Describe | Show | Truncate | CreatePipe | DeletePipe
