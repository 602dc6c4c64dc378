"""Parser of the query language: a scanner that takes the longest token, and recursive descent."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import StatementSyntaxError
from ..model import kvtext
from . import ast

#: The words of the language, in any case.
KEYWORDS = set(
    "SELECT DESCRIBE TRUNCATE DELETE DRYRUN BEFORE MAXSIZE MINSIZE MAXDBSIZE FROM RANGE WHERE PARTITIONS PARTITION PIPES SHOW CREATE PIPE POSITION LIMIT OFFSET AND OR LIKE CONTAINS PREFIX SUFFIX NOT".split()
)
WORD_OPERATORS = {"CONTAINS", "PREFIX", "SUFFIX", "LIKE"}
SIGN_OPERATORS = {"<", ">", "<=", ">=", "!=", "="}
#: Size units, decimal and binary.
UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "p": 10**15, "pb": 10**15}
UNITS |= {f"{u}ib": 1 << (10 * (k + 1)) for k, u in enumerate("kmgtp")} | {f"{u}i": 1 << (10 * (k + 1)) for k, u in enumerate("kmgtp")}

_KINDS = {
    "ident": re.compile(r"[a-zA-Z_][a-zA-Z0-9_./:\-]*"),
    "string": re.compile(r'"(?:[^\\"]|\\.)*"|\'[^\']*\'', re.S),
    "number": re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+|[mMkKgGtTbBpP][iIbB]{0,2})?"),
    "sign": re.compile(r"<>|!=|<=|>=|[-+*/%,.=<>()\[\]:]"),
}


class Token(NamedTuple):
    kind: str  # keyword, ident, string, number, sign, tags or end
    text: str
    at: int


def _tags_end(text: str, at: int) -> int:
    """Where the braces that open at `at` close, quotes aside."""
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if not depth:
                return i + 1
        i += 1
    raise StatementSyntaxError(f"braces that open at {at} don't close: {text[at:at + 40]}")


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == "{":
            end = _tags_end(text, at)
            found.append(Token("tags", text[at:end], at))
            at = end
            continue
        kind, match = max(((k, p.match(text, at)) for k, p in _KINDS.items()), key=lambda x: x[1].end() if x[1] else -1)
        if not match:
            raise StatementSyntaxError(f"unexpected {text[at]!r} at {at}")
        word = match[0]
        if kind == "ident" and word.upper() in KEYWORDS:
            kind = "keyword"
        if kind == "string":
            try:
                word = kvtext.unquote(word) if word[0] == '"' else word[1:-1]
            except ValueError as e:
                raise StatementSyntaxError(str(e)) from e
        found.append(Token(kind, word, at))
        at = match.end()
    return [*found, Token("end", "", at)]


def parse_size(text: str) -> int:
    """Bytes of a size literal such as 10G, 1Tb or 3GiB."""
    match = re.fullmatch(r"(\d*\.?\d+)\s*([a-zA-Z]*)", text.strip())
    if not match or match[2].lower() not in UNITS:
        raise StatementSyntaxError(f"not a size: {text}")
    return int(float(match[1]) * UNITS[match[2].lower()]) if "." in match[1] else int(match[1]) * UNITS[match[2].lower()]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.k = text, tokens(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, wanted: str) -> StatementSyntaxError:
        return StatementSyntaxError(f"{wanted} expected at {self.now.at}, found {self.now.text or 'the end'!r}: {self.text}")

    def word(self, *names: str) -> str | None:
        """Take a keyword if it is one of these."""
        t = self.now
        if t.kind == "keyword" and t.text.upper() in names:
            self.k += 1
            return t.text.upper()
        return None

    def sign(self, *signs: str) -> str | None:
        t = self.now
        if t.kind == "sign" and t.text in signs:
            self.k += 1
            return t.text
        return None

    def take(self, *kinds: str) -> str:
        t = self.now
        if t.kind not in kinds:
            raise self.fail(" or ".join(kinds))
        self.k += 1
        return t.text

    def clause(self, name: str, read):
        return read() if self.word(name) else None

    def integer(self) -> int:
        text = self.take("number")
        try:
            return int(text)
        except ValueError as e:
            raise StatementSyntaxError(f"not an integer: {text}") from e

    def size(self) -> int:
        return parse_size(self.take("number"))

    def expression(self) -> ast.Any_:
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return ast.Any_(tuple(parts))

    def conjunction(self) -> ast.All:
        parts = [self.term()]
        while self.word("AND"):
            parts.append(self.term())
        return ast.All(tuple(parts))

    def term(self):
        # A keyword may be an operand: NOT is one only where an operator follows.
        negated = self.now.kind == "keyword" and self.now.text.upper() == "NOT" and not self._operator_follows()
        if negated:
            self.k += 1
        if self.sign("("):
            what = self.expression()
            if not self.sign(")"):
                raise self.fail("')'")
        else:
            what = self.condition()
        return ast.Not(what) if negated else what

    def _operator_follows(self) -> bool:
        t = self.tokens[self.k + 1]
        return t.kind == "sign" and t.text in SIGN_OPERATORS or t.kind == "keyword" and t.text.upper() in WORD_OPERATORS

    def operand(self) -> ast.Operand:
        name = self.take("ident", "keyword")
        args: list[ast.Operand] = []
        if self.sign("("):
            args.append(self.operand())
            while self.sign(","):
                args.append(self.operand())
            if not self.sign(")"):
                raise self.fail("')'")
        return ast.Operand(name, tuple(args))

    def condition(self) -> ast.Condition:
        operand = self.operand()
        op = self.sign(*SIGN_OPERATORS) or self.word(*WORD_OPERATORS)
        if not op:
            raise self.fail("an operator")
        return ast.Condition(operand, op, self.take("string", "ident", "number"))

    def tags(self) -> ast.Tags:
        text = self.take("tags")
        try:
            return ast.Tags(tuple(sorted(kvtext.parse_tags(text).items())))
        except ValueError as e:
            raise StatementSyntaxError(str(e)) from e

    def source(self):
        return self.tags() if self.now.kind == "tags" else self.expression()

    def optional_source(self, *ends: str):
        """A source, unless the statement ends or one of its clauses follows."""
        t = self.now
        clause = t.kind == "keyword" and t.text.upper() in ends and not self._operator_follows()
        return None if t.kind == "end" or clause else self.source()

    def range(self) -> ast.Range:
        bracket = self.sign("[")
        start = self.take("string") if self.now.kind == "string" else None
        if self.sign(":"):
            end = self.take("string")
            if not self.sign("]"):
                raise self.fail("']'")
            return ast.Range(start, end)
        if bracket and not self.sign("]"):
            raise self.fail("':' or ']'")
        return ast.Range(start)

    def select(self) -> ast.Select:
        template = self.take("string") if self.now.kind == "string" else None
        source = self.clause("FROM", self.source)
        range_ = self.clause("RANGE", self.range)
        where = self.clause("WHERE", self.expression)
        position = self.clause("POSITION", lambda: self.take("string", "ident"))
        return ast.Select(template, source, range_, where, position, self.clause("OFFSET", self.integer), self.clause("LIMIT", self.integer))

    def statement(self) -> ast.Statement:
        match self.word("SELECT", "DESCRIBE", "TRUNCATE", "SHOW", "CREATE", "DELETE"):
            case "SELECT":
                out = self.select()
            case "DESCRIBE":
                if self.word("PIPE"):
                    out = ast.Describe(pipe=self.take("ident"))
                elif self.word("PARTITION"):
                    out = ast.Describe(tags=self.tags())
                else:
                    raise self.fail("PARTITION or PIPE")
            case "TRUNCATE":
                dry = bool(self.word("DRYRUN"))
                source = self.optional_source("MINSIZE", "MAXSIZE", "BEFORE", "MAXDBSIZE")
                sizes = [self.clause(name, self.size) for name in ("MINSIZE", "MAXSIZE")]
                before = self.clause("BEFORE", lambda: self.take("string"))
                out = ast.Truncate(dry, source, *sizes, before, self.clause("MAXDBSIZE", self.size))
            case "SHOW":
                what = self.word("PARTITIONS", "PIPES")
                if not what:
                    raise self.fail("PARTITIONS or PIPES")
                source = self.optional_source("OFFSET", "LIMIT")
                out = ast.Show(what, source, self.clause("OFFSET", self.integer), self.clause("LIMIT", self.integer))
            case "CREATE":
                if not self.word("PIPE"):
                    raise self.fail("PIPE")
                out = ast.CreatePipe(self.take("ident"), self.clause("FROM", self.source), self.clause("WHERE", self.expression))
            case "DELETE":
                if not self.word("PIPE"):
                    raise self.fail("PIPE")
                out = ast.DeletePipe(self.take("ident"))
            case _:
                raise self.fail("a statement")
        return self.end(out)

    def end(self, out):
        if self.now.kind != "end":
            raise self.fail("the end")
        return out


def parse(text: str) -> ast.Statement:
    """A statement."""
    return _Parser(text).statement()


def parse_source(text: str | None) -> ast.Source | None:
    """What may follow FROM; an empty text is None, all partitions."""
    if not text or not text.strip():
        return None
    p = _Parser(text)
    return p.end(p.source())


def parse_expression(text: str | None) -> ast.Any_ | None:
    """What may follow WHERE; an empty text is None, all records."""
    if not text or not text.strip():
        return None
    p = _Parser(text)
    return p.end(p.expression())
