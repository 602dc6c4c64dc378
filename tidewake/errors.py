"""Errors of the query language; all are raised on the driver before a job starts."""


class StatementError(ValueError):
    """Any statement that can't be run."""


class StatementSyntaxError(StatementError):
    """The statement doesn't follow the grammar."""


class UnknownOperandError(StatementError):
    """A condition names something that is no operand, or a function that doesn't exist."""


class UnsupportedOperatorError(StatementError):
    """The operand has no such operator."""


class PatternError(StatementError):
    """A LIKE pattern is malformed."""


class DateTimeError(StatementError):
    """A date-time literal can't be read."""


class FormatError(StatementError):
    """A format template is malformed."""
