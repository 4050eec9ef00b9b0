"""Errors raised before a query runs; overflow and division by zero are Spark's own at run time."""

from __future__ import annotations


class QueryError(ValueError):
    """Base of all analysis errors."""


class ParseError(QueryError):
    """The text is not a statement of the dialect."""


class TypeMismatchError(QueryError):
    """Operand types that an operation does not take."""


class UnknownNameError(QueryError):
    """A table, column or alias that does not exist here."""


class DuplicateAliasError(QueryError):
    """Two result columns of one name."""


class GroupingError(QueryError):
    """A column outside GROUP BY, a nested aggregate, or a bad grouping key."""


class ParameterError(QueryError):
    """A parameter that is missing, untyped, or of another type than declared."""


class NullInputError(QueryError):
    """Input that holds nulls, which tables do not have."""


class DigestError(QueryError):
    """Digests whose row ranges or columns do not fit together."""
