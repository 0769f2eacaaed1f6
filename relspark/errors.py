"""The error hierarchy, and the mapping from Spark's error classes to it."""

from __future__ import annotations


class Warning(Exception):  # noqa: A001
    """PEP 249's warning."""


class Error(Exception):
    """The root of all errors of the package."""


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


class ParseError(ProgrammingError):
    pass


class NoSuchTableError(ProgrammingError):
    pass


class NoSuchColumnError(ProgrammingError):
    pass


class TableExistsError(ProgrammingError):
    pass


class IndexExistsError(TableExistsError):
    pass


class ColumnExistsError(ProgrammingError):
    pass


class NoSuchIndexError(NoSuchTableError):
    pass


class ConstraintError(IntegrityError):
    pass


class NotNullError(ConstraintError):
    pass


class CheckError(ConstraintError):
    pass


class UniqueConstraintError(ConstraintError):
    pass


class ForeignKeyError(ConstraintError):
    pass


class TransactionError(OperationalError):
    pass


class AuthorizationError(OperationalError):
    pass


class ReadOnlyError(OperationalError):
    pass


class TooManyRowsError(OperationalError):
    pass


class QueryTimeoutError(OperationalError):
    pass


_BY_CLASS = (
    ("PARSE", ParseError),
    ("UNRESOLVED_COLUMN", NoSuchColumnError),
    ("TABLE_OR_VIEW_NOT_FOUND", NoSuchTableError),
    ("UNRESOLVED_ROUTINE", ProgrammingError),
    ("ARITHMETIC_OVERFLOW", DataError),
    ("CAST_", DataError),
    ("DIVIDE_BY_ZERO", DataError),
)


def translate(e: Exception) -> Exception:
    """A Spark exception as one of ours; other exceptions as they are."""
    get = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    if get is None:
        return e
    name = get() or ""
    for start, kind in _BY_CLASS:
        if name.startswith(start) or f"[{start}" in str(e):
            return kind(str(e).splitlines()[0])
    return OperationalError(str(e).splitlines()[0])
