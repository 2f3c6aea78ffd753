"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class InvalidArgument(EngineError):
    """A plan, statement or value that is not admitted."""


class NotFound(EngineError):
    """A key, table or pin that does not exist."""


class TransactionConflict(EngineError):
    """Another commit touched the same key or name first."""


class ReadOnly(EngineError):
    """A write to something that only reads."""
