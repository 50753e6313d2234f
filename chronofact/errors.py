"""Typed failures."""

from __future__ import annotations


class ChronofactError(Exception):
    pass


class QueryError(ChronofactError):
    """A query that has no meaning: wrong shape or unsafe."""


class UnboundVariable(QueryError):
    def __init__(self, variable: str, where: object):
        super().__init__(f"{variable} is not bound: {where}")
        self.variable = variable


class CursorError(ChronofactError):
    """reason: malformed, unsupported_version, basis_mismatch, scope_mismatch, query_mismatch or invalid_ordering."""

    def __init__(self, reason: str, message: str = ""):
        super().__init__(f"{reason}: {message}" if message else reason)
        self.reason = reason


class WriteError(ChronofactError):
    pass


class ReadError(ChronofactError):
    pass


class TransactionConflict(WriteError):
    def __init__(self, triple_id: str):
        super().__init__(f"fact {triple_id} is not live any more")
        self.triple_id = triple_id


class CommandAlreadyCommitted(WriteError):
    def __init__(self, command_id: str, tx_id: str):
        super().__init__(f"command {command_id} was committed as {tx_id}")
        self.command_id, self.tx_id = command_id, tx_id


class ConstraintViolated(WriteError):
    def __init__(self, violations: list, count: int | None = None):
        self.violations, self.count = violations, len(violations) if count is None else count
        super().__init__(f"{self.count} new or worse violations")


class CheckpointConflict(WriteError):
    pass


class ConfigError(ChronofactError):
    pass


class DerivationError(ChronofactError):
    pass


class StagingError(ChronofactError):
    pass
