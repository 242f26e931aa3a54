"""Errors of the engine, by the kind of fault."""


class TidemarkError(Exception):
    """Base of all errors the engine raises itself."""


class ParseError(TidemarkError):
    """The text is not in the dialect, or uses what the dialect refuses."""


class BindError(TidemarkError):
    """Names, types or limits do not fit."""


class CatalogError(TidemarkError):
    """A schema change or definition is refused."""


class NotFoundError(TidemarkError):
    """No such table, index, row or version."""


class ConflictError(TidemarkError):
    """Another commit came first, or a key exists."""


class HorizonError(NotFoundError):
    """The changes that a read needs were vacuumed."""


class PoisonedError(TidemarkError):
    """A commit failed so that it may or may not have been made; nothing is written until
    the log has been read again."""


class ConsistencyError(TidemarkError):
    """The freshness that a session asks for can't be had."""
