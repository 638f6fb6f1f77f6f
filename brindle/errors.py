"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class BadSyntax(EngineError):
    """A statement of a known kind that does not parse."""


class InvalidStatement(EngineError):
    """Text that is no statement of the wanted kind."""


class TableNotFound(EngineError):
    pass


class TableExists(EngineError):
    pass


class TableSchemaNotFound(EngineError):
    pass


class ViewNotFound(EngineError):
    pass


class ViewExists(EngineError):
    pass


class ViewCycle(EngineError):
    pass


class IndexExists(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class UnknownIndexType(EngineError):
    pass


class FieldIndexed(EngineError):
    """A field that has an index already."""


class FieldNotFound(EngineError):
    pass


class ExecuteError(EngineError):
    pass


class PlaceholderError(EngineError):
    pass


class UnserializableValue(EngineError):
    pass


class TransactionAlreadyStarted(EngineError):
    pass


class NoTransaction(EngineError):
    pass


class BadDSN(EngineError):
    pass


class LockTimeout(EngineError):
    pass
