"""Errors, each with a stable code."""


class EngineError(Exception):
    code = 0
    name = "ERROR"


def _error(title: str, name: str, code: int) -> type[EngineError]:
    return type(title, (EngineError,), {"code": code, "name": name, "__module__": __name__})


CollectionNotFound = _error("CollectionNotFound", "COLLECTION_NOT_FOUND", -1)
VectorNotFound = _error("VectorNotFound", "VECTOR_NOT_FOUND", -2)
AlreadyExists = _error("AlreadyExists", "ALREADY_EXISTS", -3)
DimensionMismatch = _error("DimensionMismatch", "DIMENSION_MISMATCH", -4)
Locked = _error("Locked", "LOCKED", -5)
Corrupt = _error("Corrupt", "CORRUPT", -6)
UnsupportedFormatVersion = _error("UnsupportedFormatVersion", "UNSUPPORTED_FORMAT_VERSION", -7)
UnsupportedProvider = _error("UnsupportedProvider", "UNSUPPORTED_PROVIDER", -8)
ReadOnly = _error("ReadOnly", "READ_ONLY", -9)
InvalidArgument = _error("InvalidArgument", "INVALID_ARGUMENT", -10)
IoError = _error("IoError", "IO", -11)
WalPending = _error("WalPending", "WAL_PENDING", -12)
Closed = _error("Closed", "CLOSED", -13)
