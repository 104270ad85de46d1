"""Errors with fixed codes."""

from __future__ import annotations

# Code, name and message of each error.
CODES = {
    -1: ("NOT_FOUND", "Record not found"),
    -1000: ("DUPLICATE_KEY", "Duplicate key found"),
    -1001: ("UNIQUE_CONSTRAINT_VIOLATION", "Unique constraint violation"),
    -1002: ("FOREIGN_KEY_VIOLATION", "Foreign key constraint violation"),
    -1003: ("CHECK_CONSTRAINT_VIOLATION", "Check constraint violation"),
    -2000: ("COLUMN_MISMATCH", "Column count mismatch"),
    -2001: ("ROW_BYTES_EXCEEDED", "Row bytes exceeded maximum size"),
    -2002: ("INVALID_DATA_TYPE", "Invalid data type"),
    -3000: ("TABLE_NOT_FOUND", "Table not found"),
    -3001: ("INDEX_NOT_FOUND", "Index not found"),
    -3002: ("NO_INDEXES", "No indexes found"),
    -4000: ("STORAGE_READ_ERROR", "Storage read error"),
    -4001: ("STORAGE_WRITE_ERROR", "Storage write error"),
    -4002: ("STORAGE_DELETE_ERROR", "Storage delete error"),
    -4003: ("STORAGE_FULL", "Storage full"),
    -5000: ("LOCK_TIMEOUT", "Lock acquisition timeout"),
    -5001: ("DEADLOCK_DETECTED", "Deadlock detected"),
    -5002: ("TRANSACTION_FAILED", "Transaction failed"),
    -5003: ("TRANSACTION_NOT_STARTED", "Transaction not started"),
    -9000: ("INVALID_OPERATION", "Invalid operation"),
    -9001: ("RESOURCE_NOT_AVAILABLE", "Resource not available"),
    -9002: ("INTERNAL_ERROR", "Internal error"),
}
BY_NAME = {name: code for code, (name, _) in CODES.items()}


class EngineError(Exception):
    """An error of a fixed code; ``name`` is one of BY_NAME."""

    def __init__(self, name: str, detail: str = ""):
        self.name, self.code = name, BY_NAME[name]
        super().__init__(f"{CODES[self.code][1]} ({self.code})" + (f": {detail}" if detail else ""))


class SqlSyntaxError(EngineError):
    def __init__(self, detail: str):
        super().__init__("INVALID_OPERATION", detail)
