"""Errors that queries report to their caller."""

from __future__ import annotations


class QueryError(Exception):
    """A query that can't be answered as it stands; code follows HTTP."""

    def __init__(self, message: str, code: int = 400):
        super().__init__(message)
        self.code, self.message = code, message

    def as_dict(self) -> dict:
        return {"status": "error", "code": self.code, "message": self.message}
