"""Classes of error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a lower-cased message that decide its class.
DB_FATAL = ("syntax error", "column does not exist", "table does not exist", "permission denied", "authentication failed", "invalid credentials")
DB_TEMPORARY = ("connection refused", "connection reset", "timeout", "deadline exceeded", "network", "i/o timeout", "too many connections", "lock timeout")
FEED_PANIC = ("readmessage panic", "ping panic", "repeated read on failed websocket", "websocket panic", "connection panic", "sendmessage panic")
FEED_FATAL = (
    "out of memory", "no space left", "disk space", "configuration error", "initialization failed",
    "multiple exchanges failed simultaneously", "segmentation fault", "fatal system error",
)


def _has(message: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(message).rlike("|".join(parts))


def classify_db_error(message: Column) -> Column:
    """fatal, temporary or retryable."""
    return F.when(_has(message, DB_FATAL), "fatal").when(_has(message, DB_TEMPORARY), "temporary").otherwise("retryable")


def classify_feed_error(message: Column) -> Column:
    """fatal or recoverable; panics of a feed connection are recoverable whatever else they say, and so is the unknown."""
    return F.when(_has(message, FEED_PANIC), "recoverable").when(_has(message, FEED_FATAL), "fatal").otherwise("recoverable")
