"""Predicates on validity. The moment is always an argument: a plan never reads the clock by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: str) -> Column:
    """A point in time from RFC 3339 text or a date (midnight UTC); null where it is neither."""
    return F.coalesce(F.lit(text).try_cast("timestamp"))


def in_force(at: Column, include_expired: bool = False, start: str = "valid_at", end: str = "invalid_at", expired: str = "expired_at") -> Column:
    """Valid at ``at``: started by then and not ended after a half-open period; no condition at all with ``include_expired``."""
    if include_expired:
        return F.lit(True)
    started = F.col(start).isNull() | (F.col(start) <= at)
    return started & not_ended(at, end, expired)


def not_ended(at: Column, end: str = "invalid_at", expired: str = "expired_at") -> Column:
    """The weaker test of searches: the start doesn't matter."""
    return (F.col(end).isNull() | (F.col(end) > at)) & (F.col(expired).isNull() | (F.col(expired) > at))


def never_ended(end: str = "invalid_at", expired: str = "expired_at") -> Column:
    """The test of audits: an end in the future counts as an end."""
    return F.col(end).isNull() & F.col(expired).isNull()


def in_namespaces(names: list[str], column: str = "namespace", null_is_global: bool = False) -> Column:
    """Membership in a chain of namespaces; an empty chain is no filter."""
    if not names:
        return F.lit(True)
    hit = F.col(column).isin(names)
    return (F.col(column).isNull() | hit) if null_is_global else hit
