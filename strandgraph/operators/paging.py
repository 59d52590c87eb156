"""Ordered pages with decimal cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandgraph.schema import GraphError

MOST = 1000


def offset_of(cursor) -> int:
    """The offset that a cursor stands for; none is 0."""
    if cursor is None:
        return 0
    if not isinstance(cursor, str) or not (cursor.isascii() and cursor.isdigit()):
        raise GraphError("bad_cursor", "a cursor is a decimal string from an earlier page")
    return int(cursor)


def clamp(limit: int | None, default: int, most: int = MOST) -> int:
    return max(1, min(most, default if limit is None else int(limit)))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of ``df``; a top-k with offset, so no full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(total: int, returned: int, offset: int, limit: int, exact: bool = False) -> dict:
    """total, has_more and cursor of a page; ``exact``: the next page begins
    after what was returned, else after ``limit``."""
    more = offset + returned < total
    return {"total": total, "has_more": more, "cursor": str(offset + (returned if exact else limit)) if more else None}
