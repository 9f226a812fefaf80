"""Column predicates and coordinate helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """End-inclusive overlap: a shared endpoint counts."""
    return (_column(b_start) <= _column(a_end)) & (_column(a_start) <= _column(b_end))


def contains_point(start, end, point) -> Column:
    """``start <= point <= end``."""
    return overlaps(point, point, start, end)


def to_day_number(col, epoch: str = "1970-01-01") -> Column:
    """DATE or TIMESTAMP as a BIGINT day number, so that the +-1 operators apply."""
    return F.datediff(F.col(col) if isinstance(col, str) else col, F.lit(epoch).cast("date")).cast("bigint")


def saturating_add(col: Column, delta: int, lo: int | None = None, hi: int | None = None) -> Column:
    """``col + delta`` in BIGINT, clamped to ``[lo, hi]``; overflow saturates instead of raising."""
    edge = 2**63 - 1 if delta >= 0 else -(2**63)
    out = F.coalesce(F.try_add(col, F.lit(delta).cast("bigint")), F.when(col.isNotNull(), F.lit(edge)))
    if lo is not None:
        out = F.greatest(out, F.lit(lo).cast("bigint"))
    if hi is not None:
        out = F.least(out, F.lit(hi).cast("bigint"))
    return out
