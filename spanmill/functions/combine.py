"""Payload combiners as aggregate columns.

A combiner folds the payloads of rows that an operator joins into one. Names map
to native aggregates; a callable ``(acc, next) -> Column`` is folded with
``aggregate`` over an ordered list, and ``PythonCombiner`` wraps an opaque Python
function (slow path, opt-in).
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


@dataclass(frozen=True)
class PythonCombiner:
    """An opaque ``f(acc, next)`` over Python values, folded in Arrow batches over ordered lists; ``returns`` is its type as DDL."""

    f: Callable
    returns: str

    def column(self, ordered: Column) -> Column:
        f, kind = self.f, to_arrow_type(_parse_datatype_string(self.returns))

        @F.arrow_udf(self.returns)
        def fold(values: pa.Array) -> pa.Array:
            return pa.array([reduce(f, xs) if xs else None for xs in values.to_pylist()], kind)

        return fold(ordered)


def combiner(combine, value: str = "value", order: Column | None = None) -> Column:
    """The aggregate for ``combine`` over ``value`` in the order of the ``order`` struct."""
    v = F.col(value)
    if isinstance(combine, str) and combine == "first":
        return F.min_by(v, order)
    if isinstance(combine, str) and combine == "last":
        return F.max_by(v, order)
    if isinstance(combine, str) and combine in ("sum", "min", "max", "count"):
        return getattr(F, combine)(v)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v")))), lambda x: x["v"])
    if isinstance(combine, str) and combine == "collect":
        return ordered
    if isinstance(combine, PythonCombiner):
        return combine.column(ordered)
    if callable(combine):
        return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, F.lit(0)), combine)
    raise ValueError(f"unknown combiner: {combine!r}")
