"""Running sums and maxima that don't put one contig into one task.

``partitionBy(contig)`` alone degenerates when one contig holds most rows. Split
frames are range-partitioned by contig and position first and written, with the
number of the partition, so that every reader sees the same ranges. A prefix then has
two levels: an aggregate per (contig, range), its exclusive prefix over that small
table, and a window per (contig, range) that starts from the carry. Ranges hold about
equally many rows however the coordinates cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.sources.workspace import cut

UNBOUNDED = Window.unboundedPreceding
RANGE = "_range"


def ranged(df: DataFrame, keys: list[str], pos: str, parts: int) -> DataFrame:
    """``df`` as a table with the number of each row's range by (keys, pos) in ``_range``."""
    return cut(df.repartitionByRange(parts, *keys, pos).withColumn(RANGE, F.spark_partition_id()), "ranged")


def running(df: DataFrame, keys: list[str], order: list, specs: list[tuple[str, str, str]], parts: int | None = None, inclusive: bool = True) -> DataFrame:
    """Add ``name`` = running ``agg`` ('sum' or 'max') of column ``src`` for each (name, src, agg).

    Rows are ordered by ``order`` within ``keys``. With ``parts``, ``df`` comes from
    ``ranged`` by the first column of ``order``; ``_range`` stays.
    """
    agg = {"sum": F.sum, "max": F.max}
    last = Window.currentRow if inclusive else -1
    if not parts:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UNBOUNDED, last)
        return df.withColumns({n: agg[a](s).over(w) for n, s, a in specs})
    totals = df.groupBy(*keys, RANGE).agg(*[agg[a](s).alias(f"_t_{n}") for n, s, a in specs])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(UNBOUNDED, -1)
    carry = totals.select(*keys, RANGE, *[agg[a](f"_t_{n}").over(before).alias(f"_c_{n}") for n, s, a in specs])
    # each range to a task of its own, whatever the number of shuffle partitions
    out = _joined(df.repartitionById(parts, F.col(RANGE)), carry, keys)
    w = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(UNBOUNDED, last)
    for n, s, a in specs:
        local = agg[a](s).over(w)
        out = out.withColumn(n, F.greatest(local, F.col(f"_c_{n}")) if a == "max" else F.when(local.isNotNull() | F.col(f"_c_{n}").isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))))
    return out.drop(*[f"_c_{n}" for n, _, _ in specs])


def _joined(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(RANGE).alias("_kr"), *[c for c in carry.columns if c.startswith("_c_")])
    cond = F.col(RANGE) == F.col("_kr")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # without keys there is one row for each range
    return df.join(renamed if keys else F.broadcast(renamed), cond).drop("_kr", *[f"_k_{k}" for k in keys])


def islands(df: DataFrame, keys: list[str], order: list, parts: int | None = None) -> DataFrame:
    """Add ``_pm`` (largest end before the row), ``_new`` and ``_island``.

    A row starts an island iff it begins after everything before it has ended;
    touching at one point joins, adjacency does not.
    """
    if parts:
        df = ranged(df, keys, "start", parts)
    flagged = running(df, keys, order, [("_pm", "end", "max")], parts, inclusive=False)
    flagged = flagged.withColumn("_new", (F.col("_pm").isNull() | (F.col("start") > F.col("_pm"))).cast("bigint"))
    if parts:  # the second prefix reads its input twice
        flagged = cut(flagged, "flagged")
    return running(flagged, keys, order, [("_island", "_new", "sum")], parts).drop(RANGE)
