"""Counts of overlapping boxes in two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.plans.rangejoin import SPAN, Grid


def _axis_grid(low, high, mean, longest, rows: int, width: float | None) -> Grid:
    low, high, longest = float(low or 0), float(high or 0), float(longest or 0)
    width = width or max(2 * float(mean or 0), (high - low) / max(1, rows), (high - low) / 2**40) or 1.0
    n = 1
    while longest > width * SPAN**n:
        n += 1
    return Grid(width, n, False, low, high)


def count_2d(boxes: DataFrame, queries: DataFrame, qid: str = "qid", cell: tuple[float, float] | None = None) -> DataFrame:
    """qid, n: closed-box overlaps of each query box; 0 included.

    Both sides have x0, x1, y0, y1. Each axis has levels of bins as in a range join (``cell``:
    width and height of the lowest, by default twice the mean sides), so a box of any
    size costs a bounded number of cells; a pair counts in the cell of its lower left
    common corner only. Inverted boxes and those with NULL or NaN sides are left out.
    ``qid`` must be unique.
    """
    sides = ["x0", "x1", "y0", "y1"]
    valid = " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in sides) + " AND x0 <= x1 AND y0 <= y1"
    queries = queries.select(F.col(qid).alias("qid"), *[F.col(c).cast("double").alias(c) for c in sides]).where(valid)
    boxes = boxes.select(*[F.col(c).cast("double").alias(c) for c in sides]).where(valid)
    both = boxes.unionAll(queries.select(*sides))
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)) for c in sides]
    r = both.agg(F.count("*"), *[f(x) for x in finite for f in (F.min, F.max)], F.avg(finite[1] - finite[0]), F.avg(finite[3] - finite[2]), F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).first()
    grids = {}
    for k, axis in enumerate("xy"):
        known = [v for v in r[1 + 4 * k : 5 + 4 * k] if v is not None] or [0.0]
        longest = min(r[11 + k] or 0.0, max(known) - min(known))
        grids[axis] = _axis_grid(min(known), max(known), r[9 + k], longest, r[0], cell[k] if cell else None)
    a, b = queries.select(F.col("qid"), *[F.col(c).alias(f"a{c}") for c in sides]), boxes.select(*[F.col(c).alias(f"b{c}") for c in sides])
    on = (F.col("bx0") <= F.col("ax1")) & (F.col("ax0") <= F.col("bx1")) & (F.col("by0") <= F.col("ay1")) & (F.col("ay0") <= F.col("by1"))
    for axis, g in grids.items():
        a, b = g.exploded(a, f"a{axis}0", f"a{axis}1", True, axis), g.exploded(b, f"b{axis}0", f"b{axis}1", False, axis)
        for c in ("role", "level", "bin"):
            a, b = a.withColumnRenamed(f"_{c}{axis}", f"a__{c}{axis}"), b.withColumnRenamed(f"_{c}{axis}", f"b__{c}{axis}")
            on &= F.col(f"a__{c}{axis}") == F.col(f"b__{c}{axis}")
        on &= g.owns(f"a{axis}0", f"b{axis}0", f"a__level{axis}", axis)
    return a.join(b, on, "left").groupBy("qid").agg(F.count("bx0").alias("n"))
