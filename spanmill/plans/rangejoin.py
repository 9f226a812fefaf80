"""Range joins: Spark has none, so the overlap predicate is rewritten to an equi-join.

Strategies
    ``equi``       the keys are joined and the overlap is a residual condition (few rows a contig)
    ``binned``     both sides are exploded over bins and joined on (keys, level, bin)
    ``broadcast``  the overlap alone, with a side that is known to be small
    ``grouped``    rows of equal ranges are put together, the ranges joined as ``binned`` and the pairs
                   of their rows made last, next to each other (many partners, many equal ranges)

Binned: every row has a level, the least whose bins it spans at most ``SPAN`` of;
level m has bins of ``width * SPAN**m``. A pair is made at the higher of its two
rows' levels and only in its owner bin, that of ``greatest(starts)``, so it comes
exactly once and a contig-wide container costs a bounded number of bins. Coordinates
may be integral or floating; infinite ends count as the outermost finite ones when
bins are chosen.

Outer forms group the exploded rows by the probe's number, so a frame whose rows were
numbered on the fly is evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.predicates import overlaps
from spanmill.plans import sweep

SPAN = 32
SMALL_ROWS = 2_000
#: Product of the largest rows per contig of both sides up to which the residual condition is cheap.
EQUI_PAIRS = 4_096
#: Average partners of a row, and rows by rows of a pair of ranges, from which equal ranges are put together.
DENSE_ROWS, GROUPED_PAIRS = 32, 9
#: Rows of one range that are put together at most (about), and pairs that a task makes.
GROUP_ROWS, TASK_PAIRS = 512, 50_000_000


@dataclass(frozen=True)
class Grid:
    """Bins of ``width * SPAN**level``, for ``levels`` levels; floating coordinates are clamped to [low, high]."""

    width: float
    levels: int = 1
    integral: bool = True
    low: float = 0.0
    high: float = 0.0

    def cell(self, at: str, level: int = 0) -> str:
        size = self.width * SPAN**level
        if self.integral:
            return f"({at}) div {int(size)}L"
        return f"CAST(floor(least(greatest(CAST({at} AS DOUBLE), CAST('{self.low!r}' AS DOUBLE)), CAST('{self.high!r}' AS DOUBLE)) / CAST('{float(size)!r}' AS DOUBLE)) AS BIGINT)"

    def exploded(self, df: DataFrame, start: str, end: str, probe: bool, tag: str = "") -> DataFrame:
        """One row per (role, level, bin). Role 0 is for pairs at the probe's own level, role 1 for those above it."""
        role, lvl, cell = f"_role{tag}", f"_level{tag}", f"_bin{tag}"

        def bins(m: int) -> Column:
            return F.expr(f"sequence({self.cell(start, m)}, {self.cell(end, m)})")

        if self.levels == 1:
            return df.withColumn(cell, F.explode(bins(0))).withColumns({role: F.lit(0), lvl: F.lit(0)})
        own = f"_own{tag}"
        df = df.withColumn(own, sum(F.expr(f"{self.cell(end, m)} - {self.cell(start, m)} > {SPAN}").cast("int") for m in range(self.levels - 1)))
        parts = []
        for m in range(self.levels):
            here, above = F.col(own) == m, F.col(own) < m
            # a probe has role 0 at its own level and role 1 above it; a stored row role 0 at its own and above, role 1 at its own
            for r, when in [(0, here), (1, above)] if probe else [(0, here | above), (1, here)]:
                parts.append(F.when(when, F.transform(bins(m), _tagged(r, m, role, lvl, cell))))
        every = F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))
        return df.select("*", F.inline(every)).drop(own)

    def owns(self, a_start: str, b_start: str, level: str, tag: str = "") -> Column:
        """The bin is that of the pair's larger start."""
        cases = "".join(f" WHEN {m} THEN {self.cell(f'greatest({a_start}, {b_start})', m)}" for m in range(self.levels))
        return F.expr(f"a__bin{tag} = CASE {level}{cases} END")


def _tagged(role: int, level: int, *names: str):
    return lambda x: F.struct(F.lit(role).alias(names[0]), F.lit(level).alias(names[1]), x.alias(names[2]))


def met(a: DataFrame, b: DataFrame, grid: Grid, more: Column, how: str = "inner", parts: int | None = None, keys: list[str] = ()) -> DataFrame:
    """The join of two frames (columns ``a_*`` and ``b_*``) over the bins of ``grid``, in ``parts`` tasks if given."""
    ax = grid.exploded(a, "a_start", "a_end", True).withColumnsRenamed({"_bin": "a__bin", "_role": "a__role", "_level": "a__level"})
    bx = grid.exploded(b, "b_start", "b_end", False).withColumnsRenamed({"_bin": "b__bin", "_role": "b__role", "_level": "b__level"})
    if parts:  # else small inputs that make many pairs would be put into few tasks
        by = ["_bin", *keys, *(["_role", "_level"] if grid.levels > 1 else [])]
        ax, bx = ax.repartition(parts, *[f"a_{c}" for c in by]), bx.repartition(parts, *[f"b_{c}" for c in by])
    on = (F.col("a__bin") == F.col("b__bin")) & more
    if grid.levels > 1:
        on = on & (F.col("a__role") == F.col("b__role")) & (F.col("a__level") == F.col("b__level"))
    on = on & grid.owns("a_start", "b_start", "a__level")
    out = ax.join(bx, on, how)
    return out.drop("a__bin", "a__role", "a__level", "b__bin", "b__role", "b__level")


def choose(a, b, keys: list[str], inner: bool = False) -> str:
    """Strategy from the statistics of both frames; ``inner`` where pairs alone are asked for."""
    sa, sb = a.stats(), b.stats()
    if not keys and min(sa.rows, sb.rows) <= SMALL_ROWS:
        return "broadcast"
    if keys and sa.max_rows * sb.max_rows <= EQUI_PAIRS:
        return "equi"
    if inner and _partners(a, b) >= DENSE_ROWS and _together(a) * _together(b) >= GROUPED_PAIRS:
        return "grouped"
    return "binned"


def _partners(a, b) -> float:
    """About how many rows of the largest contig of b a row of a overlaps."""
    sa, sb = a.stats(), b.stats()
    extent = max(sa.high, sb.high) - min(sa.low, sb.low)
    return sb.max_rows * (sa.typical + sb.typical) / extent if extent > 0 else sb.max_rows


def grid_of(a, b, width: float | None = None) -> Grid:
    """A grid for both frames, by default with bins of four typical lengths."""
    sa, sb = a.stats(), b.stats()
    integral = a.integral and b.integral
    low, high = min(sa.low, sb.low), max(sa.high, sb.high)
    width = width or 4 * max(sa.typical, sb.typical)
    if integral:
        width = max(1, int(width))
    else:
        width = max(width, (high - low) / 2**40) or 1.0
    longest, n = max(sa.longest, sb.longest), 1
    while longest > width * SPAN**n:
        n += 1
    return Grid(width, n, integral, float(low), float(high))


def _condition(keys: list[str]) -> Column:
    cond = overlaps("a_start", "a_end", "b_start", "b_end")
    for k in keys:
        cond = cond & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return cond


def sides(a, b, b_columns: list[str] | None = None, a_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The frames with ``a_`` and ``b_`` before their columns; only what is asked for."""
    def side(f, p, columns):
        return f.df.select([F.col(c).alias(f"{p}_{c}") for c in f.df.columns if columns is None or c in {*f.keys, "start", "end", *columns}])

    return side(a, "a", a_columns), side(b, "b", b_columns)


def _keys(a, b) -> list[str]:
    if list(a.keys) != list(b.keys):
        raise ValueError(f"key columns differ: {list(a.keys)} and {list(b.keys)}")
    return list(a.keys)


def _chunks(f) -> int:
    return -(-f.copies()[1] // GROUP_ROWS)


def _together(f) -> float:
    """Rows of a usual range that stay together; one where the largest range makes many chunks."""
    return max(1.0, f.copies()[0] / _chunks(f))


def _grouped(f, df: DataFrame, p: str, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per distinct range, with its rows' other columns in the array ``<p>__rows``; a range of very many rows gets several."""
    ranges = [f"{p}_{c}" for c in (*keys, "start", "end")]
    rest = [c for c in df.columns if c not in ranges]
    chunks = _chunks(f)
    chunk = F.expr(f"pmod(xxhash64({', '.join(rest)}, monotonically_increasing_id()), {chunks})") if chunks > 1 else F.lit(0)
    got = df.withColumn("_chunk", chunk).groupBy(*ranges, "_chunk").agg(F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(0))).alias(f"{p}__rows"))
    # a single column goes on as a plain array, which is a third of the bytes
    return got.select(*ranges, F.col(f"{p}__rows.{rest[0]}").alias(f"{p}__rows") if len(rest) == 1 else f"{p}__rows"), rest


def _pairs_grouped(a, b, left: DataFrame, right: DataFrame, keys: list[str], width: float | None) -> DataFrame:
    (ga, ra), (gb, rb) = _grouped(a, left, "a", keys), _grouped(b, right, "b", keys)
    parts = min(4_000, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(a.stats().rows * _partners(a, b) / TASK_PAIRS)))
    got = met(ga, gb, grid_of(a, b, width), _condition(keys), parts=parts, keys=keys)
    got = got.withColumn("_a", F.explode("a__rows")).withColumn("_b", F.explode("b__rows"))
    of = {c: F.col(f"_{p}" if len(rest) == 1 else f"_{p}.{c}").alias(c) for p, rest in (("a", ra), ("b", rb)) for c in rest}
    return got.select(*[of.get(c, c) for c in (*left.columns, *right.columns)])


def pairs(a, b, b_columns: list[str] | None = None, strategy: str = "auto", width: float | None = None, a_columns: list[str] | None = None) -> DataFrame:
    """One row per overlapping pair, columns ``a_*`` and ``b_*``; keys, start, end and what is asked for."""
    keys = _keys(a, b)
    how = choose(a, b, keys, True) if strategy == "auto" else strategy
    left, right = sides(a, b, b_columns, a_columns)
    cond = _condition(keys)
    if how == "grouped":
        return _pairs_grouped(a, b, left, right, keys, width)
    if how == "equi":
        return left.join(right, cond)
    if how == "broadcast":
        if min(a.stats().rows, b.stats().rows) > SMALL_ROWS:
            raise ValueError(f"neither side has at most {SMALL_ROWS} rows; use strategy='binned'")
        small_b = b.stats().rows <= a.stats().rows
        return left.join(F.broadcast(right), cond) if small_b else F.broadcast(left).join(right, cond).select(*left.columns, *right.columns)
    return met(left, right, grid_of(a, b, width), cond).select(*left.columns, *right.columns)


def outer(a, b, b_columns: list[str] | None = None, strategy: str = "auto", width: float | None = None) -> DataFrame:
    """As ``pairs``, and at least one row for each row of a: where ``b_*`` is NULL the row says nothing, and there may be several such."""
    keys = _keys(a, b)
    how = choose(a, b, keys) if strategy == "auto" else strategy
    left, right = sides(a, b, b_columns)
    cond = _condition(keys)
    if how == "equi" and keys:
        return left.join(right, cond, "left")
    if how == "broadcast" and b.stats().rows <= SMALL_ROWS:
        return left.join(F.broadcast(right), cond, "left")
    return met(left, right, grid_of(a, b, width), cond, "left")


def per_probe(a, b, aggregates: list[Column], carry: list[str] = (), b_columns: list[str] = (), strategy: str = "auto") -> DataFrame:
    """qid, the probe's columns ``carry`` and ``aggregates`` over its partners."""
    found = outer(a, b, list(b_columns), strategy)
    kept = [F.first(f"a_{c}").alias(c) for c in carry]
    return found.groupBy(F.col("a_ord").alias("qid")).agg(*kept, *aggregates)


def exists(a, b, negate: bool = False, strategy: str = "auto") -> DataFrame:
    """Rows of a that have (or, negated, lack) an overlap in b: by keys or a small side, else by a running maximum."""
    keys = _keys(a, b)
    how = choose(a, b, keys) if strategy == "auto" else strategy
    left, right = sides(a, b, [])
    cond = _condition(keys)
    kind = "left_anti" if negate else "left_semi"
    if how == "equi" and keys:
        return left.join(right, cond, kind)
    if how == "broadcast" and b.stats().rows <= SMALL_ROWS:
        return left.join(F.broadcast(right), cond, kind)
    # a join would make all pairs to tell that there is one
    got = sweep.marked(a, b, a.window_parts_with(b)).where(~F.col("_hit") if negate else F.col("_hit"))
    return got.select([F.col(c).alias(f"a_{c}") for c in a.df.columns])
