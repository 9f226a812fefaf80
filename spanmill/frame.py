"""IntervalFrame: a DataFrame of closed intervals with keys, payload and a unique row number."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.predicates import INTEGRAL
from spanmill.operators import query, setops
from spanmill.plans.running import ranged, running
from spanmill.sources.workspace import fresh_path, nullable, remove

#: Rows of one contig from which its windows are split into ranges, and rows a range then has.
HOT_ROWS, RANGE_ROWS = 2_000_000, 500_000


@dataclass(frozen=True)
class Stats:
    """What chooses strategies: rows, rows of the largest contig, the longest and a typical length, the outermost finite coordinates."""

    rows: int
    max_rows: int
    longest: float
    typical: float
    low: float
    high: float


class IntervalFrame:
    """Intervals as columns ``*keys, start, end, value, ord``.

    Integral coordinates become BIGINT. Rows with a NULL (or NaN) coordinate never match
    and are dropped; inverted rows (start > end) are dropped, swapped or refused by
    ``on_inverted``. A row with a NULL key matches nothing. ``ord`` must be unique; without
    one, rows are numbered, and the numbers hold within one result (``numbered`` fixes them).
    ``stats`` spares the aggregate that would gather them.
    """

    def __init__(self, df: DataFrame, keys=("contig",), start="start", end="end", value: str | None = "value", ord: str | None = None, on_inverted: str = "drop", stats: Stats | None = None):
        s, e = F.col(start), F.col(end)
        types = {df.schema[c].dataType.__class__ for c in (start, end)}
        self.integral = all(issubclass(t, INTEGRAL) for t in types)
        if self.integral:
            s, e = s.cast("bigint"), e.cast("bigint")
        if on_inverted == "swap":
            s, e = F.least(s, e), F.greatest(s, e)
        elif on_inverted == "error":
            bad = F.raise_error(F.lit("interval with start > end"))
            s = F.when(s > e, bad.cast(df.select(s).schema[0].dataType)).otherwise(s)
        elif on_inverted != "drop":
            raise ValueError(f"on_inverted: {on_inverted!r}")
        number = F.col(ord) if ord else F.monotonically_increasing_id()
        payload = F.col(value) if value and value in df.columns else F.lit(None).cast("bigint")
        keep = F.col(start).isNotNull() & F.col(end).isNotNull()
        for c in (start, end):
            if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
                keep = keep & ~F.isnan(F.col(c))
        if on_inverted == "drop":
            keep = keep & (F.col(start) <= F.col(end))
        self.keys = tuple(keys)
        self.df = df.where(keep).select(*self.keys, s.alias("start"), e.alias("end"), payload.alias("value"), number.alias("ord"))
        self._stats: Stats | None = stats
        self._copies: tuple[int, int] | None = None
        self._path: str | None = None

    # construction and lifecycle ------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession, value_type: str = "bigint", keys=()) -> IntervalFrame:
        fields = ", ".join([*(f"{k} string" for k in keys), "start bigint", "end bigint", f"value {value_type}", "ord bigint"])
        return cls(spark.createDataFrame([], fields), keys=keys, ord="ord")

    @classmethod
    def from_arrays(cls, spark: SparkSession, starts, ends, values=None, value_type: str | None = None) -> IntervalFrame:
        """Bulk construction from equally long sequences."""
        starts, ends = list(starts), list(ends)
        if len(starts) != len(ends):
            raise ValueError("starts and ends must have the same length")
        if values is not None and len(values := list(values)) != len(starts):
            raise ValueError("values must have the same length as starts")
        values = values if values is not None else [None] * len(starts)
        kind = value_type or next((t for v in values if v is not None for t in [{int: "bigint", float: "double", str: "string", bool: "boolean"}.get(type(v))] if t), "bigint")
        rows = [(int(s), int(e), v, i) for i, (s, e, v) in enumerate(zip(starts, ends, values, strict=True))]
        return cls(spark.createDataFrame(rows, f"start bigint, end bigint, value {kind}, ord bigint"), keys=(), ord="ord")

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, value_type: str | None = None) -> IntervalFrame:
        rows = list(rows)
        return cls.from_arrays(spark, [r[0] for r in rows], [r[1] for r in rows], [r[2] if len(r) > 2 else None for r in rows], value_type)

    def add(self, start, end, value=None) -> IntervalFrame:
        """A new frame with one more interval; build from many rows instead where there are many."""
        if self.keys:
            raise ValueError("add() is for frames without key columns; union a DataFrame instead")
        spark = self.df.sparkSession
        kind = self.df.schema["value"].dataType
        top = self.df.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 1).first()[0]
        row = spark.createDataFrame([(int(start), int(end), value, int(top))], T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", kind), T.StructField("ord", T.LongType())]))
        return self._with(self.df.unionByName(row))

    def _with(self, df: DataFrame) -> IntervalFrame:
        out = object.__new__(IntervalFrame)
        out.df, out.keys, out.integral, out._stats, out._copies, out._path = df, self.keys, self.integral, None, None, None
        return out

    def derive(self, df: DataFrame) -> IntervalFrame:
        """A frame over ``df``, which has this frame's keys and start, end, value; rows are numbered anew."""
        return IntervalFrame(df, keys=self.keys)

    def numbered(self) -> IntervalFrame:
        """The same rows as a written table, so that their numbers are the same wherever it is read."""
        spark, path = self.df.sparkSession, fresh_path(self.df.sparkSession, "numbered")
        self.save(path)
        out = self._with(spark.read.schema(nullable(self.df.schema)).parquet(path))
        out._stats, out._copies, out._path = self._stats, self._copies, path
        return out

    def build(self, partitions: int | None = None) -> IntervalFrame:
        """Co-locate each contig's ranges and sort them: start ascending, end descending."""
        cols = [*self.keys, "start"]
        df = self.df.repartitionByRange(partitions, *cols) if partitions else self.df.repartitionByRange(*cols)
        return self._with(df.sortWithinPartitions(*self.keys, F.asc("start"), F.desc("end"), "ord"))

    def clear(self) -> IntervalFrame:
        return self._with(self.df.limit(0))

    def reserve(self, n: int) -> IntervalFrame:
        """A capacity hint; Spark manages memory."""
        return self

    def destroy(self) -> None:
        """Let go of what the frame holds: cached blocks, and the table that ``numbered`` wrote."""
        self.df.unpersist()
        if self._path:
            remove(self.df.sparkSession, self._path)
            self._path = None

    def size(self) -> int:
        return self.df.count()

    __len__ = size

    def save(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    def stats(self) -> Stats:
        """Row counts and lengths that choose strategies; one aggregate, kept."""
        if self._stats is None:
            s, e = F.col("start").cast("double"), F.col("end").cast("double")
            finite = (F.abs(s) < float("inf")) & (F.abs(e) < float("inf"))
            span = F.when(finite, e - s)
            size = F.log1p(span) if self.integral else F.when(span > 0, F.log(span))
            edges = [F.min("start"), F.max("end")] if self.integral else [F.min(F.when(F.abs(x) < float("inf"), x)) for x in (s, e)] + [F.max(F.when(F.abs(x) < float("inf"), x)) for x in (s, e)]
            per = self.df.groupBy(*self.keys).agg(F.count("*").alias("_n"), F.max(span).alias("_m"), F.sum(size).alias("_l"), F.count(size).alias("_k"), F.count_if(~finite).alias("_open"), *[x.alias(f"_x{i}") for i, x in enumerate(edges)])
            r = per.agg(F.sum("_n"), F.max("_n"), F.max("_m"), F.sum("_l"), F.sum("_k"), F.sum("_open"), *[F.min(f"_x{i}") for i in range(len(edges))], *[F.max(f"_x{i}") for i in range(len(edges))]).first()
            known = [x for x in r[6:] if x is not None]
            low, high = (min(known), max(known)) if known else (0, 0)
            longest = (r[2] or 0) if not r[5] else high - low
            typical = math.exp(r[3] / r[4]) if r[4] else 1.0 if self.integral else (high - low) / max(1, r[0] or 0)
            self._stats = Stats(r[0] or 0, r[1] or 0, longest, typical, low, high)
        return self._stats

    def copies(self) -> tuple[int, int]:
        """Rows of a distinct (keys, start, end), the median and the most; one aggregate, kept."""
        if self._copies is None:
            median, most = self.df.groupBy(*self.keys, "start", "end").agg(F.count("*").alias("_n")).agg(F.percentile_approx("_n", 0.5), F.max("_n")).first()
            self._copies = (median or 1, most or 1)
        return self._copies

    def window_parts(self) -> int | None:
        """Ranges for windows over a contig too large for a task; None where none is."""
        s = self.stats()
        return max(64, -(-s.rows // RANGE_ROWS)) if s.max_rows > HOT_ROWS else None

    def window_parts_with(self, other: IntervalFrame) -> int | None:
        """As ``window_parts``, for windows over the rows of both frames."""
        split = [n for n in (self.window_parts(), other.window_parts()) if n]
        if split:
            return sum(split)
        return 64 if self.stats().max_rows + other.stats().max_rows > HOT_ROWS else None

    # element access ------------------------------------------------------------------

    def with_index(self) -> DataFrame:
        """Canonical position ``idx`` (from 0) within the keys: start ascending, end descending."""
        keys, parts = list(self.keys), self.window_parts()
        df = self.df.withColumn("_one", F.lit(1).cast("bigint"))
        df = ranged(df, keys, "start", parts) if parts else df
        return running(df, keys, [F.asc("start"), F.desc("end"), F.asc("ord")], [("idx", "_one", "sum")], parts).select(*self.df.columns, (F.col("idx") - 1).alias("idx"))

    def indexed(self) -> IntervalFrame:
        return self._with(self.with_index())

    def at(self, index: int, **keys):
        """(start, end, value) at a canonical index; IndexError outside."""
        df = self.with_index().where(F.col("idx") == index)
        for k, v in keys.items():
            df = df.where(F.col(k) == v)
        row = df.select("start", "end", "value").first() if index >= 0 else None
        if row is None:
            raise IndexError("index out of range")
        return tuple(row)

    def starts_at(self, index: int, **keys):
        return self.at(index, **keys)[0]

    def ends_at(self, index: int, **keys):
        return self.at(index, **keys)[1]

    def data_at(self, index: int, **keys):
        return self.at(index, **keys)[2]

    def require_integral(self, what: str) -> None:
        if not self.integral:
            raise TypeError(f"{what} needs integral coordinates; map dates to day numbers first")

    # operators -----------------------------------------------------------------------

    search_values = query.search_values
    search_values_large = query.search_values
    find_overlaps = query.search_values
    search_idxs = query.search_idxs
    search_keys = query.search_keys
    search_items = query.search_items
    search_point = query.search_point
    search_stabbed = query.search_point
    search_idxs_batch = query.search_idxs_batch
    search_values_batch = query.search_values_batch
    has_overlaps = query.has_overlaps
    any_overlaps = query.has_overlaps
    with_overlaps = query.with_overlaps
    without_overlaps = query.without_overlaps
    upper_bound = query.upper_bound
    count = query.count
    count_linear = query.count
    count_large = query.count
    count_batch = query.count
    count_point = query.count_point
    coverage = query.coverage
    total_overlaps = query.total_overlaps
    one = query.one
    span = setops.span
    merge_overlaps = setops.merge_overlaps
    gaps = setops.gaps
    union_with = setops.union_with
    intersection = setops.intersection
    difference = setops.difference
    symmetric_difference = setops.symmetric_difference
    expand = setops.expand
    flank = setops.flank
    unique = setops.unique
