"""Interval set algebra within the key columns. Every operator returns a DataFrame of keys, start, end and payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.combine import combiner
from spanmill.functions.predicates import saturating_add
from spanmill.plans import rangejoin
from spanmill.plans.running import islands


def _order(fold_order: str) -> list:
    return [F.col("start"), F.col("end").desc() if fold_order == "index" else F.col("end"), F.col("ord")]


def _fold(fold_order: str):
    return F.struct("start", (-F.col("end") if fold_order == "index" else F.col("end")).alias("e"), "ord")


def span(self) -> DataFrame:
    """keys, start, end: hull of each contig; no row for an empty frame."""
    return self.df.groupBy(*self.keys).agg(F.min("start").alias("start"), F.max("end").alias("end")) if self.keys else self.df.agg(F.min("start").alias("start"), F.max("end").alias("end")).where("start IS NOT NULL")


def merge_overlaps(self, combine="first", fold_order: str = "end") -> DataFrame:
    """Runs of overlapping intervals as one; touching at a point merges, adjacency does not."""
    with_island = islands(self.df, list(self.keys), _order(fold_order), self.window_parts())
    return with_island.groupBy(*self.keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), combiner(combine, "value", _fold(fold_order)).alias("value"), F.count("*").alias("n")).drop("_island")


def gaps(self, lo: int | None = None, hi: int | None = None, bounds: DataFrame | None = None, fill=None) -> DataFrame:
    """Complement of the merged set inside [lo, hi], or inside the (keys, lo, hi) rows of ``bounds``."""
    self.require_integral("gaps")
    keys = list(self.keys)
    if bounds is None:
        if lo is None or hi is None:
            raise ValueError("gaps needs lo and hi, or bounds")
        spark = self.df.sparkSession
        bounds = (self.df.select(*keys).distinct() if keys else spark.range(1)).select(*keys, F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
    bounds = bounds.select(*keys, F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))
    geometry = self.df.select(*keys, "start", "end", "ord")
    flagged = islands(geometry, keys, _order("end"), self.window_parts()).where("_new = 1").select(*keys, "start", "_pm")
    hull = geometry.groupBy(*keys).agg(F.max("end").alias("_last"))
    if keys:
        between, after = flagged.join(bounds, keys), bounds.join(hull, keys, "left")
    else:
        between, after = flagged.join(F.broadcast(bounds)), bounds.join(F.broadcast(hull), F.lit(True), "left")
    inner = between.select(*keys, F.greatest(F.col("_pm") + 1, F.col("lo")).alias("start"), F.least(F.col("start") - 1, F.col("hi")).alias("end"))
    outer = after.select(*keys, F.greatest(F.col("_last") + 1, F.col("lo")).alias("start"), F.col("hi").alias("end"))
    return inner.unionByName(outer).where("start <= end").withColumn("value", F.lit(fill))


def _concat(self, other):
    """Own rows first, then the other's; ``ord`` becomes (side, ord)."""
    def side(f, n):
        return f.df.select(*f.keys, "start", "end", "value", F.struct(F.lit(n).alias("side"), F.col("ord").alias("ord")).alias("ord"))

    return self._with(side(self, 0).unionByName(side(other, 1)))


def union_with(self, other, combine="first", fold_order: str = "end") -> DataFrame:
    """Both sides' intervals, merged."""
    return merge_overlaps(_concat(self, other), combine, fold_order)


def intersection(self, other, combine="first", strategy="auto") -> DataFrame:
    """For every overlapping pair its common part; not coalesced, duplicates kept.

    ``combine``: 'first' keeps this side's payload, 'last' the other's, 'collect'
    both as a struct; a callable gets both columns.
    """
    found = rangejoin.pairs(self, other, ["value"], strategy)
    a, b = F.col("a_value"), F.col("b_value")
    value = {"first": a, "last": b, "collect": F.struct(a.alias("a"), b.alias("b"))}[combine] if isinstance(combine, str) else combine(a, b)
    return found.select(*[F.col(f"a_{k}").alias(k) for k in self.keys], F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), value.alias("value"))


def difference(self, other, strategy="auto") -> DataFrame:
    """Each own row less everything the other side covers; pieces keep the payload."""
    self.require_integral("difference")
    keys = list(self.keys)
    # covers are merged first: each row then meets disjoint covers only
    merged = islands(other.df.select(*keys, "start", "end", "ord"), keys, _order("end"), other.window_parts()).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("ord"))
    covers = other._with(merged.select(*keys, "start", "end", F.lit(None).cast("bigint").alias("value"), "ord"))
    covers._stats = other.stats()
    p = rangejoin.outer(self, covers, [], strategy)
    hit = F.col("b_start").isNotNull()
    p = p.select(*[F.col(f"a_{c}").alias(c) for c in (*keys, "start", "end", "value", "ord")], F.when(hit, F.greatest("a_start", "b_start")).alias("cs"), F.when(hit, F.least("a_end", "b_end")).alias("ce"))
    w = Window.partitionBy("ord").orderBy("cs")
    p = p.withColumns({"pe": F.lag("ce").over(w), "nx": F.lead("cs").over(w), "rn": F.row_number().over(w), "any": F.max("cs").over(Window.partitionBy("ord"))})
    p = p.where("cs IS NOT NULL OR rn = 1 AND any IS NULL")  # of a row that meets no cover, one
    before = F.struct(F.coalesce(F.col("pe") + 1, F.col("start")).alias("s"), (F.col("cs") - 1).alias("e"))
    after = F.struct(F.coalesce(F.col("ce") + 1, F.col("start")).alias("s"), F.col("end").alias("e"))
    pieces = F.when(F.col("cs").isNull(), F.array(after)).when(F.col("nx").isNull(), F.array(before, after)).otherwise(F.array(before))
    out = p.select(*keys, "value", F.explode(F.filter(pieces, lambda x: x["s"] <= x["e"])).alias("x"))
    return out.select(*keys, F.col("x.s").alias("start"), F.col("x.e").alias("end"), "value")


def symmetric_difference(self, other, combine="first", strategy="auto") -> DataFrame:
    """What exactly one side covers, coalesced."""
    left, right = self.derive(difference(self, other, strategy)), self.derive(difference(other, self, strategy))
    return union_with(left, right, combine)


def expand(self, left: int, right: int, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Grow (or shrink) both ends, clamped to [lo, hi]; what becomes inverted is dropped."""
    self.require_integral("expand")
    return self.df.select(*self.keys, saturating_add(F.col("start"), -left, lo=lo).alias("start"), saturating_add(F.col("end"), right, hi=hi).alias("end"), "value").where("start <= end")


def flank(self, left: int, right: int, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The stretches just outside each interval; at most two rows each, originals not included."""
    self.require_integral("flank")
    s, e = F.col("start"), F.col("end")
    sides = []
    if left > 0:
        ls, le = saturating_add(s, -left, lo=lo), saturating_add(s, -1)
        sides.append(F.when((s > (lo if lo is not None else -(2**63))) & (ls <= le) & (le <= (hi if hi is not None else 2**63 - 1)), F.struct(ls.alias("s"), le.alias("e"))))
    if right > 0:
        rs, re = saturating_add(e, 1), saturating_add(e, right, hi=hi)
        sides.append(F.when((e < (hi if hi is not None else 2**63 - 1)) & (rs <= re) & (rs >= (lo if lo is not None else -(2**63))), F.struct(rs.alias("s"), re.alias("e"))))
    if not sides:
        return self.df.select(*self.keys, "start", "end", "value").limit(0)
    out = self.df.select(*self.keys, "value", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("x"))
    return out.select(*self.keys, F.col("x.s").alias("start"), F.col("x.e").alias("end"), "value")


def unique(self, combine="first") -> DataFrame:
    """One row per exact (start, end)."""
    return self.df.groupBy(*self.keys, "start", "end").agg(combiner(combine, "value", F.struct("ord")).alias("value"), F.count("*").alias("n"))
