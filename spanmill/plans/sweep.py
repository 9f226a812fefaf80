"""Counting without a join: running sums over the sorted end points of both sides.

``count(q) = #(b.start <= q.end) - #(b.end < q.start)``, valid since start <= end
on both sides. At equal coordinates a start comes before a probe, a probe before
an end. Cost is that of a sort, whatever the number of overlapping pairs. A NULL key
matches nothing, as in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.plans.running import ranged, running


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that can match: those without a NULL key."""
    return df.dropna(subset=keys) if keys else df


def run(events: DataFrame, keys: list[str], specs, parts: int | None) -> DataFrame:
    events = ranged(events, keys, "_x", parts) if parts else events
    return running(events, keys, [F.col("_x"), F.col("_o")], specs, parts)


def rank_count(a, b, parts: int | None = None) -> DataFrame:
    """(ord, n): overlaps of each row of a."""
    keys = list(a.keys)
    zero, one, none = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(None).cast(a.df.schema["ord"].dataType)

    def part(df, x, o, ds, de, q, kind):
        return df.select(*keys, F.col(x).alias("_x"), F.lit(o).alias("_o"), ds.alias("_ds"), de.alias("_de"), q.alias("_q"), F.lit(kind).alias("_kind"))

    # every row's two events come from one evaluation of it
    both = F.explode(F.array(F.struct(F.col("end").alias("x"), F.lit(1).alias("kind")), F.struct(F.col("start").alias("x"), F.lit(2).alias("kind")))).alias("p")
    probes = a.df.select(*keys, F.col("ord"), both).select(*keys, F.col("p.x").alias("_x"), F.lit(1).alias("_o"), zero.alias("_ds"), zero.alias("_de"), F.col("ord").alias("_q"), F.col("p.kind").alias("_kind"))
    stored = keyed(b.df, keys)
    events = part(stored, "start", 0, one, zero, none, 0).unionByName(part(stored, "end", 2, zero, one, none, 0)).unionByName(probes)
    got = run(events, keys, [("_s", "_ds", "sum"), ("_e", "_de", "sum")], parts)
    return (
        got.where("_kind > 0")
        .groupBy("_q")
        .agg((F.max(F.when(F.col("_kind") == 1, F.col("_s"))) - F.max(F.when(F.col("_kind") == 2, F.col("_e")))).alias("n"))
        .withColumnRenamed("_q", "ord")
    )


def marked(a, b, parts: int | None = None) -> DataFrame:
    """The rows of a with ``_hit``: whether the largest end among ``b.start <= a.end`` reaches ``a.start``. Every row of either side moves once; no pair is made."""
    keys = list(a.keys)
    own = [c for c in a.df.columns if c not in keys]
    none = [F.lit(None).cast(a.df.schema[c].dataType).alias(c) for c in own]
    at = b.df.schema["end"].dataType
    events = keyed(b.df, keys).select(*keys, F.col("start").alias("_x"), F.lit(0).alias("_o"), F.col("end").alias("_end"), *none).unionByName(
        a.df.select(*keys, F.col("end").alias("_x"), F.lit(1).alias("_o"), F.lit(None).cast(at).alias("_end"), *own)
    )
    got = run(events, keys, [("_m", "_end", "max")], parts)
    return got.where("_o = 1").select(*a.df.columns, F.coalesce(F.col("_m") >= F.col("start"), F.lit(False)).alias("_hit"))


def running_exists(a, b, parts: int | None = None) -> DataFrame:
    """(ord, hit): whether a row of a overlaps any of b."""
    return marked(a, b, parts).select("ord", F.col("_hit").alias("hit"))
