"""Overlap queries. Each takes a frame of queries and answers all of them in one plan.

``self`` holds the stored intervals, ``queries`` the probes, both with the same
keys. Results carry the query's ``ord`` as ``qid``. Lists are in descending
canonical index, as documented for the API; long forms are bags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.plans import rangejoin, sweep

#: Average overlaps per query from which counting by running sums beats the join.
SWEEP_ROWS = 128


def one(self, start, end):
    """A frame holding the single query (start, end), for frames without keys."""
    from spanmill.frame import IntervalFrame

    return IntervalFrame.from_arrays(self.df.sparkSession, [start], [end])


def _pairs(self, queries, columns, strategy="auto") -> DataFrame:
    return rangejoin.pairs(queries, self, columns, strategy, a_columns=["ord"])


def _query_columns(queries):
    return [F.col(f"a_{k}").alias(k) for k in queries.keys] + [F.col("a_ord").alias("qid")]


def search_values(self, queries, strategy="auto") -> DataFrame:
    """keys, qid, value: payloads of all overlaps, duplicates kept."""
    return _pairs(self, queries, ["value"], strategy).select(*_query_columns(queries), F.col("b_value").alias("value"))


def search_keys(self, queries, strategy="auto") -> DataFrame:
    """keys, qid, start, end."""
    return _pairs(self, queries, [], strategy).select(*_query_columns(queries), F.col("b_start").alias("start"), F.col("b_end").alias("end"))


def search_items(self, queries, strategy="auto") -> DataFrame:
    """keys, qid, start, end, value."""
    return _pairs(self, queries, ["value"], strategy).select(*_query_columns(queries), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("b_value").alias("value"))


def search_idxs(self, queries, strategy="auto") -> DataFrame:
    """keys, qid, idx: canonical positions."""
    return _pairs(self.indexed(), queries, ["idx"], strategy).select(*_query_columns(queries), F.col("b_idx").alias("idx"))


def _points(queries):
    return queries._with(queries.df.withColumn("end", F.col("start")))


def search_point(self, points, strategy="auto") -> DataFrame:
    """Payloads of intervals that contain the points' ``start``."""
    return search_values(self, _points(points), strategy)


def count_point(self, points, strategy="auto") -> DataFrame:
    return count(self, _points(points), strategy)


def _lists(self, queries, what) -> DataFrame:
    pair = F.when(F.col("b_idx").isNotNull(), F.struct(F.col("b_idx").alias("idx"), F.col("b_value").alias("value")))
    found = F.sort_array(F.collect_list(pair), asc=False).alias("found")
    got = rangejoin.per_probe(queries, self.indexed(), [found], b_columns=["idx", "value"])
    return got.select("qid", F.transform("found", lambda x: x[what]).alias({"idx": "idxs", "value": "values"}[what]))


def search_idxs_batch(self, queries) -> DataFrame:
    """qid, idxs: one list per query, empty where nothing overlaps."""
    return _lists(self, queries, "idx")


def search_values_batch(self, queries) -> DataFrame:
    """qid, values: one list per query; NULL payloads are kept."""
    return _lists(self, queries, "value")


def has_overlaps(self, queries, strategy="auto") -> DataFrame:
    """qid, hit: whether anything overlaps, false included."""
    if strategy in ("sweep", "auto"):
        return sweep.running_exists(queries, self, self.window_parts_with(queries)).withColumnRenamed("ord", "qid")
    return count(self, queries, strategy).select("qid", (F.col("n") > 0).alias("hit"))


def with_overlaps(self, queries, strategy="auto") -> DataFrame:
    """The query rows that overlap something (semi join)."""
    return _strip(queries, rangejoin.exists(queries, self, False, strategy))


def without_overlaps(self, queries, strategy="auto") -> DataFrame:
    """The query rows that overlap nothing (anti join)."""
    return _strip(queries, rangejoin.exists(queries, self, True, strategy))


def _strip(queries, df) -> DataFrame:
    return df.select([F.col(f"a_{c}").alias(c) for c in queries.df.columns])


def count(self, queries, strategy="auto") -> DataFrame:
    """qid, n: number of overlaps, 0 included."""
    if strategy == "auto":
        s = self.stats()
        dense = s.rows and s.high > s.low and s.max_rows * s.typical / (s.high - s.low) > SWEEP_ROWS
        strategy = "sweep" if dense else "auto"
    if strategy == "sweep":
        return sweep.rank_count(queries, self, self.window_parts_with(queries)).withColumnRenamed("ord", "qid")
    return rangejoin.per_probe(queries, self, [F.count("b_start").alias("n")], strategy=strategy)


def coverage(self, queries, strategy="auto", inclusive: bool = False, carry: list[str] = ()) -> DataFrame:
    """qid, n, covered: overlaps and the sum of ``min(ends) - max(starts)`` (plus one each if ``inclusive``); ``carry`` adds columns of the query."""
    part = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + (1 if inclusive else 0)
    covered = F.coalesce(F.sum(F.when(F.col("b_start").isNotNull(), part)), F.lit(0).cast("bigint" if self.integral and queries.integral else "double"))
    return rangejoin.per_probe(queries, self, [F.count("b_start").alias("n"), covered.alias("covered")], carry, strategy=strategy)


def total_overlaps(self, queries, strategy="auto") -> DataFrame:
    """One row, n: overlaps of all queries together."""
    if strategy == "sweep":
        return sweep.rank_count(queries, self, self.window_parts_with(queries)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    return _pairs(self, queries, [], strategy).agg(F.count("*").alias("n"))


def upper_bound(self, points) -> DataFrame:
    """qid, idx: largest canonical index whose start is at most the point's ``start``; NULL where none is, or with a NULL key."""
    keys = list(self.keys)
    kind = points.df.schema["ord"].dataType
    events = sweep.keyed(self.df, keys).select(*keys, F.col("start").alias("_x"), F.lit(0).alias("_o"), F.lit(1).cast("bigint").alias("_one"), F.lit(None).cast(kind).alias("qid")).unionByName(
        points.df.select(*keys, F.col("start").alias("_x"), F.lit(1).alias("_o"), F.lit(0).cast("bigint").alias("_one"), F.col("ord").alias("qid"))
    )
    run = sweep.run(events, keys, [("_n", "_one", "sum")], self.window_parts_with(points))
    return run.where("_o = 1").select("qid", F.when(F.col("_n") > 0, F.col("_n") - 1).alias("idx"))
