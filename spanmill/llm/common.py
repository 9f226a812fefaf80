"""Shared pieces: tables on shared storage, checked broadcasts, positions in texts, and connected components."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanmill.sources import workspace
from spanmill.sources.workspace import fresh_path

#: Rows of a few numbers each that one task writes, where their count is known.
ROWS_PER_FILE = 500_000
#: Rows of a few numbers up to which a table is broadcast; bytes of larger things.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20

#: Edges up to which the least neighbours of all nodes are broadcast.
STAR_ROWS = 250_000

_scratch: list[Scratch] = []


class Scratch:
    """Tables that ``cut`` writes inside are deleted at the end, but for those that ``keep`` names; these go to the scratch around it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        _scratch.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._at)
        return table

    def __exit__(self, *_) -> None:
        _scratch.pop()
        for path in self.paths:
            if path not in self.kept:
                workspace.remove(self.spark, path)
            elif _scratch:
                _scratch[-1].paths.append(path)


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """``df`` as a table in the workspace: lineage ends there, and lost executors cost no recomputation.

    Where about how many rows come is known, the files are not more than these need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _scratch:
        _scratch[-1].paths.append(path)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    out = spark.read.schema(workspace.nullable(df.schema)).parquet(path)
    out._at = path
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast where its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def counted(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` as a table, and its rows, counted while writing; ``rows``: how many there are at most."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name, rows)
    return out, seen.get.get("n", 0)


@contextlib.contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20):
    """Arrow batches hold at most ``rows`` rows and about ``size`` bytes (for wide rows); for eager work only."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sealed(df: DataFrame, columns: list[str], *also: str) -> tuple[DataFrame, list[str], list[str]]:
    """``columns`` under positional names that clash with nothing, the columns ``also`` after them; and both lists of names."""
    names = [f"c{i}_" for i in range(len(columns))]
    more = [f"a{i}_" for i in range(len(also))]
    picked = [df[c] if df.columns.count(c) == 1 else F.col(c) for c in (*columns, *also)]
    return df.select([c.alias(n) for c, n in zip(picked, names + more, strict=True)]), names, more


def _scanned(values: Column, join) -> Column:
    rounds = F.when(F.size(values) > 1, F.ceil(F.log2(F.size(values).cast("double"))).cast("int")).otherwise(F.lit(0))

    def step(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2.0), k).cast("int")
        # an array filled up with NULLs in front: zip_with pads the shorter one at its end, so the order is turned twice
        earlier = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - by, F.lit(0)))
        return F.reverse(F.zip_with(F.reverse(acc), F.reverse(earlier), join))

    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0))), values, step)).otherwise(values)


def running_total(numbers: Column) -> Column:
    """Inclusive running totals of an array of BIGINT, by doubling: log n passes over the array."""
    return _scanned(numbers, lambda x, y: x + F.coalesce(y, F.lit(0).cast("bigint")))


def running_max(values: Column) -> Column:
    """Inclusive running maxima of an array, NULLs left out, by doubling."""
    return _scanned(values, lambda x, y: F.greatest(x, y))


def running_min(values: Column) -> Column:
    return _scanned(values, lambda x, y: F.least(x, y))


#: Characters of the blocks that a text is read in.
BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of the text that ``blocks`` holds, without counting from its beginning."""
    i, j = (start / BLOCK).cast("int"), ((end - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, i), (start % BLOCK).cast("int") + 1, F.least(end - start, F.lit(BLOCK)).cast("int"))
    tail = F.substring(F.get(blocks, j), F.lit(1), ((end - 1) % BLOCK).cast("int") + 1)
    return F.when(end <= start, F.lit("")).when(i == j, head).otherwise(F.concat(head, F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), tail))


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): for the nodes of ``edges`` (u, v: BIGINT; a table) the smallest node reachable; smallest nodes are left out.

    Alternating large-star and small-star steps until nothing changes; then every node
    has one edge, to its component. Minima are plain aggregates and are joined back, as a
    broadcast while edges are few and from a table of their own beyond that, so that a hub's
    neighbours need not lie in one task; each step ends in a table. A step makes no more
    edges than it had, so their number, ``rows`` at first, sizes its files.
    """

    def aside(least: DataFrame) -> DataFrame:
        return F.broadcast(least) if rows is not None and rows <= STAR_ROWS else cut(least, "least")

    e, before = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(aside(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = aside(least)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        last = getattr(e, "_at", None)
        e, after = _marked_cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
        if last:  # the round before
            workspace.remove(edges.sparkSession, last)
        if after == before or not after[0]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._at = e._at
            return out
        before, rows = after, after[0]


def _marked_cut(e: DataFrame, rows: int | None) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksums, gathered while writing."""
    seen = Observation()
    h, g = F.xxhash64("u", "v"), F.xxhash64("v", "u")
    out = cut(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h % 1_000_003).alias("a"), F.sum(g % 998_244_353).alias("b")), "edges", rows)
    got = seen.get
    return out, (got.get("n", 0), got.get("a"), got.get("b"))
