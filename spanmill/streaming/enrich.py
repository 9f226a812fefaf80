"""Stream-static enrichment: streaming probes against a static set of intervals, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.frame import IntervalFrame
from spanmill.plans import rangejoin


def _stored(stored: IntervalFrame) -> DataFrame:
    return stored.df.select(*[F.col(c).alias(f"b_{c}") for c in (*stored.keys, "start", "end", "value")])


def enrich(stream: DataFrame, stored: IntervalFrame, start: str, end: str, keys: dict[str, str] | None = None, width: float | None = None) -> DataFrame:
    """Each streaming row with the stored intervals that overlap it (inner).

    ``keys`` maps the stream's key columns to the stored ones. Both sides meet in
    levelled bins: a micro-batch meets only its bins, and neither a container among the
    stored intervals nor a long probe widens them.
    """
    grid = rangejoin.grid_of(stored, stored, width)
    names = stream.columns
    probes = stream.where(F.col(start) <= F.col(end)).select(*[F.col(c).alias(f"s_{c}") for c in names], F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    cond = (F.col("b_start") <= F.col("a_end")) & (F.col("a_start") <= F.col("b_end"))
    for mine, theirs in (keys or {}).items():
        cond = cond & (F.col(f"s_{mine}") == F.col(f"b_{theirs}"))
    b = _stored(stored)
    return rangejoin.met(probes, b, grid, cond).select(*[F.col(f"s_{c}").alias(c) for c in names], *b.columns)


def enriched_batches(stored: IntervalFrame, start: str, end: str, sink: Callable[[DataFrame, int], None], keys: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: every streaming row with its overlaps, or with NULLs where it has none (left outer), given to ``sink``.

    Outer rows need all of a row's bins at once, so each micro-batch is joined as a table.
    """
    mapped = keys or {}

    def batch(df: DataFrame, number: int) -> None:
        names = df.columns
        frame = IntervalFrame(df.select(F.struct(*names).alias("value"), F.col(start).alias("start"), F.col(end).alias("end"), *[F.col(m).alias(t) for m, t in mapped.items()]), keys=tuple(mapped.values())).numbered()
        other = IntervalFrame(stored.df, keys=tuple(mapped.values()), ord="ord", stats=stored.stats())
        found = rangejoin.pairs(frame, other, ["value"])
        b = [c for c in found.columns if c.startswith("b_")]
        out = frame.df.select("ord", "value").join(found.select(F.col("a_ord").alias("ord"), *b), "ord", "left")
        sink(out.select("value.*", *b), number)

    return batch
