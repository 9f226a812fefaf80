"""BED and tabular sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.frame import IntervalFrame


def read_bed(spark: SparkSession, path, half_open: bool = True, contigs: list[str] | None = None, on_inverted: str = "drop", ord: str | None = None) -> IntervalFrame:
    """Tab-separated ``contig start end ...``.

    ``half_open`` (as on disk) turns the end into ``end - 1``; rows that are then
    negative or inverted are dropped (or swapped first, by ``on_inverted='swap'``).
    Lines that don't parse are dropped; columns past the third are ignored.
    """
    df = spark.read.text(path)
    part = F.split("value", "\t")
    df = df.select(F.get(part, F.lit(0)).alias("contig"), F.expr("try_cast(trim(get(split(value, '\t'), 1)) AS bigint)").alias("start"), F.expr("try_cast(trim(get(split(value, '\t'), 2)) AS bigint)").alias("end"))
    if contigs is not None:
        df = df.where(F.col("contig").isin(contigs))
    if on_inverted == "swap":
        df = df.select("contig", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    if half_open:
        df = df.withColumn("end", F.col("end") - 1).where("end >= 0")
    return IntervalFrame(df, keys=("contig",), value=None, ord=ord, on_inverted="drop")


def write_bed(df: DataFrame, path: str, half_open: bool = True) -> None:
    """contig, start, end (closed) as BED lines."""
    end = F.col("end") + 1 if half_open else F.col("end")
    df.select(F.concat_ws("\t", F.col("contig").cast("string"), F.col("start").cast("string"), end.cast("string")).alias("value")).write.mode("overwrite").text(path)


def coverage_report(stored: IntervalFrame, queries: IntervalFrame) -> DataFrame:
    """contig, start, end, n, covered: one line per query, zeros where nothing overlaps."""
    return stored.coverage(queries, carry=[*queries.keys, "start", "end"]).select(*queries.keys, "start", "end", "n", "covered")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("sep", "\t").csv(path)


def load(spark: SparkSession, path: str, keys=("contig",)) -> IntervalFrame:
    """A frame saved with ``IntervalFrame.save``."""
    return IntervalFrame(spark.read.parquet(path), keys=keys, ord="ord")


def save_bucketed(frame: IntervalFrame, table: str, buckets: int) -> None:
    """Bucketed and sorted by the keys, so that later joins on them don't shuffle this side."""
    keys = list(frame.keys)
    frame.df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, "start").saveAsTable(table)
