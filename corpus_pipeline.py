"""A training corpus from ``documents``: language, near duplicates, benchmark passages, personal data, packing.

Stages take (spark, docs, sf_dir), are written as Parquet and read again. All but the
last return the columns of their input. Tables that a stage writes for itself, and the
stage before, are deleted when its result stands. NULLs, empty and long texts, ties,
repeated rows and empty tables are as the operators define them. Columns beyond doc_id and text are carried
under positional names, so that no name can clash with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import decontaminate, langid, minhash, packing, pii
from spanmill.llm.common import Scratch, fresh_path
from spanmill.sources.workspace import remove


def _sealed(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """The same rows with columns c0, c1, ...; and which of them are doc_id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: names[i] for i, n in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*names), names, at["doc_id"], at["text"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go; the profiles are learned from the given ones.

    Where nothing can be learned (no lang column, or no text with a lang), none is rejected.
    """
    df, names, _, text = _sealed(docs)
    profiles = langid.learn(docs.select("text", "lang")) if "lang" in docs.columns else {}
    if not profiles:
        return docs
    got = langid.identify(df, profiles, names, text)
    return got.where(F.col("lang_pred") != langid.UNDETERMINED).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; of repeated rows, one."""
    df, names, doc_id, text = _sealed(docs)
    got = minhash.near_duplicates(docs.select("doc_id", "text"))
    drop = got.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = df.join(drop, F.col(doc_id) == F.col("_gone"), "left_anti").withColumn("_null", F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates([doc_id, "_null"]).select(*names).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    df, names, _, text = _sealed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.flagged(df, items, names, text)
    return got.where("NOT contaminated AND _at >= 0").select(*names).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars``, where there is one, follows the text."""
    df, names, _, text = _sealed(docs)
    got = pii.annotate(df, names, text)
    clean = pii.with_redacted(got, text, "spans")
    for i, n in enumerate(docs.columns):
        if n == "n_chars":
            clean = clean.withColumn(names[i], F.when(F.col(names[i]).isNotNull(), F.length(text)).cast(docs.schema[i].dataType))
    return clean.select(*names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of at most 2048."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with Scratch(spark):  # what a stage wrote for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: Tokens and learned profiles have no SQL form; the tests hold the result against a brute-force version.
ORACLE_SQL = None
