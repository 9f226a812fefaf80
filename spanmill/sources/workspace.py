"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local: str | None = None


def workspace(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may do without one; it gets a temporary folder."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="spanmill-")
    return _local


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as a table in the workspace: lineage ends there, and lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` named, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
