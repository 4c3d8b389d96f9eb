"""What the operators share: tables, folders, text expressions and a hot-key join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where all is one machine, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, **options) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends in files that outlive executors. options: the writer's.

    The files stay until the folder's owner clears it; they are named by application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to the shared folder, through Hadoop's file system, and returns its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that cut() wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if spark.sparkContext.applicationId in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; texts of ASCII alone take Spark's byte-wise lower()."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))
