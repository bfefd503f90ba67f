"""Reading the corpus tables and cutting lineage on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.plans.session import shared_dir, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors never recompute past this point."""
    return durable_at(df, label)[0]


def durable_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same, and where it is, for ``discard`` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meridion-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``durable_at`` or a pipeline stage wrote, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that their names can't clash with an operator's own."""
    rest = [col for c, col in zip(docs.columns, columns_of(docs), strict=True) if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id"), F.col("text"), (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order, from a table made of ``packed(docs)``."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns])
