"""Session settings shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster, use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir. One of our own is set only where the session names none (tests, one machine)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "spark-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the folder of spark.checkpoint.dir, and reads it.

    A table takes a fraction of the disk of a checkpoint, whose rows aren't compressed.
    """
    path = f"{_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same as a table in buckets of the keys, as many as shuffle partitions, each one file: what groups or joins by these
    keys later finds the rows where they have to be, without an exchange. The table is external, in the same folder."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(number, *keys).write.bucketBy(number, *keys).sortBy(*keys)
    dealt.option("path", f"{_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
