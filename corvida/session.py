"""Sessions, table loading and shared-storage helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; on a cluster pass only what differs."""
    builder = (
        SparkSession.builder.master(master)
        .appName("corvida")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("CORVIDA_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a single parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs in
    one machine (tests); on a cluster a missing setting is an error, as no machine's own folder will do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corvida-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    What is read again does not depend on any executor, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvida-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a ``written`` frame that nothing reads any more, as loops do with their last round's."""
    path = getattr(df, "written_to", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(spark: SparkSession) -> None:
    """Remove this library's tables from a local shared folder (tests and benchmarks)."""
    path = shared_dir(spark)
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        for entry in os.listdir(local):
            if entry.startswith("corvida-"):
                shutil.rmtree(os.path.join(local, entry), ignore_errors=True)
