"""Session construction and table access."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; ``conf`` overrides single settings.

    Shuffle partitions default to the parallelism of a local master; on a cluster leave them
    to the submit command and let adaptive execution coalesce.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared(spark: SparkSession) -> str:
    """The folder of checkpoints, ``spark.checkpoint.dir``, which all executors share; only a local session without that setting gets one of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, below the ``shared`` folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table for each core from which its own splits are left to do.
SPREAD_BYTES = 32 << 20


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of a table whose rows cost much work each. A small table, which may be one row group of one file and so one task, is dealt over all cores; a large one has splits enough."""
    df = table(spark, sf_dir, name).select(*columns)
    n = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= n:
        return df
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(n) if size < n * SPREAD_BYTES else df
