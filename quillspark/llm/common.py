"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that an Arrow batch carries to a Python worker, at most (a single row may be longer).
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, so that a worker's memory doesn't grow with the input.

    The session keeps both settings: plans read them when they run, after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def apart(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in ``spark.checkpoint.dir``.

    Only a session without that setting (tests) gets a local folder, and only with a local master.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint(eager=True)


def sampled(df: DataFrame, h: str, rows: int, of: int) -> DataFrame:
    """Those of ``df``'s ``of`` rows whose 64-bit hash ``h`` lies in the lowest part that should hold four times ``rows``."""
    from pyspark.sql import functions as F

    share = 4 * rows / max(of, 1)
    return df if share >= 1 else df.filter(F.col(h) < int((2 * share - 1) * 2**63))


def folder(spark: SparkSession) -> str:
    """A new path below the checkpoint folder."""
    cut(spark.range(1))  # makes sure of a checkpoint folder
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder, and read again; ``by``: columns that become folders."""
    path = folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        while "stored-" in path.getParent().toString():
            path = path.getParent()
        path.getFileSystem(hadoop).delete(path, True)
        return


def map_rows(df: DataFrame, schema: pa.Schema, rows: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``df`` with each Arrow batch put through ``rows`` (columns as Python lists in, tuples out)."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        for b in batches:
            got = list(rows(b.to_pydict()))
            cols = list(zip(*got, strict=True)) if got else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))
