"""Sources and sinks: tolerant readers, ledgers, tables with added columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import cell

#: An entry of the run ledger.
LEDGER = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("status", T.StringType()), T.StructField("label", T.StringType()), T.StructField("extraction_id", T.LongType()),
    T.StructField("pages", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("attempts", T.LongType()), T.StructField("error", T.StringType()),
    T.StructField("at", T.StringType()), T.StructField("run_id", T.StringType()),
])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet of strings: headers lower-cased with underscores, cells cleaned, rows without any value dropped."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    df = df.toDF(*["_".join(c.strip().lower().replace("-", " ").split()) for c in df.columns])
    return df.select(*[cell(F.col(f"`{c}`")).alias(c) for c in df.columns]).dropna("all")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; torn ones are skipped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).filter(F.col("key").isNotNull())


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def prefer(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Of files (path, ...) that differ in their extension only, the one whose extension comes first; files of other extensions go."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(x) for x in extensions]), ext)
    f = files.withColumn("_rank", rank).filter("_rank > 0").withColumn("_stem", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""))
    rest = [c for c in files.columns if c != "path"]
    return f.groupBy("_stem").agg(F.min_by(F.struct("path", *rest), "_rank").alias("f")).select("f.*").select(*files.columns)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256, is_pdf, content): whole files with their content hash; only what is used is read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), "content")


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash the cache doesn't hold."""
    return files.join(cache.select("sha256").distinct(), "sha256", "left_anti")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
    return r.load()


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces a Parquet table: the new one is written whole beside the old, then takes its place.

    A job that is lost on the way leaves the old table as it was. Between the two renames readers find no table;
    the old one is removed last. ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(new)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(fs_path(path))
    if had and not fs.rename(fs_path(path), fs_path(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(fs_path(new), fs_path(path)):
        if had:
            fs.rename(fs_path(old), fs_path(path))
        raise OSError(f"{new} can't take the place of {path}")
    if had:
        fs.delete(fs_path(old), True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: that of ``spark.checkpoint.dir``, or, with a local master, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared}/quillspark-{name}-{uuid.uuid4().hex}"


def dump_csv(df: DataFrame, path: str, rows: int = 500) -> None:
    """A backup in files of at most ``rows`` rows."""
    df.write.mode("errorifexists").option("header", True).option("maxRecordsPerFile", rows).csv(path)
