"""Registration of queries: a DataFrame function or Spark SQL, with the SQL twin that an independent engine runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the tables of ``sf_dir`` that it names after FROM, JOIN or a comma."""
    named = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    marked = re.sub(rf"(?<![.\w'])\b({'|'.join(named)})\b(?!\s*[.(])(?=\s|\)|,|$)", r"{\1}", sql)
    return spark.sql(marked, **{t: table(spark, sf_dir, t) for t in named})


def query(oracle: str | None = None):
    """Register a DataFrame query under its function name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query that is Spark SQL; the same text serves as its twin where both dialects agree."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, spark_sql)
    ORACLES[name] = oracle or spark_sql
