"""Mixing sources to target weights.

Rows get hash-random keys; ranges of the key are ranges of the order within each source, so a source
of any size is summed by many tasks: range totals first, then their prefix sums, then the running sum
inside each range. The cut falls at each source's exact budget; whole epochs come before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import apart, cut

#: Most copies of a source that a mix may take.
EPOCHS = 3
#: Weights by the source's place in code point order (null last), repeating.
WEIGHTS = (1, 2, 3)
#: Rows that one range of one source should hold at most, on average.
RANGE_ROWS = 100_000


def word_count(text):
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``at``, their places from 0 in code point order (null last): range-sorted, counted by range, prefix sums over the ranges."""
    of, n = apart("range"), apart("n")
    order = F.col("source").asc_nulls_last()
    sorted_ = cut(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn(of, F.spark_partition_id()).withColumn(n, F.monotonically_increasing_id() % (1 << 33)))
    before, starts = 0, []
    for r in sorted_.groupBy(of).count().orderBy(of).collect():  # a row for each range
        starts.append((r[of], before))
        before += r["count"]
    starts = sources.sparkSession.createDataFrame(starts, f"`{of}` int, start long")
    return sorted_.join(F.broadcast(starts), of).withColumn("at", F.col("start") + F.col(n)).drop(of, n, "start")


def targets(ranges: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, w, s, target from (source, range, n) totals: 100 % of all sizes shared by weight.

    A source stops at ``epochs`` times its size; the excess is reshared by weight. Each round finds the sources that
    their share fills, by two sums over all sources, until none is left: no task holds them all. Products are exact
    decimals, and the only rounding is one division.
    """
    s = ranges.groupBy("source").agg(F.sum("n").alias("s"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    x = cut(ranked(s).withColumn("w", w).select("source", "s", "w"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    total = x.agg(F.sum(big("s"))).first()[0] or 0
    full, rest, open_w = F.lit(False), total, None
    while True:
        sums = x.filter(~full).agg(F.count("*"), F.sum(big("w"))).first()
        held = x.filter(full).agg(F.sum(big("s"))).first()[0] or 0
        rest, before, open_w = total - epochs * held, open_w, sums[1] or 0
        if open_w == before:
            break
        exact = lambda v: F.lit(str(v)).cast("decimal(19,0)")
        full = epochs * big("s") * exact(open_w) < big("w") * exact(rest)
    share = (exact(rest) * big("w")).cast("double") / exact(open_w).cast("double")
    target = F.when(full, (epochs * big("s")).cast("double")).otherwise(share)
    return x.select("source", "w", "s", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (of its source), taken.

    A null text has size 0; null sources form one source, the last; rows without an id are ordered by their texts; repeated rows share a key and are
    taken one after the other; an empty table gives an empty result. Other columns are ignored. Reruns agree.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("?"), F.coalesce(F.col(text_col), F.lit("")))))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    digits = 2
    rows = sized.count()
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("n"))
    per = targets(ranges, weights, epochs)
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    r = ranges.select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")).alias("r")
    r = r.join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.source", "r.range", "earlier", "s", "target")
    x = sized.alias("x").join(r.alias("r"), F.col("x.source").eqNullSafe(F.col("r.source")) & (F.col("x.range") == F.col("r.range")))
    inside = W.partitionBy("x.source", "x.range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    turns = F.when(F.col("s") > 0, F.floor(F.expr("cast(floor(target) as long) div s"))).otherwise(F.lit(0)).cast("long")
    x = x.select("doc_id", "size", F.col("s").alias("source_size"), "target", before.alias("before"), budget.alias("budget"), turns.alias("turns"))
    left = F.col("budget") - F.col("turns") * F.col("source_size") - F.col("before")
    taken = F.col("turns") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return x.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to target weights."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '?' || coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * s * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) < w * (sum(s) OVER () - 3 * coalesce(sum(s) OVER b, 0)) AS full_
  FROM s WINDOW b AS (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, s, CASE WHEN full_ THEN CAST(3 * s AS DOUBLE)
         ELSE CAST((sum(s) OVER () - 3 * coalesce(sum(s) FILTER (WHERE full_) OVER (), 0)) * w AS DOUBLE)
              / CAST(sum(w) FILTER (WHERE NOT full_) OVER () AS DOUBLE) END AS target
  FROM f),
x AS (
  SELECT d.doc_id, d.size, t.s AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS turns FROM x)
SELECT doc_id, size, source_size, target,
       CAST(turns * size + greatest(0, least(size, budget - turns * source_size - before_)) AS BIGINT) AS taken
FROM y"""
