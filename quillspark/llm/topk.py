"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size, each against all rows. A pass scores everything and counts
scores by bin; the bin that holds a query's kth score becomes the range of the next pass, until bins are
one wide and the kth value is known. The last pass keeps what reaches it, and ties go to smaller ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches, folder, stored

#: Queries in a block: bounds what is broadcast (block x dimensions x 8 bytes).
BLOCK = 1024
BINS = 1024
#: Candidates scored at once by a task.
ROWS = 2048
LOW = -(2**62)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows with an id and a vector of finite components, as vec_id and x (array<double>)."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & fine)


def _matrix(lists: list, width: int) -> np.ndarray:
    """floor(256 x), shorter vectors filled with zeros."""
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : min(len(v), width)] = v[:width]
    return np.floor(out * 256)


def _scores(batch: pa.RecordBatch, ids: np.ndarray, q: np.ndarray):
    """Candidate ids and their scores by query (int64; the query's own rows at LOW)."""
    col, width = batch.column(1), q.shape[1]
    n = batch.num_rows
    flat, lengths = col.flatten(), np.diff(col.offsets.to_numpy())
    if width and (lengths == width).all():
        c = np.floor(flat.to_numpy(zero_copy_only=False).reshape(n, width) * 256)
    else:
        c = _matrix(col.to_pylist(), width)
    has = np.array(batch.column(0).is_valid())
    got = np.array(batch.column(0).fill_null(0))
    top = (np.abs(c).max(initial=0) + 1) * (np.abs(q).max(initial=0) + 1) * max(1, width)
    if top < 2**53:
        s = (q @ c.T).astype(np.int64)  # whole numbers below 2**53: exact
    elif top < 2**62:
        s = q.astype(np.int64) @ c.astype(np.int64).T
    else:
        raise ValueError("a score exceeds 62 bits")
    s[(ids[:, None] == got[None, :]) & has[None, :]] = LOW
    return got, has, s


def _best(s: np.ndarray, k: int) -> np.ndarray:
    return s if s.shape[1] <= k else -np.partition(-s, k - 1, axis=1)[:, :k]


def _bins(block, k: int):
    """Rows (query's place, bin, count) of each batch's k best scores; bins run down from the range's top.

    A lower score of the batch can't be the kth of all, so its bin needs no count.
    """

    def run(batches):
        ids, q, lo, width = block.value
        for b in batches:
            if not b.num_rows:
                continue
            _, _, s = _scores(b, ids, q)
            best = _best(s, k)
            at = np.clip((best - lo[:, None]) // width[:, None], -1, BINS)
            at[best == LOW] = -2
            rows, cols = np.nonzero(at >= 0)
            key, n = np.unique(rows * (BINS + 1) + at[rows, cols], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key // (BINS + 1), key % (BINS + 1), n)], ["q", "bin", "n"])

    return run


def _reach(block, k: int):
    """Rows (query, vec_id, score) of each batch that reach the kth value; of ties at it, the k smallest ids."""

    def run(batches):
        ids, q, least, _ = block.value
        for b in batches:
            if not b.num_rows:
                continue
            got, has, s = _scores(b, ids, q)
            rows, cols = np.nonzero((s >= least[:, None]) & (s > LOW))
            vec, sc = got[cols], s[rows, cols]
            valid = has[cols]
            order = np.lexsort((vec, ~valid, -sc, rows))
            rows, vec, sc, valid = rows[order], vec[order], sc[order], valid[order]
            start = np.searchsorted(rows, rows)  # a query's first place
            keep = np.arange(len(rows)) - start < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows[keep]]), pa.array(vec[keep], pa.int64(), mask=~valid[keep]), pa.array(sc[keep])], ["query_id", "vec_id", "score"]
            )

    return run


def search(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by inner product of floor(256 x).

    ``queries`` is a condition on ``vec_id``. All rows but those with the query's id are candidates. Rows
    whose vector is null or holds null or non-finite components take no part; missing trailing components
    count as zero; of repeated query ids the smallest vector asks. Vectors whose scores may exceed 62 bits are an error.
    Null ids are candidates, after all others in ties, and never queries; of candidates that tie at the kth place the
    smaller ids stay. Repeated rows are candidates each. Extra columns are ignored; an empty table gives an empty
    result. Each block's result is written before the next begins, so the plan doesn't grow with the queries.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, ROWS)
    rows = usable(vectors, id_col, vector_col)
    asks = rows.filter(queries & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("x").alias("x"))
    stats = asks.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    whole = lambda v: F.floor(v * 256).cast("double")
    norm = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + whole(v) * whole(v)))).first()[0] or 0.0
    blocks = -(-stats["n"] // block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asks = asks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    if blocks > 1:
        asks, path = stored(asks, "block"), folder(spark)
    for i in range(blocks):
        mine = asks.filter(F.col("block") == i).collect()
        if not mine:
            continue
        ids = np.array([r["vec_id"] for r in mine], np.int64)
        q = _matrix([r["x"] for r in mine], stats["width"])
        reach = np.ceil(np.sqrt((q * q).sum(1)) * np.sqrt(norm)) + 1  # no score lies beyond
        if (reach >= 2**61).any():
            raise ValueError("a score may exceed 62 bits")
        reach = reach.astype(np.int64)
        lo, width = -reach, (2 * reach) // BINS + 1
        known = np.zeros(len(ids), bool)
        while not known.all():
            told = spark.sparkContext.broadcast((ids, q, lo, width))
            seen = rows.mapInArrow(_bins(told, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            above = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
            at = {r["q"]: r["bin"] for r in seen.withColumn("above", above).filter(F.col("above") >= k).groupBy("q").agg(F.max("bin").alias("bin")).collect()}
            told.unpersist()
            for j in range(len(ids)):
                if known[j]:
                    continue
                if j not in at:  # fewer than k candidates
                    lo[j], known[j] = LOW + 1, True
                    width[j] = 1
                elif at[j] == BINS or width[j] == 1:
                    lo[j], known[j], width[j] = lo[j] + at[j] * width[j], True, 1
                else:
                    lo[j] += at[j] * width[j]
                    width[j] = -(-width[j] // BINS)
        told = spark.sparkContext.broadcast((ids, q, lo, width))
        found = rows.mapInArrow(_reach(told, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            found.write.parquet(f"{path}/block={i}")
            told.unpersist()
    if blocks > 1:
        found = spark.read.schema("query_id long, vec_id long, score long").parquet(f"{path}/block=*")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The five best rows of ``embeddings`` for each row whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
