"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints.

A tree fitted on a bounded sample shards all distinct fingerprints. A split at distance m from its
vantage point sends distances up to m one way and from m - 1 on the other: by the triangle inequality, two
fingerprints at most RADIUS = 2 apart differ by at most 2 in that distance, so they meet in some shard.
A shard goes on splitting the same way, compares what is left, and returns the links that span its classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import apart, arrow_batches, cut, map_rows, sampled
from quillspark.llm.components import roots

WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints that the sharding tree is fitted on: one in SAMPLE_SHARE, at least and at most so many.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 500, 8192, 200_000
#: Sampled fingerprints in a shard, and fingerprints that a shard compares directly.
SHARD_SAMPLE, DIRECT = 64, 512
#: A split must leave either side at most this share.
LARGEST = 0.85
#: Fingerprints of a part that no vantage point divides from which neighbours are sorted instead of compared, and variants sorted at once.
DENSE, VARIANTS = 8192, 8_000_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of word shingles; zero for a text without words."""
    w = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    line = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= WORDS:
        got = [h(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.concatenate(([0], ends[: -WORDS])).tolist()
        got = [h(line[s:e], SEED) for s, e in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)]
    a = np.array(got, np.uint64)
    n = np.zeros(64, np.int64)
    for at in range(0, len(a), 65536):
        n += np.unpackbits(a[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * n > len(a), bitorder="little").view(np.uint64)[0])


def _split(x: np.ndarray, rng: np.random.Generator):
    """The vantage point and distance that divide ``x`` best, with both sides' masks; None if nothing divides it."""
    best = None
    for v in x[rng.choice(len(x), min(12, len(x)), replace=False)]:
        d = np.bitwise_count(x ^ v)
        c = np.bincount(d, minlength=66)
        low = np.cumsum(c)[:65]  # distances up to m
        high = len(x) - np.concatenate(([0, 0], low))[:65]  # distances from m - 1 on
        worst = np.maximum(low, high)
        m = int(np.argmin(worst))
        if best is None or worst[m] < best[0]:
            best = int(worst[m]), v, m, d
    size, v, m, d = best
    return None if size > LARGEST * len(x) else (v, m, d <= m, d >= m - 1)


def fit(sample: np.ndarray, leaf: int = SHARD_SAMPLE):
    """A tree as nested tuples (vantage point, m, near, far); a leaf is its number."""
    rng, count = np.random.default_rng(SEED), [0]

    def grow(x):
        cut_ = _split(x, rng) if len(x) > leaf else None
        if cut_ is None:
            count[0] += 1
            return count[0] - 1
        v, m, near, far = cut_
        return v, m, grow(x[near]), grow(x[far])

    return grow(sample)


def shards(tree, x: np.ndarray, at: np.ndarray):
    """(leaf, positions of ``x``) for each leaf that some fingerprint belongs to."""
    if not isinstance(tree, tuple):
        yield tree, at
        return
    v, m, near, far = tree
    d = np.bitwise_count(x[at] ^ v)
    for side, part in ((near, at[d <= m]), (far, at[d >= m - 1])):
        if len(part):
            yield from shards(side, x, part)


def _variants(x: np.ndarray):
    """Position pairs that span what lies within two bits in ``x``: two fingerprints do just when they share one that differs from either by a bit at most.

    Every fingerprint is dealt out under itself and its 64 neighbours, by parts of those, so time and memory are those of sorting.
    """
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    parts = max(1, 65 * len(x) // VARIANTS)
    for p in range(parts):
        keys, at = [], []
        for f in flips:
            y = x ^ f
            mine = np.flatnonzero((y * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == p)
            keys.append(y[mine])
            at.append(mine)
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        yield at[same], at[same + 1]


def links(x: np.ndarray, most: int = 1 << 20, span: bool = False):
    """Position pairs of distinct fingerprints at most RADIUS apart, each at least once, in parts of about ``most``.

    With ``span``, of a dense part that no vantage point divides, only pairs that span its classes.
    """
    rng = np.random.default_rng(SEED)
    left, right, held, todo = [], [], 0, [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) > DIRECT and (cut_ := _split(x[at], rng)):
            todo += [at[cut_[2]], at[cut_[3]]]
            continue
        y = x[at]
        if span and len(at) > DENSE:
            for a, b in _variants(y):
                yield at[a], at[b]
            continue
        for i in range(0, len(y), 256):
            for j in range(i, len(y), 1 << 14):
                r, c = np.nonzero(np.bitwise_count(y[i : i + 256, None] ^ y[None, j : j + (1 << 14)]) <= RADIUS)
                keep = c + j > r + i
                left.append(at[i + r[keep]])
                right.append(at[j + c[keep]])
                held += int(keep.sum())
                if held > most:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def classes(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in each position's class, after the classes ``f`` are joined by pairs ``a``, ``b``."""
    while True:
        low = np.minimum(f[a], f[b])
        g = f.copy()
        for to in (f[a], f[b], a, b):
            np.minimum.at(g, to, low)
        while (g[g] != g).any():
            g = g[g]
        if (g == f).all():
            return f
        f = g


def _solve(table: pa.Table) -> pa.Table:
    """A shard's (shard, fp) rows to links (a > b) that span its classes."""
    x = np.sort(table.column("fp").to_numpy())
    u = x.view(np.uint64)
    root = np.arange(len(u))
    for a, b in links(u, span=True):  # a dense shard's pairs are folded into its classes as they come
        root = classes(root, a, b)
    own = root != np.arange(len(u))
    return pa.table({"a": x[own], "b": x[root[own]]})


def link(fps: DataFrame, sample_least: int = SAMPLE_LEAST, leaf: int = SHARD_SAMPLE) -> DataFrame:
    """Links (a, b) that span the classes of distinct ``fps`` (a column fp, signed 64 bits)."""
    spark = fps.sparkSession
    of = fps.count()
    n = min(SAMPLE_MOST, max(sample_least, of // SAMPLE_SHARE))
    hashed = sampled(fps.withColumn("h", F.xxhash64("fp")), "h", n, of)
    sample = [r["fp"] for r in hashed.orderBy("h").limit(n).select("fp").collect()]
    told = spark.sparkContext.broadcast(fit(np.array(sample, np.int64).view(np.uint64), leaf))

    def deal(batches):
        for b in batches:
            x = b.column(0).to_numpy()
            for shard, at in shards(told.value, x.view(np.uint64), np.arange(len(x))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(x[at])], ["shard", "fp"])

    return fps.mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInArrow(_solve, "a long, b long")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])


def _rows(cols):
    for i, h, t in zip(cols["doc_id"], cols["h"], cols["text"], strict=True):
        f = fingerprint(t)
        yield i, h, f - (1 << 64) if f >> 63 else f


def group(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, h (hash of the text), fp (signed), root (the class's smallest fingerprint), component_id (its smallest doc_id).

    Null and wordless texts have fingerprint zero and are linked like any other; null ids never name a class
    unless it has no others; repeated rows share a class; an empty table gives an empty result. Other columns are ignored. A very
    long text is hashed whole, in its task's memory.
    """
    arrow_batches(docs.sparkSession)
    marked = cut(map_rows(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text"), _SCHEMA, _rows))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    arrow_batches(docs.sparkSession, 10_000)
    root = roots(link(fps.select("fp")))
    # only linked classes need a second look: all others are named by their own smallest id
    placed = fps.join(root, fps["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row of its smallest id (null only if it has no other).

    Of rows with that id, the text of the smallest hash stays; of rows with that text too, the one whose columns, written as JSON, come
    first. An empty table stays empty; columns of any name pass through. A long text costs its length, for hashing. Only rows
    that go are looked up, so texts are shuffled only where those are many.
    """
    of, n, key = apart("id"), apart("n"), apart("h")
    g = cut(group(docs))
    mine = g.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = mine.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"))
    stays = first.select(F.col("doc_id").alias(of), F.col("h").alias(key))
    gone = g.join(stays, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col("h") == F.col(key)), "left_anti")
    gone = gone.select(F.col("doc_id").alias(of), F.col("h").alias(key)).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(key)), "left_anti")
    again = g.join(stays, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col("h") == F.col(key)), "left_semi").groupBy("doc_id", "h").agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    if not again.limit(1).count():
        return kept
    again = again.select(F.col("doc_id").alias(of), F.col("h").alias(key))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(key))
    row = F.struct(*docs.columns)
    one = kept.join(again, same).groupBy(of, key).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias(n)).select(f"{n}.*")
    return kept.join(again, same, "left_anti").unionByName(one)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all ``documents``."""
    g = group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
