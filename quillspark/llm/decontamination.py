"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of benchmark words. For each pattern length the SHIFT table tells, for the block of
words at the end of the text's window, how far the next possible match can lie; where it says nought, the
bucket of patterns with that suffix block is compared directly. A shift skips most of the text.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import apart, arrow_batches, cut, dropped, map_rows, stored

WINDOW = 13
#: Words whose suffix block picks shift and bucket.
BLOCK = 3
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes several passes.
PASS_BYTES = 8_000_000

_PATTERN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = re.compile(_PATTERN)
_JAVA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    """Words after lower-casing A-Z; a null text has none."""
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


class WuManber:
    """Search for the windows of many items in one pass for each length of pattern."""

    def __init__(self, items: list[tuple], window: int = WINDOW, block: int = BLOCK):
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            w = words(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1) if m else ():
                by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
        self.tables = []
        for m, patterns in sorted(by_length.items()):
            b = min(block, m)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, list] = {}
            for p in patterns:
                for end in range(b, m + 1):
                    k = p[end - b : end]
                    shift[k] = min(shift.get(k, m), m - end)
                buckets.setdefault(p[m - b :], []).append(p)
            self.tables.append((m, b, shift, buckets, patterns))

    def search(self, w: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Word intervals that occur as windows, in order of their ends for each length, and their items."""
        hits, items, n = [], set(), len(w)
        for m, b, shift, buckets, patterns in self.tables:
            far, i = m - b + 1, m
            get = shift.get
            if b == 3:
                while i <= n:
                    s = get((w[i - 3], w[i - 2], w[i - 1]), far)
                    if s:
                        i += s
                        continue
                    window = tuple(w[i - m : i])
                    for p in buckets[window[m - 3 :]]:
                        if p == window:
                            hits.append((i - m, i))
                            items |= patterns[p]
                    i += 1
                continue
            while i <= n:
                s = get(tuple(w[i - b : i]), far)
                if s:
                    i += s
                    continue
                window = tuple(w[i - m : i])
                for p in buckets[window[m - b :]]:
                    if p == window:
                        hits.append((i - m, i))
                        items |= patterns[p]
                i += 1
        return hits, items


def union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUILT: dict = {}


def _matcher(told) -> WuManber:
    """The tables of a broadcast, built once in each worker."""
    if told.id not in _BUILT:
        _BUILT.clear()
        _BUILT[told.id] = WuManber(pickle.loads(zlib.decompress(told.value)))
    return _BUILT[told.id]


class _Told:
    """A broadcast with an identity that survives pickling."""

    def __init__(self, spark, items):
        blob = zlib.compress(pickle.dumps(items))
        self.id = hashlib.md5(blob).hexdigest()
        self.held = spark.sparkContext.broadcast(blob)

    @property
    def value(self):
        return self.held.value


def _parts(benchmark: DataFrame, limit: int, window: int = WINDOW) -> tuple[DataFrame, int]:
    """The benchmark's items (i, t, part) in parts of about ``limit`` bytes of text, and how many parts there are.

    A long item is cut into pieces that overlap by all but one word of a window, so that it has the same windows and
    no part is larger than the limit by much. Only one part at a time ever comes to the driver.
    """
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).filter(F.col("t").isNotNull())
    step = max(1, limit // 16)
    w = F.regexp_extract_all(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_JAVA), F.lit(0))
    b = b.select("i", w.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))
    b = b.select("i", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(step + window - 1)), " "))).alias("t"))
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // limit))
    b = b.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    return (stored(b, "part") if n > 1 else b), n


def _told(spark, parts: DataFrame, k: int) -> _Told:
    return _Told(spark, [(r["i"], r["t"]) for r in parts.filter(F.col("part") == k).select("i", "t").collect()])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.string()), ("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def find(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, h (md5 of the text; null where one pass is enough), n_words, hits (word intervals [start, end); of one pass disjoint), items (distinct ids as strings).

    Null texts have no words; a null item id counts as an item with an empty name, and items that share an id are
    one; repeated rows give repeated results; extra columns are ignored. Without benchmark words nothing is hit; an
    empty table gives an empty result. Texts are searched whole, however long.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    parts, n = _parts(benchmark, pass_bytes)

    def searched(told, many):
        def rows(cols):
            match = _matcher(told)
            for i, t in zip(cols["doc_id"], cols["text"], strict=True):
                w = words(t)
                hits, found = match.search(w)
                yield i, hashlib.md5((t or "").encode()).hexdigest() if many else None, len(w), [list(x) for x in union(hits)], sorted(found)

        return map_rows(d, _SCHEMA, rows)

    if n == 1:
        return searched(_told(spark, parts, 0), False)
    hit = None
    for k in range(n):  # each pass is written before the next begins, and its tables are let go
        told = _told(spark, parts, k)
        rows = cut(searched(told, True)) if k == 0 else cut(searched(told, True).filter(F.size("hits") > 0))
        told.held.unpersist()
        if k == 0:
            every = rows.select("doc_id", "h", "n_words")
        some = rows.filter(F.size("hits") > 0).select("doc_id", "h", "hits", "items")
        hit = some if hit is None else hit.unionByName(some)
    dropped(parts)
    one = hit.groupBy("doc_id", "h").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    e, o = every.alias("e"), one.alias("o")
    none = lambda c: F.coalesce(F.col(f"o.{c}"), F.array().cast(dict(one.dtypes)[c])).alias(c)
    return e.join(o, F.col("e.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("e.h") == F.col("o.h")), "left").select("e.doc_id", "e.h", "n_words", none("hits"), none("items"))


def hit_words(hits):
    """Number of words in the union of intervals."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(a, x):
        s, e = F.greatest(a["end"], x[0]), x[1]
        return F.struct((a["n"] + F.greatest(F.lit(0), e - s)).alias("n"), F.greatest(a["end"], e).alias("end"))

    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["n"])


def judge(found: DataFrame, *more: str) -> DataFrame:
    """Counts, item digest and verdict of ``find``'s rows: contaminated if a twentieth of the words is hit."""
    n = hit_words(F.col("hits"))
    x = found.select("doc_id", *more, "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return x.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, as they are; columns of any name pass through.

    Null texts are clean; of repeated rows all stay or all go; an empty table stays empty.
    """
    spark = docs.sparkSession
    parts, n = _parts(benchmark, pass_bytes)
    if n > 1:
        of, key = apart("id"), apart("h")
        bad = judge(find(docs, benchmark, pass_bytes), "h").filter("contaminated").select(F.col("doc_id").alias(of), F.col("h").alias(key)).distinct()
        dropped(parts)
        own = F.md5(F.coalesce(F.col("text"), F.lit("")))
        return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (own == F.col(key)), "left_anti")
    arrow_batches(spark)
    told, at = _told(spark, parts, 0), docs.columns.index("text")

    def run(batches):
        match = _matcher(told)
        for b in batches:
            keep = []
            for t in b.column(at).to_pylist():
                w = words(t)
                n = sum(e - s for s, e in union(match.search(w)[0]))
                keep.append(not (n and 20 * n >= len(w)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    return judge(find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
h AS (
  SELECT k, i, x.m, p.item_id
  FROM (SELECT k, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
        FROM d, (SELECT DISTINCT m FROM p) AS l, unnest(range(1, len(w) - m + 2)) AS u(i)) x
  JOIN p ON p.m = x.m AND p.p = x.g),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS j FROM h) GROUP BY k),
t AS (
  SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT k, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM h) GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)"""
