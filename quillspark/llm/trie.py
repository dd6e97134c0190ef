"""Prefix trie over conversations.

Turns become numbers of a dictionary of distinct (role, text); conversations become sequences of numbers, and equal
sequences become one row with a count. Sequences are partitioned by their most significant turn first: a bucket holds
the sequences below one node. A bucket that is too large for a task is told by what all its sequences share (the
longest prefix of its least and its greatest one) and dealt out by the next turn, round by round. The others are
finished by tasks with multikey quicksort, whose recursion emits the nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches, cut
from quillspark.llm.mixing import word_count

#: Turns that a bucket may hold for a task to finish it.
LOCAL = 4096
#: Large buckets of a round up to which their labels are broadcast (under 200 bytes each).
TOLD = 10_000
#: Conversations of a block share the turns of its first one: as many as the hash of their id says, below HEAD.
BLOCK, HEAD = 20, 4
#: Nodes of an Arrow batch, and characters of a piece of a list of ids.
NODES, PIECE = 50_000, 1 << 16

EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids, words: each conversation's turns in order, by their numbers in the dictionary, and the words of each turn's text.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Null turns come first, and
    equal turns go by the SHA-256 of role and text; repeated rows are turns each. A conversation's numbers are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), word_count(text).alias("n"))
    turns = cut(turns.filter(F.col("conv_id").isNotNull()))
    dictionary = cut(turns.groupBy("key").agg(F.max("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    own = turns.drop("n").join(dictionary, "key").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "id", "n"))).alias("x"))
    return own.select("conv_id", F.col("x.id").alias("ids"), F.col("x.n").alias("words"))


def rebuilt(own: DataFrame, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """``own`` with the first h turns of each conversation replaced by those of its block's first conversation; h is the id's CRC-32 modulo ``head``.

    All of them if that conversation has fewer, none if there is no such conversation.
    """
    c = F.col("conv_id")
    heads = own.filter(c % block == 0).select(c.alias("of"), F.slice("ids", 1, head - 1).alias("head_ids"), F.slice("words", 1, head - 1).alias("head_words"))
    x = own.withColumn("of", c - c % block).withColumn("h", (F.crc32(c.cast("string")) % head).cast("int")).join(heads, "of", "left")
    none = F.array().cast("array<long>")
    join = lambda a, b: F.concat(F.coalesce(F.slice(a, F.lit(1), F.col("h")), none), F.slice(b, F.col("h") + 1, F.greatest(F.size(b), F.lit(1))))
    return x.select("conv_id", join("head_ids", "ids").alias("ids"), join("head_words", "words").alias("words"))


def _lists(batches):
    """Of rows (key, conv_id) sorted by both: pieces (key, first, list) of each key's ids, comma-joined."""
    key, first, held, size = None, None, [], 0
    out: list = []

    def close():
        if held:
            out.append((key, first, ",".join(held)))
            held.clear()

    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key or size >= PIECE:
                close()
                key, first, size = k, c, 0
            held.append(str(c))
            size += len(held[-1]) + 1
        if len(out) >= 256:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "list"), x, strict=True)) for x in out], _LIST)
            out = []
    close()
    yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "list"), x, strict=True)) for x in out], _LIST)


_LIST = pa.schema([("key", pa.string()), ("first", pa.int64()), ("list", pa.string())])


def _digests(batches):
    """Of pieces sorted by key and first: each key's SHA-256, fed piece by piece."""
    key, h = None, None
    for b in batches:
        out = []
        for k, text in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if k != key:
                if h:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["key", "ends"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])


def distinct(convs: DataFrame) -> DataFrame:
    """first (smallest conv_id), n, ids, words, ends (SHA-256 of all conv_ids): a row for each distinct sequence.

    Copies are combined before the shuffle. The lists of ids are made by ranges of (sequence, id), so a sequence that
    very many conversations share is listed by many tasks; one task then feeds the pieces to its hash, in order, holding none.
    """
    convs = cut(convs.withColumn("key", F.sha2(F.array_join("ids", ",").cast("binary"), 256)))
    some = convs.groupBy("key").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.first("ids").alias("ids"), F.first("words").alias("words"))
    by_range = convs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = by_range.mapInArrow(_lists, "key string, first long, list string")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends string")
    return cut(some.join(ends, "key").drop("key"))


def grow(members: list, ids: list, words: list, first: list, n: list, ends: list, depth: int, parent: int | None) -> list[list]:
    """The nodes of one bucket, as columns: all ``members`` (places in the lists) share their first ``depth`` turns.

    Multikey quicksort: the turn after a node's depth splits its members in three by a pivot; the smaller and the greater
    are split on at that depth, the equal ones are a child. Totals of subtrees are added up from the last node back.
    """
    cols: list[list] = [[] for _ in _COLUMNS]
    conv, at_depth, up_conv, convs, children, leaves, saved, told = cols
    above: list[int] = []
    todo = [(members, depth, parent, -1)]
    while todo:
        mine, d, up, over = todo.pop()
        least, count, end = min(first[m] for m in mine), sum(n[m] for m in mine), EMPTY
        some = mine[0]
        while True:
            here = len(conv)
            conv.append(least)
            at_depth.append(d)
            up_conv.append(up)
            convs.append(count)
            leaves.append(0)
            saved.append((count - 1) * words[some][d - 1] if d else 0)
            told.append(EMPTY)
            children.append(0)
            above.append(over)
            if len(mine) > 1 or len(ids[some]) == d:
                break
            children[here] = 1  # a single sequence: one node below another
            d, up, over = d + 1, least, here
        end = [m for m in mine if len(ids[m]) == d]
        if end:
            told[here] = ends[end[0]]
        parts = [[m for m in mine if len(ids[m]) > d]]
        while parts:
            part = parts.pop()
            if not part:
                continue
            pivot = ids[part[len(part) // 2]][d]
            todo.append(([m for m in part if ids[m][d] == pivot], d + 1, least, here))
            children[here] += 1
            parts += [m for m in part if ids[m][d] < pivot], [m for m in part if ids[m][d] > pivot]
    for i in range(len(conv) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if above[i] >= 0:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    return cols


_OUT = pa.schema([*[(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _COLUMNS], ("path", pa.list_(pa.string()))])


def _finish(batches):
    """Of rows sorted by label: the nodes of every bucket; a bucket's first node bears its path."""
    names = ("label", "depth", "parent", "path", "first", "n", "ids", "words", "ends")
    cols: list[list] = [[] for _ in _OUT]

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
        for c in cols:
            c.clear()
        return out

    def close(rows):
        _, depth, parent, path = rows[0][:4]
        _, _, _, _, first, n, ids, words, ends = (list(x) for x in zip(*rows, strict=True))
        got = grow(list(range(len(rows))), ids, words, first, n, ends, depth, parent)
        for c, more in zip(cols, [*got, [path, *[None] * (len(got[0]) - 1)]], strict=True):
            c.extend(more)

    rows: list = []
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if rows and rows[0][0] != row[0]:
                close(rows)
                rows = []
                if len(cols[0]) >= NODES:
                    yield flush()
            rows.append(row)
    if rows:
        close(rows)
    yield flush()


def _chains(batches):
    """The nodes of large buckets: each is the chain that all its sequences share, down to where they part."""
    for b in batches:
        for x in b.to_pylist():
            d, last, n = x["depth"], x["split"], x["n_convs"]
            depths = np.arange(d, last + 1)
            own = (n - 1) * np.array([x["words"][i - 1] if i else 0 for i in depths], np.int64)
            flat = lambda v: np.full(len(depths), v, np.int64)
            cols = [flat(x["conv_id"]), depths, [x["parent"], *[x["conv_id"]] * (last - d)], flat(n), [*[1] * (last - d), x["n_children"]]]
            cols += [flat(x["leaves"]), x["saved"] - np.cumsum(own) + own, [*[EMPTY] * (last - d), x["ends"]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[:-1], strict=True)], names=_COLUMNS)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie over ``distinct`` sequences (see ``prefix_trie`` for the columns).

    The root's bucket is always dealt out. Each round takes up only buckets that are still too large, so there are as many rounds as such
    buckets branch one below another; what all sequences of a bucket share takes one round, however long. Rounds are checkpointed.
    """
    arrow_batches(seqs.sparkSession)
    rows = seqs.select(F.lit("").alias("label"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<string>").alias("path"), "*")
    small, large = [], []
    while True:
        turns = F.sum(F.size("ids") - F.col("depth")).alias("turns")
        over = cut(rows.groupBy("label").agg(turns).filter((F.col("turns") > local) | (F.col("label") == "")).select("label"))
        n = over.count()
        if not n:
            small.append(rows)
            break
        bound = F.broadcast if n <= TOLD else lambda x: x
        small.append(rows.join(bound(over), "label", "left_anti"))
        mine = rows.join(bound(over), "label", "left_semi")
        same = "array_position(zip_with(lo, hi, (a, b) -> coalesce(a = b, false)), false)"
        info = mine.groupBy("label").agg(
            F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.min_by("words", "ids").alias("words"), F.min_by("ends", "ids").alias("end"),
            F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("path").alias("path"),
        )
        info = info.withColumn("split", F.expr(f"cast(case when {same} = 0 then size(lo) else {same} - 1 end as int)"))
        info = info.withColumn("ends", F.when(F.size("lo") == F.col("split"), F.col("end")).otherwise(EMPTY)).withColumn("words", F.slice("words", F.lit(1), F.col("split")))
        info = cut(info.drop("lo", "hi", "end"))
        down = mine.drop("parent", "depth").join(bound(info.select("label", "split", F.col("conv_id").alias("parent"))), "label").filter(F.size("ids") > F.col("split"))
        label = F.sha2(F.concat_ws("/", "label", F.get("ids", F.col("split"))).cast("binary"), 256)
        rows = cut(down.select(label.alias("label"), (F.col("split") + 1).alias("depth"), "parent", F.concat("path", F.array("label")).alias("path"), "first", "n", "ids", "words", "ends"))
        below = rows.select(F.element_at("path", -1).alias("label"), F.col("label").alias("child")).groupBy("label").agg(F.count_distinct("child").alias("n_children"))
        large.append(info.join(below, "label", "left").fillna(0, ["n_children"]))
    every = small[0]
    for x in small[1:]:
        every = every.unionByName(x)
    nodes = cut(every.repartition("label").sortWithinPartitions("label").mapInArrow(_finish, _NODE + ", path array<string>"))
    if not large:
        return nodes.drop("path")
    chains = large[0]
    for x in large[1:]:
        chains = chains.unionByName(x)
    own = F.expr("(n_convs - 1) * aggregate(slice(words, greatest(depth, 1), size(words)), 0L, (a, b) -> a + b)")
    adds = chains.select(F.concat("path", F.array("label")).alias("path"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), own.alias("saved"))
    adds = adds.unionByName(nodes.filter(F.col("path").isNotNull()).select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    totals = adds.select(F.explode("path").alias("label"), "leaves", "saved").groupBy("label").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("path").unionByName(chains.join(totals, "label").drop("path", "label").mapInArrow(_chains, _NODE))


def prefix_trie(conversations: DataFrame, local: int = LOCAL, block: int = BLOCK, head: int = HEAD, **columns: str) -> DataFrame:
    """The trie of ``rebuilt`` conversations, a row a node: conv_id (smallest member), depth, parent_conv_id (of the root: null), n_convs
    (members), n_children, n_leaves (childless nodes of its subtree), saved_tokens (summed over its subtree, each node's members but
    one times the words of its last text), ends_sha256 (of the comma-joined ids of the conversations that end there).

    See ``sequences`` for nulls, ties and repeated rows. A conversation without turns ends at the root; an empty text is a turn like
    others; an empty table has no node. Texts are read once, for their hash and count of words, and are never shuffled, so very long ones
    matter little. Other columns are ignored; ``columns`` names the four that are read (conv_col, turn_col, role_col, text_col).
    """
    return trie(distinct(rebuilt(sequences(conversations, **columns), block, head)), local)


def op13_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``, rebuilt by blocks of twenty."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 byte by byte from its table of 256, made from the polynomial; nodes by their lists of turn hashes.
SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
crc(c, s, j, v) AS (
  SELECT c, CAST(c AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT c, s, j + 1, xor(v >> 8, t[(xor(v, ascii(substr(s, j, 1))) & 255) + 1]) FROM crc, tab WHERE j <= length(s)),
h AS (SELECT c, CAST(xor(v, 4294967295) % 4 AS BIGINT) AS h FROM crc WHERE j > length(s)),
t AS (
  SELECT conv_id AS c, sha256(concat(CAST(length(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS x, turn,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, x, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS i FROM t),
r AS (
  SELECT h.c, o.x, o.w, o.i FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.i <= h.h
  UNION ALL
  SELECT h.c, o.x, o.w, o.i + 10000000 FROM h JOIN o ON o.c = h.c AND o.i > h.h),
p AS (SELECT c, x, w, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM r),
pre AS (
  SELECT c, d, w, list(x) OVER (PARTITION BY c ORDER BY d) AS path FROM p
  UNION ALL
  SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM h),
size AS (SELECT c, max(d) AS n FROM pre GROUP BY c),
node AS (
  SELECT path, d, min(pre.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
         sha256(coalesce(string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) FILTER (WHERE size.n = d), '')) AS ends_sha256
  FROM pre JOIN size ON pre.c = size.c GROUP BY path, d),
kids AS (SELECT path[:-2] AS path, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
n AS (
  SELECT a.*, b.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
  FROM node a LEFT JOIN node b ON b.d = a.d - 1 AND b.path = a.path[:-2] LEFT JOIN kids k ON k.d = a.d AND k.path = a.path),
up AS (SELECT unnest(range(d + 1)) AS d, path AS full_path, own, n_children FROM n),
sums AS (SELECT full_path[:d] AS path, d, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM up GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, n.parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sums s ON s.d = n.d AND s.path = n.path"""
