"""Source divergence audit: what sets each source of a language apart, from counts of terms.

Every kept term of a language has a price in every group (lang, source), and most counts are zero. Sums over all
kept terms are taken by inclusion and exclusion over the supports instead of over the dense table: histograms of
each group's counts price the terms as if only one side had them, a join of the sparse postings corrects the terms
that both sides have, and one product covers the terms that neither has. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches, cut

#: Documents of its language that a kept term is in, at least.
LEAST = 3
#: Terms told for each group, at most: the report's length.
TOP = 200
#: Distinct (group, term) counts that a task holds before it sends them on, and bytes of a text that are cut into words at once.
ENTRIES, PIECE = 600_000, 1 << 20

#: Bytes of terms: letters in lower case and all of non-ASCII characters; others end a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text (as UTF-8), in pieces that are cut where no term is."""
    data, at = text.encode().translate(_TERM), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _partial(batches):
    """Rows (lang, source, term, n, docs): sums over some of a task's documents."""

    def out():
        cols = [[], [], [], [], []]
        for (lang, source), (total, inside) in held.items():
            for c, more in zip(cols, ([lang] * len(total), [source] * len(total), list(total), list(total.values()), [inside[t] for t in total]), strict=True):
                c += more
        held.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    held: dict = {}
    entries = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(i) for i in range(3)), strict=True):
            total, inside = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(total), set()
            for words in terms(text.as_py()):
                total.update(words)
                seen.update(words)
            inside.update(seen)
            entries += len(total) - before
            if entries >= ENTRIES:
                yield out()
                entries = 0
    yield out()


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, total (of the language): the counts over zero of every kept term.

    ``docs`` has lang, source and text without nulls. A task sums its documents before anything is shuffled, so a hot
    source or term sends a row for each few hundred thousand sums; a term's rows of one language are a row a source.
    """
    arrow_batches(docs.sparkSession)
    part = docs.mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    counts = part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = W.partitionBy("lang", "term")
    told = counts.withColumn("total", F.sum("n").over(every)).withColumn("docs", F.sum("docs").over(every))
    return told.filter(F.col("docs") >= least).select("lang", "source", "term", "n", "total")


def _p(count: str, n: str, v: str) -> str:
    """1 + floor(10**9 (count + 1) / (n + v)), exact: the product is a decimal."""
    return f"1 + (cast({count} + 1 as decimal(20,0)) * 1000000000) div cast(greatest({n} + {v}, 1) as decimal(20,0))"


def _f(p: str, q: str) -> str:
    """floor((p - q)**2 / q); both are at most 10**9 + 1, so the square is below 2**63."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _sums(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group: lang, source, size (occurrences of kept terms), support (kept terms it has), lang_size, v (kept terms of its language), p0 (price of a count of zero)."""
    groups = docs.select("lang", "source").distinct()
    of = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("support"))
    by = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("v"))
    x = groups.join(of, ["lang", "source"], "left").join(by, "lang", "left").fillna(0, ["size", "support", "lang_size", "v"])
    return x.withColumn("p0", F.expr(_p("0", "size", "v")))


def _pairs(kept: DataFrame, groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language: the sum over all kept terms."""
    dec = "decimal(38,0)"
    x, y = groups.alias("x"), groups.alias("y")
    both = (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source"))
    neither = f"cast(x.v - x.support - y.support as decimal(20,0)) * cast({_f('x.p0', 'y.p0')} as decimal(18,0))"
    constant = x.join(y, both).selectExpr("x.lang", "x.source", "y.source as item", f"cast({neither} as {dec}) as value")
    # as if only one side had the term: a row for each distinct count of a group
    h = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"]).withColumn("p", F.expr(_p("n", "size", "v")))
    one = h.alias("x").join(y, both)
    times = lambda p, q: F.expr(f"sum(cast(terms as decimal(19,0)) * cast({_f(p, q)} as decimal(19,0)))")
    one = one.groupBy("x.lang", "x.source", F.col("y.source").alias("item")).agg(times("x.p", "y.p0").alias("there"), times("y.p0", "x.p").alias("back"))
    # both have it: what the two one-sided prices said is taken back
    over = priced.alias("a").join(priced.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    mend = lambda a, b: F.expr(f"sum(cast({_f(f'{a}.p', f'{b}.p')} - {_f(f'{a}.p', f'{b}.p0')} - {_f(f'{a}.p0', f'{b}.p')} + {_f(f'{a}.p0', f'{b}.p0')} as decimal(20,0)))")
    over = over.groupBy("a.lang", "a.source", F.col("b.source").alias("item")).agg(mend("a", "b").alias("there"), mend("b", "a").alias("back"))
    two = f"stack(2, source, item, cast(there as {dec}), item, source, cast(back as {dec})) as (source, item, value)"
    every = constant.unionByName(one.selectExpr("lang", two)).unionByName(over.selectExpr("lang", two))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each group's prices lie from those of other sources (part ``pair``, all of
    them) and of its language (part ``term``, the ``top`` terms that it has more of).

    A null text, language or source is the empty string, which is a language and a source like others. Repeated rows count
    each. A language none of whose terms is in ``least`` documents gives pairs of value 0; a group alone in its language
    gives no pair; an empty table gives an empty result. Texts are read whole, in pieces, so a very long one takes the memory of its text and
    of its distinct terms. Other columns are ignored. Pairs of sources are the result itself, so it grows with their square.
    """
    whole = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(whole(lang_col, "lang"), whole(source_col, "source"), whole(text_col, "text"))
    kept = cut(postings(docs, least))
    groups = cut(_sums(docs, kept))
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(_p("n", "size", "v"))).withColumn("q", F.expr(_p("total", "lang_size", "v")))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = _pairs(kept, groups, priced.select("lang", "source", "term", "p", "p0")).withColumn("rank", F.row_number().over(order))
    apart = priced.filter("p > q").selectExpr("lang", "source", "term as item", f"{_f('p', 'q')} as value")
    apart = apart.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    told = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told(pairs, "pair").unionByName(told(apart, "term"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, audited by language and source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The dense table: every kept term of a language in every group.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v ON w.lang = v.lang AND w.term = v.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS n FROM v GROUP BY lang),
g AS (SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS n FROM (SELECT DISTINCT lang, source FROM d) x),
dense AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         CAST(1 + (CAST(coalesce(c.n, 0) + 1 AS HUGEINT) * 1000000000) // CAST(g.n + l.v AS HUGEINT) AS BIGINT) AS p,
         CAST(1 + (CAST(v.total + 1 AS HUGEINT) * 1000000000) // CAST(l.n + l.v AS HUGEINT) AS BIGINT) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN l ON g.lang = l.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200"""
