"""Page layout: reading order, merged fragments, sections, nearby text. Input: doc, page, id, x1, y1, x2, y2, text and, where told, role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ("doc", "page")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds band and pos: a block whose top lies below all before it by more than a gap opens a band; bands read left to right."""
    gap = F.greatest(F.lit(8), F.floor(F.percentile(F.greatest(F.lit(1), F.col("y2") - F.col("y1")), F.lit(0.5)) * 0.35))
    gaps = blocks.groupBy(*PAGE).agg(gap.alias("_gap"))
    top = W.partitionBy(*PAGE).orderBy("y1", "x1", "id")
    b = blocks.join(gaps, list(PAGE)).withColumn("_low", F.max("y2").over(top.rowsBetween(W.unboundedPreceding, -1)))
    b = b.withColumn("_new", F.when(F.col("y1") > F.col("_low") + F.col("_gap"), 1).otherwise(0)).withColumn("band", F.sum("_new").over(top))
    pos = F.row_number().over(W.partitionBy(*PAGE).orderBy("band", "x1", "y1", "id"))
    return b.withColumn("pos", pos).drop("_gap", "_low", "_new")


def merge_fragments(blocks: DataFrame, joins: Column | None = None) -> DataFrame:
    """Consecutive paragraphs of which the first doesn't end a sentence become one; a word cut by a hyphen is whole again.

    ``joins`` may replace the condition; it sees ``prev``, the text before. Input ordered by pos.
    """
    w = W.partitionBy(*PAGE).orderBy("pos")
    b = blocks.withColumn("prev", F.lag("text").over(w)).withColumn("_prole", F.lag("role").over(w))
    cond = joins if joins is not None else (F.col("role") == "paragraph") & (F.col("_prole") == "paragraph") & ~F.col("prev").rlike(r"[.?!:]\s*$")
    b = b.withColumn("island", F.sum(F.when(F.coalesce(cond, F.lit(False)), 0).otherwise(1)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    text = F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["text"]), " "), r"(\p{L})- (\p{Ll})", "$1$2")
    return b.groupBy(*PAGE, "island").agg(F.min("pos").alias("pos"), F.min_by("role", "pos").alias("role"), text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))


def sections(blocks: DataFrame) -> DataFrame:
    """Adds section: the position of the last heading at or before the block, over pages."""
    w = W.partitionBy("doc").orderBy("page", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.when(F.col("role").isin("title", "heading"), F.struct("page", "pos", "text"))
    return blocks.withColumn("section", F.last(head, ignorenulls=True).over(w))


def nearby(blocks: DataFrame, least: int = 12, most: int = 240) -> DataFrame:
    """Adds nearby: what stands before and after, where it is long enough to say something."""
    w = W.partitionBy(*PAGE).orderBy("pos")
    use = lambda c: F.when(F.char_length(c) > least, c)
    return blocks.withColumn("nearby", F.substring(F.concat_ws(" ", use(F.lag("text").over(w)), use(F.lead("text").over(w))), 1, most))


def rebuild_markdown(blocks: DataFrame) -> DataFrame:
    """(doc, md) from blocks in order: titles and headings as such, the rest as paragraphs."""
    line = F.when(F.col("role") == "title", F.concat(F.lit("# "), "text")).when(F.col("role") == "heading", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    one = F.array_sort(F.collect_list(F.struct("page", "pos", line.alias("line"))))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(one, lambda x: x["line"]), "\n\n").alias("md"))


def best_pass(passes: DataFrame, score: Column) -> DataFrame:
    """The extraction pass (doc, pass, ...) of the best score; the first on ties."""
    rest = [c for c in passes.columns if c != "doc"]
    return passes.withColumn("_s", score).groupBy("doc").agg(F.max_by(F.struct(*rest), F.struct("_s", -F.col("pass"))).alias("_r")).select("doc", "_r.*")


def interpolate(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Fills nulls of ``value`` on the line between the known values around them; monotone when those are."""
    back = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(by).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    x = df.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.o")) / (F.col("_b.o") - F.col("_a.o"))
    return x.withColumn(value, F.coalesce(F.col(value), line, "_a.v", "_b.v")).drop("_a", "_b")
