"""Calendars, capacity and allocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.functions import text as T
from quillspark.functions.scoring import distribute


def calendar(terms: DataFrame) -> DataFrame:
    """(term_id, day, weekday) of every day of every term; Monday is 0. Terms whose end precedes their start have none."""
    ok = terms.filter(F.col("start_date") <= F.col("end_date"))
    return ok.select("term_id", F.explode(F.sequence(F.col("start_date").cast("date"), F.col("end_date").cast("date"), F.expr("interval 1 day"))).alias("day")).withColumn("weekday", F.weekday("day"))


def holidays(events: DataFrame) -> DataFrame:
    """Days off; a generic "holiday" on a Saturday doesn't count."""
    generic = (F.lower(F.trim("title")) == "holiday") & (F.weekday("day") == 5)
    return events.filter(~generic).select("day").distinct()


def teaching_slots(days: DataFrame, timetable: DataFrame, off: DataFrame) -> DataFrame:
    """Calendar days with the week's template (weekday, period) less days off."""
    return days.join(off, "day", "left_anti").join(timetable, "weekday").select("term_id", "day", "weekday", "period")


def week_number(day: Column, start: Column) -> Column:
    """1 in the start's week, one more each Monday."""
    monday = lambda d: F.date_sub(d.cast("date"), F.weekday(d))
    return (F.floor(F.datediff(monday(day), monday(start)) / 7) + 1).cast("long")


def capacity(slots: DataFrame, minutes: Column, needed: DataFrame) -> DataFrame:
    """By term: periods, minutes, needed minutes, buffer in percent and status (comfortable, tight, critical, short)."""
    have = slots.groupBy("term_id").agg(F.count("*").alias("periods"), F.sum(minutes).cast("long").alias("minutes"))
    x = have.join(needed, "term_id", "left").withColumn("needed", F.coalesce("needed", F.lit(0)).cast("long"))
    buffer = F.when(F.col("minutes") > 0, (F.col("minutes") - F.col("needed")) * 100.0 / F.col("minutes")).otherwise(0.0)
    return x.withColumn("buffer", buffer).withColumn("status", capacity_status(F.col("buffer")))


def capacity_status(buffer: Column) -> Column:
    return F.when(buffer >= 15, "comfortable").when(buffer >= 5, "tight").when(buffer >= 0, "critical").otherwise("short")


def allocate(units: DataFrame) -> DataFrame:
    """Periods of chapters (unit, chapter, explicit, unit_total): explicit ones stand, the rest of the unit's total is split evenly, else null."""
    w = W.partitionBy("unit")
    open_ = F.col("explicit").isNull()
    n = F.sum(F.when(open_, 1).otherwise(0)).over(w)
    left = F.greatest(F.lit(0), F.max("unit_total").over(w) - F.coalesce(F.sum("explicit").over(w), F.lit(0)))
    rn = F.row_number().over(w.orderBy(open_.desc(), "chapter"))
    share = F.floor(left / n) + F.when(rn <= left % n, 1).otherwise(0)
    return units.withColumn("periods", F.coalesce(F.col("explicit").cast("long"), F.when(F.col("unit_total").isNotNull(), share).cast("long")))


def split_by_group(df: DataFrame, minimum: int = 2, maximum: int = 5) -> DataFrame:
    """(grp, ord, size, target) to (grp, ord, quota): bounded proportional split. Groups are one chapter's topics, so each fits a task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ord")
        return pd.DataFrame({"grp": p["grp"], "ord": p["ord"], "quota": distribute(int(p["target"].iloc[0]), p["size"].astype(int).tolist(), minimum, maximum)})

    return df.groupBy("grp").applyInPandas(run, "grp long, ord long, quota long")


def chapter_budget(chapters: DataFrame, topics: DataFrame) -> DataFrame:
    """Chapters (chapter, outcomes, competencies, periods) with their budget and the topics' quotas, from topics (chapter, ord, size).

    Gives chapter, target, low, high, floor, ceiling, raw, source, quota (array by ord) and warnings; where the
    bounds of a topic's share move the total, the total follows them (bounds_moved_total).
    """
    n = topics.groupBy("chapter").agg(F.count("*").alias("topics"))
    b = chapters.join(n, "chapter", "left").select("chapter", scoring.budget(F.col("topics"), F.coalesce("outcomes", F.lit(0)), F.coalesce("competencies", F.lit(0)), F.col("periods")).alias("b")).select("chapter", "b.*")
    sized = topics.join(b.select("chapter", "target"), "chapter").select(F.col("chapter").cast("long").alias("grp"), F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size"), F.col("target").cast("long").alias("target"))
    one = F.array_sort(F.collect_list(F.struct("ord", "quota")))
    quota = split_by_group(sized).groupBy("grp").agg(F.transform(one, lambda x: x["quota"].cast("int")).alias("quota"), F.sum("quota").cast("int").alias("_total")).withColumnRenamed("grp", "_c")
    x = b.join(quota, b["chapter"].cast("long") == F.col("_c"), "left")
    total, moved = F.coalesce("_total", "target"), F.coalesce(F.col("_total") != F.col("target"), F.lit(False))
    return x.select(
        "chapter", total.alias("target"), F.least("low", total).alias("low"), F.greatest("high", total).alias("high"), "floor", "ceiling", "raw", "source", "quota",
        F.when(moved, F.array_append("warnings", "bounds_moved_total")).otherwise(F.col("warnings")).alias("warnings"),
    )


def enforce_quota(concepts: DataFrame) -> DataFrame:
    """Concepts (topic, ord, score, quota) with kept and reason: a topic keeps one more than its quota at most, its best scored; below the bar of evidence only the least number stays."""
    rn = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("score"), "ord"))
    want = F.greatest(F.col("quota"), F.lit(scoring.LEAST_KEPT))
    limit = F.greatest(F.lit(scoring.LEAST_KEPT), F.least(F.lit(scoring.MOST_KEPT), want + 1))
    reason = F.when(rn > limit, "over the allowance").when((F.col("score") < scoring.QUALITY_BAR) & (rn > scoring.LEAST_KEPT), "not supported by the text")
    return concepts.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def term_slices(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, chapter): chapters (chapter, ord) dealt over terms (term, days) in proportion to their teaching days, in order.

    A term's share of the days, added up, gives where it ends among the chapters; the last term takes the rest.
    """
    upto = F.sum("days").over(W.orderBy("term").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("days").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    t = terms.withColumn("_to", upto / total).withColumn("_from", F.lag("_to", 1, 0.0).over(W.orderBy("term")))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = chapters.withColumn("_at", (F.row_number().over(W.orderBy("ord")) - 0.5) / F.count("*").over(every))
    return c.join(t, (F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_to"))).select("term", "chapter")


def greedy(df: DataFrame) -> DataFrame:
    """(grp, item, need, bins, room) to (grp, item, bin): each item, in order, goes to the bin with most room left (the first on ties).

    Each choice depends on all before it, so a group, one term's chapters for one subject, is one task's.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("item")
        room = [float(p["room"].iloc[0])] * int(p["bins"].iloc[0])
        out = []
        for need in p["need"]:
            b = max(range(len(room)), key=lambda i: (room[i], -i))
            room[b] -= need
            out.append(b)
        return pd.DataFrame({"grp": p["grp"], "item": p["item"], "bin": out})

    return df.groupBy("grp").applyInPandas(run, "grp long, item long, bin long")


def pack(df: DataFrame, period: int = 40, review_after: int = 5) -> DataFrame:
    """(grp, ord, minutes) to lesson periods (grp, period, kind, ord, minutes, coverage).

    Concepts fill periods in order and run over into the next; after ``review_after`` teaching periods in a row comes a
    review. A group is one chapter's concepts, which a task holds.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows, at, used, taught, g = [], 1, 0, 0, p["grp"].iloc[0]
        for ord_, need in p.sort_values("ord")[["ord", "minutes"]].itertuples(index=False):
            left = need
            while left > 0:
                if used == period:
                    at, used, taught = at + 1, 0, taught + 1
                    if taught == review_after:
                        rows.append((g, at, "review", None, period, None))
                        at, taught = at + 1, 0
                take = min(left, period - used)
                left, used = left - take, used + take
                rows.append((g, at, "teach", ord_, take, round(100.0 * (need - left) / need, 2)))
        return pd.DataFrame(rows, columns=["grp", "period", "kind", "ord", "minutes", "coverage"]).astype({"ord": "Int64"})

    return df.groupBy("grp").applyInPandas(run, "grp long, period long, kind string, ord long, minutes long, coverage double")


def align_names(names: DataFrame, rows: DataFrame, least: float = 0.6) -> DataFrame:
    """(grp, l, r, how): names (grp, l, name) to rows (grp, r, name), one to one: by words, best first, then what is left in order, where as many are left on either side."""
    a, b = names.select("grp", "l", T.stems("name").alias("a")), rows.select(F.col("grp").alias("_g"), "r", T.stems("name").alias("b"))
    e, f = a.select("grp", "l", "a", F.explode("a").alias("x")), b.select("_g", "r", "b", F.explode("b").alias("_x"))
    met = e.join(f, (F.col("grp") == F.col("_g")) & (F.col("x") == F.col("_x"))).select("grp", "l", "r", T.containment(F.col("a"), F.col("b")).alias("score")).distinct()
    hit = match_names(met.select(F.col("grp").cast("long").alias("grp"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "score"), least)
    w = W.partitionBy("grp")
    left = names.select("grp", "l").join(hit.select("grp", "l"), ["grp", "l"], "left_anti")
    left = left.withColumn("k", F.row_number().over(w.orderBy("l"))).withColumn("n", F.count("*").over(w))
    right = rows.select("grp", "r").join(hit.select("grp", "r"), ["grp", "r"], "left_anti")
    right = right.withColumn("k", F.row_number().over(w.orderBy("r"))).withColumn("n", F.count("*").over(w))
    rest = left.join(right, ["grp", "k", "n"]).select(F.col("grp").cast("long").alias("grp"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))
    return hit.withColumn("how", F.lit("words")).unionByName(rest.withColumn("how", F.lit("order")))


def match_names(df: DataFrame, least: float = 0.6) -> DataFrame:
    """(grp, l, r, score) to (grp, l, r): one to one, best score first. Groups are one unit's names, which a task holds."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        seen_l, seen_r, rows = set(), set(), []
        for l, r in p[p["score"] >= least].sort_values(["score", "l", "r"], ascending=[False, True, True])[["l", "r"]].itertuples(index=False):  # noqa: E741
            if l not in seen_l and r not in seen_r:
                seen_l.add(l)
                seen_r.add(r)
                rows.append((p["grp"].iloc[0], l, r))
        return pd.DataFrame(rows, columns=["grp", "l", "r"])

    return df.groupBy("grp").applyInPandas(run, "grp long, l long, r long")


def rebalance(df: DataFrame, floor: int) -> DataFrame:
    """(grp, cat, have) to (grp, cat, want): categories below ``floor`` are filled from the largest, which keep the floor.

    What moves is the lesser of all that is missing and all that is to spare. The largest are levelled down to a line,
    the smallest up to another; where the division leaves one over, the last by name keep it.
    """
    w, have = W.partitionBy("grp"), F.col("have").cast("long")
    more, less = F.greatest(have - floor, F.lit(0)), F.greatest(floor - have, F.lit(0))
    x = df.select("grp", "cat", have.alias("have"), more.alias("more"), less.alias("less"))
    moved = F.least(F.sum("more").over(w), F.sum("less").over(w))
    x = _levelled(x.withColumn("moved", moved), "more", "down", F.col("cat").desc())
    x = _levelled(x, "less", "up", F.col("cat").desc())
    return x.select("grp", "cat", (F.col("have") - F.col("down") + F.col("up")).alias("want"))


def _levelled(x: DataFrame, part: str, name: str, order: Column) -> DataFrame:
    """Adds ``name``: what is cut off ``part`` so that ``moved`` in all is cut and the largest rest is least; prefix sums of the sorted parts give the line."""
    w = W.partitionBy("grp")
    top = w.orderBy(F.col(part).desc(), order)
    k, s = F.row_number().over(top), F.sum(part).over(top.rowsBetween(W.unboundedPreceding, W.currentRow))
    nxt = F.coalesce(F.lead(part).over(top), F.lit(0))
    y = x.withColumn("_k", k).withColumn("_s", s).withColumn("_next", nxt)
    # the first k from which levelling to the next one cuts enough
    enough = F.col("_s") - F.col("_k") * F.col("_next") >= F.col("moved")
    first = F.min(F.when(enough, F.struct("_k", "_s"))).over(w)
    y = y.withColumn("_f", first)
    rest = F.col("_f._s") - F.col("moved")  # what the first k keep in all
    base, extra = F.floor(rest / F.col("_f._k")).cast("long"), (rest % F.col("_f._k")).cast("long")
    within = F.col("_k") <= F.col("_f._k")
    # of the k, as many as are left over keep one more: the last by name
    keeps = F.row_number().over(w.orderBy(within.desc(), order)) <= extra
    cut = F.when(within & (F.col("moved") > 0), F.col(part) - base - F.when(keeps, 1).otherwise(0)).otherwise(0)
    return y.withColumn(name, F.greatest(cut, F.lit(0)).cast("long")).drop("_k", "_s", "_next", "_f")
