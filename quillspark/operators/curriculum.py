"""Curriculum frames: outcomes under competencies under goals, and what is mapped to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.relational import best_overlap

#: Scores of a lexical match (cap, and least that is accepted), an inherited one, a validated citation, an author's.
LEXICAL, ACCEPTED, INHERITED, CITED, AUTHORED = 0.45, 0.25, 0.5, 0.9, 1.0


def frame(nodes: DataFrame) -> DataFrame:
    """(id, code, type, goal, competency, outcome) of nodes (id, code, type, parent_id): two left joins over a fixed depth of three."""
    one = lambda a: nodes.select(*[F.col(c).alias(f"{a}_{c}") for c in ("id", "code", "type", "parent_id")])
    s, p, g = one("s"), one("p"), one("g")
    x = s.join(p, F.col("s_parent_id") == F.col("p_id"), "left").join(g, F.col("p_parent_id") == F.col("g_id"), "left")
    by = lambda outcome, competency, goal: F.when(F.col("s_type") == "outcome", outcome).when(F.col("s_type") == "competency", competency).otherwise(goal)
    none = F.lit(None).cast("string")
    return x.select(
        F.col("s_id").alias("id"), F.col("s_code").alias("code"), F.col("s_type").alias("type"), by(F.col("g_code"), F.col("p_code"), F.col("s_code")).alias("goal"),
        by(F.col("p_code"), F.col("s_code"), none).alias("competency"), by(F.col("s_code"), none, none).alias("outcome"),
    )


def match(concepts: DataFrame, outcomes: DataFrame, k: int = 3) -> DataFrame:
    """(concept, outcome, score): the k outcomes (id, description) that hold most of a concept's (id, name) words; capped, and only from the least accepted."""
    left = concepts.select(F.col("id").alias("l"), T.stems("name").alias("tokens"))
    right = outcomes.select(F.col("id").alias("r"), T.stems("description").alias("tokens"))
    x = best_overlap(left, right, k).filter(F.col("score") >= ACCEPTED)
    return x.select(F.col("l").alias("concept"), F.col("r").alias("outcome"), F.least(F.col("score"), F.lit(LEXICAL)).alias("score"), "rank")


def inherit(mapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outcomes under a mapped competency, at the inherited score, for concepts that map none of them themselves. mapped: concept, node, score."""
    under = nodes.filter("type = 'outcome'").select(F.col("id").alias("child"), F.col("parent_id").alias("node"))
    own = mapped.select("concept", F.col("node").alias("child"))
    return mapped.join(under, "node").select("concept", "child").distinct().join(own, ["concept", "child"], "left_anti").select("concept", F.col("child").alias("node"), F.lit(INHERITED).alias("score"))


def resync(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (item, code) with the node ids that their codes have now; null when a code is gone. Codes compare without case, spaces and dashes."""
    n = nodes.groupBy(T.code_key("code").alias("_k")).agg(F.min("id").alias("node"))
    return links.withColumn("_k", T.code_key("code")).join(n, "_k", "left").select("item", "code", "node")


def primary(links: DataFrame) -> DataFrame:
    """(item, node): of each item's links (item, ord, node, score) the best scored, first cited on ties."""
    return links.groupBy("item").agg(F.max_by("node", F.struct("score", -F.col("ord"))).alias("node"))


def concept_plan(have: DataFrame, blueprint: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, level, form, want, have, gap): what each concept lacks of the blueprint (level, form, want).

    Every concept is held against every blueprint row, whole; which side is broadcast, if any, is left to their sizes.
    """
    want = concepts.select("concept").crossJoin(blueprint)
    h = have.groupBy("concept", "level", "form").agg(F.count("*").alias("have"))
    x = want.join(h, ["concept", "level", "form"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return x.withColumn("gap", F.greatest(F.lit(0), F.col("want") - F.col("have")))
