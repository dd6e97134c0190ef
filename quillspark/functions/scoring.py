"""Scores, bands and budgets as Column builders. Rounding is half-even where the domain's integers are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each part of a confidence score weighs, by profile.
WEIGHTS = {
    "content": {"grounding_chapter": 0.30, "grounding_span": 0.25, "attribution": 0.30, "distinctness": 0.15},
    "curriculum": {"grounding_chapter": 0.22, "grounding_span": 0.18, "attribution": 0.20, "distinctness": 0.10, "curriculum_anchor": 0.30},
    "deterministic_backfill": {"attribution": 0.55, "distinctness": 0.20, "curriculum_anchor": 0.25},
}
# What an error and a warning cost, the bars of acceptance and of the flag, and what a failed audit leaves.
ERROR, WARNING, ACCEPT, FLAG, FAILED_AUDIT = 0.20, 0.08, 0.80, 0.55, 0.85


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def band(x: Column) -> Column:
    return F.when(x >= ACCEPT, "auto_accepted").when(x >= FLAG, "flagged").otherwise("low_confidence")


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the parts that are measured (not null), by weight; with none measured, zero."""
    num = sum((F.when(parts[k].isNotNull(), F.lit(w) * parts[k]).otherwise(0.0) for k, w in weights.items() if k in parts), F.lit(0.0))
    den = sum((F.when(parts[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items() if k in parts), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(0.0)


def confidence(parts: dict[str, Column], profile: str = "content", errors=0, warnings=0) -> Column:
    """Weighted mean less penalties, within 0 and 1, to three places."""
    raw = weighted(parts, WEIGHTS.get(profile, WEIGHTS["content"]))
    return F.bround(clamp(raw - ERROR * F.lit(errors) - WARNING * F.lit(warnings), 0.0, 1.0), 3)


def chapter_confidence(mean: Column, passed: Column) -> Column:
    return F.bround(clamp(F.when(passed, mean).otherwise(mean * FAILED_AUDIT), 0.0, 1.0), 3)


# From which coverage a name counts as the text's own, and a curriculum citation's full score.
FULL_COVERAGE, CITED = 0.6, 0.9
# How far two anchors of a budget may lie apart.
DIVERGENCE = 2.0
# What speaks for keeping a concept, what speaks against it, the bar of evidence, and concepts a topic has at least and most.
KEEP = {"grounded": 2.0, "attribution": 1.0, "outcome": 0.5, "outline": 0.3, "revision": -1.0}
QUALITY_BAR, LEAST_KEPT, MOST_KEPT = 1.2, 2, 5
# Points of what a document's structure holds.
STRUCTURE = {"blocks": 25, "outline": 20, "figures": 15, "tables": 15, "formulas": 15, "both_scripts": 10}


def concept_parts(in_chapter: Column, in_span: Column, coverage: Column, nearest: Column, mapped: Column, outcome_coverage: Column, has_curriculum: Column) -> dict[str, Column]:
    """The parts of a concept's confidence: a quote found in the chapter and in its topic's span, its name's words there, distance to its nearest sibling, and the curriculum.

    ``mapped`` is the best score of its mapped outcomes, ``outcome_coverage`` how much of its name the outcomes hold. The
    curriculum part is null, not zero, where there is none to be measured against.
    """
    anchor = F.when(mapped.isNotNull(), F.least(F.lit(1.0), mapped / CITED)).when(outcome_coverage.isNotNull(), F.least(F.lit(1.0), outcome_coverage / FULL_COVERAGE)).when(has_curriculum, F.lit(0.0))
    return {
        "grounding_chapter": in_chapter.cast("double"), "grounding_span": (in_chapter & in_span).cast("double"), "attribution": F.least(F.lit(1.0), coverage / FULL_COVERAGE),
        "distinctness": F.greatest(F.lit(0.0), 1.0 - F.coalesce(nearest, F.lit(0.0))), "curriculum_anchor": anchor,
    }


def topic_parts(in_chapter: Column, coverage: Column, outline_coverage: Column) -> dict[str, Column]:
    """The parts of a topic's confidence: the book's own outline stands where a concept has its span, and a topic has no siblings to fear."""
    return {"grounding_chapter": in_chapter.cast("double"), "attribution": F.least(F.lit(1.0), coverage / FULL_COVERAGE), "grounding_span": (F.coalesce(outline_coverage, F.lit(0.0)) >= 0.5).cast("double"), "distinctness": F.lit(1.0)}


def keep_score(grounded: Column, coverage: Column, outcome_coverage: Column, outline_coverage: Column, revision: Column) -> Column:
    """How much speaks for a concept's place in its chapter; it only ranks a topic's concepts. Null coverages: nothing to be covered."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    x = KEEP["grounded"] * flag(grounded) + KEEP["attribution"] * F.least(F.lit(1.0), F.coalesce(coverage, F.lit(0.0)) / FULL_COVERAGE) + KEEP["outcome"] * F.coalesce(outcome_coverage, F.lit(0.0))
    return F.round(x + KEEP["outline"] * flag(outline_coverage >= 0.5) + KEEP["revision"] * flag(revision), 3)


def structure_score(blocks: Column, outline: Column, figures: Column, tables: Column, formulas: Column, md: Column) -> Column:
    """Points of 100 for what a document's structure holds; each argument is a count."""
    both = md.rlike(r"[\x{0900}-\x{097F}]") & md.rlike("[A-Za-z]")
    told = {"blocks": blocks > 0, "outline": outline > 0, "figures": figures > 0, "tables": tables > 0, "formulas": (formulas > 0) | md.contains("$"), "both_scripts": both}
    return sum((F.when(F.coalesce(told[k], F.lit(False)), points).otherwise(0) for k, points in STRUCTURE.items()), F.lit(0)).cast("int")


# The anchors' factors, the structural bounds and the band of a budget.
def budget(topics: Column, outcomes: Column, competencies: Column, periods: Column) -> Column:
    """struct<target,low,high,floor,ceiling,raw,source,warnings>: the first of four anchors, most specific first, within structural bounds.

    Warnings: split_below_topics, where the topics alone need more than the cap; anchors_diverge, where outcomes and
    periods lie more than twice apart.
    """
    n = F.greatest(F.coalesce(topics, F.lit(1)), F.lit(1))
    half_even = lambda x: F.bround(x, 0).cast("int")
    source = F.when(outcomes >= 4, "learning_outcomes").when(competencies >= 2, "competencies").when(periods >= 1, "periods").otherwise("topics")
    raw = (
        F.when(outcomes >= 4, half_even(1.25 * outcomes)).when(competencies >= 2, half_even(3.0 * competencies))
        .when(periods >= 1, half_even(2.0 * periods)).otherwise(half_even(3.0 * n))
    )
    floor = F.greatest(2 * n, F.lit(8))
    ceiling = F.greatest(F.least(4 * n, F.lit(30)), floor)
    target = clamp(raw, floor, ceiling)
    low = F.greatest(floor, half_even(target * 0.8))
    high = F.least(ceiling, F.greatest(low, half_even(target * 1.2)))
    by_periods = F.when(periods >= 1, half_even(2.0 * periods))
    apart = F.greatest(raw, by_periods) / F.greatest(F.lit(1), F.least(raw, by_periods)) > DIVERGENCE
    warnings = [F.when(floor > 30, "split_below_topics"), F.when((outcomes >= 4) & by_periods.isNotNull() & apart, "anchors_diverge")]
    told = F.filter(F.array(*warnings), lambda w: w.isNotNull())
    return F.struct(*[x.cast("int").alias(k) for k, x in (("target", target), ("low", low), ("high", high), ("floor", floor), ("ceiling", ceiling), ("raw", raw))], source.alias("source"), told.alias("warnings"))


def distribute(target: int, sizes: list[int], minimum: int = 2, maximum: int = 5) -> list[int]:
    """``target`` split over ``sizes`` in proportion, each share within bounds; the remainder goes to (or comes from) the largest that can take it.

    The bounds win over the total. A sequential rule over one chapter's few topics; ``allocate.split`` applies it by group.
    """
    sizes = [max(1, s) for s in sizes]
    out = [max(minimum, min(maximum, round(target * s / sum(sizes)))) for s in sizes]
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while (gap := target - sum(out)) != 0:
        order = by_size if gap > 0 else by_size[::-1]
        i = next((i for i in order if (out[i] < maximum if gap > 0 else out[i] > minimum)), None)
        if i is None:
            break
        out[i] += 1 if gap > 0 else -1
    return out


def extraction_quality(chars: Column, words: Column, mojibake: Column) -> Column:
    """A document's quality in 0..1: enough text, a word-like shape, few mis-decoded characters."""
    size = F.when(chars >= 2000, 1.0).when(chars >= 500, 0.7).when(chars >= 100, 0.4).otherwise(0.1)
    length = F.when(words > 0, chars / words).otherwise(0.0)
    shape = F.when(length.between(3.0, 12.0), 1.0).otherwise(0.5)
    return F.greatest(F.lit(0.0), size * shape - F.least(mojibake * 10, F.lit(1.0)))
