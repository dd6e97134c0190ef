"""Expectations of the domain's functions, pinned on small inputs of our own."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scoring, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens_keep_marks_and_drop_stopwords(spark):
    assert one(spark, text.tokens("s"), s="The Light of प्रकाश, and it's 2 things!") == ["light", "प्रकाश", "s", "2", "things"]
    assert one(spark, text.stems("s"), s="Cities pass the buses") == ["buse", "city", "pass"]
    assert one(spark, text.match_key("s"), s="Integers and the Number Lines") == one(spark, text.match_key("s"), s="Integer and number line")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Definition of ideal gases", "Ideal gas", False),
        ("Understanding number lines", "Number line", True),
        ("Common multiples", "Lowest common multiple", False),
        ("Square numbers", "Square roots", False),
        ("Water cycle stages", "Stages in the water cycle", True),
        ("", "Water", False),
    ],
)
def test_duplicate_names(spark, a, b, same):
    got = one(spark, text.is_duplicate(text.subject_tokens("a"), text.subject_tokens("b")), a=a, b=b)
    assert got is same


def test_coverage_conventions(spark):
    assert one(spark, text.coverage(text.stems("a"), text.stems("b")), a="", b="x y") == 0.0
    assert one(spark, text.coverage(text.stems("a"), text.stems("b")), a="plant cells", b="cell walls in plants") == 1.0
    assert one(spark, text.grounded(F.col("q"), F.col("h")), q=" Two  Words", h="has two words inside") is True
    assert one(spark, text.grounded(F.col("q"), F.col("h")), q="", h="x") is False


FORMS = [
    # labels that are sub-parts: a command stands before them, or nothing
    ("long", False, "Give one test for each of these gases: (a) oxygen (b) hydrogen (c) ammonia (d) chlorine"),
    ("long", False, "Explain the following. (a) Copper turns green in damp air. (b) Salt water conducts. (c) Graphite is soft."),
    ("long", False, "(a) Name the gland that makes saliva. (b) What does it do? (c) Which food does it act on first?"),
    ("short", False, "Write a balanced equation for (a) the burning of sulphur (b) the heating of chalk."),
    # labels that are options, though no options are stored
    ("mcq", False, "The change of ice to water is an example of (i) freezing (ii) melting (iii) boiling (iv) sublimation"),
    ("mcq", False, "Which one of these was not among the findings of the survey? (a) red (b) green (c) blue (d) grey"),
    ("mcq", False, "A spoon left in vinegar loses its shine. This is due to the formation of(a) rust(b) a salt(c) glass(d) wax"),
    ("mcq", False, "The colour of the flame of a sodium lamp is (a) blue (b) yellow (c) violet (d) white"),
    # stored options are facts
    ("mcq", True, "Calculate the speed of a train that covers 90 km in 2 hours."),
    ("mcq", True, "Plants take in carbon dioxide by day. True or false?"),
    ("mcq", True, "8 g of one powder reacts with 3 g of another. What is the total mass afterwards?"),
    # the wording tells
    ("assertion_reason", False, "Assertion (A): Ice floats on water. Reason (R): Ice is less dense."),
    ("assertion_reason", True, "Assertion: The moon shines. Reason: It reflects light."),
    ("match_following", False, "Match the columns: Column-I (a) lime Column-II (i) CaO"),
    ("fill_blank", False, "The SI unit of force is ________."),
    ("true_false", False, "State whether the sentence is true or false: Sound travels in a vacuum."),
    ("proof", False, "Prove that the base angles of an isosceles triangle are equal."),
    ("construction", False, "Draw a neat circuit with two lamps in series."),
    ("numerical", False, "Calculate the work done by a force of 5 N over 3 m."),
    ("case_study_parent", False, "Read this passage and answer the questions below it. The river rose at night."),
    # length tells the rest, and marks that are no words do not count
    ("very_short", False, "Name the vitamin that sunlight gives us."),
    ("very_short", False, "Why is argon put into lamps ? \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad \u00ad"),
    ("short", False, " ".join(["word"] * 30)),
    ("long", False, " ".join(["word"] * 60)),
]


@pytest.mark.parametrize(("form", "mcq", "stem"), FORMS)
def test_forms(spark, form, mcq, stem):
    assert one(spark, text.classify_form(F.col("s"), F.lit(mcq)), s=stem) == form


@pytest.mark.parametrize(
    ("stem", "level", "marks", "dok"),
    [
        ("Design a filter for muddy water.", "create", 5, 4), ("Do you agree? Justify.", "evaluate", 3, 3), ("Compare acids and bases.", "analyze", 1, 2),
        ("Solve for x.", "apply", 5, 3), ("Why do leaves fall?", "understand", 2, 2), ("Define force.", "recall", 1, 1), ("Tick one.", "analyze", 5, 3),
    ],
)
def test_bloom_and_depth(spark, stem, level, marks, dok):
    level_ = text.bloom(F.col("s"), F.lit("long"))
    assert one(spark, level_, s=stem) == level and one(spark, text.dok(level_, F.lit(marks)), s=stem) == dok


def test_scalars(spark):
    assert one(spark, text.safe_int("s"), s="about -12 or 13") == -12
    assert one(spark, text.safe_int("s"), s="none") is None
    assert one(spark, text.cell("s"), s=" 12.0 ") == "12"
    assert one(spark, text.code_key("s"), s="C – 3.1") == "c3.1"
    assert one(spark, text.number_in(F.col("p"), F.lit("12")), p="costs 112 and 12 units") is True
    assert one(spark, text.number_in(F.col("p"), F.lit("11")), p="costs 112") is False
    assert one(spark, text.fold("s"), s="Écologie") == "ecologie"
    assert one(spark, text.item_hash("s", F.array(F.lit("b"), F.lit("a"))), s="Q") == one(spark, text.item_hash("s", F.array(F.lit("a"), F.lit("b"))), s="q")


@pytest.mark.parametrize(
    ("topics", "outcomes", "competencies", "periods", "target", "source"),
    [
        (6, 0, 0, 0, 18, "topics"), (6, 16, 0, 0, 20, "learning_outcomes"), (7, 26, 0, 0, 28, "learning_outcomes"),
        (6, 0, 5, 0, 15, "competencies"), (6, 0, 0, 11, 22, "periods"), (20, 0, 0, 0, 40, "topics"),
    ],
)
def test_budget(spark, topics, outcomes, competencies, periods, target, source):
    b = one(spark, scoring.budget(F.lit(topics), F.lit(outcomes), F.lit(competencies), F.lit(periods)))
    assert (b["target"], b["source"]) == (target, source)
    assert b["floor"] <= b["low"] <= b["target"] <= b["high"] <= b["ceiling"]


def test_budget_rounds_half_to_even(spark):
    assert one(spark, scoring.budget(F.lit(30), F.lit(26), F.lit(0), F.lit(0)))["raw"] == 32


def test_distribute_keeps_bounds_and_total():
    assert sum(scoring.distribute(18, [100, 50, 400, 20, 30, 60])) == 18
    assert scoring.distribute(8, [1] * 6) == [2] * 6
    assert scoring.distribute(18, []) == []


def test_confidence_orders_evidence(spark):
    c = lambda **p: one(spark, scoring.confidence({k: F.lit(v).cast("double") for k, v in p.items()}, "content"))
    good = c(grounding_chapter=1, grounding_span=1, attribution=1, distinctness=1)
    misplaced = c(grounding_chapter=1, grounding_span=0, attribution=0.5, distinctness=1)
    invented = c(grounding_chapter=0, grounding_span=0, attribution=0.2, distinctness=1)
    assert good == 1.0 > misplaced > invented and invented < scoring.FLAG
    assert c(grounding_chapter=1, grounding_span=None, attribution=1, distinctness=None) == 1.0  # absent isn't zero
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in scoring.WEIGHTS.values())


@pytest.mark.parametrize(
    ("stem", "grade"),
    [("The cat sat on the mat.", 0.0), ("Hmm psst tv vcr html css.", 0.39 * 6 + 11.8 - 15.59), ("Incomprehensibilities institutionalize internationalization responsibilities unquestionably notwithstanding", 20.0), ("five words are too few", None), ("प्रकाश one two three four five six", None), (None, None), ("Make some cake? Yes! We like movie time.", 0.39 * 8 / 3 + 11.8 - 15.59)],
)
def test_reading_grade(spark, stem, grade):
    got = one(spark, text.reading_grade("s"), s=stem) if stem is not None else spark.range(1).select(text.reading_grade(F.lit(None).cast("string")).alias("x")).first()["x"]
    assert (got is None) == (grade is None) and (grade is None or abs(got - max(0.0, grade)) < 1e-9)


def test_sections_called_mcq_are_objective(spark):
    from quillspark.functions import education as E

    assert one(spark, E.blueprint_band(F.col("s"), F.lit("long"), F.lit(5)), s="Section A: MCQ") == "objective"
