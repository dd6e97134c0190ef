"""The education operators on small inputs of our own."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.functions import education as E
from quillspark.functions import text as T
from quillspark.operators import audits, curriculum, layout, rules


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_options_keep_their_operators(spark):
    n = lambda s: one(spark, E.norm_option("s"), s=s)
    assert n("A + B -> C") != n("A -> B + C") and n("-9") != n("9") and n("<b>x</b> = 1") == "x equals 1"


def test_answers_reduce_to_values(spark):
    v = lambda s: one(spark, E.answer_value("s"), s=s)
    assert v("(b) green") == "green" and v("Rs 400. a7 = 100 + 300 = Rs 400") == "Rs 400" and v("x + 1 = 3, so x = 2") == "2"
    assert one(spark, E.answer_letter("s"), s="ख) हरा") == 1 and one(spark, E.answer_letter("s"), s="green") is None
    assert one(spark, E.names_option(F.col("a"), F.col("b")), a="photosynth", b="Photosynthesis in plants") is True


def test_small_functions(spark):
    assert one(spark, E.human_duration("s"), s=3725) == "1h 02m" and one(spark, E.human_duration("s"), s=0) == "-"
    assert one(spark, E.period_line("s"), s="## Tissues No. of Periods: 13").asDict() == {"name": "Tissues", "periods": 13}
    assert one(spark, E.period_line("s"), s="Max. Marks: 100") is None
    assert one(spark, E.markdown_images("s"), s="a ![x](p/q.png) ![](r.jpg)") == ["q.png", "r.jpg"]
    assert one(spark, E.relink("s", "/new"), s="![x](p/q.png)") == "![x](/new/q.png)"
    assert one(spark, E.tidy_markdown("s"), s="a  \n\n\n\n\nb\n##") == "a\n\n\nb\n"
    assert one(spark, E.render(F.lit("{p} — {t}"), p=F.col("s"), t=F.lit("x")), s="P") == "P — x"
    assert one(spark, E.before_verbs("s", ("Explain", "List")), s="Explain light List gases") == ["Explain light", "List gases"]
    assert one(spark, E.snippets("s", F.lit("Fig. 2"), 4, 4), s="see now Fig. 2 here, and Fig. 3") == ["now Fig. 2 her"]
    assert one(spark, E.slice_by_quotes(F.col("s"), F.lit("b"), F.lit("d")), s="abcde") == "bcd"
    assert one(spark, E.slice_by_quotes(F.col("s"), F.lit("z"), F.lit("d")), s="abcde") == "abcde"
    assert one(spark, E.transliterator({"a": "x", "ab": "y"})("s"), s="abac") == "yxc"
    assert one(spark, E.repair("s"), s="cafÃ©") == "café" and one(spark, E.repair("s"), s="漢") == "漢"
    assert one(spark, E.json_or_text("s"), s='{"a": 1}') == '{"a": 1}' and one(spark, E.json_or_text("s"), s='say "hi"') == '"say \\"hi\\""'
    assert one(spark, E.without_self(F.array(F.lit("A"), F.lit("b"), F.lit("b"), F.lit("")), F.col("s")), s="a") == ["b"]
    assert '"correct":true' in one(spark, E.answer_envelope(F.lit("mcq"), F.col("s"), F.array(F.lit("p"), F.lit("q")), F.lit("q")), s="q")
    assert one(spark, E.shared_words(F.col("s"), F.lit("")), s="x") == -1.0
    assert one(spark, E.damage("s"), s="Join us on telegram") == ["junk_banner"]
    assert one(spark, E.deadline(F.lit(dt.datetime(2024, 1, 1, 9, 0)), F.lit(8), F.lit(30)), s="") == dt.datetime(2024, 1, 2, 8, 30)
    assert one(spark, E.learning_flow(F.lit("MCQ"), F.lit("Easy"), F.lit("Remember"), F.lit(1), F.lit(""), F.lit(True), F.col("m")), m=False) == "adaptive_diagnostic"


def test_choice_rules(spark):
    df = spark.createDataFrame([(1, "Which gas do plants take in?", ["oxygen", "carbon dioxide", "helium", "neon"], "carbon dioxide", "easy", "Remember", 1), (2, "Photosynthesis needs what light?", ["photosynthesis", "all of the above", "none of these", "x"], "photosynthesis", "hard", "Remember", 1)], "id int, stem string, o array<string>, k string, d string, b string, dok int")
    c = rules.check(df, audits.choice_rules(*[F.col(x) for x in ("stem", "o", "k", "d", "b", "dok")]))
    got = {r["id"]: {i["code"] for i in r["issues"]} for r in c.collect()}
    assert got[1] == set() and got[2] == {"vague_options", "gives_key_away", "bloom", "dok"}


def test_answer_keys(spark):
    df = spark.createDataFrame([(1, ["red", "green"], "green", ["red", "green"], "(b) green"), (2, ["red", "green"], "red", ["red", "green"], "(b) green"), (3, ["red", "blue"], "red", ["red", "green"], "(a) green")], "id int, options array<string>, marked string, payload_options array<string>, answer_text string")
    assert [tuple(r) for r in audits.answer_keys(df).orderBy("id").collect()] == [(1, True, True, True), (2, True, True, False), (3, False, False, None)]


def test_alignment_finds_a_slip(spark):
    words = [[f"w{i}", f"v{i}"] for i in range(12)]
    rows = [("good", i, words[i], words[i]) for i in range(12)] + [("slid", i, words[min(i + 1, 11)] if i >= 4 else words[i], words[i]) for i in range(12)]
    got = {r["file"]: r for r in audits.alignment(spark.createDataFrame(rows, "file string, ord int, probe array<string>, stem array<string>")).collect()}
    assert not got["good"]["suspect"] and got["good"]["here"] == 12
    assert got["slid"]["suspect"] and got["slid"]["ahead"] == 7 and got["slid"]["longest"] == 7


def test_misfiled_block(spark):
    rows = [(1, i, "light mirror lens ray") for i in range(20)] + [(1, 1000 + i, "cell tissue organ plant") for i in range(6)] + [(2, i, "acid base salt") for i in range(30)]
    assert [tuple(r)[:4] for r in audits.misfiled_blocks(spark.createDataFrame(rows, "chapter int, id int, text string")).collect()] == [(1, 1000, 1005, 6)]


def test_concept_scores_order(spark):
    chapter = "Plants make food in light. Roots drink water from soil."
    df = spark.createDataFrame([(1, "Plants make food", "plants make food in light", "Plants make food in light.", chapter, None), (2, "Plants make food", "plants make food in light", "Roots drink water from soil.", chapter, None), (3, "Quantum spin", "spin is quantised", "Roots drink water from soil.", chapter, 0.5)], "id int, name string, quote string, slice string, chapter string, nearest double")
    s = {r["id"]: (r["value"], r["status"]) for r in audits.concept_scores(df).collect()}
    assert s[1][0] >= 0.8 > s[2][0] > s[3][0] < 0.55 and s[1][1] == "auto_accepted" and s[3][1] == "low_confidence"


def test_audit(spark):
    topics = spark.createDataFrame([(1, 10, "Water cycle stages", True, 40, 0, 900), (1, 11, "Stages in water cycle", None, 40, 900, 1000), (1, 12, "Unknown planets orbit", True, 10, 1000, 2000), (1, 13, "hidden", False, 5, None, None)], "chapter int, id long, name string, shown boolean, minutes int, start int, end int")
    concepts = spark.createDataFrame([(1, 10, 100, "Water cycle", 39), (1, 13, 101, "x", 5), (1, 99, 102, "y", 5), (1, 11, 103, "Far off things", 10), (2, None, 200, "alone", 5)], "chapter int, topic_id long, id long, name string, minutes int")
    md = "The water cycle has stages. " + "Rain falls on the hills. " * 90
    chapters = spark.createDataFrame([(1, "Water", md, ["the water cycle", "stages of water cycles"]), (2, "Empty", "nothing", None)], "chapter int, title string, md string, semantic array<string>")
    sections = spark.createDataFrame([(1, 1, "Water cycle stages", "teaching", "The water cycle. " * 40), (1, 2, "Clouds and snow", "teaching", "Clouds " * 100), (1, 3, "Unknown planets: revision", "revision", "planets orbit"), (1, 4, "WATER", "teaching", "w " * 400)], "chapter int, ord int, title string, kind string, text string")
    i = audits.audit_chapters(topics, concepts, chapters, sections)
    got = {(r["chapter"], r["check"], r["severity"], tuple(r["ids"])) for r in i.collect()}
    assert got == {
        (1, "grounding", "error", (12,)), (1, "attribution", "error", (101,)), (1, "attribution", "error", (102,)), (1, "attribution", "warning", (103,)), (2, "attribution", "error", ()),
        (1, "relevance", "error", (10, 11)), (1, "relevance", "error", (12,)), (1, "granularity", "warning", (11,)), (1, "hierarchy", "error", (12,)), (1, "hierarchy", "warning", (11,)),
        (1, "coverage", "error", (2,)), (2, "semantic", "warning", ()),
    }
    v = audits.verdicts(i).collect()
    assert [(r["chapter"], r["errors"], r["warnings"], r["passed"]) for r in v] == [(1, 7, 3, False), (2, 1, 1, False)]


def test_concepts_with_a_curriculum(spark):
    """A missing syllabus costs nothing, an unserved one does, a citation beats a match of words."""
    chapter = "Plants make food in light. Roots drink water from soil."
    base = ("Plants make food", "plants make food in light", "Plants make food in light.", chapter, None)
    rows = spark.createDataFrame([(1, *base, None, False), (2, *base, None, True), (3, *base, 0.9, True), (4, *base, 0.45, True)], "id int, name string, quote string, slice string, chapter string, nearest double, mapped double, has_curriculum boolean")
    s = {r["id"]: r["value"] for r in audits.concept_scores(rows, "curriculum").collect()}
    assert s[1] == s[3] == 1.0 and s[2] == 0.7 and s[2] < s[4] < s[3]
    audited = rows.limit(1).withColumn("errors", F.lit(2)).withColumn("warnings", F.lit(1))
    assert audits.concept_scores(audited, "curriculum").first()["value"] == 0.52


def test_blueprint_is_whole(spark):
    concepts = spark.createDataFrame([("a",), ("b",)], "concept string")
    blueprint = spark.range(1500).select(F.col("id").cast("string").alias("level"), F.lit("any").alias("form"), F.lit(1).alias("want"))
    have = spark.createDataFrame([("a", "7", "any")], "concept string, level string, form string")
    x = curriculum.concept_plan(have, blueprint, concepts)
    assert x.count() == 3000 and x.filter("gap = 0").count() == 1


def test_load_shape_and_runs(spark):
    bank = spark.createDataFrame([("Old question about rain and snow",)], "stem string").withColumn("sha256", T.item_hash("stem", F.array().cast("array<string>")))
    items = spark.createDataFrame([(1, "Old question about rain and snow", [], None, False), (2, "New question", ["a"], None, False), (3, "Another one", [], None, True), (4, "Fine", [], None, False), (5, "Fine", [], None, False)], "id int, stem string, options array<string>, key string, has_figure boolean")
    assert {r["id"]: r["hold"] for r in audits.load_shape(items, bank).collect()} == {1: "in the bank", 2: "no key", 3: "needs its figure", 4: None, 5: "repeated in the batch"}
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ledger = spark.createDataFrame([("r", "a", "running", t(1)), ("r", "a", "done", t(2)), ("r", "b", "running", t(2)), ("s", "c", "skipped", t(3))], "run_id string, key string, status string, at timestamp")
    got = {r["run_id"]: (r["state"], r["percent"], r["took"]) for r in audits.latest_runs(ledger, F.lit(t(9))).collect()}
    assert got == {"r": ("stuck", 50.0, "1h 00m"), "s": ("complete", 100.0, "-")}


def test_curriculum(spark):
    nodes = spark.createDataFrame([(1, "CG-1", "goal", None), (2, "C-1.1", "competency", 1), (3, "LO1", "outcome", 2), (4, "LO2", "outcome", 2)], "id int, code string, type string, parent_id int")
    assert {r["id"]: (r["goal"], r["competency"], r["outcome"]) for r in curriculum.frame(nodes).collect()} == {1: ("CG-1", None, None), 2: ("CG-1", "C-1.1", None), 3: ("CG-1", "C-1.1", "LO1"), 4: ("CG-1", "C-1.1", "LO2")}
    mapped = spark.createDataFrame([(7, 2, 0.9), (7, 3, 0.9)], "concept int, node int, score double")
    assert [tuple(r) for r in curriculum.inherit(mapped, nodes).collect()] == [(7, 4, 0.5)]
    links = spark.createDataFrame([(1, "c 1.1"), (2, "gone")], "item int, code string")
    assert {tuple(r) for r in curriculum.resync(links, nodes).select("item", "node").collect()} == {(1, 2), (2, None)}
    m = curriculum.match(spark.createDataFrame([(1, "water cycle")], "id int, name string"), spark.createDataFrame([(5, "explain the water cycle"), (6, "name a planet")], "id int, description string"))
    assert [tuple(r)[:3] for r in m.collect()] == [(1, 5, 0.45)]


def test_layout(spark):
    rows = [(1, 1, 1, 300, 10, 500, 30, "right", "paragraph"), (1, 1, 2, 10, 12, 200, 32, "left hyphen-", "paragraph"), (1, 1, 3, 10, 100, 500, 120, "Title", "heading"), (1, 1, 4, 10, 140, 500, 160, "body ends here without", "paragraph"), (1, 1, 5, 10, 180, 500, 200, "a stop in between.", "paragraph")]
    b = layout.reading_order(spark.createDataFrame(rows, "doc int, page int, id int, x1 int, y1 int, x2 int, y2 int, text string, role string"))
    assert [r["id"] for r in b.orderBy("pos").collect()] == [2, 1, 3, 4, 5]
    merged = layout.merge_fragments(b).orderBy("pos").collect()
    assert [r["text"] for r in merged] == ["left hyphenright", "Title", "body ends here without a stop in between."]
    assert layout.sections(b).orderBy("pos").collect()[-1]["section"]["text"] == "Title"
    assert layout.rebuild_markdown(b).first()["md"].count("## Title") == 1
    assert layout.nearby(b).filter("id = 4").first()["nearby"] == "a stop in between."
    p = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9)], "doc int, pass int, q double")
    assert layout.best_pass(p, F.col("q")).first()["pass"] == 2
