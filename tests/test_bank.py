"""Bank and plan operators on small inputs of our own."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from quillspark.operators import bank


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_selection_deals_over_concepts(spark):
    rows = [(c, i, i % 2 == 0, True, 1) for c in (1, 2, 3) for i in range(4)]
    got = [(r["concept"], r["ord"]) for r in bank.select_items(spark.createDataFrame(rows, "concept int, ord int, grounded boolean, keyed boolean, dok int"), 4).collect()]
    assert got == [(1, 0), (2, 0), (3, 0), (1, 2)]


def test_tables_answers_and_metadata(spark):
    t = one(spark, bank.trailing_table("s"), s="Fill in. <table><tr><td>a</td><td>b</td></tr></table> ")
    assert (t["stem"], t["answer"]) == ("Fill in.", "a | b")
    assert one(spark, bank.trailing_table("s"), s="No table")["answer"] is None
    items = spark.createDataFrame([(1, "Look at the figure given below", '{"answer_text": ""}'), (2, "x", '{"answer_text": "y"}'), (3, "z", None)], "id int, stem string, answer string")
    assert {r["id"]: r["needs_figure"] for r in bank.missing_answers(items).collect()} == {1: True, 3: False}
    m = bank.metadata(spark.createDataFrame([(1, "Prove that the sum is even", False), (2, "प्रकाश क्या है?", False)], "id int, stem string, is_mcq boolean")).orderBy("id").collect()
    assert (m[0]["form"], m[0]["marks"], m[0]["bloom"], m[0]["difficulty"], m[1]["script"]) == ("proof", 5, "analyze", "hard", "devanagari")


def test_near_duplicates(spark):
    rows = [(1, 1, "red green blue black white"), (1, 2, "white black blue green red pink"), (1, 3, "one two three"), (2, 4, "red green blue black white")]
    assert [tuple(r) for r in bank.near_duplicates(spark.createDataFrame(rows, "grp int, id int, stem string")).collect()] == [(1, 2, 1.0)]


def test_items_without_a_group_have_no_near_duplicates(spark):
    rows = [(None, 1, "red green blue"), (None, 2, "red green blue"), (1, 3, "red red green"), (1, 4, "red red pink")]
    assert [tuple(r) for r in bank.near_duplicates(spark.createDataFrame(rows, "grp int, id int, stem string"), 0.5).collect()] == [(3, 4, 2 / 3)]


def test_rubrics_and_blocks(spark):
    assert [tuple(x) for x in one(spark, bank.mark_bands(F.col("m"), 3), m=8)] == [(1, 3), (4, 6), (7, 8)]
    c = spark.createDataFrame([(1, 1, 0, "roots drink", "Roots drink water"), (1, 2, 2, "not there", "Roots drink water")], "item int, ord int, marks int, evidence string, source string")
    assert bank.rubric(c).first()["total"] == 1
    b = bank.merge_blocks(spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (1, "b", 1.0), (2, "a", 0.0), (2, "b", None)], "concept int, level string, share double"))
    assert {(r["concept"], r["level"]): r["share"] for r in b.collect()} == {(1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 0.5, (2, "b"): 0.5}
    assert one(spark, bank.plan_quality(F.col("s")), s="") == "empty" and one(spark, bank.plan_quality(F.col("s")), s="too short") == "thin"


def test_ids_sources_and_plans(spark):
    rows = spark.createDataFrame([("Maths ", "IX"), ("Art", "X")], "subject string, standard string")
    dims = {"subject": spark.createDataFrame([(3, "maths"), (2, "MATHS")], "id int, name string"), "standard": spark.createDataFrame([(9, "ix"), (10, "x")], "id int, name string")}
    got = {r["standard"]: (r["subject_id"], r["standard_id"], r["unresolved"]) for r in bank.resolve_ids(rows, dims).collect()}
    assert got == {"IX": (2, 9, []), "X": (None, 10, ["subject"])}
    content = spark.createDataFrame([("m", 1), ("m", 1), ("m", 2), ("a", 7), ("a", 5)], "subject string, institute int")
    wanted = spark.createDataFrame([("m", 2), ("a", 9)], "subject string, institute int")
    assert {tuple(r) for r in bank.content_source(content, wanted).collect()} == {("m", 2), ("a", 5)}
    day = dt.date(2024, 1, 1)
    slots = spark.createDataFrame([("m", day + dt.timedelta(i), 1) for i in range(5)], "subject string, day date, n int")
    plan = bank.macro_plan(spark.createDataFrame([("m", 1, 1, 2), ("m", 2, 2, 3), ("m", 3, 3, 2)], "subject string, chapter int, ord int, periods int"), slots).orderBy("chapter").collect()
    assert [(r["first_day"] and r["first_day"].day, r["last_day"] and r["last_day"].day) for r in plan] == [(1, 2), (3, 5), (None, None)]
    cal = bank.master_calendar(slots.withColumnRenamed("n", "period"), spark.createDataFrame([("m", day, 1, "old", 1), ("m", day, 1, "new", 2)], "subject string, day date, period int, title string, saved int"))
    assert {r["day"].day: r["title"] for r in cal.collect()} == {1: "new", 2: None, 3: None, 4: None, 5: None}
    assert [r["batch"] for r in bank.batches(spark.createDataFrame([(1, i) for i in range(10)], "s int, o int"), "s", "o", 4).orderBy("o").collect()] == [1] * 4 + [2] * 4 + [3] * 2


def test_curricula_and_order(spark):
    md = "## CG-1 Explores matter\n- C-1.1: Describes states\n  - Lists three states\n  - Names a gas\n- C-1.2 Uses models"
    rows = bank.parse_curricula(spark.createDataFrame([(1, md), (2, None)], "id long, md string")).collect()
    assert [(r["type"], r["code"], r["parent"]) for r in rows] == [("goal", "CG-1", None), ("competency", "C-1.1", "CG-1"), ("outcome", "C-1.1-LO1", "C-1.1"), ("outcome", "C-1.1-LO2", "C-1.1"), ("competency", "C-1.2", "CG-1")]
    p = spark.createDataFrame([(1, 1, "continues here", "the end"), (1, 2, "The start", "and it")], "grp long, ord long, head string, tail string")
    assert [r["ord"] for r in bank.best_order(p).orderBy("pos").collect()] == [2, 1]


def flow(pieces, order):
    return sum(bank._flow(pieces[a][1], pieces[b][0]) for a, b in itertools.pairwise(order))


def test_best_order_is_the_best_of_all(spark):
    r = random.Random(4)
    for n in (1, 2, 3, 5, 7):
        pieces = [(r.choice(("Big", "small", "")), r.choice(("ends.", "goes on", ""))) for _ in range(n)]
        w = [[bank._flow(a[1], b[0]) for b in pieces] for a in pieces]
        best = max(flow(pieces, o) for o in itertools.permutations(range(n)))
        assert flow(pieces, bank._best_path(w)) == best and sorted(bank._matched_path(w)) == list(range(n))
        assert flow(pieces, bank._matched_path(w)) >= best - max(1, n // 2)
    # a group of twelve is put in order, and so is one of forty
    for n in (12, 40):
        rows = [(1, i, "Start" if i == n - 1 else f"part {i}", "goes on" if i else "the end.") for i in range(n)]
        got = bank.best_order(spark.createDataFrame(rows, "grp long, ord long, head string, tail string")).orderBy("pos").collect()
        order = [x["ord"] for x in got]
        assert sorted(order) == list(range(n)) and order != list(range(n)) and flow([x[2:] for x in rows], order) >= n - 2


def test_best_order_is_exact_in_groups_of_any_size(spark):
    kinds = [("Big", "ends."), ("small", "goes on")] * 12 + [("Big", "goes on")]
    rows = [(1, i, *k) for i, k in enumerate(kinds)] + [(2, 1, "Big", "so\u2003"), (2, None, "x", "y"), (2, 0, "\u00a0small", "z: "), (None, 5, None, ""), (None, 4, "a", None)]
    got = bank.best_order(spark.createDataFrame(rows, "grp long, ord long, head string, tail string")).collect()
    order = {g: [r["ord"] for r in sorted(got, key=lambda r: r["pos"]) if r["grp"] == g] for g in (1, 2, None)}
    assert flow(kinds, order[1]) == 24  # all in one run: whole sentences, the piece that leads on, what goes on
    assert order == {1: [*range(0, 24, 2), 24, *range(1, 24, 2)], 2: [0, 1, None], None: [4, 5]}


def test_best_trail_is_the_first_best_path():
    r = random.Random(8)
    for _ in range(400):
        heads, tails = r.sample(["Big", "small", "", "5"], r.randint(1, 4)), r.sample(["ends.", "goes on", "", "x:"], r.randint(1, 4))
        pieces = [(r.choice(heads), r.choice(tails)) for _ in range(r.randint(1, 7))]
        w = [[bank._flow(a[1], b[0]) for b in pieces] for a in pieces]
        assert bank._best_trail([bank._ends(*p) for p in pieces]) == bank._best_path(w), pieces


def test_offline_tags(spark):
    items = spark.createDataFrame([(1, 1, "Compare plant cells and animal cells", "long", 5), (1, 2, "Define a galaxy", "short", 3), (2, 3, "Define plant cells", "short", 3)], "grp int, id int, stem string, form string, marks int")
    concepts = spark.createDataFrame([(1, 7, "plant cells", "walls of cells"), (1, 8, "animal cells", ""), (1, 9, "stars", "a galaxy holds many suns and much dust")], "grp int, id int, name string, description string")
    got = {r["id"]: tuple(r)[1:] for r in bank.tag_offline(items, concepts).collect()}
    assert got[1] == (7, 0.45, "analyze", 3, 4)
    assert got[2][0] is None and 0 < got[2][1] < 0.25 and got[2][2:] == ("recall", 1, 2)
    assert got[3] == (None, 0.0, "recall", 1, 2)
