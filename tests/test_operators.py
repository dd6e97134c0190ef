"""Operators on small inputs: upserts, logs, allocation, parsing, sources and streams."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators import parsing, planning, relational, rules
from quillspark.sources import files
from quillspark.streaming import ledger

PAPER = """# Sample paper
## Section A
1. Which gas do plants take in? (a) oxygen (b) carbon dioxide (c) helium (d) neon
2. Pick the metal. (A) wood (B) iron (C) glass (D) paper Answer: (b)
3. Assertion (A): Ice floats on water. Reason (R): Ice is less dense.
7. Not the next number.
## Section B
4. Explain evaporation. Solution: Molecules at the surface leave.
5. Name two fuels.
ANSWERS
1. (b) 2. (b) 3. a
"""


def test_questions_from_a_paper():
    q = parsing.questions(PAPER)
    assert [(x["section"], x["number"]) for x in q] == [("A", 1), ("A", 2), ("A", 3), ("B", 4), ("B", 5)]
    assert q[0]["options"] == ["oxygen", "carbon dioxide", "helium", "neon"] and q[0]["key"] == "b"
    assert q[1]["key"] == "b" and q[1]["stem"] == "Pick the metal."
    assert q[2]["assertion"].startswith("Ice floats") and q[2]["reason"].startswith("Ice is") and q[2]["key"] == "a"
    assert q[3]["solution"].startswith("Molecules") and q[3]["marks"] == 2
    assert len({x["sha256"] for x in q}) == 5
    assert parsing.questions("") == parsing.questions(None) == []


def full_paper():
    """A paper of 38 items and 80 marks, with an answer block that repeats every number."""
    label = lambda i: f"(a) {i}p (b) {i}q (c) {i}r (d) {i}s"
    part = lambda head, rows: [head, "", *rows, ""]
    lines = ["# CHAPTER 9", ""]
    lines += part("Section A: Multiple Choice Questions", [f"{i}. Pick the value {i} of the list.\n{label(i)}" for i in range(1, 17)])
    lines += part("Assertion-Reasoning Questions :", ["(a) Both hold, and R explains A.", "(b) Both hold.", *[f"{i}. Assertion (A): Fact {i} holds.\nReason (R): Cause {i} is known." for i in range(17, 21)]])
    lines += part("Section B: Very Short Answer Type Questions (2 marks each)", [f"{i}. Name rule {i}." for i in range(21, 26)])
    lines += part("Section C: Short Answer Type Questions (3 marks each)", [f"{i}. Explain case {i}. Solution: It takes 4. 5 is too many, see (b)." for i in range(26, 32)])
    lines += part("Section D: Long Answer Type Questions (5 marks each)", [f"{i}. Draw the graph of line {i}." for i in range(32, 36)])
    lines += part("Section E: Case-Based Questions (4 marks each)", [f"{i}. A shop sells {i} pens.\n(i) How many? (1 mark)\n(ii) When? (1 mark)\n(iii) Why so? (2 marks)" for i in range(36, 39)])
    return "\n".join([*lines, "ANSWERS", "", *[f"{n}. (b)" for n in range(1, 39)]])


@pytest.mark.parametrize("joined", [False, True])
def test_a_full_paper_tidy_and_joined_into_one_line(joined):
    md = " ".join(full_paper().split()) if joined else full_paper()
    q = parsing.questions(md)
    n = lambda key: {k: sum(x[key] == k for x in q) for k in {x[key] for x in q}}
    assert len(q) == 38 and sum(x["marks"] for x in q) == 80 and n("section") == parsing.BLUEPRINT
    assert n("form") == {"mcq": 16, "assertion_reason": 4, "very_short": 5, "short": 6, "long": 4, "case_study": 3}
    assert all(len(x["options"]) == 4 and x["key"] == "b" for x in q if x["form"] == "mcq")
    assert all(x["sub_parts"] == ["i", "ii", "iii"] for x in q if x["form"] == "case_study")
    assert all(x["solution"] and "Solution" not in x["stem"] for x in q if x["form"] == "short") and len({x["sha256"] for x in q}) == 38


def test_a_paper_without_sections():
    """Headings of forms, pages, alternatives and figures, all in one stream: nineteen items."""
    label = "(a) p (b) q (c) r (d) s"
    parts = ["<!-- page 3 --> MULTIPLE CHOICE QUESTIONS", *[f"{i}. Which is it, {i}? {label} Solution: see (b). Answer: ( c)" for i in range(1, 9)]]
    parts += ["Assertion and reason questions", *[f"{i}. Assertion: Fact {i}. Reason: Cause {i}. Answer: (a)" for i in (9, 10)]]
    parts += ["<!-- page 4 --> VERY SHORT TYPE QUESTIONS", *[f"{i}. Name rule {i} of all." for i in (11, 12, 13)], "Short Answer Type Questions (4 marks each)", "14. Look at the figure given below and tell. OR Draw a diagram of a cell.", "15. Say more."]
    parts += ["LONG ANSWER QUESTIONS", "16. Discuss.", "17. Prove it.", "CASE STUDY QUESTIONS", *[f"{i}. They went by rail. (i) Why? (ii) When? (iii) How?" for i in (18, 19)]]
    q = parsing.questions(" ".join(parts))
    assert [x["number"] for x in q] == [*range(1, 15), 14, *range(15, 20)] and [x["alternative"] for x in q if x["number"] == 14] == [0, 1]
    assert [x["form"] for x in q] == ["mcq"] * 8 + ["assertion_reason"] * 2 + ["very_short"] * 3 + ["short"] * 3 + ["long"] * 2 + ["case_study"] * 2
    assert all(x["key"] == "c" for x in q[:8]) and q[8]["key"] == "a" and {x["page"] for x in q[:10]} == {3} and {x["page"] for x in q[10:]} == {4}
    assert [x["needs_figure"] for x in q if x["number"] == 14] == [True, False] and [x["marks"] for x in q[13:16]] == [4, 4, 4] and q[-1]["marks"] == 4


def test_another_grammar():
    """A publisher's own words for parts, answers and alternatives."""
    g = parsing.Grammar(sections=("khand",), answers=("uttar mala",), answer=("uttar",), solution=("hal",), alternative=("athva",), page=r"\[p(\d+)\]")
    q = parsing.questions("[p7] KHAND - A 1. Pick. (a) w (b) x (c) y (d) z Uttar: (d) 2. Pick. (a) w (b) x (c) y (d) z KHAND - C 3. Say. Hal: so. athva Tell. UTTAR MALA 1. a 2. (c)", g)
    assert [(x["section"], x["number"], x["alternative"], x["key"], x["page"]) for x in q] == [("A", 1, 0, "d", 7), ("A", 2, 0, "c", 7), ("C", 3, 0, None, 7), ("C", 3, 1, None, 7)]
    assert q[2]["solution"] == "so."


def test_questions_over_documents(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, ""), (3, None)], "id long, md string")
    items = parsing.extract_questions(docs)
    fp = {(r["id"], r["section"]): (r["n"], r["marks"], r["choice"], r["assertion_reason"], r["figures"], r["forms"], r["expected"]) for r in parsing.section_fingerprint(items).collect()}
    assert fp == {(1, "A"): (3, 3, 2, 1, 0, ["mcq", "assertion_reason"], 20), (1, "B"): (2, 4, 0, 0, 0, ["very_short"], 5)}


def test_sections_carry_their_kind(spark):
    md = "intro\n# Light\na\n# Revision exercises\nb\nc"
    s = parsing.split_sections(spark.createDataFrame([(1, md)], "id long, md string")).orderBy("ord").collect()
    assert [(r["title"], r["kind"], r["text"]) for r in s] == [(None, "teaching", "intro"), ("Light", "teaching", "a"), ("Revision exercises", "revision", "b\nc")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta rays", "gamma", "delta wing"]), max_size=5), st.text("ab\n# ", max_size=60))
def test_topic_spans_tile_the_text(names, tail):
    md = "# Alpha\nx\n# Gamma\n" + tail
    spans = parsing.partition_by_topics(md, names)
    assert len(spans) == len(names)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(md)
        assert all(a[1] == b[0] and a[0] <= a[1] for a, b in zip(spans, spans[1:]))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 60), st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_bounded_split(target, sizes):
    q = scoring.distribute(target, sizes)
    assert all(2 <= x <= 5 for x in q)
    assert sum(q) == max(2 * len(sizes), min(5 * len(sizes), target))


def test_upsert_is_idempotent_and_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    once = relational.upsert(old, new, "k")
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in relational.upsert(once, new, "k").collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in relational.upsert(old, new, "k", False).collect()} == {(1, "a"), (2, None), (3, "c")}


def test_log_and_revert_restore_null(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "k long, shown boolean")
    changed, log = relational.change_log(df, "k", "shown", F.lit(False), F.col("k") < 3)
    assert {tuple(r) for r in changed.collect()} == {(1, False), (2, False), (3, False)}
    assert {tuple(r) for r in relational.revert(changed, log, "k", "shown").collect()} == {(1, None), (2, True), (3, False)}


def test_guard(spark):
    v, legal = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,)], "k long")
    assert [r["k"] for r in relational.guard(v, legal, "k").collect()] == [1]
    with pytest.raises(ValueError):
        relational.guard(v, legal, "k", strict=True)


def test_contains_join_finds_parts_of_words(spark):
    d = spark.createDataFrame([(1, "the quick brown foxes jumped over it"), (2, "nothing here"), (3, "quick brown fox")], "doc long, t string")
    q = spark.createDataFrame([(10, "quick brown fox"), (11, "here"), (12, "rown foxes jum"), (13, "")], "quote long, q string")
    assert {tuple(r) for r in relational.contains_join(d, q).collect()} == {(10, 1), (10, 3), (11, 2), (12, 1)}


def test_similar_sets_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(3)
    sets = {i: sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 6))}) for i in range(40)}
    got = {(x["a"], x["b"]) for x in relational.similar_sets(spark.createDataFrame(list(sets.items()), "id long, s array<string>"), "id", "s", 0.8).collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / min(len(sets[a]), len(sets[b])) >= 0.8}
    assert got == want


def shuffled(spark, df):
    """Rows that an action writes to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList()
    stages = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages()
    rows = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, stages() - before


def test_similar_sets_shuffle_no_pairs_that_cannot_be(spark):
    import random

    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    sets = [(i, r.sample(vocabulary, 6)) for i in range(600)]
    rows, n = shuffled(spark, lambda: relational.similar_sets(spark.createDataFrame(sets, "id long, s array<string>"), "id", "s", 0.8))
    words = {i: set(s) for i, s in sets}
    assert {(x["a"], x["b"]) for x in rows} == {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 5}
    assert n < 40_000  # 3,600 elements a few times; of the 180,000 pairs nearly half share a word


def test_equal_sets_meet_others_once(spark):
    sets = [(i, ["a", "b", "c", "d", f"e{i // 100}"]) for i in range(200)] + [(200, ["a", "b", "c", "x", "y"])]
    rows, n = shuffled(spark, lambda: relational.similar_sets(spark.createDataFrame(sets, "id long, s array<string>"), "id", "s", 0.8).groupBy("shared", "score").count())
    assert {tuple(r) for r in rows} == {(5, 1.0, 2 * 4950), (4, 0.8, 10000)} and n < 9_000
    assert {(r["a"], r["b"]) for r in relational.similar_elements(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (4, "b"), (4, "a")], "id int, x string"), 0.5, over=True).collect()} == {(1, 3), (2, 3), (1, 4), (3, 4)}


def test_rules(spark):
    df = spark.createDataFrame([(1, "Pick one thing from here", ["a", "b", "c"], "A"), (2, "", None, None), (3, "Pick", ["a", "b", "c", "d"], "e")], "id long, stem string, o array<string>, k string")
    c = rules.check(df, rules.item_rules(F.col("stem"), F.lit("mcq"), F.col("o"), F.col("k")))
    got = {r["id"]: {i["code"] for i in r["issues"]} for r in c.collect()}
    assert got == {1: {"V-09"}, 2: {"V-04", "V-06", "V-09"}, 3: {"V-02"}}
    assert {r["id"]: (r["errors"], r["warnings"]) for r in rules.tally(c, "id").collect()}[2] == (3, 0)
    again = rules.seen_before(spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, h string"), ["h"], ["id"])
    assert {r["id"]: r["again"] for r in again.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_calendar_and_weeks(spark):
    terms = spark.createDataFrame([(1, dt.date(2024, 1, 3), dt.date(2024, 1, 10)), (2, dt.date(2024, 2, 2), dt.date(2024, 2, 1))], "term_id long, start_date date, end_date date")
    days = planning.calendar(terms)
    assert days.count() == 8
    events = spark.createDataFrame([(dt.date(2024, 1, 6), "Holiday"), (dt.date(2024, 1, 8), "Harvest")], "day date, title string")
    off = planning.holidays(events)
    assert [r["day"] for r in off.collect()] == [dt.date(2024, 1, 8)]
    week = days.select("day", planning.week_number(F.col("day"), F.lit("2024-01-03").cast("date")).alias("w")).collect()
    assert {r["day"].day: r["w"] for r in week} == {3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2, 9: 2, 10: 2}


def test_pack_runs_over_and_reviews(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 200)], "grp long, ord long, minutes long")
    rows = planning.pack(df).orderBy("period", "ord").collect()
    assert sum(r["minutes"] for r in rows if r["kind"] == "teach") == 250
    assert [r["period"] for r in rows if r["kind"] == "review"] == [6]


def test_rebalance_equals_moving_one_by_one(spark):
    import random

    r = random.Random(8)
    rows = [(g, f"c{k}", r.randint(0, 12)) for g in range(40) for k in range(r.randint(1, 6))] + [(99, "a", 10**8), (99, "b", 0), (99, "c", 3)]

    def by_hand(have, floor):
        w = list(have)
        while min(w) < floor and max(w) > floor:
            w[w.index(max(w))] -= 1
            w[w.index(min(w))] += 1
        return w

    got = {(x["grp"], x["cat"]): x["want"] for x in planning.rebalance(spark.createDataFrame(rows, "grp long, cat string, have long"), 5).collect()}
    for g in {x[0] for x in rows} - {99}:
        own = sorted(x[1:] for x in rows if x[0] == g)
        assert [got[g, c] for c, _ in own] == by_hand([n for _, n in own], 5), own
    assert (got[99, "a"], got[99, "b"], got[99, "c"]) == (10**8 - 7, 5, 5)


def test_budgets_follow_their_bounds(spark):
    c = spark.createDataFrame([(1, 0, 0, None), (2, 4, 0, 20)], "chapter int, outcomes int, competencies int, periods int")
    t = spark.createDataFrame([(1, k, 100 + k) for k in range(20)] + [(2, k, 5000 - 900 * k) for k in range(6)], "chapter int, ord int, size int")
    b = {r["chapter"]: r for r in planning.chapter_budget(c, t).collect()}
    assert (b[1]["target"], b[1]["warnings"], sum(b[1]["quota"])) == (40, ["split_below_topics"], 40)
    assert b[2]["source"] == "learning_outcomes" and "anchors_diverge" in b[2]["warnings"] and sum(b[2]["quota"]) == b[2]["target"] and b[2]["quota"][0] >= b[2]["quota"][-1]
    q = spark.createDataFrame([(1, k, s, 2) for k, s in enumerate((3.0, 0.5, 2.5, 0.1, 0.2))], "topic int, ord int, score double, quota int")
    kept = {r["ord"]: r["reason"] for r in planning.enforce_quota(q).collect()}
    assert kept == {0: None, 2: None, 1: "not supported by the text", 4: "over the allowance", 3: "over the allowance"}


def test_names_are_aligned_by_words_and_then_by_place(spark):
    n = spark.createDataFrame([(1, 1, "Light rays"), (1, 2, "Sound"), (2, 1, "One"), (2, 2, "Two")], "grp long, l long, name string")
    r = spark.createDataFrame([(1, 5, "Noise"), (1, 6, "Rays of light"), (2, 7, "Three")], "grp long, r long, name string")
    assert {tuple(x) for x in planning.align_names(n, r).collect()} == {(1, 1, 6, "words"), (1, 2, 5, "order")}


def test_retire_keeps_the_least_id_and_all_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id long, k string, v string")
    new = spark.createDataFrame([("a", "new"), ("c", "fresh")], "k string, v string")
    assert {tuple(r) for r in relational.retire(old, new, "k", "id").collect()} == {(1, "a", "new", True, False), (2, "a", "y", False, False), (3, "b", "z", False, False), (None, "c", "fresh", True, True)}


def test_greedy_and_matching(spark):
    g = planning.greedy(spark.createDataFrame([(1, i, float(n), 2, 10.0) for i, n in enumerate([5, 1, 1, 1])], "grp long, item long, need double, bins int, room double"))
    assert [r["bin"] for r in g.orderBy("item").collect()] == [0, 1, 1, 1]
    m = planning.match_names(spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.95), (1, 2, 2, 0.9), (1, 2, 1, 0.7), (1, 3, 3, 0.5)], "grp long, l long, r long, score double"))
    assert {(r["l"], r["r"]) for r in m.collect()} == {(1, 2), (2, 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Board , Sub-Institute Id\nX,12.0\n,\nY,7\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "q.csv")).collect()] == [("X", "12"), ("Y", "7")]
    (tmp_path / "l.jsonl").write_text('{"key":"a","status":"running","at":"1"}\n{"key":"a","status":"done","at":"2"}\n{"key":"b","sta')
    rows = files.read_ledger(spark, str(tmp_path / "l.jsonl"))
    assert [tuple(r) for r in relational.latest(rows, "key", ["at"], ["status"]).collect()] == [("a", "done")]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 x")
    f = files.read_files(spark, str(tmp_path), "*.pdf")
    assert f.first()["is_pdf"] and files.not_cached(f, f.select("sha256")).count() == 0
    files.write_table(rows, str(tmp_path / "t"), ["status"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    files.write_table(spark.read.parquet(str(tmp_path / "t")).filter("status = 'done'"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and not list(tmp_path.glob("t.*"))
    bad = rows.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        files.write_table(bad, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1  # a lost job leaves the old table
    found = spark.createDataFrame([("d/a.md", 1), ("d/a.PDF", 2), ("d/b.txt", 3), ("d/c.exe", 4)], "path string, length int")
    assert {r["path"] for r in files.prefer(found, ("pdf", "md", "txt")).collect()} == {"d/a.PDF", "d/b.txt"}
    files.dump_csv(rows.select("key", "status"), str(tmp_path / "d"), 1)
    assert spark.read.csv(str(tmp_path / "d"), header=True).count() == 2


def test_stuck_stream_equals_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    schema = "key string, status string, at timestamp"
    for i, rows in enumerate([[("a", "running", t(0)), ("b", "running", t(1))], [("b", "done", t(5)), ("c", "done", t(200))], [("d", "done", t(400))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {tuple(r) for r in ledger.drain(ledger.stuck(s, 60), "append", "stuck_test").collect()}
    assert {("b", "done"), ("c", "done"), ("d", "done"), ("a", "failed")} == got


def test_keyed_streams_go_on_from_their_state_and_forget(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    schema = "key string, status string, at timestamp"
    first = [[("a", "new", t(0)), ("b", "running", t(1))], [("a", "more", t(10)), ("c", "running", t(15))]]
    second = [[("a", "again", t(30)), ("c", "done", t(31))], [("z", "new", t(900))], [("a", "late", t(950)), ("y", "running", t(951))]]
    for op, schema_of in ((lambda s: ledger.live(s, 2), "live"), (lambda s: ledger.stuck(s, 60), "stuck")):
        home = tmp_path / schema_of

        def run(at, parts, op=op, home=home):
            for i, rows in enumerate(parts):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(home / f"{at}/in/{len(list((home / at / 'in').glob('*')))}{i}"))
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(home / at / "in/*"))
            return sorted(tuple(r) for r in ledger.drain_to(op(s), str(home / at / "out"), str(home / at / "state")).collect())

        whole = run("whole", first + second)
        run("cut", first)
        assert run("cut", second) == whole  # the second run goes on where the first ended
        assert run("cut", []) == whole  # and nothing comes twice
        open_keys = {r["key"]["key"] for r in spark.read.format("statestore").option("stateVarName", "value").load(str(home / "cut/state")).select("key").collect()}
        assert open_keys == ({"z", "a", "y"} if schema_of == "live" else {"y"})  # what ended or was forgotten holds no state
    told = {tuple(r) for r in spark.read.parquet(str(tmp_path / "live/whole/out")).collect()}
    assert {("a", "again", 3), ("a", "late", 1)} <= told  # forgotten in between


def named_in_order(names):
    """The reference rule, one name after the other: (stays) for token sets in order."""
    kept = []
    for k, s in names:
        if s and not any(duplicate(s, x) for _, x in kept):
            kept.append((k, s))
    return [k for k, _ in kept]


def duplicate(a, b):
    from quillspark.functions import text as T

    if not a or not b or (a ^ b) & set(T.DISCRIMINATORS):
        return False
    short = min(len(a), len(b))
    return a == b if short < 2 else len(a & b) / short >= 0.8


def test_first_names_are_those_of_a_walk_in_order(spark):
    import random

    chain = ["Water cycle rain", "Water cycle rain cloud river lake", "Cloud river lake"]
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate([*chain, "--", "", None, "of the", "Water cycle rain"])], "grp int, ord int, name string")
    assert [r["ord"] for r in relational.first_names(d).orderBy("ord").collect()] == [0, 2, 6]
    r = random.Random(3)
    words = [f"wq{c}" for c in "abcdefghij"] + ["adding", "even"]
    rows = []
    for g in range(6):
        rows += [(g, i, " ".join(r.sample(words[: 5 + g], r.randint(1, 5)))) for i in range(60)]
        rows += [(g, 60 + i, " ".join(f"ch{j}x" for j in range(3 * i, 3 * i + 6))) for i in range(30)]  # a chain: each shares half with the next
        rows += [(g, 90 + i, "hub aa bb" + "".join(f" leaf{i}y{k}" for k in range(i % 4))) for i in range(20)]  # a star
    got = {(x["grp"], x["ord"]) for x in relational.first_names(spark.createDataFrame(rows, "grp int, ord int, name string")).collect()}
    assert got == {(g, k) for g in range(6) for k in named_in_order([(i, set(n.split())) for gg, i, n in rows if gg == g])}


def test_first_names_leave_no_part_empty(spark):
    rows = [(1, 0, "t1", "Plant cell wall"), (1, 1, "t1", "Plant root hair"), (1, 2, "t2", "Plant cell wall"), (1, 3, "t2", "plant cell walls"), (1, 4, "t3", "--")]
    d = spark.createDataFrame(rows, "grp int, ord int, topic string, name string")
    assert [r["ord"] for r in relational.first_names(d, "topic").orderBy("ord").collect()] == [0, 1, 2, 4]


def test_first_independent_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(7)]
    star = [(100, i) for i in range(101, 120)] + [(i, i + 1) for i in range(101, 119)]
    back = [(200 + i, 210) for i in range(10)]
    got = {r["id"] for r in relational.first_independent(spark.createDataFrame(chain + star + back, "a long, b long")).collect()}
    assert got == {1, 3, 5, 7} | set(range(101, 120)) | {210}
    assert relational.first_independent(spark.createDataFrame([], "a long, b long")).collect() == []


def test_set_fingerprints_guard_a_plan(spark):
    rows = [(i, i % 3 if i % 5 else None, f"v{i}" if i % 4 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, grp int, v string")
    mark = lambda x: {(r["grp"], r["mark"]) for r in relational.set_fingerprint(x, ["grp"], ["id", "v"]).collect()}
    assert mark(d) == mark(d.repartition(7)) == mark(d.orderBy(F.desc("id")).coalesce(1)) and len(mark(d)) == 4
    for change in (F.when(F.col("id") == 7, "w").otherwise(F.col("v")), F.when(F.col("id") == 8, "-").otherwise(F.col("v")), F.when(F.col("id") == 7, None).otherwise(F.col("v"))):
        assert len(mark(d.withColumn("v", change)) - mark(d)) == 1
    assert len(mark(d.unionByName(d.filter("id = 1"))) - mark(d)) == 1  # a row twice is another set
    premise = relational.set_fingerprint(d, ["grp"], ["id", "v"]).filter("grp IS NULL OR grp <> 2")
    plan = spark.createDataFrame([(i, "new") for i in range(0, 200, 2)], "id int, value string")
    now = d.withColumn("v", F.when(F.col("id") == 1, "meanwhile").otherwise(F.col("v")))
    out, log, refused = relational.apply_plan(now, plan, premise, "id", "v", ["grp"], ["id", "v"])
    assert {r["grp"] for r in refused.collect()} == {1, 2}  # one has changed, one was never looked at
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got == {i: ("meanwhile" if i == 1 else "new" if i % 2 == 0 and g in (None, 0) else v) for i, g, v in rows}
    assert {(r["id"], r["v"]) for r in relational.revert(out, log, "id", "v").collect()} == {(r["id"], r["v"]) for r in now.collect()}
    twice = plan.unionByName(spark.createDataFrame([(0, "other")], "id int, value string"))
    with pytest.raises(Exception, match="several values"):
        relational.apply_plan(d, twice, premise, "id", "v", ["grp"], ["id", "v"])[0].collect()
