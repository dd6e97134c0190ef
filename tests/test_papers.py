"""Answer-anchored papers, generated-item gates, curricula in tables, outlines, on small inputs of our own."""

from quillspark.operators import bank, gates, parsing


def test_answer_anchored_papers(spark):
    md = """Foreword that is no item
<!-- page 4 -->
The book of tests 4
V ERY SHORT ANSWER
1. What is light?
Ans: A wave.
It also acts as
particles.
<!-- page 5 -->
The book of tests 5
2) Consider the statements:
1. It bends.
2. It stops.
Which holds?
Answer : The first.
OOBJECTIVE QUESTION
1.\tAssertion (A) : Ice floats.
Reason (R) : It is light.
(A) both hold
(B) one
holds
AAns : (b) since it is less dense
<!-- page 6 -->
The book of tests 6
1. Define mass.
(a) part one
(b) part two
Ans : as told
Ans : an answer without a number
case based question
9. Read the text.
never answered
"""
    got = parsing.answered_items(spark.createDataFrame([(1, md), (2, ""), (3, None), (4, "Ans: alone")], "id int, md string")).orderBy("id", "item").collect()
    assert [(r["id"], r["item"], r["number"], r["page"], r["form"]) for r in got] == [
        (1, 1, 1, 4, "very_short"), (1, 2, 2, 5, "very_short"), (1, 3, 1, 5, "assertion_reason"), (1, 4, 1, 6, "very_short"), (1, 5, 3, 6, "very_short"), (4, 1, 1, None, None),
    ]
    assert got[0]["stem"] == "What is light?" and got[0]["answer"] == "A wave. It also acts as particles."
    assert got[1]["stem"] == "Consider the statements: 1. It bends. 2. It stops. Which holds?"
    assert [tuple(o) for o in got[2]["options"]] == [("A", "both hold"), ("B", "one holds")] and (got[2]["key"], got[2]["answer"]) == ("B", "since it is less dense")
    assert got[3]["options"] == [] and got[3]["stem"].endswith("(b) part two") and got[4]["stem"] == "" and got[4]["answer"] == "an answer without a number"


def test_running_lines_go_by_place_and_pages(spark):
    lines = [(1, 10 * p + i, s, p) for p in range(5) for i, s in enumerate([f"Chapter head {p}", "own text", "once more" if p < 2 else f"text {p}x", f"leaf {p} of 9"])]
    lines += [(1, 100, "Chapter head 3", 7), (1, 101, "x", 7), (1, 102, "y", 7), (1, 103, "Chapter head 4", 7), (1, 104, "z", 7), (1, 105, "w", 7)]
    lines += [(2, i, "same", 1) for i in range(4)]
    got = [(r["id"], r["line"], r["s"]) for r in parsing.running_lines(spark.createDataFrame(lines, "id int, line int, s string, page int"), 1).orderBy("id", "line").collect()]
    assert [x for x in got if x[0] == 2] == [(2, i, "same") for i in range(4)]
    assert not any(s.startswith("leaf") for *_, s in got) and [s for i, _, s in got if s.startswith("Chapter")] == ["Chapter head 4"]  # the one in a page's midst
    assert sum(s == "own text" for *_, s in got) == 5 and sum(s == "once more" for *_, s in got) == 2


def test_stated_arithmetic_is_exact():
    from fractions import Fraction

    worked = {
        "What is 3/4 + 2 × (5 - 1)?": (Fraction(35, 4), ()), "Work out 2^3^2.": (512, ()), "Find 41 squared": (1681, ()), "Add 12 cm + 3 m": (Fraction(78, 25), (("m", 1),)),
        "the sum of 4, 5 and 6": (15, ()), "the square root of 169 m2": (13, (("m", 1),)), "20% of 50 kg": (10000, (("g", 1),)), "difference between 10 and 3": (7, ()),
        "6 m / 2 s": (3, (("m", 1), ("s", -1))), "1 1/2 + 2": (Fraction(7, 2), ()), "the average of 1, 2 and 6": (3, ()), "(2 + 3) * 4 and 1 + 1": (20, ()), "0.1 + 0.2": (Fraction(3, 10), ()),
    }
    for stem, want in worked.items():
        assert gates.recompute(stem) == want, stem
    for stem in (None, "", "no sums", "It is 7.", "5 m + 3 kg", "1/0", "the square root of 2", "2^9999", "9" * 50 + " + 1"):
        assert gates.recompute(stem) is None, stem
    q = gates.recompute("What is 3/4 + 2 × (5 - 1)?")
    assert all(gates.states(a, q) for a in ("35/4", "8 3/4", "it is 8.75", "875%")) and not any(gates.states(a, q) for a in ("8.7", "", None, "35", "8.75 m"))
    m = gates.recompute("12 cm + 3 m")
    assert all(gates.states(a, m) for a in ("312 cm", "3.12 m", "3.12")) and not any(gates.states(a, m) for a in ("312", "3.12 kg", "31.2 m"))


def test_every_gate_fires_alone(spark):
    good = dict(id=0, chapter=1, grounded_on=10, concept=5, note=None, stem="What is 2 + 3 now", answer="5", explanation="so", bloom="apply", form="mcq", options=["5", "6", "7", "8"], mark_scheme=None, misconception=False, misconception_text=None)
    faults = [
        ({}, []), ({"grounded_on": 99}, ["G1"]), ({"grounded_on": None}, ["G1"]), ({"grounded_on": 20}, ["G1"]), ({"concept": 6, "stem": "Why 2 + 3"}, ["G2"]), ({"concept": 6, "note": "filed there", "stem": "Why 2 + 3"}, []), ({"grounded_on": 11, "concept": 7, "stem": "And 2 + 3"}, ["G3"]),
        ({"explanation": " "}, ["G4"]), ({"bloom": None}, ["G4"]), ({"options": ["5", "6", "7"]}, ["G5"]), ({"options": ["5", "6", "7", " 7"]}, ["G5"]), ({"options": None}, ["G5"]), ({"options": ["1", "2", "3", "4"]}, ["G5"]),
        ({"stem": "Then 2 + 3 is how much of it"}, ["G6"]), ({"form": "short"}, ["G7"]), ({"form": "short", "mark_scheme": "one"}, []), ({"misconception": True}, ["G8"]), ({"misconception": True, "misconception_text": "adds up"}, []),
        ({"answer": "6"}, ["G9"]), ({"stem": "Tell me"}, ["G9"]), ({"stem": None}, ["G4", "G9"]),
    ]
    rows = [good | f | {"id": i} for i, (f, _) in enumerate(faults)]
    schema = "id int, chapter int, grounded_on int, concept int, note string, stem string, answer string, explanation string, bloom string, form string, options array<string>, mark_scheme string, misconception boolean, misconception_text string"
    items = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    sourced = spark.createDataFrame([(10, 1, 5, "Then 2 and 3 is so how much of all it was"), (11, 1, 7, "words of their own"), (20, 2, 5, "in another chapter")], "id int, chapter int, concept int, stem string")
    got = {r["id"]: r for r in gates.generated_items(items, sourced, spark.createDataFrame([(1, 5), (1, 6)], "chapter int, concept int")).collect()}
    for i, (_, want) in enumerate(faults):
        assert [x["code"] for x in got[i]["issues"]] == want, (faults[i], got[i])
        assert got[i]["passed"] == (not want)


def test_covered_equals_all_pairs(spark):
    import random

    r = random.Random(5)
    asked = [(i, i % 2, r.sample("abcdefghij", r.randint(1, 8))) for i in range(60)] + [(99, 0, [])]
    held = [(i, i % 2, r.sample("abcdefghij", r.randint(1, 9))) for i in range(60)]
    for over in (0.5, 0.8):
        got = {(x["q"], x["e"]) for x in gates.covered(spark.createDataFrame(asked, "q int, g int, s array<string>"), spark.createDataFrame(held, "e int, g int, s array<string>"), over).collect()}
        assert got == {(q, e) for q, g, s in asked for e, h, t in held if g == h and s and len(set(s) & set(t)) / len(s) > over}


def test_gates_shuffle_rare_words_only(spark):
    from test_operators import shuffled

    rows = [(i, 1, i, 5, None, f"What is the sum of {i} and 3 to you ask{i} as{i} of{i} no{i}", str(i + 3), "so", "apply", "short", None, "one", False, None) for i in range(2000)]
    schema = "id int, chapter int, grounded_on int, concept int, note string, stem string, answer string, explanation string, bloom string, form string, options array<string>, mark_scheme string, misconception boolean, misconception_text string"
    sourced = [(i, 1, 5, rows[i][5] + " then" if i % 100 == 0 else f"what is the question about sum{i}") for i in range(2000)]
    make = lambda: gates.generated_items(spark.createDataFrame(rows, schema), spark.createDataFrame(sourced, "id int, chapter int, concept int, stem string"), spark.createDataFrame([(1, 5)], "chapter int, concept int"))
    got, n = shuffled(spark, lambda: make().select("id", "issues.code"))
    assert {r["id"]: r["code"] for r in got} == {i: ["G6"] if i % 100 == 0 else [] for i in range(2000)}
    assert n < 45_000  # 14 words an item


def test_covered_compares_groups_and_empty_sets(spark):
    asked = [(1, (1, None), ["a", "b"]), (2, (1, 2), ["a", "b"]), (3, (1, 2), []), (4, (1, 2), ["a", "a", "z"]), (4, (1, 3), ["b"])]
    held = [(7, (1, 2), ["a", "b", "c"]), (8, (1, 3), ["b"]), (9, (1, 2), [])]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} int, g struct<c:int,d:int>, s array<string>")
    assert {tuple(r) for r in gates.covered(frame(asked, "q"), frame(held, "e"), 0.8).collect()} == {(2, 7, 1.0), (4, 8, 1.0)}
    assert gates.covered(frame(asked, "q"), frame([], "e"), 0.8).collect() == [] == gates.covered(frame([], "q"), frame(held, "e"), 0.8).collect()


def test_tables_are_grids():
    html = "<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d &amp; e</td></tr><tr><td>f</td></tr><tr></tr><tr><td colspan='x'>g<td>h<p>i</table>"
    assert [[t for t, _ in r] for r in bank.table_grid(html)] == [["a", "b", "b"], ["a", "c", "d & e"], ["f", "", ""], ["", "", ""], ["g", "h i", ""]]
    assert bank.table_grid("") == [] and bank.table_grid("<table><td>x") == [[("x", False)]]
    assert [[t for t, _ in r] for r in bank.table_grid("<tr><td rowspan=3>a<td>b</tr><tr><td>c<td>d</tr><tr></tr>")] == [["a", "b", ""], ["a", "c", "d"], ["a", "", ""]]


def test_outcomes_of_tables(spark):
    md = """# Light No. of Periods: 5
<table><tr><td>CG 1</td><td>Competencies</td><td>Learning Outcomes</td><td>Activities</td></tr>
<tr><td rowspan=3>CG-1</td><td rowspan="2">C-1.1 and C 1.2</td><td>Explain how rays bend Draw a ray; To</td><td>Explain it by play</td></tr>
<tr><td>Identify mirrors</td></tr>
<tr><td>C1.3</td><td colspan=2>Explain how rays bend</td></tr></table>
# Sound
<table><tr><td>C – 2.1</td><td>Describe echoes</td></tr><tr><td>no code</td><td>Describe drums</td></tr>
"""
    got = bank.table_outcomes(md)
    bend = [("Light", 1, 1, f"C-1.{k}", x) for k in (1, 2) for x in ("Explain how rays bend", "Draw a ray; To")]
    assert got == [*bend, *[("Light", 1, 2, f"C-1.{k}", "Identify mirrors") for k in (1, 2)], ("Light", 1, 3, "C-1.3", "Explain how rays bend"), ("Sound", 2, 0, "C-2.1", "Describe echoes")]
    assert bank.table_outcomes(None) == [] == bank.table_outcomes("text | without | tables")
    rows = [tuple(r)[1:] for r in bank.parse_curricula(spark.createDataFrame([(1, "CG-1 Sees\nC-1.3 Bends\n- Explain how rays bend\n" + md)], "id long, md string")).collect()]
    assert [r for r in rows if r[3] == "C-1.3"] == [("outcome", "C-1.3-LO1", "Explain how rays bend", "C-1.3")]  # a bullet's wording doesn't come again
    assert ("outcome", "C-1.1-LO3", "Identify mirrors", "C-1.1") in rows
