"""Question banks and lesson plans: selection, gates, metadata, rubrics, plans, id resolution."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillspark.functions import education as E
from quillspark.functions import text as T
from quillspark.operators import curriculum
from quillspark.operators.relational import similar_elements


def select_items(items: DataFrame, n: int) -> DataFrame:
    """n items dealt in turn over concepts, each concept's best first: grounded, then keyed, then deepest, then in order.

    Input: concept, ord, grounded, keyed, dok. The whole pool is ranked in its concepts; only n rows are ordered over them.
    """
    rank = F.row_number().over(W.partitionBy("concept").orderBy(F.desc("grounded"), F.desc("keyed"), F.desc("dok"), "ord"))
    return items.withColumn("rn", rank).orderBy("rn", "concept").limit(n)


def trailing_table(c) -> Column:
    """struct<stem,answer>: a stem that ends in a filled HTML table keeps its words, and the table is the answer; null answer without one."""
    t = F.col(c) if isinstance(c, str) else c
    table = F.regexp_extract(t, r"(?is)(<table\b(?:(?!<table\b).)*</table>)\s*$", 1)
    filled = F.filter(F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), T.strip_tags), lambda x: x != "")
    ok = (table != "") & (F.size(filled) >= 2)
    return F.struct(F.when(ok, F.trim(F.substring(t, F.lit(1), F.char_length(F.rtrim(t)) - F.char_length(table)))).otherwise(t).alias("stem"), F.when(ok, F.array_join(filled, " | ")).alias("answer"))


def missing_answers(items: DataFrame) -> DataFrame:
    """Items (id, stem, answer JSON) without a model answer, and whether they must wait for a figure."""
    none = F.coalesce(F.trim(F.get_json_object("answer", "$.answer_text")), F.lit("")) == ""
    return items.filter(none).withColumn("needs_figure", F.col("stem").rlike(r"(?i)\b(figure|diagram|graph|picture) (?:given|shown|below|above)|!\["))


def metadata(items: DataFrame) -> DataFrame:
    """Derived metadata of items (id, stem, is_mcq and, where told, subject, standard, section, form, bloom, dok, marks, difficulty, option_count, needs_figure, hint, sha256, concept_id, chapter_id, topic_id, outcome_id, confidence).

    What a source tells stands; the rest is derived from the stem. A difficulty in three words can't justify the ends of a scale of five.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in items.columns else F.lit(None).cast(kind)
    x = items.withColumn("_form", F.coalesce(given("form", "string"), T.classify_form(F.col("stem"), F.col("is_mcq"))))
    x = x.withColumn("_marks", F.coalesce(given("marks", "double"), T.lookup(T.MARKS, F.col("_form"), 1).cast("double")))
    x = x.withColumn("_bloom", F.coalesce(F.lower(given("bloom", "string")), T.bloom(F.col("stem"), F.col("_form"))))
    x = x.withColumn("_dok", F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(given("dok", "int"), T.dok(F.col("_bloom"), F.col("_marks"))))))
    n = F.coalesce(given("option_count", "int"), F.when(F.col("is_mcq"), 4).otherwise(0))
    figure, hint = F.coalesce(given("needs_figure", "boolean"), F.lit(False)), F.trim(F.coalesce(given("hint", "string"), F.lit(""))) != ""
    subject, standard = given("subject", "string"), given("standard", "int")
    told = T.lookup({"easy": 2, "medium": 3, "moderate": 3, "hard": 4, "difficult": 4}, F.lower(given("difficulty", "string")))
    hindi = F.col("stem").rlike(r"[\x{0900}-\x{097F}]")
    middle = F.when(standard.isNotNull(), standard <= 8)
    columns = {
        "form": F.col("_form"), "item_type": F.when(F.col("_form") == "case_study_parent", "case_study").otherwise(F.col("_form")), "marks": F.col("_marks").cast("int"), "bloom": F.col("_bloom"), "dok": F.col("_dok"),
        "difficulty": F.when(F.col("_dok") <= 1, "easy").when(F.col("_dok") == 2, "medium").otherwise("hard"), "difficulty_1_to_5": F.coalesce(told, T.lookup(DIFFICULTY, F.col("_dok"), 4)),
        "knowledge": E.knowledge_by_level(F.col("_bloom"), subject), "wording": E.knowledge_type("stem"), "blueprint": E.blueprint_band(given("section", "string"), F.col("_form"), F.col("_marks")),
        "guessing": F.when(n >= 4, "medium").when(n >= 2, "high").otherwise("low"), "assessment": F.when(n == 0, "competency").otherwise("formative"), "format": F.when(figure, "text_diagram").when(n > 0, "h5p"),
        "interactive": F.coalesce(T.lookup(E.INTERACTIVE, F.col("_form")), F.when(n >= 2, "multiple_choice")), "scaffold": F.when(hint, "hint_available").otherwise("none"), "scaffold_ids": F.when(hint, '["hint_1"]'),
        "latency_band": T.lookup(E.LATENCY, F.col("_bloom")), "latency": F.col("_marks") * 60 + F.size(T.tokenise("stem")), "visual": figure, "offline": ~figure, "script": F.when(hindi, "devanagari").otherwise("latin"),
        "language": F.when(hindi, "hi").otherwise("en"), "grade": F.when(~hindi, T.reading_grade("stem")), "aptitude": E.aptitude(subject), "grade_band": F.when(middle, "middle").when(~middle, "secondary"), "stage": F.when(middle, "Middle").when(~middle, "Secondary"),
        "content_ref": given("sha256", "string"), "concept_ref": given("concept_id", "long"), "chapter_ref": given("chapter_id", "long"), "topic_ref": given("topic_id", "long"), "outcome_ref": given("outcome_id", "long"),
        "confidence": given("confidence", "double"), "scope": F.lit("tenant"), "quality": F.lit("draft"), "tagged_by": F.lit("derived"),
    }
    return x.select("id", *[v.alias(k) for k, v in columns.items()])


#: What a concept's name and description weigh in a match, and the depth's difficulty from 1 to 5.
NAME_WEIGHT, DESCRIPTION_WEIGHT, DIFFICULTY = 0.8, 0.2, {1: 2, 2: 3, 3: 4}


def tag_offline(items: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, concept_id, confidence, bloom, dok, difficulty) of items (grp, id, stem, form, marks) by words alone, against concepts (grp, id, name, description).

    An item and a concept of one group meet on shared words. Below the least accepted score the concept is null, and
    no score counts for more than the cap: a match of words is no understanding.
    """
    words = lambda df, c, k: df.select("grp", F.col("id").alias(k), F.explode(F.array_distinct(T.tokens(c))).alias("x"))
    stem = words(items, "stem", "item")
    size = concepts.select(F.col("grp"), F.col("id").alias("concept"), F.size(F.array_distinct(T.tokens("name"))).alias("n"), F.size(F.array_distinct(T.tokens("description"))).alias("d"))
    side = lambda c, weight: words(concepts, c, "concept").withColumn("weight", F.lit(weight))
    hits = stem.join(side("name", "n").unionByName(side("description", "d")), ["grp", "x"]).groupBy("grp", "item", "concept").agg(F.sum(F.when(F.col("weight") == "n", 1).otherwise(0)).alias("hn"), F.sum(F.when(F.col("weight") == "d", 1).otherwise(0)).alias("hd"))
    one = lambda h, of: F.col(h) / F.greatest(F.col(of), F.lit(1))
    score = NAME_WEIGHT * one("hn", "n") + DESCRIPTION_WEIGHT * one("hd", "d")
    best = hits.join(size, ["grp", "concept"]).filter("n > 0").withColumn("score", score).groupBy("grp", F.col("item").alias("id")).agg(F.max_by(F.struct("concept", "score"), F.struct("score", -F.col("concept"))).alias("b"))
    level = T.bloom(F.col("stem"), F.col("form"))
    x = items.join(best, ["grp", "id"], "left").withColumn("bloom", level).withColumn("dok", T.dok(F.col("bloom"), F.coalesce("marks", F.lit(2))))
    return x.select(
        "id", F.when(F.col("b.score") >= curriculum.ACCEPTED, F.col("b.concept")).alias("concept_id"), F.bround(F.least(F.coalesce("b.score", F.lit(0.0)), F.lit(curriculum.LEXICAL)), 3).alias("confidence"),
        "bloom", "dok", T.lookup(DIFFICULTY, F.col("dok"), 3).alias("difficulty"),
    )


def near_duplicates(items: DataFrame, most: float = 0.8) -> DataFrame:
    """(a, b, overlap), a < b, of items (grp, id, stem) whose bags of words share more than ``most`` of the smaller, within a group.

    The kth copy of a word is an element of its own, so bags are sets, and pairs meet on their rarer elements only. A null group is no group: its words are shared with none.
    """
    w = T.token_rows(items, ["grp", "id"], "stem").groupBy("grp", "id", "x").agg(F.count("*").alias("k"))
    group = F.coalesce(F.concat(F.lit("g"), F.col("grp").cast("string")), F.concat(F.lit("i"), F.col("id").cast("string")))
    e = w.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat_ws("\x00", group, "x", i.cast("string")))).alias("x"))
    return similar_elements(e, most, over=True).select("a", "b", F.col("score").alias("overlap"))


def mark_bands(marks: Column, levels: int) -> Column:
    """array<struct<low,high>>: marks 1.. split into bands as even as can be, the first take the remainder."""
    base, extra = F.floor(marks / levels), marks % levels
    size = lambda i: base + F.when(i < extra, 1).otherwise(0)
    before = lambda i: i * base + F.least(i, extra)
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct((before(i) + 1).cast("int").alias("low"), (before(i) + size(i)).cast("int").alias("high")))


def rubric(criteria: DataFrame) -> DataFrame:
    """Criteria (item, ord, marks, evidence, source) that name evidence, each worth a mark at least; totals are of what stays."""
    ok = criteria.filter(T.grounded(F.col("evidence"), F.col("source"))).withColumn("marks", F.greatest(F.lit(1), F.col("marks")))
    one = F.array_sort(F.collect_list(F.struct("ord", "marks", "evidence")))
    return ok.groupBy("item").agg(F.sum("marks").alias("total"), one.alias("criteria"))


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Concept blocks (concept, level, share) as one distribution a concept: repeats added, sums 1; an even split where all are 0."""
    g = blocks.groupBy("concept", "level").agg(F.sum(F.coalesce("share", F.lit(0.0))).alias("s"))
    w = W.partitionBy("concept")
    total = F.sum("s").over(w)
    return g.select("concept", "level", F.when(total > 0, F.col("s") / total).otherwise(1.0 / F.count("*").over(w)).alias("share"))


def plan_quality(text: Column) -> Column:
    """A teaching plan's flag: empty, thin, unstructured or good."""
    n, parts = F.size(T.tokenise(text)), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*(?:#+|\d+[.)]|[-*])\s+\S"))
    return F.when(n == 0, "empty").when(n < 40, "thin").when(parts < 3, "unstructured").otherwise("good")


def batches(items: DataFrame, by: str, order: str, most: int = 8) -> DataFrame:
    """Adds batch: at most ``most`` consecutive items of a slice."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(order))
    return items.withColumn("batch", F.ceil(rn / most).cast("int"))


def resolve_ids(rows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Adds <name>_id for each dimension (name, id) by folded name, the least id where names repeat, and unresolved: the names without one."""
    out = rows
    for name, dim in dims.items():
        d = dim.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.min("id").alias(f"{name}_id"))
        out = out.join(d, F.lower(F.trim(F.col(name))) == F.col("_k"), "left").drop("_k")
    missing = F.filter(F.array(*[F.when(F.col(f"{n}_id").isNull(), F.lit(n)) for n in dims]), lambda x: x.isNotNull())
    return out.withColumn("unresolved", missing)


def content_source(content: DataFrame, wanted: DataFrame) -> DataFrame:
    """(subject, institute): the wanted institute where it has content (subject, institute), else the one with most, the least id on ties."""
    n = content.groupBy("subject", "institute").agg(F.count("*").alias("n"))
    most = n.groupBy("subject").agg(F.max_by("institute", F.struct("n", -F.col("institute"))).alias("_most"))
    own = n.select(F.col("subject").alias("_s"), F.col("institute").alias("_own"))
    x = wanted.join(own, (F.col("subject") == F.col("_s")) & (F.col("institute") == F.col("_own")), "left").drop("_s")
    return x.join(most, "subject", "left").select("subject", F.coalesce("_own", "_most").alias("source"))


def master_calendar(slots: DataFrame, plans: DataFrame) -> DataFrame:
    """Slots (subject, day, period) with their plan (subject, day, period, title, saved): of several the last saved."""
    key = ["subject", "day", "period"]
    last = plans.groupBy(*key).agg(F.max_by("title", "saved").alias("title"))
    return slots.join(last, key, "left")


def macro_plan(chapters: DataFrame, slots: DataFrame) -> DataFrame:
    """Chapters (subject, chapter, ord, periods) on teaching slots (subject, day, n): each owns as many as its periods after those before it.

    Gives first and last day; null where the slots have run out. A range join on slot numbers within a subject.
    """
    w = W.partitionBy("subject").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = chapters.withColumn("_b", F.sum("periods").over(w)).withColumn("_a", F.col("_b") - F.col("periods") + 1)
    s = slots.withColumn("_i", F.row_number().over(W.partitionBy("subject").orderBy("day", "n")))
    one = lambda k, name: s.select(F.col("subject").alias("_s"), F.col("_i").alias(k), F.col("day").alias(name))
    x = c.join(one("_x", "first_day"), (F.col("subject") == F.col("_s")) & (F.col("_a") == F.col("_x")), "left").drop("_s", "_x")
    x = x.join(one("_x", "last_day"), (F.col("subject") == F.col("_s")) & (F.col("_b") == F.col("_x")), "left")
    return x.select("subject", "chapter", "periods", "first_day", "last_day")


_GOAL = re.compile(r"\b(CG[\s-]*\d+)\b[:.\s-]*(.*)")
_COMPETENCY = re.compile(r"\b(C[\s-]*\d+\.\d+)\b[:.\s-]*(.*)")


def curriculum_rows(md: str | None) -> list[tuple[str, str, str, str | None]]:
    """(type, code, description, parent code) out of a curriculum's lines: goals, competencies under the last goal, bullets as outcomes under the last competency."""
    out: list[tuple[str, str, str, str | None]] = []
    goal = competency = None
    for line in (md or "").splitlines():
        s = line.strip().lstrip("#*|- ").strip()
        if m := _COMPETENCY.match(s):
            competency = re.sub(r"\s+", "", m[1])
            out.append(("competency", competency, m[2].strip(" |"), goal))
        elif m := _GOAL.match(s):
            goal, competency = re.sub(r"\s+", "", m[1]), None
            out.append(("goal", goal, m[2].strip(" |"), None))
        elif competency and re.match(r"\s*[-*]\s+\S", line):
            n = sum(1 for x in out if x[0] == "outcome" and x[3] == competency) + 1
            out.append(("outcome", f"{competency}-LO{n}", s, competency))
    return out


class _Cells(HTMLParser):
    """The rows of one table's cells, as (text, columns, rows, whether it is a heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.open = False
        elif tag in ("td", "th"):
            span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and (v or "").isdigit()}
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(["", max(1, min(span.get("colspan", 1), MOST_SPAN)), max(1, min(span.get("rowspan", 1), MOST_SPAN)), tag == "th"])
            self.open = True
        elif tag in ("br", "p", "li", "div") and self.open:
            self.rows[-1][-1][0] += " "

    def handle_endtag(self, tag):
        self.open = self.open and tag not in ("td", "th", "tr", "table")

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1][0] += data


#: Columns or rows that a cell spans, at most: as many as browsers allow for columns.
MOST_SPAN = 1000


def table_grid(html: str) -> list[list[tuple[str, bool]]]:
    """The cells of an HTML table by row and column as (text, heading): what spans columns or rows stands in all of them; short rows are filled up with empty cells."""
    p = _Cells()
    p.feed(html)
    p.close()
    grid: list[list[tuple[str, bool]]] = []
    down: dict[int, tuple[int, str, bool]] = {}  # by column: rows still to come of a cell above
    for cells in p.rows:
        row: dict[int, tuple[str, bool]] = {k: (text, head) for k, (_, text, head) in down.items()}
        down = {k: (n - 1, text, head) for k, (n, text, head) in down.items() if n > 1}
        at = 0
        for text, wide, deep, head in cells:
            while at in row:
                at += 1
            for k in range(at, at + wide):
                row[k] = (" ".join(text.split()), head)
                if deep > 1:
                    down[k] = (deep - 1, *row[k])
            at += wide
        grid.append([row.get(k, ("", False)) for k in range(max(row, default=-1) + 1)])
    most = max(map(len, grid), default=0)
    return [r + [("", False)] * (most - len(r)) for r in grid]


#: Verbs by which an outcome begins, as headings of curricula write them.
_VERBS = tuple(sorted({w.capitalize() for ws in T.BLOOM.values() for w in ws} - {"How", "What", "When", "Where", "Who", "Why"} | {"Demonstrate", "Relate", "Represent", "Prepare", "Communicate", "Carry"}))
_BEFORE_VERB = re.compile(rf"(?=\b(?:{'|'.join(_VERBS)})\b)")
_CODE = re.compile(r"\bC\s*[-\u2013]?\s*(\d+\.\d+)\b")
_ROLES = {"outcome": re.compile(r"learning\s+outcome|\boutcomes?\b", re.I), "competency": re.compile(r"competenc|curricular\s+goal", re.I), "other": re.compile(r"periods?|pedagog|marks|weightage|activit", re.I)}


def table_outcomes(md: str | None, least: int = 5) -> list[tuple[str, int, int, str, str]]:
    """(chapter, table, row, competency code, outcome) out of the tables of a curriculum: each heading line names the chapter of the tables below it.

    A column's role is what its headings say (rows of heading cells, or the first row where no cell is one); where none tells, outcomes are the columns after the one with the code. A
    cell that spans rows holds for all of them, so a competency's outcomes may fill many rows. Outcomes that run on are split before each verb; those of ``least`` letters or fewer go.
    """
    out = []
    chapter, n = "", 0
    for m in re.finditer(r"(?im)^\#{1,6}[ \t]+(.+?)[ \t]*$|<table\b.*?(?:</table>|\Z)", md or "", re.S):
        if m[1] is not None:
            chapter = re.sub(r"(?i)\s*no\.?\s*of\s*periods.*", "", m[1]).strip(" :-|")
            continue
        n += 1
        grid = table_grid(m[0])
        heads = [i for i, r in enumerate(grid) if r and all(h or not t for t, h in r)] or ([0] if grid and not any(_CODE.search(t) for t, _ in grid[0]) else [])
        roles = {}
        for k in range(len(grid[0]) if grid else 0):
            said = " ".join(grid[i][k][0] for i in heads)
            roles[k] = next((role for role, p in _ROLES.items() if p.search(said)), None)
        for i, row in enumerate(grid):
            if i in heads:
                continue
            at = next((k for k, (t, _) in enumerate(row) if _CODE.search(t) and roles.get(k) in ("competency", None)), None)
            if at is None:
                continue
            told = [k for k in range(len(row)) if roles.get(k) == "outcome"] or [k for k in range(at + 1, len(row)) if roles.get(k) is None]
            text = " ".join(dict.fromkeys(row[k][0] for k in told))
            for code in dict.fromkeys(_CODE.findall(row[at][0])):
                out += [(chapter, n, i, f"C-{code}", x.strip(" ;,")) for x in _BEFORE_VERB.split(text) if len(x.strip(" ;,.")) > least]
    return out


def parse_curricula(docs: DataFrame) -> DataFrame:
    """(id, type, code, description, parent) of documents (id, md): goals, competencies and bulleted outcomes of its lines; outcomes of its tables under their competency, numbered on
    after the bullets, each wording once. Each document alone."""

    def rows_of(md):
        rows = curriculum_rows(md)
        told = {x[3:1:-1] for x in rows if x[0] == "outcome"}
        count = Counter(x[3] for x in rows if x[0] == "outcome")
        for _, _, _, code, text in table_outcomes(md):
            if (code, text) not in told:
                told.add((code, text))
                count[code] += 1
                rows.append(("outcome", f"{code}-LO{count[code]}", text, code))
        return rows

    def run(parts):
        for b in parts:
            rows = [(i, *r) for i, md in zip(b["id"], b["md"], strict=True) for r in rows_of(md)]
            yield pd.DataFrame(rows, columns=["id", "type", "code", "description", "parent"])

    return docs.select("id", "md").mapInPandas(run, "id long, type string, code string, description string, parent string")


def curriculum_tables(docs: DataFrame) -> DataFrame:
    """(id, chapter, tbl, row, code, outcome) of documents (id, md), see ``table_outcomes``. Each document alone."""

    def run(parts):
        for b in parts:
            rows = [(i, *r) for i, md in zip(b["id"], b["md"], strict=True) for r in table_outcomes(md)]
            yield pd.DataFrame(rows, columns=["id", "chapter", "tbl", "row", "code", "outcome"])

    return docs.select("id", "md").mapInPandas(run, "id long, chapter string, tbl int, row int, code string, outcome string")


def _flow(tail: str, head: str) -> int:
    """1 where one piece runs on into the next: an open end into a small letter, or a full stop into none."""
    if not tail or not head:
        return 0
    closed = tail[-1] in ".?!:"
    return int(closed != head[0].islower())


def _best_path(w: list[list[int]]) -> list[int]:
    """The order of all pieces with the most flow; the first in their own order among equals. Dynamic programming over subsets, for any flow: what tests hold ``_best_trail`` against."""
    n = len(w)
    best = [[-1] * n for _ in range(1 << n)]  # flow still to come, by the pieces used and the last of them
    for used in range((1 << n) - 1, 0, -1):
        for last in (i for i in range(n) if used >> i & 1):
            best[used][last] = max((w[last][j] + best[used | 1 << j][j] for j in range(n) if not used >> j & 1), default=0)
    path = [max(range(n), key=lambda i: (best[1 << i][i], -i))]
    used = 1 << path[0]
    while len(path) < n:
        left = (j for j in range(n) if not used >> j & 1)
        path.append(max(left, key=lambda j: (w[path[-1]][j] + best[used | 1 << j][j], -j)))
        used |= 1 << path[-1]
    return path


def _matched_path(w: list[list[int]]) -> list[int]:
    """An order of many pieces: a largest matching of ends to heads, by augmenting paths, whose circles are opened at their first piece. For any flow, like ``_best_path``."""
    n = len(w)
    before = [-1] * n  # of each piece, the one that runs on into it

    def find(i, seen):
        for j in range(n):
            if i != j and w[i][j] and j not in seen:
                seen.add(j)
                if before[j] < 0 or find(before[j], seen):
                    before[j] = i
                    return True
        return False

    for i in range(n):
        find(i, set())
    after = {i: j for j, i in enumerate(before) if i >= 0}
    out, placed = [], [False] * n
    starts = [j for j in range(n) if before[j] < 0] + list(range(n))
    for s in starts:
        while s is not None and not placed[s]:
            placed[s] = True
            out.append(s)
            s = after.get(s)
    return out


#: Where a piece begins and ends: before a head that follows a full stop, before one that goes on, or nowhere that joins.
_STOP, _ON, _NONE = range(3)


def _ends(head: str, tail: str) -> tuple[int, int]:
    """From where to where a piece leads: one that ends where another begins runs on into it, as ``_flow`` says."""
    return _NONE if not head else _ON if head[0].islower() else _STOP, _NONE if not tail else _STOP if tail[-1] in ".?!:" else _ON


def _fewest_trails(c: list[int]) -> int:
    """The fewest unbroken runs that c[3 head + tail] pieces of each kind can be put in.

    Pieces are edges between the two places, so this is the number of trails that cover a graph's edges: in each connected
    part the edges that leave places in excess of those that arrive, and one at least. An end that joins nothing is a place of its own.
    """
    at_stop = c[0] + c[1] + c[2] + c[3] + c[6]
    at_on = c[4] + c[1] + c[5] + c[3] + c[7]
    stop = c[6] + max(0, c[1] + c[2] - c[3] - c[6])
    on = c[7] + max(0, c[3] + c[5] - c[1] - c[7])
    if c[1] or c[3]:
        return c[8] + max(1, stop + on)
    return c[8] + (max(1, stop) if at_stop else 0) + (max(1, on) if at_on else 0)


def _best_trail(pieces: list[tuple[int, int]]) -> list[int]:
    """The order of all pieces (see ``_ends``) with the most flow; the first in their own order among equals.

    The best that any rest can bring is known from the number of its pieces of each kind, so an order is built from
    its beginning: the next piece is the first one of a kind that loses nothing.
    """
    queues: list[list[int]] = [[] for _ in range(9)]
    for i in range(len(pieces) - 1, -1, -1):
        queues[3 * pieces[i][0] + pieces[i][1]].append(i)
    c = [len(x) for x in queues]

    def most(n: int, last: int) -> int:
        if last == _NONE:
            return n - _fewest_trails(c) if n else 0
        c[3 * _NONE + last] += 1  # the piece before is a run's beginning that nothing precedes
        got = n + 1 - _fewest_trails(c)
        c[3 * _NONE + last] -= 1
        return got

    out, last = [], _NONE
    for n in range(len(pieces) - 1, -1, -1):
        want = most(n + 1, last)
        for k in sorted((k for k in range(9) if c[k]), key=lambda k: queues[k][-1]):
            c[k] -= 1
            if most(n, k % 3) + (last != _NONE and last == k // 3) == want:
                out.append(queues[k].pop())
                last = k % 3
                break
            c[k] += 1
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _order(heads: pd.Series, tails: pd.Series) -> pd.Series:
    """The best order of each row's pieces, told by their first and last letters (a blank where there is none). Built-in expressions have no such search."""
    return pd.Series([_best_trail([_ends(h.strip(), t.strip()) for h, t in zip(hs, ts, strict=True)]) for hs, ts in zip(heads, tails, strict=True)])


def best_order(df: DataFrame) -> DataFrame:
    """(grp, ord, pos) of pieces (grp, ord, head, tail) put in the order in which most tails run on into the next head, the first in their own order among equals.

    Groups of any size get the best order there is, in time that grows with their pieces. A group is one document's pieces, which a row holds by
    their first and last letters.
    """
    letter = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)([^\s\x1c-\x1f])", 1)
    one = lambda x: F.when(x == "", " ").otherwise(x)
    head, tail = one(letter(F.col("head").cast("string"))), one(letter(F.reverse(F.col("tail").cast("string"))))
    pieces = F.sort_array(F.collect_list(F.struct(F.col("ord").isNull().alias("last"), "ord", head.alias("h"), tail.alias("t"))))
    g = df.groupBy("grp").agg(pieces.alias("p"))
    g = g.select("grp", "p.ord", _order(F.array_join("p.h", ""), F.array_join("p.t", "")).alias("i"))
    x = g.select("grp", "ord", F.posexplode("i").alias("pos", "i"))
    return x.select(F.col("grp").cast("long").alias("grp"), F.get("ord", F.col("i")).cast("long").alias("ord"), F.col("pos").cast("long").alias("pos"))
