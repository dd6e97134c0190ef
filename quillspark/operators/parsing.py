"""Document kernels: questions out of markdown, sections, topic spans. Rows in, rows out; each document alone."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T

@dataclass(frozen=True)
class Grammar:
    """How a family of papers is set: words that open its parts. ``questions`` reads any paper by such a grammar."""

    sections: tuple[str, ...] = ("section", "part")
    forms: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "assertion_reason": ("assertion",), "mcq": ("multiple choice", "choose the correct", "objective"), "true_false": ("true or false", "true/false"),
        "fill_blank": ("fill in the blank",), "very_short": ("very short",), "short": ("short answer", "short type"), "long": ("long answer", "long type"),
        "case_study": ("case based", "case-based", "case study"),
    })
    answers: tuple[str, ...] = ("answer key", "answers")
    answer: tuple[str, ...] = ("answer", "ans", "correct option")
    solution: tuple[str, ...] = ("solutions", "solution", "explanation")
    alternative: tuple[str, ...] = ("OR",)
    page: str = r"<!--\s*page[:\s]*(\d+)\s*-->"
    #: Marks and section by form, and form by section, where a heading doesn't tell.
    marks: dict[str, int] = field(default_factory=lambda: {"mcq": 1, "assertion_reason": 1, "true_false": 1, "fill_blank": 1, "very_short": 2, "short": 3, "long": 5, "case_study": 4})
    letters: dict[str, str] = field(default_factory=lambda: {"mcq": "A", "assertion_reason": "A", "true_false": "A", "fill_blank": "A", "very_short": "B", "short": "C", "long": "D", "case_study": "E"})

    def form_of(self, letter: str) -> str:
        return next((f for f in ("mcq", "very_short", "short", "long", "case_study") if self.letters.get(f) == letter), "short")


CBSE = Grammar()
_NUMBER = re.compile(r"(?:^|(?<=\s))(?:Q\s?\.?\s?)?(\d{1,3})\s?[.)](?=\s)", re.M)
_LABEL = re.compile(r"\(\s?([a-dA-D])\s?\)")
_NUMERAL = re.compile(r"\(\s?([ivxlc]+)\s?\)")
_NUMERAL_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_EACH = re.compile(r"(\d+)\s*marks?\b", re.I)
_KEY = re.compile(r"(\d{1,3})\s*[.):\-]\s*\(?\s?([a-dA-D])\b\)?")
_PAIR = re.compile(r"assertion\s*(?:\(\s*a\s*\))?\s*[:\-]\s*(.*?)\s*reason\s*(?:\(\s*r\s*\))?\s*[:\-]\s*(.*)", re.I | re.S)
#: Words for a figure, words that point at one that is there, and tasks that make one.
_FIGURES = frozenset(("figure", "figures", "fig", "diagram", "diagrams", "graph", "graphs", "picture", "pictures"))
_POINTING = frozenset(("given", "shown", "above", "below", "adjoining", "alongside", "following", "beside"))
_MAKING = frozenset(("draw", "sketch", "plot", "construct", "label", "make", "prepare"))


def numeral(s: str) -> int:
    """The value of a roman numeral in small letters."""
    values = [_NUMERAL_VALUES[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0], strict=True))


def points_at_figure(stem: str) -> bool:
    """Whether a stem needs a figure that it doesn't ask for: a word for one near a word that points, or one that no task before it in its sentence makes."""
    for sentence in re.split(r"(?<!\bfig)[.?!]\s", stem.lower()):
        words = re.findall(r"\w+", sentence)
        for i, w in enumerate(words):
            if w in _FIGURES and (_POINTING.intersection(words[max(0, i - 4) : i + 5]) or not _MAKING.intersection(words[:i])):
                return True
    return False


def rising(numbers: list[int]) -> list[int]:
    """Places of the numbers that continue 1, 2, 3, ...: each is accepted only as the last accepted plus one."""
    out, last = [], 0
    for i, n in enumerate(numbers):
        if n == last + 1:
            out.append(i)
            last = n
    return out


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def _tidy(s: str) -> str:
    return " ".join(s.split())


def _answers(md: str, g: Grammar) -> tuple[str, dict[int, str]]:
    """A paper without its last block of answers, and the keys in that: the heading counts only before numbers that rise from its first on."""
    for m in reversed(list(re.finditer(rf"(?:^|(?<=\s))#*\s*(?:{_any(g.answers)})\s*:?\s+(?=(?:Q\s?\.?\s?)?\d{{1,3}}\s*[.):\-])", md, re.I))):
        found = [(int(n), k.lower()) for n, k in _KEY.findall(md[m.end() :])]
        if found:
            first = found[0][0] - 1
            return md[: m.start()], {found[i][0]: found[i][1] for i in rising([n - first for n, _ in found])}
    return md, {}


def _form(heading: str, g: Grammar) -> str | None:
    low = heading.lower()
    hits = [(low.find(w), -len(w), f) for f, ws in g.forms.items() for w in ws if w in low]
    return min(hits)[2] if hits else None


def _parts(md: str, g: Grammar) -> list[tuple[int, int, str, str, int]]:
    """(begin, end, section letter, form, marks) of the runs of items: printed sections and headings within them, or, without sections, the headings of forms that a number follows."""
    printed = [(m.start(), m.end(), m[1].upper()) for m in re.finditer(rf"\b(?:{_any(g.sections)})\s*[-:\u2013]?\s*([A-E])\b", md, re.I)]
    phrases = _any(tuple(w for ws in g.forms.values() for w in ws))
    named = []
    for m in re.finditer(rf"\b(?:{phrases})", md, re.I):
        after = _NUMBER.search(md, m.end(), m.end() + (400 if printed else 80))
        if after and not any(s <= m.start() < e + 80 for s, e, _ in printed) and (not named or m.start() - named[-1] >= 30) and not _NUMBER.search(md, max(0, m.start() - 12), m.start()):
            if not printed or _form(md[m.start() : m.end()], g) == "assertion_reason" and "question" in md[m.end() : m.end() + 30].lower():
                named.append(m.start())
    cuts = sorted([(s, e, letter) for s, e, letter in printed] + [(s, s, None) for s in named])
    out, letter = [], None
    for i, (s, e, own) in enumerate(cuts):
        end = cuts[i + 1][0] if i + 1 < len(cuts) else len(md)
        first = _NUMBER.search(md, e)
        heading = md[s : min(end, first.start() if first else end, e + 120)]
        form = _form(heading, g) or g.form_of(own or letter or "A")
        letter = own or (letter if printed else None) or g.letters.get(form, "A")
        told = _EACH.search(heading)
        out.append((e, end, letter, form, int(told[1]) if told else g.marks.get(form, 1)))
    return out or [(0, len(md), "A", "mcq", 1)]


def _split(piece: str, words: tuple[str, ...]) -> tuple[str, str | None]:
    m = re.search(rf"\b(?:{_any(words)})\s*[:\-]\s*", piece, re.I)
    return (piece[: m.start()], piece[m.end() :]) if m else (piece, None)


def _item(piece: str, g: Grammar) -> dict:
    """The fields of one item's text."""
    key = None
    if a := re.search(rf"\b(?:{_any(g.answer)})\s*[:\-]?\s*\(\s?([a-dA-D])\s?\)|\b(?:{_any(g.answer)})\s*[:\-]\s*([a-dA-D])\b", piece, re.I):
        key = (a[1] or a[2]).lower()
        piece = piece[: a.start()] + " " + piece[a.end() :]
    body, solution = _split(piece, g.solution)
    pair = _PAIR.match(_tidy(body))
    labels = list(_LABEL.finditer(body))
    climb = [labels[k] for k in rising([ord(o[1].lower()) - 96 for o in labels])][:4]
    options: list[str] = []
    if len(climb) == 4 and not pair:
        options = [_tidy(body[o.end() : climb[k + 1].start() if k < 3 else len(body)]).strip(" .;,") for k, o in enumerate(climb)]
        body = body[: climb[0].start()]
    parts = list(_NUMERAL.finditer(body))
    subs = [parts[k][1] for k in rising([numeral(p[1]) for p in parts])]
    worth = sum(int(x) for x in re.findall(r"\(\s*(\d+)\s*marks?\s*\)", body, re.I))
    stem = _tidy(body)
    hashed = " ".join(re.findall(r"\w+", stem.lower())) + "|" + "|".join(sorted(o.lower() for o in options))
    return {
        "stem": stem, "options": options, "key": key if options or pair else None, "worth": worth, "sub_parts": subs if len(subs) >= 2 else [],
        "assertion": pair[1].strip() if pair else None, "reason": pair[2].strip() if pair else None, "solution": _tidy(solution) if solution else None,
        "needs_figure": points_at_figure(stem), "sha256": hashlib.sha256(hashed.encode()).hexdigest(),
    }


def questions(md: str | None, grammar: Grammar = CBSE) -> list[dict]:
    """Items of a question paper: section, number, alternative, form, stem, options, key, marks, sub_parts, assertion, reason, solution, needs_figure, page, sha256, start.

    The text is one stream: headings, numbers and labels count wherever they stand, so a page that was joined into one
    line reads like a tidy one. A last block of answers gives keys by number; numbers must rise by one within a run;
    options must climb from a. What stands on either side of a lone OR are alternatives of one number. The page is the
    last page mark before an item.
    """
    md = md or ""
    pages = [(m.start(), int(m[1])) for m in re.finditer(grammar.page, md, re.I)]
    text = re.sub(grammar.page, lambda m: " " * len(m[0]), md, flags=re.I)
    text, keys = _answers(text, grammar)
    out = []
    for begin, end, letter, form, marks in _parts(text, grammar):
        found = list(_NUMBER.finditer(text, begin, end))
        if not found:
            continue
        first = int(found[0][1]) - 1  # runs may go on counting
        kept = [found[j] for j in rising([int(m[1]) - first for m in found])]
        for j, m in enumerate(kept):
            piece = text[m.end() : kept[j + 1].start() if j + 1 < len(kept) else end]
            number = int(m[1])
            for k, one in enumerate(re.split(rf"(?<=\s)(?:{_any(grammar.alternative)})(?=\s)", piece)):
                x = _item(one, grammar)
                if k and not x["stem"]:
                    continue
                own = "assertion_reason" if x["assertion"] is not None else "mcq" if x["options"] else "case_study" if form == "case_study" and x["sub_parts"] else form
                worth = x.pop("worth")
                x["key"] = x["key"] or (keys.get(number) if x["options"] or x["assertion"] is not None else None)
                out.append({"section": letter, "number": number, "alternative": k, "form": own, "marks": worth if own == "case_study" and worth else marks, "page": next((p for at, p in reversed(pages) if at <= m.start()), None), "start": m.start(), **x})
    return out


_ITEM = "id long, section string, number int, alternative int, form string, stem string, options array<string>, key string, marks int, sub_parts array<string>, assertion string, reason string, solution string, needs_figure boolean, page int, sha256 string, start int"


def extract_questions(docs: DataFrame, grammar: Grammar = CBSE) -> DataFrame:
    """Items of every document (id, md), read by ``grammar``. The state machine is sequential within a document; documents are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _ITEM.split(", ")]
        for b in batches:
            rows = [{"id": i, **q} for i, md in zip(b["id"], b["md"], strict=True) for q in questions(md, grammar)]
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int32"})

    return docs.select("id", "md").mapInPandas(run, _ITEM)


def running_lines(lines: DataFrame, places: int = 2, least: int = 3) -> DataFrame:
    """``lines`` (id, line, s, page) without the furniture of pages: lines that, but for their digits, stand among the first or among the last ``places`` of half of a document's pages, and of ``least``.

    Blank lines go too. Counted by document, line and place, so a document's pages are never held together.
    """
    x = lines.filter(F.trim("s") != "").withColumn("_k", F.regexp_replace(F.trim("s"), r"\d+", "#"))
    page = W.partitionBy("id", "page")
    rn = F.row_number().over(page.orderBy("line"))
    x = x.withColumn("_top", rn <= places).withColumn("_end", F.count("*").over(page) - rn < places)
    held = lambda c, name: F.count_distinct(F.when(F.col(c), F.col("page"))).alias(name)
    pages = x.groupBy("id").agg(F.count_distinct("page").alias("_pages"))
    often = x.filter("_top or _end").groupBy("id", "_k").agg(held("_top", "a"), held("_end", "b")).join(pages, "id")
    enough = lambda c: (F.col(c) >= least) & (2 * F.col(c) >= F.col("_pages"))
    often = often.select("id", "_k", enough("a").alias("_a"), enough("b").alias("_b")).filter("_a or _b")
    x = x.join(often, ["id", "_k"], "left")
    gone = (F.col("_top") & F.coalesce("_a", F.lit(False))) | (F.col("_end") & F.coalesce("_b", F.lit(False)))
    return x.filter(~gone).select(*lines.columns)


def answered_items(docs: DataFrame, grammar: Grammar = CBSE) -> DataFrame:
    """(id, item, part, form, number, page, stem, options, key, answer): items of documents (id, md) in which every item is answered in place.

    The mark of an answer (at the start of a line) is the anchor, so there are as many items as answers: the next item begins at the first number
    after an answer, or at the next answer where no number stands between, and numbers may restart or stand in lists within a stem. A part begins at a
    line whose letters alone, however spaced, are the words of a form (one doubled first letter is read over). Options are
    labelled by capitals at the start of a line and run to the next label; the key is the label that opens the answer.
    Furniture of pages goes first. Windows are over the lines of one document.
    """
    s = F.col("s")
    lines = docs.select("id", F.posexplode(F.split("md", "\n")).alias("line", "s"))
    mark = F.regexp_extract("s", f"(?i){grammar.page}", 1)
    upto = W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("_m", F.when(mark != "", mark.cast("int"))).withColumn("page", F.last("_m", ignorenulls=True).over(upto))
    lines = running_lines(lines.filter("_m is null").drop("_m"))
    letters = F.lower(F.regexp_replace("s", r"[^\p{L}]", ""))
    squash = lambda w: re.sub(r"[^a-z]", "", w)
    banners = {squash(w) + more: f for f, ws in grammar.forms.items() for w in ws for more in ("", "answer", "answers", "question", "questions", "answerquestion", "answerquestions")}
    single = F.when(F.substring(letters, 1, 1) == F.substring(letters, 2, 1), F.expr("substring(_l, 2)")).otherwise(F.col("_l"))
    lines = lines.withColumn("_l", letters).withColumn("_form", F.coalesce(T.lookup(banners, F.col("_l")), T.lookup(banners, single)))
    banner = F.col("_form").isNotNull() & ~s.rlike(r"\d")
    lines = lines.withColumn("form", F.last(F.when(banner, F.col("_form")), ignorenulls=True).over(upto)).withColumn("part", F.sum(banner.cast("int")).over(upto)).filter(~banner)
    # the item of a line: the answers before it, less one until a number (or the next answer) opens the next
    answer = s.rlike(rf"(?i)^\W*A?(?:{_any(grammar.answer)})\s*:")
    number = F.regexp_extract("s", r"^\s*(\d{1,3})[.)]\s", 1)
    w = W.partitionBy("id", "part").orderBy("line")
    lines = lines.withColumn("_a", answer).withColumn("_n", F.when(number != "", number.cast("int")))
    before = F.coalesce(F.sum(F.col("_a").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("_b", before)
    same = W.partitionBy("id", "part", "_b").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    opened = F.coalesce(F.max(F.col("_n").isNotNull() | F.col("_a")).over(same), F.lit(False))
    lines = lines.withColumn("k", F.when(opened | (F.col("_b") == 0), F.col("_b")).otherwise(F.col("_b") - 1))
    lines = lines.withColumn("_after", F.col("_b") > F.col("k"))
    first = F.min(F.when(F.col("_n").isNotNull() & ~F.col("_after") & ~F.col("_a"), F.col("line"))).over(W.partitionBy("id", "part", "k"))
    lines = lines.withColumn("s", F.when(F.col("line") == first, F.regexp_replace("s", r"^\s*\d{1,3}[.)]\s", "")).otherwise(F.col("s")))
    line = F.struct("line", "s")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, line))), lambda x: x["s"]), "\n")
    own = ~F.col("_after") & ~F.col("_a")
    g = lines.groupBy("id", "part", "k").agg(
        F.min(F.when(F.col("_a") | F.col("_n").isNotNull(), F.struct("line", F.when(F.col("_n").isNotNull() & own, F.col("_n")).alias("n"), "page"))).alias("first"),
        F.first("form", ignorenulls=True).alias("form"), joined(own).alias("body"), joined(~own).alias("told"), F.max("_a").alias("answered"), F.min("line").alias("line"),
    )
    g = g.filter("answered")
    clean = lambda c: T.collapse(c)
    body = F.col("body")
    label = r"(?m)^\s*\(([A-D])\)"
    pieces = F.split(body, label)
    texts = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), clean)
    labels = F.regexp_extract_all(body, F.lit(label), F.lit(1))
    options = F.filter(F.arrays_zip(labels.alias("label"), texts.alias("text")), lambda o: F.char_length(o["text"]) > 1)
    told = F.regexp_replace("told", rf"(?i)\A\W*A?(?:{_any(grammar.answer)})\s*:", "")
    key = F.upper(F.regexp_extract(told, r"\A\s*\(([A-Da-d])\)", 1))
    x = g.select("id", "part", "k", "line", "form", "first", F.when(F.size(options) > 0, clean(F.element_at(pieces, 1))).otherwise(clean(body)).alias("stem"), options.alias("options"), key.alias("key"), told.alias("told"))
    some = F.size("options") > 0
    rest = clean(F.regexp_replace("told", r"\A\s*\([A-Da-d]\)", ""))
    form = F.when(some & F.col("stem").rlike(r"(?i)\bassertion\b") & F.col("stem").rlike(r"(?i)\breason\b"), "assertion_reason").when(some, "mcq").when(F.col("form") == "mcq", "very_short").otherwise(F.col("form"))
    keyed = some & (F.col("key") != "")
    at = F.row_number().over(W.partitionBy("id").orderBy("line"))
    return x.select(
        "id", at.alias("item"), "part", form.alias("form"), F.coalesce("first.n", F.col("k") + 1).cast("int").alias("number"), F.col("first.page").alias("page"), "stem", "options",
        F.when(keyed, F.col("key")).alias("key"), F.when(keyed & (rest != ""), rest).otherwise(clean(F.col("told"))).alias("answer"),
    )


#: Items by section of a full paper, and its marks.
BLUEPRINT, FULL_MARKS = {"A": 20, "B": 5, "C": 6, "D": 4, "E": 3}, 80


def section_fingerprint(items: DataFrame) -> DataFrame:
    """By document and section: items, marks, choice items, assertion-reason items, items with a figure, forms in the order in which they come, and how many a full paper has."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    forms = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "form"))), lambda x: x["form"]))
    g = items.groupBy("id", "section").agg(
        F.count("*").alias("n"), F.sum("marks").alias("marks"), n(F.size("options") == 4).alias("choice"), n(F.col("assertion").isNotNull()).alias("assertion_reason"),
        n(F.col("needs_figure")).alias("figures"), forms.alias("forms"),
    )
    return g.withColumn("expected", T.lookup(BLUEPRINT, F.col("section"), 0))


def topic_outline(docs: DataFrame, least: int = 3) -> DataFrame:
    """(id, ord, number, title, authoritative) of documents (id, md): sections that the text numbers itself ("2.1 Mirrors"), the first of each number and wording.

    ``least`` or more of them make an outline that topics can be held against.
    """
    line = docs.select("id", F.posexplode(F.split("md", "\n")).alias("line", "s"))
    shape = r"^#{0,6}\s?(\d{1,2}\.\d{1,2})\.?\s+(\p{L}[^.?!]{2,79})$"
    x = line.withColumn("number", F.regexp_extract("s", shape, 1)).withColumn("title", F.trim(F.regexp_extract("s", shape, 2))).filter("number != ''")
    one = x.groupBy("id", "number").agg(F.min_by("title", "line").alias("title"), F.min("line").alias("line"))
    one = one.groupBy("id", T.normalise_name("title").alias("_k")).agg(F.min_by("number", "line").alias("number"), F.min_by("title", "line").alias("title"), F.min("line").alias("line")).drop("_k")
    w = W.partitionBy("id")
    return one.select("id", F.row_number().over(w.orderBy("line")).alias("ord"), "number", "title", (F.count("*").over(w) >= least).alias("authoritative"))


def topic_spans(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, ord, start, end): where each topic (id, ord, name) lies in its document (id, md); spans tile the text. Documents without topics have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, md, found in zip(b["id"], b["md"], b["topics"], strict=True):
                found = list(found)
                rows += [(i, x["ord"], s, e) for x, (s, e) in zip(found, partition_by_topics(md or "", [x["name"] or "" for x in found]), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "ord", "start", "end"])

    of = topics.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("topics"))
    return docs.join(of, "id").select("id", "md", "topics").mapInPandas(run, "id long, ord long, start long, end long")


def section_score(target: Column, title: Column, text: Column, body: int = 4000, most: int = 120) -> Column:
    """How much of a target's tokens a section holds: its heading counts three times what its body's first ``body`` characters do."""
    share = lambda c: T.coverage(target, F.array_distinct(T.tokens(c)))
    return 3.0 * share(F.substring(title, 1, most)) + share(F.substring(text, 1, body))


def split_sections(docs: DataFrame) -> DataFrame:
    """(id, ord, title, kind, start, text): markdown headings as boundaries; revision carries on until a heading that names something else."""
    lines = docs.select("id", F.posexplode(F.split("md", "\n")).alias("line", "s"))
    w = W.partitionBy("id").orderBy("line")
    title = F.regexp_extract("s", r"^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    x = lines.withColumn("title", F.when(title != "", title)).withColumn("ord", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(w))
    g = x.groupBy("id", "ord").agg(F.max("title").alias("title"), F.min("line").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("line", "s")))), lambda y: y["s"]), "\n").alias("text"))
    revision = F.col("title").rlike("(?i)revis|exercise|summary|review|practice")
    kind = F.last(F.when(revision, "revision").when(F.col("title").isNotNull(), "teaching"), ignorenulls=True).over(W.partitionBy("id").orderBy("ord"))
    return g.withColumn("kind", F.coalesce(kind, F.lit("teaching")))


def partition_by_topics(md: str, names: list[str], least: float = 0.5) -> list[tuple[int, int]]:
    """Spans that tile the text, one a topic: anchors are headings that cover a name, taken in order; the rest is interpolated."""

    def stems(s):
        return {t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t for t in re.findall(r"\w+", s.lower()) if t not in T.STOPWORDS}

    heads = [(m.start(), stems(m[1])) for m in re.finditer(r"(?m)^#{1,6}[ \t]+(.+)$", md)]
    anchors: list[int | None] = []
    cursor = 0
    for name in names:
        want, hit = stems(name), None
        for j in range(cursor, len(heads)):
            if want and len(want & heads[j][1]) / len(want) >= least:
                hit, cursor = heads[j][0], j + 1
                break
        anchors.append(hit)
    n, out = len(md), []
    known = [(-1, 0)] + [(i, a) for i, a in enumerate(anchors) if a is not None] + [(len(names), n)]
    for (i, a), (j, b) in zip(known, known[1:], strict=False):
        for k in range(max(i, 0), j):
            out.append(a if k == i else a + (b - a) * (k - max(i, 0)) // max(1, j - max(i, 0)))
    if out:
        out[0] = 0
    return list(zip(out, [*out[1:], n], strict=True)) if out else []
