"""Audits and reports over question banks: each takes DataFrames and returns findings as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import education as E
from quillspark.functions import scoring
from quillspark.functions import text as T
from quillspark.operators.parsing import section_score
from quillspark.operators.relational import similar_sets, top_k
from quillspark.operators.rules import Rule, check

# Difficulty rungs, with the Bloom levels and the depth that each allows.
LADDER = {"easy": (("Remember", "Understand"), 1), "medium": (("Understand", "Apply"), 2), "hard": (("Analyze", "Evaluate", "Create"), 3)}


#: How many times the longest other option, and characters more, a key may have.
LENGTH_TELL = 1.35, 8


def choice_rules(stem: Column, options: Column, key: Column, difficulty: Column, level: Column, dok: Column) -> list[Rule]:
    """Rules of a generated choice item: the length tell, vague and repeated options, a stem that gives the key away, the ladder."""
    n = F.size(options)
    others = F.filter(options, lambda o: o != key)
    longest = F.array_max(F.transform(others, lambda o: F.char_length(o)))
    vague = lambda o: F.lower(o).rlike(r"^\s*(all|none|both)\b.*\b(above|these)\b")
    stem_words = F.split(E.norm_option(stem), " ")
    echoes = lambda o: F.size(F.filter(F.split(E.norm_option(o), " "), lambda w: F.char_length(w) > 5)).__gt__(0) & F.forall(F.filter(F.split(E.norm_option(o), " "), lambda w: F.char_length(w) > 5), lambda w: F.array_contains(stem_words, w))
    allowed = F.when(F.lit(False), F.lit(True))
    depth = F.lit(None).cast("int")
    for rung, (levels, d) in LADDER.items():
        allowed = allowed.when(difficulty == rung, level.isin(*levels))
        depth = F.coalesce(depth, F.when(difficulty == rung, F.lit(d)))
    return [
        Rule("short_stem", "error", (F.size(F.split(F.trim(stem), r"\s+")) < 2) | (F.char_length(F.trim(stem)) < 8)),
        Rule("option_count", "error", n != 4),
        Rule("empty_option", "error", F.exists(options, lambda o: F.trim(o) == "")),
        Rule("same_options", "error", F.size(F.array_distinct(F.transform(options, E.norm_option))) < n),
        Rule("no_key", "error", F.size(F.filter(options, lambda o: o == key)) != 1),
        Rule("length_tell", "error", F.char_length(key) > longest * LENGTH_TELL[0] + LENGTH_TELL[1]),
        Rule("vague_options", "error", (F.size(F.filter(options, vague)) > 1) | vague(key)),
        Rule("gives_key_away", "error", echoes(key) & ~F.exists(others, echoes)),
        Rule("no_such_difficulty", "error", ~difficulty.isin(*LADDER)),
        Rule("bloom", "error", ~F.coalesce(allowed, F.lit(True))),
        Rule("dok", "error", dok != depth),
    ]


def written_rules(stem: Column, form: Column, answer: Column) -> list[Rule]:
    """Rules of an item that is answered in prose."""
    return [
        Rule("no_answer", "error", F.trim(F.coalesce(answer, F.lit(""))) == ""),
        Rule("short_answer", "error", (F.trim(answer) != "") & (F.size(F.split(F.trim(answer), r"\s+")) < F.when(form == "long", 20).when(form == "short", 8).otherwise(1))),
        Rule("needs_options", "error", form.isin("mcq", "assertion_reason")),
        Rule("no_blank", "error", (form == "fill_blank") & ~stem.contains("___")),
        Rule("no_pairing", "error", (form == "match_following") & ~answer.contains("-") & ~answer.contains(",")),
    ]


def answer_keys(items: DataFrame) -> DataFrame:
    """(id, fidelity, letter_vs_value, value_vs_marked) of items (id, options, marked, payload_options, answer_text); null where it can't be checked.

    fidelity: stored options equal the source's; the others: the answer's letter, its value and the marked option name the same option.
    """
    letter, value = E.answer_letter(F.col("answer_text")), E.answer_value(F.col("answer_text"))
    norm = lambda c: F.transform(F.col(c), E.norm_option)
    fidelity = F.when(F.col("payload_options").isNotNull(), F.array_sort(norm("options")) == F.array_sort(norm("payload_options")))
    by_letter = F.when((letter >= 0) & (letter < F.size("payload_options")), F.element_at("payload_options", letter + 1))
    x = items.select("id", fidelity.alias("fidelity"), by_letter.alias("l"), value.alias("v"), "options", "marked")
    fits = F.filter("options", lambda o: E.names_option(F.col("v"), o))
    return x.select(
        "id", "fidelity", F.when(F.col("l").isNotNull() & F.col("v").isNotNull(), E.names_option(F.col("v"), F.col("l"))).alias("letter_vs_value"),
        F.when(F.col("v").isNotNull() & (F.size(fits) == 1), F.element_at(fits, 1) == F.col("marked")).alias("value_vs_marked"),
    )


def answer_binding(items: DataFrame) -> DataFrame:
    """By group: rows, scored and unrelated, of items (grp, stem, answer): answers that share no word with their stem, where both have four."""
    a, b = F.array_distinct(T.tokens("stem")), F.array_distinct(T.tokens("answer"))
    scored = (F.size(a) >= 4) & (F.size(b) >= 4)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return items.groupBy("grp").agg(F.count("*").alias("rows"), n(scored).alias("scored"), n(scored & (F.size(F.array_intersect(a, b)) == 0)).alias("unrelated"))


#: The lean and the share of aligned rows that make a file suspect, and the run that does.
LEAN, ALIGNED, RUN = 0.35, 0.5, 6


def alignment(links: DataFrame) -> DataFrame:
    """By file: rows judged, aligned, leaning to the next and to the previous row, the longest run of one lean, and suspect.

    Input (file, ord, probe, stem): token sets. Suspect: a lean of .35 with under half aligned, or a run of six.
    """
    w = W.partitionBy("file").orderBy("ord")
    over = lambda b: F.when(F.size("probe").isNull() | (F.size("probe") == 0) | b.isNull() | (F.size(b) == 0), F.lit(-1.0)).otherwise(F.size(F.array_intersect("probe", b)) / F.size("probe"))
    x = links.withColumn("_n", F.lead("stem").over(w)).withColumn("_p", F.lag("stem").over(w))
    x = x.select("file", "ord", over(F.col("stem")).alias("o"), over(F.col("_n")).alias("n"), over(F.col("_p")).alias("p")).filter("o >= 0")
    x = x.withColumn("d", F.when((F.col("o") >= F.col("n")) & (F.col("o") >= F.col("p")), "h").when((F.col("n") > F.col("o")) & (F.col("n") >= F.col("p")), "a").otherwise("b"))
    x = x.withColumn("_c", F.when(F.lag("d").over(w) == F.col("d"), 0).otherwise(1)).withColumn("run", F.sum("_c").over(w))
    runs = x.groupBy("file", "run", "d").agg(F.count("*").alias("k"))
    n = lambda d: F.coalesce(F.sum(F.when(F.col("d") == d, F.col("k"))), F.lit(0)).alias
    g = runs.groupBy("file").agg(F.sum("k").alias("judged"), n("h")("here"), n("a")("ahead"), n("b")("behind"), F.coalesce(F.max(F.when(F.col("d") != "h", F.col("k"))), F.lit(0)).alias("longest"))
    lean = F.greatest("ahead", "behind") / F.col("judged")
    return g.withColumn("suspect", ((lean >= LEAN) & (F.col("here") / F.col("judged") < ALIGNED)) | (F.col("longest") >= RUN))


def misfiled_blocks(items: DataFrame, gap: int = 150, least: int = 5, chapter_least: int = 12, most: float = 0.12) -> DataFrame:
    """Runs of ids within a chapter (chapter, id, text) whose 40 commonest words hardly occur among those of its largest run."""
    w = W.partitionBy("chapter").orderBy("id")
    x = items.withColumn("_j", F.when(F.col("id") - F.lag("id").over(w) > gap, 1).otherwise(0)).withColumn("run", F.sum("_j").over(w))
    runs = x.groupBy("chapter", "run").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    chapters = runs.groupBy("chapter").agg(F.sum("n").alias("total"), F.count("*").alias("runs"), F.max_by("run", F.struct("n", -F.col("run"))).alias("main")).filter((F.col("total") >= chapter_least) & (F.col("runs") > 1))
    tf = x.join(chapters.select("chapter"), "chapter", "left_semi").select("chapter", "run", F.explode(F.filter(T.tokens("text"), lambda t: t.rlike(r"^[\p{L}\p{M}]{3,}$"))).alias("w")).groupBy("chapter", "run", "w").count()
    top = top_k(tf, ["chapter", "run"], [F.desc("count"), F.col("w")], 40)
    vocab = top.groupBy("chapter", "run").agg(F.collect_list("w").alias("v"))
    a = runs.join(chapters.select("chapter", "main"), "chapter").filter((F.col("run") != F.col("main")) & (F.col("n") >= least))
    v = vocab.select("chapter", F.col("run").alias("_r"), F.col("v").alias("main_v"))
    y = a.join(vocab, ["chapter", "run"], "left").join(v, (a["chapter"] == v["chapter"]) & (a["main"] == v["_r"]), "left").drop(v["chapter"])
    share = F.when(F.coalesce(F.least(F.size("v"), F.size("main_v")), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.array_intersect("v", "main_v")) / F.least(F.size("v"), F.size("main_v")))
    return y.withColumn("overlap", share).filter(F.col("overlap") <= most).select("chapter", "first", "last", "n", "overlap")


def concept_scores(concepts: DataFrame, profile: str = "content") -> DataFrame:
    """(id, value, status) of concepts (id, name, quote, slice, chapter, nearest and, where there is a curriculum, mapped, outcomes, has_curriculum, errors, warnings).

    ``nearest`` is the greatest containment among siblings (null without any), ``mapped`` the best score of a mapped
    outcome, ``outcomes`` the outcomes' text. ``errors`` and ``warnings`` of an audit cost what they cost.
    """
    given = lambda c, kind: F.col(c) if c in concepts.columns else F.lit(None).cast(kind)
    own = T.coverage(T.stems("name"), T.stems("slice"))
    outcomes = given("outcomes", "string")
    served = F.when(outcomes.isNotNull(), T.coverage(T.stems("name"), T.stems(outcomes)))
    parts = scoring.concept_parts(T.grounded(F.col("quote"), F.col("chapter")), T.grounded(F.col("quote"), F.col("slice")), own, F.col("nearest"), given("mapped", "double"), served, F.coalesce(given("has_curriculum", "boolean"), F.lit(False)))
    penalty = {k: F.coalesce(given(k, "int"), F.lit(0)) for k in ("errors", "warnings")}
    return concepts.select("id", scoring.confidence(parts, profile, **penalty).alias("value")).withColumn("status", scoring.band(F.col("value")))


def topic_scores(topics: DataFrame) -> DataFrame:
    """(id, value, status) of topics (id, name, quote, chapter, outline): the chapter's outline is null where it prints none."""
    cover = T.coverage(T.stems("name"), T.stems("chapter"))
    outline = F.when(F.col("outline").isNotNull(), T.coverage(T.stems("name"), T.stems("outline")))
    parts = scoring.topic_parts(T.grounded(F.col("quote"), F.col("chapter")), cover, outline)
    return topics.select("id", scoring.confidence(parts).alias("value")).withColumn("status", scoring.band(F.col("value")))


def nearest_sibling(names: DataFrame) -> DataFrame:
    """(id, nearest): the greatest containment with another name of the same group (grp, id, name), a chapter's; ids meet on shared words, and counts of them say how much is shared."""
    s = names.select("grp", "id", T.subject_tokens("name").alias("s"))
    e = s.select("grp", "id", F.size("s").alias("n"), F.explode("s").alias("x"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.id") != F.col("b.id")))
    shared = pairs.groupBy(F.col("a.id").alias("id"), F.col("b.id").alias("other")).agg((F.count("*") / F.least(F.first("a.n"), F.first("b.n"))).alias("c"))
    return shared.groupBy("id").agg(F.max("c").alias("nearest"))


#: Fixed values of the audit: coverage from which a topic is grounded, and weakly so; coverage from which a concept belongs
#: to its topic; minutes that may be missing; topics of a chapter; characters of a topic, and of a section that needs one.
GROUNDED, WEAK, BELONGS, MINUTES, TOPICS, TOPIC_CHARS, SECTION_CHARS = 0.6, 0.35, 0.4, 2, (3, 10), 800, 400


def duplicate_names(names: DataFrame) -> DataFrame:
    """(grp, a, b), a < b: names (grp, id, name) of a group that are one unit; they meet on their rarer stems only."""
    s = names.select("grp", "id", T.subject_tokens("name").alias("s"))
    keyed = s.select(F.struct("grp", "id").alias("k"), F.transform("s", lambda x: F.concat_ws("\x00", F.col("grp").cast("string"), x)).alias("keys"))
    met = similar_sets(keyed, "k", "keys", T.DUPLICATE).select("a", "b")
    of = lambda k: s.select(F.struct("grp", "id").alias(k), F.col("s").alias(f"{k}_s"))
    pairs = met.join(of("a"), "a").join(of("b"), "b").filter(T.is_duplicate(F.col("a_s"), F.col("b_s")))
    return pairs.select(F.col("a.grp").alias("grp"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def audit_chapters(topics: DataFrame, concepts: DataFrame, chapters: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Issues (chapter, check, severity, ids) of eight checks.

    Inputs: topics (chapter, id, name, shown, minutes, start, end), concepts (chapter, topic_id, id, name, minutes),
    chapters (chapter, title, md, semantic: array of names, or null), and sections (chapter, ord, title, kind, text) as
    ``parsing.split_sections`` gives them, with an authoritative outline's chapters left out of the coverage check by
    ``numbered`` (boolean, in chapters, if there). Checks: grounding, relevance (revision blocks, repeated topics and
    concepts), attribution, coverage, granularity, hierarchy (childless, minutes), semantic.
    """
    none = F.array().cast("array<bigint>")
    live = topics.filter(F.coalesce("shown", F.lit(True)))
    issue = lambda df, name, severity, ids=none: df.select("chapter", F.lit(name).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), ids.cast("array<bigint>").alias("ids"))
    one = F.array("id")
    text = chapters.select("chapter", "md", T.stems("md").alias("have"))
    out = []
    cover = live.join(text, "chapter").withColumn("c", T.coverage(T.stems("name"), F.col("have")))
    out.append(issue(cover.filter(F.col("c") < GROUNDED), "grounding", F.when(F.col("c") >= WEAK, "warning").otherwise("error"), one))
    # attribution: one issue where a chapter has no topics at all, else one for each concept that is loose or lies elsewhere
    known = topics.select(F.col("chapter").alias("_c"), F.col("id").alias("topic_id"), F.coalesce("shown", F.lit(True)).alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    any_topic = topics.select("chapter").distinct()
    out.append(issue(concepts.join(any_topic, "chapter", "left_anti").select("chapter").distinct(), "attribution", "error"))
    c = concepts.join(any_topic, "chapter", "left_semi").alias("c")
    c = c.join(known.alias("t"), (F.col("c.chapter") == F.col("t._c")) & (F.col("c.topic_id") == F.col("t.topic_id")), "left").select("c.*", "_c", "_s", "_a", "_b")
    out.append(issue(c.filter(F.col("_c").isNull() | ~F.col("_s")), "attribution", "error", one))
    own = c.filter(F.col("_s") & F.col("_a").isNotNull()).join(text.select("chapter", "md"), "chapter")
    span = F.substring(F.col("md"), F.col("_a") + 1, F.col("_b") - F.col("_a"))
    out.append(issue(own.filter(T.coverage(T.stems("name"), T.stems(span)) < BELONGS), "attribution", "warning", one))
    # relevance: repeated names; under one topic they only overlap
    twice = duplicate_names(live.select(F.col("chapter").alias("grp"), "id", "name"))
    out.append(issue(twice.withColumnRenamed("grp", "chapter"), "relevance", "error", F.array("a", "b")))
    twice = duplicate_names(concepts.filter("topic_id IS NOT NULL").select(F.col("chapter").alias("grp"), "id", "name"))
    of = lambda k: concepts.select(F.col("chapter").alias("grp"), F.col("id").alias(k), F.col("topic_id").alias(f"{k}_t"))
    twice = twice.join(of("a"), ["grp", "a"]).join(of("b"), ["grp", "b"]).withColumnRenamed("grp", "chapter")
    out.append(issue(twice, "relevance", F.when(F.col("a_t") == F.col("b_t"), "warning").otherwise("error"), F.array("a", "b")))
    # granularity
    out.append(issue(live.filter(F.col("end") - F.col("start") < TOPIC_CHARS), "granularity", "warning", one))
    counts = live.groupBy("chapter").agg(F.count("*").alias("n"))
    out.append(issue(counts.filter((F.col("n") > TOPICS[1]) | (F.col("n") < TOPICS[0])), "granularity", F.when(F.col("n") > TOPICS[1], "error").otherwise("warning")))
    # hierarchy
    under = concepts.groupBy("chapter", F.col("topic_id").alias("id")).agg(F.sum(F.coalesce("minutes", F.lit(0))).alias("_m"))
    held = live.join(under, ["chapter", "id"], "left")
    out.append(issue(held.filter(F.col("_m").isNull()), "hierarchy", "error", one))
    out.append(issue(held.filter((F.coalesce("minutes", F.lit(0)) > 0) & (F.abs(F.col("_m") - F.col("minutes")) > MINUTES)), "hierarchy", "warning", one))
    # coverage and revision, by each topic's best section
    if sections is not None:
        s = sections.filter("title IS NOT NULL").select("chapter", "ord", "title", "kind", "text")
        target = live.select("chapter", "id", "name", F.array_distinct(T.tokens("name")).alias("want"))
        scored = target.join(s, "chapter").withColumn("score", section_score(F.col("want"), F.col("title"), F.col("text")))
        home = scored.groupBy("chapter", "id").agg(F.max_by(F.struct("ord", "kind"), F.struct("score", -F.col("ord"))).alias("h"))
        out.append(issue(home.filter("h.kind = 'revision'"), "relevance", "error", one))
        open_ = chapters.filter(~F.coalesce("numbered", F.lit(False))) if "numbered" in chapters.columns else chapters
        named = open_.select("chapter", T.normalise_name("title").alias("_title"))
        taught = s.filter((F.col("kind") == "teaching") & (F.char_length("text") >= SECTION_CHARS)).join(named, "chapter").filter(T.normalise_name("title") != F.col("_title"))
        claimed = home.select("chapter", F.col("h.ord").alias("ord"))
        said = scored.filter(T.coverage(T.stems("name"), T.stems("title")) >= 0.5).select("chapter", "ord")
        out.append(issue(taught.join(claimed.union(said).distinct(), ["chapter", "ord"], "left_anti"), "coverage", "error", F.array("ord")))
    # semantic scope: names of the semantic payload that are no topic's or concept's
    out.append(issue(chapters.filter(F.col("semantic").isNull()), "semantic", "warning"))
    told = chapters.select("chapter", F.posexplode("semantic").alias("k", "name"))
    both = told.select(F.col("chapter").alias("grp"), (-F.col("k") - 1).cast("long").alias("id"), "name").unionByName(live.select(F.col("chapter").alias("grp"), F.col("id").cast("long").alias("id"), "name")).unionByName(concepts.select(F.col("chapter").alias("grp"), (F.col("id").cast("long") + (1 << 40)).alias("id"), "name"))
    met = duplicate_names(both).filter((F.col("a") < 0) & (F.col("b") >= 0)).select(F.col("grp").alias("chapter"), F.col("a").alias("k")).distinct().groupBy("chapter").agg(F.count("*").alias("m"))
    share = told.groupBy("chapter").agg(F.count("*").alias("n")).join(met, "chapter", "left").filter(F.coalesce("m", F.lit(0)) < 0.5 * F.col("n"))
    out.append(issue(share, "semantic", "warning"))
    return reduce(DataFrame.unionByName, out)


def verdicts(issues: DataFrame) -> DataFrame:
    """By chapter: errors, warnings, passed; worst first."""
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).cast("long")
    return issues.groupBy("chapter").agg(n("error").alias("errors"), n("warning").alias("warnings")).withColumn("passed", F.col("errors") == 0).orderBy(F.desc("errors"), F.desc("warnings"), "chapter")


def legacy_audit(concepts: DataFrame, budgets: DataFrame) -> DataFrame:
    """By chapter, the worst first: topics, concepts, distinct, duplicate_rows, target, ceiling, over_budget_by, mean_confidence, below_flag.

    Only what can be told without quotes is scored: concepts (chapter, topic_id, id, name, slice, outcomes or null);
    budgets as ``planning.chapter_budget`` gives them.
    """
    near = nearest_sibling(concepts.select(F.struct("chapter", "topic_id").alias("grp"), "id", "name"))
    x = concepts.join(near, "id", "left").select("*", F.lit("").alias("quote"), F.lit("").alias("chapter_text"))
    own = T.coverage(T.stems("name"), T.stems("slice"))
    served = F.when(F.col("outcomes").isNotNull(), T.coverage(T.stems("name"), T.stems("outcomes")))
    no = F.lit(False)
    parts = scoring.concept_parts(no, no, own, F.col("nearest"), F.lit(None).cast("double"), served, no)
    x = x.select("chapter", "topic_id", "name", scoring.confidence({k: parts[k] for k in scoring.WEIGHTS["deterministic_backfill"]}, "deterministic_backfill").alias("value"))
    g = x.groupBy("chapter").agg(
        F.count_distinct("topic_id").alias("topics"), F.count("*").alias("concepts"), F.count_distinct("name").alias("distinct"),
        F.bround(F.avg("value"), 3).alias("mean_confidence"), F.sum(F.when(F.col("value") < scoring.FLAG, 1).otherwise(0)).cast("long").alias("below_flag"),
    )
    g = g.join(budgets.select("chapter", "target", "ceiling"), "chapter", "left").withColumn("duplicate_rows", F.col("concepts") - F.col("distinct"))
    return g.withColumn("over_budget_by", F.greatest(F.lit(0), F.col("distinct") - F.col("ceiling"))).orderBy("mean_confidence", "chapter")


def merge_parts(items: DataFrame) -> DataFrame:
    """Adds label to items (book, part, number): where two parts or more begin at 2 or less, numbers restart, so the part qualifies them."""
    first = items.groupBy("book", "part").agg(F.min("number").alias("_f")).groupBy("book").agg(F.sum(F.when(F.col("_f") <= 2, 1).otherwise(0)).alias("_n"))
    return items.join(first, "book").withColumn("label", F.when(F.col("_n") >= 2, F.concat_ws(".", "part", "number")).otherwise(F.col("number").cast("string"))).drop("_n")


def rule_plan(rows: DataFrame, rules: list[tuple[int, str]], col: str) -> DataFrame:
    """Adds target: the id of the one rule (id, pattern) that a row's text matches; null when none or several do."""
    hits = F.filter(F.array(*[F.when(F.col(col).rlike(p), F.lit(i)) for i, p in rules]), lambda x: x.isNotNull())
    return rows.withColumn("target", F.when(F.size(hits) == 1, F.element_at(hits, 1)))


def load_shape(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Adds hold (the first reason to hold an item back, null when it may load) to items (id, stem, options, key, has_figure): against a bank (stem, sha256)."""
    x = items.withColumn("_h", T.item_hash("stem", "options")).withColumn("_p", F.substring(T.normalise_name("stem"), 1, 60))
    known_h = bank.select(F.col("sha256").alias("_h")).distinct().withColumn("_kh", F.lit(True))
    known_p = bank.select(F.substring(T.normalise_name("stem"), 1, 60).alias("_p")).distinct().withColumn("_kp", F.lit(True))
    x = x.join(known_h, "_h", "left").join(known_p, "_p", "left")
    w = W.partitionBy("_h").orderBy("id")
    x = x.withColumn("_first", F.row_number().over(w) == 1)
    reason = (
        F.when(F.trim("stem") == "", "empty stem").when(F.col("_kh"), "in the bank").when(F.col("_kp"), "begins like one in the bank").when(~F.col("_first"), "repeated in the batch")
        .when((F.size("options") > 0) & F.col("key").isNull(), "no key").when(F.col("has_figure"), "needs its figure").when(F.size(E.damage("stem")) > 0, "damaged")
    )
    return x.withColumn("hold", reason).drop("_h", "_p", "_kh", "_kp", "_first")


def latest_runs(ledger: DataFrame, heartbeat: Column, stale_minutes: int = 60) -> DataFrame:
    """By run: total, done, failed, skipped, running, percent, state, human duration, of ledger rows (run_id, key, status, at)."""
    last = ledger.groupBy("run_id", "key").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("a"), F.max("at").alias("b"))
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long").alias(s)
    g = last.groupBy("run_id").agg(F.count("*").alias("total"), n("done"), n("failed"), n("skipped"), n("running"), F.min("a").alias("started"), F.max("b").alias("ended"))
    old = F.col("ended") < heartbeat - F.expr(f"interval {stale_minutes} minutes")
    state = F.when((F.col("running") > 0) & old, "stuck").when(F.col("running") > 0, "running").when(F.col("done") + F.col("skipped") == F.col("total"), "complete").otherwise("partial")
    seconds = F.unix_timestamp("ended") - F.unix_timestamp("started")
    return g.withColumn("percent", F.round(100.0 * (F.col("done") + F.col("skipped")) / F.col("total"), 1)).withColumn("state", state).withColumn("took", E.human_duration(seconds))


def checked(items: DataFrame, rules: list[Rule]) -> DataFrame:
    return check(items, rules)
