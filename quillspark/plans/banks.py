"""Queries of question banks, curricula, layouts, plans and audits over the driver's tables, each with an independent SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import education as E
from quillspark.functions import scoring
from quillspark.functions import text as T
from quillspark.operators import audits, bank, curriculum, layout, parsing, planning, relational, rules
from quillspark.plans.registry import query
from quillspark.session import table
from quillspark.streaming import ledger


def _s(c):
    return F.col(c).cast("string")


# --- text and numbers


@query(r"SELECT s_suppkey, ['Citie', 'gas', 'class', 'box'][s_suppkey % 4 + 1] AS w, ['citie', 'gas', 'class', 'box'][s_suppkey % 4 + 1] AS folded, s_suppkey % 3 <> 0 AS same FROM supplier")
def t10_duplicate_names(spark, sf_dir):
    """Folding of names, and whether two names are one unit: a discriminator word keeps them apart."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("Citie", "gas", "class", "box")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    other = F.when(F.col("s_suppkey") % 3 == 0, "Lowest common multiples").otherwise("The common multiples")
    same = T.is_duplicate(T.subject_tokens(F.lit("Common multiples")), T.subject_tokens(other))
    return table(spark, sf_dir, "supplier").select("s_suppkey", word.alias("w"), F.array_join(T.tokenise(word), " ").alias("folded"), same.alias("same"))


@query("SELECT c_custkey, round(CAST(len(list_intersect(w, ['building', 'customer', 'nation'])) AS DOUBLE) / 3, 6) AS cover, round(CAST(len(list_intersect(w, ['building', 'customer', 'nation'])) AS DOUBLE) / least(3, len(w)), 6) AS inside FROM (SELECT c_custkey, [lower(c_mktsegment), 'customer'] AS w FROM customer)")
def t08_t09_coverage(spark, sf_dir):
    w = T.stems(F.concat("c_mktsegment", F.lit(" of the customer")))
    want = T.stems(F.lit("nation building customer"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(T.coverage(want, w), 6).alias("cover"), F.round(T.containment(want, w), 6).alias("inside"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + 1.0::DOUBLE AS score FROM part")
def t11_section_score(spark, sf_dir):
    """A section's heading counts three times its body: here the body always holds the part's words, the heading every second time."""
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("On the "), "p_name")).otherwise("Overview")
    body = F.concat(F.lit("We sell a "), "p_name", F.lit(" today."))
    return table(spark, sf_dir, "part").select("p_partkey", parsing.section_score(F.array_distinct(T.tokens("p_name")), title, body).alias("score"))


@query("SELECT c_custkey, c_acctbal > 9000 AS found FROM customer")
def t13_number_in(spark, sf_dir):
    """A number counts as found only as a whole number, not inside a longer one."""
    pool = F.when(F.col("c_acctbal") > 9000, F.concat(F.lit("costs 112 and "), _s("c_custkey"), F.lit(" units"))).otherwise(F.concat(F.lit("costs 9"), _s("c_custkey"), F.lit("7")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.number_in(pool, _s("c_custkey")).alias("found"))


@query(r"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'cafe' WHEN 1 THEN 'the end' ELSE 'customer ' || c_custkey END AS folded FROM customer")
def t15_fold(spark, sf_dir):
    """Accents and repeated words folded."""
    t = F.when(F.col("c_custkey") % 3 == 0, "Café").when(F.col("c_custkey") % 3 == 1, "the the END").otherwise(F.concat(F.lit("Customer "), _s("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.fold(E.squeeze(t)).alias("folded"))


@query("SELECT s_suppkey, sha256('offer of ' || lower(replace(s_name, '#', ' ')) || '|' || CASE WHEN s_suppkey % 2 = 0 THEN 'cash|credit' ELSE 'cash|credit|gift' END) AS h FROM supplier")
def t17_item_hash(spark, sf_dir):
    """One question whatever the order of its options."""
    options = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Credit"), F.lit("cash"))).otherwise(F.array(F.lit("gift"), F.lit("Cash"), F.lit("credit!")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.item_hash(F.concat(F.lit("Offer of "), "s_name"), options).alias("h"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN 'latin' WHEN o_orderkey % 4 = 2 THEN 'devanagari' ELSE 'mixed' END AS script FROM orders")
def t22_script_of(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    latin, deva = F.lit("the quick brown fox jumps over it"), F.lit("यह एक बहुत ही लंबा और सरल वाक्य है जो सबके काम आता है")
    t = F.when(k == 0, "ab कख").when(k == 1, latin).when(k == 2, deva).otherwise(F.concat(F.substring(latin, 1, 24), F.lit(" "), deva))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.script_of(t).alias("script"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity * 0.5::DOUBLE, 0) AS BIGINT) AS half_even FROM lineitem")
def n01_half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") * 0.5, 0).cast("long").alias("half_even"))


@query("SELECT n_nationkey, CAST(25 + CASE WHEN n_nationkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN n_nationkey % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN n_nationkey % 4 = 0 THEN 15 ELSE 0 END + CASE WHEN n_nationkey % 6 = 0 THEN 10 ELSE 0 END AS INTEGER) AS score FROM nation")
def n04_structure_score(spark, sf_dir):
    k = F.col("n_nationkey")
    flag = lambda m: F.when(k % m == 0, 1).otherwise(0)
    md = F.concat("n_name", F.when(k % 4 == 0, F.lit(" $x$")).otherwise(""), F.when(k % 6 == 0, F.lit(" प्रकाश")).otherwise(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", scoring.structure_score(F.lit(1), flag(2), flag(3), flag(5), F.lit(0), md).alias("score"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN 2.0::DOUBLE ELSE 0 END + least(1.0::DOUBLE, (c_custkey % 5) / 4.0::DOUBLE / 0.6::DOUBLE) + 0.5::DOUBLE * (c_custkey % 3) / 2 + CASE WHEN c_custkey % 7 >= 4 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN c_custkey % 11 = 0 THEN 1.0::DOUBLE ELSE 0 END, 3) AS score FROM customer")
def n05_keep_score(spark, sf_dir):
    k = F.col("c_custkey")
    score = scoring.keep_score(k % 2 == 0, (k % 5) / 4, (k % 3) / 2, (k % 7) / 8, k % 11 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


_PAIRS = "SELECT a.conv_id AS grp, a.conv_id * 100 + a.turn AS id, b.conv_id * 100 + b.turn AS other, a.w AS aw, b.w AS bw FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn"
_W = "w AS (SELECT conv_id, turn, list_distinct(list_transform(string_split(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), ' '), lambda x: 'w' || substring(x, 1, 2))) AS w FROM conversations)"


@query(f"WITH {_W} SELECT id, CAST(floor(1000 * max(CAST(len(list_intersect(aw, bw)) AS DOUBLE) / least(len(aw), len(bw)))) AS BIGINT) AS milli FROM ({_PAIRS}) WHERE len(list_intersect(aw, bw)) > 0 GROUP BY id")
def n06_nearest_sibling(spark, sf_dir):
    """The greatest containment with another turn of the same talk (of the first two letters of its first words)."""
    first = F.array_distinct(F.transform(F.slice(F.split(F.lower("text"), " "), 1, 3), lambda x: F.concat(F.lit("w"), F.substring(x, F.lit(1), F.lit(2)))))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("grp"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), first.alias("s"))
    plain = c.filter(F.forall("s", lambda x: x.rlike(r"^[\p{L}\p{N}]+$") & ~x.endswith("s")) & (F.size("s") > 0))
    odd = c.join(plain.select("id"), "id", "left_anti")
    coded = lambda d: d.withColumn("name", F.array_join(F.transform("s", lambda x: F.concat(F.lit("q"), F.md5(x), F.lit("z"))), " "))
    both = coded(plain).unionByName(coded(odd))  # words as codes, so that folding changes none
    return audits.nearest_sibling(both.select("grp", "id", "name")).select("id", F.floor(1000 * F.col("nearest")).alias("milli"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS at FROM orders")
def d05_parse_iso(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 3 == 0, "not a time").when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.parse_iso(t).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) < 510 THEN CAST(ts AS DATE) + INTERVAL 510 MINUTE ELSE CAST(ts AS DATE) + INTERVAL 1950 MINUTE END AS due FROM events WHERE event_id % 10 = 0 AND second(ts) > 0")
def d06_deadline(spark, sf_dir):
    """The next half past eight."""
    e = table(spark, sf_dir, "events").filter("event_id % 10 = 0 AND second(ts) > 0").withColumn("now", F.col("ts").cast("timestamp"))
    return e.select("event_id", E.deadline(F.col("now"), F.lit(8), F.lit(30)).cast("timestamp_ntz").alias("due"))


@query("SELECT DISTINCT day FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 2 = 0 AS generic FROM orders) WHERE NOT (generic AND isodow(day) = 6)")
def d07_holidays(spark, sf_dir):
    """Days off, but a generic "holiday" on a Saturday."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, " Holiday").otherwise("Harvest day").alias("title"))
    return planning.holidays(o)


@query(
    "WITH t AS (SELECT r_regionkey AS term, sum(r_regionkey + 2) OVER (ORDER BY r_regionkey) AS upto, sum(r_regionkey + 2) OVER () AS every, r_regionkey + 2 AS days FROM region), c AS (SELECT n_nationkey AS chapter, row_number() OVER (ORDER BY n_nationkey) - 0.5 AS pos, count(*) OVER () AS n FROM nation) "
    "SELECT term, chapter FROM t JOIN c ON pos * every > (upto - days) * n AND pos * every <= upto * n"
)
def d09_term_slices(spark, sf_dir):
    """Chapters dealt over terms in proportion to their days."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("term"), (F.col("r_regionkey") + 2).alias("days"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chapter"), F.col("n_nationkey").alias("ord"))
    return planning.term_slices(n, r)


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY coalesce(l.quality, 0), d.doc_id LIMIT 40")
def o02_default_zero(spark, sf_dir):
    """Rows without a place sort as if theirs were 0."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(0)).alias("q")).orderBy("q", "doc_id").limit(40)


# --- JSON


@query("SELECT c_custkey, 'deep' || chr(10) || c_mktsegment AS said, '{\"a\": {\"b\": [\"deep\"]}, \"s\": \"' || c_mktsegment || '\"}' AS kept FROM customer")
def m05_m06_nested(spark, sf_dir):
    """All strings in a nested value, and the value without a key at any depth."""
    j = F.concat(F.lit('{"a": {"x": "no", "b": ["deep", {"x": 1}]}, "s": "'), "c_mktsegment", F.lit('", "n": 3}'))
    c = table(spark, sf_dir, "customer").withColumn("j", j)
    return c.select("c_custkey", E.nested_text("j", "x").alias("said"), F.replace(F.replace(E.without_keys("j", "x", "n"), F.lit(", {}"), F.lit("")), F.lit("\\u"), F.lit("\\u")).alias("kept"))


@query("SELECT n_nationkey AS id, tag, CAST(i AS INTEGER) AS ord, CASE WHEN tag = 'a' THEN n_name || '-' || i ELSE n_name END AS name FROM nation, (VALUES ('a', 0), ('a', 1), ('b', 0)) t(tag, i) WHERE tag = 'a' OR n_nationkey % 2 = 0")
def m07_flatten(spark, sf_dir):
    one = lambda x: F.struct(x.alias("name"), F.lit(1).alias("weight"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.array(one(F.concat("n_name", F.lit("-0"))), one(F.concat("n_name", F.lit("-1")))).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.array(one(F.col("n_name")))).alias("b"))
    return E.flatten_tags(n, "n_nationkey", ("a", "b")).select("id", "tag", "ord", "name")


@query("SELECT o_orderkey, '{\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"n\":' || o_orderkey || ',\"none\":null}' AS j FROM orders")
def m10_plain_json(spark, sf_dir):
    v = F.struct(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").cast("decimal(12,0)").alias("n"), F.lit(None).cast("string").alias("none"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.plain_json(v).alias("j"))


@query("SELECT s_suppkey, ['A', 'B', 'C'][s_suppkey % 3 + 1] || ':' || ['x', s_name, 'y'][s_suppkey % 3 + 1] AS correct FROM supplier")
def m11_mark_correct(spark, sf_dir):
    options = F.array(F.lit("x"), F.col("s_name"), F.lit("y"))
    letter = F.substring(F.lit("abc"), (F.col("s_suppkey") % 3 + 1).cast("int"), F.lit(1))
    right = F.filter(E.mark_correct(options, letter), lambda o: o["is_correct"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(right, lambda o: F.concat(o["label"], F.lit(":"), o["text"])), ",").alias("correct"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '{\"answer_text\":\"new\",\"legacy_text\":\"' || s_name || '\"}' WHEN 1 THEN '{\"kind\":\"short\",\"answer_text\":\"new\"}' ELSE '{\"answer_text\":\"new\"}' END AS answer FROM supplier")
def m02_merged_envelope(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    old = F.when(k == 0, F.col("s_name")).when(k == 1, F.lit('{"kind":"short","answer_text":"old"}')).otherwise(F.lit(" "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", E.merged_envelope(old, F.lit("new")).alias("answer"))


@query("SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS fit, CASE WHEN s_suppkey % 3 = 0 THEN 4 WHEN s_suppkey % 3 = 1 THEN 3 ELSE 1 END AS level, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'WAVES OF LIGHT' END AS title FROM supplier")
def t26_t28_t29_items_and_headings(spark, sf_dir):
    """Whether an item fits a second role, a heading's level, and the title in a line that runs on."""
    k = F.col("s_suppkey")
    step = F.when(k % 4 == 0, "concept_diagnostic").when(k % 4 == 1, "adaptive_test").when(k % 4 == 2, "adaptive_diagnostic").otherwise("mastery_check")
    fit = E.fits(step, F.lit("HOTS"), F.lit("Medium"), F.lit("none"), F.lit(True))
    role, text = F.when(k % 3 == 2, "title").otherwise("heading"), F.when(k % 3 == 0, "2.1.4 Waves").otherwise("Waves")
    line = F.when(k % 3 == 0, "WAVES OF LIGHT A Light travels in").when(k % 3 == 1, "WAVES OF LIGHT In this section you will").otherwise("Work out 4 and 6")
    level = E.hierarchy_level(role, F.lit(None).cast("int"), text)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fit.alias("fit"), level.alias("level"), E.section_title(line).alias("title"))


# --- joins and windows that are operators


@query("SELECT n_regionkey AS grp, n_nationkey AS l, n_nationkey + 100 AS r, CASE WHEN n_nationkey % 3 = 0 THEN 'order' ELSE 'words' END AS how FROM nation")
def j17_align_names(spark, sf_dir):
    """Names matched one to one: by words, and what is left by place."""
    n = table(spark, sf_dir, "nation")
    word = F.concat(F.lit("subject"), _s("n_nationkey"), F.lit("x"))
    names = n.select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("l"), word.alias("name"))
    rows = n.select(F.col("n_regionkey").alias("grp"), (F.col("n_nationkey") + 100).alias("r"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("else")).otherwise(F.concat(F.lit("on the "), word)).alias("name"))
    return planning.align_names(names, rows).select(F.col("grp").cast("int").alias("grp"), F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"), "how")


_CUT = "SELECT n_nationkey AS id, r_regionkey AS ord, length(n_name) + 2 + r_regionkey * 13 AS s FROM nation, region"


@query(f"SELECT id, CAST(ord AS BIGINT) AS ord, CAST(CASE WHEN ord = 0 THEN 0 ELSE s END AS BIGINT) AS start, CAST(lead(s, 1, (SELECT count(*) FROM region) * 13 + 2 + len) OVER (PARTITION BY id ORDER BY ord) - CASE WHEN ord = (SELECT max(r_regionkey) FROM region) THEN 1 ELSE 0 END AS BIGINT) AS \"end\" FROM ({_CUT.replace('SELECT n_nationkey AS id', 'SELECT length(n_name) AS len, n_nationkey AS id')})")
def x03_topic_spans(spark, sf_dir):
    """Spans of topics that tile a chapter whose headings name them."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey"), F.concat(F.lit("# Topick"), _s("r_regionkey"), F.lit("\ntt")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "part"))), lambda x: x["part"]), "\n")
    docs = table(spark, sf_dir, "nation").crossJoin(r).groupBy(F.col("n_nationkey").cast("long").alias("id"), "n_name").agg(body.alias("b")).select("id", F.concat("n_name", F.lit("\n\n"), "b").alias("md"))
    topics = table(spark, sf_dir, "nation").crossJoin(table(spark, sf_dir, "region")).select(F.col("n_nationkey").cast("long").alias("id"), F.col("r_regionkey").alias("ord"), F.concat(F.lit("The topick"), _s("r_regionkey")).alias("name"))
    return parsing.topic_spans(docs, topics).select(F.col("id").cast("int").alias("id"), "ord", "start", "end")


@query("SELECT n_nationkey AS id, CAST(k AS INTEGER) AS ord, '2.' || k AS number, 'Mirror' || k || ' of ' || n_name AS title, n_nationkey % 5 >= 2 AS authoritative FROM nation, unnest(range(1, 6)) AS u(k) WHERE k <= n_nationkey % 5 + 1")
def x01_topic_outline(spark, sf_dir):
    """Sections that a chapter numbers itself; a repeated number or wording counts once."""
    k = F.explode(F.sequence(F.lit(1), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("k")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", k)
    line = F.concat(F.lit("## 2."), _s("k"), F.lit(" Mirror"), _s("k"), F.lit(" of "), "n_name", F.lit("\nSome text. 3.5 is a number.\n2."), _s("k"), F.lit(" Said again\n7."), _s("k"), F.lit("  mirror"), _s("k"), F.lit(" of "), F.lower("n_name"))
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("s")))), lambda x: x["s"]), "\n")
    return parsing.topic_outline(n.groupBy(F.col("n_nationkey").alias("id")).agg(md.alias("md"))).filter("number LIKE '2.%'").select("id", "ord", "number", "title", "authoritative")


@query(
    "WITH w AS (SELECT n_nationkey AS concept, unnest([n_nationkey % 5, n_nationkey % 7 + 10]) AS x FROM nation), o AS (SELECT s_suppkey AS outcome, unnest([s_suppkey % 5, s_suppkey % 11 + 8]) AS x FROM supplier WHERE s_suppkey < 40) "
    "SELECT concept, outcome, CAST(rank AS INTEGER) AS rank, CASE WHEN c = 2 THEN 0.45::DOUBLE ELSE 0.45::DOUBLE END AS score FROM (SELECT concept, outcome, count(*) AS c, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, outcome) AS rank FROM w JOIN o USING (x) GROUP BY 1, 2) WHERE rank <= 3"
)
def j21_match_outcomes(spark, sf_dir):
    """The three outcomes that hold most of a concept's words; a match of words is capped."""
    word = lambda x: F.concat(F.lit("k"), x.cast("string"), F.lit("q"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat_ws(" ", word(F.col("n_nationkey") % 5), word(F.col("n_nationkey") % 7 + 10)).alias("name"))
    s = table(spark, sf_dir, "supplier").filter("s_suppkey < 40").select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", word(F.col("s_suppkey") % 5), word(F.col("s_suppkey") % 11 + 8)).alias("description"))
    return curriculum.match(n, s).select("concept", "outcome", "rank", "score")


@query("SELECT n.n_nationkey AS subject, o.d AS day, CASE WHEN (n.n_nationkey + o.k) % 3 = 0 THEN 'plan ' || (o.k * 2 + 1) END AS title FROM nation n, (SELECT DATE '2024-01-01' + CAST(k AS INTEGER) AS d, k FROM (SELECT unnest(range(10)) AS k)) o")
def j25_master_calendar(spark, sf_dir):
    """Slots with their plan, of several the last saved."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    slots = n.select("subject", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("day"), F.lit(1).alias("period"))
    plans = n.filter("(subject + k) % 3 = 0").select("subject", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("day"), F.lit(1).alias("period"), F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("saved"))
    return bank.master_calendar(slots, plans.withColumn("title", F.concat(F.lit("plan "), _s("saved")))).select("subject", "day", "title")


@query("SELECT p_brand, p_partkey, CAST(rn AS INTEGER) AS rn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) ORDER BY rn, p_brand LIMIT 60")
def w03_round_robin(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("price", -F.col("p_retailprice"))
    return relational.round_robin(p, "p_brand", ["price", "p_partkey"], 60).select("p_brand", "p_partkey", "rn")


@query("SELECT user_id, island, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, CAST(sum(CASE WHEN event_id - p > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) GROUP BY user_id, island")
def w10_islands(spark, sf_dir):
    return relational.islands(table(spark, sf_dir, "events"), "user_id", "event_id", 150).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT o_orderkey, CAST(floor(date_diff('day', DATE '1992-01-06', CAST(o_orderdate AS DATE) - CAST(isodow(CAST(o_orderdate AS DATE)) - 1 AS INTEGER)) / 7.0) + 1 AS BIGINT) AS week FROM orders")
def w16_week_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", planning.week_number(F.col("o_orderdate").cast("date"), F.lit("1992-01-08").cast("date")).alias("week"))


@query(
    "WITH s AS (SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS role, CASE WHEN l_quantity > 25 THEN 'ends.' ELSE 'goes on' END AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1), "
    "j AS (SELECT *, CASE WHEN role = 'paragraph' AND lag(role) OVER w = 'paragraph' AND NOT regexp_matches(lag(text) OVER w, '[.?!:]$') THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY doc, page ORDER BY pos)) "
    "SELECT doc, page, min(pos) AS pos, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY doc, page ORDER BY pos) AS island FROM j) GROUP BY doc, page, island"
)
def w13_merge_fragments(spark, sf_dir):
    """Paragraphs that run on into the next become one."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 3 == 0, "heading").otherwise("paragraph").alias("role"), "l_quantity", "l_partkey")
    one = li.groupBy("doc", "page", "pos", "role").agg(F.min_by("l_quantity", F.struct("l_partkey", "l_quantity")).alias("q"))
    b = one.select("doc", "page", "pos", "role", F.when(F.col("q") > 25, "ends.").otherwise("goes on").alias("text"), *[F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return layout.merge_fragments(b).select("doc", "page", "pos", "text", "n")


@query("SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM orders")
def w14_sections(spark, sf_dir):
    """The heading at or before each block."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderdate").alias("page"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 7 == 0, "heading").otherwise("paragraph").alias("role"), _s("o_orderkey").alias("text"))
    return layout.sections(o).select(F.col("pos").alias("o_orderkey"), F.col("section.text").cast("long").alias("section"))


@query("SELECT o_orderkey, substring(concat_ws(' ', CASE WHEN length(p) > 12 THEN p END, CASE WHEN length(n) > 12 THEN n END), 1, 240) AS nearby FROM (SELECT o_orderkey, lag(t) OVER w AS p, lead(t) OVER w AS n FROM (SELECT o_orderkey, o_custkey, repeat('x', CAST(o_orderkey % 20 AS INTEGER)) || o_orderkey AS t FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def w15_nearby(spark, sf_dir):
    """What stands around a block, where it is long enough to say something."""
    t = F.concat(F.repeat(F.lit("x"), (F.col("o_orderkey") % 20).cast("int")), _s("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("page"), F.col("o_orderkey").alias("pos"), t.alias("text"))
    return layout.nearby(o).select(F.col("pos").alias("o_orderkey"), "nearby")


@query()
def w26_best_order(spark, sf_dir):
    """Pieces of each customer's orders in the order that reads best (tests hold it against all permutations)."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 10 = 1")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "it ends.").otherwise("and so on")
    head = F.when(F.col("o_orderkey") % 2 == 0, "A new start").otherwise("still going")
    return bank.best_order(o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("ord"), head.alias("head"), tail.alias("tail")))


# --- rules, keys, gates


@query(
    "SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'short_stem' END, CASE WHEN s_suppkey % 7 = 0 THEN 'option_count' END, CASE WHEN s_suppkey % 3 = 0 THEN 'no_key' END, CASE WHEN s_suppkey % 4 = 1 THEN 'no_such_difficulty' END, CASE WHEN s_suppkey % 4 = 2 THEN 'bloom' END, CASE WHEN s_suppkey % 4 = 2 THEN 'dok' END], lambda x: x IS NOT NULL)) AS code FROM supplier) GROUP BY code"
)
def x06_choice_rules(spark, sf_dir):
    k = F.col("s_suppkey")
    options = F.when(k % 7 == 0, F.array(F.lit("north"), F.lit("south"), F.lit("east"))).otherwise(F.array(F.lit("north"), F.lit("south"), F.lit("east"), F.lit("west")))
    stem = F.when(k % 5 == 0, "Where?").otherwise("Where does the sun go down?")
    key = F.when(k % 3 == 0, "up").otherwise("north")
    level = F.when(k % 4 == 1, "odd").otherwise("easy")
    rs = audits.choice_rules(stem, options, key, level, F.when(k % 4 == 2, "Create").otherwise("Remember"), F.when(k % 4 == 2, 4).otherwise(1))
    return rules.counts(rules.check(table(spark, sf_dir, "supplier"), rs)).select("code", "n")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Fill in for ' || s_name ELSE 'No table for ' || s_name END AS stem, CASE WHEN s_suppkey % 2 = 0 THEN 'a | ' || s_suppkey END AS answer FROM supplier")
def x25_trailing_table(spark, sf_dir):
    t = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Fill in for "), "s_name", F.lit(" <table><tr><td>a</td><td></td><td>"), _s("s_suppkey"), F.lit("</td></tr></table> "))).otherwise(F.concat(F.lit("No table for "), "s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", bank.trailing_table(t).alias("x")).select("s_suppkey", "x.stem", "x.answer")


@query("SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS needs_figure FROM supplier WHERE s_suppkey % 2 = 0")
def x26_missing_answers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    stem = F.when(F.col("s_suppkey") % 3 == 0, "Name the part in the figure given below").otherwise("Name the part")
    answer = F.when(F.col("s_suppkey") % 2 == 1, '{"answer_text": "yes"}').when(F.col("s_suppkey") % 4 == 0, '{"answer_text": " "}')
    return bank.missing_answers(s.select(F.col("s_suppkey").alias("id"), stem.alias("stem"), answer.alias("answer"))).select("id", "needs_figure")


@query("SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS fidelity, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 5 <> 0 END AS letter_vs_value, s_suppkey % 7 <> 0 AS value_vs_marked FROM supplier")
def x28_answer_keys(spark, sf_dir):
    """Stored options against the source's; the answer's letter, its value and the marked option against each other."""
    k = F.col("s_suppkey")
    options = F.array(F.lit("red"), F.lit("green"))
    source = F.when(k % 2 == 0, F.array(F.lit("Green"), F.lit("red "))).otherwise(F.array(F.lit("blue"), F.lit("green")))
    # the letter names the option green of the source, or the other one
    right = F.when(k % 2 == 0, "a").otherwise("b")
    wrong = F.when(k % 2 == 0, "b").otherwise("a")
    label = F.when(k % 3 == 0, F.lit("")).when(k % 5 == 0, F.concat(F.lit("("), wrong, F.lit(") "))).otherwise(F.concat(F.lit("("), right, F.lit(") ")))
    marked = F.when(k % 7 == 0, "red").otherwise("green")
    return audits.answer_keys(table(spark, sf_dir, "supplier").select(k.alias("id"), options.alias("options"), marked.alias("marked"), source.alias("payload_options"), F.concat(label, F.lit("green")).alias("answer_text")))


@query("SELECT hold, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'in the bank' WHEN s_suppkey % 5 = 1 AND s_suppkey % 2 = 0 THEN 'no key' WHEN s_suppkey % 5 = 2 THEN 'needs its figure' WHEN s_suppkey % 5 = 3 THEN 'empty stem' END AS hold FROM supplier) GROUP BY hold")
def x35_load_shape(spark, sf_dir):
    k = F.col("s_suppkey")
    stem = F.when(k % 5 == 3, F.lit(" ")).otherwise(F.concat(F.lit("Item of "), "s_name"))
    options = F.when(k % 5 == 1, F.array(F.lit("a"), F.concat(F.lit("b"), _s("s_suppkey")))).otherwise(F.array(F.concat(F.lit("only"), _s("s_suppkey"))))
    items = table(spark, sf_dir, "supplier").select(k.alias("id"), stem.alias("stem"), options.alias("options"), F.when((k % 5 != 1) | (k % 2 == 1), "a").alias("key"), (k % 5 == 2).alias("has_figure"))
    known = items.filter("id % 5 = 0").select("stem", T.item_hash("stem", "options").alias("sha256"))
    return audits.load_shape(items, known).groupBy("hold").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS doc, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS pass FROM orders GROUP BY o_custkey")
def x41_best_pass(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pass"), F.col("o_totalprice").alias("q"))
    return layout.best_pass(o, F.col("q")).select("doc", "pass")


@query("SELECT n_nationkey AS id, 'competency' AS type, 'C-' || n_regionkey || '.' || n_nationkey AS code, 'CG-' || n_regionkey AS parent FROM nation UNION ALL SELECT n_nationkey, 'goal', 'CG-' || n_regionkey, NULL FROM nation UNION ALL SELECT n_nationkey, 'outcome', 'C-' || n_regionkey || '.' || n_nationkey || '-LO' || k, 'C-' || n_regionkey || '.' || n_nationkey FROM nation, unnest(range(1, 3)) AS u(k)")
def x42_parse_curricula(spark, sf_dir):
    code = F.concat(F.lit("C-"), _s("n_regionkey"), F.lit("."), _s("n_nationkey"))
    md = F.concat(F.lit("## CG-"), _s("n_regionkey"), F.lit(" Explores\n- "), code, F.lit(": Describes "), "n_name", F.lit("\n  - Lists one\n  - Names two\n"))
    return bank.parse_curricula(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), md.alias("md"))).select(F.col("id").cast("int").alias("id"), "type", "code", "parent")


@query("SELECT o_orderkey, ['empty', 'thin', 'unstructured', 'good'][o_orderkey % 4 + 1] AS flag FROM orders")
def x47_plan_quality(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    prose = F.repeat(F.lit("we read and talk about it "), 10)
    t = F.when(k == 0, " ").when(k == 1, "Read.").when(k == 2, prose).otherwise(F.concat(F.lit("# Start\n- ask\n"), prose, F.lit("\n2. read\n3) talk")))
    return table(spark, sf_dir, "orders").select("o_orderkey", bank.plan_quality(t).alias("flag"))


# --- budgets, scores, audits


@query(
    "WITH t AS (SELECT n_regionkey AS chapter, count(*) AS topics FROM nation GROUP BY 1), b AS (SELECT chapter, topics, greatest(2 * topics, 8) AS f, CASE WHEN chapter = 0 THEN CAST(round_even(1.25::DOUBLE * 16, 0) AS BIGINT) WHEN chapter = 1 THEN 9 WHEN chapter = 2 THEN 22 ELSE 3 * topics END AS raw, CASE chapter WHEN 0 THEN 'learning_outcomes' WHEN 1 THEN 'competencies' WHEN 2 THEN 'periods' ELSE 'topics' END AS source FROM t) "
    "SELECT chapter, CAST(least(greatest(raw, f), greatest(least(4 * topics, 30), f)) AS INTEGER) AS target, source, CAST(topics AS INTEGER) AS quotas, CASE WHEN chapter = 0 THEN 'anchors_diverge' ELSE '' END AS warnings FROM b"
)
def x07_budget_and_quota(spark, sf_dir):
    """Chapters' budgets with their topics' quotas, which add up to them, and the warning of anchors that lie apart."""
    k = F.col("r_regionkey")
    c = table(spark, sf_dir, "region").select(k.alias("chapter"), F.when(k == 0, 16).alias("outcomes"), F.when(k == 1, 3).alias("competencies"), F.when(k == 0, 40).when(k == 2, 11).alias("periods"))
    t = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("chapter"), F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 50 + 200).alias("size"))
    b = planning.chapter_budget(c, t)
    total = F.aggregate("quota", F.lit(0), lambda a, x: a + x)
    return b.select("chapter", F.when(total == F.col("target"), F.col("target")).alias("target"), "source", F.size("quota").alias("quotas"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "SELECT p_partkey, kept FROM (SELECT p_partkey, rn <= greatest(2, least(5, greatest(2, quota) + 1)) AND (score >= 1.2 OR rn <= 2) AS kept FROM (SELECT p_partkey, CAST(substring(p_brand, 7) AS INTEGER) % 6 AS quota, p_size / 20.0 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part))"
)
def x08_enforce_quota(spark, sf_dir):
    """A topic keeps its best concepts: one more than its quota, and none below the bar of evidence but the least number."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("topic"), F.col("p_partkey").alias("ord"), (F.col("p_size") / 20.0).alias("score"), (F.substring("p_brand", 7, 3).cast("int") % 6).alias("quota"))
    return planning.enforce_quota(p).select("p_partkey", "kept")


@query(
    "SELECT c_custkey AS id, CAST(round_even(1000 * value, 0) AS BIGINT) AS milli, CASE WHEN value >= 0.8 THEN 'auto_accepted' WHEN value >= 0.55 THEN 'flagged' ELSE 'low_confidence' END AS status FROM (SELECT c_custkey, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.22::DOUBLE * q + 0.18::DOUBLE * CASE WHEN q = 1 AND s = 1 THEN 1 ELSE 0 END + 0.20::DOUBLE * 1 + 0.10::DOUBLE * (1 - d) + 0.30::DOUBLE * m) / 1.0::DOUBLE)), 3) AS value "
    "FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS q, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS s, (c_custkey % 5) / 4.0::DOUBLE AS d, CASE WHEN c_custkey % 4 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 4 = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS m FROM customer))"
)
def x09_concept_scores(spark, sf_dir):
    """Confidence with a curriculum: a citation counts fully, a match of words half, none nothing."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.lit("Roots drink water").alias("name"), F.when(k % 2 == 0, "roots drink water daily").otherwise("not said").alias("quote"),
        F.when(k % 3 == 0, "All roots drink water daily.").otherwise("Roots. They drink. Water.").alias("slice"), F.lit("All roots drink water daily.").alias("chapter"), ((k % 5) / 4).alias("nearest"),
        F.when(k % 4 == 0, 0.9).when(k % 4 == 1, 0.45).alias("mapped"), F.lit(True).alias("has_curriculum"),
    )
    s = audits.concept_scores(rows, "curriculum")
    return s.select("id", F.bround(1000 * F.col("value"), 0).cast("long").alias("milli"), "status")


@query("SELECT s_suppkey AS id, CAST(CASE s_suppkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 750 WHEN 2 THEN 700 ELSE 450 END AS BIGINT) AS milli FROM supplier")
def x09_topic_scores(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Water cycle").alias("name"), F.when(k < 2, "the water cycle").otherwise("unsaid").alias("quote"), F.lit("Here is the water cycle.").alias("chapter"), F.when(k % 2 == 0, "1.1 Water cycle").otherwise("1.1 Planets").alias("outline"))
    return audits.topic_scores(rows).select("id", F.bround(1000 * F.col("value"), 0).cast("long").alias("milli"))


@query(
    "WITH i AS (SELECT n_regionkey AS chapter, 'grounding' AS c, 'error' AS s, count(*) AS n FROM nation WHERE n_nationkey % 5 = 4 GROUP BY 1 UNION ALL SELECT n_regionkey, 'hierarchy', 'error', count(*) FROM nation WHERE n_nationkey % 4 = 3 GROUP BY 1 UNION ALL SELECT n_regionkey, 'hierarchy', 'warning', count(*) FROM nation WHERE n_nationkey % 4 = 1 GROUP BY 1 "
    "UNION ALL SELECT n_regionkey, 'granularity', 'warning', count(*) FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1 UNION ALL SELECT n_regionkey, 'attribution', 'error', count(*) FROM nation WHERE n_nationkey % 6 = 5 GROUP BY 1 UNION ALL SELECT r_regionkey, 'semantic', 'warning', 1 FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, 'semantic', 'warning', 1 FROM region WHERE r_regionkey = 3) "
    'SELECT chapter, c AS "check", s AS severity, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY ALL'
)
def x10_audit(spark, sf_dir):
    """An audit of chapters (regions) with topics (nations): what was planted is found, by check and severity."""
    k = F.col("n_nationkey")
    code = lambda c: F.concat(F.lit("zq"), F.md5(_s(c)), F.lit("x"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey >= 0")
    topics = n.select(F.col("n_regionkey").alias("chapter"), k.cast("long").alias("id"), code("n_nationkey").alias("name"), F.lit(True).alias("shown"), F.lit(40).alias("minutes"), F.lit(0).alias("start"), F.when(k % 3 == 0, 100).otherwise(2000).alias("end"))
    every = F.array_join(F.array_sort(F.collect_list(F.when(k % 5 != 4, code("n_nationkey")))), " ")
    chapters = n.groupBy(F.col("n_regionkey").alias("chapter")).agg(every.alias("md"), F.array(F.lit("stranger a"), F.lit("foreign b")).alias("odd"), F.slice(F.array_sort(F.collect_list(code("n_nationkey"))), 1, 2).alias("own"))
    chapters = chapters.select("chapter", F.lit("Title").alias("title"), "md", F.when(F.col("chapter") == 3, F.col("odd")).when(F.col("chapter") % 2 == 1, F.col("own")).alias("semantic"))
    held = n.filter(k % 4 != 3).select(F.col("n_regionkey").alias("chapter"), k.cast("long").alias("topic_id"), (k + 1000).cast("long").alias("id"), F.concat(F.lit("kw"), F.md5(_s("n_nationkey")), F.lit("y")).alias("name"), F.when(k % 4 == 1, 10).otherwise(40).alias("minutes"))
    loose = n.filter(k % 6 == 5).select(F.col("n_regionkey").alias("chapter"), F.lit(999).cast("long").alias("topic_id"), (k + 5000).cast("long").alias("id"), F.concat(F.lit("lw"), F.md5(_s("n_nationkey")), F.lit("y")).alias("name"), F.lit(0).alias("minutes"))
    issues = audits.audit_chapters(topics, held.unionByName(loose), chapters)
    # each concept's name is a code of its own, so all barely overlap their topics: those warnings are the other query's
    return issues.filter("NOT (check = 'attribution' AND severity = 'warning')").groupBy("chapter", "check", "severity").agg(F.count("*").alias("n"))


@query(
    "SELECT n_regionkey AS chapter, count(*) * 2 AS concepts, count(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) * 1 + count(DISTINCT CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END) * 2 AS \"distinct\", count(*) * 2 - (count(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) + 2 * count(DISTINCT CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END)) AS duplicate_rows FROM nation GROUP BY 1"
)
def x11_legacy_audit(spark, sf_dir):
    """Chapters written before quotes were kept, the worst first: doubled rows show."""
    n = table(spark, sf_dir, "nation").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.concat(F.lit("Idea "), _s("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit(" part"), _s("j"))).otherwise(""))
    c = n.select(F.col("n_regionkey").alias("chapter"), F.col("n_nationkey").alias("topic_id"), (F.col("n_nationkey") * 2 + F.col("j")).alias("id"), name.alias("name"), name.alias("slice"), F.lit(None).cast("string").alias("outcomes"))
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("chapter"), F.lit(18).alias("target"), F.lit(20).alias("ceiling"))
    return audits.legacy_audit(c, b).select("chapter", "concepts", "distinct", "duplicate_rows")


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END AS concept_id, CASE WHEN s_suppkey % 5 <> 0 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'analyze' ELSE 'recall' END AS bloom, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 1 END AS dok FROM supplier"
)
def x24_tag_offline(spark, sf_dir):
    """Items tagged by words alone: concept, confidence, Bloom and depth."""
    code = lambda c: F.concat(F.lit("zq"), F.md5(_s(c)), F.lit("x"))
    k = F.col("s_suppkey")
    stem = F.concat(F.when(k % 2 == 0, "Compare ").otherwise("Define "), F.when(k % 5 == 0, F.lit("it")).otherwise(code("s_nationkey")))
    items = table(spark, sf_dir, "supplier").select(F.lit(1).alias("grp"), k.alias("id"), stem.alias("stem"), F.lit("short").alias("form"), F.lit(3).alias("marks"))
    concepts = table(spark, sf_dir, "nation").select(F.lit(1).alias("grp"), F.col("n_nationkey").alias("id"), code("n_nationkey").alias("name"), F.lit("nothing else").alias("description"))
    return bank.tag_offline(items, concepts).select("id", "concept_id", "confidence", "bloom", "dok")


@query(
    """
    WITH RECURSIVE n AS (
      SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id % 3 AS part,
             [lower(p_name) || chr(97 + i::INTEGER) FOR i IN range(doc_id % 7, doc_id % 7 + 2 + doc_id % 4)] AS s
      FROM (SELECT source, doc_id, 'zq' AS p_name FROM documents WHERE doc_id % 11 <> 0)),
    w AS (
      SELECT source, k, doc_id, s, TRUE AS stays, [s] AS kept FROM n WHERE k = 1
      UNION ALL
      SELECT source, k, doc_id, s, ok, CASE WHEN ok THEN list_append(kept, s) ELSE kept END
      FROM (SELECT n.source, n.k, n.doc_id, n.s, w.kept,
                   len(list_filter(w.kept, lambda x: CAST(len(list_intersect(x, n.s)) AS DOUBLE) / least(len(x), len(n.s)) >= 0.8)) = 0 AS ok
            FROM w JOIN n ON n.source = w.source AND n.k = w.k + 1)),
    p AS (
      SELECT d.source, d.doc_id % 3 AS part, min(d.doc_id) AS doc_id, bool_or(coalesce(w.stays, FALSE)) AS any_
      FROM documents d LEFT JOIN w ON w.source = d.source AND w.doc_id = d.doc_id GROUP BY d.source, d.doc_id % 3)
    SELECT source, doc_id FROM w WHERE stays UNION SELECT source, doc_id FROM p WHERE NOT any_
    """
)
def w01_first_names(spark, sf_dir):
    """Names of two to five words from an alphabet, so that they overlap in chains: one stays unless an earlier that stayed names the same; every eleventh has no token."""
    word = lambda i: F.concat(F.lit("The zq"), F.char(97 + i))
    words = F.transform(F.sequence(F.col("doc_id") % 7, F.col("doc_id") % 7 + 1 + F.col("doc_id") % 4), word)
    name = F.when(F.col("doc_id") % 11 == 0, F.lit(" -- ")).otherwise(F.array_join(words, " "))
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), name.alias("name"), (F.col("doc_id") % 3).alias("part"))
    return relational.first_names(d, "part").select(F.col("grp").alias("source"), F.col("ord").alias("doc_id"))


# --- streams


@query("SELECT event_id, user_id FROM events")
def r04_stream_distinct(spark, sf_dir):
    """Retried entries once: each event comes twice."""
    e = ledger.stream(spark, sf_dir)
    twice = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return ledger.settled(ledger.distinct(twice, "ts", ["event_id"], "40 days").select("event_id", "user_id"))


@query("SELECT user_id, CAST(max(n) AS BIGINT) AS n, count(*) AS news FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id")
def r05_stream_live(spark, sf_dir):
    """News of each job, counted as long as it is remembered."""
    e = ledger.stream(spark, sf_dir).select(_s("user_id").alias("key"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    out = ledger.settled(ledger.live(e, 24 * 60))
    return out.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.max("n").alias("n"), F.count("*").alias("news"))


@query(
    "SELECT user_id, CASE WHEN status = 'view' THEN 'failed' ELSE status END AS status FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS seen, (SELECT max(ts) FROM events) AS newest FROM events GROUP BY user_id) "
    "WHERE status <> 'view' OR seen + INTERVAL 60 MINUTE <= date_trunc('millisecond', newest - INTERVAL 1 MINUTE)"
)
def r03_stream_stuck(spark, sf_dir):
    """Runs as a stream tells them: as they end, or failed when the watermark has passed an hour without news (here: view is running)."""
    e = ledger.stream(spark, sf_dir).select(_s("user_id").alias("key"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return ledger.settled(ledger.stuck(e, 60)).select(F.col("key").cast("long").alias("user_id"), "status")


@query("SELECT event_id FROM events WHERE NOT (event_type IN ('purchase', 'error') AND ts < TIMESTAMP '2024-01-20 00:00:00')")
def r05_evict(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", T.lookup({"purchase": "done", "error": "failed"}, F.col("event_type"), "running").alias("status"), F.col("ts").alias("at"))
    return ledger.evict(e, F.expr("TIMESTAMP_NTZ'2024-01-21 00:00:00'"), 24).select("event_id")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def r06_stream_windows(spark, sf_dir):
    w = ledger.tumbling(ledger.stream(spark, sf_dir), "ts", "1 hour", "40 days")
    return ledger.drain(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete", f"windows_{uuid.uuid4().hex}")


# --- sources


@query("SELECT lower(regexp_replace(n_name, '_', ' ')) AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def s05_s19_round_trip(spark, sf_dir):
    """A dump in files of few rows, read again as a sheet: headers are folded, numbers lose their ".0"."""
    from quillspark.sources import files

    path = files.scratch(spark, "dump")
    n = table(spark, sf_dir, "nation").select(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("Name "), F.concat(_s("n_nationkey"), F.lit(".0")).alias(" Id"))
    files.dump_csv(n, path, 7)
    return files.read_csv(spark, path).select("name", "id")


@query("SELECT CAST(count(*) AS BIGINT) AS rows_, min(k) AS least FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey >= 5)")
def s09_replace_table(spark, sf_dir):
    """A table that is replaced by a part of itself."""
    from quillspark.sources import files

    path = files.scratch(spark, "table")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    files.write_table(n, path)
    files.write_table(spark.read.parquet(path).filter("k >= 5"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows_"), F.min("k").alias("least"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderstatus, row(strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus)) AS status FROM orders GROUP BY o_custkey")
def s07_s12_ledger(spark, sf_dir):
    """A ledger that is appended to, read again, and reduced to its latest entries."""
    from quillspark.sources import files

    path = files.scratch(spark, "ledger")
    o = table(spark, sf_dir, "orders").select(_s("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    for part in (0, 1):
        files.append_ledger(o.filter(F.pmod(F.crc32("key"), F.lit(2)) == part), path)
    return relational.latest(files.read_ledger(spark, path), "key", ["at", "status"], ["status"])


@query("SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS score FROM nation WHERE n_regionkey IN (1, 2)")
def s20_align_and_guard(spark, sf_dir):
    """Rows in a schema that has more columns, and only those of a legal set."""
    from pyspark.sql import types as ty

    schema = ty.StructType([ty.StructField("id", ty.IntegerType()), ty.StructField("name", ty.StringType()), ty.StructField("score", ty.DoubleType())])
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    legal = table(spark, sf_dir, "region").filter("r_regionkey IN (1, 2)").select(F.col("r_regionkey").alias("n_regionkey"))
    return relational.align(relational.guard(n, legal, "n_regionkey"), schema)


@query("SELECT c_nationkey AS grp, seg AS cat, CAST(0 AS BIGINT) AS want FROM (SELECT 1 AS c_nationkey, 'x' AS seg) WHERE false UNION ALL SELECT n_regionkey, n_name, CAST(3 AS BIGINT) FROM nation")
def w23_level(spark, sf_dir):
    """Categories that are levelled to the floor, where there is just enough for all."""
    w = W.partitionBy("n_regionkey")
    first = F.row_number().over(w.orderBy("n_nationkey")) == 1
    have = F.when(first, 3 * F.count("*").over(w)).otherwise(0)
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("cat"), have.alias("have"))
    return planning.rebalance(n, 3)
