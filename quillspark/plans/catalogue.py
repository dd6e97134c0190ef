"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring, text
from quillspark.operators import parsing, planning, relational, rules
from quillspark.plans import banks, domain, frames, papers, sql_queries  # noqa: F401  they register queries
from quillspark.plans.registry import ORACLES, QUERIES, query
from quillspark.session import table, texts
from quillspark.streaming import ledger

__all__ = ["ORACLES", "QUERIES"]

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN (" + _STOP + "))"
_FOLD = "list_transform({0}, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%ies' THEN x[1:-4] || 'y' WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[1:-2] ELSE x END)"


def _stems(c: str) -> str:
    return f"list_sort(list_distinct({_FOLD.format(_TOKENS.format(c))}))"


_CLEAN = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_CLEAN}) AS h FROM documents")
def s10_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.content_hash("text").alias("h"))


_DUPES = f"SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, h) AS keeper, count(*) OVER (PARTITION BY lang, h) AS n FROM (SELECT doc_id, lang, sha256({_CLEAN}) AS h FROM documents)"


@query(f"SELECT * FROM ({_DUPES}) WHERE n > 1")
def x33_duplicate_keeper(spark, sf_dir):
    """Documents whose normalised text and language recur, with the smallest id as keeper."""
    d = texts(spark, sf_dir, "documents", "doc_id", "lang", "text").select("doc_id", "lang", text.content_hash("text").alias("h"))
    return relational.duplicates(d, ["lang", "h"], "doc_id").select("doc_id", "keeper", "n")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256({_CLEAN}) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def w01_first_seen_dedupe(spark, sf_dir):
    d = texts(spark, sf_dir, "documents", "doc_id", "lang", "text").select("doc_id", "lang", text.content_hash("text").alias("h"))
    return relational.first_seen(d, ["h"], ["doc_id"]).select("doc_id", "lang")


@query("SELECT a.p_partkey AS a, b.keeper AS b FROM part a JOIN (SELECT p_name, p_brand, p_type, min(p_partkey) AS keeper FROM part GROUP BY ALL HAVING count(*) > 1) b ON a.p_name IS NOT DISTINCT FROM b.p_name AND a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type")
def j04_null_safe_duplicates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return relational.duplicates(p, ["p_name", "p_brand", "p_type"], "p_partkey").select(F.col("p_partkey").alias("a"), F.col("keeper").alias("b"))


@query(f"SELECT item_id, array_to_string({_stems('text')}, ' ') AS stems FROM benchmark")
def t05_stems(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.stems("text"), " ").alias("stems"))


@query(f"SELECT p_partkey, array_to_string(list_sort({_FOLD.format(_TOKENS.format('p_name'))}), ' ') AS k FROM part")
def t06_match_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.match_key("p_name").alias("k"))


_SUBJECT = f"WITH s AS (SELECT i AS n, {_stems('t')} AS x FROM (SELECT conv_id * 100 + turn AS i, array_to_string(string_split(text, ' ')[1:4], ' ') AS t FROM conversations))"


@query(
    _SUBJECT + " SELECT a.n AS a, b.n AS b, CAST(len(list_intersect(a.x, b.x)) AS BIGINT) AS shared FROM s a JOIN s b ON a.n < b.n "
    "WHERE len(a.x) > 0 AND len(b.x) > 0 AND CAST(len(list_intersect(a.x, b.x)) AS DOUBLE) / least(len(a.x), len(b.x)) >= 0.8"
)
def j19_name_containment_pairs(spark, sf_dir):
    """Turns whose first words lie in another's by four fifths of their stems, found by their rarest stems."""
    c = table(spark, sf_dir, "conversations")
    s = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("n"), text.stems(F.array_join(F.slice(F.split("text", " "), 1, 4), " ")).alias("x"))
    return relational.similar_sets(s, "n", "x", text.DUPLICATE).select("a", "b", "shared")


@query(
    f"WITH b AS (SELECT item_id, {_stems('text')} AS w FROM benchmark WHERE item_id < 1000000), d AS (SELECT doc_id, {_stems('text')} AS w FROM documents), "
    "e AS (SELECT item_id, len(w) AS n, unnest(w) AS x FROM b), f AS (SELECT doc_id, unnest(w) AS x FROM d), "
    "s AS (SELECT item_id, doc_id, count(*) AS c FROM e JOIN f USING (x) GROUP BY 1, 2) "
    "SELECT item_id, doc_id, c AS shared, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS rn FROM s) WHERE rn <= 3"
)
def t07_coverage_topk(spark, sf_dir):
    """The three documents that cover most of each benchmark item."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("l"), text.stems("text").alias("tokens"))
    d = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("r"), F.array_distinct(F.transform(text.tokens("text"), text.singular)).alias("tokens"))
    n = b.select("l", F.size("tokens").alias("n"))
    x = relational.best_overlap(b, d, 3).join(n, "l")
    return x.select(F.col("l").alias("item_id"), F.col("r").alias("doc_id"), F.round(F.col("score") * F.col("n")).cast("long").alias("shared"), "rank")


@query(f"SELECT b.item_id, d.doc_id FROM (SELECT item_id, {_CLEAN} AS q FROM benchmark) b JOIN (SELECT doc_id, {_CLEAN} AS t FROM documents) d ON contains(d.t, b.q) WHERE b.q <> ''")
def t12_grounding(spark, sf_dir):
    """Benchmark texts that stand verbatim in a document."""
    clean = F.lower(text.collapse("text"))
    d = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), clean.alias("t"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote"), clean.alias("q"))
    return relational.contains_join(d, b).select(F.col("quote").alias("item_id"), F.col("doc").alias("doc_id"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[A-Za-z]|[^\p{L}]', '', 'g')) AS other_letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS devanagari FROM documents")
def t22_script_profile(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *text.script_counts("text"))


_RUNS = "len(regexp_extract_all(x, '[aeiouy]+'))"
_SYL = f"CAST(list_sum(list_transform(regexp_extract_all(t, '[a-z]+'), lambda x: greatest(1, {_RUNS} - CASE WHEN x LIKE '%e' AND {_RUNS} > 1 THEN 1 ELSE 0 END))) AS BIGINT)"


@query(
    "SELECT doc_id, CAST(floor(1000 * least(20.0::DOUBLE, greatest(0.0::DOUBLE, 0.39::DOUBLE * w / s + 11.8::DOUBLE * y / w - 15.59::DOUBLE))) AS BIGINT) AS milli FROM (SELECT doc_id, len(regexp_extract_all(t, '[a-z]+')) AS w, greatest(len(regexp_extract_all(t, '[.!?]')), 1) AS s, "
    + _SYL + " AS y FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE NOT regexp_matches(text, '[\\x{0900}-\\x{097F}]'))) WHERE w >= 6"
)
def t23_reading_level(spark, sf_dir):
    d = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.reading_grade("text").alias("grade"))
    return d.filter("grade is not null").select("doc_id", F.floor(1000 * F.col("grade")).alias("milli"))


_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {_HTML} AS t FROM pages")
def t18_html_text(spark, sf_dir):
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", text.html_text("html").alias("t"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<li[^>]*>(.*?)</li>', 1), '|') AS cells FROM pages")
def t18_cells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("(?i)<li[^>]*>(.*?)</li>"), F.lit(1)), "|").alias("cells"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def t33_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " ").alias("links"))


_SAYS = "list_has_any(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}#]+', ' ', 'g'), ' '), [{0}])"
_BLOOM_SQL = "CASE " + " ".join(f"WHEN {_SAYS.format(words)} THEN '{level}'" for level, words in (
    ("create", "'compose', 'create', 'design', 'develop', 'devise', 'formulate', 'invent', 'plan', 'propose'"),
    ("evaluate", "'agree', 'argue', 'assess', 'criticise', 'defend', 'evaluate', 'judge', 'justify', 'recommend'"),
    ("analyze", "'analyse', 'analyze', 'assertion', 'compare', 'contrast', 'deduce', 'derive', 'differentiate', 'distinguish', 'examine', 'infer', 'prove', 'relate'"),
    ("apply", "'apply', 'balance', 'calculate', 'complete', 'compute', 'convert', 'determine', 'draw', 'find', 'plot', 'simplify', 'sketch', 'solve', 'use'"),
    ("understand", "'classify', 'describe', 'discuss', 'explain', 'how', 'illustrate', 'interpret', 'summarise', 'why'"),
    ("recall", "'define', 'identify', 'label', 'list', 'mention', 'name', 'recall', 'state', 'what', 'when', 'where', 'who'"),
)) + " ELSE 'understand' END"
#: Questions made of suppliers: each begins with another verb.
_ASKED = "SELECT s_suppkey, ['Design', 'Justify', 'Compare', 'Solve', 'Explain', 'Define', 'Paint'][s_suppkey % 7 + 1] || ' the offer of ' || s_name || '.' AS text FROM supplier"


@query(f"SELECT s_suppkey, {_BLOOM_SQL} AS bloom FROM ({_ASKED})")
def t25_bloom(spark, sf_dir):
    verbs = F.array(*[F.lit(v) for v in ("Design", "Justify", "Compare", "Solve", "Explain", "Define", "Paint")])
    asked = F.concat(F.element_at(verbs, (F.col("s_suppkey") % 7 + 1).cast("int")), F.lit(" the offer of "), F.col("s_name"), F.lit("."))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.bloom(asked, F.lit("none")).alias("bloom"))


@query()
def t24_form_classifier(spark, sf_dir):
    """Form, marks and depth of each turn as a question stem (unit tests pin the cases)."""
    form = text.classify_form(F.col("text"))
    marks = text.lookup(text.MARKS, form, 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", form.alias("form"), marks.alias("marks"), text.dok(text.bloom(F.col("text"), form), marks).alias("dok"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE CAST(length(regexp_replace(text, '[^ÂÃ�]', '', 'g')) AS DOUBLE) / length(text) END AS ratio FROM documents")
def t20_mojibake_ratio(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.mojibake_ratio("text").alias("ratio"))


@query(
    r"SELECT doc_id, CAST(floor(1000 * greatest(0.0::DOUBLE, CAST(CASE WHEN c >= 2000 THEN 1.0 WHEN c >= 500 THEN 0.7 WHEN c >= 100 THEN 0.4 ELSE 0.1 END AS DOUBLE) * CASE WHEN w > 0 AND CAST(c AS DOUBLE) / w BETWEEN 3.0 AND 12.0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END - least(m * 10, 1.0::DOUBLE))) AS BIGINT) AS milli FROM (SELECT doc_id, length(text) AS c, len(regexp_extract_all(text, '[^\s]+')) AS w, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE CAST(length(regexp_replace(text, '[^ÂÃ�]', '', 'g')) AS DOUBLE) / length(text) END AS m FROM documents)"
)
def n03_quality_score(spark, sf_dir):
    q = scoring.extraction_quality(F.char_length("text"), F.regexp_count("text", F.lit(r"[^\s]+")), text.mojibake_ratio("text"))
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.floor(1000 * q).alias("milli"))


@query(
    "SELECT d.doc_id, CASE WHEN q IS NULL AND t IS NULL THEN 0.0::DOUBLE ELSE (0.3::DOUBLE * coalesce(q, 0) + 0.15::DOUBLE * coalesce(t, 0)) / (CASE WHEN q IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN t IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END) END AS raw FROM documents d LEFT JOIN (SELECT doc_id, CAST(quality AS DOUBLE) AS q, CAST(1 - toxic AS DOUBLE) AS t FROM labels) l ON d.doc_id = l.doc_id"
)
def a18_weighted_confidence(spark, sf_dir):
    """Weighted mean of the parts that are there: an absent label isn't a zero."""
    labels = table(spark, sf_dir, "labels")
    parts = {"grounding_chapter": F.col("quality").cast("double"), "distinctness": (1 - F.col("toxic")).cast("double")}
    raw = scoring.weighted(parts, {k: scoring.WEIGHTS["content"][k] for k in parts})
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", raw.alias("raw"))


@query("SELECT 'doc_id' AS \"column\", count(d.doc_id) AS filled FROM documents d UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'quality', count(l.quality) FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def a20_fill_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return relational.fill_rates(d).select("column", "filled")


_VOCAB = f"e AS (SELECT source, unnest({_TOKENS.format('text')}) AS x FROM documents), v AS (SELECT source, x FROM (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, x) AS rn FROM e GROUP BY source, x) WHERE rn <= 40)"


@query(f"WITH {_VOCAB} SELECT a.source AS a, b.source AS b, count(*) AS shared FROM v a JOIN v b ON a.x = b.x AND a.source < b.source GROUP BY 1, 2")
def a23_vocab_overlap(spark, sf_dir):
    """Shared words of the sources' 40 most frequent."""
    e = text.token_rows(texts(spark, sf_dir, "documents", "source", "text"), ["source"], "text").groupBy("source", "x").count()
    v = relational.top_k(e, ["source"], [F.desc("count"), F.col("x")], 40).select("source", "x")
    a, b = v.alias("a"), v.alias("b")
    j = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.source") < F.col("b.source")))
    return j.groupBy(F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(F.count("*").alias("shared"))


@query("WITH s AS (SELECT user_id, min(k) AS a, max(k) AS b FROM (SELECT user_id, event_id % 40 AS k FROM events) GROUP BY user_id) SELECT user_id, CAST(g AS BIGINT) AS k FROM s, unnest(range(a, b + 1)) AS u(g) EXCEPT SELECT user_id, event_id % 40 FROM events")
def a26_sequence_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("k"))
    return relational.sequence_gaps(e, "user_id", "k").select("user_id", "k")


@query(f"WITH e AS (SELECT DISTINCT source, unnest({_TOKENS.format('text')}) AS x FROM documents) SELECT x, count(*) AS n FROM e GROUP BY x HAVING count(*) <= 3")
def a27_rare_vocabulary(spark, sf_dir):
    e = text.token_rows(texts(spark, sf_dir, "documents", "source", "text"), ["source"], "text", distinct=True).groupBy("source", "x").agg(F.lit(1))
    return e.groupBy("x").agg(F.count("*").alias("n")).filter("n <= 3")


@query("SELECT DISTINCT a.n AS a, b.n AS b FROM (SELECT s_name AS n FROM supplier UNION SELECT substring(s_name, 1, 15) FROM supplier UNION SELECT n_name FROM nation) a JOIN (SELECT s_name AS n FROM supplier UNION SELECT n_name FROM nation) b ON starts_with(b.n, a.n) AND a.n <> b.n")
def j06_prefix_join(spark, sf_dir):
    """Names that begin another: nations of one digit and of two, and suppliers' numbers cut short."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    names = s.select("s_name").union(s.select(F.substring("s_name", 1, 15))).union(n.select("n_name"))
    whole = s.select(F.col("s_name").alias("b")).union(n.select("n_name"))
    return relational.prefix_pairs(names.toDF("name"), "name").join(whole, "b", "left_semi").select("a", "b")


@query(f"WITH p AS (SELECT p_partkey, array_to_string(list_sort({_FOLD.format(_TOKENS.format('p_name'))}), ' ') AS k FROM part) SELECT k, count(*) AS n, min(p_partkey) AS least FROM p GROUP BY k")
def j08_match_key_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.match_key("p_name").alias("k"))
    return p.groupBy("k").agg(F.count("*").alias("n"), F.min("p_partkey").alias("least"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM events")
def j14_asof_page(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return relational.as_of(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "page").select("event_id", "page")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations")
def j16_carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return relational.as_of(c, "conv_id", ["turn", "role", "text"], F.col("role") == "system", F.col("text"), "carried").select("conv_id", "turn", "carried")


@query(
    f"WITH q AS (SELECT item_id, {_stems('text')} AS w FROM benchmark), c AS (SELECT conv_id * 100 + turn AS name, {_stems('t')} AS w FROM (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:5], ' ') AS t FROM conversations)), "
    "e AS (SELECT item_id, unnest(w) AS x FROM q), f AS (SELECT name, len(w) AS n, unnest(w) AS x FROM c) "
    "SELECT item_id, name FROM (SELECT item_id, name, row_number() OVER (PARTITION BY item_id ORDER BY CAST(count(*) AS DOUBLE) / max(n) DESC, name) AS rn FROM e JOIN f USING (x) GROUP BY item_id, name) WHERE rn = 1"
)
def j20_lexical_best_match(spark, sf_dir):
    """The turn of whose first words each item holds the largest share."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.stems("text")).alias("x"))
    first = text.stems(F.array_join(F.slice(F.split("text", " "), 1, 5), " "))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("name"), first.alias("w")).select("name", F.size("w").alias("n"), F.explode("w").alias("x"))
    s = q.join(c, "x").groupBy("item_id", "name").agg((F.count("*") / F.max("n")).alias("score"))
    return relational.top_k(s, ["item_id"], [F.desc("score"), F.col("name")], 1).select("item_id", "name")


_DAYS = "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS DATE) AS day"


@query(f"WITH d AS ({_DAYS}), off AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' AND user_id < 5) SELECT d.day, p.period FROM d JOIN (SELECT * FROM (VALUES (0, 1), (0, 2), (2, 1), (4, 3), (5, 1)) t(weekday, period)) p ON p.weekday = isodow(d.day) - 1 WHERE d.day NOT IN (SELECT day FROM off)")
def j24_calendar(spark, sf_dir):
    """A term's days by the week's template, less days off."""
    term = spark.sql("SELECT 1 AS term_id, DATE'2024-01-01' AS start_date, DATE'2024-03-31' AS end_date")
    template = spark.createDataFrame([(0, 1), (0, 2), (2, 1), (4, 3), (5, 1)], "weekday int, period int")
    off = table(spark, sf_dir, "events").filter("event_type = 'error' AND user_id < 5").select(F.col("ts").cast("date").alias("day")).distinct()
    return planning.teaching_slots(planning.calendar(term), template, off).select("day", "period")


@query(
    "WITH t AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY user_id) "
    "SELECT user_id, isodow(day) - 1 AS weekday, count(*) AS n FROM (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM t) GROUP BY ALL"
)
def d08_days_by_weekday(spark, sf_dir):
    """Days of each weekday in the span that each user's events fill."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("term_id")).agg(F.min("ts").cast("date").alias("start_date"), F.max("ts").cast("date").alias("end_date"))
    return planning.calendar(e).groupBy(F.col("term_id").alias("user_id"), F.col("weekday").cast("long").alias("weekday")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, first_slot, last_slot FROM (SELECT n_nationkey, CAST(sum(n) OVER w - n + 1 AS BIGINT) AS first_slot, CAST(sum(n) OVER w AS BIGINT) AS last_slot FROM (SELECT n_nationkey, n_regionkey, n_nationkey % 4 + 1 AS n FROM nation) WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING))")
def w17_slot_ranges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n", F.col("n_nationkey") % 4 + 1)
    return relational.slots(n, ["n_regionkey"], ["n_nationkey"], "n").select("n_nationkey", "first_slot", "last_slot")


@query("SELECT c_custkey, CAST(floor(100.0 / count(*) OVER (PARTITION BY c_nationkey)) + CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 100 % count(*) OVER (PARTITION BY c_nationkey) THEN 1 ELSE 0 END AS BIGINT) AS share FROM customer")
def w20_even_split(spark, sf_dir):
    return relational.even_split(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], F.lit(100)).select("c_custkey", "share")


@query(
    "WITH p AS (SELECT n_nationkey, n_regionkey, CAST(greatest(1, round_even((n_nationkey + 1) * 300.0::DOUBLE / sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey), 0)) AS BIGINT) AS part FROM nation) "
    "SELECT n_nationkey, CAST(CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY part DESC, n_nationkey) = 1 THEN greatest(1, part + 300 - sum(part) OVER (PARTITION BY n_regionkey)) ELSE part END AS BIGINT) AS scaled FROM p"
)
def w21_rescale(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("v", F.col("n_nationkey") + 1)
    return relational.rescale(n, ["n_regionkey"], ["n_nationkey"], "v", F.lit(300)).select("n_nationkey", "scaled")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, min(turn) OVER (PARTITION BY conv_id) AS first FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE turn - first + 1 = rn GROUP BY conv_id")
def w08_monotonic_run(spark, sf_dir):
    """Turns that continue a conversation one by one: each is the last accepted plus one."""
    turns = F.array_sort(F.collect_set("turn"))
    step = lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x == F.element_at(a, -1) + 1, F.concat(a, F.array(x))).otherwise(a)
    run = F.aggregate(turns, F.array().cast("array<bigint>"), step)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.size(run).cast("long").alias("n"))


def _turn_overlap(c: DataFrame) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    s = text.stems("text")
    x = c.select("conv_id", "turn", s.alias("s"), F.lag(s).over(w).alias("p"))
    return x.select("conv_id", "turn", F.when(F.col("p").isNull() | (F.size("s") == 0) | (F.size("p") == 0), F.lit(-1)).otherwise(F.size(F.array_intersect("s", "p"))).cast("long").alias("shared"))


@query(f"SELECT conv_id, turn, CAST(CASE WHEN p IS NULL OR len(s) = 0 OR len(p) = 0 THEN -1 ELSE len(list_intersect(s, p)) END AS BIGINT) AS shared FROM (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM (SELECT conv_id, turn, role, text, {_stems('text')} AS s FROM conversations))")
def w11_alignment(spark, sf_dir):
    """Words that neighbouring turns share; -1 where that can't be told."""
    return _turn_overlap(table(spark, sf_dir, "conversations"))


@query("SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o FULL OUTER JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1) n ON o.o_orderkey = n.o_orderkey")
def s13_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter("o_orderkey % 3 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") + 1))
    return relational.upsert(o.filter("o_orderkey % 3 <> 0"), new, "o_orderkey")


@query(
    "WITH o AS (SELECT c_custkey AS id, c_nationkey || c_mktsegment AS k, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey || c_mktsegment ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey % 3 <> 0), "
    "n AS (SELECT c_nationkey || c_mktsegment AS k, min(c_acctbal) AS v FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1) "
    "SELECT o.id, coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, n.k IS NOT NULL AS shown, o.id IS NULL AS added FROM o FULL OUTER JOIN n ON o.k = n.k AND o.rn = 1"
)
def s15_retire(spark, sf_dir):
    """Customers by nation and segment after a batch: what it holds is updated, what it doesn't hidden; of repeats the least id stays."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("k"), F.col("c_acctbal").alias("v"))
    return relational.retire(c.filter("id % 3 <> 0"), c.filter("id % 7 = 0").drop("id"), "k", "id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3")
def s16_replace_children(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.replace_children(li.filter("l_linenumber <= 2"), li.filter("l_linenumber = 3"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT n.o_orderkey, coalesce(n.tag, o.tag) AS tag FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS tag FROM orders WHERE o_orderstatus = 'O') n LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS tag FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o.o_custkey = n.o_custkey")
def s17_carry(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("tag"), "o_orderstatus")
    new = o.filter("o_orderstatus = 'O'").withColumn("tag", F.when(F.col("o_orderkey") % 2 == 0, F.col("tag"))).drop("o_orderstatus")
    return relational.carry_forward(o.filter("o_orderstatus = 'F'"), new, "o_custkey", ["tag"]).select("o_orderkey", "tag")


@query(
    "SELECT 'changed' AS what, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'HIDDEN' ELSE nullif(c_mktsegment, 'BUILDING') END AS v FROM customer UNION ALL "
    "SELECT 'log', c_custkey, nullif(c_mktsegment, 'BUILDING') FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'reverted', c_custkey, nullif(c_mktsegment, 'BUILDING') FROM customer"
)
def s18_logged_revert(spark, sf_dir):
    """A logged change, its log, and the state after it is taken back, nulls included."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("v"))
    changed, log = relational.change_log(c, "c_custkey", "v", F.lit("HIDDEN"), F.col("c_custkey") % 2 == 0)
    back = relational.revert(changed, log, "c_custkey", "v")
    tag = lambda df, what: df.select(F.lit(what).alias("what"), "c_custkey", "v")
    return tag(changed, "changed").unionByName(tag(log.withColumnRenamed("previous", "v"), "log")).unionByName(tag(back, "reverted"))


_ITEM = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'assertion_reason' ELSE 'short' END AS form FROM supplier"
_FAILS = {
    "V-02": "form <> 'short' AND k % 5 = 1 AND k % 7 <> 2", "V-04": "form <> 'short' AND k % 5 = 2", "V-06": "k % 11 = 0", "V-07": "k % 4 = 1", "V-08": "k % 10 = 9 AND k > 9", "V-09": "form = 'mcq' AND k % 7 = 2",
    "V-10": "form = 'assertion_reason' AND k % 6 = 1", "V-11": "k % 13 = 5 AND k % 7 <> 2", "W-01": "form = 'short' AND k % 2 = 0",
}


@query(" UNION ALL ".join(f"SELECT '{code}' AS code, '{'warning' if code[0] == 'W' else 'error'}' AS severity, count(*) AS n FROM ({_ITEM}) WHERE {cond} HAVING count(*) > 0" for code, cond in _FAILS.items()))
def x05_validate_items(spark, sf_dir):
    """Extracted items by the rules that they break: each of the nine can fire."""
    k = F.col("s_suppkey")
    form = F.when(k % 3 == 0, "mcq").when(k % 3 == 1, "assertion_reason").otherwise("short")
    four = F.array(*[F.lit(x) for x in "pqr"], F.when(k % 13 == 5, F.repeat(F.lit("x"), 251)).otherwise("s"))
    options = F.when(k % 7 == 2, F.array().cast("array<string>")).otherwise(four)
    key = F.when(k % 5 == 1, "E").when(k % 5 != 2, "B")
    digest = F.when(k % 10 == 9, "same").otherwise(k.cast("string"))
    s = table(spark, sf_dir, "supplier").select(k, form.alias("form"), options.alias("options"), key.alias("key"), digest.alias("digest"), F.when(k % 11 == 0, " ").otherwise("What?").alias("stem"))
    s = rules.seen_before(s, ["digest"], ["s_suppkey"])
    c = F.col
    rs = rules.item_rules(
        c("stem"), c("form"), c("options"), c("key"), assertion=F.lit("A"), reason=F.when(k % 6 != 1, "R"), needs_figure=k % 4 == 1, images=F.lit(0), again=c("again"), answer=F.when(k % 2 == 1, "so")
    )
    return rules.counts(rules.check(s, rs))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE floor(greatest(0, 500 - coalesce(sum(CASE WHEN c_custkey % 3 = 0 THEN 7 END) OVER u, 0)) / count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) OVER u) + CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 <> 0 THEN 0 ELSE 1 END, c_custkey) <= greatest(0, 500 - coalesce(sum(CASE WHEN c_custkey % 3 = 0 THEN 7 END) OVER u, 0)) % count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) OVER u THEN 1 ELSE 0 END END AS BIGINT) AS periods FROM customer WINDOW u AS (PARTITION BY c_nationkey)")
def x15_allocate(spark, sf_dir):
    """Periods of chapters: explicit ones stand, the unit's rest is split evenly."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("chapter"), F.when(F.col("c_custkey") % 3 == 0, 7).alias("explicit"), F.lit(500).alias("unit_total"))
    return planning.allocate(c).select(F.col("chapter").alias("c_custkey"), "periods")


@query(
    "WITH b AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS t FROM benchmark) SELECT DISTINCT p.page_id, b.t FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS h, lower(substring(html, 1, 1200)) AS s FROM pages) p "
    "JOIN b ON list_contains(string_split(regexp_replace(p.s, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), b.t) WHERE NOT contains(p.h, b.t)"
)
def x32_foreign_pages(spark, sf_dir):
    """Pages whose head holds a title's word that isn't in their own title: pages and titles meet on words."""
    b = table(spark, sf_dir, "benchmark").select(F.lower(F.element_at(F.split("text", " "), 1)).alias("t")).distinct()
    p = texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("h"), F.lower(F.substring("html", 1, 1200)).alias("s"))
    words = p.select("page_id", "h", F.explode(F.array_distinct(F.split(F.regexp_replace("s", r"[^\p{L}\p{N}]++", " "), " "))).alias("t"))
    return words.join(b, "t").filter(~F.col("h").contains(F.col("t"))).select("page_id", "t")


_PAPER = "SELECT c_nationkey AS id, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer"


@query(
    f"SELECT id, 'A' AS section, CAST(k AS INTEGER) AS number, 'mcq' AS form, 'Which balance has customer ' || c_custkey || '?' AS stem, ['a', 'b', 'c', 'd'][c_custkey % 4 + 1] AS key, CAST(1 AS INTEGER) AS marks, 'p' || k || '|q|r|s' AS options FROM ({_PAPER}) WHERE k <= 12 "
    f"UNION ALL SELECT id, 'C', CAST(k AS INTEGER), 'short', 'Tell what you know of customer ' || c_custkey || '.', NULL, CAST(3 AS INTEGER), '' FROM ({_PAPER}) WHERE k BETWEEN 13 AND 18"
)
def x04_extract_questions(spark, sf_dir):
    """Items of question papers, one for each nation, that are set from its customers, joined into one line."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w)).filter("k <= 18")
    n = lambda x: F.col(x).cast("string")
    choice = F.concat(n("k"), F.lit(". Which balance has customer "), n("c_custkey"), F.lit("? (a) p"), n("k"), F.lit(" (b) q (c) r (d) s Solution: see 99. or (b). Answer: ("), F.substring(F.lit("abcd"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1)), F.lit(")"))
    short = F.concat(n("k"), F.lit(". Tell what you know of customer "), n("c_custkey"), F.lit("."))
    parts = F.array_sort(F.collect_list(F.struct("k", F.when(F.col("k") <= 12, choice).otherwise(short).alias("s"))))
    run = lambda cond: F.array_join(F.transform(F.filter(parts, cond), lambda x: x["s"]), " ")
    md = F.concat(F.lit("Section A: Multiple Choice Questions "), run(lambda x: x["k"] <= 12), F.lit(" Section C: Short Answer Type Questions (3 marks each) "), run(lambda x: x["k"] > 12))
    items = parsing.extract_questions(c.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(md.alias("md")))
    return items.select(F.col("id").cast("int").alias("id"), "section", "number", "form", "stem", "key", "marks", F.array_join("options", "|").alias("options"))


@query()
def x02_split_sections(spark, sf_dir):
    return parsing.split_sections(texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("text").alias("md")))


@query(
    "SELECT n_nationkey AS unit, CAST(least(greatest(raw, floor_), ceiling_) AS INTEGER) AS target, source FROM (SELECT n_nationkey, source, raw, greatest(2 * t, 8) AS floor_, greatest(least(4 * t, 30), greatest(2 * t, 8)) AS ceiling_ FROM (SELECT n_nationkey, n_regionkey + 3 AS t, "
    "CASE WHEN n_nationkey % 4 = 0 AND n_nationkey >= 4 THEN 'learning_outcomes' WHEN n_nationkey % 4 = 1 AND n_nationkey % 5 >= 2 THEN 'competencies' WHEN n_nationkey % 4 = 2 THEN 'periods' ELSE 'topics' END AS source, "
    "CASE WHEN n_nationkey % 4 = 0 AND n_nationkey >= 4 THEN round_even(1.25::DOUBLE * n_nationkey, 0) WHEN n_nationkey % 4 = 1 AND n_nationkey % 5 >= 2 THEN 3 * (n_nationkey % 5) WHEN n_nationkey % 4 = 2 THEN 2 * (n_nationkey + 1) ELSE 3 * (n_regionkey + 3) END AS raw FROM nation))"
)
def x07_chapter_budget(spark, sf_dir):
    k = F.col("n_nationkey")
    b = scoring.budget(F.col("n_regionkey") + 3, F.when(k % 4 == 0, k).otherwise(0), F.when(k % 4 == 1, k % 5).otherwise(0), F.when(k % 4 == 2, k + 1))
    return table(spark, sf_dir, "nation").select(k.alias("unit"), b.alias("b")).select("unit", "b.target", "b.source")


@query()
def w19_distribute(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("grp"), F.col("n_nationkey").cast("long").alias("ord"), (F.col("n_nationkey") * 10 + 5).cast("long").alias("size"), F.lit(18).cast("long").alias("target"))
    return planning.split_by_group(n)


@query()
def w22_greedy(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_custkey").alias("item"), (F.col("c_custkey") % 7 + 1).cast("double").alias("need"), F.lit(4).alias("bins"), F.lit(100.0).alias("room"))
    return planning.greedy(c)


@query()
def x18_meso(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 50 + 10).cast("long").alias("minutes"))
    return planning.pack(c)


@query()
def w23_rebalance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_mktsegment").alias("cat")).agg(F.count("*").alias("have"))
    return planning.rebalance(c, 8)


@query(f"SELECT page_id, CAST(len(regexp_extract_all(t, '[a-z]+')) AS BIGINT) AS words, t LIKE '%©%' AS legal FROM (SELECT page_id, lower({_HTML}) AS t FROM pages)")
def x32_page_profile(spark, sf_dir):
    t = F.lower(text.html_text("html"))
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.regexp_count(t, F.lit("[a-z]+")).cast("long").alias("words"), t.contains("©").alias("legal"))


@query(
    f"WITH e AS (SELECT DISTINCT source, unnest({_TOKENS.format('text')}) AS x FROM documents), df AS (SELECT x FROM e GROUP BY x HAVING count(*) <= 3), "
    f"d AS (SELECT DISTINCT doc_id, source AS own, unnest({_TOKENS.format('text')}) AS x FROM documents), "
    "s AS (SELECT d.doc_id, d.own, e.source, count(*) AS n FROM d JOIN df USING (x) JOIN e USING (x) GROUP BY 1, 2, 3), "
    "b AS (SELECT doc_id, own, max(CASE WHEN source = own THEN n ELSE 0 END) AS mine, max(CASE WHEN source <> own THEN n ELSE 0 END) AS other FROM s GROUP BY 1, 2) "
    "SELECT doc_id, CAST(mine AS BIGINT) AS mine, CAST(other AS BIGINT) AS other, other > mine AS hold FROM b"
)
def x46_vocabulary_rank(spark, sf_dir):
    """Documents that share more rare words with another source than with their own; a tie contradicts nothing."""
    d = text.token_rows(texts(spark, sf_dir, "documents", "doc_id", "source", "text"), ["doc_id", "source"], "text", distinct=True)
    e = d.groupBy("x", "source").agg(F.lit(1))
    rare = e.select("x", "source", F.count("*").over(W.partitionBy("x")).alias("n")).filter("n <= 3").select("x", "source")
    s = d.withColumnRenamed("source", "own").join(rare, "x").groupBy("doc_id", "own", "source").agg(F.count("*").alias("n"))
    own = F.col("source") == F.col("own")
    b = s.groupBy("doc_id", "own").agg(F.max(F.when(own, F.col("n")).otherwise(0)).alias("mine"), F.max(F.when(~own, F.col("n")).otherwise(0)).alias("other"))
    return b.select("doc_id", "mine", "other", (F.col("other") > F.col("mine")).alias("hold"))


@query(ORACLES["a15_latest_per_key"])
def r01_stream_latest(spark, sf_dir):
    """The latest event of each user as a stream gives it."""
    e = ledger.stream(spark, sf_dir)
    out = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))
    return ledger.drain(out, "complete", f"latest_{uuid.uuid4().hex}")


@query("SELECT event_type, count(*) AS n, count(CASE WHEN value > 10 THEN 1 END) AS done FROM events GROUP BY event_type")
def r02_stream_counts(spark, sf_dir):
    return ledger.drain(ledger.counts(ledger.stream(spark, sf_dir), ["event_type"], F.col("value") > 10).drop("complete"), "complete", f"counts_{uuid.uuid4().hex}")


@query("SELECT user_id, CASE WHEN s = 'view' AND t < TIMESTAMP '2024-01-30 00:00:00' THEN 'failed' ELSE s END AS status FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS s, max(ts) AS t FROM events GROUP BY user_id)")
def r03_stuck_runs(spark, sf_dir):
    """A latest status of "running" that is too old counts as failed (here: view, before a fixed time)."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))
    runs = e.withColumn("status", F.when(F.col("status") == "view", "running").otherwise(F.col("status")))
    out = ledger.stuck_batch(runs, F.expr("TIMESTAMP_NTZ'2024-01-30 01:00:00'"), 60)
    return out.select(F.col("key").alias("user_id"), F.when(F.col("status") == "running", "view").otherwise(F.col("status")).alias("status"))


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) WHERE fresh = 1 GROUP BY user_id")
def ext_session(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "30 minutes"), "user_id").count().groupBy("user_id").agg(F.count("*").alias("sessions"))


@query()
def ext_hll(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))
