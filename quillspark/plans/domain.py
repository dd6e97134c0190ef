"""Queries of the education operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import education as E
from quillspark.functions import text as T
from quillspark.operators import audits, bank, curriculum, layout, relational
from quillspark.plans.registry import query
from quillspark.session import table


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def p01_optional_filter(spark, sf_dir):
    return relational.optional(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_name <> b.n_name AND (starts_with(a.n_name, b.n_name) OR starts_with(b.n_name, a.n_name))")
def p05_prefix_either_way(spark, sf_dir):
    """Names of which either begins with the other, both ways round, by equality joins on prefixes."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = relational.prefix_pairs(n, "n_name")
    ids = lambda c, k: n.select(F.col("n_name").alias(c), F.col("n_nationkey").alias(k))
    x = p.join(ids("a", "ka"), "a").join(ids("b", "kb"), "b")
    return x.select(F.col("ka").alias("a"), F.col("kb").alias("b")).unionByName(x.select(F.col("kb").alias("a"), F.col("ka").alias("b")))


@query(r"SELECT p_partkey, TRY_CAST(regexp_extract(p_brand || ' x', '-?\d+', 0) AS INTEGER) AS n FROM part")
def p12_safe_int(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_int(F.concat("p_brand", F.lit(" x"))).alias("n"))


@query(r"SELECT c_custkey, regexp_replace(trim(CAST(c_custkey AS VARCHAR) || '.0 '), '^(-?\d+)\.0+$', '\1') AS v FROM customer")
def p13_cell_cleaning(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.cell(F.concat(F.col("c_custkey").cast("string"), F.lit(".0 "))).alias("v"))


@query("SELECT source, CAST(floor(1000 * (CASE WHEN bad = 0 THEN m ELSE m * 0.85::DOUBLE END)) AS BIGINT) AS milli FROM (SELECT source, CAST(sum(quality) AS DOUBLE) / count(*) AS m, sum(toxic) AS bad FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)")
def a17_chapter_confidence(spark, sf_dir):
    """Mean confidence of a chapter, discounted when its audit failed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    g = d.groupBy("source").agg((F.sum("quality").cast("double") / F.count("*")).alias("m"), F.sum("toxic").alias("bad"))
    return g.select("source", F.floor(1000 * F.when(F.col("bad") == 0, F.col("m")).otherwise(F.col("m") * 0.85)).alias("milli"))


_UNREL = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({1})))"
_S = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    "SELECT grp, count(*) AS rows, CAST(sum(CASE WHEN len(a) >= 4 AND len(b) >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS scored, CAST(sum(CASE WHEN len(a) >= 4 AND len(b) >= 4 AND len(list_intersect(a, b)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unrelated "
    f"FROM (SELECT u.conv_id % 10 AS grp, {_UNREL.format('u.text', _S)} AS a, {_UNREL.format('v.text', _S)} AS b FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1) GROUP BY grp"
)
def x29_binding(spark, sf_dir):
    """Answers (the next turn) that share no word with their stem, by group."""
    c = table(spark, sf_dir, "conversations")
    v = c.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("answer"))
    i = c.join(v, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))).select((F.col("conv_id") % 10).alias("grp"), F.col("text").alias("stem"), "answer")
    return audits.answer_binding(i)


@query()
def x30_alignment_slip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return audits.alignment(c.select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), T.stems("text").alias("probe"), T.stems("text").alias("stem")))


@query(
    "WITH r AS (SELECT c_nationkey AS chapter, CAST(floor(rn / 20) AS BIGINT) AS g, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer) GROUP BY 1, 2), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY n DESC, g) AS k, sum(n) OVER (PARTITION BY chapter) AS total, count(*) OVER (PARTITION BY chapter) AS runs FROM r) "
    "SELECT a.chapter, CAST(a.g * 100000 + (a.first) AS BIGINT) AS first, a.n FROM m a JOIN m b ON a.chapter = b.chapter AND b.k = 1 WHERE a.k > 1 AND a.n >= 5 AND a.total >= 12 AND a.runs > 1 AND a.g % 2 <> b.g % 2"
)
def x31_misfiled_blocks(spark, sf_dir):
    """Blocks of ids that lie far from the rest of their chapter and speak of other things: every second block of 20 customers does."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("g", F.floor((F.row_number().over(w) - 1) / 20))
    words = F.when(F.col("g") % 2 == 0, F.lit("light mirror lens ray")).otherwise(F.lit("cell tissue organ plant"))
    return audits.misfiled_blocks(c.select(F.col("c_nationkey").alias("chapter"), (F.col("g") * 100_000 + F.col("c_custkey")).alias("id"), words.alias("text")), gap=50_000).select("chapter", "first", "n")


@query("SELECT part_, number, CASE WHEN n >= 2 THEN part_ || '.' || number ELSE CAST(number AS VARCHAR) END AS label FROM (SELECT CAST(l_linenumber AS VARCHAR) AS part_, l_orderkey AS number, l_suppkey AS book FROM lineitem) i JOIN (SELECT book, count(*) FILTER (WHERE f <= 2) AS n FROM (SELECT l_suppkey AS book, l_linenumber AS p, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2) GROUP BY book) g USING (book)")
def x34_merge_parts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").cast("string").alias("part"), F.col("l_orderkey").alias("number"))
    return audits.merge_parts(li).select(F.col("part").alias("part_"), "number", "label")


@query("SELECT doc_id, CASE WHEN CAST(text LIKE '%token%' AS INTEGER) + CAST(text LIKE '%License%' AS INTEGER) = 1 THEN CASE WHEN text LIKE '%token%' THEN 1 ELSE 2 END END AS target FROM documents")
def x37_rule_plan(spark, sf_dir):
    """The one rule that a row matches; none or several leave it open."""
    return audits.rule_plan(table(spark, sf_dir, "documents").select("doc_id", "text"), [(1, "token"), (2, "License")], "text").select("doc_id", "target")


@query("SELECT user_id % 20 AS run_id, count(*) AS total, count(CASE WHEN s = 'purchase' THEN 1 END) AS done, count(CASE WHEN s = 'error' THEN 1 END) AS failed FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS s FROM events GROUP BY user_id) GROUP BY 1")
def x39_queue_status(spark, sf_dir):
    """Runs by the latest status of their keys."""
    e = relational.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "ts"])
    status = T.lookup({"purchase": "done", "error": "failed"}, F.col("event_type"), "running")
    runs = e.select((F.col("user_id") % 20).alias("run_id"), F.col("user_id").alias("key"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return audits.latest_runs(runs, F.lit("2024-02-01").cast("timestamp")).select("run_id", "total", "done", "failed")


@query("SELECT n_nationkey AS id, r_name AS goal, n_name AS competency FROM nation JOIN region ON n_regionkey = r_regionkey")
def x12_curriculum_frame(spark, sf_dir):
    """The frame of goals and competencies, from one list of nodes."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("code"), F.lit("goal").alias("type"), F.lit(None).cast("int").alias("parent_id"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("code"), F.lit("competency").alias("type"), F.col("n_regionkey").alias("parent_id"))
    return curriculum.frame(r.unionByName(n)).filter("type = 'competency'").select((F.col("id") - 100).alias("id"), "goal", "competency")


@query("SELECT l_orderkey AS item, arg_max(l_partkey, row(l_quantity, -(l_linenumber * 1000000 + l_partkey))) AS node FROM lineitem GROUP BY l_orderkey")
def x14_mirror_primary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("node"), F.col("l_quantity").alias("score"))
    return curriculum.primary(li)


@query("SELECT s_suppkey AS item, n.node FROM supplier LEFT JOIN (SELECT lower(n_name) AS k, min(n_nationkey) AS node FROM nation WHERE n_nationkey < 15 GROUP BY 1) n ON n.k = 'nation' || s_nationkey OR n.k = 'nation_' || s_nationkey")
def x13_resync(spark, sf_dir):
    """Codes that compare without case and dashes find their ids again."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return curriculum.resync(s.select(F.col("s_suppkey").alias("item"), F.upper("n_name").alias("code")), n).select("item", "node")


@query("SELECT b.p_brand AS concept, t.level, t.want, coalesce(h.n, 0) AS have, greatest(0, t.want - coalesce(h.n, 0)) AS gap FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (VALUES ('ECONOMY', 20), ('PROMO', 5)) t(level, want) LEFT JOIN (SELECT p_brand, split_part(p_type, ' ', 1) AS level, count(*) AS n FROM part GROUP BY 1, 2) h ON h.p_brand = b.p_brand AND h.level = t.level")
def x23_concept_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.element_at(F.split("p_type", " "), 1).alias("level"), F.lit("any").alias("form"))
    blueprint = spark.createDataFrame([("ECONOMY", "any", 20), ("PROMO", "any", 5)], "level string, form string, want int")
    return curriculum.concept_plan(p, blueprint, p.select("concept").distinct()).select("concept", "level", "want", "have", "gap")


@query()
def x40_reading_order(spark, sf_dir):
    """Layout blocks in reading order (line items stand in for blocks; unit tests pin the order)."""
    li = table(spark, sf_dir, "lineitem")
    b = li.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 5).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 600).alias("x1"), (F.col("l_quantity") * 15).cast("int").alias("y1"), (F.col("l_partkey") % 600 + 80).alias("x2"), (F.col("l_quantity") * 15 + 12).cast("int").alias("y2"), F.col("l_returnflag").alias("text"))
    return layout.reading_order(b).select("doc", "page", "id", "band", "pos")


@query("SELECT o_orderkey, CASE WHEN o_custkey <= 0 THEN '-' WHEN o_custkey * 7 >= 3600 THEN (o_custkey * 7) // 3600 || 'h ' || lpad(CAST((o_custkey * 7) % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN o_custkey * 7 >= 60 THEN (o_custkey * 7) // 60 || 'm ' || lpad(CAST((o_custkey * 7) % 60 AS VARCHAR), 2, '0') || 's' ELSE o_custkey * 7 || 's' END AS took FROM orders")
def t36_human_duration(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", E.human_duration(F.col("o_custkey") * 7).alias("took"))


@query("SELECT p_partkey, trim(regexp_replace(replace(replace(lower(p_name), '+', ' plus '), '=', ' equals '), '[^a-z0-9]+', ' ', 'g')) AS o, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def t16_option_and_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", E.norm_option("p_name").alias("o"), E.slug("p_name").alias("slug"))


@query("SELECT event_id, nullif(json_extract_string(props, '$.k'), '') AS v FROM events")
def m03_first_key_builder(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", E.first_key("props", "answer", "k").alias("v"))


@query("SELECT n_nationkey, CAST(floor(1000 * coalesce(k, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE a + (b - a) * (n_nationkey - ao) / (bo - ao) END)) AS BIGINT) AS milli FROM (SELECT n_nationkey, k, last_value(k IGNORE NULLS) OVER p AS a, last_value(CASE WHEN k IS NOT NULL THEN n_nationkey END IGNORE NULLS) OVER p AS ao, first_value(k IGNORE NULLS) OVER f AS b, first_value(CASE WHEN k IS NOT NULL THEN n_nationkey END IGNORE NULLS) OVER f AS bo FROM (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey * n_nationkey AS DOUBLE) END AS k FROM nation) WINDOW p AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
def w07_interpolate(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, (F.col("n_nationkey") * F.col("n_nationkey")).cast("double")).alias("k"))
    return layout.interpolate(n, "n_regionkey", "n_nationkey", "k").select("n_nationkey", F.floor(1000 * F.col("k")).alias("milli"))


@query("SELECT p_partkey FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25 DESC, p_partkey % 2 = 0 DESC, p_size % 4 DESC, p_partkey) AS rn FROM part) ORDER BY rn, p_brand LIMIT 40")
def x22_select_items(spark, sf_dir):
    """Items dealt over concepts, each concept's best first."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.col("p_partkey").alias("ord"), (F.col("p_size") > 25).alias("grounded"), (F.col("p_partkey") % 2 == 0).alias("keyed"), (F.col("p_size") % 4).alias("dok"))
    return bank.select_items(p, 40).select(F.col("ord").alias("p_partkey"))


@query("SELECT n_nationkey, CAST(ceil(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) / 2.0) AS INTEGER) AS batch FROM nation")
def x49_batches(spark, sf_dir):
    return bank.batches(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", 2).select("n_nationkey", "batch")


@query("SELECT p_brand AS concept, p_type AS level, CAST(sum(p_size) AS DOUBLE) / CAST(sum(sum(p_size)) OVER (PARTITION BY p_brand) AS DOUBLE) AS share FROM part GROUP BY p_brand, p_type")
def x44_merge_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("level"), F.col("p_size").cast("double").alias("share"))
    return bank.merge_blocks(p)


@query("SELECT subject, institute AS source FROM (SELECT c_mktsegment AS subject, c_nationkey AS institute, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey = 7 DESC, count(*) DESC, c_nationkey) AS rn FROM customer GROUP BY 1, 2) WHERE rn = 1")
def x19_content_source(spark, sf_dir):
    """The wanted institute where it has content, else the one with most."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("subject"), F.col("c_nationkey").alias("institute"))
    return bank.content_source(c, c.select("subject").distinct().withColumn("institute", F.lit(7)))


@query("SELECT s_suppkey, n_nationkey AS nation_id, n_nationkey IS NULL AS open_ FROM supplier LEFT JOIN (SELECT lower(trim(n_name)) AS k, min(n_nationkey) AS n_nationkey FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1) n ON n.k = (SELECT lower(trim(m.n_name)) FROM nation m WHERE m.n_nationkey = s_nationkey)")
def x50_resolve_ids(spark, sf_dir):
    """Names to ids by folded name, and what stays open."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.upper("n_name").alias("nation"))
    dim = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return bank.resolve_ids(s, {"nation": dim}).select("s_suppkey", "nation_id", (F.size("unresolved") > 0).alias("open_"))


@query("SELECT c_mktsegment AS subject, c_custkey AS chapter, a AS first_day, b AS last_day FROM (SELECT c_mktsegment, c_custkey, CASE WHEN e - n + 1 <= 500 THEN DATE '2024-01-01' + CAST(e - n AS INTEGER) END AS a, CASE WHEN e <= 500 THEN DATE '2024-01-01' + CAST(e - 1 AS INTEGER) END AS b FROM (SELECT c_mktsegment, c_custkey, c_custkey % 3 + 1 AS n, sum(c_custkey % 3 + 1) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS e FROM customer))")
def x17_macro_plan(spark, sf_dir):
    """Chapters on a subject's teaching days, each after those before it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("subject"), F.col("c_custkey").alias("chapter"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 3 + 1).alias("periods"))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), 499)))
    slots = c.select("subject").distinct().select("subject", days.alias("day"), F.lit(1).alias("n"))
    return bank.macro_plan(c, slots).select("subject", "chapter", "first_day", "last_day")


@query(
    "SELECT s_suppkey AS id, f AS form, m AS marks, CASE v WHEN 0 THEN 'analyze' WHEN 1 THEN 'apply' ELSE 'recall' END AS bloom, CASE v WHEN 0 THEN CASE WHEN m <= 1 THEN 2 ELSE 3 END WHEN 1 THEN 2 ELSE 1 END AS dok, "
    "CASE v WHEN 0 THEN 'conceptual' WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'procedural' ELSE 'conceptual' END ELSE 'factual' END AS knowledge, CASE WHEN q THEN 'objective' WHEN s_suppkey % 5 = 0 THEN 'case_based' ELSE CASE WHEN m <= 1 THEN 'objective' ELSE 'short_answer' END END AS blueprint, "
    "CASE WHEN q THEN 'medium' ELSE 'low' END AS guessing, CASE v WHEN 0 THEN 'slow_analysis' WHEN 1 THEN 'medium_application' ELSE 'fast_recall' END AS latency_band, CASE WHEN s_suppkey % 2 = 0 THEN 'numerical' ELSE 'verbal' END AS aptitude, CASE WHEN s_suppkey % 12 <= 8 THEN 'Middle' ELSE 'Secondary' END AS stage "
    "FROM (SELECT *, s_suppkey % 3 AS v, s_suppkey % 4 = 0 AS q, CASE WHEN s_suppkey % 4 = 0 THEN 'mcq' WHEN s_suppkey % 3 = 1 THEN 'numerical' ELSE 'very_short' END AS f, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1 WHEN s_suppkey % 3 = 1 THEN 3 ELSE 1 END AS INTEGER) AS m FROM supplier)"
)
def x27_item_metadata(spark, sf_dir):
    """Derived metadata of items that are set from suppliers."""
    k = F.col("s_suppkey")
    stem = F.concat(F.when(k % 3 == 0, "Compare ").when(k % 3 == 1, "Calculate ").otherwise("Define "), F.lit("the offer of "), "s_name", F.lit("."))
    items = table(spark, sf_dir, "supplier").select(
        k.alias("id"), stem.alias("stem"), (k % 4 == 0).alias("is_mcq"), F.when(k % 2 == 0, "Maths").otherwise("English").alias("subject"), (k % 12).alias("standard"),
        F.when((k % 5 == 0) & (k % 4 != 0), "Case based questions").when(k % 4 == 0, "Objective").alias("section"),
    )
    return bank.metadata(items).select("id", "form", "marks", "bloom", "dok", "knowledge", "blueprint", "guessing", "latency_band", "aptitude", "stage")


_BAG = "SELECT conv_id * 100 + turn AS id, role AS grp, w, count(*) AS k FROM (SELECT conv_id, turn, role, unnest(list_filter(string_split(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:6], ' ')), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN (" + _S + "))) AS w FROM conversations) GROUP BY ALL"


@query(
    f"WITH b AS ({_BAG}), n AS (SELECT id, sum(k) AS n FROM b GROUP BY id) SELECT p.id AS a, q.id AS b, CAST(floor(1000 * CAST(sum(least(p.k, q.k)) AS DOUBLE) / least(max(x.n), max(y.n))) AS BIGINT) AS milli FROM b p JOIN b q ON p.grp = q.grp AND p.w = q.w AND p.id < q.id "
    "JOIN n x ON x.id = p.id JOIN n y ON y.id = q.id GROUP BY p.id, q.id HAVING CAST(sum(least(p.k, q.k)) AS DOUBLE) / least(max(x.n), max(y.n)) > 0.5"
)
def x36_near_duplicate_items(spark, sf_dir):
    """Turns of one role whose first words, as bags, share more than half of the smaller."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("grp"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), first.alias("stem"))
    return bank.near_duplicates(c, 0.5).select("a", "b", F.floor(1000 * F.col("overlap")).alias("milli"))
