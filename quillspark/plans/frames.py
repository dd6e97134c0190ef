"""Queries that are plain joins, aggregates, windows, sorts and set operations, as DataFrames; each twin is SQL of its own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.functions import text as T
from quillspark.operators import curriculum, planning, relational, rules
from quillspark.plans.registry import query
from quillspark.session import table
from quillspark.streaming import ledger


@query("SELECT c_custkey, coalesce(CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END, 1) = 1 AS visible FROM customer")
def p02_visibility(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shown = F.when(F.col("c_custkey") % 3 == 1, 1).when(F.col("c_custkey") % 3 == 2, 0)
    return c.select("c_custkey", (F.coalesce(shown, F.lit(1)) == 1).alias("visible"))


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderdate END IS NULL")
def p03_not_deleted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return o.filter(F.col("deleted_at").isNull()).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE lower(trim(coalesce(c_mktsegment, ''))) = 'building'")
def p04_folded_equality(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.lower(F.trim(F.coalesce("c_mktsegment", F.lit("")))) == "building").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 39 AND 43")
def p06_range(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_size").between(39, 43)).select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def p07_in_list(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(1, 3))
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def p10_queue_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") > 1000))
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'no price' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END, CASE WHEN o_custkey % 10 = 0 THEN 'held' END) AS reason FROM orders")
def p11_first_reason(spark, sf_dir):
    reasons = [(F.col("o_totalprice").isNull() | (F.col("o_totalprice") <= 0), "no price"), (F.col("o_orderstatus") == "F", "closed"), (F.col("o_custkey") % 10 == 0, "held")]
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.first_reason(*reasons).alias("reason"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(CAST(l_quantity AS BIGINT), 10), 40) AS q, substring(l_returnflag || l_linestatus, 1, 1) AS clip FROM lineitem")
def p14_clamp(spark, sf_dir):
    q = scoring.clamp(F.col("l_quantity").cast("long"), 10, 40)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), F.substring(F.concat("l_returnflag", "l_linestatus"), 1, 1).alias("clip"))


@query("SELECT s_suppkey, concat_ws('|', lower(trim(s_name)), CAST(s_nationkey AS STRING), 'x') AS k FROM supplier")
def p15_composite_key(spark, sf_dir):
    k = F.concat_ws("|", F.lower(F.trim("s_name")), F.col("s_nationkey").cast("string"), F.lit("x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("k"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END AS state FROM orders")
def p16_alias_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.lookup({"O": "open", "F": "filled"}, F.col("o_orderstatus"), "partial").alias("state"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'auto_accepted' WHEN c_acctbal >= 5500 THEN 'flagged' ELSE 'low_confidence' END AS band FROM customer")
def p17_banding(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scoring.band(F.col("c_acctbal") / 10000).alias("band"))


@query("SELECT n.n_nationkey, coalesce(o.label, n.n_name) AS label, o.label IS NOT NULL AS is_custom FROM nation n LEFT JOIN (SELECT n_nationkey, upper(n_name) || '!' AS label FROM nation WHERE n_nationkey % 4 = 0) o ON n.n_nationkey = o.n_nationkey")
def p18_defaults_override(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    own = n.filter("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("own"))
    return n.join(own, "n_nationkey", "left").select("n_nationkey", F.coalesce("own", "n_name").alias("label"), F.col("own").isNotNull().alias("is_custom"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def p19_legal_set(spark, sf_dir):
    legal = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return relational.guard(table(spark, sf_dir, "lineitem"), legal, "l_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j01_inner(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("customers"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j02_left_sidecar(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("SELECT c.c_custkey, n.n_name AS competency, r.r_name AS goal, CASE WHEN c.c_acctbal < 0 THEN r.r_name ELSE n.n_name END AS code FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def j03_hierarchy(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return x.select("c_custkey", F.col("n_name").alias("competency"), F.col("r_name").alias("goal"), F.when(F.col("c_acctbal") < 0, F.col("r_name")).otherwise(F.col("n_name")).alias("code"))


@query("SELECT k, n_name FROM (SELECT s.s_suppkey AS k, n.n_name, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY n.n_nationkey) AS rn FROM (SELECT s_suppkey, concat('at nation_', CAST(s_nationkey AS STRING), ' street') AS place FROM supplier) s JOIN nation n ON contains(s.place, lower(n.n_name))) WHERE rn = 1")
def j07_substring_first(spark, sf_dir):
    place = F.concat(F.lit("at nation_"), F.col("s_nationkey").cast("string"), F.lit(" street"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("quote_"), place.alias("t"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("quote"), F.lower("n_name").alias("q"))
    met = relational.contains_join(s.select(F.col("quote_").alias("doc"), "t"), n).groupBy("doc").agg(F.min("quote").alias("k"))
    return met.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select(F.col("doc").alias("k"), "n_name")


@query("SELECT c.c_custkey, o.k IS NOT NULL AS has_order FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.c_custkey = o.k")
def j09_exists_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("has_order"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%')")
def j10_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def j11_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o.o_orderkey, coalesce(l.m, 0) AS m FROM orders o LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS m FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey")
def j13_agg_subquery(spark, sf_dir):
    r = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("m")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(r)
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left").select("o_orderkey", F.coalesce("m", F.lit(0)).alias("m"))


@query("SELECT p.p_partkey, b.band FROM part p JOIN (SELECT n_nationkey AS band, n_nationkey * 2 AS s, n_nationkey * 2 + 2 AS e FROM nation) b ON p.p_size >= b.s AND p.p_size < b.e")
def j15_interval(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("band"), F.explode(F.array(F.col("n_nationkey") * 2, F.col("n_nationkey") * 2 + 1)).alias("p_size"))
    return table(spark, sf_dir, "part").join(n, "p_size").select("p_partkey", "band")


@query("SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)")
def j26_two_anti_joins(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size BETWEEN 5 AND 15")
def j28_range_on(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(F.col("p_size").between(5, 15))
    return table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def j29_best_existing(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"], ["o_orderkey"])


@query("SELECT s.s_suppkey, n.n_nationkey, r.r_regionkey, n.n_nationkey IS NULL OR r.r_regionkey IS NULL AS unresolved FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey < 20 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def j30_resolve_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20")
    x = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select("s_suppkey", "n_nationkey", "r_regionkey", (F.col("n_nationkey").isNull() | F.col("r_regionkey").isNull()).alias("unresolved"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a01_group_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CAST(l.quality AS STRING), 'untyped') AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def a02_null_bucket(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("untyped")).alias("quality")).agg(F.count("*").alias("n"))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n, CAST(coalesce(sum(o.o_orderkey % 100), 0) AS BIGINT) AS s FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def a03_zero_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 100).alias("s"))
    x = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return x.select("c_custkey", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n", "s")])


@query("SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS n FROM orders GROUP BY o_orderpriority")
def a04_conditional_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def a05_coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_linestatus, greatest(CAST(floor(avg(CASE WHEN l_quantity > 25 THEN l_quantity WHEN l_quantity > 5 THEN 20 ELSE 10 END) + 0.5) AS BIGINT), 20) AS m FROM lineitem GROUP BY l_linestatus")
def a06_avg_case(spark, sf_dir):
    v = F.when(F.col("l_quantity") > 25, F.col("l_quantity")).when(F.col("l_quantity") > 5, 20).otherwise(10)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.greatest(F.floor(F.avg(v) + 0.5).cast("long"), F.lit(20)).alias("m"))


@query("SELECT c_nationkey, CAST(floor(CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS BIGINT) AS mean_cents FROM customer GROUP BY c_nationkey")
def a07_rounded_average(spark, sf_dir):
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.floor(F.sum(cents).cast("double") / F.count("*")).alias("mean_cents"))


@query("SELECT l_orderkey, max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS any_big FROM lineitem GROUP BY l_orderkey")
def a08_any_true(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0.08).cast("int").alias("any_big"))


@query("SELECT p_name, p_brand, min(p_partkey) AS keeper, count(*) AS n FROM part GROUP BY p_name, p_brand HAVING count(*) > 1")
def a09_keeper_having(spark, sf_dir):
    g = relational.duplicates(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey")
    return g.select("p_name", "p_brand", "keeper", "n").distinct()


@query("SELECT o_orderstatus, o_orderpriority FROM (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY o_orderstatus, o_orderpriority) WHERE rn = 1")
def a10_modal_value(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").count()
    return relational.top_k(n, ["o_orderstatus"], [F.desc("count"), F.col("o_orderpriority")], 1).select("o_orderstatus", "o_orderpriority")


@query("SELECT e.event_type, e.n, x.want, e.n < x.want AS warning FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) e LEFT JOIN (SELECT 'click' AS t, 4000 AS want UNION ALL SELECT 'error', 100 UNION ALL SELECT 'purchase', 2000) x ON x.t = e.event_type")
def a13_section_fingerprint(spark, sf_dir):
    want = {"click": 4000, "error": 100, "purchase": 2000}
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.withColumn("want", T.lookup(want, F.col("event_type"))).select("event_type", "n", "want", (F.col("n") < F.col("want")).alias("warning"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def a14_counter(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, count(CASE WHEN event_type <> 'error' THEN 1 END) AS done, count(*) = count(CASE WHEN event_type <> 'error' THEN 1 END) AS complete FROM events GROUP BY user_id")
def a16_completeness(spark, sf_dir):
    return ledger.counts(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error")


@query("SELECT doc_id, CAST(sum(CASE WHEN s = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN s = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM (SELECT doc_id, 'error' AS s FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'warning' FROM labels WHERE quality = 0) GROUP BY doc_id")
def a19_issue_tally(spark, sf_dir):
    found = rules.check(table(spark, sf_dir, "labels"), [rules.Rule("toxic", "error", F.col("toxic") == 1), rules.Rule("poor", "warning", F.col("quality") == 0)])
    return rules.tally(found, "doc_id").groupBy("doc_id").agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings")).filter("errors + warnings > 0")


@query("SELECT b.p_brand, t.p_type, coalesce(h.n, 0) AS have, greatest(0, 20 - coalesce(h.n, 0)) AS gap FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type) h ON h.p_brand = b.p_brand AND h.p_type = t.p_type")
def a22_blueprint_gap(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("level"), F.lit("any").alias("form"))
    blueprint = p.select("level", "form").distinct().withColumn("want", F.lit(20))
    x = curriculum.concept_plan(p, blueprint, p.select("concept").distinct())
    return x.select(F.col("concept").alias("p_brand"), F.col("level").alias("p_type"), "have", "gap")


@query("SELECT lang, count(*) - count(DISTINCT text) AS duplicate_rows FROM documents GROUP BY lang")
def a25_duplicate_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg((F.count("*") - F.count_distinct("text")).alias("duplicate_rows"))


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def w02_topk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.top_k(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").alias("rn"))


@query("SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderpriority, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def w04_priority_rank(spark, sf_dir):
    first = F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    x = relational.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [first, F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return x.select("o_orderkey", F.col("rank").alias("rn"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, p_size / 20.0 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn <= 5 AND (score >= 1.2 OR rn <= 2)")
def w05_quota_trim(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("ord"), (F.col("p_size") / 20.0).alias("score"), F.lit(9).alias("quota"))
    return planning.enforce_quota(p).filter("kept").select(F.col("topic").alias("p_brand"), F.col("ord").alias("p_partkey"))


@query("SELECT event_id, user_id, lead(event_id, 1, 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events")
def w09_next_boundary(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lead("event_id", 1, 1_000_000).over(w).alias("next_id"))


@query("SELECT a.c_custkey, b.s_suppkey, a.rn FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) a JOIN (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) b ON a.c_nationkey = b.s_nationkey AND a.rn = b.rn")
def w24_positional_pairs(spark, sf_dir):
    rn = lambda by, key: F.row_number().over(W.partitionBy(by).orderBy(key)).alias("rn")
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), rn("c_nationkey", "c_custkey"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), rn("s_nationkey", "s_suppkey"))
    return a.join(b, ["nation", "rn"]).select("c_custkey", "s_suppkey", "rn")


@query("SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE concat(p_name, '-', CAST(rn AS STRING)) END AS code FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def w25_unique_codes(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(rn == 1, F.col("p_name")).otherwise(F.concat_ws("-", "p_name", rn.cast("string"))).alias("code"))


@query("SELECT k, rn FROM (SELECT d.doc_id AS k, row_number() OVER (ORDER BY l.quality NULLS LAST, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id >= 0 AND d.source = 'src1')")
def o01_nulls_last(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source = 'src1'").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("k"), F.row_number().over(W.orderBy(F.col("quality").asc_nulls_last(), "doc_id")).alias("rn"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def o04_newest(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey) AS rn FROM customer) WHERE rn = 1")
def o05_preference(spark, sf_dir):
    best = F.min_by("c_custkey", F.struct((F.col("c_mktsegment") != "BUILDING").alias("other"), "c_custkey"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("SELECT d.doc_id, coalesce(l.quality, 1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY coalesce(l.quality, 1), d.doc_id LIMIT 30")
def o07_worst_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(1)).alias("q")).orderBy("q", "doc_id").limit(30)


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def setops_except(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey").alias("k")
    return o.select(key).subtract(o.filter(F.col("o_orderpriority").startswith("1")).select(key))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def setops_intersect(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return c.intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%') UNION (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def setops_symmetric(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda p: o.filter(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("k"))
    return of("1").subtract(of("2")).union(of("2").subtract(of("1")))


@query("SELECT k, src FROM (SELECT k, src, row_number() OVER (PARTITION BY k ORDER BY src) AS rn FROM (SELECT c_nationkey AS k, 1 AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation)) WHERE rn = 1")
def precedence_union(spark, sf_dir):
    side = lambda t, k, src: table(spark, sf_dir, t).select(F.col(k).alias("k"), F.lit(src).alias("src"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("src"))
    return relational.first_seen(rich.union(side("supplier", "s_nationkey", 2)).union(side("nation", "n_nationkey", 3)), ["k"], ["src"])


@query("SELECT n.n_regionkey AS term, count(*) AS periods, CAST(count(*) * 40 AS BIGINT) AS minutes, CAST(coalesce(max(q.need), 0) AS BIGINT) AS needed, CASE WHEN (count(*) * 40 - coalesce(max(q.need), 0)) * 100 >= 15 * count(*) * 40 THEN 'comfortable' WHEN (count(*) * 40 - coalesce(max(q.need), 0)) * 100 >= 5 * count(*) * 40 THEN 'tight' WHEN count(*) * 40 >= coalesce(max(q.need), 0) THEN 'critical' ELSE 'short' END AS status FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT n_regionkey AS t, count(*) * 1000 AS need FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey) q ON q.t = n.n_regionkey GROUP BY n.n_regionkey")
def x16_capacity(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_regionkey").alias("term_id"))
    slots = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("term_id")
    need = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("term_id").agg((F.count("*") * 1000).alias("needed"))
    return planning.capacity(slots, F.lit(40), need).select(F.col("term_id").alias("term"), "periods", "minutes", "needed", "status")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def x21_cascading_filters(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 2")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT p.p_brand, count(DISTINCT l.l_orderkey) AS orders_, count(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_orderkey END) AS returned FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_brand")
def x38_coverage_report(spark, sf_dir):
    x = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    returned = F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")))
    return x.groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("orders_"), returned.alias("returned"))


@query("SELECT coalesce(a.t, b.t) AS t, coalesce(a.n, 0) + coalesce(b.n, 0) AS seen, a.t IS NULL AS is_new FROM (SELECT p_type AS t, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type) a FULL OUTER JOIN (SELECT p_type AS t, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY p_type) b ON a.t = b.t")
def x48_type_catalogue(spark, sf_dir):
    n = lambda k, name: table(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == k).groupBy(F.col("p_type").alias("t")).agg(F.count("*").alias(name))
    x = n(0, "a").join(n(1, "b"), "t", "full_outer")
    return x.select("t", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("seen"), F.col("a").isNull().alias("is_new"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_linestatus").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def a15_latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def o06_argmax(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most, substring(sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)), 1, 16) AS sha16 FROM orders GROUP BY o_orderpriority")
def a24_fingerprint(spark, sf_dir):
    return relational.fingerprint(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT c_custkey, k FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) WHERE k IS NULL OR k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey % 3 <> 0)")
def p08_not_in_null_aware(spark, sf_dir):
    """NOT IN, whose nulls SQL would lose: rows without a key stay, and null keys of the list (every third) exclude nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("k"))
    return c.join(s, "k", "left_anti")


@query("SELECT page_id, CASE WHEN contains(u, '/') THEN string_split(u, '/')[-1] ELSE u END AS base FROM (SELECT page_id, rtrim(string_split(string_split(url, '#')[1], '?')[1], '/') AS u FROM pages)")
def j23_basename(spark, sf_dir):
    bare = F.regexp_replace("url", "[#?].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(bare, "([^/]+)/*$", 1).alias("base"))


@query(
    "WITH x AS (SELECT o_orderkey, o_custkey % 25 AS mirror, c_nationkey AS owner, o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey) "
    "SELECT o_orderstatus, count(*) AS rows_, count(CASE WHEN mirror <> owner THEN 1 END) AS contradictions, count(CASE WHEN owner IS NULL THEN 1 END) AS orphans, CAST(sum(coalesce(owner, mirror)) AS BIGINT) AS settled FROM x GROUP BY o_orderstatus"
)
def j27_reconcile(spark, sf_dir):
    """Mirrored columns held against their owner: rows without an owner, contradictions, and the sum after the owner's value is taken."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    x = o.select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_custkey") % 25).alias("mirror"))
    r = relational.reconcile(x, c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("owner")), "o_custkey", "mirror", "owner")
    n = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).cast("long")
    return r.groupBy("o_orderstatus").agg(F.count("*").alias("rows_"), n("contradicts").alias("contradictions"), n("orphan").alias("orphans"), F.sum("settled").cast("long").alias("settled"))
