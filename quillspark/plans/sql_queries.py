"""Queries given as Spark SQL, each with a twin in the other dialect's own functions."""

from __future__ import annotations

from quillspark.plans.registry import sql

# --- predicates and coercions
sql(
    "p09_json_missing",
    "SELECT event_id FROM events WHERE coalesce(get_json_object(props, '$.missing'), '') = ''",
    "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.missing'), '') = ''",
)

# --- joins
sql(
    "j05_normalised_key",
    r"SELECT p.p_partkey, q.n FROM part p JOIN (SELECT lower(regexp_replace(p_brand, '[\\s\\-]', '')) AS k, count(*) AS n FROM part GROUP BY 1) q ON lower(regexp_replace(p.p_brand, '[\\s\\-]', '')) = q.k",
    r"SELECT p.p_partkey, q.n FROM part p JOIN (SELECT lower(regexp_replace(p_brand, '[\s\-]', '', 'g')) AS k, count(*) AS n FROM part GROUP BY 1) q ON lower(regexp_replace(p.p_brand, '[\s\-]', '', 'g')) = q.k",
)
sql("j22_prefix_hash", "SELECT p, min(doc_id) AS doc_id FROM (SELECT doc_id, substring(sha2(CAST(doc_id AS STRING), 256), 1, 5) AS p FROM documents) GROUP BY p HAVING count(*) = 1", "SELECT p, min(doc_id) AS doc_id FROM (SELECT doc_id, substring(sha256(CAST(doc_id AS VARCHAR)), 1, 5) AS p FROM documents) GROUP BY p HAVING count(*) = 1")

# --- aggregates
sql("a11_listagg", "SELECT n_regionkey, array_join(sort_array(collect_set(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql(
    "a12_nested_group",
    "SELECT r_regionkey, array_join(transform(sort_array(collect_list(struct(n_nationkey, n_name))), x -> concat(x.n_nationkey, ':', x.n_name)), ';') AS items FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey",
    "SELECT r_regionkey, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS items FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey",
)
sql("a21_normalised_distribution", "SELECT lang, source, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY lang, source", "SELECT lang, source, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE) AS share FROM documents GROUP BY lang, source")

# --- sorts and top rows
sql("o03_field_order", "SELECT event_type, n, array_position(array('signup', 'view', 'click', 'purchase', 'error'), event_type) AS at FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)", "SELECT event_type, n, CAST(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS BIGINT) AS at FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")

# --- scalars
sql("m01_json_parse", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql(
    "m03_first_key",
    "SELECT event_id, coalesce(nullif(get_json_object(props, '$.answer'), ''), nullif(get_json_object(props, '$.k'), '')) AS v FROM events",
    "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.answer'), ''), nullif(json_extract_string(props, '$.k'), '')) AS v FROM events",
)
sql("n01_rounding", "SELECT l_orderkey, l_linenumber, floor(l_quantity * 1.25 + 0.5) AS half_up FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 1.25::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS half_up FROM lineitem")
sql("d03_minutes_between", "SELECT event_id, CAST(floor((unix_timestamp(ts) - unix_timestamp(p)) / 60) AS BIGINT) AS minutes FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)", "SELECT event_id, CAST(floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', p))) / 60) AS BIGINT) AS minutes FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
sql("d04_time_format", "SELECT event_id, date_format(ts, 'hh:mm a') AS t FROM events", "SELECT event_id, strftime(ts, '%I:%M %p') AS t FROM events")
sql("d10_hour_minute", "SELECT event_id, date_format(ts, 'HH:mm') AS t FROM events", "SELECT event_id, strftime(ts, '%H:%M') AS t FROM events")

# A correlated subquery, which Catalyst turns into a join; the twin is written as one.
sql(
    "j12_scalar_subquery",
    "SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c",
    "SELECT c.c_custkey, coalesce(o.n, 0) AS n, o.best FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
)
