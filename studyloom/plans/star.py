"""Relational queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math as M
from ..operators import calendar, intervals, ledger, relational, topics, windows
from ..operators.sinks import not_unique, orphans, upsert, violates
from ..sources.tables import scan


def nested_order_embed(spark, folder):
    """Every order, inner customer left nation, with its line items nested."""
    orders = scan(spark, folder, "orders", "o_orderkey", "o_custkey")
    lines = scan(spark, folder, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("l_quantity"))
    nested = relational.nest(orders, lines, "o_orderkey", "lines", "l_linenumber")
    customer = scan(spark, folder, "customer", F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = scan(spark, folder, "nation", "n_nationkey", "n_name")
    rows = nested.join(customer, "o_custkey").join(nation, "n_nationkey", "left")
    each = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_quantity"].cast("string")))
    return rows.select("o_orderkey", "n_name", F.size("lines").alias("n"), F.array_join(each, ",").alias("lines"))


def semi_anti_customers(spark, folder):
    customer = scan(spark, folder, "customer", "c_custkey", "c_mktsegment")
    urgent = scan(spark, folder, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority").where(F.col("o_orderpriority") == "1-URGENT")
    with_, without = customer.join(urgent, "c_custkey", "left_semi"), customer.join(urgent, "c_custkey", "left_anti")
    both = with_.select("c_mktsegment", F.lit("with").alias("side")).unionByName(without.select("c_mktsegment", F.lit("without").alias("side")))
    return both.groupBy("c_mktsegment", "side").agg(F.count("*").alias("n"))


def max_correlated_default(spark, folder):
    customer = scan(spark, folder, "customer", "c_custkey")
    orders = scan(spark, folder, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return relational.latest_or(customer, orders, "c_custkey", "o_orderdate", "latest", F.lit("1900-01-01").cast("timestamp_ntz")).select("c_custkey", F.col("latest").cast("date").alias("latest"))


def recency_rank(spark, folder):
    orders = scan(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return windows.recency(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.round("recency", 9).alias("recency"))


def range_bounds(spark, folder):
    """Is an order's date inside any of four overlapping terms, and which session number covers its day of month?"""
    orders = scan(spark, folder, "orders", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    terms = spark.createDataFrame([("1995-01-01", "1995-06-30"), ("1995-05-01", "1995-12-31"), ("1996-03-01", "1996-03-31"), ("1997-09-01", "1998-01-31")], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    inside = relational.within_any(orders, terms, "at", "a", "b", "inside").withColumn("day", F.dayofmonth("at"))
    spans = spark.createDataFrame([(1, 10, "early", 1), (8, 20, "middle", 2), (31, 25, "late", 3)], "lo int, hi int, name string, ord int")
    found = intervals.first_covering(inside, spans, "day", "lo", "hi", "ord", "name", "span")
    return found.groupBy("inside", "span").agg(F.count("*").alias("n"))


def week_buckets(spark, folder):
    from ..functions.dates import day_key, week_start

    orders = scan(spark, folder, "orders", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.to_date(week_start("o_orderdate", "Europe/Madrid")).alias("week"), day_key("o_orderdate", "Europe/Madrid").alias("day")).agg(F.count("*").alias("n"))


def priority_rank(spark, folder):
    """All orders as items: weight from the price, due by date; finished ones are completed; overdue first, then score, then id."""
    now = F.lit("1996-01-01").cast("timestamp")
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "deadline").when(F.col("o_orderpriority") == "5-LOW", "class").otherwise("event")
    items = o.select(
        F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("due"), F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_totalprice") / 10000)).alias("weight_override"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(12.5)).alias("assessment_weight"), F.when(F.col("o_orderstatus") == "F", now).alias("completed_at"),
    )
    return calendar.rank_items(items, now).select(F.col("id").alias("o_orderkey"), "weight", "weight_source", "overdue", F.round("score", 9).alias("score"), "tier")


def weight_verdict(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", (F.col("l_discount") * 1000).alias("percent"))
    return topics.weight_verdict(lines, ["l_orderkey"], "percent").groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.round(F.col("total") * 100).cast("long")).alias("hundredths"))


def page_diff(spark, folder):
    """Order priorities as blocks of two versions: odd keys were in the first, multiples of three are in the second."""
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("topic_id"), F.col("o_orderkey").cast("string").alias("key"), "o_orderkey", "o_orderpriority")
    before = o.where("o_orderkey % 2 = 1").select("topic_id", "key", F.col("o_orderpriority").alias("text"))
    after = o.where("o_orderkey % 3 = 0").select("topic_id", "key", F.when(F.col("o_orderkey") % 5 == 0, "new").otherwise(F.col("o_orderpriority")).alias("text"))
    return topics.page_diff(before, after).groupBy("status", "rank").agg(F.count("*").alias("n"))


def snapshot_diff(spark, folder):
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    stored = o.where("o_orderkey % 4 <> 0")
    fresh = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    diff = calendar.snapshot_diff(stored, fresh, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return diff.select("o_orderkey", "action", F.array_join("changed", ",").alias("changed"))


def tombstones(spark, folder):
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    at = F.col("o_orderdate").cast("timestamp")
    items = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 != 0, "f").alias("feed_id"), F.col("o_orderkey").cast("string").alias("ics_uid"),
        F.when(F.col("o_orderkey") % 3 == 0, F.expr("TIMESTAMP '1997-06-01 00:00:00' - make_interval(0, 0, 0, CAST(o_orderkey % 13 AS INT))")).alias("missing_since"),
        F.when(F.col("o_orderkey") % 7 != 0, at).alias("latest_start"), (F.col("o_orderstatus") == "F").alias("graded"),
    )
    present = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("ics_uid"))
    return calendar.plan_tombstones(items, present, F.lit("1997-06-01").cast("timestamp"))


def exam_weight(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    per = lines.groupBy(F.col("l_orderkey").alias("topic_id")).agg(F.count("*").alias("signals"), F.count_distinct("l_returnflag").alias("sources"), F.count_if(F.col("l_linestatus") == "F").alias("formulas"))
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("topic_id"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").alias("updated_at"))
    rows = o.join(per, "topic_id").select("*", F.lit(0).alias("examples"), F.lit(None).cast("double").alias("override"))
    return topics.topic_weights(rows).select("topic_id", F.round("weight", 9).alias("weight"), M.weight_band(F.round("weight", 9)).alias("band"))


def upsert_orders(spark, folder):
    """Two feeds of order states, the later one winning per key."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return upsert(o.where("o_orderkey % 9 <> 0"), new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def quality_constraints(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    orders = scan(spark, folder, "orders", "o_orderkey", "o_custkey")
    customer = scan(spark, folder, "customer", "c_custkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    checks = (
        (not_unique(lines, ["l_orderkey", "l_linenumber"]), "lineitem key"), (orphans(lines, orders, {"l_orderkey": "o_orderkey"}), "lineitem order"),
        (orphans(orders, customer, {"o_custkey": "c_custkey"}), "order customer"), (violates(lines, F.col("l_discount") <= 0.08), "discount"),
    )
    out = count(*checks[0])
    for check in checks[1:]:
        out = out.unionByName(count(*check))
    return out


def attendance_gate(spark, folder):
    """Users as courses: clicks present, views excused, errors absent; every ninth has no total, every eighth a share of none."""
    ev = scan(spark, folder, "events", F.col("user_id").alias("course_id"), "event_type")
    status = F.when(F.col("event_type") == "click", "present").when(F.col("event_type") == "view", "excused").when(F.col("event_type") == "error", "absent")
    marks = ev.select("course_id", status.alias("status")).where("status IS NOT NULL")
    total = F.when(F.col("course_id") % 9 != 0, F.count("*").cast("int"))
    courses = ev.groupBy("course_id").agg(total.alias("total_sessions")).withColumn("absence_fail_pct", F.when(F.col("course_id") % 8 == 0, F.lit(101.0)).when(F.col("course_id") % 2 == 0, F.lit(15.0)))
    return ledger.attendance_gate(marks, courses).select("course_id", "present", "absent", "excused", "allowed", "left", "gate")


def participation_standings(spark, folder):
    """Users as courses, their days as sessions (those of errors alone are absences), purchases as contributions; customers without
    events are courses without sessions."""
    ev = scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    days = ev.withColumn("occurrence_id", F.concat_ws("/", "user_id", F.to_date("ts").cast("string")))
    attended = days.groupBy(F.col("user_id").alias("course_id"), "occurrence_id").agg(F.min("ts").alias("starts_at"), F.when(F.bool_and(F.col("event_type") == "error"), "absent").otherwise("present").alias("status"))
    logs = days.where(F.col("event_type") == "purchase").select("occurrence_id")
    courses = scan(spark, folder, "customer", F.col("c_custkey").alias("course_id")).select("course_id", F.lit(20).alias("total_sessions"), F.lit(None).cast("double").alias("absence_fail_pct"), F.when(F.col("course_id") % 4 != 0, 1.5).otherwise(F.lit(0.0)).alias("target"))
    out = ledger.course_standings(courses, attended, logs)
    return out.select("course_id", "absent", "gate", "sessions", "contributions", F.round("mean", 9).alias("mean"), F.round("delta", 9).alias("delta"), "on_pace", "streak")


def asof_previous_event(spark, folder):
    """Each purchase with the last click of its user at or before it."""
    ev = scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    buy, click = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), ev.where("event_type = 'click'").select("user_id", "ts", F.col("ts").alias("click_ts"))
    return relational.as_of(buy, click, "user_id", "ts", "click_ts", "last_click").select("event_id", "last_click")


def nearest_position(spark, folder):
    """Each event with the nearest error of its user, by place in time."""
    ev = scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    from pyspark.sql.window import Window

    placed = ev.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return relational.nearest(placed, "user_id", "position", F.col("event_type") == "error", "near").select("event_id", F.col("near").cast("long").alias("near"))


def topk_per_segment(spark, folder):
    c = scan(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return relational.top_per(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_mktsegment", "c_custkey", F.col("rank").cast("long").alias("rank"))


def sync_counters(spark, folder):
    """Actions of the snapshot diff counted by kind."""
    return snapshot_diff(spark, folder).groupBy("action").agg(F.count("*").alias("n"))


def attendance_last_write(spark, folder):
    """The last event type of each user and day: last write wins."""
    ev = scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    return windows.newest(ev.select("user_id", F.to_date("ts").alias("day"), "event_type", "ts", "event_id"), ["user_id", "day"], F.col("ts"), F.col("event_id")).select("user_id", "day", "event_type")


def union_distinct_ledgers(spark, folder):
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("key"))
    c = scan(spark, folder, "customer", F.col("c_custkey").alias("key")).where("key % 3 = 0")
    return o.unionByName(c).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        nested_order_embed, semi_anti_customers, max_correlated_default, recency_rank, range_bounds, week_buckets, priority_rank,
        weight_verdict, page_diff, snapshot_diff, tombstones, exam_weight, upsert_orders, quality_constraints, attendance_gate,
        participation_standings, asof_previous_event, nearest_position, topk_per_segment, sync_counters, attendance_last_write, union_distinct_ledgers,
    )
}

DIFF = """WITH s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0),
 f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0)
 SELECT coalesce(s.o_orderkey, f.o_orderkey) AS o_orderkey,
 CASE WHEN s.o_orderkey IS NULL THEN 'added' WHEN f.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderstatus IS DISTINCT FROM f.o_orderstatus THEN 'changed' ELSE 'unchanged' END AS action,
 CASE WHEN s.o_orderkey IS NOT NULL AND f.o_orderkey IS NOT NULL AND s.o_orderstatus IS DISTINCT FROM f.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed
 FROM s FULL JOIN f USING (o_orderkey)"""

ORACLES = {
    "nested_order_embed": """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || CAST(trunc(l_quantity) AS BIGINT), ',' ORDER BY l_linenumber, l_quantity) AS lines FROM lineitem GROUP BY 1)
 SELECT o_orderkey, n_name, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(lines, '') AS lines FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l ON l_orderkey = o_orderkey""",
    "semi_anti_customers": """SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'with' ELSE 'without' END AS side, count(*) AS n FROM customer GROUP BY ALL""",
    "max_correlated_default": """SELECT c_custkey, CAST(coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1900-01-01') AS DATE) AS latest FROM customer""",
    "recency_rank": """SELECT o_orderkey, round(CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN 1.0::DOUBLE ELSE (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE / (count(*) OVER (PARTITION BY o_custkey) - 1)::DOUBLE END, 9) AS recency FROM orders""",
    "range_bounds": """WITH t(a, b) AS (VALUES (TIMESTAMP '1995-01-01', TIMESTAMP '1995-06-30'), (TIMESTAMP '1995-05-01', TIMESTAMP '1995-12-31'), (TIMESTAMP '1996-03-01', TIMESTAMP '1996-03-31'), (TIMESTAMP '1997-09-01', TIMESTAMP '1998-01-31'))
 SELECT EXISTS (SELECT 1 FROM t WHERE o_orderdate BETWEEN a AND b) AS inside, CASE WHEN day(o_orderdate) <= 10 THEN 'early' WHEN day(o_orderdate) <= 20 THEN 'middle' WHEN day(o_orderdate) >= 25 THEN 'late' END AS span, count(*) AS n FROM orders GROUP BY ALL""",
    "week_buckets": """SELECT CAST(date_trunc('week', x) AS DATE) AS week, strftime(x, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT timezone('Europe/Madrid', timezone('UTC', o_orderdate)) AS x FROM orders) GROUP BY ALL""",
    "priority_rank": """WITH k AS (SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-01-01'))::DOUBLE / 86400000000.0::DOUBLE AS days, CASE o_orderpriority WHEN '1-URGENT' THEN 'deadline' WHEN '5-LOW' THEN 'class' ELSE 'event' END AS kind,
 CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 10000)::DOUBLE END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 12.5::DOUBLE END AS a FROM orders WHERE o_orderstatus <> 'F'),
 s AS (SELECT *, days < 0 AS overdue, coalesce(w, a, CASE WHEN kind = 'deadline' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END) AS weight FROM k)
 SELECT o_orderkey, weight, CASE WHEN w IS NOT NULL THEN 'override' WHEN a IS NOT NULL THEN 'assessment' ELSE 'kind_default' END AS weight_source, overdue, round((weight + 1) / greatest(days, 0.5::DOUBLE), 9) AS score,
 CASE WHEN overdue THEN 'overdue' WHEN kind = 'class' THEN 'info' WHEN weight >= 15 THEN 'high' WHEN weight >= 5 THEN 'medium' ELSE 'low' END AS tier FROM s""",
    "weight_verdict": """WITH t AS (SELECT l_orderkey, sum(floor((l_discount * 1000) * 100 + 0.5)) AS h FROM lineitem GROUP BY 1)
 SELECT CASE WHEN abs(h - 10000) <= 1 THEN 'balanced' WHEN h < 10000 THEN 'under' ELSE 'over' END AS verdict, count(*) AS n, CAST(sum(h) AS BIGINT) AS hundredths FROM t GROUP BY 1""",
    "page_diff": """WITH b AS (SELECT o_orderkey AS k, o_orderpriority AS t FROM orders WHERE o_orderkey % 2 = 1), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderpriority END AS t FROM orders WHERE o_orderkey % 3 = 0),
 d AS (SELECT CASE WHEN a.k IS NULL THEN 'removed' WHEN b.k IS NULL THEN 'added' WHEN a.t <> b.t THEN 'changed' ELSE 'unchanged' END AS status FROM b FULL JOIN a USING (k))
 SELECT status, CAST(CASE status WHEN 'removed' THEN 1 WHEN 'changed' THEN 2 WHEN 'added' THEN 3 ELSE 4 END AS INTEGER) AS rank, count(*) AS n FROM d GROUP BY ALL""",
    "snapshot_diff": DIFF,
    "sync_counters": f"SELECT action, count(*) AS n FROM ({DIFF}) GROUP BY 1",
    "tombstones": """WITH i AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS present, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1997-06-01' - to_days(CAST(o_orderkey % 13 AS INTEGER)) END AS gone, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS last, o_orderstatus = 'F' AS graded FROM orders WHERE o_orderkey % 10 <> 0),
 a AS (SELECT *, CASE WHEN present THEN CASE WHEN gone IS NOT NULL THEN 'clear' END WHEN last IS NULL OR last < TIMESTAMP '1997-06-01' THEN 'retain_rolloff' WHEN graded THEN 'retain_graded' WHEN gone IS NULL THEN 'mark' WHEN gone <= TIMESTAMP '1997-05-25' THEN 'delete' ELSE 'keep' END AS action FROM i)
 SELECT id, action, CASE WHEN action = 'clear' OR (action = 'retain_rolloff' AND gone IS NOT NULL AND NOT coalesce(gone < last, false)) THEN 'clear' WHEN action IN ('mark', 'retain_graded') AND gone IS NULL THEN 'set' END AS write FROM a WHERE action IS NOT NULL""",
    "exam_weight": """WITH p AS (SELECT l_orderkey AS topic_id, count(*)::DOUBLE AS s, count(DISTINCT l_returnflag)::DOUBLE AS c, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE AS f FROM lineitem GROUP BY 1),
 t AS (SELECT o_orderkey AS topic_id, o_custkey, o_orderdate, s, c, f FROM orders JOIN p ON o_orderkey = topic_id),
 r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN 1.0::DOUBLE ELSE (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, topic_id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY o_custkey) - 1)::DOUBLE END AS a FROM t),
 w AS (SELECT topic_id, round(greatest(0, least(1, 0.05::DOUBLE + 0.475::DOUBLE * (s / (s + 1)) + 0.285::DOUBLE * (c / (c + 2)) * (0.5::DOUBLE + 0.5::DOUBLE * a) + 0.19::DOUBLE * (f / (f + 3)))), 9) AS weight FROM r)
 SELECT topic_id, weight, CASE WHEN weight >= 0.6 THEN 'HIGH' WHEN weight >= 0.35 THEN 'MID' ELSE 'LOW' END AS band FROM w""",
    "upsert_orders": "SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 OR o_orderkey % 6 = 0 GROUP BY 1",
    "quality_constraints": """SELECT 'lineitem key' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
 UNION ALL SELECT 'lineitem order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT 'order customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE l_discount > 0.08""",
    "attendance_gate": """WITH c AS (SELECT user_id AS course_id, count(*) FILTER (event_type = 'click') AS present, count(*) FILTER (event_type = 'error') AS absent, count(*) FILTER (event_type = 'view') AS excused,
 CASE WHEN user_id % 9 <> 0 AND user_id % 8 <> 0 THEN CAST(floor(count(*)::DOUBLE * CASE WHEN user_id % 2 = 0 THEN 15.0::DOUBLE ELSE 20.0::DOUBLE END / 100) AS BIGINT) END AS allowed FROM events GROUP BY user_id)
 SELECT *, allowed - absent AS "left", CASE WHEN allowed < absent THEN 'failed' WHEN allowed = absent THEN 'at_limit' WHEN allowed - absent = 1 THEN 'warning' WHEN allowed IS NOT NULL THEN 'ok' END AS gate FROM c""",
    "participation_standings": """WITH d AS (SELECT user_id AS course_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS n, bool_and(event_type = 'error') AS away FROM events GROUP BY ALL),
 a AS (SELECT course_id, count(*) FILTER (away) AS absent FROM d GROUP BY 1), s AS (SELECT *, sum(CASE WHEN n > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY course_id ORDER BY day DESC) AS bad FROM d WHERE NOT away),
 p AS (SELECT course_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS contributions, sum(n)::DOUBLE / count(*)::DOUBLE AS mean, count(*) FILTER (bad = 0) AS streak FROM s GROUP BY course_id),
 r AS (SELECT c_custkey AS course_id, coalesce(absent, 0) AS absent, coalesce(sessions, 0) AS sessions, coalesce(contributions, 0) AS contributions, coalesce(mean, 0) AS mean, coalesce(streak, 0) AS streak, CASE WHEN sessions > 0 AND c_custkey % 4 <> 0 THEN mean - 1.5::DOUBLE END AS delta
  FROM customer LEFT JOIN p ON p.course_id = c_custkey LEFT JOIN a ON a.course_id = c_custkey)
 SELECT course_id, absent, CASE WHEN absent > 4 THEN 'failed' WHEN absent = 4 THEN 'at_limit' WHEN absent = 3 THEN 'warning' ELSE 'ok' END AS gate, sessions, contributions, round(mean, 9) AS mean, round(delta, 9) AS delta, delta >= 0 AS on_pace, streak FROM r""",
    "asof_previous_event": """SELECT p.event_id, c.ts AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "nearest_position": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
 n AS (SELECT *, max(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM e)
 SELECT event_id, CASE WHEN q IS NULL OR pos - p <= q - pos THEN p ELSE q END AS near FROM n""",
    "topk_per_segment": """SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5""",
    "attendance_last_write": """SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL""",
    "union_distinct_ledgers": "SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0",
}

