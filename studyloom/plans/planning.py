"""Exam plans, grades and study events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grades, planner, retention
from ..sources.tables import scan, shared_folder
from ..streaming import rollups

TODAY = "1997-06-18"
DAYS = 38


def user_days(spark, folder):
    """A customer's next days, and what an order says of one of them: by its key an event, a blackout, an override, an exam or a debt."""
    c = scan(spark, folder, "customer", F.col("c_custkey").alias("user_id"))
    day = F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("i")
    days = c.select("user_id", day).select("user_id", F.date_add(F.lit(TODAY).cast("date"), F.col("i")).alias("day"))
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    at = o.select("user_id", "k", F.date_add(F.lit(TODAY).cast("date"), (F.col("k") % (DAYS - 3) + 2).cast("int")).alias("day"), F.floor(F.col("price") % 90).cast("int").alias("minutes"))
    return days, at


def resolved(spark, folder):
    days, at = user_days(spark, folder)
    settings = scan(spark, folder, "customer", F.col("c_custkey").alias("user_id")).where("user_id % 3 <> 0").select("user_id", F.array(*(F.lit(60 + 20 * i) + F.col("user_id").cast("int") % 50 for i in range(7))).alias("week"), F.when(F.col("user_id") % 2 == 0, 150).alias("most"))
    part = lambda r: at.where(F.col("k") % 5 == r)
    return planner.capacity(days, settings, part(0), part(1), part(2), part(3), part(4))


def study_capacity(spark, folder):
    return resolved(spark, folder)


def exam_plan(spark, folder):
    """Every order as an exam of its customer, its lines as the topics."""
    days, at = user_days(spark, folder)
    lines = scan(spark, folder, "lineitem", F.col("l_orderkey").alias("exam_id"), "l_linenumber", "l_quantity", "l_discount", "l_tax")
    exams = at.select("user_id", F.col("k").alias("exam_id"), F.col("day").alias("exam_date"), (F.col("k") % 5).alias("course_id"), (F.col("minutes") + 1).cast("double").alias("weight"))
    topics = lines.join(exams, "exam_id").select(
        "user_id", "exam_id", "course_id", "exam_date", "weight", (F.col("exam_id") * 10 + F.col("l_linenumber")).alias("topic_id"), F.col("l_linenumber").cast("int").alias("sequence"),
        F.col("l_quantity").cast("double").alias("est_minutes"), (F.col("l_discount") * 10).alias("difficulty"), (F.col("l_tax") * 10).alias("confidence"),
        F.when((F.col("l_linenumber") == 1) & (F.col("exam_id") % 9 == 0), F.date_sub("exam_date", 2)).alias("pinned_on"), F.lit(25).alias("pinned_minutes"), F.array().cast("array<date>").alias("planned_before"),
    )
    return planner.plan(topics, resolved(spark, folder))


def components(spark, folder):
    """Lines as assessments of their order's course: those not returned and not shipped yet are open."""
    return scan(spark, folder, "lineitem", F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("component"), F.col("l_quantity").alias("weight"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey") % 101).alias("score"), F.lit(100).alias("max_score"))


def course_standing(spark, folder):
    """What each course stands at, and what the open part needs for a mark that goes by its key."""
    s = grades.standing(components(spark, folder), ["course_id"])
    target = (F.col("course_id") % 10 + 1).cast("double")
    case, mark = grades.required_score(F.col("graded_weight"), F.col("open_weight"), F.col("banked"), target)
    r = lambda c: F.round(c, 9)
    return s.select("course_id", "graded_weight", "open_weight", r("banked").alias("banked"), r("standing").alias("standing"), case.alias("case"), r(mark).alias("required"), r(grades.german_grade(F.col("standing"))).alias("german"))


def semester_average(spark, folder):
    """Orders as courses of their customer: the price's last digits are the grade in tenths, open ones have none."""
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("user_id"), "o_orderstatus", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    courses = o.select("user_id", F.when(F.col("o_orderstatus") != "O", F.floor(F.col("p")) % 101 / 10).alias("grade"), (F.col("k") % 6).cast("double").alias("credits"))
    return grades.semester_average(courses, ["user_id"]).select("user_id", F.round("average", 6).alias("average"), "earned", "open")


def biggest_lever(spark, folder):
    """Each customer's largest open assessment, by its weight times the order's credits."""
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("course_id"), F.col("o_custkey").alias("user_id")).withColumn("credits", (F.col("course_id") % 6).cast("double"))
    return grades.biggest_lever(components(spark, folder).join(o, "course_id"), ["user_id"], "course_id")


def event_rollup(spark, folder):
    """Events by hour and type, kept by a stream that gets them in three files, each with events of all hours."""
    source, out = shared_folder(spark, "events"), shared_folder(spark, "rollup")
    ev = scan(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    for k in range(3):
        ev.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rollups.keep_rollup(stream, out, shared_folder(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = rollups.read_rollup(spark, out)
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "cents", "low", "high", rollups.quantile(F.col("hist"), 0.9).alias("p90"))


def retention_fit(spark, folder):
    """A user's events as reviews, an error as a lapse; groups are of users, bins of six hours."""
    ev = scan(spark, folder, "events", "user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    points = retention.curve(retention.recalls(ev, ["user_id"]), F.col("user_id") % 7, 6)
    return retention.stability(points, 6).select("group", "n", F.round("stability", 6).alias("stability"), F.round("error", 9).alias("error"))


QUERIES = {f.__name__: f for f in (study_capacity, exam_plan, course_standing, semester_average, biggest_lever, event_rollup, retention_fit)}

#: Marks of components, and what course_standing sums of them.
MARKS = "SELECT l_orderkey AS course_id, l_linenumber AS component, l_quantity AS w, CASE WHEN l_returnflag <> 'N' THEN (l_partkey % 101)::DOUBLE / 100 * 10 END AS m FROM lineitem"
BINS = " + ".join(f"CAST(value >= {e!r} AS INTEGER)" for e in rollups.EDGES)

ORACLES = {
    "course_standing": f"""WITH s AS (SELECT course_id, coalesce(sum(w) FILTER (m IS NOT NULL), 0) AS g, coalesce(sum(w) FILTER (m IS NULL), 0) AS o, coalesce(sum(w * m), 0) AS b FROM ({MARKS}) GROUP BY 1), t AS (SELECT *, (course_id % 10 + 1) * (g + o) AS want FROM s)
 SELECT course_id, g AS graded_weight, o AS open_weight, round(b, 9) AS banked, round(b / nullif(g, 0), 9) AS standing, CASE WHEN o <= 0 AND want - b <= {grades.NOISE} THEN 'locked_met' WHEN o <= 0 THEN 'locked_missed' WHEN (want - b) / o <= {grades.NOISE} THEN 'secured' WHEN (want - b) / o > 10 + {grades.NOISE} THEN 'unreachable' ELSE 'needed' END AS "case",
  CASE WHEN o <= 0 OR (want - b) / o > 10 + {grades.NOISE} THEN NULL ELSE round(greatest((want - b) / o, 0), 9) END AS required, CASE WHEN g > 0 THEN round(greatest(1, least(4, 1 + 3 * (10 - b / g) / 5)), 9) END AS german FROM t""",
    "semester_average": """WITH c AS (SELECT o_custkey AS user_id, CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice) % 101 / 10 END AS grade, (o_orderkey % 6)::DOUBLE AS credits FROM orders)
 SELECT user_id, round(sum(grade * credits) / nullif(sum(credits) FILTER (grade IS NOT NULL), 0), 6) AS average, coalesce(sum(credits) FILTER (grade >= 5), 0) AS earned, coalesce(sum(credits) FILTER (grade IS NULL), 0) AS open FROM c GROUP BY 1""",
    "biggest_lever": """SELECT user_id, course_id, component, lever FROM (SELECT o_custkey AS user_id, l_orderkey AS course_id, l_linenumber AS component, l_quantity * (l_orderkey % 6) AS lever, row_number() OVER (PARTITION BY o_custkey ORDER BY l_quantity * (l_orderkey % 6) DESC, l_orderkey, l_linenumber) AS k
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' AND l_quantity * (l_orderkey % 6) > 0) WHERE k = 1""",
    "event_rollup": f"""WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_type, value, {BINS} AS b FROM events), c AS (SELECT hour, event_type, b, count(*) AS k FROM e WHERE value IS NOT NULL GROUP BY ALL),
 h AS (SELECT hour, event_type, b, sum(k) OVER (PARTITION BY hour, event_type ORDER BY b) AS upto, sum(k) OVER (PARTITION BY hour, event_type) AS n FROM c),
 p AS (SELECT hour, event_type, min(b) AS b FROM h WHERE upto >= n * 0.9::DOUBLE GROUP BY ALL), s AS (SELECT hour, event_type, count(*) AS n, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS cents, min(value) AS low, max(value) AS high FROM e GROUP BY ALL)
 SELECT strftime(hour, '%Y-%m-%d %H:%M') AS hour, event_type, n, cents, low, high, CASE WHEN b = {len(rollups.EDGES)} THEN 'inf'::DOUBLE ELSE (1 << b)::DOUBLE END AS p90 FROM s LEFT JOIN p USING (hour, event_type)""",
    "retention_fit": """WITH r AS (SELECT user_id % 7 AS "group", event_type <> 'error' AS ok, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000) AS gap FROM events),
 c AS (SELECT "group", floor(gap / 6) AS bin, count(*) AS n, (count(*) FILTER (ok) + 0.5::DOUBLE) / (count(*) + 1) AS share FROM r WHERE gap IS NOT NULL GROUP BY ALL), p AS (SELECT *, (bin + 0.5::DOUBLE) * 6 AS x, -ln(share) AS y FROM c),
 f AS (SELECT "group", CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n * x * y) > 0 THEN sum(n * x * x) / sum(n * x * y) END AS s FROM p GROUP BY 1)
 SELECT f."group", f.n, round(s, 6) AS stability, round(sum(p.n * (share - exp(-x / s)) * (share - exp(-x / s))) / sum(p.n), 9) AS error FROM f JOIN p ON p."group" = f."group" GROUP BY f."group", f.n, s""",
    "study_capacity": f"""WITH d AS (SELECT c_custkey AS user_id, DATE '{TODAY}' + CAST(i AS INTEGER) AS day FROM customer, range({DAYS}) t(i)),
 o AS (SELECT o_custkey AS user_id, o_orderkey % 5 AS r, DATE '{TODAY}' + CAST(o_orderkey % {DAYS - 3} + 2 AS INTEGER) AS day, CAST(floor(o_totalprice % 90) AS INTEGER) AS minutes FROM orders),
 g AS (SELECT user_id, day, sum(CASE WHEN r = 0 THEN minutes + {planner.PADDING} END) AS busy, bool_or(r = 1) AS blackout, max(CASE WHEN r = 2 THEN minutes END) AS hand, bool_or(r = 3) AS exam_day, max(CASE WHEN r = 4 THEN minutes END) AS debt FROM o GROUP BY ALL),
 b AS (SELECT d.*, busy, hand, debt, coalesce(blackout, false) AS blackout, coalesce(exam_day, false) AS exam_day, CASE WHEN user_id % 3 = 0 THEN list_extract([{", ".join(map(str, planner.WEEK))}], isodow(day)) ELSE 40 + 20 * isodow(day) + user_id % 50 END AS base,
  CASE WHEN user_id % 3 <> 0 AND user_id % 2 = 0 THEN 150 END AS most FROM d LEFT JOIN g USING (user_id, day))
 SELECT user_id, day, CAST(CASE WHEN blackout THEN 0 ELSE greatest(floor(coalesce(hand, greatest(least(base, coalesce(most, base)) - coalesce(busy, 0), 0)) * CASE WHEN exam_day THEN {planner.EXAM_DAY} ELSE 1 END) - coalesce(debt, 0), 0) END AS INTEGER) AS minutes, blackout, exam_day FROM b""",
}
