"""The read side on the driver's tables: lists, details, dashboards and reports, each with the SQL that checks it.

customer plays the brand, its orders the editions, the order date the edition's year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairloom.functions import text as X
from fairloom.operators import relational as R
from fairloom.operators.storage import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def checked(sql: str):
    """Register a query under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def newest_first() -> list:
    return [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]


_LATEST = """latest AS (
  SELECT c.*, o.* FROM customer c LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn
    FROM orders) o ON o.o_custkey = c.c_custkey AND o.rn = 1)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its latest order."""
    return R.with_latest(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", newest_first())


@checked(f"WITH {_LATEST} SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM latest")
def latest_per_key(spark, sf_dir):
    return brands(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment", "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


@checked("""SELECT c.c_custkey, o.o_orderkey, o.y FROM customer c LEFT JOIN (
  SELECT o_custkey, o_orderkey, year(o_orderdate)::INT AS y, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS top FROM orders) o
  ON o.o_custkey = c.c_custkey AND o.y = o.top""")
def latest_by_max_fanout(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    return R.latest_fanout(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", F.col("y")).select("c_custkey", "o_orderkey", "y")


@checked(f"""WITH {_LATEST} SELECT c_custkey, c_name, o_totalprice FROM latest WHERE c_mktsegment = 'BUILDING'
  ORDER BY o_totalprice DESC NULLS LAST, c_custkey LIMIT 50""")
def list_page(spark, sf_dir):
    rows = R.equal_filters(brands(spark, sf_dir), {"segment": "c_mktsegment", "nation": "c_nationkey"}, {"segment": "BUILDING", "nation": ""})
    page = R.list_page(rows, {"price": "o_totalprice", "name": "c_name"}, "price", "desc", "c_custkey", "c_custkey")
    return page.select("c_custkey", "c_name", "o_totalprice")


@checked("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%'
  ORDER BY p_name ASC, p_partkey LIMIT 20 OFFSET 20""")
def list_page_search(spark, sf_dir):
    rows = R.search(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "RING")
    return R.list_page(rows, {"name": "p_name"}, "name", "asc", "p_partkey", "p_partkey", page=2, size="20").select("p_partkey", "p_name", "p_brand")


@checked("SELECT count(*) AS total FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%'")
def list_total(spark, sf_dir):
    return R.search(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "ring").agg(F.count("*").alias("total"))


@checked("SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND c_acctbal < 5000")
def multi_value_and_bucket_filter(spark, sf_dir):
    rows = R.in_list(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING, MACHINERY", ""])
    return rows.where((F.col("c_acctbal") >= 1000) & (F.col("c_acctbal") < 5000))


@checked("""SELECT count(*) AS total, coalesce(sum((o_orderstatus = 'O')::INT), 0)::BIGINT AS n_open,
  coalesce(sum((o_orderstatus = 'F')::INT), 0)::BIGINT AS n_done, coalesce(sum((o_orderstatus = 'X')::INT), 0)::BIGINT AS n_none FROM orders""")
def kpi_conditional(spark, sf_dir):
    n = lambda s, name: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), n("O", "n_open"), n("F", "n_done"), n("X", "n_none"))


_STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"]


@checked("""SELECT pos::INT AS pos, stage, (SELECT count(*) FROM orders WHERE o_orderpriority = stage) AS n
  FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '9-NONE')) d(pos, stage)""")
def funnel_zero_fill(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"))
    return R.zero_fill(_STAGES, counts, "stage", ["n"])


@checked(f"WITH {_LATEST} SELECT count(*) AS n_brands, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(o_totalprice) AS n_known FROM latest")
def stats_totals(spark, sf_dir):
    return brands(spark, sf_dir).agg(F.count("*").alias("n_brands"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), F.count("o_totalprice").alias("n_known"))


@checked(f"""WITH {_LATEST}, b AS (SELECT CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < 10000 THEN 'lt1w' WHEN o_totalprice < 50000 THEN '1w-5w'
  WHEN o_totalprice < 100000 THEN '5w-10w' ELSE 'gte10w' END AS bucket FROM latest)
SELECT pos::INT AS pos, d.bucket, (SELECT count(*) FROM b WHERE b.bucket = d.bucket) AS n FROM (VALUES (0, 'lt1w'), (1, '1w-5w'), (2, '5w-10w'), (3, 'gte10w')) d(pos, bucket)""")
def stats_scale(spark, sf_dir):
    counts = brands(spark, sf_dir).groupBy(X.scale_bucket(F.col("o_totalprice")).alias("bucket")).agg(F.count("*").alias("n"))
    return R.zero_fill([k for k, _, _ in X.SCALE_BUCKETS], counts, "bucket", ["n"])


@checked(f"WITH {_LATEST} SELECT c_mktsegment AS grp, count(*) AS n FROM latest WHERE c_mktsegment <> '' GROUP BY 1")
def stats_group(spark, sf_dir):
    return brands(spark, sf_dir).where("c_mktsegment <> ''").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("n"))


_POINTS = [("AFRICA", 20.0, 5.0), ("ASIA", 100.0, 35.0), ("EUROPE", 10.0, 50.0)]


@checked("""WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
p(place, lon, lat) AS (VALUES ('AFRICA', 20.0, 5.0), ('ASIA', 100.0, 35.0), ('EUROPE', 10.0, 50.0))
SELECT lon::DOUBLE AS lon, lat::DOUBLE AS lat, sum(n)::BIGINT AS n FROM g JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN p ON place = r_name GROUP BY 1, 2""")
def stats_points(spark, sf_dir):
    """Counts by place, then by coordinate; the row without a coordinate counts what could not be located."""
    known = spark.createDataFrame(_POINTS, "place string, lon double, lat double")
    by_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    placed = by_nation.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return placed.join(F.broadcast(known), F.col("place") == F.col("r_name"), "left").groupBy("lon", "lat").agg(F.sum("n").alias("n"))


@checked("""WITH c AS (SELECT month(o_orderdate)::INT AS m, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <> 3 GROUP BY 1),
f AS (SELECT d.m::INT AS m, coalesce(n, 0) AS n FROM range(1, 13) d(m) LEFT JOIN c ON c.m = d.m)
SELECT m, n, n > 0 AND n = max(n) OVER () AS is_peak FROM f""")
def month_histogram_zero_fill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where((F.year("o_orderdate") == 1996) & (F.month("o_orderdate") != 3))
    counts = orders.groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    filled = R.zero_fill(list(range(1, 13)), counts, "m", ["n"])
    top = filled.agg(F.max("n").alias("top"))
    return filled.crossJoin(F.broadcast(top)).select("m", "n", ((F.col("n") > 0) & (F.col("n") == F.col("top"))).alias("is_peak"))


@checked("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, contains(s_name, '7') AS marked
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY l_suppkey, s_name ORDER BY n_orders DESC, l_suppkey LIMIT 6""")
def top_distinct(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n_orders"))
    named = items.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return named.select("l_suppkey", "n_orders", F.col("s_name").contains("7").alias("marked")).orderBy(F.desc("n_orders"), "l_suppkey").limit(6)


@checked(f"""WITH {_LATEST} SELECT n_name, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS area FROM latest JOIN nation ON n_nationkey = c_nationkey
  GROUP BY n_name ORDER BY n DESC, n_name LIMIT 6""")
def top_city_area(spark, sf_dir):
    by_nation = brands(spark, sf_dir).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("area"))
    return by_nation.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n", "area").orderBy(F.desc("n"), "n_name").limit(6)


@checked("""SELECT count(*) FILTER (has) AS n_with, count(*) FILTER (NOT has) AS n_without FROM (
  SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-06-01') AS has FROM customer)""")
def exists_split(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    late = table(spark, sf_dir, "orders").where("o_orderdate >= date '2001-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(late, "c_custkey", "left_semi").agg(F.count("*").alias("n_with")).crossJoin(customers.join(late, "c_custkey", "left_anti").agg(F.count("*").alias("n_without")))


@checked("""SELECT strftime(ts, '%Y-%m-%d') AS day, 'meeting' AS kind, event_id, strftime(ts, '%H:%M') AS clock, false AS overdue FROM events WHERE event_type = 'signup' AND strftime(ts, '%Y-%m') = '2024-01'
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'next_action', event_id, NULL, strftime(ts, '%Y-%m-%d') < '2024-01-15' FROM events WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m') = '2024-01'""")
def calendar_union(spark, sf_dir):
    """Two kinds of entries by day of a month; today is given."""
    rows = table(spark, sf_dir, "events").withColumn("moment", F.date_format("ts", "yyyy-MM-dd HH:mm")).where(F.substring("moment", 1, 7) == "2024-01")
    day = F.substring("moment", 1, 10)
    meetings = rows.where("event_type = 'signup'").select(day.alias("day"), F.lit("meeting").alias("kind"), "event_id", X.calendar_time(F.col("moment")).alias("clock"), F.lit(False).alias("overdue"))
    actions = rows.where("event_type = 'purchase'").select(day.alias("day"), F.lit("next_action").alias("kind"), "event_id", F.lit(None).cast("string").alias("clock"), (day < "2024-01-15").alias("overdue"))
    return meetings.unionByName(actions)


@checked("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END, ''), '1999-01-01') DESC,
  strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC)::INT AS place FROM orders""")
def timeline_sort_key(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    happened = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(day)
    order = [F.coalesce(X.blank_to_null(happened), F.lit("1999-01-01")).desc(), day.desc(), F.col("o_orderkey").desc()]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("place"))


@checked("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7 OR (l_suppkey IS NOT NULL AND l_suppkey = 3)")
def or_parent_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where((F.col("l_orderkey") == 7) | (F.col("l_suppkey").isNotNull() & (F.col("l_suppkey") == 3))).select("l_orderkey", "l_linenumber")


@checked("SELECT p_brand, count(*) AS n, sum((p_size > 25)::INT)::BIGINT AS n_large, sum((p_type = 'ECONOMY')::INT)::BIGINT AS n_economy FROM part GROUP BY 1")
def group_two_conditional(spark, sf_dir):
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), n(F.col("p_size") > 25, "n_large"), n(F.col("p_type") == "ECONOMY", "n_economy"))


@checked(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NOT NULL AND {c}::VARCHAR <> '') AS filled, round(count(*) FILTER ({c} IS NOT NULL AND {c}::VARCHAR <> '') * 100.0 / count(*), 1)::DOUBLE AS share FROM documents" for c in ("text", "lang", "source", "n_chars")))
def coverage_report(spark, sf_dir):
    return R.coverage(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@checked("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 3")
def having_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers")).where("n_suppliers > 3")


@checked("""SELECT l_suppkey, string_agg(y::VARCHAR, ' > ' ORDER BY y) AS history, count(*) AS n_years FROM (
  SELECT DISTINCT l_suppkey, year(l_shipdate) AS y FROM lineitem) GROUP BY 1""")
def group_concat_history(spark, sf_dir):
    years = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list("y")), lambda y: y.cast("string"))
    return years.groupBy("l_suppkey").agg(F.array_join(ordered, " > ").alias("history"), F.count("*").alias("n_years"))


@checked("""WITH t AS (SELECT l_partkey, l_suppkey, year(l_shipdate)::INT AS y FROM lineitem)
SELECT t.*, p.n AS suppliers_of_part, s.n AS years_of_supplier FROM t JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM t GROUP BY 1) p USING (l_partkey)
JOIN (SELECT l_suppkey, count(DISTINCT y) AS n FROM t GROUP BY 1) s USING (l_suppkey)""")
def window_distinct_rotation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    return R.distinct_over(R.distinct_over(rows, ["l_partkey"], "l_suppkey", "suppliers_of_part"), ["l_suppkey"], "y", "years_of_supplier")


@checked("""SELECT o_custkey, y, string_agg(y::VARCHAR, ',') OVER (PARTITION BY o_custkey ORDER BY y) AS so_far FROM (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS y FROM orders)""")
def window_running_concat(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    so_far = Window.partitionBy("o_custkey").orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return years.withColumn("so_far", F.array_join(F.transform(F.array_sort(F.collect_list("y").over(so_far)), lambda y: y.cast("string")), ","))


@checked("""SELECT p_brand, coalesce(p_type, '') AS p_type, n, round(n * 1.0 / greatest(1, sum(n) OVER ()), 6)::DOUBLE AS share, round(sqrt(n), 6) AS radius FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)""")
def share_and_radius(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", F.coalesce("p_type", F.lit("")).alias("p_type")).agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.lit(1), F.sum("n")).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("p_brand", "p_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.sqrt("n"), 6).alias("radius"))


@checked("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 11) AND p_type = (SELECT p_type FROM part WHERE p_partkey = 11) AND p_partkey <> 11 ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def peer_fallback(spark, sf_dir):
    """Peers of the same type; of the same brand only where there is none of the type."""
    part = table(spark, sf_dir, "part")
    me = F.broadcast(part.where("p_partkey = 11").select(F.col("p_brand").alias("b"), F.col("p_type").alias("t")))
    near = part.where("p_partkey <> 11").join(me, F.col("p_brand") == F.col("b")).withColumn("tier", F.when(F.col("p_type") == F.col("t"), 0).otherwise(1))
    best = F.broadcast(near.agg(F.min("tier").alias("best")))
    return near.join(best, F.col("tier") == F.col("best")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).select("p_partkey", "p_name")


@checked("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' ORDER BY CASE WHEN p_name = 'small ring' THEN 0 ELSE 1 END, p_size DESC, p_partkey LIMIT 20""")
def exact_hit_first(spark, sf_dir):
    rows = R.search(table(spark, sf_dir, "part"), ["p_name"], "ring")
    return rows.orderBy(F.when(F.col("p_name") == "small ring", 0).otherwise(1), F.desc("p_size"), "p_partkey").limit(20).select("p_partkey", "p_name")


@checked("""SELECT event_id, props::JSON->>'$.k' AS k, CASE WHEN event_id % 5 = 0 THEN '{}' ELSE props END AS kept FROM events""")
def json_prefs(spark, sf_dir):
    dirty = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{bad"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), X.tolerant_json(dirty).alias("kept"))


@checked("""SELECT min(o_orderdate)::DATE::VARCHAR AS first_day, max(o_orderdate)::DATE::VARCHAR AS last_day, (SELECT count(*) FROM customer) AS n_brands, count(*) AS n_editions,
  (SELECT count(*) FROM supplier) AS n_organizers, (SELECT count(*) FROM part) AS n_resources FROM orders""")
def system_status(spark, sf_dir):
    """Independent counts as one row."""
    orders = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("first_day"), F.max("o_orderdate").cast("date").cast("string").alias("last_day"), F.count("*").alias("n_editions"))
    for name, alias in (("customer", "n_brands"), ("supplier", "n_organizers"), ("part", "n_resources")):
        orders = orders.crossJoin(F.broadcast(table(spark, sf_dir, name).agg(F.count("*").alias(alias))))
    return orders


@checked("""SELECT d.day::VARCHAR AS day, coalesce(n, 0) AS n, top FROM (SELECT (DATE '2024-01-01' + i::INT)::DATE AS day FROM range(0, 31) r(i)) d LEFT JOIN (
  SELECT ts::DATE AS day, count(*) AS n, array_to_string(list(event_id ORDER BY event_id)[1:3], ',') AS top FROM events WHERE event_type = 'signup' GROUP BY 1) e ON e.day = d.day""")
def calendar_grid(spark, sf_dir):
    """Every day of a month with its number of entries and the first three."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2024-01-01")), F.last_day(F.to_date(F.lit("2024-01-01"))))).alias("day"))
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("day", F.to_date("ts"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy("event_id"))
    first = rows.withColumn("r", rank).where("r <= 3").groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("top"))
    counts = rows.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").join(first, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), "top")
