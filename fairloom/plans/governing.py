"""The batch side on the driver's tables: normalising, merging, classifying, deduplicating, each with its check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.functions import text as X
from fairloom.operators import relational as R
from fairloom.operators.graph import connected_components
from fairloom.operators.storage import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def checked(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@checked("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice / 10000, 1) * 10000 WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN floor(o_totalprice) END::BIGINT AS n FROM orders""")
def parse_numeric(spark, sf_dir):
    price = F.col("o_totalprice")
    whole = F.floor(price).cast("long")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("面积:"), F.round(price / 10000, 1).cast("string"), F.lit("万平方米"))).when(
        F.col("o_orderkey") % 4 == 1, F.concat(F.format_number(whole, 0), F.lit("家"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("展商："), whole.cast("string"))).otherwise("暂无数据")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_numeric(raw).alias("n"))


@checked("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + 20) AS b FROM orders)
SELECT o_orderkey, strftime(a, '%Y-%m-%d') AS first, CASE WHEN o_orderkey % 3 < 2 THEN strftime(b, '%Y-%m-%d') END AS last FROM d""")
def parse_date_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 20).alias("b"))
    dotted = F.concat(F.date_format("a", "yyyy.M.d"), F.lit(" - "), F.date_format("b", "MM.dd"))
    han = F.concat(F.date_format("a", "yyyy年MM月dd日"), F.lit("~"), F.date_format("b", "M月d日"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, dotted).when(F.col("o_orderkey") % 3 == 1, han).otherwise(F.date_format("a", "yyyy-M-d"))
    return rows.withColumn("p", X.parse_date_pair(raw)).select("o_orderkey", F.col("p.start").alias("first"), F.col("p.end").alias("last"))


@checked("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '上海' WHEN 1 THEN '武汉' WHEN 2 THEN '呼和浩特' ELSE c_name END AS city FROM customer""")
def normalize_city(spark, sf_dir):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "上海上海").when(k == 1, "湖北武汉").when(k == 2, "呼和浩特").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_city(raw).alias("city"))


@checked(r"""SELECT page_id, regexp_replace(split_part(url, '?', 1), '(?i)(\.html?)?/*$', '') || CASE WHEN contains(url, '?') THEN substr(url, strpos(url, '?')) ELSE '' END AS url FROM pages""")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


_WORDS = {"metal": ["steel", "copper", "iron"], "shape": ["ring", "bolt", "gear"], "size": ["small", "large"]}


@checked("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{w}') THEN '{k}'" for k, ws in _WORDS.items() for w in ws) + " ELSE '' END AS class FROM part")
def keyword_first_hit(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.keyword_class(F.col("p_name"), _WORDS).alias("class"))


@checked("""SELECT p_type, coalesce(l1, '') AS l1, count(*) AS n FROM part LEFT JOIN (VALUES ('ECONOMY', 'cheap'), ('STANDARD', 'usual')) m(t, l1) ON t = p_type GROUP BY 1, 2""")
def category_map(spark, sf_dir):
    """Dictionary lookup; what the dictionary lacks keeps ''."""
    known = spark.createDataFrame([("ECONOMY", "cheap"), ("STANDARD", "usual")], "t string, l1 string")
    return table(spark, sf_dir, "part").join(F.broadcast(known), F.col("t") == F.col("p_type"), "left").groupBy("p_type", F.coalesce("l1", F.lit("")).alias("l1")).agg(F.count("*").alias("n"))


@checked("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '组委会' WHEN 1 THEN '政府' WHEN 2 THEN '协会' WHEN 3 THEN '企业' ELSE '其他' END AS type FROM supplier""")
def type_classify_regex(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "展览组委会").when(k == 1, "某市人民政府").when(k == 2, "中国机械工业协会").when(k == 3, F.concat(F.col("s_name"), F.lit(" Co., Ltd"))).otherwise("X")
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.classify_organisation(name).alias("type"))


def _old_and_new(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    old = rows.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.floor("c_acctbal").cast("long")).alias("area"))
    new = rows.where("c_custkey % 2 = 0").select("c_custkey", F.lower("c_name").alias("c_name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 7 != 0, F.lit(100).cast("long")).alias("area"))
    return old, new


_OLD_NEW = """old AS (SELECT c_custkey, c_name, c_mktsegment AS segment, CASE WHEN c_custkey % 5 <> 0 THEN floor(c_acctbal)::BIGINT END AS area FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey, lower(c_name) AS c_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN 100 END AS area FROM customer WHERE c_custkey % 2 = 0)"""


@checked(f"""WITH {_OLD_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(nullif(n.segment, ''), o.segment) AS segment,
  CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN o.area ELSE coalesce(o.area, n.area) END AS area FROM old o FULL JOIN new n USING (c_custkey)""")
def upsert_nonblank(spark, sf_dir):
    return R.upsert(*_old_and_new(spark, sf_dir), "c_custkey", overwrite=["segment"])


@checked(f"""WITH {_OLD_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(n.c_name, ''), o.c_name) AS c_name, coalesce(nullif(n.segment, ''), o.segment) AS segment,
  CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN greatest(coalesce(o.area, 0), coalesce(n.area, 0)) ELSE coalesce(o.area, n.area) END AS area FROM old o FULL JOIN new n USING (c_custkey)""")
def upsert_max(spark, sf_dir):
    return R.upsert(*_old_and_new(spark, sf_dir), "c_custkey", overwrite=["c_name", "segment"], greatest=["area"])


@checked("""WITH p AS (SELECT o_orderkey, ['site_a', 'site_b', 'site_a+site_b', '手工', ''][1 + o_orderkey % 5] AS x, ['site_a', 'site_b', ''][1 + o_orderkey % 3] AS y FROM orders)
SELECT o_orderkey, CASE WHEN x = '手工' THEN x WHEN x = '' THEN y WHEN y = '' THEN x WHEN x = y THEN x WHEN x = 'site_a+site_b' OR x <> y THEN 'site_a+site_b' END AS source FROM p""")
def source_lattice(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.col("o_orderkey") % n)
    old, new = pick(["site_a", "site_b", "site_a+site_b", "手工", ""], 5), pick(["site_a", "site_b", ""], 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.source_lattice(old, new, "site_a", "site_b", ("官网", "手工")).alias("source"))


@checked("""WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS status, max(o_totalprice) AS area, max(o_orderpriority) AS org FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1),
b AS (SELECT o_custkey AS k, min(o_orderstatus) AS status, max(o_totalprice) AS area, min(o_orderpriority) AS org FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1)
SELECT k, coalesce(nullif(a.status, ''), nullif(b.status, ''), '') AS status, greatest(a.area, b.area) AS area, CASE WHEN a.org = b.org THEN a.org ELSE concat_ws('；', a.org, b.org) END AS org FROM a FULL JOIN b USING (k)""")
def full_outer_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.where(F.year("o_orderdate") < 1998).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderstatus").alias("status"), F.max("o_totalprice").alias("area"), F.max("o_orderpriority").alias("org"))
    b = orders.where(F.year("o_orderdate") >= 1998).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("status"), F.max("o_totalprice").alias("area"), F.min("o_orderpriority").alias("org"))
    return R.full_outer_merge(a, b, "k", ["status"], ["area"], ["org"])


@checked(f"""WITH {_OLD_NEW} SELECT c_custkey, field, old_value, new_value FROM (
  SELECT c_custkey, unnest(['c_name', 'segment', 'area']) AS field, unnest([coalesce(o.c_name, ''), coalesce(o.segment, ''), coalesce(o.area::VARCHAR, '')]) AS old_value,
    unnest([coalesce(n.c_name, ''), coalesce(n.segment, ''), coalesce(n.area::VARCHAR, '')]) AS new_value FROM old o JOIN new n USING (c_custkey)) WHERE old_value <> new_value""")
def change_report(spark, sf_dir):
    return R.changes(*_old_and_new(spark, sf_dir), "c_custkey", ["c_name", "segment", "area"])


@checked("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (1 - quality)::VARCHAR WHEN doc_id % 3 = 1 THEN '' ELSE '7' END AS q, quality FROM labels)
SELECT doc_id, 'quality' AS field_name, quality::VARCHAR AS old_value, q AS new_value FROM t WHERE q IN ('0', '1') AND q <> quality::VARCHAR""")
def tag_diff_history(spark, sf_dir):
    """Imported tags: blanks change nothing, a value outside 0..1 rejects its row, changes make history rows."""
    rows = table(spark, sf_dir, "labels")
    given = F.when(F.col("doc_id") % 3 == 0, (1 - F.col("quality")).cast("string")).when(F.col("doc_id") % 3 == 1, "").otherwise("7")
    valid = rows.withColumn("given", given).where((F.col("given") != "") & F.col("given").try_cast("int").between(0, 1))
    return R.changes(valid.select("doc_id", "quality"), valid.select("doc_id", F.col("given").alias("quality")), "doc_id", ["quality"]).withColumnRenamed("field", "field_name")


@checked("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'P' WHEN o_orderdate < DATE '1998-06-01' THEN '已举办' ELSE '即将举办' END AS status FROM orders""")
def status_by_date(spark, sf_dir):
    """Manual states stay; others follow from the end date and a given day."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "P").when(F.col("o_orderdate") < F.lit("1998-06-01").cast("date"), "已举办").otherwise("即将举办").alias("status"))


@checked("""SELECT c_custkey, (c_name <> '' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000))::INT AS ready FROM customer""")
def ready_flag(spark, sf_dir):
    has = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_custkey").distinct()
    rows = table(spark, sf_dir, "customer").join(has, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", ((F.col("c_name") != "") & F.col("o_custkey").isNotNull()).cast("int").alias("ready"))


@checked("""WITH t AS (SELECT p_retailprice, p_type, unnest(string_split(p_name, ' ')) AS token FROM part)
SELECT token, round(sum(p_retailprice), 2) AS area, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ' | ') AS spellings,
  CASE WHEN count(DISTINCT p_type) > 1 THEN 'mixed' ELSE min(p_type) END AS confidence FROM t GROUP BY token""")
def rank_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select("p_retailprice", "p_type", F.explode(F.split("p_name", " ")).alias("token"))
    return tokens.groupBy("token").agg(
        F.round(F.sum("p_retailprice"), 2).alias("area"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_type")), " | ").alias("spellings"),
        F.when(F.count_distinct("p_type") > 1, "mixed").otherwise(F.min("p_type")).alias("confidence"),
    )


@checked("""WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part)
SELECT token, round(sum(l_extendedprice) / 10000, 2) AS area, count(*) AS n FROM t JOIN lineitem ON l_partkey = p_partkey WHERE year(l_shipdate) = 1997 GROUP BY 1 ORDER BY area DESC, token LIMIT 20""")
def org_area_top(spark, sf_dir):
    """Areas of one year by token, credited in full to each; items are summed by part before they meet the tokens."""
    items = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == 1997).groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("k"))
    tokens = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    return tokens.join(items, F.col("l_partkey") == F.col("p_partkey")).groupBy("token").agg(F.round(F.sum("s") / 10000, 2).alias("area"), F.sum("k").alias("n")).orderBy(F.desc("area"), "token").limit(20)


@checked("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))")
def anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


_SEEDS = [("S1", 5, "ring"), ("S2", 17, "large gear")]


@checked("""SELECT DISTINCT s, p_partkey FROM part JOIN (VALUES ('S1', 5, 'ring'), ('S2', 17, 'large gear')) v(s, k, n) ON p_partkey = k OR contains(p_name, n)""")
def seed_or_join(spark, sf_dir):
    """Rows hit by a seed's key or containing its name: an equi-join and a short list of contains, united."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    seeds = F.broadcast(spark.createDataFrame(_SEEDS, "s string, k int, n string"))
    by_key = part.join(seeds, F.col("p_partkey") == F.col("k")).select("s", "p_partkey")
    return by_key.union(part.join(seeds, F.col("p_name").contains(F.col("n"))).select("s", "p_partkey")).distinct()


@checked("""WITH names AS (SELECT DISTINCT p_name FROM part), w(q) AS (VALUES ('small ring'), ('large'), ('mediumXX'), ('nothing at all')),
exact AS (SELECT q, p_name AS hit, 1 AS step FROM w JOIN names ON p_name = q),
pre AS (SELECT q, min(p_name) AS hit, 2 AS step FROM w JOIN names ON starts_with(p_name, substr(q, 1, 5)) WHERE q NOT IN (SELECT q FROM exact) GROUP BY q)
SELECT w.q, coalesce(e.hit, p.hit) AS hit, coalesce(e.step, p.step, 0)::INT AS step FROM w LEFT JOIN exact e USING (q) LEFT JOIN pre p USING (q)""")
def prefix_cascade(spark, sf_dir):
    """Exact names first; what is left by its first five characters, the smallest name winning."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    wanted = spark.createDataFrame([("small ring",), ("large",), ("mediumXX",), ("nothing at all",)], "q string")
    exact = wanted.join(names, F.col("p_name") == F.col("q")).select("q", F.col("p_name").alias("hit"), F.lit(1).alias("step"))
    rest = wanted.join(exact, "q", "left_anti").withColumn("pre", F.substring("q", 1, 5))
    by_prefix = rest.join(names.withColumn("pre", F.substring("p_name", 1, 5)), "pre").groupBy("q").agg(F.min("p_name").alias("hit")).withColumn("step", F.lit(2))
    return wanted.join(exact.unionByName(by_prefix), "q", "left").select("q", "hit", F.coalesce("step", F.lit(0)).alias("step"))


@checked("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first_dedup(spark, sf_dir):
    """The first row of each text: a grouped minimum over hashes, no text is shuffled."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@checked("""SELECT sha256(text) AS sha, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY 1 HAVING count(*) > 1""")
def byte_duplicates(spark, sf_dir):
    """Groups of equal files. Their members are listed, as the report needs them."""
    groups = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.where("n > 1").select("sha", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@checked("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey % 16 <> 1 AND c_custkey > 1),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, label) AS (SELECT a, a FROM s UNION SELECT s.b, r.label FROM r JOIN s ON s.a = r.node WHERE r.label < s.b)
SELECT node, min(label) AS component FROM r GROUP BY node""")
def components(spark, sf_dir):
    links = table(spark, sf_dir, "customer").where("c_custkey % 16 <> 1 and c_custkey > 1").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 2").alias("b"))
    return connected_components(links)


@checked("""SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS size FROM (
  SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'))
GROUP BY l_orderkey, island HAVING count(*) >= 3""")
def adjacent_runs(spark, sf_dir):
    return R.runs(table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'"), ["l_orderkey"], "l_linenumber", 3)


@checked("""WITH n AS (SELECT p_type, p_size, min(p_name) AS a, max(p_name) AS b, max(p_retailprice) AS area, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_name)), '；') AS names FROM part GROUP BY 1, 2)
SELECT p_type, p_size, area, n, names FROM n WHERE substr(a, 1, 3) = substr(b, 1, 3)""")
def fold_colocated(spark, sf_dir):
    """Groups at one place and time whose names all share a prefix of three characters, folded into one row each. The
    smallest and the largest name share it exactly if all do."""
    g = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"), F.max("p_retailprice").alias("area"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_name")), "；").alias("names"))
    return g.where(F.substring("a", 1, 3) == F.substring("b", 1, 3)).select("p_type", "p_size", "area", "n", "names")


@checked("""SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_type <> '' GROUP BY 1, 2)) WHERE rn = 1""")
def mode_non_blank(spark, sf_dir):
    counts = table(spark, sf_dir, "part").where("p_type <> ''").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return R.latest_per_key(counts, ["p_brand"], [F.desc("n"), F.col("p_type")])


@checked("""SELECT c_custkey, 'c_acctbal' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE')
UNION ALL SELECT c_custkey, 'c_custkey->orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def constraint_violations(spark, sf_dir):
    from fairloom.schema import check, inside, refers, violations

    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    rules = [check("c_acctbal", "c_acctbal >= 0"), inside("c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"]), refers("c_custkey", "orders", orders, "o_custkey")]
    return violations(table(spark, sf_dir, "customer"), "c_custkey", rules).select("c_custkey", "rule")


@checked(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def html_extract(spark, sf_dir):
    from fairloom.sources.html import links, title

    return table(spark, sf_dir, "pages").select("page_id", title(F.col("html")).alias("title"), F.size(links(F.col("html"))).cast("long").alias("n_links"))


@checked(None)
def fuzzy_best_margin(spark, sf_dir):
    from fairloom.operators.similarity import best_match

    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    known = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type", F.lit("x")).alias("known")).agg(F.min("p_partkey").alias("id"))
    return best_match(names, known, "name", "known", "id")


def _fairs(spark, sf_dir) -> DataFrame:
    """Parts as fairs: the brand organises, the type is the city, the size the day."""
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("2026年"), "p_name").alias("name"), F.col("p_name").alias("name_en"), F.col("p_brand").alias("organizer"), F.col("p_type").alias("city"), day.alias("start"), day.alias("end"), F.lit("").alias("l1"), F.lit("").alias("l2"), F.col("p_type").alias("venue"), F.lit(1).alias("editions"))
    # one fair for each name of an organizer and city, as a brand table has
    return R.latest_per_key(rows, ["name", "organizer", "city"], [F.col("id")])


@checked(None)
def dedup_pairs(spark, sf_dir):
    from fairloom.operators.similarity import duplicate_pairs

    return duplicate_pairs(_fairs(spark, sf_dir))


@checked(None)
def dedup_review(spark, sf_dir):
    from fairloom.operators.similarity import review_layers

    return review_layers(_fairs(spark, sf_dir))



