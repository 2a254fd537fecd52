"""Sources on the driver's tables: answers, category trees, detail pages and nested records are written out of a table's
rows in the form the sources read, read back, and checked against the rows by SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.operators.storage import cut, dealt, shared_folder, table
from fairloom.plans.merging import checked as _checked
from fairloom.sources import anchored, answers, categories, html

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def checked(sql: str | None):
    return _checked(sql, QUERIES, ORACLE_SQL)


def _said(pattern: str, **values: Column) -> Column:
    """Text with {names} in it replaced by values."""
    parts, rest = [], pattern
    while "{{" in rest:
        before, _, rest = rest.partition("{{")
        name, _, rest = rest.partition("}}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


_SEARCH = '{"Status":"200","Result":[{"KeyNo":"K{{id}}","Name":"{{type}}","CreditCode":"C{{id}}"},{"Name":"second"}]}'
_VERIFY = ('{"Status":"200","Result":{"VerifyResult":1,"Data":{"Name":"{{type}}","CreditCode":"C{{id}}"}}}', '{"Status":200,"Result":{"Name":"{{type}}","CreditCode":"C{{id}}","Data":{}}}')
_DISHONEST = ('{"Status":"200","Result":{"VerifyResult":1,"Data":[{"Anno":"A{{id}}"}]}}', '{"Status":"200","VerifyResult":0,"Result":[],"Data":[{"Anno":"A{{id}}"},{"Anno":"B"}]}')
_JOBS = ('{"Status":"200","Result":[{"Title":"T{{id}}"}],"Paging":{"TotalRecords":{{id}}}}', '{"Status":"200","Result":[{"Title":"T{{id}}"},{"Title":"U"}]}')
_TENDERS = ('{"Status":"200","Result":{"Data":[{"Title":"T{{id}}"}]}}', '{"Status":"200","Result":[{"Title":"T{{id}}"}]}')

_LAST = """WITH said AS (SELECT *, event_id % 5 AS kind, event_id % 13 = 0 AS broken, event_id % 11 = 0 AS empty, event_id // 5 % 2 AS shape FROM events),
last AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) = 1),
good AS (SELECT *, NOT empty AS ok FROM last WHERE NOT broken)"""


@checked(f"""{_LAST} SELECT u.user_id AS company,
  max(CASE WHEN kind = 0 THEN CASE WHEN ok THEN 2 ELSE 0 END END)::INT AS n_hits, max(CASE WHEN kind = 0 AND ok THEN 'K' || event_id END) AS first_key,
  max(CASE WHEN kind = 1 AND ok THEN event_type END) AS verified_name, max(CASE WHEN kind = 1 AND ok THEN 'C' || event_id END) AS credit_code,
  bool_or(CASE WHEN kind = 2 THEN ok AND shape = 0 END) AS dishonest, max(CASE WHEN kind = 2 THEN CASE WHEN NOT ok THEN 0 WHEN shape = 0 THEN 1 ELSE 2 END END)::INT AS n_findings,
  max(CASE WHEN kind = 3 THEN CASE WHEN NOT ok THEN 0 WHEN shape = 0 THEN event_id ELSE 2 END END)::BIGINT AS n_jobs, max(CASE WHEN kind = 3 AND ok THEN 'T' || event_id END) AS first_job,
  max(CASE WHEN kind = 4 AND ok THEN 'T' || event_id END) AS first_tender, max(CASE WHEN kind = 4 THEN CASE WHEN ok THEN 1 ELSE 0 END END)::INT AS n_tenders
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN good USING (user_id) GROUP BY 1""")
def research_answers(spark, sf_dir):
    """Events as answers: five questions in two shapes, some broken, some without a result."""
    events = table(spark, sf_dir, "events")
    kind, shape = F.col("event_id") % 5, F.floor(F.col("event_id") / 5) % 2
    value = {"id": F.col("event_id"), "type": F.col("event_type")}
    two = lambda pair: F.when(shape == 0, _said(pair[0], **value)).otherwise(_said(pair[1], **value))
    text = F.when(kind == 0, _said(_SEARCH, **value)).when(kind == 1, two(_VERIFY)).when(kind == 2, two(_DISHONEST)).when(kind == 3, two(_JOBS)).otherwise(two(_TENDERS))
    text = F.when(F.col("event_id") % 13 == 0, F.substring(text, 1, 30)).when(F.col("event_id") % 11 == 0, '{"Status":"201","Result":null}').otherwise(text)
    code = F.element_at(F.array(*map(F.lit, (answers.SEARCH, answers.VERIFY, answers.DISHONEST, answers.RECRUITMENT, answers.TENDERS))), (kind + 1).cast("int"))
    moment = F.concat(F.col("ts").cast("string"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    found = answers.unwrapped(events.select("user_id", code.alias("code"), text.alias("answer"), moment.alias("moment")), "user_id")
    return found.select(
        "company", F.size("hits").alias("n_hits"), F.get("hits", F.lit(0))["key_no"].alias("first_key"), F.col("verified.name").alias("verified_name"), F.col("verified.credit_code").alias("credit_code"), "dishonest",
        F.size("findings").alias("n_findings"), "n_jobs", F.get("jobs", F.lit(0))["title"].alias("first_job"), F.get("tenders", F.lit(0))["title"].alias("first_tender"), F.size("tenders").alias("n_tenders"),
    ).select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) if c in ("n_hits", "n_findings", "n_tenders") else F.col(c) for c in ("company", "n_hits", "first_key", "verified_name", "credit_code", "dishonest", "n_findings", "n_jobs", "first_job", "first_tender", "n_tenders")])


def _category_pages(spark, sf_dir) -> DataFrame:
    """One page for each customer: nation's category, links to three below it (one elsewhere), or options only."""
    # a file of a few MB is read in one task, but its rows become pages, whose links take long to find: so rows are dealt
    # first, and cut, as a filter on links would otherwise move into the reading task
    people = cut(dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"), "c_custkey", rows=20_000))
    href = lambda sub: F.concat(F.lit("/exhibition-"), F.col("c_nationkey").cast("string"), F.lit("-"), (sub % 40).cast("string"), F.lit("-0-0-0-0-1/"))
    anchors = F.concat(F.lit("<nav><a class='x' href='"), href(F.col("c_custkey")), F.lit("'><b>"), F.col("c_name"), F.lit(" </b></a><a href='/other'>no</a><a href='"), href(F.col("c_custkey") * 3 + 1),
                       F.lit("'> &amp;"), F.col("c_mktsegment"), F.lit("</a><a href='/exhibition-999-1-0/'>far</a><a href='"), href(F.col("c_custkey")), F.lit("'>again</a></nav>"))
    options = F.concat(F.lit("<a href='/exhibition-999-2-0/'>far</a><select><option value='"), href(F.col("c_custkey") + 7), F.lit("'>"), F.col("c_name"), F.lit("</option></select>"))
    page = F.when(F.col("c_custkey") % 4 == 0, options).otherwise(anchors)
    return people.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("url"), F.col("c_nationkey").cast("string").alias("parent_id"), page.alias("html"))


_LINKS = """WITH link AS (SELECT c_custkey AS k, c_nationkey AS parent, unnest(CASE WHEN c_custkey % 4 = 0 THEN [c_custkey + 7] ELSE [c_custkey, c_custkey * 3 + 1] END) % 40 AS sub,
  unnest(CASE WHEN c_custkey % 4 = 0 THEN [c_name] ELSE [c_name, '&' || c_mktsegment] END) AS name, unnest(CASE WHEN c_custkey % 4 = 0 THEN [0] ELSE [0, 1] END) AS spot FROM customer)"""


@checked(f"""{_LINKS} SELECT name, sub::VARCHAR AS sub_id, parent::VARCHAR AS parent_id FROM link QUALIFY row_number() OVER (PARTITION BY parent, sub ORDER BY k, spot) = 1""")
def category_links(spark, sf_dir):
    return categories.subcategories(_category_pages(spark, sf_dir))


@checked("""WITH link AS (SELECT c_custkey AS k, c_nationkey AS p, unnest(CASE WHEN c_custkey % 4 = 0 THEN [0] ELSE [0, 2, 4] END) AS spot FROM customer),
placed AS (SELECT k, spot, CASE WHEN spot = 0 AND k % 4 = 0 OR spot = 4 THEN '999' ELSE p::VARCHAR END AS parent_id,
  'https://x.example/exhibition-' || CASE WHEN k % 4 = 0 THEN '999-2-0/' WHEN spot = 4 THEN '999-1-0/' ELSE p || '-' || CASE spot WHEN 0 THEN k % 40 ELSE (k * 3 + 1) % 40 END || '-0-0-0-0-1/' END AS url FROM link)
SELECT url, parent_id FROM placed GROUP BY ALL""")
def category_parents(spark, sf_dir):
    return categories.parent_categories(_category_pages(spark, sf_dir), "https://x.example").select("url", "parent_id")


@checked(f"""{_LINKS} SELECT name, sub::VARCHAR AS sub_id, parent::VARCHAR AS parent_id FROM link QUALIFY row_number() OVER (PARTITION BY parent, sub ORDER BY k, spot) = 1""")
def category_round_trip(spark, sf_dir):
    """Categories written as JSON documents and read again."""
    import uuid

    pages = _category_pages(spark, sf_dir)
    path = f"{shared_folder(spark)}/categories-{uuid.uuid4().hex}"
    categories.write_categories(categories.parent_categories(pages, "https://x.example"), categories.subcategories(pages), path, "2026-01-01", most=300)
    return categories.read_categories(spark, path)[1]


_TREE = """node AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 61 = 60 THEN 1000000000 + p_partkey WHEN p_partkey % 50 = 10 THEN p_partkey + 1
  WHEN p_partkey % 50 = 11 THEN p_partkey - 1 ELSE p_partkey // 3 END AS parent FROM part)"""
_WALK = f"""WITH RECURSIVE {_TREE}, walk AS (SELECT n.node, n.parent AS ancestor, 1 AS distance FROM node n JOIN node p ON p.node = n.parent
  UNION ALL SELECT w.node, n.parent, distance + 1 FROM walk w JOIN node n ON n.node = w.ancestor JOIN node p ON p.node = n.parent WHERE distance < 60),
lost AS (SELECT DISTINCT node FROM walk WHERE distance = 60)"""


def _part_tree(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    parent = F.when(k == 0, None).when(k % 61 == 60, k + 1000000000).when(k % 50 == 10, k + 1).when(k % 50 == 11, k - 1).otherwise(F.floor(k / 3))
    return table(spark, sf_dir, "part").select(k.cast("long").alias("node"), parent.cast("long").alias("parent"))


@checked(f"{_WALK} SELECT node::BIGINT AS node, ancestor::BIGINT AS ancestor, distance FROM walk WHERE node NOT IN (SELECT node FROM lost)")
def category_closure(spark, sf_dir):
    return categories.ancestors(_part_tree(spark, sf_dir))[0]


@checked(f"""{_WALK} SELECT node::BIGINT AS node, 'cycle' AS reason FROM lost UNION ALL SELECT node, 'orphan' FROM node WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM node)
  AND node NOT IN (SELECT node FROM lost)""")
def category_refused(spark, sf_dir):
    return categories.ancestors(_part_tree(spark, sf_dir))[1]


@checked("""SELECT page_id, 'Fair ' || page_id AS cn_name, CASE WHEN page_id % 3 <> 0 THEN 'Page ' || chr((65 + page_id % 26)::INT) || ' International Expo' END AS en_name,
  CASE page_id % 4 WHEN 0 THEN '2026.05.06 - 05.08' WHEN 1 THEN '2025.01.02 - 2025.01.04' WHEN 2 THEN '2024.11.30' END AS date_str, CASE WHEN page_id % 5 <> 0 THEN '杭州' END AS city,
  CASE WHEN page_id % 5 <> 0 AND page_id % 2 = 0 THEN '第' || page_id || '展馆' END AS venue, CASE WHEN page_id % 7 <> 0 THEN '协会' || page_id END AS organizer,
  CASE WHEN page_id % 6 <> 0 THEN '面积:' || page_id || ',000平方米' END AS area_str, CASE WHEN page_id % 6 <> 0 THEN '展商:' || page_id || '家' END AS exhibitors_str,
  CASE WHEN page_id % 6 <> 0 AND page_id % 2 = 0 THEN '观众:' || page_id || '人' END AS visitors_str, CASE WHEN page_id % 6 <> 0 THEN '1年' || page_id % 9 || '届' END AS cycle,
  CASE page_id % 4 WHEN 0 THEN 2026 WHEN 1 THEN 2025 WHEN 2 THEN 2024 ELSE 0 END AS year FROM pages""")
def anchored_details(spark, sf_dir):
    """Every page's id in a detail page of the second site around the page's own text."""
    k = F.col("page_id")
    said = k.cast("string")
    date = F.when(k % 4 == 0, "展会时间：2026.05.06 -  05.08").when(k % 4 == 1, "2025.01.02-2025.01.04").when(k % 4 == 2, "on 2024.11.30 only").otherwise("soon")
    place = F.when(k % 5 != 0, F.concat(F.lit("<p>浙江-杭州 "), F.when(k % 2 == 0, F.concat(F.lit("第"), said, F.lit("展馆"))).otherwise("somewhere"), F.lit("</p>"))).otherwise("")
    organizer = F.when(k % 7 != 0, F.concat(F.lit("<p><b>主办单位：</b> 协会"), said, F.lit("</p>"))).otherwise("")
    visitors = F.when(k % 2 == 0, F.concat(F.lit("观众数量："), said, F.lit("人"))).otherwise("")
    measures = F.when(k % 6 != 0, F.concat(F.lit("<p>举办周期：1年"), (k % 9).cast("string"), F.lit("届会展面积："), said, F.lit(",000平方米展商数量："), said, F.lit("家"), visitors, F.lit("</p>"))).otherwise("")
    english = F.when(k % 3 != 0, F.concat(F.lit("<p>Page "), F.element_at(F.array(*[F.lit(chr(65 + i)) for i in range(26)]), (k % 26 + 1).cast("int")), F.lit(" International Expo</p><p>。</p>"))).otherwise("<p>-</p>")
    page = F.concat(F.lit("<html><title>t-中国会展网</title><h1> Fair "), said, F.lit("</h1>"), english, F.lit("<p>"), date, F.lit("</p>"), place, organizer, measures, F.lit("<div><p>x</p></div>"), F.lit("</html>"))
    rows = table(spark, sf_dir, "pages").select("page_id", page.alias("html"))
    return anchored.anchored_rows(rows).drop("html")


@checked("""SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN 'P' || event_id WHEN event_id % 5 <> 0 THEN 'Q' || event_id END AS public_id,
  CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 1 THEN 'W' || user_id WHEN event_id % 5 <> 0 THEN 'V' || user_id END AS official_website,
  CASE WHEN event_id % 5 = 0 THEN 'first' WHEN event_id % 5 = 1 THEN 'second' ELSE 'both' END AS stats_from,
  CASE event_id % 5 WHEN 0 THEN 'a:N:,b::1' WHEN 1 THEN 'b:M:,c:M:2' ELSE 'a:N:,b:M:1,c:M:2' END AS exhibitors FROM events""")
def two_path_records(spark, sf_dir):
    """Events as records seen on two paths: one of five lacks the second, one of five the first."""
    k = F.col("event_id").cast("string")
    first = _said('{"public_id":"P{{id}}","official_website":{{site}},"stats":{"x":"1"},"exhibitors":[{"public_id":"a","name":"N"},{"public_id":"b","booth":"1"}]}', id=k, site=F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"W'), F.col("user_id").cast("string"), F.lit('"'))).otherwise("null"))
    second = _said('{"public_id":"Q{{id}}","official_website":"V{{user}}","stats":{"x":"2","y":"3"},"exhibitors":[{"public_id":"b","name":"M"},{"public_id":"c","name":"M","booth":"2"}]}', id=k, user=F.col("user_id"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.from_json(F.when(F.col("event_id") % 5 != 1, first), html.FAIR).alias("a"), F.from_json(F.when(F.col("event_id") % 5 != 0, second), html.FAIR).alias("b"))
    found = rows.select("event_id", *[v.alias(n) for n, v in html.two_paths(F.col("a"), F.col("b"), {"exhibitors": "public_id"}).items()])
    listed = F.array_join(F.transform("exhibitors", lambda e: F.concat_ws(":", e["public_id"], F.coalesce(e["name"], F.lit("")), F.coalesce(e["booth"], F.lit("")))), ",")
    return found.select("event_id", "public_id", "official_website", F.col("origin")["stats"].alias("stats_from"), listed.alias("exhibitors"))
