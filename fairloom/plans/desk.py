"""The workbench's queries on tables derived from the driver's: each block of a page is a query, with its SQL.

DERIVED states every table once, in SQL that Spark and the checking database both understand: customers play brands,
orders editions, suppliers companies, parts opportunities, events resources and what happened, documents reports, line
items participations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairloom.operators.storage import table
from fairloom.plans import actions as A
from fairloom.plans import batch as B
from fairloom.plans import workbench as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_DAY = "CAST(CAST({} AS DATE) AS STRING)"
DERIVED = {
    "exhibition_brand": ("customer", """SELECT 'B' || CAST(c_custkey AS STRING) AS brand_id, c_name AS name_cn, lower(c_name) AS name_en,
  CASE WHEN c_nationkey % 7 = 0 THEN '' ELSE 'city' || CAST(c_nationkey AS STRING) END AS city, c_mktsegment AS industry_l1,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || CAST(c_custkey % 4 AS STRING) END AS industry_l2, 'N' || CAST(c_nationkey AS STRING) AS country_cn,
  'Org ' || CAST(c_custkey % 50 AS STRING) AS organizer, CASE WHEN c_custkey % 11 = 0 THEN 'Org 7' END AS co_organizer,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS INT) AS display_ready, CAST(CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 10 END AS INT) AS scale_score,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INT) AS is_ufi_certified, CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS is_international,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 9 <> 1 THEN 'own' END AS competition_relation FROM {customer}"""),
    "exhibition_edition": ("orders", f"""SELECT 'E' || CAST(o_orderkey AS STRING) AS edition_id, 'B' || CAST(o_custkey AS STRING) AS brand_id, CAST(year(o_orderdate) AS INT) AS year,
  {_DAY.format('o_orderdate')} AS date_start, CASE WHEN o_orderkey % 4 <> 0 THEN {_DAY.format('o_orderdate')} END AS date_end, 'Hall ' || CAST(o_orderkey % 9 AS STRING) AS venue,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS area_sqm, CAST(o_orderkey % 1000 AS BIGINT) AS exhibitors_count,
  CAST(o_orderkey % 7000 AS BIGINT) AS visitors_count, CASE WHEN o_orderkey % 17 = 0 THEN '取消' WHEN o_orderkey % 19 = 0 THEN '延期' ELSE '' END AS status FROM {{orders}}"""),
    "company": ("supplier", """SELECT s_suppkey AS company_id, s_name AS name, lower(s_name) AS name_en, 'city' || CAST(s_nationkey AS STRING) AS city, 'N' || CAST(s_nationkey AS STRING) AS country,
  CASE WHEN s_suppkey % 2 = 0 THEN 'manual' ELSE 'qcc_search' END AS source_type, 'open' AS contact_status, CAST(s_suppkey % 5 + 1 AS INT) AS prospect_score,
  '2024-01-' || CAST(10 + s_suppkey % 20 AS STRING) AS updated_at, '2024-01-01' AS created_at, 'B' || CAST(s_suppkey * 3 AS STRING) AS brand_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'C' || CAST(s_suppkey AS STRING) END AS credit_code FROM {supplier}"""),
    "opportunity": ("part", """SELECT p_partkey AS opp_id, p_name AS title, upper(p_name) AS title_en, p_type AS type,
  CASE p_size % 6 WHEN 0 THEN 'contact' WHEN 1 THEN 'intent' WHEN 2 THEN 'dd' WHEN 3 THEN 'audit' WHEN 4 THEN 'closing' ELSE 'bogus' END AS stage, p_brand AS deal_type,
  CAST(p_size AS INT) AS priority, p_brand AS owner, 'call ' || p_name AS next_action,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 <> 1 THEN '2024-01-' || CAST(10 + p_partkey % 20 AS STRING) END AS next_action_due,
  CAST(CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS INT) AS is_archived, CAST(p_partkey % 20 AS BIGINT) AS company_id, 'B' || CAST(p_partkey AS STRING) AS brand_id,
  CASE WHEN p_partkey % 3 = 0 THEN '{{bad' ELSE '{{"a": 1}}' END AS detail_json, '2024-02-' || CAST(10 + p_partkey % 15 AS STRING) AS updated_at FROM {part}"""),
    "opportunity_event": ("events", f"""SELECT event_id, CAST(event_id % 200 AS BIGINT) AS opp_id, CASE WHEN event_type = 'signup' THEN 'meeting' ELSE 'note' END AS event_type, event_type AS content,
  'f/' || CAST(event_id % 3000 AS STRING) AS file_path, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN {_DAY.format('ts')} ELSE {_DAY.format('ts')} || ' 10:30' END AS occurred_at,
  {_DAY.format('ts')} || ' 08:00' AS created_at FROM {{events}}"""),
    "intel_report": ("documents", """SELECT doc_id AS id, source AS title, lang AS report_type, CASE WHEN doc_id % 4 = 0 THEN 'draft' ELSE 'published' END AS status, 'IT' AS industry_l1, text AS report_md,
  CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 40 AS BIGINT) END AS company_id, 'T' || CAST(doc_id % 7 AS STRING) AS target_company, 'B' || CAST(doc_id AS STRING) AS brand_id,
  CASE WHEN doc_id % 9 <> 0 THEN '2024-03-' || CAST(10 + doc_id % 20 AS STRING) END AS updated_at, CAST(doc_id % 50 AS BIGINT) AS opp_id FROM {documents}"""),
    "resource": ("events", """SELECT event_id AS resource_id, event_type AS kind, 'r' || CAST(event_id AS STRING) AS title, 'f/' || CAST(event_id AS STRING) AS file_path, CAST(user_id AS BIGINT) AS size_bytes,
  'crawl' AS source, '2024-01-' || CAST(10 + event_id % 20 AS STRING) AS created_at, CAST(event_id % 300 AS BIGINT) AS opp_id, CAST(event_id % 21 AS BIGINT) AS company_id FROM {events}"""),
    "brand_organizer": ("customer", """SELECT 'B' || CAST(c_custkey AS STRING) AS brand_id, CAST(0 AS INT) AS seq, 'Org ' || CAST(c_custkey % 50 AS STRING) AS canonical,
  CASE WHEN c_custkey % 4 = 0 THEN '协会' ELSE '企业' END AS org_type FROM {customer}"""),
    "crawl_log": ("region", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS batch_id, 'success' AS status, '2024-01-0' || CAST(r_regionkey + 1 AS STRING) AS started_at, '' AS finished_at FROM {region}"),
    "editions": ("part", "SELECT 'D' || CAST(p_partkey AS STRING) AS edition_id, p_brand AS show_name, CAST(2015 + p_partkey % 8 AS INT) AS edition_year FROM {part}"),
    "participations": ("lineitem", """SELECT l_orderkey * 10 + l_linenumber AS part_id, 'D' || CAST(l_partkey AS STRING) AS edition_id, 'V' || CAST(l_suppkey AS STRING) AS vis_hash,
  'Name ' || CAST(l_suppkey AS STRING) || CASE WHEN l_orderkey % 50 = 0 THEN ' Ltd' ELSE '' END AS raw_name, CASE WHEN l_suppkey % 5 = 0 THEN 'CN' ELSE 'DE' END AS country_code,
  CASE WHEN l_linenumber < 6 THEN 'H' || CAST(l_linenumber AS STRING) END AS hall, 'A' || CAST(CAST(l_quantity AS INT) AS STRING) AS booth_number FROM {lineitem}"""),
    "seeds": ("supplier", "SELECT s_suppkey AS agent_id, 'V' || CAST(s_suppkey AS STRING) AS vis_hash, 'Name ' || CAST(s_suppkey * 10 AS STRING) || ' Ltd' AS name FROM {supplier} WHERE s_suppkey <= 5"),
}


class Derived(dict):
    """The derived tables of a folder, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        source, sql = DERIVED[name]
        self[name] = self.spark.sql(sql, **{source: table(self.spark, self.sf_dir, source)})
        return self[name]


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n][1].format(**{DERIVED[n][0]: DERIVED[n][0]})})" for n in names)


_LATEST = """, latest AS (SELECT b.*, e.edition_id, e.year, e.date_start, e.date_end, e.venue, e.area_sqm, e.exhibitors_count, e.visitors_count, e.status FROM exhibition_brand b LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY year DESC NULLS LAST, edition_id DESC) AS rn FROM exhibition_edition) e ON e.brand_id = b.brand_id AND e.rn = 1)"""


def checked(name: str, tables: str, sql: str, latest: bool = False):
    """Register a function of the derived tables as the query desk_<name>, with the SQL for the same rows."""

    def add(f: Callable[[Derived], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Derived(spark, sf_dir))

        run.__name__ = f"desk_{name}"
        QUERIES[run.__name__] = run
        ORACLE_SQL[run.__name__] = f"{_with(*tables.split())}{_LATEST if latest else ''} {sql}"
        return f

    return add


TODAY, MONTH = "2024-01-17", "2024-01"
_BE = "exhibition_brand exhibition_edition"

# lists and details
checked("companies", "company", "SELECT company_id, name, city, country, source_type, contact_status, prospect_score, updated_at FROM company WHERE source_type = 'manual' AND (name ILIKE '%1%' OR name_en ILIKE '%1%') ORDER BY name, company_id LIMIT 20 OFFSET 0")(
    lambda t: W.list_page(t, "company", {"source_type": "manual", "unknown": 1}, "1", "name", "asc", 1, 20)[0].select("company_id", "name", "city", "country", "source_type", "contact_status", "prospect_score", "updated_at"))
checked("opportunities", "opportunity", """SELECT opp_id, title, type, stage, deal_type, priority, owner, next_action, next_action_due, updated_at FROM opportunity WHERE is_archived = 0 AND stage = 'dd'
  ORDER BY priority DESC, opp_id LIMIT 30 OFFSET 30""")(lambda t: W.list_page(t, "opportunity", {"stage": "dd"}, None, "priority", "desc", 2, 30)[0])
checked("opportunities_total", "opportunity", "SELECT count(*) AS total FROM opportunity WHERE is_archived = 0 AND stage = 'dd'")(lambda t: W.list_page(t, "opportunity", {"stage": "dd"})[1])
checked("reports", "intel_report company", """SELECT id, title, r.report_type, r.status, r.industry_l1, r.updated_at, substr(report_md, 1, 160) AS excerpt, coalesce(c.name, target_company) AS company_name
  FROM intel_report r LEFT JOIN company c ON c.company_id = r.company_id WHERE r.report_type = 'en' AND r.status = 'draft'""")(lambda t: W.list_rows(t, "research", {"report_type": "en", "status": "draft"}))
checked("resources", "resource", "SELECT resource_id, kind, title, file_path, size_bytes, source, created_at FROM resource WHERE kind = 'error' AND (title ILIKE '%7%' OR file_path ILIKE '%7%') ORDER BY size_bytes DESC, resource_id LIMIT 50")(
    lambda t: W.list_page(t, "resource", {"kind": "error"}, "7", "size_bytes", "desc")[0])
checked("expos", _BE, "SELECT brand_id, name_cn, name_en, city, industry_l1, industry_l2, year, area_sqm, exhibitors_count, visitors_count FROM latest WHERE display_ready = 1 AND industry_l1 = 'BUILDING' AND (name_cn ILIKE '%12%' OR name_en ILIKE '%12%')", True)(
    lambda t: W.list_rows(t, "expo", {"industry_l1": "BUILDING"}, "12"))
checked("report_detail", "intel_report", "SELECT id, title, status, company_id, target_company FROM intel_report WHERE id = 11")(lambda t: W.detail(t, "research", 11).select("id", "title", "status", "company_id", "target_company"))
checked("brand_detail", _BE, "SELECT brand_id, name_cn, edition_id, year, area_sqm FROM latest WHERE brand_id = 'B17'", True)(lambda t: W.detail(t, "expo", "B17").select("brand_id", "name_cn", "edition_id", "year", "area_sqm"))

# dashboards
checked("overview_kpi", "opportunity", f"""SELECT count(*) AS opportunities, coalesce(sum((next_action_due <> '' AND substr(next_action_due, 1, 10) < '{TODAY}')::INT), 0)::BIGINT AS overdue,
  coalesce(sum((next_action_due <> '' AND substr(next_action_due, 1, 10) BETWEEN '{TODAY}' AND '2024-01-21')::INT), 0)::BIGINT AS this_week, '2024-01-21' AS week_end FROM opportunity WHERE is_archived = 0""")(lambda t: W.overview(t, TODAY)["kpi"])
checked("overview_tasks", "opportunity", "SELECT opp_id, title, stage, owner, next_action, next_action_due FROM opportunity WHERE is_archived = 0 AND next_action_due <> '' ORDER BY next_action_due, opp_id LIMIT 10")(lambda t: W.overview(t, TODAY)["tasks"])
checked("overview_reports", "intel_report company", """SELECT id, title, report_type, r.status, r.updated_at, name AS company_name, substr(report_md, 1, 160) AS excerpt FROM intel_report r LEFT JOIN company c ON c.company_id = r.company_id
  ORDER BY r.updated_at DESC NULLS LAST, id DESC LIMIT 5""")(lambda t: W.overview(t, TODAY)["reports"])
checked("overview_funnel", "opportunity", """SELECT pos::INT AS pos, d.stage, (SELECT count(*) FROM opportunity o WHERE o.stage = d.stage AND is_archived = 0) AS n
  FROM (VALUES (0, 'contact'), (1, 'intent'), (2, 'dd'), (3, 'audit'), (4, 'closing')) d(pos, stage)""")(lambda t: W.overview(t, TODAY)["funnel"])
checked("overview_resources", "resource", "SELECT kind, count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM resource GROUP BY ROLLUP (kind)")(lambda t: W.overview(t, TODAY)["resources"])
checked("landing_coverage", f"{_BE} company intel_report resource", """SELECT count(*) AS brands, count(DISTINCT city) AS cities, count(DISTINCT country_cn) AS countries, (SELECT count(*) FROM exhibition_edition) AS n_exhibition_edition,
  (SELECT count(*) FROM company) AS n_company, (SELECT count(*) FROM intel_report) AS n_intel_report, (SELECT count(*) FROM resource) AS n_resource FROM exhibition_brand WHERE display_ready = 1""")(lambda t: W.landing(t, 1996)["coverage"])
checked("landing_organizers", "exhibition_brand brand_organizer", """SELECT canonical, count(DISTINCT o.brand_id) AS brands, contains(canonical, '7') AS highlight FROM brand_organizer o JOIN exhibition_brand b ON b.brand_id = o.brand_id
  WHERE org_type = '企业' AND display_ready = 1 GROUP BY canonical ORDER BY brands DESC, canonical LIMIT 6""")(lambda t: W.landing(t, 1996, "7")["organizers"])
checked("landing_cities", _BE, "SELECT city, count(*) AS n, coalesce(sum(area_sqm), 0)::BIGINT AS area FROM latest WHERE display_ready = 1 AND city <> '' GROUP BY city ORDER BY n DESC, city LIMIT 6", True)(lambda t: W.landing(t, 1996)["cities"])
checked("landing_schedule", _BE, """, m AS (SELECT d.m::INT AS month, count(e.edition_id) AS n FROM range(1, 13) d(m) LEFT JOIN (
  SELECT e.* FROM exhibition_edition e JOIN exhibition_brand b ON b.brand_id = e.brand_id WHERE display_ready = 1 AND date_start LIKE '1996-%') e ON substr(date_start, 6, 2)::INT = d.m GROUP BY 1)
SELECT month, n, n > 0 AND n = max(n) OVER () AS is_peak FROM m""")(lambda t: W.landing(t, 1996)["schedule"])
checked("landing_without", _BE, "SELECT count(*) AS n FROM exhibition_brand b WHERE display_ready = 1 AND NOT EXISTS (SELECT 1 FROM exhibition_edition e WHERE e.brand_id = b.brand_id AND year >= 1999)")(lambda t: W.landing(t, 1999)["without"])
checked("stats_totals", _BE, "SELECT count(*) AS brands, coalesce(sum(area_sqm), 0)::BIGINT AS area_sqm, coalesce(sum(exhibitors_count), 0)::BIGINT AS exhibitors_count, coalesce(sum(visitors_count), 0)::BIGINT AS visitors_count FROM latest WHERE display_ready = 1 AND industry_l1 IN ('BUILDING', 'MACHINERY')", True)(
    lambda t: W.expo_stats(t, ("BUILDING,MACHINERY",))["totals"])
checked("stats_industry", _BE, "SELECT industry_l1, count(*) AS n FROM latest WHERE display_ready = 1 AND area_sqm >= 10000 AND area_sqm < 50000 GROUP BY 1", True)(lambda t: W.expo_stats(t, bucket="1w-5w")["industry"])
checked("calendar", "opportunity opportunity_event", f""", rows AS (
  SELECT substr(occurred_at, 1, 10) AS day, 'meeting' AS kind, e.opp_id, title, coalesce(content, '') AS text, CASE WHEN length(occurred_at) > 10 THEN substr(occurred_at, 12, 5) END AS time, false AS overdue, 0 AS k, occurred_at AS moment, event_id AS i
  FROM opportunity_event e JOIN opportunity o ON o.opp_id = e.opp_id WHERE is_archived = 0 AND event_type = 'meeting' AND substr(occurred_at, 1, 7) = '{MONTH}'
  UNION ALL SELECT substr(next_action_due, 1, 10), 'next_action', opp_id, title, coalesce(next_action, ''), NULL, substr(next_action_due, 1, 10) < '{TODAY}', 1, next_action_due, opp_id
  FROM opportunity WHERE is_archived = 0 AND substr(next_action_due, 1, 7) = '{MONTH}')
SELECT day, kind, opp_id, title, text, time, overdue, row_number() OVER (PARTITION BY day ORDER BY k, moment, i)::INT AS place FROM rows""")(lambda t: W.calendar(t, MONTH, TODAY))
checked("system_status", f"{_BE} company opportunity intel_report resource crawl_log", """SELECT (SELECT count(*) FROM exhibition_brand) AS n_exhibition_brand, (SELECT count(*) FROM exhibition_edition) AS n_exhibition_edition, (SELECT count(*) FROM company) AS n_company,
  (SELECT count(*) FROM opportunity) AS n_opportunity, (SELECT count(*) FROM intel_report) AS n_intel_report, (SELECT count(*) FROM resource) AS n_resource, l.* FROM (
  SELECT batch_id, status, started_at, finished_at FROM crawl_log ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 1) l""")(lambda t: W.system_status(t))

# one opportunity, one company, one brand, one industry
_MINE = "(r.opp_id = 7 OR (r.company_id IS NOT NULL AND r.company_id = (SELECT company_id FROM opportunity WHERE opp_id = 7)))"
checked("opportunity", "opportunity", "SELECT opp_id, title, stage, CASE WHEN opp_id % 3 = 0 THEN '{}' ELSE detail_json END AS detail_json FROM opportunity WHERE opp_id = 9")(lambda t: W.opportunity_detail(t, 9)["opportunity"].select("opp_id", "title", "stage", "detail_json"))
checked("opportunity_company", "opportunity company", "SELECT c.company_id, c.name FROM company c WHERE c.company_id = (SELECT company_id FROM opportunity WHERE opp_id = 7)")(lambda t: W.opportunity_detail(t, 7)["company"].select("company_id", "name"))
checked("opportunity_reports", "opportunity intel_report", f"SELECT id, title, opp_id, company_id FROM intel_report r WHERE {_MINE}")(lambda t: W.opportunity_detail(t, 7)["reports"].select("id", "title", "opp_id", "company_id"))
checked("opportunity_resources", "opportunity resource", f"SELECT resource_id, kind, opp_id, company_id FROM resource r WHERE {_MINE}")(lambda t: W.opportunity_detail(t, 7)["resources"].select("resource_id", "kind", "opp_id", "company_id"))
checked("opportunity_events", "opportunity_event resource", "SELECT e.event_id, e.content, e.occurred_at, r.resource_id AS event_resource FROM opportunity_event e LEFT JOIN resource r ON r.file_path = e.file_path WHERE e.opp_id = 7")(
    lambda t: W.opportunity_detail(t, 7)["events"].select("event_id", "content", "occurred_at", "event_resource"))
checked("company", f"{_BE} company", "SELECT l.brand_id, l.edition_id, l.area_sqm FROM latest l WHERE l.brand_id = (SELECT brand_id FROM company WHERE company_id = 4)", True)(lambda t: W.company_detail(t, 4)["brand"].select("brand_id", "edition_id", "area_sqm"))
checked("company_reports", "intel_report", "SELECT id, title FROM intel_report WHERE company_id = 4")(lambda t: W.company_detail(t, 4)["reports"].select("id", "title"))
checked("company_resources", "resource", "SELECT resource_id, kind FROM resource WHERE company_id = 4")(lambda t: W.company_detail(t, 4)["resources"].select("resource_id", "kind"))
_HITS = ", hits AS (SELECT *, row_number() OVER (ORDER BY coalesce(scale_score, 0) DESC, brand_id) AS r FROM exhibition_brand WHERE name_cn ILIKE '%2%' OR name_en ILIKE '%2%' OR brand_id ILIKE '%2%'), me AS (SELECT * FROM hits WHERE r = 1)"
checked("brand_research", "exhibition_brand", f"{_HITS} SELECT brand_id, name_cn FROM me")(lambda t: W.brand_research(t, "2")["brand"].select("brand_id", "name_cn"))
checked("brand_exact", "exhibition_brand", "SELECT brand_id, name_cn FROM exhibition_brand WHERE brand_id = 'B12'")(lambda t: W.brand_research(t, "B12")["brand"].select("brand_id", "name_cn"))
checked("brand_others", "exhibition_brand", f"{_HITS} SELECT brand_id, name_cn FROM hits WHERE r BETWEEN 2 AND 6")(lambda t: W.brand_research(t, "2")["others"].select("brand_id", "name_cn"))
checked("brand_peers", "exhibition_brand", f"""{_HITS}, near AS (SELECT b.*, CASE WHEN b.industry_l2 = me.industry_l2 AND me.industry_l2 <> '' THEN 0 ELSE 1 END AS tier FROM exhibition_brand b, me WHERE b.industry_l1 = me.industry_l1 AND b.brand_id <> me.brand_id)
SELECT brand_id, industry_l2 FROM near WHERE tier = (SELECT min(tier) FROM near) ORDER BY coalesce(scale_score, 0) DESC, brand_id LIMIT 15""")(lambda t: W.brand_research(t, "2")["peers"].select("brand_id", "industry_l2"))
checked("brand_editions", _BE, f"{_HITS} SELECT edition_id, year FROM exhibition_edition WHERE brand_id = (SELECT brand_id FROM me) ORDER BY year DESC NULLS LAST, edition_id DESC LIMIT 10")(lambda t: W.brand_research(t, "2")["editions"].select("edition_id", "year"))
_TOP = ", chosen AS (SELECT * FROM exhibition_brand WHERE industry_l1 = 'BUILDING' AND industry_l2 = 'BUILDING1'), top AS (SELECT * FROM chosen ORDER BY coalesce(scale_score, 0) DESC, brand_id LIMIT 50)"
checked("industry_brands", "exhibition_brand", f"{_TOP} SELECT brand_id, scale_score FROM top")(lambda t: W.industry_research(t, "BUILDING / BUILDING1")["brands"].select("brand_id", "scale_score"))
checked("industry_counts", "exhibition_brand", f"{_TOP} SELECT count(*) AS shown, coalesce(sum((is_ufi_certified = 1)::INT), 0)::BIGINT AS ufi, coalesce(sum((is_international = 1)::INT), 0)::BIGINT AS international, (SELECT count(*) FROM chosen) AS total FROM top")(
    lambda t: W.industry_research(t, "BUILDING", "BUILDING1")["counts"])
checked("industry_cities", "exhibition_brand", f"{_TOP} SELECT coalesce(nullif(city, ''), '未知') AS city, count(*) AS n FROM top GROUP BY 1 ORDER BY n DESC, city LIMIT 5")(lambda t: W.industry_research(t, "BUILDING", "BUILDING1")["cities"])
checked("company_history", _BE, """SELECT e.edition_id, e.year, b.name_cn, b.organizer FROM exhibition_edition e JOIN exhibition_brand b ON b.brand_id = e.brand_id WHERE b.organizer ILIKE '%Org 7%' OR b.co_organizer ILIKE '%Org 7%'
  ORDER BY e.year DESC NULLS LAST, e.edition_id DESC LIMIT 30""")(lambda t: W.company_history(t, "Org 7").select("edition_id", "year", "name_cn", "organizer"))
checked("export_rows", _BE, """SELECT e.edition_id, b.brand_id, b.city, e.date_start, e.venue FROM exhibition_edition e JOIN exhibition_brand b ON b.brand_id = e.brand_id WHERE date_start BETWEEN '1996-02-01' AND '1996-04-30'""")(
    lambda t: W.export_rows(t, "1996-02-01", "1996-04-30").select("edition_id", "brand_id", "city", "date_start", "venue"))
checked("export_mainland", _BE, """SELECT e.edition_id, b.city FROM exhibition_edition e JOIN exhibition_brand b ON b.brand_id = e.brand_id WHERE date_start BETWEEN '1996-02-01' AND '1996-04-30'
  AND b.city IN (SELECT city FROM exhibition_brand WHERE country_cn < 'N2') AND b.city NOT IN ('city1', 'city2') AND NOT regexp_matches(venue, 'Hall [34]')""")(
    lambda t: W.export_rows(t, "1996-02-01", "1996-04-30", t["exhibition_brand"].where("country_cn < 'N2'"), ("city1", "city2"), "Hall [34]").select("edition_id", "city"))
checked("export_for_tagging", "exhibition_brand", "SELECT brand_id, industry_l2 FROM exhibition_brand WHERE trim(coalesce(competition_relation, '')) = '' AND industry_l2 = 'BUILDING1'")(lambda t: W.export_for_tagging(t, "BUILDING1").select("brand_id", "industry_l2"))

# exhibitors
_WALKS = ", walks AS (SELECT p.*, show_name, edition_year, trim(coalesce(hall, '') || ' ' || coalesce(booth_number, '')) AS booth_full FROM participations p JOIN editions e ON e.edition_id = p.edition_id)"
_PE = "participations editions"
checked("booth_history", _PE, f"""{_WALKS}, y AS (SELECT DISTINCT booth_full, show_name, edition_year FROM walks)
SELECT w.part_id, w.booth_full, c.n AS unique_companies_at_booth, v.n AS company_years FROM walks w
JOIN (SELECT booth_full, show_name, count(DISTINCT vis_hash) AS n FROM walks GROUP BY ALL) c ON c.booth_full = w.booth_full AND c.show_name = w.show_name
JOIN (SELECT vis_hash, show_name, count(DISTINCT edition_year) AS n FROM walks GROUP BY ALL) v ON v.vis_hash = w.vis_hash AND v.show_name = w.show_name""")(lambda t: W.booth_history(t).select("part_id", "booth_full", "unique_companies_at_booth", "company_years"))
checked("booth_rotation", _PE, f"""{_WALKS} SELECT show_name, booth_full, count(DISTINCT vis_hash) AS companies, (SELECT string_agg(edition_year || ': ' || raw_name, ' > ' ORDER BY edition_year, raw_name) FROM (
  SELECT DISTINCT edition_year, raw_name FROM walks i WHERE i.show_name = w.show_name AND i.booth_full = w.booth_full)) AS history FROM walks w GROUP BY show_name, booth_full HAVING count(DISTINCT vis_hash) > 1""")(lambda t: W.booth_rotation_alert(t))
checked("name_changes", "participations", """SELECT vis_hash, count(DISTINCT raw_name) AS names, string_agg(DISTINCT raw_name, ' > ' ORDER BY raw_name) AS history FROM participations GROUP BY 1 HAVING count(DISTINCT raw_name) > 1""")(lambda t: W.name_changes(t))
checked("other_halls", _PE, f"{_WALKS} SELECT part_id, hall, show_name FROM walks WHERE country_code = 'CN' AND hall NOT IN ('H1', 'H2')")(lambda t: W.in_other_halls(t, "CN", ("H1", "H2")).select("part_id", "hall", "show_name"))
checked("seed_hits", f"{_PE} seeds", f"{_WALKS} SELECT DISTINCT part_id, agent_id FROM walks w JOIN seeds s ON s.vis_hash = w.vis_hash OR contains(w.raw_name, s.name)")(lambda t: W.seed_hits(t, t["seeds"]))

# transitions: what a run leaves
checked("edition_status", "exhibition_edition", """SELECT edition_id, CASE WHEN status IN ('取消', '延期') THEN status WHEN date_start < '1998-01-01' AND coalesce(date_end, date_start) < '1998-01-01' THEN '已举办' ELSE '即将举办' END AS status FROM exhibition_edition""")(
    lambda t: B.edition_status(t["exhibition_edition"], "1998-01-01").select("edition_id", "status"))
checked("stage_changes", "opportunity", "SELECT opp_id, CASE WHEN opp_id % 2 = 0 AND stage <> 'closing' THEN 'closing' ELSE stage END AS stage FROM opportunity")(
    lambda t: B.stage_changes(t["opportunity"].drop("updated_at"), t["opportunity"].where("opp_id % 2 = 0").selectExpr("opp_id", "'closing' as stage"), TODAY, "me")[0].select("opp_id", "stage"))
checked("stage_events", "opportunity", "SELECT opp_id, stage || ' → closing' AS content FROM opportunity WHERE opp_id % 2 = 0 AND stage <> 'closing'")(
    lambda t: B.stage_changes(t["opportunity"].drop("updated_at"), t["opportunity"].where("opp_id % 2 = 0").selectExpr("opp_id", "'closing' as stage"), TODAY, "me")[1].select("opp_id", "content"))

# rows created, deleted, backfilled and put right
_DRAFTS = """SELECT s_suppkey AS draft, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name END AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE 'ma' END AS type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'bogus' ELSE 'contact' END AS stage, CAST(s_suppkey % 9 AS INT) AS priority FROM {supplier}"""
DERIVED["drafts"] = ("supplier", _DRAFTS)
DERIVED["scanned"] = ("events", """SELECT 'f/' || CAST(event_id * 2 AS STRING) AS file_path, 'note' AS kind, 's' || CAST(event_id AS STRING) AS title, CAST(event_id AS BIGINT) AS size_bytes,
  CAST(event_id % 5 AS BIGINT) AS company_id FROM {events}""")
DERIVED["found"] = ("events", """SELECT 'f/' || CAST(event_id AS STRING) AS report_file, 'company' AS report_type, event_type AS report_md, 'r' || CAST(event_id AS STRING) AS title,
  CAST(event_id % 9 AS BIGINT) AS company_id, '2024-05-01' AS made_at FROM {events} WHERE event_id % 3 = 0""")
DERIVED["filed"] = ("documents", """SELECT doc_id AS id, 'f/' || CAST(doc_id * 2 AS STRING) AS report_file, 'industry' AS report_type, lang AS report_md, source AS title, CAST(doc_id % 4 AS BIGINT) AS company_id,
  'draft' AS status, 'me' AS created_by, '2024-01-01' AS created_at, '2024-01-01' AS updated_at FROM {documents}""")


def _created(t: Derived) -> tuple[DataFrame, DataFrame]:
    return A.created(t["opportunity"], t["drafts"], "opp_id", "title", A.OPPORTUNITY_ENUMS, "me", TODAY, ("priority", 1, 5))


_JUDGED = """, judged AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN 'titleRequired' WHEN type NOT IN ('ma', 'greenfield', 'project_support') THEN 'badBizLine'
  WHEN stage NOT IN ('contact', 'intent', 'dd', 'audit', 'closing') THEN 'badStage' WHEN NOT priority BETWEEN 1 AND 5 THEN 'bad_priority' END AS problem FROM drafts)"""
checked("created", "opportunity drafts", f"""{_JUDGED}, good AS (SELECT * FROM judged WHERE problem IS NULL)
SELECT title, type, stage, priority, TODAY AS updated_at FROM good, (SELECT '{TODAY}' AS TODAY) UNION ALL SELECT title, type, stage, priority, updated_at FROM opportunity""")(lambda t: _created(t)[0].select("title", "type", "stage", "priority", "updated_at"))
checked("created_ids", "opportunity drafts", f"""{_JUDGED}, n AS (SELECT count(*) AS n FROM judged WHERE problem IS NULL), o AS (SELECT count(*) AS rows, max(opp_id) AS top FROM opportunity)
SELECT rows + n AS rows, rows + n AS ids, top + n AS last FROM n, o""")(lambda t: _created(t)[0].selectExpr("count(*) AS rows", "count(DISTINCT opp_id) AS ids", "max(opp_id) AS last"))
checked("created_rejected", "drafts", f"{_JUDGED} SELECT draft, problem FROM judged WHERE problem IS NOT NULL")(lambda t: _created(t)[1])


def _archived(t: Derived) -> tuple[DataFrame, DataFrame]:
    return A.archived(t["opportunity"], t["drafts"].selectExpr("draft * 4 AS opp_id"), "opp_id", "now")


checked("archived", "opportunity drafts", """SELECT opp_id, CASE WHEN k.id IS NOT NULL THEN 1 ELSE is_archived END::INT AS is_archived, CASE WHEN k.id IS NOT NULL AND is_archived = 0 THEN 'now' ELSE updated_at END AS updated_at
  FROM opportunity LEFT JOIN (SELECT DISTINCT draft * 4 AS id FROM drafts) k ON k.id = opp_id""")(lambda t: _archived(t)[0].select("opp_id", "is_archived", "updated_at"))
checked("archived_now", "opportunity drafts", "SELECT opp_id FROM opportunity WHERE is_archived = 0 AND opp_id IN (SELECT draft * 4 FROM drafts)")(lambda t: _archived(t)[1])
checked("resources_indexed", "resource scanned", """SELECT coalesce(r.file_path, s.file_path) AS file_path, coalesce(r.kind, s.kind) AS kind, coalesce(r.title, s.title) AS title, coalesce(s.size_bytes, r.size_bytes) AS size_bytes,
  coalesce(r.company_id, s.company_id) AS company_id FROM resource r FULL JOIN scanned s ON s.file_path = r.file_path""")(lambda t: A.indexed_resources(t["resource"], t["scanned"]).select("file_path", "kind", "title", "size_bytes", "company_id"))
checked("reports_backfilled", "filed found", """SELECT coalesce(f.report_file, r.report_file) AS report_file, coalesce(f.report_type, r.report_type) AS report_type, coalesce(f.report_md, r.report_md) AS report_md, coalesce(f.title, r.title) AS title,
  CASE WHEN f.report_file IS NULL THEN r.status ELSE 'published' END AS status, coalesce(f.made_at, r.updated_at) AS updated_at FROM filed r FULL JOIN found f ON f.report_file = r.report_file""")(
    lambda t: A.backfilled_reports(t["filed"], t["resource"], t["found"], "backfill")[0].select("report_file", "report_type", "report_md", "title", "status", "updated_at"))
checked("reports_linked", "filed found resource", """SELECT resource_id, f.report_file IS NOT NULL AS has_report, r.id AS known_id FROM resource s LEFT JOIN found f ON f.report_file = s.file_path LEFT JOIN filed r ON r.report_file = f.report_file""")(
    lambda t: (lambda linked, old: linked.join(old, linked["report_id"] == old["known_id"], "left").selectExpr("resource_id", "report_id IS NOT NULL AS has_report", "known_id"))(
        A.backfilled_reports(t["filed"], t["resource"], t["found"], "backfill")[1], t["filed"].selectExpr("id AS known_id")))
checked("canonical_values", "exhibition_brand", "SELECT brand_id, CASE WHEN industry_l1 IN ('BUILDING', 'FURNITURE') THEN 'HOUSE' WHEN industry_l1 = 'MACHINERY' THEN 'TOOLS' ELSE industry_l1 END AS industry_l1 FROM exhibition_brand")(
    lambda t: A.canonical_values(t["exhibition_brand"], "industry_l1", {"HOUSE": ["BUILDING", "FURNITURE"], "TOOLS": ["MACHINERY"]}).select("brand_id", "industry_l1"))


def _cleared(t: Derived) -> tuple[DataFrame, DataFrame]:
    history = t.spark.createDataFrame([], "brand_id string, field_name string, old_value string, new_value string, changed_by string, reason string, change_source string")
    return A.cleared(t["exhibition_brand"], history, "organizer", "Org 7", "script/clear", "test value")


checked("cleared", "exhibition_brand", "SELECT brand_id, CASE WHEN organizer = 'Org 7' THEN '' ELSE organizer END AS organizer FROM exhibition_brand")(lambda t: _cleared(t)[0].select("brand_id", "organizer"))
checked("cleared_audit", "exhibition_brand", "SELECT brand_id, 'organizer' AS field_name, organizer AS old_value, '' AS new_value, 'script' AS change_source FROM exhibition_brand WHERE organizer = 'Org 7'")(
    lambda t: _cleared(t)[1].select("brand_id", "field_name", "old_value", "new_value", "change_source"))

# reports
checked("search_exhibition", "exhibition_brand", """SELECT brand_id, name_cn, scale_score FROM exhibition_brand WHERE name_cn ILIKE '%0001%' OR name_en ILIKE '%0001%'
  ORDER BY CASE WHEN name_cn = '0001' THEN 0 ELSE 1 END, scale_score DESC NULLS LAST, brand_id LIMIT 20""")(lambda t: A.search_exhibition(t, "0001").select("brand_id", "name_cn", "scale_score"))
_FOUND = ", hits AS (SELECT * FROM exhibition_brand WHERE industry_l1 ILIKE '%ur%' OR industry_l2 ILIKE '%ur%' OR name_cn ILIKE '%ur%' ORDER BY scale_score DESC NULLS LAST, industry_l1 NULLS FIRST, brand_id LIMIT 50)"
checked("search_industry", "exhibition_brand", f"{_FOUND} SELECT brand_id, industry_l1, scale_score FROM hits")(lambda t: A.search_industry(t, "ur").select("brand_id", "industry_l1", "scale_score"))
checked("industries", "exhibition_brand", """SELECT industry_l1, count(*) AS brands, count(*) FILTER (competition_relation = 'own') AS competitors, count(*) FILTER (is_international = 1) AS related FROM exhibition_brand
  WHERE industry_l1 <> '' GROUP BY 1""")(lambda t: A.list_industries(t, "own", "is_international"))
checked("industry_groups", "exhibition_brand", f"{_FOUND} SELECT coalesce(nullif(industry_l1, ''), '未分类') AS industry_l1, count(*) AS total, count(*) FILTER (competition_relation = 'own') AS competitors FROM hits GROUP BY 1")(
    lambda t: A.industry_report(t, "ur", competing="own")["groups"])
checked("industry_totals", _BE, f"""{_FOUND} SELECT count(*) AS with_editions, coalesce(sum(area_sqm), 0)::BIGINT AS area_sqm, coalesce(sum(exhibitors_count), 0)::BIGINT AS exhibitors_count, coalesce(sum(visitors_count), 0)::BIGINT AS visitors_count
  FROM latest WHERE edition_id IS NOT NULL AND brand_id IN (SELECT brand_id FROM hits)""", True)(lambda t: A.industry_report(t, "ur")["totals"])
checked("organizer_area", "brand_organizer exhibition_edition", """SELECT canonical, sum(area_sqm) / 10000.0 AS area, count(*) AS fairs FROM brand_organizer o JOIN exhibition_edition e ON e.brand_id = o.brand_id AND e.year = 1996
  WHERE org_type = '企业' AND area_sqm > 0 GROUP BY 1 ORDER BY sum(area_sqm) DESC, canonical LIMIT 20""")(lambda t: A.organizer_area(t, 1996))
checked("knowledge_page", "intel_report", "SELECT id, 'active' AS status FROM intel_report WHERE status = 'published'")(lambda t: A.knowledge_page(t["intel_report"].replace({"published": "active", "draft": "archived"}, subset=["status"]))[0].select("id", "status"))
checked("knowledge_archived", "intel_report", "SELECT count(*) FILTER (status = 'draft') AS archived FROM intel_report")(lambda t: A.knowledge_page(t["intel_report"].replace({"published": "active", "draft": "archived"}, subset=["status"]))[1])
checked("prospects_export", "company", "SELECT company_id, name FROM company WHERE brand_id = 'B6'")(lambda t: A.export_prospects(t, "B6").select("company_id", "name"))
checked("edition_spread", "exhibition_edition", "SELECT count(*) FILTER (n > 1) AS with_several, max(n) AS most FROM (SELECT count(*) AS n FROM exhibition_edition GROUP BY brand_id)")(lambda t: A.edition_spread(t))
checked("last_options", "exhibition_brand", "SELECT city, max(brand_id) AS brand_id FROM exhibition_brand GROUP BY city")(lambda t: A.last_options(t["exhibition_brand"], "city", "brand_id").select("city", "brand_id"))
checked("participation_kinds", "exhibition_brand", """SELECT count(*) AS "all", count(*) FILTER (is_international = 1) AS international, count(*) FILTER (is_international = 0) AS domestic, count(*) FILTER (lower(name_cn) LIKE '%11%' OR lower(name_cn) LIKE '%#2%') AS among FROM exhibition_brand""")(
    lambda t: A.participation_kinds(t["exhibition_brand"].selectExpr("name_cn AS name", "if(is_international = 1, 'international', 'domestic') AS kind"), ("11", "#2")))
