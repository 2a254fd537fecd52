"""Tables as StructTypes, and the constraints a database would enforce as checks that return violations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The tables' columns and the domains of their coded columns.
TABLES = {
    "exhibition_brand": "brand_id string, name_cn string, name_en string, organizer string, co_organizer string, city string, country_cn string, frequency string, first_year int, industry_l1 string, industry_l2 string, industry_raw string, scale_score int, is_international int, is_ufi_certified int, competition_relation string, mds_related string, competitor_group string, ma_potential int, strategic_relevance int, website string, notes string, display_ready int, company_id long, created_at string, updated_at string",
    "exhibition_edition": "edition_id string, brand_id string, edition_num int, year int, date_start string, date_end string, city string, venue string, area_sqm long, exhibitors_count long, visitors_count long, status string, yoy_trend string, heat_score int, anomaly_flag int, data_source string, recorded_at string, notes string",
    "data_provenance": "record_id string, brand_id string, source_site string, source_url string, raw_payload string, crawled_at string, crawl_batch_id string, notes string",
    "crawl_log": "id long, batch_id string, source_site string, started_at string, finished_at string, status string, total_found long, total_new long, total_updated long, error_message string",
    "user": "user_id long, email string, role string, is_active int, last_login string, dashboard_prefs string",
    "manual_tag_history": "id long, brand_id string, field_name string, old_value string, new_value string, changed_by string, changed_at string, reason string, change_source string",
    "brand_organizer": "brand_id string, seq int, raw_token string, canonical string, org_type string, confidence string, built_at string",
    "brand_geo_tag": "brand_id string, lon double, lat double, tag string",
    "company": "company_id long, brand_id string, intel_report_id long, source_type string, qcc_key_no string, name string, name_en string, type string, city string, country string, credit_code string, oper_name string, start_date string, company_status string, reg_no string, address string, email string, prospect_score int, contact_status string, notes string, created_at string, updated_at string",
    "intel_report": "id long, report_type string, brand_id string, industry_l1 string, industry_l2 string, target_company string, params_json string, report_md string, report_file string, status string, opp_id long, company_id long, title string, created_by string, created_at string, updated_at string",
    "opportunity": "opp_id long, type string, title string, title_en string, stage string, deal_type string, company_id long, brand_id string, md_brand string, priority int, owner string, next_action string, next_action_due string, detail_json string, is_archived int, created_by string, created_at string, updated_at string",
    "opportunity_event": "event_id long, opp_id long, event_type string, content string, file_path string, occurred_at string, created_by string, created_at string",
    "resource": "resource_id long, kind string, title string, file_path string, mime string, size_bytes long, sha256 string, opp_id long, company_id long, brand_id string, report_id long, industry_l1 string, source string, collected_at string, created_by string, created_at string",
    "editions": "edition_id string, show_name string, edition_year int, oid string, city string, date_start date, date_end date, is_anchor int, notes string, scraped_at timestamp",
    "participations": "part_id long, edition_id string, vis_hash string, raw_name string, raw_country string, country_code string, hall string, booth_number string, booth_full string, product_categories string, participation_type string, profile_url string, scraped_at timestamp",
}
DOMAINS = {
    "exhibition_brand": {"competition_relation": ["是", "否", ""]},
    "exhibition_edition": {"status": ["已举办", "即将举办", "取消", "延期", ""], "yoy_trend": ["上升", "平稳", "下降", ""]},
    "crawl_log": {"status": ["running", "success", "failed", "partial"]},
    "user": {"role": ["admin", "manager", "readonly"]},
    "manual_tag_history": {"change_source": ["manual", "script", "merge"]},
    "brand_organizer": {"org_type": ["企业", "协会", "政府", "组委会", "其他"], "confidence": ["high", "check", "auto"]},
    "company": {"source_type": ["qcc_search", "manual", "db_match"]},
    "intel_report": {"status": ["draft", "published", "archived"]},
    "opportunity": {"type": ["ma", "greenfield", "project_support"], "stage": ["contact", "intent", "dd", "audit", "closing"]},
    "opportunity_event": {"event_type": ["note", "stage_change", "file", "meeting", "task_done"]},
    "resource": {"kind": ["report", "raw", "export", "roster", "note"]},
}
RANGES = {
    "exhibition_brand": {"scale_score": (1, 10), "ma_potential": (1, 5), "strategic_relevance": (1, 5)},
    "exhibition_edition": {"heat_score": (1, 5)},
    "company": {"prospect_score": (1, 5)},
    "opportunity": {"priority": (1, 5)},
}
REQUIRED = {"exhibition_brand": ["name_cn"], "company": ["name"], "resource": ["file_path"], "opportunity": ["title"]}
UNIQUE = {
    "exhibition_brand": [(["brand_id"], None)], "exhibition_edition": [(["edition_id"], None)], "data_provenance": [(["brand_id", "source_url"], None)],
    "crawl_log": [(["batch_id"], None)], "user": [(["email"], None)], "brand_organizer": [(["brand_id", "seq"], None)],
    "company": [(["brand_id", "qcc_key_no"], "qcc_key_no is not null")], "resource": [(["file_path"], None)],
}


def struct(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], struct(name))


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Callable[[DataFrame], DataFrame]


def check(name: str, condition: str) -> Rule:
    """Rows for which the condition is false; unknown passes."""
    return Rule(name, lambda df: df.where(~F.expr(condition)))


def inside(column: str, values: Sequence[object]) -> Rule:
    return Rule(column, lambda df: df.where(~F.col(column).isin(*values)))


def between(column: str, low: int, high: int) -> Rule:
    return Rule(column, lambda df: df.where(~F.col(column).between(low, high)))


def required(column: str) -> Rule:
    return Rule(f"{column} required", lambda df: df.where(F.col(column).isNull()))


def unique(columns: Sequence[str], where: str | None = None) -> Rule:
    """All rows of a key that occurs more than once; keys with a null are never equal."""

    def broken(df: DataFrame) -> DataFrame:
        some = df.where(where) if where else df
        for c in columns:
            some = some.where(F.col(c).isNotNull())
        return some.join(some.groupBy(*columns).count().where("count > 1").drop("count"), list(columns), "left_semi")

    return Rule(f"unique {', '.join(columns)}", broken)


def refers(column: str, name: str, parent: DataFrame, key: str) -> Rule:
    return Rule(f"{column}->{name}", lambda df: df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("parent_")).distinct(), F.col(column) == F.col("parent_"), "left_anti"))


def table_rules(name: str) -> list[Rule]:
    out = [required(c) for c in REQUIRED.get(name, [])]
    out += [inside(c, v) for c, v in DOMAINS.get(name, {}).items()]
    out += [between(c, *v) for c, v in RANGES.get(name, {}).items()]
    return out + [unique(*u) for u in UNIQUE.get(name, [])]


def violations(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """key, rule for every row that breaks a rule."""
    out = None
    for r in rules:
        found = r.broken(df).select(F.col(key), F.lit(r.name).alias("rule"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.select(key, F.lit("").alias("rule")).limit(0)


def cascade(children: DataFrame, column: str, parents: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children after parents were deleted: gone with them, or without their reference."""
    there = parents.select(F.col(key).alias("parent_")).distinct()
    if not set_null:
        return children.where(F.col(column).isNull()).unionByName(children.join(there, F.col(column) == F.col("parent_"), "left_semi"))
    return children.join(there, F.col(column) == F.col("parent_"), "left").withColumn(column, F.col("parent_")).drop("parent_")
