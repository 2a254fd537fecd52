"""Creating, deleting and backfilling rows, snapshot in and snapshot out, and the reports over hits of a search."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.functions import text as X
from fairloom.operators import relational as R
from fairloom.plans.batch import numbered_rows
from fairloom.plans.workbench import Tables, latest_editions
from fairloom.schema import DOMAINS

RELEVANCE = "scale_score"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# Rows created, deleted and put right


def created(rows: DataFrame, drafts: DataFrame, key: str, required: str, enums: Mapping[str, tuple[str, list[str]]], by: str, now: str, between: tuple[str, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with the valid drafts, numbered after the largest key, and the rejected drafts with their code (problem).

    drafts: draft (their own number) and columns of rows. The first rule that fails gives the code: required is blank,
    then a column of enums (column: code, values) holds another value (null is allowed but in NOT NULL columns, which are
    filled beforehand), then between's column lies outside its bounds.
    """
    rules = [F.when(_blank(required), f"{required}Required")]
    rules += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), code) for c, (code, values) in enums.items()]
    if between:
        column, low, high = between
        rules.append(F.when(~F.col(column).between(low, high), f"bad_{column}"))
    judged = drafts.withColumn("problem", F.coalesce(*rules, F.lit(None).cast("string")))
    top = F.broadcast(rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("top_")))  # one row
    good = numbered_rows(judged.where("problem is null"), "draft").crossJoin(top).withColumn(key, F.col("top_") + F.col("n"))
    stamps = {"created_by": F.lit(by), "created_at": F.lit(now), "updated_at": F.lit(now)}
    new = good.select(*[(stamps[c] if c in stamps else F.col(c) if c in good.columns else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(new), judged.where("problem is not null").select("draft", "problem")


OPPORTUNITY_ENUMS = {"type": ("badBizLine", DOMAINS["opportunity"]["type"]), "stage": ("badStage", DOMAINS["opportunity"]["stage"])}


def archived(rows: DataFrame, keys: DataFrame, key: str, now: str) -> tuple[DataFrame, DataFrame]:
    """rows after a soft delete of keys, and the keys that were really archived now: those that are gone or unknown
    change nothing."""
    hit = keys.select(F.col(key).alias("hit_")).distinct()
    joined = rows.join(hit, F.col(key) == F.col("hit_"), "left")
    now_gone = F.col("hit_").isNotNull() & (F.col("is_archived") == 0)
    after = joined.withColumn("updated_at", F.when(now_gone, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("is_archived", F.when(now_gone, F.lit(1)).otherwise(F.col("is_archived")).cast(rows.schema["is_archived"].dataType))
    return after.select(rows.columns), joined.where(now_gone).select(key)


def indexed_resources(resources: DataFrame, scanned: DataFrame, key: str = "file_path", refreshed: tuple[str, ...] = ("size_bytes", "sha256", "mime"), kept: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """Resources after a scan of the file tree: by path, refreshed columns are the scan's even if null, kept ones stay
    where they are filled, all others stay; new paths are added. scanned has one row for each path."""
    o, n = resources.alias("o"), scanned.alias("n")
    old, new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def column(c: str) -> Column:
        if c not in scanned.columns:
            return F.col(f"o.{c}")
        if c in refreshed:
            return F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c in kept or c == key:
            return F.coalesce(f"o.{c}", f"n.{c}")
        return F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[column(c).alias(c) for c in resources.columns])


def backfilled_reports(reports: DataFrame, resources: DataFrame, found: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Reports after report files were read, and resources with the report of their file (report_id).

    found: report_file, report_type, report_md, title, company_id, made_at; one row for each file. A known file's report
    is overwritten and published, a new one is numbered after the largest id.
    """
    top = F.broadcast(reports.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_")))  # one row
    known = R.latest_per_key(reports.where("report_file is not null").select("report_file", F.col("id").alias("known_id")), ["report_file"], [F.col("known_id")])
    met = found.join(known, "report_file", "left")
    fresh = numbered_rows(met.where("known_id is null"), "report_file").crossJoin(top).withColumn("id", F.col("top_") + F.col("n"))
    rows = met.where("known_id is not null").withColumn("id", F.col("known_id")).select(*found.columns, "id").unionByName(fresh.select(*found.columns, "id"))
    values = {c: F.col(f"n.{c}") for c in ("report_type", "report_md", "report_file", "company_id", "title")}
    values |= {"status": F.lit("published"), "created_by": F.lit(by), "created_at": F.col("n.made_at"), "updated_at": F.col("n.made_at")}
    o, n = reports.alias("o"), rows.alias("n")
    joined = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    here = F.col("n.id").isNotNull()
    after = joined.select(F.coalesce("o.id", "n.id").alias("id"), *[(F.when(here, values[c]).otherwise(F.col(f"o.{c}")) if c in values else F.col(f"o.{c}")).cast(reports.schema[c].dataType).alias(c) for c in reports.columns if c != "id"])
    links = rows.select(F.col("report_file").alias("file_"), F.col("id").alias("new_id_"))
    base = resources if "report_id" in resources.columns else resources.withColumn("report_id", F.lit(None).cast("long"))
    linked = base.join(links, F.col("file_path") == F.col("file_"), "left").withColumn("report_id", F.coalesce("new_id_", "report_id"))
    return after, linked.select(base.columns)


def canonical_values(rows: DataFrame, column: str, spellings: Mapping[str, list[str]]) -> DataFrame:
    """column with each of a value's other spellings replaced by it."""
    out = F.col(column)
    for value, others in spellings.items():
        out = F.when(F.col(column).isin(others), value).otherwise(out)
    return rows.withColumn(column, out)


def cleared(brands: DataFrame, history: DataFrame, column: str, value: str, by: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """brands with a dirty value of a column emptied, and history with a row for each of them."""
    dirty = brands.where(F.col(column) == value)
    facts = {"brand_id": F.col("brand_id"), "field_name": F.lit(column), "old_value": F.col(column), "new_value": F.lit(""), "changed_by": F.lit(by), "reason": F.lit(reason), "change_source": F.lit("script")}
    rows = dirty.select(*[facts.get(c, F.lit(None)).cast(history.schema[c].dataType).alias(c) for c in history.columns])
    return brands.withColumn(column, F.when(F.col(column) == value, "").otherwise(F.col(column))), history.unionByName(rows)


# Reports


def search_exhibition(t: Tables, name: str, most: int = 20) -> DataFrame:
    """Brands by name, equal ones first, then the most relevant."""
    hits = R.search(t["exhibition_brand"], ["name_cn", "name_en"], name)
    return hits.orderBy(F.when(F.col("name_cn") == name, 0).otherwise(1), F.col(RELEVANCE).desc_nulls_last(), "brand_id").limit(most)


def search_industry(t: Tables, word: str, most: int = 50) -> DataFrame:
    hits = R.search(t["exhibition_brand"], ["industry_l1", "industry_l2", "name_cn"], word)
    return hits.orderBy(F.col(RELEVANCE).desc_nulls_last(), F.col("industry_l1").asc_nulls_first(), "brand_id").limit(most)


def list_industries(t: Tables, competing: str = "是", related: str | None = None) -> DataFrame:
    """industry_l1, brands, competitors (and related, by a 0/1 column) of every named class, largest first."""
    counts = [F.count("*").alias("brands"), F.count_if(F.col("competition_relation") == competing).alias("competitors")]
    if related:
        counts.append(F.count_if(F.col(related) == 1).alias("related"))
    return t["exhibition_brand"].where("industry_l1 is not null and industry_l1 <> ''").groupBy("industry_l1").agg(*counts).orderBy(F.desc("brands"), "industry_l1")


def industry_report(t: Tables, word: str, most: int = 50, competing: str = "是") -> dict[str, DataFrame]:
    """groups (hits and competitors by class, largest first) and totals over each hit's latest edition."""
    hits = search_industry(t, word, most)
    group = F.coalesce(X.blank_to_null(F.col("industry_l1")), F.lit("未分类")).alias("industry_l1")
    of = hits.select(F.col("brand_id").alias("hit_"))  # at most most rows
    newest = latest_editions(t).join(F.broadcast(of), F.col("brand_id") == F.col("hit_"), "left_semi").where("edition_id is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return {
        "groups": hits.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col("competition_relation") == competing).alias("competitors")).orderBy(F.desc("total"), "industry_l1"),
        "totals": newest.agg(F.count("*").alias("with_editions"), total("area_sqm"), total("exhibitors_count"), total("visitors_count")),
    }


def organizer_area(t: Tables, year: int, org_type: str = "企业", most: int = 20) -> DataFrame:
    """Organizers by the area of a year's editions, in units of 10,000; each organizer of a fair gets all of it."""
    rows = t["brand_organizer"].where(F.col("org_type") == org_type).join(t["exhibition_edition"].where((F.col("year") == year) & (F.col("area_sqm") > 0)).select("brand_id", "area_sqm"), "brand_id")
    out = rows.groupBy("canonical").agg(F.sum("area_sqm").alias("sum_"), F.count("*").alias("fairs"))
    return out.orderBy(F.desc("sum_"), "canonical").limit(most).select("canonical", (F.col("sum_") / 10000.0).alias("area"), "fairs")


def knowledge_page(items: DataFrame, show_archived: bool = False) -> tuple[DataFrame, DataFrame]:
    """The items of the page, and how many are archived."""
    return items if show_archived else items.where("status = 'active'"), items.agg(F.count_if(F.col("status") == "archived").alias("archived"))


def export_prospects(t: Tables, brand_id: str | None = None, report_id: int | None = None) -> DataFrame:
    """Companies of a brand, else of a report, else all."""
    rows = t["company"]
    if brand_id:
        rows = rows.where(F.col("brand_id") == brand_id)
    elif report_id is not None:
        rows = rows.where(F.col("intel_report_id") == report_id)
    return rows.orderBy("company_id")


def edition_spread(t: Tables) -> DataFrame:
    """How many brands have more than one edition, and the most that one has."""
    counts = t["exhibition_edition"].groupBy("brand_id").agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("with_several"), F.max("n").alias("most"))


def participation_kinds(rows: DataFrame, words: tuple[str, ...], name: str = "name", place: str = "kind") -> DataFrame:
    """Participations of all, abroad, at home, and those whose fair's name holds one of the words."""
    among = F.lit(False)
    for w in words:
        among = among | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(w.lower()))
    return rows.agg(F.count("*").alias("all"), F.count_if(F.col(place) == "international").alias("international"), F.count_if(F.col(place) == "domestic").alias("domestic"), F.count_if(among).alias("among"))


def last_options(options: DataFrame, slug: str, place: str) -> DataFrame:
    """Of the options with one slug the last."""
    return R.latest_per_key(options, [slug], [F.desc(place)])


def in_layers(pairs: DataFrame) -> DataFrame:
    """Review pairs by layer, the most similar first."""
    return pairs.orderBy("layer", F.desc("sim"), "keep", "merge")
