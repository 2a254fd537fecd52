"""The workbench's read queries over its own tables (schema.py): lists, details, dashboards, exhibitor analytics.

Tables come as a dict of DataFrames by name. Everything that depends on time takes the day as an argument.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.functions import text as X
from fairloom.operators import relational as R
from fairloom.operators.containment import containing
from fairloom.schema import DOMAINS

Tables = Mapping[str, DataFrame]

#: For each list: table, key, columns shown, filters, searched columns, sortable columns, default order.
LISTS = {
    "company": ("company", "company_id", ["company_id", "name", "city", "country", "source_type", "contact_status", "prospect_score", "updated_at"], ["city", "country", "source_type", "contact_status", "brand_id"], ["name", "name_en"], ["name", "prospect_score", "updated_at", "created_at"], "updated_at"),
    "opportunity": ("opportunity", "opp_id", ["opp_id", "title", "type", "stage", "deal_type", "priority", "owner", "next_action", "next_action_due", "updated_at"], ["type", "stage", "deal_type", "owner", "company_id", "brand_id"], ["title", "title_en"], ["title", "priority", "next_action_due", "updated_at"], "updated_at"),
    "research": ("intel_report", "id", ["id", "title", "report_type", "status", "industry_l1", "updated_at", "excerpt", "company_name"], ["report_type", "status", "industry_l1", "brand_id", "company_id"], ["title", "target_company"], ["title", "updated_at", "created_at"], "updated_at"),
    "resource": ("resource", "resource_id", ["resource_id", "kind", "title", "file_path", "size_bytes", "source", "created_at"], ["kind", "source", "industry_l1", "opp_id", "company_id", "brand_id"], ["title", "file_path"], ["title", "size_bytes", "created_at"], "created_at"),
    "expo": ("exhibition_brand", "brand_id", ["brand_id", "name_cn", "name_en", "city", "industry_l1", "industry_l2", "year", "area_sqm", "exhibitors_count", "visitors_count"], ["city", "industry_l1", "industry_l2", "country_cn"], ["name_cn", "name_en"], ["name_cn", "area_sqm", "year", "exhibitors_count", "visitors_count"], "area_sqm"),
}


def latest_editions(t: Tables) -> DataFrame:
    """Brands with their latest edition, one row for each brand: the greatest year, then the greatest edition id."""
    editions = t["exhibition_edition"].select("edition_id", "brand_id", "year", "date_start", "date_end", "venue", "area_sqm", "exhibitors_count", "visitors_count", "status")
    brands = t["exhibition_brand"]
    order = [F.col("year").desc_nulls_last(), F.col("edition_id").desc()]
    best = R.latest_per_key(editions, ["brand_id"], order).withColumnRenamed("brand_id", "e_brand")
    return brands.join(best, brands["brand_id"] == best["e_brand"], "left").drop("e_brand")


def list_rows(t: Tables, name: str, wanted: Mapping[str, object] | None = None, q: str | None = None) -> DataFrame:
    """All rows of a list that pass the filters and the search."""
    table, _, shown, filters, searched, _, _ = LISTS[name]
    rows = t[table]
    if name == "opportunity":
        rows = rows.where("is_archived = 0")
    if name == "expo":
        rows = latest_editions(t).where("display_ready = 1")
    if name == "research":
        companies = t["company"].select(F.col("company_id").alias("c_id"), F.col("name").alias("c_name"))
        rows = rows.join(companies, rows["company_id"] == companies["c_id"], "left")
        rows = rows.withColumns({"excerpt": X.excerpt(F.col("report_md")), "company_name": F.coalesce("c_name", "target_company")})
    rows = R.search(R.equal_filters(rows, {f: f for f in filters}, dict(wanted or {})), searched, q)
    return rows.select(shown)


def list_page(t: Tables, name: str, wanted: Mapping[str, object] | None = None, q: str | None = None, sort: str | None = None, order: str | None = None, page: object = 1, size: object = 50) -> tuple[DataFrame, DataFrame]:
    """(one page, total): the page in a total order, and a one-row frame with the number of all rows."""
    _, key, _, _, _, sortable, default = LISTS[name]
    rows = list_rows(t, name, wanted, q)
    return R.list_page(rows, {s: s for s in sortable}, sort, order, key, default, page, size), rows.agg(F.count("*").alias("total"))


def detail(t: Tables, name: str, value: object) -> DataFrame:
    table, key = LISTS[name][:2]
    rows = latest_editions(t) if name == "expo" else t[table]
    return rows.where(F.col(key) == F.lit(value))


def expo_stats(t: Tables, industries: tuple[str, ...] = (), cities: tuple[str, ...] = (), bucket: str | None = None, places: DataFrame | None = None) -> dict[str, DataFrame]:
    """points, totals, scale and industry over the ready brands that pass the filters. places: country, city, lon, lat;
    the point without a coordinate counts what could not be located."""
    pool = R.in_list(R.in_list(latest_editions(t).where("display_ready = 1"), "industry_l1", industries), "city", cities)
    for key, low, high in X.SCALE_BUCKETS:
        if key == bucket:
            pool = pool.where((F.col("area_sqm") >= low) & (F.lit(True) if high is None else F.col("area_sqm") < high))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    counted = pool.groupBy(F.coalesce("country_cn", F.lit("")).alias("country"), F.coalesce("city", F.lit("")).alias("city")).agg(F.count("*").alias("n"))
    out = {
        "totals": pool.agg(F.count("*").alias("brands"), total("area_sqm"), total("exhibitors_count"), total("visitors_count")),
        "scale": R.zero_fill([k for k, _, _ in X.SCALE_BUCKETS], pool.groupBy(X.scale_bucket(F.col("area_sqm")).alias("bucket")).agg(F.count("*").alias("n")), "bucket", ["n"]),
        "industry": pool.where("industry_l1 is not null and industry_l1 <> ''").groupBy("industry_l1").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "industry_l1"),
    }
    if places is not None:
        out["points"] = counted.join(places, ["country", "city"], "left").groupBy("lon", "lat").agg(F.sum("n").alias("n"))
    return out


def calendar(t: Tables, month: str, today: str) -> DataFrame:
    """Meetings and due actions of a month by day: day, kind, opp_id, title, text, time, overdue, place (order in a day)."""
    live = t["opportunity"].where("is_archived = 0")
    events = t["opportunity_event"].where((F.col("event_type") == "meeting") & (F.col("occurred_at") != "") & (F.substring("occurred_at", 1, 7) == month))
    meetings = events.join(live.select("opp_id", "title"), "opp_id").select(
        F.substring("occurred_at", 1, 10).alias("day"), F.lit("meeting").alias("kind"), "opp_id", "title", F.coalesce("content", F.lit("")).alias("text"),
        X.calendar_time(F.col("occurred_at")).alias("time"), F.lit(False).alias("overdue"), F.struct(F.lit(0).alias("k"), F.col("occurred_at").alias("at"), F.col("event_id").alias("id")).alias("o"),
    )
    due = live.where((F.col("next_action_due") != "") & (F.substring("next_action_due", 1, 7) == month))
    day = F.substring("next_action_due", 1, 10)
    actions = due.select(
        day.alias("day"), F.lit("next_action").alias("kind"), "opp_id", "title", F.coalesce("next_action", F.lit("")).alias("text"), F.lit(None).cast("string").alias("time"),
        (day < today).alias("overdue"), F.struct(F.lit(1).alias("k"), F.col("next_action_due").alias("at"), F.col("opp_id").alias("id")).alias("o"),
    )
    return meetings.unionByName(actions).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("o"))).drop("o")


def overview(t: Tables, today: str) -> dict[str, DataFrame]:
    """kpi, tasks, reports, funnel, resources of the start page."""
    live = t["opportunity"].where("is_archived = 0")
    day = F.substring("next_action_due", 1, 10)
    week_end = X.end_of_week(F.to_date(F.lit(today))).cast("string")
    has_due = F.coalesce(F.col("next_action_due") != "", F.lit(False))
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    names = t["company"].select("company_id", F.col("name").alias("company_name"))
    return {
        "kpi": live.agg(F.count("*").alias("opportunities"), n(has_due & (day < today), "overdue"), n(has_due & (day >= today) & (day <= week_end), "this_week")).withColumn("week_end", week_end),
        "tasks": live.where(has_due).orderBy("next_action_due", "opp_id").limit(10).select("opp_id", "title", "stage", "owner", "next_action", "next_action_due"),
        "reports": t["intel_report"].join(names, "company_id", "left").orderBy(F.col("updated_at").desc_nulls_last(), F.desc("id")).limit(5).select("id", "title", "report_type", "status", "updated_at", "company_name", X.excerpt(F.col("report_md")).alias("excerpt")),
        "funnel": R.zero_fill(DOMAINS["opportunity"]["stage"], live.groupBy("stage").agg(F.count("*").alias("n")), "stage", ["n"]),
        "resources": t["resource"].rollup("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")),
    }


def landing(t: Tables, year: int, highlight: str = "") -> dict[str, DataFrame]:
    """coverage, organizers, cities, schedule and without (brands with no edition from year on)."""
    ready = t["exhibition_brand"].where("display_ready = 1")
    newest = latest_editions(t).where("display_ready = 1")
    organizers = t["brand_organizer"].where("org_type = '企业'").join(ready.select("brand_id"), "brand_id", "left_semi")
    coverage = ready.agg(F.count("*").alias("brands"), F.count_distinct("city").alias("cities"), F.count_distinct("country_cn").alias("countries"))
    for name in ("exhibition_edition", "company", "intel_report", "resource"):
        coverage = coverage.crossJoin(F.broadcast(t[name].agg(F.count("*").alias(f"n_{name}"))))
    starts = t["exhibition_edition"].join(ready.select("brand_id"), "brand_id", "left_semi").where(F.col("date_start").startswith(f"{year}-"))
    months = R.zero_fill(list(range(1, 13)), starts.groupBy(F.substring("date_start", 6, 2).try_cast("int").alias("month")).agg(F.count("*").alias("n")), "month", ["n"])
    peak = F.broadcast(months.agg(F.max("n").alias("top")))
    later = t["exhibition_edition"].where(F.col("year") >= year).select("brand_id")
    return {
        "coverage": coverage,
        "organizers": organizers.groupBy("canonical").agg(F.count_distinct("brand_id").alias("brands")).withColumn("highlight", F.lit(bool(highlight)) & F.col("canonical").contains(highlight)).orderBy(F.desc("brands"), "canonical").limit(6),
        "cities": newest.where("city is not null and city <> ''").groupBy("city").agg(F.count("*").alias("n"), F.coalesce(F.sum("area_sqm"), F.lit(0)).alias("area")).orderBy(F.desc("n"), "city").limit(6),
        "schedule": months.crossJoin(peak).select("month", "n", ((F.col("n") > 0) & (F.col("n") == F.col("top"))).alias("is_peak")),
        "without": ready.join(later, "brand_id", "left_anti").agg(F.count("*").alias("n")),
    }


def opportunity_detail(t: Tables, opp_id: int) -> dict[str, DataFrame]:
    """opportunity, company, brand, reports, events, resources of one opportunity; reports and resources are its own or
    its company's."""
    one = t["opportunity"].where(F.col("opp_id") == opp_id).withColumn("detail_json", X.tolerant_json(F.col("detail_json")))
    owner = F.broadcast(one.select(F.col("company_id").alias("own_company")))
    mine = lambda df: df.crossJoin(owner).where((F.col("opp_id") == opp_id) | (F.col("company_id").isNotNull() & (F.col("company_id") == F.col("own_company")))).drop("own_company")
    happened = F.coalesce(X.blank_to_null(F.col("occurred_at")), F.col("created_at"))
    return {
        "opportunity": one,
        "company": t["company"].join(owner, F.col("company_id") == F.col("own_company"), "left_semi"),
        "brand": latest_editions(t).join(F.broadcast(one.select("brand_id")), "brand_id", "left_semi"),
        "reports": mine(t["intel_report"]).orderBy(F.col("updated_at").desc_nulls_last(), F.desc("id")),
        "events": t["opportunity_event"].where(F.col("opp_id") == opp_id).join(t["resource"].select("file_path", F.col("resource_id").alias("event_resource")), "file_path", "left").orderBy(happened.desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.desc("event_id")),
        "resources": mine(t["resource"]).orderBy(F.col("created_at").desc_nulls_last(), F.desc("resource_id")),
    }


def company_detail(t: Tables, company_id: int) -> dict[str, DataFrame]:
    one = t["company"].where(F.col("company_id") == company_id)
    by = lambda name, key: t[name].where(F.col("company_id") == company_id).orderBy(F.desc(key))
    return {"company": one, "brand": latest_editions(t).join(F.broadcast(one.select("brand_id")), "brand_id", "left_semi"), "opportunities": by("opportunity", "opp_id"), "reports": by("intel_report", "id"), "resources": by("resource", "resource_id")}


def brand_research(t: Tables, identifier: str) -> dict[str, DataFrame]:
    """brand (the best of the exact hits, else of all), others (up to five), peers, editions."""
    rows = R.search(t["exhibition_brand"], ["name_cn", "name_en", "brand_id"], identifier)
    exact = (F.col("brand_id") == identifier) | (F.col("name_cn") == identifier) | (F.col("name_en") == identifier)
    tier = rows.withColumn("tier", F.when(exact, 0).otherwise(1))
    best = F.broadcast(tier.agg(F.min("tier").alias("best")))
    hits = tier.join(best, F.col("tier") == F.col("best")).drop("tier", "best").orderBy(F.desc(F.coalesce("scale_score", F.lit(0))), "brand_id").limit(6)
    picked = hits.limit(1)
    me = F.broadcast(picked.select(F.col("brand_id").alias("me"), F.col("industry_l1").alias("m1"), F.col("industry_l2").alias("m2")))
    near = t["exhibition_brand"].join(me, (F.col("industry_l1") == F.col("m1")) & (F.col("brand_id") != F.col("me"))).withColumn("tier", F.when((F.col("industry_l2") == F.col("m2")) & (F.col("m2") != ""), 0).otherwise(1))
    closest = F.broadcast(near.agg(F.min("tier").alias("best")))
    peers = near.join(closest, F.col("tier") == F.col("best")).orderBy(F.desc(F.coalesce("scale_score", F.lit(0))), "brand_id").drop("me", "m1", "m2", "tier", "best").limit(15)
    editions = t["exhibition_edition"].join(F.broadcast(picked.select("brand_id")), "brand_id", "left_semi").orderBy(F.col("year").desc_nulls_last(), F.desc("edition_id")).limit(10)
    return {"brand": picked, "others": hits.offset(1), "peers": peers, "editions": editions}


def industry_research(t: Tables, l1: str, l2: str = "", most: int = 50) -> dict[str, DataFrame]:
    """The largest brands of an industry, and counts over just these. 'l1/l2' may come as one."""
    if "/" in l1 and not l2:
        l1, l2 = (x.strip() for x in l1.split("/", 1))
    rows = t["exhibition_brand"].where(F.col("industry_l1") == l1)
    rows = rows.where(F.col("industry_l2") == l2) if l2 else rows
    top = rows.orderBy(F.desc(F.coalesce("scale_score", F.lit(0))), "brand_id").limit(most)
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    return {
        "brands": top, "counts": top.agg(F.count("*").alias("shown"), n(F.col("is_ufi_certified") == 1, "ufi"), n(F.col("is_international") == 1, "international")).crossJoin(rows.agg(F.count("*").alias("total"))),
        "cities": top.groupBy(F.coalesce(X.blank_to_null(F.col("city")), F.lit("未知")).alias("city")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(5),
    }


def company_history(t: Tables, name: str, most: int = 30) -> DataFrame:
    """Editions of brands whose organizer contains a name, newest first."""
    brands = R.search(t["exhibition_brand"], ["organizer", "co_organizer"], name).select("brand_id", "name_cn", "organizer")
    return t["exhibition_edition"].join(brands, "brand_id").orderBy(F.col("year").desc_nulls_last(), F.desc("edition_id")).limit(most)


def export_rows(t: Tables, first: str, last: str, cities: DataFrame | None = None, outside: tuple[str, ...] = (), foreign_venues: str = "") -> DataFrame:
    """Editions that start in a range of days, with their brands. cities: the mainland's places (column city)."""
    rows = t["exhibition_edition"].where(F.col("date_start").between(first, last)).drop("city", "notes").join(t["exhibition_brand"].select("brand_id", "name_cn", "name_en", "organizer", "city", "industry_l1", "industry_l2"), "brand_id")
    if cities is not None:
        rows = rows.join(F.broadcast(cities.select("city").distinct()), "city", "left_semi").where(~F.col("city").isin(*outside) if outside else F.lit(True))
        rows = rows.where(~F.coalesce("venue", F.lit("")).rlike(foreign_venues)) if foreign_venues else rows
    return rows.orderBy("date_start", "date_end", "city", "edition_id")


def export_for_tagging(t: Tables, l2: str | None = None, column: str = "competition_relation") -> DataFrame:
    rows = t["exhibition_brand"].where(F.trim(F.coalesce(column, F.lit(""))) == "")
    return (rows.where(F.col("industry_l2") == l2) if l2 else rows).orderBy("brand_id")


def system_status(t: Tables) -> DataFrame:
    """Row counts of the main tables and the latest crawl, as one row."""
    last = t["crawl_log"].orderBy(F.col("started_at").desc_nulls_last(), F.desc("id")).limit(1).select("batch_id", "status", "started_at", "finished_at")
    out = None
    for name in ("exhibition_brand", "exhibition_edition", "company", "opportunity", "intel_report", "resource"):
        one = t[name].agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(one)
    return out.join(last, F.lit(True), "left")


def user_prefs(t: Tables, email: str) -> DataFrame:
    """A user's chosen industries; what can't be read is an empty list."""
    parsed = F.from_json("dashboard_prefs", "struct<industries:array<string>>")["industries"]
    return t["user"].where((F.col("email") == email) & (F.col("is_active") == 1)).select("email", F.coalesce(parsed, F.array().cast("array<string>")).alias("industries"))


# Exhibitor analytics: editions and participations


def _walks(t: Tables) -> DataFrame:
    return t["participations"].join(t["editions"].select("edition_id", "show_name", "edition_year"), "edition_id")


def booth_history(t: Tables) -> DataFrame:
    """Every participation with the number of companies seen at the booth, the years its company came, and the years up
    to this one."""
    rows = _walks(t).withColumn("booth_full", X.booth(F.col("hall"), F.col("booth_number")))
    rows = R.distinct_over(rows, ["booth_full", "show_name"], "vis_hash", "unique_companies_at_booth")
    rows = R.distinct_over(rows, ["vis_hash", "show_name"], "edition_year", "company_years")
    so_far = Window.partitionBy("booth_full", "show_name").orderBy("edition_year").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    years = F.array_sort(F.collect_list("edition_year").over(so_far)).cast("array<string>")
    return rows.withColumn("years_so_far", F.array_join(years, ","))


def booth_rotation_alert(t: Tables) -> DataFrame:
    """Booths of a show that more than one company has had."""
    rows = _walks(t).withColumn("booth_full", X.booth(F.col("hall"), F.col("booth_number")))
    seen = F.array_sort(F.collect_set(F.struct("edition_year", "raw_name")))
    out = rows.groupBy("show_name", "booth_full").agg(F.count_distinct("vis_hash").alias("companies"), seen.alias("seen")).where("companies > 1")
    return out.withColumn("history", F.array_join(F.transform("seen", lambda s: F.concat_ws(": ", s["edition_year"], s["raw_name"])), " > ")).drop("seen")


def name_changes(t: Tables) -> DataFrame:
    """Exhibitors that came under more than one name."""
    return t["participations"].groupBy("vis_hash").agg(F.count_distinct("raw_name").alias("names"), F.array_join(F.array_sort(F.collect_set("raw_name")), " > ").alias("history")).where("names > 1")


def in_other_halls(t: Tables, country: str, halls: tuple[str, ...]) -> DataFrame:
    """A country's exhibitors outside its usual halls; rows without a hall are left out."""
    return _walks(t).where((F.col("country_code") == country) & ~F.col("hall").isin(*halls))


def adjacent_booths(t: Tables, least: int = 3) -> DataFrame:
    """Runs of booths with consecutive numbers that one exhibitor has in a hall of an edition."""
    rows = _walks(t).withColumn("number", F.regexp_extract("booth_number", r"(\d+)$", 1).try_cast("int")).where("number is not null")
    return R.runs(rows, ["edition_id", "hall", "vis_hash"], "number", least)


def seed_hits(t: Tables, seeds: DataFrame) -> DataFrame:
    """Participations of seed agents (agent_id, vis_hash, name), by hash or by a name that contains the agent's."""
    rows = _walks(t)
    by_hash = rows.join(seeds.select("agent_id", "vis_hash"), "vis_hash").select("part_id", "agent_id")
    met = containing(rows, seeds, "raw_name", "name")
    by_name = rows.join(met, "raw_name").join(seeds.select("agent_id", "name"), "name").select("part_id", "agent_id")
    return by_hash.union(by_name).distinct()


def anomaly_flags(t: Tables, seeds: DataFrame, country: str, halls: tuple[str, ...]) -> DataFrame:
    """flag_type, subject of everything the analyses above find."""
    flag = lambda df, kind, c: df.select(F.lit(kind).alias("flag_type"), F.col(c).cast("string").alias("subject"))
    rotation = booth_rotation_alert(t).withColumn("s", F.concat_ws("/", "show_name", "booth_full"))
    runs = adjacent_booths(t).withColumn("s", F.concat_ws("/", "edition_id", "hall", "first", "last"))
    parts = [flag(rotation, "booth_rotation", "s"), flag(name_changes(t), "name_change", "vis_hash"), flag(seed_hits(t, seeds), "seed_match", "part_id"), flag(in_other_halls(t, country, halls), "cn_in_intl_hall", "part_id"), flag(runs, "batch_booths", "s")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
