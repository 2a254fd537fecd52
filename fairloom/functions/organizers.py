"""Organizer strings to organizations: tokens, aliases, types, and a ranking by area."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.functions.text import OTHER_TYPE, classify_organisation, normalize_corp_name

# Separators, what may follow a comma without starting a new name, brackets, the company type.
SEPARATORS = "，、；;｜|／"
COMPANY_TAIL = re.compile(r"\s*(Ltd|Inc|LLC|L\.L\.C|Co|Corp|S\.A|S\.p\.A|Pvt|Pte|LLP|GmbH|AG|BV|NV|PLC|SRL)\b", re.I)
BRACKETS = {"（": "）", "(": ")", "【": "】", "[": "]"}
COMPANY = "企业"


def tokens(raw: str | None) -> list[str]:
    """Distinct organization names in order. Separators inside an open bracket don't separate (they become '，'); a
    comma doesn't where a company suffix follows."""
    names, held, waiting = [], "", None
    for i, ch in enumerate(raw or ""):
        if waiting:
            waiting = None if ch == waiting else waiting
            held += "，" if waiting and (ch in SEPARATORS or ch == ",") else ch
        elif ch in BRACKETS:
            # a bracket that closes before the next separator needs no watching
            waiting, held = BRACKETS[ch], held + ch
        elif ch in SEPARATORS or (ch == "," and not (held and COMPANY_TAIL.match(raw, i + 1))):
            names.append(held)
            held = ""
        else:
            held += ch
    out: dict[str, None] = {}
    for name in [*names, held]:
        name = re.sub(r"\s+", " ", _unwrapped(name.strip(" \t\n\r　·•")))
        if name:
            out.setdefault(name)
    return list(out)


def _unwrapped(name: str) -> str:
    """Without brackets around the whole name, and without one at the front that never closes."""
    while name and name[0] in BRACKETS:
        opener, closer, depth = name[0], BRACKETS[name[0]], 0
        closes = None
        for i, ch in enumerate(name):
            depth += (ch == opener) - (ch == closer)
            if depth == 0:
                closes = i
                break
        if closes == len(name) - 1:
            name = name[1:-1].strip()
        elif closes is None:
            name = name[1:].strip()
        else:
            break
    return name


@dataclass(frozen=True)
class Alias:
    """One organization under many spellings. by_country: where a name belongs to different owners by country."""

    canonical: str
    type: str
    patterns: Sequence[str]
    excludes: Sequence[str] = ()
    confidence: str = "high"
    by_country: dict[str, str] = field(default_factory=dict)
    unclear_countries: Sequence[str] = ()
    unclear_name: str = ""


def split_organizers(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([tokens(x) for x in s]), "array<string>")(c)


def resolve_alias(token: Column, country: Column, aliases: Sequence[Alias]) -> Column:
    """struct(canonical, org_type, confidence) of the first alias that fits, else null."""

    def find(names: pd.Series, countries: pd.Series) -> pd.DataFrame:
        rules = [(a, [re.compile(p, re.I) for p in a.patterns], [re.compile(p, re.I) for p in a.excludes]) for a in aliases]
        known: dict[tuple, tuple] = {}
        for key in zip(names, countries, strict=True):
            if key not in known:
                name, where = key
                found = (None, None, None)
                for a, patterns, excludes in rules:
                    if name is None or any(e.search(name) for e in excludes) or not any(p.search(name) for p in patterns):
                        continue
                    found = (a.canonical, a.type, a.confidence)
                    if where and where in a.by_country:
                        found = (a.by_country[where], a.type, "high")
                    elif where and where in a.unclear_countries:
                        found = (a.unclear_name, a.type, "check")
                    break
                known[key] = found
        return pd.DataFrame([known[k] for k in zip(names, countries, strict=True)], columns=["canonical", "org_type", "confidence"])

    return F.pandas_udf(find, "struct<canonical:string,org_type:string,confidence:string>")(token, country)


def organizer_index(brands: DataFrame, aliases: Sequence[Alias] = (), drop: Sequence[str] = (), built_at: str = "") -> DataFrame:
    """brand_id, seq, raw_token, canonical, org_type, confidence, built_at: one row for each organizer of a brand, seq
    counted from 0 after noise tokens are dropped."""
    some = brands.where("organizer is not null and trim(organizer) <> '' and organizer <> 'test'")
    country = F.coalesce("country_cn", F.lit("")) if "country_cn" in brands.columns else F.lit("")
    named = F.filter(split_organizers(F.col("organizer")), lambda t: ~F.lower(t).isin([d.strip().lower() for d in drop])) if drop else split_organizers(F.col("organizer"))
    each = some.select("brand_id", country.alias("country"), F.posexplode(named).alias("seq", "raw_token"))
    each = each.withColumn("hit", resolve_alias(F.col("raw_token"), F.col("country"), aliases)).withColumn("own", classify_organisation(F.col("raw_token")))
    found = F.col("hit.canonical").isNotNull()
    return each.select(
        "brand_id", "seq", "raw_token",
        F.when(found, F.col("hit.canonical")).when(F.col("own") == COMPANY, normalize_corp_name(F.col("raw_token"))).otherwise(F.col("raw_token")).alias("canonical"),
        F.when(found, F.col("hit.org_type")).otherwise(F.col("own")).alias("org_type"),
        F.when(found, F.col("hit.confidence")).otherwise("auto").alias("confidence"), F.lit(built_at).alias("built_at"),
    )


def rank_organizers(index: DataFrame, editions: DataFrame, year: int, all_types: bool = False, dedup: bool = False) -> dict[str, DataFrame]:
    """ranking (canonical, org_type, area, brands, confidence, spellings, place), skipped (area by type left out) and
    unmapped (canonical, area, n). Each organizer of an edition is credited with its whole area. editions: edition_id,
    brand_id, year, area_sqm, city, exhibitors_count. dedup: of editions equal in city, area and exhibitors, the first."""
    rows = editions.where((F.col("year") == year) & (F.col("area_sqm") > 0))
    if dedup:
        first = rows.groupBy("city", "area_sqm", "exhibitors_count").agg(F.min("edition_id").alias("edition_id"))
        rows = rows.join(first.select("edition_id"), "edition_id", "left_semi")
    credited = rows.join(index, "brand_id")
    kept = credited if all_types else credited.where(F.col("org_type") == COMPANY)
    ranking = kept.groupBy("canonical").agg(
        F.max("org_type").alias("org_type"), F.sum("area_sqm").alias("area"), F.count("*").alias("brands"),
        F.when(F.count_distinct("confidence") > 1, "mixed").otherwise(F.min("confidence")).alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("raw_token")), " | ").alias("spellings"),
    )
    skipped = credited.where(F.lit(not all_types) & (F.col("org_type") != COMPANY)).groupBy("org_type").agg(F.sum("area_sqm").alias("area"))
    unmapped = credited.where((F.col("confidence") == "auto") & F.col("org_type").isin(COMPANY, OTHER_TYPE)).groupBy("canonical").agg(F.sum("area_sqm").alias("area"), F.count("*").alias("n"))
    return {"ranking": ranking.orderBy(F.desc("area"), "canonical"), "skipped": skipped, "unmapped": unmapped}
