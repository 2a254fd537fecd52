"""Scalar tables: what messy strings become."""

import pytest
from pyspark.sql import functions as F

from fairloom.functions import organizers
from fairloom.functions import text as X


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


CASES = {
    "parse_numeric": [("10万平方米", 100000), ("10.5万平方米", 105000), ("5.0万人", 50000), ("100000平方米", 100000), ("600,000平方米", 600000), ("300，家", 300), ("面积:15000平方米", 15000), ("展商:350家", 350), ("展商：300，家", 300), ("1,000家", 1000), ("27.0万平方米", 270000), (None, None), ("", None), ("暂无数据", None), (",,", None)],
    "parse_date_pair": [("2026年05月06日~05月08日", ("2026-05-06", "2026-05-08")), ("2023年12月15日~06月15日", ("2023-12-15", "2024-06-15")), ("2026年5月1日", ("2026-05-01", None)), ("2024.09.01-02.01", ("2024-09-01", "2025-02-01")), ("2024.05.06-05.08", ("2024-05-06", "2024-05-08")), ("2026.05.01-05", ("2026-05-01", "2026-05-05")), ("2024.10.01", ("2024-10-01", None)), ("2026年5月1日-5日", ("2026-05-01", None)), ("2026.05.06 - 2026.05.08", (None, None)), (None, (None, None)), ("soon", (None, None))],
    "normalize_city": [("呼和浩特", "呼和浩特"), ("上海上海", "上海"), ("湖北武汉", "武汉"), ("江苏南京", "南京"), (None, ""), (" 北京 ", "北京")],
    "canonical_url": [("https://x.cn/exhibition/1.html", "https://x.cn/exhibition/1"), ("https://x.cn/exhibition/1/", "https://x.cn/exhibition/1"), ("https://x.cn/a.HTM//?p=1.html", "https://x.cn/a?p=1.html"), ("", ""), (None, "")],
    "normalize_cjk_spaces": [("上海 国际  Expo 2026 展", "上海国际 Expo 2026 展"), ("  a  b ", "a b")],
    "normalize_name": [("2026第二十四届上海国际机床展（上海市）", "上海国际机床展"), ("CBST2025年第13届饮料展", "CBST饮料展"), (None, "")],
    "classify_organisation": [("展会组委会", "组委会"), ("上海市人民政府", "政府"), ("中国机械工业联合会", "协会"), ("Messe Frankfurt", "企业"), ("ABC Co., Ltd", "企业"), ("某某", "其他")],
    "normalize_corp_name": [("德国展览有限公司", "展览"), ("公司", "公司"), ("上海会展股份有限责任公司", "上海会展")],
    "classify_industry": [("医疗器械", "医疗和健康"), ("机床五金", "机械和设备"), ("x", ""), (None, "")],
    "embedded_english": [("2026中国国际化工展览会 ICIF China 2026", "ICIF China 2026"), ("展会（SNEC）", "SNEC"), ("展会ITES深圳", "ITES"), ("展会", None)],
    "generated_english": [("2026第26届（CIIF）工博会", "CIIF"), ("中国国际机床展览会", "国际机床 EXPO"), ("", "")],
    "year_before_dot": [("2026.05.01", 2026), ("x", 0)],
    "first_year": [("in 2027, or", 2027), ("", 0)],
}


@pytest.mark.parametrize("name", CASES)
def test_table(spark, name):
    got = apply(spark, getattr(X, name), [v for v, _ in CASES[name]])
    assert [tuple(g) if hasattr(g, "start") and not isinstance(g, str) else g for g in got] == [w for _, w in CASES[name]]


def test_scale_and_time(spark):
    assert apply(spark, X.scale_bucket, [None, 0, 9999, 10000, 50000, 100000], "long") == [None, "lt1w", "lt1w", "1w-5w", "5w-10w", "gte10w"]
    assert apply(spark, lambda c: X.end_of_week(F.to_date(c)).cast("string"), ["2026-11-23", "2026-11-28", "2026-11-29"]) == ["2026-11-29"] * 3
    assert [tuple(r) for r in apply(spark, X.month_range, ["2024-02"])] == [("2024-02-01", "2024-02-29")]
    assert apply(spark, lambda c: X.shift_month(c, -1), ["2026-01"]) == ["2025-12"]
    assert apply(spark, lambda c: X.is_safe_path(c, ("data",)), ["data/a.csv", "../x", "/data/a", "data/../x", "data/.h", "other/a", ""]) == [True, False, False, False, False, False, False]
    assert apply(spark, X.tolerant_json, ['{"a":1}', "{bad", None]) == ['{"a":1}', "{}", "{}"]


def test_organizer_tokens():
    t = organizers.tokens
    assert t("A公司，B协会、A公司") == ["A公司", "B协会"]
    assert t("ABC Co., Ltd, XYZ Inc") == ["ABC Co., Ltd", "XYZ Inc"]
    assert t("（上海）会展公司（Hyve）") == ["（上海）会展公司（Hyve）"]
    assert t("（某某公司）") == ["某某公司"]
    assert t("甲（乙、丙）；丁") == ["甲（乙，丙）", "丁"]
    assert t(None) == [] and t("  ") == []


def test_organizer_index_and_ranking(spark):
    brands = spark.createDataFrame([("b1", "法兰克福展览有限公司；待定", "德国"), ("b2", "Messe Frankfurt", "德国"), ("b3", "test", ""), ("b4", "上海协会", "")], "brand_id string, organizer string, country_cn string")
    alias = organizers.Alias("法兰克福", "企业", ["法兰克福", "messe frankfurt"], by_country={"法国": "其他主"})
    index = organizers.organizer_index(brands, [alias], drop=["待定"])
    assert {(r.brand_id, r.seq, r.canonical, r.org_type, r.confidence) for r in index.collect()} == {("b1", 0, "法兰克福", "企业", "high"), ("b2", 0, "法兰克福", "企业", "high"), ("b4", 0, "上海协会", "协会", "auto")}
    editions = spark.createDataFrame([("b1-2026", "b1", 2026, 100, "x", 1), ("b2-2026", "b2", 2026, 50, "y", 1), ("b4-2026", "b4", 2026, 7, "z", 1), ("b1-2025", "b1", 2025, 9, "x", 1)], "edition_id string, brand_id string, year int, area_sqm long, city string, exhibitors_count int")
    out = organizers.rank_organizers(index, editions, 2026)
    assert [(r.canonical, r.area, r.brands) for r in out["ranking"].collect()] == [("法兰克福", 150, 2)]
    assert [(r.org_type, r.area) for r in out["skipped"].collect()] == [("协会", 7)]
