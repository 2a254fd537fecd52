"""Merging, matching and governing on small snapshots."""

import difflib
import itertools
import random

import pytest

from fairloom import schema
from fairloom.operators import similarity as S
from fairloom.operators.graph import connected_components
from fairloom.operators.storage import dealt
from fairloom.plans import batch as B

RAW = "cn_name string, en_name string, date_str string, venue string, city string, area_str string, visitors_str string, exhibitors_str string, organizer string, cycle string, industry string, source_url string, year int, crawl_batch_id string"


def raw(spark, rows):
    base = {"cn_name": "", "en_name": "", "date_str": "2026年05月06日~05月08日", "venue": "", "city": "上海上海", "area_str": "", "visitors_str": "", "exhibitors_str": "", "organizer": "", "cycle": "", "industry": "", "source_url": "", "year": 2026, "crawl_batch_id": "B1"}
    names = [c.split()[0] for c in RAW.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], RAW)


def test_merge_is_idempotent(spark):
    a = raw(spark, [{"cn_name": "  上海国际机床展  ", "area_str": "面积:10,000平方米", "organizer": "甲", "source_url": "https://site_a.x/1.html"}, {"cn_name": "新展", "source_url": "https://site_a.x/2"}, {"cn_name": "别批", "crawl_batch_id": "B0"}])
    b = raw(spark, [{"cn_name": "上海国际机床展", "area_str": "12000平方米", "organizer": "乙", "visitors_str": "观众:5.0万人", "source_url": "https://site_b.x/1/"}, {"cn_name": "只有乙", "source_url": "https://site_b.x/3"}])
    brands = schema.empty(spark, "exhibition_brand").unionByName(spark.createDataFrame([("EXPO-0007", "上海国际机床展"), ("EXPO-D92BC0D6", "无关")], "brand_id string, name_cn string"), allowMissingColumns=True)
    state = [brands, schema.empty(spark, "exhibition_edition"), schema.empty(spark, "data_provenance")]
    one = {k: v.cache() for k, v in B.merge_run(*state, a, b, "B1", "2026-01-01").items()}
    ids = {r.name_cn: r.brand_id for r in one["brands"].collect()}
    new_id = ids.pop("新展")
    assert {ids.pop("只有乙"), new_id} == {"EXPO-0008", "EXPO-0009"}
    assert ids == {"上海国际机床展": "EXPO-0007", "无关": "EXPO-D92BC0D6"}
    e = {r.brand_id: r for r in one["editions"].collect()}
    assert e["EXPO-0007"].area_sqm == 12000 and e["EXPO-0007"].visitors_count == 50000 and e["EXPO-0007"].data_source == "site_a+site_b" and e["EXPO-0007"].date_end == "2026-05-08"
    assert e[new_id].area_sqm is None and one["provenance"].count() == 4
    assert "area_sqm: site_a=10000, site_b=12000" in e["EXPO-0007"].notes
    two = B.merge_run(*[one[k] for k in ("brands", "editions", "provenance")], a, b, "B1", "2026-01-02")
    again = {r.brand_id: r.area_sqm for r in two["editions"].collect()}
    assert len(again) == 3 and again[new_id] == 0
    assert two["stats"].first().brands_created == 0 and two["provenance"].count() == 4


def test_ratio_is_difflibs_and_pruning_loses_nothing(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcd展会") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "a string").distinct()
    for t in (0.5, 0.8):
        got = {(r.a, r.b): r.sim for r in S.scored_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", t).collect()}
        want = {(x, y): s for x in set(words) for y in set(words) if x and y and (s := difflib.SequenceMatcher(None, x, y).ratio()) >= t}
        assert got == pytest.approx(want)


def test_rare_bigrams_lose_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh 展会") for _ in range(rng.randint(2, 30))) for _ in range(60)]
    for w in words[:40]:
        cut = rng.randrange(len(w))
        words += [w[:cut] + rng.choice("xyz") + w[cut:], w[cut:] + w[:cut], w[:cut] + w[cut + 2 :], w.replace("a", "q")]
    words = sorted({w for w in words if w})
    df = spark.createDataFrame([(w,) for w in words], "a string")
    for t in (0.7, 0.75, 0.85, 0.9):
        found = {(r.a, r.b): r.sim for r in S.scored_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", t).collect()}
        want = {(x, y): s for x in words for y in words if (s := difflib.SequenceMatcher(None, x, y).ratio()) >= t}
        assert found == pytest.approx(want) and len(want) > len(words)


def test_best_match(spark):
    known = spark.createDataFrame([("EXPO-0001", "上海国际机床展")], "brand_id string, name_cn string")
    names = spark.createDataFrame([("上海国际机床展",), ("上海国际机床展览会",), ("完全无关的展览",), ("",)], "n string")
    got = {r.n: r.match for r in S.best_match(names, known, "n", "name_cn", "brand_id").collect()}
    assert got == {"上海国际机床展": "EXPO-0001", "上海国际机床展览会": None, "完全无关的展览": None, "": None}
    close = known.union(spark.createDataFrame([("EXPO-0002", "上海国际机床展")], known.schema))
    assert {r.match for r in S.best_match(names, close, "n", "name_cn", "brand_id").collect()} == {None}


def test_duplicate_levels_and_components(spark):
    rows = [("b1", "2025上海机床展览", "甲", "上海", "2026-05-01", "机", "床"), ("b2", "2026上海机床展览会", "甲", "上海", "2026-05-01", "机", "床"), ("b3", "上海机床展览", "乙", "北京", "2026-01-01", "", ""), ("b4", "食品博览", "甲", "广州", "2026-02-01", "食", ""), ("b5", "食品博览会", "甲", "深圳", "2026-03-01", "食", "x")]
    brands = spark.createDataFrame(rows, "id string, name string, organizer string, city string, start string, l1 string, l2 string")
    got = {(r.a, r.b): r.level for r in S.duplicate_pairs(brands).collect()}
    assert got == {("b1", "b2"): "D0", ("b1", "b3"): "L1", ("b4", "b5"): "L3"}
    groups = {r.node: r.component for r in B.merge_groups(brands).collect()}
    assert groups == {"b1": "b1", "b2": "b1", "b3": "b1"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges if None not in e for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_merged_duplicates(spark):
    brands = schema.empty(spark, "exhibition_brand").unionByName(spark.createDataFrame([("b1", "长一点的名字", None, 2001), ("b2", "短名", "Short", 1999), ("b3", "别", None, None)], "brand_id string, name_cn string, name_en string, first_year int"), allowMissingColumns=True)
    editions = schema.empty(spark, "exhibition_edition").unionByName(spark.createDataFrame([("b1-2026", "b1", 2026, 5, ""), ("b2-2026", "b2", 2026, 9, "馆"), ("b3-2026", "b3", 2026, 1, "")], "edition_id string, brand_id string, year int, area_sqm long, venue string"), allowMissingColumns=True)
    groups = spark.createDataFrame([("b1", "b1"), ("b2", "b1")], "node string, component string")
    out = B.merged_duplicates(brands, editions, groups, {"company": spark.createDataFrame([(1, "b2"), (2, None)], "company_id long, brand_id string")})
    assert {(r.brand_id, r.name_cn, r.name_en, r.first_year) for r in out["brands"].collect()} == {("b1", "短名", "Short", 1999), ("b3", "别", None, None)}
    assert {(r.edition_id, r.area_sqm, r.venue) for r in out["editions"].collect()} == {("b1-2026", 9, "馆"), ("b3-2026", 1, None)}
    assert {(r.company_id, r.brand_id) for r in out["company"].collect()} == {(1, "b1"), (2, None)}


def test_tags(spark):
    brands = schema.empty(spark, "exhibition_brand").unionByName(spark.createDataFrame([("t1", "甲", None, 3), ("t2", "乙", "否", 4)], "brand_id string, name_cn string, competition_relation string, ma_potential int"), allowMissingColumns=True)
    sheet = spark.createDataFrame([("t1", "是", "5"), ("t2", "也许", "2"), ("t9", "是", "1")], "brand_id string, competition_relation string, ma_potential string")
    out = B.imported_tags(brands, sheet, "now", "me")
    assert {(r.brand_id, r.competition_relation, r.ma_potential) for r in out["brands"].collect()} == {("t1", "是", 5), ("t2", "否", 4)}
    assert {(r.brand_id, r.field_name, r.old_value, r.new_value) for r in out["history"].collect()} == {("t1", "competition_relation", "", "是"), ("t1", "ma_potential", "3", "5")}
    assert [(r.brand_id, r.problem) for r in out["rejected"].collect()] == [("t2", "competition_relation=也许")]


def test_status_ready_classify(spark):
    editions = spark.createDataFrame([("e1", "b1", "2026-01-01", "2026-01-03", ""), ("e2", "b1", "2026-09-01", None, ""), ("e3", "b2", "2020-01-01", "", "取消"), ("e4", "b2", "", None, "延期")], "edition_id string, brand_id string, date_start string, date_end string, status string")
    assert {r.edition_id: r.status for r in B.edition_status(editions, "2026-05-01").collect()} == {"e1": "已举办", "e2": "即将举办", "e3": "取消", "e4": "延期"}
    brands = schema.empty(spark, "exhibition_brand").unionByName(spark.createDataFrame([("b1", "机床展", "机"), ("b3", "x", "机"), ("b2", "茶展", "")], "brand_id string, name_cn string, industry_l1 string"), allowMissingColumns=True)
    assert {r.brand_id: r.display_ready for r in B.display_ready(brands, editions).collect()} == {"b1": 1, "b2": 0, "b3": 0}
    provenance = spark.createDataFrame([("b2", "u1"), ("b2", "u2"), ("b3", "u3")], "brand_id string, source_url string")
    pages = spark.createDataFrame([(1, "u1", "旧展会，"), (2, "u1", "茶叶展会，更多"), (3, "u2", "别的展会,"), (4, "u3", "未知类")], "id long, source_url string, industry string")
    categories = spark.createDataFrame([("茶叶", "食品", "茶")], "category string, l1 string, l2 string")
    out, unknown = B.classified(brands, provenance, pages, categories, {"机械": ["机床"]}, only_empty=True)
    assert {r.brand_id: (r.industry_l1, r.industry_l2) for r in out.collect()} == {"b1": ("机", None), "b2": ("食品", "茶"), "b3": ("机", None)}
    assert [r.category for r in unknown.collect()] == ["未知类"]


def test_folding(spark):
    rows = [("上海机床展A", "1", "2", "馆", 5), ("上海机床展", "1", "2", "馆", 9), ("食品甲乙丙丁", "3", "4", "馆", 1), ("糖酒食品甲乙丙丁", "3", "4", "馆", 2), ("完全不同", "3", "4", "馆", 3), ("无馆", "1", "2", "", 7)]
    out = {(r.name, r.aliases, r.area) for r in B.folded_colocated(spark.createDataFrame(rows, "name string, start string, end string, venue string, area int")).collect()}
    assert out == {("上海机床展", "上海机床展A", 9), ("食品甲乙丙丁", "糖酒食品甲乙丙丁", 2), ("完全不同", "", 3), ("无馆", "", 7)}


def test_folding_is_dealt_by_size_once(spark):
    """Groups against a plain loop over all names; more rows make more partitions, not larger ones."""
    rng = random.Random(4)
    words = ["机床", "食品", "国际", "展览会", "上海", "A", "B"]
    rows = sorted({("".join(rng.choices(words, k=rng.randint(1, 4))), "1", "2", f"馆{rng.randint(0, 90)}") for _ in range(300)}) + [(None, "1", "2", "馆"), ("机床", "1", "2", "馆"), (" ", "1", "2", "馆1")]
    rows = [(*r, i, f"x{i}") for i, r in enumerate(rows + rows[:9])]
    df = spark.createDataFrame(rows, "name string, start string, end string, venue string, area int, note string")
    want, halls = set(), {}
    for r in rows:
        halls.setdefault(r[3], []).append(r)
    for hall, here in halls.items():
        names = sorted({r[0] for r in here if r[0] is not None})
        lead = {n: n for n in [*names, None]}
        if len(here) > 1 and names[0][:3] == names[-1][:3] and len(names[0]) >= 3:
            lead = dict.fromkeys(lead, "all")
        elif 1 < len(here) <= 5:
            for x, y in itertools.combinations(names, 2):
                if difflib.SequenceMatcher(None, x, y).ratio() >= 0.45:
                    lead = {n: lead[x] if g == lead[y] else g for n, g in lead.items()}
        for g in set(lead.values()):
            some = [r for r in here if lead[r[0]] == g]
            all_names = sorted((r[0] for r in some if r[0] is not None), key=lambda n: (len(n), n))
            if some:
                want.add((all_names[0] if all_names else None, hall, max(r[4] for r in some), "；".join(all_names[1:])))
    for share in (250_000, 20):
        out = B.folded_colocated(df, share=share)
        assert {(r.name, r.venue, r.area, r.aliases) for r in out.collect()} == want
    assert dealt(df, "venue", rows=20).rdd.getNumPartitions() == -(-len(rows) // 20)


def test_prospects_and_constraints(spark):
    kind = "brand_id string, qcc_key_no string, name string"
    have = spark.createDataFrame([("b1", "k1", "A"), ("b1", None, "B")], kind)
    new = spark.createDataFrame([("b1", "k1", "A2"), ("b1", "k2", "C"), ("b1", None, "B"), (None, None, "B"), ("b1", None, ""), (None, "k1", "D")], kind)
    inserted, skipped = B.new_prospects(have, new)
    assert {tuple(r) for r in inserted.collect()} == {("b1", "k2", "C"), (None, None, "B"), (None, "k1", "D")} and skipped.count() == 3
    company = schema.empty(spark, "company").unionByName(spark.createDataFrame([(1, "b1", "k1", "A", "manual", 9), (2, "b1", "k1", None, "bad", 5), (3, None, "k1", "C", None, None)], "company_id long, brand_id string, qcc_key_no string, name string, source_type string, prospect_score int"), allowMissingColumns=True)
    found = {(r.company_id, r.rule) for r in schema.violations(company, "company_id", schema.table_rules("company")).collect()}
    assert found == {(2, "name required"), (2, "source_type"), (1, "prospect_score"), (1, "unique brand_id, qcc_key_no"), (2, "unique brand_id, qcc_key_no")}


def test_categories_and_cascade(spark):
    names = spark.createDataFrame([("医疗器械展",), ("食品饮料加工",), ("短名",), ("毫不相干之物",)], "name string")
    categories = spark.createDataFrame([("医疗器械",), ("食品饮料",)], "category string")
    assert {(r.name, r.category, r.verdict) for r in B.category_matches(names, categories).collect()} == {("医疗器械展", "医疗器械", "accept"), ("食品饮料加工", "食品饮料", "accept")}
    brands = spark.createDataFrame([("b1", "上海国际机床展览会", "CIMT"), ("b2", "广州食品与饮料工业展", ""), ("b3", "某展", None)], "brand_id string, name_cn string, name_en string")
    wanted = spark.createDataFrame([("cimt",), ("某展",), ("上海国际机床展示",), ("广州食品饮料工业展",), ("无",)], "name string")
    got = {(r.name, r.brand_id, r.step) for r in B.cascade_matches(wanted, brands).collect()}
    assert got == {("cimt", "b1", "name_en"), ("某展", "b3", "name_cn"), ("上海国际机床展示", "b1", "first 6"), ("广州食品饮料工业展", "b2", "similar")}
