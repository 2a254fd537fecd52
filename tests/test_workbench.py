"""Lists, dashboards and exhibitor analytics on small tables with known answers."""

import json
import zipfile

import pytest

from fairloom import schema
from fairloom.plans import workbench as W
from fairloom.sources import files, html, sheets
from fairloom.streaming import batches


def fill(spark, name, columns, rows):
    kinds = dict(x.split(" ", 1) for x in schema.TABLES[name].split(", "))
    ddl = ", ".join(f"{c} {kinds[c]}" for c in columns.split())
    return schema.empty(spark, name).unionByName(spark.createDataFrame(rows, ddl), allowMissingColumns=True)


@pytest.fixture(scope="module")
def t(spark):
    brands = [(x, f"医疗器械{x}" if x in "ABCD" else f"机械{x}", "上海" if x not in "IJ" else "北京", "医疗" if x in "ABCD" else "机械", "中国", 0 if x in "KL" else 1) for x in "ABCDEFGHIJKL"]
    editions = []
    for x in "ABCDEFGH":
        editions += [(f"{x}-2024", x, 2024, 90000, 500, 40000, "2024-03-01"), (f"{x}-2025-1", x, 2025, 100000, 600, 50000, "2025-03-01"), (f"{x}-2025-2", x, 2025, 120000, 700, 60000, "2025-09-01")]
    editions += [(f"{x}-2026", x, 2026, 55000 if x in "IJ" else 999999, 300, 30000, "2026-05-01") for x in "IJKL"]
    opportunities = [(i, f"机会{i}", "ma", "intent", "甲", "事", f"2026-05-{i:02d}", 0, 7 if i == 1 else None, '{"a": 1}' if i == 1 else "{bad") for i in range(1, 13)] + [(13, "x", "ma", "contact", None, None, "", 0, None, None), (14, "y", "ma", "bogus", None, None, None, 0, None, None), (15, "z", "ma", "contact", None, None, "2026-05-02", 1, None, None)]
    return {
        "exhibition_brand": fill(spark, "exhibition_brand", "brand_id name_cn city industry_l1 country_cn display_ready", brands),
        "exhibition_edition": fill(spark, "exhibition_edition", "edition_id brand_id year area_sqm exhibitors_count visitors_count date_start", editions),
        "opportunity": fill(spark, "opportunity", "opp_id title type stage owner next_action next_action_due is_archived company_id detail_json", opportunities),
        "opportunity_event": fill(spark, "opportunity_event", "event_id opp_id event_type content occurred_at created_at", [(1, 1, "meeting", "谈", "2026-05-03 14:00", "2026-05-01"), (2, 1, "meeting", None, "2026-05-03", "2026-05-01"), (3, 15, "meeting", "", "2026-05-03", ""), (4, 1, "note", "", "", "2026-06-01"), (5, 2, "meeting", "", None, "")]),
        "company": fill(spark, "company", "company_id name brand_id", [(7, "公司", "A")]),
        "intel_report": fill(spark, "intel_report", "id title report_type status updated_at company_id report_md opp_id", [(i, f"r{i}", "x", "draft", f"2026-01-0{i}", 7 if i == 3 else None, "字" * 200, 1 if i == 1 else None) for i in range(1, 8)]),
        "resource": fill(spark, "resource", "resource_id kind title file_path size_bytes company_id", [(1, "raw", "a", "p/a", 10, 7), (2, "raw", "b", "p/b", None, None), (3, "note", "c", "p/c", 5, None)]),
        "brand_organizer": fill(spark, "brand_organizer", "brand_id seq canonical org_type", [("A", 0, "甲会展", "企业"), ("B", 0, "甲会展", "企业"), ("B", 1, "乙", "企业"), ("C", 0, "协会", "协会"), ("K", 0, "甲会展", "企业")]),
        "crawl_log": fill(spark, "crawl_log", "id batch_id status started_at", [(1, "b1", "failed", "2026-01-01"), (2, "b2", "success", "2026-02-01")]),
        "user": fill(spark, "user", "user_id email is_active dashboard_prefs", [(1, "a@x", 1, '{"industries": ["医疗"]}'), (2, "b@x", 1, "{bad")]),
    }


def test_lists(t):
    page, total = W.list_page(t, "expo", sort="name_cn", order="asc")
    rows = page.collect()
    assert total.first().total == len(rows) == 10 and [r.name_cn for r in rows] == sorted(r.name_cn for r in rows)
    assert {(r.year, r.area_sqm) for r in rows if r.brand_id == "A"} == {(2025, 120000)}
    assert W.list_page(t, "expo", {"industry_l1": "医疗", "bogus": 1})[1].first().total == 4 == W.list_page(t, "expo", q="医疗器械")[1].first().total
    first, second = ({r.brand_id for r in W.list_page(t, "expo", page=p, size=4)[0].collect()} for p in (1, 2))
    assert len(first) == len(second) == 4 and not first & second
    assert W.list_page(t, "opportunity")[1].first().total == 14
    assert {r.company_name for r in W.list_page(t, "research")[0].collect()} == {None, "公司"}
    assert W.R.page_bounds("x", 9999) == (1, 200) and W.R.page_bounds(-3, 0) == (1, 50) and W.R.page_bounds(2, -1) == (2, 1)


def test_expo_stats_and_landing(spark, t):
    places = spark.createDataFrame([("中国", "上海", 121.0, 31.0)], "country string, city string, lon double, lat double")
    out = W.expo_stats(t, places=places)
    assert out["totals"].first().area_sqm == 8 * 120000 + 2 * 55000
    assert {r.bucket: r.n for r in out["scale"].collect()} == {"lt1w": 0, "1w-5w": 0, "5w-10w": 2, "gte10w": 8}
    assert {(r.lon, r.n) for r in out["points"].collect()} == {(121.0, 8), (None, 2)}
    assert W.expo_stats(t, industries=("医疗,机械",), bucket="5w-10w")["totals"].first().brands == 2
    land = W.landing(t, 2026, highlight="甲")
    assert [(r.canonical, r.brands, r.highlight) for r in land["organizers"].collect()] == [("甲会展", 2, True), ("乙", 1, False)]
    assert [(r.month, r.n) for r in land["schedule"].collect() if r.is_peak] == [(5, 2)] and land["without"].first().n == 8


def test_overview_calendar_and_details(t):
    out = W.overview(t, "2026-05-06")
    assert out["kpi"].first().asDict() == {"opportunities": 14, "overdue": 5, "this_week": 5, "week_end": "2026-05-10"}
    assert [(r.stage, r.n) for r in out["funnel"].orderBy("pos").collect()] == [("contact", 1), ("intent", 12), ("dd", 0), ("audit", 0), ("closing", 0)]
    assert len(out["tasks"].collect()) == 10 and [len(r.excerpt) for r in out["reports"].collect()] == [160] * 5
    assert {(r.kind, r.n, r.bytes) for r in out["resources"].collect()} == {("raw", 2, 10), ("note", 1, 5), (None, 3, 15)}
    days = W.calendar(t, "2026-05", "2026-05-06").where("day = '2026-05-03'").orderBy("place").collect()
    assert [(r.kind, r.time, r.overdue) for r in days] == [("meeting", None, False), ("meeting", "14:00", False), ("next_action", None, True)]
    one = W.opportunity_detail(t, 1)
    assert {k: v.count() for k, v in one.items()} == {"opportunity": 1, "company": 1, "brand": 0, "reports": 2, "events": 3, "resources": 1}
    assert [r.event_id for r in one["events"].collect()] == [4, 1, 2] and W.opportunity_detail(t, 2)["opportunity"].first().detail_json == "{}"
    assert W.company_detail(t, 7)["brand"].first().edition_id == "A-2025-2"
    assert W.brand_research(t, "医疗器械A")["brand"].first().brand_id == "A" and W.brand_research(t, "医疗")["others"].count() == 3
    assert W.industry_research(t, "医疗")["cities"].first().city == "上海"
    assert W.system_status(t).first().batch_id == "b2"
    assert W.user_prefs(t, "a@x").first().industries == ["医疗"] and W.user_prefs(t, "b@x").first().industries == []
    assert W.export_rows(t, "2025-01-01", "2025-06-30").count() == 8


def test_exhibitors(spark):
    e = spark.createDataFrame([("e1", "S", 2024), ("e2", "S", 2025)], "edition_id string, show_name string, edition_year int")
    p = spark.createDataFrame([(1, "e1", "h1", "Acme", "CN", "1", "A1"), (2, "e2", "h2", "Beta", "DE", "1", "A1"), (3, "e2", "h1", "Acme Ltd", "CN", None, "B1"), (4, "e2", "h3", "Co", "CN", "9", "C1"), (5, "e2", "h3", "Co", "CN", "9", "C2"), (6, "e2", "h3", "Co", "CN", "9", "C3")], "part_id long, edition_id string, vis_hash string, raw_name string, country_code string, hall string, booth_number string")
    t = {"editions": e, "participations": p}
    assert [(r.booth_full, r.history) for r in W.booth_rotation_alert(t).collect()] == [("1 A1", "2024: Acme > 2025: Beta")]
    assert {(r.part_id, r.unique_companies_at_booth, r.company_years, r.years_so_far) for r in W.booth_history(t).where("part_id < 3").collect()} == {(1, 2, 2, "2024"), (2, 2, 1, "2024,2025")}
    assert [(r.vis_hash, r.history) for r in W.name_changes(t).collect()] == [("h1", "Acme > Acme Ltd")]
    assert {r.part_id for r in W.in_other_halls(t, "CN", ("1",)).collect()} == {4, 5, 6}
    assert [(r["first"], r["last"], r["size"]) for r in W.adjacent_booths(t).collect()] == [(1, 3, 3)]
    seeds = spark.createDataFrame([("s1", "h2", ""), ("s2", None, "Acme")], "agent_id string, vis_hash string, name string")
    assert {tuple(r) for r in W.seed_hits(t, seeds).collect()} == {(2, "s1"), (1, "s2"), (3, "s2")}
    assert W.anomaly_flags(t, seeds, "CN", ("1",)).count() == 1 + 1 + 3 + 3 + 1


def test_html(spark):
    card = '<div class="exh-info-wrap"><h2><a href="/exhibition/5.html">机床展</a></h2><p class="En_name">MT &amp; Co</p><time>2026.05.01-05.03</time><span class="pavilion-name">馆</span><div class="scale-remind"><span class="data">1,000</span><span class="unitText">平方米</span><div></div><div><b class="data">7</b><i class="unitText">人次</i></div></div><div class="scale-remind"><b class="data">3</b><i class="unitText">米</i></div></div><div class="exh-info-wrap"><h2>none</h2></div>'
    flight = '<script>self.__next_f.push([1,"1:{\\"view\\":{\\"id\\":\\"$2:a\\"}}\\n2:{\\"a\\":"])</script><script>self.__next_f.push([1,"{\\"b\\":[1]}}\\n"])</script>'
    detail = '<dl><dt>主办：</dt><dd>上 海</dd><dt>主办</dt><dd>x</dd></dl><script type="application/ld+json">{"name":"E","startDate":"2026-01-01"}</script><a href="/event/12.html">推荐某某展会</a><a href="/event/12.html">又一次出现</a><a href="/event/x">四个字的</a>'
    df = spark.createDataFrame([(1, card), (2, flight), (3, detail), (4, None)], "page_id long, html string")
    rows = html.list_rows(df, "https://x.cn").collect()
    assert [(r.cn_name, r.en_name, r.area_str, r.visitors_str, r.exhibitors_str, r.source_url) for r in rows] == [("机床展", "MT & Co", "1,000平方米", "7人次", "", "https://x.cn/exhibition/5")]
    assert {r.page_id: r.labels for r in html.detail_rows(df).collect()}[3] == {"主办": "上海"}
    assert [(r.href, r.name) for r in html.event_anchors(df).collect()] == [("/event/12.html", "某某展会")]
    one = df.select("page_id", html.view_model(df.html, "view").alias("v"), html.json_ld(df.html).alias("j")).orderBy("page_id").collect()
    assert json.loads(one[1].v) == {"id": {"b": [1]}} and one[2].j.startDate == "2026-01-01" and one[3].v is None


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "k" / "one").mkdir(parents=True)
    (tmp_path / "k" / "one" / "index.md").write_text('---\ntitle: "T"\nyear: 2025\n---\nBody\n')
    (tmp_path / "k" / "Bad Slug").mkdir()
    (tmp_path / "k" / "Bad Slug" / "index.md").write_text("---\ntitle: x\n---\n")
    got = files.knowledge(spark, f"{tmp_path}/k/*/index.md").collect()
    assert [(r.slug, r.fields["title"], r.body.strip()) for r in got] == [("one", "T", "Body")]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "d").mkdir()
    with zipfile.ZipFile(tmp_path / "d" / "r.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d" / "broken.docx").write_bytes(b"no")
    assert {r.markdown for r in files.documents(spark, f"{tmp_path}/d").collect()} == {None, "# Head\n\nText\n\n| a |\n\n| --- |"}
    assert {r.title: r.kind for r in files.file_rows(spark, f"{tmp_path}/d").collect()} == {"r": "report", "broken": "report"}
    (tmp_path / "j").mkdir()
    for day, n in (("20260101", 1), ("20260201", 2)):
        (tmp_path / "j" / f"acme_{day}.json").write_text(json.dumps({"2001": {"Result": {"Data": n}}}))
    assert [(r.name, r.data) for r in files.raw_api_rows(spark, f"{tmp_path}/j").collect()] == [("acme", "2")]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, v string")
    rows.write.parquet(f"{tmp_path}/in")
    merge = lambda before, batch: batch.groupBy("k").agg({"v": "max"}) if before is None else before
    stream = batches.merge_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", merge)
    stream.awaitTermination(120)
    assert {tuple(r) for r in batches.snapshot(spark, f"{tmp_path}/out", 0).collect()} == {(1, "c"), (2, "b")}


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([("甲 & 乙", 3, None), ("<丙>", None, "x")], "name string, n int, note string")
    (tmp_path / "x").mkdir()
    assert sheets.export_workbook(rows, f"{tmp_path}/x/a.xlsx", {"name": "名称"}, {"note": ["x", "y"]}) == 2
    got = sheets.sheet_rows(spark, f"{tmp_path}/x").orderBy("row_no")
    assert got.columns == ["file_path", "row_no", "#", "名称", "n", "note"]
    assert [tuple(r)[1:] for r in got.collect()] == [(2, "1", "甲 & 乙", "3", ""), (3, "2", "<丙>", "", "x")]
    filled = files.forward_filled(spark.createDataFrame([(1, "A"), (2, ""), (3, "B"), (4, "-")], "i int, c string"), ["c"], "i")
    assert [r.c for r in filled.orderBy("i").collect()] == ["A", "A", "B", "B"]
    assert sheets.export_workbook(rows, f"{tmp_path}/b.xlsx", most=1) == 2
    assert [sheets.cells((tmp_path / name).read_bytes())[1][0] for name in ("b.xlsx", "b-2.xlsx")] == ["1", "2"]
