"""Containment, answers, categories and nested records on odd rows."""

import random

from pyspark.sql import functions as F

from fairloom.operators.containment import containing
from fairloom.sources import anchored, answers, categories, html


def test_containing_is_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab展会") for _ in range(rng.randint(0, n)))
    texts, strings = [word(14) for _ in range(80)] + [None], [word(5) for _ in range(60)] + [None, "", "展"]
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = {tuple(r) for r in containing(df(texts, "t_"), df(strings, "s_"), "t_", "s_").collect()}
    assert got == {(t, s) for t in texts for s in strings if t and s and s in t} and len(got) > 100
    plan = containing(df(texts, "t_"), df(strings, "s_"), "t_", "s_")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_answers_of_odd_shapes(spark):
    rows = [
        ("a", "886", '{"Status":200,"Result":{"not":"a list"}}', "1"), ("a", "2001", '{"Status":"200","Result":[1]}', "1"), ("a", "740", '{"Status":"200","Result":{"VerifyResult":0,"Data":{}}}', "1"),
        ("a", "718", '{"Status":"200","Result":null,"Paging":null}', "1"), ("a", "958", "not json", "1"), ("a", "958", '{"Status":"200","Result":[{"Title":"old"}]}', "0"),
        ("b", "2001", '{"Status":"101"}', "1"), ("c", None, None, None), (None, "718", '{"Status":"200","Result":[{"Title":"x"}],"Paging":{"TotalRecords":7}}', None),
    ]
    got = {r.company: r for r in answers.unwrapped(spark.createDataFrame(rows, "company string, code string, answer string, moment string")).collect()}
    a = got["a"]
    assert (a.hits, a.verified, a.dishonest, a.findings, a.jobs, a.n_jobs, a.tenders) == ([], None, False, [], [], 0, None)
    assert got["b"].verified is None and got["b"].hits is None and got["c"].jobs is None
    assert got[None].n_jobs == 7 and got[None].jobs[0].title == "x" and len(got) == 4
    assert answers.unwrapped(spark.createDataFrame([], "company string, code string, answer string, moment string")).count() == 0


def test_tree_with_cycles_and_orphans(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, 3), (10, 11), (11, 12), (12, 10), (13, 10), (14, 13), (20, 99), (21, 20), (30, 30)] + [(100 + i, 100 + i - 1 if i else None) for i in range(40)]
    closure, refused = categories.ancestors(spark.createDataFrame(edges, "node long, parent long"))
    got = {(r.node, r.ancestor, r.distance) for r in closure.collect()}
    assert {(r.node, r.reason) for r in refused.collect()} == {(10, "cycle"), (11, "cycle"), (12, "cycle"), (13, "cycle"), (14, "cycle"), (30, "cycle"), (20, "orphan")}
    assert got == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2), (4, 1, 3), (21, 20, 1)} | {(100 + i, 100 + j, i - j) for i in range(40) for j in range(i)}
    empty = categories.ancestors(spark.createDataFrame([], "node long, parent long"))
    assert empty[0].count() == empty[1].count() == 0


def test_category_files_round_trip(spark, tmp_path):
    parents = spark.createDataFrame([(f"p{i}", f"u{i}", str(i)) for i in range(30)], categories.PARENT)
    children = spark.createDataFrame([(f"c{i}", str(i), str(i % 30)) for i in range(70)], categories.CHILD)
    for most in (1000, 7):
        path = str(tmp_path / str(most))
        categories.write_categories(parents.repartition(3), children.repartition(3), path, "now", most)
        a, b = categories.read_categories(spark, path)
        assert sorted(a.collect()) == sorted(parents.collect()) and sorted(b.collect()) == sorted(children.collect())
    first = spark.read.schema(categories.FILE).option("multiLine", "true").json(str(tmp_path / "1000")).first()
    assert [p.parent_id for p in first.parent_categories] == [str(i) for i in range(30)] and first.crawled_at == "now"


def test_nested_records_and_detail_pages_without_parts(spark):
    one = '{"public_id":"p","location":{"city":"c"},"tags":["a","b"],"exhibitors":[{"public_id":"x","name":"X"},{"name":"keyless"}]}'
    other = '{"public_id":"q","location":{"city":"d","hall":"h"},"tags":["b","z"],"stats":{"k":"1"},"exhibitors":[{"public_id":"x","booth":"7"}]}'
    rows = spark.createDataFrame([(1, one, other), (2, one, None), (3, None, other), (4, None, None)], "id int, a string, b string")
    rows = rows.select("id", F.from_json("a", html.FAIR).alias("a"), F.from_json("b", html.FAIR).alias("b"))
    got = {r.id: r for r in rows.select("id", *[v.alias(n) for n, v in html.two_paths(F.col("a"), F.col("b"), {"exhibitors": "public_id"}).items()]).collect()}
    assert (got[1].public_id, tuple(got[1].location), got[1].tags, got[1].stats) == ("p", ("c", "h"), ["a", "b", "z"], {"k": "1"})
    assert [tuple(e) for e in got[1].exhibitors] == [("x", "X", "7"), (None, "keyless", None)]
    assert got[1].origin == {"public_id": "first", "location": "both", "tags": "both", "stats": "second", "exhibitors": "both"}
    assert got[2].public_id == "p" and got[3].public_id == "q" and set(got[3].origin.values()) == {"second"} and got[4].public_id is None and got[4].origin == {}
    page = '<div data-lingxi-preview-fields="x officialWebsite"><a href=" https://w ">w</a></div><div data-lingxi-preview-fields="statisticsInfoList"><div><div><span>438</span></div><p>家</p></div></div><a href="/exhibitor/9" aria-label="Nine">n</a>'
    full = html.two_path_rows(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert (full[0].official_website, full[0].stats, [e.name for e in full[0].exhibitors]) == ("https://w", {"家": "438"}, ["Nine"]) and full[1].public_id is None
    pages = spark.createDataFrame([(None,), ("",), ("<title>A展-中国会展网</title><p>时间：2026.01.02</p><p>主办单位：甲</p>",)], "html string")
    none, blank, some = anchored.anchored_rows(pages).collect()
    assert none.cn_name is None and none.year == 0 and blank.organizer is None
    assert (some.cn_name, some.date_str, some.year, some.organizer, some.city) == ("A展", "2026.01.02", 2026, "甲", None)


def test_sitemaps_plain_gzip_and_broken(spark, tmp_path):
    import gzip

    from fairloom.sources import files

    urls = [f"https://x.example/e/{i}.html?a=1&amp;b={i}" if i % 2 else f"https://x.example/e/{i}" for i in range(500)]
    body = ("<urlset>" + "".join(f"<url><loc> {u}\n</loc></url>" for u in urls) + "</urlset>").encode()
    (tmp_path / "plain.xml").write_bytes(body)
    (tmp_path / "packed.xml.gz").write_bytes(gzip.compress(body))
    (tmp_path / "broken.xml.gz").write_bytes(gzip.compress(body)[:60])
    (tmp_path / "empty.xml").write_bytes(b"<urlset/>")
    (tmp_path / "index.xml").write_bytes(b"<sitemapindex><sitemap><loc>https://x.example/packed.xml.gz?v=2</loc></sitemap></sitemapindex>")
    rows = files.sitemaps(spark, str(tmp_path)).collect()
    by = lambda end: [r for r in rows if r.file_path.endswith(end)]
    assert len(by("plain.xml")) == len(by("packed.xml.gz")) == 500 and {r.url for r in by("plain.xml")} == {r.url for r in by("packed.xml.gz")}
    assert {r.id for r in by("plain.xml")} == {None} | {str(i) for i in range(0, 500, 2)} and by("plain.xml")[1].url.endswith("a=1&b=1")
    assert {r.listed_by is not None for r in by("packed.xml.gz")} == {True} and by("plain.xml")[0].listed_by is None
    assert [(r.kind, r.url) for r in by("broken.xml.gz")] == [(None, None)] and by("broken.xml.gz")[0].problem
    assert [(r.kind, r.url, r.problem) for r in by("empty.xml")] == [("urls", None, None)]
    whole = files.sitemap_entries(gzip.compress(body))
    assert files.sitemap_entries(gzip.compress(body), 7) == whole and files.sitemap_entries(body, 3) == whole


def test_leftover_columns_and_many_workbooks(spark, tmp_path):
    from fairloom.sources import sheets

    rows = spark.createDataFrame([(str(i), f"n{i}", " x " if i % 2 else "", None if i % 3 else "y", i) for i in range(23)], "a string, b string, c string, d string, n int").orderBy("n")
    got = {r.a: r.notes for r in sheets.with_leftovers(rows.drop("n"), ["a", "b"]).collect()}
    assert got["0"] == '{"d":"y"}' and got["3"] == '{"c":"x","d":"y"}' and got["2"] is None and got["1"] == '{"c":"x"}'
    assert sheets.export_workbook(rows, str(tmp_path / "out.xlsx"), {"a": "A"}, most=10) == 23
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out-2.xlsx", "out-3.xlsx", "out.xlsx"]
    third = sheets.cells((tmp_path / "out-3.xlsx").read_bytes())
    assert third[0][:3] == ["#", "A", "b"] and [r[0] for r in third[1:]] == ["21", "22", "23"] and third[1][1] == "20"
