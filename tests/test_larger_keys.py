"""Queries on more customers than sf0.1 has. Where the SQL's names repeat every 20,000, each is still a fair of its own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fairloom.plans import batch, catalogue, merging, sourcing


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("customers")
    duckdb.execute(f"copy (select k + turn * 20000 as c_custkey, 'Customer#' || k + turn * 20000 as c_name, (k % 25)::INT as c_nationkey, 'BUILDING' as c_mktsegment from range(100) a(k), range(3) b(turn)) to '{path}/customer.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["cascade_steps", "merge_run_brands", "merge_run_editions", "merge_run_stats", "merge_dry_run"])
def test_same_rows_as_sql_where_shown_names_repeat(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{folder}/customer.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    got = [tuple(r) for r in catalogue.queries()[name](spark, folder).select(*names).collect()]
    assert len(want) == 1 or len(want) > 100
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_run_gets_all_rows_of_both_sites(spark, folder):
    """Site b's rows once were made of site a's where names repeat, and counted before the run."""
    _, a, b = merging._fairs(spark, folder)
    everyone = {k + turn * 20000 for k in range(100) for turn in range(3)}
    assert sorted(r.id for r in a.select("id").collect()) == sorted(k for k in everyone if k % 4 != 1)
    assert sorted(r.id for r in b.select("id").collect()) == sorted(k for k in everyone if k % 4 != 3)
    assert {r.source_url for r in b.select("source_url").collect()} == {f"https://site_b.x/{k}" for k in everyone if k % 4 != 3}


@pytest.mark.parametrize("every_pair", [False, True])
def test_pairs_of_rows_that_show_one_name_are_counted(spark, every_pair):
    kind = "id long, cn_name string, listed_name string, source_url string"
    a = spark.createDataFrame([(1, "X1", "X", "a1"), (2, "X2", "X", "a2"), (3, "Z1", "Z", "a3")], kind)
    b = spark.createDataFrame([(1, "X1", "X", "b1"), (4, "X3", "X", "b4"), (5, "X4", "X", "b5"), (6, "Y1", "Y", "b6"), (7, "Y2", "Y", "b7"), (8, "Y2", "Y", "b8")], kind)
    merged = batch.two_sources(batch.normalised_rows(a), batch.normalised_rows(b), "a", "b", every_pair)
    got = {(r.cn_name, r.data_source, tuple(r.source_urls), r.listings) for r in merged.collect()}
    n = 3 if every_pair else 1
    assert got == {("X1", "a+b", ("a1", "b5"), n), ("X2", "a+b", ("a2", "b5"), n), ("Z1", "a", ("a3",), 1), ("Y1", "b", ("b6",), 1), ("Y2", "b", ("b8",), 2 if every_pair else 1)}


def test_cascade_parts_are_found_in_their_own_names_alone(spark, tmp_path):
    """The fair of 160000 once had 8's characters, one place on, and its id comes first."""
    duckdb.execute(f"copy (select k as c_custkey from (values (3), (8), (53), (160000)) t(k)) to '{tmp_path}/customer.parquet'")
    found = {(r.brand_id, r.step) for r in catalogue.queries()["cascade_steps"](spark, str(tmp_path)).collect()}
    assert found == {("B8", "first 10"), ("B3", "organizer")}


def most_rows(spark, run) -> int:
    """The most rows that a step of the plans behind run() makes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = [0]
    executions = store.executionsList()
    for i in range(before, executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(made)


@pytest.mark.parametrize("name, step", [("concat('杜塞尔', id)", "organizer"), ("concat('上海国际机床', id)", "first 6")])
def test_cascade_names_do_not_meet_all_brands_of_a_word(spark, name, step):
    wanted = spark.range(2000).select(F.expr(name).alias("name"))
    brands = spark.range(1000).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("brand_id"), F.concat(F.lit("上海国际机床展览会第"), F.col("id").cast("string")).alias("name_cn"), F.lit("").alias("name_en"), F.lit("德国杜塞尔多夫展览公司").alias("organizer"))
    found = []
    most = most_rows(spark, lambda: found.extend(batch.cascade_matches(wanted, brands).collect()))
    assert len(found) == 2000 and {(r.brand_id, r.step) for r in found} == {("B0", step)}
    assert 2000 <= most < 100_000


def test_pages_of_one_small_file_are_dealt(spark, tmp_path):
    """A small file of many customers is one task to read; the pages made of it are many."""
    duckdb.execute(f"copy (select k as c_custkey, 'C' || k as c_name, (k % 25)::INT as c_nationkey, 'BUILDING' as c_mktsegment from range(130000) a(k)) to '{tmp_path}/customer.parquet'")
    pages = sourcing._category_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() == 7 and pages.count() == 130000
