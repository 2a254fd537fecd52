"""Names of a run matched one after another, against a plain loop."""

import difflib
import random

import pytest

from fairloom import schema
from fairloom.operators.leaders import numbered_in_order, ordered_leaders
from fairloom.plans import batch as B

RAW = "id long, cn_name string, date_str string, city string, source_url string, crawl_batch_id string"


def one_by_one(names, known, accept=0.90, margin=0.05):
    """What each name matches if every new one becomes known at its turn."""
    there, out = list(known), []
    for name in names:
        best = second = 0.0
        key = None
        for k, other in there:
            r = difflib.SequenceMatcher(None, name, other).ratio()
            if r > best:
                best, second, key = r, best, k
            elif r > second:
                second = r
        if best >= accept and (best - second if second > 0 else 1.0) >= margin:
            out.append((name, key))
        else:
            there.append((name, name))
            out.append((name, name))
    return out


def drawn(n, seed):
    """Invented fair names, with years, typing errors and families of many variants."""
    rng = random.Random(seed)
    cities, things = "上海 北京 广州 成都 西安 武汉 青岛 深圳".split(), "机床 食品 纺织 印刷 汽车 家具 医疗 能源 化工 农业 塑料 玩具".split()
    names = set()
    while len(names) < n:
        name = f"{rng.choice(['', '中国', '第十届', '国际'])}{rng.choice(cities)}{rng.choice(['国际', ''])}{rng.choice(things)}{rng.choice(['装备', '机械', '技术', ''])}{rng.choice(['展览会', '博览会', '展', '交易会'])}{rng.choice(['', '2025', '2026', '(春季)', '暨论坛'])}"
        if rng.random() < 0.5:
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice("新大亚东xyz") + name[i:]
        names.add(name)
    names = sorted(names)
    rng.shuffle(names)
    return names


@pytest.mark.parametrize(("n", "seed", "n_known"), [(2000, 1, 300), (60, 2, 0), (300, 3, 5)])
def test_same_as_one_by_one(spark, n, seed, n_known):
    names = drawn(n + n_known, seed)
    known = [(f"K{i}", x) for i, x in enumerate(names[:n_known])]
    want = dict(one_by_one(names[n_known:], known))
    df = spark.createDataFrame([(x, i) for i, x in enumerate(names[n_known:])], "name string, place int")
    got = {r.name: r.known_key or r.leader for r in ordered_leaders(df, spark.createDataFrame(known, "key string, name string")).collect()}
    assert got == want and sum(k == v for k, v in want.items()) < n + (n < 100)


def test_a_chain_settles_in_turn(spark):
    """Each name is close to its neighbours only: every second becomes a leader, however long the chain."""
    rows = [("abcdefghijklmnopqrst"[i:] + "0123456789ABCDEFGHIJ"[:i], i) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, place int")
    got = {r.name: r.known_key or r.leader for r in ordered_leaders(df, spark.createDataFrame([], "key string, name string")).collect()}
    assert got == dict(one_by_one([n for n, _ in rows], []))


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(7)
    assert [(r.v, r.n) for r in numbered_in_order(df, "v").orderBy("v").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered_in_order(df.limit(0), "v").count() == 0


def test_merge_run_matches_new_names_with_each_other(spark):
    names = drawn(120, 5)
    old, a_names, b_names = names[:30], names[30:90], names[80:120]
    a = [(i, n, "2026年05月06日~05月08日", "上海", f"https://site_a.x/{i}", "B1") for i, n in enumerate([*a_names, "  ", None])]
    b = [(i, n, "2026年05月06日~05月08日", "上海", f"https://site_b.x/{i}", "B1") for i, n in enumerate([*reversed(b_names), ""])]
    brands = schema.empty(spark, "exhibition_brand").unionByName(spark.createDataFrame([(f"EXPO-{i + 1:04d}", n) for i, n in enumerate(old)], "brand_id string, name_cn string"), allowMissingColumns=True)
    state = [brands, schema.empty(spark, "exhibition_edition"), schema.empty(spark, "data_provenance")]
    frames = [spark.createDataFrame(x, RAW).repartition(3) for x in (a, b)]
    out = B.merge_run(*state, *frames, "B1", "2026-01-01")
    turns = [*a_names, *(n for n in reversed(b_names) if n not in a_names)]
    want, count = {}, len(old)
    for name, key in one_by_one(turns, [(f"EXPO-{i + 1:04d}", n) for i, n in enumerate(old)]):
        count += key == name
        want[name] = f"EXPO-{count:04d}" if key == name else want.get(key, key)
    made = {r.name_cn: r.brand_id for r in out["brands"].collect()}
    assert {n: i for n, i in made.items() if n not in old} == {n: want[n] for n in want if list(want.values()).index(want[n]) == list(want).index(n) and want[n] > f"EXPO-{len(old):04d}"}
    stats = out["stats"].first().asDict()
    assert stats == {"rows": len(turns), "brands_created": count - len(old), "brands_matched": len(turns) - count + len(old), "editions_upserted": len(turns), "provenance_written": 100, "skipped": 2, "in_both": 10}
    assert out["editions"].select("brand_id").distinct().count() == len(set(want.values()))
    dry = B.merge_run(*state, *frames, "B1", "2026-01-01", dry_run=True)
    known = [(i, n) for i, n in ((r.brand_id, r.name_cn) for r in brands.collect())]
    fresh = sum(one_by_one([n], known)[0][1] == n for n in turns)
    assert list(dry) == ["stats"] and dry["stats"].first().brands_created == fresh and dry["stats"].first().editions_upserted == 0
