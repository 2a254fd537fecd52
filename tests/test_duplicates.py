"""Duplicate pairs and review layers against plain loops, and how many pairs of a hot organizer are looked at."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from fairloom.functions.text import normalize_name, norm_en
from fairloom.operators import similarity as S
from fairloom.plans.governing import _fairs


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def plain_pairs(rows):
    """Every pair, level by level, in the order of organizer, city and name."""
    clean = lambda x: (x or "").strip()
    rows = sorted({tuple(r) for r in rows}, key=lambda r: (clean(r[2]), clean(r[3]), r[1] or "", r[0]))
    found = {}
    for i, (ia, _, oa, ca, sa, l1a, l2a, na) in enumerate(rows):
        for ib, _, ob, cb, sb, l1b, l2b, nb in rows[i + 1 :]:
            if ia == ib:
                continue
            org, city = clean(oa) == clean(ob) and clean(oa) not in ("", "test") and bool(na and nb), clean(ca) == clean(cb) and clean(ca) != ""
            sim = ratio(na, nb)
            fits = lambda x, y: not clean(x) or not clean(y) or clean(x) == clean(y)
            sa_, sb_ = sa or "", sb or ""
            month = len(sa_) >= 7 and len(sb_) >= 7 and sa_[5:7] == sb_[5:7]
            level = (
                0 if org and city and sa_ and sa_ == sb_ and sim >= 0.80 else 1 if org and city and month and sim >= 0.85 else 2 if na == nb and len(na) >= 4
                else 3 if org and city and fits(l2a, l2b) and sim >= 0.80 else 4 if org and fits(l1a, l1b) and sim >= 0.75 else None
            )
            if level is not None:
                key = tuple(sorted((ia, ib)))
                old = found.get(key, (9, 0.0))
                found[key] = (min(old[0], level), max(old[1], round(sim, 4)))
    return {k: (S.LEVELS[v], s) for k, (v, s) in found.items()}


KIND = "id long, name string, organizer string, city string, start string, l1 string, l2 string"


def drawn(n, seed):
    rng = random.Random(seed)
    words = ["机床", "食品", "国际", "博览会", "技术", "2026年", "a"]
    pick = lambda *x: rng.choice(x)
    return [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 6))) or None, pick("甲", "甲", "甲", "甲", "乙", "test", None), pick("上海", "上海", "北京", "", None),
             pick("2026-05-06", "2025-05-01", "2026-06-01", "2026", "", None), pick("机", "食", "", None), pick("x", "y", "", None)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicate_pairs_are_all_pairs_levels(spark, seed):
    brands = spark.createDataFrame([*(rows := drawn(200, seed)), rows[3], (rows[4][0], *rows[5][1:])], KIND)
    normed = brands.select("*", normalize_name(F.coalesce("name", F.lit(""))).alias("norm")).collect()
    got = {(r.a, r.b): (r.level, r.sim) for r in S.duplicate_pairs(brands).collect()}
    assert got == plain_pairs(normed) and len({v[0] for v in got.values()}) >= 4


def plain_layers(rows, threshold=0.80):
    found = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a.org != b.org or a.org in ("", "test") or a.city != b.city or a.city == "":
                continue
            sim = ratio(a.norm, b.norm)
            there = a.place != "" and a.place == b.place
            layer = (
                "A1" if a.norm and a.norm == b.norm else "A2" if sim >= threshold else "B" if there and a.en and a.en == b.en
                else "C" if there and a.start and a.start == b.start and a.end == b.end else None
            )
            if layer:
                found.add((b.id, a.id, layer, round(sim, 4)) if b.editions > a.editions else (a.id, b.id, layer, round(sim, 4)))
    return found


def plain_review(brands):
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = brands.select("id", "start", "end", "editions", clean("organizer").alias("org"), clean("city").alias("city"), normalize_name(F.col("name")).alias("norm"), norm_en(F.col("name_en")).alias("en"), clean("venue").alias("place"))
    return plain_layers(rows.orderBy("id").collect())


def test_review_layers_are_all_pairs_layers(spark):
    rng = random.Random(4)
    rows = [(*r[:5], rng.choice(["2026-05-08", "", None]), rng.choice(["Fair A", "fair a", "", "", "", None]), rng.choice(["馆", "馆 ", "", None]), rng.randint(0, 3)) for r in drawn(400, 9)]
    brands = spark.createDataFrame(rows, "id long, name string, organizer string, city string, start string, end string, name_en string, venue string, editions int")
    got = {tuple(r) for r in S.review_layers(brands).select("keep", "merge", "layer", "sim").collect()}
    assert got == plain_review(brands) and {r[2] for r in got} == {"A1", "A2", "B", "C"}


def test_registered_queries_on_the_whole_small_tables(spark):
    fairs = _fairs(spark, "/root/testdata/sf0.001")
    normed = fairs.select("id", "name", "organizer", "city", "start", "l1", "l2", normalize_name(F.col("name")).alias("norm")).collect()
    assert {(r.a, r.b): (r.level, r.sim) for r in S.duplicate_pairs(fairs).collect()} == plain_pairs(normed)
    assert {tuple(r) for r in S.review_layers(fairs).select("keep", "merge", "layer", "sim").collect()} == plain_review(fairs)


def test_few_pairs_of_a_hot_organizer_are_candidates(spark):
    """20,000 names of one organizer: characters of their subjects are rare, the rest is common to all."""
    n = 20_000
    signs = lambda k: F.decode(F.unhex(F.concat(*[F.hex((F.col("id") * m) % 6000 + 19968) for m in k])), "UTF-16BE")
    rows = spark.range(n).select(F.lit("hot").alias("block"), F.concat(F.lit("国际"), signs((7919, 104729, 1299709)), F.lit("博览会")).alias("s"))
    pairs = S.block_candidates(rows, 0.75).count()
    assert 0 < pairs < 0.05 * n * (n - 1) / 2
