import numpy as np
import pytest

from fairloom.llm import neighbours


def brute(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in ok if i % every == 0):
        best = sorted((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize("block", [90, neighbours.BLOCK])
def test_recall_scores_and_ties(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    same = rows[40][1]
    rows += [(1000 + i, same) for i in range(60)]  # more ties than places
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] + [0.0] * 6), (2080, [float("inf")] * 8), (None, same), (2100, [1.0] * 7), (2120, [])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        found = [got[q][i] for i in range(1, 21)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
        hits += len({i for i, _ in best} & {i for i, _ in found})
        known = dict(best)
        assert all(s == pytest.approx(known[i], abs=1e-12) for i, s in found if i in known)
    assert hits >= 0.95 * 20 * len(want)
    assert [i for i, _ in (got[40][r] for r in range(1, 21))] == [i for i, _ in want[40]]


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in neighbours.neighbour_report(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def pruned(ids, x, queries, k=20):
    """Recall and the share of all vectors verified, for blocks dealt as the operator deals them."""
    blocks = -(-len(ids) // neighbours.BLOCK)
    dealt = np.random.default_rng(1).integers(0, blocks, len(ids))
    found, verified = {q: [] for q in queries}, 0
    for b in range(blocks):
        index = neighbours.Block(ids[dealt == b], x[dealt == b], float(np.linalg.norm(x, axis=1).max()), neighbours._wanted(k, blocks))
        for q in queries:
            near, score = index.search(int(ids[q]), x[q], k)
            found[q] += zip((-score).tolist(), near.tolist(), strict=True)
        verified += index.verified
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for _, i in sorted(found[q])[:k]} & set(ids[np.argsort(-s)[:k]].tolist()))
    return hits / (k * len(queries)), verified / (len(queries) * len(ids))


def test_counting_prunes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    recall, share = pruned(ids, x, np.flatnonzero(ids % 20 == 0).tolist())
    assert recall >= 0.9 and share < 0.1
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50_000, 64)) + rng.normal(size=(10, 64))[rng.integers(0, 10, 50_000)] * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    recall, share = pruned(np.arange(50_000), x, list(range(0, 50_000, 1_000)))
    assert recall >= 0.9 and share < 0.1


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.neighbour_report(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert neighbours.neighbour_report(one).count() == 0
    three = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0])], schema)
    assert [(r.rank, r.vec_id, r.score) for r in neighbours.neighbour_report(three).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, -1.0), (3, 2, -1.0)]


@pytest.mark.parametrize("kind", ["one long vector", "log-normal"])
def test_unequal_norms_are_pruned_too(spark, kind):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in given], float), np.array([r.vec_id for r in given])
    rng = np.random.default_rng(8)
    if kind == "one long vector":
        x[7] *= 100
    else:
        x *= np.exp(rng.normal(size=len(x)))[:, None]
    df = spark.createDataFrame([(int(i), v.tolist(), "x", 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score string, id int")
    tally = {name: spark.sparkContext.accumulator(0) for name in ("asked", "verified", "blocks")}
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, tally=tally).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, queries = 0, np.flatnonzero(ids % 20 == 0)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
    visited = tally["asked"].value / (len(queries) * tally["blocks"].value)
    verified = tally["verified"].value / (len(queries) * len(ids))
    print(kind, hits / (20 * len(queries)), visited, verified)
    assert hits / (20 * len(queries)) >= 0.9 and verified < 0.15
    assert visited < 0.55 or kind == "one long vector"


@pytest.mark.parametrize("n", [300, 66_000])
def test_collisions_are_counted_as_in_the_sorted_arrays(n):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((n, 8))
    block = neighbours.Block(np.arange(n), vectors, float(np.sqrt((vectors**2).sum(axis=1)).max()), 5)
    m = len(block.ends)
    a, b = np.sort(rng.integers(0, n + 1, (2, m)), axis=0)
    a[0], b[0], a[1], b[1] = 0, n, 7, 7  # all of an array, none of one
    extra = np.sqrt(np.maximum(block.largest**2 - (vectors**2).sum(axis=1), 0))
    order = np.argsort(np.hstack([vectors, extra[:, None]]) @ block.lines, axis=0, kind="stable")
    want = np.bincount(np.concatenate([order[i:j, k] for k, (i, j) in enumerate(zip(a, b, strict=True))]), minlength=n)
    assert (block._counts(block.ends + a, block.ends + b) == want).all()
