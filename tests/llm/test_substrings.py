import hashlib
import random

import pytest

from fairloom.llm import substrings

WIDTH = 13


def plain(rows):
    """One result for each row, by the definition."""
    split = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - WIDTH + 1) if k is not None else ():
            g = tuple(w[i : i + WIDTH])
            first[g] = min(first.get(g, k), k)
    out = []
    for (k, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - WIDTH + 1) if k is not None else ():
            if first[tuple(w[i : i + WIDTH])] < k:
                gone |= set(range(i, i + WIDTH))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows_with_repeats(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É.", "x\x1cy", " "]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(k) for k in (12, 13, 14, 40, 80, 13)]
    rows = []
    for i in range(n):
        parts = [line(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared).split(" ")
            a = rng.randint(0, 3)
            parts += [" ".join(s[a:]), line(rng.randint(0, 20))]
        rows.append((rng.randint(0, 10_000), " \n\t".join(parts)))
    rows += [(k + 1, t) for k, t in rows[:6]]  # copies
    rows += [rows[0], rows[1], (rows[2][0], "other text under the same id " + shared[3])]  # repeated rows, a clashing id
    rows += [(20_000, None), (20_001, ""), (20_002, " \t\n"), (None, shared[4]), (None, None), (20_003, "a " * 4000), (20_004, "a " * 4000 + line(20)), (-5, shared[4] * 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "bits", "block"), [(1, 64, 10**9), (2, 64, 600), (3, 9, 600), (4, 6, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, bits, block):
    """Few bits make edges collide, which the digests have to sort out."""
    rows = rows_with_repeats(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", "1 as tag", "2 as own")
    got = substrings.removal_report(df, bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_empty_table(spark):
    assert substrings.removal_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_paths_of_the_graph(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{a} {b}"), (2, f"x {a} y"), (3, f"{a}"), (4, f"z {b}")], "doc_id long, text string")
    paths = {(r.src, r.src_start, r.edges): r.walks for r in substrings.repeated_paths(docs).collect()}
    assert paths == {(1, 0, 28): 3, (1, 40, 18): 2}
    # a walk that leaves in the middle makes the path branch there
    docs = docs.union(spark.createDataFrame([(5, " ".join(a.split()[:20]) + " q")], docs.schema))
    paths = {(r.src, r.src_start, r.edges): r.walks for r in substrings.repeated_paths(docs).collect()}
    assert paths == {(1, 0, 8): 4, (1, 8, 20): 3, (1, 40, 18): 2}
