"""Fingerprints and links against a plain implementation of the definition."""

import re

import numpy as np
import pytest
import xxhash

from fairloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, fps, budget=3):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = {}
    for i in range(len(fps)):
        out.setdefault(root(i), []).append(keys[i])
    return {k: min(v) for v in out.values() for k in v}


TEXTS = ["", None, "one", "One\ttwo", "a b c d e f g h", "A b c d e f g h", "a b c d e f g h", "x" * 50_000, "é É ß " * 50, "w " * 3000 + "z", " \n"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_report_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect() + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("FP", docs.sparkSession.range(1).count() * __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r.doc_id: r for r in simhash.component_report(df).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([k for k, _ in rows], fps)
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{f:016x}" for (k, _), f in zip(rows, fps, strict=True)}


@pytest.mark.parametrize("limit", [10, 30_000])
def test_trie_links_connect_what_is_near(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 20, dtype=np.int64)
    values = set(base.tolist())
    for b in base.tolist() + [int(base[0])] * 300:
        v = b
        for bit in rng.choice(63, rng.integers(1, 7), replace=False).tolist():
            v ^= 1 << bit
        values.add(v)
    values = sorted(values)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), node_limit=limit).collect()
    assert all((a ^ b).bit_count() < 64 for a, b in links)
    want = plain_components(values, values)
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {v: root(v) for v in values} == want


def test_empty_table_and_kept_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.component_report(empty).count() == 0
    docs = spark.createDataFrame(
        [(1, "a b c d e", "en", "s", 9), (2, "A b c d e", None, None, None), (3, "other words stand here now", "en", "s", 1), (3, "other words stand here now", "en", "s", 1), (None, "a b c d e", "en", "s", 9), (5, None, "en", "s", 0), (6, "", "en", "s", 0)],
        SCHEMA,
    )
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5]
    assert kept.where("doc_id is null").count() == 1
