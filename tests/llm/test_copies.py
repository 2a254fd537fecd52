"""Edited copies against exact Jaccard similarities of all pairs."""

import random

import pytest

import corpus_pipeline
from fairloom.llm import copies

SF = "/root/testdata/sf0.001"


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The smallest key of every group over pairs of similarity 0.8 or more."""
    sets = {k: plain_sets(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k for k in keys if root(k) == k}


@pytest.mark.parametrize("chunk", [7, 2_000])
def test_stage_drops_edited_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(copies, "CHUNK_TEXTS", chunk)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    deal = random.Random(3)
    for k in range(25):
        words = [f"w{deal.randrange(5000)}" for _ in range(deal.randrange(60, 400))]
        rows.append((10_000 + 10 * k, " ".join(words)))
        for n in range(1, 6 if k else 10):
            edited = list(words)
            for at in deal.sample(range(len(words)), max(1, n * len(words) // 100)):
                edited[at] = "edited"
            rows.append((10_000 + 10 * k + n, "  ".join(edited).upper()))
    rows += [(20_000, "a b"), (20_001, "A\tb"), (20_002, None), (20_003, " \n"), (20_004, "")]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], schema)
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    want = plain_kept(rows)
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert {1, 6} <= want and not {177, 145} & want and len([k for k in want if 10_000 <= k < 20_000]) < 25 * 6
