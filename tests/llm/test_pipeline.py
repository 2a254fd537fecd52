"""The pipeline against a plain version of its stages, on a small table."""

import re
import zlib

import numpy as np
import pyarrow as pa
from test_copies import plain_kept
from test_decontamination import words as bench_words
from test_secrets import plain as plain_secrets
from tokenizers import Tokenizer

import corpus_pipeline
from fairloom.llm import packing, toxicity

SF = "/root/testdata/sf0.001"


def plain_clean(text, items):
    """The text without words inside occurrences of item windows, each run with what stands between its words."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    w = [low[a:b] for a, b in spots]
    hit = np.zeros(len(w) + 1, bool)
    for _, body in items:
        v = bench_words(body)
        size = min(10, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if v else 0):
            if tuple(w[i : i + size]) in grams:
                hit[i : i + size] = True
    out, at, i = "", 0, 0
    while i < len(w):
        if hit[i]:
            j = i
            while hit[j + 1]:
                j += 1
            out += text[at : spots[i][0]]
            at, i = spots[j][1], j
        i += 1
    return out + text[at:], int(hit.sum()), len(w)


def plain_redacted(text):
    out, at = "", 0
    for start, _, _, end in plain_secrets(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    scores, _ = model.scores(pa.array(rows.values()))
    rows = {k: t for (k, t), p in zip(rows.items(), scores, strict=True) if p < 0.5}
    kept = plain_kept(list(rows.items()))  # the stage's own rule: five-word shingles, similarity 0.8
    rows = {k: t for k, t in rows.items() if k in kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {k: plain_clean(t, items) for k, t in rows.items()}
    rows = {k: t for k, (t, hit, n) in rows.items() if hit <= n / 2}
    rows = {k: plain_redacted(t) for k, t in rows.items()}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for k, t in rows.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for n, a in enumerate(range(0, len(ids), 2048)):
            want[k, n] = (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 150_000)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_an_id_with_several_texts_keeps_them(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf_ int, blob int, row_ int"
    docs = spark.createDataFrame([(1, "alpha beta", "en", "s", 10, 1, 2, 3), (2, "gamma delta", "en", "s", 11, 1, 2, 3), (2, "alpha beta", "en", "s", 10, 1, 2, 3), (2, "gamma delta", "en", "s", 11, 1, 2, 3)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(tuple(r) for r in docs.collect()) == [(1, "alpha beta", "en", "s", 10, 1, 2, 3), (2, "gamma delta", "en", "s", 11, 1, 2, 3)]
