import numpy as np
import pytest
from pyspark.sql import functions as F

from fairloom.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def network(docs):
    return language.train(docs)


def test_held_out_accuracy(docs, network):
    got = language.identify(docs.select("doc_id", "text", "lang"), network).join(docs.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 as held"), "doc_id").where("held").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_every_byte_counts_and_windows_pool(network):
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abc é.\n"), 700))
    both = network.documents(language.pa.array([text, text + text, None, "", "...", "é" * 40_000]))
    assert both.shape == (6, len(network.languages))
    raw = language._FOLD[np.frombuffer(text.encode(), np.uint8)]
    total, letters = np.zeros(len(network.languages)), 0
    for a in range(0, len(raw), language.WINDOW):
        part = np.zeros(language.WINDOW, np.uint8)
        part[: len(raw[a : a + language.WINDOW])] = raw[a : a + language.WINDOW]
        mask = language._LETTER[part]
        total += network.positions(part[:, None])[:, :, 0][:, mask].sum(axis=1)
        letters += mask.sum()
    np.testing.assert_allclose(both[0], total / letters, rtol=1e-4)
    assert both[2].sum() == both[3].sum() == both[4].sum() == 0 and abs(both[5].sum() - 1) < 1e-5


def test_backpropagation_lowers_the_loss():
    rng = np.random.default_rng(1)
    windows = np.concatenate([rng.integers(97, 105, (60, 20)), rng.integers(103, 111, (60, 20))]).astype(np.uint8)
    labels = np.repeat([0, 1], 60)
    network = language.fit(list(windows), labels, ["x", "y"])
    p = network.positions(windows.T).mean(axis=1).T
    assert (p.argmax(axis=1) == labels).mean() > 0.98


def test_columns_that_clash_and_repeated_ids(spark):
    rows = [(i, "the house and of it" if i % 2 else "der und das ist ein", "en" if i % 2 else "de", 1, 2, 3, 4, 5) for i in range(40)]
    df = spark.createDataFrame(rows + rows[1:2] * 60, "doc_id long, text string, lang string, picked int, o int, read_ int, h int, score int")
    out = language.identify(df, language.train(df)).collect()
    assert len(out) == 100 and all((r.picked, r.o, r.read_, r.h) == (1, 2, 3, 4) and r.lang_pred == r.lang for r in out)
    assert language.language_report(df).count() == 100


def plain_document(network, text):
    """The network's distribution for a text, byte by byte in plain Python."""
    raw = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    total, letters = np.zeros(len(network.languages)), 0
    for a in range(0, len(raw), language.WINDOW):
        part = raw[a : a + language.WINDOW].ljust(language.WINDOW, b"\0")
        states = []
        for way in (0, 1):
            h, seen = np.zeros(language.HIDDEN), {}
            for t in range(language.WINDOW) if way == 0 else reversed(range(language.WINDOW)):
                x, s = network.embed[way][:, part[t]].astype(float), network.recur[way].astype(float) @ h
                k = language.HIDDEN
                z, r = (np.clip(0.2 * (x[i * k : (i + 1) * k] + s[i * k : (i + 1) * k]) + 0.5, 0, 1) for i in (0, 1))
                new = np.tanh(x[2 * k :] + r * s[2 * k :])
                h = z * h + (1 - z) * new
                seen[t] = h
            states.append(seen)
        for t, c in enumerate(raw[a : a + language.WINDOW]):
            if 97 <= c <= 122 or c >= 128:
                logits = network.out.astype(float) @ np.concatenate([states[0][t], states[1][t]]) + network.bias[:, 0]
                p = np.exp(logits - logits.max())
                total += p / p.sum()
                letters += 1
    return total / max(letters, 1)


def test_report_matches_plain_python(spark, docs, network):
    some = docs.orderBy("doc_id").limit(12)
    for r in language.identify(some.select("doc_id", "text"), network).collect():
        if r.text and len(r.text) < 3_000:
            p = plain_document(network, r.text)
            assert r.lang_pred == network.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-3


def test_odd_rows(spark, docs, network):
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 2), (3, "12 - 3!", "en", 3), (None, "the and of", None, 4), (3, "12 - 3!", "en", 3)], SCHEMA)
    got = {(r.doc_id, r.lang_pred, r.score == 0) for r in language.identify(odd, network).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= got and len(got) == 4
    report = language.language_report(odd.limit(0)).collect()
    assert report == []
    assert {r.lang_pred for r in language.language_report(odd.where("lang is null")).collect()} == {"und"}


def test_a_very_long_text_does_not_shut_out_its_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    usable = docs.where((F.col("lang") == "en") & (language.fold("doc_id") != 0) & (F.length("text") > 100))
    first = usable.orderBy(F.xxhash64("doc_id")).first()
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first.doc_id, F.repeat("text", 3_000_000 // len(first.text) + 1)).otherwise(F.col("text")))
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}

    def right(df):
        return [r.lang_pred == lang[r.doc_id] for r in language.language_report(df).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]

    before, after = right(docs), right(longer)
    assert np.mean(before) > 0.95 and abs(np.mean(before) - np.mean(after)) < 0.02


def test_stretches_come_from_the_whole_text(spark):
    df = spark.createDataFrame([("é" * 50 + "b" * 100 + "c" * 1000 + "z" * 50,), ("short",)], "text string").withColumn("n", F.octet_length("text"))
    long, short = (r[0] for r in df.select(language.spread("text", "n", 320)).collect())
    assert short == "short" and long.startswith("é") and long.endswith("z") and 250 < len(long.encode()) < 400 and "b" in long and "c" in long
