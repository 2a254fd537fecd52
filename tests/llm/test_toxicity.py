import re

import numpy as np
import pyarrow as pa
import pytest

from fairloom.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


def test_held_out_labels(tables, model):
    docs, labels = tables
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.fold("doc_id") == 0).toPandas()
    toxic, clean = scored[scored.toxic == 1].score.to_numpy(), scored[scored.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2 > 0.95
    assert (clean < 0.5).mean() > 0.99 and (toxic >= 0.5).mean() > 0.83


def test_scores_are_noisy_or_of_sentences(model):
    words = {int(k): float(w) for k, w in zip(model.keys, model.weights, strict=True)}
    texts = ["You idiot. A clown walks! Fine words", "nothing here", "", None, "scum " * 20_000, "a.b!c?\nd"]
    p, n = model.scores(pa.array(texts))
    for text, got in zip(texts, p, strict=True):
        sure = 0.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            w, stems, *_ = toxicity.sentence_words(pa.array([sentence]))
            if len(w):
                logit = model.bias + sum(words.get(h, 0.0) for h in {int(h) for h in [*w, *stems]})
                sure += np.logaddexp(0, logit)
        assert got == pytest.approx(1 - (1 - model.leak) * np.exp(-sure), abs=1e-9)
    assert n[0] >= 1 and n[1] == 0 and p[2] == p[3] == pytest.approx(model.leak)


def test_offending_sentences_are_located(spark, model):
    df = spark.createDataFrame([(1, "Éa be. The idiot and the scum stand here! Of it."), (2, None), (3, "clean")], "doc_id long, text string")
    got = toxicity.offending_sentences(df, model).collect()
    assert [(r.doc_id, r.sentence) for r in got] == [(1, "The idiot and the scum stand here")]
    assert df.first().text[got[0].start : got[0].end] == got[0].sentence


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    owner = np.repeat(np.arange(20), 3)
    bags = toxicity.Bags(rng.integers(0, 6, 100), np.sort(rng.integers(0, 60, 100)), owner, rng.integers(0, 4, 20).astype(float), rng.integers(0, 2, 20), rng.uniform(0.5, 2, 20))
    params = np.concatenate([rng.uniform(0, 2, 6), [-2.0, -3.0]])

    def loss(p):
        logit = p[-2] + np.bincount(bags.sentence, p[bags.word], minlength=60)
        clean = np.log1p(-1 / (1 + np.exp(-p[-1]))) - np.bincount(owner, np.log1p(np.exp(logit)), minlength=20) - bags.plain * np.log1p(np.exp(p[-2]))
        return -(bags.scale * np.where(bags.labels == 1, np.log1p(-np.exp(clean)), clean)).sum()

    got = bags.gradient(params[:-2], params[-2], params[-1])
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-6, rel=1e-4)


def test_weights_are_learned_and_samples_bounded(tables, model):
    """Weights start at zero: without the penalty's survivors there are none; a sample of no bytes gives no model."""
    assert 5 < len(model.keys) < 200 and (model.weights >= 0).all()
    assert not len(toxicity.train(*tables, size=0).keys)
    small = toxicity.train(*tables, size=400_000)
    assert len(small.keys) <= len(model.keys) * 3


def test_odd_tables(spark, tables):
    docs = spark.createDataFrame([(1, None, 5), (None, "idiot", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert max(r.score for r in toxicity.toxicity_report(docs, none).collect()) < 1e-5
    one = spark.createDataFrame([(2, 1, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_report(docs, one).count() == 4
    assert toxicity.toxicity_report(docs.limit(0), tables[1]).count() == 0
    assert toxicity.reject_toxic(docs, none).columns == docs.columns
    schema = "doc_id long, text string, scored_ int, predicted int, label int, key int, nth int, score int, keep_ int"
    clash = spark.createDataFrame([(i, f"word{i % 3} and", 1, 2, 3, 4, 5, 6, 7) for i in range(12)], schema)
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    assert all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6, 7) for r in toxicity.reject_toxic(clash, marks).collect())
    assert toxicity.toxicity_report(clash, marks).count() == 12
    repeats = docs.union(docs).union(spark.createDataFrame([(2, "x", 7)] * 50, docs.schema))
    assert toxicity.toxicity_report(repeats, one).count() == 58


SMALL = "/root/testdata/sf0.01"


def rated(got, labels):
    held = {r.doc_id: r.toxic for r in labels.collect()}
    toxic = np.array([r.score for r in got if r.held_out and held.get(r.doc_id) == 1])
    clean = np.array([r.score for r in got if r.held_out and held.get(r.doc_id) == 0])
    return (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2


@pytest.mark.parametrize("label", [0, 1])
def test_a_very_long_labelled_text_changes_little(tables, label):
    docs, labels = tables
    first = docs.join(labels.where(f"toxic = {label}"), "doc_id").where((toxicity.fold("doc_id") != 0) & (toxicity.F.length("text") > 200)).orderBy("doc_id").first()
    times = 8_000_000 // len(first.text) + 1
    longer = docs.withColumn("text", toxicity.F.when(toxicity.F.col("doc_id") == first.doc_id, toxicity.F.repeat("text", times)).otherwise(toxicity.F.col("text")))
    before, after = (toxicity.toxicity_report(d, labels).collect() for d in (docs, longer))
    assert abs(rated(before, labels) - rated(after, labels)) < 0.02
    kept = toxicity.reject_toxic(longer, labels).count()
    assert abs(kept - sum(r.predicted == 0 for r in before)) <= 20


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class_reject_nothing(spark, label):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet").where(f"toxic = {label}")
    assert toxicity.reject_toxic(docs, labels).count() == docs.count()
