"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes them a document's score.

p(document) = 1 - (1 - leak) * product over its sentences of (1 - p(sentence)), p(sentence) = sigmoid(bias + sum of
the weights of its different words and word stems). Weights, bias and leak are learned from document labels alone, by
gradient steps on the likelihood of the labels; the leak stands for labels no sentence explains. Weights start at zero
and stay at or above it: a word may speak for toxicity, and its absence for nothing. A first run with an absolute
penalty leaves most words at zero; a second one without, over the words that are left, undoes what the penalty took
from them. Sentences of at least SENTENCE probability are the offending ones.

Training sees a bounded sample: at most TRAIN_ROWS labelled documents of each class and at most half of TRAIN_BYTES of
their texts, those with the smallest hashes of their ids, weighted back to the classes' shares. Texts are taken whole
or not at all; those of over a LONG-th of a class's bytes come last, shortest first, so a very long text can't take the
place of others. Only hashes of words with some support in toxic documents are weighed. Scoring reads every whole
text once, without a shuffle.

Defined results: a null or wordless text scores the leak. Null labels aren't learned from; documents without an id
are scored but never learned from. Of rows that repeat an id at most REPEATS with different texts are learned from.
Without usable labels, or with texts of one class only, no word counts and every score is next to 0, so nothing is
rejected. Texts of any length are scored whole, in stretches of bounded size. Repeated rows are scored alike, and equal
scores stay equal. Columns of the input that clash with
result columns are replaced, others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.llm.common import blocks, flat_bytes, fold, mix, release, split_words, unused, without, word_hashes
from fairloom.operators.storage import cut

TRAIN_ROWS, TRAIN_BYTES, REPEATS, LONG = 2_000, 14_000_000, 4, 32
SENTENCE, DOCUMENT = 0.5, 0.5
#: Words are weighed if they are in this many toxic documents that differ.
SUPPORT = 5
#: Steps and the penalty of the first run, steps of the second, and the size of the first steps.
STEPS, PENALTY, AGAIN, RATE = 300, 1.6, 400, 0.1
#: A toxic document counts as much as this many clean ones: a miss costs more than a false alarm.
TOXIC_COST = 2.0
#: Where bias and the leak's logit start.
BIAS, LEAK = -6.0, -4.0

STEM, _STEM_SALT = 4, np.uint64(0x5DEECE66D1234567)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[128:] = True
_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True  # line feed ! . ?


def sentence_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words: hash, hash of the stem, text, running number of the sentence, first byte and end byte in all
    texts' bytes. The stem, a word's first STEM bytes, stands for its inflected and compound forms."""
    raw, at = flat_bytes(texts)
    low = _LOWER[raw]
    starts, ends, of = split_words(low, at, _IN_WORD)
    stops = np.cumsum(_STOPS[raw])
    sentence = stops[starts] + of if len(starts) else np.zeros(0, np.int64)
    stems = word_hashes(low, starts, np.minimum(ends, starts + STEM)) ^ _STEM_SALT
    return word_hashes(low, starts, ends), stems, of, sentence, starts, ends


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the words that count
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    leak: float = 0.0
    bias: float = -20.0

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def words_that_count(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their places, and which of the keys they are."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[k] == hashes[at]
        return at[same], k[same]

    def sentences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, logit, first byte, end byte of every sentence with a word that counts; all texts' sentence counts."""
        words, stems, of, sentence, starts, ends = sentence_words(texts)
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        number = np.cumsum(np.diff(sentence, prepend=-1) != 0) - 1
        (at, k), (at_stem, k_stem) = self.words_that_count(words), self.words_that_count(stems)
        width = max(1, len(self.keys))
        once = np.unique(number[np.concatenate([at, at_stem])] * width + np.concatenate([k, k_stem]))
        total = np.bincount(once // width, self.weights[once % width], minlength=len(first)) if len(once) else np.zeros(len(first))
        hit = np.unique(once // width)
        last = np.append(first[1:], len(words))[hit] - 1 if len(hit) else hit
        return of[first[hit]], self.bias + total[hit], starts[first[hit]], ends[last], np.bincount(of[first], minlength=len(texts))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability and number of offending sentences of every text."""
        of, logit, _, _, counts = self.sentences(texts)
        plain = counts - np.bincount(of, minlength=len(texts))
        sure = np.bincount(of, np.logaddexp(0, logit), minlength=len(texts)) + plain * np.logaddexp(0, self.bias)
        offending = np.bincount(of, logit >= np.log(SENTENCE / (1 - SENTENCE)), minlength=len(texts))
        return np.clip(1 - (1 - self.leak) * np.exp(-sure), 0, 1), offending.astype(np.int64)


def different(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes in order, and for each different hash of each document its number and its document; and every
    document's kind. Near copies are of one kind: they share the smallest hash of their rarer words, documents that
    differ seldom do."""
    words = [np.unique(h) for h, _ in docs]
    flat = np.concatenate(words)
    row = np.repeat(np.arange(len(docs)), [len(x) for x in words])
    keys, number = np.unique(flat, return_inverse=True)
    common = np.bincount(number) > max(10, len(docs) // 50)
    mixed = mix(flat)
    mixed[common[number]] = np.iinfo(np.uint64).max
    cuts = np.searchsorted(row, np.arange(len(docs) + 1))
    least = [mixed[a:b].min() if a < b else 0 for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kind = np.unique([x if x < np.iinfo(np.uint64).max else np.uint64(i) for i, x in enumerate(least)], return_inverse=True)[1]
    return keys, number, row, kind


@dataclass
class Bags:
    """Sentences of documents as pairs (sentence, word); sentences without a word that is weighed are only counted."""

    word: np.ndarray
    sentence: np.ndarray
    owner: np.ndarray  # the document of each sentence
    plain: np.ndarray  # how many other sentences each document has
    labels: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        """word and sentence, sorted by sentence, and the sentences once more by word: sums are over stretches, which
        takes far less memory than counting with weights."""
        self.heads = np.flatnonzero(np.diff(self.sentence, prepend=-1))
        self.filled = self.sentence[self.heads]
        self.by_word = self.sentence[np.argsort(self.word, kind="stable")]
        count = np.bincount(self.word) if len(self.word) else np.zeros(0, np.int64)
        self.used = np.flatnonzero(count)
        self.word_heads = (np.cumsum(count) - count)[self.used]

    def gradient(self, weights: np.ndarray, bias: float, leak: float) -> np.ndarray:
        """Of the labels' negative log-likelihood, by weights, bias and leak (its logit)."""
        logit = np.full(len(self.owner), bias)
        if len(self.word):
            logit[self.filled] += np.add.reduceat(weights.astype(np.float32)[self.word], self.heads)
        sure = np.bincount(self.owner, np.logaddexp(0, logit), minlength=len(self.labels)) + self.plain * np.logaddexp(0, bias) + np.logaddexp(0, leak)
        by_sure = self.scale * np.where(self.labels == 1, -1 / np.expm1(np.clip(sure, 1e-9, 500)), 1.0)
        by_logit = by_sure[self.owner] / (1 + np.exp(-logit))
        by_bias = by_logit.sum() + (by_sure * self.plain).sum() / (1 + np.exp(-bias))
        by_word = np.zeros(len(weights))
        if len(self.word):
            by_word[self.used] = np.add.reduceat(by_logit.astype(np.float32)[self.by_word], self.word_heads)
        return np.concatenate([by_word, [by_bias, by_sure.sum() / (1 + np.exp(-leak))]])

    def descend(self, params: np.ndarray, steps: int, penalty: float) -> np.ndarray:
        """Adam with steps that shrink to nothing; weights are pulled towards zero by penalty and stop there."""
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            grad = self.gradient(params[:-2], params[-2], params[-1])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            pace = RATE * min(1, 2 * (1 - step / (steps + 1))) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            params = params - pace * m / (1 - 0.9**step)
            params[:-2] = np.maximum(params[:-2] - pace[:-2] * penalty, 0)
        return params

    def only(self, words: np.ndarray) -> Bags:
        """The same with some of the words."""
        there = words[self.word]
        used, sentence = np.unique(self.sentence[there], return_inverse=True)
        rest = np.bincount(self.owner, minlength=len(self.labels)) - np.bincount(self.owner[used], minlength=len(self.labels))
        return Bags((np.cumsum(words) - 1)[self.word[there]].astype(np.int32), sentence.astype(np.int32), self.owner[used], self.plain + rest, self.labels, self.scale)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, class_weights: np.ndarray) -> Model:
    """docs: hashes and sentence numbers of the words and stems of each; class_weights: how many rows a row of class 0, 1 stands for.
    Empties docs on the way."""
    if not len(labels) or labels.min() == labels.max():
        return Model()
    keys, number, row, kind = different(docs)
    toxic = labels[row] == 1
    kinds = int(kind.max()) + 1
    support = np.bincount(np.unique(number[toxic] * kinds + kind[row[toxic]]) // kinds, minlength=len(keys))
    keys = keys[support >= SUPPORT]
    del number, row, toxic
    word, sentence, owner, plain, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.zeros(len(docs)), 0
    for i, (hashes, numbers) in enumerate(docs):
        k = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
        same = keys[k] == hashes if len(keys) else np.zeros(len(hashes), bool)
        own, back = np.unique(numbers[same], return_inverse=True)
        once = np.unique((back + count) * max(len(keys), 1) + k[same])
        word.append((once % max(len(keys), 1)).astype(np.int32))
        sentence.append((once // max(len(keys), 1)).astype(np.int32))
        owner.append(np.full(len(own), i))
        count += len(own)
        plain[i] = len(np.unique(numbers)) - len(own)
    weight = (class_weights * [1, TOXIC_COST])[labels] / np.bincount(kind)[kind]  # near copies count as one
    word, sentence, owner = np.concatenate(word), np.concatenate(sentence), np.concatenate(owner)
    docs.clear()  # what is left is in the bags
    release()
    bags = Bags(word, sentence, owner, plain, labels, weight / weight.mean())
    params = bags.descend(np.concatenate([np.zeros(len(keys)), [BIAS, LEAK]]), STEPS, PENALTY)
    left = params[:-2] > 0
    params = bags.only(left).descend(params[np.append(left, [True, True])], AGAIN, 0.0)
    return Model(keys[left], params[:-2], float(1 / (1 + np.exp(-params[-1]))), float(params[-2]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    usable = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & (fold("label_key") != 0))
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not shares:
        return Model()
    order = F.xxhash64("label_key")
    picked = [usable.where(F.col("label") == k).orderBy(order, "label_key").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    short = texts.select("key", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    short = short.join(F.broadcast(picked[0].union(picked[1])), F.col("key") == F.col("label_key"))  # rows * 2 short rows at most
    short = short.groupBy("label_key", "label", "hash", "size").agg(order.alias("order"))  # of equal texts one
    nth = F.row_number().over(Window.partitionBy("label_key", "label").orderBy("size", "hash"))
    short = cut(short.withColumn("nth", nth).where(F.col("nth") <= REPEATS))
    long = F.when(F.col("size") > size // 2 // LONG, F.col("size")).otherwise(0)
    so_far = F.sum("size").over(Window.partitionBy("label").orderBy(long, "order", "label_key", "nth"))
    chosen = short.withColumn("sum", so_far).where(F.col("sum") <= size // 2).select("label_key", "label", "hash", "order", "nth")
    sample = texts.join(F.broadcast(chosen), (F.col("key") == F.col("label_key")) & (texts["hash"] == chosen["hash"]))  # rows * 2 * REPEATS short rows
    sample = sample.groupBy("label", "order", "label_key", "nth").agg(F.first("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0), 1_000_000):
                words, stems, of, sentence, _, _ = sentence_words(batch.column(0).slice(a, b - a))
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([words[s:e].tobytes() + stems[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([(sentence[s:e] - sentence[s : s + 1]).astype(np.int32).tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    *(batch.column(c).slice(a, b - a) for c in (1, 2, 3)),
                ], names=["hashes", "sentences", "label", "order", "nth"])
        release()

    rows_ = sample.select("text", "label", "order", "nth").mapInArrow(features, "hashes binary, sentences binary, label int, order long, nth int")
    got = rows_.toArrow().sort_by([("order", "ascending"), ("label", "ascending"), ("nth", "ascending")])
    held = [(np.frombuffer(h.as_buffer(), np.uint64), np.tile(np.frombuffer(s.as_buffer(), np.int32), 2)) for h, s in zip(got["hashes"], got["sentences"], strict=True)]
    y = got["label"].to_numpy().astype(np.int64)
    used = np.bincount(y, minlength=2)
    del got, rows_
    model = fit(held, y, np.array([shares.get(k, 0) / max(used[k], 1) for k in (0, 1)]))
    release()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, n_offending and predicted. Only the texts go to Python, only the scores come back."""

    @F.arrow_udf("struct<score:double,n_offending:long>")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [model.scores(texts.slice(a, b - a)) for a, b in blocks(texts, 1_000_000)]
        p, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, np.int64))
        release()
        return pa.StructArray.from_arrays([pa.array(p), pa.array(n)], ["score", "n_offending"])

    base = without(docs, "score", "n_offending", "predicted")
    kept, found = [F.col(f"`{c}`") for c in base.columns], unused("scored_", *base.columns)
    scored = scored.asNondeterministic()  # else a filter on the score would run it twice
    out = base.withColumn(found, scored(F.col(text))).select(*kept, f"{found}.score", f"{found}.n_offending")
    return out.withColumn("predicted", (F.col("score") >= DOCUMENT).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each offending sentence: key, start and end (code points), probability, sentence."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType()), T.StructField("sentence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                part = batch.slice(a, b - a)
                raw, at = flat_bytes(part.column(1))
                of, logit, first, end, _ = model.sentences(part.column(1))
                bad = logit >= np.log(SENTENCE / (1 - SENTENCE))
                of, logit, first, end = of[bad], logit[bad], first[bad], end[bad]
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(of)), pa.array(points[first] - points[at[of]]), pa.array(points[end] - points[at[of]]),
                    pa.array(1 / (1 + np.exp(-logit))), pa.array([raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(first, end, strict=True)], pa.string()),
                ], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    model = train(docs, labels, key)
    held_out = F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out")
    return score(docs.select(key, "text"), model).select(key, held_out, "score", "predicted", "n_offending")


def reject_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without those predicted to be toxic."""
    mine = unused("keep_", *docs.columns)
    only = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mine), F.col("text")), train(docs, labels, key))
    return only.where("predicted = 0").select(f"{mine}.*")
