"""Edited copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly verified.

Candidates come from two sources. One is the trie join of SimHash fingerprints, over the same shingles; it finds what
differs in a few bits, but texts at similarity 0.8 differ in up to 14 of 64, where a trie prunes nothing and blocks of
equal bits are too short to deal it out by. So the other is MinHash: 28 bands of six minima, so a pair at similarity 0.8 shares a band but for one in 5,000
(one in 500,000 at 0.85). Of every band's texts each links to the smallest; the components of all
these links hold all pairs that share a band or differ in a few bits. Each component's texts then meet in one task, which compares shingle sets: from every text the
similarities to all that isn't grouped yet, so a dense group costs little more than its own size. A component with
more than CHUNK_TEXTS texts or CHUNK_SHINGLES shingles is dealt as pairs of chunks, so no task holds more than two
chunks and still every pair meets.

Texts are told apart by a 64-bit hash. Words are runs of bytes that aren't ASCII white space, ASCII letters in lower
case; a text of fewer than five words is one shingle, all wordless and null texts are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.llm.common import NOT_SPACE, blocks, flat_bytes, mix, release, split_words, word_hashes
from fairloom.operators.graph import connected_components
from fairloom.operators.storage import cut

WIDTH = 5
BANDS, ROWS = 28, 6
#: Similarity of at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
CHUNK_TEXTS, CHUNK_SHINGLES = 2_000, 500_000
#: Shingles whose minima are worked out together.
STRETCH = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHAIN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _CHAIN) | np.uint64(1)


def shingles(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, repeats included, and how many each text has (at least one)."""
    raw, at = flat_bytes(texts)
    raw = _LOWER[raw]
    starts, ends, of = split_words(raw, at, NOT_SPACE)
    words = word_hashes(raw, starts, ends)
    n = np.bincount(of, minlength=len(texts))
    size = np.minimum(n, WIDTH)[of]
    left = np.cumsum(n)[of] - np.arange(len(of))
    first = np.flatnonzero(left >= size)
    of, size = of[first], size[first]
    values = np.zeros(len(first), np.uint64)
    for k in range(WIDTH):
        more = k < size
        values[more] = mix(values[more] * _CHAIN + words[first[more] + k])
    wordless = np.flatnonzero(n == 0)
    if len(wordless):
        of = np.concatenate([of, wordless])
        by = np.argsort(of, kind="stable")
        of, values = of[by], np.concatenate([values, np.zeros(len(wordless), np.uint64)])[by]
    return values, np.bincount(of, minlength=len(texts))


def bands(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for every text."""
    ends = np.cumsum(counts)
    heads = ends - counts
    least = np.empty((len(_FACTORS), len(counts)), np.uint64)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, heads[i] + STRETCH, "right")))
        part = values[heads[i] : ends[j - 1]]
        made = np.empty_like(part)
        for k, factor in enumerate(_FACTORS):
            np.multiply(part, factor, out=made)
            least[k, i:j] = np.minimum.reduceat(made, heads[i:j] - heads[i])
        i = j
    out = np.empty((len(counts), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(counts), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * _CHAIN + least[b * ROWS + r])
        out[:, b] = h
    return out


def fingerprints(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHashes: a bit is 1 if it is set in over half of a text's shingles."""
    ends = np.cumsum(counts)
    heads = ends - counts
    out = np.zeros(len(counts), np.uint64)
    for i in range(len(counts)):
        ones = np.zeros(64, np.int64)
        for a in range(heads[i], ends[i], STRETCH):
            part = values[a : min(a + STRETCH, ends[i])]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > counts[i], bitorder="little").view(np.uint64)[0]
    return out


def groups_of(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """For every text the first text that can be reached over pairs of near texts."""
    values, counts = shingles(texts)
    n = len(counts)
    vocabulary, code = np.unique(values, return_inverse=True)
    pairs = np.unique(np.repeat(np.arange(n), counts) * len(vocabulary) + code)
    code, sizes = pairs % len(vocabulary), np.bincount(pairs // len(vocabulary), minlength=n)
    heads = np.cumsum(sizes) - sizes
    root = np.arange(n)
    rest, rest_code, rest_size = np.arange(n), code, sizes
    mark = np.zeros(len(vocabulary), bool)

    def leave(stay: np.ndarray) -> None:
        nonlocal rest, rest_code, rest_size
        rest_code = rest_code[np.repeat(stay, rest_size)]
        rest, rest_size = rest[stay], rest_size[stay]

    while len(rest) > 1:
        reached = [int(rest[0])]
        leave(np.arange(len(rest)) > 0)
        while reached and len(rest):
            at = reached.pop()
            own = code[heads[at] : heads[at] + sizes[at]]
            mark[own] = True
            shared = np.add.reduceat(mark[rest_code], np.cumsum(rest_size) - rest_size, dtype=np.int64)
            mark[own] = False
            near = shared * (NEAR[0] + NEAR[1]) >= NEAR[0] * (sizes[at] + rest_size)
            if near.any():
                root[rest[near]] = root[at]
                reached += rest[near].tolist()
                leave(~near)
    return root


def with_bands(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, leaf (a hash of the text), n (shingles), fp (the fingerprint) and bands of every row."""
    schema = texts.select(key, "leaf").schema.add("n", T.LongType()).add("fp", T.LongType()).add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(text), 2_000_000):
                part = batch.slice(a, b - a)
                values, counts = shingles(part.column(text))
                flat = pa.array(bands(values, counts).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("leaf"), pa.array(counts, pa.int64()), pa.array(fingerprints(values, counts).view(np.int64)), lists], names=schema.names)
        release()

    return texts.mapInArrow(run, schema)


def copy_groups(docs: DataFrame, near_links: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every leaf (F.xxhash64 of a text) first_key, the smallest key that has it, and root, the group's name.

    near_links: links a, b between fingerprints (column fp) that differ in a few bits.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("leaf"))
    key, text = "key", "text"
    marked = with_bands(texts, key, text)
    leaves = cut(marked.groupBy("leaf").agg(F.min(key).alias("first_key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    of_fp = cut(leaves.groupBy("fp").agg(F.min("leaf").alias("lead")))
    same = leaves.join(of_fp, "fp").where("leaf <> lead").select(F.col("leaf").alias("a"), F.col("lead").alias("b"))
    ends = [of_fp.select(F.col("fp").alias(side), F.col("lead").alias(f"lead_{side}")) for side in "ab"]
    close = near_links(of_fp.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    rows = leaves.select("leaf", F.explode("bands").alias("band"))
    lowest = rows.groupBy("band").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high")).where("low < high").select("band", "low")
    links = rows.join(lowest, "band").where("leaf <> low").select(F.col("leaf").alias("a"), F.col("low").alias("b"))
    members = connected_components(cut(links.union(same).union(close).distinct()))
    members = cut(leaves.join(members, leaves["leaf"] == members["node"]).select(F.col("leaf").alias("node"), "component", "first_key", "n"))
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    large = cut(members.groupBy("component").agg(chunks.alias("chunks")).where("chunks > 1").withColumnRenamed("component", "large"))
    if large.isEmpty():
        dealt = members.select("node", "first_key", "component", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        of = F.coalesce("chunks", F.lit(1))
        dealt = (
            members.join(large, members["component"] == large["large"], "left").withColumn("mine", F.pmod(F.xxhash64("node"), of).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
            .select("node", "first_key", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        )
    met = texts.join(dealt.hint("shuffle_hash"), (texts["leaf"] == dealt["node"]) & (texts[key] == dealt["first_key"])).select("component", "i", "j", "leaf", F.col(text).alias("text"))

    def verify(got: pa.Table) -> pa.Table:
        leaf = got.column("leaf").to_numpy()
        root = groups_of(got.column("text"))
        moved = np.flatnonzero(leaf[root] != leaf)
        release()
        return pa.table({"a": leaf[moved], "b": leaf[root[moved]]})

    near = connected_components(cut(met.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long")))
    named = leaves.join(near, leaves["leaf"] == near["node"], "left").select("leaf", "first_key", F.coalesce("component", "leaf").alias("root"))
    return cut(named)
