"""Periodic runs of words, found by comparing a text with itself at every lag, all words at once.

The words of a text are numbered; bit i of plane b is bit b of word i's number, and a plane is one big integer. For a
lag q, a plane XOR itself shifted by q has a 1 wherever that bit differs from the word q further on; the OR over the
planes has a 0 exactly where both words are the same. A run of period q is a stretch of at least max(6, 4 q) - q such
zeros. ANDing the matches with themselves shifted by 1, 2, 4, ... leaves a 1 only where such a stretch begins; nearly
always nothing is left after three planes and a few shifts, and the lag is done. A stretch that a shorter period has
already explained isn't reported again, so each run has its smallest period.

A text is worked on by itself, in the task that reads it: nothing is shuffled. The lags of a text of n words cost
n * n / 4 bit operations; over LONG words, a lag must first have equal blocks at some anchor (see possible_lags),
which holds for every lag with a run, and keeps the work near n log n.

Defined results: null and empty texts have no words; fewer than six words make no run. Very long texts are numbered in
slices and held as four bytes a word and one bit a plane and word. Among runs of the same greatest exponent, the
smallest start, then the smallest period is reported. Repeated rows and null ids give one result row each; a text with
a null id is never made periodic. An empty table gives an empty result. Other columns are ignored, whatever their
names, unless the caller takes them from the input beside the result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fairloom.llm.common import mix, release

LEAST, TIMES = 6, 4
#: Planes that a lag is tested on before all of them are.
FIRST_PLANES = 3
#: Over this many words, lags are tested on anchors first.
LONG = 1 << 13
#: Texts are cut into words by slices of about this many bytes.
SLICE = 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")

Run = tuple[int, int, int]


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end].split()
        at = end


def numbered(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the words by number."""
    names: dict[bytes, int] = {}
    ids = array("I")
    for words in word_slices(text or b""):
        ids.extend([names.setdefault(w, len(names)) for w in words])
    return np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), list(names)


def planes(ids: np.ndarray) -> list[int]:
    """Big integers: bit i of the b-th is bit b of word i's number. Numbers are multiplied by an odd constant first,
    which keeps them distinct and lets already the first planes tell words apart."""
    width = max(1, int(ids.max()).bit_length())
    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64((1 << width) - 1)
    return [int.from_bytes(np.packbits((spread >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little").tobytes(), "little") for b in range(width)]


def stretches_begin(matches: int, least: int) -> int:
    """Bits where at least `least` ones follow each other, by doubling shifts."""
    have = 1
    while have < least and matches:
        step = min(have, least - have)
        matches &= matches >> step
        have += step
    return matches


def matches_at(bits: list[int], q: int, n: int) -> int:
    """Bit i: words i and i + q are the same."""
    differ = 0
    for p in bits:
        differ |= p ^ (p >> q)
    return ~differ & ((1 << (n - q)) - 1)


def ones(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of ones among the first n bits."""
    flat = np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little", count=n)
    step = np.diff(flat.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def possible_lags(ids: np.ndarray, found: list[Run], times: int) -> Iterator[int]:
    """Lags that may have a run; no other has. found: the runs so far, which the caller adds to.

    For q between w = 2 ** k and 2 w, a stretch of 3 q matches holds a whole block of w words that starts at a multiple
    of w and comes again q words on. Blocks are compared by hashes, which can only let too much pass. Equal blocks
    inside a run whose period divides q say nothing new.
    """
    n = len(ids)
    w, hashes = 1, mix(ids.astype(np.uint64) + np.uint64(1))
    wide: list[Run] = []
    seen = 0
    for q in range(1, n // times + 1):
        if q >= 2 * w:
            hashes = mix(hashes[: n - 2 * w + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[w:])
            w *= 2
            wide = [r for r in wide if r[1] >= q + w]
        wide += [r for r in found[seen:] if r[1] >= q + w]
        seen = len(found)
        later = hashes[q::w]
        equal = np.flatnonzero(hashes[::w][: len(later)] == later) * w
        for s, length, d in wide:
            if not len(equal):
                break
            if q % d == 0:
                equal = equal[(equal < s) | (equal + q + w > s + length)]
        if len(equal):
            yield q


def periodic_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every maximal run of at least max(least, times * period) words, by start and period."""
    n = len(ids)
    if n < least:
        return []
    bits = planes(ids)
    found: list[Run] = []
    explained: set[tuple[int, int]] = set()
    for q in possible_lags(ids, found, times) if n > LONG else range(1, n // times + 1):
        need = max(max(least, times * q) - q, 1)
        if len(bits) > FIRST_PLANES and not stretches_begin(matches_at(bits[:FIRST_PLANES], q, n), need):
            continue
        matches = matches_at(bits, q, n)
        if not stretches_begin(matches, need):
            continue
        starts, ends = ones(matches, n - q)
        for s, e in zip(starts[ends - starts >= need].tolist(), ends[ends - starts >= need].tolist(), strict=True):
            if (s, e + q) not in explained:
                explained.add((s, e + q))
                found.append((s, e + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for every word that lies in a run behind that run's first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


def made_periodic(key: object, ids: np.ndarray) -> np.ndarray:
    """The test rule of the report: of one document in ten, chosen by its id, the words from a place on repeat."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    n, g = len(ids), h // 10
    if h % 10 or not n:
        return ids
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def joined(ids: np.ndarray, names: list[bytes], take: Callable[[bytes], object]) -> None:
    """Hand the words with these numbers to take, one space between them, piece by piece."""
    for at in range(0, len(ids), SLICE):
        take((b" " if at else b"") + b" ".join([names[i] for i in ids[at : at + SLICE].tolist()]))


RESULT = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
])


def mapped(docs: DataFrame, key: str, text: str, fields: list[T.StructField], row: Callable[[object, bytes | None], tuple]) -> DataFrame:
    """key and what row(key, text) says of every document."""
    schema = T.StructType([docs.schema[key], *fields])
    types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.list_(pa.list_(pa.int64())) if isinstance(f.dataType, T.ArrayType) else pa.int64() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # results, texts among them, go on before they pile up
                part = batch.slice(at, 256)
                made = [row(k.as_py(), t.as_py()) for k, t in zip(part.column(0), part.column(1).cast(pa.binary()), strict=True)]
                cols = list(zip(*made, strict=True)) if made else [()] * len(fields)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)
        release()

    return docs.select(key, text).mapInArrow(run, schema)


def collapsed(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """key, text with every run cut down to its first period (words joined by one space), and the runs as arrays of
    start, length, period in words. A text without runs comes back unchanged."""

    def row(_: object, body: bytes | None) -> tuple:
        ids, names = numbered(body)
        runs = periodic_runs(ids, least, times)
        if not runs:
            return (None if body is None else body.decode("utf-8", "replace")), []
        parts: list[bytes] = []
        joined(ids[kept_words(len(ids), runs)], names, parts.append)
        return b"".join(parts).decode("utf-8", "replace"), [list(r) for r in runs]

    return mapped(docs, key, text, [T.StructField(text, T.StringType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType())))], row)


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: number of runs, the greatest run, digests of all runs and of the collapsed text; documents
    that the test rule picks are made periodic first."""

    def row(name: object, body: bytes | None) -> tuple:
        ids, names = numbered(body)
        ids = made_periodic(name, ids)
        runs = periodic_runs(ids)
        best = greatest(runs)
        listed, left = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), hashlib.sha256()
        joined(ids[kept_words(len(ids), runs)], names, left.update)
        return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], listed.hexdigest(), left.hexdigest())

    return mapped(docs, key, text, list(RESULT.fields), row)
