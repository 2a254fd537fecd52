"""What the corpus operators share: byte-level word splitting and Arrow helpers used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are worked on in pieces of about this many bytes, so a task's memory does not follow its batch size.
BLOCK_BYTES = 4_000_000


def release() -> None:
    """Give freed memory back to the system. Python workers live on between tasks and stages; what one held at its peak
    would otherwise count against the executor to the end."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names (in any letter case) an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def unused(name: str, *taken: str) -> str:
    """name, or name with marks behind it, so that it is none of the names taken (in any letter case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def fold(key: Column | str) -> Column:
    """The fifth of the corpus a document belongs to; 0 is held out of training."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")) if isinstance(key, str) else key, F.lit(5))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit bytes; one long text is a range of its own."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if len(texts) > start:
        yield start, len(texts)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and where each text starts (one more entry than texts). Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_KEPT_POWERS: dict[int, np.ndarray] = {}

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), kept for the next block."""
    kept = _KEPT_POWERS.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1), base, np.uint64)
        kept[0] = 1
        _KEPT_POWERS[int(base)] = kept = np.cumprod(kept)
    return kept[:n]


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many ranges at once, from one running polynomial sum."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(_BASE, len(codes)), out=sums[1:])
    down = powers(_INVERSE, len(codes) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def split_words(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the runs of word bytes that lie within one text, and each run's text."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = is_word[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    joined = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a run may not cross from one text to the next
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in order of their places, worked out for a stretch of bytes at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 19), "right")))
        a = int(starts[i])
        b = max(int(ends[j - 1]), a)
        out[i:j] = range_hashes(_BYTE_CODES[raw[a:b]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACES
