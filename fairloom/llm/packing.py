"""Best-two-fit packing of tokenised documents into sequences of at most SEQUENCE tokens.

Documents are tokenised where they are read; only lengths travel. A document longer than a sequence is cut into full
pieces and a rest; full pieces are sequences of their own. The other pieces are dealt by a hash into packing groups
of about GROUP pieces, and each group is packed by itself: a bin takes the longest piece left, then again and again
the longest that fits; when nothing fits any more and a gap is left, the bin's shortest piece gives way to two
unpacked pieces if these fill its place and the gap more tightly. A group wastes at most part of one bin in tens of
thousands, and neither the driver nor one task ever sees all lengths.

Defined results: a null text is an empty one; every document ends with the separator id, so an empty text is one
piece of length 1. Repeated rows and null ids are packed like others. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.llm.common import release
from fairloom.operators.storage import cut

SEQUENCE, SEPARATOR = 2048, 0
TOKENIZER = "word_bpe_49k.json"
GROUP = 65_536
#: Chunks between white space, and words in them, whose ids a task remembers. Past this what wasn't used goes.
REMEMBERED = 180_000
#: Longer chunks hardly come again.
LONG = 32
#: Marks that may follow a word; together they are one piece. The apostrophe isn't among them: 's is a piece of its own.
MARKS = string.punctuation.replace("'", "")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in prints}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(prints)))
    return [letters[b] for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkIds(dict):
    """Ids (little-endian, unsigned, 32 bits each) of the chunks that stand between ASCII white space.

    A chunk is looked up first, then its letters and the marks behind them; only what is new goes to the tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.words: dict[str, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.letters = byte_letters()

    def plain(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of lower-case letters, straight from the model."""
        spelled = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = self.old_words.get(word) or packed([t.id for t in self.tokenizer.model.tokenize(spelled)])
        if len(word) <= LONG:
            if len(self.words) > REMEMBERED:
                self.old_words, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk) or self.made(chunk)
        if len(chunk) <= LONG:
            if len(self) > REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def made(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "surrogatepass")
        core = text.rstrip(MARKS)
        low = core.lower()
        # what normalisation could treat otherwise than lower() goes the whole way
        if not low.isalpha() or not (low.isascii() or ("\u03a3" not in core and unicodedata.is_normalized("NFC", core))):
            return self.plain(text)
        ids = self.words.get(low) or self.word(low)
        if len(core) == len(text):
            return ids
        tail = text[len(core) :]
        return ids + (self.words.get(tail) or self.words.setdefault(tail, self.plain(tail)))


# Fixed value: how a tokenizer says that it takes words, digits and runs of marks apart and drops white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def works_by_words(config: dict) -> bool:
    """If the configuration is: NFC, white space as a blank, lower case; then pieces as in WORDS, bytes as letters; BPE
    within a piece; nothing added around a text."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    parts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORDS} and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
        and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and config["model"]["type"] == "BPE" and not config["model"].get("dropout")
        and config.get("post_processor") is None and all(x["special"] for x in config.get("added_tokens", []))
    )


class ChunkTokenizer:
    """Ids of whole texts, put together from the remembered ids of their chunks.

    Valid for tokenizers that lower-case, drop white space and treat letters and marks apart; chunked says if the file
    declares just that (see works_by_words). Any other file's texts are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.ids = ChunkIds(self.tokenizer)
        self.chunked = works_by_words(json.loads(self.tokenizer.to_str()))

    def forget(self) -> None:
        """Workers live on after a task; what they remembered should not."""
        for kept in (self.ids, self.ids.words, self.ids.old, self.ids.old_words):
            kept.clear()

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.chunked:
            return self.ids.plain(text.decode("utf-8", "surrogatepass"))
        return b"".join(map(self.ids.__getitem__, text.split()))


_workers: dict[str, ChunkTokenizer] = {}


def worker_tokenizer(path: str) -> ChunkTokenizer:
    if path not in _workers:
        _workers[path] = ChunkTokenizer(path)
    return _workers[path]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece of every document."""
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_tokenizer(path)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, body in enumerate(batch.column(1).cast(pa.binary())):
                ids = coder.encode(body.as_py()) + end
                for k, at in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * at : 4 * (at + size)]
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )
        coder.forget()
        release()

    return docs.select(key, text).mapInArrow(run, schema)


class Lengths:
    """How many pieces of each length are unpacked, and the longest of at most a given length."""

    def __init__(self, counts: list[int]):
        self.count = counts
        self.down = [i if i == 0 or c else i - 1 for i, c in enumerate(counts)]
        self.left = sum(counts)

    def longest(self, most: int) -> int:
        """0 if there is none."""
        down, x = self.down, most
        while down[x] != x:
            down[x] = down[down[x]]
            x = down[x]
        return x

    def take(self, length: int) -> None:
        self.count[length] -= 1
        self.left -= 1
        if not self.count[length]:
            self.down[length] = length - 1


def two_that_fit(unpacked: Lengths, room: int, over: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most room, if it is more than over."""
    best, pair = over, None
    a = unpacked.longest(room - 1)
    while a and 2 * a > best:
        b = unpacked.longest(min(a, room - a))
        if b == a and unpacked.count[a] < 2:
            b = unpacked.longest(a - 1)
        if b and a + b > best:
            best, pair = a + b, (a, b)
            if best == room:
                break
        a = unpacked.longest(a - 1)
    return pair


def best_two_fit(counts: list[int], size: int) -> Iterator[list[int]]:
    """The lengths in each bin. counts[i]: pieces of length i, for i up to size."""
    unpacked = Lengths(counts)
    while unpacked.left:
        held, gap = [], size
        while x := unpacked.longest(gap):
            unpacked.take(x)
            held.append(x)
            gap -= x
        if gap and len(held) > 1 and unpacked.left > 1 and (pair := two_that_fit(unpacked, held[-1] + gap, held[-1])):
            given_back = held.pop()
            for x in pair:
                unpacked.take(x)
            unpacked.count[given_back] += 1
            unpacked.left += 1
            if unpacked.count[given_back] == 1:
                unpacked = Lengths(unpacked.count)
            held += pair
        yield held


def assign(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin for pieces given by length; equal lengths are taken in order."""
    counts = np.bincount(lengths, minlength=size + 1).tolist()
    by = np.argsort(lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = by.tolist()
    for n, held in enumerate(best_two_fit(counts, size)):
        at = 0
        for x in held:
            i = order[starts[x]]
            starts[x] += 1
            bins[i], offsets[i] = n, at
            at += x
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, separator: int = SEPARATOR, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    made = cut(pieces(docs, path or tokenizer_path(), key, text, size, separator))
    groups = max(1, -(-made.where(F.col("length") < size).count() // group))
    # the number a full piece's sequence gets is made of its partition and row; group numbers stay below 0
    full = made.where(F.col("length") == size).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # by the row's place in the checkpoint, so that rows that repeat are dealt like others
    rest = made.where(F.col("length") < size).withColumn("place", F.monotonically_increasing_id())
    rest = rest.select(*made.columns, F.pmod(F.xxhash64("place"), F.lit(groups)).alias("bin_group"))
    columns = made.columns
    schema = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        # the same rows in the same order whatever order the shuffle brought them in
        table = table.sort_by([("length", "ascending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = assign(table.column("length").to_numpy(), size)
        base = -((table.column("bin_group")[0].as_py() + 1) << 32)
        out = table.select(columns)
        return out.append_column("sequence_id", pa.array(base + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return full.unionByName(rest.groupBy("bin_group").applyInArrow(run, schema))
