import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fairloom.llm import packing

ODD = [
    None, "", " \n\t", "<|endoftext|> a<|startoftext|>b İIͅ ΑΣ ΑΣ. é  x y\x1cz\x85q don't 123 can'll ​", "é é É. ² ½x x² Ünï— “quo” 'tis it's. 're... ?! ǅ ß ẞ",
    "word " * 5000, "x" * 30_000, "DE.ER, a!b? 😀", "a" * 2047,
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0]


def test_chunked_ids_are_the_tokenizers(spark, plain):
    coder = packing.ChunkTokenizer(packing.tokenizer_path())
    assert coder.chunked
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aAbéÉ.,!'sßΣ1²  \n-") for _ in range(40)) for _ in range(300)]
    for text in texts + ODD:
        got = np.frombuffer(coder.encode((text or "").encode()), "<u4").tolist()
        assert got == plain(text)[:-1], text


def test_other_tokenizers_are_encoded_whole():
    path = packing.tokenizer_path("byte_bpe_50k.json")
    coder = packing.ChunkTokenizer(path)
    assert not coder.chunked
    text = "A few  words, é."
    assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check(rows, texts, plain, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for k, held in by_doc.items():
        ids, at = plain(texts[k]), 0
        for n, r in enumerate(sorted(held, key=lambda r: r.piece)):
            part = ids[at : at + size]
            assert (r.piece, r.start, r.length) == (n, at, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += size
        assert at >= len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


@pytest.mark.parametrize("group", [50, packing.GROUP])
def test_pack(spark, plain, group):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts |= {10_000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1 as piece")
    rows = packing.pack(df, group=group).collect()
    check(rows, texts, plain, 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + (1 if group > 1000 else 20)


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sorted(r.offset for r in rows)[0] == 0 and len(rows) == 4 and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "")] * 2000, "doc_id long, text string").selectExpr("doc_id", "text", "1 as bin_group", "2 as place", "3 as sequence_id")
    rows = packing.pack(same, group=100).collect()
    assert len(rows) == 2000 and len({-r.sequence_id >> 32 for r in rows}) == 20  # rows that repeat are dealt to all groups


def test_two_replace_the_smallest():
    # after 6 + 3 the gap of 1 can't be filled; 3 gives way to 2 + 2
    counts = [0, 0, 2, 1, 0, 0, 1, 0, 0, 0, 0]
    assert next(packing.best_two_fit(counts, 10)) == [6, 2, 2]


def test_bins_hold_every_piece_once():
    rng = np.random.default_rng(2)
    for size in (5, 40, 300):
        lengths = rng.integers(1, size, 500)
        bins, offsets = packing.assign(lengths, size)
        for b in range(bins.max() + 1):
            held = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
            assert [o for o, _ in held] == [0, *np.cumsum([x for _, x in held])[:-1].tolist()]
            assert sum(x for _, x in held) <= size
        first_fit = []
        for x in sorted(lengths.tolist(), reverse=True):
            at = next((i for i, room in enumerate(first_fit) if room >= x), None)
            if at is None:
                first_fit.append(size - x)
            else:
                first_fit[at] -= x
        assert bins.max() + 1 <= len(first_fit)
