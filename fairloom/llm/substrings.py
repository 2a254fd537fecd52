"""Removal of long repeated passages by compacting a de Bruijn graph of words.

Every window of WIDTH words is an edge between its first and its last WIDTH - 1 words. Edges that several documents
walk are repeated; a repeated edge is known by its source coordinate, a place in the document with the smallest id
that walks it. As long as a document's next edge is also the next edge at its source, the path does not branch for
that walk, and the edges compact into one span: (document, start, number of edges, source, source start). Spans are
then joined to the texts of both ends, and each is kept only if the words there are the same, compared by a
128-bit digest; what hashes alone confused is sorted out edge by edge, by digests, among the few spans concerned.

How it is dealt out: edges travel as packed arrays, one row for a block of texts and a bucket of edge hashes, with an
entry for each edge that is new in its block; a very common passage is thus one entry a block. What other
documents of the block repeat is compacted right there, against the block's own source. Buckets answer with packed
places, which meet again by document. Rows number (blocks x buckets), bytes about eight a word, once; texts are
shuffled once, compressed, for the verifying join. The numbers of buckets follow the size of the texts.

Defined results: a null text has no words. A document without an id is neither source nor changed. Rows that repeat
an id are told apart by their texts; equal ids are no smaller than one another. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.llm.common import NOT_SPACE, blocks, flat_bytes, range_hashes, split_words, word_hashes
from fairloom.operators.storage import cut

WIDTH = 13
BUCKET_BYTES = 8 << 20
EDGE_BYTES = 7  # of each hash that travel; the bucket's number adds some bits

#: A run of consecutive edges and where its source has the same.
SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("edges", "<i4"), ("src", "<i8"), ("src_tag", "<i8"), ("src_start", "<i4")])
PLACE = ("doc", "tag", "pos", "src", "src_tag", "diagonal")


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns as differences, byte by byte of all values, compressed."""
    planes = [np.diff(c.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n_columns, 8, -1)
    return [np.cumsum(np.ascontiguousarray(c.T).view(np.int64).ravel()) for c in raw]


def compact(doc, tag, pos, src, src_tag, diagonal) -> np.ndarray:
    """Spans of edges in a row whose sources are in a row too. diagonal: source place minus place."""
    by = np.lexsort((pos, tag, doc))
    doc, tag, pos, src, src_tag, diagonal = (x[by] for x in (doc, tag, pos, src, src_tag, diagonal))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_tag[1:] != src_tag[:-1]) | (diagonal[1:] != diagonal[:-1])
    at = np.flatnonzero(new)
    out = np.zeros(len(at), SPAN)
    out["doc"], out["tag"], out["start"], out["edges"] = doc[at], tag[at], pos[at], np.diff(np.append(at, len(doc)))
    out["src"], out["src_tag"], out["src_start"] = src[at], src_tag[at], pos[at] + diagonal[at]
    return out


def _group_of(doc: np.ndarray, tag: np.ndarray, groups: int) -> np.ndarray:
    mixed = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ tag.view(np.uint64)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def block_edges(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of every edge of every text."""
    raw, at = flat_bytes(texts)
    starts, ends, of = split_words(raw, at, NOT_SPACE)
    words = word_hashes(raw, starts, ends)
    first = np.arange(max(0, len(words) - width + 1))
    first = first[of[first] == of[first + width - 1]]
    place = np.arange(len(words)) - np.searchsorted(of, np.arange(len(texts)))[of]
    return range_hashes(words, first, first + width), of[first], place[first]


_PACKED = "bucket int, kind int, size int, edges binary, places binary, owners binary"


def _edge_rows(docs: DataFrame, key: str, text: str, width: int, buckets: int, bits: int) -> DataFrame:
    """Packed rows: kind 0, entries for a bucket of edges; kind 1, spans already found, for a group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                part = batch.slice(a, b - a)
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
                ids, tags = part.column(0).to_numpy(), part.column(2).to_numpy()
                edge, of, pos = block_edges(part.column(1), width)
                if not len(edge):
                    continue
                edge &= np.uint64((1 << bits) - 1)
                by = np.argsort(edge, kind="stable")
                edge, of, pos = edge[by], of[by], pos[by]
                head = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
                own = np.repeat(head, np.diff(np.append(head, len(edge))))
                later = ids[of] > ids[of[own]]
                out = []
                if later.any():
                    source = own[later]
                    spans = compact(ids[of[later]], tags[of[later]], pos[later], ids[of[source]], tags[of[source]], pos[source] - pos[later])
                    group = _group_of(spans["doc"], spans["tag"], buckets)
                    for g in np.unique(group).tolist():
                        out.append((g, 1, int((group == g).sum()), spans[group == g].tobytes(), None, None))
                edge, of, pos = edge[~later], of[~later], pos[~later]
                bucket = ((edge >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) if bits == 64 else (edge % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((pos, of, bucket))
                edge, of, pos, bucket = edge[by], of[by], pos[by], bucket[by]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                for g, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if e > s:
                        rows, count = np.unique(of[s:e], return_counts=True)
                        planes = edge[s:e].view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES].T.tobytes()
                        out.append((g, 0, e - s, planes, _pack(pos[s:e]), _pack(ids[rows], tags[rows], count)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "size", "edges", "places", "owners"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(key).cast("long"), text, "tag").mapInArrow(run, _PACKED)


def tagged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and tag: what tells rows of one id apart. Only where an id is repeated is that a hash of the text."""
    repeats = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    tag = F.lit(0).cast("long") if repeats.isEmpty() else F.xxhash64(text)
    return docs.select(key, text, tag.alias("tag"))


def _repeated(table: pa.Table, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """For one bucket: group, number and packed places of the edges that a document with a smaller id walks too."""
    edge, pos, doc, tag = [], [], [], []
    for row in table.filter(pc.equal(table["kind"], 0)).to_pylist():
        wide = np.zeros((row["size"], 8), np.uint8)
        wide[:, :EDGE_BYTES] = np.frombuffer(row["edges"], np.uint8).reshape(EDGE_BYTES, -1).T
        edge.append(wide.view(np.uint64).ravel())
        pos.append(_unpack(row["places"], 1)[0])
        ids, tags, count = _unpack(row["owners"], 3)
        doc.append(np.repeat(ids, count))
        tag.append(np.repeat(tags, count))
    if not edge:
        return
    edge = np.concatenate(edge)
    by = np.argsort(edge, kind="stable")
    edge = edge[by]
    head = np.concatenate([[True], edge[1:] != edge[:-1]])
    alone = head & np.append(head[1:], True)
    by, head = by[~alone], head[~alone]
    if not len(by):
        return
    pos, doc, tag = (np.concatenate(x)[by] for x in (pos, doc, tag))
    at, number = np.flatnonzero(head), np.cumsum(head) - 1
    first = np.minimum.reduceat(doc, at)
    of_first = doc == first[number]
    # the smallest place of the smallest tag of the smallest id
    tag_of = np.minimum.reduceat(np.where(of_first, tag, np.iinfo(np.int64).max), at)
    of_first &= tag == tag_of[number]
    pos_of = np.minimum.reduceat(np.where(of_first, pos, np.iinfo(np.int64).max), at)
    later = doc > first[number]
    doc, tag, pos, number = doc[later], tag[later], pos[later], number[later]
    group = _group_of(doc, tag, groups)
    by = np.lexsort((pos, tag, doc, group))
    doc, tag, pos, number, group = (x[by] for x in (doc, tag, pos, number, group))
    cuts = np.searchsorted(group, np.arange(groups + 1))
    for g, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if e > s:
            k = number[s:e]
            yield g, e - s, _pack(doc[s:e], tag[s:e], pos[s:e], first[k], tag_of[k], pos_of[k] - pos[s:e])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = 64) -> DataFrame:
    """From tagged documents, one row for each that takes part: doc, tag, own (its spans, packed), asked (the ranges other documents'
    spans name it as source for, packed)."""
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(4, -(-volume // BUCKET_BYTES))

    def answer(table: pa.Table) -> pa.Table:
        known = table.filter(pc.equal(table["kind"], 1))
        found = list(_repeated(table, buckets))
        return pa.table({
            "bucket": pa.array([*known["bucket"].to_pylist(), *(g for g, _, _ in found)], pa.int32()),
            "spans": pa.array([*known["edges"].to_pylist(), *(None for _ in found)], pa.binary()),
            "places": pa.array([*(None for _ in range(known.num_rows)), *(p for _, _, p in found)], pa.binary()),
        })

    def gather(table: pa.Table) -> pa.Table:
        spans = [np.frombuffer(x, SPAN) for x in table["spans"].to_pylist() if x is not None]
        loose = [_unpack(x, len(PLACE)) for x in table["places"].to_pylist() if x is not None]
        if loose:
            spans.append(compact(*(np.concatenate(x) for x in zip(*loose, strict=True))))
        spans = np.concatenate(spans)
        spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"]))]
        ask = np.unique(spans[["src", "src_tag", "src_start", "edges"]])
        rows: list[tuple] = []
        for part, doc, tag, place in ((spans, "doc", "tag", 2), (ask, "src", "src_tag", 3)):
            new = np.flatnonzero(np.concatenate([[True], (part[doc][1:] != part[doc][:-1]) | (part[tag][1:] != part[tag][:-1])]))
            for s, e in zip(new.tolist(), np.append(new[1:], len(part)).tolist(), strict=True):
                row: list = [int(part[doc][s]), int(part[tag][s]), None, None]
                row[place] = part[s:e].tobytes() if place == 2 else _pack(part["src_start"][s:e], part["edges"][s:e])
                rows.append(tuple(row))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc", "tag", "own", "asked"])

    packed = _edge_rows(docs, key, text, width, buckets, bits)
    answered = packed.groupBy("bucket").applyInArrow(answer, "bucket int, spans binary, places binary")
    parts = answered.groupBy("bucket").applyInArrow(gather, "doc long, tag long, own binary, asked binary")
    return parts.groupBy("doc", "tag").agg(F.max("own").alias("own"), F.collect_list("asked").alias("asked"))


def _digest(words: list[bytes], start: int, edges: int, width: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + edges + width - 1]), digest_size=16).digest()


def _kept(words: list[bytes], spans: list[tuple[int, int]], width: int) -> tuple[int, list[bytes]]:
    gone = np.zeros(len(words) + 1, np.int64)
    for start, edges in spans:
        gone[start] += 1
        gone[min(start + edges + width - 1, len(words))] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return int(out.sum()), [w for w, g in zip(words, out.tolist(), strict=True) if not g]


_OWN = "array<struct<start:int,edges:int,src:long,src_tag:long,src_start:int,digest:binary>>"
_ASKED = "array<struct<start:int,edges:int,digest:binary>>"


def _carried(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Tagged documents with their texts compressed, for the shuffle."""
    key_type = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((press(t) if t else None for t in texts), pa.binary()), batch.column(2)], names=[key, "body", "tag_"])

    return docs.select(key, text, "tag").mapInArrow(run, f"`{key}` {key_type}, body binary, tag_ long")


def _marked(docs: DataFrame, spans: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, tag, n_words, n_removed, kept_sha256 of every row if all spans hold, and the digests that tell if they do."""
    left = _carried(docs, key, text).withColumn("asked_none", F.array().cast("array<binary>"))
    right = spans.withColumnRenamed("tag", "span_tag").hint("shuffle_hash")
    joined = left.join(right, (left[key] == right["doc"]) & (left["tag_"] == right["span_tag"]), "left")
    key_type = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_type = pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("src", pa.int64()), ("src_tag", pa.int64()), ("src_start", pa.int32()), ("digest", pa.binary())]))
        asked_type = pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("digest", pa.binary())]))
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_words, n_removed, sha, own_out, asked_out = [], [], [], [], []
            for body, own, asked in zip(batch.column(1), batch.column(3), batch.column(4), strict=True):
                words = unpress(body.as_py()).split() if body.is_valid else []
                own = np.frombuffer(own.as_py() or b"", SPAN)
                gone, kept = _kept(words, [(int(s["start"]), int(s["edges"])) for s in own], width) if len(own) else (0, words)
                n_words.append(len(words))
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                own_out.append([{**{f: int(s[f]) for f in ("start", "edges", "src", "src_tag", "src_start")}, "digest": _digest(words, int(s["start"]), int(s["edges"]), width)} for s in own])
                ranges = {(int(s), int(e)) for data in asked.as_py() or () for s, e in zip(*_unpack(data, 2), strict=True)}
                asked_out.append([{"start": s, "edges": e, "digest": _digest(words, s, e, width)} for s, e in sorted(ranges)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(own_out, own_type), pa.array(asked_out, asked_type)],
                names=[key, "tag", "n_words", "n_removed", "kept_sha256", "own", "asked"],
            )

    return joined.select(key, "body", F.col("tag_").alias("tag"), "own", F.coalesce("asked", "asked_none").alias("asked")).mapInArrow(
        run, f"`{key}` {key_type}, tag long, n_words long, n_removed long, kept_sha256 string, own {_OWN}, asked {_ASKED}",
    )


_AT_SOURCE = ["src", "src_tag", "src_start", "edges", "digest"]


def _own(marked: DataFrame, key: str) -> DataFrame:
    spans = marked.select(F.col(key).cast("long").alias("doc"), "tag", F.explode("own").alias("s"))
    return spans.select("doc", "tag", "s.start", "s.edges", "s.src", "s.src_tag", "s.src_start", "s.digest")


def unverified(marked: DataFrame, key: str) -> DataFrame:
    """Ranges of a source and digests that spans claim for them, where the source's words have another digest. What
    many copies claim alike is one row before it is shuffled."""
    source = marked.where(F.size("asked") > 0).select(F.col(key).cast("long").alias("src"), F.col("tag").alias("src_tag"), F.explode("asked").alias("s")).select("src", "src_tag", F.col("s.start").alias("src_start"), "s.edges", "s.digest").distinct()
    return _own(marked, key).select(_AT_SOURCE).distinct().join(source, _AT_SOURCE, "left_anti")


def _sorted_out(docs: DataFrame, marked: DataFrame, wrong: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Spans, one row for each document (doc, tag, own), of the documents with unverified spans, exact this time.

    Every edge of an unverified span and every edge of the documents it was compared with is digested by its words;
    documents that walk the same edge have the same digest. Whatever else has the edge's hash was compared with the
    same sources: it is unverified too, or equals the source's edge and not this one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), "tag", text).dropDuplicates(["doc", "tag"])
    sources = wrong.select(F.col("src").alias("doc")).distinct()
    texts = rows.join(wrong.select("doc", "tag", "start", "edges").distinct(), ["doc", "tag"]).unionByName(
        rows.join(sources, "doc").withColumns({"start": F.lit(0), "edges": F.lit(2**31 - 1)}),
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, tag, body, start, edges in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", text, "start", "edges")), strict=True):
                words = body.encode().split()
                last = len(words) - width + 1
                out += [(doc, tag, p, _digest(words, p, 1, width)) for p in range(start, min(start + edges, last))]
            if not out:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc", "tag", "pos", "digest"])

    each = cut(texts.select("doc", "tag", text, "start", "edges").mapInArrow(digests, "doc long, tag long, pos int, digest binary").distinct())
    first = each.groupBy("digest").agg(F.min("doc").alias("first"))
    repeats = each.join(first, "digest").where("doc > first").select("doc", "tag", F.col("pos").alias("start"), F.lit(1).alias("edges"))
    touched = wrong.select("doc", "tag").distinct()
    own = _own(marked, key).join(touched, ["doc", "tag"], "left_semi")
    good = own.join(wrong, ["doc", "tag", "start", "edges", "src", "src_tag", "src_start"], "left_anti").select("doc", "tag", "start", "edges")
    every = good.unionByName(repeats.join(touched, ["doc", "tag"], "left_semi"))
    lists = every.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "edges")).alias("ranges"))
    return touched.join(lists, ["doc", "tag"], "left").select("doc", "tag", F.coalesce("ranges", F.array().cast("array<struct<start:int,edges:int>>")).alias("ranges"))


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = 64) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every row. bits: how much of the edge hashes is used."""
    docs = tagged(docs, key, text)
    marked = cut(_marked(docs, repeated_spans(docs, key, text, width, bits), key, text, width))
    claims = cut(unverified(marked, key))
    columns = [key, "n_words", "n_removed", "kept_sha256"]
    if claims.isEmpty():
        return marked.select(columns)
    wrong = cut(_own(marked, key).join(claims, _AT_SOURCE, "left_semi").drop("digest"))
    exact = cut(_sorted_out(docs, marked, wrong, key, text, width))
    there = exact.select(F.col("doc").alias("e_doc"), F.col("tag").alias("e_tag"), "ranges").hint("shuffle_hash")
    again = docs.join(there, (docs[key] == there["e_doc"]) & (docs["tag"] == there["e_tag"])).select(key, text, "ranges")
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            for body, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = body.encode().split()
                gone, kept = _kept(words, [(r["start"], r["edges"]) for r in ranges], width)
                n_words.append(len(words))
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=columns)

    corrected = again.mapInArrow(run, f"`{key}` {key_type}, n_words long, n_removed long, kept_sha256 string")
    same = marked.join(there, (marked[key] == there["e_doc"]) & (marked["tag"] == there["e_tag"]), "left_anti")
    return same.select(columns).unionByName(corrected)


def repeated_paths(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The nonbranching paths of the graph of repeated edges: src, src_start, edges, walks (documents that take it).

    A path branches wherever some document's walk joins or leaves its source's. The places where that happens are
    joined to the spans on the source, which are cut there; pieces that are the same range of the same source are one
    path.
    """
    docs = tagged(docs, key, text)
    marked = cut(_marked(docs, repeated_spans(docs, key, text, width), key, text, width))
    spans = cut(_own(marked, key).join(unverified(marked, key), _AT_SOURCE, "left_anti"))
    ends = spans.select("src", "src_tag", F.explode(F.array("src_start", F.col("src_start") + F.col("edges"))).alias("at"))
    branches = ends.groupBy("src", "src_tag").agg(F.array_sort(F.collect_set("at")).alias("ats"))  # at most one a word of the source
    inside = F.filter("ats", lambda a: (a >= F.col("src_start")) & (a <= F.col("src_start") + F.col("edges")))
    pieces = spans.join(branches, ["src", "src_tag"]).withColumn("cuts", inside)
    pairs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b")))
    pieces = pieces.select("src", "src_tag", F.explode(pairs).alias("p"))
    return pieces.groupBy("src", "src_tag", F.col("p.a").alias("src_start"), (F.col("p.b") - F.col("p.a")).alias("edges")).agg((F.count("*") + 1).alias("walks"))
