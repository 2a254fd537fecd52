"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Every document is streamed once through the automaton, one transition a word; the state's matching length tells
how many of the last words also stand together in some item.

Items are cut into pieces that overlap by a window less a word. A benchmark of at most BLOCK_WORDS words is one
automaton, sent to the executors, and nothing is shuffled. A larger one is dealt into blocks of about as many words,
and memory doesn't follow its size: a bitmap of BITMAP_BITS bits, whatever the number of items, tells which documents
may hold a window; hashes of their windows are joined with the items' to find the blocks concerned; and block by
block the texts concerned stream past the block's automaton, built in the task, one at a time. Blocks with many texts
are dealt out several times. What was found is narrow, and goes back to its texts by a digest.

Defined results: a null or wordless text has no words and no hits. Items without words are ignored; repeated items
count once by id; an item without id still makes hits but isn't listed. Repeated document rows are each judged.
Columns of the input that clash with result columns are replaced, others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.llm.common import flat_bytes, range_hashes, split_words, unused, without, word_hashes
from fairloom.operators.storage import cut

WINDOW = 10
BLOCK_WORDS = 50_000
BITMAP_BITS = 27
#: Texts that one task streams past a block's automaton.
BLOCK_TEXTS = 20_000
#: A document of which more than this share is benchmark text is rejected as a whole.
MAX_COVERAGE = 0.5

_TABLE = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_HITS = "struct<n_words:long,n_hit:long,hit_items:array<string>,hit_spans:array<struct<start:int,end:int>>>"
_HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_items", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


_IN_WORD = np.array([c != 32 for c in _TABLE])


def normalised(text: str | None) -> bytes:
    """Same length in bytes as the text: A-Z lower-cased, all that isn't part of a word blank."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


class SuffixAutomaton:
    """All substrings of all items, over word numbers; each state knows the items it occurs in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for k, words in items if words]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        self.items: list[set] = [set() for _ in self.next]
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for name, word_ids in coded:
            v = 0
            for c in word_ids:
                v = u = self.next[v][c]
                while u > 0 and name not in self.items[u]:
                    self.items[u].add(name)
                    u = self.link[u]
            if len(word_ids) < window:
                ends.setdefault(v, []).append((len(word_ids), name))
        # short items that end wherever a state ends: its own and those of its suffixes
        self.short: list[tuple] = [()] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.short[v] = tuple(ends.get(v, ())) + (self.short[self.link[v]] if v else ())
        self.shortest = min([window, *(len(w) for _, w in coded)])

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that holds exactly p's longest string followed by c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges covered by item windows, merged, and the items these windows are from."""
        get, following, link, length, window = self.vocabulary.get, self.next, self.link, self.length, self.window
        known = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        spans: list[tuple[int, int]] = []
        found: set = set()
        gaps = np.concatenate([[-1], np.flatnonzero(known < 0), [len(known)]])
        runs = np.flatnonzero(np.diff(gaps) > self.shortest)  # no window fits between nearer unknown words
        for first, stop in zip((gaps[runs] + 1).tolist(), gaps[runs + 1].tolist(), strict=True):
            v = n = 0
            for i, c in enumerate(known[first:stop].tolist(), first + 1):
                following_v = following[v]
                while c not in following_v:
                    v = link[v]
                    n = length[v]
                    following_v = following[v]
                v = following_v[c]
                n += 1
                at = i
                if n >= window:
                    u = v
                    while length[link[u]] >= window:
                        u = link[u]
                    found |= self.items[u]
                    at = i - window
                for size, name in self.short[v]:
                    if size <= n:
                        found.add(name)
                        at = min(at, i - size)
                if at < i:
                    while spans and spans[-1][1] >= at:
                        at = min(at, spans.pop()[0])
                    spans.append((at, i))
        return spans, found


def item_pieces(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> DataFrame:
    """name, body (normalised words), n (words): items in pieces of at most a quarter of a block, with the words that
    windows reach over to the next piece."""
    step = max(window, block_words // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised(body).split()
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), step):
                    part = words[at : at + step + window - 1]
                    out.append((name, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["name", "body", "n"])

    return items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(run, "name string, body binary, n long")


def window_hashes(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every size: hashes of all windows of that many words, and the texts they are in."""
    raw, at = flat_bytes(texts)
    raw = np.frombuffer(_TABLE, np.uint8)[raw]
    starts, ends, of = split_words(raw, at, _IN_WORD)
    words = word_hashes(raw, starts, ends)
    for size in sizes:
        first = np.arange(max(0, len(words) - size + 1))
        first = first[of[first] == of[first + size - 1]]
        yield range_hashes(words, first, first + size), of[first]


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _matcher(machine: SuffixAutomaton):
    """A function of texts: what the automaton finds in them."""

    @F.arrow_udf(_HITS)
    def matched(texts: pa.Array) -> pa.Array:
        found = []
        for body in texts:
            words = normalised(body.as_py()).split()
            spans, names = machine.matches(words)
            found.append({"n_words": len(words), "n_hit": sum(e - s for s, e in spans), "hit_items": sorted(x for x in names if x is not None), "hit_spans": [{"start": s, "end": e} for s, e in spans]})
        return pa.array(found, _HITS_ARROW)

    return matched.asNondeterministic()  # else a filter on the result would run it twice


def _together(texts: Column, found: Column) -> Column:
    """What several blocks found in a text, as one."""

    @F.arrow_udf(_HITS)
    def joined(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for body, parts in zip(texts, found, strict=True):
            spans, names = [], set()
            for part in parts.as_py() or ():
                spans = _union(spans, [(s["start"], s["end"]) for s in part["spans"]])
                names |= set(part["names"])
            out.append({"n_words": len(normalised(body.as_py()).split()), "n_hit": sum(e - s for s, e in spans), "hit_items": sorted(names), "hit_spans": [{"start": s, "end": e} for s, e in spans]})
        return pa.array(out, _HITS_ARROW)

    return joined.asNondeterministic()(texts, found)


def _digests(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(salt), F.col(text)).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]


def block_hits(texts: DataFrame, pieces: DataFrame, window: int, blocks: int) -> DataFrame:
    """h1, h2, found (array of spans and names) for the texts (column text) that hold a window of any piece."""
    pieces = cut(pieces.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)).cast("int")))
    sizes = sorted(r[0] for r in pieces.select(F.least("n", F.lit(window))).distinct().collect())  # at most window of them

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.minimum(batch.column("n").to_numpy(), window)
            block = batch.column("block").to_numpy()
            for size, (hashes, of) in zip(sizes, window_hashes(batch.column("body").cast(pa.string()), sizes), strict=True):
                mine = n[of] == size
                yield pa.RecordBatch.from_arrays([pa.array(hashes[mine].view(np.int64)), pa.array(block[of[mine]])], names=["gram", "block"])

    grams = cut(pieces.mapInArrow(of_pieces, "gram long, block int").distinct())
    word_bits = BITMAP_BITS - 6
    place, bit = F.col("gram").bitwiseAND(F.lit((1 << word_bits) - 1)), F.shiftrightunsigned("gram", word_bits).bitwiseAND(F.lit(63))
    marks = grams.groupBy(place.cast("int").alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(1 << word_bits, np.uint64)  # its size is fixed, and so is the most that came here
    bitmap[marks["place"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            for hashes, of in window_hashes(batch.column("text"), sizes):
                there = (bitmap[(hashes & np.uint64((1 << word_bits) - 1)).astype(np.int64)] >> ((hashes >> np.uint64(word_bits)) & np.uint64(63))) & np.uint64(1)
                at = np.flatnonzero(there)
                if len(at):
                    rows = pa.array(of[at])
                    yield pa.RecordBatch.from_arrays([batch.column("h1").take(rows), batch.column("h2").take(rows), pa.array(hashes[at].view(np.int64))], names=["h1", "h2", "gram"])

    texts = texts.select("text", *_digests("text"))
    wanted = cut(texts.mapInArrow(of_texts, "h1 long, h2 long, gram long").join(grams, "gram").select("block", "h1", "h2").distinct())
    deals = wanted.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("deals"))
    rows = wanted.join(deals, "block").select("block", F.pmod("h1", "deals").cast("int").alias("deal"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    bodies = texts.join(rows, (texts["h1"] == rows["w1"]) & (texts["h2"] == rows["w2"])).select("block", "deal", F.lit(1).alias("kind"), "h1", "h2", F.lit(None).cast("string").alias("name"), F.col("text").cast("binary").alias("body"))
    machines = pieces.join(deals, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "name", "body")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, machine = None, [], None
        span, names = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
        for batch in batches:
            out: list[tuple] = []
            for block, deal, kind, h1, h2, name, body in zip(*(batch.column(i) for i in range(7)), strict=True):
                if (block, deal) != at:
                    at, held, machine = (block, deal), [], None
                if kind.as_py() == 0:
                    held.append((name.as_py(), body.as_py().split()))
                    continue
                if machine is None:
                    machine, held = SuffixAutomaton(held, window), []
                spans, found = machine.matches(body.as_py().translate(_TABLE).split())
                if spans:
                    out.append((h1.as_py(), h2.as_py(), [{"start": s, "end": e} for s, e in spans], [x for x in found if x is not None]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), span, names))], names=["h1", "h2", "spans", "names"])

    met = machines.unionByName(bodies).repartition("block", "deal").sortWithinPartitions("block", "deal", "kind")
    found = met.mapInArrow(match, "h1 long, h2 long, spans array<struct<start:int,end:int>>, names array<string>")
    return cut(found.distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("spans", "names")).alias("found")))


def match_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit_spans (word ranges, end exclusive), hit_items (ids as strings, sorted), n_words and n_hit."""
    added = ("n_words", "n_hit", "hit_items", "hit_spans")
    base = without(docs, *added)
    kept = [F.col(f"`{c}`") for c in base.columns]
    hits, h1, h2, found = (unused(c, *docs.columns) for c in ("hits_", "h1_", "h2_", "found_"))
    pieces = item_pieces(items, item_id, item_text, window, block_words)
    words = pieces.agg(F.sum("n")).first()[0] or 0
    if words <= block_words:
        rows = pieces.select("name", "body").collect()
        out = base.withColumn(hits, _matcher(SuffixAutomaton([(r["name"], bytes(r["body"]).split()) for r in rows], window))(F.col(text)))
    else:
        narrow = block_hits(docs.select(F.col(text).alias("text")).where("text is not null"), pieces, window, -(-words // block_words))
        narrow = narrow.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("found").alias(found))
        one, two = (x for x in _digests(text))
        out = base.join(narrow, (one == F.col(h1)) & (two == F.col(h2)), "left").withColumn(hits, _together(F.col(text), F.col(found)))
    return out.select(*kept, *[F.col(f"{hits}.{c}").alias(c) for c in added])


def _cut_words(body: str | None, spans: list) -> str | None:
    """The text without the word ranges; what stands between the words of a range goes with it."""
    if body is None or not spans:
        return body
    raw, flat = body.encode("utf-8", "surrogatepass"), normalised(body)
    marks = np.frombuffer(b" " + flat + b" ", np.uint8) != 32
    starts, ends = np.flatnonzero(~marks[:-1] & marks[1:]), np.flatnonzero(marks[:-1] & ~marks[1:])
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """docs without benchmark passages: every hit span is cut out of the text, and documents of which more than
    max_coverage is hit go as a whole. Columns as they were; n_chars, where there is one, follows the new text."""
    row = unused("row_", text)  # the columns as they came, so that none clashes with what is added
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(text))
    hit = match_items(whole, items, text=text, **options)
    hit = hit.where(F.col("n_hit") <= F.col("n_words") * F.lit(float(max_coverage)))

    @F.arrow_udf("string")
    def cleaned(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(bodies.to_pylist(), spans, strict=True)
        return pa.array([None if b is None else _cut_words(b, [(x["start"], x["end"]) for x in s.as_py()]) for b, s in pairs], pa.string())

    touched = F.col("n_hit") > 0
    out = hit.withColumn("clean_", cleaned(F.when(touched, F.col(text)), F.col("hit_spans")))  # clean texts stay where they are

    def column(name: str) -> Column:
        old = F.col(f"{row}.`{name}`")
        if name == text:
            return F.when(touched, F.col("clean_")).otherwise(F.col(text)).alias(name)
        if name == "n_chars":
            return F.when(touched, F.length("clean_")).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        return old.alias(name)

    return out.select(*map(column, docs.columns))


def contamination_report(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    hit = match_items(docs.select(key, "text"), items)
    listed = F.array_join("hit_items", ",")
    return hit.select(
        key, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


__all__ = ["SuffixAutomaton", "contamination_report", "decontaminate", "match_items"]
