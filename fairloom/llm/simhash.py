"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link at MAX_BITS or fewer differing bits. Links
are found by walking pairs of trie nodes from the root together: a pair's differing bits are added up level by level
and the pair is left as soon as the error budget is exceeded.

On the cluster the walk is dealt out by the pigeonhole rule: of four 16-bit blocks, two fingerprints that differ in
at most three bits share at least one. The trie is therefore kept in four bit orders, each starting with another
block, and in each order only node pairs without a difference in the first block are followed; the node below that
block is the key rows are shuffled by (four short rows a distinct fingerprint). A node with more than NODE_LIMIT
fingerprints is dealt as pairs of chunks, so no task holds more than two chunks of it. Equal fingerprints are one
leaf. Tasks keep a union-find of what they have linked, skip node pairs that are wholly linked already, and send on
at most one link a fingerprint, so a dense group of near copies costs no more than its own size.

Defined results: null and wordless texts have fingerprint 0 and link like any other. Repeated rows and null ids are
kept; a group of which every id is null has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.llm.common import unused, without
from fairloom.llm.copies import copy_groups
from fairloom.operators.graph import connected_components
from fairloom.operators.storage import cut

SHINGLE_WORDS, SEED, BITS, MAX_BITS = 3, 42, 64, 3
BLOCK_BITS = 16
NODE_LIMIT = 30_000
#: Node pairs a task looks at together, and leaf pairs below which a node pair is compared directly.
FRONTIER, DIRECT = 400_000, 16
ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """As a signed 64-bit number; bits set in over half the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(line, SEED)], np.uint64)
    else:
        ends = np.fromiter(map(len, words), np.int64, len(words))
        np.cumsum(ends, out=ends)
        ends += np.arange(len(words))
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """docs without their texts, with the column fp (long)."""
    base = without(docs, "fp")
    kept = [c for c in base.columns if c != text]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in base.schema.fields if f.name != text), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array((fingerprint(x.as_py(), width) for x in batch.column(text)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, "fp"])

    return base.mapInArrow(run, schema)


class Groups:
    """Union-find over 0..n-1; the smallest member is a group's root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the groups of every a and its b, by hooking roots to smaller roots until nothing moves."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while len(r) and (r != (up := self.parent[r])).any():
            r = up
        self.parent[x] = r
        return r


def trie_links(values: np.ndarray, unit: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b, one for each value that isn't its group's root) among equal units' values, sorted by
    (unit, value), whose low bits differ in at most budget places. Higher bits are equal within a unit."""
    n = len(values)
    groups = Groups(n)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    tails = np.concatenate([heads[1:], [n]])
    several = tails - heads > 1
    heads, tails = heads[several], tails[several]
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(bit: int) -> np.ndarray:
        if bit not in zeros:
            zeros.clear()
            zeros[bit] = np.concatenate([[0], np.cumsum(((values >> np.uint64(bit)) & ONE) == 0)])
        return zeros[bit]

    def settled(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        """Node pairs all of whose leaves are in one group already."""
        root = groups.roots(np.arange(n))
        change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        return (change[lo_a] == change[hi_a - 1]) & (change[lo_b] == change[hi_b - 1]) & (root[lo_a] == root[lo_b])

    stack = [(bits, heads[i : i + FRONTIER], tails[i : i + FRONTIER], heads[i : i + FRONTIER], tails[i : i + FRONTIER], np.zeros(len(heads[i : i + FRONTIER]), np.int64)) for i in range(0, len(heads), FRONTIER)]
    linked = False
    while stack:
        level, la, ha, lb, hb, diff = stack.pop()
        if linked:
            open_ = ~settled(la, ha, lb, hb)
            la, ha, lb, hb, diff = (x[open_] for x in (la, ha, lb, hb, diff))
        few = (ha - la) * (hb - lb) <= DIRECT
        few |= level == 0
        if few.any():
            wide = hb[few] - lb[few]
            pairs = (ha[few] - la[few]) * wide
            for part in np.array_split(np.arange(len(pairs)), max(1, int(pairs.sum()) // (4 * FRONTIER))):
                p, w = pairs[part], wide[part]
                of = np.repeat(np.arange(len(p)), p)
                k = np.arange(len(of)) - np.repeat(np.cumsum(p) - p, p)
                a, b = la[few][part][of] + k // w[of], lb[few][part][of] + k % w[of]
                near = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
                if near.any():
                    groups.link(a[near], b[near])
                    linked = True
        la, ha, lb, hb, diff = (x[~few] for x in (la, ha, lb, hb, diff))
        if not len(la):
            continue
        level -= 1
        z = zeros_before(level)
        ma, mb = la + z[ha] - z[la], lb + z[hb] - z[lb]
        same = la == lb
        children = [
            (la, ma, lb, mb, diff, None), (ma, ha, mb, hb, diff, None),
            (la, ma, mb, hb, diff + 1, None), (ma, ha, lb, mb, diff + 1, ~same),
        ]
        parts = []
        for c_la, c_ha, c_lb, c_hb, c_diff, only in children:
            keep = (c_la < c_ha) & (c_lb < c_hb) & (c_diff <= budget)
            if only is not None:
                keep &= only
            parts.append([x[keep] for x in (c_la, c_ha, c_lb, c_hb, c_diff)])
        la, ha, lb, hb, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        for i in range(0, len(la), FRONTIER):
            stack.append((level, *(x[i : i + FRONTIER] for x in (la, ha, lb, hb, diff))))
    root = groups.roots(np.arange(n))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _rotated(fp: F.Column, order: int) -> F.Column:
    """The fingerprint with another block in front."""
    by = BLOCK_BITS * order
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect what differs in max_bits bits or fewer.

    Every link between two fingerprints is there or implied by others that are. max_bits must be under 4.
    """
    if not 0 <= max_bits < BITS // BLOCK_BITS:
        raise ValueError("four blocks allow at most three differing bits")
    fp = F.col("fp")
    orders = F.array(*[F.struct(F.lit(k).cast("long").alias("o"), _rotated(fp, k).alias("v")) for k in range(BITS // BLOCK_BITS)])
    rows = fps.select(F.explode(orders).alias("x")).select(
        "x.o", "x.v", (F.shiftrightunsigned(F.col("x.v"), BITS - BLOCK_BITS) * 4 + F.col("x.o")).alias("node"),
    )
    sizes = rows.groupBy("node").count().where(F.col("count") > node_limit)
    chunks = F.ceil(F.col("count") / (node_limit // 2)).cast("int")
    hot = cut(sizes.select(F.col("node").alias("hot"), chunks.alias("chunks")))
    if hot.isEmpty():
        rows = rows.select("o", "v", "node", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        mine = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.coalesce("chunks", F.lit(1)))).cast("int")
        rows = (
            rows.join(hot, rows["node"] == hot["hot"], "left").withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
            .select("o", "v", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(x.num_rows for x in held):
            return
        got = pa.Table.from_batches(held)
        o, v, node, i, j = (got.column(c).to_numpy() for c in ("o", "v", "node", "i", "j"))
        v = v.view(np.uint64)
        by = np.lexsort((v, j, i, node))
        o, v, node, i, j = o[by], v[by], node[by], i[by], j[by]
        first = np.concatenate([[True], (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        a, b = trie_links(v, np.cumsum(first), BITS - BLOCK_BITS, max_bits)

        def back(at: np.ndarray) -> np.ndarray:
            by = (o[at] * BLOCK_BITS).astype(np.uint64)
            left = np.where(by == 0, v[at], v[at] >> by | v[at] << ((np.uint64(BITS) - by) % np.uint64(BITS)))
            return left.view(np.int64)

        yield pa.RecordBatch.from_arrays([pa.array(back(a)), pa.array(back(b))], names=["a", "b"])

    return rows.repartition("node", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """key, fp and component (the smallest key that can be reached over links) of every document."""
    marked = cut(with_fingerprints(docs.select(key, text), text, width))
    leaves = cut(marked.groupBy("fp").agg(F.min(key).alias("first_key")))
    members = connected_components(cut(near_links(leaves, max_bits)))
    grouped = leaves.join(members, leaves["fp"] == members["node"], "left").select(
        "fp", "first_key", F.coalesce("component", "fp").alias("root"),
    )
    lowest = grouped.groupBy("root").agg(F.min("first_key").alias("component"))
    named = grouped.join(lowest, "root").select(F.col("fp").alias("leaf"), "component")
    return marked.join(named, marked["fp"] == named["leaf"]).select(key, "fp", "component")


def component_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    groups = near_groups(docs, key)
    return groups.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every group of edited copies (see copies) the document with the smallest key.

    Where a key repeats, each different text of it is a document; of equal rows one stays. Rows without a key stay: they
    can't be named as anyone's copy.
    """
    named = copy_groups(docs.where(F.col(key).isNotNull()), near_links, key, text)
    kept = named.groupBy("root").agg(F.min(F.struct("first_key", "leaf")).alias("k")).select(F.col("k.first_key").alias("kept_key"), F.col("k.leaf").alias("kept_leaf"))
    leaf = unused("leaf_", *docs.columns)
    rows = docs.withColumn(leaf, F.xxhash64(text))
    out = rows.join(kept.hint("shuffle_hash"), (rows[key] == kept["kept_key"]) & (rows[leaf] == kept["kept_leaf"]), "left_semi")
    if not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        out = out.dropDuplicates([key, leaf])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns).unionByName(docs.where(F.col(key).isNull()))
