"""Approximate nearest neighbours by counting collisions in query-aware hashing.

Every vector is projected on random lines, and each projection is kept as a sorted array: one hash function, one
array. A query's bucket is the window of that array centred on the query's own projection, so no grid is fixed
beforehand; virtual rehashing widens the windows of all arrays together, round after round, without building anything
anew. At radius R a window reaches HALF times R to both sides, so a vector at distance R lies in it with a probability
known beforehand, the same for every line; a vector that lies in at least as many windows as one at distance R does in
two of three cases is verified, that is, its exact inner product is computed. Widening ends when R has reached the
distance of the last vector wanted, or when the windows cover everything.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), M the largest norm; for a
query, order by distance is then order by inner product. Where norms differ much, that coordinate would drown the
others, so vectors are dealt into bands of similar norms (within a factor of BAND), each with an M of its own.

Rows of a band are dealt by a hash into blocks of about BLOCK vectors, each with its own sorted arrays. A vector is sent
to its block once; queries stream past a block's arrays, so a task holds one block whatever the number of queries. As
blocks are dealt by a hash, a block has few of a query's k nearest; it looks for as many as it has of its band's in all
but one of a hundred cases (_wanted) and gives all it has verified, at most k. All rows are indexed. The bands of the
longest vectors are asked first; a query then goes on only to blocks of bands where a vector could still reach the k-th
product it has found (no product is over |q| M), which loses nothing. The number of lines follows from the share of a block that is looked for: the
smaller it is, the further the wanted vectors stand out from the rest, and the fewer lines tell them apart.

Each vector's place in every sorted array is kept, so a window is a range of places, and counting compares places with
ranges for whole arrays at a time. It is linear in a block for each query (as in the published methods of this kind,
windows hold a share of every array); what it saves is vectors fetched and multiplied: a few in a hundred. With random directions in 64 dimensions,
where the wanted are hardly nearer than the rest, a plain matrix product is faster than any counting.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id or of another length than the most frequent one's. Rows that repeat an id are each candidates. A query is not
its own candidate, by id. Equal products are ranked by the smaller id. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import erf, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.operators.storage import cut

SEED = 11
BLOCK = 8_192
#: Half a window's width at radius 1. Coefficients are standard normal: at distance R, four of five vectors are inside.
HALF = 1.3
#: A vector at distance R is verified at radius R if its count is at most this many deviations below the expected one.
SLACK = 0.4
#: Lines for a whole block of wanted vectors; the number falls with the root of their share.
LINES, FEWEST, MOST = 5_200, 160, 640
#: Lines counted at a time, 255 at most.
TOGETHER = 32
#: The first radius, as a share of those at which the last queries ended; radii grow by GROWTH.
FIRST, GROWTH = 0.85, 1.12
#: Norms of a band differ by at most this factor; the last of BANDS bands holds all that are smaller.
BAND, BANDS = 1.25, 64
#: The bands asked first hold at least this share of the vectors, and LEAD times as many as are wanted.
LEADING, LEAD = 0.02, 10
#: The bands asked next hold this share together with the first.
NEXT = 0.2


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id (long), v (array of double): rows that take part."""
    v = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _wanted(k: int, blocks: int) -> int:
    """How many of a query's k nearest one of so many blocks has, in 99 of 100 cases (at least 1)."""
    mean = k / blocks
    p = total = exp(-mean)
    n = 0
    while total < 0.99 and n < k:
        n += 1
        p *= mean / n
        total += p
    return k if blocks == 1 else max(1, n)


def _lines(share: float) -> int:
    return int(np.clip(LINES * sqrt(min(share, 1)), FEWEST, MOST))


class Block:
    """Sorted projections of some vectors on all lines, laid end to end so that one search serves all lines."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, wanted: int):
        n, size = vectors.shape
        m = _lines(wanted / n)
        self.ids, self.vectors, self.largest, self.wanted = ids, vectors, largest, wanted
        self.lines = np.random.default_rng(SEED).standard_normal((size + 1, m))
        extra = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        projected = np.hstack([vectors, extra[:, None]]) @ self.lines
        order = np.argsort(projected, axis=0, kind="stable")
        self.places = np.empty((m, n), np.uint16 if n < 2**16 else np.uint32)
        np.put_along_axis(self.places, order.T, np.arange(n, dtype=self.places.dtype)[None, :], axis=1)
        values = np.take_along_axis(projected, order, axis=0)
        # no window is wider than what holds everything; lines are set apart by more than that, so they don't mix
        self.all = float(np.abs(projected).max()) + float(np.sqrt((self.lines**2).sum(axis=0)).max()) * largest + 1e-9
        self.above = np.arange(m) * (4 * self.all)
        self.sorted = (values + self.above).T.ravel().copy()
        self.after, self.inside = np.empty((TOGETHER, n), self.places.dtype), np.empty((TOGETHER, n), bool)
        self.ends = np.arange(m) * n
        inside = erf(HALF / sqrt(2))
        self.threshold = max(1, int(m * inside - SLACK * sqrt(m * inside * (1 - inside))))
        self.start = largest
        self.asked = self.verified = 0

    def _counts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """In how many arrays each vector's place lies from left to right (without it). Places are unsigned, so those
        before left become very large; some lines at a time stay in the processor's cache."""
        m, n = self.places.shape
        first, width = ((x.astype(self.places.dtype)[:, None]) for x in (left - self.ends, right - left))
        counts = np.zeros(n, np.uint16)
        for i in range(0, m, TOGETHER):
            some = slice(i, min(i + TOGETHER, m))
            after, inside = self.after[: some.stop - i], self.inside[: some.stop - i]
            np.subtract(self.places[some], first[some], out=after)
            np.less(after, width[some], out=inside)
            counts += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return counts

    def search(self, query_id: int, query: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best of the vectors verified, best first, ties to smaller ids. Products under
        least are of no use: no radius beyond the distance of such a vector is needed."""
        n, m = len(self.ids), len(self.ends)
        scale = self.largest / np.sqrt(query @ query)
        centre = np.append(query * scale, 0.0) @ self.lines + self.above  # the query made as long as the longest vector
        low = high = np.clip(np.searchsorted(self.sorted, centre), self.ends, self.ends + n)
        taken = np.zeros(n, bool)
        verified, scores, found = [], [], 0
        useful = reach = sqrt(max(2 * (self.largest**2 - least * scale), 0)) if least > -np.inf else np.inf
        radius = min(self.start * FIRST, useful)
        while True:
            width = min(HALF * radius, self.all)
            bounds = np.searchsorted(self.sorted, np.concatenate([centre - width, centre + width]))
            left, right = np.minimum(bounds[:m], low), np.maximum(bounds[m:], high)
            if width >= self.all:
                left, right = self.ends, self.ends + n
            counts = self._counts(left, right)
            low, high = left, right
            new = np.flatnonzero((counts >= self.threshold) & ~taken)
            taken[new] = True
            self.verified += len(new)
            new = new[self.ids[new] != query_id]
            verified.append(new)
            scores.append(self.vectors[new] @ query)
            found += len(new)
            if found >= self.wanted:
                last = np.partition(np.concatenate(scores), -self.wanted)[-self.wanted]
                reach = min(useful, sqrt(max(2 * (self.largest**2 - last * scale), 0)))
            if width >= self.all or radius >= reach:
                break
            radius = min(radius * GROWTH, max(reach, radius * 1.01))
        self.asked += 1
        if useful == np.inf:
            self.start = 0.9 * self.start + 0.1 * radius
        near, score = np.concatenate(verified), np.concatenate(scores)
        if len(near) > k:
            best = np.partition(score, -k)[-k]
            near = near[score >= best - 1e-9 * abs(best)]
        score = (self.vectors[near] * query).sum(axis=1)  # equal vectors score equal, wherever they stand
        by = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][by], score[by]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, tally: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row of queries among the rows of vectors. tally may hold
    accumulators: asked and verified (queries of blocks, vectors whose products were computed) and blocks."""
    rows, wanted = usable(vectors, key, column), usable(queries, key, column)
    facts = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("rows"), "n").first()
    if facts is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    size, largest = facts["n"], float(np.sqrt(facts["norm"])) or 1.0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows, wanted = (df.where(F.size("v") == size).select("id", "v", norm.alias("norm")) for df in (rows, wanted))
    band = F.least(F.greatest(F.floor(F.log(F.lit(largest) / F.greatest(F.col("norm"), F.lit(1e-300))) / F.log(F.lit(BAND))), F.lit(0)), F.lit(BANDS - 1)).cast("int")
    rows = rows.withColumn("band", band)
    held = {r["band"]: r for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # BANDS rows at most
    bands = sorted(held)
    blocks = [max(1, -(-held[b]["n"] // block)) for b in bands]
    starts = np.concatenate([[0], np.cumsum(blocks)])  # the blocks of a band follow each other
    tops = [held[b]["top"] or 1.0 for b in bands]
    so_far = np.cumsum([held[b]["n"] for b in bands])
    # the bands are asked in turns, longest vectors first; each turn ends where so many vectors have been asked
    turns = sorted({min(len(bands), 1 + int(np.searchsorted(so_far, x))) for x in (max(LEAD * k, LEADING * so_far[-1]), NEXT * so_far[-1], so_far[-1])})
    lookup = F.create_map(*[x for i, b in enumerate(bands) for x in (F.lit(b), F.struct(F.lit(int(starts[i])).alias("start"), F.lit(blocks[i]).alias("blocks")))])
    in_band = lookup[F.col("band")]
    here = rows.select((in_band["start"] + F.pmod(F.xxhash64("id"), in_band["blocks"])).cast("int").alias("block"), F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("double").alias("least"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's blocks one after another, each with its vectors first and then the queries."""
        index, at, held_ids, held_vectors = None, None, [], []
        for batch in batches:
            of, asks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            every = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            least = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False), nan=-np.inf)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if of[a] != at:
                    index, at, held_ids, held_vectors = None, of[a], [], []
                if not asks[a]:
                    held_ids.append(ids[a:b].copy())
                    held_vectors.append(every[a:b].copy())
                    continue
                if held_vectors:
                    i = int(np.searchsorted(starts, at, "right")) - 1
                    index, held_ids, held_vectors = Block(np.concatenate(held_ids), np.concatenate(held_vectors), tops[i], _wanted(k, blocks[i])), [], []
                before = index.verified if index else 0
                for q, v, t in zip(ids[a:b].tolist(), every[a:b], least[a:b].tolist(), strict=True) if index else ():
                    found, score = index.search(q, v, k, t)
                    out.append((np.full(len(found), q), found, score))
                if tally is not None and index:
                    tally["asked"].add(b - a)
                    tally["verified"].add(index.verified - before)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    def asked(those: DataFrame, first: int, last: int) -> DataFrame:
        """What queries (id, v, bands: how many each goes to, least: a product that is of use) find in the bands from first to last."""
        steps = F.explode(F.sequence(F.lit(int(starts[first])), F.element_at(F.array(*[F.lit(int(x) - 1) for x in starts[1:]]), F.col("bands"))))
        there = those.where(F.col("bands") > first).select(steps.alias("block"), F.lit(True).alias("is_query"), "id", "v", "least")
        mine = here.where((F.col("block") >= int(starts[first])) & (F.col("block") < int(starts[last])))
        dealt = mine.unionByName(there).repartition(int(starts[last] - starts[first]), "block").sortWithinPartitions("block", "is_query", "id")
        return dealt.mapInArrow(search, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = asked(wanted.withColumns({"bands": F.lit(turns[0]), "least": F.lit(None).cast("double")}), 0, turns[0])
    for first, last in pairwise(turns):
        found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least")).distinct()
        # a product is at most the norms' product, so bands are of use as long as that reaches what is there
        reach = F.size(F.filter(F.array(*map(F.lit, tops[:last])), lambda t: F.col("least").isNull() | (t * F.col("norm") * (1 + 1e-9) >= F.col("least"))))
        found = found.drop("rank").unionByName(asked(wanted.join(kth, "id", "left").withColumn("bands", reach), first, last))
    if tally is not None:
        tally["blocks"].add(int(starts[-1]))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbour_report(vectors: DataFrame, key: str = "vec_id", every: int = 20, k: int = 20) -> DataFrame:
    """The stated queries, ids divisible by every, against all rows."""
    return nearest(vectors, vectors.where(F.col(key) % every == 0), k, key)


__all__ = ["Block", "nearest", "neighbour_report", "usable"]
