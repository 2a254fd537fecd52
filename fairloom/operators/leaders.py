"""Matching rows of a run with what is known and with each other, as if they came one at a time.

A name that comes first and matches nothing becomes known itself (a leader); later names may match it. Which names do
so depends on the names before them: the result is the fixpoint of that rule over the graph of similar names. It is
found in rounds of joins. A name is settled as soon as no name before it that is still open can change its outcome:

* it matches its best candidate if that is good enough and leads all others, the open ones too, by the margin;
* it is a leader if its candidates don't decide and no open one would by itself;
* and in any case when no similar name before it is open, so every round settles at least the first open name.

Every round keeps only the edges between open names. Nothing is gathered: a name's two best candidates are all that is
kept of its neighbours. The number of rounds is the longest chain of names that wait for each other, which for names in
no particular order grows with the logarithm of their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairloom.operators.similarity import scored_pairs
from fairloom.operators.storage import cut


def sure(best: Column, second: Column, accept: float, margin: float) -> Column:
    """If the best candidate is good enough and leads the second clearly, or is the only one."""
    return (best >= accept) & ((best - second >= margin) | (second <= 0))


def two_best(candidates: DataFrame, name: str = "name") -> DataFrame:
    """name, best, key, second of each name's candidates (name, key, sim). Between equals the smallest key is best."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("sim"), F.col("key").asc_nulls_last()))
    top = candidates.withColumn("place", place).where("place <= 2").groupBy(name)
    first, second = F.col("place") == 1, F.col("place") == 2
    return top.agg(F.max(F.when(first, F.col("sim"))).alias("best"), F.max(F.when(first, F.col("key"))).alias("key"), F.coalesce(F.max(F.when(second, F.col("sim"))), F.lit(0.0)).alias("second"))


def ordered_leaders(names: DataFrame, known: DataFrame, accept: float = 0.90, margin: float = 0.05, log: float = 0.85, max_rounds: int = 500) -> DataFrame:
    """name, key: what each of names (name, place; places differ) matches: a key of known (key, name), or the name of
    its leader, with is_leader true where that is itself. known_key says which. Ratios below log count as none, which
    is exact where accept - log is at least margin."""
    if accept - log < margin - 1e-9:
        raise ValueError("log must be at least margin below accept")
    at_first = scored_pairs(names.select("name"), known.select(F.col("key").cast("string").alias("key"), F.col("name").alias("known_name")), "name", "known_name", log)
    edges = scored_pairs(names, names.select(F.col("name").alias("other"), F.col("place").alias("other_place")), "name", "other", log).where("other_place < place").select("name", "other", "sim")
    edges = cut(edges)
    none = F.lit(0.0)
    best = two_best(at_first.select("name", F.struct(F.lit(0).alias("run"), F.col("key").alias("id")).alias("key"), "sim"))
    todo = cut(names.select("name").join(best, "name", "left").select("name", F.coalesce("best", none).alias("best"), "key", F.coalesce("second", none).alias("second")))
    settled = []
    for _ in range(max_rounds):
        open_best = edges.groupBy("name").agg(F.max("sim").alias("open"))
        state = todo.join(open_best, "name", "left")
        b, s, o = F.col("best"), F.col("second"), F.col("open")
        now = sure(b, s, accept, margin)
        matched = now & (o.isNull() | (b - o >= margin))
        leader = ~now & (o.isNull() | ~sure(o, b, accept, margin))
        state = cut(state.select("name", "best", "key", "second", matched.alias("matched"), leader.alias("is_leader")))
        done = state.where("matched or is_leader")
        settled.append(done.select("name", "is_leader", F.when(~F.col("is_leader"), F.col("key")).alias("key")))
        todo = state.where("not (matched or is_leader)").select("name", "best", "key", "second")
        if not todo.take(1):
            break
        # edges of open names: those to new leaders become candidates, those to names that matched go, the rest wait
        still = edges.join(todo.select("name"), "name", "left_semi").join(done.select(F.col("name").alias("other"), "is_leader"), "other", "left")
        still = cut(still.select("name", "other", "sim", "is_leader"))
        fresh = still.where("is_leader").select("name", F.struct(F.lit(1).alias("run"), F.col("other").alias("id")).alias("key"), "sim")
        before = todo.where("key is not null").select("name", "key", F.col("best").alias("sim"))
        behind = todo.where("second > 0").select("name", F.lit(None).cast(before.schema["key"].dataType).alias("key"), F.col("second").alias("sim"))
        merged = two_best(fresh.unionByName(before).unionByName(behind))
        todo = cut(todo.select("name").join(merged, "name", "left").select("name", F.coalesce("best", none).alias("best"), "key", F.coalesce("second", none).alias("second")))
        edges = still.where("is_leader is null").select("name", "other", "sim")
    else:
        raise RuntimeError(f"names haven't settled after {max_rounds} rounds")
    rows = reduce(DataFrame.unionByName, settled)
    in_run = F.col("key.run") == 1
    return rows.select("name", "is_leader", F.when(~in_run, F.col("key.id")).alias("known_key"), F.when(F.col("is_leader"), F.col("name")).when(in_run, F.col("key.id")).alias("leader"))


def numbered_in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows with n, numbered from 1 in the given order (without one: in the order they have) without gaps. Rows are sorted
    over all partitions; only the partitions' sizes, one row each, are summed up in one place."""
    placed = cut(rows.orderBy(*order) if order else rows).withColumn("id_", F.monotonically_increasing_id())
    placed = placed.withColumns({"part_": F.shiftright("id_", 33), "in_part_": F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("part_").agg(F.count("*").alias("size_"))
    before = sizes.select("part_", (F.sum("size_").over(Window.orderBy("part_")) - F.col("size_")).alias("before_"))
    return placed.join(F.broadcast(before), "part_").withColumn("n", F.col("before_") + F.col("in_part_") + 1).drop("id_", "part_", "in_part_", "before_")
