"""Chat formatting after collapsing cumulative snapshots.

Loggers often write a conversation again after each reply, so many logged conversations are just the beginning of
longer ones. Every turn's prefix gets a rolling hash: the running sum, over the turns so far, of two independent
64-bit hashes of (position, role, text), exact in decimals. A conversation is the beginning of a longer one if its last
prefix hash is a prefix hash that some longer conversation passes through; an anti-join with the distinct passed
hashes leaves the maximal conversations. Of equal ones the smallest id stays. Only those left are rendered.

Turns are never gathered before rendering, and what hot first turns have in common is made distinct before the join.

Defined results: rows are ordered by turn (nulls first), then role and text; rows that repeat wholly count once. A
null role or text is an empty one. A row without a conversation id belongs to no other: it is a conversation of one
turn, with a null id. An empty table gives an empty result. Other columns are ignored, whatever their names. A rendered
conversation is one row, so it must fit in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame, key: str, order: str) -> DataFrame:
    """conv, alone (tells rows without a conversation apart), turn, role, text; each different row once."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    alone = F.when(F.col(key).isNull(), F.sha2(F.concat_ws("\u001f", F.coalesce(F.col(order).cast("string"), F.lit("")), role, text), 256))
    return turns.select(F.col(key).alias("conv"), F.coalesce(alone, F.lit("")).alias("alone"), F.col(order).alias("turn"), role.alias("role"), text.alias("text")).distinct()


def prefix_hashes(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """conv, alone, place (from 1), role, text, is_last, and hash: the rolling hash of the turns up to this one."""
    in_order = Window.partitionBy("conv", "alone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _turns(turns, key, order).withColumn("place", F.row_number().over(in_order)).withColumn("is_last", F.lead("role").over(in_order).isNull())
    one, two = (F.xxhash64(F.lit(salt), "place", "role", "text").cast("decimal(20,0)") for salt in ("turn", "check"))
    return rows.withColumn("hash", F.struct(F.sum(one).over(so_far).alias("a"), F.sum(two).over(so_far).alias("b")))


def maximal(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """conv, alone and n_turns of the conversations that are no beginning of a longer one; copies is how many equal ones
    it stands for, itself included. Of equal ones the smallest id stays, one without id only if none has one."""
    steps = prefix_hashes(turns, key, order)
    first = F.min(F.struct(F.col("conv").isNull().alias("unnamed"), "conv", "alone"))
    whole = steps.where("is_last").groupBy("place", "hash").agg(first.alias("first"), F.count("*").alias("copies"))
    passed = steps.where(~F.col("is_last")).select("place", "hash").distinct()
    left = whole.join(passed, ["place", "hash"], "left_anti")
    return left.select("first.conv", "first.alone", F.col("place").cast("long").alias("n_turns"), "copies")


def formatted(turns: DataFrame, key: str = "conv_id", order: str = "turn", opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """One row for each maximal conversation: key, n_turns, copies, chat."""
    keep = maximal(turns, key, order).select(F.col("conv").alias("kept"), F.col("alone").alias("kept_alone"), "n_turns", "copies")
    rows = _turns(turns, key, order)
    rows = rows.join(keep, rows["conv"].eqNullSafe(keep["kept"]) & (rows["alone"] == keep["kept_alone"]))
    said = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")))
    line = F.transform("said", lambda t: F.concat(F.lit(opening), t["role"], F.lit("\n"), t["text"], F.lit(closing)))
    gathered = rows.groupBy("conv", "alone", "n_turns", "copies").agg(said.alias("said"))
    return gathered.select(F.col("conv").alias(key), "n_turns", "copies", F.array_join(line, "\n").alias("chat"))
