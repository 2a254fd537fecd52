"""Fuzzy matching by the Ratcliff-Obershelp ratio, with candidates cut down by bounds that lose nothing.

The ratio of a and b is 2M / (len(a) + len(b)), M the characters that match; it depends on the order of a and b, so
it is computed by Python's difflib in an Arrow-batched function, and only for pairs that share rare bigrams and whose
upper bounds reach the threshold: 2 min(len) / (sum of lengths), then 2 |common characters| / (sum of lengths).
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fairloom.functions.text import normalize_name, norm_en


def ratio_from(least: float):
    """difflib's ratio as a function of two columns; 0 if either is blank or an upper bound stays below least."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher = difflib.SequenceMatcher(None)
        last, out = None, []
        for x, y in zip(a, b, strict=True):
            if not x or not y:
                out.append(0.0)
                continue
            if y != last:  # the second sequence is the one that is prepared
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            out.append(0.0 if least and matcher.quick_ratio() < least else matcher.ratio())
        return pd.Series(out, dtype="float64")

    return run


ratio = ratio_from(0.0)


def leading_names(least: float):
    """For each name of a short sorted array without repeats, the first name it is linked to: names whose ratio, taken in
    their order, is at least the least are linked, and so are those linked to the same one."""

    @F.pandas_udf("array<string>")
    def run(groups: pd.Series) -> pd.Series:
        matcher = difflib.SequenceMatcher(None)
        out = []
        for names in groups:
            first = list(range(len(names)))
            for j, y in enumerate(names):
                matcher.set_seq2(y)
                for i, x in enumerate(names[:j]):
                    matcher.set_seq1(x)
                    if first[i] != first[j] and (matcher.ratio() if x and y else 0.0) >= least:
                        low, high = sorted((first[i], first[j]))
                        first = [low if f == high else f for f in first]
            out.append([names[f] for f in first])
        return pd.Series(out)

    return run


def length_bound(a: Column, b: Column) -> Column:
    la, lb = F.char_length(a), F.char_length(b)
    return 2.0 * F.least(la, lb) / F.greatest(la + lb, F.lit(1))


def letters(c: Column) -> Column:
    """Each character with its number among equals: an array whose intersections are multiset intersections."""
    # rarer letters tend to come late in the alphabet; they make shorter lists of partners, so they come first
    chars = F.sort_array(F.filter(F.split(c, ""), lambda x: x != ""), asc=False)
    return F.transform(chars, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(chars, x) + 1).cast("string")))


def letter_bound(la: Column, lb: Column) -> Column:
    """Upper bound of the ratio from both sides' letters()."""
    return 2.0 * F.size(F.array_intersect(la, lb)) / F.greatest(F.size(la) + F.size(lb), F.lit(1))


def numbered(c: Column) -> Column:
    """An array's items, each with its number among equals, so that set intersections are multiset intersections."""
    there = F.sort_array(c)
    return F.transform(there, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(there, x) + 1).cast("string")))


def bigrams(c: Column) -> Column:
    n = F.char_length(c)
    return numbered(F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def shared_bigrams(n: Column, threshold: float) -> Column:
    """How many bigrams a string of n characters must share with any string that reaches threshold; under 1: unknown.

    Of s characters of both, M = ts/2 match and s - 2M don't. Runs of matching characters are kept apart by characters
    that don't match, so they are at most s - 2M + 1, and a run of r holds r - 1 shared bigrams: together at least
    3M - s - 1. The shortest partner has n t/(2-t) characters, so s is at least 2n/(2-t).
    """
    return F.ceil(n * (2 / (2 - threshold) * (1.5 * threshold - 1)) - 1 - 1e-9).cast("int")


def candidates(xs: DataFrame, ys: DataFrame, threshold: float) -> DataFrame:
    """Different pairs (a of xs, b of ys) that hold all of ratio threshold or more.

    Two strings that share k of their tokens share one of the first n - k + 1 of either, in any one order (prefix
    filtering). Tokens are bigrams, the rarest of both tables first, so that few strings meet on any of them. Strings too
    short for a bound on bigrams, and those as short as their partners may be, meet on characters instead.
    """
    t = threshold
    per_char = 2 / (2 - t) * (1.5 * t - 1)
    # up to this length nothing is known about bigrams, and partners are at most (2-t)/t times as long
    short = 1 / per_char + 1e-6 if per_char > 0 else float("inf")
    reach = short * (2 - t) / t + 1e-6

    def tokens(rows: DataFrame, c: str) -> DataFrame:
        long = rows.where(F.char_length(c) > short)
        return long.select(c, F.char_length(c).alias(f"n_{c}"), F.explode(bigrams(F.col(c))).alias("g_"))

    found = []
    if per_char > 0:
        tx, ty = tokens(xs, "a"), tokens(ys, "b")
        often = tx.select("g_").unionByName(ty.select("g_")).groupBy("g_").agg(F.count("*").alias("often_"))

        def first(rows: DataFrame, c: str) -> DataFrame:
            place = F.row_number().over(Window.partitionBy(c).orderBy("often_", "g_"))
            least = shared_bigrams(F.col(f"n_{c}"), t)
            return rows.join(often, "g_").withColumn("place_", place).where(F.col("place_") <= F.col(f"n_{c}") - 1 - F.greatest(least, F.lit(1)) + 1)

        found.append(first(tx, "a").join(first(ty, "b"), "g_").where(length_bound(F.col("a"), F.col("b")) >= t - 1e-9).select("a", "b"))

    # of n letters at least t/(2-t)*n must be shared: any pair shares one among the first n - that + 1
    least = t / (2 - t)

    def prefix(c: Column) -> Column:
        n = F.size(c)
        return F.slice(c, F.lit(1), F.greatest(F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1))

    def few(rows: DataFrame, c: str) -> DataFrame:
        some = rows.where(F.char_length(c) <= reach) if per_char > 0 else rows
        return some.where(F.char_length(c) > 0).select(c, F.explode(prefix(letters(F.col(c)))).alias("g_"))

    near = few(xs, "a").join(few(ys, "b"), "g_").where(length_bound(F.col("a"), F.col("b")) >= t - 1e-9)
    if per_char > 0:
        near = near.where((F.char_length("a") <= short) | (F.char_length("b") <= short))
    found.append(near.select("a", "b"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.distinct()


def scored_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs (equal in the columns on) whose ratio is at least threshold, with sim. Without block columns different
    strings meet as candidates, are scored once, and only then meet their rows again."""
    score = ratio_from(threshold)
    if on:
        pairs = left.join(right, list(on)).where(length_bound(F.col(a), F.col(b)) >= threshold - 1e-9)
        return pairs.withColumn("sim", score(F.col(a), F.col(b))).where(F.col("sim") >= threshold)
    xs, ys = left.select(F.col(a).alias("a")).where("a <> ''").distinct(), right.select(F.col(b).alias("b")).where("b <> ''").distinct()
    pairs = candidates(xs, ys, threshold).sortWithinPartitions("b").withColumn("sim", score(F.col("a"), F.col("b"))).where(F.col("sim") >= threshold)
    pairs = pairs.select(F.col("a").alias("a_"), F.col("b").alias("b_"), "sim")
    met = left.join(pairs, F.col(a) == F.col("a_")).drop("a_")
    return met.join(right, F.col("b_") == F.col(b)).select(*left.columns, *right.columns, "sim")


def best_match(names: DataFrame, known: DataFrame, name: str, known_name: str, known_key: str, accept: float = 0.90, margin: float = 0.05, log: float = 0.85) -> DataFrame:
    """For each name the key it matches: the best ratio is at least accept and leads the second by margin, else null.
    best is the best ratio of at least log. Pruning at log is exact: a runner-up below it can't spoil the margin."""
    pairs = scored_pairs(names.select(name).distinct(), known.select(known_key, known_name), name, known_name, log)
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("sim"), known_key))
    top = pairs.withColumn("place", place).where("place <= 2").groupBy(name).agg(
        F.max(F.when(F.col("place") == 1, F.col("sim"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("sim"))).alias("second"),
        F.max(F.when(F.col("place") == 1, F.col(known_key))).alias("key_"),
    )
    sure = (F.col("best") >= accept) & (F.col("best") - F.coalesce("second", F.lit(0.0)) >= margin)
    return names.join(top.select(name, "best", F.when(sure, F.col("key_")).alias("match")), name, "left")


def block_candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """block, a, b: pairs a < b of different strings of one block that hold all of ratio threshold or more, in whatever
    order the ratio is taken. rows: block, s.

    Prefix filtering within blocks, for each pair of lengths by itself: strings of n and m characters must share at
    least k = t (n + m) / 2 of them, counted with their multiplicity, so they share one of the first n - k + 1 and
    m - k + 1 of their characters, in any one order. The order is that of the block, its rarest characters first. The
    join key is block, both lengths and a character, so a block of any size is spread over very many keys. The bound on
    common characters cuts further before anything is scored.
    """
    t = threshold
    strings = rows.where("s <> ''").select("block", "s").distinct()
    tokens = strings.select("block", "s", F.char_length("s").alias("n"), F.explode(letters(F.col("s"))).alias("g"))
    often = tokens.groupBy("block", "g").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("block", "s").orderBy("often", "g"))
    placed = tokens.join(often, ["block", "g"]).withColumn("place", place)
    n = F.col("n")
    partners = F.sequence(F.ceil(n * (t / (2 - t)) - 1e-9).cast("int"), F.floor(n * ((2 - t) / t) + 1e-9).cast("int"))
    # a character no other string of the block has takes its place, but leads to no one
    first = placed.where("often > 1").withColumn("m", F.explode(partners)).where(F.col("place") <= n - F.ceil((n + F.col("m")) * (t / 2) - 1e-9) + 1)
    low = first.where("n <= m").select("block", "g", n.alias("lo"), F.col("m").alias("hi"), F.col("s").alias("x"))
    high = first.where("n >= m").select("block", "g", F.col("m").alias("lo"), n.alias("hi"), F.col("s").alias("y"))
    met = low.join(high, ["block", "g", "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y")))
    pairs = met.select("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.where(letter_bound(letters(F.col("a")), letters(F.col("b"))) >= t - 1e-9)


def block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """block, a, b, ab, ba: pairs of different strings of one block with both ratios, one at least threshold. Strings
    that meet in several blocks are scored once."""
    found = block_candidates(rows, threshold)
    score = ratio_from(threshold)
    scored = found.select("a", "b").distinct().sortWithinPartitions("b")
    scored = scored.withColumn("ab", score("a", "b")).withColumn("ba", score("b", "a")).where(F.greatest("ab", "ba") >= threshold)
    return found.join(scored, ["a", "b"]).select("block", "a", "b", "ab", "ba")


LEVELS = ("D0", "L0", "L1", "L2", "L3")


def duplicate_pairs(brands: DataFrame) -> DataFrame:
    """Pairs of brands likely to be the same, with level and sim: for each pair the first level that holds.

    brands: id, name, organizer, city, start (ISO day), l1, l2. D0 same organizer, city and day, 0.80; L0 same
    organizer, city and month of the year, 0.85; L1 same normalised name of at least four characters; L2 same organizer
    and city, compatible l2, 0.80; L3 same organizer, compatible l1, 0.75. All but L1 lie within an organizer at 0.75,
    so names are compared once per organizer; equal names meet by a join on them. The ratio of two brands is taken in
    the order of organizer, city and name. A brand may have several rows; it is no duplicate of itself.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = brands.select("id", F.coalesce("name", F.lit("")).alias("name"), clean("organizer").alias("org"), clean("city").alias("city"), F.coalesce("start", F.lit("")).alias("start"), clean("l1").alias("l1"), clean("l2").alias("l2"))
    rows = rows.withColumn("norm", normalize_name(F.col("name"))).withColumn("month", F.when(F.char_length("start") >= 7, F.substring("start", 6, 2)).otherwise("")).distinct()
    sane = rows.where((F.col("org") != "") & (F.col("org") != "test") & (F.col("norm") != ""))
    similar = block_pairs(sane.select(F.col("org").alias("block"), F.col("norm").alias("s")), 0.75)
    fields = ("id", "name", "city", "start", "month", "l1", "l2", "norm")
    side = lambda df, n: df.select("org", *[F.col(c).alias(f"{c}_{n}") for c in fields])
    near = similar.withColumnsRenamed({"block": "org", "a": "norm_1", "b": "norm_2"}).join(side(sane, 1), ["org", "norm_1"]).join(side(sane, 2), ["org", "norm_2"])
    first = F.struct("city_1", "name_1", "id_1") < F.struct("city_2", "name_2", "id_2")
    near = near.withColumn("sim", F.when(first, F.col("ab")).otherwise(F.col("ba"))).drop("ab", "ba")
    equal = side(sane, 1).join(side(sane, 2).withColumnRenamed("norm_2", "norm_1"), ["org", "norm_1"]).where("id_1 < id_2").withColumn("sim", F.lit(1.0))
    compatible = lambda c: (F.col(f"{c}_1") == F.col(f"{c}_2")) | (F.col(f"{c}_1") == "") | (F.col(f"{c}_2") == "")
    same = lambda c: (F.col(f"{c}_1") == F.col(f"{c}_2")) & (F.col(f"{c}_1") != "")
    level = (
        F.when(same("city") & same("start") & (F.col("sim") >= 0.80), 0).when(same("city") & same("month") & (F.col("sim") >= 0.85), 1)
        .when(same("city") & compatible("l2") & (F.col("sim") >= 0.80), 3).when(compatible("l1") & (F.col("sim") >= 0.75), 4)
    )
    columns = ["id_1", "id_2", "sim", "rank"]
    within = near.drop("norm_1", "norm_2").unionByName(equal.drop("norm_1")).withColumn("rank", level).where("rank is not null and id_1 <> id_2").select(columns)
    named = rows.where(F.char_length("norm") >= 4).select("id", "norm").distinct()
    by_name = named.withColumnRenamed("id", "id_1").join(named.withColumnRenamed("id", "id_2"), "norm").where("id_1 < id_2").select("id_1", "id_2", F.lit(1.0).alias("sim"), F.lit(2).alias("rank"))
    every = within.unionByName(by_name).select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b"), "rank", "sim")
    best = every.groupBy("a", "b").agg(F.min("rank").alias("rank"), F.max("sim").alias("sim"))
    return best.select("a", "b", F.get(F.array(*map(F.lit, LEVELS)), F.col("rank")).alias("level"), F.round("sim", 4).alias("sim"))


def review_layers(brands: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Pairs within organizer and city for review: keep, merge, layer A1 (same normalised name), A2 (similar), B (same
    venue and English name) or C (same venue and period). The brand with more editions is kept, then the smaller id.
    Each layer has a join of its own: on equal names, on similar names of a block, on venue and English name, on venue
    and period; no block is paired with itself as a whole."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = brands.select("id", "name", "name_en", "venue", "start", "end", "editions", clean("organizer").alias("org"), clean("city").alias("city"))
    rows = rows.where("org <> '' and org <> 'test' and city <> ''").withColumns({"norm": normalize_name(F.col("name")), "en": norm_en(F.col("name_en")), "place": clean("venue"), "block": F.struct("org", "city")})
    rows = rows.withColumn("start", F.coalesce("start", F.lit(""))).withColumn("end", F.coalesce("end", F.lit("\0")))

    def met(keys: list[str], where: str, layer: int) -> DataFrame:
        some = rows.where(where).select("block", *keys, F.struct("id", "editions", "norm").alias("x"))
        pairs = some.withColumnRenamed("x", "p").join(some.withColumnRenamed("x", "q"), ["block", *keys]).where("p.id < q.id")
        return pairs.select("p", "q", F.lit(layer).alias("rank"))

    similar = block_pairs(rows.select("block", F.col("norm").alias("s")), threshold)
    some = rows.select("block", "norm", F.struct("id", "editions", "norm").alias("x"))
    near = similar.join(some.withColumnsRenamed({"norm": "a", "x": "p"}), ["block", "a"]).join(some.withColumnsRenamed({"norm": "b", "x": "q"}), ["block", "b"])
    sure = F.when(F.col("p.id") < F.col("q.id"), F.col("ab")).otherwise(F.col("ba")) >= threshold
    swapped = F.col("p.id") > F.col("q.id")
    near = near.where(sure).select(F.when(swapped, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(swapped, F.col("p")).otherwise(F.col("q")).alias("q"), F.lit(1).alias("rank"))
    every = met(["norm"], "norm <> ''", 0).unionByName(near).unionByName(met(["place", "en"], "place <> '' and en <> ''", 2)).unionByName(met(["place", "start", "end"], "place <> '' and start <> ''", 3))
    first = every.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(F.min("rank").alias("rank"), F.first("p").alias("p"), F.first("q").alias("q"))
    first = first.withColumn("sim", F.when(F.col("rank") == 0, 1.0).otherwise(ratio(F.col("p.norm"), F.col("q.norm"))))
    swap = F.col("q.editions") > F.col("p.editions")
    layer = F.get(F.array(*map(F.lit, ("A1", "A2", "B", "C"))), F.col("rank"))
    return first.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("keep"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("merge"), layer.alias("layer"), F.round("sim", 4).alias("sim"))
