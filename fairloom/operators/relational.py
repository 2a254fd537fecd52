"""Relational building blocks the read queries and pipelines share. Every order is total: an id breaks ties."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairloom.functions.text import blank_to_null


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order. Never fans out."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def with_latest(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: Sequence[Column]) -> DataFrame:
    """Every parent with its latest child, or nulls."""
    return parents.join(latest_per_key(children, [child_key], order), parents[key] == children[child_key], "left")


def latest_fanout(parents: DataFrame, children: DataFrame, key: str, child_key: str, measure: Column) -> DataFrame:
    """Every parent with all children that share its greatest measure."""
    newest = children.groupBy(child_key).agg(F.max(measure).alias("max_")).withColumnRenamed(child_key, "key_")
    some = children.withColumn("measure_", measure).join(newest, (F.col(child_key) == F.col("key_")) & (F.col("measure_") == F.col("max_"))).drop("measure_", "max_", "key_")
    return parents.join(some, parents[key] == some[child_key], "left")


def equal_filters(rows: DataFrame, allowed: dict[str, str], wanted: dict[str, object]) -> DataFrame:
    """Equality filters by public name; unknown names and blank values are ignored."""
    for name, column in allowed.items():
        if wanted.get(name) not in (None, ""):
            rows = rows.where(F.col(column) == F.lit(wanted[name]))
    return rows


def search(rows: DataFrame, columns: Iterable[str], text: str | None) -> DataFrame:
    """Rows in which any column contains text, ASCII case ignored; % and _ in text are wildcards."""
    if not text:
        return rows
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(pattern)
    return rows.where(found)


def in_list(rows: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows with one of the values, each of which may be a comma list; no values, no filter."""
    flat = [v.strip() for x in values for v in x.split(",") if v.strip()]
    return rows.where(F.col(column).isin(flat)) if flat else rows


def page_bounds(page: object, size: object) -> tuple[int, int]:
    """Page from 1, size 1 to 200; what isn't a number, and size 0, is the default 1 and 50."""

    def number(x: object, default: int) -> int:
        try:
            return int(str(x)) or default
        except ValueError:
            return default

    return max(1, number(page, 1)), min(200, max(1, number(size, 50)))


def list_page(rows: DataFrame, sortable: dict[str, str], sort: str | None, direction: str | None, key: str, default: str, page: object = 1, size: object = 50) -> DataFrame:
    """One page in a white-listed order; only 'asc' ascends; the key breaks ties."""
    number, size = page_bounds(page, size)
    column = F.col(sortable.get(sort or "", default))
    first = column.asc_nulls_first() if direction == "asc" else column.desc_nulls_last()
    return rows.orderBy(first, F.col(key).asc()).offset((number - 1) * size).limit(size)


def zero_fill(domain: Sequence[object], counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Every member of the domain in its order (column pos), with 0 where counts has no row; other groups drop out."""
    spark = counts.sparkSession
    kind = counts.schema[key].dataType.simpleString()
    members = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"pos int, `{key}` {kind}")
    out = members.join(counts, key, "left")
    return out.select("pos", key, *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values])


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: Sequence[str] = (), greatest: Sequence[str] = (), null_is_zero: bool = True) -> DataFrame:
    """Snapshot after an upsert. overwrite: a new value wins unless blank. greatest: the larger wins; where both rows
    exist a missing number counts as 0 (null_is_zero)."""
    o, n = old.alias("o"), new.alias("n")
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        mine = F.col(f"o.{c}")
        theirs = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in overwrite:
            is_text = old.schema[c].dataType.simpleString() == "string"
            out.append(F.coalesce(blank_to_null(theirs) if is_text else theirs, mine).alias(c))
        elif c in greatest:
            merged = F.greatest(F.coalesce(theirs, F.lit(0)), F.coalesce(mine, F.lit(0))) if null_is_zero else F.greatest(theirs, mine)
            out.append(F.when(both, merged).otherwise(F.coalesce(theirs, mine)).cast(old.schema[c].dataType).alias(c))
        elif c != key:
            out.append(F.coalesce(mine, F.when(~both, theirs)).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """old plus the first new row of every key that old lacks."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    fresh = latest_per_key(fresh, keys, order) if order else fresh.dropDuplicates(list(keys))
    return old.unionByName(fresh.select(old.columns))


def changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field, old_value, new_value of every field that differs, nulls and '' alike."""
    joined = old.alias("o").join(new.alias("n"), key)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"o.{c}").cast("string"), F.lit("")).alias("old_value"), F.coalesce(F.col(f"n.{c}").cast("string"), F.lit("")).alias("new_value"))
        for c in columns
    ])
    return joined.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("old_value <> new_value")


def full_outer_merge(a: DataFrame, b: DataFrame, key: str, text: Sequence[str], numbers: Sequence[str], joined: Sequence[str] = (), separator: str = "；") -> DataFrame:
    """Two sources as one: a's text wins unless blank, the larger number wins, joined texts stand side by side if
    they differ. b's rows are expected to be one for each key."""
    x, y = a.alias("a"), b.alias("b")
    both = x.join(y, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    side = lambda c: (blank_to_null(F.col(f"a.{c}")), blank_to_null(F.col(f"b.{c}")))
    out = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    out += [F.coalesce(*side(c), F.lit("")).alias(c) for c in text]
    out += [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in numbers]
    out += [F.when(side(c)[0] == side(c)[1], side(c)[0]).otherwise(F.concat_ws(separator, *side(c))).alias(c) for c in joined]
    return both.select(*out)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return latest_per_key(rows, keys, order)


def distinct_over(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the number of distinct values in their group, by a grouped count joined back: no unbounded window."""
    counts = rows.groupBy(*keys).agg(F.count_distinct(value).alias(name))
    return rows.join(counts, list(keys))


def coverage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, filled, share (percent, one decimal) of non-blank values, in one pass."""
    filled = [F.count(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1)).alias(f"f{i}") for i, c in enumerate(columns)]
    one = rows.agg(F.count("*").alias("n"), *filled)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f{i}").alias("filled")) for i, c in enumerate(columns)])
    return one.select("n", F.explode(pairs).alias("p")).select("p.field", "p.filled", F.when(F.col("n") > 0, F.round(F.col("p.filled") * 100.0 / F.col("n"), 1)).otherwise(0.0).alias("share"))


def runs(rows: DataFrame, keys: Sequence[str], number: str, least: int = 1) -> DataFrame:
    """Islands of consecutive numbers: keys, first, last, size."""
    in_order = Window.partitionBy(*keys).orderBy(number)
    island = rows.select(*keys, number).distinct().withColumn("island_", F.col(number) - F.row_number().over(in_order))
    return island.groupBy(*keys, "island_").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).where(F.col("size") >= least).drop("island_")
