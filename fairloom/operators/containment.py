"""Which texts contain which strings, by an inverted index instead of a comparison of everything with everything.

Every string is looked up under one of its n-grams, the one that the fewest texts hold; texts meet it there by an equality
join on n-grams, and only these pairs are compared. Strings shorter than GRAM characters are looked up as they are among
the texts' shorter grams. Text case is as given; fold it before if it shouldn't matter. Null and empty strings match
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def grams(c: Column, n: int) -> Column:
    """Different substrings of n characters."""
    last = F.char_length(c) - n + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def containing(texts: DataFrame, strings: DataFrame, text: str, string: str) -> DataFrame:
    """text, string: all pairs of different values where text contains string."""
    ts = texts.select(F.col(text).alias("t")).where("t <> ''").distinct()
    ss = strings.select(F.col(string).alias("s")).where("s <> ''").distinct()
    size = F.least(F.char_length("s"), F.lit(GRAM))
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    # only the grams that strings are looked up under are counted and joined
    asked = ss.withColumn("g", F.explode(F.flatten(F.transform(sizes, lambda n: F.when(n == size, grams(F.col("s"), n)).otherwise(F.array().cast("array<string>"))))))
    wanted = asked.select("g").distinct()
    held = ts.withColumn("g", F.explode(F.flatten(F.transform(sizes, lambda n: F.when(F.char_length("t") >= n, grams(F.col("t"), n)).otherwise(F.array().cast("array<string>"))))))
    held = held.join(wanted, "g", "left_semi")
    often = held.groupBy("g").agg(F.count("*").alias("often"))
    rarest = F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("often", F.lit(0)), "g"))
    keyed = asked.join(often, "g", "left").withColumn("nth", rarest).where("nth = 1 and often is not null").select("s", "g")
    return held.join(keyed, "g").where(F.col("t").contains(F.col("s"))).select(F.col("t").alias(text), F.col("s").alias(string))
