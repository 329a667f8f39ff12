"""Containment joins: which texts contain which others, without comparing them pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import broadcast_if_small

GRAM = 3


def _grams(c: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n)))


def containment(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): all pairs in which `hay` contains `needle`, of distinct texts in a column each. Null and empty texts take no part.

    A text that contains another contains its grams, so a pair meets at the needle's rarest gram among the hays: three characters,
    or all of a needle that is shorter.
    """
    n = needles.select(F.col(needles.columns[0]).alias("needle")).filter("needle != ''").distinct()
    h = hays.select(F.col(hays.columns[0]).alias("hay")).filter("hay != ''").distinct()
    all_grams = F.flatten(F.array(*(F.when(F.length("hay") >= k, _grams(F.col("hay"), F.lit(k))).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1))))
    held = h.select("hay", F.explode(all_grams).alias("gram"))
    # a needle whose first gram no hay has is ruled out before anything is shuffled, and so are grams that no other needle has
    first = n.withColumn("gram", F.substring("needle", 1, GRAM)).join(broadcast_if_small(held.select("gram").distinct()), "gram", "left_semi")
    keys = first.select("needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    found = held.join(broadcast_if_small(keys.select("gram").distinct()), "gram", "left_semi")
    df = found.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a gram that no hay has rules its needle out
    rare = keys.join(df, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).filter("r.df > 0").select("needle", F.col("r.gram").alias("gram"))
    return rare.join(found, "gram").filter(F.col("hay").contains(F.col("needle"))).select("needle", "hay")
