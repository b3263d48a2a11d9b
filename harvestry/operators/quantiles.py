"""Exact quantiles of groups of any size: counts by ranges of values first, then only the ranges that hold a wanted rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import settled

#: Ranges that a round cuts a group's values into, and different values of a group that one task may order.
BINS, FEW = 1024, 50_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"k_{k}"]) for k in keys], F.lit(True))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, a column each of at: name -> p): the interpolated quantiles of value among the group's rows with a value, as percentile(); groups without any are left out.

    percentile() holds all different values of a group in one task. Here equal values are counted first, in parts of a
    group; then each round cuts the range of values in which a wanted rank lies into bins and keeps the bin that holds
    it, until few different values are left, which a window orders. So a group may hold any share of all rows: what
    meets in one task is bins counts or few values. Null keys are a group; NaN counts as no value.
    """
    x = F.col(value).cast("double")
    counted = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("v")).agg(F.count("*").alias("n"))
    counted = settled(counted)
    groups = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("values"))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    ranks = F.array(*[F.struct(f(place(p)).cast("long").alias("rank")) for p in at.values() for f in (F.floor, F.ceil)])
    wanted = settled(groups.select(*keys, "total", F.explode(F.array_distinct(ranks)).alias("r"), "low", "high", F.lit(0).cast("long").alias("below"), "values").select(*keys, "total", "r.rank", "low", "high", "below", "values"))
    renamed = lambda w: w.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[c for c in w.columns if c not in keys])
    done: list[DataFrame] = []
    while True:
        small = renamed(wanted.filter(F.col("values") <= few))
        held = counted.join(small, _same(counted, small, keys) & F.col("v").between(F.col("low"), F.col("high")))
        order = Window.partitionBy(*keys, "rank").orderBy("v")
        upto = held.withColumn("upto", F.col("below") + F.sum("n").over(order))
        done.append(upto.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select(*keys, "total", "rank", "v"))
        wanted = wanted.filter(F.col("values") > few)
        if wanted.isEmpty():
            break
        large = renamed(wanted)
        rows = counted.join(large, _same(counted, large, keys) & F.col("v").between(F.col("low"), F.col("high")))
        bin_ = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        cut = rows.groupBy(*keys, "total", "rank", "below", bin_.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("values"))
        upto = cut.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin")))
        held = upto.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        wanted = settled(held.select(*keys, "total", "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below"), "values"))
    found = reduce(DataFrame.union, done).groupBy(*keys).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by_rank"))
    get = lambda p, f: F.element_at("by_rank", f(place(p)).cast("long"))
    between = lambda p: get(p, F.floor) + (get(p, F.ceil) - get(p, F.floor)) * (place(p) - F.floor(place(p)))
    return found.select(*keys, *[between(p).alias(name) for name, p in at.items()])
