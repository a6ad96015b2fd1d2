"""Exact percentiles of large groups: no task holds a group.

Counts add up, so no row needs to be shuffled to find where a rank lies.  A
sketch gives some bounds for each group, weights are counted between them, and
only the rows between the two bounds that hold the rank are gathered and sorted.
The sketch decides how many rows that are, never which value is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.zset import W

#: Tables of at most this many rows are brought to the driver and sent to all tasks.
FEW = 20_000
NEAR, ACCURACY = 0.005, 1000


def small(df: DataFrame) -> DataFrame:
    """df, computed once and sent to all tasks if it is small; else as it is."""
    spark = df.sparkSession
    found = df.limit(FEW + 1)._jdf.collectAsList()
    return df if found.size() > FEW else F.broadcast(DataFrame(spark._jsparkSession.createDataFrame(found, df._jdf.schema()), spark))


def meet(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where the names are equal; null equals null."""
    r = right.select(*[F.col(f"`{c}`").alias(f"__r{i}") if (i := names.index(c) if c in names else None) is not None else F.col(f"`{c}`") for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(names)], F.lit(True))
    return left.join(r, on, how).drop(*[f"__r{i}" for i in range(len(names))])


def percentile(v: DataFrame, keys: list[str], q: float, exact: bool) -> DataFrame:
    """keys and __p: the q-th percentile of __v by weight in each group that has values, as Spark's percentile_cont, or percentile_disc if exact."""
    v = v.where("__v is not null")
    at = sorted({i / 8 for i in range(1, 8)} | {max(0.0, q - NEAR), min(1.0, q + NEAR)})
    bounds = small(v.groupBy(*keys).agg(F.percentile_approx(F.when(F.col(W) > 0, F.col("__v")), at, ACCURACY).alias("__b")))
    part: Column = reduce(lambda a, b: a + b, [F.coalesce((F.col("__v") > F.col("__b")[i]).cast("int"), F.lit(0)) for i in range(len(at))])
    dealt = meet(v, bounds, keys).withColumn("__g", part).drop("__b")
    own, by_part = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__g")
    counts = dealt.groupBy(*keys, "__g").agg(F.sum(W).alias("__n"))
    counts = counts.withColumn("__all", F.sum("__n").over(own)).withColumn("__to", F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, 0)))
    pos = f"(__all - 1) * {q!r}D"
    low, high = ("greatest(ceil(__all * %rD) - 1, 0)" % q,) * 2 if exact else (f"floor({pos})", f"ceil({pos})")
    counts = counts.where("__all > 0").selectExpr(*[f"`{k}`" for k in keys], "__g", "__to - __n AS __from", "__to", f"{pos} AS __at", f"{low} AS __low", f"{high} AS __high")
    picked = small(counts.where("(__low >= __from AND __low < __to) OR (__high >= __from AND __high < __to)").drop("__to"))
    facts = ["__g", "__from", "__at", "__low", "__high"]
    near = meet(dealt, picked, [*keys, "__g"]).groupBy(*keys, *facts, "__v").agg(F.sum(W).alias("__n")).where("__n > 0")
    upto = F.col("__from") + F.sum("__n").over(Window.partitionBy(*keys, "__g").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__to", upto)
    held = lambda rank: F.max(F.when((F.col(rank) < F.col("__to")) & (F.col(rank) >= F.col("__to") - F.col("__n")), F.col("__v"))).cast("double")
    ends = near.groupBy(*keys).agg(held("__low").alias("__a"), held("__high").alias("__z"), F.max("__at").alias("__at"), F.max("__low").alias("__low"), F.max("__high").alias("__high"))
    value = F.expr("CASE WHEN __low = __high OR __a = __z THEN __a ELSE (__high - __at) * __a + (__at - __low) * __z END")
    return small(ends.select(*keys, value.alias("__p")))


def mad(v: DataFrame, keys: list[str]) -> DataFrame:
    """keys and __p: the median of the distances to the median."""
    return percentile(meet(v, percentile(v, keys, 0.5, False), keys).withColumn("__v", F.abs(F.col("__v").cast("double") - F.col("__p"))).drop("__p"), keys, 0.5, False)
