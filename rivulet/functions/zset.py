"""Z-sets: DataFrames with a signed weight a row, in the column __w."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "__w"


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(weight).cast("long"))


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def plus(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return plus(a, negate(b))


def consolidate(z: DataFrame) -> DataFrame:
    """Add up the weights of equal rows (null equals null) and drop what nets to zero; partial sums precede the shuffle."""
    return z.groupBy(*columns(z)).agg(F.sum(W).alias(W)).where(F.col(W) != 0).select(*z.columns)


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """The change that leads from old to new."""
    return consolidate(minus(new, old))


def distinct(z: DataFrame) -> DataFrame:
    return consolidate(z).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def all_ones(z: DataFrame) -> bool:
    """Whether z is known to hold weights of 1 only."""
    ones = z.__dict__.get("_all_ones")
    return ones is not None and ones()


def like(out: DataFrame, z: DataFrame) -> DataFrame:
    """out, made from z without a change of any weight, with what is known of z's weights."""
    if "_all_ones" in z.__dict__:
        out._all_ones = z._all_ones
    return out


def settled(z: DataFrame) -> DataFrame:
    """z without negative weights: consolidated, unless its weights are all 1."""
    return z if all_ones(z) else consolidate(z).where(F.col(W) > 0)


#: The longest array that rows() makes of one weight.
RUN = 4096


def rows(z: DataFrame) -> DataFrame:
    """Plain rows: each as often as its weight says.  A stored table whose weights are all 1 is taken as it is, without a shuffle."""
    if all_ones(z):
        return z.drop(W)
    z = consolidate(z).where(F.col(W) > 0)
    # In runs, since one row may count many million times.
    z = z.withColumn("__i", F.explode(F.expr(f"sequence(0L, ({W} - 1) div {RUN})")))
    return z.withColumn("__i", F.explode(F.expr(f"sequence(1L, least({RUN}L, {W} - __i * {RUN}))"))).drop("__i", W)


def same(names: list[str], left: str, right: str) -> Column:
    """Null-safe equality of columns of two aliased sides."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`")) for n in names])


def touched(z: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of z whose key columns are among keys."""
    return like(z.alias("z").join(keys.select(*names).alias("k"), same(names, "z", "k"), "left_semi"), z) if names else z
