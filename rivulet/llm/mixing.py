"""Mixing sources to target weights.

Token counts are aggregated per source, a target per source is found by sharing
the total by weight under a cap, and each document is emitted floor(rate) times
plus once more with the fraction's probability, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import cut, text_of, with_bound, words

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2.0
SEED = "mix-1:"


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """_source, source_size, target per source (one row each, written).

    Sources in code-point order (null last) take the weights in turn.  With
    caps c = most * size the fair share is min(c, level * weight); as sources
    fill up in order of c / weight, the level follows from running sums.
    The two windows run over one row per source, never over documents.
    """
    per = cut(sized.groupBy("_source").agg(F.sum("size").alias("source_size")))
    order = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("_source").asc_nulls_last())
    upto, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("_full", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(after))
    per = per.withColumn("_all", F.sum("source_size").over(everything) * F.lit(total))
    level = (F.col("_all") - F.col("_full")) / F.col("_rest")
    per = per.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    # Once the next source is not filled, later levels only fall: the highest that holds is the right one.
    per = per.withColumn("_level", F.max("_level").over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return cut(per.select("_source", "source_size", target.alias("target")))


def _copies(docs: DataFrame, **how) -> DataFrame:
    """docs' columns under _doc, with size, source_size, target and copies."""
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.size(words(text_of(docs))).cast("long").alias("size"), docs["source"].alias("_source"))
    targets = with_bound(source_targets(sized.select("size", "_source"), **how).withColumnRenamed("_source", "_s"))
    both = sized.join(targets, F.col("_source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (chance(F.col("_doc.doc_id")) < rate - F.floor(rate)).cast("long")
    return both.withColumn("copies", F.floor(rate) + extra)


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per input row.

    A null text has size 0; a null source is a source of its own; sources
    whose texts are all empty have target 0 and are not taken.  Rows that
    repeat a doc_id share its draw.  Equal cap-to-weight ratios are ordered by
    weight, then source, which does not change any target.
    """
    slim = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"))
    out = _copies(slim, **how)
    return out.select(F.col("_doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as the mix takes it."""
    out = _copies(docs, **how).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("_doc.*")
