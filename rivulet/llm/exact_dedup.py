"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Three passes, each reading more of fewer rows: lengths that occur twice,
(length, prefix hash) classes that occur twice, full hashes of what is left.
All are exact keys.  Rows find their class in a broadcast table of a checked
size.  Shared lengths are few at any corpus size; should the shared classes not
fit, every text of a shared length gets the full hash in the pass that read it,
as hashing a text costs less than moving it to its class.  Texts never take part
in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, fits, keyed_join, text_of

PREFIX_CHARS = 256


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The values of key that two or more rows have; written."""
    return cut(rows.groupBy(key).count().where("count > 1").select(key))


def _with_twins(rows: DataFrame, shared: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with flag: whether the value of key is a shared one; true for all rows if the shared values are too many to broadcast."""
    if not fits(shared):
        return rows.withColumn(flag, F.col(key).isNotNull())
    return rows.join(F.broadcast(shared.withColumn(flag, F.lit(True))), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def exact_dedup(docs: DataFrame, carry: dict | None = None) -> DataFrame:
    """doc_id, keep_id, group_size (long), kept (boolean) and the carried columns, one row per input row.

    Texts are equal when identical (null counts as empty).  The row with the
    largest doc_id of a group stays (a null id is smallest); among repeated
    rows of that same doc_id exactly one is kept.  An empty table gives an
    empty result.  carry: name -> Column over docs, computed in the last pass.
    """
    text = text_of(docs)
    base = docs.select(docs["doc_id"].alias("doc_id"), text.alias("_text"), *[c.alias(n) for n, c in (carry or {}).items()])
    base = base.withColumn("_len", F.octet_length("_text"))
    prefix = F.when(F.col("_twin_len"), F.xxhash64("_len", F.substring("_text", 1, PREFIX_CHARS)))
    tagged = _with_twins(base, _shared(base, "_len"), "_len", "_twin_len").withColumn("_pre", prefix)
    shared = _shared(tagged.where("_twin_len"), "_pre")
    tagged = _with_twins(tagged, shared, "_pre", "_twin_pre").withColumn("_full", F.when(F.col("_twin_pre"), F.sha2("_text", 256)))
    names = ["doc_id", *(carry or {})]
    tagged = cut(tagged.select(*names, F.unhex("_full").alias("_full"), F.monotonically_increasing_id().alias("_row")))
    groups = tagged.where(F.col("_full").isNotNull()).groupBy("_full").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    groups = cut(groups.where("group_size > 1"))
    # Rows without a full hash stand alone and skip the join.
    joined = keyed_join(tagged.where(F.col("_full").isNotNull()), groups, "_full", "group_size", "left")
    joined = joined.unionByName(tagged.where(F.col("_full").isNull()), allowMissingColumns=True)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_keep._row") == F.col("_row"), F.lit(True)).alias("kept"),
        *(carry or {}),
    )
