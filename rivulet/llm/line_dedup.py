"""Line dedup over overlapping three-line windows.

Hashes of three consecutive non-blank lines are compared over all documents;
every occurrence of a window but the first (by doc_id, then position) is
covered, overlapping windows merge, and covered lines are removed.  Of a later
occurrence that overlaps the first one, only the lines after the first one are
covered, so a run of equal lines keeps three of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, keyed_join, text_of, with_bound

WIDTH = 3
BLANK = "[\\x20\\x09-\\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, _key, _text, _l: the text's lines; _at: positions of those with a word."""
    text = text_of(docs)
    out = docs.select(docs["doc_id"].alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
    out = out.withColumn("_l", F.split("_text", "\n", -1))
    at = F.expr("filter(transform(_l, (x, i) -> if(x rlike '[^\\\\x20\\\\x09-\\\\x0D]', i, -1)), i -> i >= 0)")
    return out.withColumn("_at", at)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, _key, _line: line positions covered by later occurrences of repeated windows (written)."""
    trimmed = "regexp_replace(_l[_at[k + {}]], '^[\\\\x20\\\\x09-\\\\x0D]+|[\\\\x20\\\\x09-\\\\x0D]+$', '')"
    parts = ", ".join(trimmed.format(i) for i in range(width))
    ends = ", ".join(f"_at[k + {i}]" for i in range(width))
    found = f"if(size(_at) >= {width}, transform(sequence(0, size(_at) - {width}), k -> struct(xxhash64({parts}) as h, array({ends}) as a)), null)"
    windows = _lines(docs).select("doc_id", "_key", F.explode(F.expr(found)).alias("_w"))
    windows = cut(windows.select("doc_id", "_key", F.col("_w.h").alias("_h"), F.col("_w.a").alias("_a")))
    place = F.struct("doc_id", "_key", F.element_at("_a", 1).alias("_p"), F.element_at("_a", -1).alias("_e"))
    first = windows.groupBy("_h").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count(F.lit(1)).alias("_often")).where("_first < _last").select("_h", "_first", "_often")
    later = keyed_join(windows, cut(first), "_h", "_often").where(place > F.col("_first"))
    own = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_key") == F.col("_first._key"))
    lines = F.when(own, F.filter("_a", lambda x: x > F.col("_first._e"))).otherwise(F.col("_a"))
    return cut(later.select("doc_id", "_key", F.explode(lines).alias("_line")).distinct())


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_lines, n_removed (long), text (what is left): one row per input row.

    Lines are compared without white space at their ends; blank lines belong to
    no window and stay.  Texts with fewer than three lines with words, empty
    and null texts are unchanged (null becomes empty).  Rows that repeat a
    doc_id and text are one occurrence and get the same result; a null id comes
    first; an empty table gives an empty result.
    """
    covered = repeated_windows(docs, width).groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(F.collect_set("_line").alias("_gone"))
    covered = with_bound(cut(covered))
    text = text_of(docs)
    base = docs.select(docs["doc_id"].alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
    out = base.join(covered, base["doc_id"].eqNullSafe(F.col("_d")) & (base["_key"] == F.col("_k")), "left")
    left = F.expr("array_join(filter(split(_text, '\n', -1), (x, i) -> not array_contains(_gone, i)), '\n')")
    return out.select(
        "doc_id",
        F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left).alias("text"),
    )
