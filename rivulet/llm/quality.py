"""Quality rules: per-document statistics, then cross-document line frequency per host.

Normalised lines are hashed; a line found in more than the limit of a host's
distinct documents is boilerplate and is removed; a document that loses most of
its words that way, or has too few left, is rejected as depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import BLANKS, bound, cut, text_of, with_bound, words

LEAST_WORDS = 50
#: A line is boilerplate above max(LEAST_DOCS, SHARE * documents of the host).
LEAST_DOCS, SHARE = 20, 0.1
#: A document is depleted if fewer than LEAST_LEFT of its words remain, or fewer than LEAST_WORDS.
LEAST_LEFT = 0.5


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_bare(x)) > 0)
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _repeat_words(grams: str) -> Column:
    """Words covered by the windows found twice or more; only texts with such a window pay for the sort."""
    at = F.sort_array(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), at)


def document_stats(docs: DataFrame, carry: dict | None = None) -> DataFrame:
    """doc_id, _key, _host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the carried columns (name -> Column over docs)."""
    text = text_of(docs)
    df = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("_host"), text.alias("_t"), words(text).alias("_w"), *[c.alias(n) for n, c in (carry or {}).items()])
    df = df.withColumn("_n", F.size("_w"))
    grams = F.expr("if(_n > 2, transform(sequence(0, _n - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])), cast(array() as array<bigint>))")
    df = df.select(
        "doc_id", "_host", F.xxhash64("_t").alias("_key"), F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _dup_lines(F.col("_t")).cast("long").alias("n_dup_lines"), grams.alias("_g"), *(carry or {}),
    )
    # Sorted (hash, position) pairs: equal neighbours are windows found twice; covered words follow from their positions.
    twice = "sort_array(transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h)), x -> x.i))"
    covered = f"transform(array(_s), s -> aggregate({twice}, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n))[0]"
    df = df.withColumn("_s", _repeat_words("_g")).withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), F.expr(covered)), F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "_host", "_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *(carry or {}))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, _host, _key, _at, _line (hash), _l: a row for each line with words, lower-cased, without white space at its ends."""
    text = text_of(docs)
    bare = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("_host"), F.xxhash64(text).alias("_key"), F.posexplode_outer(F.split(text, "\n", -1)).alias("_at", "_l"))
    bare = bare.withColumn("_l", F.lower(_bare(F.col("_l")))).where(F.length("_l") > 0)
    return bare.select("doc_id", "_host", "_key", "_at", F.xxhash64("_l").alias("_line"), "_l")


def boilerplate(docs: DataFrame, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """_host, _line of the lines above the limit (written).  Copies of a text count as one document."""
    found = _lines(docs).groupBy("_host", "_line").agg(F.count_distinct("_key").alias("_docs"))
    found = cut(found.where(F.col("_docs") > least))
    hosts = docs.select(docs["source"].alias("_h"), F.xxhash64(text_of(docs)).alias("_key")).groupBy("_h").agg(F.count_distinct("_key").alias("_all"))
    hosts = with_bound(cut(hosts))
    over = found.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).where(F.col("_docs") > F.greatest(F.lit(float(least)), F.col("_all") * share))
    return cut(over.select("_host", "_line"))


def _removed(docs: DataFrame, least: int, share: float) -> DataFrame:
    """_d, _k, _gone (words in removed lines), _lines (their positions): a row for each text with boilerplate (written)."""
    common = with_bound(cut(boilerplate(docs, least, share).select(F.col("_host").alias("_h"), F.col("_line").alias("_c"))))
    hit = _lines(docs).join(common, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_c")))
    # Repeated rows of a document must not add up, hence once per position.
    once = hit.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_at").agg(F.max(F.size(words(F.col("_l")))).alias("_n"))
    return cut(once.groupBy("_d", "_k").agg(F.sum("_n").alias("_gone"), F.collect_list("_at").alias("_lines")))


def _judged(stats: DataFrame, removed: DataFrame, left: float) -> DataFrame:
    """stats with the columns of removed, n_removed and kept."""
    out = stats.join(removed, stats["doc_id"].eqNullSafe(F.col("_d")) & (stats["_key"] == F.col("_k")), "left")
    gone = F.coalesce("_gone", F.lit(0).cast("long"))
    rest = F.col("n_words") - gone
    depleted = (gone > 0) & ((rest < LEAST_WORDS) | (rest < left * F.col("n_words")))
    return out.withColumn("n_removed", gone).withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality(docs: DataFrame, least: int = LEAST_DOCS, share: float = SHARE, left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the statistics, base_failed, n_removed (words in removed lines), kept: one row per input row.

    A null or empty text has no words and fails; a null source is a host of
    its own; repeated rows of a document get the same verdict; an empty table
    gives an empty result.  cleaned() gives the texts without those lines.
    """
    out = _judged(document_stats(docs), with_bound(_removed(docs, least, share).select("_d", "_k", "_gone")), left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept")


def cleaned(docs: DataFrame, least: int = LEAST_DOCS, share: float = SHARE, left: float = LEAST_LEFT) -> DataFrame:
    """The kept rows with docs' columns, text without its boilerplate lines.

    Other lines stay as they are, blank ones too; n_chars, where there is one,
    is counted again for a text that lost lines.  Rows are judged by doc_id
    (null-safe) and text together.
    """
    stats = document_stats(docs, {"_row": F.struct(*[docs[c] for c in docs.columns])})
    # No condition is pushed below a column that is not deterministic; there, kept would hold the statistics' whole expressions many times over.
    out = _judged(stats.withColumn("_pin", F.rand(0)), with_bound(_removed(docs, least, share)), left).where(F.col("kept") & (F.col("_pin") >= 0))
    lost = F.col("_lines").isNotNull()
    rest = F.expr("array_join(filter(split(cast(_row.text AS string), '\\n', -1), (x, i) -> not array_contains(_lines, i)), '\\n')")
    new = {"text": F.when(lost, rest).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length(rest).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
