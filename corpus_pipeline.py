"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents.  run() writes each stage's result to the shared folder and reads it
back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import exact_dedup, mixing, near_dedup, pieces, quality
from rivulet.llm.common import cut, text_of, with_bound
from rivulet.llm.queries import vocabulary


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with a written table of (doc_id, hash of the text); a null id equals a null id."""
    names = ["_gone_id", "_gone_key"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    right = with_bound(rows.toDF(*names))
    return docs.join(right, docs["doc_id"].eqNullSafe(right[names[0]]) & (F.xxhash64(text_of(docs)) == right[names[1]]), how)


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that found (doc_id, _key, kept: a row for each row of docs) keeps; of repeated rows as many as it keeps, one or none."""
    found = cut(found.select("doc_id", "_key", "kept"))
    gone = cut(found.where("not kept").select("doc_id", "_key").distinct())
    once = cut(_twice(found.where("kept").select("doc_id", "_key"), gone))
    if once.isEmpty():
        return _matched(docs, gone, "left_anti")
    rest = _matched(docs, gone, "left_anti")
    return rest.unionByName(_matched(docs, once, "left_semi").dropDuplicates(["doc_id", "text"]))


def _twice(kept: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents of which one row is kept and another is not: repeated rows."""
    other = with_bound(gone.toDF("_d", "_k"))
    return kept.join(other, kept["doc_id"].eqNullSafe(F.col("_d")) & (kept["_key"] == F.col("_k")), "left_semi").distinct()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, without boilerplate lines.

    A null or empty text fails; a null source is a host of its own; repeated
    rows get the same verdict; all columns stay, also ones whose names the
    rules use; an empty table stays empty.
    """
    return quality.cleaned(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest doc_id.

    Null counts as an empty text and a null id as the smallest; of repeated
    rows one stays, as of rows that differ in other columns only; two texts
    under one id are told apart; an empty table stays empty.
    """
    return _kept(docs, exact_dedup.exact_dedup(docs, {"_key": F.xxhash64(text_of(docs))}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8), the one with the smallest doc_id.

    A text without words (null, empty) is in no group and stays; a row with a
    null id goes if a row with one is in its group; of repeated rows one stays.
    """
    return _kept(docs, near_dedup.near_duplicates(docs, width=5, threshold=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 2 times.

    A null source is a source of its own; rows without words are taken by
    their source's rate as well; rows that repeat a doc_id share its draw.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the decoded text) per row; a null or empty text has the two special ids only."""
    found = pieces.encode(docs, vocabulary("piece_bpe_32k.model"), "ids and digest")
    return found.select("doc_id", "n_tokens", "ids", F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: Encoding and near-dedup by sketches have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None
