"""Language ID by compression: the language whose text, as a raw zstandard dictionary, makes a document smallest.

Dictionaries hold text of a bounded sample of labelled documents; every document
is then compressed, block by block, whole.  The score is the relative margin to
the runner-up; below LEAST_MARGIN the prediction is marked as rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import ship, slices, text_of

#: The sample: documents a language, code points taken of each, and languages, those with most documents (ties by name).
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 200, 1000, 64
BLOCK = 4096
LEVEL = 3
LEAST_MARGIN = 0.02
LETTER = re.compile(r"[^\W\d_]")


def held_out(docs: DataFrame):
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """lang -> raw dictionary; from labelled documents that are not held out, chosen by a hash of the id.

    At most languages * sample_docs * SAMPLE_CHARS code points reach the driver
    and the workers.
    """
    known = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs))
    known = known.select(docs["lang"].alias("lang"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"]).alias("h")).where("length(text) > 0")
    chosen = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    found = known.where(F.col("lang").isin(chosen)).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).withColumn("r", rank).where(F.col("r") <= sample_docs)
    out: dict[str, list[str]] = {}
    for row in sorted(found.select("lang", "r", "text").collect()):
        out.setdefault(row["lang"], []).append(row["text"])
    return {k: "\n".join(v).encode() for k, v in out.items()}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.by = {}
        for lang, raw in sorted(dictionaries.items()):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by[lang] = z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def classify(self, text: str) -> tuple[str, float]:
        if not self.by or not LETTER.search(text):
            return "und", 0.0
        data = text.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def _classify(dictionaries: dict[str, bytes], least: float):
    def run(batches):
        c = Compressors(dictionaries)
        for b in slices(batches, column=2):
            found = [c.classify(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] < least for f in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def language_id(docs: DataFrame, least_margin: float = LEAST_MARGIN, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), rejected (narrow margin): one row per input row.

    Null texts and texts without a letter are ``und`` with score 0 and
    rejected; equal sizes go to the first language by name; repeated rows
    repeat their result; without labelled rows everything is ``und``.  A row
    with a null id is not learned from and not held out.
    """
    dictionaries = train(docs, sample_docs, languages)
    slim = ship(docs).select(docs["doc_id"].alias("doc_id"), held_out(docs).alias("held_out"), text_of(docs).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_classify(dictionaries, least_margin), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
