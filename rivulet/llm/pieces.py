"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so no
merge crosses the start of a marked word.  A text is split before each run of
markers, every distinct chunk is segmented once by the library, and the ids are
joined back by position.  Chunk tables live in the Python workers, bounded in
size, so words are never shuffled.  A chunk is written without its first marker,
so a text is its chunks joined by spaces.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rivulet.llm.common import Recent, lean, ship, slices, text_of

MARK = "▁"
CHUNK = re.compile(" ( *[^ ]*)")


def chunks_of(text: str) -> list[str]:
    if "  " in text or text[:1] in ("", " "):
        return CHUNK.findall(" " + text) if text else []
    return text.split(" ")


class ChunkTable(Recent):
    """chunk -> its ids as little-endian uint32 bytes."""

    GENERATION = 100_000

    def __init__(self, model: str):
        import sentencepiece

        super().__init__(lambda chunk: self.segment([chunk])[0])
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.vocab_size())) if MARK in p.lstrip(MARK)]
        if crossing or "".join(self.sp.encode("  a", out_type=str)) != 3 * MARK + "a":
            raise ValueError("pieces of this model can cross whitespace markers")
        self.mark = self.sp.piece_to_id(MARK)
        #: Chunks that decode to something else than themselves, and what that is.
        self.changed: dict[str, str] = {}

    def segment(self, chunks: list[str]) -> list[bytes]:
        # The library puts a marker before what it gets: the chunk's first.
        ids = [i if c else [self.mark] for i, c in zip(self.sp.encode(chunks, num_threads=1), chunks)]
        # That marker is dropped in decoding, as at the start of a text.
        for c, back in zip(chunks, self.sp.decode(ids, num_threads=1)):
            if back != c:
                self.changed[c] = back
        return [array("I", i).tobytes() for i in ids]

    def find(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of all wanted chunks; those in neither generation are segmented in one call.

        Nothing is put before all are found, so a generation that ends here takes none of them away:
        a call of the library for a single chunk costs many times a chunk's share of a call for thousands.
        """
        found = {c: ids for c in wanted if (ids := self.get(c) or self.old.get(c)) is not None}
        new = [c for c in wanted if c not in found]
        if new:
            found.update(zip(new, self.segment(new)))
        for c, ids in found.items():
            if c not in self:
                self.put(c, ids)
        return found

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids without begin and end, and the text that they decode to."""
        texts = [t.replace(MARK, " ") for t in texts]
        chunks = [chunks_of(t) for t in texts]
        found = self.find(set().union(*chunks))
        if len(self.changed) > 2 * self.GENERATION:
            # A chunk outside the tables is noted again when it is segmented again; those of this group stay.
            self.changed = {c: d for c, d in self.changed.items() if c in self or c in self.old or c in found}
        out = []
        for t, own in zip(texts, chunks):
            ids = b"".join([found[c] for c in own])
            if self.changed and not self.changed.keys().isdisjoint(own):
                t = " ".join([self.changed.get(c, c) for c in own])
            out.append((ids, t))
        return out


def _grouped(texts: list[str], chars: int = 250_000):
    """Runs of texts of about so many code points, so that their chunks fit in memory."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


@functools.lru_cache(maxsize=4)
def table(model: str) -> ChunkTable:
    return ChunkTable(model)


def _encode(model: str, outputs: str):
    def run(batches):
        t = table(model)
        bos, eos = (array("I", [x]).tobytes() for x in (t.sp.bos_id(), t.sp.eos_id()))
        digests, short = outputs == "digests", outputs != "ids"
        for b in slices(batches, size=2 << 20):
            done = 0
            # A group's ids go out as one buffer before the next group is encoded.
            for group in _grouped(b.column(1).to_pylist()):
                bodies, decoded = zip(*t.encode(group))
                whole = [bos + body + eos for body in bodies]
                n = pa.array([len(w) // 4 for w in whole], pa.int64())
                if digests:
                    ids = pa.array([hashlib.sha256(w).hexdigest() for w in whole], pa.string())
                else:
                    ends = np.cumsum([0, *(len(w) // 4 for w in whole)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(whole), np.int32)))
                if short:
                    decoded = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(group)), n, ids, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                done += len(group)

    return lean(run)


def encode(docs: DataFrame, model: str, outputs: str = "ids") -> DataFrame:
    """doc_id, n_tokens (long, with begin and end), ids, decoded: one row per input row, no shuffle.

    outputs "ids" gives array<int> and the decoded text, "digests" their
    SHA-256 (ids as little-endian uint32; the text in UTF-8), "ids and digest"
    array<int> and the decoded text's SHA-256.  Null and empty
    texts have the two special ids only.  model: a file on every executor.
    """
    slim = ship(docs).select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    ids = "string" if outputs == "digests" else "array<int>"
    return slim.mapInArrow(_encode(model, outputs), f"doc_id {kind}, n_tokens long, ids {ids}, decoded string")


def _decode(model: str):
    def run(batches):
        t = table(model)
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.sp.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id and ids (array<int>); null or empty ids give an empty text."""
    slim = ship(encoded).select("doc_id", "ids")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_decode(model), f"doc_id {kind}, text string")
