"""MinHash near-dedup: one-permutation hashing with optimal densification.

A text's word shingles are hashed once; the hash's leading bits choose one of
256 bins and the least hash of a bin is its value (one permutation instead of
256).  An empty bin borrows from the first filled one of a fixed random order of
bins, the same for every text, which keeps each bin's collision probability at
the Jaccard similarity.  Bands of bins make buckets; in a bucket every text is
a candidate of the bucket's least row only, a star of n - 1 edges instead of
n * (n - 1) / 2.  Edges are confirmed on the full shingle sets.

One confirmed link a text is enough to connect it, so edges are tried in
rounds: first each text's hub that it shares most buckets with, then, between
components that are still apart, the best edge of each pair of components.
After a round the linked texts are contracted to their component, and later
rounds work on components alone.

A star misses a link if its centre is unlike both texts.  So the texts of
buckets that are not all connected afterwards meet again by their rarest
shingles, of which linked sets always share one (prefix filtering): 16 centres a
shingle, then 256, and so on, each compared with the texts of other components
only, until every text has been a centre.  No link among texts of shared buckets
is missed, and a crowd of unlike variants of one text makes few pairs, since
what they have in common is not rare.

Texts with equal sets are one class, linked without a comparison; everything
after that works on one row a class, so copies never become pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, keyed_join, lean, ship, slices, text_of, with_bound

BINS = 256
#: Centres of a rare shingle: so many in the first round, times so many in each next one.
GROWTH = 16
WHITES = np.zeros(256, bool)
WHITES[[9, 10, 11, 12, 13, 32]] = True
#: Bands and rows a band; at the threshold a pair shares no bucket with probability below 1e-8.
BANDS = {"default": (51, 5), "high": (42, 6)}
_rng = np.random.default_rng(20240607)
BASE = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
MIXERS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1).astype(np.int16)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of UTF-8 bytes, A-Z lower-cased: polynomial sums over bytes, then mixed."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~WHITES[data]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    # Position within the word gives the power, so equal words hash alike wherever they stand.
    length = end - start
    keep = inside[1:-1].astype(bool)
    letters = data[keep].astype(np.uint64) + np.uint64(1)
    offset = np.concatenate(([0], np.cumsum(length)[:-1]))
    at = np.arange(len(letters)) - np.repeat(offset, length)
    powers = np.cumprod(np.full(int(length.max()), BASE, np.uint64))
    # Two sums over differently mixed letters; a single sum modulo 2**64 has weak low bits.
    h = np.add.reduceat(letters * powers[at], offset)
    g = np.add.reduceat(mix64(letters * MIXERS[0] + at.astype(np.uint64)), offset)
    return mix64(h ^ mix64(g + length.astype(np.uint64)))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text with fewer words has its whole sequence as one."""
    w = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(w):
        return w
    k = min(width, len(w))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        total = mix64(total * MIXERS[1] + w[i : len(w) - k + 1 + i])
    return np.unique(total)


def bands_of(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    value = np.zeros(BINS, np.uint64)
    value[filled] = shingles[first]
    if len(filled) < BINS:
        full = np.zeros(BINS, bool)
        full[filled] = True
        empty = np.flatnonzero(~full)
        order = ORDER[empty]
        lender = order[np.arange(len(empty)), full[order].argmax(1)]
        value[empty] = value[lender]
    used = value[: bands * rows].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * MIXERS[2]
    for r in range(rows):
        out = mix64(out * MIXERS[3] + used[:, r])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def run(batches):
        import hashlib

        for b in slices(batches):
            n, digest, band = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                band.append(bands_of(s, bands, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "_key", "n_shingles", "digest", "bands"])

    return run


def _pack(width: int):
    def run(batches):
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "packed"])

    return run


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id apart."""
    text = text_of(docs)
    return ship(docs).select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_key"))


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, _key, n_shingles, digest of the whole set, band hashes, _row (a number of its own); the sets themselves are not kept; written."""
    slim = _slim(docs)
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = slim.mapInArrow(lean(_sketch(width, bands, rows)), f"doc_id {kind}, _key long, n_shingles long, digest binary, bands array<long>")
    return cut(out.withColumn("_row", F.monotonically_increasing_id()))


def full_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """rep, n, packed for the given rows (doc_id, _key, rep; written), shingled again from their texts."""
    wanted = with_bound(reps.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "rep"))
    slim = _slim(docs)
    texts = slim.join(wanted, slim["doc_id"].eqNullSafe(F.col("_d")) & (slim["_key"] == F.col("_k"))).select("rep", "text")
    return cut(texts.mapInArrow(lean(_pack(width)), "rep long, n long, packed binary").dropDuplicates(["rep"]))


def _shingles(batches):
    for b in slices(batches):
        packed = b.column(1)
        at = [np.frombuffer(packed[i].as_buffer(), np.int64) for i in range(b.num_rows)]
        reps = np.repeat(b.column(0).to_numpy(), [len(x) for x in at])
        ids = np.concatenate(at) if at else np.zeros(0, np.int64)
        for k in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(reps[k : k + (1 << 16)]), pa.array(ids[k : k + (1 << 16)])], ["rep", "shingle"])


def rare_shingles(sets: DataFrame, threshold: int) -> DataFrame:
    """key, rep, n, pos: each set's rarest shingles, of which two linked sets always share one; written.

    A link needs at least threshold percent of n shingles in common, so in one
    order of all shingles the first n - ceil(threshold * n / 100) + 1 of both
    sets meet (prefix filtering).  The order is by number of sets, then hash;
    shingles of one set only take their places but need no row.  pos is the
    place in the order: sets that first meet at places p and q have at most
    min(n - p, m - q) shingles in common.
    """
    seen = sets.select("rep", "packed").mapInArrow(lean(_shingles), "rep long, shingle long")
    often = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    per = seen.join(often, "shingle").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_df", "shingle"))).alias("_s"))
    room = F.expr(f"n - ({threshold} * n + 99) div 100 + 1 - (n - size(_s))").cast("int")
    per = per.join(sets.select("rep", "n"), "rep").withColumn("_room", room).where("_room > 0")
    per = per.select("rep", "n", (F.col("n") - F.size("_s")).alias("_own"), F.posexplode(F.slice("_s", 1, F.col("_room"))["shingle"]).alias("_at", "key"))
    return cut(per.select("key", "rep", "n", (F.col("_own") + F.col("_at")).alias("pos")))


def _confirm(threshold: int):
    def run(batches):
        for b in slices(batches, column=2):
            a, c = b.column(2), b.column(3)
            good = []
            for i in range(b.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(c[i].as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * inter >= threshold * (len(both) - inter))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["hub", "rep"]).filter(keep)

    return run


def confirm(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The edges (hub, rep) whose sets have 100 * intersection >= threshold * union; sets: rep, n, packed."""
    left = sets.select(F.col("rep").alias("hub"), F.col("packed").alias("_a"), F.col("n").alias("_n"))
    ratio = 100 * F.least("_n", "n") >= threshold * F.greatest("_n", "n")
    both = edges.join(sets, "rep").join(left, "hub").where(ratio)
    return cut(both.select("hub", "rep", F.col("packed").alias("_b"), "_a").mapInArrow(lean(_confirm(threshold)), "hub long, rep long"))


def contract(ends: DataFrame) -> DataFrame | None:
    """node, up (the component's node that none is below) for the nodes of the edges (lo, hi), lo < hi; written; None without edges.

    Each node takes its least lower neighbour as parent, which gives a forest;
    its roots are found by doubling.  What joins different trees is an edge
    between their roots and goes round again.
    """
    out = None
    while not ends.isEmpty():
        tree = cut(ends.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")))
        one_each = ends.count() == tree.count()
        while True:
            higher = tree.select(F.col("node").alias("up"), F.col("up").alias("_top"))
            tree = cut(tree.join(higher, "up", "left").select("node", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("_moved")))
            moved, tree = not tree.where("_moved").isEmpty(), tree.select("node", "up")
            if not moved:
                break
        out = tree if out is None else cut(_relabelled(out, tree, "up").unionByName(tree))
        if one_each:
            break
        ends = cut(_edges(_relabelled(_relabelled(ends, out, "lo"), out, "hi"), "lo", "hi"))
    return out


def _relabelled(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """df with the component (node, up) in place of a column's values; others stay."""
    names = df.columns
    out = df.join(with_bound(roots.select(F.col("node").alias(column), F.col("up").alias("_up"))), column, "left")
    return out.withColumn(column, F.coalesce("_up", column)).select(*names)


def _edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (lo, hi) of the rows whose two columns differ."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, up: its component) after further links (hub, rep); written.  Nodes that are missing are components of their own."""
    ends = _edges(_relabelled(_relabelled(links.select("hub", "rep"), labels, "hub"), labels, "rep"), "hub", "rep")
    roots = contract(cut(ends))
    if roots is None:
        return labels
    # A root's own row is missing from roots, and from labels as well, so no node is named twice.
    return cut(_relabelled(labels, roots, "up").unionByName(roots))


def _components(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found with comp, the component of its rep."""
    return _relabelled(found.withColumn("comp", F.col("rep")), labels, "comp")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, _key: one row per input row.

    Two texts are linked at 100 * |A & B| >= threshold * |A | B| over their
    distinct word shingles; component_id is the smallest doc_id reachable.
    Words are runs without ASCII white space, A-Z lower-cased.  A text without
    words (null, empty) has no shingles, stays alone and is kept; an empty
    table gives an empty result.  doc_id may be of any type that can be
    ordered.  Rows are told apart by themselves, not by doc_id: a row with a
    null id is linked like any other, and gives component_id only where no row
    of its component has an id; of several rows with one doc_id each is linked
    by its own text.  kept marks the component's row with the smallest doc_id,
    exactly one of them if it is repeated.  class_id is the least doc_id with
    exactly the same shingle set, _key a hash of the text (XXH64, null as
    empty), which tells rows of one doc_id apart.
    """
    bands, rows = BANDS["high" if threshold >= 85 else "default"]
    sketch = sketches(docs, width, bands, rows)
    filled = sketch.where("n_shingles > 0")
    low = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key"), F.col("_row").alias("row"))
    classes = cut(filled.groupBy("digest").agg(F.min("_row").alias("rep"), F.min(low).alias("low"), F.count(F.lit(1)).alias("_often")))
    reps = cut(filled.join(with_bound(classes.select(F.col("rep").alias("_row"))), "_row", "left_semi").select("doc_id", "_key", F.col("_row").alias("rep"), F.col("n_shingles").alias("n"), "bands"))
    bucket = reps.select("rep", "n", F.explode("bands").alias("band"))
    hubs = cut(bucket.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("_often")).where("_often > 1"))
    # Only rows of shared buckets go on.
    shared = keyed_join(bucket, hubs, "band", "_often").select("band", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("_n"))
    shared = cut(shared.withColumn("alike", (F.col("hub") < F.col("rep")) & (100 * F.least("n", "_n") >= threshold * F.greatest("n", "_n"))).select("band", "rep", "hub", "alike"))
    involved = shared.select("rep").distinct()
    sets = full_sets(docs, cut(reps.select("doc_id", "_key", "rep").join(involved, "rep", "left_semi")), width)
    # First each text with the hub of most of its buckets.
    votes = shared.where("alike").groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("_v"))
    tried = cut(votes.groupBy("rep").agg(F.max(F.struct("_v", (-F.col("hub")).alias("_h"))).alias("_b")).select((-F.col("_b._h")).alias("hub"), "rep"))
    none = docs.sparkSession.createDataFrame([], "node long, up long")
    labels = linked(none, confirm(tried, sets, threshold))
    # Then the best edge between each pair of components that a bucket holds both of.
    open_ = _components(shared, labels).withColumn("_c", F.col("hub"))
    open_ = _relabelled(open_, labels, "_c").where("alike and comp <> _c")
    votes = open_.groupBy("comp", "_c", "hub", "rep").agg(F.count(F.lit(1)).alias("_v"))
    again = votes.groupBy(F.least("comp", "_c").alias("lo"), F.greatest("comp", "_c").alias("hi")).agg(F.max(F.struct("_v", "hub", "rep")).alias("_b")).select("_b.hub", "_b.rep")
    again = cut(again.join(tried, ["hub", "rep"], "left_anti"))
    labels, tried = linked(labels, confirm(again, sets, threshold)), tried.unionByName(again)
    # Texts of buckets that are not connected yet meet again by their rare shingles.
    apart = _components(shared.select("band", "rep"), labels)
    split = cut(apart.groupBy("band").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("band"))
    rest = cut(shared.select("band", "rep").join(with_bound(split), "band", "left_semi").select("rep").distinct())
    rare, wanted = rare_shingles(sets.join(with_bound(rest), "rep", "left_semi"), threshold), GROWTH
    while True:
        known = _components(rare, labels)
        split = known.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_m")).where("_low < _high")
        split = cut(split.select("key", "_m"))
        most = split.agg(F.max("_m")).first()[0]
        if most is None:
            break
        open_ = cut(known.join(with_bound(split), "key"))
        # About `wanted` centres a key, all of its texts once it has no more; each meets the texts of other components.
        centre = open_.where(F.pmod(F.xxhash64("key", "rep"), F.ceil(F.col("_m") / wanted)) == 0)
        centre = with_bound(cut(centre.select("key", F.col("rep").alias("_c"), F.col("n").alias("_n"), F.col("pos").alias("_pos"), F.col("comp").alias("_comp"))))
        enough = (100 + threshold) * F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) >= threshold * (F.col("n") + F.col("_n"))
        pairs = open_.join(centre, "key").where("comp <> _comp").where(enough)
        pairs = pairs.select(F.least("rep", "_c").alias("hub"), F.greatest("rep", "_c").alias("rep")).distinct()
        pairs = cut(pairs.join(tried, ["hub", "rep"], "left_anti"))
        labels = linked(labels, confirm(pairs, sets, threshold))
        if wanted >= most:
            break
        tried, wanted = tried.unionByName(pairs), wanted * GROWTH
    # The smallest row of each component, first over classes, then over components.
    placed = cut(_components(classes.select("digest", "rep", "low", "_often"), labels))
    merged = cut(placed.where(F.col("rep") != F.col("comp")).select("comp").distinct())
    heads = cut(placed.join(with_bound(merged), "comp", "left_semi").groupBy("comp").agg(F.min("low").alias("_head")))
    placed = cut(placed.join(with_bound(heads), "comp", "left").select("digest", F.coalesce("_head", "low").alias("_head"), F.col("low.id").alias("class_id"), "_often"))
    member = keyed_join(filled.select("doc_id", "_key", "n_shingles", "digest", "_row"), placed, "digest", "_often")
    member = member.select("doc_id", "n_shingles", F.col("_head.id").alias("component_id"), (F.col("_row") == F.col("_head.row")).alias("kept"), "class_id", "_key")
    alone = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("doc_id").alias("class_id"), "_key")
    return member.unionByName(alone)
