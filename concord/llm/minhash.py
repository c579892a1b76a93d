"""MinHash fingerprints, of texts and of edited texts, and near-duplicate classes.

Shingles are runs of five words (lower case, split at white space); a shorter
text is one shingle.  ``PERMUTATIONS`` universal hash functions
(a x + b mod 2^64, upper half, over 32-bit shingle hashes) are applied in numpy
to all shingles of a piece of text at once; of each the minimum over a text's
shingles is kept, cut to 16 bits.  The share of equal minima estimates the
Jaccard similarity of two shingle sets.

Near-duplicate classes: signatures are cut into bands and joined on equal
bands in Spark.  The members of a band bucket are verified against its leader
first, by the exact Jaccard similarity of their shingle sets; connected
components over verified links follow.  Buckets that still hold several
components are compared in bounded tiles, across components only, and every
tile returns a spanning forest.  So every two members of a bucket are either
connected or compared, and neither a large group nor its pairs meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import pieces, range_cuts, range_udf, text_udf
from concord.llm.components import connected_components
from concord.llm.suffixes import string_keys
from concord.session import materialize

WORDS = 5
PERMUTATIONS, BANDS = 64, 16
SIMILARITY = 0.8
RANGE_BYTES = 16 << 20
TILE = 512
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes of all shingles, first shingle of each text and the end)."""
    lines = [b" ".join(t.lower().encode("utf-8", "surrogatepass").split()) for t in texts]
    raw = np.frombuffer(b"\n".join([*lines, b""]), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))            # of every word (an empty line has an empty word)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.array([len(x) for x in lines], np.int64)
    line = np.repeat(np.arange(len(lines)), [x.count(b" ") + 1 for x in lines]) if lines else np.zeros(0, np.int64)
    n = np.bincount(line, minlength=len(lines))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    count = np.where(sizes == 0, 0, np.maximum(n - words + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(len(lines)), count)
    begin = first[of] + np.arange(offsets[-1]) - offsets[of]
    last = np.minimum(begin + words, first[of] + n[of]) - 1
    keys = string_keys(raw, starts[begin], ends[last] - starts[begin])
    return (keys >> np.uint64(32)).astype(np.uint32), offsets


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, PERMUTATIONS] uint16: minima of each permutation; no shingle: all ones."""
    out = np.full((len(offsets) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        x = hashes.astype(np.uint64)
        for k in range(PERMUTATIONS):
            h = ((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(h, offsets[:-1][full])      # cut to the low 16 bits
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima of each pair of rows."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def signature_column(text: Column) -> Column:
    def step(texts: pa.Array) -> pa.Array:
        return pa.array([s.astype("<u2").tobytes() for s in signatures(*shingles([t or "" for t in texts.to_pylist()]))], pa.binary())

    return text_udf(step, "binary")(text)




def _set_column(text: Column) -> Column:
    """The different shingle hashes of a text, as bytes."""
    def step(texts: pa.Array) -> pa.Array:
        hashes, offsets = shingles([t or "" for t in texts.to_pylist()])
        return pa.array([np.unique(hashes[a:b]).astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())

    return text_udf(step, "binary")(text)


# ------------------------------------------------------------------ neighbours
ROW = ("doc_id bigint, row_key bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
       "edited_fingerprint binary, near_edited double, near_next double, class_id bigint")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many of ``following``, from its start, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range and descending doc_id (notes first, the next range's first row last)
    -> fingerprints of each text, of its edited text, and likeness to the next."""
    classes: dict[int, int] = {}
    held: dict | None = None                                    # the last row waits for its successor
    for batch in batches:
        kind = batch.column("kind")
        for note in batch.filter(pa.compute.equal(kind, -1)).column("classes").to_pylist():
            classes.update((x["row_key"], x["class_id"]) for x in note)
        rows = batch.filter(pa.compute.not_equal(kind, -1))
        at = 0
        for texts in pieces(rows.column("text")):
            part = rows.slice(at, len(texts))
            at += len(texts)
            own = part.select(["part", "kind", "doc_id", "row_key", "text"]).to_pylist()
            if held is not None:
                own.insert(0, held)
            yield _fingerprint(own, classes)
            held = own[-1]
    # a range ends with a row of the next one, so the row left over is such a row


def _fingerprint(rows: list[dict], classes: dict[int, int]) -> pa.RecordBatch:
    """Result rows of all but the last of ``rows``, and none for rows that only stand for a next one."""
    texts = [r["text"] for r in rows]
    hashes, offsets = shingles(texts)
    sig = signatures(hashes, offsets)
    keep = [k for k in range(len(rows) - 1) if rows[k]["kind"] == 0]
    changed = [edited(texts[k], texts[k + 1]) for k in keep]
    other = signatures(*shingles(changed))
    nxt = np.array(keep, np.int64) + 1
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([rows[k]["doc_id"] for k in keep], pa.int64()),
        "row_key": pa.array([rows[k]["row_key"] for k in keep], pa.int64()),
        "n_chars": pa.array([len(texts[k]) for k in keep], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([sig[k].astype(">u2").tobytes() for k in keep], pa.binary()),
        "edited_fingerprint": pa.array([s.astype(">u2").tobytes() for s in other], pa.binary()),
        "near_edited": pa.array(likeness(sig[keep], other), pa.float64()),
        "near_next": pa.array(likeness(sig[keep], sig[nxt]), pa.float64()),
        "class_id": pa.array([classes.get(rows[k]["row_key"], rows[k]["doc_id"]) for k in keep], pa.int64())})


def fingerprint_rows(docs: DataFrame, classes: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, row_key, text not null) -> rows of ``ROW``, one for each.

    The next document is the one before it in ascending doc_id (ties: by row
    key, null ids before all others), after the smallest the largest.  Texts
    are shuffled once, by ranges of doc_id; each range gets a copy of the first
    row of the next.  ``classes`` (doc_id, row_key, class_id): class of the rows
    whose class is not their own id; they travel to the range as one note."""
    facts = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.max("doc_id").alias("top")).head()
    n = max(1, -(-(facts["n"] or 0) // range_bytes))
    cuts = range_cuts(docs.select("doc_id"), n)
    part_of = range_udf(cuts)
    ends = set(cuts.tolist())

    # which further range gets a copy of the row as its last
    @F.arrow_udf("array<int>")
    def copies_to(ids: pa.Array) -> pa.Array:
        known = ids.to_pylist()
        part = np.searchsorted(cuts, [-(1 << 63) if i is None else i for i in known], side="left").tolist()
        return pa.array([([p + 1] if i in ends else []) + ([0] if i == facts["top"] else []) for i, p in zip(known, part)],
                        pa.list_(pa.int32()))

    nothing = F.lit(None).cast("array<struct<row_key: bigint, class_id: bigint>>").alias("classes")
    cols = ["doc_id", "row_key", "text"]
    stream = docs.select(part_of("doc_id").alias("part"), F.lit(0).alias("kind"), *cols, nothing)
    extra = docs.select(F.explode(copies_to("doc_id")).alias("part"), F.lit(1).alias("kind"), *cols, nothing)
    stream = stream.union(extra)
    if classes is not None:
        notes = classes.groupBy(part_of("doc_id").alias("part")).agg(F.collect_set(F.struct("row_key", "class_id")).alias("classes"))
        stream = stream.union(notes.select("part", F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"),
                                           F.lit(None).cast("bigint").alias("row_key"), F.lit(None).cast("string").alias("text"), "classes"))
    # notes of a range come first, then its rows, then the row that follows
    order = stream.repartition(n, "part").sortWithinPartitions(
        "part", "kind", F.col("doc_id").desc_nulls_last(), "row_key")
    return order.mapInArrow(_walk, ROW)


# --------------------------------------------------------------------- classes
def _jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _verify(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_jaccard(x.as_buffer(), y.as_buffer()) >= SIMILARITY for x, y in zip(a, b)], pa.bool_())


def _tile(rows: pa.Table) -> pa.Table:
    """Verified links between different components of one tile, thinned to a spanning forest."""
    node, comp = rows.column("node").to_numpy(), rows.column("component").to_numpy()
    side = rows.column("side").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("shingle_set").combine_chunks()]
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(size)])
    root = dict(zip(comp.tolist(), comp.tolist()))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    right = np.flatnonzero(side == 1)
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    totals = np.zeros(ends[-1] + 1, np.int64)
    for i in np.flatnonzero(side == 0).tolist():
        mine = ids[ends[i]: ends[i + 1]]
        mark[mine] = True
        np.cumsum(mark[ids], out=totals[1:])
        mark[mine] = False
        both = totals[ends[1:]] - totals[ends[:-1]]
        close = both >= SIMILARITY * (size + size[i] - both)
        for j in right[close[right]].tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[y] = x
                a.append(int(node[i]))
                b.append(int(node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def band_buckets(reps: DataFrame) -> DataFrame:
    """reps(node, sig) -> (bucket, leader, n, node) for every band bucket with several
    members; buckets of the same members in several bands are one."""
    width = 2 * PERMUTATIONS // BANDS
    bands = reps.select("node", F.explode(F.array(*[F.struct(
        F.lit(k).alias("band"), F.substring("sig", k * width + 1, width).alias("key")) for k in range(BANDS)])).alias("b")) \
        .select("node", F.xxhash64("b.band", "b.key").alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    found = bands.join(buckets, "key")
    mark = materialize(found, "bands")
    same = mark.groupBy("key").agg(F.bit_xor(F.xxhash64("node", F.lit(3))).alias("mark"))
    return mark.join(same, "key").select(F.xxhash64("mark", "n", "leader").alias("bucket"), "leader", "n", "node").distinct()


def near_classes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members of ``band_buckets``, sets(node, shingle_set) -> (node, component) of
    the nodes that a verified link connects to another."""
    a = sets.withColumnsRenamed({"node": "a", "shingle_set": "set_a"})
    b = sets.withColumnsRenamed({"node": "b", "shingle_set": "set_b"})
    same = F.arrow_udf(_verify, "boolean")
    to_leader = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    stars = materialize(to_leader.join(a, "a").join(b, "b").where(same("set_a", "set_b")).select("a", "b"), "stars-verified")
    part = connected_components(stars)
    placed = members.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    left = placed.join(split, "bucket").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    tile = lambda side, i, j, lo, hi: left.select(                                              # noqa: E731
        "bucket", "node", "component", F.lit(side).alias("side"), F.col("own").alias(i), F.explode(F.sequence(lo, hi)).alias(j)
    ).select("bucket", "node", "component", "side", "i", "j")
    tiles = tile(0, "i", "j", F.col("own"), F.col("blocks") - 1).union(tile(1, "j", "i", F.lit(0), F.col("own")))
    more = materialize(tiles.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_tile, "a long, b long"), "tiles-verified")
    if more.isEmpty():
        return part
    return connected_components(stars.union(more))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a row for each: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, class_id).

    ``class_id`` is the smallest doc_id of the near-duplicate class (exact
    copies and verified links, Jaccard 0.8 or more over five-word shingles).
    A null text is empty; texts without words have the same fingerprint; a null
    doc_id counts as smaller than all; repeated rows stay."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("row_key", F.xxhash64("doc_id", "text"))
    # a node is a different text, named by its 64-bit hash
    own = materialize(rows.select("doc_id", "row_key", F.xxhash64("text").alias("node"), signature_column(F.col("text")).alias("sig")),
                      "signatures")
    texts = materialize(own.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("first")), "texts")
    members = materialize(band_buckets(own.groupBy("node").agg(F.first("sig").alias("sig"))), "band-buckets")
    # written first, so that a small list is broadcast and the texts are not shuffled for it
    wanted = materialize(members.select("node").distinct().join(texts, "node").select("row_key"), "compared-texts")
    sets = materialize(rows.join(wanted, "row_key", "left_semi").select(
        F.xxhash64("text").alias("node"), _set_column(F.col("text")).alias("shingle_set")).dropDuplicates(["node"]), "shingle-sets")
    named = texts.join(near_classes(members, sets), "node", "left").withColumn("component", F.coalesce("component", "node"))
    class_id = named.groupBy("component").agg(F.min("first").alias("class_id"))
    labels = materialize(own.select("doc_id", "row_key", "node").distinct().join(named.select("node", "component"), "node")
                         .join(class_id, "component").where(~F.col("class_id").eqNullSafe(F.col("doc_id")))
                         .select("doc_id", "row_key", "class_id"), "classes")
    text = lambda c: F.lower(F.hex(c)).alias(c)                                                 # noqa: E731
    return fingerprint_rows(rows, labels).select(
        "doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next", "class_id")
