"""Removal of repeated byte strings, by difference covers and buckets of suffixes.

A byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller doc_id.  Two equal strings are two suffixes that agree
in their first ``width`` bytes, so the work is to find the suffixes that tie.

Sorting all suffixes of a corpus would move every byte ``width`` times.  A
difference cover modulo ``v`` thins them out: D is a set of residues such that
for any two places i, j some d < v brings both i + d and j + d into D.  If the
strings at i and j are equal, so are the cover samples at i + d and j + d of
``width - v + 1`` bytes.  Hence

1. the documents are cut into blocks of about as many bytes by ranges of doc_id
   (a bucketed table: all later steps read a block without shuffling text again);
2. every block ranks its cover samples (sorted keys, repeats left out);
3. buckets of sample keys meet, one bucket in a task, and tell every block which
   of its samples tie with another block's, one bit a sample;
4. only suffixes that hold a tied sample can tie: their ``width`` bytes are
   keyed (64 bits) and sorted within the block;
5. buckets of suffix keys meet likewise, and every block learns which of its
   keys occur in a smaller block, again one bit a key;
6. the blocks mark and cut the bytes; ties inside a block are settled there.

Exact copies of a smaller document are known from a digest and skip all that.
Keys cross the network as the steps between a bucket's sorted keys, about 3
bytes a sample and 6 a suffix, 8 at most: what a block sends depends on its own
keys, however many buckets the corpus has.  A task holds one block (about
``BLOCK_BYTES``) or one bucket; a string that stands in a third of all
documents is one key a block.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import pieces, range_cuts, range_udf, utf8
from concord.session import materialize, scratch_path

WIDTH = 50
#: A perfect difference set: every difference modulo 21 occurs.
MODULUS, COVER = 21, (3, 6, 7, 12, 14)
BLOCK_BYTES = 16 << 20
BUCKET_KEYS = 1 << 22
#: Files of the table of blocks; more blocks share a file, and a task takes them one after the other.
BLOCK_FILES = 20_000
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
PACKED = "bucket int, block int, width int, steps binary"


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64, n of each or more."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.cumprod(p))
        _powers = tuple(out)
    return _powers


def string_keys(raw: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit keys of the strings of ``width`` bytes at ``starts``."""
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=total[1:])
    h = (total[starts + width] - total[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, int]:
    """(bucket of each key of ``bits`` bits, bits of a key within its bucket)."""
    inner = bits - (buckets.bit_length() - 1)
    return (keys >> np.uint64(inner) if buckets > 1 else np.zeros(len(keys), np.uint64)).astype(np.int64), inner


def pack(keys: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, int, pa.Array]:
    """Sorted different keys of ``bits`` bits -> (buckets that hold some, bytes of a step, their steps):
    a bucket's first step is its first key less the bucket's leading part, each other the way from the key before."""
    bucket, inner = bucket_of(keys, bits, buckets)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[first] = keys[first] & np.uint64((1 << inner) - 1)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    data = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = np.append(first, len(keys)).astype(np.int64) * width
    packed = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return bucket[first], width, packed.cast(pa.binary())


def unpack(steps: bytes, width: int) -> np.ndarray:
    """Sorted keys of one block in one bucket (counted from the bucket's first)."""
    out = np.zeros((len(steps) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(steps, np.uint8).reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


class Block:
    """The texts of one block that are no exact copies, by doc_id."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        ids = docs.column("doc_id").to_numpy()
        keys = docs.column("row_key").to_numpy()
        copies = np.array([k for part in notes.column("copies").to_pylist() for k in part or []], np.int64)
        self.docs = docs
        self.copy = np.isin(keys, copies)
        own = np.flatnonzero(~self.copy)
        self.order = own[np.argsort(ids[own], kind="stable")]
        self.rank = np.unique(ids[self.order], return_inverse=True)[1]      # equal ids, equal ranks
        self.texts = docs.column("text").combine_chunks().take(pa.array(self.order))
        bits: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        for step, bucket, b in zip(notes.column("step").to_pylist(), notes.column("bucket").to_pylist(),
                                   notes.column("bits").to_pylist()):
            if b is not None:
                bits[step][bucket] = b
        self.bits = bits

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, bytes, offsets) of bounded runs of texts."""
        first = 0
        for p in pieces(self.texts):
            yield first, *utf8(p)
            first += len(p)

    @staticmethod
    def cover_places(offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of every cover sample of ``span`` bytes that ends within its text."""
        room = np.maximum(np.diff(offsets) - span + 1, 0)
        within = np.add.outer(np.arange(0, room.max(initial=0), MODULUS), COVER).ravel()
        count = np.searchsorted(within, room)
        text = np.repeat(np.arange(len(room)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return within[nth] + np.repeat(offsets[:-1], count), text

    def samples(self, bits: int) -> tuple[np.ndarray, list]:
        """(key of each cover sample, [(first text, bytes, offsets, starts)])."""
        span = WIDTH - MODULUS + 1
        keys, runs = [np.zeros(0, np.uint64)], []
        for first, raw, offsets in self.parts():
            starts, text = self.cover_places(offsets, span)
            keys.append(string_keys(raw, starts, span) >> np.uint64(64 - bits))
            runs.append((first, raw, offsets, starts, text + first))
        return np.concatenate(keys), runs

    def answers(self, step: int, keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
        """The bits that came back for the sorted, different ``keys``."""
        bucket = bucket_of(keys, bits, buckets)[0]
        out = np.zeros(len(keys), bool)
        said = sorted(self.bits[step])
        begin, end = np.searchsorted(bucket, said), np.searchsorted(bucket, said, side="right")
        for b, lo, hi in zip(said, begin.tolist(), end.tolist()):
            out[lo:hi] = np.unpackbits(np.frombuffer(self.bits[step][b], np.uint8), count=hi - lo).astype(bool)
        return out

    def suffixes(self, plan: dict) -> tuple[np.ndarray, list]:
        """(key of every suffix that holds a tied sample, [(first text, offsets, starts)])."""
        keys, runs = self.samples(plan["sample_bits"])
        found, where = np.unique(keys, return_inverse=True)
        tied = self.answers(0, found, plan["sample_bits"], plan["sample_buckets"])
        text = np.concatenate([np.zeros(0, np.int64), *[r[4] for r in runs]])
        # texts ascend and the last value stays: backwards the first text of a key, forwards its last
        low, high = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        low[where[::-1]] = text[::-1]
        high[where] = text
        tied |= high > low                                     # in two texts of this block
        good = tied[where]
        out, spans, at = [np.zeros(0, np.uint64)], [], 0
        for first, raw, offsets, starts, of in runs:
            s = starts[good[at: at + len(starts)]]
            t = of[good[at: at + len(starts)]] - first
            at += len(starts)
            lo = np.maximum(s - MODULUS + 1, offsets[t])
            hi = np.minimum(s, offsets[t + 1] - WIDTH)
            ok = hi >= lo
            edge = np.bincount(lo[ok], minlength=len(raw) + 2) - np.bincount(hi[ok] + 1, minlength=len(raw) + 2)
            begin = np.flatnonzero(np.cumsum(edge)[: len(raw)] > 0)
            out.append(string_keys(raw, begin, WIDTH))
            spans.append((first, raw, offsets, begin))
        return np.concatenate(out), spans

    def cut(self, plan: dict) -> pa.Table:
        """The result rows of the block."""
        keys, runs = self.suffixes(plan)
        found, where = np.unique(keys, return_inverse=True)
        earlier = self.answers(1, found, 64, plan["suffix_buckets"])
        rank = np.concatenate([np.zeros(0, np.int64), *[
            self.rank[first + np.searchsorted(offsets, begin, side="right") - 1] for first, _, offsets, begin in runs]])
        least = np.empty(len(found), np.int64)
        least[where[::-1]] = rank[::-1]                        # ranks ascend, so the first of a key is its least
        gone = earlier[where] | (rank > least[where])
        n = self.docs.num_rows
        size = pc.binary_length(self.docs.column("text").cast(pa.large_binary())).to_numpy().astype(np.int64)
        removed, spans = np.where(self.copy, size, 0), self.copy.astype(np.int64)
        digests = [hashlib.sha256(b"").hexdigest()] * n
        at = 0
        for first, raw, offsets, begin in runs:
            b = begin[gone[at: at + len(begin)]]
            at += len(begin)
            edge = np.zeros(len(raw) + 2, np.int32)
            edge[b] += 1                                       # places are different
            edge[b + WIDTH] -= 1
            out = np.cumsum(edge)[: len(raw)] > 0
            for k in range(len(offsets) - 1):
                mask, text = out[offsets[k]: offsets[k + 1]], raw[offsets[k]: offsets[k + 1]]
                row = self.order[first + k]
                if mask.any():
                    removed[row] = mask.sum()
                    spans[row] = np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1)
                    text = text[~mask]
                digests[row] = hashlib.sha256(text.tobytes()).hexdigest()
        return pa.table({"doc_id": self.docs.column("doc_id"), "n_bytes": size, "n_removed": removed,
                         "n_spans": spans, "kept_sha256": digests})


def _packed(block: int, keys: np.ndarray, bits: int, buckets: int) -> pa.Table:
    keys = np.sort(keys)                                       # faster than np.unique, which hashes first
    bucket, width, steps = pack(keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys, bits, buckets)
    n = len(bucket)
    return pa.table({"bucket": bucket.astype(np.int32), "block": np.full(n, block, np.int32),
                     "width": np.full(n, width, np.int32), "steps": steps})


def _meet(step: int, smaller: bool):
    """One bucket's keys of all blocks -> for each block one bit a key: does another
    (``smaller``: a smaller) block have it?"""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        lists = [unpack(s, w) for s, w in zip(rows.column("steps").to_pylist(), rows.column("width").to_pylist())]
        keys = np.concatenate(lists)
        order = np.argsort(keys, kind="stable")               # ties stay in the order of blocks
        first = np.ones(len(keys), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        bit = np.empty(len(keys), bool)
        if smaller:
            bit[order] = ~first
        else:
            bit[order] = ~first | np.append(~first[1:], False)
        ends = np.cumsum([0, *map(len, lists)])
        return pa.table({"block": rows.column("block"), "step": pa.array([step] * len(lists), pa.int32()),
                         "bucket": rows.column("bucket"),
                         "bits": pa.array([np.packbits(bit[a:b]).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})
    return run


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row.

    Null and empty texts have no bytes; texts under ``WIDTH`` bytes lose none.
    Rows with one doc_id take nothing from each other.  A null doc_id is
    smaller than none and greater than none: such a row stays whole and takes
    nothing.  The result is a written table."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    known, lost = rows.where("doc_id is not null"), rows.where("doc_id is null")
    total = known.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    n = max(1, -(-total // block_bytes))
    files = min(n, BLOCK_FILES)
    block_of = range_udf(range_cuts(known, n, F.octet_length("text")))
    keyed = known.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("block", block_of("doc_id"))
    # exact copies: narrow columns only
    narrow = keyed.where(F.octet_length("text") >= WIDTH).select("block", "doc_id", "row_key", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(narrow.join(first, "digest").where("doc_id > first").groupBy("block").agg(
        F.collect_list("row_key").alias("copies")), "copies")

    name = f"suffix_blocks_{uuid.uuid4().hex}"
    (keyed.select("block", "doc_id", "row_key", "text").repartition(files, "block").write.bucketBy(files, "block")
     .option("path", scratch_path(spark, "suffix-blocks")).option("compression", "zstd").saveAsTable(name))
    try:
        samples = total * len(COVER) // MODULUS + 1
        # a sample key has 9 bits more than it takes to number the samples: about one in 500 ties by chance
        plan = {"sample_bits": min(64, max(20, samples.bit_length() + 9)),
                "sample_buckets": _power_of_two(samples / bucket_keys, 4), "suffix_buckets": _power_of_two(total / 4 / bucket_keys, 16)}
        note = lambda df, **cols: df.select("block", *[                                         # noqa: E731
            cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in
            (("step", "int"), ("bucket", "int"), ("bits", "binary"), ("copies", "array<bigint>"))])
        said = note(copies, copies=F.col("copies"))

        def on_blocks(step, notes: DataFrame, schema: str) -> DataFrame:
            return spark.table(name).groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(step, schema)

        def samples_of(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _packed(0, np.zeros(0, np.uint64), 20, 1)
            return _packed(left.column("block")[0].as_py(), Block(left, right).samples(plan["sample_bits"])[0],
                           plan["sample_bits"], plan["sample_buckets"])

        def suffixes_of(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _packed(0, np.zeros(0, np.uint64), 64, 1)
            return _packed(left.column("block")[0].as_py(), Block(left, right).suffixes(plan)[0], 64, plan["suffix_buckets"])

        def cut_of(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                                  ("n_spans", pa.int64()), ("kept_sha256", pa.string())]).empty_table()
            return Block(left, right).cut(plan)

        met = "block int, step int, bucket int, bits binary"
        for step, make, smaller in ((0, samples_of, False), (1, suffixes_of, True)):
            bits = materialize(on_blocks(make, said, PACKED).groupBy("bucket").applyInArrow(_meet(step, smaller), met),
                               "ties")
            said = said.union(note(bits, step=F.col("step"), bucket=F.col("bucket"), bits=F.col("bits")))
        result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        done = on_blocks(cut_of, said, result)
        zero = F.lit(0).cast("bigint")
        whole = lost.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"),
                            zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
        return materialize(done.unionByName(whole), "repeats-removed")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _power_of_two(x: float, least: int) -> int:
    return 1 << max(least.bit_length() - 1, math.ceil(math.log2(max(x, 1))))
