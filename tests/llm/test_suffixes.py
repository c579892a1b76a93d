import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import suffixes as S
from concord.llm.common import range_cuts

from .cases import ODD, SCHEMA, empty, odd


def plain(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            k = b[i:i + 50]
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i, y in enumerate(gone) if y and (i == 0 or not gone[i - 1]))
        out.append(repr((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def got(df, **options):
    return sorted(repr(tuple(r)) for r in S.remove_repeats(df, **options).collect())


@pytest.mark.parametrize("block_bytes", [1 << 24, 40_000])
def test_equals_brute_force(spark, block_bytes):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    rows += [(1000 + k, "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + passage[k % 30: 50 + k] + "q" * k) for k in range(40)]
    rows += [(2000, rows[3][1]), (2000, rows[4][1]), (None, rows[5][1]), (2001, passage * 4), (2002, passage * 5)]
    assert got(spark.createDataFrame(rows, SCHEMA), block_bytes=block_bytes, bucket_keys=5000) == plain(rows)


def test_odd_rows_and_empty_table(spark):
    extra = [(9, "word " * 20), (8, "word " * 11)]
    assert got(odd(spark, extra)) == plain([*ODD, *extra])
    assert S.remove_repeats(empty(spark)).collect() == []
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("suffix_blocks") for t in spark.catalog.listTables())


def test_the_cover_meets_every_pair_of_residues():
    pairs = {(a - b) % S.MODULUS for a in S.COVER for b in S.COVER}
    assert pairs == set(range(S.MODULUS))


@pytest.mark.parametrize("bits, buckets", [(30, 8), (64, 1), (64, 1 << 14), (20, 1)])
def test_packed_keys_come_back(bits, buckets):
    keys = np.unique(np.random.default_rng(1).integers(0, (1 << bits) - 1, 5000, dtype=np.uint64))
    found, width, steps = S.pack(keys, bits, buckets)
    inner = bits - (buckets.bit_length() - 1)
    back = [S.unpack(x, width) + (np.uint64(b << inner) if inner < 64 else np.uint64(0))
            for b, x in zip(found.tolist(), steps.to_pylist())]
    assert (np.concatenate(back) == keys).all()
    assert len(S.pack(keys[:0], bits, buckets)[0]) == 0


def test_a_block_sends_as_much_whatever_the_corpus_holds():
    """Plans of about 0.5, 30 and 1600 GB: what a block of 200,000 samples packs stays under 5 bytes a key."""
    for total in (5e8, 3e10, 1.6e12):
        samples = int(total * len(S.COVER) / S.MODULUS)
        bits, buckets = samples.bit_length() + 9, S._power_of_two(samples / S.BUCKET_KEYS, 4)
        keys = np.unique(np.random.default_rng(2).integers(0, 1 << bits, 200_000, dtype=np.uint64))
        found, width, steps = S.pack(keys, bits, buckets)
        assert steps.nbytes <= 5 * len(keys) + 4 * (len(found) + 1)


def test_blocks_are_cut_by_bytes(spark):
    """One document in a hundred is long: cut by rows, the block with it would hold nearly all bytes."""
    rows = [(d, "x" * (400_000 if d % 100 == 0 else 100)) for d in range(1000)]
    rows += [(d, "x" * 1000) for d in range(1000, 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    cuts = range_cuts(df, 16, F.octet_length("text"))
    size = np.bincount(np.searchsorted(cuts, [d for d, _ in rows]), weights=[len(t) for _, t in rows])
    assert size.max() <= 2 * 400_000 + size.sum() / 16
