import random

import numpy as np
import pytest
import xxhash

from concord.llm import simhash as S
from concord.llm.components import connected_components

from .cases import ODD, empty, odd


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return sorted(tuple(sorted(g)) for g in out.values())


def _near(rng, n):
    fps = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    return fps


@pytest.mark.parametrize("options", [dict(bands=4), dict(bands=4, small=2, tile=5), dict(bands=2, levels=2)])
def test_links_equal_brute_force(spark, options):
    signed = [f - (1 << 64) if f >> 63 else f for f in _near(random.Random(2), 12)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {}
    for r in connected_components(S.links(df, 3, **options)).collect():
        got.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    want = [g for g in plain_groups([f % (1 << 64) for f in signed]) if len(g) > 1]
    assert sorted(tuple(sorted(g)) for g in got.values()) == want


@pytest.mark.parametrize("bands", [4, 8])
def test_crowded_shards_are_cut_again(spark, bands):
    """All fingerprints agree in a band: shards of the second level find the same links with fewer comparisons."""
    rng = random.Random(5)
    low = rng.getrandbits(64 // bands)
    fps = {f >> (64 // bands) << (64 // bands) | low for f in _near(rng, 60)} | _near(rng, 5)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {}
    for r in connected_components(S.links(df, 3, bands=bands, small=4, tile=16)).collect():
        got.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    assert sorted(tuple(sorted(g)) for g in got.values()) == [g for g in plain_groups(list(fps)) if len(g) > 1]
    shard = df.selectExpr("fp", "0 as tree", "7L as leaf").select("fp", S.deeper_shards(bands, 12, 3).alias("s")).collect()
    leaves = {r["fp"]: {(x["tree"], x["leaf"]) for x in r["s"]} for r in shard}
    pairs = [(a, b) for a in signed for b in signed if a < b and (a ^ b) % (1 << 64 // bands) == 0]
    met = [p for p in pairs if leaves[p[0]] & leaves[p[1]]]
    assert {p for p in pairs if ((p[0] ^ p[1]) % (1 << 64)).bit_count() <= 3} <= set(met) and len(met) < len(pairs) / 10


def _plain(docs):
    fps = {f: None for f in (plain_fingerprint(t) for _, t in docs)}
    least = {}
    for g in plain_groups(list(fps)):
        ids = [d for d, t in docs if plain_fingerprint(t) in g and d is not None]
        least |= {f: min(ids, default=None) for f in g}
    return sorted((repr(d), plain_fingerprint(t), repr(least[plain_fingerprint(t)])) for d, t in docs)


def test_documents_equal_plain_code(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["Red", "blue", "GREEN", "old", "new"]) + str(rng.randrange(50)) for _ in range(80)) for _ in range(6)]
    docs = [(i, t + " extra" * (i % 3)) for i, t in enumerate(base * 3)] + ODD
    got = S.simhash_groups(odd(spark, docs[: len(docs) - len(ODD)])).collect()
    assert sorted((repr(r["doc_id"]), r["fp"] % (1 << 64), repr(r["component_id"])) for r in got) == _plain(docs)


def test_keep_first_keeps_one_of_each_group(spark):
    df = odd(spark)
    kept = S.keep_first(df)
    groups = {g for _, _, g in ((d, t, plain_fingerprint(t)) for d, t in ODD)}
    assert kept.columns == df.columns
    assert kept.count() == len(plain_groups(list(groups)))
    assert S.keep_first(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(61)} | {(100 + i, 100) for i in range(40)}


def test_fingerprint_zero_for_no_words():
    import pyarrow as pa

    assert np.all(np.array(S.fingerprints(pa.array([None, "", " \n"]), 3)) == 0)
