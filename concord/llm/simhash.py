"""SimHash near-duplicates, found with a forest of vantage-point trees.

Fingerprint: every shingle's XXH64 votes on 64 bits; a bit is 1 if more than
half the shingles set it.  Two fingerprints are linked if at most ``RADIUS``
bits differ.

The 64 bits are cut into ``bands`` equal bands.  The Hamming distance of one
band is a metric too, and of two fingerprints within r bits at least one band
differs in r // bands bits at most.  So one vantage-point tree a band is
enough, searched with that smaller radius rho: a node holds a vantage point and
has one child for every distance to it.  By the triangle inequality a
neighbour's distance to the vantage point differs by rho at most, so all other
children are pruned.  A fingerprint is stored in the shard (leaf) of its own
distances and asks the shards whose distances lie within rho: only its own for
rho = 0, the boundary-overlapping ones too for rho > 0.  Inside a shard pairs
are compared on all 64 bits, so the links are exact for any choice of bands.

A band of 16 bits has 65,536 values, so its shards grow with the corpus.  A
shard over ``tile`` rows is cut by a second forest over the bits outside its
band, again in one part more than the radius has bits: of two neighbours one
part is equal.  Shards of both levels stand for 28 bits, so 2^28 times as many
fingerprints as a tile holds are met in tiles.

Work is on distinct fingerprints: a group of equal ones, however large, is one
row.  Small shards are joined on the shard key; larger ones are cut into blocks
of ``tile`` rows, and a task compares two blocks with numpy and returns a
spanning forest of their links, at most one edge for each row: neither all pairs nor
a whole shard ever meet in one place.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_udf
from concord.llm.components import connected_components
from concord.session import materialize

RADIUS = 3
SEED = 42


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 of the ``width``-word shingles of a lower-cased text, repeats included."""
    words = raw.lower().split()        # bytes: A-Z only, splits at space and 0x09-0x0D
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    line = b" ".join(words)
    return [xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())]


def fingerprints(texts: pa.Array, width: int) -> pa.Array:
    """Fingerprint of each text as bigint (its unsigned bits); no word: 0."""
    hashes = [shingle_hashes((t or "").encode("utf-8", "surrogatepass"), width) for t in texts.to_pylist()]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.array([x for one in hashes for x in one], dtype="<u8")
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return pa.array(out.view(np.int64))


def _vantage_points(levels: int, bits: int, seed: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(0, 1 << bits, levels)]


def _path(at: Column, distance: Column) -> Column:
    """Name of a node's child.  Names of deep leaves may clash, which only makes two leaves share a shard."""
    return (at * 67 + distance + 1) % 8796093022151


def shards(fp: Column, bands: int, levels: int, radius: int, probes: bool) -> Column:
    """array<struct(tree, leaf)>: the leaf that stores ``fp`` in each tree, or with
    ``probes`` every leaf that can hold a neighbour (a superset of the former)."""
    bits = 64 // bands
    rho = radius // bands
    trees = []
    for t in range(bands):
        band = F.shiftrightunsigned(fp, t * bits).bitwiseAND(F.lit((1 << bits) - 1)) if bands > 1 else fp
        leaves = F.array(F.lit(0).cast("bigint"))
        for v in _vantage_points(levels, min(bits, 62), 64 + t):
            d = F.bit_count(band.bitwiseXOR(F.lit(v))).cast("bigint")
            child = F.array(*[d + k for k in range(-rho, rho + 1)]) if probes else F.array(d)
            leaves = F.flatten(F.transform(child, lambda c: F.transform(leaves, lambda at: _path(at, c)))) \
                if rho and probes else F.array(_path(leaves[0], d))
        tree = F.lit(t).alias("tree")
        trees.append(F.transform(leaves, lambda x: F.struct(tree, x.alias("leaf"))))
    return F.concat(*trees)


def deeper_shards(bands: int, levels: int, radius: int) -> Column:
    """array<struct(tree, leaf)>: the leaves of the second level that store ``fp`` of shard (``tree``, ``leaf``)."""
    width, parts = 64 // bands, radius + 1
    turn = f"cast({width} * (tree + 1) as int)"                   # the shard's own band comes to the top
    rest = F.expr(f"shiftrightunsigned(fp, {turn}) | shiftleft(fp, 64 - {turn})")
    cuts = [(64 - width) * k // parts for k in range(parts + 1)]
    trees = []
    for u, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = F.shiftrightunsigned(rest, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        leaf = F.col("leaf")
        for v in _vantage_points(levels, hi - lo, 128 + u):
            leaf = _path(leaf, F.bit_count(part.bitwiseXOR(F.lit(v))).cast("bigint"))
        trees.append(F.struct(((F.col("tree") + 1) * 64 + u).cast("int").alias("tree"), leaf.alias("leaf")))
    return F.array(*trees)


def _forest(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links between a tile's asking and stored rows, thinned to a spanning forest."""
    fp = pdf["fp"].to_numpy(np.int64)
    ask, kept = np.unique(fp[pdf["side"].to_numpy() == 0]), np.unique(fp[pdf["side"].to_numpy() == 1])
    nodes = np.union1d(ask, kept)
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    at = np.searchsorted(nodes, kept)
    a, b = [], []
    for x, i in zip(ask, np.searchsorted(nodes, ask).tolist()):
        near = np.flatnonzero(np.bitwise_count((kept ^ x).view(np.uint64)) <= radius)
        r = find(i)
        for j in at[near].tolist():
            s = find(j)
            if s != r:
                root[s] = r
                a.append(nodes[i])
                b.append(nodes[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _counted(rows: DataFrame, asking: DataFrame) -> DataFrame:
    """``rows`` of the shards that two or more rows ask, with their number."""
    sizes = asking.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes, ["tree", "leaf"])


def links(fps: DataFrame, radius: int = RADIUS, bands: int = 4, levels: int = 12, small: int = 64,
          tile: int = 4096) -> DataFrame:
    """fps(fp bigint, distinct) -> links(a, b): connects exactly the fingerprints
    that chains of ``radius`` bits or fewer connect."""
    if not 1 <= bands <= 64 or 64 % bands:
        raise ValueError("bands must divide 64")
    stored = fps.select("fp", F.explode(shards(F.col("fp"), bands, levels, radius, False)).alias("s")) \
        .select("fp", "s.tree", "s.leaf")
    if radius < bands:                     # asking and stored rows are the same
        met = materialize(_counted(stored, stored), "shards")
        deep = met.where(F.col("n") > tile).select("fp", F.explode(deeper_shards(bands, levels, radius)).alias("s")) \
            .select("fp", "s.tree", "s.leaf")
        asking = stored = met.where(F.col("n") <= tile).unionByName(materialize(_counted(deep, deep), "deeper-shards"))
    else:
        probes = fps.select("fp", F.explode(shards(F.col("fp"), bands, levels, radius, True)).alias("s")).select(
            "fp", "s.tree", "s.leaf")
        asking, stored = _counted(probes, probes), _counted(stored, probes)

    left = asking.where(F.col("n") <= small).select("tree", "leaf", F.col("fp").alias("a"))
    right = stored.where(F.col("n") <= small).select("tree", "leaf", F.col("fp").alias("b"))
    once = F.col("a") < F.col("b") if radius < bands else F.col("a") != F.col("b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["tree", "leaf"]).where(close & once).select("a", "b")

    def blocks(rows: DataFrame, side: int) -> DataFrame:
        cut = rows.where(F.col("n") > small).withColumn(
            "blocks", F.ceil(F.col("n") / F.lit(tile)).cast("int")).withColumn(
            "own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        ij = (F.col("own").alias("i"), other.alias("j")) if side == 0 else (other.alias("i"), F.col("own").alias("j"))
        return cut.select("tree", "leaf", "fp", F.lit(side).alias("side"), *ij)

    tiles = blocks(asking, 0).union(blocks(stored, 1))
    if radius < bands:                     # half the tiles suffice
        tiles = tiles.where("i <= j")
    forest = tiles.groupBy("tree", "leaf", "i", "j").applyInPandas(partial(_forest, radius=radius), "a long, b long")
    return pairs.union(forest)


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = RADIUS, bands: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row_key, fp bigint, component bigint, component_id).

    ``component`` is the smallest fingerprint reachable over links,
    ``component_id`` the smallest doc_id reachable, itself included.  Null and
    empty texts and texts of white space have fingerprint 0 and are linked like
    any other; repeated rows stay; rows with a null doc_id stay and take their
    group's smallest id (null if it has none).  ``row_key`` tells rows with one
    doc_id and different texts apart."""
    fp = text_udf(partial(fingerprints, width=width), "bigint")
    own = materialize(docs.select("doc_id", _row_key().alias("row_key"), fp("text").alias("fp")), "fingerprints")
    groups = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    of = connected_components(links(groups.select("fp"), radius, bands)).withColumnRenamed("node", "fp")
    named = groups.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(first, "component").select("fp", "component", "component_id")
    return own.join(labels, "fp").select("doc_id", "row_key", "fp", "component", "component_id")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: its smallest doc_id (a null one only if
    the group has no other), of rows with that id the smallest row key, of equal rows any."""
    groups = simhash_groups(docs.select("doc_id", "text"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = groups.groupBy("component").agg(F.min(rank).alias("r")).select(
        F.col("r.row_key").alias("__row"), F.col("r.doc_id").alias("__doc"))
    keyed = docs.withColumn("__row", _row_key())
    met = keyed.join(kept, "__row").where(F.col("doc_id").eqNullSafe(F.col("__doc"))).drop("__doc")
    return met.dropDuplicates(["__row", "doc_id"]).drop("__row")
