import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import minhash as S

from .cases import ODD, empty, odd


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            holders[x].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        u = len(sets[a] | sets[b])
        if not u or len(sets[a] & sets[b]) / u >= 0.8:
            root[find(b)] = find(a)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(repr((d, min(least[find(i)], default=None))) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").collect()]
    near = [(1000 + k, rows[7][1] + " tail" * k) for k in range(1, 30)]
    return rows + near + [(2000, rows[9][1])] + ODD


def test_edited_texts_and_neighbours(spark, sample):
    df = spark.createDataFrame(sample, "doc_id long, text string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    key = {(r["doc_id"], r["text"]): r["row_key"] for r in df.collect()}
    order = sorted([(d, t or "") for d, t in sample], key=lambda r: (0 if r[0] is None else -r[0] - 1, key[r]) if r[0] is not None else (1, key[r]))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 2
        want.append(repr((d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest())))
    for size in (1 << 24, 60_000):
        got = S.fingerprint_rows(df.repartition(3), None, size).collect()
        assert sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got) == sorted(want)


def test_signatures_estimate_jaccard():
    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" for i in range(200, 2200))
    x = S.signatures(*S.shingles([a, b, a, ""]))
    assert abs(S.likeness(x[:1], x[1:2])[0] - 0.818) < 0.15
    assert (x[0] == x[2]).all() and (x[3] == 0xFFFF).all()
    assert abs(len(plain_shingles(a)) - len(np.unique(S.shingles([a])[0]))) <= 1


def test_classes_equal_exact_jaccard(spark, sample):
    rows = S.fingerprint_documents(odd(spark, sample[: len(sample) - len(ODD)])).collect()
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in rows) == plain_classes([(d, t or "") for d, t in sample])
    by_text = defaultdict(set)
    text = defaultdict(list)
    for d, t in sample:
        text[d].append(t or "")
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(set(text[r["doc_id"]])) == 1:
            by_text[text[r["doc_id"]][0]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_members_the_leader_rejects_are_compared(spark):
    """Leader 1 is like 2 and 3 only at 0.7, but 2 and 3 are alike: the tile step links them."""
    sets = {1: range(0, 100), 2: range(18, 118), 3: range(20, 120)}
    rows = [(n, np.array(list(s), "<u4").tobytes()) for n, s in sets.items()]
    table = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "node long, shingle_set binary")
    members = spark.createDataFrame([(7, 1, 3, n) for n in sets], "bucket long, leader long, n long, node long")
    got = {(r["node"], r["component"]) for r in S.near_classes(members, table).collect()}
    assert got == {(2, 2), (3, 2)}


def test_empty_table(spark):
    assert S.fingerprint_documents(empty(spark)).count() == 0
