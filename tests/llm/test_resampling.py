import hashlib
import math
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.llm import resampling as R

from .cases import ODD, empty, odd

SF = "/root/testdata/sf0.001"
PLAIN_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _plain_features(text, n):
    words = PLAIN_WORD.findall(_lower(text))
    return len(words), [" ".join(words[i: i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, n=1, buckets=10_000, seed=2024, percent=10, least_words=20):
    """(doc_id, n_features, weight, score, rank) of each document, one feature at a time."""
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in _plain_features(x, n)[1]:
                counts[_bucket(f, buckets)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        n_words, fs = _plain_features(x, n)
        weight = math.floor(Fraction(sum(gain[_bucket(f, buckets)] for f in fs), len(fs))) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(fs), weight, weight + noise, None, n_words])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_plain_code(spark):
    from concord.llm.queries import QUERIES
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = _rows(QUERIES["op11_batch_importance_resampling"](spark, SF))
    assert got == plain(docs, target)
    assert sum(r[4] is not None for r in got) >= 10


@pytest.mark.parametrize("n, block", [(1, 3), (2, 3), (3, 5), (3, 1 << 17)])
def test_features_stay_within_texts(n, block):
    texts = ["One two THREE four five six seven", None, "", "eight", "É x\x00y z_9", "a b c d e f g h i j k l m"]
    got = {i: [] for i in range(len(texts))}
    for of, bucket, _ in R.features(pa.array(texts), n, 1 << 32, block):
        for i, b in zip(of.tolist(), bucket.tolist()):
            got[i].append(b)
    for i, x in enumerate(texts):
        assert sorted(got[i]) == sorted(_bucket(f, 1 << 32) for f in _plain_features(x, n)[1])


def _table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_longer_runs_and_ties(spark):
    docs = [(i, f"alpha beta w{i % 7} gamma delta w{i % 3} epsilon") for i in range(60)] + [(5, "alpha beta"), (5, "alpha beta")]
    target = ["alpha beta gamma", "delta w1 epsilon"]
    model = R.fit(_table(spark, docs), _table(spark, [(0, x) for x in target]), n=3, buckets=97, seed=7)
    got = R.draw(_table(spark, docs).repartition(5), model, percent=35, least_words=2)
    assert _rows(got) == plain(docs, target, 3, 97, 7, 35, 2)


def test_equal_ids_are_cut_into_several_ranges(spark):
    """A third of the rows share one id (and so one score): each has a rank of its own."""
    docs = [(7, "same words here")] * 400 + [(i, "other words") for i in range(100, 900)]
    model = R.fit(_table(spark, docs), _table(spark, [(0, "words")]))
    got = R.draw(_table(spark, docs), model, percent=100, least_words=1).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1201))
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in ordered] == sorted((-r["score"], r["doc_id"]) for r in got)


def test_odd_rows(spark):
    target = _table(spark, [(0, "word words"), (1, None), (2, "")])
    docs = odd(spark)
    model = R.fit(docs, target)
    assert _rows(R.draw(docs, model, 50, 2)) == plain(ODD, ["word words", None, ""], percent=50, least_words=2)
    kept = R.draw(docs.withColumnRenamed("n", "m"), model, 50, 2, keep=("doc_id", "text", "part"))
    assert {r["part"] for r in kept.collect()} == {"x"} and "text" in kept.columns
    with pytest.raises(ValueError, match="score"):
        R.draw(docs, model, keep=("doc_id", "score"))
    assert R.draw(empty(spark), model).collect() == []
    assert not R.fit(empty(spark), empty(spark)).gains.any()
    scored = R.score(docs.withColumn("importance", F.lit(1)), model)
    assert all(r["importance"]["weight"] == 0 for r in scored.collect() if not r["text"])


def test_very_long_text(spark):
    text = "Abc dé 12 " * 400_000
    docs = [(1, text), (2, "abc")]
    model = R.fit(_table(spark, docs), _table(spark, [(0, "abc")]))
    r = {r["doc_id"]: r["importance"] for r in R.score(_table(spark, docs), model).collect()}
    assert r[1]["n_features"] == r[1]["n_words"] == 1_200_000 and r[2]["n_features"] == 1
