import math
import random

import numpy as np

from pyspark.sql import functions as F

from concord.llm import langid
from concord.llm.common import held_out

from .cases import ODD, empty, odd

SF = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"), per_language=60)
    got = langid.predict(docs, model).where(held_out()).select("lang", "language.*").collect()
    assert len(got) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert sum(r["rejected"] for r in got) <= 1


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs, 20), langid.fit(wrong, 20)
    assert a.languages == b.languages and (a.centroids == b.centroids).all()


def test_rejects_other_scripts_and_noise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, 60)
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("qxzkwjv") for _ in range(9)) for _ in range(60))
    names, score, no = model.predict(["", "12 34", "Съешь же ещё этих мягких французских булок да выпей чаю " * 3, noise])
    assert no.tolist() == [True, True, True, True]
    assert names[:2] == ["und", "und"] and score[0] == 0


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark, [(10 + i, "the cat sat on the mat and looked") for i in range(5)]).withColumn("lang", F.lit("en"))
    model = langid.fit(docs)
    rows = langid.predict(docs, model).select("doc_id", "text", "language.*", "score").toDF(
        "doc_id", "text", "pred", "cosine", "rejected", "score").collect()
    assert len(rows) == len(ODD) + 5 and all(r["score"] == "x" for r in rows)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["pred"] == "und" and r["rejected"] and r["cosine"] == 0
        assert 0 <= r["cosine"] <= 1
    none = langid.fit(empty(spark).withColumn("lang", F.lit("en")))
    assert langid.predict(docs, none).where("not language.rejected").count() == 0
    assert langid.predict(empty(spark), model).count() == 0


def _plain_counts(text):
    """N-grams by slicing words, hashed one at a time with Python integers."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    mask, mix = (1 << 64) - 1, [int(m) for m in langid._MIX]
    out = {}
    padded = " " + " ".join(letters.split()) + " "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i: i + n]
            if (n == 1 and gram == " ") or (n == 2 and gram.strip() == "") or (n == 3 and gram[1] == " "):
                continue
            h = n
            for k, c in enumerate(gram):
                h = ((h ^ (((ord(c) if c != " " else 0) * mix[k]) & mask)) * mix[0]) & mask
            slot = h >> (64 - langid.DIMS.bit_length() + 1)
            out[slot] = out.get(slot, 0) + 1
    return out


def test_scores_equal_plain_tf_idf_and_cosine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, 30)
    learned = langid.learnable(docs).collect()
    frequency = [0] * langid.DIMS
    for r in learned:
        for slot in _plain_counts(r["text"]):
            frequency[slot] += 1
    idf = [math.log((1 + len(learned)) / (1 + f)) + 1 for f in frequency]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    for r in langid.predict(docs.orderBy(F.xxhash64("doc_id")).limit(40), model).select("text", "language.*").collect():
        v = {s: math.log1p(n) * idf[s] for s, n in _plain_counts(r["text"] or "").items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best = max((sum(x * float(c[s]) for s, x in v.items()) / norm, name) for c, name in zip(model.centroids, model.languages))
        assert abs(best[0] - r["score"]) < 1e-4 and best[1] == r["lang_pred"]


def test_every_centroid_holds_a_share_of_the_rows():
    rng = np.random.default_rng(0)
    axes = np.eye(20)
    near = np.concatenate([axes[g] + 0.1 * rng.random((60, 20)) for g in range(3)])
    v = np.concatenate([near, axes[10:14]]).astype(np.float32)           # four rows far from all others
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centers = langid._sphere_means(v, 3, rng)
    held = np.bincount((v @ centers.T).argmax(axis=1), minlength=3)
    assert len(centers) == 3 and held.min() >= 60
    assert sorted(centers.argmax(axis=1).tolist()) == [0, 1, 2]
    assert len(langid._sphere_means(v[:1], 3, rng)) == 1
    assert len(langid._sphere_means(np.repeat(v[:1], 9, axis=0), 3, rng)) == 1


def test_model_comes_from_all_rows(spark):
    """Centroids are the means of all training texts of a language, not of those that the k-means starts from."""
    docs = spark.createDataFrame([(i, text, "en") for i, text in enumerate(
        f"the cat number {'abcdefghij'[i % 10] * (1 + i // 10)} sat on the mat" for i in range(120))], "doc_id long, text string, lang string")
    learned = [r["text"] for r in langid.learnable(docs).collect()]
    model = langid.fit(docs, per_language=5, clusters=1)
    mean = model.vectors(langid.ngram_counts(learned)[0]).astype(float).sum(axis=0)
    assert np.allclose(model.centroids[0], mean / np.linalg.norm(mean), atol=1e-5)
    again = langid.fit(docs.repartition(7), per_language=5, clusters=1)
    assert np.allclose(model.centroids, again.centroids, atol=1e-6) and np.allclose(model.thresholds, again.thresholds, atol=2 / langid.COSINE_STEPS)
    amount, cosine = langid.cut_cosines(model, learned, np.array(["en"] * len(learned)))
    assert len(model.thresholds) == amount.max() + 1
    for a in range(len(model.thresholds)):
        assert model.thresholds[a] <= max(0.5 * cosine[amount == b].min() for b in set(amount.tolist()) if b <= a) + 1e-9


def test_halving_keeps_about_half():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 200, 20_000)
    left = langid._halved(n, rng.integers(0, 1 << 64, len(n), dtype=np.uint64))
    assert (left <= n).all() and (left >= 0).all() and abs(left.sum() / n.sum() - 0.5) < 0.01


def test_slots_of_a_small_alphabet_are_hashed_once(monkeypatch):
    texts = ["Der schnelle braune Fuchs springt über den faulen Hund, 12 mal. " * 20, "", "a", "the cat\0sat on\nthe mat " * 30] * 20
    hashed, real = [], langid._slots
    monkeypatch.setattr(langid, "_alphabet", None)
    monkeypatch.setattr(langid, "_slots", lambda grams: hashed.append(len(grams)) or real(grams))
    counts, total = langid.ngram_counts(texts)
    assert hashed == [1, 2, 3]                                   # 80 texts in three groups
    again, _ = langid.ngram_counts(texts[:3] + ["日本語 и русский " * 3])     # letters that are new join the alphabet
    assert hashed == [1, 2, 3] * 2 and (again[:3] == counts[:3]).all()
    monkeypatch.setattr(langid, "MOST_LETTERS", 5)
    monkeypatch.setattr(langid, "_alphabet", None)
    plain, plain_total = langid.ngram_counts(texts)
    assert (plain == counts).all() and (plain_total == total).all()
    for text, row in zip(texts[:4], counts):
        assert {s: n for s, n in enumerate(row.tolist()) if n} == _plain_counts(text)
