import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import toxicity as S
from concord.llm.common import held_out

from .cases import ODD, empty, odd

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def counts():
    words = ["pathetic", "trash", "stupid", "moron", "worthless", "the", "action", "thing", "is", "an", "other"] * 40
    return S.count_trigrams([" ".join(words)])


@pytest.mark.parametrize("seen,meant", [("p4th3t1c", "pathetic"), ("tr4sh", "trash"), ("t.r.a.s.h", "trash"), ("t r a s h", "trash"),
                                        ("traaaash", "trash"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("w0rthl3ss", "worthless"),
                                        ("t-r-a-s-h!!", "trash"), ("Thing", "thing"), ("other,", "other")])
def test_restores_disguised_words(counts, seen, meant):
    assert S.restore_text(f"the {seen} is", S.Decoder(counts)) == f"the {meant} is"


@pytest.fixture(scope="module")
def more_counts():
    words = ["idiot", "rash", "loser", "clown", "asshole", "ass", "moron", "trash", "shit", "the", "is", "an", "other", "all"] * 40
    return S.count_trigrams([" ".join(words)])


@pytest.mark.parametrize("seen,meant", [
    ("idi0+", "idiot"), ("a$$", "ass"), ("!diot", "idiot"), ("+rash", "trash"), ("|oser", "loser"), ("<lown", "clown"),
    ("@$$hole", "asshole"), ("455", "ass"), ("@$$", "ass"), ("i d 1 o t", "idiot"), ("t  r  a  s  h", "trash"),
    ("l 0 s e r", "loser"), ("t r a s h !", "trash"), ("morron", "moron"), ("idiot!!", "idiot"), ("idiot###", "idiot"),
    ("the&&&", "the"), ("other***", "other"), ("(other)", "other"), ("| | |", ""), ("|", ""), ("!!!", "")])
def test_restores_signs_at_edges_and_mixed_spacing(more_counts, seen, meant):
    got = S.restore_text(f"the {seen} is", S.Decoder(more_counts))
    assert got == " ".join(["the", *meant.split(), "is"])


def test_edges_are_read_exactly(more_counts):
    d, rng = S.Decoder(more_counts), random.Random(3)
    for _ in range(80):
        signs = lambda least: "".join(rng.choice("!$+%.|") for _ in range(rng.randrange(least, 4 - least)))
        token = signs(0)[:2] + rng.choice(["idi", "a", "the", "l0se", "rash"]) + signs(1)
        lo, hi = S._core(token)
        costs = []
        for combo in itertools.product(*[
                [(ch, 0.0)] if ch.isalpha() else [("", 1.0), (" ", 1.0)] if ch not in S.LEET else
                [(x, S.READ) for x in S.LEET[ch]] + [("", S.DROP), (" ", S.END)] for ch in token]):
            read = [i for i, (x, _) in enumerate(combo) if x.strip()]
            a = b = 0
            cost, text = 0.0, ""
            for i, (x, more) in enumerate(combo):
                cheap = token[i] in S.LEET and x != " " and ((i < lo and i < read[0]) or (i >= hi and i > read[-1]))
                cost += S.EDGE if cheap else more
                if x and not (x == " " and b == 0):
                    c = 0 if x == " " else ord(x)
                    cost, a, b, text = cost + d.cost(a, b, c), b, c, text + x
            costs.append((cost + (d.cost(a, b, 0) if b else 0.0), text.split()))
        best = min(c for c, _ in costs)
        assert d.restore(token, (lo, hi)) in [w for c, w in costs if c < best + 1e-6], token


def plain_best(decoder, token):
    """Cheapest reading over every combination of readings."""
    options = []
    for i, ch in enumerate(token):
        if ch.isalpha():
            o = [(ch, 0.0)]
            if i and token[i - 1] == ch:
                run = (i > 1 and token[i - 2] == ch) or (i + 1 < len(token) and token[i + 1] == ch)
                o.append(("", S.REPEAT if run else S.REPEAT_ONCE))
        elif ch in S.LEET:
            o = [(x, S.READ) for x in S.LEET[ch]] + [("", S.DROP), (" ", S.END)]
        else:
            o = [("", 1.0), (" ", 1.0)]
        options.append(o)
    best = math.inf
    for combo in itertools.product(*options):
        a = b = 0
        cost = 0.0
        for x, more in combo:
            cost += more
            if x and not (x == " " and b == 0):
                c = 0 if x == " " else ord(x)
                cost += decoder.cost(a, b, c)
                a, b = b, c
        best = min(best, cost + (decoder.cost(a, b, 0) if b else 0.0))
    return best


def test_viterbi_is_exact(counts):
    d, rng = S.Decoder(counts), random.Random(1)
    for _ in range(40):
        token = "".join(rng.choice("traaash014!.") for _ in range(rng.randrange(2, 7)))
        words = d.restore(token)
        # the reading Viterbi returns costs what the cheapest combination costs: rebuild its cost over all combinations
        line = " ".join(words)
        best = plain_best(d, token)
        costs = [c for c, text in _all(d, token) if text.split() == words]
        assert costs and min(costs) == pytest.approx(best), (token, line)


def _all(decoder, token):
    options = []
    for i, ch in enumerate(token):
        if ch.isalpha():
            o = [(ch, 0.0)]
            if i and token[i - 1] == ch:
                run = (i > 1 and token[i - 2] == ch) or (i + 1 < len(token) and token[i + 1] == ch)
                o.append(("", S.REPEAT if run else S.REPEAT_ONCE))
        elif ch in S.LEET:
            o = [(x, S.READ) for x in S.LEET[ch]] + [("", S.DROP), (" ", S.END)]
        else:
            o = [("", 1.0), (" ", 1.0)]
        options.append(o)
    for combo in itertools.product(*options):
        a = b = 0
        cost, text = 0.0, ""
        for x, more in combo:
            cost += more
            if x and not (x == " " and b == 0):
                c = 0 if x == " " else ord(x)
                cost += decoder.cost(a, b, c)
                a, b = b, c
                text += x
        yield cost + (decoder.cost(a, b, 0) if b else 0.0), text


def test_trigram_counts_cover_all_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    want = sum(S.count_trigrams([t]) for t in texts)
    got = S.trigram_counts(docs)
    # texts stand side by side in a piece: only what reaches over their border differs
    assert (got[0] >= 0).all() and abs(int(got[2].sum()) - int(want[2].sum())) <= 4 * len(texts)
    letters = sum(c.isalpha() for t in texts for c in t.lower())
    assert got[0].sum() >= letters


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = S.fit(docs, labels)
    rows = S.score(docs.join(labels, "doc_id").where(held_out()), model).select("toxic", "toxicity").collect()
    said = [(r["toxic"], r["toxicity"] >= S.THRESHOLD) for r in rows]
    caught = sum(t and p for t, p in said) / sum(t for t, _ in said)
    wrong = sum(p and not t for t, p in said) / sum(not t for t, _ in said)
    assert caught > 0.88 and wrong < 0.005


def test_odd_rows_labels_and_empty_tables(spark):
    toxic = [(k, "you are trash and a moron today " * 3) for k in range(100, 160)]
    clean = [(k, "you are kind and a friend today " * 3) for k in range(200, 320)]
    docs = odd(spark, toxic + clean)
    labels = spark.createDataFrame([(k, 1) for k, _ in toxic] + [(k, 0) for k, _ in clean]
                                   + [(100, 0), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = S.fit(docs, labels)
    rows = S.score(docs, model).select("doc_id", "text", "toxicity").collect()
    assert len(rows) == len(ODD) + 180 and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert all((r["toxicity"] >= 0.5) == ("trash" in (r["text"] or "")) for r in rows if (r["doc_id"] or 0) >= 100)
    nothing = S.fit(docs, labels.limit(0))
    assert nothing.lexicon == {} and S.score(docs, nothing).where(F.col("toxicity") >= 0.7).count() == 0
    assert S.score(empty(spark), model).count() == 0
    assert np.all(S.fit(empty(spark), labels).counts >= 0)


def test_lexicon_counts_equal_counts_by_word():
    """Tokens looked up with their words and entries against every restored word on its own."""
    counts = S.count_trigrams(["you are a stupid idiot and a fool", "the cat sat on the mat"] * 5)
    words = ["stupid", "idiot", "cat", "sat", "you"]
    lexicon = {f: k for k, f in enumerate(dict.fromkeys(f for w in words for f in S.features(w)))}
    model = S.Model(counts, lexicon, np.linspace(-1, 2, len(lexicon)))
    for text in ("You st0pid st0pid id!ot, s t u p i d cat", "", "the cat--sat catsat", "0000 !!! you"):
        restored = S.Restorer(counts).restored(text)
        want = {}
        for word, n in restored.items():
            for f in S.features(word):
                if f in lexicon:
                    want[lexicon[f]] = want.get(lexicon[f], 0) + n
        n, found = model.lexicon_counts(text)
        assert (n, found) == (sum(restored.values()), want) and list(found) == list(want)
        z = model.bias + model.length_weight * S._length(n) + sum(model.weights[k] * S._value(c, n) for k, c in want.items())
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_tasks_of_a_worker_share_what_they_looked_up():
    counts = S.count_trigrams(["the cat sat on the mat"] * 5)
    lexicon = {f: k for k, f in enumerate(S.features("cat"))}
    a, b = S.Model(counts, lexicon, key="one"), S.Model(counts, lexicon, key="one")
    assert a.lexicon_counts("the c4t sat") == b.lexicon_counts("the c4t sat") and a.entries is b.entries and "c4t" in b.entries
    other = S.Model(counts, {}, key="two")
    assert other.lexicon_counts("the cat")[1] == {} and list(S._shared) == ["two"]
    assert S.Model(counts, lexicon).lexicon_counts("cat")[1] and S.Model(counts, {}).lexicon_counts("cat")[1] == {}
