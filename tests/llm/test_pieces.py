import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import pieces as S

from .cases import ODD, empty, odd


@pytest.fixture(scope="module")
def model():
    return S.load(S.read_model())


def plain_segmentations(p, chunk):
    """All segmentations of a chunk, best first."""
    text = "".join(S.BLANK if c == " " else "\0" if c == S.BLANK else c for c in chunk)

    def rest(i):
        if i == len(text):
            return [(0.0, [])]
        out, single = [], False
        for e in range(i + 1, min(len(text), i + p.longest) + 1):
            k = p.names.get(text[i:e])
            if k is not None:
                single |= e == i + 1
                out += [(p.scores[k] + s, [k, *x]) for s, x in rest(e)]
        if not single:
            out += [(p.unknown + s, [p.byte_ids[b] for b in chunk[i].encode()] + x) for s, x in rest(i + 1)]
        return out

    return sorted(rest(0), key=lambda r: -r[0])


def test_nbest_equals_enumeration(model):
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("the aniñ\n▁ ☃") for _ in range(rng.randrange(1, 12)))
        (raw, score, nbest), = model.encode([t], 5)
        want = plain_segmentations(model, " " + t)
        assert [x[0] for x in nbest] == [w[0] for w in want[:5]] and score == want[0][0]
        assert model.decode(raw) == t
        # every listed segmentation is one of the lattice and has the score it claims
        chunks = S._CHUNK.findall(" " + t)
        for s, changes in nbest:
            ids = [model.best(c)[0] for c in chunks]
            for k, other in changes:
                ids[k] = other
            assert (s, sum(ids, [])) in want
            assert model.decode(sum(ids, [])) == t


def test_search_and_forward_pass_agree(model):
    rng = random.Random(2)
    chunks = [" " * rng.randrange(3) + "".join(rng.choice("etaoinsé€") for _ in range(rng.randrange(1, 30))) for _ in range(100)]
    model._forget()
    model._learn(list(set(chunks)))
    for c in chunks:
        best = model.nbest_chunk(c, 2)
        raw, score, loss = model.best(c)
        assert raw in [ids for s, ids in model.nbest_chunk(c, 50) if s == score]
        assert score == best[0][0]
        assert loss == (best[0][0] - best[1][0] if len(best) > 1 else np.inf)


def test_ids_are_the_public_librarys_pieces(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=S.read_model())
    for t in ("Hello  world", "né à l'été", "x☃y"):
        (raw, _, _), = model.encode([t])
        assert sp.decode(raw) == t


def test_round_trip_of_odd_rows(spark):
    enc = S.encode(odd(spark))
    rows = S.decode(enc, "encoded.ids").select("doc_id", "text", "decoded", "encoded.*").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["decoded"] == (r["text"] or "")
        assert r["nbest"][0]["score"] == r["score"] and len(r["nbest"]) >= 1
        scores = [x["score"] for x in r["nbest"]]
        assert scores == sorted(scores, reverse=True)
        if not r["text"]:
            assert r["ids"] == [] and r["score"] == 0
    assert S.encode(empty(spark)).count() == 0


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(S, "CACHE", 50)
    model._forget()
    for k in range(10):
        t = " ".join(f"w{k}x{i}" for i in range(30))
        (raw, _, _), = model.encode([t], 2)
        assert model.decode(raw) == t
        assert len(model.cache) <= 50 and len(model.start) == len(model.cache)


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bad = S.decode(S.encode(docs, n=1), "encoded.ids").where(F.col("decoded") != F.col("text"))
    assert bad.count() == 0


def test_long_runs_without_blanks(model):
    """200 KB of one run: the search keeps linked states, so memory and time grow with the run."""
    import tracemalloc
    rng = random.Random(6)
    text = "".join(rng.choices("ABCDEFGHabcdefgh0123+/", k=200_000))
    tracemalloc.start()
    found = model.nbest_chunk(text, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2 and found[0][0] >= found[1][0]
    assert all(model.decode(ids) == text[1:] for _, ids in found)
    assert peak < 1 << 30
