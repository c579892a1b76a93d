import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import tokencounts as T
from concord.llm.pieces import MODEL, read_model

from .cases import ODD, empty, odd

SF = "/root/testdata/sf0.01"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PROTO = read_model()


def _same(text, chunk=64, overlap=8):
    got = T.encoder(PROTO, chunk, overlap).ids(text).tolist()
    assert got == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaabeinst  \n0129▁é☃\x00😀.,-ЖÄ") | st.characters(exclude_categories=["Cs"]), max_size=600))
def test_spliced_ids_equal_the_library(text):
    _same(text)
    _same(text, 16, 2)


def test_texts_without_a_stable_place(monkeypatch):
    """One letter for thousands of characters: overlaps double, then chunks grow to the whole run."""
    rng = random.Random(3)
    for text in ("a" * 5000, "=" * 3000 + " end", "word " * 40 + "o" * 2000 + " tail" * 300, " " * 4000,
                 "".join(rng.choice("abcdefgh") for _ in range(6000)), "é" * 2000 + "ab" * 900):
        _same(text)
    assert len(T.encoder(PROTO, 64, 8).stable("a" * 5000)) == 0


def test_overlaps_widen_only_where_they_must():
    coder = T.Encoder(PROTO, 64, 8)
    spans = []
    plain = coder._encode
    coder._encode = lambda text, a, b: spans.append((a, b)) or plain(text, a, b)
    text = "some ordinary words, " * 100
    assert coder.ids(text).tolist() == LIBRARY.encode(text)
    assert max(b - a for a, b in spans) <= 64 and len(spans) < 2 * len(text) / (64 - 8)
    spans.clear()
    text = "some ordinary words, " * 10 + "z" * 300 + " some ordinary words" * 10
    assert coder.ids(text).tolist() == LIBRARY.encode(text)
    assert max(b - a for a, b in spans) > 300


def test_long_documents_of_the_table():
    """Every text of the table of over 2,000 characters in chunks of 500."""
    import pyarrow.parquet as pq
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if t and len(t) > 2000]
    assert len(texts) > 50
    for t in texts:
        _same(t, 500, 32)


def test_megabyte_texts():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for text in ("".join(rng.choices(letters, k=1_000_000)), "lorem ipsum dolor " * 60_000, "line\n" * 200_000):
        _same(text, T.CHUNK, T.OVERLAP)


def test_other_models_are_encoded_whole():
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    model.ParseFromString(PROTO)
    model.normalizer_spec.remove_extra_whitespaces = True
    coder = T.Encoder(model.SerializeToString(), 64, 8)
    assert not coder.chunked and len(list(coder.segments("a b  c " * 100))) == 1
    with pytest.raises(ValueError, match="overlap"):
        T.Encoder(PROTO, 8, 8)


def test_odd_rows(spark):
    rows = T.token_counts(odd(spark).withColumn("n_tokens", F.lit("x")), limit=10, chunk=64, overlap=8).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows) == sorted(
        (-1 if d is None else d, t or "") for d, t in ODD)
    for r in rows:
        n = len(LIBRARY.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 10)
        assert r["part"] == "x"
    assert T.token_counts(empty(spark)).collect() == []
    ids = T.token_ids(odd(spark), chunk=64, overlap=8).collect()
    assert all(r["ids"] == LIBRARY.encode(r["text"] or "") for r in ids)


def test_query_equals_the_library(spark):
    from concord.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_resynchronised_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(LIBRARY.encode(docs[r["doc_id"]] or ""))
        assert tuple(r) == (r["doc_id"], len((docs[r["doc_id"]] or "").encode()), n, n > 4096)
