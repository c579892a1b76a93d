"""Token counts (and ids) of whole texts, equal to the public library's, with
huge texts encoded in overlapping chunks.

A text of up to ``chunk + overlap`` code points goes to the library as it is.
A longer one is encoded chunk by chunk, each chunk with the offsets of its
tokens; neighbouring chunks overlap.  At a chunk's start the library puts its
own blank, at its end the text is cut, so the tokens near the ends may differ
from those of the whole text.  The two encodings of an overlap are spliced at a
place where

* both have a token boundary, and
* no piece of the model holds the two code points beside the place as neighbours.

The second condition is the proof.  The encoder starts from single code points
and only ever joins neighbours into a piece of the model; a join across such a
place would be a piece that holds the two code points side by side.  So no join
crosses it, in any text, and what stands on either side is encoded as if the
other were absent: tokens before the place are the left chunk's, tokens after it
the right chunk's.  An overlap without such a place (a long run of one letter)
is doubled, at last to the whole left chunk, which then grows itself; the text
is encoded in one go if there is no such place at all.

So a worker holds the tokens of one chunk, not of the text.  The proof needs a
BPE model whose normaliser leaves texts as they are but for blanks written as
U+2581; texts of other models are always encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_udf
from concord.llm.pieces import MODEL, read_model

#: Code points of a chunk and of the overlap of two chunks, at first.
CHUNK, OVERLAP = 1 << 14, 1 << 9
LIMIT = 4096
BLANK = "▁"
_BITS = np.uint64(21)          # of a code point
#: Types of pieces that joins can make, and the model type of byte-pair encoding, in the library's model files.
_JOINED, _BPE = (1, 4, 5), 2


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Encoder:
    """The library's encoder with chunks for huge texts."""

    def __init__(self, proto: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        rules = model.normalizer_spec
        self.chunked = (model.trainer_spec.model_type == _BPE and not rules.precompiled_charsmap
                        and not rules.remove_extra_whitespaces and rules.escape_whitespaces
                        and not model.trainer_spec.treat_whitespace_as_suffix)
        inner = {(a, b) for p in model.pieces if p.type in _JOINED for a, b in zip(p.piece, p.piece[1:])}
        self.inner = np.array(sorted(ord(a) << 21 | ord(b) for a, b in inner) or [0], np.uint64)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.chunk, self.overlap = chunk, overlap

    def stable(self, text: str) -> np.ndarray:
        """Places 1 .. len - 1 that no token of any text crosses."""
        c = _points(text.replace(" ", BLANK)).astype(np.uint64)
        pair = c[:-1] << _BITS | c[1:]
        at = np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)
        return np.flatnonzero(self.inner[at] != pair) + 1

    def _encode(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place where each token begins) of a chunk; places count from the text's start."""
        got = self.library.encode(text[start:end], return_type="offset_mapping", num_threads=1)
        begins = np.array(got["offsets"], np.int64).reshape(-1, 2)[:, 0] + start
        return np.array(got["ids"], np.int32), begins

    def segments(self, text: str) -> Iterator[np.ndarray]:
        """Token ids of the whole text, one array for each chunk."""
        n = len(text)
        if n <= self.chunk + self.overlap or not self.chunked:
            yield np.array(self.library.encode(text, num_threads=1), np.int32)
            return
        start, done, size = 0, 0, self.chunk            # the chunk's start, the last splice, the chunk's size
        end = size
        ids, begins = self._encode(text, start, end)
        while end < n:
            overlap, splice = self.overlap, None
            while splice is None and overlap < 2 * (end - done):
                # an overlap that no longer fits between the last splice and the end is all of that
                right = max(end - overlap, done)
                for place in (self.stable(text[right:end]) + right)[::-1].tolist():
                    right_end = min(n, right + max(size, 2 * (end - right)))
                    ids2, begins2 = self._encode(text, right, right_end)
                    # proven stable, so it is a boundary on both sides: the check guards against another library
                    if place > done and place in begins and place in begins2:
                        splice = place
                    break
                overlap *= 2
            if splice is None:                          # nowhere to splice: the left chunk grows
                size *= 2
                end = min(n, start + size)
                ids, begins = self._encode(text, start, end)
                continue
            yield ids[(begins >= done) & (begins < splice)]
            start, done, size, end = right, splice, self.chunk, right_end
            ids, begins = ids2, begins2
        yield ids[begins >= done]

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate(list(self.segments(text)))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; short texts go to the library together."""
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk + self.overlap]
        for i, ids in zip(short, self.library.encode([texts[i] for i in short], return_type="numpy", num_threads=1)):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk + self.overlap:
                out[i] = sum(map(len, self.segments(t)))
        return out


@lru_cache(maxsize=2)
def encoder(proto: bytes, chunk: int, overlap: int) -> Encoder:
    return Encoder(proto, chunk, overlap)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
                 text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) to every row.

    Null and empty texts have 0 bytes and 0 tokens; rows are kept one for one,
    repeated ones too, and an empty table stays empty.  A huge text is encoded
    in chunks in its own task, of which it holds one at a time.  Columns of the
    three names are replaced."""
    proto = read_model(model)

    def step(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(proto, chunk, overlap).counts([t or "" for t in texts.to_pylist()]), pa.int64())

    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
            .withColumn("n_tokens", text_udf(step, "long")(text))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def token_ids(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text",
              column: str = "ids") -> DataFrame:
    """Add ``column``: array of the token ids of every whole text, spliced in the
    same way (null and empty texts: no ids); an existing column of that name is replaced."""
    proto = read_model(model)

    def step(texts: pa.Array) -> pa.Array:
        coder = encoder(proto, chunk, overlap)
        return pa.array([coder.ids(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(column, text_udf(step, "array<int>")(text))
