"""SentencePiece encoding and decoding with n-best segmentations.

The lattice of a text has a node before and after every code point and an edge
for every piece of the model that stands there (a code point that is no piece
has an edge that spells its UTF-8 bytes).  A forward Viterbi pass gives the
best score from the start to every node.  These scores are exact estimates of
what a search from the end still has to pay, so a backward A* search pops the
segmentations in order of their total score without detours.

No piece crosses the start of a run of blanks or a line feed, so the lattice
falls apart into chunks (a word with the blanks before it, or a line feed).
Chunks are scored once and kept in a bounded cache; the forward pass runs over
many new chunks at a time in numpy, and the search expands only the chunks
whose second choice can be among the text's n best.

Blanks are written as U+2581 with one more in front of the text, as the public
library does; a U+2581 of the text itself is spelt in bytes, so that decoding
gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from concord.llm.common import text_udf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CACHE = 150_000          # chunks kept in a worker
STEP_CHARS = 1 << 15     # code points in one vectorised pass
_CHUNK = re.compile(r"\x20*[^\x20\n]+|\n|\x20+")
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_NONE = -np.inf
ENCODED = ("struct<ids: array<int>, score: double, nbest: array<struct<score: double, "
           "changes: array<struct<chunk: int, ids: array<int>>>>>>")
_CHANGES = pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))


class Pieces:
    """A piece model, its lattices and their searches."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        usable = [i for i in range(sp.get_piece_size())
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.names = {sp.id_to_piece(i): i for i in usable}
        self.scores = {i: float(sp.get_score(i)) for i in usable}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.names):
            raise ValueError("this model has pieces that cross words or lines")
        # as the public library does: an unknown character costs 10 more than the worst real piece
        self.unknown = min(s for s in self.scores.values() if s > -1e8) - 10.0
        self.longest = max(map(len, self.names))
        self.spelling = {i: p.replace(BLANK, " ").encode() for p, i in self.names.items()}
        self.spelling |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        keys = np.array([self._key(np.array([[ord(x)] for x in p], np.uint32))[-1][-1, 0] for p in self.names], np.uint64)
        order = np.argsort(keys)
        # a last entry stands for "no piece"
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.key_ids = np.append(np.array(list(self.names.values()), np.int32)[order], np.int32(-1))
        self.key_scores = np.array([self.scores[i] for i in self.key_ids[:-1].tolist()] + [_NONE])
        # by a key's top bits: where its slot begins among the keys, or the last entry
        slots, first, count = np.unique(keys[order] >> np.uint64(44), return_index=True, return_counts=True)
        self.slots = np.full(1 << 20, len(keys), np.int32)
        self.slots[slots.astype(np.int64)] = first
        self.slot_most = int(count.max())
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: number of each known chunk, and by number its pieces
        (``count`` of them in ``flat`` from ``start``), score and loss (how much the second choice scores less)."""
        self.cache: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)

    def best(self, chunk: str) -> tuple[list[int], float, float]:
        """(pieces, score, loss) of a known chunk."""
        k = self.cache[chunk]
        return self.flat[self.start[k]: self.start[k] + self.count[k]].tolist(), float(self.score[k]), float(self.loss[k])

    @staticmethod
    def _key(c: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
        """Keys of the substrings of 1, 2, ... code points that end at each place (first axis) of each text."""
        h = np.zeros(c.shape, np.uint64)
        c = c.astype(np.uint64) + np.uint64(1)
        out, power = [], 1
        for n in range(1, (longest or len(c)) + 1):
            h[n - 1:] += c[: len(c) - n + 1] * np.uint64(power)
            power = power * int(_P) % (1 << 64)
            x = (h[n - 1:] ^ np.uint64(n)) * _M
            out.append((x ^ (x >> np.uint64(31))) * _P)
        return out

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key among the pieces' keys, or of the last entry."""
        at = self.slots[(key >> np.uint64(44)).astype(np.int64)]
        rows, cols = np.nonzero(at < len(self.keys) - 1)
        k, a = key[rows, cols], at[rows, cols]
        for _ in range(self.slot_most - 1):
            a += self.keys[a] < k
        a[self.keys[a] != k] = len(self.keys) - 1
        at[rows, cols] = a
        return at

    # ------------------------------------------------------------- one lattice
    def nbest_chunk(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a chunk, best first: forward Viterbi, then backward A*."""
        text = "".join(BLANK if c == " " else "\0" if c == BLANK else c for c in chunk)
        edges: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(len(text) + 1)]
        best = [0.0] + [_NONE] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                if (i := self.names.get(text[start:end])) is not None:
                    edges[end].append((start, self.scores[i], [i]))
            if not any(s == end - 1 for s, _, _ in edges[end]):
                spelt = chunk[end - 1].encode("utf-8", "surrogatepass")
                edges[end].append((end - 1, self.unknown, [self.byte_ids[b] for b in spelt]))
            best[end] = max(best[s] + w for s, w, _ in edges[end])
        # (minus total, node, tie, score of the pieces after the node, these pieces as (first, (next, ...)))
        heap: list[tuple] = [(-best[-1], len(text), 0, 0.0, None)]
        out, tie = [], 0
        while heap and len(out) < n:
            total, node, _, done, tail = heapq.heappop(heap)
            if node == 0:
                ids = []
                while tail is not None:
                    part, tail = tail
                    ids += part
                out.append((-total, ids))
                continue
            for start, w, ids in edges[node]:
                tie += 1
                heapq.heappush(heap, (-(best[start] + w + done), start, tie, w + done, (ids, tail)))
        return out

    # ----------------------------------------------------- many lattices at once
    def _learn(self, chunks: list[str]) -> None:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-sizes, kind="stable")
        lo, new = 0, []
        while lo < len(chunks):
            part = order[lo: lo + max(1, STEP_CHARS // int(sizes[order[lo]]))]
            names = [chunks[k] for k in part.tolist()]
            self.cache.update(zip(names, range(len(self.start) + lo, len(self.start) + lo + len(names))))
            new.append(self._forward(names, sizes[part]))
            lo += len(part)
        if new:
            flat, count, score, loss = (np.concatenate(x) for x in zip(*new))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
            self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])

    def _forward(self, chunks: list[str], size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Viterbi over chunks (longest first) side by side -> (pieces of all chunks,
        pieces of each, score of each, how much its second choice scores less)."""
        n = len(chunks)
        width, span = int(size[0]), min(self.longest, int(size[0]))
        text = "".join([x.ljust(width, "\0") for x in chunks])
        c = np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width).T).copy()
        own = c == ord(BLANK)
        c[c == 32] = ord(BLANK)
        c[own] = 0x110000                                      # a U+2581 of the text is no blank
        found = [self._find(key) for key in self._key(c, span)]     # by length - 1: [last place - length + 1, chunk]
        best = np.full((width + 1, n), _NONE)
        best[0] = 0.0
        back = np.zeros((width, n), np.int32)
        loss = np.zeros((width, n))
        for j in range(width):
            m = int(np.searchsorted(-size, -j, side="left"))   # chunks longer than j
            score = self.key_scores[found[0][j, :m]]
            top = best[j, :m] + np.where(score == _NONE, self.unknown, score)
            second, pick = np.full(m, _NONE), np.zeros(m, np.int32)
            for back_by in range(1, min(j + 1, span)):
                total = best[j - back_by, :m] + self.key_scores[found[back_by][j - back_by, :m]]
                better = total > top
                second = np.maximum(second, np.minimum(total, top))
                pick[better] = back_by
                top = np.maximum(top, total)
            best[j + 1, :m], back[j, :m], loss[j, :m] = top, pick, top - second
        # walk back along all best paths together
        node, least = size.copy(), np.full(n, np.inf)
        steps, live = [], np.arange(n)
        none = len(self.keys) - 1
        while len(live):
            j = node[live] - 1
            least[live] = np.minimum(least[live], loss[j, live])
            by = back[j, live]
            at = np.full(len(live), none, np.int64)
            for k in np.unique(by).tolist():
                of = by == k
                at[of] = found[k][j[of] - k, live[of]]
            # an unknown character is noted as minus its code point
            steps.append((live, j, np.where(at == none, -1 - c[j, live].astype(np.int64), self.key_ids[at])))
            node[live] = j - by
            live = live[node[live] > 0]
        row, place, piece = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(row * (width + 1) + place, kind="stable")
        row, piece = row[order], piece[order]
        odd = np.flatnonzero(piece < 0)
        if len(odd):                                           # spelt in bytes
            spelt = [[self.byte_ids[b] for b in (BLANK if x == 0x110000 else chr(x)).encode("utf-8", "surrogatepass")]
                     for x in (-1 - piece[odd]).tolist()]
            times = np.ones(len(piece), np.int64)
            times[odd] = [len(x) for x in spelt]
            row, piece = np.repeat(row, times), np.repeat(piece, times)
            piece[piece < 0] = [b for x in spelt for b in x]
        return piece.astype(np.int32), np.bincount(row, minlength=n), best[size, np.arange(n)], least

    def encode_batch(self, texts: list[str], n: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(ids of all texts, offset of each, score of each, n best of each as
        [(score, [(chunk number, ids)] that differ from the best)])."""
        out = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        seen = set().union(*out)
        if len(self.cache) + len(seen) > CACHE and self.cache:
            self._forget()
            nbest_of.cache_clear()
        self._learn([c for c in seen if c not in self.cache])
        sizes = [len(x) for x in out]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        number = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(out)), np.int64, int(ends[-1]))
        count = self.count[number]
        after = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[number] - after[:-1], count) + np.arange(after[-1])]
        score = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=self.score[number], minlength=len(texts))
        loss = self.loss[number]
        nbest = [self._nbest(chunks, loss[a:b], s, n) for chunks, a, b, s in zip(out, ends.tolist(), ends[1:].tolist(), score.tolist())]
        return ids, after[ends], score, nbest

    def encode(self, texts: list[str], n: int = 1) -> list[tuple[list[int], float, list[tuple[float, list]]]]:
        """(ids, score, n best) of each text, as ``encode_batch``."""
        ids, ends, score, nbest = self.encode_batch(texts, n)
        return [(ids[a:b].tolist(), s, x) for a, b, s, x in zip(ends.tolist(), ends[1:].tolist(), score.tolist(), nbest)]

    def _nbest(self, chunks: list[str], losses: np.ndarray, score: float, n: int) -> list[tuple[float, list]]:
        """The n best segmentations of a chain of chunks; ties: fewest changes, then the earliest chunks."""
        if n <= 1 or not chunks:
            return [(score, [])]
        # only the n - 1 chunks whose second choice costs least can differ from the best segmentation
        spots = [k for k in np.argsort(losses, kind="stable")[: n - 1].tolist() if losses[k] < np.inf]
        options = [nbest_of(self, chunks[k], n) for k in spots]
        start = (0,) * len(spots)
        heap, seen, out = [(0.0, 0, start)], {start}, []
        while heap and len(out) < n:
            loss, _, ranks = heapq.heappop(heap)
            out.append((score - loss, sorted((spots[k], options[k][r][1]) for k, r in enumerate(ranks) if r)))
            for k, r in enumerate(ranks):
                if r + 1 < len(options[k]):
                    to = (*ranks[:k], r + 1, *ranks[k + 1:])
                    if to not in seen:
                        seen.add(to)
                        more = sum(options[j][0][0] - options[j][x][0] for j, x in enumerate(to))
                        heapq.heappush(heap, (more, sum(map(bool, to)), to))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids`` without the blank in front."""
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=20_000)
def nbest_of(pieces: Pieces, chunk: str, n: int) -> list[tuple[float, list[int]]]:
    return pieces.nbest_chunk(chunk, n)


@lru_cache(maxsize=2)
def load(proto: bytes) -> Pieces:
    return Pieces(proto)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read on the driver only; tasks get its bytes (under 1 MB, checked)."""
    with open(path, "rb") as f:
        proto = f.read()
    if len(proto) > 64 << 20:
        raise ValueError(f"{path} has {len(proto)} bytes; models up to 64 MB are sent to the tasks")
    return proto


def encode(docs: DataFrame, n: int = 4, model: str = MODEL, column: str = "encoded") -> DataFrame:
    """Add ``column``: struct(ids, score, nbest) of every whole text.

    ``nbest`` lists up to n segmentations, best first, each with its score and
    the chunks that differ from ``ids``.  Null and empty texts: no ids, score 0,
    one empty segmentation.  Rows are kept one for one; an existing column of
    that name is replaced."""
    proto = read_model(model)

    def step(texts: pa.Array) -> pa.Array:
        flat, ends, score, rows = load(proto).encode_batch([t or "" for t in texts.to_pylist()], n)
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        nbest = pa.array([[{"score": s, "changes": [{"chunk": k, "ids": i} for k, i in ch]} for s, ch in r] for r in rows],
                         pa.list_(pa.struct([("score", pa.float64()), ("changes", _CHANGES)])))
        return pa.StructArray.from_arrays([ids, pa.array(score), nbest], ["ids", "score", "nbest"])

    return docs.withColumn(column, text_udf(step, ENCODED)("text"))


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL, column: str = "decoded") -> DataFrame:
    """Add ``column``: the text of the array of piece ids (null ids: empty)."""
    from pyspark.sql import functions as F

    proto = read_model(model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        p, column = load(proto), column.fill_null([])
        ids = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).tolist()
        return pa.array([p.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

    return encoded.withColumn(column, run(ids))
