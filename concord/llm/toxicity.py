"""Toxicity scores of texts whose offensive words may be disguised.

Noisy channel: a writer's letters reach us through leetspeak (digits and signs
for letters), spacing (separators between letters) and repetition.  Every token
that shows such signs becomes a lattice: each character may be read as one of
several letters, as a word end, or as nothing.  Viterbi decoding under a
character trigram model picks the reading; tokens of plain letters have only
one reading and pass unchanged.  Signs at the edges of a token may be letters
too; there they are dropped cheaply, as they mostly are punctuation.  A token
that is one sign or digit over and over says nothing.  The trigram model is
counted over all documents.

The restored text is scored by a logistic regression over a lexicon: the words
and word beginnings that the labelled texts tie most strongly to toxic ones
(G-squared), each as log(1 + 30 count / sqrt(words + 30)), and the length.  The
lexicon and the weights are fitted on a documented, bounded sample
(``SAMPLE`` labelled rows, the smallest by hash of doc_id).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import held_out, pieces, text_udf
from concord.llm.langid import letter_table

SAMPLE = 6000
LEXICON = 1000
LEAST_G2, LEAST_DOCS = 20.0, 4
THRESHOLD = 0.7
PREFIXES = range(4, 9)
CACHE = 200_000
SLOTS = 1 << 18
#: Letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l",
        "¡": "i", "×": "x", "µ": "u", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
#: Costs in nats: a sign read as a letter, dropped, or as a word end; a repeated letter dropped.
READ, DROP, END, REPEAT, REPEAT_ONCE = 1.0, 6.0, 4.0, 0.5, 5.0
EDGE = 1.5                          # a sign dropped before or after a token's letters and digits
_SINGLE = rf"(?:[^\W\d_]|[{re.escape(''.join(LEET))}])"
_SPACED = re.compile(rf"(?<!\S)(?:{_SINGLE}\s+){{2,}}{_SINGLE}(?!\S)")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


# ------------------------------------------------------------ character model
def _slots(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), np.uint64(len(columns)))
    for k, c in enumerate(columns):
        h = (h ^ (c.astype(np.uint64) * _MIX[k])) * _MIX[0]
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slot(*points: int) -> int:
    """``_slots`` of one row."""
    h = len(points)
    for k, c in enumerate(points):
        h = (h ^ (c * int(_MIX[k]))) * int(_MIX[0]) & 0xFFFFFFFFFFFFFFFF
    return h >> (64 - SLOTS.bit_length() + 1)


def count_trigrams(texts: list[str]) -> np.ndarray:
    """[3, SLOTS] counts of letters, pairs and triples; words begin and end with 0."""
    points = np.frombuffer("\0".join(["", "", *(t.lower() for t in texts), "", ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letter_table()[points], points, 0)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    out = np.zeros((3, SLOTS), np.int64)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m > 0:
            out[n - 1] = np.bincount(_slots(*[c[k: m + k] for k in range(n)]), minlength=SLOTS)
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all texts: every task adds up its own, Spark sums the slots."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, SLOTS), np.int64)
        for b in batches:
            for piece in pieces(b.column(0)):
                total += count_trigrams([t or "" for t in piece.to_pylist()])
        order, slot = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"n": pa.array(order, pa.int32()), "slot": pa.array(slot, pa.int32()),
                                          "count": pa.array(total[order, slot], pa.int64())})

    sums = docs.select("text").mapInArrow(count, "n int, slot int, count long").groupBy("n", "slot").agg(
        F.sum("count").alias("count"))
    out = np.zeros((3, SLOTS), np.int64)
    for r in sums.collect():                     # at most 3 * SLOTS rows, whatever the corpus
        out[r["n"], r["slot"]] = r["count"]
    return out


@dataclass
class Decoder:
    """Viterbi decoding of character lattices."""
    counts: np.ndarray
    known: dict = field(default_factory=dict)
    total: float = 0.0

    def cost(self, a: int, b: int, c: int) -> float:
        """-log p(c | a, b), backing off to pairs and letters."""
        key = (a, b, c)
        if (x := self.known.get(key)) is None:
            if not self.total:
                self.total = float(self.counts[0].sum())
            n3, n2 = self.counts[2][_slot(a, b, c)], self.counts[1][_slot(a, b)]
            m2, n1 = self.counts[1][_slot(b, c)], self.counts[0][_slot(b)]
            p1 = (self.counts[0][_slot(c)] + 0.5) / (self.total + 1000.0)
            p2 = (m2 + 5 * p1) / (n1 + 5)
            x = self.known[key] = -math.log((n3 + 5 * p2) / (n2 + 5))
        return x

    def restore(self, token: str, core: tuple[int, int] | None = None) -> list[str]:
        """Words of the best reading of a lower-case token (or of letters with blanks between);
        signs before and after ``core`` (first place, end) are dropped at EDGE while no letter
        stands before or after them."""
        lo, hi = core or (0, len(token))
        known, cost_of = self.known, self.cost
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        ends = []
        for i, ch in enumerate(token):
            if i >= hi and core:
                # nothing more is read: a reading; states that cost more with 1 a sign cannot win
                rest = [EDGE if x in LEET else 1.0 for x in token[i:]]
                ends += self._ends(states, sum(rest))
                most = min(ends)[0] - len(rest) + 1e-9
                states = {k: v for k, v in states.items() if v[0] <= most}
            if ch.isalpha():
                readings = [(ch, 0.0)]
                if i and token[i - 1] == ch:
                    run = (i > 1 and token[i - 2] == ch) or (i + 1 < len(token) and token[i + 1] == ch)
                    readings.append(("", REPEAT if run else REPEAT_ONCE))
                elif len(states) == 1:                            # one way on
                    ((a, b), (cost, out)), = states.items()
                    c = ord(ch)
                    if (x := known.get((a, b, c))) is None:
                        x = cost_of(a, b, c)
                    states = {(b, c): (cost + x, out + ch)}
                    continue
            elif ch in LEET:
                readings = [(x, READ) for x in LEET[ch]] + [("", DROP), (" ", END)]
            else:
                readings = [("", 1.0), (" ", 1.0)]
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, out) in states.items():
                for x, more in readings:
                    if not x or (x == " " and b == 0):
                        to, total, text = (a, b), cost + (min(more, EDGE) if i < lo and not out else more), out
                    else:
                        c = 0 if x == " " else ord(x)
                        if (y := known.get((a, b, c))) is None:
                            y = cost_of(a, b, c)
                        to, total, text = (b, c), cost + more + y, out + x
                    if to not in after or (total, text) < after[to]:
                        after[to] = (total, text)
            states = after
        return min(ends + self._ends(states, 0.0))[1].split()

    def _ends(self, states: dict, rest: float) -> list[tuple[float, str]]:
        return [(cost + (self.cost(a, b, 0) if b else 0.0) + rest, out) for (a, b), (cost, out) in states.items()]


# ------------------------------------------------------------------- features
def _core(token: str) -> tuple[int, int]:
    """(first place, end) of what lies from the first to the last letter or digit; all of a token of signs."""
    if token[:1].isalnum() and token[-1:].isalnum():
        return 0, len(token)
    at = [i for i, c in enumerate(token) if c.isalnum()]
    return (at[0], at[-1] + 1) if at else (0, len(token))


class Restorer:
    """Restored words of texts, with a bounded cache of tokens."""

    def __init__(self, counts: np.ndarray):
        self.decoder = Decoder(counts)
        self.cache: dict[str, tuple[str, ...]] = {}

    def words(self, token: str) -> tuple[str, ...]:
        """Restored words of one token without blanks (lower case)."""
        lo, hi = 0, len(token)
        while hi > lo and not (token[hi - 1].isalnum() or token[hi - 1] in LEET):
            hi -= 1
        while lo < hi and not (token[lo].isalnum() or token[lo] in LEET):
            lo += 1
        token = token[lo:hi]
        if token.isalpha() and not _DOUBLE.search(token):
            return (token,)
        if not any(c.isalpha() for c in token) and len(set(token)) < 2:
            return ()
        return tuple(self.decoder.restore(token, _core(token)))

    def spaced(self, run: str) -> list[str]:
        """Restored words of letters and signs with blanks between."""
        if len(signs := set(run.split())) < 2 and not any(c.isalpha() for c in signs):
            return []
        line = " ".join(run.split())
        return self.decoder.restore(line, _core(line))

    def tokens(self, text: str) -> tuple[list[str], Counter]:
        """(restored words of letters with blanks between, how often each other token stands in the text)."""
        text = text.lower()
        spaced: list[str] = []
        if _SPACED.search(text):
            parts, at = [], 0
            for m in _SPACED.finditer(text):
                parts.append(text[at: m.start()])
                spaced += self.spaced(m[0])
                at = m.end()
            text = " ".join([*parts, text[at:]])
        return spaced, Counter(text.split())

    def restored(self, text: str) -> Counter:
        """How often each word stands in the restored text."""
        spaced, tokens = self.tokens(text)
        out: Counter = Counter(spaced)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for token, n in tokens.items():
            words = cache.get(token)
            if words is None:
                words = cache[token] = self.words(token)
            for w in words:
                out[w] += n
        return out


def restore_text(text: str, decoder: Decoder) -> str:
    """The restored text itself: words joined by blanks (case and punctuation go)."""
    r = Restorer(decoder.counts)
    out, at, low = [], 0, text.lower()
    for m in [*_SPACED.finditer(low), None]:
        for token in low[at: m.start() if m else len(low)].split():
            out += r.words(token)
        if m:
            out += r.spaced(m[0])
            at = m.end()
    return " ".join(out)


def features(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    names = ["=" + word] + ["^" + word[:k] for k in PREFIXES if len(word) > k]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in names]


#: What the tasks of one Python worker have looked up with the latest model: key -> (restorer, entries of tokens).
_shared: dict[str, tuple] = {}


@dataclass
class Model:
    counts: np.ndarray                           # of the character model
    lexicon: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -5.0
    length_weight: float = 0.0
    entries: dict[str, tuple] = field(default_factory=dict)
    restorer: Restorer | None = None
    key: str = ""                                # names counts and lexicon; without one nothing is shared

    def __getstate__(self) -> dict:
        return {**self.__dict__, "entries": {}, "restorer": None}

    def lexicon_counts(self, text: str) -> tuple[int, dict[int, int]]:
        """(words, count of each lexicon entry) of the restored text."""
        if self.restorer is None:
            if self.key not in _shared:
                _shared.clear()
                _shared[self.key] = Restorer(self.counts), {}
            self.restorer, self.entries = _shared[self.key] if self.key else (Restorer(self.counts), {})
        if len(self.entries) > CACHE:
            self.entries.clear()
        spaced, tokens = self.restorer.tokens(text)
        total, found = len(spaced), {}
        for k in self._hits(spaced):
            found[k] = found.get(k, 0) + 1
        # a token's words and their entries are looked up together
        entries = self.entries
        for token, n in tokens.items():
            known = entries.get(token)
            if known is None:
                words = self.restorer.words(token)
                known = entries[token] = len(words), self._hits(words)
            words, hits = known
            total += n * words
            for k in hits:
                found[k] = found.get(k, 0) + n
        return total, found

    def _hits(self, words) -> tuple[int, ...]:
        return tuple(self.lexicon[f] for word in words for f in features(word) if f in self.lexicon)

    def score(self, text: str) -> float:
        n, found = self.lexicon_counts(text)
        # one call for all entries; added up in their order
        values = _value(np.array(list(found.values()), float), n) * self.weights[list(found)] if found else ()
        z = self.bias + self.length_weight * _length(n) + sum(values)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def _value(count, words):
    return np.log1p(30 * count / np.sqrt(words + 30))


def _length(words):
    return np.log1p(words) - 5


# ------------------------------------------------------------------------ fit
def _lexicon(tied: DataFrame, n_toxic: int, n_clean: int) -> dict[int, int]:
    """tied(feature, a toxic texts, b clean texts) -> the most telling features."""
    n = float(n_toxic + n_clean)
    a, b = F.col("a"), F.col("b")
    cells = [(a, n_toxic, True), (b, n_clean, True), (F.lit(n_toxic) - a, n_toxic, False), (F.lit(n_clean) - b, n_clean, False)]
    g2 = F.lit(0.0)
    for seen, column, present in cells:
        row = (a + b) if present else (F.lit(n) - a - b)
        g2 = g2 + F.when(seen > 0, 2 * seen * F.log(seen * n / (row * column))).otherwise(0.0)
    best = (tied.where((a >= LEAST_DOCS) & (a * float(n_clean) > 2 * b * float(n_toxic)))
            .withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(LEXICON))
    return {r["feature"]: k for k, r in enumerate(best.collect())}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 400) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Rows held out by ``common.held_out`` are not read for learning.  A doc_id
    labelled twice counts as toxic if one label says so; labels without a text
    and null labels are ignored.  With only one class the model scores by
    length and bias alone."""
    model = Model(trigram_counts(docs))
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = usable.count()
    near = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < min(1.0, sample / max(known, 1)) * (1 << 30)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about ``sample`` pairs of numbers: a bounded side
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(near), "doc_id").select("toxic", "text").persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
        if not toxic or not clean:
            return model

        def seen(texts: pa.Array) -> pa.Array:
            r = Restorer(model.counts)
            return pa.array([list({f for w in r.restored(t or "") for f in features(w)}) for t in texts.to_pylist()],
                            pa.list_(pa.int64()))

        is_toxic = (F.col("toxic") == 1).cast("int")
        tied = rows.select(is_toxic.alias("y"), F.explode(text_udf(seen, "array<bigint>")("text")).alias("feature")) \
            .groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        model.lexicon = _lexicon(tied, toxic, clean)
        model.key = uuid.uuid4().hex

        def counted(texts: pa.Array) -> pa.Array:
            out = [model.lexicon_counts(t or "") for t in texts.to_pylist()]
            return pa.array([{"n": n, "at": list(c), "count": list(c.values())} for n, c in out],
                            pa.struct([("n", pa.int64()), ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int32()))]))

        seen_rows = rows.select(is_toxic.alias("y"), text_udf(
            counted, "struct<n: bigint, at: array<int>, count: array<int>>")("text").alias("c")).select("y", "c.*").collect()
    finally:
        rows.unpersist()
    seen_rows.sort(key=lambda r: (r["y"], r["n"], r["at"], r["count"]))
    y = np.array([r["y"] for r in seen_rows], float)
    x = np.zeros((len(y), len(model.lexicon) + 1), np.float32)
    for k, r in enumerate(seen_rows):
        x[k, r["at"]] = _value(np.array(r["count"], float), r["n"])
        x[k, -1] = _length(r["n"])
    model.weights, model.length_weight, model.bias = _logistic(x, y, steps)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[np.ndarray, float, float]:
    """Adagrad on the regularised log loss; toxic rows count twice."""
    w, b = np.zeros(x.shape[1]), 0.0
    gw, gb = np.full(x.shape[1], 1e-6), 1e-6
    weight = np.where(y == 1, 2.0, 1.0) / len(y)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        dw, db = x.T @ g + 1e-3 * w, g.sum()
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w - 0.3 * dw / np.sqrt(gw), b - 0.3 * db / math.sqrt(gb)
    return w[:-1].copy(), float(w[-1]), float(b)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """Add ``column`` (double, 0 to 1): the score of every whole text.

    Null and empty texts are scored as texts without words; rows are kept one
    for one; an existing column of that name is replaced."""
    def step(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(column, text_udf(step, "double")("text"))
