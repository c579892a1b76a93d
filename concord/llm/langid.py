"""Language identification by nearest centroid.

A text is a vector of character n-grams (1 to 3, letters only, word ends kept),
hashed into ``DIMS`` slots, weighted by sublinear term frequency and inverse
document frequency, and scaled to length 1.  Every language has several
centroids (spherical k-means over its training texts); a text gets the language
of the centroid with the largest cosine.  A text whose best cosine is below the
threshold for its amount of n-grams is rejected: thresholds are half the
cosine with their own language that all but one in ``ODD_SHARE`` of the training
texts, cut down by chance to as many different n-grams, reach.

Document frequencies, centroids and thresholds each come from all rows that may
be learned from, in one pass each.  Only the places where the k-means starts are
taken from few rows (``per_language`` texts of each language, the smallest by
hash of doc_id).  Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import held_out, pieces, text_udf

DIMS = 8192
#: Texts whose counts are made together: tables of so many rows stay in a core's cache.
ROWS = 32
UNKNOWN = "und"
#: One training text in so many may lie below what a threshold is half of; steps of a cosine.
ODD_SHARE, COSINE_STEPS = 1000, 4096
#: Sums of vectors are taken in whole numbers of this unit, so that they do not depend on their order.
UNIT = float(1 << 32)
#: Odd multipliers of the hash, one for each place in an n-gram.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Letters (with the word end) of which all n-grams are looked up: 64 ** 3 slots.  A letter that is not among them yet.
MOST_LETTERS, _NEW = 64, 255
_letters: np.ndarray | None = None
_alphabet: tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters (made once in a process)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _slots(grams: list[np.ndarray]) -> np.ndarray:
    """Slot of each n-gram, given the code points of its 1 to 3 places (arrays that broadcast; 0: word end); DIMS for what is none."""
    h = grams[0] * _MIX[0] ^ np.uint64(len(grams))
    h *= _MIX[0]
    for k in range(1, len(grams)):
        h = h ^ grams[k] * _MIX[k]
        h *= _MIX[0]
    # the middle letter names the text, as separators stand between texts; of a pair, either place may be the letter
    good = (grams[0] != 0) | (grams[1] != 0) if len(grams) == 2 else grams[len(grams) // 2] != 0
    return np.where(good, (h >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64), DIMS)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts [texts, DIMS] float32, n-grams in each text)."""
    counts = np.zeros((len(texts), DIMS), np.float32)
    total = np.zeros(len(texts), np.int64)
    for i in range(0, len(texts), ROWS):
        part = _count(texts[i: i + ROWS])
        counts[i: i + ROWS] = part
        total[i: i + ROWS] = part.sum(axis=1)
    return counts, total


def _tabled(points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """(place of each code point in an alphabet, 0: no letter; slots of all its 1-, 2- and 3-grams), or None with too many letters.

    The alphabet is kept in the process and grows with the letters met, or starts
    anew where all of them are too many."""
    global _alphabet
    if _alphabet is None:
        _alphabet = np.zeros(1, np.uint64), np.where(letter_table(), _NEW, 0).astype(np.uint8), []
    letters, place, slots = _alphabet
    c = place[points]
    if not slots or (c == _NEW).any():
        present = np.unique(points[letter_table()[points]]).astype(np.uint64)
        letters = next((a for a in (np.union1d(letters, present), np.append(np.uint64(0), present)) if len(a) <= MOST_LETTERS), None)
        if letters is None:
            return None
        place = np.where(letter_table(), _NEW, 0).astype(np.uint8)
        place[letters.astype(np.int64)] = np.arange(len(letters))
        slots = [_slots([letters.reshape([-1 if k == i else 1 for k in range(n)]) for i in range(n)]).reshape(-1).astype(np.int32)
                 for n in (1, 2, 3)]
        _alphabet = letters, place, slots
        c = place[points]
    return c, slots


def _count(texts: list[str]) -> np.ndarray:
    """Counts [texts, DIMS] of a few texts.  The slots of all n-grams of a small alphabet are hashed once and looked up."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if (tabled := _tabled(points)) is not None:
        c, slots = tabled
    else:
        c, slots = np.where(letter_table()[points], points, 0), []
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)              # a run of other characters is one word end
    at = np.flatnonzero(keep)
    c = c[at].astype(np.int32 if slots else np.uint64)
    # a text begins behind the word end that divides it from the one before, its own word end is its last place
    begin = np.cumsum([1, *(len(t) + 1 for t in lowered)])
    begin[0] = 0
    row = np.repeat(np.arange(len(texts)) * (DIMS + 1), np.diff(np.searchsorted(at, begin)))
    code, cells = c, []
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            continue
        if slots:
            if n > 1:
                code = code[:m] * np.int32(len(slots[0])) + c[n - 1:]
            slot = slots[n - 1][code]
        else:
            slot = _slots([c[k: m + k] for k in range(n)])
        # a word end behind a letter belongs to the letter's text, so the second place names the text of a pair too
        cells.append(slot + row[n // 2: m + n // 2])
    return np.bincount(np.concatenate(cells), minlength=len(texts) * (DIMS + 1)).reshape(len(texts), DIMS + 1)[:, :DIMS]


@dataclass
class Model:
    languages: list[str]            # of each centroid
    centroids: np.ndarray           # [centroids, DIMS], length 1
    idf: np.ndarray
    thresholds: np.ndarray          # by floor(log2(different n-grams))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(counts.shape, np.float32)
        for i in range(0, len(counts), ROWS):
            n, v = counts[i: i + ROWS].reshape(-1), out[i: i + ROWS]
            at = np.flatnonzero(n != 0)                   # much faster over booleans than over numbers
            v.reshape(-1)[at] = np.log1p(n[at], dtype=np.float32) * self.idf[at % DIMS]
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine 0 to 1, rejected) of each text."""
        counts, total = ngram_counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        size = np.minimum(_amount(counts), len(self.thresholds) - 1)
        names = [UNKNOWN if n == 0 else self.languages[b] for b, n in zip(best, total)]
        return names, np.where(total == 0, 0.0, score), (total == 0) | (score < self.thresholds[size])


def _amount(counts: np.ndarray) -> np.ndarray:
    """floor(log2(different n-grams)) of each row: repeated words say nothing new."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(int)


def _sphere_means(v: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12, tries: int = 6,
                  least_share: float = 0.05) -> np.ndarray:
    """Spherical k-means of at most k centers that each hold ``least_share`` of the rows.

    Starts are rows drawn with weight 1 - cosine to the nearest start, so single
    odd rows seldom start a cluster; a cluster below the least share is dropped
    and its rows go to the others.  Of several tries the one with most clusters
    is taken, then the one with the largest sum of cosines."""
    best, best_key = v[:1], (-1, 0.0)
    for _ in range(tries):
        start = [int(rng.integers(len(v)))]
        while len(start) < min(k, len(v)):
            far = np.maximum(1 - (v @ v[start].T).max(axis=1).astype(float), 0)
            if far.sum() <= 1e-6:
                break
            start.append(int(rng.choice(len(v), p=far / far.sum())))
        centers = v[start]
        while True:
            for _ in range(steps):
                of = (v @ centers.T).argmax(axis=1)
                sums = np.stack([v[of == j].sum(axis=0) if (of == j).any() else centers[j] for j in range(len(centers))])
                centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            cosine = v @ centers.T
            held = np.bincount(cosine.argmax(axis=1), minlength=len(centers))
            if len(centers) == 1 or held.min() >= least_share * len(v):
                break
            centers = np.delete(centers, held.argmin(), axis=0)
        key = (len(centers), float(cosine.max(axis=1).sum()))
        if key > best_key:
            best, best_key = centers, key
    return best


def learnable(docs: DataFrame) -> DataFrame:
    """Rows with a language and a text that may be learned from."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of up to ``per_language`` rows of each language that may be learned from."""
    rows = learnable(docs).select("lang", "text", F.xxhash64("doc_id", F.lit(4)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a hash filter first, so that the ranking below sees about twice the sample and not the corpus
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * per_language / n))]) \
        if sizes else F.create_map(F.lit(""), F.lit(0.0))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) <= share[F.col("lang")] * float(1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return near.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text")


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, how many of them have an n-gram in each slot) over all of ``rows`` (text).

    Each task adds up its own counts; DIMS numbers come to the driver."""
    def count(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for p in pieces(batch.column(0)):
                total += (ngram_counts([t or "" for t in p.to_pylist()])[0] > 0).sum(axis=0)
                n += len(p)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["slot", "n"])

    got = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in got:
        out[r["slot"]] = r["n"]
    return int(out[-1]), out[:DIMS]


_SLOT = np.dtype([("slot", "<u2"), ("n", "<f4")])


def _dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        cells = np.frombuffer(r, _SLOT)
        out[i, cells["slot"]] = cells["n"]
    return out


def fit(docs: DataFrame, per_language: int = 250, clusters: int = 3, seed: int = 4) -> Model:
    """Learn from text and lang of all rows of ``docs`` (doc_id, text, lang) that may be learned from.

    The k-means of each language starts from at most ``per_language`` of its texts,
    which come to the driver as the n-gram counts that are not 0, made on the
    executors; the centroids are then the means of all texts nearest to each start.
    No labelled row: a model without languages, which rejects everything."""
    def counted(texts: pa.Array) -> pa.Array:
        out = []
        for r in ngram_counts(texts.to_pylist())[0]:
            cells = np.zeros(np.count_nonzero(r), _SLOT)
            cells["slot"] = np.flatnonzero(r)
            cells["n"] = r[cells["slot"]]
            out.append(cells.tobytes())
        return pa.array(out, pa.binary())

    sample = training_sample(docs, per_language).select("lang", text_udf(counted, "binary")("text").alias("v"))
    rows = sorted((r["lang"], bytes(r["v"])) for r in sample.collect())
    langs = np.array([lang for lang, _ in rows])
    if not rows:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(1))
    counts = _dense([v for _, v in rows])
    del rows
    n, frequency = document_frequencies(learnable(docs))
    model = Model([], np.zeros((0, DIMS), np.float32), (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    centers = []
    for lang in sorted(set(langs)):
        c = _sphere_means(model.vectors(counts[langs == lang]), clusters, rng)
        centers.append(c)
        model.languages += [str(lang)] * len(c)
    del counts
    model.centroids = np.concatenate(centers).astype(np.float32)
    model.centroids = centroid_means(learnable(docs), model)
    model.thresholds = cosine_thresholds(learnable(docs), model)
    return model


def _labelled(batch: pa.RecordBatch):
    """(texts, langs) of bounded pieces of a batch (lang, text)."""
    at = 0
    for p in pieces(batch.column("text")):
        yield p.to_pylist(), np.array(batch.column("lang").slice(at, len(p)).to_pylist())
        at += len(p)


def centroid_means(rows: DataFrame, model: Model) -> np.ndarray:
    """The means, scaled to length 1, of the texts of all ``rows`` (lang, text) nearest to each centroid of their own language.

    Each task adds up its own texts, in whole numbers of 1 / UNIT; a centroid without texts stays."""
    names = np.array(model.languages)

    def add(batches):
        total = np.zeros(model.centroids.shape, np.int64)
        for batch in batches:
            for texts, langs in _labelled(batch):
                v = model.vectors(ngram_counts(texts)[0])
                of = np.where(names[None, :] == langs[:, None], v @ model.centroids.T, -2).argmax(axis=1)
                for j in np.unique(of).tolist():
                    total[j] += np.rint(v[of == j].sum(axis=0, dtype=np.float64) * UNIT).astype(np.int64)
        j, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[j, slot])],
                                         ["j", "slot", "v"])

    # DIMS numbers a centroid come to the driver
    sums = rows.select("lang", "text").mapInArrow(add, "j int, slot int, v long").groupBy("j", "slot").agg(F.sum("v").alias("v"))
    out = np.zeros(model.centroids.shape, np.float64)
    for r in sums.collect():
        out[r["j"], r["slot"]] = r["v"]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 0, out / np.maximum(length, 1e-9), model.centroids).astype(np.float32)


def _halved(n: np.ndarray, random: np.ndarray) -> np.ndarray:
    """How many of n n-grams are left when each goes by chance: as many as ``random`` (uint64) has ones among
    min(n, 64) bits, and half of those past 64."""
    bits = np.minimum(n, 64).astype(np.uint64)
    ones = np.where(bits > 0, random >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0))
    return np.bitwise_count(ones).astype(np.int64) + np.maximum(n - 64, 0) // 2


def cut_cosines(model: Model, texts: list[str], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(amounts, cosines with the own language) of every text halved by chance again and again, as long as n-grams are left.

    Chance is a hash of the text, so that the result does not depend on where a text
    stands.  Texts that lie nearer to another language are left out (wrong labels)."""
    counts, _ = ngram_counts(texts)
    names = np.array(model.languages)
    right = names[(model.vectors(counts) @ model.centroids.T).argmax(axis=1)] == langs
    seeds = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
    # the centroids of each text's own language, over again where it has fewer than others
    own = {lang: np.flatnonzero(names == lang) for lang in set(langs[right].tolist())}
    most = max(map(len, own.values()), default=0)
    mine = np.array([np.resize(own[lang], most) if ok else np.zeros(most, int) for lang, ok in zip(langs.tolist(), right)]).reshape(-1, most)
    at = np.flatnonzero(counts != 0)
    at = at[right[at // DIMS]]
    row, slot = at // DIMS, at % DIMS
    n, step, amounts, cosines = counts[row, slot].astype(np.int64), 0, [], []
    while len(n):
        v = np.log1p(n) * model.idf[slot]
        length = np.sqrt(np.bincount(row, v * v, minlength=len(texts)))
        dots = [np.bincount(row, v * model.centroids[mine[row, k], slot], minlength=len(texts)) for k in range(most)]
        best = np.max(dots, axis=0) / np.maximum(length, 1e-9)
        different = np.bincount(row, minlength=len(texts))
        there = different > 0
        amounts.append(np.log2(different[there]).astype(int))
        cosines.append(best[there])
        h = (seeds[row] ^ (slot.astype(np.uint64) * _MIX[1])) + np.uint64((step + 1) * int(_MIX[2]) % (1 << 64))
        for _ in range(2):
            h = (h ^ (h >> np.uint64(31))) * _MIX[0]
        n, step = _halved(n, h ^ (h >> np.uint64(32))), step + 1
        row, slot, n = row[n > 0], slot[n > 0], n[n > 0]
    if not amounts:
        return np.zeros(0, int), np.zeros(0)
    return np.concatenate(amounts), np.concatenate(cosines)


def cosine_thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """Thresholds by floor(log2(different n-grams)) from all ``rows`` (lang, text): half the cosine that all but one in
    ``ODD_SHARE`` of the cut texts of that amount reach with their own language (``cut_cosines``)."""
    def count(batches):
        total = np.zeros((DIMS.bit_length(), COSINE_STEPS), np.int64)
        for batch in batches:
            for texts, langs in _labelled(batch):
                amount, cosine = cut_cosines(model, texts, langs)
                np.add.at(total, (amount, np.clip(cosine * COSINE_STEPS, 0, COSINE_STEPS - 1).astype(int)), 1)
        amount, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(amount.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(total[amount, step])],
                                         ["amount", "step", "n"])

    # at most COSINE_STEPS counts an amount come to the driver
    total = np.zeros((DIMS.bit_length(), COSINE_STEPS), np.int64)
    for r in rows.select("lang", "text").mapInArrow(count, "amount int, step int, n long").groupBy("amount", "step").agg(
            F.sum("n").alias("n")).collect():
        total[r["amount"], r["step"]] = r["n"]
    seen = np.flatnonzero(total.sum(axis=1))
    below = np.cumsum(total, axis=1) > total.sum(axis=1, keepdims=True) / ODD_SHARE
    lows = 0.5 * below.argmax(axis=1) / COSINE_STEPS
    # a longer text is never held to less than a shorter one
    return np.maximum.accumulate(lows[: seen.max() + 1]) if len(seen) else np.zeros(1)


def predict(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """Add ``column``: struct(lang_pred, score, rejected) for every whole text.

    Null and empty texts and texts without a letter: ``und``, 0, rejected.
    Rows are kept one for one (repeated rows get equal answers); an existing
    column of that name is replaced."""
    def step(texts: pa.Array) -> pa.Array:
        names, score, no = model.predict([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()),
                                           pa.array(no, pa.bool_())], ["lang_pred", "score", "rejected"])

    return docs.withColumn(column, text_udf(step, "lang_pred string, score double, rejected boolean")("text"))
