"""Importance resampling towards a target by hashed word n-grams.

Every run of 1 to n words is a feature; its bucket is the CRC-32 of its UTF-8
bytes modulo ``buckets``.  The gain of a bucket is the (scaled, floored) log of
how much more often the target has it than the pool; a document's weight is the
floored mean gain of its features, and its score adds Gumbel noise that depends
on the seed and the document's id alone.  The documents with the highest scores
are a sample without replacement, in proportion to exp(weight / 1000).

Features are found a batch at a time: the texts of a batch are joined with a
separator that is no word character, one regular expression finds all words of
the joined bytes, and ``searchsorted`` over the texts' offsets tells the text of
each word.  Runs whose first and last word lie in different texts are masked
before the buckets are counted (``bincount``).  Words are taken from the
expression in blocks, so a text of any length needs bounded memory.

Counts cover all rows of both tables; only ``buckets`` numbers of each reach the
driver.  The draw needs no sort of all documents: scores are integers from a
bounded range, so counts by score give the score at which the draw ends, and
only the documents from there on are ranked, by one range shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import pieces, text_udf
from concord.session import materialize

#: Fixed values of the draw: separator, word characters (after lower-casing A-Z), scale of gains.
SEPARATOR = b"\x00"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCALE = 1000
BUCKETS = 10_000
#: Words looked at together.
BLOCK_WORDS = 1 << 17
_PLACE_BITS = 33     # monotonically_increasing_id: partition above, place within it below


def features(texts: pa.Array, n: int, buckets: int, block: int = BLOCK_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text of each feature, bucket of each feature, words in a run) of a batch of texts, block by block."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    offsets = np.cumsum([0, *(len(t) + len(SEPARATOR) for t in raw)])
    found = WORD.finditer(SEPARATOR.join(raw).lower())
    words: list[bytes] = []                     # the last n - 1 words of the block before come first
    starts: list[int] = []
    while True:
        new = list(islice(found, block))
        if not new:
            return
        kept = len(words)
        words += [m[0] for m in new]
        starts += [m.start() for m in new]
        text = np.searchsorted(offsets, np.array(starts), side="right") - 1
        codes = list(map(crc32, words))
        for size in range(1, n + 1):
            if size > 1:                        # the CRC of a run goes on from that of the run without its last word
                codes = [crc32(w, crc32(b" ", c)) for c, w in zip(codes, words[size - 1:])]
            first = max(0, kept - size + 1)     # runs that end in the block before are counted there
            of = text[first: len(codes)]
            inside = of == text[first + size - 1: len(codes) + size - 1]
            yield of[inside], np.array(codes[first:], np.int64)[inside] % buckets, size
        words, starts = words[len(words) - n + 1:], starts[len(starts) - n + 1:]


def bucket_counts(table: DataFrame, n: int = 1, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket (null texts: none)."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                for _, bucket, _ in features(piece, n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    got = table.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


@dataclass
class Model:
    gains: np.ndarray       # of each bucket, integers
    n: int
    seed: int


def fit(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, text: str = "text") -> Model:
    """Gains of the target's buckets over those of the pool, both counted over all rows (smoothed by 1)."""
    if n < 1 or buckets < 1:
        raise ValueError("n and buckets must be at least 1")
    pool, wanted = (bucket_counts(t, n, buckets, text).tolist() for t in (docs, target))
    s_all, t_all = sum(pool), sum(wanted)
    return Model(np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + float(buckets)) / ((s + 1.0) * (t_all + float(buckets)))))
                           for s, t in zip(pool, wanted)], np.int64), n, seed)


def noise(doc_id: str, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id; a null id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(2.0 ** 32)))).cast("bigint")


def score(docs: DataFrame, model: Model, column: str = "importance", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``column``: struct(n_features, n_words, weight, score) of every whole text.

    Null texts, empty ones and texts without a word: no feature, weight 0.  Rows
    are kept one for one (repeated rows get equal answers); an existing column of
    that name is replaced."""
    def step(texts: pa.Array) -> pa.Array:
        rows = len(texts)
        n_words, n_features, gain = (np.zeros(rows, np.int64) for _ in range(3))
        for of, bucket, size in features(texts, model.n, len(model.gains)):
            here = np.bincount(of, minlength=rows)
            n_features += here
            if size == 1:
                n_words += here
            # float64 sums of a block are exact: 2^17 features of gains below 2^16
            gain += np.bincount(of, weights=model.gains[bucket], minlength=rows).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(n_features), pa.array(n_words), pa.array(gain // np.maximum(n_features, 1))],
                                          ["n_features", "n_words", "weight"])

    done = docs.withColumn(column, text_udf(step, "n_features long, n_words long, weight long")(text))
    return done.withColumn(column, F.col(column).withField("score", F.col(column)["weight"] + noise(doc_id, model.seed)))


def _rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``rank`` (1, 2, ... by ``order``) to rows of a written table.

    Rows equal in ``order`` follow their place in the table's files, so that any
    group of equal rows can be cut into several ranges."""
    placed = rows.select("*", F.xxhash64(F.col("_metadata.file_name")).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    by = [*order, F.col("__file"), F.col("__row")]
    ranged = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("__file", "__row")
    # written: the ranges are drawn from a sample and would differ if they were computed again
    laid = materialize(ranged.withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", _PLACE_BITS)
    sizes = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()       # one row a range
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((r["part"], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__part bigint, __offset bigint")
    place = F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (laid.withColumn("__part", part).join(F.broadcast(table), "__part")
            .withColumn("rank", F.col("__offset") + place + F.lit(1)).drop("__place", "__part", "__offset"))


def draw(docs: DataFrame, model: Model, percent: int = 10, least_words: int = 20, keep: tuple[str, ...] = ("doc_id",),
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with n_features, n_words, weight, score and rank.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100)
    with the highest scores have ranks 1, 2, ...; all others have null.  Equal
    scores go to the smaller id (null ids first), equal ids in any order: repeated
    rows are rows of their own.  An empty table stays empty.  ``keep`` is written
    and, for rows that are drawn, shuffled: name texts there only if they are wanted."""
    names = ["n_features", "n_words", "weight", "score", "rank"]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns {sorted(clash)} exist already; rename them first")
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    own = score(docs, model, "__importance", doc_id, text)
    key = [] if doc_id in keep else [F.col(doc_id)]
    scored = materialize(own.select(*keep, *key, *[F.col("__importance")[c].alias(c) for c in names[:4]]), "scored")
    enough = F.col("n_words") >= least_words
    # scores lie within about 10^5 of each other: gains are logs of 64-bit counts, the noise of 32-bit fractions
    sizes = scored.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = percent * sum(r["n"] for r in sizes) // 100
    least, above = None, 0
    for r in sorted(sizes, key=lambda r: -r["score"]):
        if above >= wanted:
            break
        least, above = r["score"], above + r["n"]
    none = F.lit(None).cast("bigint").alias("rank")
    out = [*keep, *names]
    if least is None:
        return scored.select("*", none).select(*out)
    near = enough & (F.col("score") >= least)
    ranked = _rank(scored.where(near), [F.col("score").desc(), F.col(doc_id).asc_nulls_first()])
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.select(*out).unionByName(scored.where(~near).select("*", none).select(*out))
