"""Vector compression to short codes: product quantisation with integer
codebooks, nearest entries found by LAESA.

A vector's components become integers (``floor(scale * x)``) and the vector is
cut into equal parts.  Each part position has a codebook, at first that part of
the vectors with the smallest ids.  A round assigns every part to its nearest
entry and replaces each entry by the floored mean of its parts.

Nearest entries are exact, in integers, yet most entries are never measured.
The distances of each part to a few fixed pivots (far-apart entries of the first
codebook) are computed once and written beside the vector.  In a round the
pivots' distances to the entries are computed once for a codebook, and by the
triangle inequality ``|d(part, pivot) - d(entry, pivot)|`` is a lower bound of
the distance of part and entry.  Entries are evaluated in the order of their
bounds (the largest over the pivots); an entry whose bound lies above the best
distance so far cannot win and is left out.

The vectors stay in a written table, read once a round by Arrow batches; each
task adds up its own parts, so a round shuffles at most ``entries * dimensions``
numbers a task.  Codebooks (``entries * dimensions`` integers, whatever the
number of vectors) travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.session import materialize

#: Fixed values of the codes: integer scale, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
PIVOTS = 8
#: Largest component (before scaling) for which distances stay exact in 64 bits.
LARGEST = 1 << 17
#: Vectors whose bounds are held at once, pairs measured at once, share of a slice's pairs from which a product measures them.
SLICE, PAIRS, MANY = 1024, 1 << 16, 0.05
_CLOSE = np.float32(2.0 ** -22)      # covers the rounding of distances to float32
#: Copies of a label's sum, so that the rows of one label are joined in as many tasks.
SALTS = 64


@dataclass
class Codebooks:
    """``entries[part]`` [entries, dimensions of a part] and ``pivots[part]`` [pivots, dimensions of a part], int64."""
    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def digest(self) -> str:
        """sha256 of all integer components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def _far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different entries, each the farthest from those before (ties: the first)."""
    chosen, near = [0], _square(entries, entries[:1])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _square(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances [x, y], exact; one column at a time, so that no [x, y, dimensions] array is made."""
    out = np.empty((len(x), len(y)), np.int64)
    for j, row in enumerate(y):
        diff = x - row
        out[:, j] = (diff * diff).sum(axis=1)
    return out


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(_square(x, pivots).astype(np.float64)).astype(np.float32)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance) of each row of ``x``, ties to the lower index, and how many pairs were measured.

    ``to_pivots`` and ``entry_pivots`` are float32 distances of the rows and of the
    entries to the same pivots.  Rows are taken in slices that share a nearest
    pivot.  The entry with the least bound is measured first; entries whose bounds
    lie above that distance are out.  Where many are left, the entries that some
    row of the slice still needs are measured for the slice in one matrix product
    (of integers below 2^53 in float64, so exactly), else pair by pair."""
    n, m = len(x), len(entries)
    which, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return which, best, 0
    span = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    product = 4 * span * span * max(x.shape[1], 1) < 2 ** 53
    if product:
        xf, ef = x.astype(np.float64), np.ascontiguousarray(entries.T.astype(np.float64))
        xx, ee = (xf * xf).sum(axis=1), (ef * ef).sum(axis=0)
    slack = (to_pivots.max(initial=0) + entry_pivots.max(initial=0)) * _CLOSE
    measured = n
    order = np.argsort(to_pivots.argmin(axis=1), kind="stable")

    def evaluate(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        diff = x[r] - entries[c]
        return (diff * diff).sum(axis=1)

    for lo in range(0, n, SLICE):
        rows = order[lo: lo + SLICE]
        bound = np.zeros((len(rows), m), np.float32)
        near = to_pivots[rows]
        for j in range(near.shape[1]):
            np.maximum(bound, np.abs(near[:, j, None] - entry_pivots[None, :, j]), out=bound)
        at = bound.argmin(axis=1)                          # the entry with the least bound comes first
        d = evaluate(rows, at)
        left = bound <= _root(d, slack)[:, None]           # what that distance does not rule out, itself included
        if product and np.count_nonzero(left) > MANY * left.size:
            c = np.flatnonzero(left.any(axis=0))
            square = ee[c] - 2 * (xf[rows] @ ef[:, c])     # but for the row's own square
            measured += square.size
            least = square.argmin(axis=1)
            which[rows], best[rows] = c[least], (square[np.arange(len(rows)), least] + xx[rows]).astype(np.int64)
            continue
        left[np.arange(len(rows)), at] = False
        r, c = np.nonzero(left)                            # by rows and rising index
        measured += len(r)
        for k in range(0, len(r), PAIRS):
            rk, ck = r[k: k + PAIRS], c[k: k + PAIRS]
            new = evaluate(rows[rk], ck)
            heads = np.flatnonzero(np.concatenate([[True], rk[1:] != rk[:-1]]))
            least = np.minimum.reduceat(new, heads)
            hit = np.flatnonzero(new == np.repeat(least, np.diff(np.append(heads, len(rk)))))
            row, first = np.unique(rk[hit], return_index=True)
            c1, d1 = ck[hit[first]], new[hit[first]]
            wins = (d1 < d[row]) | ((d1 == d[row]) & (c1 < at[row]))
            d[row[wins]], at[row[wins]] = d1[wins], c1[wins]
        which[rows], best[rows] = at, d
    return which, best, measured


def _root(squares: np.ndarray, slack: float) -> np.ndarray:
    """Distances rounded up, so that no bound above them can belong to a winner."""
    return (np.sqrt(squares.astype(np.float64)) * (1 + 2.0 ** -20) + 2 * slack + 1e-6).astype(np.float32)


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v array<bigint>) of the rows whose vector is whole: not null, no null, NaN or infinite component.

    A component beyond 2^17 in magnitude raises: squared distances would no longer be exact."""
    x = F.col(vector)
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.when(F.abs(e) <= LARGEST, F.floor(F.lit(float(scale)) * e.cast("double")))
                    .otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}: rescale the vectors")).cast("bigint")))
    return table.where(whole).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _assigned(batch: pa.RecordBatch, books: Codebooks, to_entries: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its integers, nearest entries, squared distances) of a batch with columns v and d."""
    v, d = _matrix(batch.column("v"), np.int64), _matrix(batch.column("d"), np.float32)
    place = 0
    for part, (entries, near) in enumerate(zip(books.entries, to_entries)):
        x = v[:, part * books.width: (part + 1) * books.width]
        p = len(books.pivots[part])
        which, square, _ = nearest(x, d[:, place: place + p], entries, near)
        place += p
        yield part, x, which, square


def _start(kept: DataFrame, parts: int, entries: int, pivots: int) -> Codebooks:
    """Codebooks of the ``entries`` smallest ids (null ids last, equal ids by their vectors)."""
    first = [r["v"] for r in kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return Codebooks([], [])
    if len({len(v) for v in first}) > 1 or len(first[0]) % parts:
        raise ValueError(f"vectors must have one length that {parts} divides; found {sorted({len(v) for v in first})}")
    whole = np.array(first, np.int64).reshape(len(first), parts, -1)
    books = [np.ascontiguousarray(whole[:, p]) for p in range(parts)]
    return Codebooks(books, [_far_apart(b, pivots) for b in books])


def _entry_distances(books: Codebooks) -> list[np.ndarray]:
    return [pivot_distances(e, p) for e, p in zip(books.entries, books.pivots)]


def _train(laid: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    for _ in range(rounds):
        def add(batches, books=books, near=_entry_distances(books)):
            shape = (len(books.entries), len(books.entries[0]))
            n, s = np.zeros(shape, np.int64), np.zeros((*shape, books.width), np.int64)
            for batch in batches:
                for part, x, which, _ in _assigned(batch, books, near):
                    order = np.argsort(which, kind="stable")
                    used, heads = np.unique(which[order], return_index=True)
                    n[part, used] += np.diff(np.append(heads, len(which)))
                    s[part, used] += np.add.reduceat(x[order], heads, axis=0) if len(heads) else 0
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
                                              pa.array(list(s[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

        sums = laid.select("v", "d").mapInArrow(add, "part int, entry int, n long, s array<long>")
        total = (sums.select("part", "entry", "n", F.posexplode("s").alias("place", "s"))
                 .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
        entries = [e.copy() for e in books.entries]            # an entry without parts stays
        for r in total.collect():
            entries[r["part"]][r["entry"], r["place"]] = r["s"] // r["n"]
        books = Codebooks(entries, books.pivots)
    return books


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every whole vector, as a written table, and the codebooks.

    ``code`` has the index of the nearest entry in hexadecimal for each part (two
    digits for up to 256 entries), ``error`` the squared distances summed over the
    parts.  Rows with a null vector or null, NaN or infinite components are
    dropped; other rows are kept one for one, repeated ones and null ids and
    labels too.  Vectors must have one length that ``parts`` divides.  Fewer rows
    than entries: codebooks of as many entries.  An empty table stays empty (with
    codebooks of no entry)."""
    if not (1 <= parts and 1 <= entries and 1 <= pivots and 0 <= rounds):
        raise ValueError("parts, entries and pivots must be at least 1")
    kept = integer_vectors(table, vec_id, vector, label, scale)
    books = _start(kept, parts, entries, pivots)
    digits = max(2, len(f"{entries - 1:x}"))
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.entries:
        return table.sparkSession.createDataFrame([], schema), books
    dimensions = parts * books.width

    @F.arrow_udf("array<float>")
    def to_pivots(vectors: pa.Array) -> pa.Array:
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes != dimensions).any():
            raise ValueError(f"vectors must have one length: {dimensions} and {int(sizes[sizes != dimensions][0])} found")
        v = _matrix(vectors, np.int64)
        d = np.concatenate([pivot_distances(v[:, p * books.width: (p + 1) * books.width], books.pivots[p]) for p in range(parts)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))

    laid = materialize(kept.withColumn("d", to_pivots("v")), "vector-parts")
    books = _train(laid, books, rounds)
    near = _entry_distances(books)
    names = np.array([f"{i:0{digits}x}" for i in range(entries)])

    def code(batches):
        for batch in batches:
            codes, error = np.full(len(batch), "", dtype=object), np.zeros(len(batch), np.int64)
            for _, _, which, square in _assigned(batch, books, near):
                codes = codes + names[which].astype(object)
                error += square
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    return materialize(laid.mapInArrow(code, schema), "vector-codes"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors summed over the rows of the same label (null labels together).

    ``coded`` is a written table.  The sums are added up before they are shuffled
    and joined back with a salt from the rows' places in the files, so that the
    rows of one label, however many, are dealt to ``SALTS`` tasks."""
    sums = coded.groupBy("label").agg(F.sum("error").cast("bigint").alias("label_error"))
    copies = sums.select(F.col("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__copy"))
    salted = coded.select("*", F.pmod(F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")), F.lit(SALTS)).cast("int").alias("__salt"))
    on = F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__copy"))
    return salted.join(copies, on).drop("__label", "__copy", "__salt")


def decode(coded: DataFrame, books: Codebooks, column: str = "v", scale: int = SCALE) -> DataFrame:
    """Add ``column``: the vector that a code stands for (entries of its parts, divided by ``scale``)."""
    digits = max(2, len(f"{max(len(books.entries[0]) - 1, 0):x}")) if books.entries else 2

    @F.arrow_udf("array<double>")
    def run(codes: pa.Array) -> pa.Array:
        rows = [np.concatenate([e[int(c[p * digits: (p + 1) * digits], 16)] for p, e in enumerate(books.entries)]) / scale
                for c in codes.to_pylist()]
        return pa.array(rows, pa.list_(pa.float64()))

    return coded.withColumn(column, run("code"))
