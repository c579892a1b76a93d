"""Small helpers shared by the text operators: Arrow batches cut into bounded
pieces, code points and bytes of whole texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Bytes of text a numpy step looks at together (a longer text is a piece of its own).
PIECE_BYTES = 1 << 20
#: Rows it looks at together, however short.
PIECE_ROWS = 512
#: Modulus and remainder of the rows that no model may learn from.
HELD_OUT_MOD, HELD_OUT_REMAINDER = 3, 1


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that models may not learn from (a null id counts as empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(text) % HELD_OUT_MOD) == HELD_OUT_REMAINDER


def pieces(texts: pa.Array, most: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.Array]:
    """Cut an array of texts so that a piece has about ``most`` bytes and at most ``rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield texts.slice(start)


def text_udf(step: Callable[[pa.Array], pa.Array], schema: str):
    """An Arrow UDF over a text column; ``step`` maps a bounded piece of the
    column to an array of as many values of type ``schema``.

    Only the text goes to the Python worker; the row's other columns stay in the JVM."""
    kind = to_arrow_type(_parse_datatype_string(schema))

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [step(p).cast(kind) for p in pieces(texts)]
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    return run


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in one array, offsets); a null text is empty."""
    filled = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset: filled.offset + len(filled) + 1]
    if not len(offsets) or filled.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(filled.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


#: Bytes that one vote of ``range_cuts`` stands for.
VOTE_BYTES = 1 << 10


def range_cuts(docs: DataFrame, ranges: int, size: Column | None = None) -> np.ndarray:
    """At most ranges - 1 ids that occur in ``doc_id`` and cut it into ranges of about as many
    rows, or as much ``size``: a row votes once for each ``VOTE_BYTES`` of it, the rest by its hash."""
    if ranges < 2:
        return np.zeros(0, np.int64)
    if size is not None:
        votes = F.floor((size + F.pmod(F.xxhash64("doc_id", size), F.lit(VOTE_BYTES))) / VOTE_BYTES).cast("int")
        docs = docs.select("doc_id", votes.alias("votes")).where("votes > 0").select(
            "doc_id", F.explode(F.sequence(F.lit(1), "votes")))
    shares = [k / ranges for k in range(1, ranges)]
    got = docs.agg(F.percentile_approx("doc_id", shares, 100 * ranges).alias("q")).head()["q"] or []
    return np.array(sorted({i for i in got if i is not None}), np.int64)


def range_udf(cuts: np.ndarray):
    """Arrow UDF id -> number of its range: range k holds the ids over cuts[k - 1] up to cuts[k]; a null id: 0."""
    @F.arrow_udf("int")
    def run(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(cuts, known, side="left").astype(np.int32))

    return run
