"""Consensus clustering: repeated subsample fits, pair co-clustering ratios and
their ten-bin histogram, computed without an N x N table.

Assignments ``(run, point_id, cluster)`` are folded per point into bit masks:
``smask`` (runs the point was sampled in) and ``m_j`` (runs it sat in cluster
j), one bigint word per 63 runs.  For two points a, b

    s = popcount(a.smask & b.smask)              times co-sampled
    c = sum_j popcount(a.m_j & b.m_j)            times co-clustered

and their bin is ``least(9, 10c div s)`` (0 when s = 0).

The histogram is over all N(N-1) ordered point pairs, so its cost is pairwise
by definition; the plan keeps that cost as small and as evenly spread as it
can, and never materialises pairs:

* Points with equal masks are interchangeable, so they collapse into weighted
  *signatures* (one row, weight w).  A group of identical points, however
  large, is one row -- this is where hot keys disappear.
* Signature pairs are enumerated once each, in a triangular block layout:
  signatures are cut into nb ranges by their cluster masks and tile (i <= j) is
  the grouping key, so a task holds at most about 2 x ``block_rows``
  signatures, whatever N.  nb follows from M alone.  A tile whose two blocks
  have no (run, cluster) in common has only pairs that never sat together: it
  is not computed, its pairs are in bin 0.
  Spark shuffles the tiles; inside a task a small numpy kernel folds the
  tile's pairs into ten bin counts (``engine="sql"`` does the same with a
  shuffled hash join and built-in bit functions).  Pairs never become rows.
* Pairs involving points never sampled (no assignment rows) are all in bin 0
  and are counted by difference from the known total N(N-1) (R N(N-1) for the
  cumulative form).  As a difference would hide wrong input, assignments are
  checked where the masks are built: run and cluster ids in range, one cluster
  for a point in a run, and no more points than N.  Counts are decimal(38, 0).

Work is M(M+1)/2 signature pairs for M signatures; M depends on how stable the
clustering is (a stable one has few), not only on N.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.masks import RunWords, popcount
from concord.functions.ratio import N_BINS, consensus_ratio, ratio_bin
from concord.functions.sampling import in_sample
from concord.operators.bisecting import bisecting_assignments
from concord.operators.blocks import point_blocks, sampled_points
from concord.operators.gaussian import gaussian_assignments
from concord.operators.kmeans import kmeans_assignments
from concord.operators.layout import fixed_layout
from concord.session import materialize

MODES = ("final", "cumulative")
_COUNT = "decimal(38,0)"
#: Fits that run at once; a parameter of the fits.
PARALLEL_FITS = 16
#: Signatures in a block of the pair space: at least and, from a million signatures on, at most.
BLOCK_ROWS = 2048
MOST_BLOCK_ROWS = 16384
#: Pair cells that a tile's kernel holds at once (few enough for a core's cache when only the last run is counted),
#: tiles in a task, and tasks beyond which a task takes more tiles.
TILE_CELLS = 256 * BLOCK_ROWS
CACHE_CELLS = 1 << 16
TILES_PER_TASK = 2
MOST_TILE_TASKS = 16384


# --------------------------------------------------------------------------- K1

#: MLlib's algorithms, made or at least labelled for all runs together; the longest start first.
_TOGETHER = {"gmm": gaussian_assignments, "bisecting": bisecting_assignments, "kmeans": kmeans_assignments}

Clusterer = Callable[[DataFrame, int, int, int], DataFrame]
"""Plug-in fit: (sampled points(point_id, features), k, max_iter, seed) -> (point_id, cluster)."""


def mllib_assignments_many(points: DataFrame, algorithms: list, k: int = 5, max_iter: int = 125,
                           seed: int = 1, runs: int = 20, sample_seed: int = 1, fraction: float = 0.9,
                           parallel_fits: int = PARALLEL_FITS, partitions: int | None = None) -> dict:
    """R subsample fits per algorithm -> {algorithm: assignments(run, point_id, cluster)}.

    ``points`` needs ``point_id`` and ``x`` (array<double>) or ``features``
    (vector).  The points are laid out once; every (algorithm, run) fit is
    submitted to one driver thread pool of ``parallel_fits`` (each fit caches its
    own 90 % sample: use fewer where these do not fit in memory together), so
    the cluster works on several fits at once.  Each run reads the fixed layout through the hash filter, so a run
    is the same rows however often it is evaluated.  The bisecting fits, whose
    updates MLlib never ends early, and the mixtures, whose steps are the most
    work, are each made together (``bisecting_assignments``, ``gaussian_assignments``:
    MLlib's rules, one pass for all runs); k-means is fitted by MLlib and labelled in
    one pass (``kmeans_assignments``).  Each algorithm's assignments are
    written once to the shared folder.
    """
    from pyspark.ml.functions import array_to_vector

    if k < 2:
        raise ValueError("k must be at least 2")
    if "features" not in points.columns:
        points = points.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    laid = fixed_layout(points.select("point_id", "features"), partitions)
    fits = {(a if isinstance(a, str) else getattr(a, "__name__", "custom")):
            (a if callable(a) else _TOGETHER[a]) for a in algorithms}
    together = [name for name in _TOGETHER if name in algorithms]

    def one(job) -> DataFrame:
        name, run = job
        sample = laid.where(in_sample(sample_seed, run, "point_id", fraction))
        return fits[name](sample, k, max_iter, seed).select(
            F.lit(run).cast("int").alias("run"), "point_id", F.col("cluster").cast("int").alias("cluster"))

    jobs = [(name, r) for name in fits if name not in together for r in range(runs)]
    sampled = None
    if together:
        base = sampled_points(laid, runs, sample_seed, fraction)
        sampled = base, point_blocks(base, runs)
    with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
        of_all = {name: pool.submit(fits[name], laid, k, max_iter, seed, runs, sample_seed, fraction, sampled, parallel_fits)
                  for name in together}
        done = dict(zip(jobs, pool.map(one, jobs)))
    out = {}
    for name in fits:
        if name in together:
            out[name] = of_all[name].result()
            continue
        per_run = [done[(name, r)] for r in range(runs)]
        u = per_run[0]
        for df in per_run[1:]:
            u = u.unionByName(df)
        out[name] = materialize(u, f"assignments-{name}")
    return out


def mllib_assignments(points: DataFrame, algorithm: str | Clusterer, k: int = 5,
                      max_iter: int = 125, seed: int = 1, runs: int = 20,
                      sample_seed: int = 1, fraction: float = 0.9,
                      parallel_fits: int = PARALLEL_FITS, partitions: int | None = None) -> DataFrame:
    """K1 for one algorithm (MLlib name or a ``Clusterer``)."""
    res = mllib_assignments_many(points, [algorithm], k, max_iter, seed, runs, sample_seed, fraction,
                                 parallel_fits, partitions)
    return next(iter(res.values()))


# --------------------------------------------------------------------- masks

def mask_columns(k: int, words: RunWords) -> list[str]:
    """smask_w (runs sampled) then m{j}_w (runs in cluster j), for every word w."""
    return words.names("smask") + [c for j in range(k) for c in words.names(f"m{j}")]


def point_masks(assignments: DataFrame, k: int, runs: int, word_bits: int = 63) -> DataFrame:
    """assignments -> (point_id, smask_w, m{j}_w); one shuffle by point."""
    words = RunWords(runs, word_bits)
    bit, word = words.bit_of("run"), words.word_of("run")
    zero = F.lit(0).cast("bigint")
    aggs = []
    for w in range(words.n):
        here = word == w
        aggs.append(F.bit_or(F.when(here, bit).otherwise(zero)).alias(f"smask_{w}"))
        for j in range(k):
            aggs.append(F.bit_or(F.when(here & (F.col("cluster") == j), bit).otherwise(zero)).alias(f"m{j}_{w}"))
    good = (F.col("cluster").between(0, k - 1) & F.col("run").between(0, runs - 1) & F.col("point_id").isNotNull())
    bad = F.sum(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1))
    return assignments.groupBy("point_id").agg(*aggs, bad.alias("out_of_range"), F.count(F.lit(1)).alias("rows"))


def signatures(assignments: DataFrame, k: int, runs: int, word_bits: int = 63) -> DataFrame:
    """Distinct mask tuples with their point count ``w``, and how many of their
    assignment rows are ``out_of_range`` or ``repeated`` (a second row of a point in a run)."""
    words = RunWords(runs, word_bits)
    sampled = None
    for c in words.names("smask"):
        sampled = popcount(c) if sampled is None else sampled + popcount(c)
    return point_masks(assignments, k, runs, word_bits).groupBy(*mask_columns(k, words)).agg(
        F.count(F.lit(1)).alias("w"), F.sum("out_of_range").alias("out_of_range"),
        F.sum(F.col("rows") - sampled).alias("repeated"))


def _check(sigs: DataFrame, n_points: int) -> int:
    """Raise on wrong assignments; the number of signatures otherwise."""
    r = sigs.agg(F.count(F.lit(1)).alias("m"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                                                 for c in ("w", "out_of_range", "repeated")]).head()
    if r["out_of_range"]:
        raise ValueError(f"{r['out_of_range']} assignment rows have a run or cluster out of range, or no point id")
    if r["repeated"]:
        raise ValueError(f"{r['repeated']} assignment rows repeat a (run, point): a point has one cluster in a run")
    if r["w"] > n_points:
        raise ValueError(f"assignments of {r['w']} points, but n_points is {n_points}")
    return r["m"]


def _blocked(sigs: DataFrame, cols: list[str], nb: int) -> DataFrame:
    """Signatures with their block ``t``: nb ranges in the order of the cluster
    masks, so that a block's members share clusters; written, as the ranges are
    drawn from a sample."""
    order = [c for c in cols if not c.startswith("smask")]
    ranged = sigs.repartitionByRange(nb, *order) if nb > 1 else sigs.coalesce(1)
    return materialize(ranged.select(*cols, "w", "sid", F.spark_partition_id().alias("t")), "signature-blocks")


def _tile_list(blocked: DataFrame, cols: list[str], nb: int, skip: bool) -> DataFrame:
    """(ba, bb), ba <= bb: the tiles to compute.  With ``skip`` only those whose
    blocks have some (run, cluster) in common; the OR of a block's masks shows it."""
    masks = [c for c in cols if not c.startswith("smask")]
    ors = blocked.groupBy("t").agg(*[F.bit_or(c).alias(c) for c in masks])
    left = ors.select(F.col("t").alias("ba"), *[F.col(c).alias(f"a_{c}") for c in masks],
                      F.explode(F.sequence(F.col("t"), F.lit(nb - 1))).alias("bb"))
    right = ors.select(F.col("t").alias("bb"), *[F.col(c).alias(f"b_{c}") for c in masks])
    shared = F.lit(not skip)
    for c in masks:
        shared = shared | (F.col(f"a_{c}").bitwiseAND(F.col(f"b_{c}")) != 0)
    return left.join(right, "bb").where(shared).select("ba", "bb")


def block_count(m: int, block_rows: int | None = None) -> int:
    """Blocks of M signatures; blocks grow with M up to MOST_BLOCK_ROWS, so that a signature's copies grow slowly."""
    if block_rows is None:
        block_rows = min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, -(-m // 64)))
    return max(1, -(-m // block_rows))


def _tiles(blocked: DataFrame, cols: list[str], kept: DataFrame, nb: int) -> DataFrame:
    """Copy each signature into the tiles of ``kept`` (ba, bb) it belongs to.

    Tile (i, j), i <= j, pairs block i (side 0) with block j (side 1).  A
    signature lands in nb + 1 tiles at most, so the copies do not depend on the
    number of cores."""
    keep = ["t", "sid", "w"] + cols
    left = blocked.join(kept, F.col("t") == F.col("ba")).select(*keep, F.lit(0).alias("side"), "ba", "bb")
    right = blocked.join(kept, F.col("t") == F.col("bb")).select(*keep, F.lit(1).alias("side"), "ba", "bb")
    # tiles are few bytes but heavy work: their partitions are fixed (AQE would
    # coalesce such a small shuffle into one task) at a few tiles each
    tasks = min(MOST_TILE_TASKS, -(-nb * (nb + 1) // 2 // TILES_PER_TASK))
    return left.unionByName(right).repartition(max(1, tasks), "ba", "bb")


def _tile_kernel(k: int, words: RunWords, by_run: bool = False):
    """Histogram of one tile with numpy: every (a in block i, b in block j)
    pair once (on the diagonal tile only sid_a <= sid_b), ordered-pair
    weights w_a w_b (both orders) or w (w - 1) for a signature with itself.
    Rows (ba, bb, run, bin, n): run = R, the histogram after all runs, or with
    ``by_run`` those after the first 1, 2, ... R runs, for which the pair
    counters go on from run to run.  Takes as many rows of side 0 at a time as
    ``TILE_CELLS`` (``CACHE_CELLS``) allow, so memory does not depend on the tile."""
    import numpy as np
    import pandas as pd

    nw, runs = words.n, words.runs

    def u64(series):
        return series.to_numpy(dtype=np.int64).view(np.uint64)

    side = runs + 1
    # bin of every (c, s) cell, c <= s <= R: cells are counted first, binned once per tile
    cell_bin = np.array([0 if sv == 0 else min(N_BINS - 1, (10 * cv) // sv)
                         for cv in range(side) for sv in range(side)])
    small = np.uint8 if side <= 256 else np.int32
    cell = np.uint16 if side * side <= 2 ** 16 else np.int64

    def add(cells, code, w):
        # exact integer sums per cell: a float64 bincount is exact while every
        # partial sum stays below 2^53; otherwise add 21-bit limbs separately
        code = code.ravel()
        if w is None:                                              # all pairs weigh 2
            part = 2 * np.bincount(code, minlength=side * side)
            for c in np.flatnonzero(part).tolist():
                cells[c] += int(part[c])
            return
        w = w.ravel()
        top = int(w.max(initial=0))
        for shift in ((0,) if top * w.size < 2 ** 53 else range(0, top.bit_length(), 21)):
            limb = w if top * w.size < 2 ** 53 else (w >> shift) & ((1 << 21) - 1)
            part = np.bincount(code, weights=limb.astype(np.float64), minlength=side * side)
            for c in np.flatnonzero(part).tolist():
                cells[c] += int(part[c]) << shift

    def labels(part, missing):
        """Cluster of each signature in each run [runs, signatures]; ``missing`` where it was not sampled."""
        out = np.full((runs, len(part)), missing, np.int32)
        for r in range(runs):
            w, bit = r // words.bits, np.uint64(r % words.bits)
            for j in range(k):
                out[r, (u64(part[f"m{j}_{w}"]) >> bit & np.uint64(1)).astype(bool)] = j
        return out

    def packed(part, turn):
        """Per word: the sampled runs, and the cluster masks, as many in a bigint as it has room for; columns if ``turn``.
        Masks of two signatures that share a bigint keep to their own bits, and as a point has one cluster in a run,
        those of different bigints have no bit in common either: their ANDs can be OR-ed before counting."""
        out = []
        for w in range(nw):
            n = words.word_runs(w)[1]
            per = 64 // n
            groups = [np.bitwise_or.reduce([u64(part[f"m{j}_{w}"]) << np.uint64(n * (j - lo)) for j in range(lo, min(k, lo + per))])
                      for lo in range(0, k, per)]
            out.append([(x[:, None] if turn else x[None, :]) for x in (u64(part[f"smask_{w}"]), *groups)])
        return out

    def last_cells(left, right, cells):
        """Ordered pairs after the last run: off the diagonal both orders of a pair at once, on it the whole
        square of the block less each point with itself."""
        own = left["ba"].iloc[0] == left["bb"].iloc[0]
        times = 1 if own else 2
        lw, rw = (part["w"].to_numpy(dtype=np.int64) for part in (left, right))
        single = int(lw.max()) == 1 and int(rw.max()) == 1
        exact = int(lw.max()) * int(rw.max()) * CACHE_CELLS < 2 ** 53 and len(right) <= CACHE_CELLS
        a, b = packed(left, True), packed(right, False)
        lf, rf = lw.astype(np.float64)[:, None], rw.astype(np.float64)[None, :]
        chunk = max(1, CACHE_CELLS // len(right))
        for lo in range(0, len(left), chunk):
            code = 0
            for (sa, *ga), (sb, *gb) in zip(a, b):
                same = ga[0][lo:lo + chunk] & gb[0]
                for x, y in zip(ga[1:], gb[1:]):
                    same |= x[lo:lo + chunk] & y
                part = np.bitwise_count(same).astype(np.intp)
                part *= side
                part += np.bitwise_count(sa[lo:lo + chunk] & sb)
                code = code + part if nw > 1 else part
            if single:
                found = np.bincount(code.ravel(), minlength=side * side)
            elif exact:                                            # sums stay below 2^53
                found = np.bincount(code.ravel(), weights=(lf[lo:lo + chunk] * rf).ravel(), minlength=side * side)
            else:
                # a weight past that is added in its own digits
                add(cells, code, times * lw[lo:lo + chunk, None].astype(object) * rw.astype(object)[None, :])
                continue
            for c in np.flatnonzero(found).tolist():
                cells[c] += times * int(found[c])
        if own:
            alone = sum(np.bitwise_count(x[0][:, 0]).astype(np.intp) for x in a) * (side + 1)
            for c, w in zip(alone.tolist(), lw.tolist()):
                cells[c] -= w

    def cells_by_run(left, right, cells):
        # products of two weights past 2^62 are done in Python integers
        top = max(int(left["w"].max()), int(right["w"].max()))
        kind = object if 2 * top ** 2 >= 2 ** 62 else np.int64
        # every pair of two different blocks of single points weighs 2
        equal = top == 1 and left["ba"].iloc[0] != left["bb"].iloc[0]
        rt, rsid = right["t"].to_numpy()[None, :], right["sid"].to_numpy()[None, :]
        rw = right["w"].to_numpy(dtype=np.int64).astype(kind)[None, :]
        rl = labels(right, -2)
        chunk = max(1, TILE_CELLS // len(right))
        for lo in range(0, len(left), chunk):
            part = left.iloc[lo:lo + chunk]
            wt = None
            if not equal:
                lt, lsid = part["t"].to_numpy()[:, None], part["sid"].to_numpy()[:, None]
                lw = part["w"].to_numpy(dtype=np.int64).astype(kind)[:, None]
                keep = (lt < rt) | (lsid <= rsid)
                wt = np.where(lsid == rsid, lw * (lw - 1), 2 * lw * rw) * keep
            ll = labels(part, -1)
            c = np.zeros((len(part), len(right)), small)
            s = np.zeros_like(c)
            for r in range(runs):                                  # the counters of run r - 1 go on
                c += ll[r][:, None] == rl[r][None, :]
                s += (ll[r] >= 0)[:, None] & (rl[r] >= 0)[None, :]
                add(cells[r], c.astype(cell) * cell(side) + s, wt)

    def kernel(pdf: "pd.DataFrame") -> "pd.DataFrame":
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        cells = {r: [0] * (side * side) for r in (range(runs) if by_run else (runs - 1,))}
        if len(left) and len(right):
            if by_run:
                cells_by_run(left, right, cells)
            else:
                last_cells(left, right, cells[runs - 1])
        out: dict[str, list] = {"ba": [], "bb": [], "run": [], "bin": [], "n": []}
        for r, counted in cells.items():
            bins = [0] * N_BINS
            for c, x in enumerate(counted):
                bins[cell_bin[c]] += x
            for name, values in zip(out, ([int(pdf["ba"].iloc[0])] * N_BINS, [int(pdf["bb"].iloc[0])] * N_BINS, [r + 1] * N_BINS,
                                          range(N_BINS), [Decimal(x) for x in bins])):
                out[name] += values
        return pd.DataFrame(out)

    return kernel


def _tile_histograms(tiles: DataFrame, k: int, words: RunWords, by_run: bool = False) -> DataFrame:
    """(ba, bb, run, bin, n) of every tile."""
    return tiles.groupBy("ba", "bb").applyInPandas(_tile_kernel(k, words, by_run), f"ba int, bb int, run int, bin int, n {_COUNT}")


def _tile_pairs_sql(tiles: DataFrame, cols: list[str]) -> DataFrame:
    """The same tiles joined with built-in operators (no Python): one row per
    signature pair, for engines without Arrow or for checking the kernel."""
    keep = ["t", "sid", "w"] + cols
    a = tiles.where("side = 0").select("ba", "bb", *[F.col(c).alias(f"a_{c}") for c in keep])
    b = tiles.where("side = 1").select(F.col("ba").alias("b_ba"), F.col("bb").alias("b_bb"),
                                       *[F.col(c).alias(f"b_{c}") for c in keep])
    on = [a.ba == b.b_ba, a.bb == b.b_bb, (a.a_t < b.b_t) | (a.a_sid <= b.b_sid)]
    pairs = a.join(b.hint("shuffle_hash"), on, "inner")
    wa, wb = F.col("a_w").cast("decimal(18,0)"), F.col("b_w").cast("decimal(18,0)")
    weight = F.when(F.col("a_sid") == F.col("b_sid"), wa * (wa - 1)).otherwise(wa * wb + wa * wb)
    return pairs.select(weight.cast("decimal(38,0)").alias("weight"),
                        *[F.col(f"a_{c}") for c in cols], *[F.col(f"b_{c}") for c in cols])


def _pair_counts(k: int, words: RunWords, p: F.Column | None = None) -> tuple[F.Column, F.Column]:
    """(c, s) of a joined signature pair, optionally over the first p runs only.
    A point has one cluster per run, so the per-cluster co-membership masks of
    a word are disjoint and can be OR-ed before counting."""
    c = s = None
    for w in range(words.n):
        same = None
        for j in range(k):
            t = F.col(f"a_m{j}_{w}").bitwiseAND(F.col(f"b_m{j}_{w}"))
            same = t if same is None else same.bitwiseOR(t)
        both = F.col(f"a_smask_{w}").bitwiseAND(F.col(f"b_smask_{w}"))
        if p is not None:
            pm = words.prefix_word_col(p, w)
            same, both = same.bitwiseAND(pm), both.bitwiseAND(pm)
        c = popcount(same) if c is None else c + popcount(same)
        s = popcount(both) if s is None else s + popcount(both)
    return c, s


def _prepared(assignments: DataFrame, n_points: int, k: int, runs: int, word_bits: int, block_rows: int | None,
              skip_tiles: bool, least_blocks: int = 1) -> tuple[DataFrame, list[str], DataFrame, int]:
    """(signatures in blocks, their mask columns, tiles to compute, number of blocks) of checked assignments."""
    words = RunWords(runs, word_bits)
    cols = mask_columns(k, words)
    sigs = materialize(signatures(assignments, k, runs, word_bits)
                       .withColumn("sid", F.monotonically_increasing_id()), "signatures")
    m = _check(sigs, n_points)
    nb = max(block_count(m, block_rows), min(m, least_blocks), 1)
    blocked = _blocked(sigs, cols, nb)
    return blocked, cols, _tile_list(blocked, cols, nb, skip_tiles), nb


def _all_bins(hist: DataFrame, total: int) -> DataFrame:
    """(bin, n) for all ten bins; what the counted pairs leave of ``total`` is in bin 0."""
    zero = F.lit(0).cast(_COUNT)
    rest = hist.agg((F.lit(Decimal(total)).cast(_COUNT) - F.coalesce(F.sum("n").cast(_COUNT), zero)).cast(_COUNT).alias("n")) \
        .select(F.lit(0).cast("int").alias("bin"), "n")
    zeros = hist.sparkSession.range(N_BINS).select(F.col("id").cast("int").alias("bin"), zero.alias("n"))
    return (zeros.unionByName(hist.select("bin", "n")).unionByName(rest)
            .groupBy("bin").agg(F.sum("n").cast(_COUNT).alias("n")))


def consensus_histogram(assignments: DataFrame, n_points: int, k: int, runs: int,
                        mode: str = "final", block_rows: int | None = None, engine: str = "numpy",
                        word_bits: int = 63, skip_tiles: bool = True) -> DataFrame:
    """Ten rows (bin int, n decimal(38, 0)) over all ordered pairs of the ``n_points`` points.

    ``final``: ratios after all runs, total N(N-1).
    ``cumulative``: the sum over r = 1..R of the histogram after the first r
    runs, total R N(N-1) (what re-binning after every run accumulates).
    ``engine``: ``numpy`` evaluates each tile in a vectorised kernel inside
    the task; ``sql`` joins the tiles with built-in operators.
    Run bits take one bigint per ``word_bits`` runs, so any number of runs works.
    Raises on ids out of range, a (run, point) with two rows, and a too small
    ``n_points``; ``skip_tiles=False`` computes the tiles that are known to be bin 0 too.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    words = RunWords(runs, word_bits)
    blocked, cols, kept, nb = _prepared(assignments, n_points, k, runs, word_bits, block_rows, skip_tiles)
    tiles = _tiles(blocked, cols, kept, nb)
    if engine == "numpy":
        hist = _tile_histograms(tiles, k, words, mode == "cumulative").groupBy("bin").agg(F.sum("n").cast(_COUNT).alias("n"))
    else:
        pairs = _tile_pairs_sql(tiles, cols)
        if mode == "final":
            c, s = _pair_counts(k, words)
            per_bin = pairs.select(ratio_bin(c, s).alias("bin"), "weight")
        else:
            p = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("p")
            c, s = _pair_counts(k, words, F.col("p"))
            per_bin = pairs.select("*", p).select(ratio_bin(c, s).alias("bin"), "weight")
        hist = per_bin.groupBy("bin").agg(F.sum("weight").cast(_COUNT).alias("n"))
    return _all_bins(hist, n_points * (n_points - 1) * (runs if mode == "cumulative" else 1))


def consensus_histogram_by_run(assignments: DataFrame, n_points: int, k: int, runs: int, block_rows: int | None = None,
                               word_bits: int = 63, skip_tiles: bool = True) -> DataFrame:
    """R x 10 rows (run int, bin int, n decimal(38, 0)): the histogram of all ordered
    pairs after the first ``run`` = 1 .. R runs, each with total N(N-1).

    The last run's is the ``final`` histogram, the sum over the runs the
    ``cumulative`` one; how the bins settle tells whether R runs are enough."""
    blocked, cols, kept, nb = _prepared(assignments, n_points, k, runs, word_bits, block_rows, skip_tiles)
    counted = _tile_histograms(_tiles(blocked, cols, kept, nb), k, RunWords(runs, word_bits), True)
    hist = counted.groupBy("run", "bin").agg(F.sum("n").cast(_COUNT).alias("n"))
    zero = F.lit(0).cast(_COUNT)
    grid = assignments.sparkSession.range(runs * N_BINS).select(
        (F.call_function("div", F.col("id"), F.lit(N_BINS)) + 1).cast("int").alias("run"), (F.col("id") % N_BINS).cast("int").alias("bin"))
    known = grid.select("run", "bin", zero.alias("n")).unionByName(hist).groupBy("run", "bin").agg(F.sum("n").cast(_COUNT).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("run"))              # ten rows a run
    rest = F.when(F.col("bin") == 0, F.lit(Decimal(n_points * (n_points - 1))).cast(_COUNT) - whole).otherwise(zero)
    return known.select("run", "bin", (F.col("n") + rest).cast(_COUNT).alias("n"))


# ----------------------------------------------------------- per-point totals

def item_totals(assignments: DataFrame, point_ids: DataFrame) -> DataFrame:
    """Row sums of the pair tables, without pairs.

    For point a: co-sampled pairs  sum_b s(a,b) = sum over a's runs of (run size - 1),
    co-clustered pairs            sum_b c(a,b) = sum over a's runs of (its cluster size - 1),
    and their ratio.  Points never sampled get zeros.
    """
    # R * k slot sizes (one partial-aggregated pass); run sizes come from them
    slot_sizes = assignments.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("slot_n"))
    run_sizes = slot_sizes.groupBy("run").agg(F.sum("slot_n").alias("run_n"))
    per = (assignments.join(F.broadcast(run_sizes), "run")
           .join(F.broadcast(slot_sizes), ["run", "cluster"])
           .groupBy("point_id").agg(
               F.sum(F.col("run_n") - 1).cast("bigint").alias("cosampled_pairs"),
               F.sum(F.col("slot_n") - 1).cast("bigint").alias("coclustered_pairs"),
               F.count(F.lit(1)).cast("bigint").alias("runs_sampled")))
    out = point_ids.select("point_id").join(per, "point_id", "left")
    cs = F.coalesce(F.col("cosampled_pairs"), F.lit(0).cast("bigint"))
    cc = F.coalesce(F.col("coclustered_pairs"), F.lit(0).cast("bigint"))
    return out.select("point_id",
                      F.coalesce("runs_sampled", F.lit(0).cast("bigint")).alias("runs_sampled"),
                      cs.alias("cosampled_pairs"), cc.alias("coclustered_pairs"),
                      F.round(consensus_ratio(cc, cs), 9).alias("consensus"))


# ------------------------------------------------------------------- K11

def consensus_compare(histograms: dict[str, DataFrame]) -> DataFrame:
    """One row per bin, one count column per algorithm."""
    names = list(histograms)
    tagged = None
    for name, h in histograms.items():
        t = h.select("bin", F.lit(name).alias("algorithm"), "n")
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy("bin").pivot("algorithm", names).agg(F.first("n")).select(
        "bin", *names)
