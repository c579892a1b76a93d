"""Benchmark decontamination by q-gram filtering and banded alignment.

Benchmark items are folded: lower case, every run of other characters than
letters and digits one space.  Needles of two kinds lie over an item: windows
of 80 characters every 16, always one at the end (a shorter item is one
needle), and disjoint tiles of 80 to 159 characters, which take edits that
crowd in one place of an item.  A needle of m characters is found in a text if
some region of the text is within k = floor(m * edit_rate) edits of it.  A
window ends at most 8 characters, its budget, off any 80 characters of an item:
every verbatim passage of 80 folded characters is found, one of 95 characters
holds a whole window.

Filter (q-gram lemma): such a region shares at least m - q + 1 - k q of the
needle's q-grams, and on diagonals (place in text minus place in needle) that
spread by k at most.  Shared q-grams are counted in bands of 2 (k + 1)
diagonals that overlap by half, so one band holds them all; bands below the
bound are dropped, first by item (with its least bound and widest band), then
by needle.  Verification: a banded alignment of the needle (both ends free in
the text) in each kept band, for all bands of a piece of text at once.  Regions
of an item that overlap on about one diagonal are one region, whose edits are
the distance to the part of the item that its needles cover.  A piece of text
with many shared q-grams is met in overlapping stretches of text and of items,
each of which holds whole needles, so that a step holds a bounded number of
them whatever the texts repeat.

An item of fewer than 24 folded characters is a phrase: it is found where it
stands whole and without edits, between ends of words (anywhere in scripts that
put no blanks between words), by the hashes of the runs that begin at a word.

The items are the query set: they are collected in blocks of bounded size
and every block's index travels to the tasks; the texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_udf

Q = 8
EDIT_RATE = 0.1
NEEDLE = 80
STRIDE = 16              # at most twice the budget of a window: see above
MIN_NEEDLE = 24          # folded characters; a shorter item is a phrase: found without edits only
BLOCK_BYTES = 4 << 20    # benchmark text in one block
HITS = 1 << 20           # shared q-grams that a step holds together
_FILTER_BITS = 20
_P = np.uint64(0x9E3779B97F4A7C15)
# scripts that put no blanks between words: Thai and Lao, Burmese, Khmer, kana and Han
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF),
             (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
LEAKS = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: int>>"
_alnum: np.ndarray | None = None


def _alnum_table() -> np.ndarray:
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _alnum


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points of all texts, place of each in its text, first place of each text)."""
    # one code point for one: only letters whose lower case is a single code point are folded
    lowered = [low if len(low := t.lower()) == len(t) else
               "".join(c if len(c.lower()) != 1 else c.lower() for c in t) for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(points)) - np.repeat(starts[:-1], sizes)
    c = np.where(_alnum_table()[points], points, 32)
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    keep[starts[:-1][sizes > 0]] = c[starts[:-1][sizes > 0]] != 32
    first = np.concatenate([[0], np.cumsum(keep)])[starts]
    return c[keep], place[keep], first


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every window of q code points, scrambled."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(points) - q + 1, np.uint64)
    for k in range(q):
        h = h * _P + points[k: len(points) - q + 1 + k].astype(np.uint64)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Needles:
    """Index of one block of items and their needles."""
    joined: np.ndarray          # folded code points of all items, then zeros for the longest needle
    owner: np.ndarray           # of each place, the number of its item
    begin: np.ndarray           # of each item, its first place
    reach: np.ndarray           # of each item, the largest budget of its needles
    least: np.ndarray           # and their least bound
    item: np.ndarray            # item_id of each needle: windows by place, then tiles by place
    start: np.ndarray           # place of its first character
    length: np.ndarray
    budget: np.ndarray          # edits allowed
    bound: np.ndarray           # q-grams that a region within the budget must share
    windows: int                # how many needles are windows
    grams: np.ndarray           # sorted different hashes
    first: np.ndarray           # of each, first posting; one more at the end
    at: np.ndarray              # postings: places
    sieve: np.ndarray           # by the hash's top bits: may be a gram

    @property
    def points(self) -> np.ndarray:
        """[needles, longest] code points (what follows a shorter needle is not part of it)."""
        return self.joined[self.start[:, None] + np.arange(self.length.max())[None, :]]

    @cached_property
    def posting_keys(self) -> np.ndarray:
        """Rising: number of the q-gram and place of every posting."""
        return np.repeat(np.arange(len(self.grams)), np.diff(self.first)) * len(self.joined) + self.at


def index(items: list[tuple[int, str]], edit_rate: float = EDIT_RATE) -> Needles | None:
    """Lay needles over items and index the items' q-grams; None if there is no needle."""
    folded, _, first = fold([t for _, t in items])
    ids, parts = [], []
    for k, (item, _) in enumerate(items):
        points = folded[first[k]: first[k + 1]]
        points = points[: len(points) - 1] if len(points) and points[-1] == 32 else points
        if len(points) >= MIN_NEEDLE:
            ids.append(item)
            parts.append(points)
    if not parts:
        return None
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    windows, tiles = [], []                                       # (item, first place, length)
    for k, n in enumerate(sizes.tolist()):
        last = max(n - NEEDLE, 0)
        windows += [(k, begin[k] + s, min(n, NEEDLE)) for s in sorted({*range(0, last, STRIDE), last})]
        if n > NEEDLE:
            m = n // NEEDLE
            cuts = np.cumsum([0] + [n // m + (j < n % m) for j in range(m)]).tolist()
            tiles += [(k, begin[k] + lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]
    of, start, length = np.array(windows + tiles, np.int64).T
    # no more edits than leave one shared q-gram certain
    budget = np.minimum((length * edit_rate).astype(np.int64), (length - Q) // Q)
    bound = length - Q + 1 - budget * Q
    reach, least = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    np.maximum.at(reach, of, budget)
    np.minimum.at(least, of, bound)
    points = np.concatenate(parts)
    h = gram_hashes(points)
    at = np.flatnonzero(owner[: len(h)] == owner[Q - 1:])
    at = at[np.argsort(h[at], kind="stable")]
    grams, starts = np.unique(h[at], return_index=True)
    sieve = np.zeros(1 << _FILTER_BITS, bool)
    sieve[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Needles(np.append(points, np.zeros(length.max(), np.uint32)), owner, begin, reach, least,
                   np.array(ids, np.int64)[of], start, length, budget, bound, len(windows),
                   grams, np.append(starts, len(at)), at, sieve)


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] numbers), then lo[1], ..."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def candidates(points: np.ndarray, first: np.ndarray, nd: Needles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, needle, first diagonal) of the bands that meet the bound; a diagonal
    is a place in the joined texts minus a place in the needle."""
    h = gram_hashes(points)
    none = np.zeros(0, np.int64)
    spots = np.flatnonzero(nd.sieve[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    g = np.minimum(np.searchsorted(nd.grams, h[spots]), len(nd.grams) - 1)
    real = nd.grams[g] == h[spots]
    spots, g = spots[real], g[real]
    text = np.searchsorted(first, spots, side="right") - 1
    inside = spots + Q <= first[text + 1]
    spots, g, text = spots[inside], g[inside], text[inside]
    if not len(spots):
        return none, none, none
    before = np.concatenate([[0], np.cumsum(nd.first[g + 1] - nd.first[g])])
    # stretches of text and of items; what overlaps holds any needle whole, with all diagonals of a band
    longest = int(nd.length.max())
    region, size = longest + 2 * (int(nd.budget.max()) + 1), len(nd.joined)
    work, keys = [(0, len(points), 0, size)], []
    while work:
        x, y, a, b = work.pop()
        lo, hi = np.searchsorted(spots, (x, y))
        if before[hi] - before[lo] > HITS and y - x > 4 * region:
            mid = (x + y) // 2
            work += [(x, mid + region, a, b), (mid, y, a, b)]
            continue
        start, n = nd.first[g[lo:hi]], nd.first[g[lo:hi] + 1] - nd.first[g[lo:hi]]
        if n.sum() > HITS:
            start, stop = (np.searchsorted(nd.posting_keys, g[lo:hi] * size + p) for p in (a, b))
            n = stop - start
            if n.sum() > HITS and b - a > 4 * longest:
                mid = (a + b) // 2
                work += [(x, y, a, mid + longest), (x, y, mid, b)]
                continue
        keys.append(_bands(np.repeat(spots[lo:hi], n), np.repeat(text[lo:hi], n), nd.at[_spread(start, n)],
                           len(points), len(first), nd))
    key = np.unique(np.concatenate(keys))
    shift, texts = size, len(first)
    top = len(points) + shift + 2
    text, needle, band = key % texts, key // texts // top, key // texts % top
    return text, needle, band * (nd.budget[needle] + 1) - shift + nd.start[needle]


def _bands(spots: np.ndarray, text: np.ndarray, at: np.ndarray, length: int, texts: int, nd: Needles) -> np.ndarray:
    """(needle * top + band) * texts + text of the bands that meet the bound, from shared
    q-grams at ``spots`` of the texts and ``at`` of the items."""
    none = np.zeros(0, np.int64)
    shift = len(nd.joined)
    top = length + shift + 2
    if not len(at):
        return none
    diagonal = spots - at + shift                                 # not negative
    # by item: what any of its needles shares with a region is in one of these bands
    owner = nd.owner[at].astype(np.int64)
    key = (owner * top + diagonal // (nd.reach[owner] + 1)) * texts + text
    found, band, count = np.unique(key, return_inverse=True, return_counts=True)
    def beside(k: int) -> np.ndarray:
        near = np.minimum(np.searchsorted(found, found + k * texts), len(found) - 1)
        return np.where(found[near] == found + k * texts, count[near], 0)
    good = (count + np.maximum(beside(1), beside(-1)) >= nd.least[found // texts // top])[band]
    at, text, diagonal, owner = at[good], text[good], diagonal[good], owner[good]
    if not len(at):
        return none
    # by needle: the windows that hold the q-gram, and the tile if one does
    starts, tiles = nd.start[: nd.windows], nd.start[nd.windows:]
    lo = np.searchsorted(starts, np.maximum(at + Q - NEEDLE, nd.begin[owner]))
    n = np.searchsorted(starts, at, side="right") - lo
    needle, hit = _spread(lo, n), np.repeat(np.arange(len(at)), n)
    if len(tiles):
        tile = np.maximum(np.searchsorted(tiles, at, side="right") - 1, 0) + nd.windows
        holds = np.flatnonzero((nd.start[tile] <= at) & (at + Q <= nd.start[tile] + nd.length[tile]))
        needle, hit = np.append(needle, tile[holds]), np.append(hit, holds)
    band = diagonal[hit] // (nd.budget[needle] + 1)
    key = (needle * top + band) * texts + text[hit]
    found, count = np.unique(np.concatenate([key, key - texts]), return_counts=True)   # band and the one below
    needle = found // texts // top
    good = (needle >= 0) & (needle < len(nd.item))
    good[good] = count[good] >= nd.bound[needle[good]]
    return found[good]


def align(points: np.ndarray, first: np.ndarray, nd: Needles, text: np.ndarray, needle: np.ndarray,
          diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the needle's best alignment in each band: all of the
    needle, any region of the text, diagonals from ``diagonal`` to + 2 (budget + 1) - 1.
    Over the budget the edits may be given as 2^20."""
    width = 2 * (nd.budget[needle] + 1)
    w = np.arange(width.max(), dtype=np.int16)
    # cost * big + first diagonal: fewest edits, then first start; needles of at most 159 characters keep it small
    big, dead, far = np.int16(64), np.int16(1 << 14), 1 << 8
    longest = int(nd.length[needle].max())
    here = np.append(points, 0).take(diagonal[:, None] + np.arange(longest + len(w))[None, :], mode="clip")
    wanted = nd.joined.take(nd.start[needle][:, None] + np.arange(longest)[None, :], mode="clip")
    # the needle's i-th character meets the text on a diagonal if lo <= i < hi
    start = diagonal[:, None] + w[None, :]
    lo = np.clip(first[text][:, None] - start, 0, far).astype(np.int16)
    hi = np.where(w[None, :] < width[:, None], np.clip(first[text + 1][:, None] - start, -1, far), -1).astype(np.int16)
    state = np.where((lo <= 0) & (hi >= 0), w[None, :], dead)
    slide = big * w[None, :]
    edits, at, end = (np.full(len(needle), x, np.int64) for x in (1 << 20, 0, 0))
    row, length, most = np.arange(len(needle)), nd.length[needle], (nd.budget[needle] + 1) * int(big)
    ends = set(length.tolist())
    for i in range(longest + 1):
        if i in ends:
            done = np.flatnonzero(length == i)
            best = state[done].argmin(axis=1)
            value = state[done, best].astype(np.int64)
            r = row[done[value < dead]]
            edits[r], at[r], end[r] = (x[value < dead] for x in (value // big, value % big, best))
        if i in ends or i % 8 == 0:                               # the fewest edits of a row never fall
            go = (length > i) & (state.min(axis=1) < most)
            if not go.all():
                row, length, most, state, here, wanted, lo, hi = (
                    x[go] for x in (row, length, most, state, here, wanted, lo, hi))
            if not len(row):
                break
        alive = i < hi
        new = np.where(here[:, i: i + len(w)] == wanted[:, i][:, None], state, state + big)
        new = np.where(alive & (lo <= i), new, dead)
        new[:, :-1] = np.minimum(new[:, :-1], state[:, 1:] + big)  # needle character left out
        # extra text characters: one edit for each step to the right
        new = np.minimum(np.minimum.accumulate(new - slide, axis=1) + slide, dead)
        state = np.where(alive, new, dead)
    return edits, diagonal + at, diagonal + end + nd.length[needle]


def distance(a: np.ndarray, b: np.ndarray, guess: int = 8) -> int:
    """Edits between two arrays of code points: diagonals within a limit, doubled until it holds the answer."""
    k = max(guess, abs(len(a) - len(b)), 1)
    while True:
        w = np.arange(-k, k + 1)                                  # place in b minus place in a
        row = np.where(w >= 0, w, 1 << 30)
        padded = np.append(b, 0)
        for i in range(len(a)):
            j = i + w
            ok = (j >= 0) & (j < len(b))
            new = np.where(ok, row + (padded[np.where(ok, j, len(b))] != a[i]), 1 << 30)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            new = np.where((j >= -1) & (j < len(b)), np.minimum.accumulate(new - w) + w, 1 << 30)
            row = new
        edits = int(row[len(b) - len(a) + k])
        if edits <= k or k >= max(len(a), len(b)):
            return edits
        k *= 2


@dataclass
class Phrases:
    """Items too short for needles, by length."""
    hashes: dict[int, np.ndarray]     # of each length, sorted
    items: dict[int, np.ndarray]      # item_id of each
    points: dict[int, np.ndarray]     # [phrases, length] code points of each


def phrases(items: list[tuple[int, str]]) -> Phrases | None:
    """The items of fewer than ``MIN_NEEDLE`` folded characters; None if there is none."""
    folded, _, first = fold([t for _, t in items])
    by_length: dict[int, list] = {}
    for k, (item, _) in enumerate(items):
        points = folded[first[k]: first[k + 1]]
        points = points[: len(points) - 1] if len(points) and points[-1] == 32 else points
        if 0 < len(points) < MIN_NEEDLE:
            by_length.setdefault(len(points), []).append((item, points))
    if not by_length:
        return None
    out = Phrases({}, {}, {})
    for n, rows in by_length.items():
        points = np.stack([p for _, p in rows])
        h = np.zeros(len(rows), np.uint64)
        for k in range(n):
            h = h * _P + points[:, k]
        order = np.argsort(h, kind="stable")
        out.hashes[n], out.points[n] = h[order], points[order]
        out.items[n] = np.array([i for i, _ in rows], np.int64)[order]
    return out


def find_phrases(points: np.ndarray, first: np.ndarray, ph: Phrases) -> list[tuple[int, int, int, int]]:
    """(text, item_id, first place, place after the last) of every phrase in the folded texts."""
    spaced = points != 32
    for lo, hi in _UNSPACED:
        spaced &= (points < lo) | (points > hi)
    edge = np.ones(len(points) + 1, bool)                         # no word goes on here
    edge[1:-1] = ~(spaced[:-1] & spaced[1:])
    edge[first] = True
    start = np.flatnonzero(edge[:-1] & (points != 32))
    text = np.searchsorted(first, start, side="right") - 1
    h = np.zeros(len(start), np.uint64)
    out = []
    for n in range(1, max(ph.hashes) + 1):
        on = start + n <= first[text + 1]
        start, text, h = start[on], text[on], h[on]
        h = h * _P + points[start + n - 1]
        if n in ph.hashes:
            lo = np.searchsorted(ph.hashes[n], h)
            count = np.where(edge[start + n], np.searchsorted(ph.hashes[n], h, side="right") - lo, 0)
            k, at, of = _spread(lo, count), np.repeat(start, count), np.repeat(text, count)
            same = (points[at[:, None] + np.arange(n)] == ph.points[n][k]).all(axis=1)
            out += zip(of[same].tolist(), ph.items[n][k[same]].tolist(), at[same].tolist(), (at[same] + n).tolist())
    return out


def find_leaks(texts: list[str], nd: Needles | None, ph: Phrases | None = None) -> list[list[dict]]:
    """Regions (item_id, start, end, edits) of each text, in code points, by start."""
    points, place, first = fold(texts)
    out: list[list[dict]] = [[] for _ in texts]
    if ph is not None and len(points):
        for t, item, s, f in find_phrases(points, first, ph):
            out[t].append({"item_id": item, "start": int(place[s]), "end": int(place[f - 1]) + 1, "edits": 0})
    if nd is not None:
        _find_regions(points, place, first, nd, out)
    return [sorted(r, key=lambda r: (r["start"], r["item_id"])) for r in out]


def _find_regions(points: np.ndarray, place: np.ndarray, first: np.ndarray, nd: Needles, out: list[list[dict]]) -> None:
    """Add the regions of the needles to ``out``."""
    text, needle, diagonal = candidates(points, first, nd)
    order = np.argsort(nd.length[needle], kind="stable")
    text, needle, diagonal = text[order], needle[order], diagonal[order]
    met = []
    for lo in range(0, len(text), 4096):                          # bounds the alignment's arrays
        part = slice(lo, lo + 4096)
        edits, start, end = align(points, first, nd, text[part], needle[part], diagonal[part])
        good = (edits <= nd.budget[needle[part]]) & (end > start)
        met.append(np.stack([text[part], nd.owner[nd.start[needle[part]]], start, end, needle[part], edits])[:, good])
    rows = np.concatenate(met, axis=1).T.tolist() if met else []
    # chains of regions: [text, item, start, end, first and last place of the item, its diagonal, most edits, all on one diagonal]
    chains: list[list] = []
    open_: list[list] = []
    for t, o, s, f, n, e in sorted(rows):
        lo = int(nd.start[n])
        hi, slope = lo + int(nd.length[n]), s - lo
        open_ = [c for c in open_ if c[0] == t and c[1] == o and c[3] > s]
        near = [c for c in open_ if abs(c[6] - slope) <= nd.reach[o]]
        if near:
            c = min(near, key=lambda c: abs(c[6] - slope))
            c[3], c[4], c[5] = max(c[3], f), min(c[4], lo), max(c[5], hi)
            c[7], c[8], c[6] = max(c[7], e), c[8] and c[6] == slope, slope
        else:
            open_.append([t, o, s, f, lo, hi, slope, e, True])
            chains.append(open_[-1])
    kept: list[list] = []
    for c in sorted(chains, key=lambda c: (c[0], c[1], c[2] - c[3])):   # an item's self-likeness shows inside longer regions
        kept = [x for x in kept if x[0] == c[0] and x[1] == c[1]]
        if any(x[2] <= c[2] and c[3] <= x[3] for x in kept):
            continue
        kept.append(c)
        t, o, s, f, lo, hi, _, most, straight = c
        edits = 0 if straight and not most else distance(nd.joined[lo:hi], points[s:f], most)
        out[t].append({"item_id": int(nd.item[np.searchsorted(nd.start[: nd.windows], nd.begin[o])]),
                       "start": int(place[s]), "end": int(place[f - 1]) + 1, "edits": edits})


def benchmark_blocks(benchmark: DataFrame) -> list[tuple[Needles | None, Phrases | None]]:
    """The benchmark (item_id, text) as indexes of about ``BLOCK_BYTES`` of text each."""
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    n = -(-size // BLOCK_BYTES)
    blocks = []
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        block = sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in rows)
        blocks.append((index(block), phrases(block)))
    return [b for b in blocks if b != (None, None)]


def leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """Add ``column``: array of (item_id, start, end, edits), empty for a clean text.

    Null and empty texts are clean; rows are kept one for one; items without a
    letter or digit are not looked for, and a benchmark of such items or none
    leaves all clean; an item without id counts as -1; of items with equal texts
    each is reported; a very long text is met in stretches of bounded work; an
    existing column of that name is replaced."""
    found = [text_udf(lambda texts, b=b: pa.array(find_leaks([t or "" for t in texts.to_pylist()], *b), _KIND),
                      LEAKS)("text") for b in benchmark_blocks(benchmark)]
    every = F.concat(*found) if len(found) > 1 else found[0] if found else F.array().cast(LEAKS)
    return docs.withColumn(column, every)


def has_passage(column: str = "leaks") -> Column:
    """True if a region of ``column`` is a passage: more than one word of a script with blanks."""
    word = r"^[\p{L}\p{N}&&[^\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF]]+$"
    return F.exists(column, lambda r: ~F.substring("text", r["start"] + 1, r["end"] - r["start"]).rlike(word))


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
