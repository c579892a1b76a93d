"""Point pairs with a least consensus ratio (K3, K4, K5 as pairs), without looking at all pairs.

In a run a sampled point has one cluster, so a point is a set of (run, cluster)
tokens, and for two points a, b

    c = tokens in common                times co-clustered
    s = runs in common                  times co-sampled

``c >= ratio * s`` is a set-similarity join.  Points with equal tokens are one
*class* (named by its smallest point id), so copies, however many, meet once.
Candidates come from prefixes:

* With n_a and n_b tokens out of R runs, s >= max(1, n_a + n_b - R), so a pair
  needs at least t = ceil(ratio * max(1, n_a + n_b - R)) common tokens; sizes with
  t > min(n_a, n_b) never meet.
* Tokens have one order, rarest first.  If the first common token stands at place
  p of a class (from 0), only n - p can be common, so p <= n - t.  Classes therefore
  list, for every size that a partner may have, their first n - t + 1 tokens as keys
  with both sizes, and meet on equal keys: a few small classes do not lengthen the
  prefixes that the others meet each other by.
* Two classes may share several keys; the pair counts only under the key of their
  first common token, which their token bits show, so no pair is made twice and
  none needs to be removed afterwards.

A key that many classes list is cut into blocks, and the pairs of two blocks meet
under a key of their own, so no task sees a whole hot key.  c and s are counted
with bit operations over the token and run words, and the ratio is checked in
integers.  Everything stays in built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.masks import RunWords, popcount
from concord.functions.ratio import consensus_ratio
from concord.operators.skew import keyed_lookup
from concord.session import materialize

#: Classes of a key that meet in one place.
BLOCK = 8192
#: Most point pairs that ``expand`` writes out unless it is told otherwise.
MOST_PAIRS = 10 ** 9
#: Most points that ``pairs_of_points`` compares with all others (their bits travel in the plan).
MOST_POINTS = 1000


@dataclass
class Links:
    """What ``links_at_least`` found: ``pairs`` (a, b, s, c, ratio) of classes, a < b, and
    ``members`` (point_id, class_id, n_runs, n_members).  Points of one class were in the same
    runs and clusters: with each other they have s = c = n_runs.  ``ends`` (class_id, n_members)
    has two rows a pair: each class with the size of the other."""
    pairs: DataFrame
    members: DataFrame
    ends: DataFrame


def _slots(assignments: DataFrame, k: int, runs: int, n_points: int | None) -> list[int]:
    """Token order: code run * k + cluster of every token, rarest first.  R * k counts reach the driver."""
    counts = assignments.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()
    bad = [(r["run"], r["cluster"]) for r in counts
           if r["run"] is None or r["cluster"] is None or not (0 <= r["run"] < runs and 0 <= r["cluster"] < k)]
    if bad:
        raise ValueError(f"assignments have a run or cluster out of range: {bad[:5]}")
    n = {r["run"] * k + r["cluster"]: r["n"] for r in counts}
    return sorted(range(runs * k), key=lambda t: (n.get(t, 0), t))


def _points(assignments: DataFrame, order: list[int], k: int, runs: int) -> tuple[DataFrame, RunWords, RunWords]:
    """(point_id, t_w.. token bits in token order, s_w.. run bits), written; a point has one cluster in a run."""
    tw, rw = RunWords(len(order)), RunWords(runs)
    rank = [0] * len(order)
    for place, token in enumerate(order):
        rank[token] = place
    rows = assignments.select("point_id", "run", F.element_at(F.lit(rank), (F.col("run") * k + F.col("cluster") + 1).cast("int")).alias("rank"))
    zero = F.lit(0).cast("bigint")

    def bits(words: RunWords, column: str, prefix: str) -> list[Column]:
        return [F.bit_or(F.when(words.word_of(column) == w, words.bit_of(column)).otherwise(zero)).alias(name)
                for w, name in enumerate(words.names(prefix))]

    grouped = rows.groupBy("point_id").agg(*bits(tw, "rank", "t"), *bits(rw, "run", "s"), F.count(F.lit(1)).alias("__rows"))
    once = F.col("point_id").isNotNull() & (F.col("__rows") == _count(rw, "s"))
    first = F.when(once, F.col("s_0")).otherwise(
        F.raise_error(F.lit("a point has no id, or two clusters in a run")).cast("bigint"))
    return materialize(grouped.withColumn("s_0", first).drop("__rows"), "point-tokens"), tw, rw


def _count(words: RunWords, prefix: str, a: str = "", b: str | None = None) -> Column:
    total = None
    for name in words.names(prefix):
        word = F.col(a + name) if b is None else F.col(a + name).bitwiseAND(F.col(b + name))
        total = popcount(word) if total is None else total + popcount(word)
    return total


def _needed(share: Fraction, runs: int, na: Column, nb: Column) -> Column:
    """ceil(ratio * max(1, na + nb - R)): the common tokens that a pair of these sizes needs."""
    least = F.greatest(F.lit(1), na + nb - F.lit(runs)).cast("bigint")
    p, q = F.lit(share.numerator).cast("bigint"), F.lit(share.denominator).cast("bigint")
    return F.call_function("div", least * p + q - 1, q)


def _share(ratio: float | str) -> Fraction:
    share = Fraction(str(ratio))
    if not 0 < share <= 1:
        raise ValueError("the least ratio must lie above 0 and be at most 1")
    return share


def _keys(classes: DataFrame, tw: RunWords, share: Fraction, runs: int, sizes: list[int]) -> DataFrame:
    """Every class once under each of its keys (k, lo, hi): a token by its place in the order, and the sizes of the
    class and of the partners that it is listed for."""
    bit_set = [f"(shiftright(t_{w}, cast(b - {w * tw.bits} as int)) & 1) = 1" for w in range(tw.n)]
    # tokens of the class in order: the set bits of its words
    of_word = [f"filter(sequence({w * tw.bits}, {min(tw.runs, (w + 1) * tw.bits) - 1}), b -> {bit_set[w]})" for w in range(tw.n)]
    need = _needed(share, runs, F.col("n"), F.col("__m"))
    listed = classes.withColumn("__tokens", F.expr(f"concat({', '.join(of_word)})")).select(
        "*", F.explode(F.array(*[F.lit(m).cast("bigint") for m in sizes])).alias("__m")).where(need <= F.least("n", "__m"))
    first = F.slice("__tokens", F.lit(1), (F.col("n") - need + 1).cast("int"))
    return listed.select(*classes.columns, F.least("n", "__m").alias("lo"), F.greatest("n", "__m").alias("hi"), F.explode(first).alias("k"))


def links_at_least(assignments: DataFrame, k: int, runs: int, ratio: float | str, block: int = BLOCK) -> Links:
    """All pairs of classes with s > 0 and c / s >= ``ratio`` (compared exactly; a float counts as its decimal text).

    ``assignments`` (run, point_id, cluster) is a written table.  Points that were
    never sampled have no pair with s > 0 and do not appear."""
    share = _share(ratio)
    points, tw, rw = _points(assignments, _slots(assignments, k, runs, None), k, runs)
    words = tw.names("t") + rw.names("s")
    found = points.groupBy(*words).agg(F.count(F.lit(1)).alias("w"), F.min("point_id").alias("class_id"))
    classes = materialize(found.withColumn("n", _count(rw, "s")), "classes")
    sizes = {r["n"]: (r["m"], r["w"]) for r in classes.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w")).collect()}
    lookup = classes.select(*tw.names("t"), "class_id", F.col("n").alias("n_runs"), F.col("w").alias("n_members"), F.col("w").alias("__count"))
    members = keyed_lookup(points.select("point_id", *tw.names("t")), lookup, tw.names("t"), "__count",
                           sum(w for _, w in sizes.values())).select("point_id", "class_id", "n_runs", "n_members")
    if not sizes:
        empty = classes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), *[F.lit(0).cast("bigint").alias(c) for c in "sc"],
                               F.lit(0.0).alias("ratio"))
        return Links(empty.where("false"), members, members.select("class_id", "n_members").where("false"))
    listed = materialize(_keys(classes, tw, share, runs, sorted(sizes)), "class-keys")
    cut = lambda size: F.ceil(F.sum(F.when(F.col("n") == F.col(size), 1).otherwise(0)) / F.lit(block)).cast("int")     # noqa: E731
    # R * k tokens and (R + 1) sizes twice bound the keys, however many classes there are
    key = ["k", "lo", "hi"]
    blocks = listed.groupBy(*key).agg(cut("lo").alias("__ni"), cut("hi").alias("__nj")).where("__ni > 0 AND __nj > 0")
    listed = listed.join(F.broadcast(materialize(blocks, "key-sizes")), key)
    one_size, own = F.col("lo") == F.col("hi"), F.xxhash64("class_id")
    keep = ["class_id", "n", "w", *words]
    mine = listed.withColumn("__i", F.pmod(own, F.col("__ni")).cast("int")).withColumn("__j", F.pmod(own, F.col("__nj")).cast("int"))
    left = mine.where("n = lo").select(*key, "__i", F.explode(F.sequence(F.when(one_size, F.col("__i")).otherwise(0), F.col("__nj") - 1)).alias("__j"),
                                       *[F.col(c).alias(f"a_{c}") for c in keep])
    right = mine.where("n = hi").select(*key, F.explode(F.sequence(F.lit(0), F.when(one_size, F.col("__j")).otherwise(F.col("__ni") - 1))).alias("__i"),
                                        "__j", *[F.col(c).alias(f"b_{c}") for c in keep])
    met = left.join(right.hint("merge"), [*key, "__i", "__j"])
    once = (F.col("lo") < F.col("hi")) | (F.col("__i") < F.col("__j")) | (F.col("a_class_id") < F.col("b_class_id"))
    # only under the key of the first common token: none is common below it
    below = None
    for w, name in enumerate(tw.names("t")):
        b = F.col(f"a_{name}").bitwiseAND(F.col(f"b_{name}")).bitwiseAND(tw.prefix_word_col(F.col("k"), w))
        below = b if below is None else below.bitwiseOR(b)
    c, s = _count(tw, "t", "a_", "b_"), _count(rw, "s", "a_", "b_")
    found = (met.where(once & (below == 0))
             .select("a_class_id", "b_class_id", "a_w", "b_w", s.alias("s"), c.alias("c"))
             .where((F.col("s") > 0) & (F.col("c") * F.lit(share.denominator) >= F.col("s") * F.lit(share.numerator))))
    pairs = found.select(F.least("a_class_id", "b_class_id").alias("a"), F.greatest("a_class_id", "b_class_id").alias("b"),
                         "s", "c", consensus_ratio("c", "s").alias("ratio"))
    end = lambda mine, other: F.struct(F.col(f"{mine}_class_id").alias("class_id"), F.col(f"{other}_w").alias("n_members"))     # noqa: E731
    return Links(pairs, members, found.select(F.inline(F.array(end("a", "b"), end("b", "a")))))


def partner_counts(links: Links) -> DataFrame:
    """(point_id, n_partners): how many other points each sampled point has a sufficient ratio with.

    One row a point, from class sizes; copies are not expanded."""
    # the pairs are made once, and added up by class before anything is shuffled
    sums = links.ends.groupBy("class_id").agg(F.sum("n_members").alias("n_others"))
    return links.members.join(sums, "class_id", "left").select(
        "point_id", (F.coalesce("n_others", F.lit(0)) + F.col("n_members") - 1).cast("bigint").alias("n_partners"))


def expand(links: Links, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a, b, s, c, ratio) for every pair of points, a < b.

    Their number is counted from the class sizes first; more than ``most_pairs``
    raises, as a result of that size is better read as classes."""
    members, pairs = materialize(links.members, "class-members"), materialize(links.pairs, "class-pairs")
    classes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("w"))
    wide = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("w").alias("wa")), "a").join(
        classes.select(F.col("class_id").alias("b"), F.col("w").alias("wb")), "b")
    big = "decimal(38,0)"
    n = sum(int(df.head()[0] or 0) for df in (wide.agg(F.sum((F.col("wa") * F.col("wb")).cast(big))),
                                             classes.agg(F.sum((F.col("w") * (F.col("w") - 1) / 2).cast(big)))))
    if n > most_pairs:
        raise ValueError(f"{n} pairs of points, more than {most_pairs}: use the classes, or raise most_pairs")
    x = members.select(F.col("class_id").alias("a"), F.col("point_id").alias("pa"))
    y = members.select(F.col("class_id").alias("b"), F.col("point_id").alias("pb"))
    across = pairs.join(x, "a").join(y, "b").select("pa", "pb", "s", "c", "ratio")
    inside = members.select("class_id", F.col("point_id").alias("pa"), F.col("n_runs").alias("s")).join(
        members.select("class_id", F.col("point_id").alias("pb")), "class_id").where("pa < pb").select(
        "pa", "pb", "s", F.col("s").alias("c"), F.lit(1.0).alias("ratio"))
    both = across.unionByName(inside)
    return both.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "s", "c", "ratio")


def pairs_of_points(assignments: DataFrame, k: int, runs: int, ids: list) -> DataFrame:
    """(a, b, s, c, ratio): each point of ``ids`` (a) with every other sampled point (b) it was ever sampled with.

    At most ``MOST_POINTS`` ids: their bits are part of the plan, and one pass over
    the points compares each with all of them; nothing is joined."""
    if len(set(ids)) > MOST_POINTS:
        raise ValueError(f"{len(set(ids))} points; at most {MOST_POINTS} are compared with all others")
    points, tw, rw = _points(assignments, _slots(assignments, k, runs, None), k, runs)
    words = tw.names("t") + rw.names("s")
    chosen = points.where(F.col("point_id").isin(*set(ids))).collect()
    kind = points.schema["point_id"].dataType
    if not chosen:
        chosen_rows = F.array().cast(f"array<struct<a:{kind.simpleString()}>>")
    else:
        chosen_rows = F.array(*[F.struct(F.lit(r["point_id"]).cast(kind).alias("a"), *[F.lit(r[w]).cast("bigint").alias(f"a_{w}") for w in words])
                                for r in sorted(chosen, key=lambda r: r["point_id"])])
    if not chosen:
        return points.select(F.col("point_id").alias("a"), F.col("point_id").alias("b"), *[F.lit(0).cast("bigint").alias(c) for c in "sc"],
                             F.lit(0.0).alias("ratio")).where("false")
    with_all = points.select(F.col("point_id").alias("b"), *words, F.inline(chosen_rows)).where("a <> b")
    with_all = with_all.select("a", "b", _count(rw, "s", "a_", "").alias("s"), _count(tw, "t", "a_", "").alias("c"))
    return with_all.where("s > 0").select("a", "b", "s", "c", consensus_ratio("c", "s").alias("ratio"))
