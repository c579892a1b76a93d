"""Pairs with a least ratio against every pair of points."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from concord.operators import pairs as P
from concord.operators.skew import keyed_lookup
from concord.session import materialize

SCHEMA = "run int, point_id bigint, cluster int"


def plain(rows):
    """{(a, b): (s, c)} over all pairs ever sampled together."""
    at = {}
    for run, p, cluster in rows:
        at.setdefault(p, {})[run] = cluster
    out = {}
    for a in at:
        for b in at:
            if a < b:
                both = at[a].keys() & at[b].keys()
                if both:
                    out[a, b] = (len(both), sum(at[a][r] == at[b][r] for r in both))
    return out


def some_rows(n, runs, k, seed, fraction=0.9, noise=0.2, copies=1):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(n):
        home, labels = rng.randrange(k), {}
        for r in range(runs):
            if rng.random() < fraction:
                labels[r] = rng.randrange(k) if rng.random() < noise else home
        for _ in range(copies if rng.random() < 0.3 else 1):
            rows += [(r, at, c) for r, c in labels.items()]
            at += 1
    return rows


def _written(spark, rows):
    return materialize(spark.createDataFrame(rows, SCHEMA), "assignments")


def _check(spark, rows, k, runs, ratio, block=P.BLOCK):
    want = {ab: sc for ab, sc in plain(rows).items() if sc[1] >= Fraction(str(ratio)) * sc[0]}
    links = P.links_at_least(_written(spark, rows), k, runs, ratio, block)
    got = P.expand(links).collect()
    assert len(got) == len(want)
    assert {(r["a"], r["b"]): (r["s"], r["c"]) for r in got} == want
    assert all(abs(r["ratio"] - r["c"] / r["s"]) < 1e-12 for r in got)
    partners = {}
    for a, b in want:
        for p in (a, b):
            partners[p] = partners.get(p, 0) + 1
    assert {r["point_id"]: r["n_partners"] for r in P.partner_counts(links).collect()} == {
        p: partners.get(p, 0) for p in {p for _, p, _ in rows}}
    return links


@pytest.mark.parametrize("ratio", [0.35, "0.8", 0.9, 1])
def test_equal_to_all_pairs(spark, ratio):
    _check(spark, some_rows(70, 20, 4, 1), 4, 20, ratio)


def test_few_runs_and_low_fractions(spark):
    """Sizes differ widely: some points were sampled once, so keys have one token."""
    _check(spark, some_rows(60, 6, 3, 2, fraction=0.4), 3, 6, 0.5)


def test_more_tokens_than_a_word(spark):
    _check(spark, some_rows(40, 70, 3, 3, noise=0.1), 3, 70, 0.85)


def test_hot_keys_are_cut_into_blocks(spark):
    """One stable group: nearly all classes list the same keys, in blocks of 3."""
    rows = some_rows(60, 12, 2, 4, noise=0.03, copies=5)
    links = _check(spark, rows, 2, 12, 0.9, block=3)
    plan = links.pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_copies_are_one_class(spark):
    rows = [(r, p, p // 200) for r in range(8) for p in range(400) if r or p % 2]
    links = P.links_at_least(_written(spark, rows), 2, 8, 0.9)
    assert links.members.select("class_id").distinct().count() == 4
    assert links.pairs.count() == 2                                   # the two halves of each group
    assert {r["n_partners"] for r in P.partner_counts(links).collect()} == {199}
    with pytest.raises(ValueError, match="39800 pairs"):
        P.expand(links, most_pairs=1000)


def test_wrong_input(spark):
    for rows, message in (([(0, 1, 5)], "out of range"), ([(9, 1, 0)], "out of range"), ([(0, 1, 0), (0, 1, 1)], "two clusters"),
                          ([(0, None, 0)], "no id")):
        with pytest.raises(Exception, match=message):
            P.links_at_least(_written(spark, rows), 2, 3, 0.9).members.collect()
    with pytest.raises(ValueError, match="ratio"):
        P.links_at_least(_written(spark, [(0, 1, 0)]), 2, 3, 0)


def test_empty_and_single(spark):
    links = P.links_at_least(_written(spark, []), 2, 3, 0.9)
    assert P.expand(links).collect() == [] and P.partner_counts(links).collect() == []
    links = P.links_at_least(_written(spark, [(0, 1, 0)]), 2, 3, 0.9)
    assert P.expand(links).collect() == [] and [tuple(r) for r in P.partner_counts(links).collect()] == [(1, 0)]


def test_pairs_of_points(spark):
    rows = some_rows(50, 9, 3, 6)
    want = {}
    for (a, b), sc in plain(rows).items():
        want[a, b] = want[b, a] = sc
    got = P.pairs_of_points(_written(spark, rows), 3, 9, [3, 7, 11, 999]).collect()
    assert {(r["a"], r["b"]): (r["s"], r["c"]) for r in got} == {ab: sc for ab, sc in want.items() if ab[0] in (3, 7, 11)}
    assert P.pairs_of_points(_written(spark, rows), 3, 9, [999]).collect() == []
    with pytest.raises(ValueError, match="at most"):
        P.pairs_of_points(_written(spark, rows), 3, 9, list(range(P.MOST_POINTS + 1)))


def test_keyed_lookup_with_a_hot_and_a_null_key(spark):
    keys = [None] * 300 + [1] * 300 + list(range(2, 2002))
    rows = materialize(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int"), "rows")
    table = materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.coalesce("k", F.lit(-1)) * 10), "table")
    got = keyed_lookup(rows, table, ["k"], "n", len(keys))
    assert got.columns == ["k", "i", "v"]
    assert sorted((r["i"], r["v"]) for r in got.collect()) == [(i, (-1 if k is None else k) * 10) for i, k in enumerate(keys)]


def test_small_classes_do_not_lengthen_the_keys_of_others(spark):
    """One point sampled in few runs: the others still list only the tokens that they need for each other's sizes."""
    rows = some_rows(40, 20, 4, 7, fraction=1.0, noise=0.1)
    def listed(rows):
        made = []
        real, P.materialize = P.materialize, lambda df, tag: made.append((tag, real(df, tag))) or made[-1][1]
        try:
            links = P.links_at_least(_written(spark, rows), 4, 20, 0.9)
        finally:
            P.materialize = real
        full = dict(made)["class-keys"].where("n = 20")
        return sorted(tuple(r) for r in links.pairs.collect()), full.count() / full.select("class_id").distinct().count()
    pairs, few = listed(rows)
    with_odd, more = listed(rows + [(r, 999, 0) for r in range(3)])
    # 20 tokens against 3 need 3 in common, so 18 keys of that kind; against 20, 18 in common, so 3 keys
    assert few == 3 and more <= 3 + 18
    assert pairs == [p for p in with_odd if 999 not in p[:2]]


def test_partner_counts_make_the_pairs_once(spark):
    links = P.links_at_least(_written(spark, some_rows(60, 12, 2, 8, noise=0.1, copies=3)), 2, 12, 0.8)
    want = {}
    sizes = {r["class_id"]: r["n_members"] for r in links.members.collect()}
    for r in links.pairs.collect():
        want[r["a"]] = want.get(r["a"], 0) + sizes[r["b"]]
        want[r["b"]] = want.get(r["b"], 0) + sizes[r["a"]]
    got = {r["class_id"]: r["n"] for r in links.ends.groupBy("class_id").agg(F.sum("n_members").alias("n")).collect()}
    assert got == want
