"""DuckDB SQL for the oracle checks.

These statements compute the same results as the Spark queries by the most
direct route the definitions allow (explicit point pairs, window functions),
so they check the Spark plans rather than repeat them.  DuckDB traps handled
here: ``sum`` returns HUGEINT (cast to BIGINT), integer division is ``//``,
``1 << run`` needs a BIGINT, and concat_ws wants VARCHAR parts.
"""

from __future__ import annotations

from concord.functions.sampling import hash_threshold
from concord.plans.fixtures import PointSet


def in_sample_sql(seed: int, run: str, pid: str, fraction: float = 0.9) -> str:
    return (f"substr(md5(concat_ws(':', '{seed}', CAST({run} AS VARCHAR), CAST({pid} AS VARCHAR))), 1, 8)"
            f" < '{hash_threshold(fraction)}'")


def sampled_sql(ps: PointSet, runs: int, seed: int = 1, fraction: float = 0.9) -> str:
    """CTEs pts(point_id, x0..) and mem(run, point_id, x0..)."""
    xs = ", ".join(f"p.x{i}" for i in range(len(ps.features)))
    return (f"pts AS ({ps.sql()}),\n"
            f"runs AS (SELECT CAST(range AS INTEGER) AS run FROM range({runs})),\n"
            f"mem AS (SELECT r.run, p.point_id, {xs} FROM pts p JOIN runs r ON TRUE\n"
            f"        WHERE {in_sample_sql(seed, 'r.run', 'p.point_id', fraction)})")


def portable_sql(ps: PointSet, k: int, runs: int = 20, seed: int = 1, steps: int = 125,
                 fraction: float = 0.9, digits: int = 9) -> str:
    """CTE chain (for WITH RECURSIVE) ending in asg(run, point_id, cluster): the portable
    clusterer, one recursion a step until no center moves or ``steps`` are done."""
    d = len(ps.features)
    xs = [f"x{i}" for i in range(d)]
    cols = ", ".join(xs)
    dist = " + ".join(f"(m.{x} - c.{x}) * (m.{x} - c.{x})" for x in xs)

    def assign(centers: str) -> str:
        return (f"SELECT run, point_id, cluster, {cols} FROM (\n"
                f"  SELECT m.run, m.point_id, c.cluster, " + ", ".join(f"m.{x}" for x in xs) + ",\n"
                f"    row_number() OVER (PARTITION BY m.run, m.point_id ORDER BY {dist}, c.cluster) AS rk\n"
                f"  FROM mem m JOIN {centers} c ON m.run = c.run) WHERE rk = 1")

    means = ", ".join(f"round(avg({x}), {digits}) AS {x}" for x in xs)
    keep = ", ".join(f"coalesce(n.{x}, o.{x}) AS {x}" for x in xs)
    moved = " OR ".join(f"n.{x} <> o.{x}" for x in xs)
    return ",\n".join([
        sampled_sql(ps, runs, seed, fraction),
        f"c0 AS (SELECT run, CAST(rn - 1 AS INTEGER) AS cluster, {cols} FROM (\n"
        f"  SELECT run, point_id, {cols}, row_number() OVER (PARTITION BY run ORDER BY "
        f"md5(concat_ws(':', 'init', '{seed}', CAST(run AS VARCHAR), CAST(point_id AS VARCHAR))), point_id) AS rn\n"
        f"  FROM mem) WHERE rn <= {k})",
        f"rc AS (SELECT 0 AS t, run, cluster, {cols}, 1 AS moved FROM c0\n"
        f"  UNION ALL SELECT o.t + 1, o.run, o.cluster, {keep},\n"
        f"    max(CASE WHEN n.run IS NOT NULL AND ({moved}) THEN 1 ELSE 0 END) OVER () AS moved\n"
        f"  FROM rc o LEFT JOIN (SELECT run, cluster, {means} FROM ({assign('rc')}) GROUP BY run, cluster) n\n"
        f"    ON o.run = n.run AND o.cluster = n.cluster WHERE o.t < {steps} AND o.moved = 1)",
        "cz AS (SELECT * FROM rc WHERE t = (SELECT max(t) FROM rc))",
        f"asg AS (SELECT run, point_id, cluster FROM ({assign('cz')}))"])


def histogram_final_sql(ps: PointSet, k: int, runs: int, **kw) -> str:
    """Explicit ordered point pairs; pairs never co-sampled are counted by difference."""
    return f"""WITH RECURSIVE {portable_sql(ps, k, runs, **kw)},
npts AS (SELECT count(*) AS n FROM pts),
pairs AS (SELECT a.point_id AS pa, b.point_id AS pb, count(*) AS s,
                 sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS c
          FROM asg a JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id GROUP BY 1, 2),
binned AS (SELECT CAST(least(9, (10 * c) // s) AS INTEGER) AS bin, count(*) AS n FROM pairs GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT bins.bin, CAST(coalesce(binned.n, 0)
    + CASE WHEN bins.bin = 0 THEN (SELECT n * (n - 1) FROM npts) - (SELECT coalesce(sum(n), 0) FROM binned) ELSE 0 END
    AS BIGINT) AS n
FROM bins LEFT JOIN binned ON bins.bin = binned.bin"""


def histogram_cumulative_sql(ps: PointSet, k: int, runs: int, **kw) -> str:
    """Per pair, running (c, s) after each co-sampled run, weighted by how many
    prefixes keep that state; everything else is bin 0."""
    return f"""WITH RECURSIVE {portable_sql(ps, k, runs, **kw)},
npts AS (SELECT count(*) AS n FROM pts),
pr AS (SELECT a.point_id AS pa, b.point_id AS pb, a.run,
              CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END AS same
       FROM asg a JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id),
st AS (SELECT sum(same) OVER w AS c, count(*) OVER w AS s,
              coalesce(lead(run) OVER (PARTITION BY pa, pb ORDER BY run), {runs}) - run AS dur
       FROM pr WINDOW w AS (PARTITION BY pa, pb ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
binned AS (SELECT CAST(least(9, (10 * c) // s) AS INTEGER) AS bin, sum(dur) AS n FROM st GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT bins.bin, CAST(coalesce(binned.n, 0)
    + CASE WHEN bins.bin = 0 THEN {runs} * (SELECT n * (n - 1) FROM npts) - (SELECT coalesce(sum(n), 0) FROM binned) ELSE 0 END
    AS BIGINT) AS n
FROM bins LEFT JOIN binned ON bins.bin = binned.bin"""
