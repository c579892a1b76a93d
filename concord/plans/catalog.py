"""The named queries: each takes (spark, sf_dir) and returns a DataFrame, and
most have a DuckDB statement that must give the same rows.

Parameters follow the reference's workloads: consensus k=5, maxIter=125,
fit seed 1, 20 runs, 90 % subsamples; evaluation k=3 with maxIter 30 / 30 /
20; importance k=4, maxIter 125, forest of 20 trees of depth 5, seed 5043.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators import cluster as C
from concord.operators import consensus as cons
from concord.operators import estimate as EST
from concord.operators import evaluate as E
from concord.operators import features as FT
from concord.operators import importance as I
from concord.operators import mixture as MIX
from concord.operators import pairs as PR
from concord.operators import points as P
from concord.operators import resample as RS
from concord.operators import stability as ST
from concord.operators import strings as STR
from concord.operators.layout import fixed_layout
from concord.operators.portable import portable_assignments
from concord.plans import oracles as O
from concord.plans.fixtures import (EMBEDDING, FIFTH, PARITY, PART, PURCHASE, PURCHASE_GROUP, REPEATED, SUPPLIER, THIRDS,
                                    USAGE_FEATURES, usage_table)
from concord.session import materialize, scratch_path
from concord.sources import csv as CSV
from concord.sources import libsvm as LIBSVM
from concord.sources import models as MODELS
from concord.sources import profile as PROFILE
from concord.sources import views as VIEWS
from concord.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the consensus workload
K_CONSENSUS = 5
RUNS = 20
MAX_ITER_CONSENSUS = 125
FIT_SEED = 1
SAMPLE_SEED = 1
FRACTION = 0.9
#: Fits of which the best is taken, for mixtures whose answer is known.
RESTARTS = 4

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _portable(spark: SparkSession, sf_dir: str, ps=PART, k: int = K_CONSENSUS) -> tuple[DataFrame, DataFrame]:
    pts = materialize(ps.load(spark, sf_dir), "points")
    asg = portable_assignments(pts, k=k, runs=RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS, fraction=FRACTION)
    return pts, asg


def _histogram(spark: SparkSession, sf_dir: str, ps, mode: str) -> DataFrame:
    pts, asg = _portable(spark, sf_dir, ps)
    hist = cons.consensus_histogram(asg, pts.count(), K_CONSENSUS, RUNS, mode=mode)
    return hist.select("bin", F.col("n").cast("bigint").alias("n"))


# ------------------------------------------------------------ consensus (K)

@query("consensus_assignments",
       f"WITH RECURSIVE {O.portable_sql(PART, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)}\n"
       "SELECT run, point_id, cluster FROM asg")
def consensus_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 with the portable clusterer: all runs of part, one row per sampled point and run."""
    return _portable(spark, sf_dir)[1]


@query("consensus_histogram_final",
       O.histogram_final_sql(PART, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS))
def consensus_histogram_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios after all runs, over all N(N-1) ordered pairs of part."""
    return _histogram(spark, sf_dir, PART, "final")


@query("consensus_assignments_wide",
       f"WITH RECURSIVE {O.portable_sql(EMBEDDING, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)}\n"
       "SELECT run, point_id, cluster FROM asg")
def consensus_assignments_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 on the embeddings (64 dimensions), portable clusterer."""
    return _portable(spark, sf_dir, EMBEDDING)[1]


@query("consensus_of_distinct_rows",
       O.histogram_final_sql(REPEATED, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS))
def consensus_of_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R5 into K1-K7: rows that repeat become one point each, then the consensus run."""
    return _histogram(spark, sf_dir, REPEATED, "final")


@query("consensus_histogram_cumulative",
       O.histogram_cumulative_sql(SUPPLIER, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS))
def consensus_histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: histogram re-binned after every run and summed (total R N(N-1)), suppliers."""
    return _histogram(spark, sf_dir, SUPPLIER, "cumulative")


@query("consensus_histogram_cumulative_rows",
       O.histogram_cumulative_sql(REPEATED, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS))
def consensus_histogram_cumulative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 on the distinct customer rows."""
    return _histogram(spark, sf_dir, REPEATED, "cumulative")


@query("pair_cosample", f"""WITH RECURSIVE {O.portable_sql(SUPPLIER, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)},
per AS (SELECT a.point_id, count(DISTINCT a.run) AS runs_sampled, count(b.point_id) AS cosampled_pairs
        FROM asg a LEFT JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id GROUP BY 1)
SELECT p.point_id, CAST(coalesce(runs_sampled, 0) AS BIGINT) AS runs_sampled,
       CAST(coalesce(cosampled_pairs, 0) AS BIGINT) AS cosampled_pairs
FROM pts p LEFT JOIN per USING (point_id)""")
def pair_cosample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 (re-aimed): per point, the row sum of the co-sample count table -- how
    many (partner, run) co-samplings it had -- from run sizes, without pairs."""
    pts, asg = _portable(spark, sf_dir, SUPPLIER)
    return cons.item_totals(asg, pts).select("point_id", "runs_sampled", "cosampled_pairs")


@query("pair_cocluster", f"""WITH RECURSIVE {O.portable_sql(SUPPLIER, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)},
per AS (SELECT a.point_id, count(b.point_id) AS coclustered_pairs
        FROM asg a JOIN asg b ON a.run = b.run AND a.cluster = b.cluster AND a.point_id <> b.point_id GROUP BY 1)
SELECT p.point_id, CAST(coalesce(coclustered_pairs, 0) AS BIGINT) AS coclustered_pairs
FROM pts p LEFT JOIN per USING (point_id)""")
def pair_cocluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 (re-aimed): per point, the row sum of the co-cluster count table, from
    (run, cluster) sizes."""
    pts, asg = _portable(spark, sf_dir, SUPPLIER)
    return cons.item_totals(asg, pts).select("point_id", "coclustered_pairs")


@query("pair_consensus", f"""WITH RECURSIVE {O.portable_sql(SUPPLIER, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)},
per AS (SELECT a.point_id, count(*) AS s, sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS c
        FROM asg a JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id GROUP BY 1)
SELECT p.point_id, CASE WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE round(CAST(c AS DOUBLE) / s, 9) END AS consensus
FROM pts p LEFT JOIN per USING (point_id)""")
def pair_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 (re-aimed): per point, co-clustered / co-sampled partner counts
    (0 when never co-sampled) -- its pooled consensus with everyone else."""
    pts, asg = _portable(spark, sf_dir, SUPPLIER)
    return cons.item_totals(asg, pts).select("point_id", "consensus")


_SUPPLIER_ASG = O.portable_sql(SUPPLIER, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)
_PART_ASG = O.portable_sql(PART, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)
LEAST_RATIO, LEAST_RATIO_PART = "0.8", "0.9"


@query("pair_at_least", f"""WITH RECURSIVE {_SUPPLIER_ASG}
SELECT a.point_id AS a, b.point_id AS b, CAST(count(*) AS BIGINT) AS s, CAST(sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS BIGINT) AS c,
       round(sum(CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0.0 END) / count(*), 9) AS ratio
FROM asg a JOIN asg b ON a.run = b.run AND a.point_id < b.point_id GROUP BY 1, 2
HAVING 10 * sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) >= 8 * count(*)""")
def pair_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4, K5 as pairs: all suppliers that were together in at least 0.8 of the runs that had both."""
    _, asg = _portable(spark, sf_dir, SUPPLIER)
    return PR.expand(PR.links_at_least(asg, K_CONSENSUS, RUNS, LEAST_RATIO)).withColumn("ratio", F.round("ratio", 9))


_PART_CLASSES = f"""WITH RECURSIVE {_PART_ASG},
tok AS (SELECT point_id, string_agg(run || ':' || cluster, ',' ORDER BY run) AS t, count(*) AS n FROM asg GROUP BY 1),
cls AS (SELECT t, min(point_id) AS class_id, min(n) AS n_runs, count(*) AS n_members FROM tok GROUP BY 1)"""


@query("pair_links_at_least", f"""{_PART_CLASSES},
rep AS (SELECT asg.* FROM asg JOIN cls ON asg.point_id = cls.class_id)
SELECT a.point_id AS a, b.point_id AS b, CAST(count(*) AS BIGINT) AS s, CAST(sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS BIGINT) AS c,
       round(sum(CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0.0 END) / count(*), 9) AS ratio
FROM rep a JOIN rep b ON a.run = b.run AND a.point_id < b.point_id GROUP BY 1, 2
HAVING 10 * sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) >= 9 * count(*)""")
def pair_links_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4, K5 on the parts: pairs of classes (parts with the same runs and clusters) with a ratio of 0.9 or more."""
    links = PR.links_at_least(_portable(spark, sf_dir)[1], K_CONSENSUS, RUNS, LEAST_RATIO_PART)
    return links.pairs.withColumn("ratio", F.round("ratio", 9))


@query("pair_class_members", f"""{_PART_CLASSES}
SELECT tok.point_id, class_id, CAST(n_runs AS BIGINT) AS n_runs, CAST(n_members AS BIGINT) AS n_members FROM tok JOIN cls USING (t)""")
def pair_class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every sampled part, named by its smallest member."""
    return PR.links_at_least(_portable(spark, sf_dir)[1], K_CONSENSUS, RUNS, LEAST_RATIO_PART).members


@query("pair_partners", f"""WITH RECURSIVE {_PART_ASG},
pr AS (SELECT a.point_id FROM asg a JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id GROUP BY a.point_id, b.point_id
       HAVING 10 * sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) >= 9 * count(*)),
n AS (SELECT point_id, count(*) AS n FROM pr GROUP BY 1)
SELECT p.point_id, CAST(coalesce(n, 0) AS BIGINT) AS n_partners FROM (SELECT DISTINCT point_id FROM asg) p LEFT JOIN n USING (point_id)""")
def pair_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other parts each part has a ratio of 0.9 or more with, from classes, without pairs of points."""
    return PR.partner_counts(PR.links_at_least(_portable(spark, sf_dir)[1], K_CONSENSUS, RUNS, LEAST_RATIO_PART))


@query("pair_of_points", f"""WITH RECURSIVE {_PART_ASG}
SELECT a.point_id AS a, b.point_id AS b, CAST(count(*) AS BIGINT) AS s, CAST(sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS BIGINT) AS c,
       round(sum(CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0.0 END) / count(*), 9) AS ratio
FROM asg a JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id WHERE a.point_id IN (1, 7, 50) GROUP BY 1, 2""")
def pair_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 under a point filter: three parts (the filter is the feature) against all others."""
    out = PR.pairs_of_points(_portable(spark, sf_dir)[1], K_CONSENSUS, RUNS, [1, 7, 50])
    return out.withColumn("ratio", F.round("ratio", 9))


@query("consensus_histogram_by_run", f"""WITH RECURSIVE {_SUPPLIER_ASG},
total AS (SELECT count(*) * (count(*) - 1) AS n FROM pts),
upto AS (SELECT r.range + 1 AS run, a.point_id AS pa, b.point_id AS pb, count(*) AS s, sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS c
         FROM range({RUNS}) r JOIN asg a ON a.run <= r.range JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id GROUP BY 1, 2, 3),
h AS (SELECT run, least(9, (10 * c) // s) AS bin, count(*) AS n FROM upto GROUP BY 1, 2),
grid AS (SELECT r.range + 1 AS run, b.range AS bin FROM range({RUNS}) r, range(10) b)
SELECT CAST(g.run AS INTEGER) AS run, CAST(g.bin AS INTEGER) AS bin, CAST(coalesce(h.n, 0) + CASE WHEN g.bin = 0
       THEN (SELECT n FROM total) - coalesce((SELECT sum(n) FROM h h2 WHERE h2.run = g.run), 0) ELSE 0 END AS BIGINT) AS n
FROM grid g LEFT JOIN h ON g.run = h.run AND g.bin = h.bin""")
def consensus_histogram_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 opened up: the histogram after each of the 20 runs of the suppliers."""
    pts, asg = _portable(spark, sf_dir, SUPPLIER)
    return cons.consensus_histogram_by_run(asg, pts.count(), K_CONSENSUS, RUNS).withColumn("n", F.col("n").cast("bigint"))


def _estimated(spark: SparkSession, sf_dir: str, fraction: float) -> DataFrame:
    pts, asg = _portable(spark, sf_dir)
    return EST.estimated_histogram(asg, pts.count(), K_CONSENSUS, RUNS, fraction).select(
        "bin", *[F.col(c).cast("bigint").alias(c) for c in ("n", "low", "high")], "exact")


@query("consensus_histogram_estimated_all", "SELECT bin, n, n AS low, n AS high, TRUE AS exact FROM ("
       + O.histogram_final_sql(PART, K_CONSENSUS, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS) + ")")
def consensus_histogram_estimated_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 by the estimator with all tiles taken: the exact histogram."""
    return _estimated(spark, sf_dir, 1.0)


@query("consensus_histogram_estimated")
def consensus_histogram_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 estimated from a fifth of the tiles, with 95 % intervals (sampling is the feature)."""
    return _estimated(spark, sf_dir, 0.2)


K_RANGE = (2, 3, 4, 5, 6)
_STABILITY_SQL = "WITH h AS (" + "\nUNION ALL ".join(
    f"SELECT {k} AS k, bin, n FROM ({O.histogram_final_sql(SUPPLIER, k, RUNS, seed=SAMPLE_SEED, steps=MAX_ITER_CONSENSUS)})" for k in K_RANGE) + """),
cum AS (SELECT k, bin, n, sum(n) OVER (PARTITION BY k ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY k) AS total FROM h),
st AS (SELECT k, sum(CAST(upto AS DOUBLE) / CAST(total AS DOUBLE)) / 10 AS area,
              sum(CASE WHEN bin BETWEEN 1 AND 8 THEN CAST(n AS DOUBLE) ELSE 0.0 END) / max(total) AS ambiguous FROM cum GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(area, 9) AS area,
       round(coalesce((area - lag(area) OVER (ORDER BY k)) / lag(area) OVER (ORDER BY k), area), 9) AS change,
       round(ambiguous, 9) AS ambiguous, row_number() OVER (ORDER BY round(ambiguous, 12), k) = 1 AS chosen FROM st"""


@query("k_stability", _STABILITY_SQL)
def k_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 with K7: which k of 2..6 clusters the suppliers most stably over 20 subsamples."""
    table = ST.choose_k(SUPPLIER.load(spark, sf_dir), list(K_RANGE), runs=RUNS, max_iter=MAX_ITER_CONSENSUS,
                        sample_seed=SAMPLE_SEED, fraction=FRACTION)
    return table.select("k", *[F.round(c, 9).alias(c) for c in ("area", "change", "ambiguous")], "chosen")


def above_mean(sample: DataFrame, k: int, max_iter: int, seed: int) -> DataFrame:
    """A plug-in clusterer: which points lie above the sample's mean (to 9 digits) in their first feature."""
    from pyspark.ml.functions import vector_to_array
    x = sample.select("point_id", vector_to_array("features")[0].alias("x0"))
    mean = x.agg(F.round(F.avg("x0"), 9).alias("m")).head()["m"]
    return x.select("point_id", (F.col("x0") > F.lit(mean)).cast("int").alias("cluster"))


@query("consensus_plugin", f"""WITH {O.sampled_sql(SUPPLIER, RUNS, SAMPLE_SEED, FRACTION)},
m AS (SELECT run, round(avg(x0), 9) AS m FROM mem GROUP BY run),
asg AS (SELECT run, point_id, CAST(x0 > m AS INTEGER) AS cluster FROM mem JOIN m USING (run)),
pr AS (SELECT count(*) AS s, sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS c
       FROM asg a JOIN asg b ON a.run = b.run AND a.point_id <> b.point_id GROUP BY a.point_id, b.point_id),
h AS (SELECT least(9, (10 * c) // s) AS bin, count(*) AS n FROM pr GROUP BY 1)
SELECT CAST(g.range AS INTEGER) AS bin, CAST(coalesce(h.n, 0) + CASE WHEN g.range = 0
       THEN (SELECT count(*) * (count(*) - 1) FROM pts) - (SELECT coalesce(sum(n), 0) FROM h) ELSE 0 END AS BIGINT) AS n
FROM range(10) g LEFT JOIN h ON g.range = h.bin""")
def consensus_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clusterer of one's own in the run loop (suppliers split at their sample's mean)."""
    pts = materialize(SUPPLIER.load(spark, sf_dir), "points")
    asg = cons.mllib_assignments(pts, above_mean, 2, 1, FIT_SEED, RUNS, SAMPLE_SEED, FRACTION)
    return cons.consensus_histogram(asg, pts.count(), 2, RUNS).select("bin", F.col("n").cast("bigint").alias("n"))


def _compare(spark: SparkSession, sf_dir: str, ps, k: int) -> DataFrame:
    pts = materialize(ps.load(spark, sf_dir), "points")
    n = pts.count()
    runs = cons.mllib_assignments_many(pts, list(C.ALGORITHMS), k, MAX_ITER_CONSENSUS, FIT_SEED, RUNS, SAMPLE_SEED, FRACTION)
    both = cons.consensus_compare({alg: cons.consensus_histogram(asg, n, k, RUNS, mode="final") for alg, asg in runs.items()})
    return both.select("bin", *[F.col(a).cast("bigint").alias(a) for a in C.ALGORITHMS])


@query("consensus_compare", f"""WITH {O.sampled_sql(PARITY, RUNS, SAMPLE_SEED, FRACTION)},
together AS (SELECT count(*) AS n FROM (SELECT DISTINCT a.point_id, b.point_id AS other FROM mem a JOIN mem b
             ON a.run = b.run AND a.point_id <> b.point_id AND a.point_id % 2 = b.point_id % 2)),
h AS (SELECT CAST(range AS INTEGER) AS bin, CAST(CASE range WHEN 9 THEN (SELECT n FROM together)
      WHEN 0 THEN (SELECT count(*) * (count(*) - 1) FROM pts) - (SELECT n FROM together) ELSE 0 END AS BIGINT) AS n FROM range(10))
SELECT bin, n AS kmeans, n AS bisecting, n AS gmm FROM h""")
def consensus_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K11 with MLlib: KMeans, bisecting k-means and Gaussian mixture, 20
    subsample fits each (k=2, maxIter=125, seed 1; the bisecting fits by MLlib's
    rules, all runs in one pass a step), final histograms side by side.  The parts lie in two far-apart groups: pairs of one group that were
    ever sampled together are always together, all others never."""
    return _compare(spark, sf_dir, PARITY, 2)


@query("consensus_compare_part")
def consensus_compare_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K11 as in ``consensus_compare`` on the parts as they are (k=5)."""
    return _compare(spark, sf_dir, PART, K_CONSENSUS)


# ------------------------------------------------------------ sources (S)

@query("src_parquet_points", PART.sql())
def src_parquet_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet scan to points; only the three needed columns are read."""
    return PART.load_wide(spark, sf_dir)


@query("src_csv_typed", "SELECT * FROM part")
def src_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with an explicit schema (the table is written as CSV to the shared
    folder first, then read back typed)."""
    part = read_table(spark, sf_dir, "part")
    path = scratch_path(spark, "part-csv")
    CSV.write_csv(part, path)
    return CSV.read_csv_typed(spark, path, part.schema)


@query("src_csv_quarantine", """SELECT CASE WHEN p_partkey % 10 = 0 OR p_partkey % 15 = 5 THEN 'bad' ELSE 'good' END AS kind, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN p_partkey % 10 = 0 OR p_partkey % 15 = 5 THEN length(CASE WHEN p_partkey % 10 = 0 THEN p_partkey || ',size ' || p_size
       ELSE p_partkey || ',' || p_size || ',extra' END) ELSE p_size END) AS BIGINT) AS total FROM part GROUP BY 1""")
def src_csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 with bad lines set aside: some parts are written with text for a number or one field too many; good rows are
    counted with their sizes, bad ones with the length of their text."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = F.when(F.col("p_partkey") % 10 == 0, F.concat(key, F.lit(",size "), size)).when(
        F.col("p_partkey") % 15 == 5, F.concat(key, F.lit(","), size, F.lit(",extra"))).otherwise(F.concat_ws(",", key, size))
    path = scratch_path(spark, "part-lines")
    read_table(spark, sf_dir, "part", ["p_partkey", "p_size"]).select(lines.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.LongType())])
    good, bad = CSV.read_csv_quarantined(spark, path, schema, header=False)
    n = F.count(F.lit(1)).cast("bigint").alias("n")
    return good.agg(F.lit("good").alias("kind"), n, F.sum("p_size").alias("total")).unionByName(
        bad.agg(F.lit("bad").alias("kind"), n, F.sum(F.length("line")).alias("total")))


_VIEW_SQL = """SELECT p_brand, CAST(count(*) AS BIGINT) AS n_parts, round(avg(p_retailprice), 6) AS avg_price,
       min(p_size) AS min_size, max(p_size) AS max_size
FROM {view} GROUP BY p_brand"""


@query("src_temp_view", _VIEW_SQL.format(view="part"))
def src_temp_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: register the table as a temp view and query it with SQL."""
    VIEWS.register_view(read_table(spark, sf_dir, "part"), "concord_parts")
    return VIEWS.query_view(spark, _VIEW_SQL.format(view="concord_parts"))


@query("src_libsvm", "SELECT CAST(p_size AS DOUBLE) AS label, CAST(p_size AS DOUBLE) / 50 AS f0, "
                     "(p_retailprice - 900) / 1200 AS f1 FROM part")
def src_libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIBSVM round trip (label = size, features = the two part features)."""
    from pyspark.ml.functions import vector_to_array
    part = read_table(spark, sf_dir, "part", ["p_size", "p_retailprice"])
    labeled = FT.to_features(part.select(
        "p_size", F.array(*[F.expr(e).cast("double") for e in PART.features]).alias("x")))
    path = scratch_path(spark, "part-libsvm")
    LIBSVM.write_libsvm(labeled, path, "p_size", "features")
    back = LIBSVM.read_libsvm(spark, path, 2)
    arr = vector_to_array("features")
    return back.select("label", arr[0].alias("f0"), arr[1].alias("f1"))


_CUSTOMER_COLS = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                  ("c_acctbal", "double"), ("c_mktsegment", "string"))


@query("profile_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(count(*) AS BIGINT) AS n_rows, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS n_nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer"
    for c, t in _CUSTOMER_COLS))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column count, nulls, distinct, min, max -- one aggregate pass."""
    return PROFILE.profile_columns(read_table(spark, sf_dir, "customer"))


@query("profile_sample", """SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
ORDER BY md5('1:' || c_custkey) LIMIT 20""")
def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 rows to look at, the same on any layout (the limit is the feature)."""
    return PROFILE.sample_rows(read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]), 20, ["c_custkey"])


@query("model_save_load", f"SELECT {PURCHASE_GROUP} AS cluster, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def model_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S6: fit, save to the shared folder, load, predict; sizes of the
    loaded model's predictions (a loaded model has no summary)."""
    pts = PURCHASE.load(spark, sf_dir)
    f = C.fit(pts, "kmeans", 2, 30, FIT_SEED)
    path = MODELS.save_model(f.model, scratch_path(spark, "model-kmeans"))
    loaded = MODELS.load_model("kmeans", path)
    g = C.Fit("kmeans", 2, loaded, loaded.transform(f.predictions.select("point_id", "features")))
    return (C.canonical_predictions(g, ["point_id"]).groupBy("cluster")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# ------------------------------------------------------------ features (F)

@query("feat_assemble", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS f0, c_acctbal AS f1 FROM customer")
def feat_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VectorAssembler over two customer columns."""
    from pyspark.ml.functions import vector_to_array
    df = FT.assemble(read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
                     ["c_nationkey", "c_acctbal"])
    arr = vector_to_array("features")
    return df.select("c_custkey", arr[0].alias("f0"), arr[1].alias("f1"))


_SEGMENT_RANK = """WITH f AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1 AS DOUBLE) AS segment_idx FROM f)
"""


@query("feat_string_index", _SEGMENT_RANK +
       "SELECT c.c_custkey, c.c_mktsegment, r.segment_idx FROM customer c JOIN r USING (c_mktsegment)")
def feat_string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """StringIndexer, most frequent first, ties alphabetical."""
    df, _ = FT.string_index(read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]),
                            "c_mktsegment", "segment_idx")
    return df.select("c_custkey", "c_mktsegment", "segment_idx")


_NAME_RANK = """WITH f AS (SELECT c_name, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT c_name, CAST(row_number() OVER (ORDER BY n DESC, c_name) - 1 AS DOUBLE) AS name_idx FROM f)
"""


@query("feat_string_index_table", _NAME_RANK + "SELECT c.c_custkey, c.c_name, r.name_idx FROM customer c JOIN r USING (c_name)")
def feat_string_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 at any cardinality: customer names indexed without a label list on the driver."""
    customers = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return STR.index_strings(customers, "c_name", STR.label_table(customers, "c_name"), "name_idx")


_FLAG_RANK = """WITH f AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY n DESC, l_returnflag) - 1 AS DOUBLE) AS flag_idx FROM f)
"""


@query("feat_index_labels", _FLAG_RANK + """SELECT l_returnflag, flag_idx, l_returnflag AS flag_back, CAST(count(*) AS BIGINT) AS n
FROM lineitem JOIN r USING (l_returnflag) GROUP BY 1, 2""")
def feat_index_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 and F4 on a column whose few labels each hold much of the table: indexed and turned back, counted."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_returnflag"])
    labels = STR.label_table(lines, "l_returnflag")
    back = STR.index_labels(materialize(STR.index_strings(lines, "l_returnflag", labels, "flag_idx"), "indexed"), "flag_idx", labels, "flag_back")
    return back.groupBy("l_returnflag", "flag_idx", "flag_back").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("feat_index_to_string", _SEGMENT_RANK +
       "SELECT c.c_custkey, r.segment_idx, c.c_mktsegment AS segment_back FROM customer c JOIN r USING (c_mktsegment)")
def feat_index_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index back to the string with the fitted indexer's labels."""
    df, model = FT.string_index(read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]),
                                "c_mktsegment", "segment_idx")
    return FT.index_to_string(df, "segment_idx", model.labels, "segment_back").select(
        "c_custkey", "segment_idx", "segment_back")


@query("feat_vector_index", """SELECT c_custkey,
  CAST(dense_rank() OVER (ORDER BY c_nationkey <> 0, c_nationkey) - 1 AS DOUBLE) AS nation_idx,
  c_acctbal AS acctbal FROM customer""")
def feat_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VectorIndexer(maxCategories=32): the nation slot becomes categorical
    (values sorted, 0 first), the balance slot stays continuous."""
    from pyspark.ml.functions import vector_to_array
    df = FT.assemble(read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
                     ["c_nationkey", "c_acctbal"])
    out, _ = FT.vector_index(df, "features", "indexed", 32)
    arr = vector_to_array("indexed")
    return out.select("c_custkey", arr[0].alias("nation_idx"), arr[1].alias("acctbal"))


# ---------------------------------------------------------- relational (R)

@query("points_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def points_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of the projected columns."""
    return P.distinct_points(read_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("points_count", """SELECT (SELECT CAST(count(*) AS BIGINT) FROM customer) AS n_rows,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS n_distinct""")
def points_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: rows before and after distinct, one row."""
    return P.count_points(read_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("points_vectors", """SELECT CAST(2 * count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT (p_size, p_retailprice)) AS BIGINT) AS n_vectors FROM part""")
def points_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R5 on vectors: every part as a dense vector and, read from LIBSVM, as a sparse one is one point."""
    part = read_table(spark, sf_dir, "part", ["p_size", "p_retailprice"])
    dense = FT.to_features(part.select("p_size", F.array(*[F.expr(e).cast("double") for e in PART.features]).alias("x")))
    path = scratch_path(spark, "part-vectors")
    LIBSVM.write_libsvm(dense, path, "p_size", "features")
    both = dense.select("features").unionByName(LIBSVM.read_libsvm(spark, path, 2).select("features"))
    return P.distinct_vectors(both).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_vectors"))


@query("points_keyed", "SELECT DISTINCT p_partkey AS point_id, p_size, p_retailprice FROM part")
def points_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 with a natural key."""
    return P.keyed_points(read_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "p_partkey")


_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("points_keyed_digest", f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS n_rows,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT {', '.join(_LINEITEM_COLS)} FROM lineitem)) AS n_points,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT {', '.join(_LINEITEM_COLS)} FROM lineitem)) AS n_ids""")
def points_keyed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 with the row digest (lineitem has no unique key): one id per distinct row."""
    li = read_table(spark, sf_dir, "lineitem", _LINEITEM_COLS)
    keyed = P.keyed_points(li, _LINEITEM_COLS)
    zero = F.lit(0).cast("bigint")
    n_rows = li.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), zero.alias("n_points"), zero.alias("n_ids"))
    ids = keyed.agg(zero.alias("n_rows"), F.count(F.lit(1)).cast("bigint").alias("n_points"),
                    F.count_distinct("point_id").cast("bigint").alias("n_ids"))
    # two one-row aggregates side by side: a union and a sum, no join needed
    return n_rows.unionByName(ids).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_rows", "n_points", "n_ids")])


@query("resample_membership", f"WITH {O.sampled_sql(PART, RUNS, SAMPLE_SEED, FRACTION)}\nSELECT run, point_id FROM mem")
def resample_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, point_id) of the 20 reproducible 90 % subsamples."""
    return RS.membership(PART.load(spark, sf_dir), RUNS, SAMPLE_SEED, FRACTION)


@query("resample_sizes", f"WITH {O.sampled_sql(PART, RUNS, SAMPLE_SEED, FRACTION)}\n"
                         "SELECT run, CAST(count(*) AS BIGINT) AS n FROM mem GROUP BY run")
def resample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsample size per run."""
    return RS.sample_sizes(PART.load(spark, sf_dir), RUNS, SAMPLE_SEED, FRACTION)


@query("train_test_split", "SELECT p_partkey AS point_id, "
       "substr(md5(concat_ws(':', 'split', '5043', CAST(p_partkey AS VARCHAR))), 1, 8) < 'cccccccc' AS is_train FROM part")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable 80 / 20 split by id hash (seed 5043)."""
    return RS.train_test_split(PART.load(spark, sf_dir), "point_id", 5043, 0.8).select("point_id", "is_train")


# ------------------------------------------------------------ clustering (C)

_PURCHASE_SQL = f"SELECT event_id AS point_id, {PURCHASE_GROUP} AS g, {PURCHASE.features[0]} AS x0 FROM events"


def _purchase_fit(spark: SparkSession, sf_dir: str, algorithm: str, max_iter: int = 30) -> C.Fit:
    return C.fit(PURCHASE.load(spark, sf_dir), algorithm, 2, max_iter, FIT_SEED)


def _sizes_and_centers(f: C.Fit) -> DataFrame:
    ids = C.canonical_ids(f)
    cent = C.centers_table(f.predictions.sparkSession, f.model)
    sizes = C.cluster_sizes(f)
    return (sizes.join(ids, "cluster").join(cent, "cluster")
            .select(F.col("rank").alias("cluster"), "n", F.round(F.col("center")[0], 6).alias("center")))


_SIZES_CENTERS_SQL = (f"SELECT g AS cluster, CAST(count(*) AS BIGINT) AS n, round(avg(x0), 6) AS center "
                      f"FROM ({_PURCHASE_SQL}) GROUP BY g")


@query("kmeans_fit", _SIZES_CENTERS_SQL)
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMeans k=2 on two far-apart groups: sizes and centers are exact."""
    return _sizes_and_centers(_purchase_fit(spark, sf_dir, "kmeans"))


@query("bisecting_fit", _SIZES_CENTERS_SQL)
def bisecting_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bisecting k-means k=2, same exact answer."""
    return _sizes_and_centers(_purchase_fit(spark, sf_dir, "bisecting"))


@query("gmm_fit", f"SELECT g AS cluster, CAST(count(*) AS BIGINT) AS n FROM ({_PURCHASE_SQL}) GROUP BY g")
def gmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian mixture k=2; hard assignments give the exact group sizes
    (means and covariances are soft estimates, not compared)."""
    f = _purchase_fit(spark, sf_dir, "gmm", 20)
    return C.canonical_predictions(f, ["point_id"]).groupBy("cluster").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("cluster_centers", f"SELECT g AS cluster, 0 AS dim, round(avg(x0), 6) AS value FROM ({_PURCHASE_SQL}) GROUP BY g")
def cluster_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: centers as long rows (cluster, dim, value)."""
    f = _purchase_fit(spark, sf_dir, "kmeans")
    ids = C.canonical_ids(f)
    return (C.cluster_centers(f).join(ids, "cluster")
            .select(F.col("rank").alias("cluster"), "dim", F.round("value", 6).alias("value")))


@query("cluster_sizes", """SELECT CAST(row_number() OVER (ORDER BY n DESC, event_type) - 1 AS INTEGER) AS cluster,
  CAST(n AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMeans k=5 on the indexed event type (five values): each value is
    its own cluster; sizes listed for every id, empty ones as 0."""
    ev, _ = FT.string_index(read_table(spark, sf_dir, "events", ["event_id", "event_type"]),
                            "event_type", "type_idx")
    pts = ev.select(F.col("event_id").alias("point_id"), F.array("type_idx").alias("x"))
    f = C.fit(pts, "kmeans", 5, 30, FIT_SEED)
    ids = C.canonical_ids(f)
    return C.cluster_sizes(f).join(ids, "cluster").select(F.col("rank").alias("cluster"), "n")


@query("cluster_wcss", f"""WITH p AS ({_PURCHASE_SQL}), m AS (SELECT g, avg(x0) AS mx FROM p GROUP BY g),
w AS (SELECT round(sum((x0 - mx) * (x0 - mx)), 6) AS wcss FROM p JOIN m USING (g))
SELECT 'kmeans' AS algorithm, wcss FROM w UNION ALL SELECT 'bisecting', wcss FROM w""")
def cluster_wcss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within-cluster sum of squares from predictions and final centers."""
    out = None
    for alg in ("kmeans", "bisecting"):
        w = C.wcss(_purchase_fit(spark, sf_dir, alg)).select("algorithm", F.round("wcss", 6).alias("wcss"))
        out = w if out is None else out.unionByName(w)
    return out


_MIXTURE_SQL = f"""p AS (SELECT point_id, x0, CAST(point_id % 5 = 0 AS INTEGER) AS g FROM ({FIFTH.sql()})),
st AS (SELECT g, count(*) AS n, avg(x0) AS m, var_pop(x0) AS v FROM p GROUP BY g),
total AS (SELECT count(*) AS n FROM p)"""


def _mixture(spark: SparkSession, sf_dir: str) -> C.Fit:
    return C.fit(FIFTH.load(spark, sf_dir), "gmm", 2, 100, FIT_SEED, restarts=RESTARTS)


@query("gmm_loglik", f"""WITH {_MIXTURE_SQL}
SELECT 2 AS k, round(sum(st.n * (ln(st.n / CAST(total.n AS DOUBLE)) - 0.5 * ln(2 * pi() * v) - 0.5)), 6) AS log_likelihood
FROM st, total""")
def gmm_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of a two-component mixture on two far-apart groups of
    parts, where it has a closed form in the groups' sizes and variances."""
    return C.gmm_loglik(_mixture(spark, sf_dir)).select("k", F.round("log_likelihood", 6).alias("log_likelihood"))


@query("gmm_loglik_loaded", f"""WITH {_MIXTURE_SQL}
SELECT 2 AS k, total.n AS n, round(sum(st.n * (ln(st.n / CAST(total.n AS DOUBLE)) - 0.5 * ln(2 * pi() * v) - 0.5)), 6) AS log_likelihood
FROM st, total GROUP BY total.n""")
def gmm_loglik_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 of any mixture: the same model saved, loaded (without a summary) and evaluated from its parameters."""
    f = _mixture(spark, sf_dir)
    loaded = MODELS.load_model("gmm", MODELS.save_model(f.model, scratch_path(spark, "model-gmm")))
    out = MIX.mixture_loglik(FIFTH.load(spark, sf_dir), MIX.Mixture.from_model(loaded))
    return out.select("k", "n", F.round("log_likelihood", 6).alias("log_likelihood"))


@query("gmm_parameters", f"""WITH {_MIXTURE_SQL}
SELECT g AS component, 'weight' AS param, -1 AS i, -1 AS j, round(st.n / CAST(total.n AS DOUBLE), 6) AS value FROM st, total
UNION ALL SELECT g, 'mean', 0, -1, round(m, 6) FROM st UNION ALL SELECT g, 'cov', 0, 0, round(v, 6) FROM st""")
def gmm_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, mean and covariance of each component (by mean) of the same mixture."""
    f = _mixture(spark, sf_dir)
    ids = C.canonical_ids(f)
    p = C.gmm_parameters(f)
    return p.join(F.broadcast(ids), p.component == ids.cluster).select(
        F.col("rank").alias("component"), "param", "i", "j", F.round("value", 6).alias("value"))


@query("gmm_parameters_part")
def gmm_parameters_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 on the parts as they are (k=3, maxIter=20)."""
    return C.gmm_parameters(C.fit(PART.load(spark, sf_dir), "gmm", 3, 20, FIT_SEED))


@query("assign_clusters", f"SELECT event_id AS point_id, {PURCHASE_GROUP} AS cluster FROM events")
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions appended to the input (one cluster per event)."""
    return C.canonical_predictions(_purchase_fit(spark, sf_dir, "kmeans"), ["point_id"])


@query("k_sweep", f"""WITH q AS (SELECT point_id % 3 AS g3, CAST(point_id % 3 = 2 AS INTEGER) AS g2, x0 FROM ({THIRDS.sql()})),
w AS (SELECT 3 AS k, sum(v) AS wcss FROM (SELECT count(*) * var_pop(x0) AS v FROM q GROUP BY g3)
      UNION ALL SELECT 2, sum(v) FROM (SELECT count(*) * var_pop(x0) AS v FROM q GROUP BY g2)),
{_MIXTURE_SQL},
rows AS (SELECT a.algorithm, k, 'wcss' AS metric, wcss AS value FROM w, (VALUES ('kmeans'), ('bisecting')) a(algorithm)
         UNION ALL SELECT 'gmm', 2, 'log_likelihood',
           sum(st.n * (ln(st.n / CAST(total.n AS DOUBLE)) - 0.5 * ln(2 * pi() * v) - 0.5)) FROM st, total)
SELECT algorithm, k, metric, round(value, 2) AS value,
       round(value - lag(value) OVER (PARTITION BY algorithm ORDER BY k), 2) AS change FROM rows""")
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k = 2, 3 for the k-means family on three groups of parts (at 0, 100
    and 10000: the best two clusters merge the first two), and a mixture with
    k = 2 on two groups; cost and its change per k."""
    means = E.k_sweep(THIRDS.load(spark, sf_dir), [2, 3], ("kmeans", "bisecting"), max_iter=30, seed=FIT_SEED)
    mixture = E.k_sweep(FIFTH.load(spark, sf_dir), [2], ("gmm",), max_iter=100, seed=FIT_SEED, restarts=RESTARTS)
    return means.unionByName(mixture).select("algorithm", "k", "metric", F.round("value", 2).alias("value"),
                                             F.round("change", 2).alias("change"))


@query("k_sweep_part")
def k_sweep_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k = 2..6 for the three algorithms on the parts as they are."""
    return E.k_sweep(PART.load(spark, sf_dir), [2, 3, 4, 5, 6], C.ALGORITHMS, max_iter=30, seed=FIT_SEED)


@query("silhouette", f"""WITH p AS ({_PURCHASE_SQL}),
st AS (SELECT g, count(*) AS n, sum(x0) AS fs, sum(x0 * x0) AS qs FROM p GROUP BY g),
d AS (SELECT p.g, s.g AS h, s.n,
             x0 * x0 + s.qs / s.n - 2 * (x0 * s.fs) / s.n AS dist, p.point_id FROM p JOIN st s ON TRUE),
pt AS (SELECT point_id,
              max(CASE WHEN g = h THEN dist * n / (n - 1) END) AS a,
              min(CASE WHEN g <> h THEN dist END) AS b,
              max(CASE WHEN g = h THEN n END) AS own_n FROM d GROUP BY point_id),
sc AS (SELECT CASE WHEN own_n = 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END AS s FROM pt)
SELECT 'kmeans' AS algorithm, 2 AS k, round(avg(s), 6) AS silhouette FROM sc""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: squared-Euclidean silhouette of the k=2 fit."""
    s = E.silhouette(_purchase_fit(spark, sf_dir, "kmeans"))
    return s.select("algorithm", "k", F.round("silhouette", 6).alias("silhouette"))


# ------------------------------------------------------------ importance (I)

@query("relabel_clusters", f"SELECT event_id AS point_id, CAST({PURCHASE_GROUP} AS DOUBLE) AS label FROM events")
def relabel_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bisecting k-means clusters renamed to the class label."""
    f = _purchase_fit(spark, sf_dir, "bisecting")
    return I.relabel(C.canonical_predictions(f, ["point_id"]), "cluster").select("point_id", "label")


def _usage_labeled(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """Per-user usage with its k-means cluster as the label, written once: the events are read once."""
    usage = FT.assemble(usage_table(spark, sf_dir), list(USAGE_FEATURES)).withColumnRenamed("user_id", "point_id")
    f = C.fit(usage, "kmeans", k, MAX_ITER_CONSENSUS, FIT_SEED)
    labeled = I.relabel(f.predictions, "prediction", "label", list(USAGE_FEATURES))
    return fixed_layout(labeled.select("point_id", "features", "label"))


@query("rf_importance", """SELECT a.algorithm, f.* FROM (VALUES ('kmeans'), ('bisecting')) a(algorithm),
(VALUES (0, 'shifted_size', 1.0::DOUBLE), (1, 'constant', 0.0::DOUBLE)) f(feature_idx, feature, importance)""")
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 - I3 from both clusterers: clusters of two far-apart groups of parts
    become classes; the forest (20 trees, depth 5, seed 5043) can only split on
    the feature that separates them, so the importances are 1 and 0."""
    pts = FT.assemble(PARITY.load(spark, sf_dir).select("point_id", F.col("x")[0].alias("shifted_size"), F.lit(3.0).alias("constant")),
                      ["shifted_size", "constant"])
    out = None
    for alg in ("kmeans", "bisecting"):
        labeled = I.relabel(C.fit(pts, alg, 2, MAX_ITER_CONSENSUS, FIT_SEED).predictions)
        imp = I.rf_importance(labeled).select(F.lit(alg).alias("algorithm"), "feature_idx", "feature",
                                              F.round("importance", 6).alias("importance"))
        out = imp if out is None else out.unionByName(imp)
    return out


@query("rf_importance_usage")
def rf_importance_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user usage -> KMeans k=4 -> forest (20 trees, depth 5,
    seed 5043) -> named importances."""
    imp = I.rf_importance(_usage_labeled(spark, sf_dir))
    return imp.select("feature_idx", "feature", F.round("importance", 6).alias("importance"))


@query("rf_importance_separable", """SELECT 0 AS feature_idx, 'is_purchase' AS feature,
  CAST(CASE WHEN count(DISTINCT event_type = 'purchase') = 2 THEN 1 ELSE 0 END AS DOUBLE) AS importance FROM events
UNION ALL SELECT 1, 'constant', CAST(0 AS DOUBLE)""")
def rf_importance_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 / I3 with a known answer: a feature equal to the label and a
    constant get importances exactly 1 and 0."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"]).select(
        F.col("event_id").alias("point_id"),
        F.expr(PURCHASE_GROUP).cast("double").alias("is_purchase"),
        F.lit(3.0).alias("constant"))
    df = FT.assemble(ev, ["is_purchase", "constant"]).withColumn("label", F.col("is_purchase"))
    imp = I.rf_importance(df)
    return imp.select("feature_idx", "feature", F.round("importance", 6).alias("importance"))


def _uninformative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with constant features and a class that one part in five has: a forest can only say the majority."""
    rows = read_table(spark, sf_dir, "part", ["p_partkey"]).select(
        F.col("p_partkey").alias("point_id"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"),
        (F.col("p_partkey") % 5 == 0).cast("double").alias("label"))
    return FT.assemble(rows, ["a", "b"])


@query("rf_holdout_score", """WITH s AS (SELECT CAST(p_partkey % 5 = 0 AS INTEGER) AS label,
  substr(md5(concat_ws(':', 'split', '5043', CAST(p_partkey AS VARCHAR))), 1, 8) < 'cccccccc' AS is_train FROM part),
major AS (SELECT label FROM s WHERE is_train GROUP BY label ORDER BY count(*) DESC LIMIT 1),
acc AS (SELECT avg(CASE WHEN label = (SELECT label FROM major) THEN 1.0 ELSE 0.0 END) AS p FROM s WHERE NOT is_train)
SELECT 'accuracy' AS metric, round(p, 6) AS value FROM acc UNION ALL SELECT 'f1', round(p * 2 * p / (1 + p), 6) FROM acc""")
def rf_holdout_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: forest trained on a stable 80 % of the rows, accuracy and weighted F1
    on the rest; with constant features it predicts the training majority."""
    return I.rf_holdout_score(_uninformative(spark, sf_dir), "point_id").select("metric", F.round("value", 6).alias("value"))


#: A part's group (one of five, by its key) and a class that follows it but for one part in seven.
_NOISY = "((p_partkey % 5 IN (1, 3)) <> (p_partkey % 7 = 0))"


def _informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part", ["p_partkey"]).select(
        F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 5).cast("double").alias("g"),
        F.expr(_NOISY).cast("double").alias("label"))
    return FT.vector_index(FT.assemble(rows, ["g"], "raw"), "raw", "features", 8)[0].select("point_id", "features", "label")


@query("rf_holdout_informative", f"""WITH s AS (SELECT p_partkey % 5 AS g, {_NOISY} AS label,
  substr(md5(concat_ws(':', 'split', '5043', CAST(p_partkey AS VARCHAR))), 1, 8) < 'cccccccc' AS is_train FROM part),
rule AS (SELECT g, avg(CAST(label AS INTEGER)) > 0.5 AS says FROM s WHERE is_train GROUP BY g),
t AS (SELECT label, says FROM s JOIN rule USING (g) WHERE NOT is_train),
per AS (SELECT l.label, (SELECT count(*) FROM t WHERE t.label = l.label) AS n,
               (SELECT count(*) FROM t WHERE t.label = l.label AND t.says = l.label) AS hit,
               (SELECT count(*) FROM t WHERE t.says = l.label) AS said FROM (SELECT DISTINCT label FROM t) l)
SELECT 'accuracy' AS metric, round((SELECT avg(CASE WHEN label = says THEN 1.0 ELSE 0.0 END) FROM t), 6) AS value
UNION ALL SELECT 'f1', round(sum(n * 2.0 * hit / (n + said)) / sum(n), 6) FROM per""")
def rf_holdout_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 on a feature that tells the class but for one part in seven: the forest says each group's majority."""
    return I.rf_holdout_score(_informative(spark, sf_dir), "point_id").select("metric", F.round("value", 6).alias("value"))


@query("rf_cross_validate_informative", f"""WITH s AS (SELECT p_partkey % 5 AS g, {_NOISY} AS label,
  CAST(CAST('0x' || substr(md5(concat_ws(':', 'fold', '5043', CAST(p_partkey AS VARCHAR))), 1, 7) AS INTEGER) % 3 AS INTEGER) AS fold FROM part),
f AS (SELECT DISTINCT fold FROM s),
rule AS (SELECT f.fold, g, avg(CAST(label AS INTEGER)) > 0.5 AS says FROM f JOIN s ON s.fold <> f.fold GROUP BY 1, 2),
acc AS (SELECT s.fold, avg(CASE WHEN s.label = r.says THEN 1.0 ELSE 0.0 END) AS p FROM s JOIN rule r ON s.fold = r.fold AND s.g = r.g GROUP BY 1)
SELECT d.max_depth, t.num_trees, (SELECT round(avg(p), 6) FROM acc) AS accuracy
FROM (VALUES (3), (5)) d(max_depth), (VALUES (10), (20)) t(num_trees)""")
def rf_cross_validate_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the grid on the same feature; every fold's rule is the majority of each group in the other folds."""
    cv = I.rf_cross_validate(_informative(spark, sf_dir), "point_id")
    return cv.select("max_depth", "num_trees", F.round("accuracy", 6).alias("accuracy"))


@query("rf_pipeline", """SELECT p_partkey AS point_id, CASE WHEN p_partkey % 5 IN (1, 3) THEN 'odd group' ELSE 'even group' END AS predicted,
  TRUE AS same_when_loaded FROM part""")
def rf_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4, F1-F4, S5, S6 as one: string and number columns indexed, assembled, a forest, its class named; the fitted
    pipeline saved, loaded and asked again."""
    rows = read_table(spark, sf_dir, "part", ["p_partkey"]).select(
        F.col("p_partkey").alias("point_id"), F.concat(F.lit("g"), F.col("p_partkey") % 5).alias("grp"), F.lit(3.0).alias("constant"),
        F.when(F.expr("p_partkey % 5 IN (1, 3)"), "odd group").otherwise("even group").alias("kind"))
    model = I.fit_class_pipeline(rows, ["grp"], ["constant"], "kind", "point_id")
    loaded = MODELS.load_model("pipeline", MODELS.save_model(model, scratch_path(spark, "model-pipeline")))
    first = I.predict_classes(model, rows.drop("kind"))
    again = I.predict_classes(loaded, rows.drop("kind")).select("point_id", F.col("predicted").alias("again"))
    return first.join(again, "point_id").select("point_id", "predicted", (F.col("predicted") == F.col("again")).alias("same_when_loaded"))


@query("rf_holdout_score_usage")
def rf_holdout_score_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 on the clustered users."""
    return I.rf_holdout_score(_usage_labeled(spark, sf_dir), "point_id")


@query("rf_cross_validate", """WITH s AS (SELECT CAST(p_partkey % 5 = 0 AS INTEGER) AS label,
  CAST(CAST('0x' || substr(md5(concat_ws(':', 'fold', '5043', CAST(p_partkey AS VARCHAR))), 1, 7) AS INTEGER) % 3 AS INTEGER) AS fold
  FROM part),
acc AS (SELECT f.fold, avg(CASE WHEN s.label = (SELECT label FROM s t WHERE t.fold <> f.fold GROUP BY label ORDER BY count(*) DESC LIMIT 1)
               THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT DISTINCT fold FROM s) f JOIN s ON s.fold = f.fold GROUP BY f.fold)
SELECT d.max_depth, t.num_trees, (SELECT round(avg(p), 6) FROM acc) AS accuracy
FROM (VALUES (3), (5)) d(max_depth), (VALUES (10), (20)) t(num_trees)""")
def rf_cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: 3-fold cross-validation of the forest over depth {3, 5} x trees {10, 20};
    with constant features every grid point scores the majority's share of each fold."""
    cv = I.rf_cross_validate(_uninformative(spark, sf_dir), "point_id")
    return cv.select("max_depth", "num_trees", F.round("accuracy", 6).alias("accuracy"))


@query("rf_cross_validate_usage")
def rf_cross_validate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the same grid on the clustered users."""
    cv = I.rf_cross_validate(_usage_labeled(spark, sf_dir), "point_id")
    return cv.select("max_depth", "num_trees", F.round("accuracy", 6).alias("accuracy"))
