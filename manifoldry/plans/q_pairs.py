"""Queries of neighbours (J10 to J12, J15, J17), quality (Q), statistics (R)."""

from pyspark.sql import functions as F

from manifoldry.operators import joins as J
from manifoldry.operators import neighbours as N
from manifoldry.operators import pairs as P
from manifoldry.operators import quality as Q
from manifoldry.operators import stats as R
from manifoldry.plans.common import VECTORS, T, r, vectors
from manifoldry.plans.registry import query

KNN = f"k AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.vec, b.vec), 12), b.id) AS rank FROM {VECTORS} a, {VECTORS} b WHERE a.id <> b.id)"
LOW = "(SELECT vec_id AS id, (embedding::DOUBLE[])[1:8] AS vec, label FROM embeddings)"


def low(spark, sf):
    return vectors(spark, sf).withColumn("vec", F.slice("vec", 1, 8))


@query("j10_knn", f"WITH {KNN} SELECT src, rank, dst, round(dist, 6) AS dist FROM k WHERE rank <= 15")
def j10(spark, sf):
    return N.knn(vectors(spark, sf), 15).withColumn("rank", F.col("rank").cast("long")).withColumn("dist", r(F.col("dist")))


@query("j11_knn_cosine", f"WITH k AS (SELECT a.id AS src, b.id AS dst, list_cosine_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_distance(a.vec, b.vec), 12), b.id) AS rank FROM {VECTORS} a, {VECTORS} b WHERE a.id <> b.id) SELECT src, rank, dst, round(dist, 6) AS dist FROM k WHERE rank <= 15")
def j11(spark, sf):
    return N.knn(vectors(spark, sf), 15, "cosine").withColumn("rank", F.col("rank").cast("long")).withColumn("dist", r(F.col("dist")))


@query("j12_nearest", f"""
WITH q AS (SELECT id, vec FROM {VECTORS} WHERE id % 5 = 0), v AS (SELECT id, vec FROM {VECTORS} WHERE id % 5 <> 0)
SELECT q.id AS src, arg_min(v.id, (round(list_distance(q.vec, v.vec), 12), v.id)) AS dst, round(min(list_distance(q.vec, v.vec)), 6) AS dist FROM q, v GROUP BY q.id""")
def j12(spark, sf):
    v = vectors(spark, sf)
    return N.nearest(v.where("id % 5 = 0"), v.where("id % 5 <> 0")).select("src", "dst", r(F.col("dist")).alias("dist"))


_DRAW = "('0x' || substr(md5('{s}:' || draw), 1, 12))::BIGINT"


@query("j15_random_pairs", f"""
WITH v AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {VECTORS}), d AS (SELECT unnest(range(1000)) AS draw, (SELECT count(*) FROM embeddings) AS n),
a AS (SELECT draw, n, {_DRAW.format(s=1)} % n AS a, 1 + {_DRAW.format(s=2)} % (n - 1) AS step FROM d)
SELECT draw, x.id AS id_a, y.id AS id_b, round(list_distance(x.vec, y.vec), 6) AS dist FROM a JOIN v x ON x.i = a.a JOIN v y ON y.i = (a.a + step) % a.n""")
def j15(spark, sf):
    """1000 pairs of distinct vectors, drawn by seeded hash, and their distances."""
    return P.random_pairs(vectors(spark, sf), 1000).withColumn("dist", r(F.col("dist")))


@query("j17_triangles", f"WITH {KNN}, e AS MATERIALIZED (SELECT src, dst FROM k WHERE rank <= 15 AND src < dst) SELECT x.src AS i, x.dst AS j, y.dst AS k FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN e z ON z.src = x.dst AND z.dst = y.dst")
def j17(spark, sf):
    return J.triangles(N.knn(vectors(spark, sf), 15))


_SIL = """
{n}_d AS (SELECT a.id, a.label AS own, b.label, avg(list_distance(a.vec, b.vec)) AS m FROM {v} a, {v} b WHERE a.id <> b.id GROUP BY ALL),
{n}_s AS (SELECT id, own AS label, max(m) FILTER (label = own) AS a, min(m) FILTER (label <> own) AS b FROM {n}_d GROUP BY ALL),
{n} AS (SELECT id, label, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM {n}_s)"""


@query("q1_silhouette", "WITH " + _SIL.format(v=VECTORS, n="z") + " SELECT id, label, round(silhouette, 6) AS silhouette FROM z")
def q1(spark, sf):
    return Q.silhouette(vectors(spark, sf), "label").withColumn("silhouette", r(F.col("silhouette")))


@query("q2_silhouette_delta", "WITH " + _SIL.format(v=VECTORS, n="z") + ", " + _SIL.format(v=LOW, n="y") + " SELECT id, z.label, round(y.silhouette - z.silhouette, 6) + 0.0 AS delta FROM z JOIN y USING (id)")
def q2(spark, sf):
    return Q.silhouette_delta(vectors(spark, sf), low(spark, sf), "label").select("id", "label", r(F.col("delta")).alias("delta"))


@query("q2_class_change", "WITH " + _SIL.format(v=VECTORS, n="z") + ", " + _SIL.format(v=LOW, n="y") + """, d AS (SELECT z.label, z.silhouette AS b, y.silhouette AS a, y.silhouette - z.silhouette AS delta FROM z JOIN y USING (id)), c AS (SELECT quantile_cont(abs(delta), 0.99) AS cut FROM d)
SELECT label, count(*) AS n, round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after, round(stddev_samp(delta), 6) AS std_delta, count(*) FILTER (abs(delta) > cut) AS n_outliers, round((avg(a) - avg(b)) / abs(avg(b)) * 100, 3) AS percent_change,
  round(quantile_cont(delta, 0.05), 6) + 0.0 AS q05, round(quantile_cont(delta, 0.5), 6) + 0.0 AS q50, round(quantile_cont(delta, 0.95), 6) + 0.0 AS q95 FROM d, c GROUP BY label""")
def q2_change(spark, sf):
    d = Q.silhouette_change(Q.silhouette_delta(vectors(spark, sf), low(spark, sf), "label"), "label")
    return d.select("label", "n", *[r(F.col(c)).alias(c) for c in ("mean_before", "mean_after", "std_delta")], "n_outliers", r(F.col("percent_change"), 3).alias("percent_change"), *[r(F.col(c)).alias(c) for c in ("q05", "q50", "q95")])


@query("q3_preservation", f"WITH {KNN}, " + KNN.replace("k AS MATERIALIZED (", "l AS MATERIALIZED (", 1).replace(VECTORS, LOW) + " SELECT round(count(*) / (15.0 * (SELECT count(*) FROM embeddings)), 6) AS preservation FROM k JOIN l USING (src, dst) WHERE k.rank <= 15 AND l.rank <= 15")
def q3(spark, sf):
    return Q.neighborhood_preservation(vectors(spark, sf), low(spark, sf)).select(r(F.col("preservation")).alias("preservation"))


@query("q4_distance_correlation", f"""
WITH s AS MATERIALIZED (SELECT a.id, a.vec, b.vec AS low FROM {VECTORS} a JOIN {LOW} b USING (id) ORDER BY md5('42:' || id), id LIMIT 2000),
p AS (SELECT round(list_distance(a.vec, b.vec), 9) AS x, round(list_distance(a.low, b.low), 9) AS y FROM s a JOIN s b ON a.id < b.id)
SELECT count(*) AS n_pairs, round(corr(rx, ry), 5) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)""")
def q4(spark, sf):
    """Of 2,000 rows in seeded order, the operator's own sample; all rows where there are no more."""
    return Q.distance_correlation(vectors(spark, sf), low(spark, sf), 2000).select("n_pairs", r(F.col("rho"), 5).alias("rho"))


@query("q5_knn_purity", f"""
WITH {KNN}, l AS (SELECT id, label FROM {VECTORS}), p AS (SELECT x.label, avg((x.label = y.label)::INT) AS purity FROM k JOIN l x ON x.id = src JOIN l y ON y.id = dst WHERE rank <= 15 GROUP BY ALL),
n AS (SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM l) AS prevalence FROM l GROUP BY label)
SELECT label, n, round(purity, 6) AS purity, round(prevalence, 6) AS prevalence, round(purity / prevalence, 6) AS enrichment FROM p JOIN n USING (label)""")
def q5(spark, sf):
    d = Q.knn_purity(vectors(spark, sf), "label", 15)
    return d.select("label", "n", *[r(F.col(c)).alias(c) for c in ("purity", "prevalence", "enrichment")])


@query("q6_knn_cv", f"""
WITH f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 5 AS fold FROM {VECTORS}),
k AS (SELECT a.id, a.fold, a.label AS own, b.label, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.vec, b.vec), 12), b.id) AS rank FROM f a, f b WHERE a.fold <> b.fold),
v AS (SELECT id, fold, own, label, count(*) AS c FROM k WHERE rank <= 5 GROUP BY ALL),
s AS (SELECT id, fold, own, arg_min(label, (-c, label)) AS said FROM v GROUP BY ALL)
SELECT fold::INT AS fold, round(a, 6) AS balanced_accuracy, round(avg(a) OVER (), 6) AS mean, round(stddev_pop(a) OVER (), 6) AS std FROM (SELECT fold, avg(r) AS a FROM (SELECT fold, own, avg((said = own)::INT) AS r FROM s GROUP BY ALL) GROUP BY fold)""")
def q6(spark, sf):
    return Q.knn_cv(vectors(spark, sf), "label").select("fold", *[r(F.col(c)).alias(c) for c in ("balanced_accuracy", "mean", "std")])


_SEEDS = """
WITH s AS MATERIALIZED (SELECT seed, a.id, a.vec, b.vec AS low FROM {v} a JOIN {l} b USING (id), (SELECT unnest([1, 2, 3, 4, 5]) AS seed) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || id), id) <= {n}),
p AS (SELECT a.seed, round(list_distance(a.vec, b.vec), 9) AS x, round(list_distance(a.low, b.low), 9) AS y FROM s a JOIN s b ON a.seed = b.seed AND a.id < b.id),
c AS (SELECT seed, corr(rx, ry) AS rho FROM (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY x) + (count(*) OVER (PARTITION BY seed, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY seed ORDER BY y) + (count(*) OVER (PARTITION BY seed, y) - 1) / 2.0 AS ry FROM p) GROUP BY seed)"""


@query("v6_seed_stability", _SEEDS.format(v=VECTORS, l=LOW, n=1000) + " SELECT seed::INT AS seed, round(rho, 5) AS rho, round(avg(rho) OVER (), 5) AS mean, round(stddev_samp(rho) OVER (), 5) AS std FROM c")
def v6(spark, sf):
    """Distance correlation of a sample of 1,000 rows, the operator's feature, for each of five seeds; mean and deviation over the seeds."""
    d = Q.seed_stability(vectors(spark, sf), low(spark, sf), 1000, [1, 2, 3, 4, 5])
    return d.select("seed", *[r(F.col(c), 5).alias(c) for c in ("rho", "mean", "std")])


_RANK = "(rank() OVER ({p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}{c}) - 1) / 2.0)"


@query("r1_spearman", f"SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT l_returnflag, {_RANK.format(p='PARTITION BY l_returnflag', c='l_quantity', g='l_returnflag, ')} AS x, {_RANK.format(p='PARTITION BY l_returnflag', c='l_extendedprice', g='l_returnflag, ')} AS y FROM lineitem) GROUP BY ALL")
def r1(spark, sf):
    return R.spearman(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", r(F.col("rho")).alias("rho"))


_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT unnest([l_returnflag, 'all']) AS panel, '{x}' AS a, '{y}' AS b, {x} AS u, {y} AS v FROM lineitem" for i, x in enumerate(_VARS) for y in _VARS[i + 1 :])


@query("r2_spearman_matrix", f"SELECT l_returnflag, a, b, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT panel AS l_returnflag, a, b, {_RANK.format(p='PARTITION BY panel, a, b', c='u', g='panel, a, b, ')} AS x, {_RANK.format(p='PARTITION BY panel, a, b', c='v', g='panel, a, b, ')} AS y FROM ({_LONG})) GROUP BY ALL")
def r2(spark, sf):
    """Each return flag is a panel, and all rows are one more."""
    return R.spearman_matrix(T(spark, sf, "lineitem"), _VARS, "l_returnflag", overall="all").select("l_returnflag", "a", "b", "n", r(F.col("rho")).alias("rho"))


#: Two-sided p of t and df: Simpson's rule over the density from 0 to |t|.
_T_P = "1 - 2 * (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma(({d} + 1) / 2.0) - lgamma({d} / 2.0) - ln({d} * pi()) / 2 - ({d} + 1) / 2.0 * ln(1 + (i * {t} / 2000) ** 2 / {d}))) * {t} / 6000 FROM (SELECT unnest(range(2001)) AS i))"
_NORMAL = "(SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((i * {z} / 2000) ** 2) / 2)) * {z} / 6000 / sqrt(2 * pi()) FROM (SELECT unnest(range(2001)) AS i))"
_C_VARS = ["c_acctbal", "c_nationkey", "c_custkey"]
_C_LONG = " UNION ALL ".join(f"SELECT c_mktsegment AS panel, '{x}' AS a, '{y}' AS b, {x}::DOUBLE AS u, {y}::DOUBLE AS v FROM c" for i, x in enumerate(_C_VARS) for y in _C_VARS[i + 1 :])


@query("r2_strongest", f"""
WITH c AS (SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, c_nationkey, c_custkey FROM customer), l AS ({_C_LONG}),
k AS (SELECT panel, a, b, {_RANK.format(p='PARTITION BY panel, a, b', c='u', g='panel, a, b, ')} AS x, {_RANK.format(p='PARTITION BY panel, a, b', c='v', g='panel, a, b, ')} AS y FROM l WHERE u IS NOT NULL AND v IS NOT NULL),
s AS (SELECT panel, a, b, count(*) AS n, corr(x, y) AS rho FROM k GROUP BY ALL HAVING count(*) >= 11), t AS (SELECT *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM s), p AS (SELECT *, {_T_P.format(t='t.t', d='(n - 2)')} AS p FROM t)
SELECT panel AS c_mktsegment, arg_min(a, (-abs(rho), a, b)) AS a, arg_min(b, (-abs(rho), a, b)) AS b, round(arg_min(rho, (-abs(rho), a, b)), 6) AS rho, round(arg_min(p, (-abs(rho), a, b)), 5) AS p,
  coalesce(list(a || '~' || b ORDER BY -abs(rho), a, b) FILTER (p < 0.05), []) AS significant FROM p GROUP BY panel""")
def r2_strongest(spark, sf):
    """Strongest pair and significant pairs of each panel; balances count where they are positive."""
    m = R.spearman_matrix(T(spark, sf, "customer"), _C_VARS, "c_mktsegment", p=True, mask={"c_acctbal": "c_acctbal"})
    return R.strongest(m, "c_mktsegment").withColumn("rho", r(F.col("rho"))).withColumn("p", r(F.col("p"), 5))


@query("r3_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def r3(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(F.corr("l_quantity", "l_extendedprice")).alias("r"))


@query("r4_linear_fit", """
WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n, avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY ALL),
g AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS s FROM f)
SELECT l_returnflag, x0, round(a + b * x0, 3) AS y0, round(a + b * x0 - 1.96 * s * sqrt(1 / n + (x0 - m) ** 2 / sxx), 3) AS lower, round(a + b * x0 + 1.96 * s * sqrt(1 / n + (x0 - m) ** 2 / sxx), 3) AS upper, round(r2, 6) AS r2 FROM g, (SELECT unnest([0.0, 10.0, 20.0, 30.0, 40.0, 50.0])::DOUBLE AS x0)""")
def r4(spark, sf):
    grid = spark.range(0, 51, 10).select(F.col("id").cast("double").alias("x0"))
    d = R.fit_band(R.linear_fit(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), grid)
    return d.select("l_returnflag", "x0", *[r(F.col(c), 3).alias(c) for c in ("y0", "lower", "upper")], r(F.col("r2")).alias("r2"))


@query("r4_slope_p", f"""
WITH f AS (SELECT c_mktsegment, regr_slope(c_acctbal, c_nationkey) AS slope, regr_r2(c_acctbal, c_nationkey) AS r2, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM f)
SELECT c_mktsegment, round(slope, 5) AS slope, round({_T_P.format(t='t.t', d='(t.n - 2)')}, 5) AS p, 0.05::DOUBLE AS beyond FROM t""")
def r4_slope_p(spark, sf):
    """p of the slope, and how much of t lies beyond the band's factor."""
    fit = R.linear_fit(T(spark, sf, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"], p=True)
    band = R.fit_band(fit, spark.range(1).select(F.lit(0.0).alias("x0")), factor=None)
    band = R.with_p(band.withColumn("df", F.col("n") - 2), "beyond", R.t_p, "factor", "df")
    return band.select("c_mktsegment", r(F.col("slope"), 5).alias("slope"), r(F.col("p"), 5).alias("p"), r(F.col("beyond")).alias("beyond"))


_PAIR = "(SELECT c.g, l_extendedprice AS v, (l_returnflag = 'A')::INT AS is_ref FROM lineitem, (SELECT unnest(['N', 'R']) AS g) c WHERE l_returnflag IN ('A', c.g))"


@query("r5_mann_whitney", f"SELECT g AS l_returnflag, count(*) FILTER (is_ref = 0) AS n1, count(*) FILTER (is_ref = 1) AS n2, round(sum(k) FILTER (is_ref = 0) - count(*) FILTER (is_ref = 0) * (count(*) FILTER (is_ref = 0) + 1) / 2.0, 3) AS u FROM (SELECT *, {_RANK.format(p='PARTITION BY g', c='v', g='g, ')} AS k FROM {_PAIR}) GROUP BY ALL")
def r5(spark, sf):
    return R.mann_whitney(T(spark, sf, "lineitem"), "l_returnflag", "A", "l_extendedprice").select("l_returnflag", "n1", "n2", r(F.col("u"), 3).alias("u"))


_C_PAIR = "(SELECT s.g, c_acctbal AS v, (c_mktsegment = 'BUILDING')::INT AS is_ref FROM customer, (SELECT DISTINCT c_mktsegment AS g FROM customer WHERE c_mktsegment <> 'BUILDING') s WHERE c_mktsegment IN ('BUILDING', s.g))"


@query("r5_one_sided", f"""
WITH k AS (SELECT *, {_RANK.format(p='PARTITION BY g', c='v', g='g, ')} AS k FROM {_C_PAIR}), n AS (SELECT g, count(*) FILTER (is_ref = 0) AS n1, count(*) FILTER (is_ref = 1) AS n2, sum(k) FILTER (is_ref = 0) AS s FROM k GROUP BY g),
t AS (SELECT g, sum(c ** 3 - c) AS ties FROM (SELECT g, v, count(*)::DOUBLE AS c FROM k GROUP BY ALL) GROUP BY g),
z AS (SELECT g, (s - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) AS off, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM n JOIN t USING (g)),
y AS (SELECT g, (off - 0.5) / sd AS z1, greatest(0, abs(off) - 0.5) / sd AS z2 FROM z)
SELECT g AS c_mktsegment, round(0.5 - {_NORMAL.format(z='y.z1')}, 5) AS p_greater, round(1 - 2 * {_NORMAL.format(z='y.z2')}, 5) AS p FROM y""")
def r5_one_sided(spark, sf):
    c = T(spark, sf, "customer")
    one, two = (R.mann_whitney(c, "c_mktsegment", "BUILDING", "c_acctbal", p=True, greater=g).select("c_mktsegment", r(F.col("p"), 5).alias(n)) for g, n in ((True, "p_greater"), (False, "p")))
    return one.join(two, "c_mktsegment")


@query("r6_shift", f"""
WITH d AS (SELECT g, v, sum(1 - is_ref) OVER w / sum(1 - is_ref) OVER (PARTITION BY g) AS a, sum(is_ref) OVER w / sum(is_ref) OVER (PARTITION BY g) AS b, sum(1 - is_ref) OVER (PARTITION BY g) AS n1, sum(is_ref) OVER (PARTITION BY g) AS n2 FROM {_C_PAIR} WINDOW w AS (PARTITION BY g ORDER BY v)),
x AS (SELECT g, max(abs(a - b)) AS d, max(abs(a - b)) * sqrt(any_value(n1) * any_value(n2) / (any_value(n1) + any_value(n2))) AS x FROM d GROUP BY g),
m AS (SELECT c_mktsegment AS g, median(c_acctbal) AS m FROM customer GROUP BY ALL)
SELECT g AS c_mktsegment, round(d, 6) AS d, sign(m - (SELECT m FROM m WHERE g = 'BUILDING'))::INT AS direction,
  round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, (SELECT 2 * sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * x * x)) FROM (SELECT unnest(range(1, 101)) AS i)))) END, 5) AS p FROM x JOIN m USING (g)""")
def r6_shift(spark, sf):
    d = R.ks_two_sample(T(spark, sf, "customer"), "c_mktsegment", "BUILDING", "c_acctbal", p=True)
    return d.select("c_mktsegment", r(F.col("d")).alias("d"), "direction", r(F.col("p"), 5).alias("p"))


@query("r6_kolmogorov_smirnov", f"SELECT g AS l_returnflag, round(max(abs(a - b)), 6) AS d FROM (SELECT g, v, sum(1 - is_ref) OVER w / sum(1 - is_ref) OVER (PARTITION BY g) AS a, sum(is_ref) OVER w / sum(is_ref) OVER (PARTITION BY g) AS b FROM {_PAIR} WINDOW w AS (PARTITION BY g ORDER BY v)) GROUP BY ALL")
def r6(spark, sf):
    return R.ks_two_sample(T(spark, sf, "lineitem"), "l_returnflag", "A", "l_extendedprice").select("l_returnflag", r(F.col("d")).alias("d"))


@query("r7_kruskal", f"""
WITH k AS (SELECT l_returnflag AS g, l_quantity AS v, {_RANK.format(p='', c='l_quantity', g='')} AS r FROM lineitem), c AS (SELECT count(*)::DOUBLE AS n, sum(r) AS s FROM k GROUP BY g),
t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM k GROUP BY v)), o AS (SELECT sum(n) AS n, count(*) AS k, sum(s * s / n) AS q FROM c),
h AS (SELECT n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM o, t)
SELECT n::BIGINT AS n, k, round(h, 4) AS h, round((h - k + 1) / (n - k), 6) AS eta2, (h - k + 1) / (n - k) < 0.06 AS small, round(exp(-h / 2), 5) AS p FROM h""")
def r7(spark, sf):
    """With three classes, p is exp(-h / 2)."""
    return R.kruskal(T(spark, sf, "lineitem"), "l_returnflag", "l_quantity", p=True).select("n", "k", r(F.col("h"), 4).alias("h"), r(F.col("eta2")).alias("eta2"), "small", r(F.col("p"), 5).alias("p"))


_TWO = "SELECT avg(x) FILTER (g = 'A') AS m1, avg(x) FILTER (g = 'R') AS m2, var_samp(x) FILTER (g = 'A') AS v1, var_samp(x) FILTER (g = 'R') AS v2, var_pop(x) FILTER (g = 'A') AS p1, var_pop(x) FILTER (g = 'R') AS p2, count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g = 'R') AS n2 FROM (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem)"


@query("r8_t_test", f"SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, n1 + n2 - 2 AS df FROM ({_TWO})")
def r8(spark, sf):
    return R.t_test(T(spark, sf, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice").select(r(F.col("t")).alias("t"), "df")


@query("r8_p", f"WITH s AS ({_TWO.replace('l_returnflag', 'c_mktsegment').replace('l_extendedprice', 'c_acctbal').replace('FROM lineitem', 'FROM customer').replace(chr(39) + 'A' + chr(39), chr(39) + 'BUILDING' + chr(39)).replace(chr(39) + 'R' + chr(39), chr(39) + 'MACHINERY' + chr(39))}), t AS (SELECT abs((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))) AS t, n1 + n2 - 2 AS df FROM s) SELECT round({_T_P.format(t='t.t', d='t.df')}, 5) AS p FROM t")
def r8_p(spark, sf):
    return R.t_test(T(spark, sf, "customer"), "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal", p=True).select(r(F.col("p"), 5).alias("p"))


@query("r9_cohens_d", f"SELECT round((m1 - m2) / sqrt(((n1 - 1) * p1 + (n2 - 1) * p2) / (n1 + n2 - 2)), 6) AS d FROM ({_TWO})")
def r9(spark, sf):
    return R.cohens_d(T(spark, sf, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice").select(r(F.col("d")).alias("d"))
