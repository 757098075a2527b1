import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.operators import geometry, joins, order, quality, stats, summary


def ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


@pytest.mark.parametrize("group", [None, ["g"]])
def test_average_ranks(spark, group):
    rng = random.Random(1)
    rows = [(i, i % 3, float(rng.randrange(8))) for i in range(60)]
    got = {r.id: r["rank"] for r in order.avg_rank(spark.createDataFrame(rows, "id long, g int, v double"), "v", group).collect()}
    for g in range(3) if group else [None]:
        part = [r for r in rows if g is None or r[1] == g]
        assert [got[r[0]] for r in part] == ranks([r[2] for r in part])


def test_index_and_even_sample(spark):
    df = spark.range(100).selectExpr("99 - id AS v")
    assert all(r["index"] == r.v for r in order.with_index(df, "v").collect())
    assert all(r.total == r.v * (r.v - 1) / 2 for r in order.running_total(df, "v", "v").collect())
    assert sorted(r.v for r in order.even_sample(df, 10, "v").collect()) == list(range(0, 100, 10))


def test_intervals_merge_when_they_touch(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 5, 8), (1, 9, 10), (1, 2, 3), (2, 1, 1)], "id long, start long, end long")
    assert sorted(map(tuple, order.merge_intervals(df, "id").collect())) == [(1, 1, 8), (1, 9, 10), (2, 1, 1)]


def test_quota_and_bootstrap(spark):
    df = spark.range(50).selectExpr("id", "CASE WHEN id < 40 THEN 'a' ELSE 'b' END AS g")
    assert order.quota_sample(df, "g", "id", 15).groupBy("g").count().orderBy("g").collect() == [("a", 15), ("b", 10)]
    reps = order.bootstrap(df, "g", "id", 12, 3).groupBy("g", "rep").count().collect()
    assert sorted(map(tuple, reps)) == [("a", 0, 12), ("a", 1, 12), ("a", 2, 12)]


def test_p_values():
    assert stats.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_p(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_p(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.kolmogorov_p(1.3581) == pytest.approx(0.05, abs=1e-4)


def test_tests_with_p(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", i + 4.5) for i in range(10)], "g string, v double")
    assert stats.mann_whitney(df, "g", "a", "v", p=True).head().u == sum(b > a for a in range(10) for b in [i + 4.5 for i in range(10)])
    assert stats.ks_two_sample(df, "g", "a", "v", p=True).head().d == pytest.approx(0.5)
    assert 0 < stats.kruskal(df, "g", "v", p=True).head().p < 0.05
    assert 0 < stats.t_test(df, "g", "a", "b", "v", p=True).head().p < 0.01
    rho = stats.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "x double, y double"), "x", "y", p=True).head()
    assert rho.rho == pytest.approx(1) and rho.p == 0


def test_scale_curve(spark):
    df = spark.createDataFrame([("g", 0.0, 2.0), ("g", 1.0, 3.0)], "g string, birth double, death double")
    s = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "s double")
    assert [r.alive for r in joins.scale_curve(df, s, ["g"]).orderBy("s").collect()] == [1, 2, 1, 0]


def test_near_duplicates_find_all_pairs(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("ABCDEFGH") for _ in range(400))
    rows = [(i, base[: 390 + i]) for i in range(6)] + [(i, "".join(rng.choice("ABCDEFGH") for _ in range(300))) for i in range(6, 12)]
    got = {(r.a, r.b) for r in joins.near_duplicates(spark.createDataFrame(rows, "id long, seq string"), "id", "seq").collect()}

    def profile(s):
        out = {}
        for i in range(len(s) - 4):
            out[s[i : i + 5]] = out.get(s[i : i + 5], 0) + 1 / (len(s) - 4)
        return out

    p = {i: profile(s) for i, s in rows}
    want = {(a, b) for a in p for b in p if a < b and (low := sum(min(v, p[b].get(k, 0)) for k, v in p[a].items())) / (2 - low) > 0.95}
    assert got == want and want


def test_histogram_of_equal_values(spark):
    assert summary.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 5, []).head().n == 2
    assert math.isclose(summary.ecdf(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v", []).orderBy("v").head().share, 0.5)


def test_percentiles_of_groups(spark):
    rng = random.Random(9)
    rows = [(g, float(rng.randrange(20)) if rng.random() > 0.1 else None) for g in ("a", "b", None) for _ in range(60)] + [("empty", None)]
    got = {r.g: (r.lo, r.mid) for r in order.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"lo": 0.1, "mid": 0.5}, ["g"]).collect()}

    def at(values, p):
        values, k = sorted(values), p * (len(values) - 1)
        i = int(k)
        return values[i] + (values[min(i + 1, len(values) - 1)] - values[i]) * (k - i)

    for g in ("a", "b", None):
        values = [v for x, v in rows if x == g and v is not None]
        assert all(math.isclose(a, at(values, p)) for a, p in zip(got[g], (0.1, 0.5), strict=True))
    assert got["empty"] == (None, None)


def test_running_totals_within_groups(spark):
    rows = [(i % 3, i, i % 5) for i in range(90)]
    got = order.running_total(spark.createDataFrame(rows, "g int, at int, v int"), "v", "at", group=["g"]).collect()
    assert all(r.total == sum(v for g, at, v in rows if g == r.g and at < r["at"]) for r in got)


def test_t_quantile_and_tails():
    assert math.isclose(stats.t_quantile(0.95, 10), 2.2281388520, rel_tol=1e-8)
    assert math.isclose(stats.t_quantile(0.99, 3), 5.8409093097, rel_tol=1e-8)
    assert math.isclose(stats.upper_p(1.6448536270), 0.05, rel_tol=1e-8)


def one_key(spark, n=4000, seed=1):
    """One key whose rows span many range partitions, and a few small ones."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(20_000), rng.randrange(1, 12)) for _ in range(n)] + [(k, rng.randrange(50), rng.randrange(0, 9)) for k in "abc" for _ in range(20)]
    return [(k, s, s + w) for k, s, w in rows] + [("hot", 5, 3), ("hot", 5, 3), ("hot", 7, 7), ("hot", 7, 7), (None, 1, 2), (None, 2, 5)]


def test_intervals_of_one_key_over_many_partitions(spark):
    rows = one_key(spark)
    want = []
    for key in {r[0] for r in rows}:
        reach = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if reach is None or s > reach:
                want.append([key, s, e])
            reach = e if reach is None else max(reach, e)
            want[-1][2] = max(want[-1][2], e)
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(7)
    parts = order._ranged(df, "k", "start").where("k = 'hot'").select("_p").distinct().count()
    assert parts > 1
    got = [(r.k, r.start, r.end) for r in order.merge_intervals(df, "k").collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)
    assert order.merge_intervals(df.where("false"), "k").count() == 0


def test_scans_across_partitions(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.randrange(100)) for i in range(900)] + [("b", 0, 4)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    best = {(r.k, r.i): r.reach for r in order.running_max(df, "v", "i", group=["k"]).collect()}
    after = {(r.k, r.i): r.next for r in order.following(df, ["v"], "i", "k").collect()}
    values = [v for k, _, v in rows if k == "a"]
    assert best == {("a", i): max(values[:i], default=None) for i in range(900)} | {("b", 0): None}
    assert {x: n and n.v for x, n in after.items()} == {("a", i): (values[i + 1] if i < 899 else None) for i in range(900)} | {("b", 0): None}


def test_bootstrap_draws_the_least(spark):
    df = spark.createDataFrame([("big" if i % 5 else "small", i) for i in range(5000)] + [("tiny", -1)], "g string, id long")
    got = {}
    for r in order.bootstrap(df, "g", "id", 30, 4).collect():
        got.setdefault((r.rep, r.g), set()).add(r.id)
    draw = lambda rep, i: hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()
    for rep in range(4):
        for g, ids in (("big", [i for i in range(5000) if i % 5]), ("small", list(range(0, 5000, 5)))):
            assert got.pop((rep, g)) == set(sorted(ids, key=lambda i: (draw(rep, i), i))[:30])
    assert not got


def test_letters_are_counted_in_batches(spark, monkeypatch):
    monkeypatch.setattr(summary, "LETTERS", 7)
    rows = [("x", 1, "abca\U0001f600"), ("x", 1, ""), ("x", None, "é" * 20), (None, 2, "aa"), (None, 2, None), ("x", 1, "a")]
    df = spark.createDataFrame(rows, "g string, h long, s string")
    got = {(r.g, r.h, r.letter): (r.n, round(r.percent, 6)) for r in summary.composition(df, "s", ["g", "h"]).collect()}
    assert got == {("x", 1, "a"): (3, 50.0), ("x", 1, "b"): (1, 16.666667), ("x", 1, "c"): (1, 16.666667), ("x", 1, "\U0001f600"): (1, 16.666667), ("x", None, "é"): (20, 100.0), (None, 2, "a"): (2, 100.0)}


def test_centre_of_flagged_points(spark):
    df = spark.createDataFrame([(0.0, 1.0, True), (2.0, 3.0, True), (10.0, 10.0, False)], "x double, y double, f boolean")
    assert tuple(geometry.flagged_centre(df, F.col("f")).head()) == (1.0, 2.0)
    assert tuple(geometry.flagged_centre(df, F.lit(False)).head()) == (4.0, 14 / 3)
    assert tuple(geometry.flagged_centre(df.where("false"), F.col("f")).head()) == (None, None)


def test_samples_of_too_many_rows_are_refused(spark):
    df = spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")
    with pytest.raises(ValueError):
        quality.distance_correlation(df, df, quality.MOST_SAMPLED + 1)


def test_curve_over_many_partitions(spark):
    """A long curve equals the same curve cut to pieces that fit one partition; short ones are left out."""
    rng = np.random.default_rng(3)
    p = np.cumsum(rng.normal(size=(700, 3)), axis=0)
    df = spark.createDataFrame([("long", i, *map(float, v)) for i, v in enumerate(p)] + [("four", i, *map(float, v)) for i, v in enumerate(p[:4])] + [("three", i, *map(float, v)) for i, v in enumerate(p[:3])], "k string, i long, x double, y double, z double").repartition(6)
    assert order._ranged(df, "k", "i").where("k = 'long'").select("_p").distinct().count() > 1
    d, eps = np.diff(p, axis=0), 1e-10
    e = np.diff(d, axis=0)
    kappa = np.linalg.norm(e, axis=1)
    t, n = d[:-1] / (np.linalg.norm(d[:-1], axis=1, keepdims=True) + eps), e / (kappa[:, None] + eps)
    b = np.cross(t, n)
    tau = -((b[1:] - b[:-1]) * n[:-1]).sum(1)
    tau = np.concatenate([tau[:1], tau])
    got = {(r.k, r.i): (r.kappa, r.tau) for r in order.frenet(df, "k", "i").collect()}
    want = {("long", i): (kappa[i], tau[i]) for i in range(698)} | {("four", i): (kappa[i], tau[i]) for i in range(2)}
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x]) for x in want)
    curve = spark.createDataFrame([("c", i, float(a), float(c)) for i, (a, c) in enumerate(zip(kappa, tau, strict=True))], "k string, i long, kappa double, tau double").repartition(5)
    errors = {r.i: r.error for r in order.residue_error(curve, "k", "i").collect()}
    th = lambda v: np.arctan2(np.diff(v), v[:-1] + 1e-10)
    assert [errors[i] for i in range(697)] == pytest.approx(np.arccos(np.clip(np.cos(th(kappa)) * np.cos(th(tau)), -1, 1)).tolist())
