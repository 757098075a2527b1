from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.operators import density, gauss, geometry, joins, neighbours, pairs, quality, topology


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).normal(size=(60, 5))


@pytest.fixture(scope="module")
def vecs(spark, cloud):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(cloud)], "id long, vec array<double>, label int")


@pytest.mark.parametrize("n_blocks", [1, 3, 7])
def test_knn(vecs, cloud, n_blocks):
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r.src, r["rank"]): r.dst for r in neighbours.knn(vecs, 4, n_blocks=n_blocks).collect()}
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:4])}


def clusters(seed, n=600, dim=6, centres=12):
    """Tight clusters far apart, with repeated rows and a class each."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 20, (centres, dim))[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[:40]
    x[-5:] = 0
    return x, rng.integers(0, 3, n)


def brute_knn(x, label, k, metric, include_self=False, other=False, same=False, query=None):
    q = np.arange(len(x)) if query is None else query
    d = np.round(pairs.distances(x[q], x, metric), 12)
    if not include_self:
        d[np.arange(len(q)), q] = np.inf
    if other:
        d[label[q][:, None] == label[None, :]] = np.inf
    if same:
        d[label[q][:, None] != label[None, :]] = np.inf
    out = {}
    for i, row in zip(q.tolist(), d, strict=True):
        near = [int(j) for j in np.lexsort((np.arange(len(x)), row))[:k] if np.isfinite(row[j])]
        out[i] = [(j, round(float(row[j]), 7)) for j in near]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("kind", [{}, {"include_self": True}, {"other": True}, {"same": True}])
def test_knn_by_pivots(spark, monkeypatch, metric, kind):
    """Ties between repeated rows of a cell go to smaller ids, whichever block these are in."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    x, label = clusters(len(kind))
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, vec array<double>, label int")
    given = {k: (v if k == "include_self" else "label") for k, v in kind.items()}
    got = {}
    for r in neighbours.knn(df, 5, metric, **given).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, round(r.dist, 7)))
    assert got == brute_knn(x, label, 5, metric, **kind)


def test_knn_leaves_far_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    x, label = clusters(7, n=1600, centres=40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    seen = {}
    got = {}
    for r in neighbours.knn(df, 3, counter=seen).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, round(r.dist, 7)))
    assert got == brute_knn(x, label, 3, "euclidean")
    assert seen["compared"] < 0.1 * seen["all"]


def test_knn_of_other_rows_and_of_few(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    x, label = clusters(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in neighbours.knn(df, 4, include_self=True, query=df.where("id % 3 = 0")).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, round(r.dist, 7)))
    assert got == brute_knn(x, label, 4, "euclidean", include_self=True, query=np.arange(0, 600, 3))
    assert neighbours.knn(df.where("id < 3"), 5).count() == 6
    assert neighbours.knn(df.where("id < 0"), 5).count() == 0 and neighbours.knn(df.where("id < 0"), 5, n_blocks=20).count() == 0


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_silhouette(vecs, cloud, n_blocks):
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    lab = np.arange(60) % 3
    for r in quality.silhouette(vecs, "label", n_blocks).collect():
        means = {c: d[r.id][(lab == c) & (np.arange(60) != r.id)].mean() for c in range(3)}
        a, b = means[lab[r.id]], min(v for c, v in means.items() if c != lab[r.id])
        assert r.silhouette == pytest.approx((b - a) / max(a, b))


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_spanning_tree(vecs, cloud, n_blocks):
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    want = sorted(pairs.tree(np.arange(60), d)["dist"])
    got = sorted(r.death for r in topology.h0_persistence(vecs, n_blocks).collect())
    assert got[-1] == float("inf")
    assert got[:-1] == pytest.approx(want)


def test_spanning_tree_of_many_blocks_with_ties(spark, monkeypatch):
    """Points of a lattice, all of whose shortest edges are equal, and repeated points."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    x = np.array([(i % 12, i // 12) for i in range(144)] + [(3, 3)] * 5 + [(50, 50), (51, 50)], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    want = sorted(pairs.tree(np.arange(len(x)), pairs.distances(x, x))["dist"])
    got = sorted(r.death for r in topology.h0_persistence(df, 19).collect())
    assert got[-1] == float("inf") and got[:-1] == pytest.approx(want)
    assert topology.h0_persistence(df.where("id < 0")).count() == 0


def test_triangles_of_a_hub(spark):
    """The two ends of a star's edges are not paired over its hub."""
    star = spark.range(1, 100_001).selectExpr("0L AS src", "id AS dst")
    more = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 4)], "src long, dst long")
    got = sorted(tuple(r) for r in joins.triangles(star.unionByName(more)).collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 4, 5)]


def near_by_hand(texts, k=5, threshold=0.95):
    profiles, out = {}, {}
    for i, t in texts.items():
        total = len(t) - k + 1
        profiles[i] = {w: n / total for w, n in Counter(t[j : j + k] for j in range(total)).items()}
    for a, b in combinations(sorted(texts), 2):
        p, q = profiles[a], profiles[b]
        low = sum(min(p[w], q[w]) for w in p.keys() & q.keys())
        if low / (2 - low) > threshold:
            out[a, b] = low / (2 - low)
    return out


@pytest.mark.parametrize("kind", ["template", "alphabet"])
def test_near_duplicates_of_texts_with_the_same_kmers(spark, kind):
    rng = np.random.default_rng(5)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    if kind == "template":
        # Fields of pages that many others hold too: their k-mers are rarest, and all pages share the template's.
        head, fields = letters("abcdefghij", 300), [letters("klmnopqrst", 30) for _ in range(12)]
        texts = {i: head + "".join(fields[j] for j in rng.choice(12, 3, replace=False)) for i in range(160)}
    else:
        texts = {i: letters("ab", 40) + letters("acgt", 400) for i in range(160)}
    for i in range(0, 160, 8):  # near copies: one letter changed, or a few left out at the end
        texts[1000 + i] = texts[i][:350] + "z" + texts[i][351:]
        texts[2000 + i] = texts[i][:-3]
    df = spark.createDataFrame(list(texts.items()), "id long, seq string")
    expected = near_by_hand(texts)
    got = {(r.a, r.b): r.similarity for r in joins.near_duplicates(df, "id", "seq").collect() if texts[r.a] != texts[r.b]}
    firsts = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}
    expected = {(a, b): s for (a, b), s in expected.items() if firsts[texts[a]] == a and firsts[texts[b]] == b}
    assert got.keys() == expected.keys() and len(expected) >= 40
    assert all(abs(got[x] - expected[x]) < 1e-9 for x in got)
    one = spark.createDataFrame([(i, t) for t, i in firsts.items()], "id long, seq string")
    candidates = {(r.a, r.b) for r in joins.near_candidates(joins.kmer_profile(one, "id", "seq"), "id", 0.95).collect()}
    assert expected.keys() <= candidates and len(candidates) <= 1.2 * len(expected)


@pytest.mark.parametrize("alphabet", ["abcdefgh", "ab\u0109\U0001f600\U0001f601"])
def test_near_duplicates_make_no_table_of_all_kmers(spark, monkeypatch, alphabet):
    """What is written are whole texts, k-mers of prefixes, and pairs; holders of a k-mer are dealt to cells, and letters of any code point count."""
    from manifoldry.operators import joins

    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list(alphabet), n))
    texts = {i: text(500) for i in range(20)}
    for i in range(20):
        texts[100 + i] = texts[i][:496] + text(2)
    df = spark.createDataFrame(list(texts.items()), "id long, seq string")
    written, real = {}, joins.settled
    monkeypatch.setattr(joins, "settled", lambda d, label: written.setdefault(label, real(d, label)))
    monkeypatch.setattr(joins, "HOLDERS", 3, raising=False)
    got = {(r.a, r.b): r.similarity for r in joins.near_duplicates(df, "id", "seq").collect()}
    expected = near_by_hand(texts)
    assert got.keys() == expected.keys() and len(got) >= 15
    assert all(abs(got[x] - expected[x]) < 1e-12 for x in got)
    assert max(t.count() for t in written.values()) < 0.2 * sum(len({t[i : i + 5] for i in range(len(t) - 4)}) for t in texts.values())


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_scale_counts(vecs, cloud, n_blocks):
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    rows = topology.scale_counts(vecs, [0.1, 1.5, 2.0, 99.0], n_blocks).collect()
    assert [(r.e, r.t) for r in rows if r.s == 99.0] == [(60 * 59 // 2, 60 * 59 * 58 // 6)]
    for r in rows:
        near = d <= r.s
        e = sum(near[i, j] for i in range(60) for j in range(i))
        t = sum(near[i, j] and near[j, k] and near[i, k] for i in range(60) for j in range(i) for k in range(j))
        assert (r.v, r.e, r.t) == (60, e, t)


def test_condition_number_and_frames(vecs, cloud):
    knn = neighbours.knn(vecs, 8).persist()
    near = {}
    for r in knn.collect():
        near.setdefault(r.src, []).append(r.dst)
    for r in geometry.condition_number(knn, vecs).collect():
        e = np.abs(np.linalg.eigvalsh(np.cov(cloud[near[r.src]].T)))
        e = e[e > 1e-10]
        assert r.condition == pytest.approx(e.max() / e.min(), rel=1e-6)
    frames = geometry.local_frame(knn, vecs)
    for r in frames.collect():
        f = np.array(r.frame)
        assert f @ f.T == pytest.approx(np.eye(2), abs=1e-9)
    assert geometry.u1_defect(knn, frames).count() == 60
    assert geometry.so_defect(knn, frames).where("defect < -1e-9").count() == 0


def test_pca(vecs, cloud):
    scores, shares = geometry.pca(vecs, 2)
    x = cloud - cloud.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:2].tolist())
    got = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u * s)[:, :2], abs=1e-6)
    assert geometry.components_needed([0.5, 0.3], 0.9) is None


def test_dbscan(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (40, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got = {r.id: r.cluster for r in density.dbscan(df, 0.8, 5).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 80)} == {1} and got[80] == -1


def plane(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")


def brute_clusters(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    root = np.where(core, label, np.where(near & core[None, :], label[None, :], len(x)).min(1))
    names = {r: k for k, r in enumerate(sorted(set(root.tolist()) - {len(x)}))}
    return {i: names.get(int(r), -1) for i, r in enumerate(root)}


@pytest.mark.parametrize("seed,eps,least", [(0, 0.5, 4), (1, 1.0, 5), (2, 0.25, 3), (3, 1.0, 1)])
def test_dbscan_equals_brute_force(spark, seed, eps, least):
    """Clouds, a lattice with distances of exactly eps, repeated points, lone ones."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.uniform(-6, 6, (150, 2)), [(i * 0.5 + 10, j * 0.5) for i in range(6) for j in range(6)], [(20.0, 20.0)] * 4, [(30.0, 1.0), (31.0, 1.0), (32.0, 1.0)]])
    assert {r.id: r.cluster for r in density.dbscan(plane(spark, x), eps, least).collect()} == brute_clusters(x, eps, least)


def test_dbscan_of_cells_that_only_some_points_link(spark):
    """Full cells whose known cores are too far apart, although one point each is near."""
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 0.02, (200, 2)), rng.uniform(0, 0.02, (200, 2)) + [1.30, 0]
    x = np.concatenate([a, b, [(0.1495, 0.01)], [(1.1495, 0.01)]])
    assert {r.id: r.cluster for r in density.dbscan(plane(spark, x), 1.0, 5).collect()} == brute_clusters(x, 1.0, 5)


def test_dbscan_of_a_full_cell(spark):
    """A hundred thousand points that are all near each other, and some beside them."""
    dense = spark.range(100_000).selectExpr("id", "(id % 317) / 1000.0D AS x", "floor(id / 317) / 1000.0D AS y")
    more = spark.createDataFrame([(200_000, 1.1, 0.1), (200_001, 9.0, 9.0), (200_002, None, 1.0)], "id long, x double, y double")
    got = density.dbscan(dense.unionByName(more), 1.0, 5).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in got} == {0: 100_001, -1: 2}


def test_kernel_sums_by_cells(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.uniform(-40, 40, (60, 2)), [(2.0, 2.0)] * 40])
    for h in (0.05, 0.7, 30.0):
        want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * h * h)).sum(1)
        got = {r.id: r.total for r in gauss.gauss_sums(plane(spark, x), plane(spark, x), h).collect()}
        assert len(got) == len(x) and max(abs(got[i] - want[i]) for i in got) <= gauss.ERROR * len(x)
    far = {r.id: r.total for r in gauss.gauss_sums(plane(spark, [(1e4, 1e4), (0, 0)]), plane(spark, x), 0.7).collect()}
    assert far[0] == 0 and far[1] == pytest.approx(np.exp(-(x**2).sum(1) / 0.98).sum())


def test_empty_tables(spark):
    none = plane(spark, [])
    vec = none.selectExpr("id", "array(x, y) AS vec", "'c' AS label")
    assert density.kde(none).count() == density.density_raster(none, 5).count() == density.kde_grid(none.withColumn("g", F.lit("a")), 5, "g").count() == 0
    assert density.kde_1d(none.withColumn("g0", F.lit("a")), "x", spark.range(3).withColumnRenamed("id", "g"), "g0").count() == density.dbscan(none).count() == 0
    assert [tuple(r) for r in geometry.distance_concentration(vec, 2).collect()] == [(0, None, None, None, None, None)]
    scores, shares = geometry.pca(vec, 2)
    assert scores.count() == 0 and shares == []
    same = plane(spark, [(1, 1)] * 3)
    assert density.density_raster(same, 5).count() == 0 and [r.density for r in density.kde(same).collect()] == [None] * 3


def test_loop_on_a_plane(spark):
    n = 12
    at = [(i, float(np.cos(2 * np.pi * i / n)), float(np.sin(2 * np.pi * i / n))) for i in range(n)]
    points = spark.createDataFrame(at, "id long, x double, y double")
    vecs = spark.createDataFrame([(i, [x, y, 1.0]) for i, x, y in at], "id long, vec array<double>")
    config = spark.createDataFrame([("c", 0.0, 0.0, 1.0)], "path string, cx double, cy double, radius double")
    r = geometry.wilson_loop(geometry.circle_paths(config, n), points, vecs).head()
    assert r.n_points == n and r.wilson_loop > 0 and r.max_distance < 1e-9
