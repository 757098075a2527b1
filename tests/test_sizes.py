"""Faults that only larger or uneven tables show."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.plans import catalogue, registry  # noqa: F401
from manifoldry.sources import files as S


def embeddings(spark, folder, vectors, start=0):
    rows = [(start + i, [float(x) for x in v], f"c{i % 3}") for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def by_sql(folder, name, table="embeddings"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(registry.ORACLES[name])
    return sorted(repr(tuple(dict(zip([c[0] for c in cur.description], r, strict=True)).items())) for r in cur.fetchall())


def by_spark(spark, folder, name):
    return sorted(repr(tuple(r.asDict().items())) for r in registry.QUERIES[name](spark, str(folder)).collect())


def test_control_keys_beyond_four_digits(spark):
    keys = S.generate_control(spark, 12_000, "AB", [1, 1]).select("seq_id")
    assert keys.distinct().count() == 12_000
    assert keys.where(F.col("seq_id").startswith("control|random|random_0001|")).count() == 1


@pytest.mark.parametrize("name", ["v1_mean_pool", "v2_region_pool"])
def test_small_negative_means_keep_their_sign(spark, tmp_path, name):
    x = np.zeros((30, 64))
    x[:, 0], x[:, 1], x[:, 2] = -1e-8, 1e-8, 0.5
    embeddings(spark, tmp_path, x)
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert all(math.copysign(1, r.pooled[0]) == -1 and math.copysign(1, r.pooled[1]) == 1 for r in got)
    assert by_spark(spark, tmp_path, name) == by_sql(tmp_path, name)


@pytest.mark.parametrize("n", [28, 53, 58])
def test_region_pool_of_a_last_group_too_short_for_its_regions(spark, tmp_path, n):
    embeddings(spark, tmp_path, np.random.default_rng(2).normal(size=(n, 64)))
    assert by_spark(spark, tmp_path, "v2_region_pool") == by_sql(tmp_path, "v2_region_pool")


def test_adjacent_cosine_of_a_short_last_group(spark, tmp_path):
    embeddings(spark, tmp_path, np.random.default_rng(1).normal(size=(53, 64)))
    got = by_spark(spark, tmp_path, "w8_adjacent_cosine")
    assert len(got) == 24 + 24 + 2 and got == by_sql(tmp_path, "w8_adjacent_cosine")


def test_equal_vectors_are_at_no_distance(spark):
    """Copies tie at 0, so that smaller ids come first; what is left of large squares would put them in any order."""
    from manifoldry.operators import neighbours

    x = np.random.default_rng(5).normal(size=(1, 64)) * 100
    df = spark.createDataFrame([(i, x[0].tolist()) for i in range(40)], "id long, vec array<double>")
    got = {(r.src, r["rank"]): (r.dst, r.dist) for r in neighbours.knn(df, 3, n_blocks=4).collect()}
    assert all(got[(i, k + 1)] == (j, 0.0) for i in range(40) for k, j in enumerate([j for j in range(40) if j != i][:3]))


def test_blocks_travel_to_cells_not_to_each_other(spark):
    """Up to 512 blocks, each goes to 24 cells at most, however many it meets."""
    from manifoldry.operators import pairs

    sent = []
    for n in (128, 256):
        rows = spark.range(n).select(F.col("id").cast("int").alias("block"), F.lit(0).alias("rows"))
        met = rows.select(F.col("block").alias("a")).crossJoin(rows.select(F.col("block").alias("b")))
        sent.append(pairs.lanes(met, rows, rows, n, n).count() / n)
    assert max(sent) <= 24


def test_sums_by_class_for_any_type_of_label(spark):
    from manifoldry.operators import pairs

    x = np.random.default_rng(6).normal(size=(30, 6))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for kind, name in (("int", int), ("string", str)):
        df = spark.createDataFrame([(i, v.tolist(), name(i % 2)) for i, v in enumerate(x)], f"id long, vec array<double>, label {kind}")
        for r in pairs.label_sums(df, "label", 3).collect():
            mine = np.arange(30) % 2 == int(r.label)
            assert r.total == pytest.approx(d[r.id][mine].sum()) and r.n == mine.sum() - mine[r.id]


def test_kmers_do_not_travel(spark):
    """Only the texts are shuffled: counts and shares of a key are made where its text is."""
    from manifoldry.operators.joins import kmer_profile

    df = spark.createDataFrame([(1, "ABCABCABC"), (1, "ABCAB"), (2, "ABC"), (3, "AAAAAA")], "id long, seq string")
    out = kmer_profile(df, "id", "seq")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.id, r.kmer): r.n for r in out.collect()} == {(1, "ABCAB"): 3, (1, "BCABC"): 2, (1, "CABCA"): 1, (3, "AAAAA"): 2}


def test_kmers_take_one_pass(spark):
    from manifoldry.functions.scalars import kmers

    texts = ["ab\nc😀déf", "abcde", "abcd", "", None, "A" * 300_000]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "s string").select(kmers(F.col("s")).alias("k")).collect()]
    assert got == [[(t or "")[i : i + 5] for i in range(len(t or "") - 4)] for t in texts]


def test_a_block_meets_itself_in_one_order(spark, monkeypatch):
    """Rows of a shuffle come in any order; two packings of one table then have pairs (i, j), i < j, twice or not at all."""
    from manifoldry.operators import pairs

    made, real = [], pairs.packed

    def packed(df, n_blocks, cols):
        made.append(0)
        order = F.array_sort if len(made) % 2 else lambda c: F.reverse(F.array_sort(c))
        return real(df, n_blocks, cols).withColumn("rows", order("rows"))

    monkeypatch.setattr(pairs, "packed", packed)
    df = spark.createDataFrame([(i, [float(i), i * i / 7]) for i in range(20)], "id long, vec array<double>")
    got = [(r.i, r.j) for r in pairs.near(df, float("inf"), 3).collect()]
    assert sorted(got) == [(i, j) for i in range(20) for j in range(i + 1, 20)]


def test_spanning_tree_searches_for_few_rows(spark, monkeypatch):
    """Only rows whose near ones all share their component, and not those of the largest one, are searched for."""
    from manifoldry.operators import neighbours, topology

    x = np.random.default_rng(3).normal(size=(300, 3))
    x[:40] = x[0] + np.random.default_rng(4).normal(size=(40, 3)) * 1e-3
    asked, real = [], neighbours.knn

    def knn(df, k, **more):
        asked.append((df if more.get("query") is None else more["query"]).count())
        return real(df, k, **more)

    monkeypatch.setattr(neighbours, "knn", knn)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = sorted(r.death for r in topology.h0_persistence(df, 2).collect())
    want = sorted(r.death for r in topology.h0_persistence(df, 1).collect())
    assert got == pytest.approx(want) and sum(asked[1:]) < 100


def test_triples_travel_as_blocks_of_three_groups(spark, monkeypatch):
    """Counts are the same with any number of blocks, in rows of one block each."""
    from manifoldry.operators import topology

    x = np.random.default_rng(8).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    widest, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (widest.append(self.columns), real(self, *a, **k))[1])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag([np.inf] * 60)
    got = {r.s: (r.e, r.t) for r in topology.scale_counts(df, [0.5, 1.5, 2.5, 99.0], 9).collect()}
    near = {s: (d <= s).astype(int) for s in got}
    assert got == {s: (m.sum() // 2, np.trace(m @ m @ m) // 6) for s, m in near.items()}
    assert ["a", "b", "c", "block", "rows"] in widest


def test_blocks_of_a_table_travel_to_cells_not_to_each_other(spark, monkeypatch):
    """Moments and near pairs of 40 blocks: a block of rows is a row for each cell that it goes to, at most 16, where it was one for each of 40 others."""
    from manifoldry.operators import pairs

    x = np.random.default_rng(5).normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    sent, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (sent.append(self.where("rows is not null").count()), real(self, *a, **k))[1])
    got = pairs.pair_moments(df, 0.7, 40).head()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(200, 1)]
    assert [got.n, got.s, got.q, got.lo, got.hi, got.k] == pytest.approx([len(d), d.sum(), (d * d).sum(), d.min(), d.max(), np.exp(-d * d / (2 * 0.7**2)).sum()])
    assert len(sent) == 1 and sent[0] <= 16 * 40


@pytest.mark.parametrize("edges", [20, 1 << 20])
def test_curvature_sends_edges_as_ids(spark, monkeypatch, edges):
    """With many cells and a hub that all rows are near to, curvature is that by hand; vectors travel in rows of their own, not with each edge."""
    from manifoldry.operators import geometry, neighbours

    x = np.random.default_rng(7).normal(size=(90, 3))
    x[0], x[1] = 0, x[2]  # equal rows have an edge of no length
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    monkeypatch.setattr(geometry, "EDGES", edges, raising=False)
    knn = neighbours.knn(df, 5).persist()
    short = knn.where("src % 7 > 0 or rank < 4")  # lists of different lengths
    near = {}
    for r in short.orderBy("src", "rank").collect():
        near.setdefault(r.src, []).append((r.dst, r.dist))
    types, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (types.extend(t for _, t in self.dtypes), real(self, *a, **k))[1])
    got = {r.src: r.curvature for r in geometry.ricci_curvature(short, df).collect()}
    at = {i: x[[j for j, _ in v]] for i, v in near.items()}
    w = lambda i, j: np.sqrt(((at[i][:, None] - at[j][None]) ** 2).sum(2)).min(1).mean()
    assert got == pytest.approx({i: np.mean([1 - w(i, j) / d for j, d in v if d >= 1e-10]) for i, v in near.items()})
    assert "array<double>" in types and "array<array<double>>" not in types


def test_near_pairs_are_those_of_the_vectors(monkeypatch):
    """Where rounding of a product could decide, the vectors themselves do: on a grid all distances are at a scale, in large, small and usual numbers."""
    from manifoldry.operators import topology

    grid = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3)
    for by, away in ((1, 0), (0.1, 1000), (1e-6, 0), (1e20, 0)):
        x = grid * by + away
        y = x[50:150]
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        steps = np.array([-1, 0, by, 2 * by, 3 * by, np.inf])
        near = [n if at is None else set(at.tolist()) for n, _, at in topology._near(x, y, False, steps, topology._places)]
        assert near == [d.size if (d <= s).all() else set(np.flatnonzero(d <= s).tolist()) for s in steps]


@pytest.mark.parametrize("share", [0.02, 0.2, 0.7, 1.0])
def test_triples_by_bits_and_by_products_are_the_same(share):
    from manifoldry.operators import topology

    r = np.random.default_rng(6)
    ab, cb, ac = (r.random(s) <= share for s in ((130, 100), (90, 100), (130, 90)))
    told = lambda m, what: (int(np.count_nonzero(m)), m.shape, what(m))
    want = np.einsum("ij,kj,ik->", *(m.astype(int) for m in (ab, cb, ac)))
    assert topology._closed(told(ab, topology._bits), told(cb, topology._bits), told(ac, topology._places)) == want


def test_cells_hand_on_their_parts_in_pieces(spark, monkeypatch):
    """What a task judges leaves it by MOST_JUDGED pairs of parts, not by whole batches."""
    from test_pairs import brute_clusters, plane

    from manifoldry.operators import density

    monkeypatch.setattr(density, "MOST_JUDGED", 3)
    x = np.random.default_rng(2).uniform(0, 12, size=(300, 2))
    got = {r.id: r.cluster for r in density.dbscan(plane(spark, x), 0.5, 4).collect()}
    assert got == brute_clusters(x, 0.5, 4) and len(set(got.values())) > 3


def test_frames_are_read_without_lists():
    """A part of a batch has its own frames; no value becomes a Python object."""
    import pyarrow as pa

    from manifoldry.operators import geometry

    x = np.random.default_rng(9).normal(size=(7, 2, 5)).round(3)
    column = pa.array(x.tolist() + [[[1.0, None, 0, 0, 0], [0.0] * 5]], pa.list_(pa.list_(pa.float64())))
    assert np.array_equal(geometry.stacked(column[2:7]), x[2:])
    assert np.isnan(geometry.stacked(column[7:])[0, 0, 1]) and geometry.stacked(column[:0]).shape == (0, 2, 0)
