"""Kernel densities, rasters, boundary flags and density clusters in the plane."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.operators.components import components
from manifoldry.operators.gauss import gauss_sums
from manifoldry.operators.order import percentiles, with_index
from manifoldry.operators.summary import dominant, value_shares, with_percentiles, with_scalars
from manifoldry.sources.store import settled


def bandwidth(df: DataFrame) -> tuple[int, float]:
    """n and n^(-1/6) times the mean of the two axes' population deviations."""
    n, sx, sy = df.agg(F.count("*"), F.stddev_pop("x"), F.stddev_pop("y")).head()
    return n, n ** (-1 / 6) * ((sx or 0.0) + (sy or 0.0)) / 2 if n else 0.0


def kde(df: DataFrame, query: DataFrame | None = None, h: float | None = None) -> DataFrame:
    """(id, density): mean of exp(-r^2 / 2h^2) / (2 pi h^2) over all points of `df`, itself included.

    Kernels are summed by cells, each to gauss.ERROR, so a density is right to that over 2 pi h^2. Without points there
    is no density; points that all share a place have no bandwidth of their own, and a null density.
    """
    n, own = bandwidth(df)
    h = h or own
    asked = df if query is None else query
    if not n or not h:
        return asked.where(F.lit(n > 0)).select("id", F.lit(None).cast("double").alias("density"))
    return gauss_sums(asked, df, h).select("id", (F.col("total") / (n * 2 * math.pi * h * h)).alias("density"))


def kde_1d(df: DataFrame, col: str, grid: DataFrame, group: str) -> DataFrame:
    """Gaussian density of each group at the grid's points (g); Scott's factor times the sample deviation.

    Equal values meet first; a task lays its values over the grid, whose size is a parameter, by batches and hands on one
    sum for each of its groups and grid points.
    """
    stats = df.groupBy(group).agg(F.count(col).alias("_n"), F.stddev_samp(col).alias("_s")).withColumn("_h", F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2)))
    stats = stats.where("_h > 0").withColumn("_k", F.xxhash64(group))
    values = df.groupBy(group, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_c")).where("_v is not null")
    at = np.array(sorted(r.g for r in grid.select(F.col("g").cast("double").alias("g")).distinct().collect()))
    given = values.join(stats, group).select("_k", "_v", "_h", (F.col("_c") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("_w"))

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            k, v, h, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for label in np.unique(k).tolist():
                mine = k == label
                z = (at - v[mine, None]) / h[mine, None]
                total[label] = total.get(label, 0) + w[mine] @ np.exp(-z * z / 2)
        for label, made in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label)), pa.array(at), pa.array(made)], ["_k", "g", "d"])

    laid = given.mapInArrow(sums, "_k long, g double, d double").groupBy("_k", "g").agg(F.sum("d").alias("density"))
    return laid.join(stats.select("_k", group), "_k").select(group, "g", "density")


def grid_cells(df: DataFrame, n: int) -> DataFrame:
    """(id, ix, iy, x, y): n x n points over the bounding box; id = ix * n + iy."""
    box = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cells = df.sparkSession.range(n * n).select("id", F.floor(F.col("id") / n).cast("int").alias("ix"), (F.col("id") % n).cast("int").alias("iy"))
    at = lambda i, a, b: F.col(a) + F.col(i) * (F.col(b) - F.col(a)) / (n - 1)
    return cells.crossJoin(F.broadcast(box)).select("id", "ix", "iy", at("ix", "x0", "x1").alias("x"), at("iy", "y0", "y1").alias("y"))


def _axes(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid's places on both axes; none for an empty table."""
    x0, x1, y0, y1 = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if x0 is None or y0 is None:
        return np.zeros(0), np.zeros(0)
    step = np.arange(n) / (n - 1)
    return x0 + step * (x1 - x0), y0 + step * (y1 - y0)


def density_raster(df: DataFrame, n: int = 200) -> DataFrame:
    """(id, ix, iy, x, y, value): log10 of the density at n x n cells.

    The kernel is a product of one in x and one in y, so a batch of points is laid over the whole grid, whose size is a
    parameter, by a product of two matrices; a task hands on one sum a cell. An empty table has no cells, and neither
    have points that all share a place, which have no bandwidth.
    """
    rows, h = bandwidth(df)
    gx, gy = _axes(df, n)
    if not rows or not h or not len(gx):
        return grid_cells(df, n).where(F.lit(False)).withColumn("value", F.lit(0.0))

    def sums(batches):
        total = np.zeros((n, n))
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("x", "y"))
            total += np.exp(-((gx - x) ** 2) / (2 * h * h)).T @ np.exp(-((gy - y) ** 2) / (2 * h * h))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "total"])

    laid = df.select(F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null").mapInArrow(sums, "at long, total double")
    laid = laid.groupBy("at").agg((F.sum("total") / (rows * 2 * math.pi * h * h)).alias("density"))
    out = grid_cells(df, n).join(laid, F.col("id") == F.col("at"), "left")
    return out.select("id", "ix", "iy", "x", "y", F.log10(F.coalesce("density", F.lit(0.0)) + 1e-60).alias("value"))


def kde_grid(df: DataFrame, n: int, group: str, least: int = 20) -> DataFrame:
    """(group, ix, iy, density, inside): full-covariance Scott kernel of each class with `least` rows or more; inside
    marks cells from the 90th percentile of positive cells on."""
    stats = df.groupBy(group).agg(F.count("*").alias("_n"), F.covar_samp("x", "x").alias("_xx"), F.covar_samp("y", "y").alias("_yy"), F.covar_samp("x", "y").alias("_xy")).where(F.col("_n") >= least)
    f = F.pow(F.col("_n"), F.lit(-1 / 3))
    det = (F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")) * f * f
    stats = stats.select(group, "_n", det.alias("_d"), (F.col("_yy") * f / det).alias("_a"), (F.col("_xx") * f / det).alias("_b"), (-F.col("_xy") * f / det).alias("_c"))
    gx, gy = _axes(df, n)
    if not len(gx):
        return df.select(group, F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit(0.0).alias("density"), F.lit(False).alias("inside")).where(F.lit(False))

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, a, b, c, w, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            for s in range(0, len(x), 256):
                dx, dy = gx - x[s : s + 256, None], gy - y[s : s + 256, None]
                a_, b_, c_ = (v[s : s + 256, None, None] for v in (a, b, c))
                form = a_ * (dx * dx)[:, :, None] + b_ * (dy * dy)[:, None, :] + 2 * c_ * dx[:, :, None] * dy[:, None, :]
                each = np.exp(-form / 2) * w[s : s + 256, None, None]
                for label in np.unique(k[s : s + 256]).tolist():
                    total[label] = total.get(label, 0) + each[k[s : s + 256] == label].sum(axis=0)
        for label, grid in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, label)), pa.array(np.repeat(np.arange(n, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), n)), pa.array(grid.ravel())], ["_k", "ix", "iy", "d"])

    # Classes and cells are both bounded by parameters: a task sums its points over all cells of the classes it has.
    numbered = stats.withColumn("_k", F.xxhash64(group))
    given = df.join(F.broadcast(numbered), group).select(F.col("x").cast("double"), F.col("y").cast("double"), "_a", "_b", "_c", (1 / (F.col("_n") * 2 * math.pi * F.sqrt("_d"))).alias("_w"), "_k")
    laid = given.where("x is not null and y is not null").mapInArrow(sums, "_k long, ix int, iy int, d double").groupBy("_k", "ix", "iy").agg(F.sum("d").alias("density"))
    each = laid.join(F.broadcast(numbered.select("_k", group)), "_k").select(group, "ix", "iy", "density")
    level = each.where("density > 0").groupBy(group).agg(F.percentile("density", F.lit(0.9)).alias("_l"))
    return each.join(F.broadcast(level), group, "left").withColumn("inside", F.coalesce(F.col("density") >= F.col("_l"), F.lit(False))).drop("_l")


def smooth_raster(raster: DataFrame, n: int, sigma: float = 2.0) -> DataFrame:
    """Separable Gaussian with reflecting edges, radius int(4 sigma + 0.5)."""
    radius = int(4 * sigma + 0.5)
    weight = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(weight)).alias("w")) for k, w in zip(range(-radius, radius + 1), weight, strict=True)]))
    out = raster.select("ix", "iy", "value")
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        # Each cell looks at its neighbours along the axis; looks past an edge are reflected back.
        look = F.pmod(F.col(axis) + F.col("t.k"), F.lit(2 * n))
        source = F.when(look < n, look).otherwise(2 * n - 1 - look).cast("int")
        want = out.select(axis, other, table.alias("t")).select(axis, other, F.col("t.w").alias("w"), source.alias("_src"))
        values = out.select(F.col(axis).alias("_src"), other, F.col("value").alias("_v"))
        out = want.join(values, ["_src", other]).groupBy("ix", "iy").agg(F.sum(F.col("w") * F.col("_v")).alias("value"))
    return out


def raster_gradient(raster: DataFrame) -> DataFrame:
    """(ix, iy, gradient): central differences in index units, one-sided at edges."""

    def along(axis: str, other: str) -> Column:
        w = Window.partitionBy(other).orderBy(axis)
        a, b, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        return F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2)

    g = raster.withColumn("_gx", along("ix", "iy")).withColumn("_gy", along("iy", "ix"))
    return g.select("ix", "iy", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).alias("gradient"))


def point_gradient(df: DataFrame, gradient: DataFrame, n: int) -> DataFrame:
    """The gradient of each point's nearest cell."""
    out = with_scalars(df, F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    cell = lambda c, a, b: F.floor((F.col(c) - F.col(a)) / (F.col(b) - F.col(a)) * (n - 1) + 0.5).cast("int")
    out = out.withColumn("ix", cell("x", "_x0", "_x1")).withColumn("iy", cell("y", "_y0", "_y1")).drop("_x0", "_x1", "_y0", "_y1")
    return out.join(F.broadcast(gradient), ["ix", "iy"]).drop("ix", "iy")


def local_density_std(knn_with_self: DataFrame, density: DataFrame) -> DataFrame:
    return knn_with_self.join(density.select(F.col("id").alias("dst"), "density"), "dst").groupBy("src").agg(F.stddev_pop("density").alias("local_std"))


def median_deviation(df: DataFrame, col: str, name: str) -> DataFrame:
    return with_percentiles(df, col, {"_m": 0.5}).withColumn(name, F.abs(F.col(col) - F.col("_m"))).drop("_m")


def boundary_score(df: DataFrame, cols: list[str], q: float = 0.95, least: int = 2, of: dict[str, DataFrame] | None = None) -> DataFrame:
    """How many columns exceed their percentile, and whether at least `least` do. The percentile is that of the column
    itself, or of the same column in the table that `of` names for it, such as a whole raster's gradient."""
    out = df
    for i, c in enumerate(cols):
        out = out.crossJoin(F.broadcast(percentiles((of or {}).get(c, df), c, {f"_q{i}": q})))
    score = sum(((F.col(c) > F.col(f"_q{i}")).cast("int") for i, c in enumerate(cols)), F.lit(0))
    return out.withColumn("score", score).withColumn("is_boundary", F.col("score") >= least).drop(*[f"_q{i}" for i in range(len(cols))])


#: Cells to a side that a cell of the clustering is cut into when it is compared with another.
FINE = 16
#: Pairs of parts that a task holds before it hands them on.
MOST_JUDGED = 1 << 16


def _cell_links(cores: DataFrame, side: float, eps: float) -> DataFrame:
    """(a, b): nodes of cells that hold cores within eps of each other.

    A cell is known by a core of each of its FINE x FINE parts, so that two cells compare in a task, however many points
    they hold: often two of those cores are near, or all parts are too far apart. Only parts that are neither have their
    points compared.
    """
    part = lambda c, k: F.least(F.greatest(F.floor((F.col(c) / side - F.col(k)) * FINE), F.lit(0)), F.lit(FINE - 1))
    fine = settled(cores.withColumn("part", (part("x", "cx") * FINE + part("y", "cy")).cast("int")), "parts")
    one = fine.groupBy("cx", "cy", "part").agg(F.min(F.struct("x", "y")).alias("p"))
    cell = fine.groupBy("cx", "cy").agg(F.min("first").alias("node"))
    known = one.groupBy("cx", "cy").agg(F.collect_list(F.struct("part", "p.x", "p.y")).alias("parts")).join(cell, ["cx", "cy"])
    known = settled(known, "cells")
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])).alias("s")
    left = known.select(step, "cx", "cy", F.col("node").alias("a"), F.col("parts").alias("left")).select("s", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "a", "left")
    met = left.join(known.select("cx", "cy", F.col("node").alias("b"), F.col("parts").alias("right")), ["cx", "cy"]).select("s", "a", "b", "left", "right")
    width = side / FINE

    def judge(batches):
        names, kinds = ["a", "b", "pa", "pb"], (np.int64, np.int64, np.int32, np.int32)
        for batch in batches:
            sides = []
            for side in ("left", "right"):
                lists = batch.column(side)
                part, x, y = (lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("part", "x", "y"))
                sides.append((lists.offsets.to_numpy(), part, x, y))
            a, b, i, j = (v.to_numpy(zero_copy_only=False) for v in (batch.column("a"), batch.column("b"), batch.column("s").field("i"), batch.column("s").field("j")))
            found, n = [], 0
            for r in range(batch.num_rows):
                (p, px, py), (q, qx, qy) = ([v[at[r] : at[r + 1]] for v in values] for at, *values in sides)
                if ((px[:, None] - qx) ** 2 + (py[:, None] - qy) ** 2 <= eps * eps).any():
                    pairs = np.array([-1]), np.array([-1])
                else:
                    gx = np.abs(q // FINE + i[r] * FINE - (p // FINE)[:, None]) - 1
                    gy = np.abs(q % FINE + j[r] * FINE - (p % FINE)[:, None]) - 1
                    row, col = np.nonzero(np.hypot(np.maximum(gx, 0), np.maximum(gy, 0)) * width <= eps * (1 + 1e-6))
                    pairs = p[row], q[col]
                m = len(pairs[0])
                found.append((np.full(m, a[r]), np.full(m, b[r]), *pairs))
                n += m
                if n > MOST_JUDGED or r == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(t)) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names)
                    found, n = [], 0

    judged = settled(met.mapInArrow(judge, "a long, b long, pa int, pb int"), "judged")
    points = fine.join(cell, ["cx", "cy"])
    x = points.select(F.col("node").alias("a"), F.col("part").alias("pa"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    y = points.select(F.col("node").alias("b"), F.col("part").alias("pb"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = (F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2 <= eps * eps
    asked = judged.where("pa >= 0").join(x, ["a", "pa"]).join(y, ["b", "pb"]).where(near).select("a", "b")
    return judged.where("pa < 0").select("a", "b").unionByName(asked).distinct()


def _around(rows: DataFrame, others: DataFrame, eps: float, *carried: str) -> DataFrame:
    """Rows (cx, cy, x, y) with each of `others` within eps: their cells are two steps apart at most."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])).alias("s")
    a = rows.select(F.col("x").alias("x1"), F.col("y").alias("y1"), "cx", "cy", step).select("x1", "y1", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    b = others.select("cx", "cy", F.col("x").alias("x2"), F.col("y").alias("y2"), *carried)
    near = (F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2 <= eps * eps
    return a.join(b, ["cx", "cy"]).where(near).select(F.col("x1").alias("x"), F.col("y1").alias("y"), *carried)


def dbscan(df: DataFrame, eps: float = 2.0, min_samples: int = 5) -> DataFrame:
    """(id, cluster): cores have min_samples points within eps, themselves included; clusters are connected cores,
    numbered by their lowest core; a border point joins the lowest cluster near it; the rest is -1.

    Cells have a diagonal of eps, so all points of a cell are near each other: the points of a cell of min_samples are
    cores without looking at any, only points of emptier cells are compared with those around them, and cells, not
    points, are linked. Points without a place are -1.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)  # a little less, so that rounding never parts what shares a cell
    cell = {"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}
    given = df.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = given.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumns(cell)
    places = settled(places, "places")
    full = places.groupBy("cx", "cy").agg(F.sum("n").alias("held")).where(F.col("held") >= min_samples).select("cx", "cy")
    loose = settled(places.join(full, ["cx", "cy"], "left_anti"), "loose")
    enough = _around(loose, places, eps, "n").groupBy("x", "y").agg(F.sum("n").alias("held")).where(F.col("held") >= min_samples).select("x", "y")
    columns = ["cx", "cy", "x", "y", "first"]
    cores = settled(places.join(full, ["cx", "cy"], "left_semi").select(columns).unionByName(loose.join(enough, ["x", "y"], "left_semi").select(columns)), "cores")
    found = components(_cell_links(cores, side, eps))
    node = cores.groupBy("cx", "cy").agg(F.min("first").alias("node"))
    labels = node.join(found.withColumnRenamed("id", "node"), "node", "left").select("cx", "cy", F.coalesce("component", "node").alias("label"))
    labelled = settled(cores.join(labels, ["cx", "cy"]).select("cx", "cy", "x", "y", "label"), "labels")
    border = _around(loose.join(enough, ["x", "y"], "left_anti"), labelled, eps, "label").groupBy("x", "y").agg(F.min("label").alias("root"))
    roots = labelled.select("x", "y", F.col("label").alias("root")).unionByName(border)
    names = with_index(roots.select("root").distinct(), "root", name="cluster")
    return given.join(roots.join(names, "root").select("x", "y", "cluster"), ["x", "y"], "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_profile(df: DataFrame, cluster: str, label: str, measures: list[str] | None = None) -> DataFrame:
    """n, centre, mean of each measure, most frequent label of each cluster, and how many points are noise."""
    inside = df.where(F.col(cluster) >= 0)
    stats = inside.groupBy(cluster).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), *[F.avg(m).alias(f"mean_{m}") for m in measures or []])
    return with_scalars(stats.join(dominant(inside, [cluster], label), cluster), F.count_if(F.col(cluster) < 0).alias("n_noise"), of=df)


def boundary_mix(df: DataFrame, flag: str, label: str) -> DataFrame:
    return value_shares(df.where(flag), label)
