"""Component lifetimes, simplex counts and interval statistics."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.operators import neighbours, pairs
from manifoldry.operators.components import components
from manifoldry.operators.order import percentiles, top_k
from manifoldry.operators.pairs import matrix
from manifoldry.operators.summary import joined
from manifoldry.sources.store import settled


def adaptive_threshold(df: DataFrame, k: int = 15, q: float = 0.9, group: str | None = None) -> DataFrame:
    """The q-th percentile of the distance to the k-th neighbour, over all rows or within each class or replicate."""
    if group:
        edges = neighbours.knn(df, k, same=group).where(F.col("rank") == k).join(df.select(F.col("id").alias("src"), group), "src")
        return percentiles(edges, "dist", {"threshold": q}, [group])
    return percentiles(neighbours.knn(df, k).where(F.col("rank") == k), "dist", {"threshold": q})


#: Neighbours that a spanning tree looks at before it searches.
NEAR = 15


def h0_persistence(df: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(birth, death): deaths are the lengths of the minimum spanning tree, one is infinite.

    Rows that fit one block make their tree there. Else a row's nearest one outside its component is looked up among its
    NEAR neighbours, the shortest of a component is an edge of the tree, and components that meet are contracted. A row
    whose neighbours all share its component is searched for only if it may have its component's shortest edge, and not
    in the largest component: each other one has an edge of its own, so that components at least halve in a round.
    """
    ever = df.sparkSession.range(1 if not df.isEmpty() else 0).select(F.lit(0.0).alias("birth"), F.lit(float("inf")).alias("death"))
    if (n_blocks or pairs.blocks_for(df)) == 1:
        edges = pairs.spanning_edges(df, 1)
        return ever.unionByName(edges.select(F.lit(0.0).alias("birth"), F.col("dist").alias("death")))
    rows = settled(df.select("id", F.col("vec").cast("array<double>").alias("vec")), "rows")
    near = settled(neighbours.knn(rows, NEAR, n_blocks=n_blocks).select("src", "dst", "dist"), "near")
    others = rows.count() - 1
    label = rows.select("id", F.col("id").alias("c"))
    deaths = []
    # One order of all edges, so that components that choose at a tie never make a circle.
    edge = F.min(F.struct("dist", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))).alias("e")
    while True:
        both = near.join(label.toDF("src", "c"), "src").join(label.toDF("dst", "d"), "dst")
        out = F.min(F.when(F.col("c") != F.col("d"), F.struct("dist", "dst", "d"))).alias("out")
        seen = settled(both.groupBy("src", "c").agg(out, F.max("dist").alias("far"), F.count("*").alias("n")), "seen")
        sizes = seen.groupBy("c").agg(F.count("*").alias("size"), F.min("out.dist").alias("best"))
        largest = sizes.orderBy(F.desc("size"), "c").select("c").head()
        if largest is None:
            break
        unsure = F.col("out").isNull() & (F.col("n") < others) & (F.col("best").isNull() | (F.col("far") <= F.col("best")))
        unsure = settled(seen.join(sizes.select("c", "best"), "c").where(unsure).select(F.col("src").alias("id"), "c"), "unsure")
        known = seen.where("out is not null").select("src", "c", "out.*")
        if not unsure.where(F.col("c") == largest.c).isEmpty():
            known = known.where(F.col("c") != largest.c)
        asked = unsure.where(F.col("c") != largest.c)
        if not asked.isEmpty():
            found = neighbours.knn(rows.join(label, "id"), 1, query=rows.join(asked, "id"), other="c", n_blocks=n_blocks)
            known = known.unionByName(found.join(label.toDF("src", "c"), "src").join(label.toDF("dst", "d"), "dst").select("src", "c", "dist", "dst", "d"))
        best = settled(known.groupBy("c").agg(edge).select("e.*").distinct(), "shortest")
        if best.isEmpty():
            break
        deaths.append(best.select(F.lit(0.0).alias("birth"), F.col("dist").alias("death")))
        met = components(best.select("a", "b")).toDF("c", "to")
        label = settled(label.join(met, "c", "left").select("id", F.coalesce("to", "c").alias("c")), "labels")
    return reduce(DataFrame.unionByName, deaths, ever)


#: Groups of blocks, at least and at most: three groups are a task's. Blocks of two groups whose bits it holds at once, rows whose distances and near pairs whose bits are in a core's cache.
SOME, GROUPS, TILE, ROWS, AT_ONCE = 5, 8, 8, 256, 1024


def _within(x: np.ndarray, y: np.ndarray, steps: np.ndarray, sides: dict, held: dict) -> list[np.ndarray]:
    """For each scale, whether each of `y` is near to each of `x`: by one product, of single precision where its rounding decides few pairs, and by the vectors themselves where it decides."""
    own, (_, theirs) = (x * x).sum(1, keepdims=True), sides[np.float64]
    size = (own.max() + theirs.max()) if len(x) and len(y) else 0.0
    for kind in (np.float32, np.float64):
        if kind is np.float32 and size > 1e30:
            continue
        square, near, may = (b[: len(x)] if isinstance(b, np.ndarray) else [v[: len(x)] for v in b] for b in held[kind])
        np.matmul(np.hstack([-2 * x, own, np.ones_like(own)]).astype(kind), sides[kind][0], out=square)
        err, open_ = size * (x.shape[1] + 16) * np.finfo(kind).eps, []
        for s, m in zip(steps, near, strict=True):
            np.less_equal(square, kind(s * s - err), out=m)
            np.less_equal(square, kind(s * s + err), out=may)
            open_.append(np.flatnonzero(may & ~m) if np.count_nonzero(may) > np.count_nonzero(m) else np.zeros(0, np.int64))
        if kind is np.float64 or sum(map(len, open_)) * 50 <= square.size:
            break
    for s, m, at in zip(steps, near, open_, strict=True):
        for i in range(0, len(at), 1 << 16):
            p, q = np.divmod(at[i : i + (1 << 16)], max(1, len(y)))
            m[p, q] = np.sqrt(((x[p] - y[q]) ** 2).sum(1)) <= s
        if s < 0:
            m[:] = False
    return near


def _near(x: np.ndarray, y: np.ndarray, equal: bool, steps: np.ndarray, what) -> list[tuple]:
    """For each scale, the number of near pairs of `x` and `y`, their sizes, and `what(part, row)` of the parts of the table of what is near, from that row on; None where all are."""
    theirs = (y * y).sum(1, keepdims=True)
    right = np.hstack([y, np.ones_like(theirs), theirs]).T
    sides = {np.float64: (right, theirs), np.float32: (right.astype(np.float32) if not theirs.max(initial=0) > 1e30 else None, theirs)}
    places = lambda kind: np.empty((min(ROWS, len(x)), len(y)), kind)
    flags = [places(bool) for _ in steps], places(bool)
    # Written again for each part.
    held = {np.float32: (places(np.float32), *flags), np.float64: (places(np.float64), *flags)}
    n, parts = [0] * len(steps), [[] for _ in steps]
    for i in range(0, len(x), ROWS):
        for k, m in enumerate(_within(x[i : i + ROWS], y, steps, sides, held)):
            if equal:  # no point is its own neighbour
                m[np.arange(len(m)), i + np.arange(len(m))] = False
            near = int(np.count_nonzero(m))
            n[k] += near
            parts[k].append(what(m, i) if near < m.size else i)
    whole = lambda i: what(np.ones((min(ROWS, len(x) - i), len(y)), bool), i)
    return [(c, (len(x), len(y)), None if c == len(x) * len(y) else np.concatenate([whole(p) if isinstance(p, int) else p for p in v])) for c, v in zip(n, parts, strict=True)]


def _bits(m: np.ndarray, row: int = 0) -> np.ndarray:
    """Rows as words of 64 bits."""
    return np.packbits(np.pad(m, ((0, 0), (0, -m.shape[1] % 64))) if m.shape[1] % 64 else m, axis=1).view(np.uint64)


def _places(m: np.ndarray, row: int = 0) -> np.ndarray:
    return np.flatnonzero(m) + row * m.shape[1]


def _nothing(m: np.ndarray, row: int = 0) -> np.ndarray:
    return np.zeros(0)


def _closed(ab: tuple, cb: tuple, ac: tuple) -> int:
    """Triples of a, b and c that are all near each other: what is near in b to both ends of a near pair of a and c. Of each two, their number, sizes, and bits or the pairs."""
    if not (ab[0] and cb[0] and ac[0]):
        return 0
    if all(n == p * q for n, (p, q), _ in (ab, cb, ac)):
        return ab[1][0] * ab[1][1] * cb[1][0]
    (na, nb), nc = ab[1], cb[1][0]
    # Where all are near, nothing is kept.
    x, y, met = (v if v is not None else f(np.ones(shape, bool)) for (_, shape, v), f in ((ab, _bits), (cb, _bits), (ac, _places)))
    if ac[0] > 0.45 * na * nc:
        flat = lambda m: np.unpackbits(m.view(np.uint8), axis=1, count=nb).astype(np.float32)
        near = np.zeros((na, nc), bool)
        near.ravel()[met] = True
        return int((flat(x) @ flat(y).T)[near].sum(dtype=np.float64))
    i, k = np.divmod(met, nc)
    total, words = 0, x.shape[1]
    p, q, n = np.empty((AT_ONCE, words), np.uint64), np.empty((AT_ONCE, words), np.uint64), np.empty((AT_ONCE, words), np.uint8)
    for s in range(0, len(i), AT_ONCE):
        # In place, in what a core's cache holds.
        m = min(AT_ONCE, len(i) - s)
        np.take(x, i[s : s + m], axis=0, out=p[:m], mode="clip")
        np.take(y, k[s : s + m], axis=0, out=q[:m], mode="clip")
        np.bitwise_count(np.bitwise_and(p[:m], q[:m], out=p[:m]), out=n[:m])
        total += int(n[:m].sum(dtype=np.uint64))
    return total


def scale_counts(df: DataFrame, scales: list[float], n_blocks: int | None = None) -> DataFrame:
    """(s, v, e, t, euler): points, pairs and triples within each scale. A triple counts from its longest side on.

    Nothing is written for a pair or a triple: each pair of blocks adds to a count of pairs at each scale, each three
    blocks to one of triples, by the bits of what is near. A task has the blocks of three groups, of GROUPS at most, so
    that a block travels as often whatever the table's size, and no row holds more than a block. Only two blocks of
    different roles are compared, and their bits serve a tile of others. Triples are cubic in the rows.
    """
    n, v = n_blocks or pairs.blocks_for(df), df.count()
    steps = np.array(scales, float)

    def step(kept, right, same):
        kept[1][:] += [n // (1 + same) for n, *_ in _near(kept[0], matrix(right), same, steps, _nothing)]

    def edges(_, kept):
        return {"k": np.arange(len(steps), dtype=np.int32), "n": kept[1]}

    groups = min(n, GROUPS, max(SOME, -(-n // TILE)))

    def counts(cell: tuple[int, int, int], held: dict[int, np.ndarray]) -> pa.RecordBatch:
        first, second, third = ([x for x in sorted(held) if x % groups == g] for g in cell)
        total = [0] * len(steps)
        sides = lambda x, y, what: _near(held[x], held[y], x == y, steps, what)
        tiles = lambda blocks: [blocks[i : i + TILE] for i in range(0, len(blocks), TILE)]
        for some, others in ((p, q) for p in tiles(first) for q in tiles(second)):
            ab = {(a, b): sides(a, b, _bits) for a in some for b in others if cell[0] != cell[1] or a <= b}
            for c in third:
                cb = {b: sides(c, b, _bits) for b in others if cell[1] != cell[2] or b <= c}
                for a in some:
                    met = [b for b in cb if (a, b) in ab]
                    ac = sides(a, c, _places) if met else []
                    for b in met:
                        same = 6 if a == c == b else 2 if a == b or b == c else 1  # so often does each triple come up
                        for k in range(len(steps)):
                            total[k] += _closed(ab[a, b][k], cb[b][k], ac[k]) // same
        return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["k", "n"])

    def triples(batches):
        cell, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                at = tuple(batch.column(c)[i].as_py() for c in "abc")
                if at != cell:
                    if held:
                        yield counts(cell, held)
                    cell, held = at, {}
                held[batch.column("block")[i].as_py()] = matrix(batch.column("rows")[i].values)
        if held:
            yield counts(cell, held)

    rows = settled(pairs.packed(df, n, ["vec"]), "blocks")
    # The tasks are as many as the cells.
    threes = list(combinations_with_replacement(range(groups), 3))
    cells = df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(threes)], "task int, a int, b int, c int").select("*", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("group"))
    three = cells.join(rows.select(F.pmod("block", F.lit(groups)).alias("group"), "block", "rows"), "group")
    three = three.repartitionById(len(threes), "task").select("a", "b", "c", "block", "rows").sortWithinPartitions("a", "b", "c", "block")
    opened = lambda left: (matrix(left), np.zeros(len(steps), np.int64))
    e = pairs.passed(pairs.symmetric_lanes(df, ["vec"], n), opened, step, edges, "k int, n long").groupBy("k").agg(F.sum("n").alias("e"))
    t = three.mapInArrow(triples, "k int, n long").groupBy("k").agg(F.sum("n").alias("t"))
    at = df.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(scales)], "k int, s double")
    out = at.join(e, "k", "left").join(t, "k", "left").fillna(0, ["e", "t"])
    return out.select("s", F.lit(v).cast("long").alias("v"), "e", "t").withColumn("euler", F.col("v") - F.col("e") + F.col("t"))


def interval_metrics(intervals: DataFrame, group: list[str]) -> DataFrame:
    """Mean, entropy, median, 90th percentile and greatest of the lengths that are finite; entropy over positive ones."""
    length = intervals.where((F.col("death") < float("inf")) & F.col("death").isNotNull()).withColumn("l", F.col("death") - F.col("birth"))
    positive = F.when(F.col("l") > 0, F.col("l"))
    # -sum(l/L ln(l/L)) = ln L - sum(l ln l) / L
    total = F.sum(positive)
    entropy = F.log(total) - F.sum(positive * F.log(positive)) / total
    rest = length.groupBy(*group).agg(F.count("*").alias("n"), F.avg("l").alias("mean"), F.coalesce(entropy, F.lit(0.0)).alias("entropy"), F.max("l").alias("max"))
    return joined(rest, percentiles(length, "l", {"q50": 0.5, "q90": 0.9}, group), group)


def top_persistent(intervals: DataFrame, k: int, group: list[str]) -> DataFrame:
    finite = intervals.where(F.col("death") < float("inf")).withColumn("persistence", F.col("death") - F.col("birth"))
    return top_k(finite, k, [F.desc("persistence"), F.asc("birth")], group)


def curve_bands(curves: DataFrame, group: str, scale: str, value: str) -> DataFrame:
    """Median and quartiles over replicates at each scale."""
    return percentiles(curves, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, [group, scale])


def curve_summary(bands: DataFrame, group: str, scale: str) -> DataFrame:
    """Peak scale and value (first of several) and trapezoid area of the median curve."""
    w = Window.partitionBy(group).orderBy(scale)
    step = (F.col(scale) - F.lag(scale).over(w)) * (F.col("median") + F.lag("median").over(w)) / 2
    peak = F.min(F.struct((-F.col("median")).alias("m"), F.col(scale).alias("s")))
    return bands.withColumn("_a", step).groupBy(group).agg(F.sum("_a").alias("area"), peak.alias("p")).select(group, F.col("p.s").alias("peak_at"), (-F.col("p.m")).alias("peak"), "area")


def scale_range(intervals: DataFrame, group: list[str], steps: int, q: float = 0.99) -> DataFrame:
    """(group, step, s): `steps` scales from 0 to the q-th percentile of the finite deaths of each group."""
    top = percentiles(intervals.where(F.col("death") < float("inf")), "death", {"_top": q}, group)
    at = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    return top.select(*group, "_top", at).withColumn("s", F.col("_top") * F.col("step") / (steps - 1)).drop("_top")


def replicate_ellipse(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Means and sample covariance of two measures over a group's replicates."""
    return df.groupBy(group).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.covar_samp(x, x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.covar_samp(y, y).alias("yy"))


def replicate_ci(df: DataFrame, group: str, col: str) -> DataFrame:
    d = df.groupBy(group).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    return d.withColumn("lower", F.col("mean") - 1.96 * F.col("std")).withColumn("upper", F.col("mean") + 1.96 * F.col("std"))


def matrix_summary(df: DataFrame) -> DataFrame:
    """Mean and deviation for each class pair (i, j) over replicates, nulls left out."""
    return df.groupBy("i", "j").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def row_means(df: DataFrame) -> DataFrame:
    """Row means of each replicate's matrix without the diagonal."""
    return df.where("i <> j").groupBy("rep", "i").agg(F.avg("value").alias("mean"))


