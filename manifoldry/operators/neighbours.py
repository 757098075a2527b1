"""Exact nearest-neighbour joins by metric partitioning.

A table of more than FEW blocks is dealt to the nearest of a bounded number of pivots, drawn once; a cell is cut into
shells by distance from its pivot, and those into blocks. First, each block meets blocks around its own pivot until k rows
are sure, which bounds every row's k-th distance. Then it meets those further blocks that the triangle inequality cannot
rule out: no row of them is nearer than the pivots' distance and the blocks' inner and outer radii allow. Smaller tables
are dealt by a hash, and all blocks meet.

A block pair is never a row with two matrices: cells of some left and some right blocks are a task each, and a block
travels once to each cell (`pairs.lanes`). A cell keeps a running best k, so that k rows for each id and lane leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.operators.order import hashed
from manifoldry.operators.pairs import distances, ids, lanes, matrix, passed
from manifoldry.sources.store import settled

BLOCK = 2048
#: Blocks that a small table is cut into, so that few rows still make some tasks.
LEAST_ROWS, SOME = 256, 8
#: Tables of more blocks than this are dealt by pivots.
FEW = 16
#: Pivots at most; what is known of cells fits in the driver, whatever the table's size.
PIVOTS = 1024
#: Shells of a cell at most.
SHELLS = 32
#: Distances are compared at this many places; bounds give way by a little more.
PLACES, SLACK = 12, 1e-9


def blocks_for(df: DataFrame) -> int:
    n = df.count()
    return max(1, -(-n // BLOCK), min(SOME, n // LEAST_ROWS))


def _hash_blocks(df: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """(block, rows, size) by a hash of the id."""
    block = F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")
    return df.select(block, F.struct(*cols).alias("row")).groupBy("block").agg(F.collect_list("row").alias("rows")).withColumn("size", F.size("rows"))


def _flat(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose Euclidean distance grows with the metric's."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _pivot_blocks(df: DataFrame, pivots: np.ndarray, metric: str, cols: list[str]) -> DataFrame:
    """(block, cell, lo, hi, size, rows): rows around their nearest pivot, in shells of about BLOCK, those of twice as many in parts."""

    def nearest_pivot(batches):
        for batch in batches:
            flat = batch.column("vec")
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            d = distances(_flat(x, metric), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1) if len(d) else np.zeros(0))], [*batch.schema.names, "cell", "far"])

    given = df.select(*cols)
    fields = ", ".join(f"`{c}` {t}" for c, t in given.dtypes)
    dealt = settled(given.mapInArrow(nearest_pivot, f"{fields}, cell int, far double"), "dealt")
    # Shells hold about as many rows each, by a sketch of bounded size; rows at one distance share a shell, and are cut into parts.
    cells = dealt.groupBy("cell").agg(F.greatest(F.round(F.count("*") / BLOCK), F.lit(1)).alias("shells"), F.percentile_approx("far", [i / SHELLS for i in range(1, SHELLS)], 1000).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda cut: cut < F.col("far")))
    shelled = dealt.join(F.broadcast(cells), "cell").withColumn("shell", F.floor(place * F.least("shells", F.lit(SHELLS)) / SHELLS)).drop("_cuts")
    sizes = shelled.groupBy("cell", "shell").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("parts"))
    parted = shelled.join(sizes, ["cell", "shell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = parted.groupBy("cell", "shell", "part").agg(F.collect_list(F.struct(*cols)).alias("rows"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("size"))
    return settled(blocks.select(F.xxhash64("cell", "shell", "part").alias("block"), "cell", "lo", "hi", F.col("size").cast("int").alias("size"), "rows"), "blocks")


#: Candidates whose distances are computed one by one at a time; rows of a product of matrices.
FEW_PAIRS, PART = 1 << 16, 256


def _exact(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray, metric: str) -> np.ndarray:
    """Distances of single pairs: those of equal vectors are zero, so that ties are ties."""
    out = np.empty(len(row))
    for i in range(0, len(row), FEW_PAIRS):
        p, q = x[row[i : i + FEW_PAIRS]], y[col[i : i + FEW_PAIRS]]
        out[i : i + FEW_PAIRS] = 1 - (p * q).sum(1) if metric == "cosine" else np.sqrt(((p - q) ** 2).sum(1))
    return np.round(out, PLACES)


def _merge(best: tuple[np.ndarray, np.ndarray], row: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
    """Adds pairs to the k best of each row in place, ties to the smaller id."""
    k = best[0].shape[1]
    touched = np.unique(row)
    old = np.repeat(touched, k)
    row, b, d = np.concatenate([old, row]), np.concatenate([best[0][touched].ravel(), b]), np.concatenate([best[1][touched].ravel(), d])
    order = np.lexsort((b, d, row))
    row, b, d = row[order], b[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    best[0][row[kept], place[kept]], best[1][row[kept], place[kept]] = b[kept], d[kept]


def _sides(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Left and right factors: their product is the squared distance, or the cosine distance of unit vectors."""
    one = np.ones((len(x), 1))
    if metric == "cosine":
        return np.hstack([-x, one]), np.hstack([x, one])
    size = (x * x).sum(1, keepdims=True)
    return np.hstack([-2 * x, size, one]), np.hstack([x, one, size])


def compared(met: DataFrame, left: DataFrame, right: DataFrame, sizes: tuple[int, int], k: int, metric: str, include_self: bool, other: str | None, same: str | None) -> DataFrame:
    """(block, src, dst, dist): for the block pairs (a, b) of `met`, the k best of each lane for each left row.

    A product of matrices bounds the distances of a block pair; only pairs that can be among a row's k best, by what it
    had when pairs were last merged, have theirs computed. The product is of single precision once all rows have k, unless its rounding, which
    follows the vectors' sizes, is no small part of the distances.
    """
    labels = [c for c in (other, same) if c]

    def opened(rows):
        x = _flat(matrix(rows), metric)
        return ids(rows), x, _sides(x, metric)[0].astype(np.float32), [ids(rows, c) for c in labels], (np.zeros((len(x), k), np.int64), np.full((len(x), k), np.inf)), []

    def merged(kept):
        *_, best, waiting = kept
        if waiting:
            _merge(best, *(np.concatenate(v) for v in zip(*waiting, strict=True)))
            waiting.clear()

    def step(kept, rows, same_block):
        a, x, rough, marks, best, waiting = kept
        b, y = ids(rows), _flat(matrix(rows), metric)
        if not len(a) or not len(b):
            return
        theirs = [ids(rows, c) for c in labels]

        def allowed(i, j):
            good = np.ones(np.broadcast(i, j).shape, bool) if include_self else a[i] != b[j]
            for c, mine, other_ in zip(labels, marks, theirs, strict=True):
                good &= mine[i] != other_[j] if c == other else mine[i] == other_[j]
            return good

        size = (x * x).sum(1) + (y * y).sum(1).max()
        err = lambda t: (size + (metric == "cosine")) * (x.shape[1] + 16) * np.finfo(t).eps
        far = best[1][:, -1] + 2 * 10.0**-PLACES
        limit = far if metric == "cosine" else far * far
        open_ = np.flatnonzero(~np.isfinite(limit))
        kind = np.float32 if not len(open_) and size.max() < 1e30 and (err(np.float32) > 0.05 * limit).mean() < 0.1 and np.median(limit) > 1e-30 else np.float64
        lead, tail = rough if kind is np.float32 else _sides(x, metric)[0], _sides(y, metric)[1].astype(kind)
        limit = limit + err(kind)
        limit[open_] = -np.inf
        found = []
        for s in range(0, len(a), PART):
            row, col = np.divmod(np.flatnonzero((lead[s : s + PART] @ tail.T <= limit[s : s + PART, None].astype(kind)).ravel()), len(b))
            found.append((row + s, col))
        for s in range(0, len(open_), PART):
            mine = open_[s : s + PART]
            d = lead[mine] @ tail.T
            d[~allowed(mine[:, None], np.arange(len(b))[None, :])] = np.inf
            if len(b) > k:
                most = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * err(kind)[mine] + 1e-11
                d[d > most[:, None]] = np.inf
            row, col = np.nonzero(np.isfinite(d))
            found.append((mine[row], col))
        row, col = (np.concatenate(v) for v in zip(*found, strict=True))
        good = allowed(row, col)
        row, col = row[good], col[good]
        if len(row):
            waiting.append((row, b[col], _exact(x, y, row, col, metric)))
        if len(open_) or 2 * sum(len(w[0]) for w in waiting) > best[0].size:
            merged(kept)

    def told(block, kept):
        merged(kept)
        a, best = kept[0], kept[4]
        good = np.isfinite(best[1])
        src = np.repeat(a, k).reshape(best[0].shape)[good]
        return {"block": np.full(len(src), block, np.int64), "src": src, "dst": best[0][good], "dist": best[1][good]}

    return passed(lanes(met, left, right, *sizes), opened, step, told, "block long, src long, dst long, dist double")


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _around(cells: list, between: np.ndarray, wanted: int) -> list[list[int]]:
    """For each cell, the cells around it, nearest first, until they hold `wanted` rows."""
    size = np.zeros(len(between), np.int64)
    size[[c.cell for c in cells]] = [c.size for c in cells]
    out = []
    for row in between:
        order = np.argsort(row, kind="stable")
        order = order[size[order] > 0]
        n = int(np.searchsorted(np.cumsum(size[order]), wanted)) + 1
        out.append(order[:n].tolist())
    return out


def pruned_pairs(left: DataFrame, right: DataFrame, pivots: np.ndarray, k: int, compare) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Block pairs of the first and the second pass, and what the first one found. `compare` takes block pairs."""
    between = distances(pivots, pivots)
    known = right.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size")).collect()  # a row for each pivot
    wanted = 4 * k + 1
    around = _around(known, between, wanted)

    def start(batches):
        for batch in batches:
            lists = [around[c] for c in batch.column("_at").to_pylist()]
            n = [len(x) for x in lists]
            at = pa.array(np.repeat(np.arange(len(n)), n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("a", "lo_a", "hi_a")), pa.array([i for m in n for i in range(m)], pa.int32()), pa.array([c for x in lists for c in x], pa.int32())], ["a", "lo_a", "hi_a", "turn", "cell"])

    place = left.select(F.col("block").alias("a"), F.col("cell").alias("_at"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    here = right.select(F.col("block").alias("b"), "cell", "lo", "hi", F.col("size").alias("n"))
    gap = F.greatest(F.col("lo") - F.col("hi_a"), F.col("lo_a") - F.col("hi"), F.lit(0.0))
    near = place.mapInArrow(start, "a long, lo_a double, hi_a double, turn int, cell int").join(here, "cell")
    before = F.sum("n").over(Window.partitionBy("a").orderBy("turn", gap, "b").rowsBetween(Window.unboundedPreceding, -1))
    first = settled(near.withColumn("_n", F.coalesce(before, F.lit(0))).where(F.col("_n") < wanted).select("a", "b"), "first-pairs")
    found = settled(compare(first), "first")

    # A block's rows all have their k-th neighbour within `reach`, once each of them has k.
    full = _first(found, k).groupBy("block", "src").agg(F.count("*").alias("n"), F.max("dist").alias("d")).where(F.col("n") == k).groupBy("block").agg(F.count("*").alias("sure"), F.max("d").alias("d"))
    return first, found, full


def _second(left: DataFrame, right: DataFrame, pivots: np.ndarray, first: DataFrame, full: DataFrame, metric: str) -> DataFrame:
    between = distances(pivots, pivots)
    known = right.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row for each pivot
    at, lo, hi = (np.array([c[f] for c in known]) for f in ("cell", "lo", "hi"))
    reach = F.sqrt(2 * (F.col("d") + SLACK * SLACK + 10.0**-PLACES)) if metric == "cosine" else F.col("d")
    place = left.select(F.col("block").alias("a"), F.col("cell").alias("_at"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), "size")
    place = place.join(full.select(F.col("block").alias("a"), "sure", "d"), "a", "left")
    place = place.withColumn("reach", F.when(F.col("sure") == F.col("size"), reach + SLACK).otherwise(float("inf"))).select("a", "_at", "lo_a", "hi_a", "reach")

    def cells(batches):
        for batch in batches:
            mine, lo_a, hi_a, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "lo_a", "hi_a", "reach"))
            d = between[mine][:, at]
            least = np.maximum(np.maximum(d - hi_a[:, None] - hi[None, :], lo[None, :] - d - hi_a[:, None]), lo_a[:, None] - d - hi[None, :])
            i, j = np.nonzero(least <= far[:, None])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i)) for c in ("a", "lo_a", "hi_a", "reach")), pa.array(at[j].astype(np.int32)), pa.array(d[i, j])], ["a", "lo_a", "hi_a", "reach", "cell", "between"])

    some = place.mapInArrow(cells, "a long, lo_a double, hi_a double, reach double, cell int, between double")
    here = right.select(F.col("block").alias("b"), "cell", "lo", "hi")
    d = F.col("between")
    least = F.greatest(d - F.col("hi_a") - F.col("hi"), F.col("lo") - d - F.col("hi_a"), F.col("lo_a") - d - F.col("hi"))
    return settled(some.join(here, "cell").where(least <= F.col("reach")).select("a", "b").join(first, ["a", "b"], "left_anti"), "second-pairs")


def draw_pivots(df: DataFrame, n: int, metric: str = "euclidean") -> np.ndarray:
    """The vectors of the first n rows by a hash of the id, n at most PIVOTS, without repeats."""
    rows = df.select("id", "vec").orderBy(hashed("id", seed=7), "id").limit(min(n, PIVOTS)).collect()
    return np.unique(_flat(np.array([r.vec for r in rows], float), metric), axis=0)


def knn(df: DataFrame, k: int, metric: str = "euclidean", include_self: bool = False, query: DataFrame | None = None, other: str | None = None, n_blocks: int | None = None, same: str | None = None, counter: dict | None = None) -> DataFrame:
    """(src, rank, dst, dist): the k nearest rows of `df` (id, vec) for each row of `query`, by default `df` itself.

    Ties go to the smaller id. With `other`, only rows with another value of that column are neighbours, with `same` only
    those with the same. Rows with fewer neighbours have all they have; an empty table gives an empty result. `counter`
    is told how many block pairs there are, and how many were compared.
    """
    n = n_blocks or blocks_for(df)
    cols = ["id", "vec", *({other, same} - {None})]
    rows = df.withColumn("vec", F.col("vec").cast("array<double>"))
    asked = None if query is None else query.withColumn("vec", F.col("vec").cast("array<double>"))
    settings = (k, metric, include_self, other, same)
    if n <= FEW or df.isEmpty():
        right = _hash_blocks(rows, n, cols)
        left = right if asked is None else _hash_blocks(asked, n_blocks or blocks_for(asked), cols)
        met = left.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"))
        return _first(compared(met, left, right, (n if asked is None else n_blocks or blocks_for(asked), n), *settings), k).select("src", "rank", "dst", "dist")
    pivots = draw_pivots(rows, n, metric)
    right = _pivot_blocks(rows, pivots, metric, cols)
    left = right if asked is None else _pivot_blocks(asked, pivots, metric, cols)
    sizes = left.count(), right.count()
    first, found, full = pruned_pairs(left, right, pivots, k, lambda met: compared(met, left, right, sizes, *settings))
    second = _second(left, right, pivots, first, full, metric)
    if counter is not None:
        counter.update(all=sizes[0] * sizes[1], compared=first.count() + second.count())
    # Whoever reads it more than once finds it made.
    return settled(_first(found.unionByName(compared(second, left, right, sizes, *settings)), k).select("src", "rank", "dst", "dist"), "neighbours")


def nearest(query: DataFrame, ref: DataFrame) -> DataFrame:
    return knn(ref, 1, include_self=True, query=query).drop("rank")
