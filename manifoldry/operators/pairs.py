"""All-pairs work in blocks.

Rows are dealt to blocks by a hash of their id and each block is packed into one row: ids, labels and a matrix. Pairs
of blocks meet by an equi-join on the block number; NumPy works on a pair of blocks at a time and reduces it to a few
rows for each id, so pairs are never rows. Blocks hold about BLOCK rows whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.operators.order import drawn_int, with_index
from manifoldry.sources.store import settled

BLOCK = 2048


def packed(df: DataFrame, n_blocks: int, cols: list[str]) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")
    return df.select(block, F.struct(*cols).alias("row")).groupBy("block").agg(F.collect_list("row").alias("rows"))


def blocks_for(df: DataFrame, size: int = BLOCK) -> int:
    return max(1, -(-df.count() // size))


def block_pairs(left: DataFrame, right: DataFrame, cols: list[str], n_left: int, n_right: int, symmetric: bool = False) -> DataFrame:
    """(a, b, left, right): every pair of blocks, with `symmetric` only those with a <= b of one table.

    Both sides of a table are one packing, written once: rows that a shuffle hands on come in any order, and a block that
    meets itself must have its rows in the same one, or pairs (i, j), i < j, are not each pair once.
    """
    mine = settled(packed(left, n_left, cols), "blocks") if symmetric else packed(left, n_left, cols)
    x = mine.select(F.col("block").alias("a"), F.col("rows").alias("left"))
    y = (mine if symmetric else packed(right, n_right, cols)).select(F.col("block").alias("b"), F.col("rows").alias("right"))
    first = F.col("a") if symmetric else F.lit(0)
    return x.withColumn("b", F.explode(F.sequence(first, F.lit(n_right - 1)))).join(y, "b").repartition("a", "b")


#: Left blocks that a task holds at most while right blocks pass by, and right blocks that pass; there are so many GROUPS and LANES at least.
HELD, PASSING, GROUPS, LANES = 128, 512, 12, 4


def lanes(met: DataFrame, left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """(group, lane, b, a, of, rows): the block pairs (a, b) of `met` in cells of some left and some right blocks, a task each.

    A block travels once to each cell that needs it, not to each block that it meets: up to GROUPS * HELD and LANES *
    PASSING blocks, what travels is in proportion to the rows. Few long lanes leave few rows, and few are merged. The left blocks `a` of a cell come first, without b; then
    its right ones, each with the left ones `of` that it meets.
    """
    groups, runs = (max(min(least, n), -(-n // most)) for n, least, most in ((n_left, GROUPS, HELD), (n_right, LANES, PASSING)))
    cells = met.select(F.pmod("a", F.lit(groups)).cast("int").alias("group"), F.pmod("b", F.lit(runs)).cast("int").alias("lane"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    none, nothing = F.lit(None).cast("long"), F.lit(None).cast("array<bigint>")
    ahead = cells.select("group", "lane", "a").distinct().join(left.select(F.col("block").cast("long").alias("a"), "rows"), "a").select("group", "lane", none.alias("b"), "a", nothing.alias("of"), "rows")
    wanted = cells.groupBy("group", "lane", "b").agg(F.collect_list("a").alias("of"))
    behind = wanted.join(right.select(F.col("block").cast("long").alias("b"), "rows"), "b").select("group", "lane", "b", none.alias("a"), "of", "rows")
    run = ahead.unionByName(behind)
    # Nulls come first: the left blocks, then the right ones.
    return run.repartitionById(groups * runs, F.col("group") * runs + F.col("lane")).sortWithinPartitions("group", "lane", "b", "a")


def passed(cells: DataFrame, opened, step, told, schema: str) -> DataFrame:
    """Over `lanes`: `opened(left rows)` is what a task keeps of a left block, `step(kept, right rows, same block)` adds a right block
    to it in place, and `told(block, kept)` are the columns that it leaves with at the cell's end."""

    def run(batches):
        cell, kept = None, {}

        def leave():
            for a, state in kept.items():
                out = told(a, state)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))

        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("group", "lane", "b", "a", "of")), strict=True))
            for i, (group, lane, b, a, of) in enumerate(at):
                if (group, lane) != cell:
                    yield from leave()
                    cell, kept = (group, lane), {}
                rows = batch.column("rows")[i].values
                if b is None:
                    kept[a] = opened(rows)
                else:
                    for x in of:
                        step(kept[x], rows, x == b)
        yield from leave()

    return cells.mapInArrow(run, schema)


def matrix(rows: pa.Array, field: str = "vec") -> np.ndarray:
    flat = rows.field(field)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(rows), -1) if len(rows) else values.reshape(0, 0)


def ids(rows: pa.Array, field: str = "id") -> np.ndarray:
    return rows.field(field).to_numpy(zero_copy_only=False)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one product of matrices; exact zeros are only near zero."""
    one = lambda v: np.ones((len(v), 1))
    size = lambda v: (v * v).sum(1, keepdims=True)
    return np.hstack([-2 * x, size(x), one(x)]) @ np.hstack([y, one(y), size(y)]).T


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        return 1 - x @ y.T
    if x.shape[1] <= 4:
        return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    d, size = squares(x, y), (x * x).sum(1) + ((y * y).sum(1).max() if len(y) else 0)
    row, col = np.nonzero(d <= 1e-6 * size[:, None])
    # What little is left of large squares is mostly rounding: those pairs are taken one by one, and equal vectors are at 0.
    for i in range(0, len(row), 1 << 16):
        p, q = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def reduced(pairs: DataFrame, reduce, schema: str) -> DataFrame:
    """`reduce(left rows, right rows, same block)` for each pair of blocks; it yields dicts of columns."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (batch.column(c)[i].values for c in ("left", "right"))
                same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                for out in reduce(left, right, same):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))

    return pairs.mapInArrow(run, schema)


def random_pairs(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(draw, id_a, id_b, dist) of n seeded draws of two different rows of `df` (id, vec); none where there are fewer than two."""
    v = settled(with_index(df.select("id", "vec"), "id"), "indexed")
    total = v.count()
    a = F.col("a")
    draws = df.sparkSession.range(n if total > 1 else 0).withColumnRenamed("id", "draw").withColumn("a", drawn_int("draw", seed=seed) % total)
    draws = draws.withColumn("b", (a + 1 + drawn_int("draw", seed=seed + 1) % max(1, total - 1)) % total)
    left, right = (v.select(F.col("index").alias(k), F.col("id").alias(f"id_{k}"), F.col("vec").alias(f"v{k}")) for k in "ab")
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return draws.join(left, "a").join(right, "b").select("draw", "id_a", "id_b", d.alias("dist"))


def label_sums(df: DataFrame, label: str, n_blocks: int | None = None) -> DataFrame:
    """(id, label, total, n): distances from each row to each class, itself left out of n. A row for each id, class and lane leaves the tasks."""
    n = n_blocks or blocks_for(df)
    rows = settled(packed(df, n, ["id", "vec", label]), "blocks")
    met = rows.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))

    def opened(left):
        return ids(left), matrix(left), {}, left.field(label).type

    def step(kept, right, same):
        a, x, sums, _ = kept
        d = squares(x, matrix(right))
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        names, of = np.unique(ids(right, label), return_inverse=True)
        hot = np.eye(len(names))[of]
        count = np.broadcast_to(hot.sum(0), (len(a), len(names)))
        if same:
            self_ = a[:, None] == ids(right)[None, :]
            d[self_] = 0
            count = count - self_ @ hot
        total = d @ hot
        for i, name in enumerate(names.tolist()):
            t, c = sums.setdefault(name, (np.zeros(len(a)), np.zeros(len(a))))
            t += total[:, i]
            c += count[:, i]

    kind = dict(df.dtypes)[label]

    def told(_, kept):
        a, _, sums, type_ = kept
        names = pa.array([name for name in sums for _ in range(len(a))], type_)
        return {"id": np.tile(a, len(sums)), label: names, "total": np.concatenate([t for t, _ in sums.values()]), "n": np.concatenate([c for _, c in sums.values()]).astype(np.int64)}

    parts = passed(lanes(met, rows, rows, n, n), opened, step, told, f"id long, {label} {kind}, total double, n long")
    return parts.groupBy("id", label).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def symmetric_lanes(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """`lanes` of the block pairs a <= b of one table. It is packed once and written, so that a block that meets itself has its rows in one order."""
    rows = settled(packed(df, n, cols), "blocks")
    met = rows.select(F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(n - 1))).alias("b"))
    return lanes(met, rows, rows, n, n)


def pair_moments(df: DataFrame, h: float = 1.0, n_blocks: int | None = None) -> DataFrame:
    """One row over all i < j: n, sum, sum of squares, least and greatest distance, sum of kernel weights. A block travels to cells of blocks, and a row for each block and lane leaves them."""

    def step(kept, right, same):
        x, sums, ends = kept
        d = distances(x, matrix(right))
        d = d[np.triu_indices(len(d), 1)] if same else d.ravel()
        if len(d):
            q = d * d
            sums += [len(d), d.sum(), q.sum(), np.exp(q / (-2 * h * h)).sum()]
            ends += [(d.min(), d.max())]

    def opened(left):
        return matrix(left), np.zeros(4), []

    def told(_, kept):
        _, (n, s, q, k), ends = kept
        out = {"n": int(n), "s": s, "q": q, "lo": min((e[0] for e in ends), default=0.0), "hi": max((e[1] for e in ends), default=0.0), "k": k}
        return {c: np.array([v])[: int(n > 0)] for c, v in out.items()}

    parts = passed(symmetric_lanes(df, ["id", "vec"], n_blocks or blocks_for(df)), opened, step, told, "n long, s double, q double, lo double, hi double, k double")
    return parts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("k"))


def near(df: DataFrame, radius: float, n_blocks: int | None = None) -> DataFrame:
    """(i, j, dist), i < j, of all pairs within `radius`."""
    n = n_blocks or blocks_for(df)

    def close(left, right, same):
        a, b = ids(left), ids(right)
        d = distances(matrix(left), matrix(right))
        keep = d <= radius
        keep &= np.triu(np.ones_like(keep), 1) if same else True
        i, j = np.nonzero(keep)
        yield {"i": np.minimum(a[i], b[j]), "j": np.maximum(a[i], b[j]), "dist": d[i, j]}

    return reduced(block_pairs(df, df, ["id", "vec"], n, n, symmetric=True), close, "i long, j long, dist double")


def spanning_edges(df: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(i, j, dist): each pair of blocks' minimum spanning forest. The minimum spanning tree is among them."""
    n = n_blocks or blocks_for(df)

    def forest(left, right, same):
        a, x = ids(left), matrix(left)
        if not same:
            a, x = np.concatenate([a, ids(right)]), np.concatenate([x, matrix(right)])
        yield tree(a, distances(x, x))

    return reduced(block_pairs(df, df, ["id", "vec"], n, n, symmetric=True), forest, "i long, j long, dist double")


def tree(a: np.ndarray, d: np.ndarray) -> dict:
    """Minimum spanning tree of a full graph, grown from its first node."""
    m = len(a)
    done, best, via = np.zeros(m, bool), np.full(m, np.inf), np.zeros(m, int)
    out, at = {"i": [], "j": [], "dist": []}, 0
    for _ in range(m - 1):
        done[at] = True
        closer = (d[at] < best) & ~done
        best[closer], via[closer] = d[at][closer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        out["i"].append(min(a[at], a[via[at]]))
        out["j"].append(max(a[at], a[via[at]]))
        out["dist"].append(best[at])
    return {"i": np.array(out["i"], np.int64), "j": np.array(out["j"], np.int64), "dist": np.array(out["dist"], float)}
