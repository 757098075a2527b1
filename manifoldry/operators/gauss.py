"""Sums of Gaussian kernels in the plane by cells and moments, at a stated error and in time that follows the points.

Points are summed into cells as wide as the kernel's deviation: a cell keeps the moments of its points about its centre up
to ORDER. A tile of cells takes the moments of its own and of all cells within REACH, and turns them into a Taylor series
about the centre of each cell that is asked for; points are put into their cell's series. No pair of points is looked at.

With h the deviation, d^m/dx^m of He_k(x) exp(-x^2/2) is (-1)^m He_(k+m)(x) exp(-x^2/2) for Hermite's polynomials He, so
that a source at v and a target at u from their cells' centres, all in units of h and D apart, have the kernel
sum over k, m of v^k/k! u^m/m! (-1)^m He_(k+m)(D) exp(-D^2/2), a product of one such sum in x and one in y.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms in each direction, and cells to each side that count. What is left out is less than ERROR for each point of unit weight.
ORDER, REACH, ERROR = 20, 8, 1e-10
#: Cells to a side of a tile; at least twice REACH, so that a cell is asked for by four tiles at most.
TILE = 16
#: Cells that a task sums up before it hands them on; parts of a cell's points, so that a full cell is spread over tasks.
HELD, PARTS = 2048, 8

_FACTORIAL = np.array([factorial(k) for k in range(ORDER)], float)


def _powers(x: np.ndarray) -> np.ndarray:
    return x[:, None] ** np.arange(ORDER)


def _shift(distance: int) -> np.ndarray:
    """[m, k]: what the k-th moment of a cell adds to the m-th coefficient of a cell `distance` cells further on."""
    he = [1.0, float(distance)]
    for k in range(1, 2 * ORDER - 2):
        he.append(distance * he[-1] - k * he[-2])
    m, k = np.indices((ORDER, ORDER))
    return (-1.0) ** m * np.array(he)[m + k] * np.exp(-distance * distance / 2) / _FACTORIAL[m]


def _cells(df: DataFrame, h: float) -> DataFrame:
    points = df.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    return points.withColumns({"ix": F.floor(F.col("x") / h), "iy": F.floor(F.col("y") / h)})


def _moments(points: DataFrame, h: float) -> DataFrame:
    """(ix, iy, m): the moments of each cell, v1^k/k! v2^l/l! summed over its points."""
    names = ["ix", "iy", "m"]

    def told(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], names)

    def sums(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y, ix, iy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "ix", "iy"))
            order = np.lexsort((iy, ix))
            x, y, ix, iy = x[order], y[order], ix[order], iy[order]
            for s in range(0, len(x), 4096):
                a, b = (ix[s : s + 4096], iy[s : s + 4096])
                first = np.flatnonzero((np.diff(a, prepend=a[0] - 1) != 0) | (np.diff(b, prepend=b[0] - 1) != 0))
                p = _powers(x[s : s + 4096] / h - a - 0.5) / _FACTORIAL
                q = _powers(y[s : s + 4096] / h - b - 0.5) / _FACTORIAL
                for u, v, m in zip(a[first].tolist(), b[first].tolist(), np.add.reduceat(p[:, :, None] * q[:, None, :], first), strict=True):
                    held[u, v] = held[u, v] + m if (u, v) in held else m
            if len(held) > HELD:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    def added(table: pa.Table) -> pa.Table:
        m = table.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(0)
        return pa.table([table.column("ix").slice(0, 1), table.column("iy").slice(0, 1), pa.array([m], pa.list_(pa.float64()))], names)

    # A cell has a row for each task that saw some of its points.
    parts = points.select("x", "y", "ix", "iy").mapInArrow(sums, "ix long, iy long, m array<double>")
    return parts.groupBy("ix", "iy").applyInArrow(added, "ix long, iy long, m array<double>")


def _series(moments: DataFrame, asked: DataFrame) -> DataFrame:
    """(ix, iy, c): the series of each cell of `asked`, by tiles."""
    tile = lambda c: F.floor(F.col(c) / TILE)
    around = [F.explode(F.sequence(F.floor((F.col(c) - REACH) / TILE), F.floor((F.col(c) + REACH) / TILE))) for c in ("ix", "iy")]
    given = moments.withColumn("tx", around[0]).withColumn("ty", around[1])
    wanted = asked.withColumns({"tx": tile("ix"), "ty": tile("iy")})
    shifts = {d: _shift(d) for d in range(-REACH, REACH + 1)}
    size = TILE + 2 * REACH

    def turn(left: pa.Table, right: pa.Table) -> pa.Table:
        out, ux, uy = [], right.column("ix").to_numpy(), right.column("iy").to_numpy()
        grid = np.zeros((size, size, ORDER, ORDER))
        if right.num_rows and left.num_rows:
            x0, y0 = (int(right.column(c)[0].as_py()) * TILE - REACH for c in ("tx", "ty"))
            ix, iy = left.column("ix").to_numpy() - x0, left.column("iy").to_numpy() - y0
            grid[ix, iy] = left.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, ORDER, ORDER)
            # First along y, then along x: cells d before a cell are d widths from it.
            rows = np.zeros((size, TILE, ORDER, ORDER))
            for d, s in shifts.items():
                rows += grid[:, REACH - d : REACH - d + TILE] @ s.T
            whole = np.zeros((TILE, TILE, ORDER, ORDER))
            for d, s in shifts.items():
                whole += s @ rows[REACH - d : REACH - d + TILE]
            out = list(whole[ux - x0 - REACH, uy - y0 - REACH].reshape(len(ux), -1))
        elif right.num_rows:
            out = [np.zeros(ORDER * ORDER)] * len(ux)
        return pa.table([pa.array(ux if len(out) else [], pa.int64()), pa.array(uy if len(out) else [], pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["ix", "iy", "c"])

    return given.groupBy("tx", "ty").cogroup(wanted.groupBy("tx", "ty")).applyInArrow(turn, "ix long, iy long, c array<double>")


def gauss_sums(query: DataFrame, df: DataFrame, h: float) -> DataFrame:
    """(id, total): for each row (id, x, y) of `query`, the sum over `df` of exp(-r^2 / 2h^2), to ERROR for each point of `df`.

    Points without a place are left out on both sides.
    """
    targets = _cells(query, h)
    series = _series(_moments(_cells(df, h), h), targets.select("ix", "iy").distinct())
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    kind = dict(query.dtypes)["id"]
    ahead = series.select("ix", "iy", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(0).alias("turn"), none(kind).alias("id"), none("double").alias("x"), none("double").alias("y"), "c")
    behind = targets.select("ix", "iy", part.alias("part"), F.lit(1).alias("turn"), "id", "x", "y", none("array<double>").alias("c"))

    def put(batches):
        series = None
        for batch in batches:
            turn = batch.column("turn").to_numpy()
            x, y, ix, iy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "ix", "iy"))
            total = np.zeros(len(turn))
            heads = np.flatnonzero(turn == 0).tolist()
            for at, stop in zip([-1, *heads], [*heads, len(turn)], strict=True):
                if at >= 0:
                    series = batch.column("c")[at].values.to_numpy(zero_copy_only=False).reshape(ORDER, ORDER)
                run = slice(at + 1, stop)
                if stop > at + 1:
                    total[run] = ((_powers(x[run] / h - ix[run] - 0.5) @ series) * _powers(y[run] / h - iy[run] - 0.5)).sum(1)
            keep = pa.array(turn == 1)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), pa.array(total[turn == 1])], ["id", "total"])

    run = ahead.unionByName(behind).repartition("ix", "iy", "part").sortWithinPartitions("ix", "iy", "part", "turn")
    return run.mapInArrow(put, f"id {kind}, total double")
