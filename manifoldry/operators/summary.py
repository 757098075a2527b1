"""Counts, shares, summaries, histograms and checks: partial sums before every shuffle, scalars joined by broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.operators.order import percentiles, running_total, same_keys

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def with_scalars(df: DataFrame, *aggs: Column, of: DataFrame | None = None) -> DataFrame:
    """`df` with global aggregates, one row, as columns."""
    return df.crossJoin(F.broadcast((df if of is None else of).agg(*aggs)))


def with_percentiles(df: DataFrame, col: str, wanted: dict[str, float]) -> DataFrame:
    """`df` with global percentiles, one row, as columns."""
    return df.crossJoin(F.broadcast(percentiles(df, col, wanted)))


def joined(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Two summaries of the same groups, a null group too."""
    renamed = [f"_j{i}" for i in range(len(group))]
    if not group:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(g).alias(n) for g, n in zip(group, renamed, strict=True)], *[c for c in right.columns if c not in group])
    return left.join(other, same_keys(group, renamed)).drop(*renamed)


def value_shares(df: DataFrame, *cols: str) -> DataFrame:
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return with_scalars(counts, F.sum("n").alias("_t")).withColumn("percent", F.col("n") * 100 / F.col("_t")).drop("_t")


def describe_by(df: DataFrame, group: list[str], col: str) -> DataFrame:
    rest = df.groupBy(*group).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std_pop"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    return joined(rest, percentiles(df, col, QUARTILES, group), group).select(*group, "n", "mean", "std_pop", "std", "min", *QUARTILES, "max")


def flag_tails(df: DataFrame, col: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Columns is_high (>= upper percentile) and is_low (<= lower one)."""
    out = with_percentiles(df, col, {"_lo": low, "_hi": high})
    return out.withColumn("is_high", F.col(col) >= F.col("_hi")).withColumn("is_low", F.col(col) <= F.col("_lo")).drop("_lo", "_hi")


def clip_percentile(df: DataFrame, col: str, low: float, high: float, name: str) -> DataFrame:
    out = with_percentiles(df, col, {"_lo": low, "_hi": high})
    return out.withColumn(name, F.least(F.greatest(F.col(col), F.col("_lo")), F.col("_hi"))).drop("_lo", "_hi")


def distinct_rounded(df: DataFrame, col: str, places: list[int]) -> DataFrame:
    return df.agg(*[F.count_distinct(F.round(col, p)).alias(f"places_{p}") for p in places])


def histogram(df: DataFrame, col: str, bins: int, group: list[str], log: bool = False, density: bool = False) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; with `log` of the positive values' log10.

    With `density` also each bin's share of its group by its width.
    """
    if log:
        df = df.where(F.col(col) > 0).withColumn(col, F.log10(col))
    out = with_scalars(df, F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = out.groupBy(*group, F.when(width > 0, at).otherwise(0).alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("_w"))
    if density:  # a row for each bin of a group
        counts = counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*group)) / F.col("_w"))
    return counts.drop("_w")


def ecdf(df: DataFrame, col: str, group: list[str]) -> DataFrame:
    """Share of rows up to each distinct value."""
    counts = df.groupBy(*group, col).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    placed = joined(running_total(counts, "_c", col, group=group, name="_b"), totals, group)
    return placed.withColumn("share", (F.col("_b") + F.col("_c")) / F.col("_n")).drop("_c", "_b", "_n")


#: Letters that are counted at once.
LETTERS = 4_000_000


def composition(df: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """Letters (code points), their counts and percent, within `by`. A batch of texts is counted at once; letters are never rows."""

    def count(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("_seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + LETTERS, side="right")))
                part = batch.slice(at, stop - at)
                texts = pc.fill_null(part.column("_seq"), "")
                code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
                key = np.zeros(part.num_rows, np.int64)
                for c in by:
                    _, key = np.unique(key * (part.num_rows + 1) + pc.fill_null(part.column(c).dictionary_encode().indices, part.num_rows).to_numpy(zero_copy_only=False), return_inverse=True)
                _, row = np.unique(key, return_index=True)
                found, n = np.unique(np.repeat(key, pc.utf8_length(texts).to_numpy(zero_copy_only=False)) * (1 << 21) + code, return_counts=True)
                of = pa.array(row[found >> 21])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in by), pa.array([chr(c) for c in (found & ((1 << 21) - 1)).tolist()], pa.string()), pa.array(n, pa.int64())], [*by, "letter", "n"])
                at = stop

    given = df.select(*by, F.col(seq).alias("_seq"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1])
    counts = given.mapInArrow(count, f"{kinds}, letter string, n long").groupBy(*by, "letter").agg(F.sum("n").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*by)))


def top_letters(df: DataFrame, seq: str, by: list[str], k: int) -> DataFrame:
    """The k most frequent letters (ties by letter) of each group, with their place and the number of distinct letters."""
    w = Window.partitionBy(*by)  # a row for each letter of a group
    placed = composition(df, seq, by).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "letter"))).withColumn("letters", F.count("*").over(w))
    return placed.where(F.col("place") <= k).select(*by, "letter", "n", "place", "letters")


def composition_deviation(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed minus expected percent for each letter; the expected table has one row a letter."""
    return observed.join(F.broadcast(expected), "letter").withColumn("difference", F.col("percent") - F.col("expected"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter in turn and the pass rate against the step before; one pass over the rows."""
    passed, so_far = [F.count("*").alias("c0")], F.lit(True)
    for i, (_, condition) in enumerate(steps, 1):
        so_far = so_far & F.coalesce(condition, F.lit(False))
        passed.append(F.count_if(so_far).alias(f"c{i}"))
    one = df.agg(*passed)
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"c{i}").alias("n"), (F.col(f"c{i}") / F.col(f"c{i - 1}")).alias("rate")) for i, (n, _) in enumerate(steps, 1)]
    return one.select(F.inline(F.array(*rows)))


def estimate_volume(df: DataFrame, length: str, dim: int, width: int, rate: float, budget: float) -> DataFrame:
    out = df.agg(F.count("*").alias("n"), F.sum(length).alias("residues"))
    out = out.withColumn("sequence_bytes", F.col("n") * dim * width).withColumn("residue_bytes", F.col("residues") * dim * width)
    return out.withColumn("seconds", F.col("residues") / rate).withColumn("within_budget", F.col("residue_bytes") <= budget)


def merge_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Existing and added counts over the union of categories, share of the total and growth factor."""
    x, y = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((a, "existing"), (b, "added")))
    out = x.join(y, key, "full_outer").fillna(0, ["existing", "added"]).withColumn("total", F.col("existing") + F.col("added"))
    out = with_scalars(out, F.sum("total").alias("_t"))
    return out.withColumn("percent", F.col("total") * 100 / F.col("_t")).withColumn("growth", F.when(F.col("existing") > 0, F.col("total") / F.col("existing"))).drop("_t")


def dominant(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """The most frequent value; ties to the first by name."""
    counts = df.groupBy(*group, col).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(col).alias("v")))["v"].alias("dominant"))


def fold_change(df: DataFrame, group: str, ref: str, col: str) -> DataFrame:
    means = df.groupBy(group).agg(F.avg(col).alias("mean"))
    return with_scalars(means, F.max(F.when(F.col(group) == ref, F.col("mean"))).alias("_r")).withColumn("fold", F.col("mean") / F.col("_r")).drop("_r")


def sign_shares(df: DataFrame, col: str, group: list[str]) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return joined(df.groupBy(*group).agg(share(F.col(col) > 0).alias("positive"), share(F.col(col) < 0).alias("negative")), percentiles(df, col, QUARTILES, group), group)


def significance_split(df: DataFrame, group: list[str], rho: str, p: str, level: float = 0.05) -> DataFrame:
    sure = F.col(p) < level
    counts = df.groupBy(*group).agg(F.count_if(sure & (F.col(rho) > 0)).alias("positive"), F.count_if(sure & (F.col(rho) < 0)).alias("negative"), F.count_if(~sure).alias("unsure"), F.avg(rho).alias("mean_rho"))
    return joined(counts, percentiles(df, rho, {"median_rho": 0.5}, group), group)


def vector_mean(df: DataFrame, group: list[str], vec: str) -> DataFrame:
    """Component-wise mean of each group; components meet as partial sums."""
    parts = df.select(*group, F.posexplode(vec).alias("i", "v")).groupBy(*group, "i").agg(F.avg("v").alias("v"))
    return parts.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))


def quality_checks(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows, distinct keys, rows of repeated keys, and vectors with a value that is not finite."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"))
    return counts.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.sum("bad").alias("not_finite"))
