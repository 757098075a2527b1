"""Ordinals, average ranks, intervals, samples and running values.

A global order never goes through one task: rows are range-partitioned, counted for each partition, and numbered locally.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.sources.store import settled


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` in range partitions with their number; an order is settled once, so the rows are kept."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranged")


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equal keys, nulls too."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _carried(dealt: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of range partitions with what `told` says of each (partition, group)."""
    renamed = [f"_k{i}" for i in range(len(keys))]
    told = told.select(*[F.col(k).alias(n) for k, n in zip(keys, renamed, strict=True)], *[c for c in told.columns if c not in keys])
    if len(keys) == 1:
        told = F.broadcast(told)  # a row for each range partition
    return dealt.join(told, same_keys(keys, renamed), "left").drop(*renamed)


def segmented_scan(df: DataFrame, value: Column, order: list[str], group: list[str], name: str, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """`fold` of `value` over all earlier rows of the group, for any associative function: null for the first row.

    `fold` is its aggregate and `both` joins two results, either of which may be null. A group of any size is spread over
    range partitions and folded there; what a partition starts with is folded over the results of those before it, so
    what meets in one task is a row for each partition that a group is in.
    """
    dealt = _ranged(df, *group, *order)
    keys = ["_p", *group]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys).agg(fold(value).alias("_s"))
    out = _carried(dealt.withColumn("_l", fold(value).over(inside)), sums.select(*keys, fold(F.col("_s")).over(before).alias("_before")), keys)
    return out.withColumn(name, both(F.col("_before"), F.col("_l"))).drop("_p", "_l", "_before")


def _running(df: DataFrame, value: Column, order: list[str], group: list[str], name: str) -> DataFrame:
    """Sum of `value` over all earlier rows of the group, 0 for the first."""
    return segmented_scan(df, value, order, group, name, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_max(df: DataFrame, value: str, *order: str, group: list[str] | None = None, name: str = "reach") -> DataFrame:
    """The greatest value of all rows before, by `order` within `group`: null for the first."""
    return segmented_scan(df, F.col(value), list(order), group or [], name, F.max, lambda a, b: F.greatest(a, b))


def following(df: DataFrame, columns: list[str], order: str, group: str, name: str = "next") -> DataFrame:
    """`name`: a struct of the next row's `columns` in the group, null for the last; groups may span range partitions."""
    dealt = _ranged(df, group, order)
    keys = ["_p", group]
    inside = Window.partitionBy(*keys).orderBy(order)
    row = F.struct(*columns)
    heads = dealt.groupBy(*keys).agg(F.min(F.struct(order, row.alias("_r"))).alias("_h"))
    after = heads.select(*keys, F.lead("_h._r").over(Window.partitionBy(group).orderBy("_p")).alias("_after"))
    out = _carried(dealt.withColumn("_n", F.lead(row).over(inside)), after, keys)
    return out.withColumn(name, F.coalesce("_n", "_after")).drop("_p", "_n", "_after")


def with_index(df: DataFrame, *order: str, start: int = 0, name: str = "index") -> DataFrame:
    """A 0-based position by `order`."""
    out = _running(df, F.lit(1), list(order), [], "_at")
    return out.withColumn(name, (F.col("_at") + start).cast("long")).drop("_at")


def running_total(df: DataFrame, value: str, *order: str, group: list[str] | None = None, name: str = "total") -> DataFrame:
    """The sum of `value` over all rows before, by `order` within `group`: 0 for the first. Ties come in no fixed order."""
    return _running(df, F.col(value), list(order), group or [], name)


def value_ranks(df: DataFrame, col: str, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The average rank of each distinct value within its group: rows before it + (its rows + 1) / 2."""
    group = group or []
    counts = df.groupBy(*group, col).agg(F.count("*").alias("_c"))
    return running_total(counts, "_c", col, group=group, name="_b").withColumn(name, F.col("_b") + (F.col("_c") + 1) / 2).drop("_b", "_c")


def avg_ranks(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Average ranks of several columns within `group` (column c as `_r_c`), all by one pass over their distinct values.

    Columns are of type double and without nulls.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("_x")
    counts = df.select(*group, each).groupBy(*group, F.col("_x.c").alias("_i"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_c"))
    placed = running_total(counts, "_c", "_v", group=[*group, "_i"], name="_b")
    ranks = settled(placed.select(*group, "_i", "_v", (F.col("_b") + (F.col("_c") + 1) / 2).alias("_rank")), "ranks")
    renamed = [f"_k{i}" for i in range(len(group) + 1)]
    for i, c in enumerate(columns):
        mine = ranks.where(F.col("_i") == i).select(*[F.col(k).alias(n) for k, n in zip([*group, "_v"], renamed, strict=True)], F.col("_rank").alias(f"_r_{c}"))
        df = df.join(mine, same_keys([*group, c], renamed)).drop(*renamed)
    return df


def avg_rank(df: DataFrame, col: str, group: list[str] | None = None, name: str = "rank", of: DataFrame | None = None) -> DataFrame:
    """Average ranks; ties share the mean. Ranks are those among the rows of `of`, by default `df` itself."""
    keys = [*(group or []), col]
    renamed = [f"_k{i}" for i in range(len(keys))]
    ranks = value_ranks(df if of is None else of, col, group, name)
    ranks = ranks.select(*[F.col(k).alias(n) for k, n in zip(keys, renamed, strict=True)], name)
    return df.join(ranks, same_keys(keys, renamed)).drop(*renamed)


def percentiles(df: DataFrame, col: str, wanted: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """A column for each wanted share p of each group: the value at place p (n - 1), between neighbours in proportion.

    Values are counted, ordered over range partitions, and taken by place; no group's values meet in one buffer. Nulls
    are left out; a group of nulls alone has null results.
    """
    group = group or []
    counts = df.groupBy(*group, F.col(col).cast("double").alias("_v")).agg(F.count(F.col(col)).alias("_c"))
    placed = running_total(counts, "_c", "_v", group=group, name="_b")
    renamed = [f"_g{i}" for i in range(len(group))]
    totals = counts.groupBy(*[F.col(g).alias(n) for g, n in zip(group, renamed, strict=True)]).agg(F.sum("_c").alias("_n"))
    placed = placed.join(totals, same_keys(group, renamed)) if group else placed.crossJoin(F.broadcast(totals))
    at = lambda k: F.max(F.when((F.col("_b") <= k) & (k < F.col("_b") + F.col("_c")), F.col("_v")))
    found = []
    for name, p in wanted.items():
        place = F.lit(p) * (F.col("_n") - 1)
        found += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    out = placed.groupBy(*group).agg(*found)
    return out.select(*group, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in wanted])


def merge_intervals(df: DataFrame, key: str) -> DataFrame:
    """Merges (start, end) when start <= the end so far; a shared end merges, end + 1 does not. A key of any size is spread over tasks."""
    reached = running_max(df.select(key, "start", "end"), "end", "start", "end", group=[key], name="_reach")
    # Of equal rows the one that opens an island comes first in both orders.
    new = reached.select(key, "start", "end", F.coalesce((F.col("start") <= F.col("_reach")).cast("int"), F.lit(0)).alias("_goes_on")).withColumn("_new", 1 - F.col("_goes_on"))
    island = running_total(new, "_new", "start", "end", "_goes_on", group=[key], name="_i").withColumn("_i", F.col("_i") + F.col("_new"))
    return island.groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def hashed(*cols: str | Column, seed: int = 42) -> Column:
    """A seeded draw: the md5 of seed and values, so that other engines can draw the same rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def drawn_int(*cols: str | Column, seed: int = 42) -> Column:
    """A seeded draw from 0 to 2^48 - 1."""
    return F.conv(F.substring(hashed(*cols, seed=seed), 1, 12), 16, 10).cast("long")


def quota_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each class, in hash order."""
    w = Window.partitionBy(group).orderBy(hashed(key, seed=seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def even_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows at int(i * N / n) of the order; all rows if N <= n."""
    total = df.count()
    if total <= n:
        return df
    picks = df.sparkSession.range(n).select(F.floor(F.col("id") * total / n).cast("long").alias("index"))
    return with_index(df, *order).join(F.broadcast(picks), "index", "left_semi").drop("index")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in seeded hash order; all when there are no more."""
    return df.orderBy(hashed(key, seed=seed), key).limit(n)


def bootstrap(df: DataFrame, group: str, key: str, n: int, reps: int, seed: int = 42) -> DataFrame:
    """For each replicate and class, n rows without replacement; classes smaller than n are left out.

    The n rows of the least draws are meant. Draws far above the n-th of so many are passed over where a row is read, so
    that little more than the samples is copied; should that ever leave a sample short, nothing is passed over.
    """
    big = settled(df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= n), "classes")
    draw = hashed("rep", key, seed=seed)
    each = df.join(big, group).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_d", draw)
    share = F.conv(F.substring("_d", 1, 12), 16, 10).cast("double") / float(1 << 48)
    low = settled(each.where(share * F.col("_n") < n + 8 * n**0.5 + 40).drop("_n"), "draws")
    short = low.groupBy("rep", group).agg(F.count("*").alias("c")).where(F.col("c") >= n).count() < big.count() * reps
    w = Window.partitionBy("rep", group).orderBy("_d", key)
    return (each.drop("_n") if short else low).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_d")


def top_k(df: DataFrame, k: int, by: list[Column], group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def aligned_correlation(a: DataFrame, b: DataFrame, key: str, pos: str, x: str, y: str, least: int = 5) -> DataFrame:
    """(key, outcome, n, rho, mean): rank correlation of two sequences by key over the places both have, and the mean of `y` there.

    outcome: ok, no_left, no_right, or short where either has fewer than `least` places; skipped keys have null results.
    """
    n_a, n_b = (t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((a, "_na"), (b, "_nb")))
    state = F.when(F.col("_nb").isNull(), "no_right").when(F.col("_na").isNull(), "no_left").when(F.least("_na", "_nb") < least, "short").otherwise("ok")
    judged = n_a.join(n_b, key, "full_outer").select(key, state.alias("outcome"))
    pairs = a.select(key, pos, x).join(b.select(key, pos, y), [key, pos]).join(judged.where("outcome = 'ok'").select(key), key, "left_semi")
    ranked = avg_ranks(pairs.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), ["x", "y"], [key])
    varies = (F.min("_r_x") < F.max("_r_x")) & (F.min("_r_y") < F.max("_r_y"))
    told = ranked.groupBy(key).agg(F.count("*").alias("n"), F.when(varies, F.corr("_r_x", "_r_y")).alias("rho"), F.avg("y").alias("mean"))
    return judged.join(told, key, "left")


def cumulative_phase(df: DataFrame, key: str, order: list[str], step: str, name: str = "phase") -> DataFrame:
    """Running sum of `step` along each sequence, its own step included."""
    return running_total(df, step, *order, group=[key], name="_phase").withColumn(name, F.col("_phase") + F.col(step)).drop("_phase")


def recurring_pairs(df: DataFrame, panel: str, item: str, by: list[Column], k: int, least: int = 2) -> DataFrame:
    """(a, b, n): pairs of items that are both among the first k of at least `least` panels; k bounds a panel's pairs."""
    picked = top_k(df, k, by, [panel]).select(panel, item).distinct()
    other = picked.select(F.col(panel).alias("_p"), F.col(item).alias("b"))
    pairs = picked.join(other, (F.col(panel) == F.col("_p")) & (F.col(item) < F.col("b")))
    return pairs.groupBy(F.col(item).alias("a"), "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def representatives(df: DataFrame, col: str, key: str) -> DataFrame:
    """The rows with the largest, smallest and middle value (position N // 2), without repeats."""
    n = df.count()
    placed = with_index(df, col, key)
    return placed.where(F.col("index").isin(0, n // 2, n - 1)).drop("index")


def adjacent_cosine(df: DataFrame, key: str, pos: str, vec: str, least: int = 5) -> DataFrame:
    """1 - cos(v_j, v_j+1) along each sequence; shorter ones than `least` are skipped."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    long = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    pair = following(df.join(long, key, "left_semi"), [vec], pos, key, "_to").withColumn("_next", F.col(f"_to.{vec}")).where("_next is not null")
    cos = dot(F.col(vec), F.col("_next")) / F.sqrt(dot(F.col(vec), F.col(vec)) * dot(F.col("_next"), F.col("_next")))
    return pair.select(key, pos, (1 - cos).alias("distance"))


def around(df: DataFrame, columns: list[str], order: str, group: str, before: int, after: int) -> DataFrame:
    """`prev` and `next`: structs of the `before` rows before and the `after` rows after each row of the group, in order.

    Groups may span range partitions: a partition gets the few rows that lie next to it from those beside it.
    """
    dealt = _ranged(df, group, order)
    keys = ["_p", group]
    row, inside = F.struct(*columns), Window.partitionBy("_p", group).orderBy(order)
    placed = dealt.withColumn("_at", F.row_number().over(inside)).withColumn("_of", F.count("*").over(Window.partitionBy(*keys)))
    edge = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("_at", row.alias("r"))))), lambda x: x["r"])
    ends = placed.where((F.col("_at") <= after) | (F.col("_at") > F.col("_of") - before)).groupBy(*keys).agg(edge(F.col("_at") <= after).alias("_head"), edge(F.col("_at") > F.col("_of") - before).alias("_tail"))
    beside = Window.partitionBy(group).orderBy("_p")
    last = lambda x: F.slice(x, F.greatest(F.size(x) - before + 1, F.lit(1)), before)
    first = lambda x: F.slice(x, 1, after)
    ends = ends.select(*keys, F.flatten(F.collect_list("_tail").over(beside.rowsBetween(-before, -1))).alias("_b"), F.flatten(F.collect_list("_head").over(beside.rowsBetween(1, after))).alias("_a"))
    out = _carried(placed.withColumn("_l", F.collect_list(row).over(inside.rowsBetween(-before, -1))).withColumn("_r", F.collect_list(row).over(inside.rowsBetween(1, after))), ends, keys)
    return out.withColumn("prev", last(F.concat("_b", "_l"))).withColumn("next", first(F.concat("_r", "_a"))).drop("_p", "_at", "_of", "_l", "_r", "_b", "_a")


def frenet(df: DataFrame, key: str, pos: str) -> DataFrame:
    """kappa and tau along each curve (x, y, z) of 4 points or more: T from r', kappa from r'', N, B = T x N, tau from dB.

    A row takes one point before it and three after it; a curve of any length is spread over tasks.
    """
    eps = 1e-10
    long = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 4").select(key)
    out = around(df.join(long, key, "left_semi").select(key, pos, "x", "y", "z"), ["x", "y", "z"], pos, key, 1, 3).where(F.size("next") >= 2)
    out = out.withColumn("_q", F.concat("prev", F.array(F.struct("x", "y", "z")), "next")).withColumn("_i", F.size("prev"))

    def frame(i: Column) -> Column:
        a, b, c = (F.get("_q", i + k) for k in range(3))
        d = {t: b[t] - a[t] for t in "xyz"}
        e = {t: c[t] - b[t] - d[t] for t in "xyz"}
        size = lambda v: F.sqrt(sum((v[t] * v[t] for t in "xyz"), F.lit(0.0)))
        return F.struct(size(e).alias("k"), *[(d[t] / (size(d) + eps)).alias(f"t{t}") for t in "xyz"], *[(e[t] / (size(e) + eps)).alias(f"n{t}") for t in "xyz"])

    def bent(f: Column) -> dict[str, Column]:
        return {a: f[f"t{b}"] * f[f"n{c}"] - f[f"t{c}"] * f[f"n{b}"] for a, b, c in ("xyz", "yzx", "zxy")}

    # The first torsion has no predecessor and repeats the next one.
    out = out.withColumns({"_f": frame(F.col("_i")), "_u": frame(F.lit(0)), "_v": frame(F.lit(1))})
    u, v = bent(F.col("_u")), bent(F.col("_v"))
    tau = -sum(((v[t] - u[t]) * F.col(f"_u.n{t}") for t in "xyz"), F.lit(0.0))
    return out.select(key, pos, F.col("_f.k").alias("kappa"), F.coalesce(tau, F.lit(0.0)).alias("tau"))


def residue_error(curve: DataFrame, key: str, pos: str) -> DataFrame:
    """arccos(cos th_kappa * cos th_tau), th = atan2(difference, value + 1e-10), for each step of a curve."""
    out = following(curve, ["kappa", "tau"], pos, key, "_to").where("_to is not null")
    th = lambda c: F.atan2(F.col(f"_to.{c}") - F.col(c), F.col(c) + 1e-10)
    out = out.withColumn("_k", th("kappa")).withColumn("_t", th("tau"))
    return out.select(key, pos, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos("_k") * F.cos("_t")))).alias("error"))


def mean_error(kappa_deg: Column, tau_deg: Column, v_re: Column) -> Column:
    """Mean of |kappa^2 + tau^2 - V| / (|kappa^2 + tau^2| + 1e-10) in radians, to the shortest array's end; null if one is empty."""
    n = F.least(F.size(kappa_deg), F.size(tau_deg), F.size(v_re))
    each = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (lambda e: F.abs(e - F.get(v_re, i)) / (F.abs(e) + 1e-10))(F.radians(F.get(kappa_deg, i)) * F.radians(F.get(kappa_deg, i)) + F.radians(F.get(tau_deg, i)) * F.radians(F.get(tau_deg, i))),
    )
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n)
