"""Rank statistics, tests and fits. Statistics are aggregates; p-values are scalar functions of one row a test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.operators.order import avg_rank, avg_ranks, percentiles, running_total, same_keys
from manifoldry.operators.summary import joined


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return 1.0 if df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(level: float, df: float) -> float:
    """The t that the two-sided `level` lies within, by bisection."""
    lo, hi = 0.0, 1.0
    while t_p(hi, df) > 1 - level:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_p(mid, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


def chi2_p(x: float, df: float) -> float:
    """Upper tail of chi-square, by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= y / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b, c = y + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 1000):
        k = -n * (n - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def kolmogorov_p(x: float) -> float:
    return 1.0 if x < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def with_p(df: DataFrame, name: str, fn, *cols: str) -> DataFrame:
    """A p-value column, in Arrow batches: grouped tests have as many rows as groups."""

    @F.pandas_udf("double")
    def p(v: pd.DataFrame) -> pd.Series:
        values = zip(*[v[c] for c in v.columns], strict=True)
        return pd.Series([None if any(pd.isna(x) for x in row) else float(fn(*row)) for row in values], dtype="float64")

    return df.withColumn(name, p(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])))


def with_rho_p(df: DataFrame) -> DataFrame:
    """Two-sided p of rho from n pairs."""
    rho = F.col("rho")
    t = F.when(F.abs(rho) >= 1, float("inf")).otherwise(F.abs(rho) * F.sqrt((F.col("n") - 2) / (1 - rho * rho)))
    return with_p(df.withColumn("_t", t).withColumn("_df", F.col("n") - 2), "p", lambda t, d: 0.0 if math.isinf(t) else t_p(t, d), "_t", "_df").drop("_t", "_df")


def _enough(df: DataFrame, group: list[str], least: int) -> DataFrame:
    """The rows of groups of `least` rows or more."""
    if not group:
        return df
    renamed = [f"_e{i}" for i in range(len(group))]
    big = df.groupBy(*[F.col(g).alias(n) for g, n in zip(group, renamed, strict=True)]).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(big, same_keys(group, renamed), "left_semi")


def spearman(df: DataFrame, a: str, b: str, group: list[str] | None = None, least: int = 3, p: bool = False) -> DataFrame:
    """n and rho for each group, over pairs without nulls; groups of fewer than `least` rows are left out."""
    group = group or []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    ranked = avg_ranks(_enough(pairs, group, least), ["x", "y"], group)
    varies = (F.min("_r_x") < F.max("_r_x")) & (F.min("_r_y") < F.max("_r_y"))
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.when(varies, F.corr("_r_x", "_r_y")).alias("rho"))
    return with_rho_p(out) if p else out


def spearman_matrix(df: DataFrame, columns: list[str], panel: str, least: int = 11, p: bool = False, mask: dict[str, str] | None = None, overall: str | None = None) -> DataFrame:
    """(panel, a, b, n, rho) for all column pairs in each panel with enough rows; `overall` names one more panel, of all rows.

    A column is ranked once for each set of rows it is complete in: where no value is missing, four columns are four
    rankings, not twelve. `mask` names a score for some columns, whose values count only where the score is above 0.
    """
    for c, score in (mask or {}).items():
        df = df.withColumn(c, F.when(F.col(score) > 0, F.col(c)))
    df = df.select(panel, *[F.col(c).cast("double").alias(c) for c in columns])
    if overall is not None:
        df = df.withColumn(panel, F.explode(F.array(F.col(panel).cast("string"), F.lit(overall))))
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).head()
    whole = [c for c in columns if not gaps[c]]
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    shared, own = ([q for q in pairs if (q[0] in whole and q[1] in whole) == w] for w in (True, False))
    out = None
    if shared:
        ranked = avg_ranks(_enough(df, [panel], least), whole, [panel])
        varies = lambda c: F.min(f"_r_{c}") < F.max(f"_r_{c}")
        one = ranked.groupBy(panel).agg(F.count("*").alias("n"), *[F.when(varies(x) & varies(y), F.corr(f"_r_{x}", f"_r_{y}")).alias(f"_c{i}") for i, (x, y) in enumerate(shared)])
        rows = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col("n"), F.col(f"_c{i}").alias("rho")) for i, (x, y) in enumerate(shared)])
        out = one.select(panel, F.inline(rows))
    if own:
        items = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("va"), F.col(y).alias("vb")) for x, y in own])
        rest = spearman(df.select(panel, F.inline(items)), "va", "vb", [panel, "a", "b"], least)
        out = rest if out is None else out.unionByName(rest)
    return with_rho_p(out) if p else out


def strongest(matrix: DataFrame, panel: str, level: float = 0.05) -> DataFrame:
    """Of a matrix with p, each panel's pair of the greatest |rho| (ties by name), and its significant pairs, strongest first."""
    order = F.struct((-F.abs("rho")).alias("k"), "a", "b", "rho", "p")
    out = matrix.where(F.col("rho").isNotNull()).groupBy(panel).agg(F.min(order).alias("s"), F.array_sort(F.collect_list(F.when(F.col("p") < level, order))).alias("l"))
    names = F.transform("l", lambda x: F.concat_ws("~", x["a"], x["b"]))
    return out.select(panel, F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.rho").alias("rho"), F.col("s.p").alias("p"), names.alias("significant"))


def linear_fit(df: DataFrame, x: str, y: str, group: list[str], p: bool = False) -> DataFrame:
    """slope, intercept, r2, residual deviation s (n - 2), and what a band needs: n, mean_x, sxx. With `p`, that of the slope."""
    d = df.groupBy(*group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mean_x"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("_syy")
    )
    d = d.withColumn("s", F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") * (1 - F.col("r2"))) / (F.col("n") - 2))).drop("_syy")
    if not p:
        return d
    t = F.when(F.col("r2") >= 1, float("inf")).otherwise(F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return with_p(d.withColumn("_t", t).withColumn("_df", F.col("n") - 2), "p", lambda t, f: 0.0 if math.isinf(t) else t_p(t, f), "_t", "_df").drop("_t", "_df")


def fit_band(fit: DataFrame, grid: DataFrame, factor: float | None = 1.96, level: float = 0.95) -> DataFrame:
    """The fit's line and band at the grid's x0; both tables have few rows by design. Without a factor, that of t at `level`."""
    if factor is None:
        fit = with_p(fit.withColumn("_df", F.col("n") - 2), "factor", lambda f: t_quantile(level, f), "_df").drop("_df")
    factor = F.col("factor") if factor is None else F.lit(factor)
    se = F.col("s") * F.sqrt(1 / F.col("n") + (F.col("x0") - F.col("mean_x")) ** 2 / F.col("sxx"))
    line = F.col("intercept") + F.col("slope") * F.col("x0")
    return fit.crossJoin(F.broadcast(grid)).withColumn("y0", line).withColumn("lower", line - factor * se).withColumn("upper", line + factor * se)


def _against(df: DataFrame, group: str, ref: str, col: str) -> DataFrame:
    """Rows of each class beside a copy of the reference's rows for it: (class, value, is_ref)."""
    classes = df.select(group).distinct().where(F.col(group) != ref)
    others = df.where(F.col(group) != ref).select(group, col, F.lit(0).alias("is_ref"))
    return others.unionByName(df.where(F.col(group) == ref).select(col).crossJoin(F.broadcast(classes)).select(group, col, F.lit(1).alias("is_ref")))


def upper_p(z: float) -> float:
    """One-sided: how often a normal value exceeds z."""
    return math.erfc(z / math.sqrt(2)) / 2


def mann_whitney(df: DataFrame, group: str, ref: str, col: str, p: bool = False, greater: bool = False) -> DataFrame:
    """U of each class against the reference; p is normal, corrected for ties and continuity.

    With `greater`, z and p are one-sided: small where the class has greater values than the reference.
    """
    ranked = avg_rank(_against(df, group, ref, col), col, [group], "_r")
    ties = ranked.groupBy(group, col).agg(F.count("*").alias("c")).groupBy(group).agg(F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties"))
    out = ranked.groupBy(group).agg(F.count_if(F.col("is_ref") == 0).alias("n1"), F.count_if(F.col("is_ref") == 1).alias("n2"), F.sum(F.when(F.col("is_ref") == 0, F.col("_r"))).alias("_s"))
    out = out.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2).drop("_s").join(ties, group)
    n = (F.col("n1") + F.col("n2")).cast("double")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    off = F.col("u") - F.col("n1") * F.col("n2") / 2.0
    out = out.withColumn("z", (off - 0.5 if greater else F.greatest(F.lit(0.0), F.abs(off) - 0.5)) / sd)
    return with_p(out, "p", upper_p if greater else normal_p, "z") if p else out


def ks_two_sample(df: DataFrame, group: str, ref: str, col: str, p: bool = False) -> DataFrame:
    """The largest gap between each class's distribution and the reference's; direction is the sign of its median's shift from the reference's."""
    counts = _against(df, group, ref, col).groupBy(group, col).agg(F.sum(1 - F.col("is_ref")).alias("a"), F.sum("is_ref").alias("b"))
    totals = counts.groupBy(group).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    both = running_total(running_total(counts, "a", col, group=[group], name="_a"), "b", col, group=[group], name="_b")
    gap = (F.col("_a") + F.col("a")) / F.col("n1") - (F.col("_b") + F.col("b")) / F.col("n2")
    out = joined(both, totals, [group]).groupBy(group).agg(F.max(F.abs(gap)).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    medians = percentiles(df, col, {"_m": 0.5}, [group])
    medians = medians.crossJoin(F.broadcast(medians.where(F.col(group) == ref).select(F.col("_m").alias("_ref"))))
    out = joined(out, medians.select(group, F.signum(F.col("_m") - F.col("_ref")).cast("int").alias("direction")), [group])
    if not p:
        return out
    return with_p(out.withColumn("_x", F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))), "p", kolmogorov_p, "_x").drop("_x")


def kruskal(df: DataFrame, group: str, col: str, p: bool = False) -> DataFrame:
    """H with tie correction and eta squared: one row."""
    ranked = avg_rank(df.select(group, col).where(F.col(col).isNotNull()), col, None, "_r")
    classes = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("s"))
    ties = df.groupBy(col).agg(F.count("*").alias("c")).agg(F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties"))
    one = classes.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).crossJoin(ties)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    out = one.withColumn("h", h).withColumn("eta2", (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).withColumn("small", F.col("eta2") < 0.06)
    out = out.select("n", "k", "h", "eta2", "small")
    return with_p(out.withColumn("_df", F.col("k") - 1), "p", chi2_p, "h", "_df").drop("_df") if p else out


def _moments(df: DataFrame, group: str, a: str, b: str, col: str) -> DataFrame:
    pick = lambda g: F.when(F.col(group) == g, F.col(col))
    return df.agg(*[f(pick(g)).alias(f"{n}{i}") for i, g in ((1, a), (2, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("p", F.var_pop), ("n", F.count))])


def t_test(df: DataFrame, group: str, a: str, b: str, col: str, p: bool = False) -> DataFrame:
    """Equal-variance two-sample t."""
    c = F.col
    pooled = ((c("n1") - 1) * c("v1") + (c("n2") - 1) * c("v2")) / (c("n1") + c("n2") - 2)
    out = _moments(df, group, a, b, col).withColumn("t", (c("m1") - c("m2")) / F.sqrt(pooled * (1 / c("n1") + 1 / c("n2")))).withColumn("df", c("n1") + c("n2") - 2)
    return with_p(out.select("t", "df"), "p", t_p, "t", "df") if p else out.select("t", "df")


def cohens_d(df: DataFrame, group: str, a: str, b: str, col: str) -> DataFrame:
    """(m1 - m2) / pooled deviation, of population variances with n - 1 weights."""
    c = F.col
    pooled = F.sqrt(((c("n1") - 1) * c("p1") + (c("n2") - 1) * c("p2")) / (c("n1") + c("n2") - 2))
    return _moments(df, group, a, b, col).select(((c("m1") - c("m2")) / pooled).alias("d"))
