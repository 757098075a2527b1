"""Embedding quality: silhouettes, preserved neighbourhoods, purity, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.operators import neighbours, pairs
from manifoldry.operators.order import avg_ranks, percentiles, running_total, sample_n
from manifoldry.operators.summary import joined, with_percentiles, with_scalars
from manifoldry.sources.store import settled


def silhouette(df: DataFrame, label: str, n_blocks: int | None = None) -> DataFrame:
    """(id, label, silhouette): (b - a) / max(a, b), 0 in a class of one."""
    sums = pairs.label_sums(df, label, n_blocks).withColumnRenamed(label, "_other").join(df.select("id", label), "id")
    mean = F.col("total") / F.col("n")
    own = F.col("_other") == F.col(label)
    ab = sums.groupBy("id", label).agg(F.max(F.when(own & (F.col("n") > 0), mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    value = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return ab.select("id", label, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(value).alias("silhouette"))


def silhouette_delta(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    x, y = silhouette(a, label), silhouette(b, label).select("id", F.col("silhouette").alias("after"))
    return x.withColumnRenamed("silhouette", "before").join(y, "id").withColumn("delta", F.col("after") - F.col("before"))


def silhouette_change(delta: DataFrame, label: str) -> DataFrame:
    """Each class's rows, mean before and after, percent change (0 from a mean of 0), quantiles of the difference and their outlier count.

    Outliers are rows whose |difference| is over the 99th percentile of all |differences|.
    """
    d = with_percentiles(delta.withColumn("_a", F.abs("delta")), "_a", {"_cut": 0.99})
    change = (F.col("mean_after") - F.col("mean_before")) / F.abs("mean_before") * 100
    means = d.groupBy(label).agg(F.count("*").alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.stddev_samp("delta").alias("std_delta"), F.count_if(F.col("_a") > F.col("_cut")).alias("n_outliers"))
    means = means.withColumn("percent_change", F.when(F.abs("mean_before") > 1e-6, change).otherwise(0.0))
    return joined(means, percentiles(delta, "delta", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, [label]), [label])


def neighborhood_preservation(hi: DataFrame, lo: DataFrame, k: int = 15) -> DataFrame:
    """Mean share of the k neighbours that both spaces have."""
    a, b = (neighbours.knn(x, k).select("src", "dst") for x in (hi, lo))
    return a.join(b, ["src", "dst"]).groupBy().agg(F.count("*").alias("_c")).crossJoin(hi.agg(F.count("*").alias("_n"))).select((F.col("_c") / (F.col("_n") * k)).alias("preservation"))


#: Rows of a sample whose pairs are all written.
MOST_SAMPLED = 5000


def _sampled_pairs(hi: DataFrame, lo: DataFrame, n: int, seed: int) -> DataFrame:
    """(d_hi, d_lo) of all pairs of n sampled rows in two spaces."""
    if n > MOST_SAMPLED:
        raise ValueError(f"a sample of {n} rows has too many pairs; {MOST_SAMPLED} are allowed")
    rows = sample_n(hi.select("id"), n, "id", seed)
    both = settled(rows.join(hi.select("id", F.col("vec").alias("_h")), "id").join(lo.select("id", F.col("vec").alias("_l")), "id"), "sample")
    a, b = (pairs.near(both.select("id", F.col(c).alias("vec")), float("inf")).withColumn("dist", F.round("dist", 9)).withColumnRenamed("dist", name) for c, name in (("_h", "d_hi"), ("_l", "d_lo")))
    return a.join(b, ["i", "j"]).select("d_hi", "d_lo")


def _rank_correlation(both: DataFrame, group: list[str]) -> DataFrame:
    ranked = avg_ranks(settled(both, "distances"), ["d_hi", "d_lo"], group)
    return ranked.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.corr("_r_d_hi", "_r_d_lo").alias("rho"))


def distance_correlation(hi: DataFrame, lo: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Spearman correlation of all pair distances of n sampled rows in two spaces; n is at most MOST_SAMPLED, since its pairs are rows."""
    return _rank_correlation(_sampled_pairs(hi, lo, n, seed), [])


def seed_stability(hi: DataFrame, lo: DataFrame, n: int, seeds: list[int]) -> DataFrame:
    """(seed, rho, mean, std): the distance correlation of each seed's sample; all seeds are ranked together."""
    parts = [_sampled_pairs(hi, lo, n, s).withColumn("seed", F.lit(s)) for s in seeds]
    out = _rank_correlation(reduce(DataFrame.unionByName, parts), ["seed"]).drop("n_pairs")
    return with_scalars(out, F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("std"))


def knn_purity(df: DataFrame, label: str, k: int = 15) -> DataFrame:
    """(label, n, purity, prevalence, enrichment): share of neighbours of one's own class."""
    names = df.select("id", label)
    edges = neighbours.knn(df.select("id", "vec"), k).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    purity = edges.groupBy("a").agg(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("purity")).withColumnRenamed("a", label)
    total = df.agg(F.count("*").alias("_t"))
    shares = df.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("prevalence", F.col("n") / F.col("_t")).drop("_t")
    return shares.join(purity, label).withColumn("enrichment", F.col("purity") / F.col("prevalence"))


def knn_cv(df: DataFrame, label: str, k: int = 5, folds: int = 5) -> DataFrame:
    """(fold, balanced_accuracy, mean, std): majority of the k nearest rows of other folds, ties to the smallest label; mean and deviation over folds."""
    at = running_total(df.withColumn("_1", F.lit(1)), "_1", "id", group=[label], name="_at")
    dealt = settled(at.withColumn("fold", F.pmod("_at", F.lit(folds)).cast("int")).drop("_1", "_at"), "folds")
    names = dealt.select("id", label)
    votes = neighbours.knn(dealt, k, other="fold").join(names.toDF("dst", "v"), "dst").groupBy("src", "v").agg(F.count("*").alias("c"))
    said = votes.groupBy("src").agg(F.min(F.struct((-F.col("c")).alias("c"), "v"))["v"].alias("said")).withColumnRenamed("src", "id")
    recall = dealt.join(said, "id").groupBy("fold", label).agg(F.avg(F.when(F.col("said") == F.col(label), 1.0).otherwise(0.0)).alias("recall"))
    scores = recall.groupBy("fold").agg(F.avg("recall").alias("balanced_accuracy"))
    return with_scalars(scores, F.avg("balanced_accuracy").alias("mean"), F.stddev_pop("balanced_accuracy").alias("std"))
