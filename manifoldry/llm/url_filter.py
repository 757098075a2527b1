"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that the rules label: length, depth, digit ratio, character entropy, parameter counts and
how often each host suffix was blocked among labelled URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manifoldry.llm.common import let, materialise, read

#: (host and path prefix, verdict). A rule holds for its host and all subdomains.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Most labelled URLs that the trees learn from, half for each verdict; a sample by hash of the URL beyond that.
MAX_TRAIN = 20_000
TREES, DEPTH = 12, 4
#: Weight of the overall block rate in a suffix's statistic, in URLs.
PRIOR = 20.0
FEATURES = ("f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_suffix")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """`pages` with host and path; both empty without `://` or for a null url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(url, _SPLIT, 2))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict, of the longest rule that fits, or null. The rules are a bounded parameter."""
    best = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits is the longest
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(best)
    return urls.withColumn("_r", best).withColumn("rule", F.col("_r.rule")).withColumn("rule_verdict", F.col("_r.rule_verdict")).drop("_r")


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    chars = F.array_sort(F.split(text, ""))
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")

    def of(c: Column) -> Column:
        share = lambda x: (F.size(c) - F.size(F.array_remove(c, x))) / n
        return -F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, x: a + let(share(x), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))

    return let(chars, of)


def lexical(urls: DataFrame) -> DataFrame:
    """The features but the suffix statistic, and suffix: the host's last two labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.char_length(url)
    return urls.withColumns(
        {
            "f_length": length.cast("double"),
            "f_host_length": F.char_length("host").cast("double"),
            "f_depth": F.regexp_count(F.col("path"), F.lit("/[^/]")).cast("double"),
            "f_digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
            "f_entropy": _entropy(url),
            "f_params": F.regexp_count(url, F.lit(r"[?&][^=&?#]+=")).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "suffix": F.substring_index("host", ".", -2),
        }
    )


def with_score(urls: DataFrame) -> DataFrame:
    """`urls` (url, host, path, rule_verdict) with a score: how likely the trees take each for one to block.

    They learn from distinct URLs with a rule_verdict, at most MAX_TRAIN / 2 of each verdict, those of the least hash,
    weighed by how often each stands there. A labelled URL's own rows are left out of its suffix statistic.
    """
    rows = materialise(urls.withColumn("suffix", F.substring_index("host", ".", -2)), "urls")
    labelled = rows.where("rule_verdict is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    distinct = materialise(labelled.groupBy("url", "host", "path", "suffix", "label").agg(F.count("*").cast("double").alias("times")), "labelled")
    totals = distinct.agg(F.sum("times").alias("n"), F.sum(F.col("label") * F.col("times")).alias("blocked"), F.count_distinct("label").alias("kinds")).head()
    rate = float((totals.blocked or 0.0) / (totals.n or 1.0))
    stats = distinct.groupBy("suffix").agg(F.sum(F.col("label") * F.col("times")).alias("_b"), F.sum("times").alias("_n"))
    smoothed = lambda b, n: F.coalesce((b + PRIOR * rate) / (n + PRIOR), F.lit(rate))
    featured = lexical(rows).join(stats, "suffix", "left").withColumn("f_suffix", smoothed(F.col("_b"), F.col("_n"))).drop("_b", "_n")
    if totals.kinds < 2:
        return featured.withColumn("score", F.lit(0.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    chosen = None
    for label in (0.0, 1.0):
        part = distinct.where(F.col("label") == label).orderBy(F.xxhash64("url", F.lit("train")), "url").limit(MAX_TRAIN // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    own = F.col("times")
    train = lexical(chosen).join(stats, "suffix").withColumn("f_suffix", smoothed(F.col("_b") - F.col("label") * own, F.col("_n") - own))
    train = materialise(vectors.transform(train).select("features", "label", "times", "url").orderBy("url").coalesce(1).select("features", "label", "times"), "url-train")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, weightCol="times").fit(train)
    return model.transform(vectors.transform(featured)).withColumn("score", vector_to_array("probability")[1])


def held_out_accuracy(pages: DataFrame) -> DataFrame:
    """n, n_right: URLs that a rule labels and whose crc32 is a multiple of 5, judged by trees that learn from the others."""
    ruled = with_rule(parsed(pages.select("page_id", "url"))).withColumnRenamed("rule_verdict", "truth")
    hidden = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5 == 0
    scored = with_score(ruled.withColumn("hidden", hidden).withColumn("rule_verdict", F.when(~hidden, F.col("truth"))))
    right = F.when((F.col("score") > 0.5) == (F.col("truth") == "block"), 1).otherwise(0)
    return scored.where(F.col("hidden") & F.col("truth").isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("n_right"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of `pages` (page_id, url).

    verdict: the rule's, else block where the trees' score is over a half. score: null where a rule decides. With fewer
    than two kinds of labels there is nothing to learn and every other URL is allowed, at score 0. Null and empty URLs
    have an empty host and path and are judged by the trees. Empty input: empty result.
    """
    scored = with_score(with_rule(parsed(pages.select("page_id", "url"))))
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What rules alone say of every page's URL; the part of op3 that SQL can express."""
    return with_rule(parsed(read(spark, sf_dir, "pages").select("page_id", "url"))).select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"))


_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
RULES_SQL = f"""
WITH r(rule, verdict) AS (VALUES {_RULES}), u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h, r WHERE ('.' || host).ends_with('.' || split_part(rule, '/', 1)) AND path.starts_with(substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT h.*, m.rule, m.verdict FROM h LEFT JOIN m USING (page_id)"""
