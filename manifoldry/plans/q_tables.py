"""Queries of joins (J), aggregations (A) and set operations (U)."""

from pyspark.sql import functions as F

from manifoldry.operators import joins as J
from manifoldry.operators import summary as A
from manifoldry.plans.common import SEQ, T, VECTORS, r, sequences, vectors
from manifoldry.plans.registry import query


@query("j1_match_ids", "SELECT count(*) FILTER (s IS NOT NULL) AS matched, count(*) FILTER (s IS NULL) AS missed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS s FROM labels) ON d.doc_id = s")
def j1(spark, sf):
    return J.match_ids(T(spark, sf, "labels"), T(spark, sf, "documents"), "doc_id")


@query("j2_enrich_first", "SELECT c_custkey, o_orderkey AS first_order, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) ON o_custkey = c_custkey AND k = 1")
def j2(spark, sf):
    meta = T(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    return J.enrich_first(T(spark, sf, "customer").select("c_custkey"), meta, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", F.col("o_orderkey").alias("first_order"), "o_totalprice")


@query("j3_enrich_where", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND lang = 'de'")
def j3(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang")
    return J.enrich_where(d, F.col("lang") == "de", T(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("j4_lookup_fallback", """
SELECT doc_id, coalesce(a, b) AS n, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'none' END AS outcome
FROM documents LEFT JOIN (SELECT doc_id, quality AS a FROM labels) USING (doc_id) LEFT JOIN (SELECT page_id AS doc_id, length(url)::INT AS b FROM pages) USING (doc_id)""")
def j4(spark, sf):
    first = T(spark, sf, "labels").select("doc_id", F.col("quality").alias("n"))
    second = T(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.length("url").alias("n"))
    return J.lookup_fallback(T(spark, sf, "documents").select("doc_id"), first, second, "doc_id", "n")


@query("j4_locate", """
WITH t AS (SELECT c_custkey AS k, c_custkey % 3 AS m, upper(regexp_replace(c_name || c_mktsegment || c_mktsegment, '[^A-Za-z]', '', 'g')) AS seq FROM customer),
f AS (SELECT k, m, seq, CASE WHEN k % 5 = 0 THEN 'QQQQQQ' ELSE substr(seq, 4, 6) END AS frag FROM t)
SELECT k, CASE WHEN m < 2 AND k % 5 > 0 THEN strpos(seq, frag) END::INT AS start, CASE WHEN m < 2 AND k % 5 > 0 THEN strpos(seq, frag) + 5 END::INT AS "end",
  CASE WHEN m = 2 THEN 'none' WHEN k % 5 = 0 THEN 'mismatch' WHEN m = 0 THEN 'first' ELSE 'second' END AS outcome FROM f""")
def j4_locate(spark, sf):
    """Fragments of sequences made of customers' names and segments, in two tables that hold a third of the keys each."""
    name = F.upper(F.regexp_replace(F.concat("c_name", "c_mktsegment", "c_mktsegment"), "[^A-Za-z]", ""))
    t = T(spark, sf, "customer").select(F.col("c_custkey").alias("k"), name.alias("seq"))
    asked = t.select("k", F.when(F.col("k") % 5 == 0, "QQQQQQ").otherwise(F.substring("seq", 4, 6)).alias("frag"))
    return J.locate_fallback(asked, t.where("k % 3 = 0"), t.where("k % 3 = 1"), "k", "frag", "seq").drop("frag")


@query("j5_lookup_alt_key", "SELECT p_partkey, coalesce(s1.s_name, s2.s_name) AS name FROM part LEFT JOIN supplier s1 ON s1.s_suppkey = p_partkey LEFT JOIN supplier s2 ON s2.s_suppkey = p_size")
def j5(spark, sf):
    names = T(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return J.lookup_alt_key(T(spark, sf, "part").select("p_partkey", "p_size"), names, "s_suppkey", "name", [F.col("p_partkey"), F.col("p_size").cast("long")]).select("p_partkey", "name")


@query("j6_override", f"SELECT id, id % 7 = 0 AS replaced, round(CASE WHEN id % 7 = 0 THEN -vec[1] ELSE vec[1] END, 6) AS v0 FROM {VECTORS}")
def j6(spark, sf):
    v = vectors(spark, sf)
    over = v.where("id % 7 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec"))
    return J.replace_embeddings(v, over, "id", "vec").select("id", "replaced", r(F.col("vec")[0]).alias("v0"))


@query("j7_score_sets", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS scored FROM documents")
def j7(spark, sf):
    d, s = T(spark, sf, "documents").select("doc_id"), T(spark, sf, "labels")
    return J.with_score(d, s, "doc_id").withColumn("scored", F.lit(True)).union(J.without_score(d, s, "doc_id").withColumn("scored", F.lit(False)))


@query("j8_features", "SELECT c_custkey, c_mktsegment, n_orders, round(spent, 2) AS spent, n_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j8(spark, sf):
    c = T(spark, sf, "customer")
    orders = T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    nation = c.select("c_custkey", "c_nationkey").join(T(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return J.assemble_features(c.select("c_custkey", "c_mktsegment"), [orders, nation], "c_custkey")


@query("j9_compare", """
WITH m AS (SELECT l_returnflag AS category, l_linestatus AS method, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL)
SELECT category, max(v) FILTER (method = 'F') AS "F", max(v) FILTER (method = 'O') AS "O", arg_min(method, (-v, method)) AS best FROM m GROUP BY category""")
def j9(spark, sf):
    m = T(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("method")).agg(r(F.avg("l_quantity")).alias("v"))
    return J.compare_methods(m, "category", "method", "v", ["F", "O"])


@query("j13_near_duplicates", f"""
WITH d AS MATERIALIZED (SELECT doc_id, seq, min(doc_id) OVER (PARTITION BY seq) AS rep FROM {SEQ} WHERE length(seq) >= 5),
k AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5))) AS kmer FROM d WHERE doc_id = rep),
c AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT doc_id, kmer, n / (sum(n) OVER (PARTITION BY doc_id)) AS s FROM c),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.s, b.s)) AS low FROM p a JOIN p b ON a.kmer = b.kmer AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, round(low / (2 - low), 6) AS similarity FROM q WHERE low / (2 - low) > 0.95 UNION ALL SELECT rep, doc_id, 1.0 FROM d WHERE rep <> doc_id""")
def j13(spark, sf):
    return J.near_duplicates(sequences(spark, sf), "doc_id", "seq").select("a", "b", r(F.col("similarity")).alias("similarity"))


@query("j14_ordinal_pairs", """
SELECT a.i AS index, round(abs(a.x - b.x), 4) AS gap FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS x FROM customer) a
JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal AS x FROM supplier) b ON a.i = b.i""")
def j14(spark, sf):
    pairs = J.pair_by_ordinal(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), T(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "c_custkey", "s_suppkey")
    return pairs.select("index", F.round(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 4).alias("gap"))


_INTERVALS = "(SELECT event_type AS g, epoch(min(ts)) / 3600 - 473352 AS birth, epoch(max(ts)) / 3600 - 473352 AS death FROM events GROUP BY event_type, user_id)"


def intervals(spark, sf):
    """Event types and users as intervals, in hours."""
    hours = lambda c: F.unix_micros(c) / 1e6 / 3600 - 473352
    e = T(spark, sf, "events").groupBy(F.col("event_type").alias("g"), "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("g", hours(F.col("a").cast("timestamp")).alias("birth"), hours(F.col("b").cast("timestamp")).alias("death"))


@query("j16_scale_curve", f"SELECT g, s, count(*) FILTER (birth <= s AND s < death) AS alive FROM {_INTERVALS}, (SELECT unnest(range(0, 745, 24))::DOUBLE AS s) GROUP BY ALL")
def j16(spark, sf):
    scales = spark.range(0, 745, 24).select(F.col("id").cast("double").alias("s"))
    return J.scale_curve(intervals(spark, sf), scales, ["g"])


@query("a1_shares", "SELECT lang, source, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY ALL")
def a1(spark, sf):
    return A.value_shares(T(spark, sf, "documents"), "lang", "source").withColumn("percent", r(F.col("percent")))


@query("a2_describe", """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std_pop, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL""")
def a2(spark, sf):
    d = A.describe_by(T(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return d.select("l_returnflag", "n", *[r(F.col(c), 4).alias(c) for c in ("mean", "std_pop", "std")], "min", *[r(F.col(c), 4).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("a3_tails", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b FROM lineitem) SELECT l_returnflag, count(*) FILTER (l_extendedprice >= b) AS high, count(*) FILTER (l_extendedprice <= a) AS low FROM lineitem, q GROUP BY ALL")
def a3(spark, sf):
    return A.flag_tails(T(spark, sf, "lineitem"), "l_extendedprice").groupBy("l_returnflag").agg(F.count_if("is_high").alias("high"), F.count_if("is_low").alias("low"))


@query("a4_distinct_rounded", "SELECT count(DISTINCT round(l_extendedprice, 0)) AS places_0, count(DISTINCT round(l_extendedprice, 2)) AS places_2 FROM lineitem")
def a4(spark, sf):
    return A.distinct_rounded(T(spark, sf, "lineitem"), "l_extendedprice", [0, 2])


@query("a5_histogram", "WITH q AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT l_returnflag, least(floor((l_extendedprice - a) / ((b - a) / 30)), 29)::INT AS bin, count(*) AS n FROM lineitem, q GROUP BY ALL")
def a5(spark, sf):
    return A.histogram(T(spark, sf, "lineitem"), "l_extendedprice", 30, ["l_returnflag"])


@query("a5_density", "WITH v AS (SELECT l_returnflag, log10(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0), q AS (SELECT min(x) AS a, max(x) AS b FROM v), h AS (SELECT l_returnflag, least(floor((x - a) / ((b - a) / 30)), 29)::INT AS bin, count(*) AS n, any_value((b - a) / 30) AS w FROM v, q GROUP BY ALL) SELECT l_returnflag, bin, n, round(n / sum(n) OVER (PARTITION BY l_returnflag) / w, 6) AS density FROM h")
def a5_density(spark, sf):
    return A.histogram(T(spark, sf, "lineitem"), "l_extendedprice", 30, ["l_returnflag"], log=True, density=True).withColumn("density", r(F.col("density")))


@query("a6_ecdf", "SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 6) AS share FROM lineitem")
def a6(spark, sf):
    return A.ecdf(T(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("share", r(F.col("share")))


_LETTERS = f"(SELECT lang, x AS letter, count(*) AS n FROM (SELECT lang, unnest(string_split(seq, '')) AS x FROM {SEQ}) WHERE x <> '' GROUP BY ALL)"


@query("a7_composition", f"SELECT lang, letter, n, round(n * 100.0 / sum(n) OVER (PARTITION BY lang), 6) AS percent FROM {_LETTERS}")
def a7(spark, sf):
    return A.composition(sequences(spark, sf), "seq", ["lang"]).withColumn("percent", r(F.col("percent")))


@query("a7_top_letters", f"SELECT lang, letter, n, place, letters FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, letter)::INT AS place, count(*) OVER (PARTITION BY lang) AS letters FROM {_LETTERS}) WHERE place <= 5")
def a7_top(spark, sf):
    return A.top_letters(sequences(spark, sf), "seq", ["lang"], 5)


@query("a8_deviation", f"SELECT lang, letter, round(n * 100.0 / sum(n) OVER (PARTITION BY lang) - 100.0 / 26, 6) AS difference FROM {_LETTERS}")
def a8(spark, sf):
    even = spark.range(26).select(F.char(F.col("id") + 65).alias("letter"), F.lit(100.0 / 26).alias("expected"))
    return A.composition_deviation(A.composition(sequences(spark, sf), "seq", ["lang"]), even).select("lang", "letter", r(F.col("difference")).alias("difference"))


@query("a9_funnel", """
WITH c AS (SELECT count(*) AS c0, count(*) FILTER (n_chars >= 500) AS c1, count(*) FILTER (n_chars >= 500 AND lang = 'en') AS c2, count(*) FILTER (n_chars >= 500 AND lang = 'en' AND source = 'src0') AS c3 FROM documents)
SELECT 1 AS step, 'long' AS name, c1 AS n, round(c1 / c0, 6) AS rate FROM c UNION ALL SELECT 2, 'english', c2, round(c2 / c1, 6) FROM c UNION ALL SELECT 3, 'src0', c3, round(c3 / c2, 6) FROM c""")
def a9(spark, sf):
    steps = [("long", F.col("n_chars") >= 500), ("english", F.col("lang") == "en"), ("src0", F.col("source") == "src0")]
    return A.funnel(T(spark, sf, "documents"), steps).withColumn("rate", r(F.col("rate")))


@query("a10_volume", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS residues, count(*) * 2560 * 2 AS sequence_bytes, (sum(n_chars) * 2560 * 2)::BIGINT AS residue_bytes, round(sum(n_chars) / 12178, 4) AS seconds, sum(n_chars) * 2560 * 2 <= 60e9 AS within_budget FROM documents")
def a10(spark, sf):
    return A.estimate_volume(T(spark, sf, "documents"), "n_chars", 2560, 2, 12178.0, 60e9).withColumn("seconds", F.round("seconds", 4))


@query("a11_merge_counts", """
WITH a AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey < 20 GROUP BY ALL),
t AS (SELECT k, coalesce(x, 0) AS existing, coalesce(y, 0) AS added FROM a FULL JOIN b USING (k))
SELECT k, existing, added, existing + added AS total, round((existing + added) * 100.0 / (SELECT sum(existing + added) FROM t), 6) AS percent, round(CASE WHEN existing > 0 THEN (existing + added) / existing END, 6) AS growth FROM t""")
def a11(spark, sf):
    a = T(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    b = T(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("k"))
    return A.merge_counts(a, b, "k").withColumn("percent", r(F.col("percent"))).withColumn("growth", r(F.col("growth")))


@query("a12_dominant", "SELECT user_id, event_type AS dominant FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1")
def a12(spark, sf):
    return A.dominant(T(spark, sf, "events"), ["user_id"], "event_type")


@query("a13_fold_change", "WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY ALL) SELECT event_type, round(mean, 6) AS mean, round(mean / (SELECT mean FROM m WHERE event_type = 'error'), 6) AS fold FROM m")
def a13(spark, sf):
    return A.fold_change(T(spark, sf, "events"), "event_type", "error", "value").select("event_type", r(F.col("mean")).alias("mean"), r(F.col("fold")).alias("fold"))


@query("a14_sign_shares", """
SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 0 THEN 100.0 ELSE 0 END), 6) AS positive, round(avg(CASE WHEN c_acctbal < 0 THEN 100.0 ELSE 0 END), 6) AS negative,
  round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.75), 4) AS q75 FROM customer GROUP BY ALL""")
def a14(spark, sf):
    d = A.sign_shares(T(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return d.select("c_mktsegment", r(F.col("positive")).alias("positive"), r(F.col("negative")).alias("negative"), *[r(F.col(c), 4).alias(c) for c in ("q25", "q50", "q75")])


@query("a15_significance", """
SELECT l_returnflag, count(*) FILTER (l_tax < 0.05 AND x > 0) AS positive, count(*) FILTER (l_tax < 0.05 AND x < 0) AS negative, count(*) FILTER (l_tax >= 0.05) AS unsure, round(avg(x), 6) AS mean_rho, round(median(x), 6) AS median_rho
FROM (SELECT *, l_discount - 0.05 AS x FROM lineitem) GROUP BY ALL""")
def a15(spark, sf):
    d = A.significance_split(T(spark, sf, "lineitem").withColumn("x", F.col("l_discount") - 0.05), ["l_returnflag"], "x", "l_tax")
    return d.withColumn("mean_rho", r(F.col("mean_rho"))).withColumn("median_rho", r(F.col("median_rho")))


@query("a16_vector_mean", f"""
SELECT label, list(round(m, 6) ORDER BY i) AS mean FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(vec) AS v, unnest(range(64)) AS i FROM {VECTORS}) GROUP BY ALL) GROUP BY label""")
def a16(spark, sf):
    return A.vector_mean(vectors(spark, sf), ["label"], "vec").select("label", F.transform("mean", lambda x: r(x)).alias("mean"))


@query("a17_checks", "SELECT sum(n)::BIGINT AS rows, count(*) AS keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated, sum(bad)::BIGINT AS not_finite FROM (SELECT vec_id, count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS bad FROM embeddings GROUP BY vec_id)")
def a17(spark, sf):
    return A.quality_checks(vectors(spark, sf), "id", "vec")


@query("u1_union", "SELECT 'a' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS size FROM customer UNION ALL SELECT 'b', p_partkey, NULL, NULL, p_size FROM part")
def u1(spark, sf):
    a = T(spark, sf, "customer").select(F.lit("a").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = T(spark, sf, "part").select(F.lit("b").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return J.union_datasets([a, b], ["kind", "id"])


@query("u2_override_union", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def u2(spark, sf):
    a = T(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return J.merge_keyed(a, T(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


@query("u3_overlap", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_b")
def u3(spark, sf):
    return J.id_overlap(T(spark, sf, "documents"), T(spark, sf, "labels"), "doc_id")
