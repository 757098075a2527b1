"""Queries P1 to P20."""

from pyspark.sql import functions as F

from manifoldry.functions import scalars as S
from manifoldry.plans.common import SEQ, T, r, sequences
from manifoldry.plans.registry import query


@query("p1_keys", "SELECT doc_id, concat_ws('|', lang, source, doc_id::VARCHAR, n_chars::VARCHAR) AS key, lang AS category, source AS subcategory, doc_id::VARCHAR AS id FROM documents")
def p1(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", S.make_key(F.col("lang"), F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("key"))
    k = S.split_key(F.col("key"))
    return d.select("doc_id", "key", k["category"].alias("category"), k["subcategory"].alias("subcategory"), k["id"].alias("id"))


@query("p2_class", """
SELECT p_partkey, CASE x WHEN 'a' THEN 'all-alpha' WHEN 'b' THEN 'all-beta' WHEN 'c' THEN 'alpha/beta' WHEN 'd' THEN 'alpha+beta' WHEN 'e' THEN 'multi-domain' WHEN 'f' THEN 'membrane' WHEN 'g' THEN 'small' ELSE 'unknown' END AS class
FROM (SELECT p_partkey, regexp_extract('d1ux ' || substr(p_name, 1, 1) || '.1.' || p_size || '.2 (A:)', '([a-g])\\.\\d+\\.\\d+\\.\\d+', 1) AS x FROM part)""".replace("\\\\", "\\"))
def p2(spark, sf):
    d = F.concat(F.lit("d1ux "), F.substring("p_name", 1, 1), F.lit(".1."), F.col("p_size").cast("string"), F.lit(".2 (A:)"))
    return T(spark, sf, "part").select("p_partkey", S.parse_class(d).alias("class"))


_KEY = "CASE o_custkey % 5 WHEN 0 THEN 'anchor' WHEN 1 THEN 'astral95' WHEN 2 THEN 'control' WHEN 3 THEN 'idp' ELSE 'other' END || '|x|' || printf('%05d', o_custkey) || 'A|9'"


def _keys(spark, sf):
    m = F.col("o_custkey") % 5
    head = F.when(m == 0, "anchor").when(m == 1, "astral95").when(m == 2, "control").when(m == 3, "idp").otherwise("other")
    return T(spark, sf, "orders").select("o_orderkey", F.concat(head, F.lit("|x|"), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit("A|9")).alias("key"))


@query("p3_taxonomy", f"""
SELECT o_orderkey, CASE split_part(key, '|', 1) WHEN 'anchor' THEN 'anchor' WHEN 'astral95' THEN 'astral95' WHEN 'control' THEN 'random' WHEN 'idp' THEN 'idp' ELSE 'unknown' END AS category
FROM (SELECT o_orderkey, {_KEY} AS key FROM orders)""")
def p3(spark, sf):
    return _keys(spark, sf).select("o_orderkey", S.taxonomy(F.col("key")).alias("category"))


_SUBS = "['anchor', 'random', 'idp', 'knotted', 'fold_switching', 'other', NULL]"
_CATS = "['extreme', 'anchor', 'control', 'extreme', NULL]"


@query("p3_taxonomy_pairs", f"""
SELECT o_orderkey, CASE WHEN s IN ('anchor', 'astral95', 'integrable', 'random', 'idp', 'knotted', 'fold_switching') THEN s ELSE 'unknown' END AS by_sub,
  CASE WHEN c = 'extreme' THEN CASE WHEN s IN ('fold_switching', 'idp') THEN s ELSE 'knotted' END WHEN c = 'anchor' THEN c WHEN c = 'control' THEN 'random' ELSE 'unknown' END AS by_pair
FROM (SELECT o_orderkey, {_SUBS}[o_custkey % 7 + 1] AS s, {_CATS}[o_orderkey % 5 + 1] AS c FROM orders)""")
def p3_pairs(spark, sf):
    o = T(spark, sf, "orders")
    subs = F.array(*[F.lit(x) for x in ("anchor", "random", "idp", "knotted", "fold_switching", "other", None)])
    cats = F.array(*[F.lit(x) for x in ("extreme", "anchor", "control", "extreme", None)])
    d = o.select("o_orderkey", F.get(subs, (F.col("o_custkey") % 7).cast("int")).alias("s"), F.get(cats, (F.col("o_orderkey") % 5).cast("int")).alias("c"))
    return d.select("o_orderkey", S.taxonomy_of_sub(F.col("s")).alias("by_sub"), S.taxonomy_of_pair(F.col("c"), F.col("s")).alias("by_pair"))


@query("p4_source_key", f"""
SELECT o_orderkey, lower(CASE WHEN cat = 'astral95' THEN CASE WHEN length(p) >= 5 THEN substr(p, 2, 4) END ELSE substr(p, 1, 4) END) AS source_key
FROM (SELECT o_orderkey, split_part(key, '|', 1) AS cat, split_part(key, '|', 3) AS p FROM (SELECT o_orderkey, {_KEY} AS key FROM orders))""")
def p4(spark, sf):
    return _keys(spark, sf).select("o_orderkey", S.source_key(S.taxonomy(F.col("key")), F.col("key")).alias("source_key"))


_RANGES = "(l_linenumber * 3)::VARCHAR || '-' || (l_linenumber * 3 + l_quantity::INT)::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN ',bad' ELSE ', 100-120' END"


@query("p5_ranges", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN a ELSE a || ',100-120' END AS ranges
FROM (SELECT *, (l_linenumber * 3)::VARCHAR || '-' || (l_linenumber * 3 + l_quantity::INT)::VARCHAR AS a FROM lineitem)""")
def p5(spark, sf):
    n = F.col("l_linenumber")
    text = F.concat((n * 3).cast("string"), F.lit("-"), (n * 3 + F.col("l_quantity").cast("int")).cast("string"), F.when(n % 2 == 0, ",bad").otherwise(", 100-120"))
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.format_ranges(S.parse_ranges(text)).alias("ranges"))


@query("p6_region_check", """
SELECT l_returnflag, reason, count(*) AS n FROM (
  SELECT l_returnflag, CASE WHEN s > e THEN 'start_after_end' WHEN s < 1 OR e > 40 THEN 'out_of_bounds' ELSE 'ok' END AS reason
  FROM (SELECT l_returnflag, l_linenumber * 5 - 5 AS s, l_quantity::INT AS e FROM lineitem)) GROUP BY ALL""")
def p6(spark, sf):
    d = T(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linenumber") * 5 - 5).alias("s"), F.col("l_quantity").cast("int").alias("e"))
    return d.groupBy("l_returnflag", F.coalesce(S.region_fault(F.col("s"), F.col("e"), F.lit(40)), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("p6_valid_records", """
SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_linenumber * 5 - 4 AS s, l_linenumber * 5 + l_quantity::INT AS e FROM lineitem)
GROUP BY l_orderkey HAVING bool_and(s <= e AND s >= 1 AND e <= 75)""")
def p6_records(spark, sf):
    """Any bad region drops its record."""
    from manifoldry.operators.joins import valid_records

    d = T(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 5 - 4).alias("s"), (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("int")).alias("e"))
    return valid_records(d, "l_orderkey", S.region_fault(F.col("s"), F.col("e"), F.lit(75))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("p7_clean", f"SELECT doc_id, md5(translate(seq, 'UBZX', 'CNQ')) AS cleaned, md5(replace(seq, 'X', '')) AS letters FROM {SEQ}")
def p7(spark, sf):
    s = F.col("seq")
    return sequences(spark, sf).select("doc_id", F.md5(S.clean_sequence(s)).alias("cleaned"), F.md5(S.letters_only(s)).alias("letters"))


@query("p8_length", f"SELECT doc_id, length(seq) AS length FROM {SEQ} WHERE length(seq) BETWEEN 40 AND 500")
def p8(spark, sf):
    return sequences(spark, sf).select("doc_id", F.length("seq").alias("length")).where(F.col("length").between(40, 500))


@query("p9_composition_ok", f"""
WITH s AS (SELECT doc_id, translate(seq, 'BJOUXZ', '') AS seq FROM {SEQ}),
c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(seq, '')) AS x FROM s) GROUP BY ALL),
m AS (SELECT doc_id, max(n) AS top, sum(n) AS total FROM c WHERE x <> '' GROUP BY doc_id)
SELECT s.doc_id, coalesce(length(seq) > 0 AND top <= 0.12 * total, false) AS ok FROM s LEFT JOIN m USING (doc_id)""")
def p9(spark, sf):
    s = sequences(spark, sf).withColumn("seq", F.translate("seq", "BJOUXZ", ""))
    return s.select("doc_id", S.composition_ok(F.col("seq"), 0.12).alias("ok"))


@query("p11_interleave", """
SELECT c_custkey, array_to_string(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: upper(a[i]) || lower(b[i])), '') AS mixed,
  array_to_string(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: upper(a[i]) || lower(b[i])), ' ') AS tokens, length(a) <> length(b) AS mismatch
FROM (SELECT c_custkey, c_mktsegment AS a, c_name AS b FROM customer)""")
def p11(spark, sf):
    d = T(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), F.col("c_name").alias("b"))
    d = d.withColumn("mixed", S.interleave(F.col("a"), F.col("b")))
    return d.select("c_custkey", "mixed", S.pair_tokens(F.col("mixed")).alias("tokens"), (F.length("a") != F.length("b")).alias("mismatch"))


@query("p14_logs", "SELECT l_orderkey, l_linenumber, l_partkey, round(log10(l_discount + 1e-60), 6) AS log_density, round(log10(l_quantity + 1), 6) AS log_cond FROM lineitem")
def p14(spark, sf):
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(S.log_density(F.col("l_discount"))).alias("log_density"), r(F.log10(F.col("l_quantity") + 1)).alias("log_cond"))


@query("p15_labels", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE 'ns' END AS label FROM lineitem")
def p15(spark, sf):
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.significance(F.col("l_tax")).alias("label"))


@query("p16_pct_change", "SELECT c_custkey, round(CASE WHEN abs(c_acctbal) <= 1e-6 THEN 0 ELSE (1000 - c_acctbal) / abs(c_acctbal) * 100 END, 6) AS change FROM customer")
def p16(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", r(S.pct_change(F.lit(1000.0), F.col("c_acctbal"))).alias("change"))


@query("p17_kmers", f"""
WITH k AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5))) AS kmer FROM {SEQ} WHERE doc_id % 1 = 0),
c AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL)
SELECT doc_id, count(*) AS n_kmers, max(n) AS top, round(sum((n / t) * (n / t)), 8) AS concentration
FROM (SELECT *, (sum(n) OVER (PARTITION BY doc_id))::DOUBLE AS t FROM c) GROUP BY doc_id""".replace(" WHERE doc_id % 1 = 0", ""))
def p17(spark, sf):
    from manifoldry.operators.joins import kmer_profile

    return kmer_profile(sequences(spark, sf), "doc_id", "seq").groupBy("doc_id").agg(F.count("*").alias("n_kmers"), F.max("n").alias("top"), F.round(F.sum(F.col("share") * F.col("share")), 8).alias("concentration"))


@query("p18_locate", """
SELECT p_partkey, CASE WHEN strpos(f, g) > 0 THEN strpos(f, g) WHEN strpos(f, substr(g, 2)) > 0 AND g LIKE 'M%' THEN strpos(f, substr(g, 2)) END AS start
FROM (SELECT p_partkey, upper(replace(p_type || '-' || p_name, '-', '')) AS f, CASE WHEN p_size % 2 = 0 THEN 'M' ELSE '' END || upper(substr(p_name, 3, 40)) AS g FROM part)""")
def p18(spark, sf):
    d = T(spark, sf, "part").select("p_partkey", F.concat_ws("-", "p_type", "p_name").alias("f"), F.concat(F.when(F.col("p_size") % 2 == 0, "M").otherwise(""), F.substring("p_name", 3, 40)).alias("g"))
    return d.select("p_partkey", S.locate_fragment(F.col("f"), F.col("g"))["start"].cast("long").alias("start"))


@query("p19_masks", "SELECT l_returnflag, count(*) FILTER (isfinite(x)) AS n, round(avg(x) FILTER (isfinite(x)), 6) AS mean FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'nan'::DOUBLE WHEN l_linenumber = 3 THEN 'inf'::DOUBLE ELSE l_quantity END AS x FROM lineitem) GROUP BY ALL")
def p19(spark, sf):
    n = F.col("l_linenumber")
    x = F.when(n == 1, None).when(n == 2, float("nan")).when(n == 3, float("inf")).otherwise(F.col("l_quantity"))
    d = T(spark, sf, "lineitem").select("l_returnflag", x.alias("x"))
    return d.where(S.finite(F.col("x"))).groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("x")).alias("mean"))


@query("p20_clip", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, lo), hi), 4) AS clipped FROM lineitem, q""")
def p20(spark, sf):
    from manifoldry.operators.summary import clip_percentile

    d = clip_percentile(T(spark, sf, "lineitem"), "l_extendedprice", 0.01, 0.99, "clipped")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round("clipped", 4).alias("clipped"))
