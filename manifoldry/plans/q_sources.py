"""Queries of sources and sinks (S1 to S6, S8, S10): given tables are written in a format, read back and compared."""

import uuid

from pyspark.sql import functions as F

from manifoldry.plans.common import SEQ, T, r, sequences
from manifoldry.plans.registry import query
from manifoldry.sources import files as S
from manifoldry.sources.store import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_fasta", f"SELECT 'doc|' || doc_id AS seq_id, 'doc|' || doc_id || ' ' || lang AS description, length(seq) AS length, md5(seq) AS digest FROM {SEQ} WHERE seq <> ''")
def s1(spark, sf):
    """Written wrapped at 60 letters, with a description."""
    path = _folder(spark, "fasta")
    rows = sequences(spark, sf).where("seq <> ''")
    S.write_fasta(rows.select(F.concat_ws(" ", F.concat(F.lit("doc|"), F.col("doc_id").cast("string")), "lang").alias("seq_id"), F.col("seq").alias("sequence")), path, 60)
    back = S.read_fasta(spark, path)
    return back.select("seq_id", "description", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


@query("s2_fasta_lines", f"SELECT sum(1 + (length(seq) + 79) // 80)::BIGINT AS lines, sum(length(seq))::BIGINT AS letters FROM {SEQ} WHERE seq <> ''")
def s2(spark, sf):
    """Lines of a FASTA file wrapped at 80 letters: a header and the body of each."""
    path = _folder(spark, "fasta")
    S.write_fasta(sequences(spark, sf).where("seq <> ''").select(F.col("doc_id").cast("string").alias("seq_id"), F.col("seq").alias("sequence")), path)
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("lines"), F.sum(F.when(~F.col("value").startswith(">"), F.length("value")).otherwise(0)).alias("letters"))


@query("s3_csv", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def s3(spark, sf):
    """A missing value is written as nothing and read as null."""
    path = _folder(spark, "csv")
    c = T(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    S.write_result(c, path, "csv")
    return S.read_table(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("s4_delimited", "SELECT 's' || s_suppkey AS pdb, 'A' || s_nationkey AS chain FROM supplier WHERE s_suppkey % 4 > 1")
def s4(spark, sf):
    """A quarter of the lines are comments, another has too few fields."""
    path = _folder(spark, "delimited")
    s = T(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"), (F.col("s_suppkey") % 4).alias("m"))
    line = F.when(F.col("m") == 0, F.concat(F.lit("# s"), "k")).when(F.col("m") == 1, F.concat(F.lit("s"), "k")).otherwise(F.concat(F.lit("s"), "k", F.lit(" ; A"), "n", F.lit(";x")))
    s.select(line.alias("value")).write.text(path)
    return S.read_delimited(spark, path, {"pdb": 0, "chain": 1}, min_fields=3)


@query("s5_intervals", "SELECT 'P' || l_orderkey AS accession, l_linenumber::INT AS start, (l_linenumber + l_quantity)::INT AS \"end\" FROM lineitem WHERE l_linenumber % 3 > 0")
def s5(spark, sf):
    """Every third line has a bad end."""
    path = _folder(spark, "intervals")
    n = F.col("l_linenumber").cast("int")
    end = F.when(n % 3 > 0, (n + F.col("l_quantity").cast("int")).cast("string")).otherwise("?")
    rows = T(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("acc"), n.alias("start"), end.alias("end"))
    rows.write.csv(path, sep="\t", header=True)
    return S.read_intervals(spark, path)


@query("s6_regions", """
WITH d AS (SELECT l_orderkey AS id, l_returnflag AS type, l_linenumber::INT AS start, (l_linenumber + l_quantity)::INT AS e FROM lineitem)
SELECT 'o' || id AS id, type, start, CASE WHEN id % 2 = 0 THEN e + 1000 ELSE e END AS "end" FROM d""")
def s6(spark, sf):
    """Two region sets; the later one has the even orders again, with other ends, and wins."""
    first, second = _folder(spark, "regions"), _folder(spark, "regions")
    n = F.col("l_linenumber").cast("int")
    d = T(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("A").alias("sequence"), F.col("l_returnflag").alias("type"), n.alias("start"), (n + F.col("l_quantity").cast("int")).alias("end"))
    S.write_regions(d.drop("l_orderkey"), first, "all")
    S.write_regions(d.where("l_orderkey % 2 = 0").withColumn("end", F.col("end") + 1000).drop("l_orderkey"), second, "even")
    return S.read_regions(spark, first, second, lines=True)


@query("s8_atoms", "SELECT (event_id // 500)::INT AS model, 'A' AS chain, ((event_id % 500) // 2 + 1)::INT AS resseq, 'GLY' AS resname, round(arg_min(round(value, 3), event_id), 3) AS x FROM events GROUP BY ALL")
def s8(spark, sf):
    """Fixed-width lines of a model for every 500 events, two atoms a residue, of which the first stays."""
    path = _folder(spark, "atoms")
    at = F.col("event_id")
    line = F.format_string("%-6s%5d  CA  GLY A%4d    %8.3f%8.3f%8.3f", F.lit("ATOM"), (at % 500).cast("int"), F.floor(at % 500 / 2).cast("int") + 1, F.round("value", 3), F.lit(0.0), F.lit(0.0))
    models = T(spark, sf, "events").select(F.floor(at / 500).cast("int").alias("model"), F.struct("event_id", line.alias("line")).alias("l"))
    models = models.groupBy("model").agg(F.array_sort(F.collect_list("l")).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    models.select(F.concat(F.format_string("MODEL     %4d\n", "model"), body, F.lit("\nENDMDL")).alias("value")).write.text(path)
    return S.ca_points(S.read_atoms(spark, path)).select("model", "chain", "resseq", "resname", r(F.col("x"), 3).alias("x"))


@query("s10_sinks", "SELECT format, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier, (SELECT unnest(['csv', 'json', 'parquet']) AS format) GROUP BY format")
def s10(spark, sf):
    """The same table through each sink."""
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = _folder(spark, fmt)
        S.write_result(T(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), path, fmt)
        back = spark.read.schema("s_suppkey long, s_acctbal double").options(header=True).format(fmt).load(path)
        one = back.agg(F.lit(fmt).alias("format"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s7_table_rows", """
WITH h AS (SELECT s_nationkey AS k, '<tr><th>Name</th><th>Code</th><th>Note</th></tr>' || string_agg('<tr><td>' || s_name || '</td><td>' || s_suppkey || '</td><td>' || s_nationkey || '</td></tr>', '' ORDER BY s_suppkey) AS html FROM supplier GROUP BY s_nationkey),
x AS (SELECT k, s_suppkey, row_number() OVER (PARTITION BY k ORDER BY s_suppkey) AS position, substr(s_name, 1, 14) AS name FROM (SELECT s_nationkey AS k, s_suppkey, s_name FROM supplier))
SELECT name, arg_min(s_suppkey::VARCHAR, (k, position)) AS code FROM x GROUP BY name""")
def s7_rows(spark, sf):
    """Tables of three cells made of suppliers, with a header each; the first row of each key stays."""
    s = T(spark, sf, "supplier")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.substring("s_name", 1, 14)), cell(F.col("s_suppkey").cast("string")), cell(F.col("s_nationkey").cast("string")), F.lit("</tr>"))
    page = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    page = page.select(F.col("s_nationkey").alias("k"), F.concat(F.lit("<tr><th>Name</th><th>Code</th><th>Note</th></tr>"), "rows").alias("html"))
    return S.first_rows(S.extract_rows(page, "k", "html"), "c1").select(F.col("c1").alias("name"), F.col("c2").alias("code"))
