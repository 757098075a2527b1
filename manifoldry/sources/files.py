"""Readers and writers of the text and table formats. Paths are anything that Spark's readers open."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifoldry.sources.store import settled

# What readers run in tasks travels by value, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, description, sequence): a record for each header; the id is the header's first token, body lines are joined."""
    raw = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    record = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_extract(record, r"^([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), head.alias("description"), body.alias("sequence"))


def write_fasta(df: DataFrame, path: str, width: int | None = 80) -> None:
    """Header line, then the sequence wrapped at `width`, or on one line."""
    body = F.col("sequence") if width is None else F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), body).alias("value")).write.text(path)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, sep=sep, nullValue="NA")


def read_delimited(spark: SparkSession, path: str, columns: dict[str, int], sep: str = ";", comment: str = "#", min_fields: int = 2) -> DataFrame:
    """Fields by position from lines with enough of them; comments and blank lines are skipped, fields trimmed."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith(comment))
    parts = lines.select(F.split("value", F.lit("\\Q" + sep + "\\E")).alias("f")).where(F.size("f") >= min_fields)
    return parts.select(*[F.trim(F.get("f", F.lit(i))).alias(n) for n, i in columns.items()])


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(accession, start, end) of a tab-separated file with a header; rows with a bad or missing field are dropped."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="accession string, a string, b string", mode="PERMISSIVE", enforceSchema=True)
    return rows.select("accession", F.expr("try_cast(a AS int)").alias("start"), F.expr("try_cast(b AS int)").alias("end")).where("accession is not null and start is not null and end is not null")


REGION_SET = "dataset string, total_sequences int, sequences array<struct<id:string,sequence:string,length:int,regions:array<struct<type:string,start:int,end:int>>>>"


def read_regions(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """(id, type, start, end); where files share an id, the last file's regions stay. With `lines`, a set a line, not a file."""
    rows = None
    for rank, path in enumerate(paths):
        one = spark.read.json(path, schema=REGION_SET, multiLine=not lines).select(F.explode("sequences").alias("s"), F.lit(rank).alias("_rank")).select("s.id", "s.regions", "_rank")
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("id").agg(F.max_by("regions", "_rank").alias("regions"))
    return last.select("id", F.inline("regions"))


def write_regions(df: DataFrame, path: str, dataset: str) -> None:
    """(id, sequence, type, start, end) as JSON lines: each a set of one sequence with its length and regions, and how many sequences there are in all."""
    region = F.struct("type", "start", "end")
    nested = df.groupBy("id").agg(F.first("sequence").alias("sequence"), F.sort_array(F.collect_list(region)).alias("regions"))
    one = F.struct("id", "sequence", F.length("sequence").alias("length"), "regions")
    total = df.agg(F.count_distinct("id").cast("int").alias("total_sequences"))
    nested.crossJoin(F.broadcast(total)).select(F.lit(dataset).alias("dataset"), "total_sequences", F.array(one).alias("sequences")).write.json(path)


#: A row of three cells; header cells make no row.
_CELLS = r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>\s*</tr>"


def extract_rows(df: DataFrame, key: str, text: str, pattern: str = _CELLS, groups: int = 3) -> DataFrame:
    """(key, position, c1, c2, ...): every match of a pattern in marked-up text, with its groups."""
    cells = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"c{g}") for g in range(1, groups + 1)])
    return df.select(key, F.posexplode(cells).alias("position", "_c")).select(key, "position", *[F.col(f"_c.c{g}").alias(f"c{g}") for g in range(1, groups + 1)])


def first_rows(rows: DataFrame, name: str, least: int = 5) -> DataFrame:
    """The first row of each name of `least` characters or more that starts with 4 letters or digits; header cells are no rows."""
    good = rows.where((F.length(name) >= least) & F.col(name).rlike("^[A-Za-z0-9]{4}"))
    rest = [c for c in rows.columns if c != name]
    return good.groupBy(name).agg(F.min(F.struct(*rest)).alias("_f")).select(*[F.col(c if c == name else f"_f.{c}").alias(c) for c in rows.columns])


def _numbered(batches):
    """Kept lines with their number in the block and the model that the block has begun before, and a row of what each block ends with."""
    names = ["file", "at", "line", "model", "value"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    here, line, model = None, 0, None
    for batch in batches:
        rows = []
        for file, at, value in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "value")), strict=True):
            if (file, at) != here:
                if here is not None:
                    rows.append((*here, line, model, None))
                here, line, model = (file, at), 0, None
            head = value.lstrip()
            if head.startswith("MODEL"):
                word = head[5:].split()
                model = int(word[0]) if head[5:6].isspace() and word and word[0].isdigit() else model
            elif value.startswith(("ATOM", "HETATM")):
                rows.append((file, at, line, model, value))
            line += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
    if here is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*here, line, model, None), kinds, strict=True)], names)


def read_atoms(spark: SparkSession, path: str, hetero: bool = False) -> DataFrame:
    """(file, place, model, chain, resseq, resname, atom, x, y, z) from fixed-width lines of all files; place is the line's number.

    Files of any size: Spark cuts them into splits, each of which finds the MODEL lines in it. A running fold over the
    splits' summaries, a row for each, tells a split how many lines come before it and which model it begins in. Lines
    before any MODEL line are of model 1.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    found = settled(lines.mapInArrow(_numbered, "file string, at long, line long, model int, value string"), "atom-lines")
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("value is null").select("file", "at", F.coalesce(F.sum("line").over(order), F.lit(0)).alias("_lines"), F.last("model", ignorenulls=True).over(order).alias("_model"))
    kept = found.where(F.col("value").startswith("ATOM") | (F.lit(hetero) & F.col("value").startswith("HETATM"))).join(ends, ["file", "at"])
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    return kept.select("file", (F.col("_lines") + F.col("line")).alias("place"), F.coalesce("model", "_model", F.lit(1)).alias("model"), F.substring("value", 22, 1).alias("chain"), cut(23, 4).cast("int").alias("resseq"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom"), *[cut(a, 8).cast("double").alias(n) for a, n in ((31, "x"), (39, "y"), (47, "z"))])


def ca_points(atoms: DataFrame) -> DataFrame:
    """One point a residue: the first CA of each (file, model, chain, resseq)."""
    key = ["file", "model", "chain", "resseq"]
    rest = [c for c in atoms.columns if c not in (*key, "place")]
    first = atoms.where("atom = 'CA'").groupBy(*key).agg(F.min(F.struct("place", *rest)).alias("_f"))
    return first.select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def with_files(df: DataFrame, listing: DataFrame, key, name: str) -> DataFrame:
    """Rows whose key, whatever its case, is in a listing."""
    keys = listing.select(F.lower(F.col(name)).alias("_f")).distinct()
    return df.withColumn("_f", F.lower(key)).join(keys, "_f", "left_semi").drop("_f")


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names without their suffix of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    return files.select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit(suffix), F.lit("")).alias("name"))


def generate_control(spark: SparkSession, n: int, alphabet: str, weights: list[float], mean: float = 166, sd: float = 69, low: int = 40, high: int = 300, seed: int = 42) -> DataFrame:
    """n rows of random letters: length int(gauss(mean, sd)) within low..high, letters by weight."""
    total, bounds = 0.0, []
    for w in weights:
        total += w / sum(weights)
        bounds.append(total)
    rows = spark.range(n).withColumn("length", F.greatest(F.lit(low), F.least(F.lit(high), (F.randn(seed) * sd + mean).cast("int"))))
    u = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1_000_000)) / 1e6
    steps = F.array(*[F.lit(b) for b in bounds[:-1]])
    letter = lambda i: F.substring(F.lit(alphabet), F.size(F.filter(steps, lambda b: b <= u(i))) + 1, F.lit(1))
    seq = F.array_join(F.transform(F.sequence(F.lit(1), "length"), letter), "")
    key = F.concat_ws("|", F.lit("control"), F.lit("random"), F.concat(F.lit("random_"), F.format_string("%04d", F.col("id") + 1)), F.col("length").cast("string"))
    return rows.select(key.alias("seq_id"), seq.alias("sequence"), "length")
