"""What several operators share: white space, intermediate tables and gapless numbering."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from manifoldry.sources.store import own_folder

#: White space that separates words, as a regular expression class.
SPACES = r"[\x20\x09-\x0D]"
#: Anything but white space.
NOT_SPACES = r"[^\x20\x09-\x0D]"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` into the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """`df` written as a table in `n` buckets by `key`, so that grouping by `key` later needs no shuffle of it.

    The catalogue forgets the table at once; what reads its files knows their buckets already.
    """
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", new_path(df.sparkSession, label)).option("compression", "zstd").saveAsTable(name)
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    return table


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `df` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, even if a lambda inside `body` uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def buckets(spark: SparkSession) -> int:
    """Sub-buckets for each key of a gapless numbering; follows the shuffle partitions and so the data."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gapless(df: DataFrame, key: str, spread: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of each `key` from 0 without gaps, in no fixed order between sub-buckets.

    A key can hold any share of the rows: rows of a key are dealt to sub-buckets by `spread`, each sub-bucket is
    numbered by itself, and the sub-buckets' counts, a row for each, give the offsets.
    """
    n = buckets(df.sparkSession)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    # The join asks only for (key, bucket), which the window below asks for too: one shuffle of the rows.
    counts = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    out = numbered.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")), "left")
    return out.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_key", "_b", "_before", "_at", "_bucket")


_shipped: set[str] = set()


def ship() -> None:
    """The package as an archive that Spark's file server hands to every worker, once an application."""
    import manifoldry

    context = SparkContext.getOrCreate()
    if context.applicationId in _shipped:
        return
    top = Path(manifoldry.__path__[0])
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "manifoldry.zip"  # read by the driver's file server alone
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def task(module: str, name: str, *args, two: bool = False):
    """A function for mapInArrow or applyInArrow that calls `module.name(batches, *args)`, with two tables for a cogroup.

    Spark gives the package to the workers, which need not have it where the driver does.
    """
    ship()

    def call(*given):
        import importlib

        import pyarrow as pa

        made = getattr(importlib.import_module(module), name)(*given, *args)
        if isinstance(made, pa.Table):
            return made
        return released(made)

    def released(batches):
        # Workers live on after a task: what Arrow keeps for later would add to the next one's needs.
        import pyarrow as pa

        yield from batches
        pa.default_memory_pool().release_unused()

    def run(batches):
        return call(batches)

    def run_two(left, right):
        return call(left, right)

    return run_two if two else run
