"""Exact deduplication with a heavy-hitter split.

A frequent-items sketch of the Misra-Gries family finds the digests that hold a large share of the rows. Those
candidates are counted exactly; the verified winners, a bounded table, are broadcast, so that rows of huge groups are
decided where they are read. All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manifoldry.llm.common import SPACES, materialise, read, unused

#: Candidates taken from the sketch, and so the most rows that are ever broadcast.
CANDIDATES = 64
#: Items that the sketch tracks; it errs by at most about 4 / TRACKED of the rows.
TRACKED = 4096
#: A candidate is a heavy hitter if it holds at least this share of the rows.
HEAVY_SHARE = 0.001


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " ")


def decisions(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, heavy.

    Nulls: a null text is an empty text; a null doc_id loses to any other, and a group of only null ids keeps them.
    Repeated rows with one doc_id share its verdict. Empty input: empty result. Other columns are ignored.
    """
    digests = materialise(docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "digests")
    key = F.xxhash64("text_sha256")
    sketch = digests.agg(F.expr(f"approx_top_k(xxhash64(text_sha256), {CANDIDATES}, {TRACKED})").alias("top"), F.count("*").alias("n_rows"))
    candidates = sketch.select(F.explode("top").alias("c"), "n_rows").select(F.col("c.item").alias("item"), "n_rows")
    winners = (
        digests.join(F.broadcast(candidates), key == F.col("item"))
        .groupBy("text_sha256", "n_rows")
        .agg(F.min("doc_id").alias("heavy_id"), F.count("*").alias("heavy_size"))
        .where((F.col("heavy_size") >= F.col("n_rows") * HEAVY_SHARE) & (F.col("heavy_size") > 1))
        .select(F.col("text_sha256").alias("heavy_sha"), "heavy_id", "heavy_size")
    )
    winners = materialise(winners.coalesce(1), "heavy")
    marked = digests.join(F.broadcast(winners), F.col("text_sha256") == F.col("heavy_sha"), "left")
    heavy = marked.where("heavy_sha is not null").select("doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), "text_sha256", F.lit(True).alias("heavy"))
    rest = marked.where("heavy_sha is null").select("doc_id", "text_sha256")
    # Written, so that the join below has a shuffle of its own, which Spark can split where a digest is frequent.
    groups = materialise(rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    light = rest.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256", F.lit(False).alias("heavy"))
    return heavy.unionByName(light).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without later copies, columns unchanged. Rows that repeat a kept doc_id with the same text all stay."""
    id_, sha = unused(docs, "_gone", "_sha")
    gone = decisions(docs).where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.sha2(normalised(F.col("text")), 256) == F.col(sha))
    return docs.join(gone, same, "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    return decisions(read(spark, sf_dir, "documents")).drop("heavy")


SQL = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents))
"""
