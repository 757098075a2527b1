"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sequences over A-Z."""
    return T(spark, sf, "documents").select("doc_id", "lang", "source", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


#: The same in SQL.
SEQ = "(SELECT doc_id, lang, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"


def r(c, places: int = 6):
    """Rounded, so that sums in another order compare equal; never a negative zero."""
    return F.round(c, places) + 0.0


def signed(c, places: int = 6):
    """Rounded; what rounds to zero keeps its sign, as in SQL."""
    return F.round(F.abs(c), places) * F.signum(c)


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as points in the plane: value and hours of the day."""
    e = T(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("value") / 10).alias("x"), ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")) / 3600.0).alias("y"), F.col("event_type").alias("label"))


POINTS = "(SELECT event_id AS id, value / 10 AS x, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0 AS y, event_type AS label FROM events)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


VECTORS = "(SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
