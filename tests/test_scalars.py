import pytest
from pyspark.sql import functions as F

from manifoldry.functions import scalars as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    "full, frag, want",
    [
        ("ABCDEFGH", "CDE", (3, 5)),
        ("ABCDEFGH", "MCDE", (3, 5)),
        ("ABCDEFGHIJKL", "CDEFGHIJKX", (3, 12)),
        ("ABCDEFGH", "XYZXYZ", None),
        ("AB-CD", "bc", (2, 3)),
        ("AB", "ABCD", None),
    ],
)
def test_locate(spark, full, frag, want):
    got = one(spark, S.locate_fragment(F.col("a"), F.col("b")), a=full, b=frag)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text, want", [("89-132", "89-132"), ("1-2, 5-9", "1-2,5-9"), ("x,3-4,7", "3-4"), ("", "")])
def test_ranges(spark, text, want):
    assert one(spark, S.format_ranges(S.parse_ranges(F.col("a"))), a=text) == want


def test_keys_and_classes(spark):
    key = S.make_key(F.lit("a"), F.lit(None).cast("string"), F.lit("x"), F.lit(3))
    assert one(spark, key) == "a|unknown|x|3"
    assert one(spark, S.parse_class(F.lit("d1 c.2.1.5 (A:)"))) == "alpha/beta"
    assert one(spark, S.parse_class(F.lit("none"))) == "unknown"
    assert one(spark, S.taxonomy(F.lit("control|x"))) == "random"


def test_composition_and_kmers(spark):
    assert one(spark, S.composition_ok(F.lit("ACDE"))) is True
    assert one(spark, S.composition_ok(F.lit("AAAC"))) is False
    assert one(spark, S.composition_ok(F.lit("ABC"))) is False
    assert one(spark, S.kmers(F.lit("ABCD"), 3)) == ["ABC", "BCD"]
    assert one(spark, S.kmers(F.lit("AB"), 3)) == []


def test_interleave(spark):
    assert one(spark, S.interleave(F.lit("ab"), F.lit("CDE"))) == "AcBd"
    assert one(spark, S.pair_tokens(F.lit("AcBd"))) == "Ac Bd"


def test_labels(spark):
    assert [one(spark, S.significance(F.lit(p))) for p in (0.0001, 0.005, 0.02, 0.2)] == ["***", "**", "*", "ns"]
    assert one(spark, S.pct_change(F.lit(3.0), F.lit(0.0))) == 0
    assert one(spark, S.finite(F.lit(float("nan")))) is False
