"""Sequence chemistry as set jobs: letter counts joined to small published scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.functions.scalars import LETTERS

#: Hydropathy of Kyte and Doolittle (1982).
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
#: Acid constants and the sign of the charge, of side chains and of the two ends (EMBOSS).
PKA = {"D": (3.9, -1), "E": (4.1, -1), "C": (8.5, -1), "Y": (10.1, -1), "H": (6.5, 1), "K": (10.8, 1), "R": (12.5, 1)}
ENDS = ((8.6, 1), (3.6, -1))
#: Residue names and letters.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def _counts(seq: str) -> dict[str, F.Column]:
    return {x: F.length(seq) - F.length(F.replace(F.col(seq), F.lit(x), F.lit(""))) for x in LETTERS}


def physchem(df: DataFrame, seq: str) -> DataFrame:
    """gravy, the mean hydropathy, and aromaticity, the share of F, W and Y; null without letters of the alphabet."""
    n = _counts(seq)
    total = sum(n.values(), F.lit(0))
    gravy = sum((n[x] * HYDROPATHY[x] for x in LETTERS), F.lit(0.0)) / total
    return df.withColumn("gravy", F.when(total > 0, gravy)).withColumn("aromaticity", F.when(total > 0, (n["F"] + n["W"] + n["Y"]) / total))


def charge(seq: str, ph: F.Column) -> F.Column:
    n = _counts(seq)
    parts = [(F.lit(1), *e) for e in ENDS] + [(n[x], *PKA[x]) for x in PKA]
    return sum((c * sign / (1 + F.pow(F.lit(10.0), (ph - k) * sign)) for c, k, sign in parts), F.lit(0.0))


def isoelectric_point(df: DataFrame, seq: str, step: float = 0.1) -> DataFrame:
    """The pH on a grid from 0 to 14 with the least net charge, the lower of two."""
    counts = df.withColumn("_n", F.array(*[_counts(seq)[x] for x in PKA]))
    parts = [(F.lit(1), *e) for e in ENDS] + [(F.get("_n", F.lit(i)), *PKA[x]) for i, x in enumerate(PKA)]

    def net(i):
        ph = i * step
        return F.abs(sum((c * sign / (1 + F.pow(F.lit(10.0), (ph - k) * sign)) for c, k, sign in parts), F.lit(0.0)))

    grid = F.transform(F.sequence(F.lit(0), F.lit(round(14 / step))), lambda i: F.struct(F.round(net(i), 9).alias("c"), i.alias("i")))
    return counts.withColumn("pi", F.round(F.array_min(grid)["i"] * step, 6)).drop("_n")


def atoms_to_sequence(atoms: DataFrame, key: list[str]) -> DataFrame:
    """Letters of residues in order (key, resseq, resname); names that are not standard are left out."""
    names = F.create_map(*[F.lit(x) for item in RESIDUES.items() for x in item])
    letters = atoms.select(*key, "resseq", F.element_at(names, F.col("resname")).alias("letter")).where("letter is not null")
    joined = letters.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("resseq", "letter"))).alias("_r"))
    return joined.select(*key, F.array_join(F.transform("_r", lambda x: x["letter"]), "").alias("sequence"))
