"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; each node weighs as much as the shards below it. A row descends from the
root: at each level every child draws -ln(u) / weight from a hash of the row's key and the child's name, and the least
draw wins. A draw depends on nothing but key, child and weight, so a changed weight moves rows only into or out of the
subtree whose weight changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manifoldry.llm.common import gapless, let, read

RACKS, SHARDS = 2, 4


def tree(shards: int, racks: int = RACKS, per_rack: int = SHARDS, weights: dict[int, float] | None = None) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight). Shards fill one rack after another; a shard beyond full regions opens a
    region of its own, so that it takes rows only into itself."""
    weight = weights or {}
    leaves = [(s, float(weight.get(s, 1.0))) for s in range(shards)]
    in_racks = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [in_racks[i : i + racks] for i in range(0, len(in_racks), racks)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(weight)


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What the child with the least draw leads to. Only the chosen branch of a case is evaluated below it."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(children)])

    def branch(least: Column) -> Column:
        out = F.when(least.getField("i") == 0, children[0][2])
        for i, (_, _, below) in enumerate(children[1:], 1):
            out = out.when(least.getField("i") == i, below)
        return out

    return let(F.array_min(draws), branch)


def place(key: Column, nodes: list[list[list[tuple[int, float]]]]) -> Column:
    """The shard of a row. Weights must be positive. A null key is a key of its own."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    regions = []
    rack_no = 0
    for r, region in enumerate(nodes):
        racks = []
        for rack in region:
            shards = [(f"shard-{s}", w, F.lit(s)) for s, w in rack]
            racks.append((f"rack-{rack_no}", sum(w for _, w in rack), _choose(key, shards)))
            rack_no += 1
        regions.append((f"region-{r}", sum(w for _, w, _ in racks), _choose(key, racks)))
    return _choose(key, regions).cast("int")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after one more is added, a row for each row of `docs`.

    `shards` must fill whole regions (a multiple of RACKS * SHARDS): only then does one more shard open a region of its
    own and take rows only into itself. In a region that is not full, old shards would take rows too.
    A null text has size 1 and the crc32 of an empty text. Repeated rows go to one shard, in slots of their own. Empty input: empty result.
    """
    if shards < 1 or shards % (RACKS * SHARDS):
        raise ValueError(f"law key needs a multiple of {RACKS * SHARDS} shards, got {shards}")
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), tree(shards)).alias("shard"),
        place(F.col("doc_id"), tree(shards + 1)).alias("grown_shard"),
    )
    return gapless(placed, "shard", F.struct("doc_id", "text_crc32"), ["doc_id", "text_crc32"], "slot")


def op10(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
