"""Near-duplicate documents by an LSH forest of min-hash signatures.

A document is the set of its 5-word shingles. Each tree of the forest orders the documents by another sequence of
min-hash values; documents with a common prefix of DEPTH values are a region, and neighbours if it is small. Where it is
larger than a region may be, its documents are sorted by their further values, and those next to each other, which have
the longest common prefixes, are neighbours: how deep a prefix counts adapts to what is there. Neighbours are candidates;
every link is confirmed on full sets, and linked documents are grouped.

Neighbours in a sorted order are not all that is similar. Documents of regions that were too large are therefore joined
once more, exactly, for links between groups not yet linked (`_across`). What remains to chance is whether two documents
share a prefix of DEPTH values in one of the trees.

Documents with equal sets are one node from the start, so exact copies cost nothing later on.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.common import materialise, read, task, unused
from manifoldry.operators.components import components
from manifoldry.operators.order import running_total

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
VALUES = 128
TREES = 12
#: Values of a region's common prefix, and of the order within a region that is too large.
DEPTH, SORTED = 3, 32
#: The most that a region may weigh. A document weighs 1, or more if it has over SHINGLES shingles.
REGION, SHINGLES = 1024, 4096
#: Documents that hold one rare shingle, and members of a group, that meet as pairs.
FEW = 32
#: Regions of at most so many documents are compared in place, larger ones with their full sets.
SMALL = 32
#: Candidates in such small regions whose values agree so seldom that a link's would with less than this chance are none.
CHANCE = 1e-12

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, VALUES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Words of more bytes are hashed one by one.
LONG = 64
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES | np.uint8(0x20), _BYTES)
_IN_WORD = (_BYTES != 0x20) & ((_BYTES < 0x09) | (_BYTES > 0x0D))
#: The first n bytes of a piece.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, of all texts, one after another, and where each text's words start and the last stop.

    Words are read as pieces of 8 bytes, all words at once; the few long ones are hashed one by one.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.array([], np.uint64), np.zeros(len(texts) + 1, np.int64)
    padded = np.zeros(size + 8, np.uint8)
    padded[:size] = _LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    within = _IN_WORD[padded[:size]]
    first = np.concatenate([[True], ~within[:-1]])  # what follows white space, or starts a text
    first[bounds[bounds < size]] = True
    last = np.concatenate([first[1:] | ~within[1:], [True]])
    start = np.flatnonzero(within & first)
    length = np.flatnonzero(within & last) + 1 - start
    pieces = np.ndarray(size + 1, "<u8", padded, strides=(1,))
    rest = length.clip(max=8)
    out = mix(length.astype(np.uint64) * _K[0] + (pieces[start] & _FIRST[rest]))
    more = np.flatnonzero((length > 8) & (length <= LONG))
    at = 8
    while len(more):
        rest = (length[more] - at).clip(max=8)
        out[more] = mix(out[more] * _K[1] + (pieces[start[more] + at] & _FIRST[rest]))
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[start[i] : start[i] + length[i]].tobytes())
    return out, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each run of 5 words; for fewer words, one for the whole; none without words."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        h = np.uint64(n) * np.ones(1, np.uint64)
        for w in words:
            h = mix(h * _K[0] + w)
        return h
    total = words[: n - WORDS + 1] * _K[0]
    for i in range(1, WORDS):
        total = mix(total) * _K[i] + words[i : n - WORDS + 1 + i]
    return mix(total)


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    words, starts = word_hashes(column)
    for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        yield np.unique(shingle_hashes(words[a:b]))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        h = x[i : i + 2048, None] * _A
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least


def sign(batches):
    """doc_id, n_shingles, a digest of the set, and the signature (null for an empty set)."""
    for block in tokens.blocks(batches):
        n, digest, sigs = [], [], []
        for s in shingle_sets(block.column("text")):
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s).tobytes() if len(s) else None)
        columns = [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, VALUES)


def _values(sig: np.ndarray, tree: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The values from `lo` to `hi` of each row's order, which is that of its tree."""
    at = (tree[:, None] * 10 + np.arange(lo, hi)) % VALUES
    return np.take_along_axis(sig, at, axis=1)


def tree_keys(batches):
    """(key, node, tree): a hash of the tree and the first DEPTH values of its order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column("sig"))
        for t in range(TREES):
            tree = np.full(len(sig), t)
            key = mix(tree.astype(np.uint64) * np.uint64(1000) + np.uint64(DEPTH))
            for value in _values(sig, tree, 0, DEPTH).T:
                key = mix(key * _K[0] + value.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(n) for n in ("node", "n_shingles")), pa.array(tree.astype(np.int32))], ["key", "node", "n_shingles", "tree"])


def tree_orders(batches):
    """(key, node, n_shingles, order): the further values of each row's tree, so that bytes sort as values do."""
    for batch in batches:
        values = _values(_matrix(batch.column("sig")), batch.column("tree").to_numpy(), DEPTH, SORTED) if batch.num_rows else np.zeros((0, SORTED - DEPTH))
        order = [row.tobytes() for row in values.astype(">u2")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "node", "n_shingles")), pa.array(order, pa.binary())], ["key", "node", "n_shingles", "order"])


def least_agreement(percent: int) -> int:
    """Of VALUES low bytes, how many must agree at least: fewer do with a chance of CHANCE at most where `percent` of two sets is common."""
    p, k, tail = percent / 100, 0, 0.0
    while (tail := tail + comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k)) <= CHANCE:
        k += 1
    return k


def near_pairs(batches, least: int):
    """Pairs of nodes with one key whose signatures agree enough; rows come sorted by key, SMALL of a key at most."""
    held: pa.RecordBatch | None = None

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, node = rows.column("key").to_numpy(), rows.column("node").to_numpy()
        low = np.ascontiguousarray(_matrix(rows.column("sig")).astype(np.uint8))
        out_a, out_b = [], []
        for lag in range(1, SMALL):
            at = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(at):
                break
            good = at[(low[at] == low[at + lag]).sum(axis=1) >= least]
            out_a.append(node[good])
            out_b.append(node[good + lag])
        a, b = (np.concatenate(x) if x else np.array([], np.int64) for x in (out_a, out_b))
        keep = a != b
        a, b = a[keep], b[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        held = batch.slice(last)
        if last:
            yield pairs(batch.slice(0, last))
    if held is not None:
        yield pairs(held)


def sets_of(batches):
    for block in tokens.blocks(batches):
        sets = [s.astype("<u8").tobytes() for s in shingle_sets(block.column("text"))]
        n = pa.array([len(s) // 8 for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), n, pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "n_shingles", "shingles"])


def confirm(batches, percent: int):
    """Pairs with both sets: those that are links."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = 0
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def links_in(table: pa.Table, percent: int) -> pa.Table:
    """Links that connect all that the links of a region connect and that is not connected yet, at most one less than its nodes.

    `component` says what is connected already, `asks` which nodes to compare with all others.
    """
    node, asks = table.column("node").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
    _, group = np.unique(table.column("component").to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(m), n)
    order = np.argsort(shingle, kind="stable")
    holders, per = doc[order], np.bincount(shingle)
    begin = np.cumsum(per) - per
    first = np.cumsum(n) - n
    a, b = [], []
    for i in np.flatnonzero(asks).tolist():
        if (group == group[i]).all():
            break
        mine = shingle[first[i] : first[i] + n[i]]
        both = np.bincount(tokens.spread(holders, begin, per, mine), minlength=m)
        linked = np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (both > 0))
        for g in np.unique(group[linked[group[linked] != group[i]]]):
            a.append(node[i])
            b.append(node[linked[group[linked] == g][0]])
            group[group == g] = group[i]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def shingle_rows(batches):
    """(shingle, node, component, n_shingles) for each shingle of each set."""
    for batch in tokens.blocks(batches, 8_000_000, "shingles"):
        n = pc.divide(pc.binary_length(batch.column("shingles")), 8).to_numpy(zero_copy_only=False)
        each = pa.array(np.repeat(np.arange(batch.num_rows), n))
        shingle = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(shingle), *(batch.column(c).take(each) for c in ("node", "component", "n_shingles"))], ["shingle", "node", "component", "n_shingles"])


def _weight() -> Column:
    return F.greatest(F.lit(1.0), F.col("n_shingles") / SHINGLES)


def _regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, node, size) of all regions, with what is sorted cut in overlapping stretches, and the nodes of regions that are too large."""
    keys = nodes.select("node", "n_shingles", "sig").mapInArrow(task(__name__, "tree_keys"), "key long, node long, n_shingles long, tree int")
    keys = materialise(keys, "tree-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum(_weight()).alias("weight")).where("size > 1")
    placed = materialise(keys.join(sizes, "key"), "regions")
    fits = placed.where(F.col("weight") <= REGION).select("key", "node", "size")
    over = placed.where(F.col("weight") > REGION)
    if over.isEmpty():
        return fits, None
    rows = over.select("key", "node", "n_shingles", "tree").join(nodes.select(F.col("node").alias("_node"), "sig"), F.col("node") == F.col("_node")).drop("_node")
    orders = rows.mapInArrow(task(__name__, "tree_orders"), "key long, node long, n_shingles long, order binary")
    at = running_total(orders.withColumn("weight", _weight()), "weight", "key", "order", "node", name="at")
    # Each is in two stretches, so that any two less than half a region apart meet in one.
    half = F.floor(F.col("at") / (REGION / 2)).cast("long")
    stretch = at.select("node", F.explode(F.array(F.xxhash64("key", half), F.xxhash64("key", half + 1))).alias("key"))
    stretch = materialise(stretch, "stretches")
    lengths = stretch.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return fits.unionByName(stretch.join(lengths, "key").select("key", "node", "size")), materialise(over.select("node").distinct(), "overfull")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b")), "b").select("a", "b", "shingles_a", "shingles_b")
    return with_b.mapInArrow(task(__name__, "confirm", percent), "a long, b long")


def _linked(groups: DataFrame, percent: int) -> DataFrame:
    """Links within each `key` of groups (key, node, shingles, component, asks)."""
    columns = groups.select("key", "node", "shingles", "component", "asks")
    return columns.groupBy("key").applyInArrow(task(__name__, "links_in", percent), "a long, b long")


def _across(sets: DataFrame, percent: int) -> DataFrame:
    """All links between nodes of different components in sets (node, n_shingles, shingles, component), or enough to connect the same.

    Linked nodes share one of their rarest shingles, those beyond the overlap that a link needs and one more, whatever
    counts as rare, if all sets have the same order (prefix filter). Shingles that only one component has come first in
    that order, and lead nowhere; then the fewer hold a shingle, the sooner it comes.

    A link with a set at least as large needs more overlap than one with any set: the smaller side of a pair has a shorter
    prefix, and none if so many of its shingles are its component's own that the others do not suffice. The sizes that
    the rest can reach bound the other side. Pages of one template that are no duplicates therefore do not meet.
    """
    rows = sets.mapInArrow(task(__name__, "shingle_rows"), "shingle long, node long, component long, n_shingles long")
    held = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle", "n")
    shared = rows.join(held, "shingle")
    rarest = Window.partitionBy("node").orderBy("n", "shingle")
    placed = shared.select("*", F.row_number().over(rarest).alias("at"), F.count("*").over(Window.partitionBy("node")).alias("n_shared"))
    least = F.ceil(F.col("n_shingles") * percent / 100)
    # A link of sizes n and m has percent * (n + m) <= (100 + percent) * overlap.
    reach = F.floor((100 + percent) * F.col("n_shared") / percent) - F.col("n_shingles")
    twice = F.ceil(2 * percent * F.col("n_shingles") / (100 + percent))
    prefix = placed.where(F.col("at") <= F.col("n_shared") - least + 1).select("shingle", "node", "component", "n_shingles", reach.alias("reach"), (F.col("at") <= F.col("n_shared") - twice + 1).alias("smaller"))
    prefix = materialise(prefix, "prefixes")
    big = materialise(sets.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") > FEW), "large-components")
    in_small = prefix.join(big, "component", "left_anti")
    in_large = prefix.join(big.select("component"), "component", "left_semi")

    # Members of small components meet as pairs.
    other = in_small.where(F.col("reach") * 100 >= percent * F.col("n_shingles")).select("shingle", F.col("node").alias("b"), F.col("component").alias("of_b"), F.col("n_shingles").alias("n_b"), F.col("reach").alias("reach_b"))
    meet = (F.col("component") != F.col("of_b")) & ((F.col("n_shingles") < F.col("n_b")) | ((F.col("n_shingles") == F.col("n_b")) & (F.col("node") < F.col("b"))))
    alike = (100 * F.col("n_shingles") >= percent * F.col("n_b")) & (F.col("n_b") <= F.col("reach")) & (F.col("n_shingles") <= F.col("reach_b"))
    pairs = materialise(in_small.where("smaller").join(other, "shingle").where(meet & alike).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "pairs")

    # Whoever shares a rare shingle with a large component meets all of it, in parts, once.
    whole = in_large.select("shingle", F.col("component").alias("large")).distinct()
    asking = in_small.select("shingle", "node", "component", F.lit(True).alias("small")).unionByName(in_large.select("shingle", "node", "component", F.lit(False).alias("small")))
    asking = asking.join(whole, "shingle").where((F.col("component") != F.col("large")) & (F.col("small") | (F.col("component") < F.col("large")))).select("node", "large").distinct()
    asking = materialise(asking, "asking")
    n_parts = F.ceil(F.sum(_weight()) / (REGION / 2))
    members = sets.join(big.select("component"), "component", "left_semi").select("component", "node", "n_shingles")
    asked = asking.join(sets.select("node", "n_shingles"), "node")
    parts = members.groupBy("component").agg(n_parts.alias("parts")).join(asked.groupBy(F.col("large").alias("component")).agg(n_parts.alias("chunks")), "component")
    parts = materialise(parts, "parts")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held_by = members.join(parts, "component").select("node", "component", deal("parts").alias("part"), every("chunks").alias("chunk"), F.lit(False).alias("asks"))
    asked_by = asked.withColumnRenamed("large", "component").join(parts, "component").select("node", "component", deal("chunks").alias("chunk"), every("parts").alias("part"), F.lit(True).alias("asks"))
    rooms = held_by.unionByName(asked_by).select(F.xxhash64("component", "part", "chunk").alias("key"), "node", "asks")
    dense = rooms.join(sets, "node")
    return _confirmed(pairs, sets.select("node", "shingles"), percent).unionByName(_linked(dense, percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    A null or empty text has no shingles and links with nothing. Rows that share a doc_id are one document in links. A
    row with a null doc_id links with nothing: its component_id is null and it is kept. Other columns are ignored.
    Empty input: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialise(rows.mapInArrow(task(__name__, "sign"), "doc_id long, n_shingles long, set_id binary, sig binary"), "signatures")
    real = base.where("n_shingles > 0 and doc_id is not null")
    reps = materialise(real.groupBy("set_id").agg(F.min("doc_id").alias("node")), "representatives")
    nodes = real.join(reps.withColumnRenamed("set_id", "_set"), (F.col("doc_id") == F.col("node")) & (F.col("set_id") == F.col("_set"))).select("node", "n_shingles", "sig")
    nodes = materialise(nodes, "nodes")
    regions, overfull = _regions(nodes)
    regions = materialise(regions, "neighbours")

    small = regions.where(F.col("size") <= SMALL).select("key", "node").join(nodes, "node").select("key", "node", "sig")
    small = small.repartition("key").sortWithinPartitions("key", "node")
    pairs = materialise(small.mapInArrow(task(__name__, "near_pairs", least_agreement(percent)), "a long, b long").distinct(), "pairs")
    large = regions.where(F.col("size") > SMALL).select("key", "node").distinct()

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node"))
    wanted = (wanted.union(overfull) if overfull is not None else wanted).distinct()
    texts = rows.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("node"), "left_semi")
    sets = materialise(texts.mapInArrow(task(__name__, "sets_of"), "node long, n_shingles long, shingles binary"), "shingle-sets")
    dense = large.join(sets, "node").select("key", "node", "shingles", F.col("node").alias("component"), F.lit(True).alias("asks"))
    links = materialise(_confirmed(pairs, sets, percent).unionByName(_linked(dense, percent)), "links")
    groups = materialise(components(links), "components")
    if overfull is not None:
        known = sets.join(overfull, "node", "left_semi").join(groups, F.col("node") == F.col("id"), "left").select("node", "n_shingles", "shingles", F.coalesce("component", "node").alias("component"))
        more = materialise(_across(materialise(known, "overfull-sets"), percent), "links")
        groups = materialise(components(links.unionByName(more)), "components") if not more.isEmpty() else groups

    member = base.select("doc_id", "n_shingles", "set_id").join(reps, "set_id", "left").join(groups, F.col("node") == F.col("id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return member.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each component, columns unchanged. Rows of a doc_id stay or go together: they go if none is kept."""
    judged = near_duplicates(docs, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    (id_,) = unused(docs, "_gone")
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias(id_))
    return docs.join(gone, F.col("doc_id") == F.col(id_), "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
