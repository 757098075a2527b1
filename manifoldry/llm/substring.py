"""Near-duplicate passages by compact windows over min-hashes of token runs.

Two passages that are near duplicates share a run of words whose least length follows from the similarity (`shared_run`).
A Cartesian tree over the hashes of a document's shorter runs groups its subsequences by their least hash: a compact
window stands for all subsequences with one minimum. Subsequences of that length which are equal have the same minimum,
so the one hash that all agree on is enough, and no near duplicate depends on chance to be a candidate.

What holds a key meets its first holder in the corpus. Overlapping windows of two documents are joined to intervals,
and their shingles compared. What is not found similar there meets the other earlier holders of the key, a class of
equal surroundings at a time.

The first occurrence of a passage, by doc_id, stays; later ones are marked, and can be cut from the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.common import materialise, read, task, unused
from manifoldry.llm.minhash import WORDS, mix, shingle_hashes, word_hashes

#: Least words of a passage, and its shingles.
PASSAGE = 50
LEAST = PASSAGE - WORDS + 1
#: Passages are near duplicates from this similarity of their shingle sets on.
PERCENT = 80
#: So many different surroundings of a key meet each other; where there are more, they must share a rare shingle too, and
#: where so many hold that one as well, what they hold around the key is compared place by place.
FEW = 64
#: Open places that a task holds while all surroundings of their key pass by, and those of each that meet at a time.
HELD, SOME = 1024, (64, 256)
#: Shingles of a tile, in which documents are cut for comparison.
TILE = 128

_WHOLE = np.uint64(0x1F83D9ABFB41BD6B)


def shared_run(least: int, percent: int) -> int:
    """Words of a run that two passages of `least` shingles or more share at least, if their similarity is `percent`.

    Shingles that follow each other in one passage and not in the other part at a break, which costs either passage 4
    shingles or more. What is shared has a piece more than breaks, and the longest is no shorter than their mean. (Words
    that a passage repeats within itself can hide a break.)
    """
    cost, best, k = WORDS - 1, -(-percent * least // 100), 1
    while percent < 100:
        fewest = -(-cost * k * (100 + percent) // (100 - percent))
        n = max(least, fewest)
        best = min(best, -(-percent * (n + cost * k) // (100 * (k + 1))))
        if fewest > least and k > 1:
            break
        k += 1
    return best + WORDS - 1


def run_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of `n` words, WORDS or more, from the hashes of the shingles."""
    m = len(shingles) - (n - WORDS)
    if m <= 0:
        return shingles[:0]
    out = shingles[:m] ^ np.uint64(n)
    for at in [*range(WORDS, n - WORDS, WORDS), n - WORDS]:
        out = mix(out * _WHOLE + shingles[at : at + m])
    return out


def least_places(keys: np.ndarray, least: int) -> np.ndarray:
    """The places of the least keys of all runs of `least` places, in order. Keys end in their places; zero keys are walls."""
    if len(keys) < least:
        return np.array([], np.int64)
    run, size = keys, 1
    while size < least:
        step = min(size, least - size)
        run = np.minimum(run[:-step], run[step:])
        size += step
    roots = run[np.flatnonzero(np.diff(run, prepend=np.uint64(0)))]  # a place is least in runs that follow each other
    return (roots[roots >= np.uint64(1 << 32)] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def compact_windows(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), ends included, of all windows of `least` places or more in which keys[c] is the least. Keys are distinct.

    Zero keys are walls. Minima over runs of powers of two stand for the tree: a run's least key is a root, and its
    window reaches to the next smaller keys on both sides.
    """
    n = len(keys)
    levels = [keys]
    while (1 << len(levels)) <= n:
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    c = least_places(keys, least)
    own, left, right = keys[c], c.copy(), c + 1
    for k in reversed(range(len(levels))):
        size = len(levels[k])
        at = left - (1 << k)
        left = np.where((at >= 0) & (levels[k][np.maximum(at, 0)] > own), at, left)
        right = np.where((right < size) & (levels[k][np.minimum(right, size - 1)] > own), right + (1 << k), right)
    return left, c, right - 1


def windows(batches, run: int, gram: int):
    """(key, doc, c): of every `run` words, the place and the key of the `gram` words of the least hash."""
    for block in tokens.blocks(batches, 1_000_000):
        words, starts = word_hashes(block.column("text"))
        n = np.diff(starts)
        left = np.repeat(starts[1:], n) - np.arange(len(words))  # words up to the text's end
        h = run_hashes(shingle_hashes(words), gram) if len(words) >= gram else words[:0]
        doc_id = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = (np.maximum(h >> np.uint64(32), np.uint64(1)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        keys[left[: len(h)] < gram] = 0
        c = least_places(keys, run - gram + 1)
        doc = np.repeat(np.arange(len(n)), n)[c]
        columns = [pa.array(h[c].view(np.int64)), pa.array(doc_id[doc]), pa.array((c - starts[doc]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "c"])


def block_shingles(block: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Shingle hashes of all words of a block, and where each text's own start and stop; those across two texts are in between."""
    words, starts = word_hashes(block.column("text"))
    s = shingle_hashes(words) if len(words) >= WORDS else words[:0]
    return s, list(zip(starts[:-1].tolist(), np.maximum(starts[1:] - (WORDS - 1), starts[:-1]).tolist(), strict=True))


def surroundings(batches, gram: int, reach: int):
    """(key, doc, c, around): the keys at the places `wanted`, with a digest of the shingles up to `reach` before and after."""
    for block in tokens.blocks(batches):
        shingles, bounds = block_shingles(block)
        first, doc, place, around = [], [], [], []
        for d, wanted, (a, b) in zip(block.column("doc_id").to_pylist(), block.column("wanted").to_pylist(), bounds, strict=True):
            s = shingles[a:b]
            at = [c for c in sorted(wanted) if c + gram - WORDS < b - a]
            first += [a + c for c in at]
            doc += [d] * len(at)
            place += at
            around += [xxhash.xxh3_64_intdigest(s[max(0, c - reach) : c + gram - WORDS + 1 + reach].tobytes()) for c in at]
        keys = run_hashes(shingles, gram)[np.array(first, np.int64)].view(np.int64)
        columns = [pa.array(keys), pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(np.array(around, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "c", "around"])


def contexts(batches, gram: int, reach: int):
    """(pair, doc, c, open): the key at each place `wanted`, paired with every distinct shingle up to `reach` before and after that it does not hold."""
    inner = gram - WORDS + 1
    offsets = np.arange(-reach, inner + reach)
    ends = ((offsets < 0) | (offsets >= inner)).astype(np.uint64)
    none, bit = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    for block in tokens.blocks(batches):
        shingles, bounds = block_shingles(block)
        doc, place, opens, starts, stops = [], [], [], [], []
        for d, wanted, (a, b) in zip(block.column("doc_id").to_pylist(), block.column("wanted").to_pylist(), bounds, strict=True):
            asked = [x for x in wanted if x["c"] + inner <= b - a]  # another row of the doc_id may have the others
            doc += [d] * len(asked)
            place += [x["c"] for x in asked]
            opens += [x["open"] for x in asked]
            starts += [a] * len(asked)
            stops += [b] * len(asked)
        if not doc:
            continue
        doc, place, opens, starts, stops = (np.array(x, t) for x, t in ((doc, np.int64), (place, np.int32), (opens, bool), (starts, np.int64), (stops, np.int64)))
        key = run_hashes(shingles, gram)[starts + place]
        out = []
        for s in range(0, len(doc), 4096):
            part = slice(s, s + 4096)
            near = (starts[part] + place[part])[:, None] + offsets
            inside = (near >= starts[part, None]) & (near < stops[part, None])
            value = shingles[near.clip(0, len(shingles) - 1)] & ~bit | ends
            value = np.sort(np.where(inside, value, none), axis=1)  # of equal shingles, one that the key holds comes first
            kept = (value & bit == bit) & (value != none)
            kept[:, 1:] &= value[:, 1:] >> bit != value[:, :-1] >> bit
            row, column = np.nonzero(kept)
            pair = mix(value[row, column] * _WHOLE + key[part][row])
            which = row + s
            out.append(pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(doc[which]), pa.array(place[which]), pa.array(opens[which])], ["pair", "doc", "c", "open"]))
        yield from out


def around(batches, gram: int, reach: int):
    """(key, doc, c, open, hashes): the keys at the places `wanted`, with the 32-bit hashes of the shingles up to `reach` before and after, 0 beyond the text."""
    inner = gram - WORDS + 1
    beyond = np.zeros(reach, "<u4")
    for block in tokens.blocks(batches):
        shingles, bounds = block_shingles(block)
        first, doc, place, opens, data = [], [], [], [], []
        for d, wanted, (a, b) in zip(block.column("doc_id").to_pylist(), block.column("wanted").to_pylist(), bounds, strict=True):
            s = shingles[a:b]
            asked = [x for x in wanted if x["c"] + inner <= b - a]
            first += [a + x["c"] for x in asked]
            all_ = np.concatenate([beyond, np.maximum(s >> np.uint64(32), np.uint64(1)).astype("<u4"), beyond])
            doc += [d] * len(asked)
            place += [x["c"] for x in asked]
            opens += [x["open"] for x in asked]
            data += [all_[x["c"] : x["c"] + inner + 2 * reach].tobytes() for x in asked]
        keys = run_hashes(shingles, gram)[np.array(first, np.int64)].view(np.int64)
        columns = [pa.array(keys), pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(opens, pa.bool_()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "c", "open", "hashes"])


def hits(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """[i, p, j]: how many of the `least` hashes of x[i] from place p on are anywhere in y[j]. Hash 0 is none."""
    names, of = np.unique(y, return_inverse=True)
    held = np.zeros((len(names) + 1, len(y)), np.int16)
    held[of.reshape(y.shape), np.arange(len(y))[:, None]] = 1
    held[:-1][names == 0] = 0
    at = np.searchsorted(names, x).clip(max=len(names) - 1)
    total = held[np.where(names[at] == x, at, len(names))].cumsum(1, dtype=np.int16)
    out = total[:, least - 1 :]
    out[:, 1:] -= total[:, :-least].copy()
    return out


def meetings(batches, least: int, percent: int):
    """What is `around` keys, by (key, part, later, doc), to pairs (doc, c, doc0, c0) of open places with earlier holders.

    The open places of a part come first, then all holders of its key in the order of documents. An open place is paired
    with each holder by which more of what is around it repeats than by those before, so that pairs follow the places:
    only windows with enough shingles of the holder are looked at, and only where no span holds them yet.
    """
    enough = -(-2 * percent * least // (100 + percent))
    group, held = None, []

    def opened(parts):
        doc, c, x = (np.concatenate(v) for v in zip(*parts, strict=True))
        return doc, c, x, x == 0  # beyond the text nothing can be found: it counts as done

    def met(mine, doc0, c0, y):
        doc, c, x, done = mine
        out = []
        live = np.flatnonzero((doc > doc0[0]) & ~done.all(1))
        for s in range(0, len(live), SOME[0]):
            rows = live[s : s + SOME[0]]
            good = hits(x[rows], y, least) >= enough
            good &= (doc0[None, :] < doc[rows, None])[:, None, :]
            i, j = np.nonzero(good.any(1))
            first, last = good.argmax(1)[i, j], good.shape[1] - 1 - good[:, ::-1].argmax(1)[i, j] + least
            for n in np.unique(i).tolist():
                row, rest = rows[n], np.flatnonzero(i == n)
                a, skip = x[row][x[row] != 0], int((x[row] != 0).argmax())
                while len(rest):
                    below = np.concatenate([[0], np.cumsum(done[row])])
                    rest = rest[below[last[rest]] - below[first[rest]] < last[rest] - first[rest]]
                    new = False
                    while len(rest) and not new:
                        k, rest = j[rest[0]], rest[1:]
                        for p, q in similar_spans(a, y[k][y[k] != 0], least, percent):
                            new |= not done[row, skip + p : skip + q + 1].all()
                            done[row, skip + p : skip + q + 1] = True
                        if new:
                            out.append((doc[row], c[row], doc0[k], c0[k]))
        return out

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, part, later, doc, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "part", "later", "doc", "c"))
        data = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<u4").reshape(n, -1)
        new = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (later[1:] != later[:-1])) + 1, [n]])
        out = []
        for s, e in zip(new.tolist(), new[1:].tolist(), strict=False):
            if group != (key[s], part[s]):
                group, held = (key[s], part[s]), []
            if not later[s]:
                held.append((doc[s:e], c[s:e], data[s:e]))
                continue
            if isinstance(held, list):
                held = opened(held) if held else None
            for t in range(s, e if held else s, SOME[1]):
                to = min(e, t + SOME[1])
                out += met(held, doc[t:to], c[t:to], data[t:to])
        parts = list(zip(*out, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types, strict=True)], ["doc", "c", "doc0", "c0"])


def tiles(batches):
    """(doc, tile, hashes): the tiles asked for, as 32-bit shingle hashes."""
    for block in tokens.blocks(batches):
        shingles, bounds = block_shingles(block)
        short = (shingles >> np.uint64(32)).astype("<u4")
        doc, number, data = [], [], []
        for d, wanted, (a, b) in zip(block.column("doc_id").to_pylist(), block.column("wanted").to_pylist(), bounds, strict=True):
            s = short[a:b]
            for t in sorted(wanted):
                if len(part := s[t * TILE : (t + 1) * TILE]):
                    doc.append(d)
                    number.append(t)
                    data.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(data, pa.binary())], ["doc", "tile", "hashes"])


def similar_spans(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Spans of `a`, ends included, that are near duplicates of a span of `b`, both of `least` shingles or more.

    A window of `least` shingles can only be one if enough of them are in `b`. Where such windows touch they are tried as
    a whole, then one by one; what is similar is joined, and loses the ends that are not in `b`.
    """
    if len(a) < least or len(b) < least:
        return []
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    at = np.searchsorted(ranked, a).clip(max=len(b) - 1)
    hit, where = ranked[at] == a, order[at]
    total = np.concatenate([[0], np.cumsum(hit)])
    enough = -(-2 * percent * least // (100 + percent))
    at = np.flatnonzero(total[least:] - total[:-least] >= enough)
    if not len(at):
        return []
    places = np.flatnonzero(hit)
    shifts = where[places] - places
    below = total.tolist()
    mine, theirs = a.tolist(), b.tolist()

    def similar(s: int, e: int) -> bool:
        """Whether a[s:e] is similar to what its first and last hit, or its middle one, point at in `b`."""
        first, stop = below[s], below[e]
        middle = int(shifts[(first + stop) // 2])
        ours = set(mine[s:e])
        for p, q in {(s + int(shifts[first]), e + int(shifts[stop - 1])), (s + middle, e + middle)}:
            # Where `b` ends too soon, the partner is the nearest one that is long enough.
            p = max(0, min(p, len(b) - least))
            partner = set(theirs[p : min(len(b), max(q, p + least))])
            both = len(ours & partner)
            if 100 * both >= percent * (len(ours) + len(partner) - both):
                return True
        return False

    good = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > least) + 1):
        s, e = int(run[0]), int(run[-1]) + least
        good += [(s, e)] if similar(s, e) else [(i, i + least) for i in run.tolist() if similar(i, i + least)]
    out: list[tuple[int, int]] = []
    for s, e in good:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return [(int(places[below[s]]), int(places[below[e] - 1])) for s, e in out]


def verify(batches, least: int, percent: int):
    """Candidates' tiles, sorted by candidate, side and number, to spans in words: (doc, start, stop, source)."""
    held: pa.Table | None = None
    names = ["doc", "lo", "hi", "doc0", "lo0", "side", "tile", "hashes"]

    def spans(rows: pa.Table) -> pa.RecordBatch:
        cols = [rows.column(n).to_numpy() for n in ("doc", "lo", "hi", "doc0", "lo0", "side", "tile")]
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:5]])
        cuts = [*np.flatnonzero(new).tolist(), len(new)]
        data = rows.column("hashes").to_pylist()
        out = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            doc, lo, hi, doc0 = (int(x[s]) for x in cols[:4])
            mid = s + int((cols[5][s:e] == 0).sum())
            if mid in (s, e):
                continue
            a, b = np.frombuffer(b"".join(data[s:mid]), "<u4"), np.frombuffer(b"".join(data[mid:e]), "<u4")
            skip = int(cols[6][s]) * TILE
            a = a[max(0, lo - skip) : hi + 1 - skip]
            out += [(doc, max(lo, skip) + p, max(lo, skip) + q + WORDS, doc0) for p, q in similar_spans(a, b, least, percent)]
        parts = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], ["doc", "start", "stop", "source"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(names)
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        doc = rows.column("doc").to_numpy()
        last = int(np.searchsorted(doc, doc[-1]))
        held = rows.slice(last)
        if last:
            yield spans(rows.slice(0, last))
    if held is not None:
        yield spans(held)


def _compare(rows: DataFrame, pairs: DataFrame, least: int, percent: int) -> DataFrame:
    """Spans of the pairs (doc, c, d, doc0, c0, d0), which share words at or between the places c to d and c0 to d0, that are similar."""
    before = lambda c: F.greatest(F.col(c) - least, F.lit(0))
    after = lambda c: F.col(c) + 2 * least
    pairs = pairs.select("doc", before("c").alias("l"), after("d").alias("r"), "doc0", before("c0").alias("l0"), after("d0").alias("r0"))
    # Pairs of a document that overlap and meet one part of an other document are one candidate: at most a document's keys in a group.
    for lo, hi, group, island in (("l0", "r0", ["doc", "doc0"], "part"), ("l", "r", ["doc", "doc0", "part"], "island")):
        each = Window.partitionBy(*group).orderBy(lo, hi)
        reach = F.max(hi).over(each.rowsBetween(Window.unboundedPreceding, -1))
        pairs = pairs.withColumn("new", F.coalesce((F.col(lo) > reach).cast("int"), F.lit(1))).withColumn(island, F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = pairs.groupBy("doc", "doc0", "part", "island").agg(F.min("l").alias("lo"), F.max("r").alias("hi"), F.min("l0").alias("lo0"), F.max("r0").alias("hi0"))
    candidates = materialise(bounds.drop("part", "island"), "candidates")

    span = lambda lo, hi: F.explode(F.sequence((F.col(lo) / TILE).cast("int"), (F.col(hi) / TILE).cast("int")))
    side_a = candidates.select("doc", "lo", "hi", "doc0", "lo0", F.lit(0).alias("side"), F.col("doc").alias("of"), span("lo", "hi").alias("tile"))
    side_b = candidates.select("doc", "lo", "hi", "doc0", "lo0", F.lit(1).alias("side"), F.col("doc0").alias("of"), span("lo0", "hi0").alias("tile"))
    asked = side_a.unionByName(side_b)
    wanted = asked.groupBy("of", "tile").agg(F.lit(1).alias("_")).groupBy("of").agg(F.collect_list("tile").alias("wanted"))
    texts = rows.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("of")).select("doc_id", "text", "wanted")
    cut = materialise(texts.mapInArrow(task(__name__, "tiles"), "doc long, tile int, hashes binary"), "tiles")
    cut = cut.select(F.col("doc").alias("_doc"), F.col("tile").alias("_tile"), "hashes")
    ready = asked.join(cut, (F.col("of") == F.col("_doc")) & (F.col("tile") == F.col("_tile"))).select("doc", "lo", "hi", "doc0", "lo0", "side", "tile", "hashes")
    ready = ready.repartition("doc").sortWithinPartitions("doc", "doc0", "lo", "hi", "lo0", "side", "tile")
    return materialise(ready.mapInArrow(task(__name__, "verify", least, percent), "doc long, start long, stop long, source long"), "passages")


def passages(docs: DataFrame, passage: int = PASSAGE, percent: int = PERCENT) -> DataFrame:
    """(doc, start, stop, source): words start..stop-1 of `doc` repeat a passage of the earlier document `source`.

    Only passages between documents count, not within one. Null and empty texts and rows with a null doc_id have none;
    rows that share a doc_id are one document.
    """
    least = passage - WORDS + 1
    run = shared_run(least, percent)
    gram = max(WORDS, run * 3 // 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = materialise(rows.mapInArrow(task(__name__, "windows", run, gram), "key long, doc long, c int"), "all-windows")
    # What is grouped by key is written before rows join it by key: a join of two shuffles is one that Spark splits where a key is hot.
    repeated = materialise(found.groupBy("key").agg(F.min("doc").alias("doc0"), F.max("doc").alias("most")).where("doc0 < most").select("key", "doc0"), "repeated")
    met = materialise(found.join(repeated, "key"), "windows")
    first = materialise(met.where("doc = doc0").groupBy("key").agg(F.min("c").alias("c0")).select(F.col("key").alias("_key"), "c0"), "first")
    others = materialise(met.join(first, F.col("key") == F.col("_key")).where("doc <> doc0 or c <> c0").select("key", "doc", "c", "doc0", "c0"), "others")
    later = others.where("doc <> doc0")
    spans = _compare(rows, later.select("doc", "c", F.col("c").alias("d"), "doc0", "c0", F.col("c0").alias("d0")), least, percent)

    # What no span holds and has other earlier holders than the first, which can be later places of the first's document.
    held = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(F.col("doc").alias("_doc"), "spans")
    inside = F.exists("spans", lambda s: (s["start"] <= F.col("c")) & (s["stop"] >= F.col("c") + gram))
    left = later.join(held, F.col("doc") == F.col("_doc"), "left").where(F.col("spans").isNull() | ~inside).select("key", "doc", "c")
    left = materialise(left, "left")
    more = others.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("key")
    again = materialise(left.select("key").distinct().join(more, "key"), "again")
    if again.isEmpty():
        return spans
    open_ = left.select(F.col("key").alias("_key"), F.col("doc").alias("_doc"), F.col("c").alias("_c"), F.lit(True).alias("open"))
    return spans.unionByName(_compare(rows, _other_holders(rows, met.select("key", "doc", "c").join(again, "key"), open_, gram, least, percent), least, percent))


def _at_places(rows: DataFrame, places: DataFrame, *what: str) -> DataFrame:
    """doc_id, text and the wanted places of the documents in `places` (doc, c), as structs if more columns are asked for."""
    place = F.struct("c", *what) if what else F.col("c")
    wanted = places.groupBy("doc").agg(F.collect_set(place).alias("wanted"))
    return rows.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "wanted")


def _other_holders(rows: DataFrame, holders: DataFrame, open_: DataFrame, gram: int, least: int, percent: int) -> DataFrame:
    """Pairs of the open places of `holders` (key, doc, c) with earlier holders of their keys.

    Holders with the same surrounding are a class, whose first member stands for it; of its open ones, those in the first
    open document do, as the others repeat the first member. Open classes meet all classes of their key where these are
    few. Where they are many, they meet those that share a rare shingle beside the key: of two similar passages around a
    key, each has so many shingles in common with the other that they share one of its rarest ones, whatever order counts
    as rare, if it is the same for both (prefix filter). Of those whose rarest ones are held by many, all meet too
    (`_among_many`). A surrounding that repeats itself has fewer different shingles; where it is similar with fewer in
    common than others need, it is not found among many.
    """
    seen = _at_places(rows, holders).mapInArrow(task(__name__, "surroundings", gram, least), "key long, doc long, c int, around long")
    same = (F.col("key") == F.col("_key")) & (F.col("doc") == F.col("_doc")) & (F.col("c") == F.col("_c"))
    seen = materialise(seen.join(open_, same, "left").select("key", "doc", "c", "around", F.coalesce("open", F.lit(False)).alias("open")), "holders")
    classes = seen.groupBy("key", "around").agg(F.min(F.struct("doc", "c")).alias("f"), F.max("open").alias("any_open"), F.min(F.when(F.col("open"), F.struct("doc", "c"))).alias("o"))
    classes = materialise(classes, "classes")
    sizes = materialise(classes.groupBy("key").agg(F.count("*").alias("n"), F.max("any_open").alias("any_open")).where("any_open").select("key", "n"), "sizes")
    sources = classes.select("key", F.col("f.doc").alias("doc0"), F.col("f.c").alias("c0"))
    heads = classes.where("any_open").select("key", "around", F.col("f.doc").alias("doc0"), F.col("f.c").alias("c0"), F.col("o.doc").alias("o"))
    members = seen.where("open").select("key", "around", "doc", "c").join(heads, ["key", "around"]).where("doc0 < doc or o = doc")
    members = materialise(members.select("key", "doc", "c", "doc0", "c0", (F.col("o") == F.col("doc")).alias("stands")), "members")
    targets = members.where("stands").select("key", "doc", "c")
    names = ["doc", "c", "doc0", "c0"]
    in_class = members.where("doc0 < doc").select(names)
    few = sizes.where(F.col("n") <= FEW).select("key")
    among_few = targets.join(few, "key").join(sources.join(few, "key"), "key").where("doc0 < doc").select(names)
    found = in_class.unionByName(among_few)
    many = materialise(sizes.where(F.col("n") > FEW).select("key"), "many")
    if not many.isEmpty():
        firsts = sources.join(many, "key").select("key", F.col("doc0").alias("doc"), F.col("c0").alias("c"), F.lit(False).alias("open"))
        stand = firsts.unionByName(targets.join(many, "key").select("key", "doc", "c", F.lit(True).alias("open")))
        reps = materialise(stand.groupBy("doc", "c").agg(F.max("open").alias("open")), "representatives")
        needed = -(-2 * percent * least // (100 + percent)) - (gram - WORDS + 1)
        beside = materialise(_at_places(rows, reps, "open").mapInArrow(task(__name__, "contexts", gram, least), "pair long, doc long, c int, open boolean"), "contexts")
        held = materialise(beside.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"), "pairs")
        # Shingles that only one has come first in the order and lead nowhere: they take places of the prefix, own - needed + 1,
        # and need no rows; what is left of it goes to the n_shared others.
        shared = beside.join(held, "pair").select("pair", "doc", "c", "open", "n")
        rarest = Window.partitionBy("doc", "c").orderBy("n", "pair")
        last = F.count("*").over(Window.partitionBy("doc", "c"))
        placed = shared.select("*", F.row_number().over(rarest).alias("at"), last.alias("n_shared"))
        prefix = materialise(placed.where(F.col("at") <= F.col("n_shared") - needed + 1).drop("at", "n_shared"), "prefixes")
        rare = prefix.where(F.col("n") <= FEW)
        meet = rare.where("open").select("pair", "doc", "c").join(rare.select("pair", F.col("doc").alias("doc0"), F.col("c").alias("c0")), "pair").where("doc0 < doc").select(names)
        found = found.unionByName(meet)
        hot = prefix.where(F.col("n") > FEW).select("doc", "c", "open")
        hot = materialise(hot.groupBy("doc", "c").agg(F.max("open").alias("open")), "hot-places")
        if not hot.where("open").isEmpty():
            found = found.unionByName(_among_many(rows, hot, gram, least, percent).select(names))
    return found.distinct().select("doc", "c", F.col("c").alias("d"), "doc0", "c0", F.col("c0").alias("d0"))


def _among_many(rows: DataFrame, places: DataFrame, gram: int, least: int, percent: int) -> DataFrame:
    """Pairs of the open ones of `places` (doc, c, open) with earlier holders of their key among these.

    All are compared, in tasks of HELD open places, by which the holders pass; a row leaves them only for what more of an
    open place's surrounding a holder repeats. So rows follow the places, and only comparisons their square.
    """
    schema = "key long, doc long, c int, open boolean, hashes binary"
    holders = materialise(_at_places(rows, places, "open").mapInArrow(task(__name__, "around", gram, least), schema), "around")
    parts = holders.groupBy("key").agg(F.ceil(F.count_if("open") / HELD).cast("int").alias("parts")).where("parts > 0")
    dealt = holders.join(materialise(parts, "parts"), "key")
    names = ["key", "part", "later", "doc", "c", "hashes"]
    held = dealt.where("open").select("*", F.pmod(F.xxhash64("doc", "c"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("later"))
    passing = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("later"))
    met = held.select(names).unionByName(passing.select(names)).repartition("key", "part").sortWithinPartitions("key", "part", "later", "doc", "c")
    return materialise(met.mapInArrow(task(__name__, "meetings", least, percent), "doc long, c int, doc0 long, c0 int"), "meetings")


def marked(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_spans, n_dup_words, spans (start, stop), sources, n_copied_from_here.

    spans are disjoint; a document without repeated passages has empty lists. n_copied_from_here counts the documents
    that repeat a passage of this one. Empty input: empty result.
    """
    found = passages(docs) if found is None else found
    order = Window.partitionBy("doc").orderBy("start", "stop", "source")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = joined.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("n_dup_words"))
    sources = found.groupBy("doc").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    copied = found.select("source", "doc").distinct().groupBy("source").agg(F.count("*").alias("n_copied_from_here"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    for part, key in ((spans, "doc"), (sources, "doc"), (copied, "source")):
        out = out.join(part.withColumnRenamed(key, "_k"), F.col("doc_id") == F.col("_k"), "left").drop("_k")
    return out.select(
        "doc_id",
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).alias("n_spans"),
        F.coalesce("n_dup_words", F.lit(0)).alias("n_dup_words"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
        F.coalesce("n_copied_from_here", F.lit(0)).alias("n_copied_from_here"),
    )


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans`, and without the white space after each that goes."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at : places[start][0]])
        at = places[stop][0] if stop < len(places) else places[stop - 1][1]
    return "".join([*out, text[at:]])


def cut_batches(batches, spans: str):
    for batch in batches:
        texts = [t if not s else cut_spans(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n != spans]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def cut_passages(docs: DataFrame) -> DataFrame:
    """`docs` with later occurrences of repeated passages cut from text, columns and rows unchanged otherwise."""
    id_, found = unused(docs, "_doc", "_spans")
    spans = marked(docs).where("n_spans > 0").select(F.col("doc_id").alias(id_), F.col("spans").alias(found)).dropDuplicates([id_])
    joined = docs.join(spans, F.col("doc_id") == F.col(id_), "left").drop(id_)
    whole = joined.where(F.col(found).isNull()).drop(found)
    cut = joined.where(F.col(found).isNotNull()).mapInArrow(task(__name__, "cut_batches", found), docs.schema)
    return whole.unionByName(cut)


def op9(spark, sf_dir: str) -> DataFrame:
    return marked(read(spark, sf_dir, "documents"))
