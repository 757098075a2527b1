"""Best-two-fit packing of token sequences.

Bins are filled greedily with the longest pieces that fit; then a bin's shortest piece is replaced by two unpacked
pieces that fill the gap it leaves more tightly. Pieces of one length are alike, so bins are planned on the histogram
of lengths, at most one row for each length up to the capacity, and every bin shape is repeated as often as the
histogram allows. Pieces, numbered within their length, then find their bin by that number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.common import gapless, materialise, read, task

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(batches, path: str, pattern: str, end: int, capacity: int, added: dict[str, int]):
    """Pieces of the texts' ids; all but a document's first piece have `capacity` tokens."""
    coder = tokens.Coder(path, pattern)
    for block in tokens.blocks(batches):
        ids, starts = coder.encode_with(block.column("text"), end, added)
        n = np.diff(starts)
        count = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        first = n - (count - 1) * capacity
        begin = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[doc], capacity)
        data = memoryview(ids.astype("<u4").tobytes())
        at = starts[doc] + begin
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        columns = [block.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def _greedy(left: np.ndarray, capacity: int) -> list[int]:
    """One bin: the longest piece, then again and again the longest that fits. Takes from `left`."""
    out, gap = [], capacity
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        out.append(int(fits[-1]))
        left[fits[-1]] -= 1
        gap -= out[-1]
    return out


def _two(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two pieces in `left` with the greatest sum of at most `gap`."""
    have = np.flatnonzero(left[:gap])
    if not len(have):
        return None
    at = np.searchsorted(have, gap - have, side="right") - 1
    other = have[np.maximum(at, 0)]
    same = (other == have) & (left[have] < 2)  # one piece cannot be both
    other = np.where(same, np.where(at > 0, have[np.maximum(at - 1, 0)], 0), other)
    total = np.where((at >= 0) & (other > 0), have + other, 0)
    best = int(np.argmax(total))
    return (int(have[best]), int(other[best])) if total[best] else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bins that use up `counts`, pieces for each length from 1 to `capacity`."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        before = left.copy()
        shape = _greedy(left, capacity)
        while (gap := capacity - sum(shape)) and len(shape) > 1:
            least = min(shape)
            pair = _two(left, gap + least)
            if pair is None or sum(pair) <= least:
                break
            shape.remove(least)
            left[least] += 1
            for x in pair:
                left[x] -= 1
                shape.append(x)
        need = np.bincount(shape, minlength=capacity + 1)
        times = int((before[need > 0] // need[need > 0]).min())
        left = before - times * need
        out.append((times, sorted(shape, reverse=True)))
    return out


def runs(bins: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows of length, first number, first sequence, pieces a sequence, offset of the first, sorted by length and number."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for times, shape in bins:
        offset = 0
        for length in dict.fromkeys(shape):
            n = shape.count(length)
            rows.append((length, seen.get(length, 0), sequence, n, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(batches, rows: np.ndarray):
    key = rows[:, 0] * (1 << 48) + rows[:, 1]
    for batch in batches:
        length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        at = np.searchsorted(key, length * (1 << 48) + number, side="right") - 1
        _, first, sequence, n, offset = rows[at].T
        i = number - first
        columns = [*batch.columns[:5], pa.array(sequence + i // n, pa.int64()), pa.array(offset + i % n * length, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, pattern: str, end: int = END, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `added` are tokens with ids of their own wherever they stand in a text. A null or empty text is the one id `end`.
    Repeated rows are packed each by itself; a null doc_id stays null. Other columns are ignored. Empty input: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = materialise(rows.mapInArrow(task(__name__, "cut", tokens.vocabulary(docs.sparkSession, path), pattern, end, capacity, added or {}), PIECES), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    shapes = runs(plan({r["length"]: r["count"] for r in histogram}, capacity))
    numbered = gapless(pieces, "length", F.struct("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32"], "number")
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(task(__name__, "assign", shapes), PIECES + ", sequence_id long, offset long")


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
