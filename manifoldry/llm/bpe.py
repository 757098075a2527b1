"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts fall into pre-tokens, each a word with its positions. Blocks of texts keep their distinct words and, compressed,
the positions; words are dealt by hash, so that each distinct word of the corpus is encoded once, in one place; ids go
back to the blocks that asked, where documents are put together by position. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.common import bucketed, buckets, read, task

ROWS = "block string, bucket int, doc_ids array<long>, counts array<int>, payload binary"
#: The bucket of a block's positions; words have buckets from 0.
POSITIONS = -1
BLOCK_BYTES = 8_000_000
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 24_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, byte by byte of their values, compressed."""
    parts = []
    for x in arrays:
        parts += [np.uint64(len(x)).tobytes(), np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        n = int(np.frombuffer(data, np.uint64, 1, at)[0])
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at + 8).reshape(4, n).T).view("<u4").ravel())
        at += 8 + 4 * n
    return out


def _pre_tokens(distinct: list[str], joined: int, pattern: str) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all parts, one after another, and how many each part has."""
    find = regex.compile(pattern).findall
    words = find("".join(distinct[:joined]))
    ends = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), np.cumsum([len(p) for p in distinct[:joined]]), side="right")
    alone = [find(p) for p in distinct[joined:]]
    counts = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in alone], np.int64)]).astype(np.int64)
    return words + [w for x in alone for w in x], counts


def explode(batches, pattern: str, n_buckets: int):
    """For each block: a row of positions, and a row of distinct words for each bucket that has some."""
    from pyspark import TaskContext

    partition, number = TaskContext.get().partitionId(), 0
    for block in tokens.blocks(batches, BLOCK_BYTES):
        distinct, code, starts, joined = tokens.parts(block.column("text"))
        words, counts = _pre_tokens(distinct, joined, pattern)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        begin = np.cumsum(counts) - counts
        seen = tokens.spread(coded.indices.to_numpy().astype(np.int64), begin, counts, code)
        per_doc = np.add.reduceat(np.append(counts[code], 0), starts[:-1]) if len(starts) > 1 else np.array([], np.int64)
        texts = [w.encode() for w in coded.dictionary.to_pylist()]
        # Frequent words get small numbers, whose bytes compress well.
        often = np.argsort(-np.bincount(seen, minlength=len(texts)), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(texts[i]) % n_buckets for i in often.tolist()), np.int64, len(often))
        order = np.argsort(bucket, kind="stable")  # a bucket's words lie by rank
        name = f"{partition}-{number}"
        number += 1
        rows = [(name, POSITIONS, block.column("doc_id").to_pylist(), per_doc.tolist(), pack(rank[seen], bucket))]
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1)).tolist()
        for b in range(n_buckets):
            mine = [texts[i] for i in often[order[cuts[b] : cuts[b + 1]]].tolist()]
            if mine:
                lengths = np.fromiter(map(len, mine), np.int64, len(mine))
                rows.append((name, b, [], [], pack(lengths, np.frombuffer(b"".join(mine), np.uint8))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "doc_ids", "counts", "payload"])


def encode_bucket(table: pa.Table, path: str | tuple, pattern: str) -> pa.Table:
    """All words of a bucket, of every block: each distinct one is encoded once; answers go by block."""
    coder = tokens.Coder(path, pattern)
    sizes, lists = [], []
    for payload in table.column("payload").to_pylist():
        lengths, letters = unpack(payload)
        stops = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        sizes.append(len(lengths))
        lists.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(letters.astype(np.uint8).tobytes())]))
    flat = pa.concat_arrays(lists).cast(pa.large_string()).dictionary_encode()
    # A word that a space begins and nothing white ends can stand before the next such word.
    alone = np.asarray(pc.invert(pc.match_substring_regex(flat.dictionary, f"^ [^{tokens.WHITE}]+$")))
    order = np.argsort(alone, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids, start, length = coder.encode_parts(flat.dictionary.take(pa.array(order)).to_pylist(), int((~alone).sum()))
    code = place[flat.indices.to_numpy()]
    payload, at = [], 0
    for n in sizes:
        mine = code[at : at + n]
        at += n
        payload.append(pack(length[mine], tokens.spread(ids, start, length, mine)))
    none = [[]] * len(sizes)
    return pa.table([table.column("block"), table.column("bucket"), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int32())), pa.array(payload, pa.binary())], ["block", "bucket", "doc_ids", "counts", "payload"])


def decode_words(ids: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """Each word's bytes: ids joined to the table of token bytes, put together by position."""
    table = tokens.ranks(path)
    by_id = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        by_id[rank] = token
    data = pc.take(pa.array(by_id, pa.large_binary()), pa.array(ids.astype(np.int64)))
    joined = b"".join(data.to_pylist())
    size = np.concatenate([[0], np.cumsum(tokens.token_lengths(path)[ids])])
    stops = size[np.cumsum(counts)].tolist()
    return [joined[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def assemble(table: pa.Table, answers: pa.Table, path: str) -> pa.Table:
    """The documents of one block, from its positions and the ids of its words."""
    head = table.to_pylist()[0]
    told = [unpack(x) for x in answers.sort_by("bucket").column("payload").to_pylist()]
    counts = np.concatenate([x[0] for x in told] or [[]]).astype(np.int64)
    ids = np.concatenate([x[1] for x in told] or [[]]).astype(np.int64)
    seen, bucket = unpack(head["payload"])
    place = np.empty(len(bucket), np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    stops = np.cumsum(counts).tolist()
    names = list(map(str, ids.tolist()))
    said = [" ".join(names[a:b]).encode() for a, b in zip([0, *stops], stops, strict=False)]
    decoded = decode_words(ids, counts, path)
    at, n_tokens, hashes, texts = 0, [], [], []
    for k in head["counts"]:
        mine = place[seen[at : at + k]]
        at += k
        n_tokens.append(int(counts[mine].sum()))
        mine = mine.tolist()
        hashes.append(hashlib.sha256(b" ".join([said[i] for i in mine])).hexdigest())
        texts.append(hashlib.sha256(b"".join([decoded[i] for i in mine])).hexdigest())
    return pa.table([pa.array(head["doc_ids"], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs`.

    A null text is empty and has no ids. Repeated rows give repeated results; a null doc_id stays null. Other columns
    are ignored. Empty input: empty result.
    """
    # A bucket's words are one group in memory: as many buckets as keep it small, whatever the shuffle partitions are.
    n = 1 + (docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // BUCKET_BYTES
    known = tokens.vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task(__name__, "explode", pattern, n), ROWS)
    # Positions, the bulk, stay where they are written; only words and their ids move.
    rows = bucketed(rows, "block", buckets(docs.sparkSession), "pre-tokens")
    words, positions = rows.where(F.col("bucket") != POSITIONS), rows.where(F.col("bucket") == POSITIONS)
    encoded = words.groupBy("bucket").applyInArrow(task(__name__, "encode_bucket", known, pattern), ROWS)
    both = positions.groupBy("block").cogroup(encoded.groupBy("block"))
    return both.applyInArrow(task(__name__, "assemble", known, two=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
