"""Byte-level BPE over blocks of texts.

A pre-token never holds a space after something that is not white space, so texts fall apart at such spaces. The parts
of a block are dictionary-encoded by Arrow, each distinct part is encoded once, and ids are gathered by position.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: All that the pre-token pattern may take for white space, and a little more.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Bytes of text in a block.
BLOCK_BYTES = 4_000_000


#: What drivers have broadcast, by application and path; what tasks were given, by path.
_sent: dict[tuple[str, str], object] = {}
_given: dict[str, object] = {}


def vocabulary(spark, path: str) -> tuple:
    """A rank file as tasks get it: read here and broadcast once, so that workers need not have it. Its size does not follow the data."""
    key = spark.sparkContext.applicationId, path
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(_ranks(path))
    return path, _sent[key]


def _known(path: str | tuple) -> str:
    """The path of a file, or of what `vocabulary` made of it; a worker keeps one copy for each path."""
    if isinstance(path, str):
        return path
    _given[path[0]] = path[1]
    return path[0]


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    if path in _given:
        return _given[path].value
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_lengths(path: str) -> np.ndarray:
    out = np.zeros(max(_ranks(path).values()) + 1, np.int64)
    for token, rank in _ranks(path).items():
        out[rank] = len(token)
    return out


def ranks(path: str | tuple) -> dict[bytes, int]:
    return _ranks(_known(path))


def encoding(path: str | tuple, pattern: str):
    return _encoding(_known(path), pattern)


def token_lengths(path: str | tuple) -> np.ndarray:
    return _token_lengths(_known(path))


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a `tokenizers` file, which are matched in the text as it is."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is around them are not supported")
    return {t["content"]: t["id"] for t in found}


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of its column `column`, and at least a row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def parts(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Distinct parts, the code of each part of each text, and where each text's codes start.

    The first `n` distinct parts, n the last value, can be encoded as one string joined without a gap; others only one by one.
    """
    texts = _texts(column)
    whole = pc.match_substring_regex(texts, f"[{WHITE}] ")
    split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    starts = split.offsets.to_numpy()
    starts = (starts - starts[0]).astype(np.int64)
    flat = split.flatten()
    # The first part of a text has no space before it; a text that cannot be split is its own only part.
    heads = pc.if_else(whole, texts, flat.take(pa.array(starts[:-1])))
    coded, head = flat.dictionary_encode(), heads.dictionary_encode()
    bare = pc.match_substring_regex(coded.dictionary, f"^$|^[{WHITE}]|[{WHITE}]$")
    order = np.argsort(np.asarray(bare), kind="stable")
    moved = np.empty(len(order), np.int64)
    moved[order] = np.arange(len(order))
    code = moved[coded.indices.to_numpy()]
    code[starts[:-1]] = len(order) + head.indices.to_numpy()
    spaced = [" " + part for part in coded.dictionary.take(pa.array(order)).to_pylist()]
    return spaced + head.dictionary.to_pylist(), code, starts, len(order) - pc.sum(bare).as_py()


def spread(values: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The slices values[start[c] : start[c] + length[c]] for each c of `code`, one after another."""
    n = length[code]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start[code] - (ends - n), n) + np.arange(total)]


class Coder:
    """Encodes blocks of texts with one vocabulary."""

    def __init__(self, path: str | tuple, pattern: str):
        self.path, self.enc, self.length = path, encoding(path, pattern), token_lengths(path)

    def encode_parts(self, distinct: list[str], joined: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all distinct parts, and each part's start and length in them."""
        ids = np.array(self.enc.encode_ordinary("".join(distinct[:joined])), np.uint32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in distinct[:joined]), np.int64, joined))
        starts = [np.searchsorted(np.cumsum(self.length[ids]), ends, side="right")]
        alone = [self.enc.encode_ordinary(p) for p in distinct[joined:]]
        n = np.fromiter(map(len, alone), np.int64, len(alone))
        stop = np.concatenate([starts[0], len(ids) + np.cumsum(n)]).astype(np.int64)
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        tail = np.fromiter((i for x in alone for i in x), np.uint32, int(n.sum()))
        return np.concatenate([ids, tail]), start, stop - start

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the id `end`, and where each text starts and the last one stops."""
        distinct, code, starts, joined = parts(column)
        ids, start, length = self.encode_parts(distinct, joined)
        start, length = np.append(start, len(ids)), np.append(length, 1)
        code = np.insert(code, starts[1:], len(start) - 1)
        out = spread(np.append(ids, np.uint32(end)), start, length, code)
        text_ends = starts[1:] + np.arange(1, len(starts))
        n = np.concatenate([[0], np.cumsum(length[code])])
        return out, np.concatenate([[0], n[text_ends]]).astype(np.int64)

    def encode_with(self, column: pa.Array, end: int, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, with the ids of `added` where these stand in the texts; what is between them is encoded by itself."""
        texts = _texts(column)
        token = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
        if not added or not pc.any(pc.match_substring_regex(texts, token)).as_py():
            return self.encode(column, end)
        # Each stretch is encoded with `end` after it, which then gives way to the added token that stood there.
        stretches, after, last = [], [], []
        for text in texts.to_pylist():
            cut = re.split(f"({token})", text)
            stretches += cut[::2]
            after += [*(added[t] for t in cut[1::2]), end]
            last.append(len(stretches))
        ids, starts = self.encode(pa.array(stretches, pa.large_string()), end)
        ids[starts[1:] - 1] = after
        return ids, starts[[0, *last]]
