"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A sequence of pieces is what merging gives if and only if each two that stand side by side are what merging gives for
those two alone. So a text is encoded from left to right: the longest piece that starts here, found for all positions in
one pass of an Aho-Corasick automaton, is taken if it goes with the piece before it; if not, a shorter one; if none
does, the position is marked as failed in a bit field and the piece before it gives way. Whether two pieces go together
is found by undoing their merges, the latest first, and looking for a merge across the border that would have come first.

No piece of a model that splits at white space has a space after something else, and there are other characters that no
piece has after a letter. Texts fall apart there without any change to the result, and a distinct part is encoded and
decoded once for as long as a worker remembers it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.common import read, task

SPACE = "▁"
#: Kinds of pieces in the model file (fixed values of its format).
NORMAL, BYTE = 1, 6
#: The model type and the fields that are read (fixed values of the format): trainer.model_type, normalizer settings.
BPE = 2
#: Parts remembered between blocks: so many new ones, then these are the old ones. Pairs of pieces; all go when there are so many.
REMEMBERED, PAIRS = 250_000, 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            yield key >> 3, data[at : at + 8]
            at += 8


def read_model(path: str) -> dict:
    """Pieces (text, score, id), ids of the bytes, and whether a space is put before a text. Models that need more than this are refused."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    found, coded = [], {}
    for number, (key, value) in enumerate((k, v) for k, v in message if k == 1):
        piece = dict(_fields(value))
        kind = piece.get(3, NORMAL)
        if kind == NORMAL:
            found.append((piece[1].decode(), piece.get(2, 0.0), number))
        elif kind == BYTE:
            coded[int(piece[1][3:5], 16)] = number
        elif kind not in (2, 3):
            raise ValueError("pieces of users and unused pieces are not supported")
    trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
    normal = dict(_fields(next((v for k, v in message if k == 3), b"")))
    if trainer.get(3, 1) != BPE or len(coded) != 256:
        raise ValueError("the model must be of the merge type with bytes for unknown characters")
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24):
        raise ValueError("the model must leave texts and white space as they are")
    if any(re.search(f"[^{SPACE}]{SPACE}", text) for text, _, _ in found):
        raise ValueError("the model's pieces must not span words")
    return {"pieces": found, "bytes": [coded[i] for i in range(256)], "prefix": bool(normal.get(3, 1))}


def merge(text: str, order: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging of a short text, best first and then leftmost: what is left, and the last merge."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((order[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in order), default=None)
        if best is None:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = ["".join(last)]
    return parts, last


def prepare(model: dict) -> dict:
    """Tables that the driver makes once and every task gets: merge order, halves and next shorter piece of each piece."""
    rank = {score: k for k, score in enumerate(sorted({s for _, s, _ in model["pieces"]}, reverse=True))}
    order = {text: rank[score] for text, score, _ in model["pieces"]}
    halves = {}
    for text in order:
        if len(text) > 1:
            left, last = merge(text, order)
            if left == [text]:  # a piece that its own merges do not lead to never comes up
                halves[text] = last
    # Marks: ASCII characters that stand in pieces only at the beginning, after a space or after another mark.
    marks = {c for text in order for c in text if c.isascii() and not c.isalnum()}
    while out := {b for text in order for a, b in zip(text, text[1:], strict=False) if b in marks and a != SPACE and a not in marks}:
        marks -= out
    shorter = {text: next((text[:k] for k in range(len(text) - 1, 1, -1) if text[:k] in halves), text[0]) for text in halves}
    return {"order": order, "halves": halves, "shorter": shorter, "ids": {text: i for text, _, i in model["pieces"]}, "bytes": model["bytes"], "prefix": model["prefix"], "marks": "".join(sorted(marks))}


class Coder:
    """Encodes and decodes with the tables of `prepare`."""

    def __init__(self, tables: dict):
        import ahocorasick

        self.order, self.halves, self.shorter = tables["order"], tables["halves"], tables["shorter"]
        self.ids, self.bytes, self.prefix = tables["ids"], tables["bytes"], tables["prefix"]
        self.find = ahocorasick.Automaton()
        for piece in self.halves:
            self.find.add_word(piece, (len(piece) - 1, piece))
        self.find.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.room = PAIRS
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        marks = re.escape(tables["marks"])
        self.cut = re.compile(f"{SPACE}+[{marks}]*[^{SPACE}{marks}]*|[{marks}]+[^{SPACE}{marks}]*|[^{SPACE}{marks}]+" if marks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.surface = {i: text.replace(SPACE, " ").encode() for text, i in self.ids.items()}
        self.surface |= {i: bytes([b]) for b, i in enumerate(self.bytes)}

    def goes(self, left: str, right: str) -> bool:
        """Whether merging leaves these two side by side; remembered."""
        if self.room == 0:
            for row in self.pairs.values():
                row.clear()
            self.room = PAIRS
        self.room -= 1
        known = self.pairs[left][right] = self._goes(left, right)
        return known

    def _goes(self, left: str, right: str) -> bool:
        order, halves = self.order, self.halves
        # Where both are single characters nothing is left to undo. `before`: a merge across must be earlier than this.
        before = len(order)
        when_left, when_right = (order[left] if left in halves else -1), (order[right] if right in halves else -1)
        while True:
            across = order.get(left + right)
            if across is not None and across < before:
                return False
            if when_left < 0 and when_right < 0:
                return True
            if when_left > when_right:
                before = when_left
                left = halves[left][1]
                when_left = order[left] if left in halves else -1
            else:
                before = when_right + 1  # of equal merges the left one comes first
                right = halves[right][0]
                when_right = order[right] if right in halves else -1

    def split(self, part: str) -> list[str]:
        """The pieces and single characters that merging leaves of a text."""
        n, longest = len(part), list(part)
        for end, (back, piece) in self.find.iter(part):
            longest[end - back] = piece  # ends rise, so that the longest comes last
        failed, out, at, shorter, pairs = bytearray(n + 1), [], 0, self.shorter.get, self.pairs
        piece, row = longest[0] if n else None, None
        while at < n:
            while piece is not None:
                if not failed[at + len(piece)]:
                    if row is None:
                        break
                    goes = row.get(piece)
                    if goes or (goes is None and self.goes(out[-1], piece)):
                        break
                piece = shorter(piece)
            if piece is None:
                failed[at] = 1
                piece = out.pop()
                row = pairs[out[-1]] if out else None
                at -= len(piece)
            else:
                out.append(piece)
                row = pairs[piece]
                at += len(piece)
                piece = longest[at] if at < n else None
        return out

    def encode_part(self, part: str) -> list[int]:
        out = []
        for piece in self.split(part):
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.bytes[b] for b in piece.encode()]
        return out

    def decode_ids(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def parts(self, text: str) -> list[str]:
        """A text with its spaces as the model has them, cut before each run of spaces, and of marks that follow other characters."""
        text = text.replace(" ", SPACE)
        if self.prefix and text:
            text = SPACE + text
        return self.cut(text)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.encode_part(part)]

    def decode(self, ids: list[int]) -> str:
        out = self.decode_ids(ids)
        return (out[1:] if self.prefix and out.startswith(b" ") else out).decode()

    def learn(self, part: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, the decoded text."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        got = self.older.get(part)
        if got is None:
            ids = self.encode_part(part)
            got = (len(ids), ",".join(map(str, ids)), self.decode_ids(ids).decode())
        self.known[part] = got
        return got

    def digests(self, text: str) -> tuple[int, str, str]:
        made = []
        for part in self.parts(text):
            made.append(self.known.get(part) or self.learn(part))
        n, ids, back = zip(*made, strict=True) if made else ((0,), ("",), ("",))
        back = "".join(back)
        if self.prefix and back.startswith(" "):
            back = back[1:]
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


_made: dict[str, Coder] = {}


def _coder(key: str, tables) -> Coder:
    """The coder of these broadcast tables; a worker makes it once."""
    if key not in _made:
        _made.clear()
        _made[key] = Coder(tables.value)
    return _made[key]


def code_blocks(batches, key, tables):
    coder = _coder(key, tables)
    for block in tokens.blocks(batches):
        made = [coder.digests(text or "") for text in block.column("text").to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_blocks(batches, key, tables):
    coder = _coder(key, tables)
    for block in tokens.blocks(batches):
        ids = pa.array([coder.encode(text or "") for text in block.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), ids], ["doc_id", "ids"])


def decode_blocks(batches, key, tables):
    coder = _coder(key, tables)
    for block in batches:
        text = pa.array([coder.decode(ids or []) for ids in block.column("ids").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), text], ["doc_id", "text"])


def _task(name: str, rows: DataFrame, path: str):
    # A vocabulary: its size does not follow the data. The file is read here, so workers need not have it.
    return task(__name__, name, path, rows.sparkSession.sparkContext.broadcast(prepare(read_model(path))))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for each row of `docs`, as the library encodes `text` without begin and end ids.

    A null text is empty and has no ids. Repeated rows give repeated results; a null doc_id stays null. Other columns
    are ignored. Empty input: empty result. A text of any length is one value, and a stretch of it without white space
    is encoded in time that follows its length.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_task("encode_blocks", docs, path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row (doc_id, ids). Null ids give an empty text."""
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_task("decode_blocks", coded, path), "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to; rows as in `encode`."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_task("code_blocks", docs, path), SCHEMA)


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
