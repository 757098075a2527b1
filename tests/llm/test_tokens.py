"""Token coding, counts and packing against the tokenizer libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from manifoldry.llm import bpe, packing, token_counts, tokens

PATH = P.path("byte_bpe_50k.tiktoken")
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
HF.encode_special_tokens = True
ODD = ["", "  ", "a  b", "\n\n x", " lead", "trail ", "a \n\n b\n", "don't it's 12 345", "\u65e5\u672c \u8a9e  text", "emoji \U0001f600 \u200b z", "a\x1c b", "<|endoftext|> x", "tab\t y", "\u3000x y", "a\r\n b c\n", "x\n", " \n", None, "\x85 y q", "aaaa" * 5000, "word " * 20_000]
SCHEMA = "doc_id long, text string, piece string, block string, start string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "b", "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def ids(text):
    return HF.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab '1\n\t\r.,!\u00e9\u00a0\u2003\u200b\x1c\x85\u3000\u65e5")), max_size=25), min_size=1, max_size=8))
def test_coder_equals_the_library(texts):
    coder = tokens.Coder(PATH, P.PATTERN)
    out, at = coder.encode(pa.array(texts), 0)
    assert [out[a : b - 1].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids(t) for t in texts]


def test_bpe_round_trip(spark):
    got = bpe.encode_digests(frame(spark, [*ODD, *ODD]), PATH, P.PATTERN).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        t = [*ODD, *ODD][r.doc_id]
        assert r.n_tokens == len(ids(t))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids(t))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(frame(spark, []), PATH, P.PATTERN).count() == 0
    assert [r.n_tokens for r in bpe.encode_digests(frame(spark, ["", None]), PATH, P.PATTERN).collect()] == [0, 0]


def test_packing(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["a", "bc", "def", "xyzzy"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    rows = packing.pack(frame(spark, texts), PATH, P.PATTERN).collect()
    places, total = defaultdict(list), Counter()
    for r in rows:
        want = [*ids(texts[r.doc_id]), 0]
        part = want[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 2048
        places[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
    assert all(total[i] == len(ids(t)) + 1 for i, t in enumerate(texts))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    bins = []  # first fit, longest first
    for length in sorted((r.length for r in rows), reverse=True):
        at = next((i for i, used in enumerate(bins) if used + length <= 2048), None)
        bins.append(length) if at is None else bins.__setitem__(at, bins[at] + length)
    assert -(-sum(total.values()) // 2048) <= len(places) <= len(bins)
    assert packing.pack(frame(spark, []), PATH, P.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
def test_plans_use_every_piece_once(counts):
    used = Counter()
    for times, shape in packing.plan(counts, 50):
        assert times > 0 and sum(shape) <= 50
        used.update({x: n * times for x, n in Counter(shape).items()})
    assert used == Counter(counts)


def test_two_pieces_fit_better_than_one():
    # Greedy: 60 + 30, gap 10; two of 20 fill what the 30 leaves.
    assert packing.plan({60: 1, 30: 1, 20: 2}, 100)[0] == (1, [60, 20, 20])


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_counts_across_splits(spark, tmp_path, split):
    """Files are cut anywhere, also amid an id; ids whose bytes look like the end id across two ids do no harm."""
    texts = [*ODD[:19], "tail", "tail"]
    out = str(tmp_path / "tokens")
    token_counts.write_token_files(frame(spark, texts), out, PATH, P.PATTERN)
    rng = random.Random(split)
    tricky = [rng.choice([0x50C4, 0xC450, 0x5050, 0xC4C4, 7]) for _ in range(400)]
    (tmp_path / "tokens" / "part-99999-tricky.txt").write_bytes(np.array(tricky, "<u2").tobytes())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = token_counts.count_tokens(spark, out).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    written = [r for r in rows if "tricky" not in r.file]
    assert sorted(r.n_tokens for r in written) == sorted(len(ids(t)) for t in texts) and all(r.ended for r in written)
    by = defaultdict(list)
    for r in rows:
        by[r.file].append((r.doc_no, r.start, r.n_tokens))
    for docs in by.values():
        at = 0
        for no, (doc_no, start, n) in enumerate(sorted(docs)):
            assert (doc_no, start) == (no, at)
            at += n + 1
    want, n = [], 0
    for x in tricky:
        if x == 0xC450:
            want.append(n)
            n = 0
        else:
            n += 1
    want += [n] if n else []
    assert [n for _, _, n in sorted(by["part-99999-tricky.txt"])] == want


def test_counts_of_an_open_end(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = token_counts.count_tokens(spark, str(tmp_path)).orderBy("doc_no").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in rows] == [(0, 2, True), (3, 0, True), (4, 3, False)]
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark, str(tmp_path), end=0x0505)


def test_counts_carry_document_ids(spark, tmp_path):
    texts = [*ODD, "again", "again"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = token_counts.op2(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(ids(t)) for i, t in enumerate(texts)} and len(rows) == len(texts)
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert token_counts.op2(spark, str(tmp_path / "none")).count() == 0


def test_counts_with_a_limit_of_rows_a_file(spark, tmp_path):
    texts = [f"text {i} " * (i % 7) for i in range(120)]
    docs = spark.createDataFrame([(i % 50, t, "p", "d", "s") for i, t in enumerate(texts)], "doc_id long, text string, part string, doc_no string, start string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        rows = token_counts.op2(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i % 50, len(ids(t))) for i, t in enumerate(texts))


def test_counts_that_do_not_pair_off_are_an_error(spark, tmp_path):
    docs = frame(spark, ["a", "b", "c", "d", "e"]).coalesce(1)
    token_counts.write_token_files(docs, str(tmp_path / "t"), PATH, P.PATTERN)
    counted = token_counts.count_tokens(spark, str(tmp_path / "t"))
    assert token_counts.paired(counted, token_counts.document_ids(docs)).count() == 5
    with pytest.raises(ValueError, match="pair off"):
        token_counts.paired(counted, token_counts.document_ids(docs.limit(4).coalesce(1)))
    with pytest.raises(ValueError, match="pair off"):
        token_counts.paired(counted, token_counts.document_ids(docs.repartition(2)))


def test_packing_codes_added_tokens_as_the_library_does(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    added = tokens.added_tokens(P.path("byte_bpe_50k.json"))
    texts = [*ODD[:19], "a <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|> b", "x<|endoftext|>", " <|endoftext|>\n\n y  ", "<|endoftext|", "<|endoftext|> word" * 3000]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert want[19] == [64, 220, 50256, 2124, 0]
    rows = packing.pack(frame(spark, texts), PATH, P.PATTERN, added=added).collect()
    total = Counter()
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
    assert [total[i] for i in range(len(texts))] == [len(w) for w in want]


def test_registered_packing_codes_added_tokens(spark, tmp_path):
    frame(spark, ["a <|endoftext|> x"]).write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = packing.op8(spark, str(tmp_path)).collect()
    assert (r.length, r.ids_crc32) == (5, zlib.crc32(np.array([64, 220, 50256, 2124, 0], "<u4").tobytes()))
