"""Collocations of 2 to 5 words from a weighted de Bruijn graph.

Texts fall into pieces at punctuation, pieces into words. An edge of the graph is a run of five words: it leads from its
first four words to its last four, and weighs as often as it occurs. Runs that a piece's end cuts short are kept as they
are: they correct the flow of the nodes that they end in. A shorter phrase occurs as often as all edges and cut runs that
begin with it weigh together, so that one table of edges gives all counts. Words with fewer occurrences than a phrase
must have end runs as a piece's end does, since no phrase that counts holds one.

Blocks of texts number their words and send distinct ones, packed, to buckets by a hash; there they are counted, and the
frequent ones' ids go back to the blocks. Each block's edges are summed in the block and dealt to buckets by their first
two words, where equal ones meet and flows are summed over sorted edges. A
pair of words that holds a large share of a block would overfill its bucket: its edges are dealt by all five words, its
flows come out in parts, and a mark sent after it keeps the rest of that pair from being cut off before the parts are
added up. Where a phrase flows into one longer phrase as a whole, only the end of that unary path is written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.llm import tokens
from manifoldry.llm.bpe import pack, unpack
from manifoldry.llm.common import materialise, read, task

#: Bytes (fixed values) that end a piece and that separate words in one.
ENDS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
LONGEST, LEAST, TOP = 5, 100, 2000
NO_LANG = "und"
#: Bytes of text in a block, which is of one language; blocks that grow at the same time in a task; bytes to a bucket of words.
BLOCK_BYTES, GROWING, WORD_BYTES = 16_000_000, 48_000_000, 32_000_000
#: Edges in a bucket, about; a pair of words with more than this part of a block's edges is dealt by whole edges.
BUCKET, SHARE = 1_500_000, 256
#: A block's words in order have this bucket, its distinct words buckets from 0.
ORDER = -1
BLOCKS = "block string, lang string, bucket int, n long, payload binary"
WORDS = "block string, bucket int, payload binary, lang string, words array<string>, f array<long>, ids array<long>"
EDGES = "bucket int, lang string, kind int, payload binary"
#: Kinds of rows: edges by their first two words, edges by all words, pairs that have edges of the second kind.
LIGHT, HEAVY, MARK = 0, 1, 2
PATHS = "lang string, ids array<long>, shortest int, n long, whole boolean"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of all texts: the number of each word from 1, with a 0 between pieces, and the distinct words; A-Z are lower-cased."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1] - offsets[0]] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    piece = np.cumsum((kind == 2) + first[:-1].astype(np.int8), dtype=np.int64)[begins]
    length = np.concatenate([[0], np.cumsum(stops - begins)]).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(length.tobytes()), pa.py_buffer(data[kind == 0].tobytes())])
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64) + 1
    return np.insert(code, np.flatnonzero(np.diff(piece)) + 1, 0), coded.dictionary


def by_language(batches):
    """(language, texts) of up to BLOCK_BYTES; what is waiting for more of its language is bounded."""
    waiting: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in tokens.blocks(batches, BLOCK_BYTES // 4):
        for lang in pc.unique(batch.column("lang")).to_pylist():
            mine = batch.filter(pc.equal(batch.column("lang"), lang)).column("text")
            waiting.setdefault(lang, []).append(mine.cast(pa.large_string()))
            size[lang] = size.get(lang, 0) + (pc.sum(pc.binary_length(mine)).as_py() or 0)
        while size and (max(size.values()) >= BLOCK_BYTES or sum(size.values()) >= GROWING):
            most = max(size, key=size.__getitem__)
            del size[most]
            yield most, pa.concat_arrays(waiting.pop(most))
    for lang in list(waiting):
        yield lang, pa.concat_arrays(waiting.pop(lang))


def number(batches, n_buckets: int):
    """For each block: a row of its words in order, and a row of distinct words with their counts for each bucket that has some."""
    from pyspark import TaskContext

    partition, made = TaskContext.get().partitionId(), 0
    for lang, column in by_language(batches):
        seen, distinct = words_of(column)
        counts = np.bincount(seen, minlength=len(distinct) + 1)[1:]
        # Frequent words get small numbers, whose bytes compress well.
        often = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(distinct) + 1, np.int64)
        rank[often + 1] = np.arange(1, len(distinct) + 1)
        words, counts = distinct.take(pa.array(often)).to_pylist(), counts[often]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        name = f"{partition}-{made}"
        made += 1
        rows = [(name, lang, ORDER, int(counts.sum()), pack(rank[seen], bucket))]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            at = order[start:stop]
            mine = [words[i] for i in at.tolist()]
            lengths = np.fromiter(map(len, mine), np.int64, len(mine))
            rows.append((name, lang, int(bucket[at[0]]), 0, pack(lengths, counts[at], np.frombuffer(b"".join(mine), np.uint8))))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "lang", "bucket", "n", "payload"])


def count_words(table: pa.Table, n_buckets: int, least: int) -> pa.Table:
    """All words of a bucket: ids for each block's, 0 for words that are not frequent; and a row of the frequent ones of each language."""
    rows = []
    for lang in sorted(pc.unique(table.column("lang")).to_pylist()):
        mine = table.filter(pc.equal(table.column("lang"), lang))
        lists, counts = [], []
        for payload in mine.column("payload").to_pylist():
            lengths, n, letters = unpack(payload)
            stops = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            lists.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(letters.astype(np.uint8).tobytes())]))
            counts.append(n)
        coded = pa.concat_arrays(lists).dictionary_encode()
        code = coded.indices.to_numpy()
        f = np.bincount(code, np.concatenate(counts)).astype(np.int64)
        frequent = np.flatnonzero(f >= least)
        words = coded.dictionary.take(pa.array(frequent)).to_pylist()
        order = sorted(range(len(words)), key=lambda i: (-f[frequent[i]], words[i]))
        # Ids are the same whenever this runs; those of a bucket and language are next to none of another.
        first = sum(len(r[4]) for r in rows if r[4])
        ids = np.zeros(len(f), np.int64)
        ids[frequent[order]] = 1 + table.column("bucket")[0].as_py() + n_buckets * (first + np.arange(len(order)))
        if len(order) and ids.max() >= 1 << 32:
            raise ValueError("more frequent words than 32-bit numbers")
        at = 0
        for block, n in zip(mine.column("block").to_pylist(), counts, strict=True):
            rows.append((block, table.column("bucket")[0].as_py(), pack(ids[code[at : at + len(n)]]), lang, None, None, None))
            at += len(n)
        rows.append((None, table.column("bucket")[0].as_py(), None, lang, [words[i].decode() for i in order], f[frequent[order]].tolist(), ids[frequent[order]].tolist()))
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "bucket", "payload", "lang", "words", "f", "ids"])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five 32-bit columns as three keys that sort alike."""
    g = grams.astype(np.uint64)
    return g[:, 0] << np.uint64(32) | g[:, 1], g[:, 2] << np.uint64(32) | g[:, 3], g[:, 4]


def summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sum of `n` of each."""
    keys = _keys(grams)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return grams[order[first]], np.add.reduceat(n[order], first) if len(first) else n[:0]


def edges(left: pa.Table, right: pa.Table, n_buckets: int, share: int) -> pa.Table:
    """The edges of one block, from its words in order and the ids of those that are frequent."""
    head = left.to_pylist()[0]
    seen, bucket = unpack(head["payload"])
    told = np.concatenate([unpack(x)[0] for x in right.sort_by("bucket").column("payload").to_pylist()] or [[]])
    ids = np.zeros(len(bucket) + 1, np.uint32)
    ids[np.argsort(bucket, kind="stable") + 1] = told  # answers lie by bucket, and in it as the block's words do
    seen = np.concatenate([ids[seen.astype(np.int64)], np.zeros(LONGEST - 1, np.uint32)])
    at = np.flatnonzero((seen[:-1] != 0) & (seen[1:] != 0))
    grams = seen[at[:, None] + np.arange(LONGEST)] if len(at) else np.zeros((0, LONGEST), np.uint32)
    grams = np.where(np.logical_and.accumulate(grams != 0, axis=1), grams, 0)
    grams, n = summed(grams, np.ones(len(grams), np.int64))
    first, second, third = _keys(grams)
    begins = np.flatnonzero(np.diff(first, prepend=np.uint64(0)) != 0)
    weight = np.diff(np.append(begins, len(first)))
    heavy = np.repeat(weight > max(len(first) // share, 16), weight)
    seed = np.uint64(zlib.crc32(head["lang"].encode()))
    by_pair = mixed(first ^ seed)
    bucket = (np.where(heavy, mixed(by_pair ^ mixed(second) ^ third), by_pair) % np.uint64(n_buckets)).astype(np.int64)
    rows = []
    for kind in (LIGHT, HEAVY):
        mine = np.flatnonzero(heavy == (kind == HEAVY))
        mine = mine[np.argsort(bucket[mine], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[mine], prepend=-1)).tolist() + [len(mine)]
        rows += [(int(bucket[mine[a]]), head["lang"], kind, pack(*grams[mine[a:b]].T, n[mine[a:b]])) for a, b in zip(cuts, cuts[1:], strict=False)]
    for k in np.flatnonzero(heavy[begins] if len(begins) else []).tolist():
        i = begins[k]
        rows.append((int(by_pair[i] % np.uint64(n_buckets)), head["lang"], MARK, pack(grams[i, :2])))
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["bucket", "lang", "kind", "payload"])


def paths(grams: np.ndarray, n: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of at least `least` occurrences by flow over sorted edges: ends of unary paths, the shortest length on the path, occurrences."""
    out, (first, second, third) = [], _keys(grams)
    # For each length: where a phrase begins, and its flow there.
    change, flow = [], []
    new = np.zeros(len(grams), bool)
    new[:1] = True
    shifted = [(first, 0), (second, 32), (second, 0), (third, 0)]
    for k, (key, shift) in enumerate(shifted, 2):
        part = key >> np.uint64(shift)
        new = new.copy()
        new[1:] |= part[1:] != part[:-1]
        begins = np.flatnonzero(new)
        f = np.zeros(len(grams), np.int64)
        f[begins] = np.add.reduceat(n, begins) if len(begins) else 0
        f[grams[:, k - 1] == 0] = 0  # a run that ends before is no phrase of this length
        change.append(new)
        flow.append(f)
    shortest = np.full(len(grams), 2)
    for k in range(2, LONGEST + 1):
        f = flow[k - 2]
        on = flow[k - 1] == f if k < LONGEST else np.zeros(len(grams), bool)
        at = np.flatnonzero((f >= least) & ~on)
        out.append((grams[at, :k], shortest[at].copy(), f[at]))
        shortest = np.where(on, shortest, k + 1)
    return out


def flows(table: pa.Table, least: int) -> pa.Table:
    """All edges of a bucket: phrases that are frequent, and parts of those whose edges are in other buckets too."""
    out = {"lang": [], "ids": [], "shortest": [], "n": [], "whole": []}

    def put(lang, grams, shortest, n, whole):
        out["lang"].append(pa.array([lang] * len(n), pa.string()))
        starts = pa.array(np.arange(len(n) + 1) * grams.shape[1], pa.int32())
        out["ids"].append(pa.ListArray.from_arrays(starts, pa.array(grams.ravel().astype(np.int64))))
        out["shortest"].append(pa.array(shortest, pa.int32()))
        out["n"].append(pa.array(n, pa.int64()))
        out["whole"].append(pa.array([whole] * len(n), pa.bool_()))

    for lang in pc.unique(table.column("lang")).to_pylist():
        mine = table.filter(pc.equal(table.column("lang"), lang))
        got = {}
        for kind in (LIGHT, HEAVY, MARK):
            told = [unpack(x) for x in mine.filter(pc.equal(mine.column("kind"), kind)).column("payload").to_pylist()]
            if kind == MARK:
                marks = np.unique([int(x[0][0]) << 32 | int(x[0][1]) for x in told]).astype(np.uint64)
            elif told:
                columns = [np.concatenate(c) for c in zip(*told, strict=True)]
                got[kind] = summed(np.stack(columns[:LONGEST], axis=1), columns[LONGEST].astype(np.int64))
        for kind, (grams, n) in got.items():
            part = np.isin(_keys(grams)[0], marks) if kind == LIGHT else np.ones(len(n), bool)
            for found in paths(grams[~part], n[~part], least):
                put(lang, *found, True)
            for k in range(2, LONGEST + 1):  # prefixes of edges, each once
                cut, cut_n = grams[part][:, :k], n[part]
                cut, cut_n = cut[cut[:, k - 1] != 0], cut_n[cut[:, k - 1] != 0]
                wide = np.zeros((len(cut), LONGEST), np.uint32)
                wide[:, :k] = cut
                wide, cut_n = summed(wide, cut_n)
                put(lang, wide[:, :k], np.full(len(cut_n), k), cut_n, False)
    kinds = {"lang": pa.string(), "ids": pa.list_(pa.int64()), "shortest": pa.int32(), "n": pa.int64(), "whole": pa.bool_()}
    return pa.table({c: pa.chunked_array(out[c], kinds[c]) for c in kinds})


def phrase_counts(docs: DataFrame, least: int = LEAST, bucket: int = BUCKET, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id) and phrases (lang, ids, f) of at least `least` occurrences, and all word occurrences (lang, n)."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    n_words = 1 + (rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // WORD_BYTES
    blocks = materialise(rows.where("text is not null").mapInArrow(task(__name__, "number", n_words), BLOCKS), "blocks")
    counted = materialise(blocks.where(F.col("bucket") != ORDER).groupBy("bucket").applyInArrow(task(__name__, "count_words", n_words, least), WORDS), "words")
    words = counted.where("block is null").select("lang", F.explode(F.arrays_zip("words", "f", "ids")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.f").alias("f"), F.col("w.ids").alias("id"))
    answers = counted.where("block is not null").select(F.col("block").alias("of"), "bucket", "payload")
    asked = blocks.where(F.col("bucket") == ORDER).select("block", "lang", "n", "payload")
    n_buckets = 1 + (asked.agg(F.sum("n")).head()[0] or 0) // bucket
    made = asked.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(task(__name__, "edges", n_buckets, share, two=True), EDGES)
    found = materialise(made.groupBy("bucket").applyInArrow(task(__name__, "flows", least), PATHS), "paths")
    lengths = F.sequence("shortest", F.size("ids"))
    whole = found.where("whole").select("lang", F.explode(F.transform(lengths, lambda k: F.slice("ids", F.lit(1), k))).alias("ids"), F.col("n").alias("f"))
    parts = found.where("not whole").groupBy("lang", "ids").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return words, materialise(whole.unionByName(parts), "phrases"), asked.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, bucket: int = BUCKET, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, a, phrase.

    A null text has no words; a null language is NO_LANG. Repeated rows count each time. A phrase is dropped if a phrase one
    word longer occurs as often; longer ones than that need not be looked at, as the phrase between would too. Scores are
    exact (38 digits). Empty input: empty result. Other columns are ignored.
    """
    words, phrases, totals = phrase_counts(docs, least, bucket, share)
    size = F.size("ids")
    inner = phrases.where(size > 2).select("lang", F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    kept = phrases.join(inner, ["lang", "ids", "f"], "left_anti")
    known = phrases.unionByName(words.select("lang", F.array("id").alias("ids"), "f"))
    cuts = kept.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(known.select("lang", F.col("ids").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("ids").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("cast((1000BD * _a * _n) div (_l * _r) as long)"))
    best = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    scored = best.select("lang", "ids", "a", "n", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    # Words are looked up for what can be among the first; ties at the end stay until phrases decide.
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = scored.withColumn("place", F.rank().over(by)).where(F.col("place") <= top)
    named = first.select("lang", "ids", "a", "l", "r", "n", "score", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    named = named.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])))) AS p FROM said),
f AS (SELECT lang, p, count(*) AS f FROM runs GROUP BY lang, p HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM said GROUP BY lang),
phrases AS (SELECT * FROM f WHERE len(p) >= 2),
inside AS (SELECT lang, unnest([p[:-2], p[2:]]) AS p, f FROM phrases WHERE len(p) >= 3),
kept AS (SELECT * FROM phrases ANTI JOIN inside USING (lang, p, f)),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
