"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted or deleted letter have letter counts at a squared distance of 1, by one replaced letter
at 2. Words are dealt to cells by their length and by how many of their letters fall into each of a few groups of letters,
so that near words lie in cells one step apart: a length block meets the blocks of its own and the next length, and of
these only the cells that can hold near words. Cells are cut into blocks of a bounded size. For each pair of blocks one
NumPy product of their count matrices gives all squared distances; what is close enough is compared letter by letter, and
only a number and a best neighbour for each word leave the task, so pairs are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manifoldry.llm.common import materialise, read, task

#: What a word may consist of; only A-Z are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[a-zÀ-ÿ]+"
#: Planted slips: a word of a document loses a letter where the checksum of both is divisible by this.
SLIP = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form has at least so many times the word's occurrences.
RATIO = 2
#: Groups of letters, whose counts make a word's cell; all other letters are one more group.
GROUPS = ("aeiou", "bcdfg", "hjklm", "npqrs")
#: Words in a block. A Gram matrix of two blocks has so many rows and columns.
BLOCK = 2048
NEAR = "word string, n_near long, best_n long, best string"


def slipped(run: Column, h: Column) -> Column:
    """`run` without the code point h % length where SLIP divides `h`."""
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words of at least LEAST_LETTERS letters that occur LEAST_COUNT times.

    A null text has no words; a null doc_id counts as an empty one in the checksum; repeated rows count each time.
    """
    text = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("run"))
    # Only a run of so many letters can be a word; shorter ones end here, before the checksum.
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    words = runs.where(F.char_length("run") >= LEAST_LETTERS).select(slipped(F.col("run"), h).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _steps() -> list[tuple[int, ...]]:
    """Steps (length, groups...) between cells of near words, one of each pair of opposite ones; the first is no step."""
    k = len(GROUPS)
    unit = [tuple(int(i == j) for j in range(k)) for i in range(k)]
    none = (0,) * k
    moves = {none} | {tuple(a - b for a, b in zip(x, y, strict=True)) for x in [*unit, none] for y in [*unit, none]}
    same = {m for m in moves if m > none} | {none}
    return sorted((0, *m) for m in same) + [(1, *m) for m in [none, *unit]]


def blocks(words: DataFrame) -> DataFrame:
    """(length, groups..., block, words, counts): the words of each cell in blocks of about BLOCK."""
    cell = ["length", *[f"g{i}" for i in range(len(GROUPS))]]
    placed = words.select("word", "n", F.char_length("word").alias("length"), *[F.char_length(F.regexp_replace("word", f"[^{g}]", "")).alias(f"g{i}") for i, g in enumerate(GROUPS)])
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = placed.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    return dealt.groupBy(*cell, "block").agg(F.collect_list(F.struct("word", "n")).alias("rows")).select(*cell, "block", F.col("rows.word").alias("words"), F.col("rows.n").alias("counts"))


def block_pairs(cut: DataFrame) -> DataFrame:
    """Pairs of blocks of cells that can hold near words, each pair once; a block also meets itself."""
    cell = [c for c in cut.columns if c not in ("block", "words", "counts")]
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(cell, s, strict=True)]) for s in _steps()])
    left = cut.withColumn("step", F.explode(steps)).select(*[(F.col(c) + F.col(f"step.{c}")).alias(c) for c in cell], F.forall(F.array(*[F.col(f"step.{c}") for c in cell]), lambda x: x == 0).alias("same"), F.col("block").alias("a"), F.col("words").alias("left"), F.col("counts").alias("left_n"))
    right = cut.select(*cell, F.col("block").alias("b"), F.col("words").alias("right"), F.col("counts").alias("right_n"))
    met = left.join(right, cell).where(~F.col("same") | (F.col("a") <= F.col("b")))
    return met.select((F.col("same") & (F.col("a") == F.col("b"))).alias("itself"), "left", "left_n", "right", "right_n")


def letters(words: list[str]) -> np.ndarray:
    """Code points, a row for each word; all words have one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def count_matrix(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each letter of `alphabet` is in each word; sums of products stay exact."""
    kind = np.float32 if codes.shape[1] < 2048 else np.float64
    at = np.searchsorted(alphabet, codes) + np.arange(len(codes))[:, None] * len(alphabet)
    return np.bincount(at.ravel(), minlength=len(codes) * len(alphabet)).reshape(len(codes), -1).astype(kind)


def near_pairs(left: list[str], right: list[str], itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words one edit apart. The right words are as long as the left ones or one letter longer."""
    a, b = letters(left), letters(right)
    alphabet = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    x, y = count_matrix(a, alphabet), count_matrix(b, alphabet)
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    longer = b.shape[1] > a.shape[1]
    i, j = np.nonzero(distance == (1 if longer else 2))
    if itself:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // a.shape[1])
    for at in range(0, len(i), step):
        p, q = a[i[at : at + step]], b[j[at : at + step]]
        if longer:  # equal up to some letter, and from it on one place later
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            good[at : at + step] = head + tail >= p.shape[1]
        else:
            good[at : at + step] = (p != q).sum(1) == 1
    return i[good], j[good]


def _best(words: list[str], near: np.ndarray, of: list[str], n: np.ndarray, by: np.ndarray) -> tuple[list, list, list, list]:
    """For each word with near ones: how many, and the most frequent of them, of equal ones the first in code-point order."""
    rank = np.empty(len(of), np.int64)
    rank[sorted(range(len(of)), key=of.__getitem__)] = np.arange(len(of))
    order = np.lexsort((rank[by], -n[by], near))
    near, by = near[order], by[order]
    first = np.flatnonzero(np.diff(near, prepend=-1))
    count = np.diff(np.append(first, len(near)))
    return [words[k] for k in near[first].tolist()], count.tolist(), n[by[first]].tolist(), [of[k] for k in by[first].tolist()]


def compare(batches):
    """For each pair of blocks: a row (word, n_near, best_n, best) for each word with near ones, on both sides."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right = row["left"], row["right"]
            i, j = near_pairs(left, right, row["itself"])
            if not len(i):
                continue
            n, m = np.array(row["left_n"], np.int64), np.array(row["right_n"], np.int64)
            if row["itself"]:
                sides = [_best(left, np.concatenate([i, j]), left, n, np.concatenate([j, i]))]
            else:
                sides = [_best(left, i, right, m, j), _best(right, j, left, n, i)]
            for made in sides:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for the rows (word, n) that have near words."""
    met = block_pairs(materialise(blocks(words), "letter-blocks"))
    # The columns of the join are large and its rows few: a batch is a few pairs of blocks.
    found = met.mapInArrow(task(__name__, "compare"), NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row (word, form): forms followed to the last, twice as far in each round.

    Occurrences at least double from a word to its form, so there is no circle and a handful of rounds do.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        now = materialise(now.join(further, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of `docs` (see `word_counts`). Empty input: empty result.

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is its most frequent
    near word, of equal ones the first in code-point order, if that has RATIO times its occurrences; else null. Words of
    any length take part; a block of very long words is compared in slices. Other columns are ignored.
    """
    words = materialise(word_counts(docs), "words")
    near = near_words(words)
    has = F.col("best_n") >= RATIO * F.col("n")
    judged = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    up = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


#: Near words by equal rests: an inserted letter leaves the shorter word, a replaced one the same rest at the same place.
SQL = r"""
WITH table_of AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x::BIGINT)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY id, run),
summed AS (SELECT run, n, xor(list_reduce(range(length(x) // 2), lambda c, k: xor(c // 256, t[xor(c % 256, ('0x' || x[2 * k + 1 : 2 * k + 2])::BIGINT) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM counted, table_of),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
rests AS (SELECT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM rests a JOIN rests b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.m = b.m) END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
up AS (WITH RECURSIVE step AS (SELECT word, word AS at FROM formed UNION ALL SELECT s.word, f.form FROM step s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL) SELECT s.word, s.at AS root FROM step s JOIN formed f ON f.word = s.at WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, u.root FROM formed f JOIN up u ON u.word = f.word
"""
