"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams, word ends included. N-grams hash to embedding rows; their mean goes
through a linear softmax. Rows and softmax are trained together in numpy on a bounded sample of labelled documents.
Misspellings share most n-grams with the word they come from. Scoring needs one number a row, the embedding's part
of the log odds, so a whole text of any length is read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manifoldry.llm import tokens
from manifoldry.llm.common import materialise, read, task

NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 20
DIM = 8
EPOCHS = 20
RATE = 0.5
#: Rows are trained for n-grams in at least so many documents, whose rates in the two classes are so many standard errors apart.
MIN_DOCS, MIN_Z = 3, 4.0
#: Empty n-grams added to every bag, so that a few n-grams cannot decide by themselves.
SMOOTH = 100
#: Most training documents of each class: the ones with the least hash of their id.
MAX_TRAIN = {0: 3000, 1: 1000}
THRESHOLD = 0.7
#: Toxic documents weigh so much of the training sample, whatever their share in it, so that scores mean the same at every size.
TOXIC_SHARE = 0.25
_SPAN = 1 << 20
_PRIME = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def _words(text: str) -> str:
    """Lower-cased words with one space between them."""
    return " ".join(text.lower().split())


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as code points, a space before each text and after the last; where each starts and the last stops."""
    low = [_words(t) for t in texts]
    cp = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    return cp, np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)


def _grams(cp: np.ndarray):
    """(start, bucket) arrays of the n-grams with no space inside, for each n."""
    solid = cp != 32
    h = cp * _PRIME
    h = (h ^ (h >> np.uint32(15))) * _SPREAD
    rolled, inside = h[:-1] * _PRIME + h[1:], solid[1:]
    for n in range(3, max(NGRAMS) + 1):
        if len(cp) < n:
            return
        rolled = rolled[:-1] * _PRIME + h[n - 1 :]
        ok = inside[: len(rolled)] if n == 3 else ok[:-1] & solid[n - 2 : len(cp) - 1]
        if n in NGRAMS:
            at = np.flatnonzero(ok)
            mixed = (rolled[at] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _SPREAD
            yield at, (mixed ^ (mixed >> np.uint32(13))) * _PRIME >> np.uint32(32 - BUCKET_BITS)


def _spans(cp: np.ndarray):
    """Pieces of a bounded number of n-gram starts: (offset, code points)."""
    reach = max(NGRAMS) - 1
    for s in range(0, len(cp), _SPAN):
        yield s, cp[s : s + _SPAN + reach]


def bags(batches):
    """doc_id, toxic, buckets, counts."""
    for batch in tokens.blocks(batches, 1):
        cp, _ = _code_points(["" if x is None else x for x in batch.column("text").to_pylist()])
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for s, part in _spans(cp):
            for at, bucket in _grams(part):
                total += np.bincount(bucket[at < _SPAN], minlength=len(total))
        used = np.flatnonzero(total)
        columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[used].astype(np.int32)], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "buckets", "counts"])


def shares(batches, kept: np.ndarray):
    """doc_id, toxic, at, share: a bag's n-grams that are in `kept`, by their place there, and their shares of the whole bag."""
    for batch in batches:
        at, share = [], []
        for buckets, counts in zip(batch.column("buckets"), batch.column("counts"), strict=True):
            buckets, counts = np.asarray(buckets.values), np.asarray(counts.values)
            place = np.searchsorted(kept, buckets)
            good = (place < len(kept)) & (kept[np.minimum(place, len(kept) - 1)] == buckets) if len(kept) else np.zeros(len(buckets), bool)
            at.append(place[good].astype(np.int32))
            share.append(counts[good] / (counts.sum() + SMOOTH))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float64()))], ["doc_id", "toxic", "at", "share"])


def train(share: list[tuple[int, np.ndarray, np.ndarray]], n: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Log-odds weight of each of `n` n-grams and the bias, from (label, n-grams, shares). AdaGrad over documents in random order."""
    positive = sum(y for y, _, _ in share)
    stress = (1.0, TOXIC_SHARE / (1 - TOXIC_SHARE) * (len(share) - positive) / positive)
    rng = np.random.default_rng(seed)
    emb, emb_sq = np.zeros((n, DIM)), np.full((n, DIM), 1e-12)
    out, out_sq = rng.normal(0, 0.5, (DIM, 2)), np.full((DIM, 2), 1e-8)
    bias, bias_sq = np.zeros(2), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(share)):
            y, buckets, weight = share[i]
            mean = weight @ emb[buckets]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= stress[y]
            g_emb = weight[:, None] * (out @ p)[None, :]
            g_out = np.outer(mean, p)
            emb_sq[buckets] += g_emb * g_emb
            emb[buckets] -= rate * g_emb / np.sqrt(emb_sq[buckets])
            out_sq += g_out * g_out
            out -= 0.2 * rate * g_out / np.sqrt(out_sq)
            bias_sq += p * p
            bias -= 0.2 * rate * p / np.sqrt(bias_sq)
    return emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def score_texts(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    cp, starts = _code_points(texts)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for s, part in _spans(cp):
        first = max(0, int(np.searchsorted(starts, s, side="right")) - 1)
        stop = min(len(texts), int(np.searchsorted(starts, s + _SPAN, side="left")))
        edges = np.clip(starts[first : stop + 1] - s, 0, _SPAN)
        for at, bucket in _grams(part):
            sums = np.concatenate([[0.0], np.cumsum(weight[bucket])])
            cuts = np.searchsorted(at, edges)
            total[first:stop] += np.diff(sums[cuts])
            n[first:stop] += np.diff(cuts)
    return 1 / (1 + np.exp(-np.clip(total / (n + SMOOTH) + bias, -60, 60)))


def score_batches(batches, kept: np.ndarray, values: np.ndarray, bias: float, name: str):
    weight = np.zeros(1 << BUCKET_BITS)
    weight[kept] = values
    for block in tokens.blocks(batches, 2_000_000):
        score = score_texts(["" if x is None else x for x in block.column("text").to_pylist()], weight, bias)
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(score)], [*block.schema.names, name])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def telling(bags_: DataFrame, n: int, positive: int) -> np.ndarray:
    """The n-grams that are kept, sorted: those in MIN_DOCS documents or more whose rates in the classes are MIN_Z errors apart."""
    counts = bags_.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("toxic").alias("docs_1"))
    rate = F.col("docs") / n
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / positive + 1 / (n - positive)))
    apart = F.abs(F.col("docs_1") / positive - (F.col("docs") - F.col("docs_1")) / (n - positive)) / error
    kept = counts.where((F.col("docs") >= MIN_DOCS) & (apart >= MIN_Z)).select("bucket").toArrow()  # at most all buckets
    return np.sort(kept.column("bucket").to_numpy())


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """n-grams, their weights and the bias, from labelled documents that are not held out: at most MAX_TRAIN of each class.

    Their bags stay in tables; what reaches the driver are the n-grams kept and each document's shares of these. Without
    both classes nothing is learnt and the score is that of no evidence, 0.5.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_h", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy("_h", "doc_id").limit(MAX_TRAIN[label])
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.drop("_h")), "doc_id")  # as many rows as MAX_TRAIN allows
    held = materialise(sample.select("doc_id", "text", "toxic").mapInArrow(task(__name__, "bags"), "doc_id long, toxic int, buckets array<int>, counts array<int>"), "bags")
    n, positive = held.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    if positive in (0, n):
        return np.array([], np.int64), np.array([]), 0.0
    kept = telling(held, n, positive)
    table = held.mapInArrow(task(__name__, "shares", kept), "doc_id long, toxic int, at array<int>, share array<double>").toArrow().sort_by("doc_id")
    rows = [(y, np.asarray(a.values), np.asarray(s.values)) for y, a, s in zip(table.column("toxic").to_pylist(), table.column("at"), table.column("share"), strict=True)]
    return kept, *train(rows, len(kept))


def with_score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1, higher for toxic, in column `name`, which replaces any other of that name.

    A null or empty text gets the score of no evidence. Labels, lang, source and doc_id are never inputs of a score.
    Repeated rows get equal scores. Empty input: empty result.
    """
    kept, weight, bias = fit(docs, labels)
    base = docs.drop(name)
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])
    return base.mapInArrow(task(__name__, "score_batches", kept, weight, bias, name), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
