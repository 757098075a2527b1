"""The document pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, whatever else these are called. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from manifoldry.llm import exact_dedup, minhash, packing, substring, tokens, toxicity
from manifoldry.llm.common import materialise, read, unused


def drop_toxic(spark, docs, sf_dir):
    """Documents that score under the threshold. Null and empty texts score as no evidence and stay; repeated rows share a score."""
    (score,) = unused(docs, "_toxicity")
    scored = toxicity.with_score(docs, read(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark, docs, sf_dir):
    """The first document of each normalised text. Null counts as empty; rows that repeat a kept document stay; null ids lose to others."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near duplicates. Five words, a similarity of 0.8 or more. Texts without words and rows
    without an id stay; rows of one doc_id stay or go together."""
    return minhash.drop_near_duplicates(docs, percent=80)


def cut_repeated_passages(spark, docs, sf_dir):
    """Texts without the passages that an earlier document has; n_chars follows the text. Null and empty texts and rows
    without an id stay as they are; rows of one doc_id are one document, whose repeats of itself stay."""
    cut = substring.cut_passages(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 2048 tokens. A null or empty text is one end token; each row is packed by itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]
#: Training, min-hash links and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
