"""Phrases against counting all of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from manifoldry.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, n string, ids string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", "n", "i", "b") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower)]


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    phrase = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    dropped = set()
    for (lang, p), c in phrase.items():
        dropped |= {(lang, p[i : i + k]) for k in range(2, len(p)) for i in range(len(p) - k + 1) if c >= f[lang, p[i : i + k]]}
    rows = []
    for (lang, p), a in phrase.items():
        if (lang, p) not in dropped:
            cut = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cut)
            rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    common = "a the of to in on by an és ÀB x0 |   日本".split(" ")
    lines = [" ".join(rng.choices(common, k=rng.randrange(2, 9))) for _ in range(12)]
    rows = []
    for _ in range(docs):
        parts = [rng.choice(lines) if rng.random() < 0.4 else " ".join(rng.choices([*common, *[f"r{rng.randrange(500)}"] * 2], k=rng.randrange(0, 12))) for _ in range(rng.randrange(1, 12))]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(p + rng.choice([". ", ",", "\n", " \t", "!?", "\x0b", ""]) for p in parts)))
    return [*rows, ("en", None), (None, ""), ("en", "."), ("en", rows[0][1].upper()), rows[3], rows[3]]


def got(spark, rows, **kind):
    made = phrases.collocations(frame(spark, rows), **kind)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in made.collect())


@pytest.mark.parametrize("seed,kind", [(0, {}), (1, {"top": 7}), (2, {"bucket": 300, "share": 40}), (3, {"bucket": 50, "share": 10_000}), (4, {"share": 1})])
def test_phrases_equal_brute_force(spark, seed, kind):
    """Also with pairs that are dealt by all words and with many buckets."""
    want = brute(corpus(seed), 5, kind.get("top", 2000))
    assert len(want) > 20 and got(spark, corpus(seed), least=5, **kind) == want


def test_a_pair_that_holds_much_of_the_text(spark):
    rng = random.Random(8)
    rows = [("en", ". ".join(f"hot pair {rng.choice('abc')} {rng.choice('def')} r{rng.randrange(9)}" if rng.random() < 0.6 else " ".join(rng.choices("hot pair a b c d e f g h".split(), k=6)) for _ in range(20))) for _ in range(100)]
    assert got(spark, rows, least=20, bucket=200, share=20) == brute(rows, 20, 2000)


def test_long_texts_repeats_and_nothing(spark):
    long = "one two three four five six seven " * 4000
    rows = [("en", long), ("en", "x" * 100_000), ("en", "same same same same same same same same. " * 50)]
    assert got(spark, rows) == brute(rows, 100, 2000)
    assert got(spark, []) == []
    assert got(spark, [("en", None), (None, ""), ("en", "a b c")]) == []


def test_ties_are_broken_by_bytes(spark):
    rows = [("en", "zz zy. é è. a b. ") for _ in range(100)]
    made = got(spark, rows, top=2)
    assert made == brute(rows, 100, 2) and [r[2] for r in made] == ["a b", "zz zy"]


def test_words_of_slices_and_document_ends():
    column = pa.array(["skip me", "Ab ab", "", "ab.cd  É\té", None, ",x", "tail"])[1:6]
    code, words = phrases.words_of(column)
    words = [w.decode() for w in words.to_pylist()]
    assert [words[c - 1] if c else "|" for c in code.tolist()] == ["ab", "ab", "|", "ab", "|", "cd", "É", "é", "|", "x"]
    assert phrases.words_of(pa.array([None, ""], pa.string()))[0].tolist() == []


def test_unary_paths_stand_for_their_prefixes():
    grams = np.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 7, 0, 0]], np.uint32)
    found = {tuple(g): (int(s), int(n)) for g, s, n in ((g, s, n) for part in phrases.paths(grams, np.array([3, 4, 2]), 3) for g, s, n in zip(part[0].tolist(), part[1], part[2], strict=True))}
    assert found == {(1, 2): (2, 9), (1, 2, 3, 4): (3, 7), (1, 2, 3, 4, 5): (5, 3), (1, 2, 3, 4, 6): (5, 4)}
