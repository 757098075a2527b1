"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from manifoldry.llm import variants

SCHEMA = "doc_id long, text string, word string, n string, length string, block string, form string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", "l", "b", "f") for i, t in rows], SCHEMA).repartition(3)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        top = min(around, key=lambda v: (-n[v], v), default=None)
        out[w] = (top if top and n[top] >= 2 * n[w] else None, len(around))
    found = set()
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.add((w, n[w], n_near, form, n[form] if form else None, root))
    return found


def got(spark, rows):
    made = [tuple(r) for r in variants.variants(frame(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(made) == len(set(made))
    return set(made)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeioubcdlmnrstéÉ÷") for _ in range(rng.randrange(5, 9))) for _ in range(25)]
    for s in list(stems):
        for _ in range(6):  # chains of slips, so that forms lead on to other forms
            k = rng.randrange(len(s))
            s = rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("aeizé") + s[k:], s[:k] + rng.choice("aeizé") + s[k + 1 :]])
            stems.append(s)
    weight = [2 ** rng.randrange(8) for _ in stems]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(stems, weight, k=80))) for i in range(docs)]
    return [*rows, (None, " ".join(stems * 3)), (None, None), (7, ""), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    want = brute(corpus(seed))
    assert got(spark, corpus(seed)) == want
    assert any(form and root != form for _, _, _, form, _, root in want)


def test_blocks_of_a_few_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 3)
    assert got(spark, corpus(9, 20)) == brute(corpus(9, 20))


def test_ties_and_very_long_words(spark):
    long = "ab" * 30_000
    rows = [(i, f"{long} {long}c {long[:-1]}z house mouse louse Mouse  spelt spelté ×abcd aßàçè") for i in range(5)] + [(9, "rouse rouse rouse rouse rouse rouse rouse rouse rouse rouse xouse xouse xouse")]
    want = brute(rows)
    assert got(spark, rows) == want
    assert {w: f for w, _, _, f, _, _ in want}["xouse"] in ("mouse", "rouse")


def test_every_near_pair_is_in_cells_one_step_apart():
    """Any insertion, deletion or replacement, of letters of every group, leads to a cell that is met."""
    steps = set(variants._steps())
    steps |= {tuple(-x for x in s) for s in steps}
    cell = lambda w: (len(w), *[sum(c in g for c in w) for g in variants.GROUPS])
    rng = random.Random(1)
    for _ in range(5000):
        w = "".join(rng.choice("abhnzté") for _ in range(rng.randrange(5, 9)))
        k, c = rng.randrange(len(w)), rng.choice("abhnzté")
        for v in (w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]):
            assert tuple(np.subtract(cell(v), cell(w))) in steps


def test_no_words(spark):
    assert got(spark, []) == set()
    assert got(spark, [(1, None), (2, ""), (3, "a b c"), (4, "once only here")]) == set()
