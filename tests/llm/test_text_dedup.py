"""Exact and near deduplication, passages and components against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from manifoldry.llm import exact_dedup, minhash, substring
from manifoldry.llm.common import materialise
from manifoldry.operators.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORDS = [f"w{i}" for i in range(3000)]


def frame(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(d, t, None, "s", None, "x") for d, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(rng, n, words=120, edits=6):
    base = [rng.choice(WORDS) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out


def corpus(seed, group=25):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    for size in (2, 3, group):
        texts += near_copies(rng, size)
    texts += ["", " \t\n", "one", "One", "two words", "\u00e9t\u00e9 \u00e0 l\u2019eau \u2003 x y z", texts[0], texts[0].upper(), texts[3] + "  ", "long " * 30_000, None]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = corpus(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_in_full_regions(spark, monkeypatch):
    """Regions over the small bound are compared with full sets; the depth adapts where they overflow."""
    rows = corpus(5, group=150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 85)
    monkeypatch.setattr(minhash, "REGION", 40)
    again = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert again == brute_components(rows, 85)


def template_pages(seed, n, words=180, own=30, copies=60):
    """Pages of one template, each with words of its own, far under the threshold from each other; some are edited once more."""
    rng = random.Random(seed)
    template = [rng.choice(WORDS) for _ in range(words)]
    pages = []
    for _ in range(n):
        at = rng.randrange(words)
        pages.append(template[:at] + [rng.choice(WORDS) for _ in range(own)] + template[at:])
    for page in rng.sample(pages, copies):
        w = list(page)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        pages.append(w)
    rng.shuffle(pages)
    return [(i, " ".join(w)) for i, w in enumerate(pages)]


@pytest.mark.parametrize("region", [4, 16, 128, 1024])
def test_near_duplicates_among_template_pages(spark, monkeypatch, region):
    """No link is lost where a region holds more than it may, whatever its bound."""
    rows = template_pages(region, 300)
    monkeypatch.setattr(minhash, "REGION", region)
    monkeypatch.setattr(minhash, "FEW", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    want = brute_components(rows, 85)
    assert got == want
    assert 30 < sum(c != d for d, (_, c) in want.items())


def test_pages_of_a_template_make_no_pairs(spark, monkeypatch):
    """Pages that share most words without being duplicates: what meets grows with the pages, not with their square."""
    met = []

    def seen(df, label):
        out = materialise(df, label)
        met.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(minhash, "materialise", seen)
    monkeypatch.setattr(minhash, "REGION", 32)
    for n in (100, 200, 400):
        rows = template_pages(n, n, own=20, copies=n // 10)
        met.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
        assert len(met) == 2 and met[1] <= n
        assert n > 100 or got == brute_components(rows, 85)


def test_candidates_are_cut_by_chance():
    for percent in (80, 85):
        p, least = percent / 100, minhash.least_agreement(percent)
        tail = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(least))
        assert tail <= minhash.CHANCE < tail + math.comb(128, least) * p**least * (1 - p) ** (128 - least)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]  # both rows of document 2 go


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in group.items() if k in real}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, " a b"), (1, None), (2, ""), (4, "x"), (None, "x"), (7, "\u00a0")] + [(100 + i, "hot text") for i in range(300)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.heavy) for r in exact_dedup.decisions(frame(spark, rows)).collect()}
    assert got[5] == (3, 2, False, False) or got[5] == (3, 2, False, True)
    assert got[3][:3] == (3, 2, True) and got[9][:3] == (9, 1, True)
    assert got[2][:3] == (1, 2, False) and got[None][:3] == (4, 2, False)
    assert got[250] == (100, 300, False, True) and got[100] == (100, 300, True, True)
    digest = {r.doc_id: r.text_sha256 for r in exact_dedup.decisions(frame(spark, rows)).collect()}
    assert digest[5] == hashlib.sha256(b"a b").hexdigest() and digest[7] == hashlib.sha256("\u00a0".encode()).hexdigest()
    assert exact_dedup.decisions(frame(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(frame(spark, [*rows, (5, "another text")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (3, "a\tb"), (4, "x"), (5, "another text"), (7, "\u00a0"), (9, " a b"), (100, "hot text")]


def test_windows_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, least in ((1, 3), (30, 5), (200, 46), (64, 8)):
        h = rng.integers(1, 20, n).astype(np.uint64)
        keys = (h << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        keys[rng.integers(0, n)] = 0
        want = set()
        for c in range(n):
            if keys[c] >> np.uint64(32) == 0:
                continue
            a = b = c
            while a > 0 and keys[a - 1] > keys[c]:
                a -= 1
            while b < n - 1 and keys[b + 1] > keys[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((a, c, b))
        got = substring.compact_windows(keys, least)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_passages(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    shared, near = words(70), words(90)
    edited = list(near)
    edited[45] = "edit"
    docs = {1: words(100) + shared + words(50), 2: words(30) + shared + words(200), 3: words(300), 4: near + words(20), 5: words(60) + edited, 6: words(40), 9: words(20) + shared}
    rows = [(d, " ".join(w)) for d, w in docs.items()] + [(7, ""), (8, None), (None, " ".join(shared))]
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {d for d, r in got.items() if r.n_spans} == {2, 5, 9}
    span = got[2].spans[0]
    assert span.start <= 30 and span.stop >= 100 and span.stop - span.start <= 80 and got[2].sources == [1]
    assert got[5].spans[0].start <= 61 and got[5].spans[0].stop >= 149
    assert got[1].n_copied_from_here == 2
    cut = {r.doc_id: r.text for r in substring.cut_passages(frame(spark, rows)).collect()}
    assert cut[1] == " ".join(docs[1]) and cut[3] == " ".join(docs[3]) and cut[8] is None
    assert " ".join(shared[5:60]) not in cut[2] and cut[2].startswith(" ".join(docs[2][:20]))
    assert substring.marked(frame(spark, [])).count() == 0


def test_every_repeated_window_is_found(spark):
    """All runs of 55 equal words in an earlier document, whatever surrounds them."""
    rng = random.Random(11)
    pool = [[rng.choice(WORDS) for _ in range(rng.randrange(55, 120))] for _ in range(12)]
    rows = []
    for d in range(40):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += [rng.choice(WORDS) for _ in range(rng.randrange(10, 80))] + rng.choice(pool)
        rows.append((d, " ".join(w)))
    first, need = {}, defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 54):
            k = tuple(w[i : i + 55])
            if first.setdefault(k, d) != d:
                need[d].update(range(i, i + 55))
    got = {r.doc_id: {i for s in r.spans for i in range(s.start, s.stop)} for r in substring.marked(frame(spark, rows)).collect()}
    for d, v in need.items():
        inner = {i for i in v if {i - 6, i + 6} <= v}  # a span may stop up to 6 words before the end of a repeat
        assert inner <= got[d]


def test_cut_keeps_the_rest():
    assert substring.cut_spans("a b  c d\te", [(1, 3)]) == "a d\te"
    assert substring.cut_spans(" a b", [(0, 2)]) == " "
    assert substring.cut_spans("a b c ", [(2, 3)]) == "a b  "


def test_passages_meet_all_earlier_holders(spark):
    """Documents that share a passage, after older ones that hold only parts of it."""
    rng = random.Random(12)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows, need = [], {}
    for g in range(24):
        b = words(60)
        part = b[10:50] if g % 2 else [w if i % 12 else "edit" for i, w in enumerate(b)]
        rows += [(10 * g + i, " ".join(words(60) + x + words(60))) for i, x in enumerate((part, part[5:35], b, b))]
        need[10 * g + 3] = 10 * g + 2
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    missed = [d for d, source in need.items() if source not in got[d].sources or not any(s.start <= 60 and s.stop >= 120 for s in got[d].spans)]
    assert not missed
    assert {d for d, r in got.items() if r.n_spans} == set(need)


def test_shared_run():
    assert substring.shared_run(46, 80) == 24


def test_quoted_pieces_hide_no_later_copy(spark):
    """Five older documents quote pieces of a passage that three later ones hold whole."""
    rng = random.Random(21)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage = words(60)
    rows = [(i, " ".join(words(40) + passage[8 * i : 8 * i + 20] + words(40))) for i in range(5)]
    rows += [(10 + i, " ".join(words(50) + passage + words(50))) for i in range(3)]
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    assert [d for d, r in sorted(got.items()) if r.n_spans] == [11, 12]
    assert all(10 in got[d].sources and got[d].spans[0].start <= 50 and got[d].spans[0].stop >= 110 for d in (11, 12))


@pytest.mark.parametrize("length, changes", [(50, 1), (60, 1), (100, 2), (200, 4)])
def test_near_repeats(spark, length, changes):
    """Each document's passage, with words changed, in a later one; those that are similar enough are all found."""
    rng = random.Random(length)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows, alike = [], set()
    for i in range(60):
        passage = words(length)
        other = list(passage)
        for at in rng.sample(range(length), changes):
            other[at] = "changed"
        rows += [(i, " ".join(words(60) + passage + words(60))), (1000 + i, " ".join(words(80) + other + words(60)))]
        a, b = shingles(" ".join(passage)), shingles(" ".join(other))
        if 100 * len(a & b) >= 80 * len(a | b):
            alike.add(1000 + i)
    got = {r.doc_id for r in substring.marked(frame(spark, rows)).collect() if r.n_spans}
    assert len(alike) > 20 and alike <= got and not {d for d in got if d < 1000}


def test_hot_line_beside_repeats(spark, monkeypatch):
    """A line that all documents share, in surroundings of their own; some pairs share what is around it too."""
    monkeypatch.setattr(substring, "FEW", 4)
    rng = random.Random(31)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    line = words(30)
    rows, need = [], set()
    for i in range(40):
        before, after = words(60), words(60)
        rows.append((i, " ".join(before + line + after)))
        if i % 4 == 0:
            rows.append((100 + i, " ".join(words(60) + before[-15:] + line + after[:12] + words(60))))  # 57 words alike
            need.add(100 + i)
        if i % 4 == 1:
            rows.append((100 + i, " ".join(words(60) + before[-6:] + line + after[:6] + words(60))))  # 42 words alike
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    assert {d for d, r in got.items() if r.n_spans} == need
    assert all(d - 100 in got[d].sources for d in need)


def test_no_rare_shingle_beside_repeats(spark, monkeypatch):
    """A passage of which each shingle stands in many documents, two of its words changed in each; three late ones hold it whole."""
    monkeypatch.setattr(substring, "FEW", 2)
    rng = random.Random(51)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, rows = words(64), []
    for i in range(150):
        other = list(passage)
        for at in rng.choice([(a, b) for a in range(14, 50) for b in range(a + 5, 50)]):
            other[at] = f"edit{i}"
        rows.append((i, " ".join(words(60) + other + words(60))))
    rows += [(1000 + i, " ".join(words(60) + passage + words(60))) for i in range(3)]
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    assert [d for d, r in sorted(got.items()) if r.n_spans] == [1001, 1002]
    assert all(1000 in got[d].sources and got[d].spans[0].start <= 60 and got[d].spans[0].stop >= 124 for d in (1001, 1002))


def test_every_exact_repeat_is_marked(spark):
    """Fragments of passages in many documents: each run of 50 words that an earlier document has is marked but for a few words at its ends."""
    rng = random.Random(41)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    pool = [words(140) for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(1, 4)):
            p, a = rng.choice(pool), rng.randrange(0, 100)
            w += words(rng.randrange(5, 60)) + p[a : a + rng.randrange(15, 90)]
        rows.append((d, " ".join(w)))
    first, runs = {}, defaultdict(list)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                runs[d].append(i)
    got = {r.doc_id: {i for s in r.spans for i in range(s.start, s.stop)} for r in substring.marked(frame(spark, rows)).collect()}
    # A longer repeat may end up to `run - gram` words beyond what another, earlier holder has of it.
    slack = 24 - 18
    assert sum(map(len, runs.values())) > 200
    assert all(len(set(range(i, i + 50)) - got[d]) <= slack for d, at in runs.items() for i in at)


def _quoted(passage):
    """Pieces of a passage that hold all its runs of 18 words, none of them a repeat by itself."""
    return [passage[a : a + 30] for a in range(0, len(passage) - 17, 13)]


def test_every_place_of_a_document_is_compared(spark):
    """Older documents quote pieces of a passage, one holds it whole; a later one holds it twice, in equal surroundings."""
    rng = random.Random(61)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, before, after = words(60), words(60), words(60)
    rows = [(i, " ".join(words(40) + p + words(40))) for i, p in enumerate(_quoted(passage))]
    twice = before + passage + after
    rows += [(10, " ".join(words(50) + passage + words(50))), (11, " ".join(twice + words(100) + twice))]
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    assert [d for d, r in sorted(got.items()) if r.n_spans] == [11]
    assert [(s.start <= 60, s.stop >= 120) for s in got[11].spans[:1]] == [(True, True)]
    assert [(s.start <= 340, s.stop >= 400) for s in got[11].spans[1:]] == [(True, True)]


def test_every_place_of_the_first_document_counts(spark):
    """A document quotes pieces of a passage before it holds it whole; only one other holds it."""
    rng = random.Random(62)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage = words(60)
    first = [w for p in _quoted(passage) for w in p + words(200)] + passage + words(50)
    rows = [(1, " ".join(first)), (2, " ".join(words(50) + passage + words(50)))]
    got = {r.doc_id: r for r in substring.marked(frame(spark, rows)).collect()}
    assert [d for d, r in sorted(got.items()) if r.n_spans] == [2] and got[2].sources == [1]
    assert got[2].spans[0].start <= 50 and got[2].spans[0].stop >= 110


def test_words_are_split_as_a_pattern_does():
    """Words of all lengths, white space of all kinds, null and empty texts, in slices too."""
    rng = random.Random(64)
    texts = ["".join(rng.choice("abAB \t\n\x0b\x0c\r,\u00e9\u2003\x00") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "x" * 64 + " " + "x" * 65, "X" * 200, "A" * 8 + " " + "a" * 8 + " " + "a" * 9, None]
    rng.shuffle(texts)
    one, other = {}, {}
    for column in (pa.array(texts), pa.array(texts).slice(7, 200), pa.array(texts, pa.large_string()).slice(3), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        hashes, starts = minhash.word_hashes(column)
        assert len(starts) == len(column) + 1
        for text, a, b in zip(column.to_pylist(), starts.tolist(), starts[1:].tolist(), strict=False):
            found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
            assert len(found) == b - a
            assert all(one.setdefault(w, h) == h and other.setdefault(h, w) == w for w, h in zip(found, hashes[a:b].tolist(), strict=True))
    assert len(one) > 300
