"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from manifoldry.llm import bpe, exact_dedup, minhash, packing, quality_rules, sharding, substring, token_counts, toxicity, url_filter
from manifoldry.llm.common import unused

WORDS = [f"w{i}" for i in range(3000)]
LONG = " ".join(WORDS[i % 2999] for i in range(120_000))
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _spans string, _gone string, _sha string, _toxicity string, _tox_score string, kept string, key string, node string, score string, shard string, slot string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *["x"] * 13) for d, t in rows], CLASH)


def test_clashing_columns_come_through(spark):
    rng = random.Random(1)
    passage = [rng.choice(WORDS) for _ in range(70)]
    own = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows = [(1, " ".join(own(30) + passage)), (2, " ".join(own(300) + passage)), (3, "a copy"), (4, "a copy"), (5, None), (6, ""), (None, "a copy"), (4, "a copy")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(1, 7)], "doc_id long, quality int, toxic int")
    assert unused(docs, "_doc", "_Gone") == ["_doc_", "_Gone_"]
    for made in (substring.cut_passages(docs), exact_dedup.drop_copies(docs), minhash.drop_near_duplicates(docs)):
        assert made.columns == docs.columns
        assert all(r["_doc"] == r["_spans"] == r["_gone"] == r["_sha"] == r["_toxicity"] == "x" for r in made.collect())
    scored = toxicity.with_score(docs, labels, "fresh")
    assert scored.columns == [*docs.columns, "fresh"] and scored.count() == len(rows)
    assert scored.where("_tox_score = 'x' and _toxicity = 'x'").count() == len(rows)
    cut = {r.doc_id: r.text for r in substring.cut_passages(docs).collect()}
    assert cut[5] is None and cut[6] == "" and " ".join(passage) not in cut[2]


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, LONG), (2, LONG), (3, "short"), (3, "short"), (4, None), (None, LONG)]
    docs = frame(spark, rows)
    found = {(r.doc_id, r.n_spans > 0) for r in substring.marked(docs).collect()}
    assert found == {(1, False), (2, True), (3, False), (4, False), (None, False)} and substring.marked(docs).count() == len(rows)
    copies = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.decisions(docs).collect()}
    assert copies[2] == (1, 3) and copies[3] == (3, 2) and copies[None] == (1, 3)
    judged = quality_rules.ledger(docs.select("doc_id", "text")).collect()
    assert len(judged) == len(rows) and max(r.n_words for r in judged) == 120_000
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    scores = [(r.doc_id, r.fresh) for r in toxicity.with_score(docs, labels, "fresh").collect()]
    assert len(scores) == len(rows) and len({s for d, s in scores if d == 3}) == 1 and all(0 <= s <= 1 for _, s in scores)


def draw(key, name, weight):
    h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
    return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight


def descend(key, nodes):
    """The shard of a key by brute force."""
    region_weight = [sum(w for rack in region for _, w in rack) for region in nodes]
    r = min(range(len(nodes)), key=lambda i: draw(key, f"region-{i}", region_weight[i])) if len(nodes) > 1 else 0
    first = sum(len(region) for region in nodes[:r])
    racks = nodes[r]
    k = min(range(len(racks)), key=lambda i: draw(key, f"rack-{first + i}", sum(w for _, w in racks[i]))) if len(racks) > 1 else 0
    shards = racks[k]
    return min(shards, key=lambda s: draw(key, f"shard-{s[0]}", s[1]))[0] if len(shards) > 1 else shards[0][0]


@pytest.mark.parametrize("shards", [8, 16, 24])
def test_sharding_against_brute_force(spark, shards):
    rows = [(i, None if i % 9 == 0 else "t\u00e9" * (i % 40)) for i in range(1500)] + [(7, LONG), (7, LONG), (None, "x")]
    got = sharding.shard(frame(spark, rows), shards).collect()
    assert len(got) == len(rows)
    now, grown = sharding.tree(shards), sharding.tree(shards + 1)
    texts = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    for r in got:
        key = str(r.doc_id) if r.doc_id is not None else "\0null"
        assert (r.shard, r.grown_shard) == (descend(key, now), descend(key, grown)) and r.grown_shard in (r.shard, shards)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("shards", [0, 10, 12, 20])
def test_shard_counts_that_would_break_the_law_are_refused(spark, shards):
    with pytest.raises(ValueError):
        sharding.shard(frame(spark, []), shards)


def by_rules(url):
    """host, path, rule by brute force."""
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    stop = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:stop])
    tail = rest[stop:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r, _ in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "example.com", "X.Example.COM", "notexample.com", "net", "example.net", "q.example.net", "b.org", "org", "\u00c9.org", "", "localhost:80"]
    tails = ["/en/7", "/en/71?x=/de/8", "/de/8", "/de/80#y", "/es/", "/es", "/EN/7", "", "?/en/", "#/de/", "/en/" + "9" * 50_000]
    urls = [f"{rng.choice(['http', 'https', 'X'])}{rng.choice(['://', '://', ':/', ''])}{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(400)] + [None, "", "://", "a://b://com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "s", "f") for i, u in enumerate(urls + urls[:50])], "page_id long, url string, host string, suffix string, features string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls) + 50
    verdicts = dict(url_filter.RULES)
    for i, u in enumerate(urls + urls[:50]):
        assert got[i][:3] == by_rules(u)
        assert got[i][3] == verdicts[got[i][2]] if got[i][2] else got[i][3] in ("allow", "block")


def test_trees_on_hidden_labels(spark):
    """Labels that follow from the words of the url, so that only features can tell; a suffix's own label is left out."""
    rng = random.Random(5)
    rows = [(i, f"http://h{i}.{'com/en' if i % 2 else 'net/de'}/{'9' * (rng.randrange(8, 14) if i % 2 else rng.randrange(0, 4))}x{rng.randrange(99)}") for i in range(1200)]
    r = url_filter.held_out_accuracy(spark.createDataFrame(rows, "page_id long, url string")).head()
    assert r.n > 150 and r.n_right >= 0.9 * r.n


def test_empty_tables(spark):
    import public_tokenizers as P

    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = P.path("byte_bpe_50k.tiktoken")
    made = [minhash.near_duplicates(docs), exact_dedup.decisions(docs), substring.marked(docs), substring.cut_passages(docs), toxicity.with_score(docs, labels), sharding.shard(docs), bpe.encode_digests(docs, path, P.PATTERN), packing.pack(docs, path, P.PATTERN), quality_rules.apply_policy(quality_rules.ledger(docs)), quality_rules.ablations(quality_rules.ledger(docs)), token_counts.document_ids(docs)]
    assert [m.count() for m in made] == [0] * len(made)


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, quality int, toxic int"
    docs = frame(spark, [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "four"), (4, LONG)])
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in out} == {1, 2, None, 4}
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
