"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps its measurements and one failure bit for each rule.
Policies are versioned masks over those bits: applying another one, or asking what a rule costs, never reads text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manifoldry.llm.common import NOT_SPACES, SPACES, let, materialise, read

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` (SQL over the measurements) holds. A rule keeps its bit for ever."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
)
BASE = 0b11
#: Version: the bits of which any rejects.
POLICIES = {"v1": 0b000011, "v2": 0b111111}
CURRENT = "v2"


def _n_lines(text: Column) -> Column:
    """Lines with a word, and how many of them equal an earlier one."""
    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACES))
    return let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows that start at the sorted `starts`."""
    step = lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 3).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; `hashes` in order of position."""
    placed = F.sort_array(F.arrays_zip(hashes, F.sequence(F.lit(0), F.size(hashes) - 1)).cast("array<struct<h:bigint,i:int>>"))
    none = F.array(F.lit(None).cast("bigint"))

    def inside(s: Column) -> Column:
        h = s.getField("h")
        rows = F.arrays_zip(h, s.getField("i"), F.slice(F.concat(none, h), 1, F.size(h)), F.concat(F.slice(h, 2, F.size(h)), none))
        rows = rows.cast("array<struct<h:bigint,i:int,before:bigint,after:bigint>>")
        twice = F.filter(rows, lambda r: (r["h"] == r["before"]) | (r["h"] == r["after"]))
        return let(twice, lambda t: _covered(F.array_sort(t.getField("i"))))

    return let(placed, inside)


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with the measurements. A null text has no words and no lines; measurement columns replace others of their name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES + "+"), "")

    def by_word(w: Column) -> Column:
        windows = F.arrays_zip(w, F.slice(w, 2, F.size(w)), F.slice(w, 3, F.size(w)))
        hashes = F.slice(F.transform(windows, lambda x: F.xxhash64(x)), 1, F.greatest(F.size(w) - 2, F.lit(0)))
        repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_repeated(h)))
        return F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeated.cast("long").alias("rep"))

    measured = docs.withColumn("_w", let(words, by_word)).withColumn("_l", _n_lines(text))
    return measured.withColumns(
        {
            "n_words": F.col("_w.n"),
            "word_chars": F.col("_w.chars"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.col("_l.n"),
            "n_dup_lines": F.col("_l.dup"),
            "n_repeat_words": F.col("_w.rep"),
        }
    ).drop("_w", "_l")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and `failures`, a bit for each failed rule. A row for each row of `docs`; empty input: empty result."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs).withColumn("failures", failures)


def apply_policy(recorded: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with the verdict of one policy version."""
    return recorded.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failures").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(recorded: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule in it: documents that fail the rule, and those that only this rule rejects.

    Documents meet as counts of distinct bitmasks, at most 2 ** rules rows.
    """
    masks = recorded.groupBy("failures").agg(F.count("*").alias("n"))
    asked = [(v, m, r.name, 1 << r.bit) for v, m in POLICIES.items() for r in rules if m >> r.bit & 1]
    parts = [
        masks.select(F.lit(v).alias("policy"), F.lit(name).alias("rule"), "n", F.col("failures").bitwiseAND(F.lit(m)).alias("bits"), F.lit(bit).alias("bit"))
        for v, m, name, bit in asked
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def sole_failure(failures: Column, version: str = CURRENT) -> Column:
    """The bit of the rule that alone rejects a document under a policy: without it, the document would stay; else 0."""
    bits = failures.bitwiseAND(F.lit(POLICIES[version]))
    return F.when(bits.bitwiseAND(bits - 1) == 0, bits).otherwise(0).cast("long")


def with_ablation(judged: DataFrame, recorded: DataFrame, version: str = CURRENT) -> DataFrame:
    """`judged`, whose `sole_failure` is a rule's bit or 0, with how many documents that rule alone rejects: what would stay without it."""
    bits = F.create_map(*[x for r in RULES for x in (F.lit(r.name), F.lit(1 << r.bit).cast("long"))])
    told = ablations(recorded).where(F.col("policy") == version).select(F.get(F.map_values(F.map_filter(bits, lambda k, _: k == F.col("rule"))), F.lit(0)).alias("_bit"), F.col("n_only_this").alias("_n"))
    return judged.join(F.broadcast(told), F.col("sole_failure") == F.col("_bit"), "left").withColumn("ablation_gain", F.coalesce("_n", F.lit(0))).drop("_bit", "_n")


def op4(spark, sf_dir: str) -> DataFrame:
    """The ledger is stored once; both policies and the ablations, by aggregation over distinct masks, are read from it."""
    recorded = materialise(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "ledger")
    earlier = apply_policy(recorded, "v1").withColumnRenamed("kept", "kept_v1").drop("policy")
    judged = apply_policy(earlier).withColumn("sole_failure", sole_failure(F.col("failures")))
    return with_ablation(judged, recorded).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failures").bitwiseAND(F.lit(BASE)).cast("boolean").alias("base_failed"), "kept", "failures", "kept_v1", "sole_failure", "ablation_gain")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS tri FROM w),
g AS (SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(tri) + 1)) AS i FROM m),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM m LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT AS failures FROM a),
d AS (SELECT *, (CASE WHEN failures IN (1, 2, 4, 8, 16, 32) THEN failures ELSE 0 END)::BIGINT AS sole_failure FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, (failures & 3) = 0 AS kept_v1,
  sole_failure, CASE WHEN sole_failure > 0 THEN count(*) OVER (PARTITION BY sole_failure) ELSE 0 END AS ablation_gain FROM d
"""
