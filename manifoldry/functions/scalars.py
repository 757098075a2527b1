"""Column functions: keys, classes, intervals as text, sequence cleaning, masks and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class letters and names.
CLASSES = {"a": "all-alpha", "b": "all-beta", "c": "alpha/beta", "d": "alpha+beta", "e": "multi-domain", "f": "membrane", "g": "small"}
#: Key prefixes and categories.
PREFIXES = {"anchor": "anchor", "astral95": "astral95", "integrable": "integrable", "control": "random", "idp": "idp", "knotted": "knotted", "fold_switching": "fold_switching"}
LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def make_key(category: Column, sub: Column, ident: Column, n: Column) -> Column:
    """cat|sub|id|length; missing parts become unknown."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("unknown")) for c in (category, sub, ident, n)])


def split_key(key: Column) -> Column:
    """(category, subcategory, id, length) of a key."""
    part = lambda i: F.coalesce(F.get(F.split(key, r"\|"), F.lit(i)), F.lit("unknown"))
    return F.struct(part(0).alias("category"), part(1).alias("subcategory"), part(2).alias("id"), part(3).alias("length"))


def parse_class(description: Column) -> Column:
    return _lookup(CLASSES, F.regexp_extract(description, r"([a-g])\.\d+\.\d+\.\d+", 1), "unknown")


def taxonomy(key: Column) -> Column:
    """The class of a key, from its prefix."""
    return _lookup(PREFIXES, F.get(F.split(key, r"\|"), F.lit(0)), "unknown")


def taxonomy_of_sub(sub: Column) -> Column:
    """The class that a subcategory names; control is a category, not a subcategory."""
    return F.coalesce(F.when(sub.isin(*PREFIXES.values()), sub), F.lit("unknown"))


def taxonomy_of_pair(category: Column, sub: Column) -> Column:
    """The class of (category, subcategory): that of the category; extreme ones by subcategory, knotted if it is no other."""
    extreme = F.when(sub.isin("fold_switching", "idp"), sub).otherwise("knotted")
    plain = F.when(category.isin("anchor", "astral95", "integrable"), category).when(category == "control", "random")
    return F.coalesce(F.when(category == "extreme", extreme), plain, F.lit("unknown"))


def source_key(category: Column, key: Column) -> Column:
    """anchor: first 4 characters of part 3; astral95: characters 2-5 if there are 5; others: first 4; lower-cased."""
    part = F.coalesce(F.get(F.split(key, r"\|"), F.lit(2)), F.lit(""))
    domain = F.when(F.length(part) >= 5, F.substring(part, 2, 4))
    return F.lower(F.when(category == "astral95", domain).otherwise(F.substring(part, 1, 4)))


def parse_range(text: Column) -> Column:
    """(start, end) of 'a-b': one dash and two integers, else null."""
    ok = text.rlike(r"^\d+-\d+$")
    bound = lambda i: F.get(F.split(text, "-"), F.lit(i)).try_cast("int")
    return F.when(ok, F.struct(bound(0).alias("start"), bound(1).alias("end")))


def parse_ranges(text: Column) -> Column:
    """All valid ranges of 'a-b,c-d'."""
    return F.filter(F.transform(F.split(text, ","), lambda x: parse_range(F.trim(x))), lambda x: x.isNotNull())


def format_ranges(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")


def region_fault(start: Column, end: Column, length: Column) -> Column:
    """Why a region is bad, or null: start over end first, then out of bounds."""
    return F.when(start > end, "start_after_end").when((start < 1) | (end > length), "out_of_bounds")


def clean_sequence(seq: Column) -> Column:
    """Drops X; U becomes C, B becomes N, Z becomes Q."""
    return F.translate(seq, "UBZX", "CNQ")


def letters_only(seq: Column) -> Column:
    """Upper case, without X and anything that is no letter."""
    return F.regexp_replace(F.upper(seq), "[^A-WYZ]", "")


def composition_ok(seq: Column, most: float = 0.5, alphabet: str = LETTERS) -> Column:
    """Every letter is in the alphabet and none has a share above `most`."""
    n = F.length(seq)
    highest = F.greatest(*[n - F.length(F.replace(seq, F.lit(x), F.lit(""))) for x in alphabet])
    return seq.rlike(f"^[{alphabet}]+$") & (highest <= n * most)


def interleave(a: Column, b: Column) -> Column:
    """upper(a1) lower(b1) upper(a2) lower(b2) ..., to the shorter's end."""
    n = F.least(F.length(a), F.length(b))
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.upper(F.substring(a, i, F.lit(1))), F.lower(F.substring(b, i, F.lit(1)))))
    return F.when(n > 0, F.array_join(each, "")).otherwise("")


def pair_tokens(seq: Column) -> Column:
    """Tokens of 2 characters, joined by a space."""
    return F.trim(F.regexp_replace(seq, "(..)", "$1 "))


def log_density(x: Column) -> Column:
    return F.log10(x + 1e-60)


def significance(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def pct_change(new: Column, old: Column) -> Column:
    return F.when(F.abs(old) <= 1e-6, 0.0).otherwise((new - old) / F.abs(old) * 100)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def kmers(seq: Column, k: int = 5) -> Column:
    """All substrings of length k, in one pass: a substring by its place would count code points from the text's start each time."""
    each = "(?s)(?=([^\\x{DC00}-\\x{DFFF}].{%d}))" % (k - 1)  # never from the middle of a pair of surrogates
    return F.coalesce(F.regexp_extract_all(seq, F.lit(each), F.lit(1)), F.array().cast("array<string>"))


def _best_window(full: Column, frag: Column) -> Column:
    n = F.length(full) - F.length(frag) + 1
    letters = F.split(frag, "")
    miss = lambda i: F.aggregate(F.zip_with(F.split(F.substring(full, i, F.length(frag)), ""), letters, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    best = F.array_min(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(miss(i).alias("miss"), i.alias("at"))))
    return F.when((n > 0) & (F.length(frag) > 0), F.when(best["miss"] <= F.length(frag) * 0.3, best["at"]))


def locate_fragment(full: Column, frag: Column) -> Column:
    """(start, end) of a fragment: exact, then without a leading M, then the first best window with at most 30 % mismatches, then that without M."""
    full, frag = F.upper(F.replace(full, F.lit("-"), F.lit(""))), F.upper(F.replace(frag, F.lit("-"), F.lit("")))
    bare = F.when(frag.startswith("M") & (F.length(frag) > 1), F.substring(frag, F.lit(2), F.length(frag)))
    exact = lambda f: F.when(F.instr(full, f) > 0, F.instr(full, f))
    spot = lambda at, f: F.when(at.isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(f) - 1).cast("int").alias("end")))
    return F.coalesce(spot(exact(frag), frag), spot(exact(bare), bare), spot(_best_window(full, frag), frag), spot(_best_window(full, bare), bare))
