"""Text functions as Column expressions; vocabularies are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelspark import vocab


def normalize(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def any_match(text: Column, patterns: list[str]) -> Column:
    """One alternation instead of one scan per pattern."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def classify_intent(text: Column, patterns: dict[str, list[str]] = vocab.INTENT_PATTERNS, default: str = "informational") -> Column:
    """The first intent, in the order of ``patterns``, with a match in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda out, kv: F.when(any_match(low, kv[1]), kv[0]).otherwise(out), reversed(patterns.items()), F.lit(default))


def stage_scores(text: Column, patterns: dict[str, list[str]] = vocab.STAGE_PATTERNS) -> dict[str, Column]:
    """Patterns of each stage that match."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {s: reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in ps]) for s, ps in patterns.items()}


def classify_stage(scores: dict[str, Column], default: str = "Discovery") -> Column:
    """The stage with most matches; the deepest wins ties. ``scores`` in order of depth."""
    top = F.greatest(*scores.values())
    out = F.lit(default)
    for stage, n in scores.items():
        out = F.when((top > 0) & (n == top), stage).otherwise(out)
    return out


def lexicon_sentiment(text: Column, positive: list[str] = vocab.POSITIVE, negative: list[str] = vocab.NEGATIVE, negators: list[str] = vocab.NEGATORS) -> Column:
    """(positive - negative hits) / hits, 4 places; a negator just before a hit flips it; 0 without hits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), F.lit(1))
    member = lambda x, some: x.isin(*some) if some else F.lit(False)
    before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    hit = lambda w: F.when(member(w, positive), 1).when(member(w, negative), -1).otherwise(0)
    hits = F.zip_with(words, before, lambda w, b: F.when(member(b, negators), -hit(w)).otherwise(hit(w)))
    step = lambda a, x: F.struct((a["net"] + x).alias("net"), (a["n"] + F.abs(x)).alias("n"))  # noqa: E731  one pass over the words
    start = F.struct(F.lit(0).alias("net"), F.lit(0).alias("n"))
    return F.aggregate(hits, start, step, lambda a: F.when(a["n"] > 0, F.bround(a["net"] / F.greatest(a["n"], F.lit(1)), 4)).otherwise(0.0))


def extract_terms(text: Column, aliases: dict[str, str]) -> Column:
    """Sorted distinct canonical names of the aliases found as whole words; longer aliases first."""
    import re

    names = sorted((a.lower() for a in aliases), key=lambda a: (-len(a), a))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(" + "|".join(map(re.escape, names)) + r")\b"), F.lit(1))
    canon = F.create_map(*[F.lit(x) for a, c in sorted(aliases.items()) for x in (a.lower(), c)])
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: canon[a])))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct ``[a-z0-9]+`` of more than one character, without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    found = F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))
    return F.array_except(found, F.array(*[F.lit(s) for s in stopwords])) if stopwords else found


def containment(a: Column, b: Column) -> Column:
    """|a & b| / |a| of two sets; 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))).otherwise(0.0)


def trigrams(text: Column) -> Column:
    """All runs of three characters, with repeats."""
    n = F.length(text) - 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the trigram multisets of two texts; 0 if either has none."""
    x, y = trigrams(a), trigrams(b)
    times = lambda arr, t: F.size(F.filter(arr, lambda s: s == t)).cast("double")
    dot = lambda p, q: F.aggregate(p, F.lit(0.0), lambda acc, t: acc + times(q, t))  # noqa: E731  sums count_p * count_q
    return F.when((F.size(x) > 0) & (F.size(y) > 0), dot(x, y) / F.sqrt(F.greatest(dot(x, x) * dot(y, y), F.lit(1e-300)))).otherwise(0.0)


def spf_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\bspf\s*(\d{1,3})\b"), F.lit(1))))


def to_float(text: Column) -> Column:
    """The first number after commas are dropped; null without one."""
    return F.expr("null").cast("double") if text is None else F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
