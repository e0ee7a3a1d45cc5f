"""Text functions: terms, negation-aware exclusion, degeneration, controlled lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lightshelf.functions.scalar import col

# Words that are no content terms of a description.
STOP_WORDS = frozenset("the a an and or but of in on at to for with by from is are was were be been being it its this that these those there here as into over under up down out off then than so very can will just not no".split())
# What negates a term that follows.
NEGATIONS = ("no", "not", "without", "absence of", "no visible")


def quoted(term: str) -> str:
    """A term as part of a regular expression of Java."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", term)


def has_term(c, term: str) -> Column:
    """Whether a text holds the whole word or phrase, whatever its case; false for NULL."""
    return F.coalesce(F.lower(col(c)).rlike(rf"\b{quoted(term.lower())}\b"), F.lit(False))


def stems(term: str, expansions: dict[str, list[str]] | None = None) -> list[str]:
    """A term, itself without a plural s, and its expansions."""
    out = [term.lower()]
    if len(term) > 4 and term.endswith("s"):
        out.append(term.lower()[:-1])
    out += [x.lower() for x in (expansions or {}).get(term.lower(), [])]
    return list(dict.fromkeys(out))


def contains_excluded(c, terms: list[str], expansions: dict[str, list[str]] | None = None) -> Column:
    """Whether a text names one of the terms outside of a negation (a cue within 40 characters before it)."""
    if not terms:
        return F.lit(False)
    every = list(dict.fromkeys(s for t in terms for s in stems(t, expansions)))
    cue = "|".join(sorted((quoted(n) for n in NEGATIONS), key=len, reverse=True))
    terms = rf"\b(?:{'|'.join(quoted(t) for t in every)})"
    pattern = rf"{terms}\b(?<!\b(?:{cue})\b(?! other)[^.;]{{0,30}}{terms})"
    return F.coalesce(F.lower(col(c)).rlike(pattern), F.lit(False))


def content_terms(c, least: int = 3, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """Distinct lower-case words (hyphens within) of at least `least` letters that are no stop words, in order of appearance."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z]+(?:-[a-z]+)*)"), 1)
    stop = F.array(*[F.lit(w) for w in sorted(stop_words)])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w)))


def words_of(c) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")


def _with(value: Column, use) -> Column:
    """`use` of a value that is computed once; named in lambda functions, an expression is computed again for each element."""
    return F.transform(F.array(value), use)[0]


def _thrice(words: Column) -> Column:
    """Whether six words follow each other three times somewhere; only texts with repeated runs are sorted."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - 5), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(6))))
    most = lambda g: F.aggregate(
        F.array_sort(g), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1)).alias("run"), F.greatest(s["most"], F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))).alias("most")),
    )["most"]
    return _with(grams, lambda g: F.when(F.size(F.array_distinct(g)) > F.size(g) - 2, F.lit(False)).otherwise(most(g) >= 3))


def is_degenerate(c) -> Column:
    """Runaway text: over 350 words, few distinct ones among many, a run of six words three times, or many ellipses."""
    dots = (F.length(col(c)) - F.length(F.replace(col(c), F.lit("..."), F.lit("")))) / 3 > 8

    def judged(words: Column, n: Column) -> Column:
        # three equal runs leave at most n - 2 distinct words
        distinct = F.size(F.array_distinct(words))
        return F.when(n < 6, F.lit(False)).otherwise(_with(distinct, lambda k: ((n > 60) & (k / n < 0.45)) | (F.when(k > n - 2, F.lit(False)).otherwise(_thrice(words)))))

    words = F.filter(F.split(F.trim(F.lower(col(c))), r"\s+"), lambda w: w != "")
    long = _with(words, lambda w: _with(F.size(w), lambda n: F.when(n > 350, F.lit(True)).otherwise(judged(w, n))))
    return F.coalesce(dots | long, F.lit(False))


def is_description(c) -> Column:
    """At least four words, and six besides any coordinates."""
    plain = F.regexp_replace(col(c), r"-?\d+\.\d+", " ")
    has_point = col(c).rlike(r"-?\d+\.\d{3,}")
    return F.coalesce((F.size(words_of(c)) >= 4) & (~has_point | (F.size(F.filter(words_of(plain), lambda w: w.rlike("[A-Za-z]"))) >= 6)), F.lit(False))


def controlled_list(reply, vocabulary: list[str], reject_at: int | None = None) -> Column:
    """Distinct members of the vocabulary in a comma list, as they come; NULL if there are `reject_at` or more."""
    known = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    found = F.array_distinct(F.filter(F.transform(F.split(col(reply), ","), lambda x: F.rtrim(F.regexp_replace(F.lower(F.trim(x)), r"\.+$", ""))), lambda x: F.array_contains(known, x)))
    return found if reject_at is None else F.when(F.size(found) < reject_at, found)
