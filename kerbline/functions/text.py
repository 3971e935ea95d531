"""Names: normalisation, terms, codes and trigram similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Written forms that mean the same, words that an initialism skips, and what a code looks like.
ABBREVIATIONS = {
    "av": "avenue",
    "ave": "avenue",
    "blvd": "boulevard",
    "center": "centre",
    "cir": "circle",
    "cres": "crescent",
    "ct": "court",
    "dr": "drive",
    "e": "east",
    "hwy": "highway",
    "ln": "lane",
    "n": "north",
    "pkwy": "parkway",
    "pl": "place",
    "rd": "road",
    "s": "south",
    "sq": "square",
    "st": "street",
    "terr": "terrace",
    "theater": "theatre",
    "trl": "trail",
    "w": "west",
}
SKIPPED = ("a", "an", "and", "at", "for", "in", "of", "on", "the")
CODE = "^(?=.{2,6}$)[a-z]{1,4}[0-9]{0,2}$"
MAX_TERMS = 8


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def plain_text(text: Column) -> Column:
    """Lower case, & as and, apostrophes gone, other non-word characters as single spaces. Accents stay: see normalise."""
    t = F.regexp_replace(F.lower(text), "&", " and ")
    t = F.regexp_replace(t, "['\\u2019]", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def expanded(text: Column) -> Column:
    """Abbreviated words in full."""
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def normalise(text: Column) -> Column:
    """Lower case without accents, apostrophes and punctuation, & as and, abbreviations in full: a-z, 0-9 and single spaces only."""
    t = F.regexp_replace(F.replace(F.lower(fold_accents(text)), F.lit("&"), F.lit(" and ")), "['\u2019`]", "")
    return expanded(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")))


def terms(text: Column) -> Column:
    """The first MAX_TERMS distinct words."""
    return F.slice(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")), 1, MAX_TERMS)


def compact(text: Column) -> Column:
    """A text as typed the way codes are written: small letters and digits run together, no abbreviation in full."""
    return F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", "")


def code_of(text: Column) -> Column:
    """A recorded code such as E7, SLC or P.A.C.: one to four letters, then at most two digits, two characters at least; else null."""
    t = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    return F.when(t.rlike(CODE), t)


def initialism(text: Column) -> Column:
    """Initials of a name of two words or more without the skipped ones, numbers whole; null unless they are 2 to 6 characters."""
    words = F.filter(F.split(normalise(text), " "), lambda w: (w != "") & ~w.isin(*SKIPPED))
    letters = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), w).otherwise(F.substring(w, 1, 1))), "")
    return F.when((F.size(words) >= 2) & F.char_length(letters).between(2, 6), letters)


def matches_terms(text: Column, wanted: Column) -> Column:
    """Every term begins a word of the text; all-digit terms must be whole words."""
    words = F.split(text, " ")
    return F.forall(wanted, lambda t: F.exists(words, lambda w: F.when(t.rlike("^[0-9]+$"), w == t).otherwise(F.startswith(w, t))))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of each word, with two spaces before and one after it."""
    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(first: Column, second: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    a, b = trigrams(first), trigrams(second)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _best_extent(first: str, second: str) -> float:
    def pieces(text: str) -> list[str]:
        return [w[i : i + 3] for w in (f"  {x} " for x in text.split(" ") if x) for i in range(len(w) - 2)]

    wanted, line = set(pieces(first)), pieces(second)
    ends = [i for i, p in enumerate(line) if p in wanted]  # the best extent begins and ends with shared trigrams
    best = 0.0
    for k, i in enumerate(ends):
        seen: set[str] = set()
        shared, done = 0, i
        for j in ends[k:]:
            new = set(line[done : j + 1]) - seen
            seen |= new
            shared += len(new & wanted)
            done = j + 1
            best = max(best, shared / (len(wanted) + len(seen) - shared))
    return best


@F.pandas_udf(T.DoubleType())
def word_similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """Greatest similarity of the first text's trigrams to those of any contiguous extent of the second's, in order."""
    return pd.Series([None if a is None or b is None else _best_extent(a, b) for a, b in zip(first, second, strict=True)], dtype="float64")


def same_street(first: Column, second: Column) -> Column:
    """Equal word sets after expansion; null if either name has no word."""
    a, b = (F.array_sort(terms(expanded(plain_text(c)))) for c in (first, second))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), a == b)
