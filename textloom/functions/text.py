"""Text expressions: tokens, normal forms, cleaning, counts. All are native columns but the few
that Unicode normal forms and casefolding need, which are Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token: letters, marks and digits, with one apostrophe part.
TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)?"
NUMBER = r"^\p{N}+([.,]\p{N}+)*$"


def tokens(text: Column, lower: bool = True) -> Column:
    """Unicode word tokens in order; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Pieces between blanks, punctuation kept."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def without_numbers(toks: Column, keep: Sequence[str] = ()) -> Column:
    return F.filter(toks, lambda t: ~t.rlike(NUMBER) | t.isin(*keep) if keep else ~t.rlike(NUMBER))


def without_terms(toks: Column, terms: Sequence[str], keep: Sequence[str] = ()) -> Column:
    """Drops listed terms, but none to keep, and leaves repeats of all others."""
    gone = [t for t in terms if t not in set(keep)]
    return F.filter(toks, lambda t: ~t.isin(*gone)) if gone else toks


def normalized(text: Column) -> Column:
    """Trimmed, white space runs to one blank, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def checksum(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; ASCII texts pass unchanged."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full casefolding, for keys that are matched."""
    return text.map(lambda t: t if t is None else t.casefold())


def ngrams(toks: Column, n: int) -> Column:
    """Space-joined runs of n tokens, which never cross a unit."""
    if not 1 <= n <= 10:
        raise ValueError("n must be from 1 to 10")
    if n == 1:
        return toks
    last = F.size(toks) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(toks, i + k) for k in range(n)]))
    )


def merged_phrases(toks: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """Tokens with each phrase as one, its parts joined by underscores: left to right, the longest that fits at a place.

    The tokens are one text for that, in which phrases are marked by one expression that tries the longest first.
    """
    listed = sorted({" ".join(p) for p in phrases}, key=lambda p: (-p.count(" "), p))
    if not listed:
        return toks
    fits = "(?<![^ ])(?:" + "|".join(re.escape(p) for p in listed) + ")(?![^ ])"
    marked = F.split(F.regexp_replace(F.array_join(toks, " "), fits, "\x01$0\x01"), "\x01")
    joined = F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(" "), F.lit("_"))).otherwise(x)), "")
    return F.when(F.size(toks) == 0, toks).otherwise(F.split(joined, " "))


# cleaning steps, each text to text


def clean_whitespace(text: Column) -> Column:
    """CRLF and CR to LF, runs of blanks to one, three or more LF to two, lines and ends stripped."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.btrim(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t"))), "\n"), F.lit(" \t\n"))


def clean_dehyphenate(text: Column) -> Column:
    """Joins ASCII words that a hyphen breaks at a line end."""
    return F.regexp_replace(text, r"([A-Za-z])-\s*\n\s*([A-Za-z])", "$1$2")


def _kept_lines(text: Column, dropped: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(dropped)), "\n")


def clean_page_numbers(text: Column) -> Column:
    """Drops lines that are a page number only, such as "12", "page 3" or "- 4 -"."""
    return _kept_lines(text, r"(?i)^\s*(?:page\s+)?(?:\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])\s*$")


def clean_tables(text: Column) -> Column:
    """Drops pipe-table lines, their rulers, and lines with three or more tabs."""
    return _kept_lines(text, r"^\s*\|.+\|\s*$|^\s*\|?[\s:-]+\|[\s|:-]*$|(?:\t[^\t]*){3,}")


def clean_bibliography(text: Column) -> Column:
    """Cuts the text at the first bibliography heading from the fourth line on."""
    heading = r"(?i)^\s*(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list|endnotes)\s*:?\s*$"
    lines = F.split(text, "\n")
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(heading) & (i >= 3), i)), lambda i: i.isNotNull()))
    return F.when(at.isNull(), text).otherwise(F.array_join(F.slice(lines, 1, F.coalesce(at, F.lit(0))), "\n"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least, none for empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def syllables(word: Column) -> Column:
    """Vowel groups, a final e left out, one at least."""
    w = F.btrim(F.lower(word), F.lit("'"))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.when(F.endswith(w, F.lit("e")) & (groups > 1), groups - 1).otherwise(groups), F.lit(1)))
