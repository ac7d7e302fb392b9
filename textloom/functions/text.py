"""Tokens, normal forms and stems as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet, the combining marks that extend a token, and the crawler's word rule.
BASE = r"[0-9A-Za-z\x{0400}-\x{052F}]"
EXTENDED = (
    r"[0-9A-Za-z\x{0400}-\x{052F}\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]"
)
TOKEN = f"{BASE}{EXTENDED}*+(?:-{BASE}{EXTENDED}*+)*+"
WORD = r"[A-Za-z\x{0410}-\x{044F}\x{0401}\x{0451}0-9]+(?:-[A-Za-z\x{0410}-\x{044F}\x{0401}\x{0451}0-9]+)?"
#: ASCII other than letters, digits and ``_``.
OTHER_ASCII = "".join(chr(i) for i in range(128) if not (chr(i).isalnum() or chr(i) == "_"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Suffixes in the order in which they are tried.
SUFFIXES_EN = ("ing", "ed", "ly", "es", "s")
SUFFIXES_RU = (
    "иями", "ями", "ами", "иями", "иям", "ием", "иях",
    "ого", "ему", "ыми", "ими", "ее", "ое", "ая", "яя",
    "ов", "ев", "ей", "ам", "ям", "ах", "ях", "ом", "ем",
    "ы", "и", "а", "я", "о", "е", "у", "ю",
)


def tokens(text: Column) -> Column:
    """Array of the tokens of a text, case kept. A single hyphen joins token parts; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Words as the crawler counts them: at most one hyphen within a word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone; other scripts keep their case."""
    return F.translate(c, UPPER, LOWER)


def norm_boolean(token: Column, unicode_fold: bool = False) -> Column:
    """The Boolean index's form of a token: hyphens stay."""
    return F.lower(token) if unicode_fold else ascii_lower(token)


def norm_ranked(token: Column, unicode_fold: bool = False) -> Column:
    """The ranked index's form: ASCII other than letters, digits and ``_`` goes, hyphens too."""
    if unicode_fold:
        return F.lower(F.translate(token, OTHER_ASCII, ""))
    # letters map to letters, and what has no counterpart goes
    return F.translate(token, UPPER + OTHER_ASCII, LOWER)


def ranked_length_ok(term: Column) -> Column:
    """The ranked index keeps terms of 2 to 64 bytes."""
    return F.octet_length(term).between(2, 64)


def _cut_first(word: Column, suffixes: tuple[str, ...], spare: int) -> Column:
    """Without the first of ``suffixes`` that ends the word and leaves more than ``spare`` bytes."""
    out = None
    for suffix in suffixes:
        fits = F.endswith(word, F.lit(suffix)) & (F.octet_length(word) > len(suffix.encode()) + spare)
        short = F.substr(word, F.lit(1), F.length(word) - len(suffix))
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return out.otherwise(word)


def stem_normalised(term: Column) -> Column:
    """Light stem of a term in the ranked form; lengths are bytes."""
    english = F.when(F.octet_length(term) < 4, term).otherwise(_cut_first(term, SUFFIXES_EN, 1))
    russian = F.when(F.octet_length(term) < 8, term).otherwise(_cut_first(term, SUFFIXES_RU, 4))
    beyond_ascii = F.octet_length(term) > F.length(term)
    return F.when(beyond_ascii, russian).when(term.rlike("[A-Za-z]"), english).otherwise(term)


def stem(token: Column, enabled: bool = True) -> Column:
    """Normal form and stem of a token; empty below 2 bytes."""

    def of(term: Column) -> Column:
        return F.when(F.octet_length(term) < 2, F.lit("")).otherwise(stem_normalised(term) if enabled else term)

    # the normal form as an array of one, so that it is computed once and not again for each suffix
    return F.element_at(F.transform(F.array(norm_ranked(token)), of), 1)


def repaired_utf8(data: Column) -> Column:
    """Text of bytes or of a string that may be no valid UTF-8: each bad sequence is U+FFFD, which separates tokens."""
    return F.make_valid_utf8(data.cast("string"))


def squeeze_space(c: Column) -> Column:
    """Each run of white space, Unicode's included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{1C}-\x{1F}]+", " "))


def trim_ascii_space(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n\f\u000b"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_url_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def source_name(c: Column) -> Column:
    """A name of ``[a-z0-9_]`` alone, ``source`` where nothing is left."""
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]+", "_"), F.lit("_"))
    return F.when(clean == "", "source").otherwise(clean)


def retry_delay(retries: Column, base: int = 30, cap: int = 3600) -> Column:
    """``min(cap, base * 2 ** retries)`` seconds; retries below 0 count as 0."""
    doublings = F.least(F.greatest(retries, F.lit(0)), F.lit(40)).cast("int")
    return F.least(F.lit(cap).cast("long"), F.lit(base).cast("long") * F.pow(F.lit(2.0), doublings).cast("long"))


def retry_wait(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt, numbered from 0: ``min(5, 0.5 * 2 ** attempt)``."""
    return F.least(F.lit(5.0), F.lit(0.5) * F.pow(F.lit(2.0), attempt))
