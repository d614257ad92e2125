"""Text helpers. Every function takes a Column and returns a Column.

All of them stay inside the JVM except :func:`nfc`, which sends only the rows
that may need it through an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values (the rules they belong to give other results with others) ----
# White space as a class that the JVM and Python read alike: plain \s is ASCII in one and Unicode in the other.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NON_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE}]"
SENTENCE_BREAK = rf"(?<=[.!?…])[{SPACE}]+(?=[A-ZĐÀ-Ỹ0-9“\"(])"
SENTENCE_END = rf"[.!?…]+(?:[{SPACE}]|$)"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PLAUSIBLE_CLASS = rf"\x20-\x7EÀ-ɏḀ-ỿ{SPACE}"
PLAUSIBLE_MIN_LENGTH = 12
PLAUSIBLE_MIN_SHARE = 0.85
VIETNAMESE_LETTERS = (
    "àáảãạăằắẳẵặâầấẩẫậ"
    "èéẻẽẹêềếểễệ"
    "ìíỉĩị"
    "òóỏõọôồốổỗộơờớởỡợ"
    "ùúủũụưừứửữự"
    "ỳýỷỹỵ"
    "đ"
)
# The same letters as a class for lower-case text. Java tests single characters
# one by one, so the block that holds only these letters is given as a range.
VIETNAMESE_CLASS = "àáâãèéêìíòóôõùúýăđĩũơưạ-ỹ"
VIETNAMESE_MIN_SHARE = 0.012
DETECT_MIN_CHARS = 25
WORDS_PER_MINUTE = {"vi": 228, "en": 158}
# ---- end of fixed values ----

# Share of these words that makes a text English. They replace a statistical
# detector, so both the list and the threshold are parameters of the callers.
ENGLISH_WORDS = (
    "the", "and", "of", "to", "is", "that", "for", "with",
    "by", "it", "this", "are", "from", "have",
)
ENGLISH_MIN_SHARE = 0.05

# Every character in this class is left alone by NFC, whatever stands next to it.
_SURELY_NFC = r"\u0000-˿Ḁ-ỿ‐-⁞€"


@F.pandas_udf(StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it.

    Only texts with a character that composition could touch are handed to
    Python, the others go through as NULL and cost nothing. What most texts
    consist of goes first: one range is found far faster than a class of several.
    """
    rare = F.regexp_replace(text, r"[\x00-\u02FF]+", "")
    doubtful = F.when(rare.rlike(f"[^{_SURELY_NFC}]"), text)
    return F.coalesce(_nfc_batch(doubtful), text)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks as ``trim`` does."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalise_text(text: Column) -> Column:
    """NFC plus ``\\n`` line ends; a leading byte order mark goes too."""
    return nfc(unix_newlines(F.regexp_replace(text, "^﻿", "")))


def squash(text: Column) -> Column:
    """Lower case, punctuation to blanks, runs of white space to one blank.

    Both steps together turn every run of other characters into one blank.
    """
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def term_key(text: Column) -> Column:
    """Comparison key of a term (composition first, or accents would be blanked)."""
    return squash(nfc(text))


def loose(text: Column) -> Column:
    """Lower case and punctuation to blanks; runs of blanks are kept."""
    return F.regexp_replace(F.lower(text), NON_WORD, " ")


def contains_loosely(text: Column, term: Column) -> Column:
    return F.contains(loose(text), strip(loose(term)))


def blank(text: Column) -> Column:
    """True for NULL, empty and all-white-space text."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def ascii_fold(text: Column) -> Column:
    """Order key that ignores the case of A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def speaking_seconds(text: Column, lang: Column) -> Column:
    """Estimated speaking time, one decimal, as decimal."""
    per_minute = F.when(lang == "vi", F.lit(WORDS_PER_MINUTE["vi"])).otherwise(
        F.lit(WORDS_PER_MINUTE["en"])
    )
    return F.round(F.size(words(text)).cast("decimal(12,0)") * 60 / per_minute.cast("decimal(5,0)"), 1)


def sentence_count(text: Column) -> Column:
    parts = F.filter(F.split(text, SENTENCE_END), lambda p: strip(p) != "")
    return F.greatest(F.lit(1), F.size(parts))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def is_plausible_line(line: Column) -> Column:
    """Long enough and mostly made of characters found in real text."""
    body = strip(line)
    good = F.length(F.regexp_replace(body, f"[^{PLAUSIBLE_CLASS}]+", ""))
    return (F.length(body) >= PLAUSIBLE_MIN_LENGTH) & (
        good >= PLAUSIBLE_MIN_SHARE * F.length(body)
    )


def _language(chars: Column, letters: Column, marked: Column, tokens: Column,
              english_words: tuple[str, ...], english_min_share: float) -> Column:
    english = F.filter(tokens, lambda w: w.isin(*english_words))
    return (
        F.when(chars < DETECT_MIN_CHARS, "unknown")
        .when(letters == 0, "unknown")
        .when(marked >= VIETNAMESE_MIN_SHARE * letters, "vi")
        .when(F.size(english) >= english_min_share * F.size(tokens), "en")
        .otherwise("unknown")
    )


def block_languages(
    texts: Column,
    english_words: tuple[str, ...] = ENGLISH_WORDS,
    english_min_share: float = ENGLISH_MIN_SHARE,
) -> Column:
    """``vi``, ``en`` or ``unknown`` for every text of an array.

    Marked letters decide first. Their set contains é, è, ê, à, ó and more, so
    French or Spanish text is labelled ``vi`` as well; that is the rule. What is
    left is English when enough of its words are English function words.

    Expressions inside a lambda are evaluated wherever they appear, so each
    step binds what the next one uses more than once.
    """
    bodies = F.transform(F.transform(texts, strip), lambda b: F.struct(F.length(b).alias("n"), F.split(F.lower(b), r"[^\p{L}]+").alias("words")))
    # The words joined are the letters, and every marked letter is one. Plain ones go first, as one range is found far faster than the class.
    joined = F.transform(bodies, lambda b: F.struct(b["n"].alias("n"), b["words"].alias("words"), F.array_join(b["words"], "").alias("letters")))
    measured = F.transform(joined, lambda b: F.struct(
        b["n"].alias("n"),
        F.length(b["letters"]).alias("letters"),
        F.length(F.regexp_replace(F.regexp_replace(b["letters"], r"[\x00-\x7F]+", ""), f"[^{VIETNAMESE_CLASS}]+", "")).alias("marked"),
        F.array_remove(b["words"], "").alias("tokens"),
    ))
    return F.transform(measured, lambda m: _language(
        m["n"], m["letters"], m["marked"], m["tokens"], english_words, english_min_share))


def block_language(text: Column, **detector) -> Column:
    """:func:`block_languages` of one text."""
    return block_languages(F.array(text), **detector)[0]


def excerpt(text: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def quote_pattern(text: Column) -> Column:
    """The text as a literal inside a Java regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quote_replacement(text: Column) -> Column:
    """The text as a literal replacement (no group references)."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")
