"""Short-text cleaning and counting. Letters are those of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the text features.
SPACE = r"[ \t\n\f\r]"
URL = r"https?://[^ \t\n\f\r]+"
USER = r"@[\p{L}0-9_]+"
RETWEET = r"(^|[ \t\n\f\r])RT([ \t\n\f\r]|$)"
DIGITS = r"[0-9]+"
PUNCTUATION = r"[\"#$%&'()*+,/:;<=>@\[\\\]^_`{|}~-]"
HASHTAG = r"#[\p{L}0-9_]+"
WORD = r"\p{L}+"
UPPER_WORD = r"^\p{Lu}\p{Lu}+$"
SENTENCE_END = r"[.!?]+"
TOKEN = r"\p{L}+"


def preprocess_text(text: Column) -> Column:
    """Drop URLs, user names, retweet marks, digits and punctuation other than sentence ends; collapse spaces."""
    for pattern in (URL, USER, RETWEET, DIGITS, PUNCTUATION):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case letter runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def upper_words(text: Column) -> Column:
    """Number of words of two or more letters in capitals."""
    return F.size(F.filter(words(text), lambda w: w.rlike(UPPER_WORD)))


def sentences(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(r"[^ \t\n\f\r]")))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
