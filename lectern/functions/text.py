"""Text and token functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the engine counts it: ASCII blanks and controls, and the Unicode separators.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Scripts written without blanks: one token for each character.
SPACELESS = r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]"
#: A query uses its first terms only.
QUERY_TERMS = 32
SNIPPET = 600


def stripped(text: Column) -> Column:
    """The text without white space at its ends, line breaks included."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def without_mark(text: Column) -> Column:
    """The text without a leading byte order mark."""
    return F.regexp_replace(text, r"^\ufeff", "")


def words(text: Column) -> Column:
    """The words of a text: runs without white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_cost(word: Column) -> Column:
    """Tokens of one word: 1 up to 16 characters, beyond that a quarter of its length, rounded up."""
    n = F.length(word)
    return F.when(n <= 16, 1).otherwise(F.ceil(n / 4)).cast("long")


def token_count(text: Column) -> Column:
    """Approximate tokens: characters of scripts without blanks, and the cost of all other words."""
    text = F.coalesce(text, F.lit(""))
    rest = words(F.regexp_replace(text, SPACELESS, " "))
    return (F.regexp_count(text, F.lit(SPACELESS)) + F.aggregate(rest, F.lit(0).cast("long"), lambda s, w: s + word_cost(w))).cast("long")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, as they are indexed and searched."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(question: Column) -> Column:
    """The terms a question searches for: the first 32, repetitions kept."""
    return F.slice(terms(question), 1, QUERY_TERMS)


def snippet(text: Column, length: int = SNIPPET) -> Column:
    """The trimmed text, cut to ``length`` code points with an ellipsis where it is longer."""
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) > length, F.concat(F.rtrim(F.left(trimmed, F.lit(length))), F.lit("…"))).otherwise(trimmed)


def title_of(message: Column) -> Column:
    """A conversation's title: the message with single blanks, at most 60 code points."""
    flat = F.trim(F.regexp_replace(message, f"{SPACE}+", " "))
    return F.when(flat == "", F.lit("New conversation")).otherwise(F.left(flat, F.lit(60)))


def content_hash(text: Column, version: str = "v1") -> Column:
    """Key of a cached extraction: the text, a NUL and the version."""
    return F.sha2(F.concat(text, F.lit("\0"), F.lit(version)), 256)


def joined_hash(texts: Column) -> Column:
    """Key of a cached summary: the children's texts, with a blank line between."""
    return F.sha2(F.array_join(texts, "\n\n"), 256)


def normalised(text: Column) -> Column:
    """Lower case; everything but letters and digits is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def contains_words(text: Column, part: Column) -> Column:
    """Whether normalised ``part`` stands in normalised ``text`` on word boundaries; never if empty."""
    return (part != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), part, F.lit(" ")))


def word_pattern(needle: str, compound: bool = False) -> str:
    """A pattern for a word that no letter or digit touches; within compounds one free side is enough."""
    import re

    free_left, free_right = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    quoted = re.escape(needle)
    return f"{free_left}{quoted}|{quoted}{free_right}" if compound else f"{free_left}{quoted}{free_right}"


def f1(a: Column, b: Column, both: Column) -> Column:
    """F1 of two texts of ``a`` and ``b`` words with ``both`` in common; 1 if both are empty, 0 if one is."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0) | (both == 0), 0.0).otherwise(2.0 * both / (a + b))


def strip_code(markdown: Column) -> Column:
    """The text without fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?s)(```|~~~).*?(\1|\z)", " "), r"`[^`\n]*`", " ")


def citation_markers(markdown: Column) -> Column:
    """Labels S1, S2, ... in square brackets outside code, in the order of first use."""
    return F.array_distinct(F.regexp_extract_all(strip_code(markdown), F.lit(r"\[(S\d+)\]"), F.lit(1)))


def message_tokens(text: Column) -> Column:
    """Tokens of a message in a prompt, with a margin for the true tokenizer and its frame."""
    return (F.ceil(token_count(text) * 1.3 * 1.5) + 8).cast("long")


def csv_field(value: Column) -> Column:
    """A CSV field: formula signs made harmless, quoted where it must be."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)
