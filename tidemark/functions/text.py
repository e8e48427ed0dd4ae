"""Text expressions as Column functions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose matches decide results.
TOKEN = "[a-z0-9]+"
NUMERIC_TERM = r"(?<![\w.])[+-]?\d+(?:[.,]\d+)?%?(?![\w.])"
NUMBER = r"(?:(?<![\w.%])[-+])?\d+(?:[.,]\d+)*%?"
CLOSURE_MARKER = r"(?i)\b(superseded by|supersedes|replaced by|replaces|deprecated|obsolete)\b"
RELATIONAL_QUERY = (
    r"(?i)\b(?:why|how|when|before|after|compare|comparison|difference|changed|change|"
    r"decision|decided|status|result|outcome|outcomes|happened|led|caused|consequence|following|"
    r"subsequent|entity|entities|each|per)\b"
    r"|\b(?:this|that|it|they|them)\b"
)
SPEAKER_TAG = r"^\|[^|]*\|:\s*"
LEAST_SKELETON = 12
CODE = (r"(?s)```.*?```", r"(?s)~~~.*?~~~", r"(?is)<pre\b.*?</pre>", r"(?is)<code\b.*?</code>", r"`[^`\n]+`")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers, in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def numeric_terms(text: Column) -> Column:
    """Distinct numbers of a text in order, decimal commas as points."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMERIC_TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def relational(query: Column) -> Column:
    """Whether a query asks how things relate: only such queries are expanded."""
    return F.coalesce(query, F.lit("")).rlike(RELATIONAL_QUERY)


def without_code(text: Column) -> Column:
    """A text with fenced blocks, <pre> and <code> elements and inline code spans as blanks."""
    for pattern in CODE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def code_density(text: Column) -> Column:
    """Share of a text's words that stand in code; null without a word."""
    words = lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)))
    text = F.coalesce(text, F.lit(""))
    return (words(text) - words(without_code(text))) / F.nullif(words(text), F.lit(0))


def safe_reference(name: Column, most: int = 120) -> Column:
    """A name from the corpus as quoted data: one line, no control or format characters, no quotes, bounded."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", ""), '"', "'"), r"[\s\p{Z}]+", " ")
    plain = F.trim(plain)
    short = F.when(F.char_length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)
    return F.when(name.isNull() | (plain == ""), "unknown").otherwise(F.concat(F.lit('"'), short, F.lit('"')))


def supersedes_key(value: Column) -> Column:
    """What a reference and a file name are matched by: no brackets, no folder, no ``.md``."""
    bare = F.regexp_replace(F.trim(value), r"^(?:\[\s*)+(.*?)(?:\s*\])+$", "$1")
    stem = F.regexp_replace(F.trim(bare), r"(?i)\.md$", "")
    return F.trim(F.element_at(F.split(stem, "/"), -1))


def skeleton(line: Column) -> Column:
    """A line with every number as ``#``: lines that restate one claim have one skeleton."""
    return F.trim(F.regexp_replace(F.trim(line), NUMBER, "#"))


def answer_words(text: Column) -> Column:
    """Words of an answer for token F1: lower case, no ASCII punctuation, no articles."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+"), lambda w: w != "")


def history_query(turns: Column) -> Column:
    """Lines of earlier turns, newest last, without speaker tags and blank lines."""
    lines = F.flatten(F.transform(turns, lambda t: F.split(t, "\r\n|\r|\n")))
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SPEAKER_TAG, "")))
    return F.array_join(F.filter(plain, lambda x: x != ""), "\n")


def version_of(file: Column) -> tuple[Column, Column]:
    """(base, number) of names like ``notes_v2.md``; nulls for other names."""
    name = F.element_at(F.split(file, "/"), -1)
    pattern = r"^(.*?)[_\-. ]?v(\d+)(\.[^.]+)?$"
    has = name.rlike(pattern)
    base = F.when(has, F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 3)))
    return supersedes_key(base), F.when(has, F.regexp_extract(name, pattern, 2).cast("long"))


def clean_text(content: Column) -> Column:
    """UTF-8 bytes as text without byte-order mark and NUL."""
    text = F.decode(content, "UTF-8")
    return F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\x00"), F.lit(""))
