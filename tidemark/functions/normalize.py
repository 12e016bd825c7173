"""Identifiers and text as Column expressions. All are null-safe and JVM-side."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: words that count as missing, legal suffixes in the order they are tried, and the patterns of filings' texts
MISSING = ("nan", "none")
MISSING_ITEMS = ("nan", "none", "null")
LEGAL_SUFFIXES = ("CORPORATION", "CORP", "INCORPORATED", "INC", "LIMITED", "LTD")
ITEM_CODE = r"(?i)(?:\bitem\s*)?([0-9]{1,2}\.[0-9]{2})"
NOTE_HEADING = r"(?i)\b(EXPLANATORY NOTES?|NOTE REGARDING AMENDMENT|INTRODUCTORY NOTE)\b"
MAJOR_HEADING = r"(?i)\b(PART\s+(?:I|II|III|IV)\b|ITEM\s+[0-9]{1,2}(?:\.[0-9]{2})?\b|SIGNATURES\b|EXHIBIT INDEX\b|TABLE OF CONTENTS\b)"
FINANCIAL_WORDS = r"(?i)\b(restat(?:e|ed|ement|ing)|correct(?:ed|ion|ing)?|error|misstatement|non-reliance|nonreliance|previously issued financial)\b"
ADMIN_WORDS = r"(?i)\b(part\s+iii|proxy|def\s*14a|exhibit)\b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def form_key(c: str | Column) -> Column:
    """A form's name as filters compare it."""
    return F.upper(F.trim(F.coalesce(col(c), F.lit(""))))


def digits(c: str | Column) -> Column:
    return F.regexp_replace(col(c).cast("string"), "[^0-9]", "")


def _padded(n: Column, least: int) -> Column:
    return F.when(n >= least, F.lpad(n.cast("string"), 10, "0"))


def cik_digits(c: str | Column, least: int = 1) -> Column:
    """An issuer id from the digits of a text, padded to ten (F1; with least 0: F3)."""
    return _padded(digits(c).try_cast("bigint"), least)


def _number_or_digits(c: str | Column) -> Column:
    text = F.trim(col(c).cast("string"))
    text = F.when(~F.lower(text).isin(*MISSING), text)
    return F.coalesce(text.try_cast("double").try_cast("bigint"), digits(text).try_cast("bigint"))


def cik(c: str | Column, least: int = 1) -> Column:
    """An issuer id read as a number first, so '320193.0' keeps its value, then by digits (F2, F4): the canonical form. Ids below least are none."""
    return _padded(_number_or_digits(c), least)


def firm_key(c: str | Column) -> Column:
    """A firm number of 0 or more, not padded."""
    n = _number_or_digits(c)
    return F.when(n >= 0, n.cast("string"))


def year_key(c: str | Column) -> Column:
    """A year from 1800 to 2200, read as a number or from the first four digits."""
    y = F.coalesce(F.trim(col(c).cast("string")).try_cast("double").try_cast("int"), F.substring(digits(c), 1, 4).try_cast("int"))
    return F.when(y.between(1800, 2200), y)


def ticker(c: str | Column) -> Column:
    """Upper case, dots as dashes."""
    t = F.upper(F.trim(col(c).cast("string")))
    return F.when((t != "") & ~t.isin("NAN", "NONE"), F.translate(t, ".", "-"))


def company_name(c: str | Column) -> Column:
    """Upper case, single blanks, without one legal suffix."""
    t = F.trim(F.regexp_replace(F.upper(col(c).cast("string")), r"\s+", " "))
    t = F.when((t != "") & ~t.isin("NAN", "NONE"), t)
    return F.nullif(F.trim(F.regexp_replace(t, f" ({'|'.join(LEGAL_SUFFIXES)})$", "")), F.lit(""))


def tickers(c: str | Column) -> Column:
    """A list of tickers from a JSON list or from text with commas or semicolons."""
    raw = F.trim(col(c).cast("string"))
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    parts = F.coalesce(listed, F.split(F.translate(raw, ";", ","), ","))
    out = F.filter(F.transform(parts, ticker), lambda x: x.isNotNull())
    return F.when(raw.isNull() | F.lower(raw).isin("", *MISSING, "[]"), F.array().cast("array<string>")).otherwise(out)


def accession_plain(c: str | Column) -> Column:
    return F.translate(F.coalesce(col(c).cast("string"), F.lit("")), "-", "")


def items_missing(c: str | Column) -> Column:
    t = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return (t == "") | t.isin(*MISSING_ITEMS)


def item_codes(c: str | Column) -> Column:
    """The sorted distinct item codes that a filing's items name (F8); none if they are missing."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(ITEM_CODE), F.lit(1))))
    return F.when(items_missing(c), F.array().cast("array<string>")).otherwise(found)


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def plain_text(c: str | Column) -> Column:
    """HTML as text: without scripts and styles, tags as line feeds, entities resolved, blanks collapsed.
    Only the entities pass through Python, in Arrow batches."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    t = _unescaped(F.regexp_replace(t, "<[^>]+>", "\n"))
    return F.regexp_replace(F.regexp_replace(t, "[ \\t\\r\\f\\x0B]+", " "), r"\n\s*", "\n")


def note_window(c: str | Column, search: int = 20_000, most: int = 3_000) -> Column:
    """The explanatory note of a plain text: from its heading, if that's in the first `search` signs, to the next
    major heading or to `most` signs (F10); empty if there's none."""
    t = col(c)
    head = F.regexp_extract(F.substring(t, 1, search), NOTE_HEADING, 1)
    start = F.regexp_instr(F.substring(t, 1, search), F.lit(NOTE_HEADING))
    window = t.substr(start, F.lit(most))
    after = window.substr(F.length(head) + 1, F.lit(most))
    major = F.regexp_instr(after, F.lit(MAJOR_HEADING))
    note = F.when(major > 0, window.substr(F.lit(1), F.length(head) + major - 1)).otherwise(window)
    return F.when(F.coalesce(start, F.lit(0)) > 0, F.regexp_replace(note, r"^\s+|\s+$", "")).otherwise(F.lit(""))


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def identifier_words(c: str | Column) -> Column:
    """The lower-case words of an identifier, also of one in camel case."""
    t = F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(t, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def numeric_like(c: str | Column) -> Column:
    """A number from text with thousands separators or a percent sign."""
    return F.regexp_replace(F.trim(col(c).cast("string")), "[,%]", "").try_cast("double")


def bool_like(c: str | Column) -> Column:
    """1 or 0 from words for true and false."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("true", "t", "yes", "y", "1"), 1).when(t.isin("false", "f", "no", "n", "0"), 0)


def year_hint(c: str | Column) -> Column:
    """The first year from 1900 on that a link names."""
    return F.nullif(F.regexp_extract(col(c), "((?:20|19)[0-9]{2})", 1), F.lit("")).cast("int")


def family_of(column: str, families: dict[str, tuple[str, ...]], other: str = "other") -> str:
    """The feature family of a column name: the first whose prefix or name fits (F16)."""
    return next((f for f, marks in families.items() if any(column == m or (m.endswith("_") and column.startswith(m)) for m in marks)), other)
