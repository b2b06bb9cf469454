"""Text normalisation, hashing and counting as column expressions.

Only compatibility normalisation has no built-in form. It goes through an Arrow function, and only for
texts that hold a character it could change: all other rows pass a null to it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that compatibility composition leaves as they are, and whose case folding is lower() but for sharp s.
_PLAIN = (
    r"[\x00-\x7F¡-§©«-®°±¶·»¿-ÿĀ-ıĴ-ľŁ-ňŊ-ž"
    r"Ѐ-ѵѸ-ԯ–—‘-„•€]*"
)
_SPACES = r"[\s\x0B\x1C-\x1F\x85   -     　]+"
_INVISIBLE = "[​‌‍﻿]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def _plain(text: Column) -> Column:
    return text.rlike(f"^{_PLAIN}$")


def normalize_text(text: Column) -> Column:
    """Compatibility composition, no invisible characters, white space runs to one blank, none at the ends; null gives ''."""
    body = F.coalesce(text, F.lit(""))
    composed = F.coalesce(_nfkc(F.when(~_plain(body), body)), body)
    return F.trim(F.regexp_replace(F.regexp_replace(composed, _INVISIBLE, ""), _SPACES, " "))


def fold(text: Column) -> Column:
    """Case folding: lower case with sharp s as ss, by the standard library where more is needed."""
    return F.coalesce(_casefold(F.when(~_plain(text), text)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def normalize_for_hash(text: Column) -> Column:
    return fold(normalize_text(text))


def text_hash(text: Column) -> Column:
    """SHA-256 (hex) of the folded normal form."""
    return F.sha2(normalize_for_hash(text), 256)


def count_words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the normal form."""
    return F.regexp_count(normalize_text(text), F.lit(r"[\p{L}\p{M}\p{N}_]+")).cast("long")


def count_blank_words(text: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")).cast("long")


def truncate(text: Column, most: int) -> Column:
    """The normal form, cut to ``most`` characters with an ellipsis as the last one."""
    t = normalize_text(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def normalize_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(fold(tag), _SPACES, " "))


def occurrences(text: Column, *parts: str) -> Column:
    """How often the single characters occur."""
    n = F.lit(0)
    for p in parts:
        n = n + F.char_length(text) - F.char_length(F.replace(text, F.lit(p), F.lit("")))
    return n.cast("long")


def structure(text: Column) -> dict[str, Column]:
    """Counts of a text's shape."""
    t = F.coalesce(text, F.lit(""))
    dashes = occurrences(t, "-", "—")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return {
        "line_count": F.greatest(F.lit(1).cast("long"), occurrences(t, "\n") + 1),
        "sentence_count": F.greatest(F.lit(1).cast("long"), F.regexp_count(t, F.lit("[.!?]+")).cast("long")),
        "dash_count": dashes,
        "question_count": occurrences(t, "?"),
        "exclamation_count": occurrences(t, "!"),
        "comma_count": occurrences(t, ","),
        "quote_count": occurrences(t, '"', "«", "»"),
        "char_count": F.char_length(t).cast("long"),
        "blank_word_count": count_blank_words(t),
        "looks_like_dialogue": dashes >= 2,
        "uppercase_ratio": F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(F.lit(1), letters),
    }


def block_key(text: Column, length: int = 24) -> Column:
    """Folded first characters of the normal form: near-duplicate candidates share them."""
    return fold(F.substring(normalize_text(text), 1, length))


def parse_params(text: Column) -> Column:
    """``k=v;k=v`` as a map; keys and values are trimmed, pieces without ``=`` are left out."""
    pieces = F.filter(F.split(text, ";"), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pieces, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_replace(p, r"^[^=]*=", ""))))
    return F.map_from_entries(entries)


def parse_json_list(text: Column) -> Column:
    """A JSON list of strings; null and blank give none, text that is no list gives itself, a JSON string its content."""
    parsed = F.from_json(text, "array<string>")
    scalar = F.array(F.regexp_replace(F.trim(text), r'^"(.*)"$', "$1"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, scalar))


def parse_rating(number: Column, rates: Column) -> Column:
    """A signed whole number; where the first field is absent, the first ``;`` piece of the second."""
    first = F.replace(F.trim(number), F.lit("+"), F.lit("")).try_cast("int")
    return F.when(number.isNotNull(), first).otherwise(F.trim(F.substring_index(rates, ";", 1)).try_cast("int"))


def parse_date(text: Column, year: Column, month: Column) -> Column:
    """ISO date of the first dd.mm.yyyy in a text; else the month's first day."""
    g = lambda i: F.regexp_extract(text, r"(\d{2})\.(\d{2})\.(\d{4})", i)
    found = F.concat_ws("-", g(3), g(2), g(1))
    return F.when(g(3) != "", found).otherwise(F.format_string("%04d-%02d-01", year.cast("int"), month.cast("int")))


def join_url(base: str, link: Column) -> Column:
    """Absolute form of a link on a host: absolute links stay, others are put below ``base``."""
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, "^/+", "")))
