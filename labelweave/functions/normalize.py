"""Text normalisation as column expressions; a disabled step adds nothing to the plan."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, fields, replace
from functools import cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and patterns the normalisation rules are defined on.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
KHMER_DIGITS = "\u17e0\u17e1\u17e2\u17e3\u17e4\u17e5\u17e6\u17e7\u17e8\u17e9"
ASCII_DIGITS = "0123456789"
KHMER_STOPS = "\u17d4\u17d5\u17d6"
KHMER_STOPS_ASCII = "..:"
KHMER_REPEAT = "\u17d7"
CURLY = "\u2018\u2019\u201c\u201d\u2013\u2014"
CURLY_ASCII = "''\"\"--"
ELLIPSIS = "\u2026"
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1FAFF}\x{2600}-\x{27BF}]"
EMOJI_TAG = " <EMOJI> "
LATIN_TAG = "<LATIN> "
LATIN_LETTER = "[A-Za-z]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"



def _char_class(points: list[int]) -> str:
    """A regular-expression class of code points, in ranges."""
    starts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    stops = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, stops))


@cache
def _unicode_order() -> tuple[str, str]:
    """Patterns for text that NFC, or the order of its marks, may change; derived from Python's Unicode tables.

    A text is in NFC if no character changes alone, none may join with one before it, and no mark follows a mark of a
    higher class. Characters that join are second in some canonical decomposition (or conjoining vowels and finals). Two
    marks in a row are looked at whatever their classes; a mark behind a base, as Khmer text is full of, is not.
    """
    marks, joins = [], set()
    for p in range(0x110000):
        if 0xD800 <= p <= 0xDFFF or 0xAC00 <= p <= 0xD7A3:
            continue
        c = chr(p)
        if unicodedata.combining(c):
            marks.append(p)
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            codes = [int(x, 16) for x in parts.split()]
            if len(codes) > 1 and unicodedata.normalize("NFC", c) == c:
                joins.add(codes[1])
            if unicodedata.normalize("NFC", c) != c:
                joins.add(p)
    joins |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul syllables, which are composed by rule
    pair = f"[{_char_class(marks)}]{{2}}"
    return f"[{_char_class(sorted(joins))}]|{pair}", pair



@dataclass(frozen=True)
class NormConfig:
    """Switches of the normaliser; all off by default."""

    nfc: bool = False
    whitespace: bool = False
    punct: bool = False
    elongation: bool = False
    emoji: str = "keep"
    remove_zero_width: bool = False
    khmer_digits: str = "keep"
    khmer_punct: bool = False
    diacritics_reorder: bool = False
    latin_action: str = "none"
    latin_threshold: float = 0.2

    @classmethod
    def everything(cls) -> "NormConfig":
        """The all-steps preset."""
        return cls(nfc=True, whitespace=True, punct=True, elongation=True, emoji="map",
                   remove_zero_width=True, khmer_digits="map", khmer_punct=True, diacritics_reorder=True,
                   latin_action="tag")

    def override(self, **changes) -> "NormConfig":
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known and v is not None})


def remove_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


@F.pandas_udf(StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC. Rows that cannot change travel to the Python workers as nulls."""
    return F.coalesce(_nfc_batch(F.when(c.rlike(_unicode_order()[0]), c)), c)


def _order_marks(text: str | None) -> str | None:
    if text is None:
        return None
    runs = [(marked, list(run)) for marked, run in groupby(text, key=lambda ch: unicodedata.combining(ch) > 0)]
    return "".join(
        "".join(sorted(run, key=unicodedata.combining) if marked and at else run)
        for at, (marked, run) in enumerate(runs)
    )


@F.pandas_udf(StringType())
def _order_marks_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_order_marks, na_action="ignore")


def reorder_marks(c: Column) -> Column:
    """Stable order of combining marks after a base character; a leading stray run stays."""
    return F.coalesce(_order_marks_batch(F.when(c.rlike(_unicode_order()[1]), c)), c)


def khmer_digits(c: Column) -> Column:
    return F.translate(c, KHMER_DIGITS, ASCII_DIGITS)


def khmer_punct(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, KHMER_STOPS, KHMER_STOPS_ASCII), KHMER_REPEAT + "+", KHMER_REPEAT)


def emoji(c: Column, mode: str) -> Column:
    if mode == "remove":
        return F.regexp_replace(c, EMOJI, "")
    if mode == "map":
        return F.regexp_replace(c, EMOJI, EMOJI_TAG)
    return c


def elongation(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\n])\1{2,}", "$1$1")


def punct(c: Column) -> Column:
    ascii_only = F.replace(F.translate(c, CURLY, CURLY_ASCII), F.lit(ELLIPSIS), F.lit("..."))
    return F.regexp_replace(ascii_only, r"([!?.,:])\1+", "$1")


def latin_ratio(c: Column) -> Column:
    """Share of ASCII letters among the code points; 0 for empty text."""
    return F.regexp_count(c, F.lit(LATIN_LETTER)) / F.greatest(F.lit(1), F.length(c))


def latin_action(c: Column, action: str, threshold: float) -> Column:
    if action == "tag":
        return F.when(latin_ratio(c) >= threshold, F.concat(F.lit(LATIN_TAG), c)).otherwise(c)
    if action == "strip":
        return F.when(latin_ratio(c) >= threshold, F.regexp_replace(c, LATIN_LETTER, "")).otherwise(c)
    return c


def whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def normalize(c: Column | str, cfg: NormConfig | None) -> Column:
    """The steps of ``cfg`` in their fixed order. Null becomes empty text."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    if cfg is None:
        return c
    if cfg.remove_zero_width:
        c = remove_zero_width(c)
    if cfg.nfc:
        c = nfc(c)
    elif cfg.diacritics_reorder:
        # NFC output is in canonical order already, so the step is only needed without NFC.
        c = reorder_marks(c)
    if cfg.khmer_digits == "map":
        c = khmer_digits(c)
    if cfg.khmer_punct:
        c = khmer_punct(c)
    c = emoji(c, cfg.emoji)
    if cfg.elongation:
        c = elongation(c)
    if cfg.punct:
        c = punct(c)
    c = latin_action(c, cfg.latin_action, cfg.latin_threshold)
    if cfg.whitespace:
        c = whitespace(c)
    return c


def normalize_corpus(df, cfg: NormConfig | None, text: str = "text"):
    return df.withColumn(text, normalize(F.col(text), cfg))
