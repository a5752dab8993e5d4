"""Scalar rules on labels, languages, splits and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.functions.normalize import WHITESPACE
from labelweave.schema import LABELS, SPLIT_ALIASES, SPLITS

# Spellings accepted for each label, and the two scripts of the code-switch class.
ANNOTATION_VARIANTS = {"POSITIVE": "POS", "+": "POS", "NEGATIVE": "NEG", "-": "NEG", "NEUTRAL": "NEU", "0": "NEU"}
DECISION_VARIANTS = {
    "POSITIVE": "POS", "+": "POS", "POS-": "POS", "+POS": "POS",
    "NEGATIVE": "NEG", "-": "NEG", "NEG-": "NEG", "-NEG": "NEG",
    "NEUTRAL": "NEU", "0": "NEU", "NEU-": "NEU",
}
KHMER = r"[\x{1780}-\x{17FF}]"
LATIN = "[A-Za-z]"
MAX_TEXT_CHARS = 4000


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def upper_label(c: Column | str) -> Column:
    return F.upper(strip(F.coalesce(as_column(c), F.lit(""))))


def _spelling(c: Column, variants: dict[str, str]) -> Column:
    found = None
    for target in dict.fromkeys(variants.values()):
        spelled = c.isin([k for k, v in variants.items() if v == target])
        found = F.when(spelled, target) if found is None else found.when(spelled, target)
    return found.otherwise(c)


def annotation_label(c: Column | str) -> Column:
    return _spelling(upper_label(c), ANNOTATION_VARIANTS)


def decision_label(c: Column | str) -> Column:
    return _spelling(upper_label(c), DECISION_VARIANTS)


def canonical_split(c: Column | str) -> Column:
    """train / val / test, with aliases; anything else is null."""
    low = F.lower(strip(c))
    out = F.when(low.isin(list(SPLITS)), low)
    for alias, target in SPLIT_ALIASES.items():
        out = out.when(low == alias, target)
    return out


def code_switch(c: Column | str, first: str = KHMER, second: str = LATIN,
                names: tuple[str, str] = ("km", "en")) -> Column:
    c = as_column(c)
    a, b = c.rlike(first), c.rlike(second)
    return (F.when(a & b, f"{names[0]}+{names[1]}").when(a, names[0]).when(b, names[1]).otherwise("other"))


def rejection_reason(text: Column | str, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Why a text is refused for scoring; null when it is accepted."""
    return F.when(is_blank(text), "empty").when(F.length(as_column(text)) > max_chars, "too_long")


def lang_index(lang: Column | str, langs: Sequence[str]) -> Column:
    """Position in the list of languages; -1 when unknown or missing."""
    known = F.array(*[F.lit(l.lower()) for l in langs])
    return F.coalesce(F.array_position(known, F.lower(as_column(lang))).cast("int") - 1, F.lit(-1))


def number(c: Column | str) -> Column:
    """Number, or a string that holds one; otherwise null."""
    return strip(as_column(c).cast("string")).try_cast("double")


def adjudication_note(item_id, text, label_a, label_b) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- Item ID: "), as_column(item_id)),
        F.concat(F.lit("- Text (de-identified): "), as_column(text)),
        F.concat(F.lit("- Label A: "), as_column(label_a)),
        F.concat(F.lit("- Label B: "), as_column(label_b)),
        F.lit(f"- Final Label: <{'/'.join(LABELS)}>"),
        F.lit("- Rationale: <why chosen>"),
    )


def review_note(item_id, text, gold, predicted) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- Item ID: "), as_column(item_id)),
        F.concat(F.lit("- Text (de-identified): "), as_column(text)),
        F.concat(F.lit("- Label A: "), as_column(gold)),
        F.concat(F.lit("- Label B: "), as_column(predicted), F.lit(" (model)")),
        F.lit(f"- Final Label: <{'/'.join(LABELS)}>"),
        F.lit("- Action Items: <add example/update guidelines/augment data>"),
    )


def file_safe(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), "[^A-Za-z0-9_-]", "_")


def token_length_flags(tokens: Column | str, max_length: int) -> Column:
    """Token count and whether it reached the limit."""
    n = F.size(as_column(tokens))
    return F.struct(n.alias("seq_len"), (n >= max_length).alias("truncated"))
