"""Reproducible text perturbations.

Every random draw is a function of (seed, row key, preset, character position), so a perturbed corpus does not
depend on partitioning. The per-row seeds are md5 draws; per-character draws square (seed + position * step) modulo
a prime, three integer operations per character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.functions import normalize as norm
from labelweave.functions.labels import KHMER, as_column
from labelweave.schema import draw_index, keyed_hash, uniform

# The characters and phrases the perturbations insert.
ZERO_WIDTH_MARKS = ["\u200b", "\u200c", "\u200d", "\ufeff"]
KHMER_MARK_FIRST, KHMER_MARK_LAST = "\u17b4", "\u17d3"
EMOJIS = ["😀", "😁", "😂", "🤣", "😅", "😊", "😍", "😡", "😭", "👍", "👎", "🔥", "✨", "💯", "❗"]
LOOKALIKE_FROM = "ABCEHKMOPTXYaeopcxy"
LOOKALIKE_TO = (
    "\u0410\u0392\u0421\u0415\u041d\u039a\u039c\u041e\u0420\u0422\u03a7\u03a5"
    "\u0430\u0435\u043e\u0440\u0441\u0445\u0443"
)
PHRASES_EN = ["ok", "wow", "haha", "lol", "great", "bad", "love", "hate"]
PHRASES_KM = ["ល្អ", "អាក្រក់", "សុខចិត្ត", "ច្រណែន", "ពិតៗ", "អូហូ"]

_PRIME = 2147483647
_STEP = 1640531527


def _share(p: float) -> float:
    return min(1.0, max(0.0, float(p)))


def _row_seed(seed, key: Column, stream: str) -> Column:
    return F.conv(F.substring(keyed_hash(seed, key, F.lit(stream)), 1, 8), 16, 10).cast("long")


def _drawn(row_seed: Column, position: Column) -> Column:
    """Integer draw in [0, _PRIME) for one character."""
    x = (row_seed + position.cast("long") * F.lit(_STEP)) % F.lit(_PRIME)
    return (x * x) % F.lit(_PRIME)


def _below(draw: Column, p: float) -> Column:
    return draw < F.lit(int(_share(p) * _PRIME))


def _map_chars(text: Column, key: Column, seed, streams: list[str],
               rule: Callable[[Column, Column, Column], Column]) -> Column:
    """Rewrite a text character by character: ``rule(char, position, row)``.

    ``row`` carries the characters and one seed per stream. It is bound as the only element of an array, so both are
    worked out once per text rather than once per character. Empty text is one empty piece, which rules pass through.
    """
    row = F.struct(F.split(text, "").alias("chars"), *[_row_seed(seed, key, s).alias(f"seed{i}") for i, s in enumerate(streams)])
    rewritten = F.transform(F.array(row), lambda r: F.array_join(
        F.transform(r["chars"], lambda c, i: rule(c, i, r)), ""))
    return F.get(rewritten, F.lit(0))


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def diacritics(text: Column, key: Column, severity: float, seed=0) -> Column:
    """Each Khmer vowel sign or mark is, with p = severity, dropped or doubled."""
    def rule(c, i, row):
        hit = c.between(KHMER_MARK_FIRST, KHMER_MARK_LAST) & _below(_drawn(row["seed0"], i), severity)
        return F.when(hit, F.when(_below(_drawn(row["seed1"], i), 0.5), "").otherwise(F.concat(c, c))).otherwise(c)

    marked = text.rlike(f"[{KHMER_MARK_FIRST}-{KHMER_MARK_LAST}]")
    return F.when(marked, _map_chars(text, key, seed, ["diacritics", "diacritics-fate"], rule)).otherwise(text)


def zero_width(text: Column, key: Column, severity: float, seed=0) -> Column:
    """After each character, with p = 0.2 severity, one of four invisible marks."""
    marks = _literal_array(ZERO_WIDTH_MARKS)

    def rule(c, i, row):
        mark = F.get(marks, (_drawn(row["seed1"], i) % 4).cast("int"))
        return F.when((c != "") & _below(_drawn(row["seed0"], i), 0.2 * _share(severity)), F.concat(c, mark)).otherwise(c)

    return _map_chars(text, key, seed, ["zero_width", "zero_width-mark"], rule)


def emoji_burst(text: Column, key: Column, severity: float, seed=0) -> Column:
    burst = max(1, int(1 + severity * 5))
    emojis = _literal_array(EMOJIS)
    picked = [F.element_at(emojis, draw_index(len(EMOJIS), seed, key, F.lit("emoji"), F.lit(i))) for i in range(burst)]
    return F.concat(text, F.lit(" "), *picked)


def elongation(text: Column, key: Column, severity: float, seed=0) -> Column:
    """A character that differs from both neighbours is, with p = 0.6 severity, repeated."""
    times = 2 + int(_share(severity) * 3)

    def rule(c, i, row):
        before, after = F.get(row["chars"], i - 1), F.get(row["chars"], i + 1)
        alone = F.coalesce(before != c, F.lit(True)) & F.coalesce(after != c, F.lit(True))
        return F.when(_below(_drawn(row["seed0"], i), 0.6 * _share(severity)) & alone, F.repeat(c, F.lit(times))).otherwise(c)

    return _map_chars(text, key, seed, ["elongation"], rule)


def mixed_script(text: Column, key: Column, severity: float, seed=0) -> Column:
    """Latin letters become Cyrillic or Greek look-alikes with p = severity."""
    def rule(c, i, row):
        hit = _below(_drawn(row["seed0"], i), severity) & F.lit(LOOKALIKE_FROM).contains(c)
        return F.when(hit, F.translate(c, LOOKALIKE_FROM, LOOKALIKE_TO)).otherwise(c)

    return _map_chars(text, key, seed, ["mixed_script"], rule)


def code_switch(text: Column, key: Column, severity: float, seed=0) -> Column:
    """A phrase of the other language, as a suffix with p = 0.5 + 0.5 severity, else as a prefix."""
    def pick(phrases):
        return F.element_at(_literal_array(phrases), draw_index(len(phrases), seed, key, F.lit("phrase")))

    phrase = F.when(text.rlike(KHMER), pick(PHRASES_EN)).otherwise(pick(PHRASES_KM))
    at_end = uniform(seed, key, F.lit("place")) < 0.5 + 0.5 * severity
    return F.when(at_end, F.concat(text, F.lit(" "), phrase)).otherwise(F.concat(phrase, F.lit(" "), text))


def latinized_khmer(text: Column, key: Column, severity: float, seed=0) -> Column:
    """Marks perturbed, invisible marks inserted at full severity, Khmer digits to ASCII."""
    return norm.khmer_digits(zero_width(diacritics(text, key, severity, seed), key, 1.0, seed))


TRANSFORMS: dict[str, Callable[..., Column]] = {}


def register_transform(name: str, transform: Callable[..., Column]) -> None:
    """Add a named transform ``f(text, key, severity, seed) -> Column``."""
    TRANSFORMS[name] = transform


for _preset in (diacritics, zero_width, emoji_burst, elongation, mixed_script, code_switch, latinized_khmer):
    register_transform(_preset.__name__, _preset)


def perturb(name: str, text: Column | str, key: Column | str, severity: float = 0.5, prob: float = 1.0, seed=0) -> Column:
    """Apply a named transform to the rows whose draw falls below ``prob``."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; known: {sorted(TRANSFORMS)}")
    text, key = as_column(text), as_column(key)
    changed = TRANSFORMS[name](text, key, severity, seed)
    if prob >= 1.0:
        return changed
    return F.when(uniform(seed, key, F.lit(name), F.lit("apply")) < _share(prob), changed).otherwise(text)
