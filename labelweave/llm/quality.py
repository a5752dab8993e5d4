"""Quality rules: a learned decision list over text statistics, in DataFrame operations only.

`text_statistics` derives the statistics, `fit_rules` learns an ordered list of threshold conjunctions by sequential
covering (grow on one part of the labelled rows, prune on the other), and `verdict` turns the list into one ordered
conditional expression.

Defined results: a null, empty or blank text has no words and all counts 0; a null id or label column passes through
(null labels do not train, an id labelled twice counts with its lower label); repeated rows keep one result each;
empty tables give empty results, and no labelled rows give an empty list, which keeps all; only the named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import WORD, bind, bounded, settle, word_array

# Fixed value: the characters the contract counts as symbols.
SYMBOLS = r"[#*$%&|<>]"

FEATURES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "digit_share")


def _same(s: Column, x: Column, at: Column) -> Column:
    return F.coalesce(F.get(s, at)["v"] == x["v"], F.lit(False))


def _words_in_repeated_windows(hashes: Column) -> Column:
    """Words covered by a 3-word window that occurs twice; only texts with a repeated window sort their windows."""
    windows = F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 3, F.lit(0))),
                    lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))))

    def covered(s: Column) -> Column:
        repeated = F.filter(s, lambda x, at: _same(s, x, at - 1) | _same(s, x, at + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return bind(windows, lambda v: F.when(F.size(v) == F.size(F.array_distinct(v)), F.lit(0)).otherwise(
        bind(F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("v"), i.alias("i")))), covered)))


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of every whole text, one row per document, without a shuffle.

    Arrays are bound once inside the expression, so nothing is evaluated again per element however Catalyst moves it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = bind(F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)),
                 lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    words = bind(word_array(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"),
        bind(F.transform(w, lambda x: F.xxhash64(x)), _words_in_repeated_windows).alias("repeat")))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("long")
    parts = docs.select(*keep, words.alias("_w"), lines.alias("_l"), count(SYMBOLS).alias("n_symbols"), count("[A-Z]").alias("n_upper"),
                        count("!").alias("n_exclaim"), count("[0-9]").alias("n_digits"))
    # a non-deterministic step keeps filters on the result from being evaluated a second time below it
    once = lambda c: F.when(F.monotonically_increasing_id() >= 0, F.col(c)).cast("long")
    out = parts.select(*keep, once("_w.n").alias("n_words"), once("_w.chars").alias("word_chars"), once("_w.repeat").alias("n_repeat_words"),
                       once("_l.n").alias("n_lines"), once("_l.dup").alias("n_dup_lines"), "n_symbols", "n_upper", "n_exclaim", "n_digits")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"mean_word_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
                            "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
                            "upper_share": share("n_upper", "word_chars"), "exclaim_share": share("n_exclaim", "word_chars"),
                            "digit_share": share("n_digits", "word_chars")})


def base_failed() -> Column:
    """The contract's fixed rule: too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_sample(labels: DataFrame, label: str, max_rows: int, key: str = "doc_id") -> DataFrame:
    """At most `max_rows` labelled ids, chosen by hash; a repeated id has its lower label."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    return bounded(rows, F.xxhash64(key), max_rows)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def binned(self, cuts: list[float]) -> Column:
        at = F.col(f"_b_{self.feature}")
        return at > cuts.index(self.cut) if self.above else at <= cuts.index(self.cut)


Rule = tuple[Condition, ...]


def fit_rules(rows: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "label", bad: int = 0, bins: int = 64,
              max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_cover: int = 8) -> list[Rule]:
    """Sequential covering of the `bad` rows.

    Thresholds are quantiles of each feature. A third of the rows prunes what the others grow. Every growth step is one
    query that counts rows by (feature, bin, class, part), of which at most features x bins x 4 rows come back; a rule
    joins the list when it stays at `min_precision` and `min_cover` over the rows no earlier rule covers.
    """
    features = tuple(features)
    shares = [i / bins for i in range(1, bins)] + [0.995]
    cuts_row = rows.agg(*[F.percentile_approx(f, shares, 100_000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in features}
    features = tuple(f for f in features if cuts[f])
    if not features:
        return []
    binned = settle(rows.select(
        (F.col(label) == bad).alias("_bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("_prune"),
        *features, *[sum((F.col(f) > F.lit(c)).cast("int") for c in cuts[f]).alias(f"_b_{f}") for f in features]).coalesce(8), "rules")

    def holds(rule: Rule) -> Column:
        met = F.lit(True)
        for c in rule:
            met = met & c.binned(cuts[c.feature])
        return met

    def tables(open_rows: DataFrame):
        """(feature, part) -> per bin [bad, other]."""
        cells = open_rows.select("_bad", "_prune", F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in features])).alias("x"))
        found = {}
        for r in cells.groupBy("x.f", "x.b", "_bad", "_prune").count().collect():
            found.setdefault((r["f"], r["_prune"]), {}).setdefault(r["b"], [0, 0])[0 if r["_bad"] else 1] += r["count"]
        return found

    def totals(found, part):
        cells = found.get((features[0], part), {}).values()
        return sum(c[0] for c in cells), sum(c[1] for c in cells)

    def candidates(found, part):
        for f in features:
            cells, (bad_all, other_all) = found.get((f, part), {}), totals(found, part)
            bad_below = other_below = 0
            for i, cut in enumerate(cuts[f]):
                b, o = cells.get(i, (0, 0))
                bad_below, other_below = bad_below + b, other_below + o
                yield Condition(f, False, cut), bad_below, other_below
                yield Condition(f, True, cut), bad_all - bad_below, other_all - other_below

    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        rule, trail, here = (), [], left
        while len(rule) < max_conditions:
            found = tables(here)
            bad_all, other_all = totals(found, False)
            if rule:
                trail.append((rule, *totals(found, True), bad_all, other_all))
            if not bad_all or (rule and other_all == 0):
                break
            best, gain = None, 1e-9
            log_all = _log_share(bad_all, other_all)
            for c, b, o in candidates(found, False):
                if b >= min_cover and (g := b * (_log_share(b, o) - log_all)) > gain:
                    best, gain = c, g
            if best is None:
                break
            rule += (best,)
            here = here.where(best.binned(cuts[best.feature]))
        if rule and (not trail or trail[-1][0] != rule):
            found = tables(here)
            trail.append((rule, *totals(found, True), *totals(found, False)))
        # prune: the shortest prefix that does best on the rows kept back
        worth = [(r, (b - o) / max(b + o, 1), b + gb, o + go) for r, b, o, gb, go in trail if b + gb >= min_cover]
        if not worth:
            break
        kept, _, b, o = max(worth, key=lambda x: (round(x[1], 6), -len(x[0])))
        if b < min_precision * (b + o):
            break
        rules.append(kept)
        left = left.where(~holds(kept))
    return [_with_margin(binned, rule) for rule in rules]


def _with_margin(rows: DataFrame, rule: Rule) -> Rule:
    """Cuts moved to the middle between the labelled values on their two sides."""
    sides = rows.agg(*[F.struct(F.max(F.when(F.col(c.feature) <= c.cut, F.col(c.feature))).alias("low"),
                                F.min(F.when(F.col(c.feature) > c.cut, F.col(c.feature))).alias("high")).alias(f"_{i}")
                       for i, c in enumerate(rule)]).first()
    return tuple(c if None in side else Condition(c.feature, c.above, (side["low"] + side["high"]) / 2)
                 for c, side in zip(rule, sides))


def _log_share(bad: int, other: int) -> float:
    import math

    return math.log((bad + 0.5) / (bad + other + 1))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, or null: one ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    chain = None
    for number, rule in enumerate(rules):
        met = rule[0].column()
        for c in rule[1:]:
            met = met & c.column()
        chain = F.when(met, number) if chain is None else chain.when(met, number)
    return chain.cast("int")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> list[Rule]:
    """Rules from the labelled documents; `max_labelled` bounds the rows that train, and what is broadcast to find them."""
    sample = labelled_sample(labels, "quality", max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    return fit_rules(text_statistics(rows, keep=("doc_id", "label")).where(~base_failed()), **options)


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics, the fixed rule and the verdict of the list for every document."""
    failed = base_failed()
    return (text_statistics(docs, keep=keep).withColumn("base_failed", failed)
            .withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
