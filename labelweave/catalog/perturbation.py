"""Reproducible perturbations and stress evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.registry import query
from labelweave.catalog.views import documents, noisy, sql_hash, sql_uniform, with_views
from labelweave.functions import perturb as T

SEVERITY, SEED = 0.6, 7


def _sql_list(values):
    return "[" + ", ".join(" || ".join(f"chr({ord(c)})" for c in v) for v in values) + "]"


def _row_seed(stream):
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(id AS VARCHAR), '{stream}')), 1, 8) AS BIGINT)"


def _mixed(seed, i):
    x = f"(({seed} + CAST({i} AS BIGINT) * {T._STEP}) % {T._PRIME})"
    return f"(({x} * {x}) % {T._PRIME})"


def _below(draw, p):
    return f"{draw} < {int(p * T._PRIME)}"


def _index(n, *tags):
    parts = ", ".join(f"'{t}'" for t in tags)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(id AS VARCHAR), {parts})), 1, 8) AS BIGINT) % {n} + 1)"


def _sql_map(text, body):
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: {body}), '')"


def _sql_diacritics(source):
    body = (f"CASE WHEN c >= chr({0x17B4}) AND c <= chr({0x17D3}) AND {_below(_mixed('s1', 'i - 1'), SEVERITY)} "
            f"THEN CASE WHEN {_below(_mixed('s2', 'i - 1'), 0.5)} THEN '' ELSE c || c END ELSE c END")
    return f"""SELECT id, {_sql_map('text', body)} AS text
               FROM (SELECT id, text, {_row_seed('diacritics')} AS s1, {_row_seed('diacritics-fate')} AS s2 FROM {source})"""


def _sql_zero_width(source, severity):
    body = (f"CASE WHEN {_below(_mixed('s1', 'i - 1'), 0.2 * severity)} THEN c || "
            f"{_sql_list(T.ZERO_WIDTH_MARKS)}[{_mixed('s2', 'i - 1')} % 4 + 1] ELSE c END")
    return f"""SELECT id, {_sql_map('text', body)} AS text
               FROM (SELECT id, text, {_row_seed('zero_width')} AS s1, {_row_seed('zero_width-mark')} AS s2 FROM {source})"""


_TIMES = 2 + int(SEVERITY * 3)
_LOOK_FROM = "'" + T.LOOKALIKE_FROM + "'"
_LOOK_TO = " || ".join(f"chr({ord(c)})" for c in T.LOOKALIKE_TO)
SQL = {
    "diacritics": _sql_diacritics("noisy"),
    "zero_width": _sql_zero_width("noisy", SEVERITY),
    "emoji_burst": "SELECT id, text || ' ' || " + " || ".join(
        f"{_sql_list(T.EMOJIS)}[{_index(len(T.EMOJIS), 'emoji', str(i))}]" for i in range(max(1, int(1 + SEVERITY * 5)))) + " AS text FROM noisy",
    "elongation": f"""SELECT id, array_to_string(list_transform(chars, lambda c, i:
          CASE WHEN (i = 1 OR chars[i - 1] <> c) AND (i = len(chars) OR chars[i + 1] <> c) AND {_below(_mixed('s1', 'i - 1'), 0.6 * SEVERITY)}
               THEN repeat(c, {_TIMES}) ELSE c END), '') AS text
        FROM (SELECT id, string_split(text, '') AS chars, {_row_seed('elongation')} AS s1 FROM noisy)""",
    "mixed_script": f"""SELECT id, {_sql_map('text', f"CASE WHEN contains({_LOOK_FROM}, c) AND {_below(_mixed('s1', 'i - 1'), SEVERITY)} THEN translate(c, {_LOOK_FROM}, {_LOOK_TO}) ELSE c END")} AS text
        FROM (SELECT id, text, {_row_seed('mixed_script')} AS s1 FROM noisy)""",
    "code_switch": rf"""SELECT id, CASE WHEN u < 0.5::DOUBLE + 0.5::DOUBLE * {SEVERITY}::DOUBLE THEN text || ' ' || phrase ELSE phrase || ' ' || text END AS text
        FROM (SELECT id, text, {sql_uniform(SEED, 'id', "'place'")} AS u,
                     CASE WHEN regexp_matches(text, '[\x{{1780}}-\x{{17FF}}]') THEN {_sql_list(T.PHRASES_EN)}[{_index(len(T.PHRASES_EN), 'phrase')}]
                          ELSE {_sql_list(T.PHRASES_KM)}[{_index(len(T.PHRASES_KM), 'phrase')}] END AS phrase FROM noisy)""",
    "latinized_khmer": "SELECT id, translate(text, " + " || ".join(f"chr({0x17E0 + i})" for i in range(10)) +
                       f", '0123456789') AS text FROM ({_sql_zero_width('(' + _sql_diacritics('noisy') + ')', 1.0)})",
}


def _stress(name):
    @query(f"stress_{name}", with_views("noisy", SQL[name]))
    def run(spark, sf):
        return noisy(spark, sf).select("id", T.perturb(name, "text", "id", SEVERITY, seed=SEED).alias("text"))


for _name in SQL:
    _stress(_name)


@query("stress_share", f"""
    SELECT lang, count(*) AS n, count(*) FILTER ({sql_uniform(SEED, 'doc_id', "'emoji_burst'", "'apply'")} < 0.3::DOUBLE) AS changed
    FROM documents GROUP BY lang""")
def stress_share(spark, sf):
    rows = documents(spark, sf)
    after = T.perturb("emoji_burst", "text", "id", SEVERITY, prob=0.3, seed=SEED)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(after != F.col("text"), 1)).alias("changed"))
