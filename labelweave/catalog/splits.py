"""Splits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.registry import query
from labelweave.catalog.views import draw, labelled, sql_draw, sql_hash, sql_uniform, with_views
from labelweave.operators import quality as Q
from labelweave.operators import sampling as S
from labelweave.operators.ordering import last_rows

RATIOS = (0.8, 0.1, 0.1)
SQL_RATIOS = "0.8::DOUBLE", "0.1::DOUBLE"


def _sql_stratified(bucket):
    place = sql_hash(42, "id")
    return f"""SELECT id, CASE WHEN r <= floor(n * {SQL_RATIOS[0]}) THEN 'train'
                               WHEN r <= floor(n * {SQL_RATIOS[0]}) + floor(n * {SQL_RATIOS[1]}) THEN 'val' ELSE 'test' END AS split
               FROM (SELECT id, row_number() OVER (PARTITION BY {bucket} ORDER BY {place}, CAST(id AS VARCHAR)) AS r,
                            count(*) OVER (PARTITION BY {bucket}) AS n FROM labelled)"""


@query("split_stratified", with_views("labelled", _sql_stratified("label")))
def split_stratified(spark, sf):
    return S.stratified_split(labelled(spark, sf, text=False), *RATIOS).select("id", "split")


@query("split_strat_lang", with_views("labelled", _sql_stratified("label, lower(coalesce(lang, 'unk'))")))
def split_strat_lang(spark, sf):
    return S.stratified_split(labelled(spark, sf, text=False), *RATIOS, by_lang=True).select("id", "split")


@query("split_approx", with_views("labelled", f"""
    SELECT id, CASE WHEN u < {SQL_RATIOS[0]} THEN 'train' WHEN u < {SQL_RATIOS[0]} + {SQL_RATIOS[1]} THEN 'val' ELSE 'test' END AS split
    FROM (SELECT id, {sql_uniform(42, 'id')} AS u FROM labelled)"""))
def split_approx(spark, sf):
    return S.stratified_split(labelled(spark, sf, text=False), *RATIOS, approx=True).select("id", "split")


# Groups of uneven size, some rows without one.
GROUPS = f"""SELECT id, label, lang, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 3 = 0 THEN 'big' ELSE "group" || '-' || CAST(n % 13 AS VARCHAR) END AS "group"
             FROM (SELECT *, {sql_draw('group', 'id')} AS n FROM labelled)"""


def _grouped(spark, sf):
    n = draw("group", "id")
    group = (F.when(n % 11 == 0, F.lit(None)).when(n % 3 == 0, "big")
             .otherwise(F.concat("group", F.lit("-"), (n % 13).cast("string"))))
    return labelled(spark, sf, text=False).withColumn("group", group)


_KEYED = f"SELECT *, coalesce(\"group\", '__nogroup_' || CAST(id AS VARCHAR)) AS g FROM ({GROUPS})"


def sql_group_split(columns):
    """Rows of `keyed` with the split of their group `g`."""
    return f"""
    SELECT {columns}, CASE WHEN t.g IS NULL THEN 'train' WHEN t.is_test THEN 'test' ELSE 'val' END AS split
    FROM keyed k LEFT JOIN (
      SELECT g, row_number() OVER (ORDER BY {sql_hash(43, 'g')}, g) <= ceil(count(*) OVER () * (0.1::DOUBLE / (0.1::DOUBLE + 0.1::DOUBLE))) AS is_test
      FROM (SELECT g, row_number() OVER (ORDER BY {sql_hash(42, 'g')}, g) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM keyed))
      WHERE r <= ceil(n * (0.1::DOUBLE + 0.1::DOUBLE))) t ON t.g = k.g"""


@query("split_group", with_views("labelled", sql_group_split("k.id"), keyed=_KEYED))
def split_group(spark, sf):
    return S.group_split(_grouped(spark, sf), *RATIOS).select("id", "split")


def _sql_greedy(ratios):
    """Groups, largest first, each to the side whose counts then miss its targets least."""
    sides, classes = range(3), ("NEG", "NEU", "POS")
    error = lambda i: " + ".join(f"abs(s{i}_{c} + {c} - t_{c} * {ratios[i]}::DOUBLE)" for c in classes)
    state = ", ".join(f"s{i}_{c} + CASE WHEN side = {i} THEN {c} ELSE 0 END AS s{i}_{c}" for i in sides for c in classes)
    held = ", ".join(f"w.s{i}_{c}" for i in sides for c in classes)
    return f"""
    SELECT k.id, k."group", CASE w.side WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM keyed k JOIN (
      WITH RECURSIVE groups AS (
        SELECT g, row_number() OVER (ORDER BY count(*) DESC, g) AS r, {', '.join(f"CAST(count(*) FILTER (label = '{c}') AS DOUBLE) AS {c}" for c in classes)}
        FROM keyed GROUP BY g),
      totals AS (SELECT {', '.join(f'sum({c}) AS t_{c}' for c in classes)} FROM groups),
      walk AS (
        SELECT CAST(0 AS BIGINT) AS r, CAST('' AS VARCHAR) AS g, -1 AS side, {', '.join(f'CAST(0 AS DOUBLE) AS s{i}_{c}' for i in sides for c in classes)}
        UNION ALL
        SELECT r, g, side, {state} FROM (
          SELECT *, CASE WHEN e0 <= e1 AND e0 <= e2 THEN 0 WHEN e1 <= e2 THEN 1 ELSE 2 END AS side FROM (
            SELECT *, {', '.join(f'{error(i)} AS e{i}' for i in sides)} FROM (
              SELECT n.r, n.g, {', '.join('n.' + c for c in classes)}, {held}, {', '.join('t_' + c for c in classes)}
              FROM walk w JOIN groups n ON n.r = w.r + 1 CROSS JOIN totals))))
      SELECT g, side FROM walk WHERE r > 0) w ON w.g = k.g"""


@query("split_group_stratified", with_views("labelled", _sql_greedy((0.6, 0.2, 0.2)), keyed=_KEYED))
def split_group_stratified(spark, sf):
    return S.group_stratified_split(_grouped(spark, sf), 0.6, 0.2, 0.2).select("id", "group", "split")


@query("split_group_leaks", """SELECT "group", '' AS splits, 0 AS n_splits FROM (SELECT source AS "group" FROM documents WHERE false)""")
def split_group_leaks(spark, sf):
    return Q.group_leakage(S.group_split(_grouped(spark, sf), *RATIOS))


@query("split_fallback", with_views("labelled", _sql_stratified("label")))
def split_fallback(spark, sf):
    rows = labelled(spark, sf, text=False).withColumn("group", F.lit(" "))
    return S.group_split_or_stratified(rows, *RATIOS).select("id", "split")


@query("group_order", with_views("labelled", "SELECT g AS \"group\", count(*) AS size FROM keyed GROUP BY g", keyed=_KEYED))
def group_order(spark, sf):
    return S.group_sizes(_grouped(spark, sf))


@query("assign_groups", with_views("labelled", """
    SELECT id, "group", CASE "group" WHEN 'src1' THEN 'val' WHEN 'src2' THEN 'test' WHEN 'src3' THEN NULL ELSE 'train' END AS split FROM labelled"""))
def assign_groups(spark, sf):
    rows = labelled(spark, sf, text=False)
    split = F.when(F.col("group") == "src1", "val").when(F.col("group") == "src2", "test").otherwise("train")
    assignment = rows.select("group").distinct().where("`group` <> 'src3'").withColumn("split", split)
    return S.assign_groups(rows, assignment).select("id", "group", "split")


@query("hold_out", with_views("labelled", f"""
    SELECT id, row_number() OVER (ORDER BY {sql_hash(42, 'id')}, CAST(id AS VARCHAR)) <= floor(count(*) OVER () * 0.3::DOUBLE) AS held_out
    FROM labelled"""))
def hold_out(spark, sf):
    return S.hold_out(labelled(spark, sf, text=False), 0.3).select("id", "held_out")


_RANKED = f"""SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'id')}, CAST(id AS VARCHAR)) AS r,
                     count(*) OVER (PARTITION BY label) AS n FROM labelled"""


@query("undersample", with_views("labelled", f"""
    SELECT id, label FROM (SELECT *, min(n) OVER () AS least FROM ({_RANKED})) WHERE r <= least(n, round_even(least * 1.2::DOUBLE, 0))"""))
def undersample(spark, sf):
    return S.undersample(labelled(spark, sf, text=False), 1.2).select("id", "label")


@query("oversample", with_views("labelled", f"""
    SELECT id, label, copy FROM (
      SELECT id, label, unnest(range(1, CAST(target // n + CASE WHEN r <= target % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy
      FROM (SELECT *, greatest(n, CAST(round_even(most * 1.0::DOUBLE, 0) AS BIGINT)) AS target
            FROM (SELECT *, max(n) OVER () AS most FROM ({_RANKED}))))"""))
def oversample(spark, sf):
    return S.oversample(labelled(spark, sf, text=False), 1.0).select("id", "label", "copy")


@query("repair_splits", with_views("labelled", f"""
    SELECT id, CASE WHEN id = (SELECT id FROM labelled WHERE label <> 'POS' AND id % 2 = 0 AND label = (
                                 SELECT min(label) FROM labelled WHERE label <> 'POS' AND id % 2 = 0)
                               ORDER BY {sql_hash(42, 'id')} LIMIT 1) THEN 'train'
                    WHEN label = 'POS' THEN 'train' WHEN id % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM labelled"""))
def repair_splits(spark, sf):
    split = F.when(F.col("label") == "POS", "train").when(F.col("id") % 2 == 0, "val").otherwise("test")
    return S.repair_splits(labelled(spark, sf, text=False).withColumn("split", split)).select("id", "split")


@query("held_out_tail", with_views("labelled", """
    SELECT id FROM (SELECT id, row_number() OVER (ORDER BY seq DESC) AS r, count(*) OVER () AS n FROM labelled)
    WHERE r <= greatest(1, floor(n * 0.05::DOUBLE))"""))
def held_out_tail(spark, sf):
    return last_rows(labelled(spark, sf, text=False), 0.05).select("id")
