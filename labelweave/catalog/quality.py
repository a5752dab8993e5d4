"""Dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.registry import query
from labelweave.catalog.views import raw_rows, with_views
from labelweave.operators import quality as Q

LANGS = ("de", "en", "es", "fr", "km")

ROW_ISSUES = """
  SELECT seq, id, rule, detail FROM (
    SELECT seq, id, unnest([
      CASE WHEN id = '' THEN {'rule': 'empty id', 'detail': ''} END,
      CASE WHEN trim(text) = '' THEN {'rule': 'empty text', 'detail': ''} END,
      CASE WHEN trim(label) = '' THEN {'rule': 'empty label', 'detail': ''}
           WHEN upper(trim(label)) NOT IN ('POS', 'NEG', 'NEU') THEN {'rule': 'invalid label', 'detail': upper(trim(label))} END,
      CASE WHEN trim(lang) = '' THEN {'rule': 'empty lang', 'detail': ''}
           WHEN lower(trim(lang)) NOT IN ('de', 'en', 'es', 'fr', 'km') THEN {'rule': 'invalid lang', 'detail': lower(trim(lang))} END,
      CASE WHEN trim(split) = '' THEN {'rule': 'empty split', 'detail': ''}
           WHEN lower(trim(split)) NOT IN ('train', 'val', 'test') THEN {'rule': 'invalid split', 'detail': lower(trim(split))} END
    ]) AS i FROM raw_rows), (SELECT 1) WHERE i IS NOT NULL"""
ROW_ISSUES = ROW_ISSUES.replace("SELECT seq, id, rule, detail FROM (", "SELECT seq, id, i.rule AS rule, i.detail AS detail FROM (").replace(
    "), (SELECT 1) WHERE", ") WHERE")
DUPLICATES = """
  SELECT seq, id, 'duplicate id' AS rule, '' AS detail
  FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM raw_rows) WHERE r > 1"""
CONFLICTS = """
  SELECT seq, id, 'several splits' AS rule, before || ' -> ' || s AS detail
  FROM (SELECT seq, id, s, lag(s) OVER (PARTITION BY id ORDER BY seq) AS before
        FROM (SELECT seq, id, lower(trim(split)) AS s FROM raw_rows) WHERE s IN ('train', 'val', 'test'))
  WHERE before <> s"""
LEAKAGE = """
  SELECT "group", string_agg(s, ',' ORDER BY s) AS splits, count(*) AS n_splits
  FROM (SELECT DISTINCT trim("group") AS "group", lower(trim(split)) AS s FROM raw_rows
        WHERE trim("group") <> '' AND trim(split) <> '')
  GROUP BY "group" HAVING count(*) > 1"""
ALL_ISSUES = f"""{ROW_ISSUES} UNION ALL {DUPLICATES} UNION ALL {CONFLICTS} UNION ALL
  SELECT NULL, NULL, 'group spans splits', "group" || ': ' || splits FROM ({LEAKAGE})"""


def _all(spark, sf):
    return Q.issues(raw_rows(spark, sf), group="group", lang="lang", split="split", langs=LANGS)


@query("validate_issues", with_views("raw_rows", ALL_ISSUES))
def validate_issues(spark, sf):
    return _all(spark, sf)


@query("row_issues", with_views("raw_rows", ROW_ISSUES))
def row_issues(spark, sf):
    return Q.row_level(raw_rows(spark, sf), lang="lang", split="split", langs=LANGS)


@query("dup_ids", with_views("raw_rows", DUPLICATES))
def dup_ids(spark, sf):
    return Q.duplicate_ids(raw_rows(spark, sf))


@query("split_conflicts", with_views("raw_rows", CONFLICTS))
def split_conflicts(spark, sf):
    return Q.split_conflicts(raw_rows(spark, sf))


@query("group_leakage", with_views("raw_rows", LEAKAGE))
def group_leakage(spark, sf):
    return Q.group_leakage(raw_rows(spark, sf))


@query("validate_verdict", with_views("raw_rows", f"""
    SELECT count(*) AS issues, count(*) FILTER (rule <> 'group spans splits') AS errors,
           CASE WHEN count(*) FILTER (rule <> 'group spans splits') = 0 THEN 'PASSED' ELSE 'FAILED' END AS verdict
    FROM ({ALL_ISSUES})"""))
def validate_verdict(spark, sf):
    return Q.verdict(_all(spark, sf))


@query("validate_shown", with_views("raw_rows", f"SELECT * FROM ({ALL_ISSUES}) ORDER BY seq NULLS LAST, rule, detail LIMIT 500"))
def validate_shown(spark, sf):
    return Q.shown_issues(_all(spark, sf))


@query("validate_summary", with_views("raw_rows", """
    SELECT count(*) AS total_rows, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS duplicate_ids,
           count(*) FILTER (trim(text) = '') AS empty_text,
           round(count(*) FILTER (trim(text) = '')::DOUBLE / count(*) * 100.0, 6) AS empty_text_pct,
           count(*) FILTER (trim("group") <> '') AS group_nonempty
    FROM raw_rows"""))
def validate_summary(spark, sf):
    return Q.summary(raw_rows(spark, sf), group="group").withColumn("empty_text_pct", F.round("empty_text_pct", 6))


@query("validate_distributions", with_views("raw_rows", """
    SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT 'label' AS dimension, upper(trim(label)) AS value, 1 AS n FROM raw_rows
      UNION ALL SELECT 'lang', lower(trim(lang)), 1 FROM raw_rows
      UNION ALL SELECT 'lang', unnest(['de', 'en', 'es', 'fr', 'km']), 0
      UNION ALL SELECT 'split', lower(trim(split)), 1 FROM raw_rows
      UNION ALL SELECT 'codeswitch',
        CASE WHEN km AND en THEN 'km+en' WHEN km THEN 'km' WHEN en THEN 'en' ELSE 'other' END, 1
        FROM (SELECT regexp_matches(text, '[\\x{1780}-\\x{17FF}]') AS km, regexp_matches(text, '[A-Za-z]') AS en
              FROM raw_rows WHERE text <> '')) GROUP BY dimension, value"""))
def validate_distributions(spark, sf):
    return Q.distributions(raw_rows(spark, sf), lang="lang", split="split", langs=LANGS)


@query("missing_columns", "SELECT 'sentiment' AS \"column\", 'missing column' AS rule, count(*) AS rows FROM documents")
def missing_columns(spark, sf):
    return Q.missing_columns(raw_rows(spark, sf), optional=["group", "sentiment"])
