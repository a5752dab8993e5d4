"""Annotator agreement and label resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.registry import query
from labelweave.catalog.views import LABEL_AT, annotations, draw, labelled, sql_draw, with_views
from labelweave.functions import labels as L
from labelweave.operators import agreement as A
from labelweave.operators import resolve as R
from labelweave.operators.metrics import distribution

LATEST = """SELECT id, annotator, arg_max(label, seq) AS label, arg_max(text, seq) AS text, arg_max(lang, seq) AS lang, min(seq) AS pos
            FROM annotations GROUP BY id, annotator"""


def _sql_pairs(op):
    return f"""SELECT a.id, CASE WHEN length(a.text) >= length(b.text) THEN a.text ELSE b.text END AS text,
                      a.annotator AS annotator_a, a.label AS label_a, b.annotator AS annotator_b, b.label AS label_b
               FROM latest a JOIN latest b ON a.id = b.id AND a.pos < b.pos AND a.label {op} b.label"""


@query("latest_annotations", with_views("annotations", f"SELECT id, annotator, pos, label FROM ({LATEST})"))
def latest_annotations(spark, sf):
    return A.latest_annotations(annotations(spark, sf), keep=())


@query("disagreements", with_views("annotations", _sql_pairs("<>"), latest=LATEST))
def disagreements(spark, sf):
    return A.disagreements(annotations(spark, sf))


@query("agreements", with_views("annotations", _sql_pairs("="), latest=LATEST))
def agreements(spark, sf):
    return A.agreements(annotations(spark, sf))


def _logged(spark, sf):
    """Items an adjudicator decided already."""
    items = labelled(spark, sf, text=False).where(draw("logged", "id") % 4 == 0)
    n = draw("decided", "id")
    return items.select("id", F.element_at(F.array(*[F.lit(l) for l in LABEL_AT]), (n % 3 + 1).cast("int")).alias("final_label"),
                        "seq")


DECISIONS = f"""SELECT id, CASE {sql_draw('decided', 'id')} % 3 WHEN 0 THEN 'POS' WHEN 1 THEN 'NEG' ELSE 'NEU' END AS final_label
                FROM labelled WHERE {sql_draw('logged', 'id')} % 4 = 0"""


@query("queue_anti", with_views(
    "annotations", f"SELECT * FROM ({_sql_pairs('<>')}) WHERE id NOT IN (SELECT id FROM decisions)", latest=LATEST, decisions=DECISIONS))
def queue_anti(spark, sf):
    return A.queue_new(A.disagreements(annotations(spark, sf)), _logged(spark, sf))


@query("adjudication_notes", with_views("annotations", f"""
    SELECT id, annotator_a, annotator_b, '- Item ID: ' || CAST(id AS VARCHAR) || chr(10) || '- Text (de-identified): ' || text || chr(10) ||
           '- Label A: ' || label_a || chr(10) || '- Label B: ' || label_b || chr(10) ||
           '- Final Label: <POS/NEG/NEU>' || chr(10) || '- Rationale: <why chosen>' AS note
    FROM ({_sql_pairs('<>')})""", latest=LATEST))
def adjudication_notes(spark, sf):
    pairs = A.disagreements(annotations(spark, sf))
    return pairs.select("id", "annotator_a", "annotator_b",
                        L.adjudication_note(F.col("id").cast("string"), "text", "label_a", "label_b").alias("note"))


FIRST_TWO = """SELECT id, max(CASE WHEN r = 1 THEN label END) AS label_a, max(CASE WHEN r = 2 THEN label END) AS label_b
               FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM latest) WHERE r <= 2
               GROUP BY id HAVING max(r) = 2"""


def _sql_kappa(counts, by, at_one):
    keys = ", ".join(by)
    lead = f"{keys}, " if by else ""
    group = f"GROUP BY {keys}" if by else ""
    pe = " + ".join(f"(sum(CASE WHEN label_a = '{l}' THEN n ELSE 0 END) / sum(n)::DOUBLE) * "
                    f"(sum(CASE WHEN label_b = '{l}' THEN n ELSE 0 END) / sum(n)::DOUBLE)" for l in LABEL_AT)
    return f"""SELECT {lead}CAST(n AS BIGINT) AS n, CAST(same AS BIGINT) AS agreements,
                      round(CASE WHEN pe = 1 THEN {at_one} ELSE (same / n::DOUBLE - pe) / (1 - pe) END, 6) AS kappa
               FROM (SELECT {lead}sum(n) AS n, sum(CASE WHEN label_a = label_b THEN n ELSE 0 END) AS same, {pe} AS pe
                     FROM ({counts}) {group})"""


_TWO_COUNTS = f"SELECT label_a, label_b, count(*) AS n FROM ({FIRST_TWO}) GROUP BY label_a, label_b"


@query("agreement_matrix", with_views("annotations", _TWO_COUNTS, latest=LATEST))
def agreement_matrix(spark, sf):
    return A.first_two_counts(annotations(spark, sf))


@query("kappa_first_two", with_views("annotations", f"""
    SELECT n AS items, agreements, round(agreements / n::DOUBLE, 6) AS agreement, kappa FROM ({_sql_kappa(_TWO_COUNTS, (), '1.0')})""",
                                     latest=LATEST))
def kappa_first_two(spark, sf):
    out = A.agreement_summary(annotations(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


_PAIRS = """SELECT a.id, a.lang, a.annotator AS annotator_a, b.annotator AS annotator_b, a.label AS label_a, b.label AS label_b
            FROM latest a JOIN latest b ON a.id = b.id AND a.annotator < b.annotator"""


def _pair_counts(by):
    return f"SELECT {by}, label_a, label_b, count(*) AS n FROM ({_PAIRS}) GROUP BY {by}, label_a, label_b"


@query("iaa_pairs", with_views("annotations", _sql_kappa(
    _pair_counts("annotator_a, annotator_b"), ("annotator_a", "annotator_b"), "'NaN'::DOUBLE"), latest=LATEST))
def iaa_pairs(spark, sf):
    return A.kappa_per_pair(annotations(spark, sf)).withColumn("kappa", F.round("kappa", 6))


@query("iaa_pairs_lang", with_views("annotations", _sql_kappa(
    _pair_counts("lang, annotator_a, annotator_b"), ("lang", "annotator_a", "annotator_b"), "'NaN'::DOUBLE"), latest=LATEST))
def iaa_pairs_lang(spark, sf):
    return A.kappa_per_pair(annotations(spark, sf), lang="lang").withColumn("kappa", F.round("kappa", 6))


@query("common_items", with_views("annotations", """
    SELECT id FROM annotations WHERE annotator = 'a' INTERSECT SELECT id FROM annotations WHERE annotator = 'c'"""))
def common_items(spark, sf):
    return A.common_items(annotations(spark, sf), "a", "c")


BEST_TEXT = """SELECT id, text FROM (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY length(text) DESC, seq) AS r
               FROM annotations) WHERE r = 1"""
TOTALS = """SELECT id, sum(n) AS total, max(n) AS best, coalesce(list_sort(list(n), 'DESC')[2], 0) AS second, arg_max(label, n) AS top
            FROM (SELECT id, label, count(*) AS n FROM annotations GROUP BY id, label) GROUP BY id"""


def _sql_resolve(fallback, decided=False, extra=""):
    decision = "d.final_label" if decided else "NULL"
    join = "LEFT JOIN decisions d ON d.id = t.id" if decided else ""
    return f"""SELECT t.id, x.text, coalesce({decision}, CASE WHEN best = total THEN top END, {fallback}) AS label
               FROM totals t JOIN best_text x ON x.id = t.id {join} {extra}
               WHERE coalesce({decision}, CASE WHEN best = total THEN top END, {fallback}) IS NOT NULL"""


def _final(resolved):
    return R.resolved_only(resolved).select("id", "text", "label")


@query("resolve_drop", with_views("annotations", _sql_resolve("NULL"), totals=TOTALS, best_text=BEST_TEXT))
def resolve_drop(spark, sf):
    return _final(R.resolve(annotations(spark, sf), "drop_unresolved"))


_MAJORITY = "CASE WHEN best > second THEN top END"


@query("resolve_majority", with_views("annotations", _sql_resolve(_MAJORITY), totals=TOTALS, best_text=BEST_TEXT))
def resolve_majority(spark, sf):
    return _final(R.resolve(annotations(spark, sf), "majority"))


_PRIORITY = "SELECT id, arg_max(label, seq) FILTER (annotator = 'c') AS by_c, arg_max(label, seq) FILTER (annotator = 'a') AS by_a FROM annotations GROUP BY id"


@query("resolve_priority", with_views("annotations", _sql_resolve(
    "coalesce(p.by_c, p.by_a)", extra="JOIN listed p ON p.id = t.id"), totals=TOTALS, best_text=BEST_TEXT, listed=_PRIORITY))
def resolve_priority(spark, sf):
    return _final(R.resolve(annotations(spark, sf), "annotator_priority", priority=["c", "a"]))


@query("decision_override", with_views("annotations", _sql_resolve(_MAJORITY, decided=True), totals=TOTALS,
                                       best_text=BEST_TEXT, decisions=DECISIONS))
def decision_override(spark, sf):
    return _final(R.resolve(annotations(spark, sf), "majority", decisions=_logged(spark, sf)))


@query("resolution_counts", with_views("annotations", f"""
    SELECT CASE WHEN d.id IS NOT NULL THEN 'decision' WHEN best = total THEN 'unanimous' WHEN best > second THEN 'majority'
                ELSE 'unresolved' END AS how, count(*) AS n
    FROM totals t LEFT JOIN decisions d ON d.id = t.id GROUP BY how""", totals=TOTALS, decisions=DECISIONS))
def resolution_counts(spark, sf):
    return R.unresolved_count(R.resolve(annotations(spark, sf), "majority", decisions=_logged(spark, sf)))


@query("majority_vote", with_views("annotations", "SELECT id, top AS label, best AS votes FROM totals WHERE best > second", totals=TOTALS))
def majority_vote(spark, sf):
    return R.majority(annotations(spark, sf))


@query("representative_text", with_views("annotations", "SELECT * FROM best_text", best_text=BEST_TEXT))
def representative_text(spark, sf):
    return R.representative_texts(annotations(spark, sf))


@query("attach_groups", with_views("annotations", """
    SELECT m.id, m.top AS label, l."group" FROM totals m LEFT JOIN labelled l ON l.id = m.id AND l.id % 5 <> 0
    WHERE m.best > m.second""", totals=TOTALS))
def attach_groups(spark, sf):
    groups = labelled(spark, sf, text=False).where("id % 5 <> 0")
    return R.attach_groups(R.majority(annotations(spark, sf)), groups).select("id", "label", "group")


@query("union_sources", with_views("annotations", """
    SELECT annotator, label, count(*) AS n FROM (SELECT * FROM annotations UNION ALL SELECT * FROM annotations WHERE annotator = 'a')
    GROUP BY annotator, label"""))
def union_sources(spark, sf):
    from labelweave.sources.tables import combine
    anns = annotations(spark, sf)
    return combine(anns, anns.where("annotator = 'a'")).groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"))


@query("resolved_distribution", with_views("annotations", """
    SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT top AS label, 1 AS n FROM totals WHERE best > second
      UNION ALL SELECT unnest(['POS', 'NEG', 'NEU']), 0) GROUP BY label""", totals=TOTALS))
def resolved_distribution(spark, sf):
    return distribution(R.majority(annotations(spark, sf)), "label", LABEL_AT)
