"""Scoring by a linear model of given weights, so that SQL can state every number of it.

A weight is a function of the n-gram's md5. Features, scoring, explanations, routing, stress and conformal sets are those of
fitted models; only the optimiser is left out.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from labelweave.catalog.features import _CLEAN, sql_grams
from labelweave.catalog.metrics import rounded, sql_summary
from labelweave.catalog.perturbation import SEED, SEVERITY, SQL
from labelweave.catalog.registry import query
from labelweave.catalog.views import LABEL_AT, documents, draw, labelled, sql_draw, sql_hash, with_views
from labelweave.functions.proba import EPSILON
from labelweave.operators import explain as E
from labelweave.operators import features, metrics, models
from labelweave.plans import evaluation

NMIN, NMAX, MIN_DF = 2, 3, 5
CLASSES = sorted(LABEL_AT)
INTERCEPTS = {"NEG": 0.02, "NEU": 0.01, "POS": 0.0}


def _weights(index, head=""):
    """A weight between -1 and 1 for each n-gram and class; every head has its own."""
    parts = [F.struct(F.lit(c).alias("label"), ((draw(f"weight{head}|{c}", "gram") % 2001 - 1000) / 1000.0).alias("weight")) for c in CLASSES]
    return index.select(F.col("gram").alias("feature"), F.inline(F.array(*parts)))


def given_model(spark, sf, heads=()):
    """The model, and one more for each head, on features of all documents."""
    rows = documents(spark, sf).select(F.coalesce("text", F.lit("")).alias("_norm"))
    fitted = features.fit_features(rows, NMIN, NMAX, MIN_DF)
    make = partial(models.with_weights, fitted, CLASSES, intercepts=INTERCEPTS)
    whole = make(weights=_weights(fitted.index))
    return (whole, {h: make(weights=_weights(fitted.index, f"-{h}")) for h in heads}) if heads else whole


def _chars(source):
    return f"SELECT id, string_split({_CLEAN}, '') AS chars FROM ({source})"


_DOCS = "SELECT doc_id AS id, text FROM documents"


def _scores(source=_DOCS, heads=("",)):
    """Common table expressions: tf-idf of ``source`` with the document frequencies of all documents, logits, and predictions."""
    grams = sql_grams(NMIN, NMAX)
    coefficients = ", ".join(f"({sql_draw(f'weight{h}|{c}', 'gram')} % 2001 - 1000) / 1000.0::DOUBLE AS w{h.replace('-', '_')}_{c}" for h in heads for c in CLASSES)
    sums = ", ".join(f"coalesce(sum(x * w{h.replace('-', '_')}_{c}), 0.0::DOUBLE) + {INTERCEPTS[c]}::DOUBLE AS l{h.replace('-', '_')}_{c}" for h in heads for c in CLASSES)
    pick = {c: f"l_{c}" for c in CLASSES}
    for h in heads[1:]:
        pick = {c: f"CASE WHEN lower(lang) = '{h[1:]}' THEN l{h.replace('-', '_')}_{c} ELSE {e} END" for c, e in pick.items()}
    total = " + ".join(f"exp(z_{c})" for c in CLASSES)
    return {
        "chars": _chars(_DOCS), "grams": grams, "df": f"SELECT gram, count(DISTINCT id) AS df FROM grams GROUP BY gram HAVING count(DISTINCT id) >= {MIN_DF}",
        "asked": _chars(source), "asked_grams": grams.replace("FROM chars", "FROM asked"),
        "idx": f"SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1 AS idf, {coefficients} FROM df",
        "raw": "SELECT id, gram, count(*) * any_value(idf) AS v FROM asked_grams JOIN idx USING (gram) GROUP BY id, gram",
        "vectors": "SELECT id, gram, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS x FROM raw",
        "logits": f"SELECT a.id, {sums} FROM asked a LEFT JOIN vectors v ON a.id = v.id LEFT JOIN idx ON v.gram = idx.gram GROUP BY a.id",
        "chosen": "SELECT g.id, l.lang, l.\"group\", l.label, " + ", ".join(f"{e} AS z_{c}" for c, e in pick.items()) + " FROM logits g JOIN labelled l ON g.id = l.id",
        "given": f"""SELECT id, lang, "group", label, p_POS, p_NEG, p_NEU, greatest(p_POS, p_NEG, p_NEU) AS confidence,
                       greatest(p_POS, p_NEG, p_NEU) - list_sort([p_POS, p_NEG, p_NEU])[2] AS margin,
                       CASE greatest(p_POS, p_NEG, p_NEU) WHEN p_NEG THEN 'NEG' WHEN p_NEU THEN 'NEU' ELSE 'POS' END AS pred_label
                     FROM (SELECT id, lang, "group", label, {', '.join(f'exp(z_{c}) / ({total}) AS p_{c}' for c in CLASSES)} FROM chosen)"""}


_PREDICTIONS = "SELECT id, label, pred_label, round(p_POS, 6) AS proba_POS, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM given"


def _predictions(scored):
    return rounded(scored.select("id", "label", "pred_label", F.element_at("proba", F.lit("POS")).alias("proba_POS"), "confidence", "margin"),
                   "proba_POS", "confidence", "margin")


@query("given_predictions", with_views("labelled", _PREDICTIONS, **_scores()))
def given_predictions(spark, sf):
    return _predictions(given_model(spark, sf).score(labelled(spark, sf)))


@query("given_top_features", with_views("labelled", f"""
    SELECT DISTINCT label, gram AS feature, round(w, 6) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, gram) AS high, row_number() OVER (PARTITION BY label ORDER BY w, gram) AS low
      FROM ({' UNION ALL '.join(f"SELECT '{c}' AS label, gram, w_{c} AS w FROM idx" for c in CLASSES)})) WHERE high <= 20 OR low <= 20""", **_scores()))
def given_top_features(spark, sf):
    return E.top_features(given_model(spark, sf).weights(spark), 20)


_PARTS = " UNION ALL ".join(f"SELECT id, gram, '{c}' AS class, x * w_{c} AS c FROM vectors JOIN idx USING (gram)" for c in CLASSES)
_RANKED = """SELECT *, row_number() OVER (PARTITION BY id, class ORDER BY c DESC, gram) AS r FROM parts WHERE c <> 0"""
_LISTED = "SELECT id, class, string_agg(gram || '|' || format('{:.4f}', c), '; ' ORDER BY r) AS top FROM ranked WHERE r <= 5 GROUP BY id, class"


@query("given_explanations", with_views("labelled", """
    SELECT g.id, l.text, g.label, g.pred_label, p.top AS top_pred_features, t.top AS top_true_features
    FROM given g JOIN labelled l USING (id) LEFT JOIN listed p ON p.id = g.id AND p.class = g.pred_label LEFT JOIN listed t ON t.id = g.id AND t.class = g.label
    WHERE g.label <> g.pred_label""", **_scores(), parts=_PARTS, ranked=_RANKED, listed=_LISTED))
def given_explanations(spark, sf):
    model = given_model(spark, sf)
    return E.explain_misclassified(model.score(labelled(spark, sf)), model, NMIN, NMAX).select(
        "id", "text", "label", "pred_label", "top_pred_features", "top_true_features")


_ENTROPY = " - ".join(["0.0::DOUBLE", *[f"p_{c} * ln(p_{c} + {EPSILON}::DOUBLE)" for c in CLASSES]])


@query("given_request_records", with_views("labelled", f"""
    SELECT id, NULL AS reason, pred_label, list_aggregate(s, 'string_agg', ',') AS pred_set, CAST(len(s) AS INTEGER) AS set_size, round(e, 6) AS entropy, gram AS feature
    FROM (SELECT *, {_ENTROPY} AS e, list_filter([{', '.join(f"CASE WHEN 1.0::DOUBLE - p_{c} <= 0.6::DOUBLE THEN '{c}' END" for c in CLASSES)}], lambda x: x IS NOT NULL) AS s
          FROM given) g LEFT JOIN strongest USING (id) WHERE id IN (SELECT id FROM ({_DOCS}) WHERE trim(text) <> '' AND length(text) <= 4000)
    UNION ALL SELECT id, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'too_long' END, NULL, NULL, NULL, NULL, NULL FROM ({_DOCS})
    WHERE trim(text) = '' OR length(text) > 4000""", **_scores(), parts=_PARTS, strongest="""
    SELECT p.id, p.gram FROM parts p JOIN given g ON p.id = g.id AND p.class = g.pred_label WHERE c <> 0
    QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY abs(c) DESC, p.gram) = 1"""))
def given_request_records(spark, sf):
    out = evaluation.request_records(documents(spark, sf).select("id", "text"), given_model(spark, sf), tau=0.6, importance=3, max_chars=4000)
    joined = F.when(F.col("reason").isNull(), F.array_join("pred_set", ","))
    return rounded(out.select("id", "reason", "pred_label", F.nullif(joined, F.lit("")).alias("pred_set"), "set_size", "entropy",
                              F.get("importance", F.lit(0))["feature"].alias("feature")), "entropy")


@query("given_language_heads", with_views("labelled", _PREDICTIONS, **_scores(heads=("", "-de", "-en"))))
def given_language_heads(spark, sf):
    default, heads = given_model(spark, sf, ("de", "en"))
    return _predictions(models.LanguageRouted(default, heads).score(labelled(spark, sf)))


@query("given_stress", with_views("labelled", f"""
    SELECT 'overall' AS scope, NULL AS category, n, accuracy, f1_macro FROM ({sql_summary('given')})
    UNION ALL SELECT 'category', lang, n, accuracy, f1_macro FROM ({sql_summary('given', 'lang')})""", noisy=_DOCS, perturbed=SQL["mixed_script"],
    **_scores("SELECT id, text FROM perturbed")))
def given_stress(spark, sf):
    test = labelled(spark, sf).withColumnRenamed("lang", "category")
    scores, _ = evaluation.stress_test(test, given_model(spark, sf), "mixed_script", SEVERITY, seed=SEED)
    return rounded(scores.select("scope", "category", "n", "accuracy", "f1_macro"), "accuracy", "f1_macro")


_HELD = f"""SELECT *, row_number() OVER (ORDER BY {sql_hash(42, 'id')}, CAST(id AS VARCHAR)) <= floor(count(*) OVER () * 0.2::DOUBLE) AS held FROM given"""
_OF_GOLD = "CASE label WHEN 'POS' THEN p_POS WHEN 'NEG' THEN p_NEG ELSE p_NEU END"


@query("given_conformal", with_views("labelled", f"""
    SELECT count(*) AS n, round(avg(CASE WHEN {_OF_GOLD} >= 1.0::DOUBLE - tau THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
           round(avg({' + '.join(f'CASE WHEN 1.0::DOUBLE - p_{c} <= tau THEN 1 ELSE 0 END' for c in CLASSES)}), 6) AS mean_size, round(any_value(tau), 6) AS tau
    FROM parted, calibrated WHERE NOT held""", **_scores(), parted=_HELD, calibrated=f"""
    SELECT s[CAST(ceil(least(1.0::DOUBLE, ceil((len(s) + 1) * 0.9::DOUBLE) / len(s)) * (len(s) - 1)) AS BIGINT) + 1] AS tau
    FROM (SELECT list(1.0::DOUBLE - {_OF_GOLD} ORDER BY 1.0::DOUBLE - {_OF_GOLD}) AS s FROM parted WHERE held)"""))
def given_conformal(spark, sf):
    _, coverage, tau = evaluation.conformal_predictions(labelled(spark, sf), given_model(spark, sf))
    return rounded(coverage.withColumn("tau", F.lit(tau)), "coverage", "mean_size", "tau")
