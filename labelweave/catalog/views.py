"""Engine views of the driver tables, once as DataFrames and once as SQL common table expressions.

``labelled`` gives every document a label; ``annotations`` lets three people label it, with mistakes; ``predictions``
gives two models' probabilities; ``raw_rows`` is a dirty copy for the checks; ``noisy`` holds the characters the
normaliser is about. All are functions of the tables and of md5, so both engines build the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.schema import widen

LABEL_AT = ("POS", "NEG", "NEU")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(tag: str, *cols) -> Column:
    """32-bit integer from md5 of a tag and key columns."""
    text = F.md5(F.concat_ws("|", F.lit(tag), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def sql_draw(tag: str, *cols: str) -> str:
    keys = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{tag}', {keys})), 1, 8) AS BIGINT)"


def sql_hash(seed, *cols: str) -> str:
    keys = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws('|', '{seed}', {keys}))"


def sql_uniform(seed, *cols: str) -> str:
    return f"(CAST('0x' || substr({sql_hash(seed, *cols)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _label_of(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(l) for l in LABEL_AT]), (n % 3 + 1).cast("int"))


def _sql_label_of(n: str) -> str:
    return f"(CASE ({n}) % 3 WHEN 0 THEN 'POS' WHEN 1 THEN 'NEG' ELSE 'NEU' END)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "documents")).withColumnsRenamed({"doc_id": "id", "source": "group"}).withColumn("seq", F.col("id"))


def labelled(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    marks = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    label = (F.when(F.col("toxic") == 1, "NEG").when(F.col("quality") == 1, "POS").when(F.col("quality") == 0, "NEU")
             .otherwise(_label_of(draw("gold", "id"))))
    return documents(spark, sf_dir).join(marks, "id", "left").select(
        "id", *(["text"] if text else []), "lang", "group", label.alias("label"), "seq")


def _shifted(label: Column) -> Column:
    return F.when(label == "POS", "NEG").when(label == "NEG", "NEU").otherwise("POS")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = labelled(spark, sf_dir)
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("annotator")) for k, w in
                                enumerate(("a", "b", "c", "a"))])).alias("t")
    rows = base.select("id", "text", "lang", "label", turns).select("id", "text", "lang", "label", "t.*")
    n = draw("ann", "id", "k")
    return rows.where(((F.col("k") < 2) | ((F.col("k") == 2) & (n % 4 != 0)) | ((F.col("k") == 3) & (n % 7 == 0)))).select(
        "id", F.when((F.col("k") == 2) & (n % 5 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        "lang", "annotator", F.when(n % 100 < 25, _shifted(F.col("label"))).otherwise(F.col("label")).alias("label"),
        (F.col("id") * 10 + F.col("k")).alias("seq"))


def predictions(spark: SparkSession, sf_dir: str, model: str = "a") -> DataFrame:
    base = labelled(spark, sf_dir, text=False)
    weights = {l: (draw(f"{model}|{l}", "id") % 100 + 1 + F.when(F.col("label") == l, 80).otherwise(0)) for l in LABEL_AT}
    rows = base.withColumns({f"w_{l}": w for l, w in weights.items()})
    total = sum(F.col(f"w_{l}") for l in LABEL_AT)
    p = {l: F.col(f"w_{l}") / total for l in LABEL_AT}
    top = F.greatest(*[F.col(f"w_{l}") for l in LABEL_AT])
    pred = F.when(F.col("w_NEG") == top, "NEG").when(F.col("w_NEU") == top, "NEU").otherwise("POS")
    proba = F.create_map(*[x for l in LABEL_AT for x in (F.lit(l), p[l])])
    middle = F.sort_array(F.array(*[F.col(f"w_{l}") for l in LABEL_AT]))[1]
    return rows.select("id", "lang", "group", "label", pred.alias("pred_label"), proba.alias("proba"),
                       (top / total).alias("confidence"), ((top - middle) / total).alias("margin"))


def with_text(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows by document id, with the documents' texts."""
    return rows.join(labelled(spark, sf_dir).select("id", "text"), "id")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = labelled(spark, sf_dir)
    n = draw("raw", "id")
    return base.select(
        F.when(n % 97 == 0, "").when(n % 20 == 0, (F.col("id") - F.col("id") % 10).cast("string"))
        .otherwise(F.col("id").cast("string")).alias("id"),
        F.when(n % 50 == 0, "").when(n % 50 == 1, "  ").otherwise(F.col("text")).alias("text"),
        F.when(n % 40 == 0, " ").when(n % 41 == 0, "bad").when(n % 3 == 0, F.concat(F.lit(" "), F.lower("label")))
        .otherwise(F.col("label")).alias("label"),
        F.when(n % 30 == 0, "").when(n % 31 == 0, "xx").when(n % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("lang"),
        F.when(n % 60 == 0, "").when(n % 61 == 0, "dev").when(n % 5 == 0, "val").when(n % 5 == 1, "Test ")
        .otherwise("train").alias("split"),
        F.when(n % 6 == 0, "").otherwise(F.concat("group", F.lit("-"), (F.col("id") % 500).cast("string"))).alias("group"),
        "seq")


# Replacements that plant special characters in the driver texts.
NOISE = (
    ("th", "t​h"), ("ea", "éa"), ("ing ", "ing\U0001f600 "), ("ou", "ouuuu"), (". ", "។ "),
    ("nd ", "nd ៗៗៗ៖ "), ("er ", "er’s… "), ("es ", "es!!!?? "), ("as", "សា"),
    ("de ", "de  "), ("on", "on—១២៣"), ("\n", "\r\n\n"),
)


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for a, b in NOISE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return documents(spark, sf_dir).select("id", text.alias("text"), "lang")


def _sql_text(value: str) -> str:
    out = "".join(c if 32 <= ord(c) < 127 and c != "'" else f"' || chr({ord(c)}) || '" for c in value)
    return f"('{out}')"


def _sql_noise() -> str:
    text = "text"
    for a, b in NOISE:
        text = f"replace({text}, {_sql_text(a)}, {_sql_text(b)})"
    return text


def _sql_predictions(model: str) -> str:
    w = {l: f"({sql_draw(f'{model}|{l}', 'id')} % 100 + 1 + CASE WHEN label = '{l}' THEN 80 ELSE 0 END)" for l in LABEL_AT}
    inner = ", ".join(f"{e} AS w_{l}" for l, e in w.items())
    return f"""
      SELECT id, lang, "group", label, CASE WHEN w_NEG = top THEN 'NEG' WHEN w_NEU = top THEN 'NEU' ELSE 'POS' END AS pred_label,
             w_POS / total AS p_POS, w_NEG / total AS p_NEG, w_NEU / total AS p_NEU,
             top / total AS confidence, (top - middle) / total AS margin
      FROM (SELECT *, greatest(w_POS, w_NEG, w_NEU) AS top, CAST(w_POS + w_NEG + w_NEU AS DOUBLE) AS total,
                   list_sort([w_POS, w_NEG, w_NEU])[2] AS middle
            FROM (SELECT *, {inner} FROM labelled))"""


_N_ANN, _N_RAW = sql_draw("ann", "id", "k"), sql_draw("raw", "id")
CTES = {
    "labelled": (f"""
      SELECT d.doc_id AS id, d.text, d.lang, d.source AS "group",
             CASE WHEN l.toxic = 1 THEN 'NEG' WHEN l.quality = 1 THEN 'POS' WHEN l.quality = 0 THEN 'NEU'
                  ELSE {_sql_label_of(sql_draw('gold', 'd.doc_id'))} END AS label, d.doc_id AS seq
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", ()),
    "annotations": (f"""
      SELECT id, CASE WHEN k = 2 AND n % 5 = 0 THEN text || '!' ELSE text END AS text, lang, annotator,
             CASE WHEN n % 100 < 25 THEN CASE label WHEN 'POS' THEN 'NEG' WHEN 'NEG' THEN 'NEU' ELSE 'POS' END
                  ELSE label END AS label, id * 10 + k AS seq
      FROM (SELECT *, {_N_ANN} AS n
            FROM labelled, (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'a')) AS t(k, annotator))
      WHERE k < 2 OR (k = 2 AND n % 4 <> 0) OR (k = 3 AND n % 7 = 0)""", ("labelled",)),
    "predictions_a": (_sql_predictions("a"), ("labelled",)),
    "predictions_b": (_sql_predictions("b"), ("labelled",)),
    "raw_rows": (f"""
      SELECT CASE WHEN n % 97 = 0 THEN '' WHEN n % 20 = 0 THEN CAST(id - id % 10 AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS id,
             CASE WHEN n % 50 = 0 THEN '' WHEN n % 50 = 1 THEN '  ' ELSE text END AS text,
             CASE WHEN n % 40 = 0 THEN ' ' WHEN n % 41 = 0 THEN 'bad' WHEN n % 3 = 0 THEN ' ' || lower(label) ELSE label END AS label,
             CASE WHEN n % 30 = 0 THEN '' WHEN n % 31 = 0 THEN 'xx' WHEN n % 2 = 0 THEN upper(lang) ELSE lang END AS lang,
             CASE WHEN n % 60 = 0 THEN '' WHEN n % 61 = 0 THEN 'dev' WHEN n % 5 = 0 THEN 'val' WHEN n % 5 = 1 THEN 'Test '
                  ELSE 'train' END AS split,
             CASE WHEN n % 6 = 0 THEN '' ELSE "group" || '-' || CAST(id % 500 AS VARCHAR) END AS "group", seq
      FROM (SELECT *, {_N_RAW} AS n FROM labelled)""", ("labelled",)),
    "noisy": (f"SELECT doc_id AS id, {_sql_noise()} AS text, lang FROM documents", ()),
}


def with_views(*names_then_body: str, **extra: str) -> str:
    """SQL of a query over views: ``with_views("labelled", "SELECT ...")``. Extra CTEs follow the views in order."""
    *names, body = names_then_body
    used: list[str] = []

    def need(name):
        for other in CTES[name][1]:
            need(other)
        if name not in used:
            used.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in used] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
