"""Normalisation steps and scalar text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.registry import query
from labelweave.catalog.views import documents, labelled, noisy, raw_rows, with_views
from labelweave.functions import labels as L
from labelweave.functions import normalize as N
from labelweave.functions.labels import file_safe

EMOJI = r"'[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1FAFF}\x{2600}-\x{27BF}]'"
SPACES = r"'[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def sql_zero_width(t):
    return f"translate({t}, chr(8203) || chr(8204) || chr(8205) || chr(65279), '')"


def sql_digits(t):
    khmer = " || ".join(f"chr({0x17E0 + i})" for i in range(10))
    return f"translate({t}, {khmer}, '0123456789')"


def sql_khmer_punct(t):
    mapped = f"translate({t}, chr(6100) || chr(6101) || chr(6102), '..:')"
    return rf"regexp_replace({mapped}, '\x{{17d7}}+', chr(6103), 'g')"


def sql_emoji(t, to):
    return f"regexp_replace({t}, {EMOJI}, '{to}', 'g')"


def sql_elongation(t):
    return f"""array_to_string(list_transform(list_filter(
        list_zip(string_split({t}, ''), list_concat([NULL], string_split({t}, '')), list_concat([NULL, NULL], string_split({t}, ''))),
        lambda c: c[1] IS NOT NULL AND NOT (c[1] <> chr(10) AND c[1] IS NOT DISTINCT FROM c[2] AND c[1] IS NOT DISTINCT FROM c[3])),
        lambda c: c[1]), '')"""


def sql_punct(t):
    out = f"replace(translate({t}, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212), '''''\"\"--'), chr(8230), '...')"
    for ch in ("!", "[?]", "[.]", ",", ":"):
        out = f"regexp_replace({out}, '{ch}{{2,}}', '{ch.strip('[]')}', 'g')"
    return out


def sql_ratio(t):
    return f"(len(regexp_extract_all({t}, '[A-Za-z]'))::DOUBLE / greatest(1, length({t})))"


def sql_latin_tag(t, threshold=0.2):
    return f"CASE WHEN {sql_ratio(t)} >= {threshold}::DOUBLE THEN '<LATIN> ' || {t} ELSE {t} END"


def sql_whitespace(t):
    return f"trim(regexp_replace({t}, {SPACES}, ' ', 'g'), ' ')"


def _step(name, cfg, sql):
    @query(name, with_views("noisy", f"SELECT id, {sql} AS text FROM noisy"))
    def run(spark, sf):
        return noisy(spark, sf).select("id", N.normalize("text", cfg).alias("text"))


_step("norm_zero_width", N.NormConfig(remove_zero_width=True), sql_zero_width("text"))
_step("norm_nfc", N.NormConfig(nfc=True), "nfc_normalize(text)")
_step("norm_digits", N.NormConfig(khmer_digits="map"), sql_digits("text"))
_step("norm_khmer_punct", N.NormConfig(khmer_punct=True), sql_khmer_punct("text"))
_step("norm_emoji_map", N.NormConfig(emoji="map"), sql_emoji("text", " <EMOJI> "))
_step("norm_emoji_remove", N.NormConfig(emoji="remove"), sql_emoji("text", ""))
_step("norm_elongation", N.NormConfig(elongation=True), sql_elongation("text"))
_step("norm_punct", N.NormConfig(punct=True), sql_punct("text"))
_step("norm_latin_tag", N.NormConfig(latin_action="tag", latin_threshold=0.75), sql_latin_tag("text", 0.75))
_step("norm_latin_strip", N.NormConfig(latin_action="strip", latin_threshold=0.75),
      f"CASE WHEN {sql_ratio('text')} >= 0.75::DOUBLE THEN regexp_replace(text, '[A-Za-z]', '', 'g') ELSE text END")
_step("norm_whitespace", N.NormConfig(whitespace=True), sql_whitespace("text"))


@query("norm_diacritics_reorder")
def norm_diacritics_reorder(spark, sf):
    return noisy(spark, sf).select("id", N.normalize("text", N.NormConfig(diacritics_reorder=True)).alias("text"))


# Each step of the whole normaliser is one CTE, so no expression is repeated inside the next.
_STEPS = [sql_zero_width("text"), "nfc_normalize(text)", sql_digits("text"), sql_khmer_punct("text"),
          sql_emoji("text", " <EMOJI> "), sql_elongation("text"), sql_punct("text"), sql_latin_tag("text"),
          sql_whitespace("text")]


@query("norm_all", with_views("noisy", f"SELECT id, text FROM s{len(_STEPS)}", **{
    f"s{i + 1}": f"SELECT id, {step} AS text FROM {'noisy' if i == 0 else f's{i}'}" for i, step in enumerate(_STEPS)}))
def norm_all(spark, sf):
    return N.normalize_corpus(noisy(spark, sf), N.NormConfig.everything()).select("id", "text")


@query("latin_ratio", with_views("noisy", f"SELECT id, round({sql_ratio('text')}, 6) AS ratio FROM noisy"))
def latin_ratio(spark, sf):
    return noisy(spark, sf).select("id", F.round(N.latin_ratio(F.col("text")), 6).alias("ratio"))


@query("codeswitch", with_views("noisy", r"""
    SELECT lang, CASE WHEN km AND en THEN 'km+en' WHEN km THEN 'km' WHEN en THEN 'en' ELSE 'other' END AS script, count(*) AS n
    FROM (SELECT lang, regexp_matches(text, '[\x{1780}-\x{17FF}]') AS km, regexp_matches(text, '[A-Za-z]') AS en FROM noisy)
    GROUP BY ALL"""))
def codeswitch(spark, sf):
    return (noisy(spark, sf).select("lang", L.code_switch("text").alias("script"))
            .groupBy("lang", "script").agg(F.count(F.lit(1)).alias("n")))


@query("label_variants", with_views("labelled", "SELECT id, label FROM labelled"))
def label_variants(spark, sf):
    spelled = {"POS": (" positive", "+ ", "pos"), "NEG": ("Negative", "-", "neg "), "NEU": ("neutral ", "0", "NEU")}
    as_typed = None
    for label, forms in spelled.items():
        form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("id") % 3 + 1).cast("int"))
        as_typed = F.when(F.col("label") == label, form) if as_typed is None else as_typed.when(F.col("label") == label, form)
    typed = labelled(spark, sf, text=False).select("id", as_typed.alias("label"))
    return typed.select("id", L.annotation_label("label").alias("label"))


@query("label_upper_trim", with_views("raw_rows", "SELECT seq, upper(trim(label)) AS label FROM raw_rows"))
def label_upper_trim(spark, sf):
    return raw_rows(spark, sf).select("seq", L.upper_label("label").alias("label"))


@query("canonical_split", with_views("raw_rows", """
    SELECT split, count(*) AS n FROM (
      SELECT CASE lower(trim(split)) WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END AS split
      FROM raw_rows) WHERE split IN ('train', 'val', 'test') GROUP BY split"""))
def canonical_split(spark, sf):
    from labelweave.sources.tables import with_known_split
    return with_known_split(raw_rows(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("length_limits", with_views("raw_rows", """
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 4000 THEN 'too_long' ELSE 'accepted' END AS reason
      FROM raw_rows) GROUP BY reason"""))
def length_limits(spark, sf):
    reason = F.coalesce(L.rejection_reason("text"), F.lit("accepted"))
    return raw_rows(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("lang_index", """
    SELECT doc_id AS id, CASE lower(lang) WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE -1 END AS lang_idx FROM documents""")
def lang_index(spark, sf):
    return documents(spark, sf).select("id", L.lang_index("lang", ["de", "en", "fr"]).alias("lang_idx"))


@query("number_coercion", """
    SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR)
                                   WHEN event_id % 3 = 1 THEN event_type ELSE '' END AS DOUBLE) AS value FROM events""")
def number_coercion(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    cell = (F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string"))
            .when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(""))
    return events.select("event_id", L.number(cell).alias("value"))


@query("token_flags", r"""
    SELECT doc_id AS id, len(tokens) AS seq_len, len(tokens) >= 512 AS truncated
    FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS tokens FROM documents)""")
def token_flags(spark, sf):
    from labelweave.operators.corpus import words
    flags = L.token_length_flags(words("text"), 512)
    return documents(spark, sf).select("id", flags.alias("f")).select("id", "f.seq_len", "f.truncated")


@query("safe_names", """
    SELECT DISTINCT regexp_replace(regexp_replace(url, '^http://', ''), '[^A-Za-z0-9_-]', '_', 'g') AS name FROM pages""")
def safe_names(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select(file_safe(F.regexp_replace("url", "^http://", "")).alias("name")).distinct()
