"""N-grams, TF-IDF and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.metrics import rounded
from labelweave.catalog.registry import query
from labelweave.catalog.views import documents
from labelweave.operators import corpus as C
from labelweave.operators import ngrams as G

_CLEAN = r"regexp_replace(text, '[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2,}', ' ', 'g')"


def sql_grams(nmin, nmax):
    """(id, gram) rows of all documents."""
    parts = []
    for n in range(nmin, nmax + 1):
        joined = " || ".join(f"chars[i + {k}]" for k in range(n))
        parts.append(f"SELECT id, unnest(list_transform(range(1, len(chars) - {n} + 2), lambda i: {joined})) AS gram FROM chars")
    return " UNION ALL ".join(parts)


_CHARS = f"SELECT doc_id AS id, string_split({_CLEAN}, '') AS chars FROM documents"


def _sql(body, nmin, nmax, **extra):
    more = "".join(f", {k} AS ({v})" for k, v in extra.items())
    return f"WITH chars AS ({_CHARS}), grams AS ({sql_grams(nmin, nmax)}){more} {body}"


@query("char_ngrams", _sql("SELECT gram, count(*) AS n FROM grams GROUP BY gram", 3, 5))
def char_ngrams(spark, sf):
    return G.ngram_counts(documents(spark, sf), 3, 5)


@query("doc_freq", _sql("SELECT gram, count(DISTINCT id) AS df FROM grams GROUP BY gram HAVING count(DISTINCT id) >= 2", 3, 5))
def doc_freq(spark, sf):
    return G.document_frequency(documents(spark, sf), 3, 5, min_df=2)


_TFIDF = {
    "tf": "SELECT id, gram, count(*) AS tf FROM grams GROUP BY id, gram",
    "df": "SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2",
    "raw": "SELECT id, tf.gram, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df ON tf.gram = df.gram",
    "weights": "SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw",
}


@query("tfidf_long", _sql("""SELECT id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS heaviest
                             FROM weights GROUP BY id""", 3, 5, **_TFIDF))
def tfidf_long(spark, sf):
    weights = G.tfidf(documents(spark, sf), 3, 5, min_df=2)
    return weights.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("total"),
                                     F.round(F.max("weight"), 6).alias("heaviest"))


@query("ngram_range", """SELECT least(3, max(length(text))) AS low, least(5, max(length(text))) AS high FROM documents""")
def ngram_range(spark, sf):
    rows = documents(spark, sf)
    low, high = G.effective_range(rows, 3, 5)
    return spark.createDataFrame([(low, high)], "low long, high long")


_WORDS = r"""SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')) AS word FROM documents) GROUP BY word"""


@query("word_counts", _WORDS)
def word_counts(spark, sf):
    return C.word_counts(documents(spark, sf))


MERGES = 8


def _sql_merges(k):
    """The first k merges, one stage of common table expressions per merge."""
    parts = [f"words AS ({_WORDS})",
             "t0 AS MATERIALIZED (SELECT n, array_to_string(list_transform(string_split(word, ''), lambda c: chr(2) || c || chr(3)), '') AS s FROM words)"]
    for i in range(k):
        parts.append(f"""b{i} AS MATERIALIZED (SELECT l, r, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, unnest(list_zip(p[1:len(p) - 1], p[2:len(p)])) AS z, z[1] AS l, z[2] AS r FROM (
              SELECT n, string_split(s[2:length(s) - 1], chr(3) || chr(2)) AS p FROM t{i}) WHERE len(p) > 1)
          GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1)""")
        parts.append(f"""t{i + 1} AS MATERIALIZED (SELECT t.n, replace(t.s, chr(2) || b.l || chr(3) || chr(2) || b.r || chr(3),
            chr(2) || b.l || b.r || chr(3)) AS s FROM t{i} t, b{i} b)""")
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS rank, l AS left, r AS right, l || r AS token, n AS frequency FROM b{i}" for i in range(k))
    return f"WITH {', '.join(parts)} {rows}"


@query("bpe_merges", _sql_merges(MERGES).replace("AS left,", 'AS "left",').replace("AS right,", 'AS "right",'))
def bpe_merges(spark, sf):
    return C.merges_table(spark, C.learn_merges(documents(spark, sf), MERGES))


@query("bpe_vocabulary")
def bpe_vocabulary(spark, sf):
    """All merges of a vocabulary of 16,000 entries; `bpe_merges` compares the first ones with SQL."""
    return C.merges_table(spark, C.learn_merges(documents(spark, sf)))


@query("characters", "SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents")
def characters(spark, sf):
    return C.characters(documents(spark, sf))


@query("character_coverage", rf"""
    WITH words AS ({_WORDS}), c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents),
         known AS (SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM words)
    SELECT count(*) AS distinct_chars, round(count(known.ch)::DOUBLE / count(*), 6) AS coverage FROM c LEFT JOIN known ON c.ch = known.ch""")
def character_coverage(spark, sf):
    rows = documents(spark, sf)
    tokens = C.vocabulary(rows, C.merges_table(spark, []))
    return rounded(C.coverage(C.characters(rows), tokens), "coverage")


@query("corpus_stats")
def corpus_stats(spark, sf):
    return rounded(C.corpus_statistics(documents(spark, sf)), "coverage", "avg_tokens")


@query("held_out_tokens", r"""
    SELECT count(*) AS held_out, round(avg(2 + coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)), 6) AS avg_tokens
    FROM (SELECT regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS words,
                 row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS n FROM documents)
    WHERE r <= greatest(1, floor(n * 0.05::DOUBLE))""")
def held_out_tokens(spark, sf):
    # Without merges every character of a word is a token.
    return rounded(C.held_out_tokens(documents(spark, sf), []), "avg_tokens")
