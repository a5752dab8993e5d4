"""The operators of this subpackage as queries over their whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import chat, jaccard, lines, negatives, neighbours, packing, periodic, pieces, quality, secrets, suffixes, toxicity, warc
from labelweave.llm.common import bind, read, word_array


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, folded from an event log, rendered, and read back from the blocks."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)],
                                 "conv_id long, turn long, role string, text string")
    turns = chat.render_turns(chat.log_of(rows.unionByName(more)), *chat.ORDER)
    return chat.read_back(turns, *chat.ORDER)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, fixed rule and learned verdict of every document."""
    docs = read(spark, sf_dir, "documents")
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "base_failed", "kept", "rule")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    return warc.archive_round_trip(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document, links at a similarity of 0.8 or more."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve into sequences of at most 2048 ids, one row per piece."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the fifth of the ids held out does not train."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95 or more."""
    return neighbours.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's score; the value itself is given as a hash."""
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", "part", F.sha2("value", 256).alias("value_sha256"), F.char_length("value").alias("value_chars"),
                        *secrets.FEATURES, "score", "is_secret")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from every document."""
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts, checksum of the ids, and whether the text came back."""
    return pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, a tenth of them made periodic first, and digests of the runs and the words left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))

    made = bind(word_array(F.col("text")), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")))
    found = periodic.word_runs(docs.withColumn("text", F.when(crc % 10 == 0, made).otherwise(F.col("text"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.col("best")
    return found.withColumn("best", periodic.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best negatives of every anchor below each of its five positives."""
    vectors = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("whole"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))  # before floor() hides it
    found = negatives.hard_negatives(vectors.where(finite), F.col("vec_id") % 100 == 0, column="whole")
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds dropped from every document."""
    return lines.drop_repeated_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_ngram_jaccard, op3_packing, op4_quality_rules, op5_toxicity, op6_warc, op7_embedding_near_dedup,
    op8_secret_scan, op9_suffix_dedup, op10_sentencepiece, op11_periodic_runs, op12_hard_negatives, op13_line_dedup)}


def _rendered(column: str, marks: dict[str, int]) -> str:
    """Length of an escaped text: every escaped character becomes two."""
    more = " + ".join(f"(length({column}) - length(replace({column}, '{m}', ''))) // {n}" for m, n in marks.items())
    return f"(length({column}) + {more})"


ORACLES: dict[str, str] = {
    "op1_chat_formatting": rf"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
               CAST(sum(14 + {_rendered('role', {chr(92): 1, '#': 1, '<': 1, ':': 1})} + {_rendered('text', {chr(92): 1, '### ': 4, '</turn>': 7})}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, hash(x) AS h FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)),
        links AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = s.doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             r AS (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS head FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN head <> page_id THEN head END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM r""",
    "op7_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b
                  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, c AS component_id, e.vec_id = c AS kept
        FROM embeddings e JOIN least ON x = e.vec_id""",
    # An island of places whose word comes again q words later is a run's first part. The same stretch has its smallest
    # period among those that divide the others. CRC-32 is computed from its polynomial.
    "op11_periodic_runs": r"""
        WITH bits AS (
          SELECT n, CAST(list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) AS v
          FROM (SELECT unnest(range(256)) AS n)),
        tab AS (SELECT list(v ORDER BY n) AS t FROM bits),
        digits AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents),
        hashed AS (
          SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(d, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM digits, tab),
        words AS (
          SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents JOIN hashed USING (doc_id)),
        facts AS (
          SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN g % len(w) END AS a FROM words),
        made AS (
          SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
                 ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM facts),
        places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM made),
        met AS (
          SELECT x.doc_id, y.i - x.i AS q, x.i FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (
          SELECT doc_id, q, min(i) AS s, count(*) + q AS length
          FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM met) GROUP BY doc_id, q, island),
        runs AS (
          SELECT doc_id, s, length, min(q) AS q FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, s, length),
        told AS (
          SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM runs GROUP BY doc_id),
        best AS (
          SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, s, q) = 1),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
        kept AS (
          SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t FROM places p LEFT JOIN dropped d ON p.doc_id = d.doc_id AND p.i = d.i
          WHERE d.i IS NULL GROUP BY p.doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli,
               coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM made LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.e) = len(b.e)),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op13_line_dedup": """
        WITH l AS (
          SELECT doc_id, i, p[i] AS line, translate(trim(p[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
        r AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
        SELECT doc_id, count(*) AS n_lines, count(owner) FILTER (owner <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN owner IS NULL OR owner = doc_id THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM l LEFT JOIN r ON l.k = r.k GROUP BY doc_id""",
}
