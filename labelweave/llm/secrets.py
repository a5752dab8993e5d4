"""Secret scan: a random forest decides which secret-like strings are findings. DataFrame operations only.

A candidate is a run of at least 16 of `A-Za-z0-9+/_=-` with a digit in it. Its features are length, changes of
character class, share of letters that stand in dictionary words, alphabet, whether it decodes to plain text or looks like
a path, and the words beside it. The forest learns from labelled findings. Without a table of them `planted` makes some:
values whose nature is known because they are made here (access keys, tokens, passwords; commit ids, digests, UUIDs, card numbers, paths,
identifiers, encoded text) stand among words of the corpus, in settings that both natures share where real ones do. The
label is the nature of the value and no function of the features. `weak_labels`, a rule on the context, remains for
callers who want to learn from their own texts.

Documents without a candidate are skipped by one test of the text, so clean text costs one pass and no shuffle.

Defined results: null and empty texts have no candidates; null ids are kept; repeated rows give repeated findings; ties
of a tree go to "not a secret"; with labels of one class only that class is given to all; empty tables give no rows;
whole texts of any length are read; only the named columns are read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import bind, bounded, settle, word_array

CANDIDATE = r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-]*[0-9])[A-Za-z0-9+/_=\-]{16,}"
NAMES = r"(?i)(?:token|secret|passw|passwd|pwd|credential|auth|bearer|access|private|api|key)"
FEATURES = ("length", "transitions", "digit_share", "upper_share", "hex_only", "digits_only", "distinct_share", "dictionary_share",
            "decodes_to_text", "path_like", "quoted", "assigned", "named", "right_plain")
MASK = "<SECRET>"


def _at(words: Column, i: Column) -> Column:
    return F.coalesce(F.get(words, i), F.lit(""))


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per candidate: *keep, word_no, part, value, word, and the two words to the left and one to the right."""
    hit = docs.where(F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False)))
    near = bind(word_array(F.col(text)), lambda w: F.filter(
        F.transform(w, lambda x, i: F.when(x.rlike(CANDIDATE), F.struct(
            i.alias("word_no"), x.alias("word"), _at(w, i - 2).alias("left2"), _at(w, i - 1).alias("left1"), _at(w, i + 1).alias("right1")))),
        lambda s: s.isNotNull()))
    rows = hit.select(*keep, F.explode(near).alias("n")).select(*keep, "n.*")
    return rows.select(*keep, "word_no", "word", "left2", "left1", "right1",
                       F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), 0)).alias("part", "value"))


def dictionary(docs: DataFrame, text: str = "text", size: int = 2_000) -> list[str]:
    """The commonest words of three letters or more outside candidates, by the number of documents that hold them."""
    plain = F.lower(F.regexp_replace(F.col(text), CANDIDATE, " "))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z]{3,}"), 0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def _word_list(words: list[str]) -> Column:
    """The words as one array: a single value to the planner, however many they are and however often they are used."""
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    value, share = F.col("value"), lambda pattern: F.regexp_count("value", F.lit(pattern)) / F.col("length")
    known = _word_list(words)
    pieces = F.array_intersect(F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), 0), known)
    flag = lambda c: c.cast("double")
    unpadded = F.rtrim(value, F.lit("="))
    padded = F.concat(unpadded, F.repeat(F.lit("="), F.pmod(-F.char_length(unpadded), F.lit(4))))
    decoded = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")  # a character for each byte
    own = F.regexp_extract(value, r"\A([A-Za-z_\-]+=)[^=]", 1)  # a name that the run itself begins with
    left = F.concat(F.concat_ws(" ", "left2", "left1", F.expr("substring_index(word, value, 1)")), own)
    return (found.withColumn("length", F.char_length(value).cast("double")).withColumn("_left", left)
            .withColumns({
                "transitions": share(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
                "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"),
                "hex_only": flag(value.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")), "digits_only": flag(value.rlike(r"\A[0-9]+\z")),
                "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.least(F.col("length"), F.lit(64.0)),
                "dictionary_share": F.char_length(F.array_join(pieces, "")) / F.col("length"),
                "decodes_to_text": F.coalesce(F.regexp_count(decoded, F.lit("[ -~]")) / F.greatest(F.char_length(decoded), F.lit(1)), F.lit(0.0)),
                "path_like": flag(F.col("word").rlike(r"://|[\w.\-]+/[\w.\-]+/|\.[a-z]{2,4}\b")),
                "quoted": flag(F.col("word").rlike("[\"'`]")),
                "assigned": flag(F.col("_left").rlike(r"[=:]\s*[\"'`]?\s*\z")),
                "named": flag(F.col("_left").rlike(NAMES)),
                "right_plain": flag(F.col("right1").rlike(r"\A\p{L}+[.,]?\z"))}))


def weak_labels(rows: DataFrame) -> DataFrame:
    """Labelled findings: 1 where a telling name is assigned, 0 where nothing of the kind is near and the shape is not a key's."""
    told = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 20)
    keylike = ((F.col("length") >= 20) & (F.col("transitions") >= 0.2) & (F.col("dictionary_share") < 0.3) & (F.col("upper_share") > 0)
               & (F.col("path_like") == 0))
    far = (F.col("named") == 0) & (F.col("assigned") == 0) & ~keylike
    return rows.withColumn("label", F.when(told, 1.0).when(far, 0.0)).where("label is not null")


def _kinds(key: Column) -> list[tuple[float, str, Column, tuple[str, ...]]]:
    """(label, name, value, settings) of what `planted` plants; values are functions of hashes of `key`, `{}` is their place."""
    digest = lambda k: F.sha2(F.concat(key, F.lit(f":{k}")), 256)
    packed = F.concat(*[F.base64(F.unhex(digest(k))) for k in range(3)])
    mixed = F.regexp_replace(packed, "[+/=]", "")
    size = lambda low, high: (F.lit(low) + F.pmod(F.xxhash64(key, F.lit("size")), F.lit(high - low + 1))).cast("int")
    digits = F.regexp_replace(F.concat(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(10 ** 9)).cast("string") for k in range(4)]), "^0", "7")
    cut = lambda c, n: F.substr(c, F.lit(1), F.lit(n) if isinstance(n, int) else n)
    hexes = digest("hex")
    uuid4 = F.concat_ws("-", *[F.substr(hexes, F.lit(i), F.lit(n)) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    given = ('token = "{}"', "api_key: {}", "password={}", "secret = '{}'", "Bearer {}", "ACCESS_TOKEN={}", "auth_token: \"{}\",", "private key = {}",
             "credential: {}")
    plain = ("{}", "use {} there", '"{}"', "id = {}", "value: {}", "{},")
    shown = ("{}", "({})", "id = \"{}\"", "{}.", "see {} for", "| {} |", "number: {}", "ref={}")
    return [
        (1.0, "hex key", cut(hexes, size(32, 64)), given),
        (1.0, "mixed key", cut(mixed, size(24, 64)), given + plain),
        (1.0, "password", F.concat(cut(mixed, size(20, 28)), F.lit("9")), given),
        (1.0, "coded key", cut(packed, size(36, 64)), given + plain),
        (1.0, "access key id", F.concat(F.lit("AKIA"), cut(F.upper(mixed), 16)), given + plain),
        (1.0, "service token", F.concat(F.element_at(F.array(*map(F.lit, ("ghp_", "sk_live_", "xoxb-", "glpat-", "eyJ"))), (F.pmod(F.xxhash64(key), F.lit(5)) + 1).cast("int")),
                                        cut(mixed, size(24, 40))), given + plain),
        (0.0, "commit", cut(hexes, 40), ("commit {}", 'commit id = "{}"', "sha1: {}", "checkout {}", "rev={}", "{}") + shown),
        (0.0, "digest", hexes, ("sha256: {}", 'digest = "{}"', "checksum {}", "sha256={}", "{}") + shown),
        (0.0, "short digest", cut(hexes, 32), ("md5: {}", 'etag = "{}"', "md5={}") + shown),
        (0.0, "upper digest", F.upper(hexes), ("SHA256: {}", "fingerprint {}") + shown),
        (0.0, "uuid", uuid4, ("uuid: {}", "trace_id={}", "request {}", "api call {}") + shown),
        (0.0, "card", cut(digits, 16), ("card {} paid", "access {}", "order = {}", "key {}", "api = {}") + shown),
        (0.0, "number", cut(digits, size(17, 24)), ("token count {}", "account: {}", "at {}") + shown),
        (0.0, "stamp", F.concat(F.lit("2024-05-06T07-08-09-"), cut(digits, 6)), ("at {}", "time = {}", "access = {}") + shown),
        (0.0, "product", F.concat_ws("-", *[F.upper(F.substr(hexes, F.lit(i), F.lit(5))) for i in (1, 6, 11, 16)]), ("serial: {}", "part {}") + shown),
        (0.0, "path", F.concat(F.lit("/@/@/v2/@/@")), ("path = {}", "open {}", 'api = "{}"', "auth_file: {}") + shown),
        (0.0, "address", F.concat(F.lit("https://@.org/@/@/3/"), cut(hexes, 8)), ("url: {}", "token page {}", "href={}") + shown),
        (0.0, "name", F.concat(F.lit("@_@_@_"), cut(digits, 2)), ("key = {}", "token_name: {}", "api_version = {}", "call {}") + shown),
        (0.0, "encoded text", F.lit("~"), ('data = "{}"', "content: {}", "base64,{}") + shown),
    ]


def planted(spark: SparkSession, words: list[str], n: int = 9_000, seed: int = 0) -> DataFrame:
    """Labelled findings of known nature: candidates of `n` made sentences, with `label`, `kind` and the number `made`.

    The words around a value, and those inside paths, names and encoded text, are drawn from `words`; with none, from a few
    fixed ones. Other seeds give other values.
    """
    pool = _word_list(words or ["and", "the", "more", "other"])
    key = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    word = lambda k: F.get(pool, F.pmod(F.xxhash64(key, F.lit(f"w{k}")), F.size(pool)).cast("int"))
    kinds = _kinds(key)
    place = F.pmod(F.col("id"), F.lit(len(kinds)))
    turn = F.pmod(F.xxhash64(key, F.lit("setting")), F.lit(1 << 20))
    setting, value, label, name = (F.lit(None).cast(t) for t in ("string", "string", "double", "string"))
    for i, (kind_label, kind, made, settings) in enumerate(kinds):
        mine = place == i
        setting = F.when(mine, F.get(F.array(*map(F.lit, settings)), (turn % len(settings)).cast("int"))).otherwise(setting)
        value = F.when(mine, made).otherwise(value)
        label, name = F.when(mine, F.lit(kind_label)).otherwise(label), F.when(mine, F.lit(kind)).otherwise(name)
    rows = spark.range(n).select(F.col("id").alias("made"), label.alias("label"), name.alias("kind"), setting.alias("setting"), value.alias("value"),
                                 *[word(k).alias(f"w{k}") for k in range(8)])
    filled = F.col("value")
    for k in range(5):  # each @ in turn is a word
        filled = F.regexp_replace(filled, F.lit("^([^@]*)@"), F.concat(F.lit("$1"), F.col(f"w{k}")))
    encoded = F.base64(F.encode(F.concat_ws(" ", *[F.col(f"w{k}") for k in range(5)]), "UTF-8"))
    filled = F.when(F.col("value") == "~", F.regexp_replace(encoded, r"\s", "")).otherwise(filled)
    text = F.concat_ws(" ", "w5", "w6", F.replace("setting", F.lit("{}"), filled), "w7")
    # a written step: its large expressions are planned once, and not in each query that reads the findings
    made = settle(rows.select("made", "label", "kind", text.alias("text")), "planted")
    return candidates(made, keep=("made", "label", "kind"))


def _training(rows: DataFrame, max_findings: int) -> DataFrame:
    """Per class, at most `max_findings` distinct findings in their context, chosen by hash, so a rare class stays whole.

    `weight` is the number of rows that a finding stands for: its copies, times the share of its class that was drawn.
    """
    rows = rows.withColumn("_h", F.xxhash64("value", "word", "left2", "left1", "right1"))
    held = rows.select("label", "_h").distinct().groupBy("label").agg(F.count("_h").alias("n")).orderBy("label").collect()
    out = None
    for label, n in held:
        own, scale = rows.where(F.col("label") == label), 1_000_000_000
        if n > max_findings:  # far fewer rows before they are grouped
            own = own.where(F.pmod("_h", F.lit(scale)) < int(scale * min(1.0, 1.2 * (max_findings + 1000) / n)) + 1)
        folded = own.groupBy(*FEATURES, "label", "_h").agg((F.count("_h") * max(1.0, n / max_findings)).alias("weight"))
        drawn = bounded(folded, F.col("_h"), max_findings)
        out = drawn if out is None else out.unionAll(drawn)
    return rows.select(*FEATURES, "label", "_h", F.lit(1.0).alias("weight")).limit(0) if out is None else out


def classify(found: DataFrame, labelled: DataFrame | None = None, words: list[str] | None = None, max_findings: int = 20_000,
             trees: int = 20, depth: int = 6) -> DataFrame:
    """Candidates with `score` and `is_secret`.

    `labelled` holds candidates in the same columns with a `label`; at most `max_findings` of each class, chosen by hash,
    train the forest.
    """
    rows = with_features(found, words or [])
    train = weak_labels(rows) if labelled is None else with_features(labelled, words or []).where("label is not null")
    train = settle(_training(train.withColumn("label", F.col("label").cast("double")), max_findings), "findings")
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    if len(classes) < 2:
        score = F.lit(classes.pop() if classes else 0.0)
        return rows.withColumn("score", score).withColumn("is_secret", F.col("score") > 0.5)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=11, cacheNodeIds=False)
    model = forest.fit(assembler.transform(train).select("_x", "label", "weight"))
    scored = model.transform(assembler.transform(rows)).withColumn("score", vector_to_array(F.col("probability"))[1])
    return scored.drop("_x", "rawPrediction", "probability", "prediction").withColumn("is_secret", F.col("score") > 0.5)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), labelled: DataFrame | None = None) -> DataFrame:
    """Classified candidates of all documents, by the labelled findings given, else by planted ones among the corpus's words."""
    found, words = settle(candidates(docs, text, keep), "candidates"), dictionary(docs, text)
    return classify(found, planted(docs.sparkSession, words) if labelled is None else labelled, words)


def redact(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """The documents with every finding masked in its text; all rows and columns stay.

    Findings meet their text by its SHA-256, so repeated rows and null ids need no key. Only documents with a candidate
    are joined.
    """
    own = uuid.uuid4().hex  # names no column of `docs` has
    key, found = f"text_key_{own}", f"values_{own}"
    marked = docs.withColumn(key, F.sha2(F.col(text), 256))
    values = scan(marked, text, (key,), labelled).where("is_secret").groupBy(key).agg(F.collect_set("value").alias(found))
    has = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    clean = F.aggregate(F.array_sort(F.coalesce(found, F.array().cast("array<string>")), lambda a, b: F.char_length(b) - F.char_length(a)),
                        F.col(text), lambda acc, v: F.replace(acc, v, F.lit(MASK)))
    changed = marked.where(has).join(values, key, "left").withColumn(text, clean).select(*docs.columns)
    return docs.where(~has).unionByName(changed)
