import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.functions import normalize as N
from labelweave.functions.labels import annotation_label, code_switch, lang_index, number, rejection_reason, strip


def run(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in rows.select("i", expression.alias("o")).orderBy("i").collect()]


def norm(spark, values, **switches):
    return run(spark, values, N.normalize("t", N.NormConfig(**switches)))


def test_single_steps(spark):
    assert norm(spark, ["haaaa!!! ...ok  x"], elongation=True) == ["haa!! ..ok  x"]
    assert norm(spark, ["haaaa!!! ...ok  x"], punct=True) == ["haaaa! .ok  x"]
    assert norm(spark, ["haaaa!!! ...ok  x  \x1c"], whitespace=True) == ["haaaa!!! ...ok x"]
    text = "😀🔥 ១២៣ ។ ៗៗៗ​"
    assert norm(spark, [text], emoji="map") == [" <EMOJI>  <EMOJI>  ១២៣ ។ ៗៗៗ​"]
    assert norm(spark, [text], emoji="remove", khmer_digits="map") == [" 123 ។ ៗៗៗ​"]
    assert norm(spark, [text], khmer_punct=True, remove_zero_width=True) == ["😀🔥 ១២៣ . ៗ"]
    assert norm(spark, ["a\r\r\r\rb"], elongation=True) == ["a\r\rb"]
    assert norm(spark, ["a\n\n\n\nb"], elongation=True) == ["a\n\n\n\nb"]


def test_null_empty_and_no_config(spark):
    assert norm(spark, [None, ""], nfc=True, whitespace=True) == ["", ""]
    assert run(spark, [None, " x "], N.normalize("t", None)) == ["", " x "]


def test_latin_ratio_and_actions(spark):
    text = "សួស្តី Hello!!!"
    assert run(spark, [text, ""], N.latin_ratio(F.col("t"))) == [5 / 15, 0.0]
    assert run(spark, [text], code_switch("t")) == ["km+en"]
    assert norm(spark, [text], latin_action="tag") == ["<LATIN> " + text]
    assert norm(spark, [text], latin_action="strip") == ["សួស្តី !!!"]
    assert norm(spark, [text], latin_action="tag", latin_threshold=0.5) == [text]


def test_everything(spark):
    assert norm(spark, ["haaaa!!! ...ok  x"], **vars(N.NormConfig.everything())) == ["<LATIN> haa! .ok x"]


def test_mark_order(spark):
    stray = "̣́ạ́"
    assert norm(spark, [stray], diacritics_reorder=True) == ["̣́ạ́"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aȩ្̣́៝ក é", max_size=8), min_size=1, max_size=20))
def test_nfc_equals_unicodedata(spark, texts):
    assert norm(spark, texts, nfc=True) == [unicodedata.normalize("NFC", t) for t in texts]


def test_override_keeps_known_switches():
    cfg = N.NormConfig().override(punct=True, unknown=1, emoji=None)
    assert cfg.punct and cfg.emoji == "keep"


def test_scalar_rules(spark):
    assert run(spark, [" positive", "+", "-", "neutral", "0", "x", None], annotation_label("t")) == [
        "POS", "POS", "NEG", "NEU", "NEU", "X", ""]
    assert run(spark, ["  a \t"], strip("t")) == ["a"]
    assert run(spark, ["EN", "xx", None], lang_index("t", ["de", "en"])) == [1, -1, -1]
    assert run(spark, ["1.5", " 2 ", "", "a", None], number("t")) == [1.5, 2.0, None, None, None]
    assert run(spark, ["a", " ", None, "a" * 4001], rejection_reason("t")) == [None, "empty", "empty", "too_long"]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    rows = spark.createDataFrame([(i, "haaa  ១" * i) for i in range(20)], "i int, t string").repartition(parts)
    out = rows.select("i", N.normalize("t", N.NormConfig.everything()).alias("o")).orderBy("i").collect()
    assert out[1]["o"] == "<LATIN> haa 1"


def test_only_texts_that_may_change_leave_the_engine():
    """Quick check against Python's own normalisation: every single character, and pairs of characters with marks."""
    import re
    import unicodedata

    wide = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", p)
    may_change, in_a_row = (re.compile(wide(p)) for p in N._unicode_order())
    points = [p for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF]
    assert all(may_change.search(chr(p)) for p in points if unicodedata.normalize("NFC", chr(p)) != chr(p))
    rng = random.Random(3)
    odd = [chr(p) for p in points if unicodedata.combining(chr(p)) or unicodedata.decomposition(chr(p))] + [chr(p) for p in range(0x1100, 0x1200)]
    for _ in range(60_000):
        text = "".join(rng.choice(odd) if rng.random() < 0.7 else rng.choice("aeoកស") for _ in range(rng.randint(2, 4)))
        if not may_change.search(text):
            assert unicodedata.normalize("NFC", text) == text
        if not in_a_row.search(text):
            assert N._order_marks(text) == text
    for text in ("សួស្តី ពិភពលោក ខ្មែរ", "漢字かな交じり文", "plain café", "😀🔥"):
        assert not may_change.search(text) and not in_a_row.search(text)
    for text in ("cafe\u0301", "a\u0323\u0307", "\u1100\u1161", "\u212b"):
        assert may_change.search(text)


def test_a_folder_is_made_once_for_a_local_session():
    from types import SimpleNamespace

    from labelweave import session

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                           sparkContext=SimpleNamespace(master="local[2]", applicationId="app-of-a-test"))
    first = session.scratch_path(bare, "a")
    assert first.startswith(session.shared_dir(bare)) and session.shared_dir(bare) == session.shared_dir(bare)
    bare.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        session.shared_dir(bare)
