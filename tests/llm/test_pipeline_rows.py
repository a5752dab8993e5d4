"""Rows of the pipeline's Jaccard stage whose ids are null or repeat."""

from __future__ import annotations

import corpus_pipeline


def _words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_one_row_of_each_component_stays(spark):
    rows = [(None, _words("a")), (None, _words("b")), (None, _words("c")), (5, _words("c")), (5, _words("c") + " more"), (7, _words("d")), (7, _words("e")),
            (8, _words("d")), (2, _words("e")), (9, ""), (9, " \n"), (None, None), (None, None), (10, _words("f")), (10, _words("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, docs, "").collect()]
    want = [(None, _words("a")), (None, _words("b")), (None, _words("c")), (7, _words("d")), (2, _words("e")), (9, ""), (9, " \n"), (None, None), (None, None), (10, _words("f"))]
    assert sorted(got, key=str) == sorted(want, key=str)
