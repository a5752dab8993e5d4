"""Payloads that end in a version line, and texts with very long words."""

from __future__ import annotations

import numpy as np
import pytest

from labelweave.llm import jaccard, warc


@pytest.mark.parametrize("payload", ["x" + warc.VERSION, warc.VERSION, "a" * 4088 + warc.VERSION + "tail", warc.SEPARATOR * 3, "a" * 4090 + warc.VERSION])
def test_no_chunk_holds_a_version(payload):
    coded = warc.chunked(payload)
    assert warc.VERSION not in coded and warc.dechunk(coded.encode()).decode() == payload


def test_pages_that_end_in_a_version_come_back(spark):
    texts = ["page " + warc.VERSION, "a" * 4088 + warc.VERSION + "b" * 70_000, ("c" * 65_400 + warc.VERSION) * 2]
    pages = spark.createDataFrame([(i, "http://x/", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = [(r.page_id, bytes(r.payload).decode(), r.problem) for r in warc.archive_round_trip(pages).orderBy("page_id").collect()]
    assert got == [(i, t, None) for i, t in enumerate(texts)]


def test_long_words_after_white_space(monkeypatch):
    text = b" " + b"x" * 90 + b" " + b"y" * 200 + b" z  " + b"w" * 64 + b"\n"
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    monkeypatch.setattr(jaccard, "_tables", {})
    assert len(whole) == 4 and np.array_equal(jaccard.word_hashes(text), whole)
