"""Event-sourced chat formatting and WARC reassembly: exact round trips on hostile rows."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from labelweave.llm import chat, warc
from labelweave.llm.common import read

CONV = "conv_id long, turn long, role string, text string, seq string"


def test_escape_is_reversible_and_hides_control_strings():
    for text in ("", "\\", "#### x", "### Assistant: </turn> ok", "\\### Assistant: </turn> ok", "\\h\\l\\c", "</turn></turn>\n", "## ", "a\\\\#<:"):
        block, start, length = chat.render_block("assistant", text)
        assert chat.parse_block(block) == ("assistant", text)
        assert chat.unescape(block[start:start + length]) == text
        assert block.count(chat.END) == 1 and block[len(chat.HEAD):].count("### ") == 0
    assert chat.parse_block(chat.render_block("a:b#</turn>\\", "x")[0]) == ("a:b#</turn>\\", "x")


def test_rows_come_back(spark, sf_dir):
    extra = spark.createDataFrame([
        (-7, 0, "user", "\\### Assistant: </turn> ok", "x"), (-7, 1, "assistant", "\\### Assistant: </turn> ok", "x"), (-8, 0, None, None, None),
        (-8, 0, "assistant", "", "x"), (None, None, "a:b", "#### x## \\\\#", "x"), (-9, 1, "assistant", "é" * 5000, "x"),
        (-9, 1, "assistant", "é" * 5000, "x"), (-10, 5, "assistant", "z" * 300_000, "x")], CONV)
    rows = read(spark, sf_dir, "conversations").withColumn("seq", F.lit("clash")).unionByName(extra)
    out = chat.read_back(chat.render_turns(chat.log_of(rows), *chat.ORDER), *chat.ORDER).collect()
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.conv_id].append(r)
    assert {r.conv_id for r in out} == set(by) and len(out) == len(by)
    for r in out:
        turns = sorted(by[r.conv_id], key=lambda x: (-1 if x.turn is None else x.turn, x.role or ""))
        trained = "".join(x.text or "" for x in turns if x.role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(trained)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x.role or ''}\n{x.text or ''}\n" for x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()


def test_fold(spark):
    log = spark.createDataFrame([
        (1, 1, 1, "open", "user", "helo"), (1, 1, 2, "edit", None, "hello"), (1, 2, 1, "open", "assistant", None), (1, 2, 2, "delta", None, "bad"),
        (1, 2, 3, "regenerate", None, None), (1, 2, 5, "delta", None, "b"), (1, 2, 4, "delta", None, "a"), (1, 3, 1, "open", "user", "gone"),
        (1, 3, 2, "retract", None, None), (2, 1, 1, "open", "system", None)], "conv_id long, message long, seq int, kind string, role string, text string")
    got = {(r.conv_id, r.message): chat.parse_block(r.block) for r in chat.render_turns(log).collect()}
    assert got == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "ab"), (2, 1): ("system", "")}
    whole = {r.conv_id: r.formatted for r in chat.conversations_of(chat.render_turns(log)).collect()}
    assert whole[1] == "### user: hello</turn>\n### assistant: ab</turn>\n"
    assert chat.read_back(chat.render_turns(log.limit(0))).count() == 0
    with pytest.raises(Exception, match="unknown event kind"):
        chat.render_turns(log.withColumn("kind", F.lit("?"))).count()


def _expected(rows):
    best, out = {}, collections.Counter()
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 1000 and r.page_id is not None:
            best[p] = max(best.get(p, r.page_id), r.page_id)
    for r in rows:
        p = (r.html or "").encode()
        again = r.page_id is not None and p in best and best[p] != r.page_id
        out[(r.page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[p] if again else None)] += 1
    return out


def test_archives_round_trip(spark, sf_dir):
    extra = spark.createDataFrame([
        (100000, None, "x" * 2000, 1), (100001, "u\r\n", "x" * 2000, 2), (100001, "u\r\n", "x" * 2000, 2), (100002, "u", None, 3), (100007, "u", "", 3),
        (100003, "http://x/WARC/1.1", ("\r\n\r\n" + warc.SEPARATOR) * 200, 4), (100004, "u", "WARC/1.1\r\nö\r\nWARC/1.1\r\n", 5),
        (None, "u", "x" * 2000, 6), (100005, "u", "ß" * 200_000, 7), (100006, "u", "y" * 999, 8), (100008, "u", "y" * 999, 8)],
        "page_id long, url string, html string, digest int")
    pages = read(spark, sf_dir, "pages").withColumn("digest", F.lit(0)).unionByName(extra)
    out = warc.archive_round_trip(pages, segment_chars=50_000).collect()
    assert not [r.problem for r in out if r.problem]
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == _expected(pages.collect())
    assert all(bytes(r.payload) == b"\xc3\x9f" * 200_000 for r in out if r.page_id == 100005)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_damaged_segments_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 5000), (2, "u", "b" * 100)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_records(pages), path, segment_chars=1000, compression="none")
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() >= 4
    cut = warc.reassemble(records.where("number <> 3")).collect()
    assert {r.page_id: r.problem for r in cut} == {1: "segments missing or repeated", 2: None}
    short = warc.reassemble(records.where("not (record_type = 'continuation' and total is not null)")).collect()
    assert {r.page_id: r.problem for r in short} == {1: "wrong total length", 2: None}
    lost = warc.reassemble(records.where("not (page_id = 1 and record_type = 'response') or page_id is null")).collect()
    assert sorted(str(r.problem) for r in lost) == ["None", "no first segment"]
