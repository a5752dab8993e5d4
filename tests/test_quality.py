import pytest

from labelweave.operators import quality as Q


@pytest.fixture(scope="module")
def rows(spark):
    data = [("1", "a", "POS", "km", "train", "g1"), ("2", " ", "neg", "EN", "val", "g1"), ("1", "b", "odd", "", "test", ""),
            ("", None, "", "xx", "dev", "g2"), ("1", "c", "POS", "en", "test", "g3")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)],
                                 "id string, text string, label string, lang string, split string, group string, seq long")


def rules(df):
    return sorted((r["seq"], r["rule"]) for r in df.collect() if r["seq"] is not None)


def test_issues(rows):
    found = Q.issues(rows, group="group", lang="lang", split="split", langs=["km", "en"])
    assert rules(found) == [
        (1, "empty text"), (2, "duplicate id"), (2, "empty lang"), (2, "invalid label"), (2, "several splits"),
        (3, "empty id"), (3, "empty label"), (3, "empty text"), (3, "invalid lang"), (3, "invalid split"), (4, "duplicate id")]
    assert [r["detail"] for r in found.where("seq is null").collect()] == ["g1: train,val"]
    assert Q.verdict(found).first()["verdict"] == "FAILED"
    assert Q.shown_issues(found, 3).count() == 3


def test_valid_rows_pass(rows):
    good = rows.where("seq = 0")
    assert Q.verdict(Q.issues(good, lang="lang", split="split")).first()["verdict"] == "PASSED"
    assert Q.splits_disjoint(good)


def test_extra_labels_can_be_allowed(rows):
    assert "invalid label" not in {r for _, r in rules(Q.row_level(rows, allow_extra_labels=True))}


def test_summary_and_columns(spark, rows):
    r = Q.summary(rows, "group").first()
    assert (r["total_rows"], r["unique_ids"], r["duplicate_ids"], r["empty_text"], r["group_nonempty"]) == (5, 3, 2, 2, 4)
    langs = {x["value"]: x["n"] for x in Q.distributions(rows, lang="lang", langs=["km", "fr"]).where("dimension = 'lang'").collect()}
    assert langs["fr"] == 0 and langs["en"] == 2
    assert [x["column"] for x in Q.missing_columns(rows.drop("text"), ["topic"]).collect()] == ["text", "topic"]
    with pytest.raises(ValueError):
        Q.row_level(rows.drop("label"))
    empty = Q.summary(rows.where("seq < 0")).first()
    assert (empty["total_rows"], empty["empty_text_pct"]) == (0, 0.0)
