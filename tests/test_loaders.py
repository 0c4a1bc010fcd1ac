"""The loaders refuse planted faults, and read their sources no more often than they say."""

import csv
import json

import pytest

from canvass.errors import DataError
from canvass.plans import loaders

IDS = ["QID9_1", "QID9_2"]


def tree(*answers):
    return json.dumps({"Elements": [{"Questions": [{"QuestionID": q, "QuestionText": "Buy?", "Answers": {"SelectedText": a, "SelectedByPosition": 1}} for q, a in zip(IDS, answers, strict=True)]}]})


def write(folder, name, rows):
    (folder / name).mkdir(exist_ok=True)
    with open(folder / name / "x.csv", "w", newline="") as f:
        csv.writer(f).writerows(rows)


def sources(spark, folder, earlier=None, later=None, trees=None, catalog=None):
    write(folder, "earlier", earlier or [["pid", "age", *IDS], ["1", " 30", "yes ", "no"], ["2", "", "no", "no"]])
    write(folder, "later", later or [["pid", *IDS, "other"], ["2", "no", "yes", ""], [" 1 ", "yes", "no", "x"]])
    spark.createDataFrame(trees or [("1", tree("yes", "no")), ("2", tree("no", "yes"))], "pid string, tree string").write.mode("overwrite").parquet(str(folder / "wave"))
    entries = catalog or [{"QuestionID": "age", "BlockName": "Demographics", "QuestionText": "How old?", "Options": ["30", "40"], "csv_columns": ["age"]}, {"QuestionID": "o", "BlockName": "Else", "QuestionText": "?", "Options": ["x"], "csv_columns": ["other"]}]
    (folder / "catalog.json").write_text(json.dumps(entries))
    at = lambda x: str(folder / x)
    return {"earlier": at("earlier"), "later": at("later"), "catalog": at("catalog.json"), "waves": [at("wave")], "payload": "tree", "basic": ["age"], "ids": IDS, "persons": 2, "files": 1, "path": at("joined")}


def test_twin_tables(spark, tmp_path):
    got = loaders.load_twin(spark, **sources(spark, tmp_path))
    assert got.audit == {"rows_earlier": 2, "rows_later": 2, "rows_trees": 2, "cells_equal": 3, "cells_differ": 1}
    assert sorted((r["pid"], r["age"], r["QID9_1"]) for r in got.rows.collect()) == [("1", " 30", "yes "), ("2", "", "no")]
    assert {r["pid"]: [i["answer"] for i in r["items"]] for r in got.items.collect()} == {"1": ["yes", "no"], "2": ["no", "yes"]}
    assert got.stems == {"age": "How old?"} and got.options == {"age": ["30", "40"]}
    made = loaders.build_twin(got, basic=["age"], ids=IDS, strata=["age"], seed=1, source="earlier.csv", size=1)
    assert sorted(r["subject_id"] for r in made.cards.collect()) == ["1", "2"] and made.sample.count() == 1


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"earlier": [["pid", "age", *IDS], ["1", "30", "a", "b"]]}, "earlier has 1 rows, not 2"),
        ({"earlier": [["pid", "age", *IDS], ["1", "30", "a", "b"], ["3", "30", "a", "b"]]}, "lacks persons"),
        ({"earlier": [["pid", "age", *IDS], ["1", "30", "a", "b"], ["1 ", "30", "a", "b"]]}, r"earlier repeats persons: 1, such as \['1'\]"),
        ({"earlier": [["pid", "age", *IDS], ["1", "30", "a", "b"], [" ", "30", "a", "b"]]}, "blank persons"),
        ({"earlier": [["pid", *IDS], ["1", "a", "b"], ["2", "a", "b"]]}, r"lacks the columns \['age'\]"),
        ({"later": [["pid", *IDS, "secret"], ["1", "yes", "no", ""], ["2", "no", "yes", ""]]}, r"unknown columns \['secret'\]"),
        ({"later": [["pid", *IDS], ["1", "yes", "yes"], ["2", "no", "yes"]]}, r"answers differ between table and tree: 1, such as \['1'\]"),
        ({"trees": [("1", tree("yes", "no"))]}, "trees has 1 rows, not 2"),
        ({"catalog": [{"QuestionID": "age", "BlockName": "Demographics", "QuestionText": "How old?", "Options": ["30"], "csv_columns": ["age"]}, {"QuestionID": "sex", "BlockName": "Demographics", "QuestionText": "?", "Options": ["x"], "csv_columns": ["sex"]}]}, r"without a place: \['sex'\]"),
    ],
)
def test_twin_faults(spark, tmp_path, change, error):
    with pytest.raises(DataError, match=error):
        loaders.load_twin(spark, **sources(spark, tmp_path, **change))


def test_sources_are_read_once(spark, tmp_path):
    kinds = sources(spark, tmp_path)
    reads = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("load", "load")
    try:
        loaders.load_twin(spark, **kinds)
        reads = tracker.getJobIdsForGroup("load")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # headers, the catalog's checks, the depth of the trees, and one pass over all three
    assert len(reads) < 30


def test_lettuce_table(spark, tmp_path):
    from canvass.plans.builders import DRAWN_PRICE, DRAWN_PRODUCT, OUTCOMES

    head = ["pid", "survey_q01_age", *OUTCOMES, DRAWN_PRODUCT, DRAWN_PRICE]
    write(tmp_path, "t", [head, ["1", "30", *["1.5"] * 6, "TRUE", "kale", "2"], ["2", "31", *[" "] * 6, "FALSE", "", ""]])
    got = loaders.load_lettuce(spark, table=str(tmp_path / "t"), persons=2, path=str(tmp_path / "o"))
    assert got.audit == {"rows_lettuce": 2, "blank_outcomes": 6}
    items = {r["pid"]: r["items"] for r in got.items.collect()}
    assert items["1"][-1]["stimulus"] == {DRAWN_PRICE: "2", DRAWN_PRODUCT: "kale"} and items["1"][0]["answer"] == "1.5"
    made = loaders.build_lettuce(got, columns=["survey_q01_age"], strata=["survey_q01_age"], seed=1, source="t.csv")
    assert [r["reason"] for r in made.exclusions.collect()] == ["pricing outcome local_field is blank"]
    with pytest.raises(DataError, match="610"):
        loaders.load_lettuce(spark, table=str(tmp_path / "t"))
    write(tmp_path, "u", [[*head, "odd"], ["1", "30", *["1.5"] * 6, "TRUE", "kale", "2", ""]])
    with pytest.raises(DataError, match="odd"):
        loaders.load_lettuce(spark, table=str(tmp_path / "u"), persons=1)
