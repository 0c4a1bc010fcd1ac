"""Trees and replies against plain readings of their rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from canvass.functions import trees
from canvass.plans import scoring


def frame(spark, values, name="x"):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], f"i int, {name} string")


def random_json(rng, deep=0):
    kind = rng.random()
    if deep > 5 or kind < 0.3:
        return rng.choice([1, 2.5, None, True, "x", "{not", '[1,{"a":2}]', 'q"}', "é\\", ""])
    if kind < 0.6:
        return [random_json(rng, deep + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice("zyxwa") + str(i): random_json(rng, deep + 1) for i in range(rng.randint(0, 4))}


def test_objects_in_the_order_of_the_text(spark):
    rng = random.Random(4)
    values = [random_json(rng) for _ in range(150)] + ["{", None, "", "[] x", "  [{\"b\": {}, \"a\": {}}] "]

    def walk(x):
        if isinstance(x, dict):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from walk(y)

    def read(t):
        try:
            return json.loads(t)
        except (TypeError, ValueError):
            return None

    df = frame(spark, values)
    for r in trees.objects(df, "x").collect():
        want = list(walk(read(r["x"])))
        assert [json.loads(o["body"]) for o in r["objects"]] == want, r["x"]
        # the text's own order, not one by name
        assert [list(json.loads(o["body"])) for o in r["objects"]] == [list(w) for w in want]


def test_aligned_is_a_longest_run(spark):
    def longest(h, m):
        table = [[0] * (len(m) + 1) for _ in range(len(h) + 1)]
        for i, x in enumerate(h):
            for j, y in enumerate(m):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(1)
    rows = [tuple([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2)) for _ in range(200)] + [(["a", "b"], ["b", "a", "x"]), (["a", "b", "c"], ["a", "c"])]
    df = spark.createDataFrame([(h, m) for h, m in rows], "h array<string>, m array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(trees.aligned(F.col("h"), F.col("m"))).collect()]
    for (h, m), pairs in zip(rows, got, strict=True):
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        if len(h) == len(m):
            assert pairs == [(i, i) for i in range(len(h))]
        else:
            assert len(pairs) == longest(h, m) and all(h[i] == m[j] for i, j in pairs)
    assert got[-2] == [(1, 0)]  # of equally long ones the first human cell is given up
    assert got[-1] == [(0, 0), (2, 1)]


def test_forms_of_answers(spark):
    cases = [
        ({"SelectedByPosition": [1, "02", "x", None]}, "#1#2#x#None"), ({"SelectedByPosition": 3}, "#3"), ({"SelectedByPosition": "03"}, "#03"), ({"SelectedText": [" A", "b"]}, "|a|b|"), ({"SelectedText": " Ja "}, "ja"), ({"SelectedText": "ẞ"}, "ss"),
        ({"Values": [1, " 2 "]}, "~1~2"), ({"Values": 4}, "~4"), ({"Values": None}, None), ({}, None), ({"SelectedText": None, "Values": [3]}, "~3"), ({"Values": [], "SelectedByPosition": []}, "#"), ({"SelectedText": ""}, ""),
    ]
    rows = frame(spark, [c for c, _ in cases]).withColumn("v", F.try_parse_json("x")).select("i", trees.form(trees.answer(F.col("v"))).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == [f for _, f in cases]


def test_types_by_name_and_by_answer(spark):
    survey = [({"QuestionType": q}, t) for q, t in (("MC", "choice"), (' "te" ', "text"), ("Matrix", "matrix"), ("MATRIX SLIDER", "matrix"), ("HSLIDER", "slider"), ("?", "other"))]
    survey += [({"Answers": {"Values": 1}}, "slider"), ({"Answers": {"SelectedByPosition": [1]}}, "matrix"), ({"Answers": {"SelectedText": "x"}}, "choice"), ({"Answers": {"SelectedText": ["x"]}}, "choice"), ({"QuestionType": None, "Answers": {"Values": None}}, "other")]
    got = frame(spark, [q for q, _ in survey]).withColumn("v", F.try_parse_json("x")).select("i", trees.survey_type(F.col("v"), trees.answer(F.try_variant_get("v", "$.Answers", "variant"))).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in survey]
    reply = [({"Question Type": "MC"}, "choice"), ({"Question Type": "Text entry"}, "text"), ({"QuestionType": "text matrix"}, "matrix"), ({"Question Type": "", "QuestionType": "slider"}, "slider"), ({"SelectedText": ["x"]}, "matrix"), ({"Values": [1]}, "slider"), ({}, "choice")]
    got = frame(spark, [q for q, _ in reply]).withColumn("v", F.try_parse_json("x")).select("i", trees.reply_type(F.col("v"), trees.answer(F.col("v"))).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in reply]


def test_numbers_of_answers(spark):
    options = F.array(F.lit("Yes"), F.lit("No, never"))
    cases = [
        ({"Values": [1, "2%"]}, True, [1.0, 2.0]), ({"Values": [1, "x"], "SelectedByPosition": 3}, False, []), ({"Values": "1,200"}, False, [1200.0]), ({"SelectedByPosition": 2}, False, [2.0]), ({"SelectedByPosition": [1, 2]}, True, [1.0, 2.0]),
        ({"SelectedByPosition": ["x"], "SelectedText": "no"}, False, [2.0]), ({"SelectedByPosition": "x", "SelectedText": "no"}, False, []), ({"SelectedText": ["yes", "No"]}, True, [1.0, 2.0]), ({"SelectedText": "yes, always"}, False, [1.0]), ({"SelectedText": ["yes", "?"]}, False, []), ({}, False, []),
    ]
    got = frame(spark, [c for c, *_ in cases]).withColumn("v", F.try_parse_json("x")).withColumn("o", options).select("i", trees.chosen_numbers(trees.numbers(trees.answer(F.col("v")), F.col("o"))).alias("n")).orderBy("i").collect()
    assert [(r["n"]["several"], r["n"]["codes"]) for r in got] == [(s, c) for _, s, c in cases]


def study(spark, *rows):
    return scoring.study_cells(spark.createDataFrame([("s:1", json.dumps(h), m if isinstance(m, str) else json.dumps(m)) for h, m in rows], "question_id string, payload string, model string"))


def test_entries_without_an_answer_are_not_paired(spark):
    tree = {"Elements": [{"Answers": {"SelectedByPosition": 1}}, {"Answers": {"SelectedByPosition": 2}}]}
    cells = study(spark, (tree, {"Q1": {"SelectedByPosition": 1}, "Q2": {"note": "none"}, "Q3": {"SelectedByPosition": 2}}))
    assert sorted(map(tuple, scoring.study_labels(cells).collect())) == [("s:Q1", "#1", "#1"), ("s:Q3", "#2", "#2")]
    assert sorted(tuple(r)[:3] for r in scoring.encode_cells(cells).collect()) == [("s:Q1", 1.0, 1.0), ("s:Q3", 2.0, 2.0)]


def test_labels_and_numbers_are_paired_apart(spark):
    # the tree's first question was not answered: labels leave it out, numbers pair by types
    tree = [{"QuestionType": "MC", "Answers": {"SelectedText": None}}, {"QuestionType": "MC", "Answers": {"SelectedByPosition": 1}}, {"QuestionType": "Slider", "Answers": {"Values": [4]}}]
    cells = study(spark, (tree, json.dumps(json.dumps({"Q1": {"SelectedByPosition": 2}, "Q2": {"Question Type": "slider", "Answers": {"Values": [5]}}}))))
    assert sorted(map(tuple, scoring.study_labels(cells).collect())) == [("s:Q1", "#1", "#2"), ("s:Q2", "~4", "~5")]
    assert sorted(tuple(r)[:3] for r in scoring.encode_cells(cells).collect()) == [("s:Q2:1", 4.0, 5.0)]  # Q1 meets the first choice, which has no number


def test_no_python_in_study_plans(spark):
    cells = study(spark, ([{"Answers": {"Values": 1}}], {"Q1": {"Values": 1}}))
    for df in (scoring.study_labels(cells), scoring.encode_cells(cells)):
        assert "Python" not in df._jdf.queryExecution().toString() and "ArrowEval" not in df._jdf.queryExecution().toString()


def test_leaves_are_not_opened_and_keys_in_escapes_are_read(spark):
    tree = '[{"Options": ["a [1]", "b {"], "\\u0041nswers": {"SelectedByPosition": 2}}, {"a": [[], {}, [{"b": 1}]]}]'
    (row,) = trees.objects(frame(spark, [tree]), "x").collect()
    assert [o["at"] for o in row["objects"]] == ["[0]", "[0].Answers", "[1]", "[1].a[1]", "[1].a[2][0]"]
    (row,) = trees.survey_cells(frame(spark, [tree]), "x", "h").collect()
    assert [c["form"] for c in row["h"]] == ["#2"]


def test_pricing_answers_are_strict(spark):
    q = lambda name, **more: {"QuestionID": f"QID9_{name}", "QuestionText": "Buy?", "Answers": {"SelectedText": "Yes", "SelectedByPosition": 1}} | more
    cases = [
        ({"e": [q(2), {"x": q(1)}, {"QuestionID": "QID9_3"}, {"QuestionID": "Q", "QuestionText": 1}]}, ["QID9_2", "QID9_1"], None),
        ([q(1), q(1)], [], "repeats QID9_1"), ([q(1, Answers=[])], [], "has no Answers object for QID9_1"), ([q(1), q(2, Answers={"SelectedText": 3})], [], "has no text chosen for QID9_2"), ([q(1, QuestionText=None)], [], "has no text of QID9_1"),
        ([q(1, QuestionText=" ")], [], "has no text of QID9_1"), ([q(1, Answers={"SelectedText": "a", "SelectedByPosition": True})], [], "has no whole place for QID9_1"), ([q(1, Answers={"SelectedText": "a", "SelectedByPosition": 1.5})], [], "has no whole place for QID9_1"),
        ([q(1, Answers={"SelectedText": " a", "SelectedByPosition": 1})], [], "has a blank or padded answer to QID9_1"), ("{", [], None),
    ]
    got = trees.priced(frame(spark, [c for c, *_ in cases]), "x", "p").orderBy("i").collect()
    assert [([x["question_id"] for x in r["p"]["items"]], r["p"]["error"]) for r in got] == [(ids, e) for _, ids, e in cases]


@pytest.mark.parametrize("wrap", [lambda e: {"Elements": e}, lambda e: e])
def test_questions_of_a_survey(spark, wrap):
    block = {"ElementType": "Block", "Questions": [
        {"QuestionID": "Q1", "QuestionText": "<b>Pick</b>", "QuestionType": "MC", "Options": ["a", "b"], "Answers": {"SelectedText": "b"}},
        {"QuestionID": "M1", "QuestionText": "Rate", "QuestionType": "Matrix", "Columns": ["lo", "hi"], "Rows": ["one", " ", "two"], "Answers": {"SelectedText": ["lo", "lo", "hi"]}},
        {"QuestionID": "D", "QuestionType": "DB"}, 7, {"QuestionText": "Why?", "Answers": {"Text": [{"a": "x <i>y</i>"}, "z"]}},
    ]}
    other = {"ElementType": "Block", "Questions": [{"QuestionID": "S", "QuestionText": "How far?", "QuestionType": "Slider", "Answers": {"Values": [1, 2]}}]}
    tree = wrap([{"ElementType": "Branch", "Elements": [block]}, {"ElementType": "Group", "Elements": [other]}, other, {"ElementType": "Block"}])
    got = trees.survey_questions(frame(spark, [tree, "{", None]), "x").orderBy("i").collect()
    assert [(q["block"], q["pos"], q["id"], q["kind"], q["gold"]) for q in got[0]["questions"]] == [(0, 0, "Q1", "multiple_choice", "b"), (0, 1, "M1:1", "likert", "lo"), (0, 2, "M1:3", "likert", "hi"), (0, 3, "q5", "text", "x y; z"), (1, 4, "S", "numeric", "1, 2")]
    assert [q["prompt"] for q in got[0]["questions"]][:3] == ["Pick\nOptions:\n- a\n- b", "Rate\none\nOptions:\n- lo\n- hi", "Rate\ntwo\nOptions:\n- lo\n- hi"]
    assert got[1]["questions"] == got[2]["questions"] == []


def test_trees_are_opened_once_below_an_explode(spark):
    df = trees.survey_questions(frame(spark, [{"Elements": []}]), "x").select(F.explode("questions"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("$['ElementType']") == 1


def test_texts_that_look_like_objects_are_none(spark):
    values = ['{"a": "{x}", "b": {"c": "[1]"}}', '["\\u007b", "\\u005b", [{"d": 1}]]', '{"a": " {", "b": [[]]}', '{"a": "x\\"{", "b": {}}']
    got = [[o["at"] for o in r["objects"]] for r in trees.objects(frame(spark, values), "x").orderBy("i").collect()]
    assert got == [["", ".b"], ["[2][0]"], [""], ["", ".b"]]


def test_texts_of_objects_in_order(spark):
    rng = random.Random(9)
    values = [json.dumps(random_json(rng), ensure_ascii=bool(i % 2), indent=i % 3 or None) for i in range(150)] + ["{", None, "", "[] x", "  [{\"b\": {}, \"a\": {}}] ", '{"a": 1, "a": {}}', '{"a{": "}\\\\", "b": [[{"c": "\\"{"}]]}']
    df = frame(spark, values)
    got = trees.objects(df, "x").withColumn("b", trees.bodies(F.col("x"), trees.deepest(df, "x"))).collect()
    assert all([json.loads(o["body"]) for o in r["objects"]] == [json.loads(b) for b in r["b"]] for r in got)


def test_each_text_of_a_question_is_read_once(spark, monkeypatch):
    tree = lambda i: [{"Answers": {"SelectedByPosition": i % 2}}, {"note": "Answers"}, {"QuestionType": "Slider", "Answers": {"Values": [i % 3, 1.50, 1e3]}}]
    rows = [(tree(i), {"Q2": {"Values": [i % 2]}, "Q1": {"SelectedByPosition": i % 3}, "Q3": {"x": 1}} if i % 4 else {}) for i in range(40)] + [([], {}), ({}, {"Q1": {"Values": 1}})]
    read = lambda: study(spark, *rows)
    cells = read()
    assert "['Values']" not in (plan := cells._jdf.queryExecution().optimizedPlan().toString()) and ".Values" not in plan
    once = sorted(cells.collect(), key=str)
    assert len(once) == len(rows) and once[-1]["h"] is not None
    monkeypatch.setattr(trees, "FEW", 0)
    assert sorted(read().collect(), key=str) == once
