"""Text functions, JSON, cards and batches on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from canvass.functions import jsonx
from canvass.functions import text as x
from canvass.operators import metrics as m
from canvass.operators import relational as r
from canvass.plans import batching, bundle, cards, groups, scoring
from canvass.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    L = F.lit
    assert one(spark, x.strip_html(L(" <p>a&nbsp;b</p> &amp; c "))) == "a b & c"
    assert one(spark, x.norm_label(L(" Straße "))) == "strasse" and one(spark, x.norm_label(L("  "))) is None
    assert [one(spark, x.parse_number(L(v))) for v in ("1,200", " yes", "No", "5%", "inf", "nan", "1_0", "1e2", "")] == [1200.0, 1.0, 0.0, 5.0, None, None, None, 100.0, None]
    opts = F.array(L("Red apple"), L("Green"))
    assert [one(spark, x.encode_with_options(L(v), opts)) for v in ("green", "red", "blue")] == [2, 1, None]
    assert [one(spark, x.weekly_hours(L(v))) for v in ("Full-time student", "Part time", "Full-time", "Self-employed", None)] == [0.0, 20.0, 40.0, None, None]
    assert [one(spark, x.education_bucket(L(v))) for v in ("Associate’s degree", "College graduate", "some_college", "?")] == ["some_college", "bachelor_or_higher", "some_college", "unknown"]
    assert [one(spark, x.income_over_50k(L(v))) for v in ("$30,000-$50,000", "$50,000-$75,000", "none")] == [False, True, False]
    assert [one(spark, x.normalize_yes_no(L(v))) for v in ("Yes!", "nope", "I would not buy", "I would buy", "eh")] == ["Yes", "No", "No", "Yes", None]
    assert one(spark, x.canonical_pid(L(" PID_7 "))) == "7"
    assert one(spark, x.group_key(L("ESS"), F.create_map(L("b"), L("1"), L("a"), L("2")))) == "ESS:a=2|b=1"
    assert one(spark, x.group_key(L("ESS"), F.lit(None).cast("map<string,string>"))) == "ESS:population"
    assert one(spark, x.proportion8(L(1), L(3))) == 33333333 and one(spark, x.proportion8(L(1), L(16))) == 6250000
    with pytest.raises(Exception, match="reserved"):
        one(spark, x.normalize_cell(L(" MISSING ")))


def test_replies(spark):
    cases = {'{"a": 1}': None, 'x ```json\n{"a": 1}\n``` y': None, 'so {"a": 1} it is': None, "": "model reply is empty", "no": "model reply does not contain a JSON object", "[1]": "model reply JSON must be an object"}
    for raw, error in cases.items():
        got = one(spark, jsonx.reply_object(F.lit(raw)))
        assert got["error"] == error and (error or json.loads(got["json"]) == {"a": 1})



def test_metric_identities(spark):
    rng = random.Random(3)
    rows = [(i, str(k), rng.randint(0, 4), rng.randint(0, 4)) for i in range(12) for k in range(4)]
    counts = spark.createDataFrame(rows, "item int, label string, human long, model long")
    got = m.tvd_top1(counts, ["item"]).join(m.jensen_shannon(counts, ["item"]), "item").join(m.ordered_distances(counts, ["item"]), "item").collect()
    assert got
    for g in got:
        mine = [v for v in rows if v[0] == g["item"]]
        h, o = (sum(v[j] for v in mine) for j in (2, 3))
        p, q = [v[2] / h for v in mine], [v[3] / o for v in mine]
        assert g["tvd"] == pytest.approx(sum(abs(a - b) for a, b in zip(p, q, strict=True)) / 2)
        assert g["ks"] <= g["tvd"] + 1e-12 and g["ks"] <= g["wasserstein"] + 1e-12 and 0 <= g["jsd"] <= 1 + 1e-12
        assert g["top1"] == int(any(a == max(p) and b == max(q) for a, b in zip(p, q, strict=True)))


def test_mean_tvd_of_pairs(spark):
    rows = spark.createDataFrame([("price", "buy", "buy"), ("price", "buy", "not"), ("price", "not", "buy"), ("color", "red", "blue"), ("color", "red", "blue"), ("x", None, "y")], "item string, h string, m string")
    got = scoring.mean_tvd_by_item(rows, "item", "h", "m").first()
    assert (got["mean_tvd"], got["mean_top1"], got["items"]) == (0.5, 0.5, 2)


def test_scoring_encodes_lists_options_and_numbers(spark):
    responses = spark.createDataFrame([("q1", "b", "a"), ("q2", "1,2", "3,2"), ("q3:1", "hi", "lo"), ("q4", "5", "x")], "question_id string, human string, model string")
    scales = spark.createDataFrame([("q1", ["a", "b"], 1.0), ("q3", ["lo", "hi"], 1.0)], "question_id string, options array<string>, span double")
    got = {(g["item"], g["human"], g["model"]) for g in scoring.encode_pairs(responses, scales).collect()}
    assert got == {("q1", 2.0, 1.0), ("q2:1", 1.0, 3.0), ("q2:2", 2.0, 2.0), ("q3:1", 2.0, 1.0)}
    assert scoring.score(responses, scales).first()["items"] == 4


def test_batches_and_answers(spark):
    packages = spark.createDataFrame([("s", i, f"q{i}", "me", "Why?", ["a", "b"], "multiple_choice", "answer") for i in range(5)], "subject_id string, ord int, question_id string, persona string, prompt string, options array<string>, kind string, response_mode string")
    batches = batching.pack(packages, 2, outer=True).orderBy("chunk")
    rows = batches.collect()
    assert [b["question_ids"] for b in rows] == [["q0", "q1"], ["q2", "q3"], ["q4"]] and "response: choice" in rows[0]["user"]
    calls = spark.sparkContext.accumulator(0)

    def provider(system, user):
        calls.add(1)
        return json.dumps({"answers": [{"question_id": q, "answer": "a"} for q in ("q0", "q2", "q3")] + [{"question_id": "q0", "answer": "b"}]})

    got = {a["question_id"]: (a["answer"], a["error"]) for a in batching.answers(batching.ask(batches, provider)).collect()}
    assert got["q0"] == ("b", None) and got["q2"] == ("a", None) and got["q1"][1] == "missing question_id q1"
    attempts = []

    def flaky(system, user):
        attempts.append(1)
        if len(attempts) < 3:
            raise batching.TransportError("down")
        return "{}"

    assert batching.with_retry(flaky, pause=0)("", "") == "{}" and len(attempts) == 3


def test_bundles(spark):
    records = spark.createDataFrame([("pid_7", {"age": "34", "QID21": "$100,000 or more"}, " ", [("Q9", "Pick one", ["red", "blue"], "multiple_choice", "SECRET"), ("Q8", "Say", [], None, " ")])], "id string, demographics map<string,string>, persona_text string, questions array<struct<id:string,prompt:string,options:array<string>,kind:string,gold:string>>")
    b = bundle.from_records(records, "twin2k_500")
    assert b.subjects.first()["subject_id"] == "7" and b.subjects.first()["persona_text"] is None
    assert b.cases.count() == 2 and [g["answer"] for g in b.gold.collect()] == ["SECRET"] and "SECRET" not in str(b.questions.collect())
    demo = b.subjects.select(bundle.canonical_demographics(F.col("demographics")).alias("d")).first()["d"]
    assert demo["income"] == "$100,000 or more" and demo["age"] == "34"
    assert b.filtered(F.col("question_id") == "Q8").cases.count() == 1 and bundle.resolve("BDM") == "bdm_lettuce"
    bad = records.withColumn("questions", F.transform("questions", lambda q: q.withField("prompt", F.lit("Answer: SECRET"))))
    with pytest.raises(Exception, match="held-out"):
        bundle.from_records(bad, "x").cases.collect()


def test_cards_and_leaks(spark):
    rows = spark.createDataFrame([("7", "red", " "), ("8", "blue", "12")], "pid string, color string, bid string")
    made = cards.basic_cards(rows, "d", "f.csv", ["color", "bid"], {"color": "Color?", "bid": "Bid?"}, {"color": ["red", "blue"]})
    got = {c["subject_id"]: c for c in made.collect()}
    assert got["7"]["text"].endswith("## Basics\ncolor: red\nbid: MISSING\n") and got["7"]["basic_info"][1]["status"] == "missing"
    assert made.filter(cards.generated_text(F.col("text"))).count() == 0
    # a value of the card itself is no leak, be it digits or not
    outcomes = spark.createDataFrame([("7", "12"), ("8", "12"), ("8", "MISSING"), ("7", "lor: r")], "subject_id string, text string")
    assert {(k["subject_id"], k["kind"]) for k in cards.leaks(made, outcomes).collect()} == {("7", "text")}
    inner = spark.createDataFrame([("9", "## Identity\n\n## Basics\ncolor: x\nprice: 12\n", [("x",)])], "subject_id string, text string, basic_info array<struct<value:string>>")
    outcomes = spark.createDataFrame([("9", "12"), ("9", "pri"), ("9", "a $4.50 b")], "subject_id string, text string")
    assert {(k["subject_id"], k["kind"], k["text"]) for k in cards.leaks(inner, outcomes).collect()} == {("9", "value", "12")}
    with pytest.raises(Exception, match="not in the catalog"):
        cards.basic_cards(rows, "d", "f", ["color"], {"color": "?"}, {"color": ["red"]}).collect()
    bad = cards.eligibility(rows.select("pid"), spark.createDataFrame([("7", [("a", "x"), ("b", " ")])], "pid string, items array<struct<question_id:string,answer:string>>"), ["a", "b"])
    assert {(e["pid"], e["reason"]) for e in bad.collect()} == {("7", "pricing outcome b is blank"), ("8", "missing pricing outcomes")}


def test_life_cards_follow_the_draws(spark):
    people = spark.createDataFrame([("p1", {"age": "40", "education": "College graduate", "work_hours": "38", "income_over_50k": "true", "state": "Ohio"}, {"sleep": 480.5, "work": 300.0})], "subject_id string, demographics map<string,string>, routine map<string,double>")
    text = cards.life_cards(people, 5).first()["text"]
    from canvass.operators.sampling import first_uniform

    rng = first_uniform("5:p1")
    childhood = cards.CHILDHOOD[rng.randrange(5)]
    schooling = cards.SCHOOLING["bachelor_or_higher"][rng.randrange(2)]
    work = cards.WORK["high"][rng.randrange(3)]
    assert f"Childhood: {childhood}\nSchooling: {schooling}\nWork path: {work} Typical weekly hours: 38." in text
    assert "State: Ohio" in text and "- sleep: 480 minutes\n- work: 300 minutes" in text
    assert cards.tendency_cards(people).first()["text"].count("\n") == 7


def test_group_options_and_catalog(spark):
    none = F.lit(None).cast("map<string,string>")
    human = F.create_map(F.lit("B"), F.lit(0.5), F.lit("A"), F.lit(0.5))
    got = one(spark, groups.parse_options(F.lit("Like it? (A): yes\n(B): no"), none, human))
    assert got["status"] in ("from_inline_options", "fallback_human_answer_keys")
    assert one(spark, groups.parse_options(F.lit("Like it?"), none, human))["keys"] == ["A", "B"]
    assert one(spark, groups.parse_options(F.lit("Like it?"), none, F.lit(None).cast("map<string,double>")))["status"] == "fail_no_options_block"
    rows = spark.createDataFrame([("q", "t1", [], "d", "Pop", 1), ("q", "t2", ["a"], "e", "Grouped", 2)], "question_id string, input_template string, options array<string>, dataset_name string, split string, ord int")
    c = groups.catalog(rows).first()
    assert c["source"] == "both" and c["options"] == ["a"] and c["datasets"] == ["d", "e"]


def test_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿pid,a\n7, 8 \n9,\n", encoding="utf-8")
    assert [tuple(v) for v in readers.read_csv(spark, str(p), ["pid", "a"]).collect()] == [("7", "8"), ("9", "")]
    with pytest.raises(ValueError, match="lacks"):
        readers.read_csv(spark, str(p), ["pid", "b"])
    with pytest.raises(ValueError, match="unknown"):
        readers.check_columns(["pid", "z"], {"id": ["pid"]})
    with pytest.raises(ValueError, match="repeated"):
        readers.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    j = tmp_path / "x.jsonl"
    j.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(j), "a int").count() == 2
    j.write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(j), "a int").collect()
    out = tmp_path / "out"
    writers.write_jsonl(spark.createDataFrame([(2, "é"), (1, "x")], "b int, a string"), str(out), ["b"])
    assert [t["value"] for t in spark.read.text(str(out)).orderBy("value").collect()] == ['{"a":"x","b":1}', '{"a":"é","b":2}']
    facts = readers.file_facts(spark, str(out)).filter("name like 'part%'")
    lock = facts.limit(1).withColumn("bytes", F.col("bytes") + 1).union(spark.createDataFrame([("gone", 1, "x")], "name string, bytes long, sha256 string"))
    status = {s["status"] for s in readers.verify(facts, lock).collect()}
    assert {"changed", "missing"} <= status
    assert len(writers.manifest(str(out), spark, seed=1)["manifest_sha256"]) == 64


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int")
    assert {(w["k"], w["v"]) for w in r.last_wins(df, ["k"], ["o"]).collect()} == {(1, "b"), (2, "c")}
    assert {(w["k"], w["v"]) for w in r.first_wins(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "c")}
    ids = spark.createDataFrame([("10",), ("2",), ("b",), ("3",)], "i string")
    assert [i["i"] for i in ids.orderBy(*r.numeric_first(F.col("i"))).collect()] == ["2", "3", "10", "b"]
    texts = spark.createDataFrame([(1, "one two three four five"), (2, "one two")], "id int, text string")
    needles = spark.createDataFrame([(1, "two three four five"), (2, "two"), (3, "one two three four five six"), (4, "three four fi")], "n int, needle string")
    assert {(p["id"], p["n"]) for p in r.contained(texts, needles, "text", "needle", 3).collect()} == {(1, 1), (1, 2), (2, 2), (1, 4)}


def test_contained_at_any_place(spark):
    texts = ['say "one two three four five six", he said', "(one two three)x", "a<b>one two, three", "word, and sword.", "two  spaces\there", "é日本one", "", None]
    needles = ["one two three four five six", "one two three", "ne two thre", "one two", "one", "word", "ord", "d", "wo  spaces\the", "\t", "日本", "and sword", "one two three four five seven", "", None]
    a = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "id int, text string")
    b = spark.createDataFrame(list(enumerate(needles)), "n int, needle string")
    got = sorted((p["id"], p["n"]) for p in r.contained(a, b, "text", "needle").collect())
    rows = [*enumerate(texts), (3, texts[3])]
    assert got == sorted((i, n) for i, x in rows for n, y in enumerate(needles) if x and y and y in x)


def test_answers_are_made_once_and_do_not_move_to_their_question(spark):
    rows = spark.createDataFrame([("Q1", "5%", "1,000"), ("Q1", " yes", "x"), ("Q1", "1, 2", "3,4")], "question_id string, human string, model string")
    scales = spark.createDataFrame([("Q1", ["yes", "no"], None)], "question_id string, options array<string>, span double")
    df = scoring.encode_pairs(rows, scales)
    assert sorted(map(tuple, df.collect())) == [("Q1", 5.0, 1000.0, None), ("Q1:1", 1.0, 3.0, 100.0), ("Q1:2", 2.0, 4.0, 100.0)]
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    # the rule of a percent sign stands in the plan once for each side
    assert scoring.encode_bids(rows)._jdf.queryExecution().optimizedPlan().toString().count("%$") == 2


def test_plain_numbers_are_as_by_the_rules(spark):
    said = [("5", 5.0), ("-.5%", -0.5), ("1.", 1.0), (" 7 ", 7.0), ("1e3", 1000.0), ("9" * 400, None), ("1e999", None), ("5%%", None), ("5%,", 5.0), ("True", 1.0), ("NO", 0.0), ("", None), ("1d", None), ("٣", None), (None, None), ("+", None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(said)], "i int, x string").select("i", x.parse_number(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [n for _, n in said]
