"""Builders, assembly and simulation: what they refuse, and a job from start to end."""

import json
import re

import pytest
from pyspark.sql import functions as F

from canvass.errors import DataError, EnvironmentFault, TransportError
from canvass.operators import sampling
from canvass.plans import assembly, builders, simulation
from canvass.plans.bundle import Bundle, from_records
from canvass.plans.groups import cases
from canvass.sources import readers

RECORDS = "id string, demographics map<string,string>, persona_text string, questions array<struct<id:string,prompt:string,options:array<string>,kind:string,gold:string>>"


def bundle(spark):
    ask = [("q1", "One?", ["a", "b"], "multiple_choice", "a"), ("q2", "Buy?", ["buy", "skip"], "text", "buy"), ("q3", "How many?", [], "numeric", " ")]
    return from_records(spark.createDataFrame([("p1", {"age": "40", "income": "$60,000"}, "Card one", ask), ("p2", {"age": "30"}, "Card two", ask[:2])], RECORDS), "twin2k_500")


def test_builders_refuse(spark):
    people = spark.createDataFrame([("1",)], "pid string")
    with pytest.raises(DataError, match="columns of persons"):
        builders.refuse_persons(people)
    one = spark.createDataFrame([('"just me"',), (None,)], "human_answer string")
    with pytest.raises(Exception, match="must be a distribution"):
        builders.refuse_persons(one).collect()
    for text, what in (("{}", "must have options"), ('{"a": -1}', "weights")):
        with pytest.raises(Exception, match=what):
            spark.createDataFrame([(text,)], "x string").select(builders.distribution(F.col("x"))).collect()
    with pytest.raises(DataError, match="groups are refused"):
        builders.refuse_expansion("simbench", "group", people)
    nobody = spark.createDataFrame([("p", {}, " ")], "subject_id string, demographics map<string,string>, persona_text string")
    with pytest.raises(Exception, match="no demographics to expand"):
        builders.refuse_expansion("twin2k_500", "individual", nobody).collect()
    bad = spark.createDataFrame([("1", {"local_field": "3"}, None, [])], RECORDS)
    with pytest.raises(Exception, match="outcome column on the persona"):
        builders.lettuce_bundle(bad).subjects.collect()
    shows = spark.createDataFrame([("1", {"income": "about 2.75"}, None, [("local_field", "p", [], "numeric", "2.75")])], RECORDS)
    with pytest.raises(Exception, match="held-out answer into the persona"):
        builders.lettuce_bundle(shows).subjects.collect()
    study = spark.createDataFrame([("1", "a", 'text {"x":1}', '{"x":1}')], "id string, study string, survey_text string, gold_payload string")
    with pytest.raises(Exception, match="holds the answers"):
        builders.study_bundle(study, ["a"]).questions.collect()
    with pytest.raises(Exception, match="unknown study"):
        builders.study_bundle(study, ["b"]).cases.collect()
    with pytest.raises(DataError, match="not 610"):
        builders.lettuce_records(people)
    with pytest.raises(EnvironmentFault, match="run: fetch twin"):
        readers.require_cache(spark, ["/nowhere/x.jsonl"], "fetch twin")


def test_records_keep_pricing_questions_and_full_trees(spark):
    rows = builders.only_questions(spark.createDataFrame([("1", {}, None, [("QID9_1", "p", [], "text", ""), ("Q", "p", [], "text", "")])], RECORDS), "QID9_")
    assert [q["id"] for q in rows.first()["questions"]] == ["QID9_1"]
    trees = spark.createDataFrame([(None, '{"a": 1}'), ("[1]", '"{\\"b\\": 2}"'), ('{"c": 3}', "{}")], "early string, whole string")
    assert [json.loads(r[0]) for r in trees.select(builders.preferred_json(["early", "whole"])).collect()] == [{"a": 1}, {"b": 2}, {"c": 3}]
    assert builders.field_map("d", "f", ["x"], {"x": "X?"}, {"x": ["1"]}, ["y"])["fields"][0]["source_options"] == ["1"]


def test_waves_are_strict(spark):
    def tree(*qs):
        return json.dumps([{"QuestionID": i, "QuestionText": t, "Answers": a} for i, t, a in qs])

    good = ("QID9_1", "Buy?", {"SelectedText": "Yes", "SelectedByPosition": 1})
    for qs, what in (((good, good), "repeats"), ((), "not the expected"), ((("QID9_1", "Buy?", {"SelectedText": " Yes", "SelectedByPosition": 1}),), "padded"), ((("QID9_1", " ", good[2]),), "no text of"), ((("QID9_1", "B", {"SelectedText": "Yes", "SelectedByPosition": True}),), "whole place"), ((("QID9_1", "B", []),), "no Answers")):
        with pytest.raises(Exception, match=what):
            assembly.wave_items(spark.createDataFrame([("7", tree(*qs))], "pid string, tree string"), "tree", ["QID9_1"]).collect()
    assert assembly.wave_items(spark.createDataFrame([(7, tree(good))], "pid long, tree string"), "tree", ["QID9_1"]).first()["items"][0]["answer"] == "Yes"


def test_catalog_refuses(spark):
    kind = "QuestionID string, BlockName string, QuestionText string, Options array<string>, csv_columns array<string>"
    for rows, what in (([("a", "D", "A?", ["x"], ["c", "c"])], "repeats columns"), ([("a", "D", " ", ["x"], [])], "without text"), ([("", "D", "A?", ["x"], [])], "without a QuestionID"), ([("b", "D", "A?", ["x"], [])], "lacks stems"), ([("a", "D", "A?", ["x"], []), ("a", "D", "A?", ["x"], [])], "repeats stems")):
        with pytest.raises(DataError, match=what):
            assembly.read_catalog(spark.createDataFrame(rows, kind), ["a"])
    _, columns, unmapped = assembly.read_catalog(spark.createDataFrame([("a", "Demographics", "A?", ["x"], ["c"]), ("b", "Demographics", "B?", [], ["d"])], kind), ["a"])
    assert [r[0] for r in columns.collect()] == ["c", "d"] and [r[0] for r in unmapped.collect()] == ["b"]


def people(spark, answer="never_said"):
    rows = spark.createDataFrame([(str(i), "mf"[i % 2], str(20 + i)) for i in range(40)], "pid string, sex string, age string")
    item = "question_id string, answer string, question_text string, source_column string, stimulus map<string,string>"
    kind = "pid string, items array<struct<" + item.replace(" string", ":string").replace(" map", ":map") + ">>"
    return rows, spark.createDataFrame([(str(i), [("q", answer, "following product in that category: Fine Soap. The product is priced at: $4.50", "w", None)]) for i in range(40)], kind)


def test_assembly_checks_and_writes(spark, tmp_path):
    rows, outcomes = people(spark)
    make = lambda o=outcomes, r=rows, **k: assembly.assemble(r, o, **({"dataset": "d", "source": "f", "columns": ["sex", "age"], "strata": ["sex"], "outcome_ids": ["q"], "seed": 1, "ages": ["age"]} | k))
    made = assembly.twice(make)
    assert made.plan["population"] == 40 and made.sample.count() == made.plan["sample_size"] == 29
    assert {r["value"] for r in made.report.filter("field = 'age'").collect()} == {"20-29", "30-39", "40-49", "50-59"}
    assembly.write(made, str(tmp_path / "out"))
    assert [json.loads(x)["subject_id"] for x in sorted_lines(tmp_path / "out" / "cards")][:3] == ["0", "1", "2"]
    with pytest.raises(DataError, match="show an outcome"):
        make(people(spark, "age: 21")[1])
    with pytest.raises(DataError, match="unknown columns"):
        make(allowed=["pid", "sex"])
    with pytest.raises(DataError, match="blocked columns"):
        make(forbidden=["age"])
    with pytest.raises(DataError, match="repeated keys"):
        make(r=rows.union(rows.limit(1)))
    wrong = made.cards.withColumn("basic_info", F.transform("basic_info", lambda f: f.withField("value", F.lit("x"))))
    assert assembly.values_differ(wrong, rows, ["sex", "age"]).count() == 80
    assert assembly.values_differ(made.cards, rows.withColumn("more", F.lit("1")), ["sex", "age", "more"]).count() == 40


def sorted_lines(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def reply(system, user):
    ids = re.findall(r"(?m)^question_id: (\w+)$", user)
    return json.dumps({"answers": [{"question_id": q, "answer": "7", "buy_prob": 5, "probs": {"a": 0, "b": 3}} for q in ids]})


def test_outer_draws_of_a_run(spark):
    b = bundle(spark)
    asked = simulation.packages(b, "atus_expanded_skill", 3, under="Be quick.")
    assert all("## Life history" in r["persona"] and r["persona"].endswith("\n\nBe quick.") and "【" in r["persona"] for r in asked.collect())

    def told(system, user):
        assert system == "You fill in a survey."
        return reply(system, user)

    run = simulation.simulate(asked, told, model="m", outer=True, seed=5, system="You fill in a survey.")
    got = {(r["subject_id"], r["question_id"]): (r["answer"], r["error"]) for r in run.results.collect()}
    assert got["p1", "q1"] == ("b", None) and got["p1", "q3"] == ("7", None) and {got[p, "q2"][0] for p in ("p1", "p2")} <= {"buy", "skip"}
    rng = sampling.first_uniform("5:p1:buy:q2")
    assert got["p1", "q2"][0] == ("buy" if rng.random() < 0.85 else "skip")
    bad = simulation.simulate(simulation.packages(b, "fixed_text"), lambda s, u: json.dumps({"answers": [{"question_id": "q1", "answer": "a"}, {"question_id": "q2", "buy_prob": "x"}]}), model="m", outer=True)
    errors = {(r["subject_id"], r["question_id"]): r["error"] for r in bad.results.collect()}
    assert errors["p1", "q1"] == "q1 probs must match its options" and errors["p1", "q2"] == "q2 buy_prob is not a number" and errors["p1", "q3"] == "missing question_id q3"
    with pytest.raises(DataError, match="unknown method"):
        simulation.packages(b, "crystal_ball")


def test_a_job_fails_then_resumes_then_is_complete(spark, tmp_path):
    b, path = bundle(spark), str(tmp_path / "job")

    def flaky(system, user):
        if "Card two" in user:
            raise TransportError("down")
        return reply(system, user)

    from canvass.plans import batching

    pause, batching.PAUSE = batching.PAUSE, 0.0
    try:
        assert simulation.run_job(b, flaky, name="fixed_text", model="m", path=path) == "batch_errors"
    finally:
        batching.PAUSE = pause
    assert not simulation.is_complete(spark, path) and simulation.read_replies(spark, f"{path}/cache").count() == 1

    def only_two(system, user):
        assert "Card two" in user  # the other is in the cache
        return reply(system, user)

    assert simulation.run_job(b, only_two, name="fixed_text", model="m", path=path) == "responses"
    rows = [json.loads(x) for x in sorted_lines(tmp_path / "job" / "responses")]
    assert [(r["subject_id"], r["question_id"], r["cached"]) for r in rows] == [("p1", "q1", True), ("p1", "q2", True), ("p1", "q3", True), ("p2", "q1", False), ("p2", "q2", False)]
    assert json.loads((tmp_path / "job" / "manifest.json").read_text())["model"] == "m"
    assert simulation.run_job(b, flaky, name="fixed_text", model="m", path=path) == "complete"


def test_progress_and_samples(spark):
    b = bundle(spark)
    run = simulation.simulate(simulation.packages(b, "fixed_text"), reply, model="m", size=2)
    assert simulation.progress(run, 5, 6.0) == {"done": 3, "cached": 0, "failed": 0, "left": 2, "eta_seconds": 4.0}
    seats = spark.createDataFrame([("$60,000", 1), ("unknown", 0)], "stratum string, seats int")
    some = simulation.income_sample(b, builders.income_stratum(F.col("demographics")), seats, 1)
    assert [r["subject_id"] for r in some.subjects.collect()] == ["p1"]
    chosen = spark.createDataFrame([("p2",)], "subject_id string")
    whole = lambda x, seed: Bundle(x.subjects, x.questions, x.cases, x.gold)
    assert simulation.topped_up(b, chosen, 1, whole, 1).subjects.count() == 1 and simulation.topped_up(b, chosen, 2, whole, 1).subjects.count() == 2
    records = spark.createDataFrame([(i, float(i > 5), "x" * i) for i in range(10)], "id int, w double, body string")
    assert {r["id"] for r in readers.sampled_records(records, "id", F.col("w"), 4, 2).collect()} == {6, 7, 8, 9}


def test_demographics_that_a_card_reads(spark):
    raw = {"QID14": "College graduate", "QID24": "Part-time employment", "income": "$100,000 or more", "local_field": "3", "age": "4 ", "sex": " "}
    rows = spark.createDataFrame([("p", raw), ("q", {"age": "5"})], "id string, d map<string,string>").select("id", builders.adapted(F.col("d")).alias("d"))
    got = {r["id"]: r["d"] for r in rows.collect()}
    assert got["p"]["education_bucket"] == "bachelor_or_higher" and got["p"]["income_over_50k"] == "true" and "local_field" not in got["p"] and got["p"]["age"] == "4" and "sex" not in got["p"]
    assert got["q"] == {"age": "5"}
    assert spark.createDataFrame([({"a": "1.5", "b": "x"},)], "m map<string,string>").select(builders.float_map(F.col("m"))).first()[0] == {"a": 1.5}


def test_pricing_questions_and_samples(spark):
    ask = [("QID9_1", "p", [], "text", ""), ("QID9_2", "p", [], "text", ""), ("QID1", "p", [], "text", "")]
    b = from_records(spark.createDataFrame([("1", {}, "x", ask), ("2", {}, "x", ask[1:])], RECORDS), "twin2k_500")
    with pytest.raises(DataError, match="without 2 pricing"):
        builders.pricing_bundle(b, "twin2k_500", 2)
    one = Bundle(b.subjects.filter("subject_id = '1'"), b.questions, b.cases.filter("subject_id = '1'"), b.gold)
    assert builders.pricing_bundle(one, "twin2k_500", 2).cases.count() == 2
    with pytest.raises(DataError, match="no pricing study"):
        builders.pricing("simbench", F.col("x"))
    from canvass.plans.report import in_sample

    ids = spark.createDataFrame([("1",)], "subject_id string")
    assert {r["subject_id"]: r["sampled"] for r in in_sample(b.subjects, ids, "subject_id").collect()} == {"1": True, "2": False}
    for bad, what in ((ids.union(ids), "repeated"), (spark.createDataFrame([("9",)], "subject_id string"), "population lacks")):
        with pytest.raises(DataError, match=what):
            in_sample(b.subjects, bad, "subject_id")


def test_export_of_texts(spark, tmp_path):
    from canvass.sources.writers import export_texts

    df = spark.createDataFrame([("a", "xy"), ("b", "xyzz"), ("c", "xy")], "subject_id string, text string")
    assert export_texts(df, "subject_id", "text", str(tmp_path / "cards")) == {"least": 2, "most": 4, "mean": 8 / 3, "texts": 2}
    assert [json.loads(x)["subject_id"] for x in sorted_lines(tmp_path / "cards")] == ["a", "b", "c"]
    with pytest.raises(DataError, match="no rows"):
        spark.createDataFrame([], "line long").write.parquet(str(tmp_path / "none"))
        readers.read_splits(spark, {"none": str(tmp_path / "none")})


def test_lock_of_outputs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    (tmp_path / "y").write_text("2")
    facts = readers.file_facts(spark, str(tmp_path)).cache()
    assert {r["name"] for r in facts.collect()} == {"a/x", "y"}
    assert readers.verified(facts, facts) == "verified" and readers.verified(facts.filter("false"), facts) == "skipped_absent"
    assert readers.verified(facts.filter("name = 'y'"), facts, ["a/x"]) == "partial"
    for here, there, what in ((facts, facts.filter("name = 'y'"), "is extra"), (facts.filter("name = 'y'"), facts, "is missing"), (facts.withColumn("bytes", F.lit(9)), facts, "is changed")):
        with pytest.raises(DataError, match=what):
            readers.verified(here, there)


def test_case_ids_go_past_five_digits(spark):
    rows = spark.range(100_002).select(F.lit("s").alias("split"), F.lit("d").alias("dataset_name"), F.lit("q").alias("input_template"), F.col("id").alias("ord"), F.create_map(F.lit("a"), F.lit("b")).alias("variables"))
    got = cases(rows).agg(F.countDistinct("case_id"), F.min("case_id"), F.max(F.struct("ord", "case_id")).alias("m")).first()
    assert got[0] == 100_002 and got[1] == "s:d:00000" and got["m"]["case_id"] == "s:d:100001"


def test_life_cards_name_the_first_of_equal_activities(spark):
    from canvass.plans.cards import life_cards

    people_ = spark.createDataFrame([("p", {"age": "4"})], "subject_id string, demographics map<string,string>").withColumn("routine", F.create_map(F.lit("work"), F.lit(60.0), F.lit("eating"), F.lit(60.0)))
    assert "Time-use note: work averages" in life_cards(people_).first()["text"]


@pytest.mark.parametrize("name", ["survey_tree", "wave_items", "lettuce_subjects", "lettuce_cases", "shopper_questions", "study_cases", "life_cards"])
def test_narrow_rows_are_dealt_before_they_grow(spark, name):
    from canvass import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_twin_sources_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from canvass.queries import surveys
    from canvass.queries.base import Tables

    monkeypatch.setattr(surveys, "scratch", lambda t, name: str(tmp_path / name))
    surveys.twin_files(Tables(spark, "/root/testdata/sf0.001"))
    assert {len(list((tmp_path / "twin" / x).glob("part-*"))) for x in ("earlier", "later", "wave0", "wave1")} == {spark.sparkContext.defaultParallelism}


def test_questions_are_kept_once_without_a_sort(spark):
    rows = spark.createDataFrame([("d", "q", i % 2, f"Prompt {i % 2}", ["a"], "text") for i in range(9)], "dataset string, question_id string, ord int, prompt string, options array<string>, kind string")
    from canvass.plans.bundle import versioned

    cases, questions = versioned(rows)
    assert questions.count() == 2 and cases.count() == 9
    assert "Sort" not in questions._jdf.queryExecution().executedPlan().toString()


def test_golds_join_in_parts_that_are_not_merged(spark):
    rows = spark.createDataFrame([("p", "q", "text")], "subject_id string, question_id string, prompt string")
    joined = simulation.with_gold(rows, spark.createDataFrame([("d", "p", "q", "a")], "dataset string, subject_id string, question_id string, answer string"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(subject_id" in plan
    assert [(r["subject_id"], r["question_id"], r["prompt"], r["answer"]) for r in joined.collect()] == [("p", "q", "text", "a")]
