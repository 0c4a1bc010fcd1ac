"""Whole surveys on the test tables: builders, assembly, simulation, scorers, sources and sinks."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.errors import TransportError
from canvass.functions import trees
from canvass.functions.jsonx import decoded
from canvass.plans import assembly, batching, builders, fetching, jobs, loaders, report, scoring, simulation
from canvass.plans.bundle import Bundle, from_records
from canvass.queries.base import Registry, Tables
from canvass.session import shared_dir
from canvass.sources import publish, readers, replies, writers

R = Registry()


def scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/canvass/{name}-{uuid.uuid4().hex[:12]}"


# assembly


PEOPLE = """p AS (SELECT CAST(c_custkey AS VARCHAR) AS pid, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, c_custkey % 5 AS r FROM customer),
e AS (SELECT * FROM p WHERE r NOT IN (1, 2, 3))"""


def people(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers as text rows, and two outcomes for those of them that do not lack some."""
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("pid"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    r = F.col("pid").cast("long") % 5
    none = F.lit(None).cast("map<string,string>")
    item = lambda q, answer: F.struct(F.lit(q).alias("question_id"), answer.alias("answer"), F.lit("How much?").alias("question_text"), F.lit("wave_4").alias("source_column"), none.alias("stimulus"))
    a, b = item("q_a", F.concat(F.lit("bid_"), "pid")), item("q_b", F.when(r == 3, " ").otherwise("yes_bid"))
    outcomes = rows.filter(r != 1).select("pid", F.when(r == 2, F.array(b, a)).otherwise(F.array(a, b)).alias("items"))
    return rows, outcomes


def assembled(t: Tables) -> assembly.Assembled:
    rows, outcomes = people(t)
    return assembly.assemble(rows, outcomes, dataset="demo", source="customer.csv", columns=["segment", "nation"], strata=["segment"], outcome_ids=["q_a", "q_b"], seed=42, allowed=["pid", "segment", "nation"])


@R.add(f"""WITH {PEOPLE} SELECT pid AS subject_id, CASE r WHEN 1 THEN 'missing pricing outcomes' WHEN 2 THEN 'pricing outcome ids are not the expected set in order' ELSE 'pricing outcome q_b is blank' END AS reason
FROM p WHERE r IN (1, 2, 3)""")
def assembled_exclusions(t: Tables):
    return assembled(t).exclusions


@R.add(f"""WITH {PEOPLE}, s AS (SELECT count(*) AS pop FROM e), n AS (SELECT CAST(least(pop, ceil(97.0 * pop / (pop + 96))) AS BIGINT) AS n, pop FROM s),
c AS (SELECT segment, count(*) AS k FROM e GROUP BY ALL), b AS (SELECT segment, k, n.n * k // pop AS base, n.n * k % pop AS over, n.n AS n FROM c, n), l AS (SELECT max(n) - sum(base) AS rest FROM b),
seats AS (SELECT segment, base + (row_number() OVER (ORDER BY over DESC, segment) <= rest)::INT AS seats FROM b, l),
k AS (SELECT pid, segment, row_number() OVER (PARTITION BY segment ORDER BY sha256('42' || chr(10) || 'demo' || chr(10) || segment || chr(10) || pid), pid) AS rk FROM e)
SELECT pid AS subject_id, sha256('42' || chr(10) || 'demo' || chr(10) || 'selected' || chr(10) || pid) AS draw_order FROM k JOIN seats USING (segment) WHERE rk <= seats""")
def assembled_sample(t: Tables):
    return assembled(t).sample


@R.add(f"""WITH {PEOPLE} SELECT pid AS subject_id, '## Identity' || chr(10) || 'dataset: demo' || chr(10) || 'subject_id: ' || pid || chr(10) || 'source_file: customer.csv' || chr(10) || 'source_id_column: pid' || chr(10) || chr(10)
|| '## Basics' || chr(10) || 'segment: ' || segment || chr(10) || 'nation: ' || nation || chr(10) AS text FROM e""")
def assembled_cards(t: Tables):
    return assembled(t).cards.select("subject_id", "text")


@R.add("""WITH c AS (SELECT * FROM (SELECT c_mktsegment AS level, count(*) AS population, 'segment' AS field FROM customer GROUP BY ALL UNION ALL SELECT CAST(c_custkey % 4 AS VARCHAR), count(*), 'part' FROM customer GROUP BY ALL)),
t AS (SELECT count(*) AS total FROM customer), b AS (SELECT field, level, population, total, 84 * population // total AS base, 84 * population % total AS over FROM c, t),
l AS (SELECT field, 84 - sum(base) AS rest FROM b GROUP BY ALL), s AS (SELECT field, level, population, total, base + (row_number() OVER (PARTITION BY field ORDER BY over DESC, level) <= rest)::INT AS sample FROM b JOIN l USING (field))
SELECT field, level, population, CAST(sample AS BIGINT) AS sample, round(84.0 * population / total, 6) AS quota, round(abs(sample - 84.0 * population / total), 6) AS gap FROM s""")
def margin_balance(t: Tables):
    """Both margins of a joint allocation."""
    rows = t.customer.select(F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 4).cast("string").alias("part"))
    out = assembly.margin_balance(assembly.seats_of(rows, ["segment", "part"], 84), ["segment", "part"], 84)
    return out.withColumns({"quota": F.round("quota", 6), "gap": F.round("gap", 6)})


@R.add("SELECT 's' || CAST(s_suppkey AS VARCHAR) AS question_id, s_name AS stem, ['yes', CAST(s_nationkey AS VARCHAR)] AS options FROM supplier WHERE s_suppkey < 5")
def catalog_stems(t: Tables):
    sk = F.col("s_suppkey").cast("string")
    entries = t.supplier.select(F.concat(F.lit("s"), sk).alias("QuestionID"), F.lit("Demographics").alias("BlockName"), F.col("s_name").alias("QuestionText"), F.array(F.lit("yes"), F.col("s_nationkey").cast("string")).alias("Options"), F.array(F.concat(F.lit("c"), sk)).alias("csv_columns"))
    return assembly.read_catalog(entries, [f"s{i}" for i in range(5)])[0]


@R.add("""SELECT CAST(c_custkey AS VARCHAR) AS pid, 'QID9_' || i AS question_id, c_mktsegment AS answer, CAST(c_nationkey + i AS BIGINT) AS answer_position, 'Buy ' || i || '?' AS question_text FROM customer, (VALUES (1), (2), (3)) AS x(i)""")
def wave_items(t: Tables):
    q = lambda i: F.struct(F.lit(f"QID9_{i}").alias("QuestionID"), F.lit(f"Buy {i}?").alias("QuestionText"), F.struct(F.col("c_mktsegment").alias("SelectedText"), (F.col("c_nationkey") + i).alias("SelectedByPosition")).alias("Answers"))
    tree = F.struct(F.array(F.struct(F.lit("Block").alias("ElementType"), F.array(q(2), q(1)).alias("Questions"))).alias("Elements"), F.struct(q(3).alias("inner")).alias("more"))
    rows = t.spread("customer", "c_custkey", "c_mktsegment", "c_nationkey").select(F.col("c_custkey").alias("pid"), F.to_json(tree).alias("tree"))
    out = assembly.wave_items(rows, "tree", ["QID9_1", "QID9_2", "QID9_3"])
    return out.select("pid", F.explode("items").alias("i")).select("pid", "i.question_id", "i.answer", "i.answer_position", "i.question_text")


@R.add("SELECT count(*) FILTER (c_custkey % 3 <> 0) * 2 AS equal, count(*) FILTER (c_custkey % 3 = 0) * 2 AS differ FROM customer")
def paired_waves(t: Tables):
    c = F.col("c_mktsegment")
    later = t.customer.select(F.col("c_custkey").cast("string").alias("pid"), c.alias("a"), c.alias("b"))
    earlier = t.customer.select(F.col("c_custkey").cast("string").alias("pid"), *(F.when(F.col("c_custkey") % 3 == 0, "none").otherwise(F.concat(c, F.lit(" "))).alias(x) for x in "ab"))
    items = later.select("pid", F.array(*(F.struct(F.lit(x).alias("question_id"), F.col(x).alias("answer")) for x in "ab")).alias("items"))
    return assembly.paired_waves(earlier, later, items, ["a", "b"])


# loaders


TWIN_IDS = ("QID9_1", "QID9_2", "QID9_3")


def twin_files(t: Tables) -> loaders.Loaded:
    """The sources of a twin survey written from the customers, and loaded again: two waves, a catalog and trees in two files."""
    base, k = scratch(t, "twin"), F.col("c_custkey")
    customer = t.spread("customer", "c_custkey", "c_mktsegment", "c_nationkey")
    pid = k.cast("string").alias("pid")
    cells = [F.col("c_mktsegment").alias("segment"), F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")).alias("nation")]
    writers.write_csv(customer.select(pid, *cells, *(F.when(k % 3 == 0, "none").otherwise(F.col("c_mktsegment")).alias(q) for q in TWIN_IDS)), f"{base}/earlier")
    writers.write_csv(customer.select(pid, *(F.col("c_mktsegment").alias(q) for q in TWIN_IDS)), f"{base}/later")
    q = lambda i: F.struct(F.lit(f"QID9_{i}").alias("QuestionID"), F.lit(f"Buy {i}?").alias("QuestionText"), F.struct(F.col("c_mktsegment").alias("SelectedText"), F.lit(i).alias("SelectedByPosition")).alias("Answers"))
    tree = F.to_json(F.struct(F.array(F.struct(F.lit("Block").alias("ElementType"), F.array(q(3), q(1), q(2)).alias("Questions"))).alias("Elements")))
    for rest in (0, 1):
        customer.filter(k % 2 == rest).select(pid, tree.alias("tree")).write.parquet(f"{base}/wave{rest}")
    segments = [r[0] for r in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    nations = [str(r[0]) for r in t.customer.select("c_nationkey").distinct().orderBy("c_nationkey").collect()]
    entry = lambda c, stem, options: {"QuestionID": c, "BlockName": "Demographics", "QuestionText": stem, "Options": options, "csv_columns": [c]}
    publish.write_text(t.spark, f"{base}/catalog.json", json.dumps([entry("segment", "Which segment?", segments), entry("nation", "Which nation?", nations)]))
    return loaders.load_twin(t.spark, earlier=f"{base}/earlier", later=f"{base}/later", catalog=f"{base}/catalog.json", waves=[f"{base}/wave0", f"{base}/wave1"], payload="tree", basic=["segment", "nation"], ids=TWIN_IDS, persons=t.customer.count(), files=2)


@R.add("SELECT count(*) AS rows_earlier, count(*) AS rows_later, count(*) AS rows_trees, 3 * count(*) FILTER (c_custkey % 3 > 0) AS cells_equal, 3 * count(*) FILTER (c_custkey % 3 = 0) AS cells_differ FROM customer")
def twin_audit(t: Tables):
    """Counts taken while the sources were read and joined."""
    audit = twin_files(t).audit
    return t.spark.createDataFrame([tuple(audit.values())], ", ".join(f"{k} long" for k in audit))


@R.add("""WITH n AS (SELECT c_mktsegment AS segment, count(*) AS k FROM customer GROUP BY ALL), t AS (SELECT sum(k) AS pop FROM n), b AS (SELECT segment, k, 60 * k // pop AS base, 60 * k % pop AS over FROM n, t), l AS (SELECT 60 - sum(base) AS rest FROM b),
seats AS (SELECT segment, base + (row_number() OVER (ORDER BY over DESC, segment) <= rest)::INT AS seats FROM b, l),
k AS (SELECT c_custkey, c_mktsegment AS segment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42' || chr(10) || 'twin2k_500' || chr(10) || c_mktsegment || chr(10) || CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR)) AS rk FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS subject_id, 'Which nation?' AS stem, CAST(c_nationkey AS VARCHAR) AS nation, segment AS bought FROM k JOIN seats USING (segment) WHERE rk <= seats""")
def twin_build(t: Tables):
    """The persons drawn for the data set of the twin survey, with a field of their card and an outcome."""
    made = loaders.build_twin(twin_files(t), basic=["segment", "nation"], ids=TWIN_IDS, strata=["segment"], seed=42, source="earlier.csv", size=60)
    field = F.get(F.filter("basic_info", lambda f: f["source_column"] == "nation"), F.lit(0))
    cards = made.cards.select("subject_id", field["source_question_text"].alias("stem"), field["value"].alias("nation"))
    outcomes = made.outcomes.select("subject_id", F.get("items", F.lit(2))["answer"].alias("bought"))
    return made.sample.select("subject_id").join(cards, "subject_id").join(outcomes, "subject_id")


@R.add("""SELECT CAST(s_suppkey AS VARCHAR) AS subject_id, question_id, CASE WHEN question_id = 'conclusion_purchased_product' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END ELSE printf('%d.%02d', s_suppkey % 10, s_suppkey % 89) END AS answer,
CASE WHEN question_id = 'conclusion_purchased_product' THEN s_name END AS product FROM supplier, (VALUES ('local_field'), ('local_greenhouse'), ('local_vertical'), ('nonlocal_field'), ('nonlocal_greenhouse'), ('nonlocal_vertical'), ('conclusion_purchased_product')) AS v(question_id)""")
def lettuce_build(t: Tables):
    """Outcomes of the data set of the lettuce survey, the purchase with the product drawn."""
    path, k = scratch(t, "lettuce"), F.col("s_suppkey")
    bid = F.format_string("%d.%02d", k % 10, k % 89)
    rows = t.supplier.select(k.cast("string").alias("pid"), (k % 60).cast("string").alias("survey_q01_age"), F.col("s_nationkey").cast("string").alias("survey_q15_income"), *(bid.alias(c) for c in builders.PRODUCTS), F.when(k % 2 == 0, "TRUE").otherwise("FALSE").alias(builders.PURCHASE), F.col("s_name").alias(builders.DRAWN_PRODUCT), F.lit("2.50").alias(builders.DRAWN_PRICE))
    writers.write_csv(rows, path)
    loaded = loaders.load_lettuce(t.spark, table=path, persons=t.supplier.count())
    made = loaders.build_lettuce(loaded, columns=["survey_q01_age", "survey_q15_income"], strata=["survey_q15_income"], seed=42, source="lettuce.csv", size=5)
    return made.outcomes.select("subject_id", F.explode("items").alias("i")).select("subject_id", "i.question_id", "i.answer", F.element_at("i.stimulus", builders.DRAWN_PRODUCT).alias("product"))


# builders


@R.add("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 > 0 THEN CAST(18 + c_custkey % 60 AS VARCHAR) END AS age, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS income FROM customer)
SELECT id AS subject_id, CASE WHEN age IS NOT NULL OR income IS NOT NULL THEN 'Structured shopper profile from the Canadian BDM lettuce survey (Gibson and Li). These are demographics and consumer habits, not a long narrative persona.'
|| chr(10) || coalesce(chr(10) || 'Age: ' || age, '') || coalesce(chr(10) || 'Household income: ' || income, '') END AS persona_text, map_keys AS keys FROM (SELECT *, list_filter(['age', 'income'], lambda k: CASE k WHEN 'age' THEN age ELSE income END IS NOT NULL) AS map_keys FROM s)""")
def lettuce_subjects(t: Tables):
    return lettuce(t).subjects.select("subject_id", "persona_text", F.array_sort(F.map_keys("demographics")).alias("keys"))


def lettuce(t: Tables) -> Bundle:
    k = F.col("c_custkey")
    cells = {"survey_q01_age": F.when(k % 3 > 0, (18 + k % 60).cast("string")), "survey_q15_income": F.when(k % 2 == 0, F.col("c_mktsegment"))}
    bids = {c: F.when(k % 7 != i, F.format_string("%d.%02d", k % 10, k % 89)) for i, c in enumerate(builders.PRODUCTS)}
    drawn = {builders.PURCHASE: F.when(k % 2 == 0, "TRUE").otherwise("FALSE"), builders.DRAWN_PRODUCT: F.lit("kale"), builders.DRAWN_PRICE: F.lit(" ")}
    rows = t.spread("customer", "c_custkey", "c_mktsegment").select(k.cast("string").alias("pid"), *(c.alias(n) for n, c in (cells | bids | drawn).items()))
    return builders.lettuce_bundle(builders.lettuce_records(rows, expected=t.customer.count()))


@R.add("""WITH q AS (SELECT * FROM (VALUES (0, 'local_field', 'local field-grown lettuce'), (1, 'local_greenhouse', 'local greenhouse-grown lettuce'), (2, 'local_vertical', 'local vertically farmed lettuce'), (3, 'nonlocal_field', 'non-local field-grown lettuce'),
(4, 'nonlocal_greenhouse', 'non-local greenhouse-grown lettuce'), (5, 'nonlocal_vertical', 'non-local vertically farmed lettuce'), (6, 'conclusion_purchased_product', NULL)) AS v(i, question_id, product)),
c AS (SELECT c_custkey AS k, i, question_id, CASE WHEN i < 6 THEN 'You are taking part in a Becker-DeGroot-Marschak elicitation in Ontario, Canada. What is the most you would pay, in Canadian dollars from 0 to 10, for ' || product || '?'
ELSE 'Under the same Becker-DeGroot-Marschak rule, one product was drawn at random (kale) and a price was drawn at random (the randomly drawn price Canadian dollars). Would you purchase that product at the drawn price? Answer TRUE or FALSE.' END AS prompt FROM customer, q)
SELECT CAST(k AS VARCHAR) AS subject_id, question_id, CAST(i AS INT) AS pos, prompt, CASE WHEN i = 6 THEN CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END WHEN k % 7 <> i THEN printf('%d.%02d', k % 10, k % 89) END AS answer FROM c""")
def lettuce_cases(t: Tables):
    b = lettuce(t)
    return simulation.with_gold(b.asked(), b.gold).select("subject_id", "question_id", "pos", "prompt", "answer")


@R.add("""SELECT CAST(c_custkey AS VARCHAR) AS subject_id, 'Under the same Becker-DeGroot-Marschak rule, one product was drawn at random (' || CASE WHEN c_custkey % 3 = 0 THEN 'the randomly selected lettuce' ELSE c_mktsegment END || ') and a price was drawn at random ('
|| printf('%d.%02d', c_custkey % 7, c_custkey % 100) || ' Canadian dollars). Would you purchase that product at the drawn price? Answer TRUE or FALSE.' AS prompt FROM customer""")
def shopper_questions(t: Tables):
    """Each shopper is asked about the product and the price drawn for them."""
    k = F.col("c_custkey")
    drawn = {builders.PURCHASE: F.lit("TRUE"), builders.DRAWN_PRODUCT: F.when(k % 3 > 0, F.col("c_mktsegment")), builders.DRAWN_PRICE: F.format_string("%d.%02d", k % 7, k % 100)}
    rows = t.spread("customer", "c_custkey", "c_mktsegment").select(k.cast("string").alias("pid"), F.lit("30").alias("survey_q01_age"), *(F.lit("").alias(c) for c in builders.PRODUCTS), *(c.alias(n) for n, c in drawn.items()))
    b = builders.lettuce_bundle(builders.lettuce_records(rows, expected=None))
    return simulation.packages(b, "fixed_text").filter(F.col("question_id") == builders.PURCHASE).select("subject_id", "prompt")


@R.add("""SELECT CAST(s_suppkey AS VARCHAR) AS question_id, 'd:nation=' || s_nationkey AS subject_id, 'Of ' || s_name || '?' AS prompt, CASE WHEN s_suppkey % 2 = 0 THEN ['A', 'B'] ELSE ['C', 'D', 'E'] END AS options FROM supplier
UNION ALL SELECT 'all', 'd:nation=' || n_nationkey, 'In ' || n_name || '?', [n_name, 'none'] FROM nation""")
def group_questions(t: Tables):
    """A question that every group is asked in its own words and with its own options, and questions of one group."""

    def rows(df: DataFrame, nation: str, answer, task, prompt, index) -> DataFrame:
        variables = F.to_json(F.struct(F.col(nation).cast("string").alias("nation")))
        named = {"dataset_name": F.lit("d"), "group_prompt_template": F.lit("People of {nation}"), "group_prompt_variable_map": variables, "human_answer": answer, "auxiliary": F.to_json(F.struct(task.cast("string").alias("task_id"))), "input_template": prompt, "group_size": F.lit(5), "index": index}
        return df.select(*(c.alias(n) for n, c in named.items()))

    one = rows(t.supplier, "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, '{"A": 1, "B": 2}').otherwise('{"C": 1, "D": 0, "E": 2}'), F.col("s_suppkey"), F.concat(F.lit("Of "), "s_name", F.lit("?")), F.col("s_suppkey").cast("long"))
    every = rows(t.nation, "n_nationkey", F.concat(F.lit('{"'), "n_name", F.lit('": 0.5, "none": 0.5}')), F.lit("all"), F.concat(F.lit("In "), "n_name", F.lit("?")), F.lit(1 << 40) + F.col("n_nationkey"))
    b = builders.group_bundle(builders.group_records(one.unionByName(every), "Pop"))
    return simulation.packages(b, "group").select("question_id", "subject_id", "prompt", "options")


@R.add("""SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(b AS INT) AS block, CAST(pos AS INT) AS pos, id, CASE id WHEN 'Q1' THEN 'Pick' || chr(10) || 'Options:' || chr(10) || '- ' || c_mktsegment || chr(10) || '- none' WHEN 'free' THEN 'Why?' ELSE 'Rate' || chr(10) || CASE id WHEN 'M:1' THEN 'this' ELSE 'that' END || chr(10) || 'Options:' || chr(10) || '- lo' || chr(10) || '- hi' END AS prompt,
kind, CASE id WHEN 'Q1' THEN c_mktsegment WHEN 'M:1' THEN 'lo' WHEN 'M:3' THEN CASE WHEN c_custkey % 2 = 0 THEN 'hi' ELSE 'lo' END ELSE CAST(c_nationkey AS VARCHAR) || '; more' END AS gold
FROM customer, (VALUES (0, 0, 'Q1', 'multiple_choice'), (0, 1, 'M:1', 'likert'), (0, 2, 'M:3', 'likert'), (1, 3, 'free', 'text')) AS v(b, pos, id, kind)""")
def survey_tree(t: Tables):
    """The questions of a tree with a branch, a matrix, a hidden question and a group that is no block."""
    k = F.col("c_custkey")
    head = F.format_string('{"Elements":[{"ElementType":"Branch","Elements":[{"ElementType":"Block","Questions":[{"QuestionType":"MC","QuestionID":"Q1","QuestionText":"<b>Pick</b>","Options":["%s","none"],"Answers":{"SelectedText":"%s"}},', "c_mktsegment", "c_mktsegment")
    matrix = F.format_string('{"QuestionType":"DB","QuestionID":"D"},{"QuestionType":"Matrix","QuestionID":"M","QuestionText":"Rate","Columns":["lo","hi"],"Rows":["this"," ","that"],"Answers":{"SelectedText":["lo","lo","%s"]}}]}]},', F.when(k % 2 == 0, "hi").otherwise("lo"))
    tail = F.format_string('{"ElementType":"Group","Elements":[{"ElementType":"Block","Questions":[{"QuestionID":"hidden","QuestionText":"?"}]}]},{"ElementType":"Block","Questions":[{"QuestionID":"free","QuestionText":"Why?","QuestionType":"TE","Answers":{"Text":[{"x":"%d"},"more"]}}]}]}', "c_nationkey")
    found = trees.survey_questions(t.spread("customer", "c_custkey", "c_mktsegment", "c_nationkey").select(k.cast("string").alias("pid"), F.concat(head, matrix, tail).alias("tree")), "tree")
    return found.select("pid", F.explode("questions").alias("q")).select("pid", "q.block", "q.pos", "q.id", "q.prompt", "q.kind", "q.gold")


@R.add("""SELECT CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END || ':' || CAST(o_orderkey AS VARCHAR) AS question_id, CAST(o_orderkey AS VARCHAR) AS subject_id, 'Survey ' || o_orderpriority AS prompt,
CASE WHEN o_orderkey % 3 > 0 THEN '{"x":' || o_custkey || '}' END AS payload FROM orders""")
def study_cases(t: Tables):
    payload = F.when(F.col("o_orderkey") % 3 > 0, F.to_json(F.struct(F.col("o_custkey").alias("x"))))
    # some exports hold JSON within a JSON string
    twice = F.when(F.col("o_orderkey") % 2 == 0, payload).otherwise(F.concat(F.lit('"'), F.replace(payload, F.lit('"'), F.lit('\\"')), F.lit('"')))
    out = None
    for study, rest in (("a", 0), ("b", 1)):
        rows = t.spread("orders", "o_orderkey", "o_custkey", "o_orderpriority").filter(F.col("o_custkey") % 2 == rest).select(F.concat(F.lit("pid_"), "o_orderkey").alias("PID"), F.concat(F.lit(" Survey "), "o_orderpriority").alias("survey_text"), twice.alias("survey_json_with_human_response"))
        part = builders.study_records(rows, study)
        out = part if out is None else out.union(part)
    b = builders.study_bundle(out, ["a", "b"])
    return simulation.with_gold(b.asked(), b.gold).select("question_id", "subject_id", "prompt", "payload")


@R.add("""SELECT 'd:nation=' || n_name || '|region=' || n_regionkey AS subject_id, CASE WHEN n_nationkey % 2 = 0 THEN 't' || n_nationkey ELSE 'item-' || n_nationkey END AS question_id, 'People of ' || n_name || ' in ' || n_regionkey AS persona_text, 'Q?' AS prompt,
['A', 'B'] AS options, 0.25 AS a, 0.75 AS b, CAST(n_nationkey + 10 AS BIGINT) AS group_size FROM nation""")
def group_cases(t: Tables):
    k = F.col("n_nationkey")
    rows = t.nation.select(
        F.lit("d").alias("dataset_name"), F.lit("People of {nation} in {region} ").alias("group_prompt_template"), F.to_json(F.struct(F.col("n_regionkey").cast("string").alias("region"), F.col("n_name").alias("nation"))).alias("group_prompt_variable_map"),
        F.lit('"{\\"A\\": 0.25, \\"B\\": 0.75}"').alias("human_answer"), F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("t"), k).alias("task_id")))).alias("auxiliary"), F.lit(" Q? ").alias("input_template"), (k + 10).alias("group_size"), k.alias("index"),
    )
    b = builders.group_bundle(builders.group_records(rows, "Pop"))
    joined = b.asked().join(b.subjects, "subject_id").join(b.gold.drop("dataset"), ["subject_id", "question_id"])
    return joined.select("subject_id", "question_id", "persona_text", "prompt", "options", F.element_at("distribution", "A").cast("decimal(3,2)").alias("a"), F.element_at("distribution", "B").cast("decimal(3,2)").alias("b"), "group_size")


@R.add("""SELECT CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN 'n' || c_nationkey WHEN c_custkey % 4 = 2 THEN '$' || c_custkey % 9 || '000' ELSE 'unknown' END AS stratum, count(*) AS n FROM customer GROUP BY ALL""")
def income_strata(t: Tables):
    k = F.col("c_custkey")
    demo = F.create_map(F.lit("QID21"), F.when(k % 4 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" "), F.lit("income"), F.when(k % 4 == 1, F.concat(F.lit("n"), "c_nationkey")))
    text = F.when(k % 4 == 2, F.concat(F.lit("Age: 3\nIncome answer: $"), k % 9, F.lit("000"))).otherwise("Answer: no")
    return t.customer.groupBy(builders.income_stratum(demo, text=text).alias("stratum")).agg(F.count("*").alias("n"))


@R.add("SELECT 'p' || n_nationkey AS subject_id, question_id, n_name AS persona, options FROM nation, (VALUES ('q1', ['Yes', 'No']), ('q2', ['a'])) AS v(question_id, options)")
def fixed_personas(t: Tables):
    personas = t.nation.select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.concat("n_name", F.lit("\n")).alias("text"))
    questions = t.spark.createDataFrame([("q1", "One?", None), ("q2", "Two?", ["a"])], "id string, prompt string, options array<string>")
    return builders.fixed_personas(personas, questions, t.nation.count(), 2, ["Yes", "No"]).select("subject_id", "question_id", "persona", "options")


@R.add("SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN event_type END AS value FROM events")
def jsonish(t: Tables):
    """JSON, JSON within a JSON string, other text, and blanks."""
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), "props")).when(k == 1, quoted).when(k == 2, F.col("event_type")).otherwise(" ")
    return t.events.select("event_id", decoded(raw).alias("value"))


# simulation


def even_replies(system: str, user: str) -> str:
    """A provider that answers questions of even number only."""
    ids = [q for q in re.findall(r"(?m)^question_id: (\d+)$", user) if int(q) % 2 == 0]
    return json.dumps({"answers": [{"question_id": q, "answer": "mock", "rationale": "-"} for q in ids]})


def talks(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit("Say "), F.col("turn").cast("string"))
    return t.conversations.select(F.col("conv_id").cast("string").alias("subject_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("question_id"), F.lit("A person.").alias("persona"), prompt.alias("prompt"), F.array().cast("array<string>").alias("options"), F.lit("text").alias("kind"), F.lit("answer").alias("response_mode"))


@R.add("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'mock' END AS answer, CASE WHEN turn % 2 = 1 THEN 'missing question_id ' || turn END AS error, conv_id % 3 = 0 AS cached FROM conversations""")
def survey_run(t: Tables):
    """Packed, asked in batches of 3 unless the cache has the reply, read back to one row a question."""
    asked = talks(t).withColumn("persona", F.concat(F.lit("Person "), "subject_id"))
    even = F.filter("question_ids", lambda q: q.cast("long") % 2 == 0)
    batches = batching.pack(asked, 3).withColumn("key", batching.cache_key("provider", "m", "system", "user", "response_mode"))
    cache = batches.filter(F.col("subject_id").cast("long") % 3 == 0).select("key", batching.mock_reply(even).alias("raw"))
    run = simulation.simulate(asked, even_replies, model="m", size=3, cache=cache)
    return run.results.select(F.col("subject_id").cast("long").alias("conv_id"), F.col("question_id").cast("long").alias("turn"), "answer", "error", "cached")


@R.add("""WITH b AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk, turn FROM conversations), c AS (SELECT conv_id, chunk, bool_and(turn % 2 = 0) AS clean FROM b GROUP BY ALL)
SELECT count(*) AS batches, count(*) FILTER (clean) AS kept FROM c""")
def cached_batches(t: Tables):
    """Only batches of which every question was answered go to the cache."""
    run = simulation.simulate(talks(t).withColumn("persona", F.concat(F.lit("Person "), "subject_id")), even_replies, model="m", size=3)
    n = run.results.select("subject_id", "chunk").distinct().agg(F.count("*").alias("batches"))
    return n.join(run.cache.agg(F.count("*").alias("kept")), F.lit(True))


# scorers


@R.add("""WITH a AS (SELECT 'S' || p_partkey % 40 AS q, arg_min(string_split(p_type, ' '), p_partkey) AS o, arg_min(p_brand, p_partkey) AS kind FROM part GROUP BY 1),
c AS (SELECT 'S' || s_suppkey AS q, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN ['x', 'y', 'z'] WHEN s_suppkey % 3 = 1 THEN ['l', 'r'] ELSE [] END AS o FROM supplier),
b AS (SELECT coalesce(a.q, c.q) AS question_id, CASE WHEN len(coalesce(a.o, [])) > 0 THEN a.o ELSE coalesce(c.o, a.o) END AS options,
coalesce(CASE WHEN len(a.o) >= 2 THEN len(a.o) - 1 END, CASE WHEN c.k IS NULL THEN NULL WHEN len(c.o) >= 2 THEN len(c.o) - 1 ELSE 100 - c.k END) AS span, coalesce(a.kind, 'T') AS kind FROM a FULL JOIN c ON a.q = c.q)
SELECT question_id, options, CAST(span AS DOUBLE) AS span, kind FROM b UNION ALL SELECT q || ':' || i, o, CAST(len(o) - 1 AS DOUBLE), 'likert' FROM c, (VALUES (1), (2)) AS r(i) WHERE k % 2 = 0 AND len(o) > 0""")
def scales(t: Tables):
    asked = t.part.select(F.concat(F.lit("S"), F.col("p_partkey") % 40).alias("question_id"), F.split("p_type", " ").alias("options"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("ord"))
    k = F.col("s_suppkey")
    catalog = t.supplier.select(
        F.concat(F.lit("S"), k).alias("QuestionID"), F.lit("T").alias("QuestionType"), F.when(k % 3 == 0, F.array(*map(F.lit, "xyz"))).alias("Options"), F.when(k % 3 == 1, F.array(*map(F.lit, "lr"))).alias("Columns"),
        F.when(k % 2 == 0, F.array(*map(F.lit, "ab"))).alias("Rows"), F.when(k % 3 == 2, F.struct(k.alias("Min"), F.lit(100).alias("Max"))).alias("Range"),
    )
    return scoring.scales(asked, catalog)


@R.add("""WITH x AS (SELECT CASE WHEN l_linenumber = 1 THEN 'conclusion_purchased_product' ELSE 'local_field' END AS item, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END ELSE l_quantity END AS h,
CASE WHEN l_linenumber = 1 THEN CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END ELSE l_discount * 100 END AS m FROM lineitem)
SELECT item, count(*) AS n, round(avg(1 - abs(h - m) / CASE WHEN item = 'local_field' THEN 10 ELSE 1 END), 6) AS accuracy FROM x GROUP BY item""")
def bid_scores(t: Tables):
    buys = F.col("l_linenumber") == 1
    answers = t.lineitem.select(
        F.when(buys, builders.PURCHASE).otherwise("local_field").alias("question_id"),
        F.when(buys, F.when(F.col("l_quantity") > 25, " TRUE").otherwise("no")).otherwise(F.col("l_quantity").cast("string")).alias("human"),
        F.when(buys, F.when(F.col("l_discount") > 0.05, "Yes").otherwise("False")).otherwise(F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%"))).alias("model"),
    )
    codes = scoring.encode_bids(answers)
    return codes.groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.abs(F.col("human") - F.col("model")) / F.col("span")), 6).alias("accuracy"))


STUDY_CODES = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT 's:Q1' AS item, CAST(1 + k % 3 AS DOUBLE) AS human, CAST(1 + c % 3 AS DOUBLE) AS model, 2.0::DOUBLE AS span FROM o
UNION ALL SELECT 's:Q2:' || i, CAST(CASE i WHEN 1 THEN k % 100 ELSE 5 END AS DOUBLE), CAST(CASE i WHEN 1 THEN c % 100 ELSE 7 END AS DOUBLE), CAST(greatest(k % 100, c % 100, 7) - least(k % 100, c % 100, 5) AS DOUBLE) FROM o, (VALUES (1), (2)) AS v(i) WHERE k % 2 = 0
UNION ALL SELECT 's:Q10', CAST(1 + k % 2 AS DOUBLE), CAST(1 + c % 2 AS DOUBLE), 1.0::DOUBLE FROM o WHERE k % 2 = 0"""


def study_answers(t: Tables) -> DataFrame:
    """Trees with one or three questions beside replies with as many or fewer, as some replies leave questions out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    options = '"Options":["red","green","blue"],'
    human = F.concat(
        F.format_string('{"Elements":[{"Questions":[{"QuestionType":"MC",' + options + '"Answers":{"SelectedByPosition":%d}},', 1 + k % 3),
        F.format_string('{"QuestionType":"Slider","Answers":{"Values":["%d",5]}},', k % 100),
        F.format_string('{"QuestionType":"Matrix","Choices":["n","y"],"Answers":{"SelectedText":"%s"}}]}]}', F.when(k % 2 == 0, "N").otherwise("y")),
    )
    full = F.concat(
        F.format_string('{"Q10":{"Question Type":"matrix","Choices":["n","y"],"Answers":{"SelectedText":"%s"}},', F.when(c % 2 == 0, "n").otherwise(" Y")),
        F.format_string('"note":1,"Q1":{"QuestionType":"single choice","SelectedByPosition":%d},', 1 + c % 3),
        F.format_string('"Q2":{"Question Type":"slider","Answers":{"Values":[%d,"7"]}}}', c % 100),
    )
    # shorter than the tree, so paired by types
    short = F.format_string('{"Q1":{"Answers":{"SelectedByPosition":%d}}}', 1 + c % 3)
    return t.spread("orders", "o_orderkey", "o_custkey").select(F.lit("s:1").alias("question_id"), human.alias("payload"), F.when(k % 2 == 0, full).otherwise(short).alias("model"))


@R.add(STUDY_CODES)
def study_codes(t: Tables):
    return scoring.encode_cells(scoring.study_cells(study_answers(t)))


@R.add("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT 's:Q1' AS question_id, '#' || 1 + k % 3 AS human, '#' || 1 + c % 3 AS model FROM o
UNION ALL SELECT 's:Q2', '~' || k % 100 || '~5', '~' || c % 100 || '~7' FROM o WHERE k % 2 = 0 UNION ALL SELECT 's:Q10', CASE WHEN k % 2 = 0 THEN 'n' ELSE 'y' END, CASE WHEN c % 2 = 0 THEN 'n' ELSE 'y' END FROM o WHERE k % 2 = 0""")
def study_labels(t: Tables):
    return scoring.study_labels(scoring.study_cells(study_answers(t)))


@R.add(f"""WITH x AS ({STUDY_CODES.replace("WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT * FROM (")})),
s AS (SELECT item, greatest(max(span), 0) AS span FROM x GROUP BY item), i AS (SELECT item, avg(1 - abs(human - model) / s.span) AS acc, avg(human) AS h, avg(model) AS m FROM x JOIN s USING (item) GROUP BY item)
SELECT count(*) AS items, round(avg(acc), 6) AS ordinal_accuracy, round(avg(h), 6) AS human_mean, round(avg(m), 6) AS model_mean FROM i""")
def study_scores(t: Tables):
    s = scoring.score_run("twin2k_mega_study", study_answers(t))
    return s.select("items", *(F.round(c, 6).alias(c) for c in ("ordinal_accuracy", "human_mean", "model_mean")))


@R.add("""WITH n AS (SELECT event_type AS qid, count(*) FILTER (user_id % 3 = 0) AS yes, count(*) FILTER (user_id % 3 = 1) AS no, count(*) FILTER (user_id % 3 = 2) AS unparsed FROM events WHERE event_type <> 'error' GROUP BY ALL),
q AS (SELECT DISTINCT event_type AS qid FROM events), j AS (SELECT q.qid, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no, coalesce(unparsed, 0) AS unparsed FROM q LEFT JOIN n USING (qid))
SELECT qid, 'Buy ' || qid AS body, yes, no, yes + no AS n, unparsed, 0.75::DOUBLE AS human_yes, 0.25::DOUBLE AS human_no, CASE WHEN yes + no = 0 THEN 1 ELSE round((abs(yes / (yes + no) - 0.75) + abs(no / (yes + no) - 0.25)) / 2, 6) END AS tvd, CASE WHEN yes + no = 0 THEN 0 ELSE round(yes / (yes + no), 6) END AS mean FROM j""")
def yes_no_cards(t: Tables):
    questions = t.events.select(F.col("event_type").alias("qid"), F.concat(F.lit("Buy "), "event_type").alias("body")).distinct()
    u = F.col("user_id") % 3
    said = t.events.filter("event_type <> 'error'").select(F.col("event_type").alias("qid"), F.when(u == 0, "Yes").when(u == 1, "No").otherwise("perhaps").alias("answer"))
    human = questions.select("qid", F.lit(3.0).alias("yes"), F.lit(1.0).alias("no"))
    return scoring.yes_no_cards(questions, said, human)


# sources and sinks


@R.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def json_lines(t: Tables):
    """Written as sorted JSON lines and read back strictly."""
    path = scratch(t, "jsonl")
    writers.write_jsonl(t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal"), path, ["c_custkey"])
    return readers.read_jsonl(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@R.add("SELECT CAST(s_suppkey AS VARCHAR) AS pid, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier")
def csv_table(t: Tables):
    """Written with a header and read back as trimmed text, the key checked."""
    path = scratch(t, "csv")
    writers.write_csv(t.supplier.select(F.col("s_suppkey").cast("string").alias("pid"), F.concat("s_name", F.lit(" ")).alias("name"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_nationkey").cast("string")).alias("nation")), path)
    return readers.assert_unique(readers.read_csv(t.spark, path, ["pid", "name", "nation"]), ["pid"])


@R.add("SELECT o_orderkey, o_orderpriority, true AS in_place FROM orders")
def json_places(t: Tables):
    """Lines keep their file and number: those of a file that was written in order count its rows up."""
    path = scratch(t, "places")
    writers.write_jsonl(t.orders.select("o_orderkey", "o_orderpriority"), path, ["o_orderkey"])
    rows = readers.read_jsonl(t.spark, path, "o_orderkey long, o_orderpriority string", place="at")
    rank = F.row_number().over(W.partitionBy("at.file").orderBy("o_orderkey"))
    return rows.select("o_orderkey", "o_orderpriority", (F.col("at.line") == rank).alias("in_place"))


@R.add("""SELECT CASE event_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not a JSON object' ELSE 'good' END AS state, count(*) AS n, sum(event_id) FILTER (event_id % 6 > 2) AS ids FROM events WHERE event_id % 6 <> 2 GROUP BY ALL""")
def lenient_lines(t: Tables):
    """Lines that are cut short or no objects are put aside with a reason; blank ones count for nothing."""
    path = scratch(t, "lenient")
    k = F.col("event_id") % 6
    whole = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(k == 0, F.substring(whole, 1, 10)).when(k == 1, F.concat(F.lit("["), "event_id", F.lit("]"))).when(k == 2, "  ").otherwise(whole).alias("value")).write.text(path)
    good, bad = readers.read_lenient(t.spark, path, "event_id long, event_type string")
    counts = bad.groupBy(F.col("reason").alias("state")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("ids"))
    return counts.union(good.agg(F.lit("good").alias("state"), F.count("*").alias("n"), F.sum("event_id").alias("ids")))


@R.add("""SELECT 1 AS version, 'customer' AS name, count(*) AS n, sum(c_custkey) AS keys FROM customer WHERE c_nationkey < 10 UNION ALL SELECT 1, 'supplier', count(*), sum(s_suppkey) FROM supplier
UNION ALL SELECT 2, 'customer', count(*), sum(c_custkey) FROM customer UNION ALL SELECT 2, 'supplier', count(*), sum(s_suppkey) FROM supplier""")
def published_tables(t: Tables):
    """Two versions of a folder of tables, read back against their locks; a writer that dies between them leaves no trace."""
    path = scratch(t, "published")
    keys = {"customer": "c_custkey", "supplier": "s_suppkey"}
    publish.publish({"customer": t.customer.filter("c_nationkey < 10"), "supplier": t.supplier}, path, source="test tables")
    try:
        publish.publish({"customer": t.customer, "supplier": t.supplier.withColumn("x", F.raise_error(F.lit("the writer died")).cast("string"))}, path)
    except Exception as error:
        if "the writer died" not in str(error):
            raise
    publish.publish({"customer": t.customer, "supplier": t.supplier}, path)
    parts = [publish.read_published(t.spark, path, name, v).agg(F.lit(v).alias("version"), F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(k).alias("keys")) for v in publish.versions(t.spark, path) for name, k in keys.items()]
    return reduce(DataFrame.union, parts)


@R.add("""SELECT d AS dataset, 'fixed_text' AS method, m AS model, CASE WHEN m = 'down' THEN 'batch_errors' ELSE 'responses' END AS state, CASE WHEN m = 'down' THEN 0 ELSE n END AS answers
FROM (SELECT 'even' AS d, count(*) * 2 AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'odd', count(*) * 2 FROM customer WHERE c_custkey % 2 = 1), (VALUES ('a'), ('b'), ('down')) AS v(m)""")
def job_grid(t: Tables):
    """Two surveys asked by one method of three models, one of which can't be reached; answers are read from what the jobs wrote."""
    base = scratch(t, "jobs")

    def bundle_of(name: str) -> Bundle:
        k = F.col("c_custkey")
        ask = lambda q: F.struct(F.lit(q).alias("id"), F.concat(F.lit(f"{q}, "), "c_name", F.lit("?")).alias("prompt"), F.array(F.lit("yes"), F.lit("no")).alias("options"), F.lit("multiple_choice").alias("kind"), F.lit("yes").alias("gold"))
        rows = t.customer.filter(k % 2 == int(name == "odd")).select(k.cast("string").alias("id"), F.create_map(F.lit("segment"), "c_mktsegment").alias("demographics"), F.col("c_name").alias("persona_text"), F.array(ask("q1"), ask("q2")).alias("questions"))
        return from_records(rows, "twin2k_500")

    states = jobs.run_jobs(t.spark, jobs.grid(base, ["even", "odd"], ["fixed_text"], ["a", "b", "down"], size=2), bundle_of, provider_of)
    made = [j for j in states.collect() if j["state"] == "responses"]
    counts = [readers.read_jsonl(t.spark, f"{base}/{j['dataset']}/{j['method']}/{j['model']}/responses", "answer string").agg(F.lit(j["dataset"]).alias("dataset"), F.lit(j["model"]).alias("model"), F.count("answer").alias("answers")) for j in made]
    return states.join(reduce(DataFrame.union, counts), ["dataset", "model"], "left").select("dataset", "method", "model", "state", F.coalesce("answers", F.lit(0)).alias("answers"))


@R.add("""SELECT 'twin2k_500' AS dataset, 'persons' AS "table", count(*) AS rows, 'fetched' AS state, sum(c_custkey) AS keys FROM customer UNION ALL SELECT 'bdm_lettuce', 'shoppers', count(*), 'fetched', sum(s_suppkey) FROM supplier UNION ALL SELECT 'twin2k_500', 'extra', 0, 'skipped', NULL""")
def fetched_tables(t: Tables):
    """Two data sets by their short names, one with an optional table that is not there, and what can be loaded then."""
    store = scratch(t, "store")
    absent = lambda: t.spark.read.parquet(f"{store}/no-such-file")
    sources = {
        "twin2k_500": fetching.Source({"persons": lambda: t.customer, "extra": absent}, ["extra"], {"persons": t.customer.count()}),
        "bdm_lettuce": fetching.Source({"shoppers": lambda: t.supplier}),
    }
    made = fetching.fetch(t.spark, store, ["twin", "lettuce", "TWIN2K"], sources)
    keys = {("twin2k_500", "persons"): "c_custkey", ("bdm_lettuce", "shoppers"): "s_suppkey"}
    sums = [fetching.load(t.spark, store, d, n).agg(F.lit(d).alias("dataset"), F.lit(n).alias("table"), F.sum(k).alias("keys")) for (d, n), k in keys.items()]
    return made.join(reduce(DataFrame.union, sums), ["dataset", "table"], "left")


@R.add("SELECT conv_id, turn, conv_id % 3 < 2 AS known, CASE WHEN conv_id % 3 < 2 THEN 'said ' || text END AS raw FROM conversations")
def reply_store(t: Tables):
    """Replies added by two jobs, compacted between them, and looked up."""
    store = replies.ReplyStore(t.spark, scratch(t, "replies"), buckets=8)
    key = F.concat_ws(":", "conv_id", "turn")
    rows = t.conversations.select("conv_id", "turn", key.alias("key"), F.concat(F.lit("said "), "text").alias("raw"))
    for rest in (0, 1):
        store.add(rows.filter(F.col("conv_id") % 3 == rest))
        if rest == 0:
            store.compact()
    found = store.look_up(rows.drop("raw"))
    return found.select("conv_id", "turn", F.col("raw").isNotNull().alias("known"), "raw")


@R.add("""WITH a AS (SELECT o_orderpriority AS item, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS item, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT a.item, a.mean, b.mean AS older_mean FROM a LEFT JOIN b USING (item)""")
def older_scores(t: Tables):
    """A table of scores with those of an older run beside, which lacks an item."""
    per = lambda df: df.groupBy(F.col("o_orderpriority").alias("item")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return report.with_older(per(t.orders), per(t.orders.filter("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'")), ["item"], ["mean"])


def provider_of(model: str):
    """Providers of the grid: one that can't be reached, others that answer yes."""

    def told(system: str, user: str) -> str:
        if model == "down":
            raise TransportError("no route")
        return json.dumps({"answers": [{"question_id": q, "answer": "yes"} for q in re.findall(r"(?m)^question_id: (\S+)$", user)]})

    return told
