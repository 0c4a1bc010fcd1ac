"""Scalar functions over documents, pages and events; cards; the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canvass.functions import text as x
from canvass.plans import assembly, builders, bundle, cards, groups, report, scoring
from canvass.queries.base import Registry, Tables
from canvass.session import shared_dir
from canvass.sources import readers, writers
from canvass.streaming import incremental

R = Registry()
_WS = "'[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, {_WS}, ' ', 'g'))"


@R.add(f"SELECT page_id, md5({_squeeze("replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')")}) AS digest FROM pages")
def strip_html(t: Tables):
    return t.pages.select("page_id", F.md5(x.strip_html(F.col("html")).cast("binary")).alias("digest"))


@R.add("SELECT doc_id, nullif(replace(lower(trim(source)), 'ß', 'ss'), '') AS label FROM documents")
def norm_label(t: Tables):
    return t.documents.select("doc_id", x.norm_label(F.col("source")).alias("label"))


@R.add(f"SELECT doc_id, 'SB_' || regexp_replace(source, '[^A-Za-z0-9]+', '', 'g') || '_' || substr(sha1(source || '||' || {_squeeze('text')}), 1, 8) AS qid FROM documents")
def template_qid(t: Tables):
    return t.documents.select("doc_id", x.make_qid(F.col("source"), F.col("text")).alias("qid"))


@R.add("""SELECT conv_id, turn, CASE WHEN lower(trim(text)) LIKE 'yes%' THEN 'Yes' WHEN lower(trim(text)) LIKE 'no%' THEN 'No'
WHEN regexp_matches(lower(text), 'would not|wouldn''t|will not|not purchase|not buy|do not|don''t') THEN 'No' WHEN regexp_matches(lower(text), 'would purchase|would buy|will buy|will purchase|i''d buy') THEN 'Yes' END AS answer FROM conversations""")
def yes_no(t: Tables):
    return t.conversations.select("conv_id", "turn", x.normalize_yes_no(F.col("text")).alias("answer"))


@R.add("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'less than') THEN 'less' WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'grey' WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper') THEN 'red' ELSE 'unknown' END AS bucket FROM part""")
def bucket_rules(t: Tables):
    rules = (("less", ("less than",)), ("grey", ("steel", "tin")), ("red", ("brass", "copper")))
    return t.part.select("p_partkey", x.first_rule(F.lower("p_type"), rules, "unknown").alias("bucket"))


_DEMO = "SELECT c_custkey, ['Some college, no degree', 'High school graduate', 'Associate’s degree', 'College graduate', 'Postgraduate', 'Less than high school', 'Other'][1 + c_custkey % 7] AS e, ['Full-time employment', 'Part-time', 'Retired', 'Full-time student', 'Self-employed', 'Home-maker'][1 + c_custkey % 6] AS j, ['Under $30,000', '$50,000-$75,000', '$100,000 or more', 'none'][1 + c_custkey % 4] AS i FROM customer"


@R.add(f"""WITH d AS ({_DEMO}) SELECT c_custkey, CASE WHEN contains(lower(e), 'less than') THEN 'less_than_high_school' WHEN contains(lower(e), 'some college') OR contains(lower(e), 'associate') THEN 'some_college' WHEN contains(lower(e), 'high school') THEN 'high_school'
WHEN contains(lower(e), 'graduate') OR contains(lower(e), 'postgrad') THEN 'bachelor_or_higher' ELSE 'unknown' END AS education,
CASE WHEN j IN ('Retired', 'Full-time student', 'Home-maker') THEN 0.0 WHEN j = 'Part-time' THEN 20.0 WHEN j = 'Full-time employment' THEN 40.0 END::DOUBLE AS hours, i IN ('$50,000-$75,000', '$100,000 or more') AS rich FROM d""")
def demographics(t: Tables):
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (1 + F.col("c_custkey") % len(items)).cast("int"))
    e = pick(("Some college, no degree", "High school graduate", "Associate’s degree", "College graduate", "Postgraduate", "Less than high school", "Other"))
    j = pick(("Full-time employment", "Part-time", "Retired", "Full-time student", "Self-employed", "Home-maker"))
    i = pick(("Under $30,000", "$50,000-$75,000", "$100,000 or more", "none"))
    return t.customer.select("c_custkey", x.education_bucket(e).alias("education"), x.weekly_hours(j).alias("hours"), x.income_over_50k(i).alias("rich"))


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.from_json("props", "map<string,int>")["k"].alias("k"))


@R.add("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN CAST(event_id AS DOUBLE) WHEN 3 THEN 12.5 END AS number FROM events""")
def parse_number(t: Tables):
    raw = F.when(F.col("event_id") % 5 == 0, " TRUE ").when(F.col("event_id") % 5 == 1, "no").when(F.col("event_id") % 5 == 2, F.format_number("event_id", 0)).when(F.col("event_id") % 5 == 3, "12.5%").otherwise("nan")
    return t.events.select("event_id", x.parse_number(raw).alias("number"))


@R.add("""SELECT p_partkey, 'Pick a size.' || chr(10) || 'Options:' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type AS prompt FROM part""")
def prompt_options(t: Tables):
    return t.part.select("p_partkey", x.with_options(F.lit("Pick a size."), F.array("p_brand", "p_type")).alias("prompt"))


@R.add("SELECT c_custkey, 'ESS:nation=' || CAST(c_nationkey AS VARCHAR) || '|segment=' || c_mktsegment AS group_key, 'A ' || c_mktsegment || ' buyer of ' || CAST(c_nationkey AS VARCHAR) AS prompt FROM customer")
def group_prompts(t: Tables):
    nation = F.col("c_nationkey").cast("string")
    pairs = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), nation)
    prompt = x.format_template(F.lit("A {segment} buyer of {nation}"), F.map_entries(pairs))
    return t.customer.select("c_custkey", x.group_key(F.lit("ESS"), pairs).alias("group_key"), prompt.alias("prompt"))


@R.add("""SELECT p_partkey, p_name || '?' AS stem, ['A', 'B'] AS keys, [p_brand, p_type] AS texts, 'from_options_block' AS status FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, ['1', '2'], ['no', 'yes'], 'from_answer_options' FROM part WHERE p_partkey % 2 = 1""")
def option_parsing(t: Tables):
    block = F.concat("p_name", F.lit("?\nOptions:\n(A): "), "p_brand", F.lit("\n(B): "), "p_type")
    even = F.col("p_partkey") % 2 == 0
    options = F.when(even, F.lit(None)).otherwise(F.create_map(F.lit("2"), F.lit("yes"), F.lit("1"), F.lit("no"))).cast("map<string,string>")
    out = t.part.select("p_partkey", groups.parse_options(F.when(even, block).otherwise(F.col("p_name")), options, F.lit(None).cast("map<string,double>")).alias("o"))
    return out.select("p_partkey", "o.stem", "o.keys", "o.texts", "o.status")


@R.add("""SELECT '## Identity' || chr(10) || 'dataset: demo' || chr(10) || 'subject_id: ' || CAST(c_custkey AS VARCHAR) || chr(10) || 'source_file: customer' || chr(10) || 'source_id_column: pid' || chr(10) || chr(10) || '## Basics' || chr(10) ||
'name: ' || c_name || chr(10) || 'segment: ' || CASE WHEN c_custkey % 5 = 0 THEN 'MISSING' ELSE c_mktsegment END || chr(10) AS text, CAST(c_custkey AS VARCHAR) AS subject_id FROM customer""")
def basic_cards(t: Tables):
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("pid"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"))
    return cards.basic_cards(rows, "demo", "customer", ["name", "segment"]).select("text", "subject_id")


@R.add("""SELECT c_custkey, CAST(CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS BIGINT) AS code FROM customer""")
def option_codes(t: Tables):
    """Exact, folded and begun options, and an answer that is none."""
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, " NEVER ").when(k == 1, "Some").when(k == 2, "sometimes, at work").when(k == 3, "always").otherwise("who knows")
    return t.customer.select("c_custkey", x.encode_with_options(said, F.array(F.lit("Never"), F.lit("Sometimes"), F.lit("Always"))).alias("code"))


@R.add("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'State: ' || s_name WHEN s_suppkey % 3 = 1 THEN 'Region: ' || CAST(s_nationkey AS VARCHAR) ELSE 'State: Unknown' END AS place, s_suppkey % 4 = 1 AS told FROM supplier""")
def place_lines(t: Tables):
    k = F.col("s_suppkey")
    state, region = F.when(k % 3 == 0, F.concat(F.lit(" "), "s_name")).otherwise(" "), F.when(k % 3 < 2, F.col("s_nationkey").cast("string"))
    return t.supplier.select("s_suppkey", x.place_line(state, region).alias("place"), x.truthy(F.when(k % 4 == 1, " Yes ").when(k % 4 == 2, "no")).alias("told"))


@R.add("""SELECT c_custkey, list_sort(list_filter(['age=' || c_custkey % 90, CASE WHEN c_custkey % 2 = 0 THEN 'education=College graduate' END, CASE WHEN c_custkey % 2 = 0 THEN 'education_bucket=bachelor_or_higher' END, CASE WHEN c_custkey % 3 = 0 THEN 'employment=Part-time' END, CASE WHEN c_custkey % 3 = 0 THEN 'work_hours=20' END,
CASE WHEN c_custkey % 3 = 0 THEN 'QID24=Part-time' END, CASE WHEN c_custkey % 5 = 0 THEN 'income=$' || (c_custkey % 2 * 40000 + 20000) END, CASE WHEN c_custkey % 5 = 0 THEN 'income_over_50k=' || CASE WHEN c_custkey % 2 = 1 THEN 'true' ELSE 'false' END END], lambda x: x IS NOT NULL)) AS facts FROM customer""")
def adapted_people(t: Tables):
    """Survey ids to keys, outcomes left out, and what is derived: education, hours, income."""
    k = F.col("c_custkey")
    pairs = [
        (F.lit("age"), F.concat(F.lit(" "), (k % 90).cast("string"))), (F.lit("education"), F.when(k % 2 == 0, "College graduate")), (F.lit("QID24"), F.when(k % 3 == 0, "Part-time")),
        (F.lit("income"), F.when(k % 5 == 0, F.concat(F.lit("$"), (k % 2 * 40000 + 20000).cast("string")))), (F.lit("local_field"), F.lit("2.50")), (F.lit("region"), F.lit(" ")),
    ]
    made = builders.adapted(F.create_map(*(c for p in pairs for c in p)))
    return t.customer.select("c_custkey", F.array_sort(F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("facts"))


@R.add("""SELECT CAST(c_custkey AS VARCHAR) AS subject_id, CASE c_custkey % 10 WHEN 1 THEN 'segment' ELSE 'name' END AS "column" FROM customer WHERE c_custkey % 10 IN (1, 2)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), unnest(['name', 'segment']) FROM customer WHERE c_custkey % 10 = 3""")
def card_differences(t: Tables):
    """Cards beside a source in which cells were changed, emptied, or whose rows are gone."""
    k = F.col("c_custkey")
    rows = t.customer.select(k.cast("string").alias("pid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), k)
    made = cards.basic_cards(rows, "demo", "customer", ["name", "segment"])
    source = rows.filter(k % 10 != 3).withColumns({"segment": F.when(k % 10 == 1, "").otherwise(F.concat(F.col("segment"), F.lit(" "))), "name": F.when(k % 10 == 2, "else").otherwise(F.col("name"))})
    return assembly.values_differ(made, source, ["name", "segment"])


@R.add("""SELECT c_custkey, c_custkey % 11 = 0 AS sampled FROM customer""")
def sample_members(t: Tables):
    rows = t.customer.select("c_custkey")
    return report.in_sample(rows, rows.filter("c_custkey % 11 = 0"), "c_custkey")


@R.add("""SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'Q3:1' WHEN l_linenumber % 3 = 1 THEN 'Q1' ELSE 'Q2:x' END AS item, count(*) AS n, CASE WHEN l_linenumber % 3 = 0 THEN 4.0 WHEN l_linenumber % 3 = 1 THEN 1.0 END::DOUBLE AS span, CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END ELSE l_linenumber END) AS DOUBLE) AS human,
CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END ELSE l_suppkey END) AS DOUBLE) AS model FROM lineitem GROUP BY l_linenumber % 3
UNION ALL SELECT 'L:' || i, count(*), 9.0::DOUBLE, CAST(sum(CASE i WHEN 1 THEN l_linenumber ELSE 7 END) AS DOUBLE), CAST(sum(CASE i WHEN 1 THEN 3 ELSE l_suppkey END) AS DOUBLE) FROM lineitem, (VALUES (1), (2)) AS v(i) GROUP BY i""")
def scaled_pairs(t: Tables):
    """Answers beside the scale of their question, of the name before its colon, or of none; lists part by part."""
    scales = t.spark.createDataFrame([("Q1", ["yes", "no"], None), ("Q3:1", [], 4.0), ("Q3", [], 8.0), ("L", [], 9.0)], "question_id string, options array<string>, span double").withColumn("kind", F.lit(""))
    kind, n, s = F.col("l_linenumber") % 3, F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    named = F.when(kind == 0, "Q3:1").when(kind == 1, "Q1").otherwise("Q2:x")
    human = F.when(kind == 1, F.when(F.col("l_returnflag") == "A", " Yes").otherwise("NO")).otherwise(n)
    model = F.when(kind == 1, F.when(F.col("l_linestatus") == "F", "yes, sure").otherwise("no")).otherwise(F.concat(s, F.lit("%")))
    single = t.lineitem.select(named.alias("question_id"), human.alias("human"), model.alias("model"))
    listed = t.lineitem.select(F.lit("L").alias("question_id"), F.concat(n, F.lit(", 7")).alias("human"), F.concat(F.lit("3,"), s).alias("model"))
    out = scoring.encode_pairs(single.union(listed), scales)
    return out.groupBy("item").agg(F.count("*").alias("n"), F.max("span").alias("span"), F.sum("human").alias("human"), F.sum("model").alias("model"))


@R.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY ALL")
def partitioned_table(t: Tables):
    """Written in folders by two keys and counted from them."""
    path = f"{shared_dir(t.spark)}/canvass/parted-{uuid.uuid4().hex[:12]}"
    writers.write_partitioned(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, "o_orderstatus", "o_orderpriority")
    return t.spark.read.parquet(path).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@R.add("""WITH x AS (SELECT 'nation' AS split, 0 AS split_ord, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'supplier', 1, s_suppkey, s_name FROM supplier) SELECT split, k, name FROM x ORDER BY split_ord, k LIMIT 30""")
def split_rows(t: Tables):
    """Two splits one after the other under one limit, the second not whole."""
    base = f"{shared_dir(t.spark)}/canvass/splits-{uuid.uuid4().hex[:12]}"
    t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")).write.parquet(f"{base}/nation")
    t.supplier.select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name")).write.parquet(f"{base}/supplier")
    return readers.read_splits(t.spark, {"nation": f"{base}/nation", "supplier": f"{base}/supplier"}, limit=30, order="k").select("split", "k", "name")


@R.add("""WITH u AS (SELECT *, (CAST(('0x' || substr(sha256('3' || chr(10) || CAST(p_partkey AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM part) SELECT p_partkey, p_name, p_size FROM u ORDER BY ln(u) / p_size DESC LIMIT 40""")
def two_pass_sample(t: Tables):
    """Records drawn by weight: ids and weights first, then the chosen records whole."""
    return readers.sampled_records(t.part, "p_partkey", F.col("p_size"), 40, 3).select("p_partkey", "p_name", "p_size")


@R.add("SELECT c_custkey, c_mktsegment AS held, CASE WHEN c_custkey % 4 < 2 THEN 'card of ' || c_name ELSE c_name END AS persona_text FROM customer")
def attached_personas(t: Tables):
    """Persons of one survey with the cards of another where it has them."""
    k = F.col("c_custkey")
    ask = F.array(F.struct(F.lit("q").alias("id"), F.lit("Which?").alias("prompt"), F.array(F.lit("a")).alias("options"), F.lit("text").alias("kind"), F.col("c_mktsegment").alias("gold")))
    made = bundle.from_records(t.customer.select(k.cast("string").alias("id"), F.create_map(F.lit("age"), F.lit("30")).alias("demographics"), F.col("c_name").alias("persona_text"), ask.alias("questions")), "twin2k_500")
    cards_ = t.customer.filter(k % 4 < 2).select(k.cast("string").alias("subject_id"), F.concat(F.lit("card of "), "c_name").alias("persona_text"))
    both = bundle.attach_personas(made, cards_)
    return both.subjects.join(both.gold, "subject_id").select(F.col("subject_id").cast("long").alias("c_custkey"), F.col("answer").alias("held"), "persona_text")


@R.add()
def life_cards(t: Tables):
    demo = F.create_map(F.lit("age"), (18 + F.col("c_custkey") % 70).cast("string"), F.lit("education"), F.lit("College graduate"), F.lit("employment"), F.when(F.col("c_custkey") % 2 == 0, "Full-time").otherwise("Retired"), F.lit("region"), F.col("c_mktsegment"))
    people = t.spread("customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").cast("string").alias("subject_id"), demo.alias("demographics"), F.create_map(F.lit("work"), F.lit(240.0), F.lit("sleep"), F.lit(480.5)).alias("routine"))
    return cards.life_cards(people, 42)


@R.add()
def tendency_cards(t: Tables):
    return cards.tendency_cards(t.customer.select(F.col("c_custkey").cast("string").alias("subject_id")))


@R.add("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(t: Tables):
    """Daily counts of the answer stream, run over all files there are."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    schema = t.events.schema
    # a stream reads folders, and the table may be one file
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    counts = incremental.window_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type")
    incremental.drain(counts, f"{base}/state", f"{base}/out", mode="complete")
    return t.spark.read.parquet(f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
