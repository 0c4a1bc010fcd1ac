"""Relational preparation: joins, checks, reshaping, catalogs, batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.functions.jsonx import canonical_hash, reply_object
from canvass.operators import relational as r
from canvass.plans import batching, groups
from canvass.queries.base import Registry, Tables
from canvass.sources.writers import text_statistics

R = Registry()


@R.add("""WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, last_order, last_priority FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def attach_left(t: Tables):
    last = r.last_wins(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    right = last.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_orderpriority").alias("last_priority"))
    return r.attach(t.customer.select("c_custkey", "c_name"), right, ["c_custkey"])


@R.add("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def gold_attach(t: Tables):
    return r.attach(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@R.add("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unmatched_anti(t: Tables):
    return t.part.select("p_partkey", "p_name").join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@R.add("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_filter(t: Tables):
    subjects, _ = r.keep_with(t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"), t.orders.withColumnRenamed("o_custkey", "k"), "k", F.col("o_totalprice") > 300000)
    return subjects.withColumnRenamed("k", "c_custkey").select("c_custkey", "c_mktsegment")


@R.add("""WITH n AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'no orders' WHEN u = 0 THEN 'no urgent order' WHEN n < 8 THEN 'too few orders' ELSE 'ok' END AS reason FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def eligibility_reasons(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    joined = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", r.reasons([(F.col("n").isNull(), "no orders"), (F.col("u") == 0, "no urgent order"), (F.col("n") < 8, "too few orders")], "ok").alias("reason"))


@R.add("""WITH p AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS priority),
n AS (SELECT c_nationkey AS k, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT n_nationkey, priority, coalesce(n, 0) AS n FROM nation CROSS JOIN p LEFT JOIN n USING (priority) WHERE n.k IS NULL OR n.k = n_nationkey
UNION ALL SELECT n_nationkey, priority, 0 FROM nation CROSS JOIN p WHERE EXISTS (SELECT 1 FROM n WHERE n.priority = p.priority) AND NOT EXISTS (SELECT 1 FROM n WHERE n.priority = p.priority AND n.k = n_nationkey)""")
def persons_x_questions(t: Tables):
    # every person gets the fixed list of questions: an explode, not a cross join
    priorities = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    spine = t.nation.select("n_nationkey", F.explode(priorities).alias("priority"))
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return spine.join(n, ["n_nationkey", "priority"], "left").select("n_nationkey", "priority", F.coalesce("n", F.lit(0)).alias("n"))


@R.add("""SELECT o_orderkey, item, value FROM (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders) UNPIVOT (value FOR item IN (status, priority))""")
def unpivot_items(t: Tables):
    wide = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return r.unpivot(wide, ["o_orderkey"], ["status", "priority"])


@R.add("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <> 4")
def uniform_count_check(t: Tables):
    return r.unequal_counts(t.conversations.select("conv_id").distinct(), t.conversations, "conv_id", 4)


@R.add("""WITH x AS (SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS INT) AS chunk FROM conversations)
SELECT conv_id, chunk, count(*) AS n, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM x GROUP BY conv_id, chunk""")
def batch_chunks(t: Tables):
    cut = r.chunks(t.conversations.select("conv_id", "turn"), "conv_id", ["turn"], 3)
    return cut.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("turn")).cast("array<string>"), ",").alias("turns"))


@R.add("""SELECT CAST(conv_id AS VARCHAR) AS subject_id, md5('Persona:' || chr(10) || chr(10) || 'A person.' || chr(10) || chr(10) || 'Questions:' || chr(10) || chr(10)
|| string_agg('question_id: ' || turn || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def pack_prompt(t: Tables):
    turn = F.col("turn").cast("string")
    asked = t.conversations.select(F.col("conv_id").cast("string").alias("subject_id"), F.col("turn").alias("ord"), turn.alias("question_id"), F.lit("A person.").alias("persona"), F.col("text").alias("prompt"), F.array().cast("array<string>").alias("options"), F.lit("text").alias("kind"), F.lit("answer").alias("response_mode"))
    return batching.pack(asked, 10_000).select("subject_id", F.md5(F.col("user").cast("binary")).alias("digest"))


@R.add("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'mock' END AS answer, CASE WHEN turn % 2 = 1 THEN 'missing question_id ' || CAST(turn AS VARCHAR) END AS error FROM conversations""")
def mock_simulate(t: Tables):
    """Turns asked in batches of 3; the mock provider answers the even ones only."""
    cut = r.chunks(t.conversations.select(F.col("conv_id").alias("subject_id"), "turn", F.col("turn").cast("string").alias("q")), "subject_id", ["turn"], 3)
    batches = cut.groupBy("subject_id", "chunk").agg(F.array_sort(F.collect_list("q")).alias("question_ids")).withColumn("response_mode", F.lit("answer"))
    even = F.filter("question_ids", lambda q: q.cast("long") % 2 == 0)
    # every other reply is fenced, as models do
    raw = batching.mock_reply(even)
    replies = batches.withColumn("raw", F.when(F.col("chunk") % 2 == 0, raw).otherwise(F.concat(F.lit("Here you are:\n```json\n"), raw, F.lit("\n```"))))
    out = batching.answers(replies)
    return out.select(F.col("subject_id").alias("conv_id"), F.col("question_id").cast("long").alias("turn"), "answer", "error")


@R.add("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k,
CASE event_id % 4 WHEN 3 THEN 'model reply does not contain a JSON object' END AS error FROM events""")
def reply_salvage(t: Tables):
    e = t.events.withColumn("raw", F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise("no json here"))
    out = e.select("event_id", reply_object(F.col("raw")).alias("x"))
    return out.select("event_id", F.get_json_object("x.json", "$.k").cast("int").alias("k"), F.col("x.error").alias("error"))


@R.add("""WITH n AS (SELECT user_id AS case_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL)
SELECT case_id, label, round(n / sum(n) OVER (PARTITION BY case_id), 6) AS share FROM n""")
def explode_shares(t: Tables):
    n = t.events.groupBy("user_id", "event_type").count()
    total = W.partitionBy("user_id")
    percent = n.withColumn("p", 100.0 * F.col("count") / F.sum("count").over(total))
    answer = percent.groupBy(F.col("user_id").alias("case_id")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("answer"))
    return groups.shares(answer).select("case_id", "label", F.round("share", 6).alias("share"))


@R.add("""WITH n AS (SELECT user_id AS case_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT case_id, event_type, n / sum(n) OVER (PARTITION BY case_id) AS share FROM n)
SELECT case_id, round(sum(share), 6) AS total FROM s WHERE event_type <> 'click' GROUP BY case_id HAVING abs(sum(share) - 1) > 1e-3""")
def share_sum_issues(t: Tables):
    n = t.events.groupBy(F.col("user_id").alias("case_id"), "event_type").count()
    s = n.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy("case_id"))).filter("event_type <> 'click'")
    return groups.share_sum_issues(s).select("case_id", F.round("total", 6).alias("total"))


@R.add("""WITH k AS (SELECT md5(text) AS question_id, lang, source, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Pop' ELSE 'Grouped' END AS split FROM documents)
SELECT question_id, arg_min(lang, (split, doc_id)) AS template, list_sort(list(DISTINCT source)) AS datasets, CASE WHEN count(DISTINCT split) > 1 THEN 'both' ELSE min(split) END AS source, count(*) AS cases,
arg_min(CASE WHEN doc_id % 3 = 0 THEN lang END, (split, doc_id)) FILTER (doc_id % 3 = 0) AS option FROM k GROUP BY question_id""")
def catalog_dedup(t: Tables):
    k = F.col("doc_id")
    options = F.when(k % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    rows = t.documents.select(F.md5(F.col("text").cast("binary")).alias("question_id"), F.col("lang").alias("input_template"), options.alias("options"), F.col("source").alias("dataset_name"), F.when(k % 2 == 0, "Pop").otherwise("Grouped").alias("split"), k.alias("ord"))
    return groups.catalog(rows).select("question_id", "template", "datasets", "source", "cases", F.get("options", F.lit(0)).alias("option"))


@R.add("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(trim(b.text)) > 0")
def leak_containment(t: Tables):
    # blank to the SQL is what has space separators only
    needles = t.benchmark.filter(F.col("text").rlike(r"[^\p{Zs}]")).select("item_id", F.col("text").alias("needle"))
    return r.contained(t.documents.select("doc_id", "text"), needles, "text", "needle").select("item_id", "doc_id")


@R.add("""SELECT sha256('{"c_acctbal":"' || printf('%.2f', c_acctbal) || '","c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '"}') AS hash, c_custkey FROM customer""")
def canonical_row_hash(t: Tables):
    rows = t.customer.select("c_custkey", "c_name", F.format_string("%.2f", "c_acctbal").alias("c_acctbal"))
    return rows.select(canonical_hash("c_name", "c_custkey", "c_acctbal").alias("hash"), "c_custkey")


@R.add("""(SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def union_intersect_except(t: Tables):
    keys = lambda p: t.orders.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    return keys("1-URGENT").intersect(keys("5-LOW")).subtract(t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@R.add("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'a' ELSE 'b' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def key_set_difference(t: Tables):
    return r.key_difference(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k")), ["k"])


@R.add("""WITH a AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS n, count(*) FILTER (event_id % 2 = 1) AS m FROM events GROUP BY ALL)
SELECT count(*) FILTER (n = m) AS equal, count(*) FILTER (n <> m) AS differ FROM a WHERE n > 0 AND m > 0""")
def wave_audit(t: Tables):
    side = lambda x: t.events.filter(F.col("event_id") % 2 == x).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return r.audit_equal(side(0), side(1), ["user_id", "event_type"], "n")


@R.add("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rk FROM n)
SELECT user_id, event_type, n, CAST(rk AS INT) AS rk FROM k WHERE rk <= 2""")
def topk_users(t: Tables):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("rk", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("rk <= 2")


@R.add("""WITH c AS (SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 100) SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id""")
def limited_cases(t: Tables):
    some, _ = r.limited(t.conversations.select("conv_id", "turn"), t.conversations.select("conv_id").distinct(), "conv_id", ["conv_id", "turn"], 100)
    return some.groupBy("conv_id").agg(F.count("*").alias("n"))


@R.add("""WITH x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Pop' ELSE 'Grouped' END AS split, lang, doc_id FROM documents)
SELECT doc_id, split || ':' || lang || ':' || printf('%05d', row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) AS case_id FROM x""")
def case_ids(t: Tables):
    rows = t.documents.select(F.when(F.col("doc_id") % 2 == 0, "Pop").otherwise("Grouped").alias("split"), F.col("lang").alias("dataset_name"), F.lit("q").alias("input_template"), F.col("doc_id").alias("ord"), F.map_from_arrays(F.array(F.lit("lang")), F.array("lang")).alias("variables"))
    return groups.cases(rows).select(F.col("ord").alias("doc_id"), "case_id")


@R.add("SELECT lang AS dataset, count(*) FILTER (doc_id % 2 = 0) AS pop, count(*) FILTER (doc_id % 2 = 1) AS grouped, count(*) AS total FROM documents GROUP BY lang")
def breakdown(t: Tables):
    return groups.breakdown(t.documents.select(F.col("lang").alias("dataset"), F.when(F.col("doc_id") % 2 == 0, "pop").otherwise("grouped").alias("split")), "dataset", ["pop", "grouped"])


@R.add("SELECT lang AS question_id, count(*) AS rows FROM documents WHERE lang <> 'en' GROUP BY lang")
def unknown_questions(t: Tables):
    return groups.unknown_questions(t.documents.select(F.col("lang").alias("question_id")), t.spark.createDataFrame([("en",)], "question_id string"))


@R.add("SELECT min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, count(DISTINCT text) AS texts FROM documents")
def card_lengths(t: Tables):
    return text_statistics(t.documents, "text").withColumn("mean", F.round("mean", 6))
