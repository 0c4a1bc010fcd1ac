"""Sizes, quotas, draws and reports on samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators import sampling as s
from canvass.plans import report
from canvass.queries.base import Registry, Tables

R = Registry()


@R.add("""WITH c AS (SELECT c_mktsegment AS level, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n) AS total FROM c),
b AS (SELECT level, n, CAST(84 * n // total AS BIGINT) AS base, 84 * n % total AS over FROM c, t), l AS (SELECT 84 - sum(base) AS rest FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY over DESC, level) AS rk FROM b) SELECT level, n, CAST(base + (rk <= rest)::INT AS BIGINT) AS seats FROM r, l""")
def hamilton_seats(t: Tables):
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("level")).agg(F.count("*").alias("n"))
    return s.hamilton(counts, "level", "n", 84)


@R.add("""WITH h AS (SELECT c_custkey, c_mktsegment, sha256('42' || chr(10) || 'demo' || chr(10) || c_mktsegment || chr(10) || CAST(c_custkey AS VARCHAR)) AS h FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS rk FROM h)
SELECT c_custkey, c_mktsegment, sha256('42' || chr(10) || 'demo' || chr(10) || 'selected' || chr(10) || CAST(c_custkey AS VARCHAR)) AS draw_order FROM k WHERE rk <= 5""")
def stratified_draw(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    seats = rows.select("c_mktsegment").distinct().withColumn("seats", F.lit(5))
    return s.stratified_draw(rows, ["c_mktsegment"], "c_custkey", seats, 42, "demo")


_SHARES = """c AS (SELECT c_mktsegment AS income, count(*) AS population FROM customer GROUP BY ALL), t AS (SELECT sum(population) AS total FROM c),
b AS (SELECT income, population, CAST(50 * population // total AS BIGINT) AS base, 50 * population % total AS over FROM c, t), l AS (SELECT 50 - sum(base) AS rest FROM b),
r AS (SELECT income, population, CAST(base + (row_number() OVER (ORDER BY over DESC, income) <= rest)::INT AS BIGINT) AS selected FROM b, l)"""


def _shares(t: Tables):
    return s.by_shares(t.customer.select("c_custkey", F.col("c_mktsegment").alias("income")), "income", "c_custkey", 50, 9, "jobs")


@R.add(f"""WITH {_SHARES}, k AS (SELECT c_custkey, c_mktsegment AS income, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('9' || chr(10) || 'jobs' || chr(10) || c_mktsegment || chr(10) || CAST(c_custkey AS VARCHAR)), c_custkey) AS rk FROM customer)
SELECT c_custkey, income FROM k JOIN r USING (income) WHERE rk <= selected""")
def share_sample(t: Tables):
    return _shares(t)[0].select("c_custkey", "income")


@R.add(f"WITH {_SHARES} SELECT income, population, selected, 50 AS n, 9 AS seed FROM r")
def share_facts(t: Tables):
    return _shares(t)[1]


@R.add("""WITH x AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS population, count(*) FILTER (o_orderkey % 7 = 0) AS sample FROM orders GROUP BY ALL)
SELECT 'a' AS axis, a AS level, sum(population) AS population, sum(sample) AS sample FROM x GROUP BY a UNION ALL SELECT 'b', b, sum(population), sum(sample) FROM x GROUP BY b""")
def axis_totals(t: Tables):
    cells = t.orders.groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("population"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("sample"))
    return s.axis_totals(cells, ["a", "b"], ["population", "sample"])


@R.add()
def two_margin_allocation(t: Tables):
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.allocate_two_margins(people.select(F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region")), "segment", "region", 60)


@R.add("""WITH n AS (SELECT 'customer' AS name, count(*) AS population FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier)
SELECT name, population, least(population, (97 * population + population + 95) // (population + 96)) AS n FROM n""")
def planned_size(t: Tables):
    counts = {name: getattr(t, name).count() for name in ("customer", "part", "supplier")}
    return t.spark.createDataFrame([(k, v, s.planned_size(v)) for k, v in counts.items()], "name string, population long, n long")


@R.add("""WITH u AS (SELECT c_custkey, c_acctbal, greatest(c_acctbal, 0) AS w, (CAST(('0x' || substr(sha256('7' || chr(10) || CAST(c_custkey AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM customer)
SELECT c_custkey, c_acctbal FROM u WHERE w > 0 ORDER BY ln(u) / w DESC LIMIT 50""")
def weighted_draw(t: Tables):
    return s.weighted_draw(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", F.col("c_acctbal"), 50, 7)


_SHARE = "CAST((n * 200000000 + d) // (2 * d) - (CASE WHEN (n * 200000000 + d) % (2 * d) = 0 AND ((n * 200000000 + d) // (2 * d)) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT)"
_COUNTS = """l AS (SELECT 'segment' AS field, c_mktsegment AS value, c_custkey % 11 = 0 AS s FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), c_custkey % 11 = 0 FROM customer),
c AS (SELECT field, value, count(*) AS population, count(*) FILTER (s) AS sample FROM l GROUP BY ALL),
t AS (SELECT *, CAST(sum(population) OVER w AS BIGINT) AS pn, CAST(sum(sample) OVER w AS BIGINT) AS sn FROM c WINDOW w AS (PARTITION BY field))"""


def _fields(t: Tables):
    rows = t.customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 11 == 0).alias("s"))
    return report.field_report(rows, ["segment", "nation"], "s")


@R.add(f"WITH {_COUNTS} SELECT field, value, population, sample, {_SHARE.replace('n *', 'population *').replace(' d', ' pn').replace('* d', '* pn')} AS population_share, {_SHARE.replace('n *', 'sample *').replace(' d', ' sn').replace('* d', '* sn')} AS sample_share FROM t")
def margin_report(t: Tables):
    return _fields(t)


@R.add(f"WITH {_COUNTS} SELECT field, round(max(abs(population / pn - sample / sn)), 6) AS largest, round(sum(abs(population / pn - sample / sn)) / 2, 6) AS tvd FROM t GROUP BY field")
def margin_distances(t: Tables):
    return report.field_distances(_fields(t)).select("field", F.round("largest", 6).alias("largest"), F.round("tvd", 6).alias("tvd"))


@R.add("SELECT CAST(p_size // 10 * 10 AS VARCHAR) || '-' || CAST(p_size // 10 * 10 + 9 AS VARCHAR) AS decade, count(*) AS n FROM part GROUP BY ALL")
def decade_bins(t: Tables):
    return t.part.groupBy(report.decade("p_size").alias("decade")).agg(F.count("*").alias("n"))


@R.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority))")
def grouping_sets_strata(t: Tables):
    sets = [[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderstatus")], [F.col("o_orderpriority")]]
    return t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@R.add()
def outer_draws(t: Tables):
    """buy or skip for each event by its clamped value, seeded by user and event."""
    e = t.events.select("event_id", F.col("user_id").cast("string").alias("u"), F.col("event_id").cast("string").alias("i"), (F.col("value") % 1).alias("p"))
    return e.select("event_id", s.clamp_prob(F.col("p")).alias("p"), s.outer_price(F.col("p"), 42, F.col("u"), F.col("i")).alias("answer"))
