"""Metric queries: F rows of lineitem stand for humans, O rows for a model, brands for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators import metrics as m
from canvass.plans import scoring
from canvass.queries.base import Registry, Tables

R = Registry()


def _is(status: str):
    return F.col("l_linestatus") == status


def _lines(t: Tables):
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


_BRAND_LABELS = """
c AS (SELECT p_brand AS item, l_returnflag AS label, count(*) FILTER (l_linestatus = 'F') AS h, count(*) FILTER (l_linestatus = 'O') AS m
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus IN ('F', 'O') GROUP BY ALL),
s AS (SELECT *, sum(h) OVER w AS hn, sum(m) OVER w AS mn, max(h) OVER w AS hx, max(m) OVER w AS mx FROM c WINDOW w AS (PARTITION BY item)),
tt AS (SELECT item, sum(abs(h / hn - m / mn)) / 2 AS tvd, max(CASE WHEN h = hx AND m = mx THEN 1 ELSE 0 END) AS top1 FROM s WHERE hn > 0 AND mn > 0 GROUP BY item)
"""


@R.add(f"WITH {_BRAND_LABELS} SELECT item, round(tvd, 6) AS tvd, top1 FROM tt")
def item_tvd_top1(t: Tables):
    counts = m.label_counts(_lines(t).withColumnRenamed("p_brand", "item"), ["item"], "l_returnflag", _is("F"), _is("O"))
    return m.tvd_top1(counts, ["item"]).select("item", F.round("tvd", 6).alias("tvd"), "top1")


@R.add(f"WITH {_BRAND_LABELS} SELECT round(avg(tvd), 6) AS mean_tvd, round(avg(top1), 6) AS mean_top1, count(*) AS items FROM tt")
def mean_tvd(t: Tables):
    counts = m.label_counts(_lines(t).withColumnRenamed("p_brand", "item"), ["item"], "l_returnflag", _is("F"), _is("O"))
    return m.tvd_top1(counts, ["item"]).agg(F.round(F.avg("tvd"), 6).alias("mean_tvd"), F.round(F.avg("top1"), 6).alias("mean_top1"), F.count("*").alias("items"))


_SEGMENT = """
c AS (SELECT c_mktsegment AS segment, o_orderpriority AS label, count(*) FILTER (o_orderstatus = 'F') AS h, count(*) FILTER (o_orderstatus <> 'F') AS m
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT *, h / sum(h) OVER w AS p, m / sum(m) OVER w AS q FROM c WINDOW w AS (PARTITION BY segment))
"""


def _segments(t: Tables):
    rows = t.orders.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    return m.label_counts(rows, ["segment"], "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F")


@R.add(f"WITH {_SEGMENT} SELECT segment, round(sum(abs(p - q)) / 2, 6) AS tvd FROM s GROUP BY segment")
def subgroup_tvd(t: Tables):
    return m.tvd_top1(_segments(t), ["segment"]).select("segment", F.round("tvd", 6).alias("tvd"))


@R.add(f"""WITH {_SEGMENT}, d AS (SELECT segment, abs(sum(p) OVER w - sum(q) OVER w) AS gap FROM s WINDOW w AS (PARTITION BY segment ORDER BY label ROWS UNBOUNDED PRECEDING))
SELECT segment, round(sum(gap), 6) AS wasserstein, round(max(gap), 6) AS ks, round(1 - sum(gap) / (count(*) - 1), 6) AS alignment FROM d GROUP BY segment""")
def wasserstein_ks(t: Tables):
    return m.ordered_distances(_segments(t), ["segment"]).select("segment", *(F.round(c, 6).alias(c) for c in ("wasserstein", "ks", "alignment")))


@R.add(f"WITH {_SEGMENT} SELECT segment, round(CASE WHEN stddev_pop(p) > 1e-12 AND stddev_pop(q) > 1e-12 THEN covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) END, 6) AS r FROM s GROUP BY segment")
def distribution_correlation(t: Tables):
    return m.share_correlation(_segments(t), ["segment"]).select("segment", F.round("r", 6).alias("r"))


@R.add("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS h, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS m FROM events GROUP BY ALL),
s AS (SELECT user_id, h / nullif(sum(h) OVER w, 0) AS p, m / nullif(sum(m) OVER w, 0) AS q FROM c WINDOW w AS (PARTITION BY user_id)),
x AS (SELECT user_id, p, q, (p + q) / 2 AS mid FROM s WHERE p IS NOT NULL AND q IS NOT NULL)
SELECT user_id, round(sum(CASE WHEN p > 0 THEN p * log2(p / mid) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / mid) ELSE 0 END) / 2, 6) AS jsd FROM x GROUP BY user_id""")
def jsd_by_user(t: Tables):
    early = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    counts = m.label_counts(t.events, ["user_id"], "event_type", early, ~early)
    return m.jensen_shannon(counts, ["user_id"]).select("user_id", F.round("jsd", 6).alias("jsd"))


_PEARSON = "SELECT p_brand AS item, covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


@R.add(f"WITH x AS ({_PEARSON}) SELECT item, round(r, 6) AS r FROM x")
def item_pearson(t: Tables):
    return _lines(t).groupBy(F.col("p_brand").alias("item")).agg(F.round(m.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@R.add(f"WITH x AS ({_PEARSON}) SELECT round(tanh(avg(atanh(least(greatest(r, -1 + 1e-12), 1 - 1e-12)))), 6) AS pooled_r FROM x WHERE r IS NOT NULL AND isfinite(r)")
def fisher_pooled_corr(t: Tables):
    per = _lines(t).groupBy("p_brand").agg(m.pearson("l_quantity", "l_extendedprice").alias("r"))
    return per.agg(F.round(m.fisher_mean(F.col("r")), 6).alias("pooled_r"))


@R.add("""SELECT p_brand AS item, round((avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F')) / nullif(stddev_pop(l_quantity) FILTER (l_linestatus = 'F'), 0), 6) AS glass_delta,
round(stddev_pop(l_quantity) FILTER (l_linestatus = 'O') / nullif(stddev_pop(l_quantity) FILTER (l_linestatus = 'F'), 0), 6) AS sd_ratio
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def glass_sd_ratio(t: Tables):
    sides = _lines(t).select("p_brand", F.when(_is("F"), F.col("l_quantity")).alias("h"), F.when(_is("O"), F.col("l_quantity")).alias("o"))
    return sides.groupBy(F.col("p_brand").alias("item")).agg(F.round(m.glass_delta("h", "o"), 6).alias("glass_delta"), F.round(m.sd_ratio("h", "o"), 6).alias("sd_ratio"))


@R.add("""SELECT p_brand AS item, round(avg(abs(l_linenumber - l_quantity / 7)), 6) AS mae, round(avg((l_linenumber - l_quantity / 7) * (l_linenumber - l_quantity / 7)), 6) AS mse,
round(avg(1 - abs(l_linenumber - l_quantity / 7) / 6), 6) AS accuracy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def ordinal_mae_mse_acc(t: Tables):
    x, y = F.col("l_linenumber").cast("double"), F.col("l_quantity") / 7
    return _lines(t).groupBy(F.col("p_brand").alias("item")).agg(*(F.round(c, 6).alias(n) for c, n in ((m.ordinal_mae(x, y), "mae"), (m.mean_squared_error(x, y), "mse"), (m.ordinal_accuracy(x, y, F.lit(6.0)), "accuracy"))))


@R.add("""WITH l AS (SELECT p_brand AS item, l_linestatus = 'F' AS human, l_extendedprice / 1000 AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT item, CAST(round_even(v, 0) AS BIGINT) AS code, max(human::INT) AS h, max((NOT human)::INT) AS m FROM l GROUP BY ALL),
cv AS (SELECT item, sum(h * m) / nullif(sum(h), 0) AS coverage FROM c GROUP BY item),
sp AS (SELECT item, max(v) FILTER (human) - min(v) FILTER (human) AS hs, max(v) FILTER (NOT human) - min(v) FILTER (NOT human) AS ms FROM l GROUP BY item)
SELECT item, round(coverage, 6) AS coverage, round(CASE WHEN hs = 0 THEN CASE WHEN ms = 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, ms / hs) END, 6) AS span_ratio FROM cv JOIN sp USING (item)""")
def amplitude(t: Tables):
    rows = _lines(t).select(F.col("p_brand").alias("item"), "l_linestatus", (F.col("l_extendedprice") / 1000).alias("v"))
    return m.amplitude(rows, ["item"], "v", _is("F")).select("item", F.round("coverage", 6).alias("coverage"), F.round("span_ratio", 6).alias("span_ratio"))


@R.add("""WITH n AS (SELECT user_id % 5 AS model, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT model, event_type, n / sum(n) OVER (PARTITION BY model) AS v FROM n),
p AS (SELECT event_type, var_pop(v) AS vp, stddev_pop(v) AS sp FROM s GROUP BY event_type)
SELECT round(avg(vp), 9) AS mean_variance, round(avg(sp), 6) AS mean_std, round(max(sp), 6) AS max_std FROM p""")
def cross_model_variance(t: Tables):
    from pyspark.sql.window import Window as W

    n = t.events.groupBy((F.col("user_id") % 5).alias("model"), "event_type").count()
    v = n.withColumn("v", F.col("count") / F.sum("count").over(W.partitionBy("model")))
    out = m.cross_model_variance(v, "event_type", "v")
    return out.select(F.round("mean_variance", 9).alias("mean_variance"), F.round("mean_std", 6).alias("mean_std"), F.round("max_std", 6).alias("max_std"))


@R.add("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), i AS (SELECT sum(v) AS iv, count(*) AS k FROM (SELECT var_samp(n) AS v FROM g GROUP BY event_type)),
p AS (SELECT var_samp(x) AS tv, count(*) AS n FROM (SELECT sum(n) AS x FROM g GROUP BY user_id))
SELECT round(k / (k - 1) * (1 - iv / nullif(tv, 0)), 6) AS alpha, k, n FROM i, p""")
def cronbach(t: Tables):
    grid = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return m.cronbach_alpha(grid, "user_id", "event_type", "n").select(F.round("alpha", 6).alias("alpha"), "k", "n")


@R.add("""WITH p AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS h, CAST(1 + o_orderkey % 5 AS INT) AS m FROM orders),
c AS (SELECT h, m, count(*) AS n FROM p WHERE h BETWEEN 1 AND 5 AND m BETWEEN 1 AND 5 GROUP BY ALL), a AS (SELECT h, sum(n) AS x FROM c GROUP BY h), b AS (SELECT m, sum(n) AS y FROM c GROUP BY m),
t AS (SELECT sum(n) AS total FROM c), o AS (SELECT sum(n * (h - m) * (h - m)) AS obs FROM c), e AS (SELECT sum(x * y * (h - m) * (h - m)) AS ex FROM a, b)
SELECT CAST(total AS BIGINT) AS n, round(1 - obs / nullif(ex / total, 0), 6) AS kappa FROM t, o, e""")
def qwk(t: Tables):
    pairs = t.orders.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("h"), (1 + F.col("o_orderkey") % 5).alias("m"))
    return m.quadratic_weighted_kappa(pairs, "m", "h", 5).select("n", F.round("kappa", 6).alias("kappa"))


_EFFECT = """e AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY event_type)"""


def _effect(t: Tables):
    early = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    return t.events.groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b"))


@R.add(f"WITH {_EFFECT} SELECT event_type, round(abs(a - b), 6) AS error FROM e")
def treatment_effect(t: Tables):
    return _effect(t).select("event_type", F.round(F.abs(F.col("a") - F.col("b")), 6).alias("error"))


@R.add(f"WITH {_EFFECT} SELECT event_type, round(CASE WHEN b = 0 THEN CASE WHEN a = b THEN 100.0 ELSE 0.0 END ELSE least(100.0, greatest(0.0, 100 * (1 - abs(a - b) / abs(b - 0)))) END, 6) AS closeness FROM e")
def closeness(t: Tables):
    return _effect(t).select("event_type", F.round(m.closeness(F.col("a"), F.col("b"), F.lit(0.0)), 6).alias("closeness"))


@R.add("SELECT count(*) AS n, count(*) FILTER (quality = (n_chars > 400)::INT) AS hits, round(avg((quality = (n_chars > 400)::INT)::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id)")
def exact_match_accuracy(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("rule", (F.col("n_chars") > 400).cast("int"))
    same = F.col("quality") == F.col("rule")
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("hits"), F.round(m.accuracy(F.col("quality"), F.col("rule")), 6).alias("accuracy"))


@R.add("""WITH l AS (SELECT p_brand AS item, CAST(l_linenumber AS DOUBLE) AS human, CAST(1 + l_orderkey % 7 AS DOUBLE) AS model FROM lineitem JOIN part ON l_partkey = p_partkey),
i AS (SELECT item, greatest(max(human), max(model)) - least(min(human), min(model)) AS span, avg(abs(human - model)) AS mae, covar_pop(human, model) / nullif(stddev_pop(human) * stddev_pop(model), 0) AS r,
 (avg(model) - avg(human)) / nullif(stddev_pop(human), 0) AS g, stddev_pop(model) / nullif(stddev_pop(human), 0) AS sd, avg(human) AS hm, avg(model) AS mm FROM l GROUP BY item)
SELECT count(*) AS items, round(avg(1 - mae / span), 6) AS ordinal_accuracy, round(tanh(avg(atanh(r))), 6) AS pooled_r, count(*) FILTER (r IS NULL) AS skipped_zero_var_corr,
round(avg(g), 6) AS glass_delta, round(avg(sd), 6) AS sd_ratio, round(avg(hm), 6) AS human_mean, round(avg(mm), 6) AS model_mean FROM i WHERE span > 0""")
def coded_metrics(t: Tables):
    codes = _lines(t).select(F.col("p_brand").alias("item"), F.col("l_linenumber").cast("double").alias("human"), (1 + F.col("l_orderkey") % 7).cast("double").alias("model"), F.lit(None).cast("double").alias("span"))
    out = m.coded_summary(codes)
    return out.select("items", *(c if c == "skipped_zero_var_corr" else F.round(c, 6).alias(c) for c in out.columns if c != "items"))


@R.add("""WITH x AS (SELECT p_brand AS item, l_linestatus AS method, avg(l_discount) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT item, round(max(v) FILTER (method = 'F'), 6) AS base_v, round(max(v) FILTER (method = 'O'), 6) AS other_v, round(max(v) FILTER (method = 'O') - max(v) FILTER (method = 'F'), 6) AS delta_v FROM x GROUP BY item""")
def compare_delta(t: Tables):
    table = _lines(t).groupBy(F.col("p_brand").alias("item"), F.col("l_linestatus").alias("method")).agg(F.avg("l_discount").alias("v"))
    out = scoring.compare(table, ["item"], "method", "F", "O", ["v"])
    return out.select("item", F.round("F_v", 6).alias("base_v"), F.round("O_v", 6).alias("other_v"), "delta_v")
