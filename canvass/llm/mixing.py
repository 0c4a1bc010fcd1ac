"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they
belong to). A flow network routes word capacity from patterns to source
quotas: every pattern has one arc for each repetition of its documents, the
later ones dearer (a convex cost), and an arc to each of its sources; each
source has an arc of its quota. Only the aggregated network is solved on the
driver; its size follows the number of patterns and sources. Documents are
then selected in a seeded order that Spark computes: running sums over seeded
buckets, then within a bucket, so that no task holds a whole source. A
document that straddles the end of its share is passed over, and the following
ones that fit go on, again by running sums, until no document with a copy left
fits what is left of any quota.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; documents with no source at all take 0;
repeated rows are documents of their own; an empty table gives no rows; extra
columns are kept by `mix` and never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.llm.common import Scratch

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), Fraction(3, 2), 2, 42
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> dict[str | None, Fraction]:
    """Targets by weight in code-point order, null last; none above cap times its source, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximum flow, by shortest augmenting paths with potentials."""
    n = 1 + max([source, sink, *(x for a in arcs for x in a[:2])])
    out: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for u, v, capacity, price in arcs:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            out[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
    potential = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, source)]
        far[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                v, x = to[e], d + cost[e] + potential[u] - potential[to[e]]
                if room[e] and (far[v] is None or x < far[v]):
                    far[v], via[v] = x, e
                    heapq.heappush(heap, (x, v))
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        reach = max(x for x in far if x is not None)
        potential = [p + (reach if x is None else x) for p, x in zip(potential, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def route(patterns: list[tuple[tuple[str | None, ...], int]], targets: dict[str | None, Fraction], cap: int = CAP) -> list[tuple[int, int, str | None, int]]:
    """(pattern index, repetition, source, words) with words > 0; repetition r of a document costs r."""
    names = list(targets)
    at = {s: 2 + i for i, s in enumerate(names)}
    first = 2 + len(names)
    arcs = [(at[s], 1, int(targets[s]), 0) for s in names]
    copies, links = [], []
    for i, (members, size) in enumerate(patterns):
        for r in range(cap):
            copies.append((len(arcs), i, r))
            arcs.append((0, first + i, size, r))
        for s in members:
            links.append((len(arcs), i, s))
            arcs.append((first + i, at[s], cap * size, 0))
    flow = min_cost_flow(arcs, 0, 1)
    room: dict[int, list[list[int]]] = {}
    for e, i, r in copies:
        room.setdefault(i, []).append([r, flow[e]])
    out = []
    for e, i, s in links:
        need = flow[e]
        for lane in room.get(i, []):
            if part := min(need, lane[1]):
                out.append((i, lane[0], s, part))
                lane[1] -= part
                need -= part
    return out


def mix(docs: DataFrame, size: Column, members: Column, *, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs with `size`, `source_size`, `target` (of the first member) and `taken`, the words the mix takes of each document.

    members: an array of source names, in which a null is a source too.
    Documents are taken whole, 0 to `cap` times. What whole documents leave of
    a quota is filled by others, until none that may still be taken fits it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    names = F.array_sort(F.array_distinct(members))
    base = docs.withColumns({"__size": size, "__members": names})
    base = base.withColumn("__key", F.coalesce(F.array_join(F.transform("__members", lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit(""))), "\x1f"), F.lit("\x1f")))
    # a stable order: equal rows are alike, so any order among them gives the same result
    base = base.withColumn("__rank", F.xxhash64(F.lit(seed), F.col(key), "__size", "__members"))
    base = scratch.cut(base, "sized")
    found = base.groupBy("__key").agg(F.first("__members").alias("members"), F.sum("__size").alias("size"), F.count("*").alias("n")).collect()
    patterns = sorted(((tuple(r["members"] or ()), int(r["size"]), r["n"], r["__key"]) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict[str | None, int] = {}
    for got, words, *_ in patterns:
        for s in got:
            sizes[s] = sizes.get(s, 0) + words
    targets = quotas(sizes, weights, share, cap)
    lanes = route([p[:2] for p in patterns], targets, cap)

    where, rows = {}, []
    for i, r, s, part in lanes:
        start = where.get((i, r), 0)
        where[i, r] = start + part
        rows.append((i, r, f"{len(rows)}", start, start + part))
    numbered = spark.createDataFrame([(i, p[3]) for i, p in enumerate(patterns)], "__pattern int, __key string")
    lane = spark.createDataFrame(rows, "__pattern int, __copy int, __lane string, __from long, __to long")
    buckets = max(16, max((p[2] for p in patterns), default=0) // 20_000)
    rank = base.select(key, "__rank", "__size", "__key", F.pmod("__rank", F.lit(buckets)).cast("int").alias("__bucket"))
    # one row for each pattern or lane, from the driver's own list: broadcast while that is short
    small = (lambda df: F.broadcast(df)) if len(patterns) + len(rows) <= BROADCAST_ROWS else (lambda df: df)
    rank = rank.join(small(numbered), "__key").drop("__key")
    sums = rank.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("__sum"))
    before = sums.select("__pattern", "__bucket", (F.sum("__sum").over(W.partitionBy("__pattern").orderBy("__bucket")) - F.col("__sum")).alias("__before"))
    inside = W.partitionBy("__pattern", "__bucket").orderBy("__rank", key, "__size")
    placed = rank.withColumn("__n", F.row_number().over(inside)).withColumn("__sum", F.sum("__size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(before, ["__pattern", "__bucket"]).withColumn("__end", F.col("__before") + F.col("__sum"))
    placed = scratch.cut(placed.select(key, "__rank", "__size", "__pattern", "__n", "__bucket", "__end"), "placed")
    offers = placed.filter("__size > 0").join(small(lane.groupBy("__pattern").agg(F.collect_list(F.struct("__copy", "__lane", "__from", "__to")).alias("__lanes"))), "__pattern", "left")
    begin = F.col("__end") - F.col("__size")
    offers = offers.withColumn("__in", F.filter("__lanes", lambda x: (x["__from"] <= begin) & (F.col("__end") <= x["__to"])))
    offers = scratch.cut(offers.select("__pattern", "__bucket", "__n", "__size", F.when(F.col("__in").isNull(), 0).otherwise(F.size("__in")).alias("__copies"), F.transform("__in", lambda x: x["__lane"]).alias("__in")), "offers")

    # what whole documents and the ends of lanes left of each quota
    got = {r["lane"]: r["s"] for r in offers.select(F.explode("__in").alias("lane"), "__size").groupBy("lane").agg(F.sum("__size").alias("s")).collect()}
    gap = {s: int(t) for s, t in targets.items()}
    for (_, _, s, _), x in zip(lanes, rows, strict=True):
        gap[s] -= got.get(x[2], 0)
    more = _fill(scratch, offers, [p[0] for p in patterns], gap, cap).groupBy("__pattern", "__bucket", "__n").agg(F.count("*").alias("__more"))
    copies = offers.select("__pattern", "__bucket", "__n", "__copies")
    taken = placed.join(copies, ["__pattern", "__bucket", "__n"], "left").join(more, ["__pattern", "__bucket", "__n"], "left")
    taken = taken.withColumn("__taken", F.col("__size") * (F.coalesce("__copies", F.lit(0)) + F.coalesce("__more", F.lit(0))))
    return _with_sources(_attach(base, taken, key), sizes, targets).drop("__rank", "__members", "__key")


def _fill(scratch: Scratch, offers: DataFrame, members: list[tuple[str | None, ...]], gap: dict[str | None, int], cap: int) -> DataFrame:
    """The copies (__pattern, __bucket, __n, __copy) that fill gaps of sources, so that no copy left fits what is left of a gap.

    Each pass takes, in seeded order, the copies that fit the gap up to the
    first that would go over it; that one no longer fits the next time. Of
    sources with a pattern in common one takes its turn at a time.
    """
    spark = offers.sparkSession
    shape = "__pattern int, __bucket int, __n int, __copy int"
    # the second copy of a document comes after the first ones of all
    free = offers.filter(F.col("__copies") < cap).select("__pattern", "__bucket", "__n", "__size", F.explode(F.sequence(F.col("__copies"), F.lit(cap - 1))).alias("__copy"))
    of: dict[str | None, list[int]] = {}
    for i, names in enumerate(members):
        for s in names:
            of.setdefault(s, []).append(i)
    gap = dict(gap)
    waiting = [s for s in gap if gap[s] > 0]
    taken = spark.createDataFrame([], shape)
    passes = 0
    while waiting:
        turn: dict[int, int] = {}
        now = []
        for s in waiting:
            if not any(i in turn for i in of[s]):
                turn |= dict.fromkeys(of[s], len(now))
                now.append(s)
        asks = spark.createDataFrame([(i, k, gap[now[k]]) for i, k in turn.items()], "__pattern int, __ask int, __gap long")
        fits = free.join(F.broadcast(asks) if len(turn) <= BROADCAST_ROWS else asks, "__pattern").filter("__size <= __gap").join(taken, ["__pattern", "__bucket", "__n", "__copy"], "left_anti")
        sums = fits.groupBy("__ask", "__copy", "__bucket").agg(F.sum("__size").alias("__sum"))
        before = sums.select("__ask", "__copy", "__bucket", (F.sum("__sum").over(W.partitionBy("__ask").orderBy("__copy", "__bucket")) - F.col("__sum")).alias("__before"))
        inside = W.partitionBy("__ask", "__copy", "__bucket").orderBy("__n", "__pattern").rowsBetween(W.unboundedPreceding, 0)
        chosen = fits.join(before, ["__ask", "__copy", "__bucket"]).filter("__before < __gap").withColumn("__end", F.col("__before") + F.sum("__size").over(inside)).filter("__end <= __gap")
        chosen = scratch.cut(chosen.select("__pattern", "__bucket", "__n", "__copy", "__ask", "__size"), f"fill{passes}")
        used = {now[r["__ask"]]: r["s"] for r in chosen.groupBy("__ask").agg(F.sum("__size").alias("s")).collect()}
        taken = taken.union(chosen.select(taken.columns))
        passes += 1
        # a source that found nothing never will: gaps and copies only shrink
        gap |= {s: gap[s] - n for s, n in used.items()}
        waiting = [s for s in waiting if s not in now] + [s for s in now if s in used and gap[s] > 0]
    return taken


def _attach(base: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of base with what is taken of them; equal rows are dealt their shares in order."""
    same = W.partitionBy(key, "__rank").orderBy("__size")
    right = taken.select(key, "__rank", F.row_number().over(W.partitionBy(key, "__rank").orderBy(F.desc("__taken"))).alias("__i"), F.col("__taken").alias("taken"))
    left = base.withColumn("__i", F.row_number().over(same))
    on = left[key].eqNullSafe(right[key]) & (left["__rank"] == right["__rank"]) & (left["__i"] == right["__i"])
    return left.join(right, on, "left").select(*(left[c] for c in base.columns), F.coalesce(right["taken"], F.lit(0)).alias("taken"))


def _with_sources(df: DataFrame, sizes: dict, targets: dict) -> DataFrame:
    facts = df.sparkSession.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes], "__source string, source_size long, target double")
    one = F.when(F.size("__members") > 0, F.element_at("__members", 1))
    joined = df.withColumn("__one", one).join(facts, one.eqNullSafe(F.col("__source")) & (F.size("__members") > 0), "left")
    return joined.drop("__source", "__one").withColumnRenamed("__size", "size")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, each in its one source."""
    from canvass.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(sized, F.col("words"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")
