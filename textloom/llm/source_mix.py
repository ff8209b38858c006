"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document belongs to one source or to several. Documents are aggregated by pattern (the set of
their sources), and tokens flow from patterns to the quotas of the sources. A pattern can give its
tokens once at cost 0, a second time at cost 1 and so on up to the allowed repeats, so the costs
are convex: repetition is used only where distinct text is used up. Costs sit on the arcs out of the
start alone, hence shortest augmenting paths by level give the min-cost maximum flow. Then documents
are selected in a seeded order: every document is taken as often as its pattern is repeated in full,
and once more if it lies in the part that is begun.

Sizes, places and targets of the sources are computed in Spark, however many there are. A source that
stands alone in its pattern needs no flow: it takes its quota, up to the repeats. The flow works on one
row for each pattern that meets others at a source. No path leads from one connected component of
patterns and sources to another, so the flow runs for each component by itself, in tasks, whatever
the number of patterns; the patterns (not the documents) of one component meet in one task. The seeded
selection sums sizes by pattern and bucket of the hash first, so only the documents of the one
bucket where a pattern's part ends pass a window, however large the pattern is. Documents with more
than 1/LARGE of their pattern's tokens (fewer than LARGE) are selected before the others, their share
of the part, and what they miss or exceed it by is left to the others, so a pattern's part is met to
1/(2 LARGE) of its tokens.

* null text: size 0; documents of size 0 take 0;
* null source: a source of its own, last in order; an empty list of sources or null: never taken;
* repeated rows: taken each by itself; equal rows are interchangeable; rows of one size whose ids are
  null or equal share a place in the seeded order and are taken or left together, except where the
  order decides by the id;
* empty table: empty result; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.graph import connected_components
from textloom.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns of overlapping sources for each part that flows are dealt to, and sources of a range; no result depends on them.
MAX_PATTERNS, RANGE = 100_000, 1_000_000
#: Buckets of a pattern's seeded order.
BUCKETS = 1 << 12
LARGE = 200


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is shared again."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / whole > cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / whole
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            rest -= target[i]
        open_ -= full
    return target


def routed(patterns: list[tuple[list[int], int]], quotas: list[int], repeats: int) -> list[int]:
    """Tokens taken of each pattern (its sources, its tokens) by a min-cost maximum flow to the quotas.

    Levels of repetition open one after the other; within a level flow is augmented along shortest
    paths, which may move what other patterns send to a source on to another of their sources.
    """
    left = [0] * len(patterns)
    free = list(quotas)
    flow: list[dict[int, int]] = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    senders: list[dict[int, None]] = [{} for _ in quotas]  # in the order they came, so numbers of patterns decide nothing
    taken = [0] * len(patterns)

    def augment(start: int) -> bool:
        came: dict[tuple[str, int], tuple[str, int] | None] = {("p", start): None}
        queue = deque(came)
        while queue:
            kind, i = here = queue.popleft()
            if kind == "s" and free[i] > 0:
                path = [here]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [flow[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2)]
                amount = min(left[start], free[i], *back)
                for (a, x), (_, y) in zip(path, path[1:], strict=False):
                    if a == "p":
                        flow[x][y] += amount
                        senders[y][x] = None
                    else:
                        flow[y][x] -= amount
                        if not flow[y][x]:
                            senders[x].pop(y, None)
                left[start] -= amount
                free[i] -= amount
                taken[start] += amount
                return True
            near = [("s", s) for s in flow[i]] if kind == "p" else [("p", p) for p in senders[i]]
            for other in near:
                if other not in came:
                    came[other] = here
                    queue.append(other)
        return False

    for _ in range(repeats):
        for p, (_, tokens) in enumerate(patterns):
            left[p] = tokens
        for p in range(len(patterns)):
            while left[p] > 0 and any(free) and augment(p):
                pass
    return taken


def ranked_sources(patterns: DataFrame) -> DataFrame:
    """(source, size, shared, place): tokens of each source, whether a pattern has others beside it, and
    its place in the order of code points, null last.

    Places are counted in two levels: within ranges of about RANGE sources, and over the ranges.
    """
    found = patterns.select(F.explode("pattern").alias("source"), "tokens", (F.size("pattern") > 1).alias("many"))
    sources = stored(found.groupBy("source").agg(F.sum("tokens").alias("size"), F.max("many").alias("shared")).withColumn("none", F.col("source").isNull()))
    ranges = max(1, -(-sources.count() // RANGE))
    dealt = stored(sources.repartitionByRange(ranges, "none", "source").withColumn("range", F.spark_partition_id()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for a range
    before = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("none", "source")) - 1
    return dealt.withColumn("within", within).join(before, "range").select("source", "size", "shared", (F.col("before") + F.col("within")).alias("place"))


def targets_of(sources: DataFrame, weights: tuple[float, ...], total: float, cap: float) -> DataFrame:
    """``sources`` with target, as ``capped_targets`` gives it, by a few aggregations over (size, place).

    The share of a unit of weight only grows as full sources leave, so a source that is full stays so.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(sources.withColumn("weight", weight))
    most = F.col("size") * F.lit(float(cap))
    rest, whole, full = float(total), None, F.lit(False)
    count = -1
    while True:
        row = weighed.agg(F.sum(F.when(full, most)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("whole"), F.count_if(full).alias("n")).first()
        rest, whole = float(total) - (row["used"] or 0.0), row["whole"]
        if row["n"] == count or not whole:
            break
        count = row["n"]
        full = F.lit(rest) * F.col("weight") / F.lit(whole) > most
    share = F.lit(rest) * F.col("weight") / F.lit(whole) if whole else most
    return weighed.withColumn("target", F.when(full, most).otherwise(share)).drop("weight")


def _plan(patterns: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """What is taken of each pattern: __full times all of it, and __part tokens of it once more."""
    spark = patterns.sparkSession
    total = patterns.agg(F.sum("tokens")).first()[0] or 0
    sources = stored(targets_of(ranked_sources(patterns), weights, share * total, repeats))
    quota = F.rint("target").cast("long")

    def told(df: DataFrame, flow: Column) -> DataFrame:
        some = F.col("tokens") > 0
        return df.withColumn("flow", flow).select(
            F.col("pattern").alias("__pattern"), "source_sizes", "targets",
            F.when(some, F.expr("flow div tokens")).otherwise(0).alias("__full"), F.when(some, F.expr("flow % tokens")).otherwise(0).alias("__part"), F.col("tokens").alias("__tokens"),
        )

    # A source that no pattern shares takes what its quota asks for, up to the repeats.
    alone = patterns.filter(F.size("pattern") == 1).withColumn("one", F.col("pattern")[0])
    met = alone.join(sources, F.col("one").eqNullSafe(F.col("source")))
    own = met.withColumns({"source_sizes": F.array("size"), "targets": F.array("target")})
    settled = told(own.filter(~F.col("shared")), F.least(quota, F.col("tokens") * repeats))

    # Patterns that meet at shared sources go through the flow.
    beside = own.filter("shared").select("pattern", "tokens").unionByName(patterns.filter(F.size("pattern") > 1))
    if beside.isEmpty():
        return settled
    routes = _flows(beside, sources.filter("shared").withColumn("quota", quota), repeats)
    return settled.unionByName(told(routes, F.col("routed")).select(settled.columns))


def _flows(patterns: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """(pattern, tokens, source_sizes, targets, routed) of patterns that meet at sources, component by component."""
    each = patterns.select("pattern", "tokens", F.posexplode("pattern").alias("at", "one"))
    met = each.join(sources, F.col("one").eqNullSafe(F.col("source")))
    facts = F.array_sort(F.collect_list(F.struct("at", "place", "size", "target", "quota")))
    whole = stored(met.groupBy("pattern", "tokens").agg(facts.alias("facts")))
    # Every shared source has another beside it in some pattern, hence an edge.
    edges = whole.select(F.col("facts")[0]["place"].alias("one"), F.explode("facts.place").alias("other"))
    components = connected_components(edges, "one", "other")
    dealt = whole.join(components, F.col("facts")[0]["place"] == F.col("node")).select(
        "component", "pattern", "tokens", F.col("facts.place").alias("places"), F.col("facts.quota").alias("quotas"),
        F.col("facts.size").alias("source_sizes"), F.col("facts.target").alias("targets"),
    )

    def route(component: pa.Table) -> pa.Table:
        places = component.column("places").to_pylist()
        order = sorted(range(len(places)), key=places.__getitem__)
        quota = {s: q for row, quotas in zip(places, component.column("quotas").to_pylist(), strict=True) for s, q in zip(row, quotas, strict=True)}
        number = {s: i for i, s in enumerate(sorted(quota))}
        tokens = component.column("tokens").to_pylist()
        taken = routed([([number[s] for s in places[i]], tokens[i]) for i in order], [quota[s] for s in number], repeats)
        kept = component.select(["pattern", "tokens", "source_sizes", "targets"]).take(pa.array(order))
        return kept.append_column("routed", pa.array(taken, pa.int64()))

    parts = -(-whole.count() // MAX_PATTERNS)
    told = "pattern array<string>, tokens long, source_sizes array<long>, targets array<double>, routed long"
    return dealt.repartition(parts, "component").groupBy("component").applyInArrow(route, told)


def mix_sources(docs: DataFrame, members: str, size: str, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 7, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with source_sizes, targets (both in the order of ``members``) and taken.

    ``members``: the array of a document's sources; ``size``: its tokens. Sources in order of code
    points, null last, take the weights in turn; together they are to give ``share`` of all tokens.
    """
    sets = docs.filter(F.size(members) > 0).select(F.array_sort(F.array_distinct(members)).alias("pattern"), F.col(size).alias("size"))
    patterns = stored(sets.groupBy("pattern").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")))
    plan = stored(_plan(patterns, weights, share, repeats))

    order = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(size))
    placed = docs.drop("source_sizes", "targets", "taken").withColumn("__order", order)
    placed = placed.withColumn("__bucket", F.pmod(F.shiftright("__order", 20), F.lit(BUCKETS))).withColumn("__key", F.array_sort(F.array_distinct(members)))
    joined = placed.join(plan, F.expr("__key <=> __pattern"), "left").withColumn("__large", F.coalesce(F.col(size) * LARGE > F.col("__tokens"), F.lit(False)))

    def middle(*order_by: str) -> Column:
        """How far the middle of a document lies in the seeded order of its group."""
        before = Window.partitionBy("__key").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col(size) / 2

    share_of_large = F.col("__part") / F.col("__tokens") * F.sum(size).over(Window.partitionBy("__key"))
    large = joined.filter("__large").withColumn("__once", middle("__order", doc_id) <= share_of_large)
    # These two have a row for a pattern. Written first, their sizes are known, and few are broadcast instead of shuffling documents.
    by_large = stored(large.groupBy(F.col("__key").alias("__large_key")).agg(F.sum(F.when(F.col("__once"), F.col(size)).otherwise(0)).alias("__by_large")))

    sums = joined.filter("not __large and __part > 0").groupBy("__key", "__part", F.col("__bucket").alias("bucket")).agg(F.sum(size).alias("sum"))
    running = Window.partitionBy("__key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("sum").over(running), F.lit(0))).join(by_large, F.expr("__key <=> __large_key"), "left")
    ends = ends.withColumn("need", F.col("__part") - F.coalesce("__by_large", F.lit(0)))
    # The bucket where the part of a pattern ends, and what is still needed of that bucket; where the
    # part takes all of the others, the end lies beyond the last bucket.
    ends = stored(ends.groupBy(F.col("__key").alias("__end_key")).agg(
        F.coalesce(F.min(F.when(F.col("before") + F.col("sum") >= F.col("need"), F.col("bucket"))), F.lit(BUCKETS)).alias("__end"),
        F.min(F.when(F.col("before") < F.col("need"), F.col("need") - F.col("before"))).alias("__need"),
    ))
    others = joined.filter("not __large").join(ends, F.expr("__key <=> __end_key"), "left")
    at_end = F.coalesce(F.col("__bucket") == F.col("__end"), F.lit(False))
    last = others.filter(at_end).withColumn("__once", F.coalesce(middle("__order", doc_id) <= F.col("__need"), F.lit(False)))
    before = others.filter(~at_end).withColumn("__once", F.coalesce(F.col("__bucket") < F.col("__end"), F.lit(False)))
    extra = ["__end_key", "__end", "__need"]
    chosen = before.unionByName(last).drop(*extra).unionByName(large)
    times = F.coalesce("__full", F.lit(0)) + F.when(F.col("__once"), 1).otherwise(0)
    return chosen.withColumn("taken", F.col(size) * times).drop("__order", "__bucket", "__key", "__pattern", "__full", "__part", "__tokens", "__large", "__once")
