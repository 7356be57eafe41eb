"""Mixing sources to target weights: a minimum-cost flow from membership patterns to source quotas.

Documents are aggregated by the set of sources they belong to. Each pattern offers its words up to
MAX_REPEATS times, every further pass at a higher cost; each source has a quota. The cheapest flow says
how many words of each pattern go to each of its sources. Documents are then picked by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabsieve.llm.components import connected_components
from tabsieve.llm.stages import written
from tabsieve.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Up to this many patterns the plan is made on the driver, beyond it in Spark, with the same result.
MAX_PATTERNS = 20_000
SEED = 42
_BUCKETS = 1 << 16
# Columns that `mix` adds or needs for itself.
OWN_NAMES = {"_row", "_size", "_members", "_times", "_hash", "_bucket", "_copy", "_p", "_passes", "_rest", "_last", "_before"}

Source = str | None
Pattern = tuple[Source, ...]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def by_code_point(sources: Sequence[Source]) -> list[Source]:
    """Sources by code point, null last."""
    return sorted(set(sources), key=lambda s: (s is None, s or ""))


def quotas(sizes: dict[Source, int], total: int, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS) -> dict[Source, float]:
    """Targets in proportion to the weights; a target stops at `most` times its source's size, and the
    excess is shared again by weight among the others until none is above."""
    order = by_code_point(list(sizes))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: set[Source] = set()
    while True:
        left, parts = total - sum(most * sizes[s] for s in fixed), sum(weight[s] for s in order if s not in fixed)
        above = {s for s in order if s not in fixed and left * weight[s] > most * sizes[s] * parts}
        if not above:
            return {s: float(most * sizes[s]) if s in fixed else left * weight[s] / parts for s in order}
        fixed |= above


def cheapest_flow(offers: dict[Pattern, int], need: dict[Source, int], most: int = MAX_REPEATS) -> dict[Pattern, int]:
    """Words taken from each pattern: successive shortest paths on source -> pattern -> quota.

    Pass r of a pattern costs r per word (a convex cost), so a path is cheapest if it starts at the
    pattern with the fewest passes used; rerouting goes back over flow that already reaches a quota.
    """
    linked: dict[Source, Source] = {s: s for p in offers for s in p}

    def root(s: Source) -> Source:
        while linked[s] != s:
            linked[s] = s = linked[linked[s]]
        return s

    for p in offers:  # sources that share no documents, directly or in a chain, are separate problems
        for s in p[1:]:
            linked[root(s)] = root(p[0])
    split: dict[Source, dict[Pattern, int]] = {}
    for p, n in offers.items():
        split.setdefault(root(p[0]), {})[p] = n
    used: dict[Pattern, int] = {}
    for own in split.values():
        used |= _cheapest(own, {s: need[s] for p in own for s in p if s in need}, most)
    return used


def _cheapest(offers: dict[Pattern, int], need: dict[Source, int], most: int) -> dict[Pattern, int]:
    used, flow = dict.fromkeys(offers, 0), {p: dict.fromkeys(p, 0) for p in offers}
    members: dict[Source, list[Pattern]] = {s: [] for s in need}
    for p in offers:
        for s in p:
            if s in members:
                members[s].append(p)
    open_need = {s: n for s, n in need.items() if n > 0}
    while open_need:
        # Cheapest pattern from which each still open quota can be reached, by levels of passes used.
        best: tuple | None = None
        for quota in open_need:
            back: dict = {quota: None}
            queue = [quota]
            while queue:
                s = queue.pop(0)
                for p in members[s]:
                    if p in back:
                        continue
                    back[p] = s
                    room = most * offers[p] - used[p]
                    if room > 0 and (best is None or used[p] // offers[p] < best[0]):
                        best = (used[p] // offers[p], p, back, quota)
                    for other in p:  # take words back from another source of this pattern
                        if other in members and other not in back and flow[p].get(other, 0) > 0:
                            back[other] = p
                            queue.append(other)
        if best is None:
            break
        _, p, back, quota = best
        path, node = [], p
        while node is not None:
            path.append(node)
            node = back[node]
        amount = min(open_need[quota], offers[p] - used[p] % offers[p])
        for i in range(2, len(path), 2):
            amount = min(amount, flow[path[i]][path[i - 1]])
        used[p] += amount
        for i in range(0, len(path) - 1, 2):
            flow[path[i]][path[i + 1]] += amount
            if i + 2 < len(path):
                flow[path[i + 2]][path[i + 1]] -= amount
        open_need[quota] -= amount
        open_need = {s: n for s, n in open_need.items() if n > 0}
    return used


_PLAN = T.StructType([T.StructField("_p", T.ArrayType(T.StringType())), T.StructField("_passes", T.LongType()),
                      T.StructField("_rest", T.LongType())])


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources with `number`, their place by code point (null last): a range sort, then offsets of its partitions."""
    placed = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(
        F.col("source").isNull(), "source").withColumn("_i", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_i", 33)
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    first = placed.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(first), part == F.col("_part")).withColumn(
        "number", F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_i", "_part", "_before")


def _targets(sources: DataFrame, total: int, weights: Sequence[int], most: int) -> DataFrame:
    """source, source_size, number and target of many sources: `quotas`, one round of it a pass over the sources."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    now = written(_numbered(sources).withColumns({"weight": weight.cast("bigint"), "fixed": F.lit(False)}), "sources")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    while True:
        r = now.agg(F.sum(F.when(F.col("fixed"), F.col("source_size"))).alias("fixed"), F.sum(F.when(~F.col("fixed"), F.col("weight"))).alias("parts")).first()
        left, parts = total - most * (r["fixed"] or 0), r["parts"] or 0
        above = ~F.col("fixed") & (F.lit(left).cast("decimal(38,0)") * wide("weight") > wide("source_size") * F.lit(most * parts).cast("decimal(38,0)"))
        if now.filter(above).isEmpty():
            share = (F.lit(left).cast("bigint") * F.col("weight")).cast("double") / F.lit(float(parts or 1))
            return now.withColumn("target", F.when(F.col("fixed"), (most * F.col("source_size")).cast("double")).otherwise(share)).drop(
                "weight", "fixed")
        now = written(now.withColumn("fixed", F.col("fixed") | above), "sources")


def _plan_in_spark(seen: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, DataFrame]:
    """(plan, sources) for any number of patterns. A pattern of one source that it shares with no other needs no flow. The
    other patterns fall into groups that share sources, in chains too; a group is solved in one task."""
    patterns = written(seen.groupBy("_members").agg(F.sum("_words").alias("words")), "patterns")
    total = patterns.agg(F.sum("words")).first()[0] or 0
    member = patterns.select(F.explode("_members").alias("source"), "_members", "words")
    sources = written(_targets(member.groupBy("source").agg(F.sum("words").alias("source_size")), total, weights, most), "targets")
    number = member.join(sources.select(F.col("source").alias("_s"), "number", "target"), F.col("source").eqNullSafe(F.col("_s")))
    by_pattern = written(number.groupBy("_members", "words").agg(
        F.collect_list(F.struct("source", "number", "target")).alias("_of"), F.min("number").alias("first")), "members")
    edges = by_pattern.filter("size(_of) > 1").select("first", F.explode("_of.number").alias("other"))
    nodes = written(connected_components(edges, "first", "other"), "flows")
    need = F.floor(F.col("_of")[0]["target"]).cast("bigint")
    taken = F.least(need, most * F.col("words"))
    passes, rest = F.floor(F.try_divide(taken, "words")).cast("bigint"), F.try_mod(taken, F.col("words"))
    alone = by_pattern.join(nodes, F.col("first") == F.col("node"), "left_anti").select(
        F.col("_members").alias("_p"), F.coalesce(passes, F.lit(1)).cast("bigint").alias("_passes"), F.coalesce(rest, F.lit(0)).cast("bigint").alias("_rest"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(tuple(p), int(n), of) for p, n, of in zip(pdf["_members"], pdf["words"], pdf["_of"], strict=True)]
        quota = {s["source"]: int(s["target"]) for _, _, of in rows for s in of}
        used = cheapest_flow({p: n for p, n, _ in rows if n > 0}, quota, most)
        return pd.DataFrame([(list(p), used[p] // n, used[p] % n) if n else (list(p), 1, 0) for p, n, _ in rows], columns=["_p", "_passes", "_rest"])

    groups = by_pattern.join(nodes, F.col("first") == F.col("node")).groupBy("component").applyInPandas(solve, _PLAN)
    return written(alone.unionByName(groups), "plan"), sources.select("source", "source_size", "target")


def mix(df: DataFrame, members: Column, key: str = "doc_id", size: Column | None = None, text: str = "text",
        weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources). `rows`: all columns of df with `_size` (words), `_members` and `_times` (how often
    the mix takes the document); `sources`: source, source_size and target.

    `members` is an array with the sources of a row. Sizes of a pattern are aggregated in Spark; up to MAX_PATTERNS
    patterns are planned on the driver, more of them in Spark (`_plan_in_spark`), with the same result. Whole passes of a pattern take every
    document; the rest of its words is taken in the order of md5(seed|key): a histogram over hash buckets
    finds the bucket in which the quota is reached, and only that bucket's documents are ranked. The last
    document is taken if that comes nearer to the quota. Rows are never shuffled but for that bucket.

    Null texts have size 0. A null source is a source of its own, ordered last; a null array counts as
    one null source. Rows without a key hash like one key and rank first. Repeated keys are picked
    together. Documents of size 0 are taken with their hash neighbours at no cost. An empty table gives
    empty results.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    size = word_count(F.col(text)) if size is None else size
    pattern = F.coalesce(F.array_sort(F.array_distinct(members)), F.array(F.lit(None).cast("string")))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15)
    hashed = F.conv(digits, 16, 10).cast("bigint")
    rows = df.withColumns({"_members": pattern, "_hash": hashed, "_bucket": F.shiftright(hashed, 44)})
    seen = written(rows.groupBy("_members", "_bucket").agg(F.sum(size).alias("_words")), "mix")
    patterns = seen.groupBy("_members").agg(F.sum("_words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    few = len(patterns) <= MAX_PATTERNS
    small = F.broadcast if few else (lambda table: table)  # one row a pattern
    if few:
        offers = {tuple(r["_members"]): r["words"] for r in patterns}
        total, sizes = sum(offers.values()), {}
        for p, words in offers.items():
            for s in p:
                sizes[s] = sizes.get(s, 0) + words
        target = quotas(sizes, total, weights, most) if sizes else {}
        used = cheapest_flow({p: n for p, n in offers.items() if n > 0}, {s: int(x) for s, x in target.items()}, most)
        plan = spark.createDataFrame(
            [(list(p), n // offers[p], n % offers[p]) for p, n in used.items()]
            + [(list(p), 1, 0) for p, n in offers.items() if n == 0], _PLAN)
        sources = spark.createDataFrame([(s, sizes[s], target[s]) for s in target], "source string, source_size long, target double")
    else:
        plan, sources = _plan_in_spark(seen, weights, most)
    before = F.sum("_words").over(Window.partitionBy("_members").orderBy("_bucket")) - F.col("_words")
    cut = (seen.withColumn("_before", before).join(small(plan), F.col("_members").eqNullSafe(F.col("_p")))
           .filter(F.col("_before") <= F.col("_rest")).groupBy("_members")
           .agg(F.max(F.struct("_bucket", "_before")).alias("_cut"), F.first("_passes").alias("_passes"), F.first("_rest").alias("_rest"))
           .select(F.col("_members").alias("_p"), "_cut._bucket", "_cut._before", "_passes", "_rest")
           .withColumnRenamed("_bucket", "_last"))
    placed = rows.join(small(written(cut, "cut")), F.col("_members").eqNullSafe(F.col("_p")))
    sure = placed.filter(F.col("_bucket") != F.col("_last")).withColumns({
        "_size": size, "_times": F.col("_passes") + (F.col("_bucket") < F.col("_last")).cast("bigint")})
    edge = placed.filter(F.col("_bucket") == F.col("_last")).withColumn("_size", size)
    rank = Window.partitionBy("_members").orderBy("_hash", key, "_size").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("_before") + F.sum("_size").over(rank)) - F.col("_size")
    edge = edge.withColumn("_times", F.col("_passes") + ((F.col("_rest") > 0) & (middle <= 2 * F.col("_rest"))).cast("bigint"))
    columns = [*df.columns, "_size", "_members", "_times"]
    return sure.select(columns).union(edge.select(columns)), sources


def mixed(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, source_size, target and taken (words with repeats) of every row, one source each."""
    rows, sources = mix(df.select(key, text, source), F.array(F.col(source)), key, text=text)
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("_members")[0].eqNullSafe(F.col("_source"))).select(
        key, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken"))


def repeated(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of df, whatever their names. Null texts and
    texts without words go with their hash neighbours; null keys, repeated keys and repeated rows are treated as in
    `mix`; an empty table stays empty."""
    columns = df.columns
    if {c.lower() for c in columns} & OWN_NAMES:
        df = df.select(F.struct("*").alias("_row"), key, text, source)
    rows, _ = mix(df, F.array(F.col(source)), key, text=text)
    copies = rows.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return copies.select("_row.*") if "_row" in df.columns and df.columns != columns else copies.select(columns)
