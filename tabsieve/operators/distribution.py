"""Distributed building blocks: long form, value histograms, running totals and exact quantiles.

None of them sorts a whole column in one task. Quantiles count values by the leading bits of their
ordered keys and look again only into the ranges that hold a requested rank; per group, a mergeable
sketch brackets each rank, then only the values inside the brackets are counted exactly.
Running totals are two-level: totals per bucket, then an ordered sum inside each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counters a column of the summaries that find frequent values.
HITTERS = 64
MAX_BUFFERS = 90  # aggregation buffers per pass that keep whole-stage code generation on
#: Bits of a key that one scan for quantiles tells apart: a range has at most 2 ** RADIX_BITS cells.
RADIX_BITS = 20
#: Values that a task gathers of a column before it counts them.
GATHERED = 200_000


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., variable, value), one row per cell."""
    cells = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    return cells.unpivot(list(keep), list(features), "variable", "value")


def column_aggregate(
    df: DataFrame, features: Sequence[str], measures: dict, buffers_each: int = 1
) -> DataFrame:
    """One scan, one row per variable, for cheap measures: {name: fn(column) -> aggregate}.

    Works on the wide form (no row blow-up) in chunks small enough for code generation; a
    columnar source reads every column once whatever the number of chunks.
    """
    per_chunk = max(1, MAX_BUFFERS // max(1, buffers_each * len(measures)))
    out = None
    for start in range(0, len(features), per_chunk):
        chunk = list(features[start : start + per_chunk])
        structs = [
            F.struct(F.lit(c).alias("variable"), *[fn(F.col(c)).alias(m) for m, fn in measures.items()])
            for c in chunk
        ]
        part = df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
        out = part if out is None else out.unionByName(part)
    return out


def value_histogram(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., variable, value, n): combined before the shuffle, so repeated values cost nothing."""
    return long_form(df, features, keep).groupBy(*keep, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def _keys(column: pa.Array) -> tuple[np.ndarray, int]:
    """The values that are there as 64-bit keys (one for 0 and -0, one for all NaN), and the number of nulls."""
    x = column.drop_null().to_numpy(zero_copy_only=False).astype("float64") + 0.0
    x[np.isnan(x)] = np.nan
    return x.view(np.int64), column.null_count


def _sum_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), dtype=np.int64)
    np.add.at(sums, at, counts)
    return found, sums


def _summarise(features: Sequence[str], k: int) -> Callable:
    """k counters a column: when there are more, the (k + 1)-th largest count is taken off all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in features}
        lost = dict.fromkeys(features, 0)
        for batch in batches:
            for c in features:
                keys, counts = np.unique(_keys(batch.column(c))[0], return_counts=True)
                keys, counts = _sum_keys(np.concatenate([held[c][0], keys]), np.concatenate([held[c][1], counts]))
                if len(keys) > k:
                    cut = np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
                    keys, counts, lost[c] = keys[counts > cut], counts[counts > cut] - cut, lost[c] + int(cut)
                held[c] = keys, counts
        rows = [(c, int(x), int(n)) for c in features for x, n in zip(*held[c], strict=True)] + [(c, None, lost[c]) for c in features]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["variable", "key", "n"])
    return run


def _count_keys(wanted: dict[str, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(len(x), dtype=np.int64) for c, x in wanted.items()}
        nulls, rows = dict.fromkeys(wanted, 0), 0
        for batch in batches:
            rows += batch.num_rows
            for c, x in wanted.items():
                keys, missing = _keys(batch.column(c))
                nulls[c] += missing
                if len(x):
                    at = np.minimum(np.searchsorted(x, keys), len(x) - 1)
                    sums[c] += np.bincount(at[x[at] == keys], minlength=len(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(wanted)), pa.array([sums[c].tolist() for c in wanted], pa.list_(pa.int64())),
             pa.array([nulls[c] for c in wanted], pa.int64()), pa.array([rows] * len(wanted), pa.int64())],
            names=["variable", "counts", "nulls", "rows"])
    return run


def heavy_hitters(df: DataFrame, features: Sequence[str], k: int = HITTERS) -> list[tuple[str, int, int, bool]]:
    """(variable, top, total, sure) of every column with rows: the count of its most frequent value, NULL being one.

    A scan keeps k counters a column in every task; merged, they miss no value with more than about total / k rows. A
    second scan counts these candidates exactly. `sure` says that no other value can have more than `top`; if not,
    `top` is a lower bound. At most len(features) * k rows reach the driver.
    """
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    seen = cells.mapInArrow(_summarise(features, k), "variable string, key long, n long").groupBy("variable", "key").agg(
        F.sum("n").alias("n"))
    most = Window.partitionBy("variable", F.col("key").isNull()).orderBy(F.desc("n"), "key")
    best = seen.withColumn("_r", F.row_number().over(most)).filter(F.col("_r") <= k + 1).collect()
    held: dict[str, list] = {c: [] for c in features}
    lost = dict.fromkeys(features, 0)
    for r in best:
        if r["key"] is None:
            lost[r["variable"]] += r["n"]
        elif r["_r"] <= k:
            held[r["variable"]].append(r["key"])
    for r in best:  # what the merged summary leaves out has at most its largest count on top of the tasks' losses
        if r["key"] is not None and r["_r"] == k + 1:
            lost[r["variable"]] += r["n"]
    wanted = {c: np.array(sorted(x), dtype=np.int64) for c, x in held.items()}
    exact = cells.mapInArrow(_count_keys(wanted), "variable string, counts array<long>, nulls long, rows long")
    places = exact.select("variable", F.posexplode_outer("counts").alias("i", "n"), "nulls", "rows").groupBy("variable", "i").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows")).collect()
    out: dict[str, tuple[int, int]] = {}
    for r in places:
        top, _ = out.get(r["variable"], (0, 0))
        out[r["variable"]] = max(top, r["n"] or 0, r["nulls"]), r["rows"]
    return [(c, *out[c], out[c][0] >= lost[c]) for c in features if c in out and out[c][1]]


def _few(features: Sequence[str], most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, np.int64) for c in features}
        for batch in batches:
            for c in features:
                if len(held[c]) < most:
                    held[c] = np.union1d(held[c], _keys(batch.column(c))[0])[:most]
        keys = np.concatenate([held[c] for c in features])
        names = [c for c in features for _ in held[c]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys), pa.array(keys.view(np.float64))],
                                         names=["variable", "key", "value"])
    return run


def few_values(df: DataFrame, features: Sequence[str], most: int) -> DataFrame:
    """(variable, key, value): distinct values of every column, at most `most` from a task. `key` tells values apart."""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    return cells.mapInArrow(_few(features, most), "variable string, key long, value double")


def locate(df: DataFrame, edges: str, value: Column, size: int, out: str, inclusive: bool = False) -> DataFrame:
    """Add `out`: how many entries of the ascending array column lie below the value (or equal it).

    An unrolled binary search over at most `size` entries: every step is a plain projection that
    stays inside generated code, unlike an array lambda that would visit all entries.
    """
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(size, 1).bit_length() - 1
    while step:
        probe = F.get(F.col(edges), F.col(out) + (step - 1))
        hit = (probe <= value) if inclusive else (probe < value)
        df = df.withColumn(out, F.when(hit, F.col(out) + step).otherwise(F.col(out)))
        step >>= 1
    return df


def bucket_by_sketch(
    df: DataFrame, groups: Sequence[str], value: str, buckets: int = 128, name: str = "bucket"
) -> DataFrame:
    """Add an order-preserving bucket of about equal row count per group (heavy values stay whole)."""
    probs = [i / buckets for i in range(1, buckets)]
    tagged = df if groups else df.withColumn("_one", F.lit(0))
    keys = list(groups) or ["_one"]
    edges = tagged.groupBy(*keys).agg(F.percentile_approx(value, probs, 10 * buckets).alias("_edges"))
    placed = locate(tagged.join(edges, keys), "_edges", F.col(value), buckets, name)
    return placed.drop("_edges", "_one")


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    suffix: str = "_cum",
) -> DataFrame:
    """Inclusive cumulative sums per group in `order`, computed bucket by bucket."""
    by_bucket = F.col(bucket).desc() if descending else F.col(bucket).asc()
    by_value = F.col(order).desc() if descending else F.col(order).asc()
    totals = df.groupBy(*groups, bucket).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, bucket,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = (
        Window.partitionBy(*groups, bucket).orderBy(by_value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = df.join(offsets, [*groups, bucket])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"{c}{suffix}") for c in sums],
    )


def _ordered(column: pa.Array) -> np.ndarray:
    """The values that are there, neither null nor NaN, as 64-bit keys in the order of the values."""
    x = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
    bits = x[~np.isnan(x)].view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _value(key: int) -> float:
    bits = np.array([key], dtype=np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64)[0])


def _cells(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, shift: int) -> np.ndarray:
    """part, cell, low, high and n of the keys that lie in a range; ranges are disjoint and ascend."""
    keys, n = np.unique(keys, return_counts=True)
    part = np.searchsorted(starts, keys, side="right") - 1
    inside = (part >= 0) & (keys <= ends[part])
    return np.stack([part[inside], keys[inside] >> shift, keys[inside], keys[inside], n[inside]])


def _merged(found: np.ndarray) -> np.ndarray:
    if not found.shape[1]:
        return found
    found = found[:, np.lexsort((found[1], found[0]))]
    new = np.flatnonzero(np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)]))
    return np.stack([found[0][new], found[1][new], np.minimum.reduceat(found[2], new), np.maximum.reduceat(found[3], new),
                     np.add.reduceat(found[4], new)])


def _count_cells(ranges: dict[str, list[tuple[int, int]]], shift: int) -> Callable:
    """Values per variable, range and cell (the key without its last `shift` bits), with the cell's smallest and largest key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = {c: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for c, r in ranges.items()}
        held = {c: np.zeros((5, 0), dtype=np.int64) for c in ranges}
        waiting: dict[str, list[np.ndarray]] = {c: [] for c in ranges}

        def count() -> None:
            for c, parts in waiting.items():
                if parts:
                    held[c] = _merged(np.concatenate([held[c], _cells(np.concatenate(parts), *limits[c], shift)], axis=1))
                    parts.clear()

        rows = 0
        for batch in batches:
            for c in ranges:
                waiting[c].append(_ordered(batch.column(c)))
            rows += batch.num_rows
            if rows >= GATHERED:
                count()
                rows = 0
        count()
        for c, (part, cell, low, high, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(part), pa.string()), *(pa.array(x, pa.int64()) for x in (part, cell, low, high, n))],
                names=["variable", "part", "cell", "low", "high", "n"])
    return run


def _table_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(variable, p, q). Each scan counts cells of 2 ** -RADIX_BITS of a range, first of all keys, then of the cells that
    hold a wanted rank and more than one value. Doubles have 64 bits, so four scans at most; two where values spread."""
    spark, probs = df.sparkSession, sorted({float(p) for p in probs})
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    ranges = {c: [(-(2**63), 2**63 - 1)] for c in features}
    starts: dict[tuple[str, int], int] = {(c, 0): 0 for c in features}  # rows before a range
    sizes: dict[str, int] = {}
    wanted: dict[str, set[int]] = {}
    at: dict[tuple[str, int], float] = {}
    shift = 64
    while ranges and probs:
        shift = max(0, shift - RADIX_BITS)
        counted = cells.select(*ranges).mapInArrow(
            _count_cells(ranges, shift), "variable string, part long, cell long, low long, high long, n long").groupBy(
            "variable", "part", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        w = Window.partitionBy("variable", "part")
        run = w.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counted.withColumns({"upto": F.sum("n").over(run), "size": F.sum("n").over(w)})
        if sizes:
            parts = [(c, i) for c, found in ranges.items() for i in range(len(found))]
            need = pa.table({
                "variable": pa.array([c for c, _ in parts], pa.string()), "part": pa.array([i for _, i in parts], pa.int64()),
                "ranks": pa.array([sorted(r - starts[at_] for r in wanted[at_[0]]) for at_ in parts], pa.list_(pa.int64()))})
            placed = placed.join(F.broadcast(spark.createDataFrame(need)), ["variable", "part"])
        else:
            rank = [F.lit(p) * (F.col("size") - 1) for p in probs]
            placed = placed.withColumn("ranks", F.array(*[f(r).cast("bigint") for r in rank for f in (F.floor, F.ceil)]))
        hits = placed.filter(F.exists("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).collect()
        if not sizes:
            sizes = {r["variable"]: r["size"] for r in hits}
            wanted = {c: {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)} for c, n in sizes.items()}
        open_: dict[str, list[tuple[int, int, int]]] = {}
        for r in hits:
            c, after = r["variable"], starts[r["variable"], r["part"]] + r["upto"]
            if r["low"] == r["high"]:
                at |= {(c, k): _value(r["low"]) for k in wanted[c] if after - r["n"] <= k < after}
            else:
                open_.setdefault(c, []).append((r["low"], r["high"], after - r["n"]))
        ranges, starts = {}, {}
        for c, found in open_.items():
            ranges[c] = [(low, high) for low, high, _ in sorted(found)]
            starts |= {(c, i): before for i, (_, _, before) in enumerate(sorted(found))}
    rows = []
    for c, n in sizes.items():
        for p in probs:
            k = p * (n - 1)
            low, high = at[c, math.floor(k)], at[c, math.ceil(k)]
            rows.append((c, p, low + (high - low) * (k - math.floor(k))))
    names, types = ("variable", "p", "q"), (pa.string(), pa.float64(), pa.float64())
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}))


def exact_quantiles(
    df: DataFrame,
    features: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """(by..., variable, p, q): linearly interpolated quantiles, NULL and NaN left out.

    `by` must be a low-cardinality key (class, fold, split): its sketches are broadcast. Without it the table is read at
    once, in two scans as a rule.
    """
    by = list(by)
    if not by:
        return _table_quantiles(df, features, probs)
    cells = long_form(df, features, by).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [*by, "variable"]
    # A sketch misses a rank by at most n/accuracy; four times that, plus the whole range for
    # groups too small for the margin to cover the interpolation neighbour, always brackets it.
    eps = 4.0 / accuracy
    edge_probs = [x for p in probs for x in (max(p - eps, 0.0), min(p + eps, 1.0))]
    sketch = cells.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.percentile_approx("value", edge_probs, accuracy).alias("e"),
    )
    small = F.col("n") <= accuracy
    brackets = F.array(
        *[
            F.struct(
                F.when(small, F.col("lo")).otherwise(F.col("e")[2 * i]).alias("a"),
                F.when(small, F.col("hi")).otherwise(F.col("e")[2 * i + 1]).alias("b"),
            )
            for i in range(len(probs))
        ]
    )
    sketch = sketch.select(*keys, "n", F.array_distinct(brackets).alias("br")).withColumn(
        "edges", F.array_sort(F.array_distinct(F.concat(F.transform("br", lambda s: s["a"]),
                                                        F.transform("br", lambda s: s["b"]))))
    )
    # covered[s]: does the open interval just below edge s belong to a bracket?
    sketch = sketch.withColumn("covered", F.transform("edges", lambda e, i: (i > 0) & F.exists(
        "br", lambda s: (s["a"] <= F.get(F.col("edges"), i - 1)) & (s["b"] >= e))))
    renamed = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", "covered", "edges")
    match = None
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        match = cond if match is None else match & cond
    placed = locate(cells.join(F.broadcast(renamed), match), "edges", F.col("value"), len(edge_probs), "slot")
    slot = F.col("slot")
    upper = F.get(F.col("edges"), slot)
    lower = F.when(slot > 0, F.get(F.col("edges"), slot - 1))
    inside = F.coalesce(F.get(F.col("covered"), slot) | (upper == F.col("value")), F.lit(False))
    sub = F.coalesce(
        F.least(F.lit(255), F.floor(F.try_divide(F.col("value") - lower, upper - lower) * 256)), F.lit(0)
    ).cast("int")
    counted = (
        placed.select(
            *keys,
            F.col("n").alias("total"),
            (slot * 512 + F.when(inside, sub + 1).otherwise(0)).alias("bucket"),
            F.when(inside, F.col("value")).alias("v"),
        )
        .groupBy(*keys, "total", "bucket", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cum = running_totals(counted, [*keys, "total"], "bucket", "v", ["n"])
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"),
                               (F.lit(float(p)) * (F.col("total") - 1)).alias("k")) for p in probs])

    def covers(r: Column) -> Column:
        return (F.col("n_cum") - F.col("n") <= r) & (r < F.col("n_cum"))

    hits = cum.select(
        *keys, "v",
        F.explode(F.filter(F.transform(
            ranks,
            lambda s: F.struct(s["p"].alias("p"), s["k"].alias("k"),
                               covers(F.floor(s["k"])).alias("at_lo"), covers(F.ceil(s["k"])).alias("at_hi")),
        ), lambda s: s["at_lo"] | s["at_hi"])).alias("r"),
    )
    pairs = hits.groupBy(*keys, F.col("r.p").alias("p")).agg(
        F.max(F.when(F.col("r.at_lo"), F.col("v"))).alias("lo"),
        F.max(F.when(F.col("r.at_hi"), F.col("v"))).alias("hi"),
        F.max("r.k").alias("k"),
    )
    return pairs.select(
        *keys, "p",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") - F.floor("k"))).alias("q"),
    )


def exact_medians(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, features, [0.5], by).select(*by, "variable", F.col("q").alias("median"))


def average_ranks(hist: DataFrame, groups: Sequence[str], value: str = "value", count: str = "n") -> DataFrame:
    """Add `avg_rank` (ties share the mean of their positions) to a value histogram."""
    bucketed = bucket_by_sketch(hist, groups, value)
    cum = running_totals(bucketed, groups, "bucket", value, [count])
    return cum.withColumn(
        "avg_rank", F.col(f"{count}_cum") - F.col(count) + (F.col(count) + 1) / F.lit(2.0)
    ).drop("bucket", f"{count}_cum")
