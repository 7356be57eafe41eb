"""A base side of few rows needs no tree of cells, and gives the same neighbours to the same bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import knn


@pytest.mark.parametrize("holes", (False, True))
def test_few_base_rows_are_seen_in_one_pass(spark, monkeypatch, holes):
    h = lambda c: (F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(40)) / 8).cast("double")  # noqa: E731  ties and copies
    table = spark.range(900).select(
        F.concat(F.lit("r"), F.col("id")).alias("row_id"), (F.col("id") % 3).alias("label"), h("a").alias("a"),
        (F.when(F.col("id") % 5 > 0, h("b")) if holes else h("b")).alias("b"))
    find = lambda: sorted(knn.neighbours(table, table, ["a", "b"], 4, payload=None if holes else "label", fill_missing=holes).collect())
    built, build = [], knn.build_tree
    monkeypatch.setattr(knn, "build_tree", lambda *a: built.append(a) or build(*a))
    few = find()
    assert not built
    monkeypatch.setattr(knn, "CROSS_ROWS", 0)
    assert find() == few and built and len(few) == 4 * (180 if holes else 900)


@pytest.mark.parametrize("ties", (False, True))
def test_a_pair_is_measured_once_for_all_missing_components(monkeypatch, ties):
    """A query block meets base blocks: for every component that a query misses, the nearest rows that have it, as by sorting all pairs."""
    rng = np.random.default_rng(5)

    def block(start):
        ids = np.arange(start, start + 120)
        x = rng.normal(size=(120, 20))
        x = np.round(x) if ties else x
        for c in range(20):
            x[ids % 7 == c % 7, c] = np.nan
        x[ids % 40 == 0] = np.nan  # nothing in common with any row
        return ids, x

    base, (ids, x) = [block(s) for s in (0, 120, 240)], block(1000)
    measured, pairs = [], knn.pair_distances
    monkeypatch.setattr(knn, "pair_distances", lambda a, b: measured.append(len(a)) or pairs(a, b))
    monkeypatch.setattr(knn, "CROSS_QUERIES", 50)
    found = knn._Nearest(ids, x, 4, True)
    for i, b in base:
        found.see(i, b, np.full(len(i), np.nan))
    got = {}
    for r in (r for f in found.frames() for r in f.itertuples()):
        got.setdefault((r.id, r.slot), []).append((r.d2, r.neighbour, r.y))
    far, all_ids, all_x = knn.block_distances(x, np.concatenate([b for _, b in base])), np.concatenate([i for i, _ in base]), np.concatenate([b for _, b in base])
    want = {}
    for q, c in zip(*np.nonzero(np.isnan(x)), strict=True):
        near = sorted((far[q, j], all_ids[j], all_x[j, c]) for j in range(360) if np.isfinite(far[q, j]) and not np.isnan(all_x[j, c]))[:4]
        if near:
            want[ids[q], c] = near
    assert {k: sorted(v) for k, v in got.items()} == want
    assert ties or sum(measured) < sum(len(v) for v in got.values()) * 6  # slots of a query share their pairs


def test_small_sides_are_searched_by_all_tasks(spark):
    """Two sides of a few blocks meet in as many tasks as there are blocks of queries, not in one behind a broadcast."""
    rows = spark.range(600).select(F.col("id"), F.array(F.col("id") % 7, F.col("id") % 11).cast("array<double>").alias("x"), F.lit(0.0).alias("y"))
    found = knn._cross(rows.select("id", "x"), rows, 600, 2, 3, False)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 3 * 600
