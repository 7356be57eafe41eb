"""Exact k-nearest-neighbour join, on complete vectors or on vectors with missing components.

The base side is cut into a tree of cells: a cell of more than LEAF rows gets FAN hash-sampled pivots of its own and
every row goes to its nearest one, level by level, so cells stay small however many rows there are. Per cell a
bounding box, a distance range to its pivot and a row count are kept in a table, which give a lower bound of the
distance from a query to anything in the cell. A query first walks down to the cells nearest to it, which yields its
current k-th distance; then it walks the tree again and goes only into cells whose bound does not exceed that
distance, the nearest leaves first and the others after the distance has shrunk. Walks move blocks of queries that
stand at one node, so the children of a node are read once a block. A visit pairs blocks of queries with blocks of
base rows on (leaf, block), computes distances with numpy and emits at most k + 1 rows per query, so no task ever holds
a whole cell and no pair of rows is materialised. Identical base vectors beyond the k + 1 smallest keys cannot be
neighbours and are left out before the cells are built, so piles of copies do not grow a cell. Only rows that no pivot
tells apart (without common components) stay together in a larger leaf, in blocks.

With more than TREE_DIMS components such bounds prune next to nothing, and walks would move every query to every leaf.
Then blocks of queries meet blocks of base rows in a cross join that shuffles neither side: a task keeps the nearest rows
of a query block over all base blocks it sees, a matrix product finds the pairs that may be among them, and only the
distances of these are computed, exactly as elsewhere.

Distances are nan-euclidean: squared differences over the components present on both sides,
scaled by p / (number of such components); on complete vectors this is the plain distance.
Ties are broken by the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.session import ensure_checkpoint_dir
from tabsieve.sources.files import union_all

BLOCK = 1024
#: Rows of a cell beyond which it is cut, and the pivots that it then gets.
LEAF, FAN = 2 * BLOCK, 16
#: Levels of the tree; a node's number holds four bits a level.
LEVELS = 15
#: Components up to which the tree of cells is used.
TREE_DIMS = 16
#: Rows of a block of the cross join, queries whose products are held at once, and base blocks of a task.
CROSS_BLOCK, CROSS_QUERIES, CROSS_BASE = 4096, 512, 32
#: Pairs of a product that are measured at once.
HIT_PAIRS = 1 << 16
#: Rows of a base side that no tree is built for: all its blocks are shown to every query in one pass.
CROSS_ROWS = 4 * CROSS_BLOCK
#: Leaves that a query visits before its distance is looked at again.
FIRST_LEAVES = 4
_ROOT = 1


def _vector(features: Sequence[str] | str) -> F.Column:
    if isinstance(features, str):
        return F.transform(F.col(features), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype="float64")


def block_distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared nan-euclidean distances; pairs without a common component are infinitely far."""
    p = q.shape[1]
    acc = np.zeros((len(q), len(b)))
    mq, mb = ~np.isnan(q), ~np.isnan(b)
    complete = mq.all() and mb.all()
    q0, b0 = (q, b) if complete else (np.where(mq, q, 0.0), np.where(mb, b, 0.0))
    for d in range(p):
        diff = q0[:, d, None] - b0[None, :, d]
        diff *= diff
        if not complete:
            diff *= mq[:, d, None] & mb[None, :, d]
        acc += diff
    if complete:
        return acc
    common = mq.astype("float64") @ mb.T.astype("float64")
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, acc * (p / common), np.inf)


class _Nearest:
    """The `want` nearest base rows of the queries of one block, for each slot, over all base blocks shown to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, want: int, fill_missing: bool):
        self.ids, self.x, self.want, self.fill_missing = ids, x, want, fill_missing
        self.has = ~np.isnan(x)
        self.x0 = np.where(self.has, x, 0.0)
        self.square = (self.x0**2).sum(1)
        self.open = ~self.has if fill_missing else np.ones((len(x), 1), dtype=bool)  # the slots of a query
        self.kept: dict[int, tuple[np.ndarray, ...]] = {}  # by first query: row, slot, d2, neighbour, y
        self.worst = np.where(self.open, np.inf, -np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        has = ~np.isnan(x)
        x0 = np.where(has, x, 0.0)
        complete = self.has.all() and has.all()
        squares = (x0**2).sum(1)
        p = x.shape[1]
        wide = (np.column_stack([x0, np.ones(len(x0)), squares]) if complete else np.column_stack([x0, x0**2, has])).T
        fits = has if self.fill_missing else np.ones((len(x), 1), dtype=bool)
        for start in range(0, len(self.x), CROSS_QUERIES):
            rows = slice(start, start + CROSS_QUERIES)
            if complete:  # |q|^2 - 2 q b + |b|^2 as one product
                near = np.column_stack([-2.0 * self.x0[rows], self.square[rows], np.ones(len(self.x0[rows]))]) @ wide
                slack = 1e-12 * (self.square[rows] + squares.max())
            else:
                mine = self.has[rows]
                near = np.column_stack([-2.0 * self.x0[rows], mine, self.x0[rows]**2]) @ wide
                common = mine.astype("float32") @ has.T.astype("float32")  # small whole numbers
                with np.errstate(divide="ignore", invalid="ignore"):
                    near *= np.divide(p, common, dtype="float64")
                near[common == 0] = np.inf
                slack = 1e-12 * p * (self.square[rows] + squares.max())
            self._merge(start, near, slack, fits, ids, x, x if self.fill_missing else y[:, None])

    def _merge(self, start: int, near: np.ndarray, slack: np.ndarray, fits: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs whose product is within its error of the current bound of a slot are measured and merged."""
        limit = self.worst[start:start + len(near)] + slack[:, None]
        for slot in np.flatnonzero(np.isposinf(limit).any(0)):  # queries that have not seen `want` rows yet
            i, j = np.flatnonzero(np.isposinf(limit[:, slot])), np.flatnonzero(fits[:, slot])
            if len(j) > self.want:
                part = near if (len(i), len(j)) == near.shape else near[np.ix_(i, j)]
                limit[i, slot] = np.partition(part, self.want - 1, axis=1)[:, self.want - 1] + 2 * slack[i]
        # One look at a pair for all slots of its query: few pairs are near enough for any of them.
        pairs = np.nonzero(near <= limit.max(1)[:, None])
        for at in range(0, len(pairs[0]), HIT_PAIRS):
            r, c = (z[at:at + HIT_PAIRS] for z in pairs)
            a, slot = np.nonzero((near[r, c][:, None] <= limit[r]) & fits[c])
            d2 = pair_distances(self.x[start + r], x[c])[a]
            fine = np.isfinite(d2)
            a, slot, d2 = a[fine], slot[fine], d2[fine]
            if not len(a):
                continue
            found = (r[a], slot, d2, ids[c[a]], y[c[a], slot])
            old = self.kept.get(start)
            if old is not None:
                found = tuple(np.concatenate(z) for z in zip(old, found, strict=True))
            group = found[0] * self.open.shape[1] + found[1]
            order = np.lexsort((found[3], found[2], group))
            found, group = tuple(z[order] for z in found), group[order]
            place = np.arange(len(order)) - np.searchsorted(group, group)
            found = tuple(z[place < self.want] for z in found)
            full = place[place < self.want] == self.want - 1
            self.worst[start + found[0][full], found[1][full]] = found[2][full]
            self.kept[start] = found

    def frames(self) -> Iterator[pd.DataFrame]:
        for start, (r, slot, d2, neighbour, y) in self.kept.items():
            yield pd.DataFrame({"id": self.ids[start + r], "slot": slot.astype("int32"), "neighbour": neighbour, "d2": d2, "y": y})


def pair_distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`block_distances` of the rows of q and b one to one: the same sums in the same order."""
    p = q.shape[1]
    acc, common = np.zeros(len(q)), np.zeros(len(q))
    for d in range(p):
        both = ~np.isnan(q[:, d]) & ~np.isnan(b[:, d])
        diff = np.where(both, q[:, d], 0.0) - np.where(both, b[:, d], 0.0)
        acc += diff * diff
        common += both
    if (common == p).all():
        return acc
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, acc * (p / common), np.inf)


def _cross(q: DataFrame, rows: DataFrame, total: int, p: int, want: int, fill_missing: bool) -> DataFrame:
    """(id, slot, neighbour, d2, y): the `want` nearest of (id, x, y) per query (id, x), once a partition of the base side."""
    spark = q.sparkSession
    queries, cores = q.count(), spark.sparkContext.defaultParallelism

    def blocks(df: DataFrame, n: int, parts: int, values: Sequence[str]) -> DataFrame:
        packed = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").agg(
            F.collect_list(F.struct(*values)).alias("b"))
        return packed.repartition(parts).select("block", *[
            F.flatten(f"b.{v}").alias(v) if v == "x" else F.col(f"b.{v}").alias(v) for v in values]).checkpoint()

    size = max(1, min(CROSS_BLOCK, -(-queries // (2 * cores))))  # small tables still make work for all cores
    nq, nb = max(1, -(-queries // size)), max(1, -(-total // CROSS_BLOCK))
    left = blocks(q, nq, min(nq, 4 * cores), ("id", "x")).select("block", F.col("id").alias("q_id"), F.col("x").alias("q_x"))
    right = blocks(rows, nb, -(-nb // CROSS_BASE), ("id", "x", "y")).drop("block")
    id_type = q.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            for r in pdf.itertuples():  # the base blocks of a query block follow each other
                if r.block != at:
                    if state is not None:
                        yield from state.frames()
                    at, state = r.block, _Nearest(np.array(r.q_id.tolist()), np.asarray(r.q_x, dtype="float64").reshape(-1, p),
                                                  want, fill_missing)
                y = np.array([np.nan if v is None else v for v in r.y], dtype="float64")
                state.see(np.array(r.id.tolist()), np.asarray(r.x, dtype="float64").reshape(-1, p), y)
        if state is not None:
            yield from state.frames()

    # Not a broadcast of the queries: that would show them to one task for each part of the base, a pair of blocks at a time.
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInPandas(search, f"id {id_type}, slot int, neighbour {id_type}, d2 double, y double")


class _Cells:
    """The children of one node: pivots and summaries."""

    def __init__(self, children: Sequence):
        self.node = np.array([c["node"] for c in children])
        self.leaf = np.array([c["leaf"] for c in children], dtype=bool)
        self.n = np.array([c["n"] for c in children], dtype="float64")
        self.near, self.far = (np.array([c[f] for c in children], dtype="float64") for f in ("near", "far"))
        self.pivots, self.lo, self.hi = (
            np.array([[np.nan if v is None else v for v in c[f]] for c in children], dtype="float64") for f in ("pivot", "lo", "hi"))
        self.always = np.array([c["full"] for c in children], dtype="int64") == self.n[:, None]
        self.complete = self.always.all(1)

    def bounds(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from each query to each cell; `d` are the distances to the pivots."""
        p = x.shape[1]
        present = ~np.isnan(x)
        x0 = np.where(present, x, 0.0)
        out = np.zeros((len(x), len(self.n)))
        scale = p / np.maximum(present.sum(1), 1)
        for c in range(len(self.n)):
            use = present & self.always[c]
            lo, hi = np.nan_to_num(self.lo[c]), np.nan_to_num(self.hi[c])
            gap = np.maximum(np.maximum(lo - x0, x0 - hi), 0.0) * use
            out[:, c] = np.sqrt((gap**2).sum(1) * scale)
        with np.errstate(invalid="ignore"):
            ball = np.maximum(d - self.far[None, :], self.near[None, :] - d)
        ok = present.all(1)[:, None] & self.complete[None, :]
        out = np.where(ok, np.maximum(out, ball), out)
        return out * (1 - 1e-12) - 1e-12


def _chunked(rows: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """(by, one array per value): the rows of each `by` in chunks of about BLOCK rows, `x` laid flat."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    parted = rows.join(sizes, by).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    packed = parted.groupBy(by, "_part").agg(F.collect_list(F.struct(*values)).alias("_c"))
    return packed.select(by, *[F.flatten(f"_c.{v}").alias(v) if v == "x" else F.col(f"_c.{v}").alias(v) for v in values])


class Tree:
    """`rows` (id, x, y, cell): the base rows with their leaf; `nodes`: summaries of all cells but the root."""

    def __init__(self, rows: DataFrame, nodes: DataFrame | None, levels: int):
        self.rows, self.nodes, self.levels = rows, nodes, levels


def _summary(placed: DataFrame, p: int) -> DataFrame:
    comp = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    return placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("near"), F.max("r").alias("far"),
        F.array(*[F.min(comp(i)) for i in range(p)]).alias("lo"), F.array(*[F.max(comp(i)) for i in range(p)]).alias("hi"),
        F.array(*[F.count(comp(i)) for i in range(p)]).alias("full"))


def build_tree(rows: DataFrame, total: int, p: int) -> Tree:
    """Cut (id, x, y) into leaves of at most LEAF rows. A cell that its pivots do not divide stays a leaf."""
    id_type = rows.schema["id"].dataType.simpleString()
    placed = rows.withColumn("cell", F.lit(_ROOT).cast("bigint"))
    if total <= LEAF:
        return Tree(placed, None, 0)
    schema = f"id {id_type}, x array<double>, y double, cell bigint, r double"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                pivots = np.array([list(v) for v in r.pivots], dtype="float64").reshape(-1, p)
                x = np.asarray(r.x, dtype="float64").reshape(-1, p)
                d = np.sqrt(block_distances(x, pivots))
                d = np.where(np.isfinite(d), d, 1e300)
                best = d.argmin(1)
                yield pd.DataFrame({"id": r.id, "x": list(x), "y": np.array(r.y, dtype="float64"),
                                    "cell": r.cell * FAN + best, "r": d[np.arange(len(d)), best]})

    open_ = placed.sparkSession.createDataFrame([(_ROOT, total)], "cell bigint, n bigint")
    done, nodes, level = [], [], 0
    while level < LEVELS:
        inside = placed.join(open_, "cell").drop("n") if level else placed
        # A few more candidates than pivots, by hash, so that no cell is sorted whole.
        share = F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = placed.join(open_, "cell").filter(share < 4.0 * FAN / F.col("n"))
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id", "cell"), "id")
        pivots = drawn.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= FAN).groupBy("cell").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_i", "x"))), lambda v: v["x"]).alias("pivots")).checkpoint()
        cut = _chunked(inside.join(pivots.select("cell"), "cell", "left_semi"), "cell", ("id", "x", "y")).join(pivots, "cell")
        # Arrow hands missing components back as NULL; keep them as NaN.
        fresh = cut.select("cell", "id", "x", "y", "pivots").mapInPandas(assign, schema).withColumn("x", _vector("x")).checkpoint()
        level += 1
        parent = F.col("cell").cast("bigint")
        named = _summary(fresh, p).withColumn("parent", F.floor(parent / FAN).cast("bigint"))
        seed = pivots.select(F.col("cell").alias("parent"), F.posexplode("pivots").alias("_i", "pivot")).withColumn(
            "cell", F.col("parent") * FAN + F.col("_i")).drop("parent")
        named = named.join(seed.drop("_i"), "cell").join(
            open_.select(F.col("cell").alias("parent"), F.col("n").alias("_of")), "parent")
        grow = (F.col("n") > LEAF) & (F.col("n") < 0.95 * F.col("_of")) & F.lit(level < LEVELS)
        named = named.withColumn("leaf", ~grow).drop("_of").checkpoint()
        nodes.append(named)
        done.append(fresh.join(named.filter("leaf").select("cell"), "cell", "left_semi").select("id", "x", "y", "cell"))
        placed = fresh.join(named.filter("NOT leaf").select("cell"), "cell", "left_semi").select("id", "x", "y", "cell")
        open_ = named.filter("NOT leaf").select("cell", "n")
        if open_.isEmpty():
            break
    return Tree(union_all(done).checkpoint(), union_all(nodes).withColumnRenamed("cell", "node"), level)


class Base:
    """The base side of a search, ready for any number of query tables; without a tree all its rows are shown to every query."""

    def __init__(self, rows: DataFrame, total: int, p: int, tree: Tree | None = None):
        self.rows, self.total, self.p, self.tree = rows, total, p, tree
        if tree is None:
            return
        self.nb = tree.rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).checkpoint()
        packed = tree.rows.join(self.nb, "cell").withColumn(
            "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        ).groupBy("cell", "block").agg(F.collect_list(F.struct("id", "x", "y")).alias("b"))  # ~BLOCK rows each
        # Every visit reads the blocks: as a plan they would be put together again by each.
        self.packed = packed.select("cell", "block", F.col("b.id").alias("b_id"), F.flatten("b.x").alias("b_x"),
                                    F.col("b.y").alias("b_y")).checkpoint()
        fields = ("node", "leaf", "n", "near", "far", "pivot", "lo", "hi", "full")
        self.children = tree.nodes.groupBy(F.col("parent").alias("at")).agg(
            F.collect_list(F.struct(*fields)).alias("children")).checkpoint() if tree.levels else None  # FAN at most


def base_side(base: DataFrame, features: Sequence[str] | str, k: int = 5, key: str = "row_id", payload: str | None = "label",
              fill_missing: bool = False, small: bool = True) -> Base:
    """The rows that queries for k neighbours may meet, in a tree of cells unless they are few (and `small` allows that) or wide."""
    ensure_checkpoint_dir(base.sparkSession)
    y = F.col(payload).cast("double") if payload and not fill_missing else F.lit(None).cast("double")
    rows = base.select(F.col(key).alias("id"), _vector(features).alias("x"), y.alias("y"))
    if isinstance(features, str) or len(features) > TREE_DIMS:
        seen = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if seen[0] == 0:
            raise ValueError("the base side is empty")
        if seen[1] > TREE_DIMS:
            return Base(rows, *seen)
    copies = Window.partitionBy("x").orderBy("id")
    rows = rows.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= k + 1).drop("_c").checkpoint()
    total, p = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if total == 0:
        raise ValueError("the base side is empty")
    if total <= CROSS_ROWS and small:  # the walk is a dozen short jobs, whatever the size
        return Base(rows, total, p)
    return Base(rows, total, p, build_tree(rows, total, p))


def neighbours(
    queries: DataFrame, base: DataFrame | Base, features: Sequence[str] | str, k: int = 5, key: str = "row_id",
    payload: str | None = "label", exclude_self: bool = True, fill_missing: bool = False, report: dict | None = None,
) -> DataFrame:
    """(row_id, slot, rank, neighbour, distance, y): the k nearest base rows of every query row.

    `slot` is 0, or with fill_missing the index of a component missing in the query; then only base
    rows that have it count, and y is their value of it. Otherwise y is the payload column. `report` receives the
    numbers of leaves, queries and visits (query, leaf). A base that several tables are searched in may be given as
    `base_side` of the same arguments.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    q = queries.select(F.col(key).alias("id"), _vector(features).alias("x"))
    if fill_missing:
        q = q.filter(F.exists("x", F.isnan))
    nearest = Window.partitionBy("id", "slot").orderBy("d2", "neighbour")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)

    def named(one: DataFrame) -> DataFrame:
        return one.select(F.col("id").alias(key), "slot", "rank", "neighbour", F.sqrt("d2").alias("distance"), "y")

    side = base if isinstance(base, Base) else base_side(base, features, k, key, payload, fill_missing, small=report is None)
    p, tree = side.p, side.tree
    if tree is None:
        found = _cross(q, side.rows, side.total, p, k + 1, fill_missing)
        return named(best(found.filter(F.col("id") != F.col("neighbour")) if exclude_self else found).checkpoint())
    nb, packed, children = side.nb, side.packed, side.children
    id_type = q.schema["id"].dataType.simpleString()

    def step(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                cells = _Cells(r.children)
                xs = np.asarray(r.x, dtype="float64").reshape(-1, p)
                theta = np.array(r.theta, dtype="float64")
                d = np.sqrt(block_distances(xs, cells.pivots))
                lb = cells.bounds(xs, d)
                if first:  # the nearest cells that hold k + 1 rows together
                    order = np.lexsort((d, lb), axis=1)
                    filled = np.cumsum(cells.n[order], axis=1)
                    want = np.zeros(lb.shape, dtype=bool)
                    np.put_along_axis(want, order, (filled - cells.n[order]) < k + 1, axis=1)
                else:
                    want = lb <= theta[:, None]
                i, j = np.nonzero(want)
                yield pd.DataFrame({"id": np.asarray(r.id)[i], "x": list(xs[i]), "theta": theta[i], "at": cells.node[j],
                                    "leaf": cells.leaf[j], "lb": lb[i, j]})

    def walk(frontier: DataFrame, first: bool) -> DataFrame:
        """(id, x, cell, lb): the leaves that queries (id, x, theta) have to visit."""
        frontier = frontier.withColumn("at", F.lit(_ROOT).cast("bigint"))
        if not tree.levels:
            return frontier.select("id", "x", F.col("at").alias("cell"), F.lit(0.0).alias("lb"))
        found = []
        for _ in range(tree.levels):
            chunks = _chunked(frontier, "at", ("id", "x", "theta")).join(children, "at").select("id", "x", "theta", "children")
            out = chunks.mapInPandas(
                lambda batches: step(batches, first),
                f"id {id_type}, x array<double>, theta double, at bigint, leaf boolean, lb double").withColumn("x", _vector("x")).checkpoint()
            found.append(out.filter("leaf").select("id", "x", F.col("at").alias("cell"), "lb"))
            frontier = out.filter("NOT leaf").select("id", "x", "theta", "at")
        return union_all(found)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                qx = np.asarray(r.q_x, dtype="float64").reshape(-1, p)
                bx = np.asarray(r.b_x, dtype="float64").reshape(-1, p)
                qi, bi = np.asarray(r.q_id), np.asarray(r.b_id)
                by = np.array([np.nan if v is None else v for v in r.b_y], dtype="float64")
                yield _top(qx, bx, qi, bi, by, k + 1, fill_missing)

    def visit(v: DataFrame) -> DataFrame:
        """Pair query blocks with base blocks of the same leaf; keep the k nearest per query."""
        if report is not None:
            report["visits"] = report.get("visits", 0) + v.count()
        chunks = _chunked(v, "cell", ("id", "x")).select("cell", F.col("id").alias("q_id"), F.col("x").alias("q_x"))
        chunks = chunks.join(nb, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = chunks.join(packed, ["cell", "block"]).select("q_id", "q_x", "b_id", "b_x", "b_y")
        found = pairs.mapInPandas(
            distances, f"id {id_type}, slot int, neighbour {id_type}, d2 double, y double")
        return found.filter(F.col("id") != F.col("neighbour")) if exclude_self else found

    start = walk(q.withColumn("theta", F.lit(float("inf"))), True).checkpoint()
    if report is not None:
        report |= {"leaves": nb.count(), "queries": q.count()}
    one = best(visit(start)).checkpoint()
    if tree.levels:
        slots = F.size(F.filter("x", F.isnan)) if fill_missing else F.lit(1)

        def radius(now: DataFrame) -> DataFrame:
            kth = now.groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.max("d2").alias("worst"))
            return q.join(kth, "id", "left").select("id", "x", F.when(
                F.col("found") >= slots * k, F.sqrt("worst")).otherwise(F.lit(float("inf"))).alias("theta"))

        rest = walk(radius(one), False).join(start.select("id", "cell"), ["id", "cell"], "left_anti")
        by_bound = Window.partitionBy("id").orderBy("lb", "cell")
        rest = rest.withColumn("_turn", F.row_number().over(by_bound)).checkpoint()
        one = best(one.drop("rank").unionByName(visit(rest.filter(F.col("_turn") <= FIRST_LEAVES).select("id", "x", "cell")))).checkpoint()
        late = rest.filter(F.col("_turn") > FIRST_LEAVES).join(radius(one).select("id", "theta"), "id").filter(F.col("lb") <= F.col("theta"))
        one = best(one.drop("rank").unionByName(visit(late.select("id", "x", "cell").checkpoint())))
    return named(one)


def _top(qx, bx, qi, bi, by, k: int, fill_missing: bool) -> pd.DataFrame:
    """The k nearest base rows per query (and per missing component) of one block pair."""
    out = []
    for start in range(0, len(qx), 256):  # bounds the distance matrix
        sub = slice(start, start + 256)
        d2 = block_distances(qx[sub], bx)
        slots = range(qx.shape[1]) if fill_missing else (0,)
        for s in slots:
            r = np.nonzero(np.isnan(qx[sub][:, s]))[0] if fill_missing else np.arange(len(d2))
            c = np.nonzero(~np.isnan(bx[:, s]))[0] if fill_missing else np.arange(len(bx))
            if not len(r) or not len(c):
                continue
            part = d2[np.ix_(r, c)] if fill_missing else d2
            if part.shape[1] > k:
                cut = np.partition(part, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero((part <= cut[:, None]) & np.isfinite(part))
            else:
                i, j = np.nonzero(np.isfinite(part))
            order = np.lexsort((bi[c[j]], part[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            out.append(pd.DataFrame({
                "id": qi[sub][r[i]], "slot": np.full(len(i), s, dtype="int32"), "neighbour": bi[c[j]],
                "d2": part[i, j], "y": bx[c[j], s] if fill_missing else by[c[j]]}))
    if not out:
        return pd.DataFrame({"id": qi[:0], "slot": np.zeros(0, "int32"), "neighbour": bi[:0],
                             "d2": np.zeros(0), "y": np.zeros(0)})
    return pd.concat(out, ignore_index=True)


# ---- users of the join -----------------------------------------------------------------------

def knn_impute(df: DataFrame, features: Sequence[str], k: int = 5, key: str = "row_id",
               donors: DataFrame | Base | None = None) -> DataFrame:
    """Fill each missing component with the mean of the k nearest rows that have it."""
    base = donors if donors is not None else df
    near = neighbours(df, base, features, k, key, None, fill_missing=True)
    fills = near.groupBy(key).pivot("slot", list(range(len(features)))).agg(F.avg("y"))
    fills = fills.select(key, *[F.col(str(i)).alias(f"_f_{c}") for i, c in enumerate(features)])
    return df.join(fills, key, "left").withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}")) for c in features
    }).drop(*[f"_f_{c}" for c in features])


class KnnImputerModel(Model):
    def __init__(self, donors: DataFrame, features: Sequence[str], k: int, key: str):
        super().__init__()
        self.donors, self.features, self.k, self.key = donors, list(features), k, key
        self.side: Base | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.side is None:  # the training rows are filled first, then those of a test: both search the same tree
            self.side = base_side(self.donors, self.features, self.k, self.key, None, fill_missing=True)
        return knn_impute(dataset, self.features, self.k, self.key, self.side)


class KnnImputer(Estimator):
    """Fills from the k nearest training rows that have the value."""

    def __init__(self, features: Sequence[str], k: int = 5, key: str = "row_id"):
        super().__init__()
        self.features, self.k, self.key = list(features), k, key

    def _fit(self, dataset: DataFrame) -> KnnImputerModel:
        return KnnImputerModel(dataset, self.features, self.k, self.key)


class NeighboursModel(Model):
    def __init__(self, train: DataFrame, features: Sequence[str], k: int, key: str):
        super().__init__()
        self.train, self.features, self.k, self.key = train, list(features), k, key

    def _transform(self, dataset: DataFrame) -> DataFrame:
        votes = neighbours(dataset, self.train, self.features, self.k, self.key, "label", exclude_self=False)
        share = votes.groupBy(self.key).agg(F.avg("y").alias("score"))
        return dataset.join(share, self.key).withColumn("pred", (F.col("score") > 0.5).cast("int"))


class NearestNeighbours(Estimator):
    """Majority vote of the k nearest training rows (an even vote goes to class 0)."""

    def __init__(self, features: Sequence[str], k: int = 5, key: str = "row_id"):
        super().__init__()
        self.features, self.k, self.key = list(features), k, key

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        return NeighboursModel(dataset, self.features, self.k, self.key)
