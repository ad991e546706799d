"""Exact top-k search by dual-tree traversal of cover trees.

Queries and data are unit vectors, on which cosine order is distance order.  Each is split into
cells around pivots, the upper level of the index.  A sample of every cell first gives each
query cell a bound on its worst kth score; the covering radii of cells then decide which data
cells a group of queries can need.  Groups receive only those, nearest first, and compare
trees: a pair of nodes is pruned if even the nearest points that the two covering radii
allow score less than the worst kth score of the query node, and where the leaves below a
pair would hardly be pruned, its points are compared as one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import id_numbers, quoted, written

#: Points in a leaf, and most children of a node; a node that needs more has them through nodes between.
LEAF, FAN = 256, 16
#: Rows a cell aims at, and most cells (the driver holds a pivot for each).
CELL_ROWS, MOST_CELLS = 2048, 4096
#: Most bytes of a group's query vectors, and of the data vectors that a group's task reads, at 4 bytes an element.
GROUP_BYTES, PART_BYTES = 32 << 20, 256 << 20
#: Rows of a cell that give its queries their first bound.
SEED_ROWS = 1024
#: Scores are ranked after rounding to so many digits, ties by id; the slack keeps pruning exact under rounding.
DIGITS = 6
SLACK = 2e-6
#: Scores in single precision are off by less than this.
ROUGH = 1e-5
#: Query and data rows of a block of scores, which stays in a core's cache.
BLOCK = 512, 1024
#: A pair of nodes is compared as a whole if it has at most so many pairs of points, or if radii leave at least this share of them.
FEW, DENSE = 1 << 16, 0.125


class CoverTree:
    """Points in an order in which each node is a range; arrays per node: start, stop, centre, radius, target, children.

    A node's children centre on its own points, chosen farthest first, so that they are farther apart
    than they cover.  The cover of a node that reached its target radius aims at half its radius; where
    FAN children don't reach that, they keep the target, and their own children go on towards it.
    The radius kept is the true covering radius.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.start: list[int] = []
        self.stop: list[int] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.target: list[float] = []
        self.children: list[list[int]] = []
        todo = [(0, len(points), -1, 2.0)] if len(points) else []
        while todo:
            a, b, parent, target = todo.pop()
            p = points[self.order[a:b]]
            centre = p[int(np.argmax(p @ p.mean(0)))]
            dist = distance(p @ centre)
            far = float(dist.max())
            node = len(self.start)
            self.start.append(a)
            self.stop.append(b)
            self.centre.append(centre)
            self.radius.append(far)
            self.target.append(target)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= LEAF or far <= 1e-3:
                continue
            aim = far / 2 if far <= target else target
            owner = np.zeros(b - a, np.int64)
            n = 1
            while n < FAN and dist.max() > aim:
                d = distance(p @ p[int(np.argmax(dist))])
                near = d < dist
                owner[near], dist[near] = n, d[near]
                n += 1
            by = np.argsort(owner, kind="stable")
            self.order[a:b] = self.order[a:b][by]
            cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
            todo += [(a + int(cuts[i]), a + int(cuts[i + 1]), node, aim) for i in range(n) if cuts[i + 1] > cuts[i]]
        self.sorted = points[self.order]
        self.rough = self.sorted.astype(np.float32)
        self.centres = np.array(self.centre).reshape(len(self.centre), -1)
        # the leaves in order of their points
        first = np.array(self.start, np.int64)
        leaves = np.array([n for n, below in enumerate(self.children) if not below], np.int64)
        leaves = leaves[np.argsort(first[leaves])]
        self.first, self.middle, self.reach = first[leaves], self.centres[leaves], np.array(self.radius)[leaves]
        self.size = np.array(self.stop, np.int64)[leaves] - self.first

    def leaves(self, node: int) -> slice:
        return slice(*np.searchsorted(self.first, [self.start[node], self.stop[node]]))


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few hits: eight places are looked at together."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.nonzero(mask)
    some = np.flatnonzero(flat.view(np.uint64))
    return np.divmod((some[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[some]], mask.shape[1])


class Search:
    """Running top k of a group's queries; ``floor`` has for each a score that its kth is known to reach."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, skip_self: bool, floor: np.ndarray | None = None):
        self.tree = CoverTree(points)
        self.ids, self.k, self.skip = ids[self.tree.order], k, skip_self
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor[self.tree.order]
        self.bar = self.floor.copy()
        self.room = np.empty(BLOCK[0] * BLOCK[1], np.float32)
        self.compared = 0

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        data = CoverTree(points)
        ids = ids[data.order]
        q = self.tree
        if not len(q.start) or not len(data.start):
            return
        self.bound(data, ids)
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            gap = float(distance(q.centres[a] @ data.centres[b])) - q.radius[a] - data.radius[b]
            most = 1 - gap * gap / 2 if gap > 0 else 1.0
            if most < self.bar[q.start[a] : q.stop[a]].min() - SLACK:
                continue
            mine, other = q.children[a], data.children[b]
            few = (q.stop[a] - q.start[a]) * (data.stop[b] - data.start[b]) <= FEW
            if few or (not mine and not other) or self.share(a, data, b, self.bar) >= DENSE:
                for j in range(data.start[b], data.stop[b], BLOCK[1]):
                    for i in range(q.start[a], q.stop[a], BLOCK[0]):
                        self.leaf(i, min(i + BLOCK[0], q.stop[a]), data, ids, j, min(j + BLOCK[1], data.stop[b]))
            elif mine and (not other or q.radius[a] >= data.radius[b]):
                stack += [(c, b) for c in mine]
            else:
                near = np.argsort(data.centres[other] @ q.centres[a])  # the nearest is popped first
                stack += [(a, other[int(i)]) for i in near]

    def share(self, a: int, data: CoverTree, b: int, bar: np.ndarray) -> float:
        """The share of the pairs of points below nodes a and b whose leaves aren't pruned by ``bar``."""
        q = self.tree
        m, o = q.leaves(a), data.leaves(b)
        gap = distance(q.middle[m] @ data.middle[o].T) - q.reach[m, None] - data.reach[o]
        worst = np.minimum.reduceat(bar[q.start[a] : q.stop[a]], q.first[m] - q.start[a])
        kept = np.where(gap > 0, 1 - gap * gap / 2, 1.0) >= worst[:, None] - SLACK
        return float(q.size[m] @ (kept @ data.size[o])) / (int(q.size[m].sum()) * int(data.size[o].sum()))

    def bound(self, data: CoverTree, ids: np.ndarray) -> None:
        """Queries without a bound get one from the leaves nearest to theirs, unless no bound would prune enough."""
        q, need = self.tree, self.k + self.skip
        open_ = np.isneginf(np.minimum.reduceat(self.bar, q.first))
        if not open_.any() or len(ids) < need or self.share(0, data, 0, np.ones(len(self.bar))) >= DENSE:
            return
        for n in np.flatnonzero(open_):
            a, b = q.first[n], q.first[n] + q.size[n]
            by = np.argsort(-(data.middle @ q.middle[n]), kind="stable")
            by = by[: int(np.searchsorted(np.cumsum(data.size[by]), need)) + 1]
            at = np.concatenate([np.arange(data.first[i], data.first[i] + data.size[i]) for i in by])
            rough = self.tree.rough[a:b] @ data.rough[at].T
            self.compared += rough.size
            kth = np.partition(rough, -need, axis=1)[:, -need].astype(float)
            self.floor[a:b] = np.maximum(self.floor[a:b], kth - (SLACK + ROUGH))
        self.bar = np.maximum(self.bar, self.floor)

    def leaf(self, a: int, b: int, data: CoverTree, ids: np.ndarray, start: int, stop: int) -> None:
        """Compare queries a..b with data start..stop: roughly first, exactly where the rough score may count."""
        rough = np.matmul(self.tree.rough[a:b], data.rough[start:stop].T, out=self.room[: (b - a) * (stop - start)].reshape(b - a, -1))
        self.compared += rough.size
        edge = self.bar[a:b] - (SLACK + ROUGH)
        need = self.k + self.skip
        blank = np.flatnonzero(np.isneginf(edge))
        if len(blank) and need <= stop - start:  # the kth of the block itself is a bound
            edge[blank] = np.partition(rough[blank], -need, axis=1)[:, -need] - (SLACK + 2 * ROUGH)
        hit = np.flatnonzero(rough.max(axis=1) >= edge)
        if not len(hit):
            return
        r, c = places(rough[hit] >= edge[hit, None].astype(np.float32))
        r, c = hit[r], c + start
        if self.skip:
            other = self.ids[a + r] != ids[c]
            r, c = r[other], c[other]
        if not len(r):
            return
        v = np.empty(len(r))
        for i in range(0, len(r), 65_536):
            v[i : i + 65_536] = np.einsum("ij,ij->i", self.tree.sorted[a + r[i : i + 65_536]], data.sorted[c[i : i + 65_536]])
        v = np.round(v, DIGITS) + 0.0
        rows = r[np.flatnonzero(np.diff(r, prepend=-1))]
        row = np.concatenate([np.repeat(rows, self.k), r])
        val = np.concatenate([self.score[a + rows].ravel(), v])
        who = np.concatenate([self.found[a + rows].ravel(), ids[c]])
        by = np.lexsort((who, -val, row))
        row, val, who = row[by], val[by], who[by]
        take = np.searchsorted(row, rows)[:, None] + np.arange(self.k)
        self.score[a + rows] = val[take]
        self.found[a + rows] = who[take]
        self.bar[a + rows] = np.maximum(self.floor[a + rows], val[take[:, -1]])


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clean(df: DataFrame) -> DataFrame:
    """(id, vec) of rows (id, vec) with one row an id; without null ids and vectors that have no direction."""
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = df.select("id", "vec").filter("id IS NOT NULL AND vec IS NOT NULL").withColumn("n2", norm)
    return rows.filter("n2 > 0 AND n2 < double('Infinity')").groupBy("id").agg(F.min("vec").alias("vec"))


def _assign(pivots: np.ndarray):
    rough = pivots.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                points = unit(part.column(1))
                cell = np.argmax(points.astype(np.float32) @ rough.T, axis=1)  # any cell would do, if the radius is exact
                far = distance(np.einsum("ij,ij->i", points, pivots[cell]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "vec", "cell", "far"])

    return run


def _search(k: int, skip_self: bool):
    """Rows (task, side, low, cell, id, vec, floor) sorted by task, side, low and cell: queries (side 0), then data cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"task": None, "side": 0, "held": [], "search": None}

        def flush() -> None:
            """Use the rows held: queries start a search, data rows are compared."""
            if state["held"]:
                ids, points, floor = (np.concatenate(x) for x in zip(*state["held"]))
                state["held"] = []
                if state["side"] == 0:
                    state["search"] = Search(ids, points, k, skip_self, floor)
                elif state["search"] is not None:
                    state["search"].add(ids, points)

        def result() -> Iterator[pa.RecordBatch]:
            s, state["search"] = state["search"], None
            if s is None:
                return
            for a in range(0, len(s.ids), 16384):
                score, found = s.score[a : a + 16384], s.found[a : a + 16384]
                row, rank = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[a + row]), pa.array(found[row, rank]), pa.array((rank + 1).astype(np.int32)), pa.array(score[row, rank])], ["id", "neighbor_id", "rank", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            task, side, cell = (batch.column(i).to_numpy() for i in (0, 1, 3))
            ids, points, floor = batch.column(4).to_numpy(), unit(batch.column(5)), batch.column(6).to_numpy()
            cut = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1]) | ((cell[1:] != cell[:-1]) & (side[1:] == 1))])
            for a, b in zip(cut, np.r_[cut[1:], len(task)]):
                here = (task[a], side[a], cell[a] if side[a] else -1)
                if here != state.get("here") or (side[a] and sum(len(i) for i, _, _ in state["held"]) >= 8192):
                    flush()
                    if state["task"] != task[a]:
                        yield from result()
                        state["task"] = task[a]
                    state["here"], state["side"] = here, side[a]
                state["held"].append((ids[a:b], points[a:b], floor[a:b]))
        flush()
        yield from result()

    return run


SCHEMA = "id long, neighbor_id long, rank int, score double"


def _numbers(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(columns))


def _compared(ask: DataFrame, data: DataFrame, tasks: int, k: int, skip_self: bool) -> DataFrame:
    """Results of the rows ``ask`` (task, cell, id, vec, floor) against ``data`` (task, low, cell, id, vec) of the same task."""
    q = ask.select("task", F.lit(0).alias("side"), F.lit(0.0).alias("low"), "cell", "id", "vec", "floor")
    d = data.select("task", F.lit(1).alias("side"), "low", "cell", "id", "vec", F.lit(0.0).alias("floor"))
    rows = q.unionAll(d).repartitionByRange(tasks, "task").sortWithinPartitions("task", "side", "low", "cell", "id")
    return rows.mapInArrow(_search(k, skip_self), SCHEMA)


def top_k(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None, skip_self: bool | None = None) -> DataFrame:
    """(id, neighbor_id, rank, score): the k rows of ``df`` with the largest cosine for every query.

    Without ``queries`` every row of ``df`` is a query.  With ``skip_self`` (the default without
    ``queries``) a row isn't a neighbour of the query of the same id.  Scores are
    rounded to 6 digits; ties rank by id, so the result is exact and unique.

    The driver holds the pivots, at most 4096 vectors, and one line of statistics for each cell, and for each
    cell and group; all vectors stay on the executors.  A group has at most ``GROUP_BYTES`` of query vectors, and a
    data cell is sent once to each group that may need it.  The data that a group needs is spread over tasks of at
    about ``PART_BYTES``, whose k best a window merges; so neither all queries nor all data meet in one task.

    Defined results: a row with a null id, a null vector, a null, infinite or not-a-number
    element, or the zero vector is neither query nor neighbour, nor is a vector of other than the
    commonest length (of the shorter at a tie), however long; rows that repeat an id count once, with the least vector;
    fewer than k others give fewer rows; empty tables give none; extra columns are ignored, whatever their names; ids may have
    any type that sorts, and keep it.
    """
    spark = df.sparkSession
    skip_self = queries is None if skip_self is None else skip_self
    sides = [d.select(F.col(quoted(id_col)).alias("key"), F.col(quoted(vec_col)).cast("array<float>").alias("vec")) for d in ([df] if queries is None else [df, queries])]
    kind = sides[0].schema["key"].dataType
    ask_kind = sides[-1].schema["key"].dataType
    sides, names = id_numbers(sides, "key")

    def named(found: DataFrame) -> DataFrame:
        if names is None:
            return found.withColumns({"id": F.col("id").cast(ask_kind), "neighbor_id": F.col("neighbor_id").cast(kind)})
        other = names.select(F.col("name").alias("other"), F.col("id").alias("neighbor_id"))
        return found.join(names, "id").join(other, "neighbor_id").select(F.col("name").cast(ask_kind).alias("id"), F.col("other").cast(kind).alias("neighbor_id"), "rank", "score")

    sides = [clean(s) for s in sides]
    sizes = sides[0].groupBy(F.size("vec").alias("d")).count().collect()
    if not sizes:
        return named(spark.createDataFrame([], SCHEMA))
    dim, n = max(((r["d"], r["count"]) for r in sizes), key=lambda x: (x[1], -x[0]))
    sides = [s.filter(F.size("vec") == dim) for s in sides]
    m = min(max(1, -(-n // CELL_ROWS)), MOST_CELLS)
    turn = F.xxhash64("id", F.lit("pivot"))
    chosen = sides[0].orderBy(turn, "id").limit(m).select("vec").collect()
    pivots = np.array([r["vec"] for r in chosen], np.float64)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    kept = [written(s.mapInArrow(_assign(pivots), "id long, vec array<float>, cell int, far double"), "cells") for s in sides]
    stats = [{r["cell"]: (r["n"], r["far"]) for r in s.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()} for s in kept]
    data, ask = stats[0], stats[-1]
    if not ask:
        return named(spark.createDataFrame([], SCHEMA))

    # queries: neighbouring cells form a group; a cell with many queries is split
    total, cores = sum(x[0] for x in ask.values()), spark.sparkContext.defaultParallelism
    groups = max(-(-total * dim * 4 // GROUP_BYTES), 1)
    target = -(-total // groups)
    parts, group, filled = [], 0, 0
    for c in (int(x) for x in CoverTree(pivots).order if int(x) in ask):
        splits = max(1, -(-ask[c][0] // target))
        for part in range(splits):
            if filled >= target:
                group, filled = group + 1, 0
            parts.append((c, splits, part, group))
            filled += ask[c][0] // splits + 1
    of = np.array(parts, np.int32).reshape(-1, 4)
    groups = group + 1
    to_group = _numbers(spark, q_cell=of[:, 0], splits=of[:, 1], part=of[:, 2], grp=of[:, 3])
    grouped = kept[-1].join(F.broadcast(to_group), (F.col("cell") == F.col("q_cell")) & (F.pmod(F.xxhash64("id", F.lit("part")), F.col("splits")) == F.col("part"))).select("grp", "cell", "id", "vec")

    # a first bound for every query cell, from a sample of its own data cell
    cells = np.array(sorted(data), np.int32)
    count, reach = np.array([data[c][0] for c in cells]), np.array([data[c][1] for c in cells])
    step = _numbers(spark, s_cell=cells, step=np.maximum(1, -(-count // SEED_ROWS)).astype(np.int64))
    sample = kept[0].join(F.broadcast(step), F.col("cell") == F.col("s_cell")).filter(F.pmod(F.xxhash64("id", F.lit("seed")), F.col("step")) == 0)
    own = to_group.select(F.col("q_cell").alias("o_cell"), F.col("grp")).distinct()
    pair = (F.col("grp").cast("long") * MOST_CELLS + F.col("cell")).alias("task")  # queries meet the sample of their own cell alone
    seeds = sample.join(F.broadcast(own), F.col("cell") == F.col("o_cell")).select(pair, F.lit(0.0).alias("low"), "cell", "id", "vec")
    seeded = max(groups, min(2 * cores, len(parts)))
    first = _compared(grouped.select(pair, "cell", "id", "vec", F.lit(float("-inf")).alias("floor")), seeds, seeded, k, skip_self)
    bounds = written(first.filter(F.col("rank") == k).select("id", F.col("score").alias("floor")), "bounds")
    known = grouped.join(bounds, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    worst = {(r["grp"], r["cell"]): r["floor"] for r in known.groupBy("grp", "cell").agg(F.min("floor").alias("floor")).collect()}

    # which data cells a group can need, by covering radii against that bound
    near = distance(np.clip(pivots @ pivots[cells].T, -1, 1))
    low = np.full((groups, len(cells)), np.inf)
    for c, _, _, g in parts:
        if (g, c) in worst:
            gap = near[c] - ask[c][1] - reach
            reached = distance(np.array(max(-1.0, worst[g, c] - SLACK))) if np.isfinite(worst[g, c]) else np.inf
            low[g] = np.where(gap <= reached + 1e-6, np.minimum(low[g], gap), low[g])
    spread = max(-(-n * dim * 4 // PART_BYTES), min(-(-2 * cores // groups), -(-n // 4096)), 1)
    order = CoverTree(pivots[cells]).order  # neighbouring cells share a task; a cell with many rows lies in several
    start = np.empty(len(cells), np.int64)
    start[order] = np.cumsum(count[order]) - count[order]
    where = _numbers(spark, w_cell=cells, first=start, size=count.astype(np.int64))
    g, c = np.nonzero(np.isfinite(low))
    sent = _numbers(spark, d_cell=cells[c], grp=g.astype(np.int32), low=low[g, c])
    slot = F.least(F.floor((F.col("first") + F.pmod(F.xxhash64("id", F.lit("slot")), F.col("size"))) * spread / n), F.lit(spread - 1))
    placed = kept[0].join(F.broadcast(where), F.col("cell") == F.col("w_cell")).withColumn("slot", slot.cast("int"))
    rows = placed.join(sent, F.col("cell") == F.col("d_cell")).select((F.col("grp") * spread + F.col("slot")).alias("task"), "low", "cell", "id", "vec")
    tasks = groups * spread
    asked = known.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda i: F.col("grp") * spread + i))).select("task", "cell", "id", "vec", "floor")
    found = _compared(asked, rows, tasks, k, skip_self)
    if spread > 1:
        best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbor_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return named(found)


#: The production query asks for every row whose id is divisible by this.
ASK_EVERY = 20


def op1_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest others, among all embeddings, of every embedding whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = top_k(rows, 10, queries=rows.filter(F.col("vec_id") % ASK_EVERY == 0), skip_self=True)
    return found.select(F.col("id").alias("vec_id"), "neighbor_id", "rank", "score")


OP1_SQL = f"""
WITH v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), {DIGITS}) + 0.0 AS score FROM v a JOIN v b ON a.vec_id % {ASK_EVERY} = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, neighbor_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM p) WHERE rank <= 10
"""
