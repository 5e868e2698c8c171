"""Approximate nearest neighbours: 2-stable projections indexed by kd-trees, verified until a chi-square test stops.

A unit vector is projected by a Gaussian matrix to few dimensions; for two vectors at distance d, the squared distance of
their projections divided by d**2 is chi-square distributed. So neighbours are verified (by their true cosine) in the order
of their projected distance, until the test says that a vector farther out in the projection is with ``confidence`` no
nearer than the k-th found so far: chi2(R**2 / d_k**2) >= confidence.

Index: the top of the tree, ``n_cells`` cells, is fitted on a bounded random sample (``sample_rows``) of projections; every
vector then goes to its cell and, by a hash, to one of the cell's blocks of about ``block_rows`` vectors. Each block is one
row of the index table: vectors, projections in kd order, boxes of the buckets. Search: a query first looks into one block
of its own cell, which bounds d_k, then into the blocks of all cells whose boxes the test doesn't rule out. Blocks meet
queries in slots of about ``slot_queries``, so a task holds one block and one slot. Equal query vectors are searched once.

What reaches the driver: the sample, and one box for each of at most ``max_cells`` cells, whatever the input's size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take
no part; vectors are compared with those of their own length only; an id stands for all its rows (repeated rows count
once, the best of several vectors counts, and none of a query id's rows is its neighbour); each different vector of a
query id is a query of its own; ties go to the smaller id; a query without candidates has no rows; an empty table gives
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WorkTables, arrow, written

#: Projected squared distances may differ by so much from rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """``dims``: of the projection (even). ``confidence``: that a neighbour isn't beyond where the search stops."""

    dims: int = 8
    confidence: float = 0.95
    block_rows: int = 2048
    bucket_rows: int = 128
    cell_blocks: int = 4
    max_cells: int = 4096
    sample_rows: int = 1 << 16
    slot_queries: int = 4096
    seed: int = 11


def chi_square(x: float, dims: int) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_bound(confidence: float, dims: int) -> float:
    """The x at which the distribution function is ``confidence``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < confidence else (low, mid)
    return high


@functools.lru_cache(maxsize=8)
def _matrix(size: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).normal(size=(size, dims))


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True) + 0.0


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of ``a`` (one each) and ``b`` (several each); the same vectors give the same value wherever they stand."""
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    dots, norms = (a[:, None, :] * b).sum(-1), np.sqrt((a * a).sum(-1))[:, None] * np.sqrt((b * b).sum(-1))
    return np.clip(dots / norms, -1, 1)


def _split(points: np.ndarray, members: np.ndarray) -> tuple[int, np.ndarray]:
    """The widest dimension and the members in the order of its halves."""
    own = points[members]
    dim = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
    return dim, members[np.argpartition(own[:, dim], (len(members) - 1) // 2)]


def fitted_cells(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim, cut) of the inner nodes of a complete kd-tree of 2**depth cells."""
    dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = {0: np.arange(len(points))}
    for node in range(2**depth - 1):
        members = parts.pop(node)
        if len(members):
            dims[node], members = _split(points, members)
            mid = (len(members) - 1) // 2
            cuts[node] = points[members[mid], dims[node]]
            parts[2 * node + 1], parts[2 * node + 2] = members[: mid + 1], members[mid + 1 :]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = members
    return dims, cuts


def cell_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dims, cuts = tree
    node = np.zeros(len(points), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > cuts[node])
    return node - len(dims)


def kd_order(points: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the points bucket by bucket of a kd-tree, and where buckets begin."""
    parts = [np.arange(len(points))]
    while max(map(len, parts)) > bucket:
        halves = []
        for members in parts:
            if len(members) > 1:
                _, members = _split(points, members)
            mid = (len(members) + 1) // 2
            halves += [members[:mid], members[mid:]]
        parts = [p for p in halves if len(p)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) from boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k, None]
        out += np.maximum(np.maximum(low[:, k] - p, p - high[:, k]), 0) ** 2
    return out


@dataclass
class Tree:
    """A block of the index: different unit vectors in kd order, each with its least ids."""

    vectors: np.ndarray
    points: np.ndarray
    bounds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ids: np.ndarray
    id_bounds: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, s: Settings, keep: int) -> Tree:
        """``keep``: of rows with one direction, so many with the least ids can be among anyone's nearest."""
        directions = np.ascontiguousarray(units(vectors))
        _, first, group = np.unique(directions.view(f"V{directions.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        points = directions[first] @ _matrix(vectors.shape[1], s.dims, s.seed)
        order, bounds = kd_order(points, s.bucket_rows)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = np.unique(np.stack([place[group], ids], axis=1), axis=0)  # by direction, then id; each once
        start = np.searchsorted(rows[:, 0], np.arange(len(order)))
        rows = rows[np.arange(len(rows)) - start[rows[:, 0]] < keep]
        points = points[order]
        low, high = np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1])
        return cls(vectors[first][order], points, bounds, low, high, rows[:, 1].copy(), np.searchsorted(rows[:, 0], np.arange(len(order) + 1)))

    def nearest(self, queries: np.ndarray, reach: np.ndarray, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of ``n`` neighbours of each query (-1: none), ``reach`` being squared distances not to pass.

        Buckets come in the order of their boxes' distance, a query's next one at a time; those that share it are
        multiplied at once. A vector is verified if its projection lies within what the chi-square test leaves open.
        """
        factor, wide = chi_square_bound(s.confidence, s.dims), queries.shape[1]
        directions, own = units(queries), units(self.vectors)
        projected = directions @ _matrix(wide, s.dims, s.seed)
        boxes = box_distances(projected, self.low, self.high)
        turns = np.argsort(boxes, axis=1, kind="stable")
        best, at, reach = np.full((len(queries), n), -2.0), np.full((len(queries), n), -1), reach.copy()
        active = np.arange(len(queries))
        for turn in range(len(self.low)):
            bucket = turns[active, turn]
            near = boxes[active, bucket] <= factor * reach[active] + SLACK
            active, bucket = active[near], bucket[near]  # the next boxes are farther still
            if not len(active):
                break
            by = np.argsort(bucket, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                who, (a, b) = active[group], self.bounds[bucket[group[0]] : bucket[group[0]] + 2]
                gaps = ((projected[who, None, :] - self.points[None, a:b]) ** 2).sum(-1)
                found = np.where(gaps <= factor * reach[who, None] + SLACK, directions[who] @ own[a:b].T, -2.0)
                both, places = np.concatenate([best[who], found], axis=1), np.concatenate([at[who], np.broadcast_to(np.arange(a, b), found.shape)], axis=1)
                top = np.argpartition(-both, n - 1, axis=1)[:, :n]
                best[who], at[who] = np.take_along_axis(both, top, 1), np.take_along_axis(places, top, 1)
                worst = best[who].min(axis=1)
                reach[who] = np.where(worst > -2, np.minimum(reach[who], 2 - 2 * worst), reach[who])
        at[best == -2] = -1
        return at, np.where(at >= 0, cosines(queries, self.vectors[at]), -2.0)

    def rows(self, places: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): the ``n`` best ids of each query."""
        query, k = np.nonzero(places >= 0)
        place, score = places[query, k], scores[query, k]
        size = self.id_bounds[place + 1] - self.id_bounds[place]
        each = np.repeat(np.arange(len(place)), size)
        ids = self.ids[self.id_bounds[place][each] + np.arange(len(each)) - (np.cumsum(size) - size)[each]]
        query, score = query[each], score[each]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < n
        return query[first], ids[first], score[first]


def _valid(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of those that take part, by length."""
    lists = batch.column(1)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths().fill_null(0)), 0)
    has_id = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    ids, flat = batch.column(0).fill_null(0).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[(sizes > 0) & has_id]).tolist():
        rows = np.flatnonzero((sizes == size) & has_id)
        vectors = flat[begin[rows][:, None] + np.arange(size)]
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if good.any():
            yield ids[rows[good]], vectors[good] + 0.0


def _kind(vectors: DataFrame, column: str) -> str:
    return "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"


def _bytes(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * vectors.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors).tobytes())]).cast(pa.binary())


def _vectors(column: pa.ChunkedArray, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size).astype(np.float64)


@dataclass
class Index:
    """``blocks``: the index table; ``low``, ``high``: boxes of the cells; ``cells``: (size, cell, n_blocks) with rows."""

    settings: Settings
    kind: str
    keep: int
    tree: tuple[np.ndarray, np.ndarray]
    blocks: DataFrame
    cells: DataFrame
    low: np.ndarray
    high: np.ndarray


def placed(vectors: DataFrame, kind: str, tree: tuple[np.ndarray, np.ndarray], s: Settings, keep: int) -> DataFrame:
    """(id, size, cell, vec) of the vectors that take part; of a batch's equal vectors, those with the ``keep`` least ids."""

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, own in _valid(batch, kind):
            size = own.shape[1]
            _, group = np.unique(np.ascontiguousarray(own).view(f"V{size * own.itemsize}").ravel(), return_inverse=True)
            order = np.lexsort((ids, group))
            order = order[np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(ids[order]) != 0)])]
            order = order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < keep]
            cell = cell_of(units(own[order].astype(np.float64)) @ _matrix(size, s.dims, s.seed), tree)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[order], pa.int64()), "size": pa.array(np.full(len(order), size), pa.int32()), "cell": pa.array(cell, pa.int32()), "vec": _bytes(own[order])})

    return vectors.mapInArrow(arrow(place), "id long, size int, cell int, vec binary")


def sampled(vectors: DataFrame, kind: str, rows: int, s: Settings) -> np.ndarray:
    """Projections of a random sample, of ``s.sample_rows`` rows at most."""

    def project(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, own in _valid(batch, kind):
            yield pa.RecordBatch.from_pydict({"p": _bytes(units(own.astype(np.float64)) @ _matrix(own.shape[1], s.dims, s.seed))})

    part = min(1.0, 0.9 * s.sample_rows / max(rows, 1))
    found = vectors.sample(part, seed=s.seed).mapInArrow(arrow(project), "p binary").limit(s.sample_rows).collect()
    return np.frombuffer(b"".join(bytes(r["p"]) for r in found), "<f8").reshape(-1, s.dims)


BLOCK = "size int, cell int, block int, low array<double>, high array<double>, vecs binary, points binary, bounds binary, ids binary, id_bounds binary"


def built(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", s: Settings = Settings()) -> Index:
    """Index all vectors that take part, for searches of ``k`` neighbours."""
    kind, keep, spark = _kind(vectors, vec_col), k + 1, vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    n = rows.count()
    depth = min(int(math.log2(s.max_cells)), max(0, math.ceil(math.log2(max(n, 1) / (s.block_rows * s.cell_blocks)))))
    tree = fitted_cells(sampled(rows, kind, n, s), depth)
    work = WorkTables(spark)
    own = work.written(placed(rows, kind, tree, s, keep), "vectors")
    cells = written(own.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / s.block_rows).cast("int").alias("n_blocks")), "cells")

    def pack(table: pa.Table) -> pa.Table:
        size, cell, block = (table[c][0].as_py() for c in ("size", "cell", "block"))
        t = Tree.of(table["id"].to_numpy(), _vectors(table["vec"], size, kind), s, keep)
        row = {"size": size, "cell": cell, "block": block, "low": t.low.min(axis=0).tolist(), "high": t.high.max(axis=0).tolist(), "vecs": t.vectors.astype(kind).tobytes()}
        row |= {name: getattr(t, name).astype(d).tobytes() for name, d in (("points", "<f8"), ("bounds", "<i8"), ("ids", "<i8"), ("id_bounds", "<i8"))}
        return pa.Table.from_pylist([row], SCHEMA)

    in_block = F.pmod(F.xxhash64("id", "vec"), F.col("n_blocks")).cast("int").alias("block")
    blocks = own.join(cells, ["size", "cell"]).select("id", "size", "cell", in_block, "vec").groupBy("size", "cell", "block").applyInArrow(pack, BLOCK)
    blocks = written(blocks, "blocks")
    low, high = np.full((2**depth, s.dims), np.inf), np.full((2**depth, s.dims), -np.inf)
    ends = [F.min(F.col("low")[d]).alias(f"l{d}") for d in range(s.dims)] + [F.max(F.col("high")[d]).alias(f"h{d}") for d in range(s.dims)]
    for r in blocks.groupBy("cell").agg(*ends).collect():  # max_cells rows at most
        low[r["cell"]], high[r["cell"]] = [r[f"l{d}"] for d in range(s.dims)], [r[f"h{d}"] for d in range(s.dims)]
    work.drop()
    return Index(s, kind, keep, tree, blocks, cells, low, high)


SCHEMA = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *[(c, pa.binary()) for c in ("vecs", "points", "bounds", "ids", "id_bounds")]])
PLACE = ["size", "cell", "block", "slot"]


def visited(index: Index, visits: DataFrame) -> DataFrame:
    """(query, id, score): of each (size, cell, block, slot, query, vec, reach), the best of that block."""
    s, kind, n = index.settings, index.kind, index.keep

    def look(block: pa.Table, queries: pa.Table) -> pa.Table:
        if not block.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        size, get = block["size"][0].as_py(), lambda c, d: np.frombuffer(block[c][0].as_py(), d)
        bounds, points = get("bounds", "<i8"), get("points", "<f8").reshape(-1, s.dims)
        low, high = np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1])
        tree = Tree(get("vecs", kind).reshape(-1, size).astype(np.float64), points, bounds, low, high, get("ids", "<i8"), get("id_bounds", "<i8"))
        parts = []
        for k in range(0, queries.num_rows, 512):
            part = queries[k : k + 512]
            places, scores = tree.nearest(_vectors(part["vec"], size, kind), part["reach"].to_numpy(), n, s)
            query, ids, score = tree.rows(places, scores, n)
            parts.append(pa.Table.from_arrays([part["query"].combine_chunks().take(pa.array(query)), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], schema=FOUND))
        return pa.concat_tables(parts)

    slots = visits.select(*PLACE[:3], F.col("slot").alias("for_slot")).distinct()
    wanted = index.blocks.drop("low", "high").join(slots, PLACE[:3]).groupBy(*PLACE[:3], "for_slot")
    return wanted.cogroup(visits.select(*PLACE, "query", "vec", "reach").groupBy(*PLACE)).applyInArrow(look, "query string, id long, score double")


FOUND = pa.schema([("query", pa.string()), ("id", pa.int64()), ("score", pa.float64())])


def _best(found: DataFrame, n: int) -> DataFrame:
    """(query, top): the ``n`` best of each query, best first."""
    once = found.repartition("query").groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
    return ranked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("top"))


def nearest(index: Index, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the index's ``k`` nearest vectors of each query row."""
    s, k, spark = index.settings, index.keep - 1, queries.sparkSession
    work = WorkTables(spark)
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    asked = work.written(placed(rows, index.kind, index.tree, s, 1 << 62).select("id", "size", "cell", "vec", F.md5("vec").alias("query")), "asked")
    members = asked.select("id", "query").distinct()
    once = asked.dropDuplicates(["query"])
    slots = max(1, math.ceil(once.count() / s.slot_queries))
    slot = F.pmod(F.xxhash64("query"), F.lit(slots)).cast("int").alias("slot")
    each = work.written(once.select("query", "size", "cell", "vec", slot), "queries")
    home = each.join(index.cells, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("query", F.lit(1)), F.col("n_blocks")).cast("int"))
    first = work.written(visited(index, home.withColumn("reach", F.lit(4.0))), "first")
    reach = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    open_to = F.when(F.col("n") >= index.keep, F.greatest(2 - 2 * F.col("worst"), F.lit(0.0))).otherwise(4.0)
    factor, low, high, kind = chi_square_bound(s.confidence, s.dims), index.low, index.high, index.kind

    def cells_left(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, bound = batch.column("size").to_numpy(), batch.column("reach").to_numpy()
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for part in np.split(rows, range(256, len(rows), 256)):
                directions = units(_vectors(batch.column("vec").take(pa.array(part)), size, kind))
                gaps = box_distances(directions @ _matrix(size, s.dims, s.seed), low, high)
                who, cell = np.nonzero(gaps <= factor * bound[part, None] + SLACK)
                own = batch.take(pa.array(part[who]))
                yield own.set_column(own.schema.get_field_index("cell"), "cell", pa.array(cell, pa.int32()))

    fields = "query string, size int, cell int, vec binary, slot int, reach double, home_cell int, home_block int"
    there = home.select("query", "size", "cell", "vec", "slot", F.col("cell").alias("home_cell"), F.col("block").alias("home_block"))
    bounded = each.join(there.select("query", "home_cell", "home_block"), "query", "left").join(reach, "query", "left").select("query", "size", "cell", "vec", "slot", F.coalesce(open_to, F.lit(4.0)).alias("reach"), "home_cell", "home_block")
    left = bounded.mapInArrow(arrow(cells_left), fields).join(index.cells, ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    seen: Column = F.coalesce((F.col("cell") == F.col("home_cell")) & (F.col("block") == F.col("home_block")), F.lit(False))
    rest = work.written(left.where(~seen).select(*PLACE, "query", "vec", "reach"), "visits")
    top = written(_best(first.unionByName(visited(index, rest)), index.keep), "nearest")
    members = written(members, "members")
    work.drop()
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, k)
    found = members.join(top, "query").select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "hit"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
