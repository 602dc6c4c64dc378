"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are rounded to int8 multiples of a scale of their own; the norm of what rounding took
away is kept. For tiles of vectors the int8 products are exact integers, and the true cosine of a
pair lies within (e1 + e2 + e1 e2) of the scaled product, e being those norms. Pairs surely above or
below the threshold are settled so; only the rest is computed in double precision. Before that, a
product of the projections on a few directions plus that of the norms of the rest bounds the cosine
from above; where it leaves few pairs, only those get int8 products. Equal vectors are one class and
take part once.

A tile is a row of one table, written once. Pairs of tiles are a Cartesian product of that table's
partitions, each of which is read from the shared folder by the tasks that need it, so no vector is
copied for the tiles it meets. A task returns counts and a spanning forest of its links, never the
links themselves.

Where there are many tiles, vectors are dealt to cells by their nearest pivot. Angles obey the
triangle inequality, so two cells whose pivots are further apart than both radii and the threshold's
angle hold no link, and none of their tiles meet. Where that would spare little, as for vectors that
fill all directions alike, tiles are cut from the rows as they stand.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .graph import UnionFind

_SLACK = 1e-6  # covers the rounding of the bounds themselves
#: Bytes of vectors in a tile, of tiles in a partition of theirs (a task reads two), and of prepared tiles that a worker keeps.
_TILE_BYTES, _PART_BYTES, _KEPT_BYTES = 8 << 20, 24 << 20, 96 << 20


def _vectors(column: pa.Array) -> tuple[list[np.ndarray | None]]:
    """float64 vectors; None where one is null, empty, zero, or holds a null or non-finite component."""
    flat = pc.list_flatten(column)
    flat = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    lengths = np.asarray(pc.list_value_length(column).fill_null(0))
    ends = np.cumsum(lengths)
    out: list[np.ndarray | None] = []
    for n, e in zip(lengths, ends, strict=True):
        v = flat[e - n : e]
        out.append(v if n and np.isfinite(v).all() and v.any() else None)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _vectors(batch.column("embedding"))
        data = [None if v is None else (v + 0.0).astype(dtype).tobytes() for v in vectors]
        yield pa.record_batch(
            {
                "vec_id": batch.column("vec_id"),
                "fp": pa.array([None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()),
                "vec": pa.array(data, pa.binary()),
            }
        )


@cache
def _directions(dim: int) -> np.ndarray | None:
    """Orthonormal columns to project on; None where these would not be far fewer than the dimensions."""
    few = max(24, dim // 8)
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, few)))[0] if 2 * few <= dim else None


class _Tile:
    """Unit vectors of one dimension, their int8 codes, scales and error norms.

    The products of `low` are no smaller than the cosines: projections on a few directions, and the norm of the rest.
    """

    def __init__(self, vectors: list[bytes], dtype: str = "<f8"):
        self.unit = _units(vectors, dtype)
        self.scale = np.abs(self.unit).max(1) / 127
        codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((self.unit - codes * self.scale[:, None]) ** 2).sum(1)) + _SLACK
        # BLAS has no int8 products: as floats of integers below 2^24 they are exact up to 1,040 dimensions, in double beyond.
        self.codes = codes.astype(np.float32 if codes.shape[1] <= 1040 else np.float64)
        directions = _directions(codes.shape[1])
        self.low = None
        if directions is not None:
            part = self.unit @ directions
            rest = np.sqrt(np.maximum(1 - (part**2).sum(1, keepdims=True), 0) + 1e-12)
            self.low = np.hstack([part, rest]).astype(np.float32)

    def nbytes(self) -> int:
        return self.unit.nbytes + self.codes.nbytes + (0 if self.low is None else self.low.nbytes)


def _near(a: _Tile, b: _Tile, threshold: float, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows of tile a: the first row, and the links as rows from it and rows of b."""
    sparse = a.low is not None and b.low is not None
    low = np.ascontiguousarray(b.low.T) if sparse else None
    for at in range(0, len(a.unit), rows):
        end = min(at + rows, len(a.unit))
        scale, error = a.scale[at:end], a.error[at:end]
        if sparse:
            # Rounding in single precision stays below (directions + 4) 2^-23 for products of unit vectors.
            maybe = np.flatnonzero(a.low[at:end] @ low >= np.float32(threshold - 2e-6 - (len(low) + 4) * 2.0**-23))
            # Many left, as in one dense cluster: whole products for what is left of this pair of tiles.
            sparse = len(maybe) <= (end - at) * len(b.unit) // 64
            if sparse:
                i, j = np.divmod(maybe, len(b.unit))
                product = np.einsum("ij,ij->i", a.codes[at + i], b.codes[j]) * b.scale[j] * scale[i]
        if not sparse:
            near = a.codes[at:end] @ b.codes.T
            near *= b.scale.astype(near.dtype)[None, :]
            # For all rows of b at once, with the largest of their errors: no pair that may link is missed.
            bound = error + b.error.max() * (1 + error) + 2e-6
            i, j = np.divmod(np.flatnonzero(near >= ((threshold - bound) / scale).astype(near.dtype)[:, None] * (1 - 1e-6)), len(b.unit))
            product = near[i, j].astype(np.float64) * scale[i]
        own = error[i] + b.error[j] * (1 + error[i]) + 2e-6
        sure = product - own >= threshold
        doubt = np.flatnonzero(~sure & (product + own >= threshold))
        for k in range(0, len(doubt), 65536):
            part = doubt[k : k + 65536]
            sure[part] = np.einsum("ij,ij->i", a.unit[at + i[part]], b.unit[j[part]]) >= threshold
        yield at, i[sure], j[sure]


def linked(a: _Tile, b: _Tile, threshold: float, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of rows of tile a: the first row and a boolean matrix of links to the rows of b."""
    for at, i, j in _near(a, b, threshold, rows):
        matrix = np.zeros((min(rows, len(a.unit) - at), len(b.unit)), bool)
        matrix[i, j] = True
        yield at, matrix


@dataclass
class Cells:
    """Pivots of the dimensions with many vectors, and which cells of them may hold links of each other."""

    pivots: dict[int, np.ndarray]  # unit rows by dimension
    radius: dict[int, np.ndarray]  # the largest angle of each cell, -1 for an empty one
    count: dict[int, np.ndarray]

    def may_meet(self, dim: int, threshold: float) -> np.ndarray:
        """Boolean matrix over the cells of a dimension."""
        pivots, radius = self.pivots[dim], self.radius[dim]
        apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
        return (apart - radius[:, None] - radius[None, :] <= np.arccos(threshold) + 1e-5) & (radius >= 0)[:, None] & (radius >= 0)[None, :]

    def spared(self, dim: int, threshold: float) -> float:
        """Share of the pairs of vectors that never meet."""
        weight = self.count[dim].astype(float)
        return 1 - float(weight @ self.may_meet(dim, threshold) @ weight) / weight.sum() ** 2


def _units(vectors: list[bytes], dtype: str) -> np.ndarray:
    raw = np.frombuffer(b"".join(vectors), dtype).astype(np.float64).reshape(len(vectors), -1)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def find_cells(classes: DataFrame, dims: dict[int, int], dtype: str, most_pivots: int, most_dims: int = 16) -> tuple[Cells, DataFrame]:
    """Cells of the dimensions in dims (dimension -> tiles) that have the most tiles, and classes with their `cell`.

    Pivots are the vectors with the smallest hashes, one for each tile and `most_pivots` at most.
    """
    chosen = sorted((d for d, tiles in dims.items() if tiles > 1), key=lambda d: (-dims[d], d))[:most_dims]
    pivots = {}
    for d in chosen:
        rows = classes.filter(F.col("dim") == d).orderBy("fp").limit(min(most_pivots, dims[d])).select("vec").collect()
        pivots[d] = _units([bytes(r["vec"]) for r in rows], dtype)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.asarray(batch.column("dim"))
            cell, angle = np.zeros(len(dim), np.int32), np.full(len(dim), np.pi)
            vec = batch.column("vec")
            for d, p in pivots.items():
                where = np.flatnonzero(dim == d)
                for k in range(0, len(where), 4096):
                    at = where[k : k + 4096]
                    near = _units([vec[int(i)].as_py() for i in at], dtype) @ p.T
                    cell[at] = near.argmax(1)
                    angle[at] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    dealt = classes.select("fp", "n", "rep", "vec", "dim").mapInArrow(nearest, "fp binary, n long, rep long, vec binary, dim int, cell int, angle double")
    dealt = common.materialize(dealt, "cells")
    cells = Cells(pivots, {d: np.full(len(p), -1.0) for d, p in pivots.items()}, {d: np.zeros(len(p), np.int64) for d, p in pivots.items()})
    # A row for each cell: their number is bounded by the two parameters.
    for r in dealt.filter(F.col("dim").isin(*chosen)).groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        cells.radius[r["dim"]][r["cell"]], cells.count[r["dim"]][r["cell"]] = r["radius"], r["n"]
    return cells, dealt


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile_rows: int = 4096, most_pivots: int = 256) -> DataFrame:
    """Compare all vectors by cosine; a row for each: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (array of numbers); other columns are ignored. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do vectors of unlike
    dimensions. n_links counts the other vectors at or above the threshold, equal ones included;
    component_id is the smallest vec_id reachable by links and kept marks it. Rows without vec_id
    count as links of others; they have no component and are kept. An empty table gives no rows.
    Every pair that the cells don't rule out is covered: at worst the work is quadratic in the number
    of distinct vectors, in tiles of `tile_rows` at most. What is written and shuffled grows with the
    vectors and not with their pairs. The table is read twice and has to be the same both times.
    """
    with common.Scope() as scope:
        return scope.keep(common.materialize(_labelled(vectors, threshold, tile_rows, most_pivots), "near-vectors"))


def _most_rows(dim: int, dtype: str, tile_rows: int) -> int:
    return min(tile_rows, max(1, _TILE_BYTES // (dim * int(dtype[-1]))))


def _pack(classes: DataFrame, dtype: str, tile_rows: int, meets: dict[tuple[int, int], list[int]]) -> DataFrame:
    """A row for each tile: id, dim, cell, meets (cells that may hold links; null: all), and its classes' fp, n, rep, vec one after the other.

    A tile holds vectors of one dimension, and of one cell where `meets` has that.
    """

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[pa.RecordBatch]] = {}
        held = 0

        def cut(key: tuple[int, int], whole_only: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(waiting.pop(key))
            most = _most_rows(key[0], dtype, tile_rows)
            end = len(rows) // most * most if whole_only else len(rows)
            held -= end * key[0] * int(dtype[-1])
            for at in range(0, end, most):
                part = rows.slice(at, min(most, end - at))
                rep = part.column("rep")
                packed = [
                    b"".join(part.column("fp").to_pylist()),
                    np.asarray(part.column("n")).astype("<i8").tobytes(),
                    np.asarray(rep.fill_null(0)).astype("<i8").tobytes(),
                    np.asarray(rep.is_null()).astype("u1").tobytes(),
                    b"".join(part.column("vec").to_pylist()),
                ]
                columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([meets.get(key)], pa.list_(pa.int32()))]
                yield pa.record_batch([*columns, *(pa.array([x], pa.binary()) for x in packed)], ["dim", "cell", "meets", "fp", "n", "rep", "none", "vec"])
            if end < len(rows):
                waiting[key] = rows.slice(end).to_batches()

        for batch in batches:
            dim, cell = np.asarray(batch.column("dim")), np.asarray(batch.column("cell"))
            for d in np.unique(dim).tolist():
                cells = np.unique(cell[dim == d]).tolist()
                own = [(d, c) for c in cells if (d, c) in meets]
                for key in own or [(d, 0)]:
                    at = np.flatnonzero((dim == d) & (cell == key[1])) if own else np.flatnonzero(dim == d)
                    waiting.setdefault(key, []).append(batch.take(pa.array(at)))
                    held += len(at) * d * int(dtype[-1])
                    if sum(map(len, waiting[key])) >= _most_rows(d, dtype, tile_rows):
                        yield from cut(key, True)
            if held > 4 * _TILE_BYTES:
                for key in list(waiting):
                    yield from cut(key, False)
        for key in list(waiting):
            yield from cut(key, False)

    schema = "dim int, cell int, meets array<int>, fp binary, n binary, rep binary, none binary, vec binary"
    return classes.select("fp", "n", "rep", "vec", "dim", "cell").mapInArrow(tiles, schema).withColumn("id", F.monotonically_increasing_id())


def _tiles(classes: DataFrame, tile_rows: int, most_pivots: int, dtype: str, threshold: float) -> tuple[DataFrame, int]:
    """The table of tiles, and the bytes in it. What it was made from is deleted."""
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each dimension that occurs
    dims = {d: -(-n // _most_rows(d, dtype, tile_rows)) for d, n in counts.items()}
    meets: dict[tuple[int, int], list[int]] = {}
    dealt = classes
    if any(t > 1 for t in dims.values()):
        cells, dealt = find_cells(classes, dims, dtype, most_pivots)
        common.discard(classes)
        for d in cells.pivots:
            if cells.spared(d, threshold) > 0.1:
                may = cells.may_meet(d, threshold)
                meets |= {(d, c): np.flatnonzero(may[c]).tolist() for c in np.flatnonzero(cells.count[d]).tolist()}
        given = dealt.repartitionByRange(common.shuffle_partitions(classes.sparkSession), "dim", "cell", "fp").sortWithinPartitions("dim", "cell") if meets else dealt
    else:
        given = classes.withColumn("cell", F.lit(0))
    packed = _pack(given, dtype, tile_rows, meets)
    # A file holds few tiles, so that files can be dealt evenly over partitions.
    size = sum(n * (d * int(dtype[-1]) + 33) for d, n in counts.items())
    per_file = max(1, min(sum(dims.values()) // 256, (4 << 20) // max(1, size // max(1, sum(dims.values())))))
    with common.setting(classes.sparkSession, "spark.sql.files.maxRecordsPerFile", str(per_file)):
        tiles = common.materialize(packed, "tiles")
    common.discard(dealt)
    return tiles, size


class _Links:
    """Links found by a task: counts and a spanning forest over the classes of all its tiles."""

    def __init__(self):
        self.first: dict[int, int] = {}  # a tile's first class
        self.parts: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        self.links = np.zeros(0, np.int64)
        self.sets = UnionFind(0)
        self.weight: dict[int, np.ndarray] = {}
        self.named: dict[int, np.ndarray] = {}

    def add(self, which: int, fp: bytes, n: bytes, rep: bytes, none: bytes) -> None:
        if which not in self.first:
            self.first[which] = len(self.links)
            self.weight[which], self.named[which] = np.frombuffer(n, "<i8"), np.frombuffer(none, "u1") == 0
            self.parts.append((fp, np.frombuffer(rep, "<i8"), self.named[which]))
            self.sets.root = np.concatenate([self.sets.root, len(self.links) + np.arange(len(none))])
            self.links = np.concatenate([self.links, np.zeros(len(none), np.int64)])

    def pair(self, i: int, j: int, a: _Tile, b: _Tile, threshold: float) -> None:
        x, y = self.first[i], self.first[j]
        own = UnionFind(len(a.unit) + (len(b.unit) if i != j else 0))
        shift = len(a.unit) if i != j else 0
        for at, p, q in _near(a, b, threshold):
            p = p + at
            if i == j:
                p, q = p[p != q], q[p != q]
            if not len(p):
                continue
            # Sums in double precision are exact below 2^53 rows.
            self.links[x : x + len(a.unit)] += np.bincount(p, self.weight[j][q], len(a.unit)).astype(np.int64)
            if i != j:
                self.links[y : y + len(b.unit)] += np.bincount(q, self.weight[i][p], len(b.unit)).astype(np.int64)
            # Rows without vec_id have no component, so nothing is reached through them.
            through = self.named[i][p] & self.named[j][q]
            own.join(p[through], shift + q[through])
        up = np.flatnonzero(own.root != np.arange(len(own.root)))
        place = lambda k: np.where(k < len(a.unit), x + k, y + k - len(a.unit))
        self.sets.join(place(up), place(own.root[up]))

    def batch(self) -> pa.RecordBatch:
        where = np.flatnonzero(self.links)
        fp = np.frombuffer(b"".join(p[0] for p in self.parts), "V16")
        rep = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in self.parts)])
        named = np.concatenate([np.zeros(0, bool), *(p[2] for p in self.parts)])
        root = self.sets.root[where]
        return pa.record_batch(
            {
                "fp": pa.array([x.tobytes() for x in fp[where]], pa.binary()),
                "links": pa.array(self.links[where]),
                "a": pa.array(rep[where], mask=~named[where]),
                "b": pa.array(rep[root], mask=~named[root]),
            }
        )


def _met(tiles: DataFrame, size: int, dtype: str, threshold: float) -> DataFrame:
    """fp, links, a, b of all pairs of tiles that may hold links. Each task reads two partitions of the table; nothing is shuffled."""
    spark = tiles.sparkSession

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kept = _Links(), OrderedDict()
        held = 0
        for batch in batches:
            for k in range(batch.num_rows):
                pair = []
                for side in "ab":
                    value = lambda name: batch.column(f"{side}_{name}")[k]  # noqa: B023, E731
                    which = value("id").as_py()
                    if which not in kept:
                        raw, dim = value("vec").as_buffer(), value("dim").as_py() * int(dtype[-1])
                        found.add(which, *(value(name).as_py() for name in ("fp", "n", "rep", "none")))
                        kept[which] = _Tile([raw[at : at + dim] for at in range(0, raw.size, dim)], dtype)
                        held += kept[which].nbytes()
                    kept.move_to_end(which)
                    pair.append((which, kept[which]))
                (i, a), (j, b) = pair
                found.pair(i, j, a, b, threshold)
                while held > _KEPT_BYTES and len(kept) > 2:
                    held -= kept.popitem(last=False)[1].nbytes()
        if len(found.links):
            yield found.batch()

    a, b = (tiles.select([F.col(c).alias(f"{side}_{c}") for c in tiles.columns]) for side in "ab")
    i, j = F.col("a_id"), F.col("b_id")
    # Of (i, j) and (j, i) one is taken, either as often, so that all pairs of partitions have like shares.
    once = (i == j) | ((i < j) == (F.pmod(F.xxhash64(F.least(i, j), F.greatest(i, j)), F.lit(2)) == 0))
    may = (F.col("a_dim") == F.col("b_dim")) & (F.col("a_meets").isNull() | F.array_contains("a_meets", F.col("b_cell"))) & once
    pairs = a.hint("shuffle_replicate_nl").join(b, may).drop("a_meets", "b_meets", "a_cell", "b_cell")
    parts = max(8, int((8 * spark.sparkContext.defaultParallelism) ** 0.5))
    with (
        common.setting(spark, "spark.sql.files.maxPartitionBytes", str(min(_PART_BYTES, max(1 << 20, size // parts)))),
        common.setting(spark, "spark.sql.files.openCostInBytes", str(1 << 16)),
        common.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2"),
    ):
        return common.materialize(pairs.mapInArrow(products, "fp binary, links long, a long, b long"), "tile-links")


def _labelled(vectors: DataFrame, threshold: float, tile_rows: int, most_pivots: int) -> DataFrame:
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Single precision holds vectors of floats as they are; anything else is kept in double.
    dtype = "<f4" if given.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    prints = given.mapInArrow(lambda batches: _fingerprints(batches, dtype), "vec_id long, fp binary, vec binary")
    classes = (
        prints.filter("fp IS NOT NULL")
        .groupBy("fp")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec"))
        .withColumn("dim", F.expr(f"cast(length(vec) div {dtype[-1]} as int)"))
    )
    classes = common.materialize(classes, "classes")
    named = common.materialize(classes.select("fp", "n", "rep"), "named")
    tiles, size = _tiles(classes, tile_rows, most_pivots, dtype, threshold)
    found = _met(tiles, size, dtype, threshold)
    common.discard(tiles)
    direct = found.groupBy("fp").agg(F.sum("links").alias("links"))
    joined = graph.components(found)
    summary = (
        named.join(direct, "fp", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("fp", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = prints.select("vec_id", "fp").join(summary, "fp", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
