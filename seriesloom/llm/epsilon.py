"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2 c)`` apart. A grid of that width is laid over the leading principal dimensions
and vectors are put in the order of their cells. The number of cells is bounded by the grid, whatever the table, so their
counts come to the driver, which joins the sequence with itself by halving: two intervals whose boxes are too far apart
are skipped, small ones become a pair of blocks. An interval with too many vectors is dealt into parts. Within a pair of
blocks the same test skips smaller intervals, and what is left is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, components, ship
from seriesloom.sources.artifacts import settle

COSINE = 0.9
LEADING = 5
BLOCK = 4096
SAMPLE = 4096
"""vectors that fix the principal dimensions; they decide only how much is skipped"""
INNER = 256
SLACK = 1e-6
FOUND = "rep long, h long, links long, root long"


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def principal(sample: list[list[float]], leading: int) -> dict[int, np.ndarray]:
    """Leading principal dimensions for each vector length in the sample."""
    out = {}
    for n in {len(v) for v in sample}:
        unit = _unit(np.array([v for v in sample if len(v) == n]))
        centred = unit - unit.mean(axis=0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        out[n] = np.ascontiguousarray(vectors[:, ::-1][:, :leading])
    return out


def basis_for(bases: dict[int, np.ndarray], n: int, leading: int) -> np.ndarray:
    return bases[n] if n in bases else np.eye(n)[:, :leading]


def cells_of(coordinates: np.ndarray, width: float, leading: int) -> np.ndarray:
    """One number per vector whose order is the grid order."""
    steps = math.floor(1 / width) + 1
    out = np.zeros(len(coordinates), np.int64)
    for k in range(leading):
        step = np.floor(coordinates[:, k] / width).astype(np.int64) if k < coordinates.shape[1] else np.zeros(len(coordinates), np.int64)
        out = out * (2 * steps) + np.clip(step + steps, 0, 2 * steps - 1)
    return out


class Sequence:
    """Cells in grid order, cut into intervals, and the pairs of intervals that have to be joined."""

    def __init__(self, counts: dict[tuple[int, int], int], width: float, leading: int, block: int):
        self.keys = sorted(counts)
        self.width, steps = width, 2 * (math.floor(1 / width) + 1)
        sizes = [counts[k] for k in self.keys]
        grid = np.array([[c // steps ** (leading - 1 - j) % steps for j in range(leading)] for _, c in self.keys], dtype=np.int64).reshape(-1, leading)
        self.of_cell: dict[tuple[int, int], int] = {}
        self.parts: list[int] = []
        boxes, dims, start = [], [], 0
        while start < len(self.keys):
            end, n = start + 1, sizes[start]
            while end < len(self.keys) and self.keys[end][0] == self.keys[start][0] and n + sizes[end] <= block:
                n += sizes[end]
                end += 1
            for k in range(start, end):
                self.of_cell[self.keys[k]] = len(self.parts)
            self.parts.append(max(1, -(-n // block)))
            boxes.append((grid[start:end].min(axis=0), grid[start:end].max(axis=0)))
            dims.append(self.keys[start][0])
            start = end
        self.low = np.array([b[0] for b in boxes]).reshape(-1, leading)
        self.high = np.array([b[1] for b in boxes]).reshape(-1, leading)
        self.dims = dims
        self.pairs: list[tuple[int, int]] = []
        if dims:
            self._join((0, len(dims)), (0, len(dims)))
        self.first: dict[tuple[int, int], int] = {}
        n = 0
        for pair in self.pairs:
            self.first[pair] = n
            n += self.parts[pair[0]] * self.parts[pair[1]]
        self.partners: list[list[int]] = [[] for _ in dims]
        for a, b in self.pairs:
            self.partners[a].append(b)
            if a != b:
                self.partners[b].append(a)

    def _apart(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether no vector of one range of intervals can be within the width of one of the other: cells are as wide."""
        gap = np.maximum(self.low[b[0] : b[1]].min(axis=0) - self.high[a[0] : a[1]].max(axis=0), self.low[a[0] : a[1]].min(axis=0) - self.high[b[0] : b[1]].max(axis=0)) - 1
        return float((np.maximum(gap, 0) ** 2).sum()) > 1 or bool((gap >= 1).any())

    def _join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if a != b and self._apart(a, b):
            return
        if a[1] - a[0] == 1 and b[1] - b[0] == 1:
            if self.dims[a[0]] == self.dims[b[0]]:
                self.pairs.append((a[0], b[0]))
            return
        halves = lambda r: [r] if r[1] - r[0] == 1 else [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])]
        for x in halves(a):
            for y in halves(b):
                if x[0] <= y[0]:
                    self._join(x, y)

    def tiles(self, interval: int, part: int) -> list[tuple[int, int]]:
        """(tile, side) of each pair of blocks that a part of an interval takes part in; side 2 joins the part with itself."""
        out = []
        for other in self.partners[interval]:
            n = self.parts[other]
            if other == interval:
                base = self.first[interval, interval]
                out += [(base + part * n + j, 0 if j > part else 2) for j in range(part, n)] + [(base + i * n + part, 1) for i in range(part)]
            elif interval < other:
                out += [(self.first[interval, other] + part * n + j, 0) for j in range(n)]
            else:
                out += [(self.first[other, interval] + i * self.parts[interval] + part, 1) for i in range(n)]
        return out


class Links:
    """Links found in a tile: weighted counts per vector and a forest that spans the linked ones."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), np.zeros(n, np.int64)

    def _find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = int(self.root[k])
        return k

    def add(self, mask: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Join what a block of links connects, one link per row in each turn, until no link leads out of a tree."""
        hit_rows, hit_columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        mask, rows, columns = mask[np.ix_(hit_rows, hit_columns)], rows[hit_rows], columns[hit_columns]
        while len(rows):
            roots = [np.array([self._find(int(k)) for k in side]) for side in (rows, columns)]
            open_ = mask & (roots[0][:, None] != roots[1][None, :])
            left = open_.any(axis=1)
            if not left.any():
                return
            for r, c in zip(rows[left].tolist(), columns[open_[left].argmax(axis=1)].tolist()):
                a, b = self._find(r), self._find(c)
                if a != b:
                    self.root[max(a, b)] = min(a, b)


def _order(unit: np.ndarray, basis: np.ndarray, width: float, leading: int) -> np.ndarray:
    at = unit @ basis
    return np.lexsort((*at.T[::-1], cells_of(at, width, leading)))


def join_tile(a: np.ndarray, b: np.ndarray | None, wa: np.ndarray, wb: np.ndarray | None, basis: np.ndarray, cosine: float, width: float, leading: int) -> Links:
    """Links between the unit vectors of two blocks, or within one."""
    same = b is None
    b, wb = (a, wa) if same else (b, wb)
    out = Links(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    orders = [_order(x, basis, width, leading) for x in (a, b)]
    cuts = [[o[k : k + INNER] for k in range(0, len(o), INNER)] for o in orders]
    boxes = [[((x[o] @ basis).min(axis=0), (x[o] @ basis).max(axis=0)) for o in c] for x, c in ((a, cuts[0]), (b, cuts[1]))]
    small = [x.astype(np.float32) for x in (a, b)]
    for i, rows in enumerate(cuts[0]):
        low, high = boxes[0][i]
        for j in range(i if same else 0, len(cuts[1])):
            columns = cuts[1][j]
            gap = np.maximum(np.maximum(boxes[1][j][0] - high, low - boxes[1][j][1]), 0)
            if float((gap * gap).sum()) > (width + SLACK) ** 2:
                continue
            near = small[0][rows] @ small[1][columns].T
            mask = near >= cosine
            close = np.argwhere(np.abs(near - cosine) < 1e-4)
            if len(close):
                exact = (a[rows[close[:, 0]]] * b[columns[close[:, 1]]]).sum(axis=1)
                mask[close[:, 0], close[:, 1]] = exact >= cosine
            if same and i == j:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            out.links[rows] += mask @ wb[columns]
            if not (same and i == j):
                out.links[columns + shift] += mask.T @ wa[rows]
            out.add(mask, rows, columns + shift)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing, nor
    do vectors of different lengths. Equal vectors are joined once, with their number as weight; they link with each other.
    """
    ship(vectors.sparkSession)
    width = math.sqrt(2 - 2 * cosine) + SLACK
    rows = columns_of(vectors, "vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alike = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    alike, _ = settle(alike.withColumn("h", F.xxhash64("embedding")), "vectors")
    sample = [r["embedding"] for r in alike.orderBy("h", "rep").limit(SAMPLE).select("embedding").collect()]
    bases = principal(sample, leading)

    def with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(0)])
            for n in np.unique(sizes):
                own = batch.filter(pa.array(sizes == n))
                at = _unit(_matrix(own.column(0))) @ basis_for(bases, int(n), leading)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(n)] * own.num_rows, pa.int32()), pa.array(cells_of(at, width, leading)), own.column(1), own.column(2), own.column(3), own.column(0)],
                    ["n", "cell", "rep", "m", "h", "embedding"],
                )

    element = alike.schema["embedding"].dataType.simpleString()
    placed = alike.select("embedding", "rep", "m", "h").mapInArrow(with_cells, f"n int, cell long, rep long, m long, h long, embedding {element}")
    placed, _ = settle(placed, "placed")
    sequence = Sequence({(r["n"], r["cell"]): r["k"] for r in placed.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("k")).collect()}, width, leading, block)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, sides, at = [], [], []
            for k, (n, cell, h) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 1, 4)])):
                interval = sequence.of_cell[n, cell]
                for tile, side in sequence.tiles(interval, (h >> 7) % sequence.parts[interval]):
                    tiles.append(tile)
                    sides.append(side)
                    at.append(k)
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tiles, pa.int64()), pa.array(sides, pa.int32()), *own.columns[2:]], ["tile", "side", "rep", "m", "h", "embedding"]
            )

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows.column("side").to_numpy()
        rep, h, m = (rows.column(c).to_numpy() for c in ("rep", "h", "m"))
        unit = _unit(_matrix(rows.column("embedding").chunk(0)))
        basis = basis_for(bases, unit.shape[1], leading)
        own = np.flatnonzero(side == 2)
        if len(own):
            order, found = own, join_tile(unit[own], None, m[own], None, basis, cosine, width, leading)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            order = np.concatenate([a, b])
            if not len(a) or not len(b):
                order = order[:0]
                found = Links(0)
            else:
                found = join_tile(unit[a], unit[b], m[a], m[b], basis, cosine, width, leading)
        hit = np.flatnonzero(found.links > 0)
        roots = np.array([found._find(int(k)) for k in hit], dtype=np.int64)
        return pa.table({"rep": rep[order[hit]], "h": h[order[hit]], "links": found.links[hit], "root": rep[order[roots]] if len(hit) else np.zeros(0, np.int64)})

    spread = placed.mapInArrow(dealt, f"tile long, side int, rep long, m long, h long, embedding {element}")
    found, _ = settle(spread.groupBy("tile").applyInArrow(joined, FOUND), "found")
    links = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        alike.select("embedding", "rep", "h", "m").join(links, ["rep", "h"], "left")
        .join(parts.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    known, _ = settle(known, "known")
    linked = rows.where(usable).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
