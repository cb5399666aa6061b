"""Array work done inside Spark tasks: design rows, sums of products, the small solve, predictions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pyarrow as pa

from seriesloom.models.spec import SEASONAL_BLOCKS

ACCUMULATOR_BYTES = 64 << 20


def block_columns(layout: int) -> int:
    return sum(2 * n for i, (_, _, n) in enumerate(SEASONAL_BLOCKS) if layout >> i & 1)


def trend_rows(t: np.ndarray, knots: np.ndarray, most: int, reach: float) -> np.ndarray:
    """Columns 1, t and one hinge per knot. Row i has ``knots[i]`` knots, even over the first part of its history;
    the remaining hinge columns are 0."""
    out = np.zeros((len(t), 2 + most))
    out[:, 0] = 1.0
    out[:, 1] = t
    if most:
        number = np.arange(1, most + 1)
        count = knots.reshape(-1, 1)
        place = reach * number / np.maximum(count, 1)
        out[:, 2:] = np.where(number <= count, np.maximum(t.reshape(-1, 1) - place, 0.0), 0.0)
    return out


def season_rows(days: np.ndarray, active: np.ndarray, layout: int) -> np.ndarray:
    """Sine and cosine columns of each block of the layout; 0 where the block is off for a row's key."""
    parts = []
    for i, (_, period, harmonics) in enumerate(SEASONAL_BLOCKS):
        if not layout >> i & 1:
            continue
        turn = np.exp(2j * np.pi * np.mod(days / period, 1.0))
        waves = np.cumprod(np.repeat(turn[:, None], harmonics, axis=1), axis=1)
        on = (active >> i & 1).astype(float)[:, None]
        block = np.empty((len(days), 2 * harmonics))
        block[:, 0::2] = waves.imag * on
        block[:, 1::2] = waves.real * on
        parts.append(block)
    return np.hstack(parts) if parts else np.zeros((len(days), 0))


def numbers(batch: pa.RecordBatch, name: str, dtype=float) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False), dtype=dtype)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """Inverse of :func:`matrix`."""
    height, width = rows.shape
    offsets = np.arange(height + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def blobs(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values; these cross between Spark and the tasks in one copy each."""
    return pa.array([row.tobytes() for row in rows], pa.binary())


def from_blobs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist())).reshape(batch.num_rows, -1)


def batch_of(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the declared schema; columns that differ in type are cast."""
    cast = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(cast, schema=schema)


def group_codes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """One integer per row that tells the groups of a batch apart."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for name in names:
        part = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        code = code * (int(part.max(initial=0)) + 1) + part
        code = np.unique(code, return_inverse=True)[1]
    return code


def segments(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Position of a first row and positions of all rows of each group."""
    if not batch.num_rows:
        return
    code = group_codes(batch, names)
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order])) + 1
    for rows in np.split(order, edges):
        yield int(rows[0]), rows


def sums_batch(groups: list[tuple[list, list[np.ndarray]]], schema: pa.Schema, carried: list[str]) -> pa.RecordBatch:
    columns = [pa.array([g[0][i] for g in groups], schema.field(name).type) for i, name in enumerate(carried)]
    columns += [blobs([g[1][i] for g in groups]) for i in range(len(schema) - len(carried))]
    return batch_of(columns, schema)


class Sums:
    """Vectors added up per group. Groups are given out when too many are open, so memory stays bounded;
    a group given out more than once is added up again by the merge that follows."""

    def __init__(self, schema: pa.Schema, carried: list[str], width: int):
        self.schema, self.carried = schema, carried
        self.most = max(64, ACCUMULATOR_BYTES // max(1, width * 8 * (len(schema) - len(carried))))
        self.open: dict[tuple, tuple[list, list[np.ndarray]]] = {}

    def add(self, batch: pa.RecordBatch, first: int, group: list[str], vectors: list[np.ndarray]) -> None:
        name = tuple(batch.column(g)[first].as_py() for g in group)
        held = self.open.get(name)
        if held is None:
            self.open[name] = ([batch.column(c)[first].as_py() for c in self.carried], vectors)
        else:
            for total, vector in zip(held[1], vectors, strict=True):
                total += vector

    def full(self) -> bool:
        return len(self.open) > self.most

    def drain(self) -> Iterator[pa.RecordBatch]:
        held, self.open = list(self.open.values()), {}
        for start in range(0, len(held), 256):
            yield sums_batch(held[start : start + 256], self.schema, self.carried)


def packed_width(columns: int) -> int:
    """Upper triangle, cross products, sum of squares, rows, seconds."""
    return columns * (columns + 1) // 2 + columns + 3


_triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def upper_triangle(columns: int) -> tuple[np.ndarray, np.ndarray]:
    if columns not in _triangles:
        _triangles[columns] = np.triu_indices(columns)
    return _triangles[columns]


def pack(x: np.ndarray, y: np.ndarray, seconds: float) -> np.ndarray:
    upper = upper_triangle(x.shape[1])
    return np.concatenate([(x.T @ x)[upper], x.T @ y, [y @ y, len(y), seconds]])


def unpack(rows: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stacked (A, b, yy, n, seconds)."""
    size = columns * (columns + 1) // 2
    upper = upper_triangle(columns)
    a = np.zeros((len(rows), columns, columns))
    a[:, upper[0], upper[1]] = rows[:, :size]
    a[:, upper[1], upper[0]] = rows[:, :size]
    return a, rows[:, size : size + columns], rows[:, -3], rows[:, -2], rows[:, -1]


def design(batch: pa.RecordBatch, knots: int, layout: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season columns of a batch of rows that carry the basis of their key."""
    day = numbers(batch, "_day")
    t = (day - numbers(batch, "_start")) / numbers(batch, "_span")
    trend = trend_rows(t, numbers(batch, "_knots", np.int64), knots, reach)
    return trend, season_rows(day, numbers(batch, "_seasons", np.int64), layout)


def sum_products(
    batches: Iterator[pa.RecordBatch],
    schema: pa.Schema,
    group: list[str],
    carried: list[str],
    knots: int,
    layout: int,
    reach: float,
) -> Iterator[pa.RecordBatch]:
    """Products of the design rows summed per group."""
    width = 2 + knots + block_columns(layout)
    sums = Sums(schema, carried, packed_width(width))
    for batch in batches:
        began = time.perf_counter()
        x = np.hstack(design(batch, knots, layout, reach))
        # the middle of the key's range is taken off, so that sums keep their digits whatever the level
        y = (numbers(batch, "y") - numbers(batch, "_level")) / numbers(batch, "_scale")
        share = (time.perf_counter() - began) / max(1, batch.num_rows)
        for first, rows in segments(batch, group):
            began = time.perf_counter()
            vector = pack(x[rows], y[rows], 0.0)
            vector[-1] = share * len(rows) + time.perf_counter() - began
            sums.add(batch, first, group, [vector])
        if sums.full():
            yield from sums.drain()
    yield from sums.drain()


def merge_sums(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, group: list[str], carried: list[str], parts: list[str]
) -> Iterator[pa.RecordBatch]:
    """Add up the partial sums of sorted groups; a group is given out once, when the next one begins."""
    name, held = None, None
    done: list[tuple[list, list[np.ndarray]]] = []
    for batch in batches:
        stacks = [from_blobs(batch, part) for part in parts]
        ids = list(zip(*[batch.column(g).to_pylist() for g in group], strict=True))
        for i, this in enumerate(ids):
            if this == name:
                for total, stack in zip(held[1], stacks, strict=True):
                    total += stack[i]
                continue
            if held is not None:
                done.append(held)
            name = this
            held = ([batch.column(c)[i].as_py() for c in carried], [stack[i].copy() for stack in stacks])
        if len(done) >= 64:
            yield sums_batch(done, schema, carried)
            done = []
    if held is not None:
        done.append(held)
    if done:
        yield sums_batch(done, schema, carried)


def lasso(s: np.ndarray, c: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimum of x'Sx/2 - c'x + weight |x| for stacked problems, by an active set that begins with the signs of ``start``.

    With the signs given, the minimum is that of a linear system. On the way there the first entry that would change its sign is
    set to 0 and leaves the set; once there, the entry at 0 whose slope exceeds the weight most enters it. Every step
    lowers the objective and there are finitely many sets, so this ends.
    """
    x = start.copy()
    height, width = x.shape
    if not width:
        return x
    places = np.arange(width)
    s = s.copy()
    largest = np.einsum("ijj->ij", s).max(axis=1)
    s[:, places, places] += np.where(largest > 0, 1e-13 * largest, 1.0)[:, None]  # columns may be tied where there are no rows
    sign, blocked = np.sign(x), np.zeros(x.shape, bool)
    best = np.full(height, np.inf)
    open_ = np.arange(height)
    while len(open_):
        so, co, lo, xo, signs, shut = s[open_], c[open_], weight[open_, None], x[open_], sign[open_], blocked[open_]
        active = signs != 0
        system = np.where(active[:, :, None] & active[:, None, :], so, 0.0)
        system[:, places, places] += ~active
        goal = np.linalg.solve(system, np.where(active, co - lo * signs, 0.0)[..., None])[..., 0]
        crossing = active & (goal * signs <= 0)
        ahead = np.where(crossing, np.abs(xo) / np.maximum(np.abs(xo - goal), 1e-300), 1.0)
        share = np.where(crossing.any(axis=1), np.minimum(ahead, 1.0).min(axis=1), 1.0)
        leaving = crossing & (ahead <= share[:, None])
        there = ~leaving.any(axis=1)
        shut = shut & ~(share > 0)[:, None] | leaving & (share == 0)[:, None]
        xo = np.where(leaving | ~active, 0.0, xo + share[:, None] * (goal - xo))
        signs = np.where(leaving, 0.0, signs)
        along = np.matmul(so, xo[..., None])[..., 0]
        slope = co - along
        worth = np.einsum("ij,ij->i", xo, along / 2 - co) + lo[:, 0] * np.abs(xo).sum(axis=1)
        excess = np.where(shut | (signs != 0), -1.0, np.abs(slope) - lo)
        enter = excess.argmax(axis=1)
        rows = np.arange(len(open_))
        noise = 1e-10 * lo[:, 0] + 1e-14 * np.abs(co).max(axis=1)
        # rounding ends the search too: from a set that was reached, the next one must be better
        ends = there & ((excess[rows, enter] <= noise) | (worth >= best[open_]))
        grows = there & ~ends
        signs[rows[grows], enter[grows]] = np.sign(slope[rows[grows], enter[grows]])
        best[open_[there]] = np.minimum(best[open_[there]], worth[there])
        x[open_], sign[open_], blocked[open_] = xo, signs, shut
        open_ = open_[~ends]
    return x


def noise_level(rss: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Most likely square of the noise scale under its prior, half-normal(0, 0.5)."""
    return 2.0 * rss / (n + np.sqrt(n * n + 16.0 * rss))


def solve(
    a: np.ndarray,
    b: np.ndarray,
    yy: np.ndarray,
    n: np.ndarray,
    changepoint_scale: np.ndarray,
    season_scale: np.ndarray,
    knots: int,
    shift: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior mode of stacked problems from their sums; the third value tells which fulfil the conditions of a mode.

    ``shift`` is what was taken off the values before they were summed: the prior of the offset is about 0 before that.

    Priors: Laplace on slope changes, normal on season weights, normal(0, 5) on slope and offset, half-normal(0, 0.5)
    on the noise. For a given noise the columns with normal priors are eliminated and an active set finds the slope changes
    exactly. More noise means a larger residual, which in turn means more noise: so the noise that agrees with its own
    residual is a root of one rising function and is found between brackets, from above.
    """
    height, width = b.shape
    theta, sigma, converged = np.zeros((height, width)), np.zeros(height), np.zeros(height, dtype=bool)
    if not height:
        return theta, sigma, converged
    # Columns without any weight (blocks that are off, knots a short series lacks) stay 0 and need no work.
    used = np.flatnonzero(np.nan_to_num(np.einsum("ijj->ij", a)).max(axis=0, initial=0.0) > 0.0)
    bent = (used >= 2) & (used < 2 + knots)
    l, r = np.flatnonzero(bent), np.flatnonzero(~bent)
    a, b = a[:, used[:, None], used], b[:, used]
    precision = np.where(used[r] < 2, 1.0 / 25.0, (1.0 / season_scale**2)[:, None])
    pull = np.zeros((height, len(r)))
    if shift is not None and len(used) and used[0] == 0:
        pull[:, 0] = -shift / 25.0
    # what is left of a sum of squares after it cancels is no noise
    least = np.maximum(1e-12 * yy / np.maximum(n, 1.0), 1e-24)
    noise = np.maximum(yy / np.maximum(n, 1.0), least)
    low, high = least.copy(), np.full(height, np.inf)
    tie = 1e-13 * np.einsum("ijj->ij", a).max(axis=1, initial=0.0)  # columns may be tied where rows are few
    bends = np.zeros((height, len(l)))
    sound = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1) & np.isfinite(yy)
    theta[~sound], sigma[~sound] = np.nan, np.nan
    before = np.column_stack([np.full(height, np.nan), noise])
    open_ = np.flatnonzero(sound)
    diagonal = np.arange(len(r))
    turn = 0
    while len(open_):
        turn += 1
        ao, bo, v = a[open_], b[open_], noise[open_]
        system = ao[:, r[:, None], r]
        system[:, diagonal, diagonal] += v[:, None] * precision[open_] + tie[open_, None]
        right = np.concatenate([(bo[:, r] + v[:, None] * pull[open_])[..., None], ao[:, r[:, None], l]], axis=2)
        part = np.linalg.solve(system, right)
        across = ao[:, l[:, None], r]
        s = ao[:, l[:, None], l] - across @ part[..., 1:]
        c = bo[:, l] - np.matmul(across, part[..., :1])[..., 0]
        weight = v / changepoint_scale[open_]
        own = lasso((s + s.transpose(0, 2, 1)) / 2, c, weight, bends[open_])
        bends[open_] = own
        whole = np.zeros((len(open_), len(used)))
        whole[:, l] = own
        whole[:, r] = part[..., 0] - np.matmul(part[..., 1:], own[..., None])[..., 0]
        along = np.matmul(ao, whole[..., None])[..., 0]
        rss = np.maximum(yy[open_] - 2.0 * np.einsum("ij,ij->i", whole, bo) + np.einsum("ij,ij->i", whole, along), 0.0)
        new = np.maximum(noise_level(rss, n[open_]), least[open_])
        settled = np.abs(new - v) <= 1e-9 * v
        high[open_] = np.where(new <= v, v, high[open_])
        low[open_] = np.where(new >= v, v, low[open_])
        closed = high[open_] <= low[open_] * (1 + 1e-9)
        done = settled | closed | ~np.isfinite(new)
        if done.any():
            at = open_[done]
            theta[at[:, None], used] = whole[done]
            sigma[at] = np.sqrt(new[done])
            slope = bo[done][:, l] - along[done][:, l]
            lambdas = weight[done][:, None]
            fine = np.where(own[done] == 0, np.abs(slope) - lambdas, np.abs(slope - lambdas * np.sign(own[done])))
            size = np.abs(bo[done]).max(axis=1, initial=0.0) + np.einsum("ij,ij->i", np.abs(ao[done]).max(axis=2, initial=0.0), np.abs(whole[done]))
            converged[at] = fine.max(axis=1, initial=0.0) <= 1e-6 * lambdas[:, 0] + 1e-11 * size
        # three values in a row tell where a steady approach ends
        first, second = before[open_].T
        bend = new - 2 * second + first
        with np.errstate(all="ignore"):
            guess = new - (new - second) ** 2 / bend
        bounded = np.isfinite(high[open_])
        inside = lambda v: np.isfinite(v) & (v > low[open_]) & (v < high[open_])
        following = np.where(inside(guess), guess, new)
        halve = bounded & (~inside(following) | (turn > 20 and turn % 2 == 1))
        following = np.where(halve, np.sqrt(low[open_] * np.where(bounded, high[open_], 1.0)), following)
        jumped = following != new
        before[open_] = np.where(jumped[:, None], np.nan, np.column_stack([second, new]))
        before[open_[jumped], 1] = following[jumped]
        noise[open_] = following
        open_ = open_[~done]
    return theta, sigma, converged


def solve_batches(
    batches: Iterator[pa.RecordBatch],
    schema: pa.Schema,
    kept: list[str],
    settings: list[tuple[int, float, float]],
    own: bool,
    knots: int,
    layout: int,
) -> Iterator[pa.RecordBatch]:
    """Solve every row of sums under each numbered pair of prior scales, with ``own`` also under the row's own pair (number 0)."""
    width = 2 + knots + block_columns(layout)
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            batch = whole.slice(start, 64)
            began = time.perf_counter()
            train = unpack(from_blobs(batch, "_train"), width)
            pairs = np.tile(np.array(settings, dtype=float).reshape(-1, 3), (batch.num_rows, 1, 1))
            if own:
                scales = [numbers(batch, c) for c in ("changepoint_prior_scale", "seasonality_prior_scale")]
                pairs = np.concatenate([np.stack([np.zeros(batch.num_rows), *scales], axis=1)[:, None], pairs], axis=1)
            pick = np.repeat(np.arange(batch.num_rows), pairs.shape[1])
            pairs = pairs.reshape(-1, 3)
            a, b, yy, n, seconds = (part[pick] for part in train)
            shift = (numbers(batch, "_level") / numbers(batch, "_scale"))[pick]
            centred, sigma, converged = solve(a, b, yy, n, pairs[:, 1], pairs[:, 2], knots, shift)
            theta = centred.copy()
            theta[:, 0] += shift
            spent = (time.perf_counter() - began) / max(1, len(pick))
            columns = [batch.column(c).take(pa.array(pick)) for c in kept]
            columns += [pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 2].copy())]
            columns += [lists(theta), blobs(theta), pa.array(sigma), pa.array(converged), pa.array(seconds + spent)]
            yield batch_of(columns, schema)


def merge_and_solve(
    batches: Iterator[pa.RecordBatch],
    sums_schema: pa.Schema,
    group: list[str],
    carried: list[str],
    parts: list[str],
    **how,
) -> Iterator[pa.RecordBatch]:
    """Both steps in one task: merged sums do not leave it."""
    return solve_batches(merge_sums(batches, sums_schema, group, carried, parts), **how)


NODES = 600
"""points of the numerical inversion of a characteristic function"""
CHANGES = np.logspace(-4, 3, 57)
NOISE = np.linspace(0.0, 1.0, 41) ** 2


def walk_bound(changes: np.ndarray, noise: np.ndarray, z: float) -> np.ndarray:
    """Half-width, in standard deviations, of the central interval of noise plus a walk of slope changes.

    ``changes`` is the expected number of changes so far, ``noise`` the share of the normal noise in the whole variance, and z
    the normal quantile of the interval's upper end. Changes come at even times with Laplace sizes, so the walk's
    characteristic function is exp(c (atan(bu) / (bu) - 1)). Its distribution has mass exp(-c) without any change, which is
    taken apart; the rest is inverted by quadrature over u, and the quantile found by halving.
    """
    c, a = np.asarray(changes, float)[:, None], np.clip(np.asarray(noise, float), 1e-8, 1.0)[:, None]
    b = np.sqrt(np.maximum(1.5 * (1.0 - a) / c, 1e-12))
    v = (np.arange(NODES) + 0.5) * np.pi / (12.0 / b + 16.0)  # v = b u
    still = np.exp(-c)
    weight = np.exp(-0.5 * a * (v / b) ** 2) * (np.exp(c * (np.arctan(v) / v - 1.0)) - still) / v * (v[:, :1] * 2.0) / np.pi
    level = 2.0 * _normal_cdf(np.array(z)) - 1.0
    low, high = np.zeros_like(c), np.full_like(c, 1.0 / np.sqrt(1.0 - level))
    for _ in range(24):
        x = 0.5 * (low + high)
        below = 0.5 * (1.0 - still) + still * _normal_cdf(x / np.sqrt(a)) + (weight * np.sin(v * (x / b))).sum(axis=1, keepdims=True)
        high, low = np.where(below > 0.5 + 0.5 * level, x, high), np.where(below > 0.5 + 0.5 * level, low, x)
    return np.where(a[:, 0] >= 1.0, z, 0.5 * (low + high)[:, 0])


def walk_bounds(changes: np.ndarray, noise: np.ndarray, z: np.ndarray, tables: dict[float, np.ndarray]) -> np.ndarray:
    """``walk_bound`` of each row, between the points of a table over ``CHANGES`` and ``NOISE``.

    ``tables`` keeps the points computed so far by level, so a task inverts each point once, whatever its rows. Rows without
    changes ahead take the normal quantile.
    """
    out = np.array(z, float)
    moved = (changes > 0) & (noise < 1.0)
    for level in np.unique(out[moved]):
        rows = moved & (z == level)
        i = np.interp(np.log(changes[rows]), np.log(CHANGES), np.arange(len(CHANGES)))
        j = np.sqrt(noise[rows]) * (len(NOISE) - 1)
        i0, j0 = np.minimum(i.astype(int), len(CHANGES) - 2), np.minimum(j.astype(int), len(NOISE) - 2)
        i, j = i - i0, j - j0
        known = tables.setdefault(level, np.full((len(CHANGES), len(NOISE)), np.nan))
        wanted = np.zeros(known.shape, bool)
        for down, right in ((0, 0), (0, 1), (1, 0), (1, 1)):
            wanted[i0 + down, j0 + right] = True
        at, of = np.nonzero(wanted & np.isnan(known))
        known[at, of] = walk_bound(CHANGES[at], NOISE[of], float(level))
        near = (1 - j) * known[i0, j0] + j * known[i0, j0 + 1]
        out[rows] = (1 - i) * near + i * ((1 - j) * known[i0 + 1, j0] + j * known[i0 + 1, j0 + 1])
    return out


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(erfc, otypes=[float])(-x / sqrt(2.0)) / 2.0


def predict_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Prediction and bounds of rows that carry their key's model.

    Past the history the bounds are quantiles of the noise plus further slope changes, arriving at the rate and with the
    mean size of those fitted.
    """
    tables: dict[float, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        knots = batch.column("_most_knots")[0].as_py()
        layout = batch.column("_layout")[0].as_py()
        reach = batch.column("_reach")[0].as_py()
        trend_x, season_x = design(batch, knots, layout, reach)
        theta = from_blobs(batch, "_theta")
        trend = np.einsum("ij,ij->i", trend_x, theta[:, : 2 + knots])
        season = np.einsum("ij,ij->i", season_x, theta[:, 2 + knots :])
        times = np.array(batch.column("seasonality_mode").to_pylist()) == "multiplicative"
        scale = numbers(batch, "_scale")
        level = np.where(times, trend * (1.0 + season), trend + season)
        count = numbers(batch, "_knots")
        size = np.abs(theta[:, 2 : 2 + knots]).sum(axis=1) / np.maximum(count, 1.0) + 1e-8
        ahead = np.maximum((numbers(batch, "_day") - numbers(batch, "_start")) / numbers(batch, "_span") - 1.0, 0.0)
        walk = np.where(count > 0, count * 2.0 * size**2 * ahead**3 / 3.0, 0.0)
        walk = walk * np.where(times, 1.0 + season, 1.0) ** 2
        noise = numbers(batch, "sigma") ** 2
        whole = noise + walk
        share = np.divide(noise, whole, out=np.ones_like(whole), where=whole > 0)
        half = walk_bounds(count * ahead, share, numbers(batch, "_z"), tables) * np.sqrt(whole)
        columns = [batch.column(c) for c in kept]
        columns += [pa.array(scale * v) for v in (level, level - half, level + half)]
        yield batch_of(columns, schema)
