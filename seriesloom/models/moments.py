"""Sums per segment of a key's history, and the systems of its folds made from them.

A key's time is cut at every changepoint and cut-off of its folds (a plain fit is one fold). A row is added once, to
the segment it lies in. Between two changepoints the trend is a straight line in x, the place in the whole history, so every
product of design columns is a polynomial in x times a product of season columns or the value: its sum over a fold follows
from running totals at the fold's own changepoints and ends. Rows are never copied to the folds that use them.

``w`` stands for the columns (1, seasons, value). In the additive mode products of seasons are needed at the ends of folds
only; in the multiplicative one, where seasons are scaled by the trend, at every changepoint and with x and x squared.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from seriesloom.models import kernels

MICROS_PER_DAY = 86_400_000_000
ROWS_AT_ONCE = 4096
SYSTEMS_AT_ONCE = 256
FOLDS = ["_fold", "_cut", "_trained", "_spans", "_scales", "_counts"]
MIN_TRAIN = 2


@dataclass
class Shape:
    """What all keys share."""

    knots: int
    layout: int
    reach: float
    horizon: int
    """microseconds; 0 without tests"""
    times: bool
    """seasons multiply the trend"""

    @property
    def seasons(self) -> int:
        return kernels.block_columns(self.layout)

    @property
    def columns(self) -> int:
        return 2 + self.knots + self.seasons

    @property
    def fine_width(self) -> int:
        m = self.seasons
        return 3 * (m + 2) * (m + 3) // 2 if self.times else 2 * m + 5

    @property
    def coarse_width(self) -> int:
        m = self.seasons
        return 0 if self.times else (m + 1) * (m + 2) // 2


def knot_micros(first: int, spans: np.ndarray, counts: np.ndarray, shape: Shape) -> np.ndarray:
    """Times of the changepoints of each fold, as whole microseconds; those a fold lacks lie at its start."""
    number = np.arange(1, shape.knots + 1)
    place = np.where(number <= counts[:, None], shape.reach * number / np.maximum(counts, 1)[:, None], 0.0)
    return first + np.floor(place * (spans * MICROS_PER_DAY)[:, None]).astype(np.int64)


class Segments:
    """Open sums of one key (or of a part of its rows)."""

    def __init__(self, base: dict, shape: Shape):
        self.base, self.shape, self.seconds = base, shape, 0.0
        self.first, self.span = base["_first"], base["_whole"]
        self.fold, self.cut, self.trained, self.spans, self.scales, self.counts = (np.array(base[c]) for c in FOLDS)
        ends = [self.cut, self.cut + shape.horizon] if shape.horizon else [self.cut]
        self.knot = knot_micros(self.first, self.spans, self.counts, shape)
        self.coarse = np.unique(np.concatenate(ends))
        self.fine = np.unique(np.concatenate([self.knot.ravel(), self.coarse]))
        self.fine_sums = np.zeros((len(self.fine), shape.fine_width))
        self.coarse_sums = np.zeros((0 if shape.times else len(self.coarse), shape.coarse_width))

    def place(self, at: np.ndarray) -> np.ndarray:
        """Microseconds to x, which goes from -1/2 to 1/2 over the key's history."""
        return (at - self.first) / MICROS_PER_DAY / self.span - 0.5

    def add(self, at: np.ndarray, y: np.ndarray) -> None:
        began = time.perf_counter()
        for start in range(0, len(at), ROWS_AT_ONCE):
            self._add(at[start : start + ROWS_AT_ONCE], y[start : start + ROWS_AT_ONCE])
        self.seconds += time.perf_counter() - began

    def _add(self, at: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at, y = at[order], y[order]
        used = int(np.searchsorted(at, self.fine[-1], side="right"))
        at, y = at[:used], y[:used]
        if not used:
            return
        x = self.place(at)
        value = (y - self.base["_level"]) / self.base["_size"]
        active = np.full(used, self.base["_seasons"])
        season = kernels.season_rows(at / MICROS_PER_DAY, active, self.shape.layout)
        segment = np.searchsorted(self.fine, at)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        one = np.ones(used)
        if self.shape.times:
            w = np.column_stack([one, season, value])
            i, j = kernels.upper_triangle(w.shape[1])
            powers = np.column_stack([one, x, x * x])
            for a, b in zip(starts, [*starts[1:], used]):
                own = np.einsum("np,ni,nj->pij", powers[a:b], w[a:b], w[a:b], optimize=True)
                self.fine_sums[segment[a]] += own[:, i, j].ravel()
            return
        thin = np.column_stack([one, x, x * x, season, x[:, None] * season, value, x * value])
        self.fine_sums[segment[starts]] += np.add.reduceat(thin, starts, axis=0)
        w = np.column_stack([season, value])
        i, j = kernels.upper_triangle(w.shape[1])
        segment = np.searchsorted(self.coarse, at)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        for a, b in zip(starts, [*starts[1:], used]):
            self.coarse_sums[segment[a]] += (w[a:b].T @ w[a:b])[i, j]

    def merge(self, fine: bytes, coarse: bytes, seconds: float) -> None:
        self.fine_sums += np.frombuffer(fine).reshape(self.fine_sums.shape)
        self.coarse_sums += np.frombuffer(coarse).reshape(self.coarse_sums.shape)
        self.seconds += seconds

    # ---- folds -----------------------------------------------------------------------------------------------------

    def systems(self) -> Iterator[System]:
        """The folds that can be fitted, each with its sums between changepoints and, with a horizon, its test sums."""
        fine = np.vstack([np.zeros(self.shape.fine_width), np.cumsum(self.fine_sums, axis=0)])
        coarse = np.vstack([np.zeros(self.shape.coarse_width), np.cumsum(self.coarse_sums, axis=0)])
        upto = lambda sums, marks, at: sums[np.searchsorted(marks, at) + 1]
        share = self.seconds / max(1, len(self.fold))
        for k in np.flatnonzero(self.trained >= MIN_TRAIN).tolist():
            count, cut = int(self.counts[k]), self.cut[k]
            inner = np.concatenate([upto(fine, self.fine, self.knot[k, :count]), upto(fine, self.fine, [cut])])
            between = np.diff(inner, axis=0, prepend=np.zeros((1, inner.shape[1])))
            pairs = test = test_pairs = None
            if not self.shape.times:
                pairs = upto(coarse, self.coarse, cut)
            if self.shape.horizon:
                test = upto(fine, self.fine, cut + self.shape.horizon) - upto(fine, self.fine, cut)
                if not self.shape.times:
                    test_pairs = upto(coarse, self.coarse, cut + self.shape.horizon) - pairs
            yield System(self, k, count, between, pairs, test, test_pairs, share)


class System:
    """One fold: sums per stretch between its changepoints, in the scale of the whole key."""

    def __init__(self, owner: Segments, k: int, count: int, between, pairs, test, test_pairs, seconds: float):
        self.owner, self.k, self.count, self.seconds = owner, k, count, seconds
        self.shape = owner.shape
        self.between, self.pairs, self.test, self.test_pairs = between, pairs, test, test_pairs
        self.scale = float(owner.scales[k])
        self.ratio = owner.base["_size"] / self.scale
        self.shift = owner.base["_level"] / self.scale
        stretch = owner.span / float(owner.spans[k])
        knot = owner.shape.reach * np.arange(1, count + 1) / max(count, 1) / stretch - 0.5
        # trend columns are lines in x between changepoints: level + slope * x, hinges once they are passed
        passed = np.arange(count + 1)[None, :] > np.arange(count)[:, None]
        ones = np.ones((1, count + 1))
        self.level = np.vstack([ones, 0.5 * stretch * ones, np.where(passed, -knot[:, None] * stretch, 0.0)])
        self.slope = np.vstack([0.0 * ones, stretch * ones, np.where(passed, stretch, 0.0)])

    def _blocks(self, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Products of the additive mode by their powers of x: (1), (seasons), (value)."""
        m = self.shape.seasons
        return sums[:, :3], sums[:, 3 : 3 + m], sums[:, 3 + m : 3 + 2 * m], sums[:, 3 + 2 * m] * self.ratio, sums[:, 4 + 2 * m] * self.ratio

    def additive(self, test: bool = False) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Sums of products of the design columns, with the value, of its square, and the rows."""
        m, width = self.shape.seasons, self.shape.columns
        sums, pairs = (self.test[None], self.test_pairs) if test else (self.between, self.pairs)
        level, slope = (self.level[:, -1:], self.slope[:, -1:]) if test else (self.level, self.slope)
        ones, season, season_x, value, value_x = self._blocks(sums)
        a, b = np.zeros((width, width)), np.zeros(width)
        trend = [*range(2 + self.count)]
        cross = (level * ones[:, 1]) @ slope.T
        a[np.ix_(trend, trend)] = (level * ones[:, 0]) @ level.T + cross + cross.T + (slope * ones[:, 2]) @ slope.T
        other = [*range(2 + self.shape.knots, width)]
        mixed = level @ season + slope @ season_x
        a[np.ix_(trend, other)], a[np.ix_(other, trend)] = mixed, mixed.T
        both = np.zeros((m + 1, m + 1))
        both[kernels.upper_triangle(m + 1)] = pairs
        a[np.ix_(other, other)] = both[:m, :m] + np.triu(both[:m, :m], 1).T
        b[trend] = level @ value + slope @ value_x
        b[other] = both[:m, m] * self.ratio
        return a, b, float(both[m, m]) * self.ratio**2, float(ones[:, 0].sum())

    def cubes(self, test: bool = False) -> np.ndarray:
        """Sums of w times w by power of x and stretch."""
        sums = self.test[None] if test else self.between
        width = self.shape.seasons + 2
        upper = kernels.upper_triangle(width)
        out = np.zeros((3, len(sums), width, width))
        each = sums.reshape(len(sums), 3, -1).transpose(1, 0, 2)
        out[:, :, upper[0], upper[1]] = each
        out[:, :, upper[1], upper[0]] = each
        out[:, :, -1, :] *= self.ratio
        out[:, :, :, -1] *= self.ratio
        return out


def squared_error(m: np.ndarray, level: np.ndarray, slope: np.ndarray, trend: np.ndarray, season: np.ndarray, shift: float) -> float:
    """Squared error of trend times (1 + season), from sums of w times w."""
    at, by = trend @ level, trend @ slope
    zero = np.zeros((len(at), 1))
    fixed = np.column_stack([-at, -(at + shift)[:, None] * season, zero + 1.0])
    grown = np.column_stack([-by, -by[:, None] * season, zero])
    quadratic = lambda a, p, b: np.einsum("li,lij,lj->", a, m[p], b)
    return max(0.0, float(quadratic(fixed, 0, fixed) + 2 * quadratic(fixed, 1, grown) + quadratic(grown, 2, grown)))


def linearised(m: np.ndarray, level: np.ndarray, slope: np.ndarray, trend: np.ndarray, season: np.ndarray, shift: float):
    """Products of the columns that the model has near (trend, season), and of its values there."""
    at, by = trend @ level, trend @ slope
    whole = at + shift
    w = np.concatenate([[1.0], season, [0.0]])
    z = np.concatenate([[0.0], season, [0.0]])
    mw, mz = m @ w, m @ z
    ww, size = mw @ w, len(level)
    cross = (level * ww[1]) @ slope.T
    a = np.zeros((size + len(season),) * 2)
    a[:size, :size] = (level * ww[0]) @ level.T + cross + cross.T + (slope * ww[2]) @ slope.T
    first = (whole[:, None] * mw[0] + by[:, None] * mw[1])[:, 1:-1]
    second = (whole[:, None] * mw[1] + by[:, None] * mw[2])[:, 1:-1]
    a[:size, size:] = level @ first + slope @ second
    a[size:, :size] = a[:size, size:].T
    a[size:, size:] = np.einsum("l,lij->ij", whole**2, m[0, :, 1:-1, 1:-1]) + np.einsum("l,lij->ij", 2 * whole * by, m[1, :, 1:-1, 1:-1])
    a[size:, size:] += np.einsum("l,lij->ij", by**2, m[2, :, 1:-1, 1:-1])
    # the value that the columns are held against: y + trend * season, trend without the shift
    v = [m[p][:, -1] + at[:, None] * mz[p] + by[:, None] * mz[p + 1] for p in (0, 1)]
    b = np.concatenate([level @ (v[0] @ w) + slope @ (v[1] @ w), (whole[:, None] * v[0] + by[:, None] * v[1])[:, 1:-1].sum(axis=0)])
    zz = mz @ z
    yy = m[0][:, -1, -1].sum() + 2 * (at @ mz[0][:, -1] + by @ mz[1][:, -1]) + at**2 @ zz[0] + 2 * (at * by) @ zz[1] + by**2 @ zz[2]
    return a, b, float(yy)


def solve_times(system: System, changepoint_scale: float, season_scale: float) -> tuple[np.ndarray, float, bool]:
    """Posterior mode where seasons multiply the trend: each step solves the model made linear at the present place, and goes
    as far towards its answer as the posterior itself gets better. Ends when no step does, or nothing moves."""
    m, shift = system.cubes(), system.shift
    level, slope = system.level, system.slope
    n, size = float(m[0, :, 0, 0].sum()), len(system.level)
    used = np.flatnonzero(m[0, :, range(1, m.shape[-1] - 1), range(1, m.shape[-1] - 1)].sum(axis=1) > 0)
    keep = np.concatenate([[0], 1 + used, [m.shape[-1] - 1]])
    m = m[:, :, keep[:, None], keep]
    one = lambda v: np.array([v])

    def fitted(a, b, yy):
        theta, sigma, fine = kernels.solve(a[None], b[None], one(yy), one(n), one(changepoint_scale), one(season_scale), size - 2, one(shift))
        return theta[0], bool(fine[0])

    def cost(theta: np.ndarray) -> tuple[float, float]:
        rss = squared_error(m, level, slope, theta[:size], theta[size:], shift)
        noise = max(2.0 * rss / (n + np.sqrt(n * n + 16.0 * rss)), floor)
        prior = ((theta[0] + shift) ** 2 + theta[1] ** 2) / 50 + np.abs(theta[2:size]).sum() / changepoint_scale
        return rss / (2 * noise) + n / 2 * np.log(noise) + 2 * noise + prior + (theta[size:] ** 2).sum() / (2 * season_scale**2), noise

    yy = float(m[0][:, -1, -1].sum())
    floor = max(1e-12 * yy / max(n, 1.0), 1e-24)
    plain = linearised(m, level, slope, np.zeros(size), np.zeros(len(used)), shift)
    start, _ = fitted(plain[0][:size, :size], plain[1][:size], plain[2])
    theta = np.concatenate([start, np.zeros(len(used))])
    now, noise = cost(theta)
    while True:
        a, b, value = linearised(m, level, slope, theta[:size], theta[size:], shift)
        goal, inner = fitted(a, b, value)
        step, better = 1.0, None
        while step > 1e-9:
            tried, its = cost(theta + step * (goal - theta))
            if tried < now - 1e-12 * abs(now):
                better = theta + step * (goal - theta), tried, its
                break
            step /= 2
        # without a better place, how far the linear answer is away tells whether this is the mode
        moved = np.abs(goal - theta).max() / max(1.0, np.abs(theta).max())
        if better is None:
            break
        theta, now, noise = better
    out = np.zeros(system.shape.columns)
    out[:size] = theta[:size]
    out[2 + system.shape.knots + used] = theta[size:]
    return out, float(np.sqrt(noise)), bool(inner and moved < 1e-3)


# ---- streams inside tasks ------------------------------------------------------------------------------------------


def sum_stream(batches: Iterator[pa.RecordBatch], schema: pa.Schema, group: list[str], carried: list[str], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row of sums per group. The first row of a group (``_kind`` 0) carries its basis; groups without
    one are passed over."""
    held: Segments | None = None
    name = None
    for batch in batches:
        ids = kernels.group_codes(batch, group)
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        kind = kernels.numbers(batch, "_kind", np.int64)
        at, y = batch.column("_micros").fill_null(0).to_numpy(), batch.column("y").fill_null(0.0).to_numpy()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            here = tuple(batch.column(g)[a].as_py() for g in group)
            if here != name:
                if held is not None:
                    yield _sums_row(held, schema, carried)
                name = here
                held = Segments({c: batch.column(c)[a].as_py() for c in carried}, shape) if kind[a] == 0 else None
            if held is not None:
                rows = a + np.flatnonzero(kind[a:b] == 1)
                held.add(at[rows], y[rows])
    if held is not None:
        yield _sums_row(held, schema, carried)


def _sums_row(held: Segments, schema: pa.Schema, carried: list[str]) -> pa.RecordBatch:
    values = [held.base[c] for c in carried] + [held.fine_sums.tobytes(), held.coarse_sums.tobytes(), held.seconds]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def merge_stream(batches: Iterator[pa.RecordBatch], group: list[str], carried: list[str], shape: Shape) -> Iterator[Segments]:
    """Sums of groups whose rows of sums follow one another."""
    held, name = None, None
    for batch in batches:
        for row in batch.to_pylist():
            here = tuple(row[g] for g in group)
            if held is None or here != name:
                if held is not None:
                    yield held
                name, held = here, Segments({c: row[c] for c in carried}, shape)
            held.merge(row["_fine"], row["_coarse"], row["_seconds"])
    if held is not None:
        yield held


def solved_batch(systems: list[System], settings: list[tuple[int, float, float]], own: bool, schema: pa.Schema, kept: list[str]) -> pa.RecordBatch:
    """Every fold under every setting, with the squared error of its test rows."""
    shape = systems[0].shape
    began = time.perf_counter()
    pairs = []
    for i, s in enumerate(systems):
        base = s.owner.base
        mine = [(0, base["changepoint_prior_scale"], base["seasonality_prior_scale"])] if own else []
        pairs += [(i, *p) for p in [*mine, *settings]]
    pick = np.array([p[0] for p in pairs])
    scales = np.array([p[2:] for p in pairs], dtype=float).reshape(-1, 2)
    shift = np.array([s.shift for s in systems])[pick]
    sse, n_test = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    if shape.times:
        found = [solve_times(systems[i], *scale) for i, scale in zip(pick, scales.tolist())]
        centred, sigma, converged = np.array([f[0] for f in found]), np.array([f[1] for f in found]), np.array([f[2] for f in found])
        if shape.horizon:
            tests = [s.cubes(test=True) for s in systems]
            for row, i in enumerate(pick.tolist()):
                s, size = systems[i], 2 + systems[i].count
                season = centred[row, 2 + shape.knots :]
                error = squared_error(tests[i], s.level[:, -1:], s.slope[:, -1:], centred[row, :size], season, s.shift)
                sse[row], n_test[row] = error * s.scale**2, round(tests[i][0, 0, 0, 0])
    else:
        a, b, yy, n = (np.array(v)[pick] for v in zip(*[s.additive() for s in systems]))
        centred, sigma, converged = kernels.solve(a, b, yy, n, scales[:, 0], scales[:, 1], shape.knots, shift)
        if shape.horizon:
            a, b, yy, n = (np.array(v)[pick] for v in zip(*[s.additive(test=True) for s in systems]))
            along = np.matmul(a, centred[..., None])[..., 0]
            error = yy - 2.0 * np.einsum("ij,ij->i", centred, b) + np.einsum("ij,ij->i", centred, along)
            sse = np.maximum(error, 0.0) * np.array([s.scale for s in systems])[pick] ** 2
            n_test = np.rint(n).astype(np.int64)
    theta = centred.copy()
    theta[:, 0] += shift
    spent = (time.perf_counter() - began) / max(1, len(pairs))
    of = {
        "_fold": lambda s: int(s.owner.fold[s.k]), "cutoff": lambda s: int(s.owner.cut[s.k]), "n_train": lambda s: int(s.owner.trained[s.k]),
        "_span": lambda s: float(s.owner.spans[s.k]), "_scale": lambda s: s.scale, "_knots": lambda s: s.count,
    }
    columns = []
    for name in kept:
        values = [of[name](s) if name in of else s.owner.base[name] for s in systems]
        columns.append(pa.array([values[i] for i in pick], schema.field(name).type))
    seconds = np.array([s.seconds for s in systems])[pick] + spent
    columns += [pa.array(np.array([p[1] for p in pairs], np.int32)), pa.array(scales[:, 0].copy()), pa.array(scales[:, 1].copy())]
    columns += [kernels.lists(theta), kernels.blobs(theta), pa.array(sigma), pa.array(converged), pa.array(seconds)]
    if shape.horizon:
        columns += [pa.array(sse), pa.array(n_test)]
    return kernels.batch_of(columns, schema)


def solve_stream(groups: Iterator[Segments], settings: list[tuple[int, float, float]], own: bool, schema: pa.Schema, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Folds of all groups, some hundred systems at a time."""
    most = max(1, SYSTEMS_AT_ONCE // max(1, len(settings) + own))
    held: list[System] = []
    for group in groups:
        for system in group.systems():
            held.append(system)
            if len(held) >= most:
                yield solved_batch(held, settings, own, schema, kept)
                held = []
    if held:
        yield solved_batch(held, settings, own, schema, kept)


def sum_and_solve(batches, sums_schema, group, piece, carried, shape, settings, own, schema, kept) -> Iterator[pa.RecordBatch]:
    """Both steps in one task, where no key's rows are spread over several."""
    sums = sum_stream(batches, sums_schema, [*group, piece], carried, shape)
    return solve_stream(merge_stream(sums, group, carried, shape), settings, own, schema, kept)


def merge_and_solve(batches, group, carried, shape, settings, own, schema, kept) -> Iterator[pa.RecordBatch]:
    return solve_stream(merge_stream(batches, group, carried, shape), settings, own, schema, kept)
