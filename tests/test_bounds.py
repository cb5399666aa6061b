from statistics import NormalDist

import numpy as np
import pytest

from seriesloom.models import kernels


def simulated(changes, noise, width, rng, n=200_000):
    """Quantile of |noise + walk| in standard deviations, from drawn paths."""
    counts = rng.poisson(changes, n)
    path = np.repeat(np.arange(n), counts)
    size = np.sqrt(1.5 * (1 - noise) / changes)
    x = rng.normal(0, np.sqrt(noise), n)
    np.add.at(x, path, rng.laplace(0, size, len(path)) * rng.random(len(path)))
    return np.quantile(np.abs(x), width)


@pytest.mark.parametrize("width", [0.8, 0.95])
def test_bounds_agree_with_simulated_paths(width):
    rng, z, tables = np.random.default_rng(7), NormalDist().inv_cdf((1 + width) / 2), {}
    for changes in (0.05, 0.3, 1.0, 5.0, 25.0):
        for noise in (0.05, 0.5, 0.9):
            want = simulated(changes, noise, width, rng)
            exact = kernels.walk_bound([changes], [noise], z)[0]
            read = kernels.walk_bounds(np.array([changes]), np.array([noise]), np.array([z]), tables)[0]
            assert abs(exact - want) < 0.02 and abs(read - exact) < 0.01, (changes, noise)


def test_limits_of_the_bounds():
    z, tables = NormalDist().inv_cdf(0.9), {}
    changes, noise = np.array([0.0, 3.0, 1e9, 1e-9, 1e-3]), np.array([1.0, 1.0, 0.3, 0.25, 0.0])
    got = kernels.walk_bounds(changes, noise, np.full(5, z), tables)
    assert got[:2].tolist() == [z, z]  # nothing ahead, or nothing but noise
    assert abs(got[2] - z) < 2e-3 and abs(got[3] - z * 0.5) < 2e-3  # very many changes, hardly any
    assert got[4] < 1e-3  # without noise the path hardly ever moves
    assert (~np.isnan(tables[z])).sum() <= 16 and not kernels.walk_bounds(np.empty(0), np.empty(0), np.empty(0), {}).size
