import numpy as np
import pytest

from foliant.llm import gbt


def brute_tree(x, g, h, w, edges, depth, ridge, least):
    """Leaf value of every row by trying every split of every node, first best feature and edge."""
    out = np.zeros(len(x))

    def grow(rows, left):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) >= 2:
            for j in range(x.shape[1]):
                for e in edges[j]:
                    low = x[rows, j] < e
                    if w[rows][low].sum() < least or w[rows][~low].sum() < least:
                        continue
                    gain = g[rows][low].sum() ** 2 / (h[rows][low].sum() + ridge) + g[rows][~low].sum() ** 2 / (h[rows][~low].sum() + ridge) - gs**2 / (hs + ridge)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, j, e)
        if best[1] is None:
            out[rows] = gs / (hs + ridge)
            return
        low = x[rows, best[1]] < best[2]
        grow(rows[low], left - 1)
        grow(rows[~low], left - 1)

    grow(np.arange(len(x)), depth)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_boosting_against_every_split(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((120, 3)), 1)
    x[rng.random(x.shape) < 0.3] = 0
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(120) > 0).astype(float)
    w = rng.integers(1, 4, 120).astype(float)
    model = gbt.fit(x, y, w, trees=4, depth=2, n_bins=16, least=3.0)
    f = np.full(len(y), model.base)
    for _ in range(4):
        p = 1 / (1 + np.exp(-f))
        f = f + model.rate * brute_tree(x, w * (y - p), w * p * (1 - p) + 1e-12, w, model.edges, 2, 1.0, 3.0)
    assert np.allclose(model.margin(x), f, atol=1e-9)


@pytest.mark.parametrize("seed", range(10))
def test_isotonic_against_the_min_max_formula(seed):
    """The fit at each margin is the largest, over starts, of the smallest, over ends, of weighted means."""
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 12, 40).astype(float) if seed % 2 else rng.standard_normal(40)
    y, w = (rng.random(40) < 1 / (1 + np.exp(-m / 4))).astype(float), rng.random(40) + 0.1
    at = np.unique(m)
    own = [(w[m == v].sum(), (w * y)[m == v].sum()) for v in at]
    mean = lambda a, b: sum(s for _, s in own[a : b + 1]) / sum(n for n, _ in own[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    xs, ps = gbt.isotonic(m, y, w)
    assert np.allclose(np.interp(at, xs, ps), want, atol=1e-9) and (np.diff(ps) >= 0).all()
