"""Books of more symbols than dates: conditions of the best book, and both ways to a covariance matrix."""

import numpy as np
import pytest

from quantweave.operators import optimizers


def book(n, gaps=0.0, dates=24):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, dates)) * 0.3 * (1 + r.random((n, 1))) + 0.02
    x[r.random((n, dates)) < gaps] = np.nan
    return x


def test_factors_are_the_covariances():
    for x in (book(150), book(150, 0.01), book(40, 0.1), book(10)):
        u, values = optimizers.factors(x)
        assert np.allclose((u * values) @ u.T, optimizers.covariances(x)[1], atol=1e-12) and np.allclose(u.T @ u, np.eye(len(values)), atol=1e-9)
    x = book(10)
    x[0, 1:] = np.nan
    assert optimizers.factors(x) is None


@pytest.mark.parametrize("method", optimizers.METHODS)
@pytest.mark.parametrize("n, gaps", [(50, 0.0), (240, 0.0), (240, 0.005)])
def test_conditions_of_the_best_book(method, n, gaps):
    x = book(n, gaps)
    w = optimizers.weigh([x], method, 0.0, 1e-8)[0]
    mean, cov = optimizers.covariances(x)
    values, vectors = np.linalg.eigh(cov)
    s = (vectors * np.maximum(values, 0.0)) @ vectors.T + 1e-8 * np.diag(cov).mean() * np.eye(n)
    assert w.sum() == pytest.approx(1) and w.min() >= 0
    g = s @ w
    if method == "risk_parity":
        assert np.abs(w * g / (w * g).mean() - 1).max() < 1e-3
    else:
        aim = np.sqrt(np.diag(cov)) if method == "diversification" else mean
        off = (aim @ w) / (w @ g) * g - aim
        assert np.where(w > 1e-9, np.abs(off), -off).max() < 1e-4 * np.abs(aim).max()
