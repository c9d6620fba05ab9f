"""The uniform threshold: what it leaves unread, and that nothing is lost."""

import numpy as np
import pytest

from tidemark.llm import topk


def parts(seed, n, width=64, spread=True):
    """Rows with most of their weight in one list each, so that the others' shares are out of reach."""
    made = np.random.default_rng(seed)
    x = made.normal(0, 4 if spread else 40, (n, width))
    if spread:
        for i, j in enumerate(made.integers(0, topk.SLICES, n)):
            x[i, topk._slices(width)[j]] *= 30
    return np.floor(x)


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_all_pairs_above_the_cutoff_are_found(spread, kind):
    q, r = parts(1, 40, spread=spread).astype(kind), parts(2, 3000, spread=spread).astype(kind)
    full = q @ r.T
    for cutoffs in (np.sort(full, 1)[:, -5].astype(np.float64), np.full(40, -np.inf), np.zeros(40), np.full(40, full.max() + 1.0)):
        which, place, score, _ = topk.reached(q, r, cutoffs)
        want = np.nonzero(full >= cutoffs[:, None])
        assert (which == want[0]).all() and (place == want[1]).all() and (score == full[want]).all()


def test_fewer_products_than_with_norms_alone():
    """Counted in products of components, against reading every row whose norms let it reach the cutoff."""
    for seed in range(3):
        r = parts(seed + 10, 4000)
        for i in range(0, 40, 8):
            q = parts(seed + 20, 40)[i : i + 1]
            full = q @ r.T
            cutoffs = np.sort(full, 1)[:, -5]
            *_, products = topk.reached(q, r, cutoffs)
            whole = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)
            listed = topk._norms(q, topk._slices(64)) @ topk._norms(r, topk._slices(64)).T
            by_norms = min((whole >= cutoffs[:, None]).any(0).sum(), (listed >= cutoffs[:, None]).any(0).sum()) * len(q) * 64
            assert products < 0.7 * by_norms, (products, by_norms)


def test_empty_lists_and_zero_vectors():
    q, r = np.zeros((2, 3)), np.array([[0.0, 0, 0], [1, 2, 3]])
    which, place, score, _ = topk.reached(q, r, np.array([0.0, 1.0]))
    assert which.tolist() == [0, 0] and place.tolist() == [0, 1] and score.tolist() == [0, 0]
