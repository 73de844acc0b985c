"""Dense checks of the boundary kernel that need no golden data."""

import tracemalloc

import numpy as np
import pytest

from ringfence.functions import kernel
from ringfence.functions.kernel import Boundary, fit, from_fields, judge, similarity, to_fields


def gram(m):
    return similarity(m.sv, m.sv, m.sigma)


def one_by_one(rows, sigma):
    """The same pass, a single row per step."""
    m = Boundary.start(rows[0], sigma)
    for r in rows[1:]:
        if m.score(r)[0] > 0:
            m.accept(r)
        m.seen += 1
    return m


@pytest.mark.parametrize("d,sigma,n", [(2, 0.5, 400), (6, 2.08, 3000), (4, 1.66, 3000), (20, 4.0, 1500)])
def test_block_pass_equals_row_pass_and_is_consistent(d, sigma, n):
    rows = np.random.default_rng(d).normal(size=(n, d))
    m, counts = fit(rows, sigma)
    slow = one_by_one(rows, sigma)
    assert np.allclose(m.sv, slow.sv) and np.allclose(m.alpha, slow.alpha, atol=1e-9)
    assert np.abs(gram(m) @ m.inverse - np.eye(m.size)).max() < 1e-8
    assert m.alpha.min() >= 0 and m.alpha.sum() == pytest.approx(1.0)
    assert m.radius == pytest.approx(1.0 / m.inverse.sum())
    assert counts["sv_before"] + counts["added"] - counts["removed"] == counts["sv_after"] == m.size
    assert m.seen == n and counts["processed"] == n - 1


def test_single_row_start():
    rows = np.random.default_rng(42).random((10, 2))
    m = Boundary.start(rows[0], 0.5)
    assert m.sv.shape == (1, 2) and m.alpha.tolist() == [1.0] and m.radius == 1.0


def test_trained_shapes_and_probe_point():
    rows = np.random.default_rng(42).random((10, 2))
    m, _ = fit(rows, 0.5)
    assert len(m.alpha) == len(m.sv) and m.alpha.sum() == pytest.approx(1.0)
    assert m.score(np.array([0.5, 0.5])).shape == (1,)
    assert m.sims(np.array([0.5, 0.5])).shape == (1, m.size)


def test_forced_negative_weight_is_pruned():
    rows = np.random.default_rng(42).random((10, 2))
    m = Boundary.start(rows[0], 0.1)
    m.grow(np.array([0.9, 0.9]), m.sims(np.array([0.9, 0.9]))[0])
    assert m.size == 2
    m.alpha[0] = -0.1
    assert len(m.prune()) == 1 and m.size == 1


def test_batches_equal_one_pass_and_restore_is_exact():
    rng = np.random.default_rng(42)
    rows = np.vstack([rng.normal(size=(200, 3)) * 0.5, rng.normal(size=(20, 3)) * 3])
    rng.shuffle(rows)
    whole, _ = fit(rows, 1.0)
    m, _ = fit(rows[:50], 1.0)
    m.learn(rows[50:100])
    m = from_fields(to_fields(m))
    m.learn(rows[100:])
    assert np.array_equal(m.sv, whole.sv) and np.allclose(m.alpha, whole.alpha) and m.seen == whole.seen == 220


def test_overrides_for_far_and_duplicate_rows():
    m, _ = fit(np.random.default_rng(1).normal(size=(300, 4)), 1.66)
    near = m.sv[0]
    far = np.full(4, 30.0)
    score, raw, best = judge(m.sims(np.vstack([near, far])), m.alpha, m.radius)
    assert score.tolist() == [-1.0, -1.0]
    assert raw[1] == pytest.approx(m.radius) and best[1] < 1e-8 and best[0] > 1 - 1e-8
    assert (m.score(m.sv) == -1).all()


def test_nan_row_is_never_accepted():
    m, _ = fit(np.random.default_rng(1).normal(size=(50, 3)), 1.5)
    before = m.size
    m.learn(np.array([[np.nan, 0.0, 0.0]]))
    assert m.size == before and np.isnan(m.score(np.array([[np.nan, 0, 0]]))[0])


def test_bad_seed_row_and_central_seed():
    """A first row far from all others leaves one support vector; the central seed does not."""
    rows = np.random.default_rng(0).normal(size=(2000, 6))
    rows[0] = 8.0
    assert fit(rows, 2.08)[0].size == 1
    assert fit(rows, 2.08, seed="central")[0].size > 20
    with pytest.raises(ValueError):
        fit(rows, 2.08, seed="other")


def test_trace_has_one_radius_per_row():
    trace = []
    m, _ = fit(np.random.default_rng(5).normal(size=(500, 3)), 1.5, trace=trace)
    assert len(trace) == 499 and trace[-1] == m.radius


@pytest.mark.parametrize("d,sigma,n", [(3, 0.5, 900), (6, 0.6, 700), (20, 3.0, 600)])
def test_wide_pass_is_the_plain_pass(monkeypatch, d, sigma, n):
    """Many support vectors, drops and returns among them; the pass over its inverse by blocks takes the same steps."""
    rows, plain, wide = np.random.default_rng(d).normal(size=(n, d)), [], []
    a, counts_a = fit(rows, sigma, trace=plain)
    monkeypatch.setattr(kernel, "WIDE", 10)
    taken, apply = [], kernel._Wide._apply
    monkeypatch.setattr(kernel._Wide, "_apply", lambda self, **k: taken.append(self.r) or apply(self, **k))
    b, counts_b = fit(rows, sigma, trace=wide)
    # the inverse is gone over once a block, not for every vector taken or dropped
    assert sum(taken) > 3 * len(taken) > 0 and counts_a["removed"] > 0
    assert counts_a == counts_b and np.array_equal(a.sv, b.sv) and np.allclose(plain, wide, atol=1e-12)
    assert np.allclose(a.alpha, b.alpha, atol=1e-9) and np.abs(gram(b) @ b.inverse - np.eye(b.size)).max() < 1e-8


def test_wide_models_travel_without_their_inverse(monkeypatch):
    rows = np.random.default_rng(1).normal(size=(300, 4))
    whole, _ = fit(rows, 0.7)
    monkeypatch.setattr(kernel, "INVERSE_ROWS", 20)
    half, _ = fit(rows[:150], 0.7)
    assert half.size > 20 and not len(to_fields(half)["inverse"])
    again = from_fields(to_fields(half))
    again.learn(rows[150:])
    assert np.array_equal(again.sv, whole.sv) and np.allclose(again.alpha, whole.alpha, atol=1e-10) and again.seen == 300


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_strips_are_the_matrix(monkeypatch, held):
    """Products, rows, sums, changes and closed places, in memory and in a file, over several strips."""
    monkeypatch.setattr(kernel, "HELD_BYTES", held)
    rng = np.random.default_rng(2)
    n, more = 300, 420
    a = rng.normal(size=(n, n))
    a = a + a.T
    s = kernel.Strips(a)
    assert (s.file is None) == bool(held) and np.array_equal(s.square(n), a) and np.array_equal(s.copy().square(n), a)
    x, wanted = rng.normal(size=(5, n)), np.array([0, 299, 131])
    products, rows = s.times(x, wanted)
    assert np.allclose(products, x @ a) and np.array_equal(rows, a[wanted])
    assert all(np.array_equal(s.row(j, n), a[j]) for j in (0, 127, 128, 299)) and np.allclose(s.sums(n), a.sum(axis=1))
    u, d, gone = rng.normal(size=(7, more)), rng.normal(size=7), np.array([3, 129, 400])
    want = np.zeros((more, more))
    want[:n, :n] = a
    want += (u * d[:, None]).T @ u
    want[gone] = 0.0
    want[:, gone] = 0.0
    assert np.allclose(s.add(u, d, gone), want.sum(axis=1)) and np.allclose(s.square(more), want)
    at = np.delete(np.arange(more), [*gone, *range(140, 290)])
    s.close(at)
    assert np.allclose(s.square(len(at)), want[np.ix_(at, at)]) and s.count == 3
    assert np.allclose(s.add(np.zeros((1, 700)), np.ones(1), gone[:0])[len(at):], 0.0)
    sv = rng.normal(size=(300, 4))
    assert np.allclose(kernel.Strips.inverse_of(sv, 0.8).square(300) @ similarity(sv, sv, 0.8), np.eye(300), atol=1e-8)


@pytest.mark.parametrize("d,sigma,n", [(3, 0.5, 900), (6, 0.6, 700), (20, 3.0, 600)])
def test_pass_over_a_file_is_the_plain_pass(monkeypatch, d, sigma, n):
    rows, plain, filed = np.random.default_rng(d).normal(size=(n, d)), [], []
    a, counts_a = fit(rows, sigma, trace=plain)
    for name, value in {"WIDE": 10, "HELD_BYTES": 0, "_LIKELY": 4, "INVERSE_ROWS": 20}.items():
        monkeypatch.setattr(kernel, name, value)
    b, counts_b = fit(rows, sigma, trace=filed)
    assert counts_a == counts_b and counts_a["removed"] > 0 and np.array_equal(a.sv, b.sv)
    assert b.inverse.file is not None and np.abs(gram(b) @ b.inverse.square(b.size) - np.eye(b.size)).max() < 1e-8
    assert np.allclose(plain, filed, atol=1e-12) and np.allclose(a.alpha, b.alpha, atol=1e-9)
    # a model whose inverse lies in a file is copied, travels without it and learns on
    again = from_fields(to_fields(b.copy()))
    more = np.random.default_rng(d + 1).normal(size=(100, d))
    assert a.learn(more) == again.learn(more) and np.array_equal(a.sv, again.sv) and np.allclose(a.alpha, again.alpha, atol=1e-9)


def test_memory_does_not_grow_with_the_square_of_the_vectors(monkeypatch):
    for name, value in {"HELD_BYTES": 0, "INVERSE_ROWS": 100, "_BLOCK_CELLS": 100_000}.items():
        monkeypatch.setattr(kernel, name, value, raising=False)
    rows = np.random.default_rng(0).normal(size=(2500, 20))
    tracemalloc.start()
    model, _ = fit(rows, 1.0)
    again = from_fields(to_fields(model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again.size > 2300 and peak < 0.6 * 8 * model.size**2
