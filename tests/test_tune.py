import numpy as np
import pytest

from corollary.operators.tune import GaussianProcess, choose, design_points, expected_improvement, hypervolume, nadir, pareto, standardized, tune


def test_points_and_front():
    assert design_points(10) == [2, 4, 6, 8, 10] and design_points(3) == [1, 2, 3] and design_points(1) == [1]
    y = np.array([[1.0, 3.0], [2.0, 2.0], [3.0, 1.0], [1.0, 1.0]])
    assert pareto(y).tolist() == [True, True, True, False]
    assert hypervolume(y, np.zeros(2)) == 6 and choose(y, np.zeros(2)) == 1


def test_expected_improvement_is_the_mean_growth():
    rng, ref = np.random.default_rng(0), np.zeros(2)
    for _ in range(5):
        y = rng.random((4, 2))
        draws = rng.normal(0.6, 0.3, 8000)
        grown = np.mean([hypervolume(np.vstack([y, [0.7, d]]), ref) - hypervolume(y, ref) for d in draws])
        assert abs(expected_improvement(0.7, 0.6, 0.3, y, ref) - grown) < 0.01


def test_process_follows_its_points():
    x = np.linspace(0, 1, 8)
    m, s = GaussianProcess(x, np.sin(3 * x)).predict(x)
    assert np.abs(m - np.sin(3 * x)).max() < 0.1 and (s >= 0).all()


@pytest.mark.parametrize("acquisition", ["qehvi", "qnehvi"])
def test_tune_finds_a_good_level(acquisition):
    cr = [1 - 0.03 * k for k in range(1, 21)]
    got = tune(cr, lambda k: 1 + (max(0, k - 12) * 0.5), acquisition=acquisition)
    assert 8 <= got.level <= 14 and len(got.samples) <= 15 and got.hypervolumes == sorted(got.hypervolumes)
    with pytest.raises(ValueError):
        tune(cr, lambda k: 1.0, acquisition="other")
    assert tune([], lambda k: 1.0).level == 0


def test_standardized_and_nadir():
    y = np.array([[1.0, 2.0], [np.e, 4.0]])
    assert np.allclose(standardized(y), [[-1, -1], [1, 1]]) and (standardized(y[:1]) == y[:1]).all()
    assert np.allclose(nadir(np.array([[0.0, 0.0], [1.0, 4.0]]), 0.1), [-0.4, -0.4]) and np.allclose(nadir(np.array([[0.0, 0.0], [1.0, 4.0]]), 0.1, 2.0), [-0.1, -0.2])
