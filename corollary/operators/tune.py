"""How many rules to apply: two objectives, compression ratio and workload latency.

The compression ratio of every level is known; latencies are measured. A Gaussian process models the
latency objective over the level, and the next level to measure is the one with the largest expected
hypervolume improvement over the front found so far. A few hundred levels at most: numpy on the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

ACQUISITIONS = ("qehvi", "qnehvi")


def design_points(n: int, initial: int = 5) -> list[int]:
    """Every (n // initial)-th level of 1..n."""
    step = max(1, n // initial)
    return list(range(step, n + 1, step))[:initial] or [n]


def objectives(cr: np.ndarray, latency: np.ndarray, initial: int) -> np.ndarray:
    """Both to be maximised: 1 / ratio, and the least initial latency over the latency."""
    return np.stack([1 / cr, latency[:initial].min() / latency], axis=1)


def pareto(y: np.ndarray) -> np.ndarray:
    """Which points no other point is at least as good in both and better in one."""
    return np.array([not any((z >= p).all() and (z > p).any() for z in y) for p in y])


def standardized(y: np.ndarray) -> np.ndarray:
    """Objectives for a model of both: the logarithm of the first and the second, each with mean 0 and
    deviation 1; a single point, and an objective that does not vary, stay as they are."""
    if len(y) == 1:
        return y
    z = np.stack([np.log(y[:, 0]), y[:, 1]], axis=1)
    return (z - z.mean(axis=0)) / np.where(z.std(axis=0) > 0, z.std(axis=0), 1.0)


def nadir(z: np.ndarray, delta: float = 0.005, alpha: float = 1.0) -> np.ndarray:
    """A reference point a little below the least of each objective. alpha at most 1 takes the first
    objective's range from the second one's, above 1 the second's from the first one's."""
    low, span = z.min(axis=0), np.ptp(z, axis=0)
    if alpha <= 1:
        span[0] = span[1] / alpha
    else:
        span[1] = span[0] * alpha
    return low - delta * span


def hypervolume(y: np.ndarray, ref: np.ndarray) -> float:
    area, reach = 0.0, ref[1]
    for a, b in sorted((tuple(p) for p in y if (p > ref).all()), reverse=True):
        if b > reach:
            area += (a - ref[0]) * (b - reach)
            reach = b
    return area


class GaussianProcess:
    """Squared-exponential kernel; length and noise by the marginal likelihood on a grid."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.scale = np.asarray(x, float), float(np.mean(y)), float(np.std(y)) or 1.0
        z = (np.asarray(y, float) - self.mean) / self.scale
        best = -np.inf
        for length in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6):
            for noise in (1e-4, 1e-3, 1e-2, 1e-1):
                low = np.linalg.cholesky(self._k(self.x, self.x, length) + noise * np.eye(len(z)))
                alpha = np.linalg.solve(low.T, np.linalg.solve(low, z))
                fit = -0.5 * z @ alpha - np.log(np.diag(low)).sum()
                if fit > best:
                    best, self.low, self.alpha, self.length = fit, low, alpha, length

    @staticmethod
    def _k(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None] - b[None]) / length) ** 2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self._k(np.asarray(x, float), self.x, self.length)
        v = np.linalg.solve(self.low, k.T)
        return self.mean + self.scale * (k @ self.alpha), self.scale * np.sqrt(np.maximum(1 - (v**2).sum(axis=0), 1e-12))


def _above(m: float, s: float, t: float) -> float:
    """E[max(Y - t, 0)] for Y normal with mean m and deviation s."""
    u = (m - t) / s
    return (m - t) * 0.5 * (1 + math.erf(u / math.sqrt(2))) + s * math.exp(-u * u / 2) / math.sqrt(2 * math.pi)


def expected_improvement(first: float, m: float, s: float, y: np.ndarray, ref: np.ndarray) -> float:
    """Expected growth of the hypervolume by a point whose first objective is known and whose second is
    normal: over each strip of the first objective up to ``first``, what exceeds the front there."""
    if first <= ref[0]:
        return 0.0
    front = sorted({(a, b) for a, b in y if a > ref[0] and b > ref[1]})
    edges = [ref[0], *(a for a, _ in front if a < first), first]
    total = 0.0
    for low, high in zip(edges, edges[1:]):
        height = max([ref[1], *(b for a, b in front if a >= high)])
        total += (high - low) * _above(m, s, height)
    return total


def choose(y: np.ndarray, ref: np.ndarray) -> int:
    """The point with the largest box over the reference point, else the nearest to it."""
    d = y - ref
    good = (d > 0).all(axis=1)
    return int(np.argmax(np.where(good, d[:, 0] * d[:, 1], -np.inf))) if good.any() else int(np.argmin((d**2).sum(axis=1)))


@dataclass
class Tuned:
    level: int
    samples: list[tuple[int, float, float]]  # level, ratio, latency
    hypervolumes: list[float]


def tune(cr: list[float], latency: Callable[[int], float], initial: int = 5, rounds: int = 10, acquisition: str = "qehvi", reference: tuple[float, float] | None = None, seed: int = 0) -> Tuned:
    """cr[k - 1]: the ratio at level k. latency(k): measured there, relative to the original base."""
    if acquisition not in ACQUISITIONS:
        raise ValueError(f"unknown acquisition: {acquisition}")
    if not cr:
        return Tuned(0, [], [])
    n, ratio = len(cr), np.asarray(cr, float)
    seen = design_points(n, initial)
    times = [latency(k) for k in seen]
    volumes: list[float] = []
    rng = np.random.default_rng(seed)
    for step in range(rounds + 1):
        y = objectives(ratio[[k - 1 for k in seen]], np.array(times), initial)
        ref = np.array(reference) if reference else y[: min(initial, len(y))].min(axis=0)
        volumes.append(hypervolume(y, ref))
        rest = [k for k in range(1, n + 1) if k not in seen]
        if step == rounds or not rest:
            break
        gp = GaussianProcess(np.array(seen) / n, y[:, 1])
        m, s = gp.predict(np.array(rest) / n)
        if acquisition == "qehvi":
            gain = [expected_improvement(1 / ratio[k - 1], a, b, y, ref) for k, a, b in zip(rest, m, s)]
        else:  # the front itself is noisy: the mean over draws of the measured levels' values
            pm, ps = gp.predict(np.array(seen) / n)
            draws = [np.stack([y[:, 0], pm + ps * rng.standard_normal(len(pm))], axis=1) for _ in range(32)]
            gain = [float(np.mean([expected_improvement(1 / ratio[k - 1], a, b, d, ref) for d in draws])) for k, a, b in zip(rest, m, s)]
        k = rest[int(np.argmax(gain))]
        seen.append(k)
        times.append(latency(k))
    best = choose(y, ref)
    return Tuned(seen[best], [(k, float(ratio[k - 1]), t) for k, t in zip(seen, times)], volumes)


def workload_seconds(answers) -> float:
    """Wall-clock time to compute DataFrames without keeping their rows."""
    began = time.perf_counter()
    for df in answers:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
