"""Training of the classifying network of pyspark.ml on many rows: numpy in the tasks, the optimiser on the driver."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

# Rows whose outputs a task holds at once.
STEP_ROWS = 512
# Pairs of steps that L-BFGS remembers, and values it looks back on for convergence; both as pyspark.ml has them.
MEMORY, LOOK_BACK = 10, 20


class SearchFailed(Exception):
    """No step along a direction lowers the loss enough."""


def unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer the matrix (inputs, outputs) and the bias, as views of a weight vector of pyspark.ml."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def loss_sums(x: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, layers: list[int]) -> np.ndarray:
    """[sum of the cross entropy, its gradient...] of rows that count `times` each."""
    out = np.zeros(1 + len(weights))
    steps, slopes = unpacked(weights, layers), unpacked(out[1:], layers)
    for start in range(0, len(x), STEP_ROWS):
        n, held = times[start:start + STEP_ROWS], [x[start:start + STEP_ROWS]]
        for i, (matrix, bias) in enumerate(steps):
            z = held[-1] @ matrix
            z += bias
            if i < len(steps) - 1:
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
            held.append(z)
        z, at = held.pop(), (np.arange(len(n)), y[start:start + STEP_ROWS])
        z -= z.max(1, keepdims=True)
        delta = np.exp(z)
        total = delta.sum(1)
        out[0] += n @ (np.log(total) - z[at])
        delta /= total[:, None]
        delta[at] -= 1
        delta *= n[:, None]
        for i in range(len(steps) - 1, -1, -1):
            slopes[i][0][...] += held[i].T @ delta
            slopes[i][1][...] += delta.sum(0)
            if i:
                delta = delta @ steps[i][0].T
                delta *= held[i]
                delta *= 1 - held[i]
    return out


def mean_loss(points: DataFrame, total: float, layers: list[int]):
    """The mean loss and its gradient as a function of the weights; points are (label int, x array<double>, times double)."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches):
            out = np.zeros(1 + len(weights))
            with np.errstate(over="ignore"):
                for batch in batches:
                    label, x, times = (batch.column(c) for c in ("label", "x", "times"))
                    out += loss_sums(x.flatten().to_numpy().reshape(-1, layers[0]), label.to_numpy(), times.to_numpy(), weights, layers)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = points.mapInArrow(sums, "sums binary").collect()
        both = np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0) / total
        return float(both[0]), both[1:]

    return at


def line_search(along, first: float, slope: float, start: float):
    """The first point (step, value, slope, ...) along a direction that meets the strong Wolfe conditions, as in the library behind pyspark.ml."""
    falls = lambda p: p[1] <= first + 1e-4 * p[0] * slope
    flat = lambda p: abs(p[2]) <= 0.9 * abs(slope)

    def between(a, b):
        left, right = (a, b) if a[0] <= b[0] else (b, a)
        d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
        wide, inside = right[0] - left[0], d1 * d1 - left[2] * right[2]
        bend = right[2] - left[2] + 2 * np.sqrt(max(inside, 0.0))
        t = right[0] - wide * (right[2] + np.sqrt(inside) - d1) / bend if inside >= 0 and bend else left[0] + wide / 2
        return min(max(t, left[0] + 0.1 * wide), left[0] + 0.9 * wide)

    def zoom(low, high):
        for _ in range(10):
            p = along(between(low, high))
            if not falls(p) or p[1] >= low[1]:
                high = p
                continue
            if flat(p):
                return p
            if p[2] * (high[0] - low[0]) >= 0:
                high = low
            low = p
        raise SearchFailed

    t, low = start, (0.0, first, slope)
    for turn in range(10):
        p = along(t)
        if not np.isfinite(p[1]):
            t /= 2
            continue
        if not falls(p) or (p[1] >= low[1] and turn):
            return zoom(low, p)
        if flat(p):
            return p
        if p[2] >= 0:
            return zoom(p, low)
        low, t = p, t * 1.5
    raise SearchFailed


def minimised(f, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """L-BFGS from x, with the settings, the line search and the end of pyspark.ml's networks."""
    value, slope = f(x)
    initial, values, past, failed = value, deque([value], LOOK_BACK), deque(maxlen=MEMORY), False
    done = 0
    while done < iterations and np.linalg.norm(slope) > max(tolerance * value, 1e-8):
        way, shares = slope.copy(), []
        for s, g in reversed(past):
            shares.append((s @ way) / (s @ g))
            way -= shares[-1] * g
        if past:
            s, g = past[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), share in zip(past, reversed(shares)):
            way += (share - (g @ way) / (s @ g)) * s
        way = -way

        def along(t):
            here, there = f(x + t * way)
            return t, here, float(there @ way), there

        try:
            if slope @ way > 0:
                raise SearchFailed
            t, next_value, _, next_slope = line_search(along, value, float(slope @ way), 1.0 if done else 1 / np.linalg.norm(way))
            if t * np.linalg.norm(slope) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed = True
            past.clear()
            continue
        failed = False
        if t * (way @ (next_slope - slope)) > 0:
            past.append((t * way, next_slope - slope))
        x, value, slope = x + t * way, next_value, next_slope
        done += 1
        values.append(value)
        if len(values) > 1 and abs(value - max(values)) <= tolerance * initial:
            break
    return x


def fit_network(network, points: DataFrame, total: float):
    """The model that `network`, a MultilayerPerceptronClassifier, would fit on points (label int, x array<double>, times double), from its own first weights.

    pyspark.ml averages blocks of 128 rows per partition, the last of them smaller; here every row counts the same.
    """
    layers = list(network.getLayers())
    one = points.sparkSession.createDataFrame([(0.0, Vectors.dense([0.0] * layers[0]))], [network.getLabelCol(), network.getFeaturesCol()])
    start = network.getInitialWeights() if network.isSet(network.initialWeights) else network.copy({network.maxIter: 0}).fit(one).weights
    weights = minimised(mean_loss(points, total, layers), start.toArray(), network.getMaxIter(), network.getTol())
    model = network.copy({network.maxIter: 0, network.initialWeights: Vectors.dense(weights)}).fit(one)
    model._set(maxIter=network.getMaxIter())
    model.clear(model.initialWeights)
    return model
