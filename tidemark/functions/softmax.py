"""Softmax regression on one block of rows; used inside Spark tasks.

Weights are a ``(classes, features + 1)`` array whose column 0 is the intercept.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
import pyarrow as pa

MEMORY, TOLERANCE = 10, 1e-6  # steps that L-BFGS remembers; size of the gradient, in units of the loss, at which it stops
TRIES = 20  # lengths that are tried along a direction


def dense_block(column: pa.Array, width: int) -> np.ndarray:
    """ARRAY<number> or MAP<INT, number> column as a dense ``(rows, width)`` block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if pa.types.is_map(column.type):
        offsets = column.offsets.to_numpy()
        first, last = int(offsets[0]), int(offsets[-1])
        rows = np.repeat(np.arange(n), np.diff(offsets))
        block = np.zeros((n, width))
        block[rows, column.keys.to_numpy()[first:last]] = column.items.to_numpy(zero_copy_only=False)[first:last]
        return block
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size != n * width:
        raise ValueError(f"expected {width} features in every row")
    return flat.reshape(n, width).astype(np.float64)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w.T


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy and its gradient over the rows of one block."""
    if len(y) and not (0 <= y.min() and y.max() < len(w)):
        raise ValueError(f"labels must lie in 0..{len(w) - 1}; part them off with validate_labels")
    z = margins(x, w)
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1)
    rows = np.arange(len(y))
    loss = float(np.sum(np.log(total) - z[rows, y]))
    residual = e / total[:, None]
    residual[rows, y] -= 1.0
    return loss, residual.T @ x


def lbfgs(w: np.ndarray, iterations: int, memory: int = MEMORY, tolerance: float = TOLERANCE) -> Generator:
    """L-BFGS that asks for values: yields a point, is sent ``(loss, gradient)``.

    Returns ``(w, losses)`` where ``losses`` starts with the loss before the
    first step.  The caller decides how a point is evaluated: on one block in
    a task, or with one Spark job over all rows.
    """
    shape = w.shape
    point = w.ravel().astype(np.float64)
    loss, gradient = yield point.reshape(shape)
    gradient = gradient.ravel()
    losses, steps = [loss], []
    for iteration in range(iterations):
        norm = np.linalg.norm(gradient)
        if norm <= tolerance * max(1.0, abs(loss)):
            break
        direction = -_inverse_hessian_times(gradient, steps)
        slope = float(direction @ gradient)
        if slope >= 0:
            direction, slope, steps = -gradient, -norm * norm, []
        first = 1.0 / np.linalg.norm(direction) if iteration == 0 else 1.0
        found = yield from _wolfe_step(point, direction, shape, loss, slope, first)
        if found is None:
            break
        length, new_loss, new_gradient = found
        change = length * direction
        turn = new_gradient - gradient
        if change @ turn > 1e-12:
            steps = [*steps, (change, turn)][-memory:]
        point, loss, gradient = point + change, new_loss, new_gradient
        losses.append(loss)
    return point.reshape(shape), losses


def _inverse_hessian_times(gradient: np.ndarray, steps: list) -> np.ndarray:
    q, used = gradient.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        used.append(a)
        q -= a * y
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(used)):
        q += s * (a - (y @ q) / (s @ y))
    return q


def scale_of(sums: np.ndarray, squares: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation per feature, 1 for the intercept, 0 for a constant feature."""
    if n < 2:
        scale = np.ones_like(sums)
    else:
        variance = (squares - sums * sums / n) / (n - 1)
        scale = np.sqrt(np.where(variance > 1e-12 * np.maximum(1.0, squares / n), variance, 0.0))
    scale[0] = 1.0
    return scale


def unscale(w: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.divide(w, scale, out=np.zeros_like(w), where=scale > 0)


def fit_block(x: np.ndarray, y: np.ndarray, old: np.ndarray, iterations: int) -> tuple[np.ndarray, float]:
    """New minus old weights after L-BFGS steps on one block of rows, and the mean loss at the end."""
    scale = scale_of(x.sum(axis=0), (x * x).sum(axis=0), len(y))
    steps = lbfgs(old * scale, iterations)
    point = next(steps)
    while True:
        loss, gradient = loss_and_gradient(x, y, unscale(point, scale))
        try:
            point = steps.send((loss / len(y), unscale(gradient, scale) / len(y)))
        except StopIteration as done:
            new, losses = done.value
            return np.where(scale > 0, unscale(new, scale) - old, 0.0), losses[-1]


class StepLength:
    """Searches a step length that lowers the loss enough and flattens the slope enough.

    ``length`` is the one to try next; :meth:`tell` takes the loss and the slope
    found there.
    """

    def __init__(self, loss: float, slope: float, length: float, decrease: float = 1e-4, curvature: float = 0.9):
        self.loss, self.slope, self.length = loss, slope, length
        self.decrease, self.curvature = decrease, curvature
        self.low, self.high, self.least = 0.0, None, None

    def tell(self, loss: float, slope: float) -> tuple[bool, bool]:
        """Whether the length is the best so far that lowers the loss enough, and whether the search is over."""
        better = False
        if loss > self.loss + self.decrease * self.length * self.slope:
            self.high = self.length
        else:
            better = self.least is None or loss <= self.least
            if better:
                self.least = loss
            if abs(slope) <= -self.curvature * self.slope:
                return better, True
            if slope > 0:
                self.high = self.length
            else:
                self.low = self.length
        self.length = self.length * 1.5 if self.high is None else (self.low + self.high) / 2
        return better, False


def _wolfe_step(point, direction, shape, loss0, slope0, length):
    search, best = StepLength(loss0, slope0, length), None
    for _ in range(TRIES):
        length = search.length
        loss, gradient = yield (point + length * direction).reshape(shape)
        gradient = gradient.ravel()
        better, done = search.tell(loss, float(direction @ gradient))
        if better or done:
            best = (length, loss, gradient)
        if done:
            break
    return best
