"""A layer of gated recurrent units in numpy, forward and backward over a window of steps, and Adam.

Arrays have features first and lanes last, so that a gate is one block. The squashing functions are x / (1 + |x|) for the
candidate and half of that plus a half for the gates: several times faster than exponentials, and as smooth where it matters.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def start_weights(rng: np.random.Generator, size: int) -> dict[str, np.ndarray]:
    """Recurrent weights (3 * size by size: update, reset, candidate) and the candidate's recurrent bias."""
    u = np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(3)])
    return {"u": u.astype(np.float32), "bu": np.zeros(size, np.float32)}


def by_step(size: int, steps: int, lanes: int, dtype: np.dtype = np.float32) -> np.ndarray:
    """Room for size by steps by lanes in which what belongs to a step lies together."""
    return np.empty((steps, size, lanes), dtype).transpose(1, 0, 2)


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray, bu: np.ndarray) -> np.ndarray:
    """The next state of each lane (size by lanes). x: input to the gates (3 * size by lanes)."""
    size = len(h)
    from_h = u @ h
    gates = from_h[: 2 * size]
    gates += x[: 2 * size]
    squash(gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    new = from_h[2 * size :]
    new += bu[:, None]
    new *= gates[size:]
    new += x[2 * size :]
    squash(new)
    out = h - new
    out *= gates[:size]
    out += new
    return out


def forward(x: np.ndarray, h: np.ndarray, carry: np.ndarray, u: np.ndarray, bu: np.ndarray):
    """States after each step (size by steps by lanes) and what ``backward`` needs.

    x: 3 * size by steps by lanes. carry: steps by lanes, 0 where a lane starts anew.
    """
    size, steps = len(h), x.shape[1]
    states, before, kept = by_step(size, *x.shape[1:], dtype=h.dtype), by_step(size, *x.shape[1:], dtype=h.dtype), []
    for t in range(steps):
        h0 = np.multiply(h, carry[t], out=before[:, t])
        from_h = u @ h0
        gates = from_h[: 2 * size]
        gates += x[: 2 * size, t]
        squash(gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        inner = from_h[2 * size :]
        inner += bu[:, None]
        new = inner * gates[size:]
        new += x[2 * size :, t]
        squash(new)
        change = h0 - new
        h = np.multiply(change, gates[:size], out=states[:, t])
        h += new
        kept.append((gates, inner, new, change))
    return states, (before, kept)


def backward(d_states: np.ndarray, kept: tuple, carry: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients of the gates' inputs (like x) and of the weights; nothing flows into steps before the window."""
    before, steps = kept
    size = u.shape[1]
    dx = by_step(3 * size, *d_states.shape[1:], dtype=u.dtype)
    from_h = by_step(*d_states.shape, dtype=u.dtype)  # gradients of the candidate's part that comes from the state
    dh, du = np.zeros((size, d_states.shape[2]), u.dtype), np.zeros_like(u)
    to_gates, to_inner = np.ascontiguousarray(u[: 2 * size].T), np.ascontiguousarray(u[2 * size :].T)
    for t in range(len(steps) - 1, -1, -1):
        gates, inner, new, change = steps[t]
        dh += d_states[:, t]
        rest = 1 - gates
        # of s = x / (1 + |x|) the slope is (1 - |s|) ** 2; a gate g is (s + 1) / 2, and so 1 - |s| is 2 * min(g, 1 - g)
        slope = np.minimum(gates, rest)
        slope *= slope
        slope += slope
        d_new = np.abs(new)
        np.subtract(1, d_new, out=d_new)
        d_new *= d_new
        d_new *= dh
        d_new = np.multiply(d_new, rest[:size], out=dx[2 * size :, t])
        change *= dh
        inner *= d_new
        np.multiply(change, slope[:size], out=dx[:size, t])
        np.multiply(inner, slope[size:], out=dx[size : 2 * size, t])
        np.multiply(d_new, gates[size:], out=from_h[:, t])
        if t:
            dh *= gates[:size]
            dh += to_gates @ dx[: 2 * size, t]
            dh += to_inner @ from_h[:, t]
            dh *= carry[t]
        du[: 2 * size] += dx[: 2 * size, t] @ before[:, t].T
        du[2 * size :] += from_h[:, t] @ before[:, t].T
    return dx, {"u": du, "bu": from_h.sum((1, 2))}


class Adam:
    """Adam steps on a dict of weights, with gradients scaled to a largest norm."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.003, largest: float = 5.0):
        self.weights, self.rate, self.largest, self.n = weights, rate, largest, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = min(1.0, self.largest / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            g = g * np.float32(scale)
            mean, square = self.mean[k], self.square[k]
            part = g - mean
            part *= np.float32(0.1)
            mean += part
            g *= g
            g -= square
            g *= np.float32(0.001)
            square += g
            np.sqrt(square, out=g)
            g += np.float32(1e-8)
            np.multiply(mean, np.float32(rate), out=part)
            part /= g
            self.weights[k] -= part
