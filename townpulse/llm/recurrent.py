"""Gated recurrent layers in numpy: running them, and their gradients by backpropagation through time.

A layer has gates z (keep the old state), r (how much the old state feeds the candidate) and the
candidate n. Inputs come already multiplied by their weights: three blocks of ``hidden`` columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Input that empties the state: both gates shut, no candidate.
SHUT = -30.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, through tanh."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def blank_input(hidden: int) -> np.ndarray:
    """The input row of a place without content."""
    return np.repeat(np.array([SHUT, SHUT, 0], np.float32), hidden)


def parts(x: np.ndarray) -> list[np.ndarray]:
    """The three blocks of columns, each contiguous (numpy is much faster on those)."""
    return [np.ascontiguousarray(p) for p in np.split(x, 3, axis=-1)]


def run_layer(
    steps: int,
    rows: int,
    inputs: Callable[[int], list[np.ndarray]],
    weights: np.ndarray,
    backwards: bool,
) -> np.ndarray:
    """States (steps, rows, hidden); ``inputs(t)`` gives three new (rows, hidden) arrays."""
    hidden = weights.shape[0]
    to_z, to_r, to_n = parts(weights)
    out = np.empty((steps, rows, hidden), np.float32)
    state = np.zeros((rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        z, r, n = inputs(t)
        z += state @ to_z
        r += state @ to_r
        g = state @ to_n
        g *= sigmoid(r)
        n += g
        np.tanh(n, out=n)
        state = state - n
        state *= sigmoid(z)
        np.add(state, n, out=out[t])
        state = out[t]
    return out


def layer_gradients(
    inputs: np.ndarray, states: np.ndarray, grads: np.ndarray, weights: np.ndarray, backwards: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs (steps, rows, 3 * hidden) and of the weights.

    ``states`` are those of ``run_layer``, ``grads`` the loss's gradients at them.
    """
    steps, rows, hidden = states.shape
    d_inputs, d_weights = np.empty_like(inputs), np.zeros_like(weights)
    carry = np.zeros((rows, hidden), np.float32)
    for t in range(steps) if backwards else range(steps - 1, -1, -1):
        before = t + 1 if backwards else t - 1
        old = states[before] if 0 <= before < steps else np.zeros((rows, hidden), np.float32)
        g = old @ weights
        gates = sigmoid(inputs[t][:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(inputs[t][:, 2 * hidden :] + r * g[:, 2 * hidden :])
        d_state = grads[t] + carry
        d_new = d_state * (1 - z) * (1 - new * new)
        d_x = d_inputs[t]
        d_x[:, :hidden] = d_state * (old - new) * z * (1 - z)
        d_x[:, hidden : 2 * hidden] = d_new * g[:, 2 * hidden :] * r * (1 - r)
        d_x[:, 2 * hidden :] = d_new
        d_g = d_x.copy()
        d_g[:, 2 * hidden :] *= r
        d_weights += old.T @ d_g
        carry = d_state * z + d_g @ weights.T
    return d_inputs, d_weights


class Adam:
    """Adam steps on a dict of arrays, in place."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in values.items()}
        self.second = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.first[k] = 0.9 * self.first[k] + np.float32(0.1) * g
            self.second[k] = 0.999 * self.second[k] + np.float32(0.001) * g * g
            m = self.first[k] / (1 - 0.9**self.t)
            v = self.second[k] / (1 - 0.999**self.t)
            self.values[k] -= np.float32(rate or self.rate) * m / (np.sqrt(v) + np.float32(1e-8))
