"""Long short-term memory layers in numpy: running them, and their gradients through time.

Inputs come already multiplied by their weights: four blocks of ``hidden`` columns for the input gate,
the forget gate, the output gate and the candidate. ``real`` marks the steps that a row has; elsewhere
its state is empty, so short rows may stand beside long ones in both directions.
"""

from __future__ import annotations

import numpy as np

from townpulse.llm.recurrent import sigmoid


def run_lstm(
    inputs: np.ndarray, weights: np.ndarray, real: np.ndarray, backwards: bool
) -> tuple[np.ndarray, np.ndarray]:
    """States and cells (steps, rows, hidden) for inputs (steps, rows, 4 * hidden)."""
    steps, rows, _ = inputs.shape
    hidden = weights.shape[0]
    states = np.zeros((steps, rows, hidden), np.float32)
    cells = np.zeros((steps, rows, hidden), np.float32)
    state = cell = np.zeros((rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        gates = inputs[t] + state @ weights
        sigmoid(gates[:, : 3 * hidden])
        np.tanh(gates[:, 3 * hidden :], out=gates[:, 3 * hidden :])
        i, f, o, g = np.split(gates, 4, axis=1)
        cell = (f * cell + i * g) * real[t][:, None]
        state = o * np.tanh(cell) * real[t][:, None]
        states[t], cells[t] = state, cell
    return states, cells


def lstm_gradients(
    inputs: np.ndarray,
    weights: np.ndarray,
    real: np.ndarray,
    backwards: bool,
    states: np.ndarray,
    cells: np.ndarray,
    grads: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the weights; ``grads`` are the loss's at the states."""
    steps, rows, hidden = states.shape
    d_inputs, d_weights = np.empty_like(inputs), np.zeros_like(weights)
    empty = np.zeros((rows, hidden), np.float32)
    d_state, d_cell = empty, empty
    for t in range(steps) if backwards else range(steps - 1, -1, -1):
        before = t + 1 if backwards else t - 1
        old_state, old_cell = (states[before], cells[before]) if 0 <= before < steps else (empty, empty)
        gates = inputs[t] + old_state @ weights
        sigmoid(gates[:, : 3 * hidden])
        np.tanh(gates[:, 3 * hidden :], out=gates[:, 3 * hidden :])
        i, f, o, g = np.split(gates, 4, axis=1)
        on = real[t][:, None]
        squashed = np.tanh(cells[t])
        d_h = (grads[t] + d_state) * on
        d_c = (d_h * o * (1 - squashed * squashed) + d_cell) * on
        d_gates = np.concatenate(
            [d_c * g * i * (1 - i), d_c * old_cell * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g * g)],
            axis=1,
        )
        d_inputs[t] = d_gates
        d_weights += old_state.T @ d_gates
        d_state, d_cell = d_gates @ weights.T, d_c * f
    return d_inputs, d_weights
