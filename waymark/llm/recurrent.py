"""A bidirectional LSTM that labels every step of a sequence (Hochreiter and Schmidhuber 1997; Graves and Schmidhuber 2005)."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np

#: Steps whose inputs are projected at once.
STEPS = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Labeller:
    """Two LSTM layers, one per direction, and a logistic output for each step."""

    def __init__(self, width: int, hidden: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {}
        for way in ("forth", "back"):
            self.weights[f"{way}_in"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * hidden))
            self.weights[f"{way}_state"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # forget little at first
            self.weights[f"{way}_bias"] = bias
            self.weights[f"{way}_out"] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
        self.weights["bias"] = np.zeros(1)
        self.weights = {name: value.astype(np.float32) for name, value in self.weights.items()}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as stored:
            made.weights = {name: stored[name] for name in stored.files}
        made.hidden = len(made.weights["forth_out"])
        return made

    def _gates(self, z: np.ndarray) -> tuple[np.ndarray, ...]:
        h = self.hidden
        return _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])

    def _walk(self, way: str, inputs: np.ndarray) -> np.ndarray:
        """What a direction adds to the output of each step; inputs are [row, step, feature]."""
        w = self.weights
        rows, steps, _ = inputs.shape
        state = cell = np.zeros((rows, self.hidden), dtype=np.float32)
        out = np.empty((rows, steps), dtype=np.float32)
        for first in range(0, steps, STEPS):
            projected = inputs[:, first : first + STEPS] @ w[f"{way}_in"] + w[f"{way}_bias"]
            for step in range(projected.shape[1]):
                i, f, o, g = self._gates(projected[:, step] + state @ w[f"{way}_state"])
                cell = f * cell + i * g
                state = o * np.tanh(cell)
                out[:, first + step] = state @ w[f"{way}_out"]
        return out

    def predict(self, sequences: Sequence[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Probability of label 1 for each step; sequences of like length are computed together."""
        found: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        while order:
            take = max(1, min(len(order), cells // len(sequences[order[-1]])))
            chosen, order = order[-take:], order[:-take]
            inputs, turned, lengths = _padded([sequences[i] for i in chosen])
            forth = self._walk("forth", inputs)
            back = np.take_along_axis(self._walk("back", np.take_along_axis(inputs, turned[..., None], axis=1)), turned, axis=1)
            scores = _sigmoid(forth + back + self.weights["bias"])
            for i, row, length in zip(chosen, scores, lengths, strict=True):
                found[i] = row[:length]
        return found

    def _learn_way(self, way: str, inputs: np.ndarray):
        """Walk one direction and keep what its gradient needs; returns outputs and a function from their gradient to those of the weights."""
        w, hidden = self.weights, self.hidden
        rows, steps, width = inputs.shape
        projected = inputs @ w[f"{way}_in"] + w[f"{way}_bias"]
        state = cell = np.zeros((rows, hidden), dtype=np.float32)
        kept, out = [], np.empty((rows, steps), dtype=np.float32)
        for step in range(steps):
            i, f, o, g = self._gates(projected[:, step] + state @ w[f"{way}_state"])
            before, old = state, cell
            cell = f * cell + i * g
            bent = np.tanh(cell)
            state = o * bent
            out[:, step] = state @ w[f"{way}_out"]
            kept.append((i, f, o, g, bent, before, old, state))

        def gradient(wanted: np.ndarray) -> dict[str, np.ndarray]:
            d_z = np.empty((rows, steps, 4 * hidden), dtype=np.float32)
            d_state = d_cell = np.zeros((rows, hidden), dtype=np.float32)
            d_out, d_recurrent = np.zeros(hidden, dtype=np.float32), np.zeros_like(w[f"{way}_state"])
            for step in range(steps - 1, -1, -1):
                i, f, o, g, bent, before, old, now = kept[step]
                d_out += wanted[:, step] @ now
                d_state = d_state + wanted[:, step, None] * w[f"{way}_out"]
                d_cell = d_cell + d_state * o * (1 - bent * bent)
                z = d_z[:, step]
                z[:, :hidden] = d_cell * g * i * (1 - i)
                z[:, hidden : 2 * hidden] = d_cell * old * f * (1 - f)
                z[:, 2 * hidden : 3 * hidden] = d_state * bent * o * (1 - o)
                z[:, 3 * hidden :] = d_cell * i * (1 - g * g)
                d_recurrent += before.T @ z
                d_state, d_cell = z @ w[f"{way}_state"].T, d_cell * f
            flat = d_z.reshape(-1, 4 * hidden)
            return {
                f"{way}_in": inputs.reshape(-1, width).T @ flat, f"{way}_state": d_recurrent, f"{way}_bias": flat.sum(axis=0),
                f"{way}_out": d_out,
            }

        return out, gradient

    def gradients(self, sequences: Sequence[np.ndarray], labels: Sequence[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the steps, and its gradient."""
        inputs, turned, lengths = _padded(sequences)
        steps = inputs.shape[1]
        inside = np.arange(steps) < lengths[:, None]
        wanted = np.zeros((len(sequences), steps), dtype=np.float32)
        for row, label in zip(wanted, labels, strict=True):
            row[: len(label)] = label
        forth, forth_gradient = self._learn_way("forth", inputs)
        back, back_gradient = self._learn_way("back", np.take_along_axis(inputs, turned[..., None], axis=1))
        logit = forth + np.take_along_axis(back, turned, axis=1) + self.weights["bias"]
        loss = np.where(inside, np.logaddexp(0.0, logit) - wanted * logit, 0.0).sum() / inside.sum()
        error = np.where(inside, (_sigmoid(logit) - wanted) / inside.sum(), 0.0).astype(np.float32)
        found = forth_gradient(error) | back_gradient(np.take_along_axis(error, turned, axis=1))
        return float(loss), found | {"bias": error.sum(keepdims=True).reshape(1)}

    def fit(
        self, sequences: Sequence[np.ndarray], labels: Sequence[np.ndarray], epochs: int, rate: float = 0.01, batch: int = 32, seed: int = 0
    ) -> float:
        """Adam (Kingma and Ba 2015) over shuffled batches of sequences of like length; returns the last epoch's loss."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(s) for s in sequences], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        first = {name: np.zeros_like(value) for name, value in self.weights.items()}
        second = {name: np.zeros_like(value) for name, value in self.weights.items()}
        count, loss = 0, 0.0
        for epoch in range(epochs):
            pace = rate * (0.1 + 0.9 * (1 - epoch / epochs))
            losses = []
            for group in rng.permutation(len(groups)):
                one, found = self.gradients([sequences[i] for i in groups[group]], [labels[i] for i in groups[group]])
                losses.append(one)
                count += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
                for name, g in found.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-12))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    step = first[name] / (1 - 0.9**count) / (np.sqrt(second[name] / (1 - 0.999**count)) + 1e-8)
                    self.weights[name] = (self.weights[name] - pace * step).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def _padded(sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[row, step, feature], the places that turn each sequence round (padding stays at its end), and the lengths."""
    lengths = np.array([len(s) for s in sequences])
    steps = int(lengths.max())
    inputs = np.zeros((len(sequences), steps, sequences[0].shape[1]), dtype=np.float32)
    for row, sequence in zip(inputs, sequences, strict=True):
        row[: len(sequence)] = sequence
    at = np.arange(steps)
    turned = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return inputs, turned, lengths
