"""Two-label linear-chain conditional random fields over hashed features, with numpy.

Sequences are handled side by side: arrays are padded to the longest one, and each step of
a chain is one operation on all sequences.
"""

from __future__ import annotations

import numpy as np


#: Places whose features are looked up at once.
PLACES = 1 << 16


class ChainCrf:
    """Label 1 scores the sum of its features' weights; transitions and starts are free."""

    def __init__(self, buckets: int):
        self.weights = np.zeros(buckets)
        self.steps = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores of label 1, from an array whose last axis holds feature buckets."""
        flat = features.reshape(-1, features.shape[-1])
        out = np.empty(len(flat))
        for at in range(0, len(flat), PLACES):
            out[at : at + PLACES] = self.weights[flat[at : at + PLACES]].sum(-1)
        return out.reshape(features.shape[:-1])

    def _forward(self, scores: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
        """Odds-normalised messages: per position, the share of label 1, and the running norm."""
        e = np.exp(np.clip(scores, -30, 30))
        n = scores.shape[1]
        shares = np.empty(scores.shape)
        first = np.exp(self.start[1] - self.start[0]) * e[:, 0]
        shares[:, 0] = first / (1 + first)
        for t in range(1, n):
            p = shares[:, t - 1]
            one = ((1 - p) * step[0, 1] + p * step[1, 1]) * e[:, t]
            zero = (1 - p) * step[0, 0] + p * step[1, 0]
            shares[:, t] = one / (one + zero)
        return shares, e

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Probability of label 1 at each place of padded sequences (0 behind their ends)."""
        step = np.exp(self.steps)
        shares, e = self._forward(scores, step)
        n = scores.shape[1]
        beta = np.full((len(scores), 2), 0.5)
        out = np.zeros(scores.shape)
        joint = np.zeros((2, 2))
        for t in range(n - 1, -1, -1):
            live = lengths > t
            p = shares[:, t]
            one, zero = p * beta[:, 1], (1 - p) * beta[:, 0]
            out[:, t] = np.where(live, one / (one + zero), 0)
            if t:
                back = np.stack([beta[:, 0], beta[:, 1] * e[:, t]], 1)
                if pairs:
                    q = shares[:, t - 1]
                    cell = np.stack([1 - q, q], 1)[:, :, None] * step[None] * back[:, None, :]
                    cell /= cell.sum((1, 2), keepdims=True)
                    joint += (cell * live[:, None, None]).sum(0)
                new = np.stack([step[0, 0] * back[:, 0] + step[0, 1] * back[:, 1],
                                step[1, 0] * back[:, 0] + step[1, 1] * back[:, 1]], 1)
                new /= new.sum(1, keepdims=True)
                beta = np.where(live[:, None], new, beta)
        return (out, joint) if pairs else out

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of one sequence."""
        n = len(scores)
        best = np.array([self.start[0], self.start[1] + scores[0]])
        back = np.zeros((n, 2), np.int8)
        for t in range(1, n):
            ways = best[:, None] + self.steps
            back[t] = ways.argmax(0)
            best = ways.max(0)
            best[1] += scores[t]
        labels = np.empty(n, np.int8)
        labels[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, epochs: int = 60,
            rate: float = 0.1, penalty: float = 1e-4) -> ChainCrf:
        """Full-batch Adam on the conditional likelihood; arrays are (sequence, place[, feature])."""
        live = np.arange(labels.shape[1])[None] < lengths[:, None]
        flat, total = features[live], live.sum()
        both = live[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
        starts = np.bincount(labels[:, 0], minlength=2)[:2]
        params = [self.weights, self.steps, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for epoch in range(1, epochs + 1):
            scores = np.where(live, self.emissions(features), 0)
            p, joint = self.marginals(scores, lengths, pairs=True)
            wrong = np.repeat((p - labels)[live], flat.shape[-1])
            grads = [
                np.bincount(flat.ravel(), wrong, len(self.weights)) / total + penalty * self.weights,
                (joint - seen) / total,
                (np.array([1 - p[:, 0], p[:, 0]]).sum(1) - starts) / total,
            ]
            for x, g, a, b in zip(params, grads, first, second):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                x -= rate * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
        return self
