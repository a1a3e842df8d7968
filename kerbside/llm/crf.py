"""Linear-chain conditional random field with two labels, trained and decoded over many sequences at once."""

from __future__ import annotations

import numpy as np


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the sequences, and their numbers from the longest to the shortest."""
    return np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64), np.argsort(-lengths, kind="stable")


def _active(lengths: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """For each position the sequences that reach it."""
    have = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    return [order[:n] for n in have]


class Crf:
    """Label 1 is content.  ``weights``: features x 2, ``moves``: label before x label, both plain arrays."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.moves, self.mean, self.scale = weights, moves, mean, scale

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of sequences laid end to end; of equally good ones, those with the smaller label last."""
        lengths = np.asarray(lengths, dtype=np.int64)
        starts, order = _layout(lengths)
        unary = self.scores(features) if len(features) else np.empty((0, 2))
        best = unary.copy()
        back = np.zeros(unary.shape, dtype=np.int8)
        steps = _active(lengths, order)
        for t, seqs in enumerate(steps[1:], 1):
            at = starts[seqs] + t
            through = best[at - 1][:, :, None] + self.moves[None]
            back[at] = through.argmax(1)
            best[at] += through.max(1)
        labels = np.zeros(len(unary), dtype=np.int8)
        some = lengths > 0
        last = (starts + lengths - 1)[some]
        labels[last] = best[last].argmax(1)
        for t in range(len(steps) - 1, 0, -1):
            at = starts[steps[t]] + t
            labels[at - 1] = back[at, labels[at]]
        return labels


def train(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> Crf:
    """Fit by gradient ascent (Adam) on the likelihood; label -1 is unknown and summed over."""
    lengths = np.asarray(lengths, dtype=np.int64)
    features = np.asarray(features, dtype=np.float64)
    mean, scale = features.mean(0), features.std(0)
    scale[scale < 1e-6] = 1.0
    x = np.c_[(features - mean) / scale, np.ones(len(features))]
    starts, order = _layout(lengths)
    act = _active(lengths, order)
    n = len(x)
    known = np.zeros((n, 2))
    known[labels == 0, 1] = known[labels == 1, 0] = -1e9
    w, moves = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]

    def expected(unary):
        alpha, beta = unary.copy(), np.zeros_like(unary)
        for t, s in enumerate(act[1:], 1):
            at = starts[s] + t
            alpha[at] += np.logaddexp(alpha[at - 1, :1] + moves[0], alpha[at - 1, 1:] + moves[1])
        for t in range(len(act) - 1, 0, -1):
            at = starts[act[t]] + t
            ahead = unary[at] + beta[at]
            beta[at - 1] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        both = alpha + beta
        node = np.exp(both - np.logaddexp(both[:, :1], both[:, 1:]))
        pair = np.zeros((2, 2))
        at = np.setdiff1d(np.arange(n), starts[lengths > 0], assume_unique=True)
        if len(at):
            p = alpha[at - 1][:, :, None] + moves[None] + (unary[at] + beta[at])[:, None, :]
            p = np.exp(p - p.max((1, 2), keepdims=True))
            pair = (p / p.sum((1, 2), keepdims=True)).sum(0)
        return node, pair

    for step in range(1, steps + 1):
        unary = x @ w
        node, pair = expected(unary)
        node_k, pair_k = expected(unary + known)
        grads = [x.T @ (node_k - node) / n - ridge * w, (pair_k - pair) / n - ridge * moves]
        for i, (param, g) in enumerate(zip((w, moves), grads)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            param += 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(w, moves, mean, scale)
