"""Skip-chain conditional random field over tokens, in numpy.

Texts of one batch are padded to one array. Neighbours share transition potentials;
tokens of one text that repeat another share a potential with it that favours the same
kind, with a weight for each kind. Marginals come from loopy message passing: exact passes along the
chains alternate with damped messages over the skip edges.
"""

from __future__ import annotations

import numpy as np

IMPOSSIBLE = -1e4
#: Least probability of a message.
TINY = 1e-300
#: Rounds of messages over skip edges, and the part of the old message that is kept.
ROUNDS, DAMPING = 4, 0.5


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class SkipChain:
    """Labels are O and B-/I- of each kind; I- follows B- or I- of its kind only."""

    def __init__(self, kinds: list[str], n_features: int):
        self.kinds = kinds
        self.labels = ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]
        n = len(self.labels)
        self.kind_of = np.array([0, *[i + 1 for i in range(len(kinds)) for _ in "BI"]])
        allowed = np.ones((n, n), bool)
        for j in range(2, n, 2):
            allowed[:, j] = self.kind_of == self.kind_of[j]
        self.closed = np.where(allowed, 0.0, IMPOSSIBLE)
        self.first = np.where(np.arange(n) % 2 == 0, IMPOSSIBLE, 0.0)
        self.first[0] = 0.0
        self.same = (self.kind_of[:, None] == self.kind_of[None, :]).astype(float)
        #: Weight of agreement on each kind, the outside first.
        self.agree = np.zeros(len(kinds) + 1)
        self.weights = np.zeros((n_features, n))
        self.steps = np.zeros((n, n))

    def bond(self) -> np.ndarray:
        """Potentials of a skip edge's pair of labels."""
        return self.same * self.agree[self.kind_of]

    def scores(self, features: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded label scores [text, token, label] from the active features of each token."""
        lengths = np.array([len(t) for t in features])
        flat = np.fromiter((f for t in features for token in t for f in token), np.int64)
        counts = np.fromiter((len(token) for t in features for token in t), np.int64)
        starts = np.cumsum(counts) - counts
        summed = np.add.reduceat(self.weights[flat], starts, axis=0)
        out = np.zeros((len(features), lengths.max(), len(self.labels)))
        out[np.arange(lengths.max())[None, :] < lengths[:, None]] = summed
        return out, lengths

    def _chain(self, unary: np.ndarray, lengths: np.ndarray):
        """Forward and backward log messages of all chains at once, each up to a constant.

        The passes run on probabilities that are scaled at every token.
        """
        t = unary.shape[1]
        move = np.exp(self.steps + self.closed)
        here = np.exp(unary - unary.max(2, keepdims=True))
        ahead, behind = np.empty_like(unary), np.ones_like(unary)
        now = here[:, 0] * np.exp(self.first)
        ahead[:, 0] = now
        for i in range(1, t):
            now = (now @ move) * here[:, i]
            now /= now.sum(1, keepdims=True)
            ahead[:, i] = now
        back = move.T
        for i in range(t - 2, -1, -1):
            step = (behind[:, i + 1] * here[:, i + 1]) @ back
            step /= step.sum(1, keepdims=True)
            behind[:, i] = step
            short = lengths <= i + 1
            if short.any():
                behind[short, i] = 1.0
        return np.log(np.maximum(ahead, TINY)), np.log(np.maximum(behind, TINY))

    def infer(self, unary: np.ndarray, lengths: np.ndarray, edges: np.ndarray):
        """Beliefs by loopy message passing; edges are rows (text, token, later token).

        Returns unary scores with the skip messages, forward and backward messages, and
        the log beliefs of each edge's pair of labels.
        """
        k = unary.shape[2]
        if not len(edges):
            return unary, *self._chain(unary, lengths), np.zeros((0, k, k))
        bond = self.bond()
        text, a, b = edges.T
        to_a, to_b = np.zeros((len(edges), k)), np.zeros((len(edges), k))
        for _ in range(ROUNDS):
            full = unary.copy()
            np.add.at(full, (text, a), to_a)
            np.add.at(full, (text, b), to_b)
            ahead, behind = self._chain(full, lengths)
            belief = ahead + behind
            free_a, free_b = belief[text, a] - to_a, belief[text, b] - to_b
            new_b = logsumexp(free_a[:, :, None] + bond, 1)
            new_a = logsumexp(free_b[:, :, None] + bond, 1)
            new_a -= logsumexp(new_a, 1)[:, None]
            new_b -= logsumexp(new_b, 1)[:, None]
            to_a = DAMPING * to_a + (1 - DAMPING) * new_a
            to_b = DAMPING * to_b + (1 - DAMPING) * new_b
        full = unary.copy()
        np.add.at(full, (text, a), to_a)
        np.add.at(full, (text, b), to_b)
        ahead, behind = self._chain(full, lengths)
        belief = ahead + behind
        pair = (belief[text, a] - to_a)[:, :, None] + (belief[text, b] - to_b)[:, None, :] + bond
        pair -= logsumexp(pair.reshape(len(edges), -1), 1)[:, None, None]
        return full, ahead, behind, pair

    def decode(self, features: list[list[list[int]]], edges: np.ndarray) -> list[np.ndarray]:
        """Best label sequences under the scores that hold the skip messages."""
        unary, lengths = self.scores(features)
        full = self.infer(unary, lengths, edges)[0]
        n, t, _ = full.shape
        move = self.steps + self.closed
        best = full[:, 0] + self.first
        back = np.zeros(full.shape, np.int64)
        at_end = [None] * n
        for i in range(t):
            if i:
                options = best[:, :, None] + move
                back[:, i] = options.argmax(1)
                best = options.max(1) + full[:, i]
            for k in np.flatnonzero(lengths == i + 1):
                at_end[k] = int(best[k].argmax())
        paths = []
        for k in range(n):
            path = np.empty(lengths[k], np.int64)
            path[-1] = at_end[k]
            for i in range(lengths[k] - 1, 0, -1):
                path[i - 1] = back[k, i, path[i]]
            paths.append(path)
        return paths

    def fit(self, features, edges: np.ndarray, labels: list[list[int]], steps: int = 60, rate: float = 0.05, pull: float = 0.5):
        """Gradient steps on the likelihood; weights are pulled to where they start."""
        anchors = [self.weights.copy(), self.steps.copy(), self.agree.copy()]
        flat = np.fromiter((f for t in features for token in t for f in token), np.int64)
        owner = np.repeat(
            np.arange(sum(len(t) for t in features)), [len(token) for t in features for token in t]
        )
        gold = np.concatenate([np.array(x) for x in labels])
        mean = [np.zeros_like(a) for a in anchors]
        square = [np.zeros_like(a) for a in anchors]
        for step in range(1, steps + 1):
            unary, lengths = self.scores(features)
            full, ahead, behind, pair = self.infer(unary, lengths, edges)
            live = np.arange(unary.shape[1])[None, :] < lengths[:, None]
            belief = ahead + behind
            belief -= logsumexp(belief, 2)[:, :, None]
            gap = -np.exp(belief[live])
            gap[np.arange(len(gold)), gold] += 1
            g_weights = np.zeros_like(self.weights)
            np.add.at(g_weights, flat, gap[owner])
            g_steps = np.zeros_like(self.steps)
            for i in range(1, unary.shape[1]):
                on = lengths > i
                both = ahead[on, i - 1, :, None] + self.steps + self.closed + (full[on, i] + behind[on, i])[:, None, :]
                both -= logsumexp(both.reshape(on.sum(), -1), 1)[:, None, None]
                g_steps -= np.exp(both).sum(0)
            for x in labels:
                np.add.at(g_steps, (x[:-1], x[1:]), 1)
            g_agree = np.zeros_like(self.agree)
            for t, a, b in edges.tolist():
                if self.same[labels[t][a], labels[t][b]]:
                    g_agree[self.kind_of[labels[t][a]]] += 1
            np.subtract.at(g_agree, self.kind_of, (np.exp(pair) * self.same).sum((0, 1)))
            now = [self.weights, self.steps, self.agree]
            for i, (x, g, anchor) in enumerate(zip(now, (g_weights, g_steps, g_agree), anchors, strict=True)):
                g = g - pull * (x - anchor)
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                x += rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def stays_outside(self, unary: np.ndarray) -> bool:
        """Whether a chain of any length, all of whose tokens have these scores, is best all O.

        The gain of every path of labels over the path of O is bounded by the longest
        paths over the labels, which exist unless a cycle gains.
        """
        gain = self.steps + self.closed + unary[None, :] - self.steps[0, 0] - unary[0]
        best = gain.copy()
        for k in range(len(unary)):
            best = np.maximum(best, best[:, k, None] + best[None, k, :])
        start = self.first + unary - unary[0]
        inner = np.maximum(start, (start[:, None] + best).max(0))
        return bool((np.diag(best) <= 0).all() and (inner[1:] < 0).all())
