"""A small convolutional text classifier in numpy.

Items (bytes or hashed words) have embeddings; filters of several widths slide
over them; the maximum of each filter over a text, rectified, feeds a softmax.
For prediction the embeddings are multiplied into the filters once: a table per
place of a filter gives the response of an item, so a convolution is a sum of
shifted table rows and gives the same numbers as the product would.
"""

from __future__ import annotations

import numpy as np


class ConvNet:
    def __init__(self, vocabulary: int, classes: int, embed: int = 8, widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        self.widths, self.filters, self.classes = widths, filters, classes
        self.embedding = (r.standard_normal((vocabulary, embed)) * 0.5).astype(np.float32)
        self.kernels = [(r.standard_normal((k, embed, filters)) * (2 / (k * embed)) ** 0.5).astype(np.float32) for k in widths]
        self.bias = np.zeros(len(widths) * filters, np.float32)
        self.out = (r.standard_normal((len(widths) * filters, classes)) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)
        self._seen: dict[int, np.ndarray] = {}
        self.silent: int | None = None  # an item whose embedding stays zero

    # Every text ends with ``max(widths) - 1`` empty items, so each of its items can begin a filter.
    def pad(self) -> int:
        return max(self.widths) - 1

    def _step(self, key: int, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Adagrad."""
        s = self._seen.setdefault(key, np.zeros_like(value))
        s += grad * grad
        value -= rate * grad / (np.sqrt(s) + 1e-6)

    def _forward(self, feats: list[np.ndarray], live: np.ndarray, starts: np.ndarray):
        """feats: for each feature the item numbers, flat; live: 0 for padding."""
        e = self.embedding[feats[0]]
        for f in feats[1:]:
            e = e + self.embedding[f]
        e *= live[:, None]
        pooled, where = [], []
        n = len(live)
        for k, kern in zip(self.widths, self.kernels, strict=True):
            y = e[: n] @ kern[0]
            for j in range(1, k):
                y[: n - j] += e[j:] @ kern[j]
            y[live == 0] = 0  # a filter that begins after a text would reach into the next one
            at = np.stack([s + y[s:t].argmax(0) for s, t in zip(starts, [*starts[1:], n], strict=True)])
            where.append(at)
            pooled.append(np.take_along_axis(y, at, 0))
        return e, np.concatenate(pooled, 1) + self.bias, where

    def train(self, texts: list[list[np.ndarray]], y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.05, seed: int = 2, weight: np.ndarray | None = None, drop: float = 0.0) -> None:
        """texts: for each text its features, arrays of item numbers of equal length. Of the items a share
        ``drop`` is left out at random each time, so no single item can stand for a text."""
        r = np.random.default_rng(seed)
        weight = np.ones(self.classes) if weight is None else weight
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), batch):
                some = [texts[i] for i in order[lo : lo + batch]]
                if drop:
                    some = [[f[k] for f in t] for t in some for k in [r.random(len(t[0])) >= drop]]
                self._learn(some, y[order[lo : lo + batch]], rate, weight)
                if self.silent is not None:
                    self.embedding[self.silent] = 0

    def flat(self, texts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        pad = self.pad()
        lens = np.array([len(t[0]) + max(1, pad) for t in texts])
        starts = np.cumsum(lens) - lens
        feats = [np.zeros(lens.sum(), np.int64) for _ in texts[0]]
        live = np.zeros(lens.sum(), np.float32)
        for s, t in zip(starts, texts, strict=True):
            live[s : s + len(t[0])] = 1
            for f, x in zip(feats, t, strict=True):
                f[s : s + len(x)] = x
        return feats, live, starts

    def _learn(self, texts, y, rate, weight) -> None:
        feats, live, starts = self.flat(texts)
        e, z, where = self._forward(feats, live, starts)
        a = np.maximum(z, 0)
        logit = a @ self.out + self.out_bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p
        g[np.arange(len(y)), y] -= 1
        g = (g * weight[y][:, None] / len(y)).astype(np.float32)
        ga = (g @ self.out.T) * (z > 0)
        self._step(0, self.out, a.T @ g, rate)
        self._step(1, self.out_bias, g.sum(0), rate)
        self._step(2, self.bias, ga.sum(0), rate)
        n, dim = len(live), self.embedding.shape[1]
        rows, grads = [], []
        for i, (k, kern) in enumerate(zip(self.widths, self.kernels, strict=True)):
            gi = ga[:, i * self.filters : (i + 1) * self.filters]
            gk = np.zeros_like(kern)
            for j in range(k):
                at = where[i] + j
                ok = (at < n) & (gi != 0) & (live[where[i]] > 0)
                at = np.where(ok, at, 0)
                gj = np.where(ok, gi, 0)
                x = e[at]  # texts, filters, embed
                gk[j] = np.einsum("tfe,tf->ef", x, gj)
                d = (gj[:, :, None] * kern[j].T[None]).reshape(-1, dim)
                keep = ok.ravel() & (live[at.ravel()] > 0)
                rows.append(at.ravel()[keep])
                grads.append(d[keep])
            self._step(3 + i, kern, gk, rate)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        ids = np.concatenate([f[rows] for f in feats])
        grads = np.concatenate([grads] * len(feats))
        u, inv = np.unique(ids, return_inverse=True)
        total = np.zeros((len(u), dim), np.float32)
        np.add.at(total, inv, grads)
        s = self._seen.setdefault(99, np.zeros_like(self.embedding))
        s[u] += total * total
        self.embedding[u] -= rate * total / (np.sqrt(s[u]) + 1e-6)

    def forget(self) -> None:
        """Drop what only training needs, before the model travels."""
        self._seen = {}

    def tables(self) -> np.ndarray:
        """For each item the responses of all places of all filters, side by side."""
        return np.concatenate([self.embedding @ kern[j] for kern in self.kernels for j in range(kern.shape[0])], 1)

    def pool(self, rows: np.ndarray, starts: np.ndarray, quiet: np.ndarray) -> np.ndarray:
        """Maxima over texts, before bias and rectifier; rows: sums of ``tables`` rows (0 for padding), flat.
        Filters that begin in the ``quiet`` rows (padding at least) count as 0."""
        out, c, f, n = [], 0, self.filters, len(rows)
        for k in self.widths:
            y = rows[:, c : c + f].copy()
            for j in range(1, k):
                y[: n - j] += rows[j:, c + j * f : c + (j + 1) * f]
            c += k * f
            y[quiet] = 0
            out.append(np.maximum.reduceat(y, starts, 0))
        return np.concatenate(out, 1)

    def activate(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)
