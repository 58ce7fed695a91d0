"""Averaged hashed embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A document is the mean of the embeddings of its features (hashed byte n-grams, and word n-grams where asked for). As the
output layer is linear, embeddings times output weights give one table of class scores per feature, and scoring a document is a
mean over that table. Features are hashed and summed with numpy over slices of many documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from graphloom.llm._common import give_back, mix, powers, prefix_hash, slices

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE = 1 << 19


@dataclass(frozen=True)
class Features:
    """Which features a text has. Each kind has 2**bits buckets; the last row of the table belongs to no feature.

    A word n-gram of one word repeated is one feature, whatever the word.
    """

    chars: tuple[int, ...] = (2, 3, 4)
    words: tuple[int, ...] = ()
    lower: bool = True
    bits: int = 15
    #: So many features without a sign either way are added to each text, so that few features count for less.
    prior: int = 0

    @property
    def size(self) -> int:
        return (len(self.chars) + len(self.words)) << self.bits

    def _bucket(self, h: np.ndarray, kind: int) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64) + (kind << self.bits)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind: the bucket of each feature, and the rows' offsets. N-grams that leave their row are the last row."""
        out = []
        if self.lower:
            data = _LOWER[data]
        n = len(data)
        wide = data.astype(_U)
        gram, at = wide, 1
        for kind, k in enumerate(self.chars):
            while at < k:
                gram = (gram[:-1] << _U(8)) | wide[at:] if len(gram) > 1 else gram[:0]
                at += 1
            bucket = np.full(n, self.size, np.int64)
            bucket[: len(gram)] = self._bucket(gram * _U(0x9E3779B97F4A7C15), kind)
            for i in range(1, k):
                cut = offsets[1:] - i
                bucket[cut[(cut >= 0) & (cut >= offsets[:-1])]] = self.size
            out.append((bucket, offsets))
        if self.words:
            mask = ~_SPACE[data]
            change = np.zeros(n + 1, bool)
            change[1:n] = mask[1:] != mask[:-1]
            change[offsets] = True
            at = np.flatnonzero(change)
            inside = mask[at[:-1]] if n else np.zeros(0, bool)
            starts, ends = at[:-1][inside], at[1:][inside]
            c = prefix_hash(data)
            h = mix((c[ends] - c[starts]) * powers(n + 1)[1][starts])
            first = np.searchsorted(starts, offsets)
            for j, k in enumerate(self.words):
                g = h.copy()
                for i in range(1, k):
                    g[:-i] = g[:-i] * _U(0xD6E8FEB86659FD93) + h[i:] if i < len(h) else g[:-i]
                same = np.ones(len(h), bool)
                for i in range(1, k):
                    same[:-i] &= h[i:] == h[: len(h) - i]
                if k > 1:
                    g[same] = _U(k)
                bucket = self._bucket(mix(g), len(self.chars) + j)
                for i in range(1, k):
                    cut = first[1:] - i
                    bucket[cut[(cut >= 0) & (cut >= first[:-1])]] = self.size
                out.append((bucket, first))
        return out


@dataclass
class Model:
    """Class scores per feature (with a zero row for no feature), bias, temperature and the rejection threshold."""

    features: Features
    classes: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty((len(offsets) - 1, len(self.classes)))
        for i, j in slices(offsets, SLICE):
            own = offsets[i : j + 1] - offsets[i]
            parts = self.features.of(data[offsets[i] : offsets[j]], own)
            count = np.zeros(j - i)
            for bucket, at in parts:
                real = np.concatenate([[0], np.cumsum(bucket != self.features.size)])
                count += real[at[1:]] - real[at[:-1]]
            for c in range(len(self.classes)):
                total = np.zeros(j - i)
                column = self.table[:, c]
                for bucket, at in parts:
                    s = np.concatenate([[0.0], np.cumsum(column[bucket], dtype=np.float64)])
                    total += s[at[1:]] - s[at[:-1]]
                out[i:j, c] = total / np.maximum(count + self.features.prior, 1)
        return (out + self.bias) / self.temperature

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offsets))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets, as steps from one to the next, and how often each occurs; in types as narrow as they allow, as a fit holds
    the bags of all its examples."""
    u, n = np.unique(buckets, return_counts=True)
    steps = np.diff(u, prepend=0)
    return steps.astype(np.min_scalar_type(steps.max(initial=0))), n.astype(np.min_scalar_type(n.max(initial=0)))


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def train(texts: list[str], labels: list[str], features: Features, *, dim: int = 12, epochs: int = 6, rate: float = 0.4, seed: int = 7, target: float = 0.99, documents: list | None = None) -> Model:
    """Fit on the examples of four fifths of the documents (by default each example is one); temperature and rejection threshold are
    set on those of the rest, none of which is fitted.

    The threshold is the least score from which on `target` of the predictions on that fifth are right. With no example at all
    there is one class, `und`.
    """
    classes = sorted(set(labels)) or ["und"]
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (features.size + 1, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    y = np.array([classes.index(x) for x in labels], np.int64)
    number = {d: k for k, d in enumerate(dict.fromkeys(documents or range(len(y))))}
    held = np.array([number[d] for d in documents or range(len(y))], np.int64) % 5 == 4
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        found = np.concatenate([x for x, _ in features.of(raw, np.array([0, len(raw)]))]) if len(raw) else np.zeros(0, np.int64)
        bags.append(bag(found[found < features.size]))
    fit = [i for i in np.flatnonzero(~held) if len(bags[i][0])]
    step, steps = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            apart, counts = bags[i]
            u = np.cumsum(apart, dtype=np.int64)
            n = (counts / max(1, counts.sum(dtype=np.int64) + features.prior)).astype(np.float32)
            rows = e[u]
            v = n @ rows
            p = softmax((v @ w + b)[None])[0]
            p[y[i]] -= 1
            lr = rate * (1 - step / steps)
            back = w @ p
            w -= lr * np.outer(v, p)
            b -= lr * p
            # The features of a bag share one gradient; its weights sum to 1, so it is scaled by their number.
            rows -= (lr * len(u) ** 0.5) * n[:, None] * back[None]
            e[u] = rows
            step += 1
    table = (e @ w).astype(np.float32)
    del bags, e
    table[-1] = 0
    model = Model(features, classes, table, b.astype(np.float64))
    if held.any():
        z = model.logits(*packed([t for t, h in zip(texts, held, strict=True) if h]))
        truth = y[held]
        grid = np.geomspace(0.1, 10, 41)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= target * np.arange(1, len(order) + 1))
        model.reject_below = float(score[order][good[-1]]) if len(good) else 1.0
    give_back()
    return model
