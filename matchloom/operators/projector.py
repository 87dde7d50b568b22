"""A residual projector learned from linked records.

``x + W2 gelu(W1 x)``, at unit length, trained with in-batch and hard negatives.
The output layer starts at zero, so an untrained projector changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_TRIPLETS = 150_000
LEAST_ADDRESS_PAIRS = 1000


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, by the tanh form."""
    return 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * _phi(x)


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    t = np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * x * x)


@dataclass
class Projector:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def identity(dim: int, hidden: int = 256, seed: int = 42) -> Projector:
        rng = np.random.default_rng(seed)
        bound = 1 / np.sqrt(dim)
        return Projector(rng.uniform(-bound, bound, (dim, hidden)), rng.uniform(-bound, bound, hidden), np.zeros((hidden, dim)), np.zeros(dim))

    def parameters(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        pre = x @ self.w1 + self.b1
        act = gelu(pre)
        raw = x + act @ self.w2 + self.b2
        norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        return raw / norm, (x, pre, act, raw / norm, norm)

    def backward(self, grad: np.ndarray, cache: tuple) -> list[np.ndarray]:
        x, pre, act, out, norm = cache
        raw = (grad - out * (grad * out).sum(axis=1, keepdims=True)) / norm
        hidden = raw @ self.w2.T * _gelu_slope(pre)
        return [x.T @ hidden, hidden.sum(axis=0), act.T @ raw, raw.sum(axis=0)]

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64))[0].astype(np.float32)

    def save(self, spark, path: str) -> None:
        rows = [(n, list(p.shape), p.ravel().tolist()) for n, p in zip(("w1", "b1", "w2", "b2"), self.parameters())]
        spark.createDataFrame(rows, "name string, shape array<int>, v array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Projector:
        rows = {r["name"]: np.array(r["v"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
        return Projector(*(rows[n] for n in ("w1", "b1", "w2", "b2")))


def train(anchors: np.ndarray, positives: np.ndarray, negatives: np.ndarray, temperature: float = 0.07, rate: float = 1e-3, decay: float = 1e-4, epochs: int = 4, batch: int = 2048, seed: int = 42) -> Projector:
    """InfoNCE over the batch's positives and each anchor's hard negative, with AdamW; an incomplete last batch is left out."""
    own = Projector.identity(anchors.shape[1], seed=seed)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in own.parameters()]
    second = [np.zeros_like(p) for p in own.parameters()]
    step, batch = 0, min(batch, len(anchors))
    for _ in range(epochs if batch else 0):
        order = rng.permutation(len(anchors))
        for at in range(0, len(order) - batch + 1, batch):
            rows = order[at : at + batch]
            (a, ca), (p, cp), (n, cn) = (own.forward(x[rows].astype(np.float64)) for x in (anchors, positives, negatives))
            logits = np.concatenate((a @ p.T, (a * n).sum(axis=1, keepdims=True)), axis=1) / temperature
            logits -= logits.max(axis=1, keepdims=True)
            share = np.exp(logits)
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(batch), np.arange(batch)] -= 1
            share /= batch * temperature
            inside, hard = share[:, :batch], share[:, batch:]
            grads = [sum(g) for g in zip(own.backward(inside @ p + hard * n, ca), own.backward(inside.T @ a, cp), own.backward(hard * a, cn))]
            step += 1
            for value, grad, m, v in zip(own.parameters(), grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value *= 1 - rate * decay
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return own
