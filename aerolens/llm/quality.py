"""Operator 3: a quality classifier, a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks of ``WIDTH`` bytes, one every
``STRIDE``, which cover the whole text (its end is padded). ``FILTERS`` learned
filters score every chunk; each filter's greatest score over the text (max
pooling) passes a rectifier, and a learned weighting of them gives one
probability. A byte whose following bytes also stand at most ``LAGS`` bytes
back is a symbol of its own, so that the filters can see repetition.

A filter over one-hot bytes is a table look-up, so scoring is a few gathers per
chunk. Training descends the log loss by Adam on a sample of labelled texts,
bounded by ``MAX_TRAIN_DOCS`` documents of at most ``MAX_TRAIN_CHARS`` characters,
on the driver; longer texts are not trained on, but are scored whole like all.

Defined results: a null or empty text is one chunk of padding and gets that
chunk's score; without labelled rows, or with one label only, every score is
that label's share (0.5 without any). Equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import labelled_sample, map_texts

WIDTH, STRIDE, FILTERS = 8, 4, 24
LAGS = 24
SYMBOLS = 512
MAX_TRAIN_DOCS = 3000
MAX_TRAIN_CHARS = 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 100, 0.01, 1e-4
SEED = 7
#: Symbols scored at once.
BLOCK = 1 << 19


@dataclass
class Network:
    #: (WIDTH, SYMBOLS, FILTERS) scores of the symbols at each place of a chunk
    tables: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    def combine(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.maximum(pooled, 0) @ self.weight + self.offset)))


def symbols(raw: bytes) -> np.ndarray:
    """A text's bytes, plus 256 where the eight bytes from here on also stand 1 to ``LAGS`` bytes
    back; padded with zeros so that the chunks cover the text."""
    n = len(raw)
    padded = max(WIDTH, WIDTH + -(-max(0, n - WIDTH) // STRIDE) * STRIDE)
    b = np.zeros(padded + 8, np.uint8)
    b[:n] = np.frombuffer(raw, np.uint8)
    out = b[:padded].astype(np.int32)
    if n > 8:
        gram = np.zeros(n - 7, np.uint64)
        for j in range(8):
            gram |= b[j:n - 7 + j].astype(np.uint64) << np.uint64(8 * j)
        again = np.zeros(len(gram), bool)
        for lag in range(1, min(LAGS, len(gram) - 1) + 1):
            again[lag:] |= gram[lag:] == gram[:-lag]
        out[:len(gram)] += again.astype(np.int32) << 8
    return out


def pool(net: Network, texts: list[np.ndarray], where: bool = False):
    """Greatest score of each filter in each text; with ``where``, also the symbols of that chunk."""
    pooled = np.empty((len(texts), FILTERS), np.float32)
    chosen = np.empty((len(texts), FILTERS, WIDTH), np.int32) if where else None
    for i, s in enumerate(texts):
        best = None
        for start in range(0, len(s) - WIDTH + 1, BLOCK):
            part = s[start:start + BLOCK + WIDTH - STRIDE]
            at = np.arange(0, len(part) - WIDTH + 1, STRIDE)
            score = net.tables[0][part[at]]
            for j in range(1, WIDTH):
                score += net.tables[j][part[at + j]]
            top = score.argmax(0)
            value = score[top, np.arange(FILTERS)]
            if where:
                rows = part[at[top][:, None] + np.arange(WIDTH)]
                chosen[i] = rows if best is None else np.where((value > best)[:, None], rows, chosen[i])
            best = value if best is None else np.maximum(best, value)
        pooled[i] = best + net.bias
    return (pooled, chosen) if where else pooled


def fit(texts: list[np.ndarray], labels: np.ndarray) -> Network:
    """Adam on the log loss. Only the chunk that wins a filter's pooling has a gradient."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.05, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or share in (0, 1):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(net.tables, net.bias, np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))))
    net.offset = float(np.log(share / (1 - share)))
    params = [net.tables, net.bias, net.weight, np.array([net.offset], np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    place, filt = np.arange(WIDTH)[None, None, :], np.arange(FILTERS)[None, :, None]
    step = 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            net.offset = float(params[3][0])
            pooled, chosen = pool(net, [texts[i] for i in rows], where=True)
            error = (net.combine(pooled) - labels[rows]) / len(rows)
            back = error[:, None] * net.weight[None, :] * (pooled > 0)
            g = np.zeros_like(net.tables)
            np.add.at(g, (np.broadcast_to(place, chosen.shape), chosen, np.broadcast_to(filt, chosen.shape)),
                      np.broadcast_to(back[:, :, None], chosen.shape).astype(np.float32))
            grads = [g, back.sum(0), np.maximum(pooled, 0).T @ error, np.array([error.sum()])]
            step += 1
            rate = RATE * (1 - step / (EPOCHS * max(1, len(texts) // BATCH) + 1))
            for p, m, v, d in zip(params, mean, square, grads):
                d = d + DECAY * p
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    net.offset = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int = MAX_TRAIN_DOCS) -> Network:
    """Fit on at most ``max_docs`` labelled rows (0 or 1) whose text has at most ``MAX_TRAIN_CHARS`` characters."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_docs, MAX_TRAIN_CHARS)
    return fit([symbols(t.encode()) for t, _ in sample], np.array([y for _, y in sample], float))


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with each whole text's probability of label 1."""
    def factory():
        def fn(texts):
            return [net.combine(pool(net, [symbols(t.encode()) for t in texts])).astype(float).tolist()]
        return fn
    return map_texts(docs, text_col, f"`{out}` double", factory)
