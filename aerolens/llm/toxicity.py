"""Operator 6: toxicity by gradient-boosted trees over dense features.

The features of a text are rates, not words: densities of a learned lexicon,
second-person words near lexicon words, capitals, punctuation, and signs of
obfuscation (digits or symbols inside words, drawn-out letters). The lexicon
holds whole words and word beginnings of 3 to 8 letters that labelled toxic
texts favour. Trees are boosted on the log loss over binned features, and their
scores are calibrated by isotonic regression.

Training texts are split into folds: each text's lexicon features come from a
lexicon learned on the other folds, and the calibration from trees that have
not seen the text. All fits run on a sample bounded by ``MAX_TRAIN_DOCS``
documents of at most ``MAX_TRAIN_CHARS`` characters, on the driver; scoring
reads every text whole.

Defined results: a null or empty text has all features 0 and gets that score;
without labelled rows, or with one label only, every score is that label's
share (0.5 without any). Equal texts have equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import labelled_sample, map_texts

MAX_TRAIN_DOCS = 6000
MAX_TRAIN_CHARS = 20_000
FOLDS = 3
#: Lexicon entries, and the toxic texts and log-odds that one needs.
ENTRIES, LEAST_TEXTS, LEAST_ODDS = 3000, 4, 2.0
PREFIXES = range(3, 9)
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 3, 0.15, 64, 8, 1.0
NEAR = 5
MEMO = 400_000

#: Words that address someone, in the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te ti toi ton ta tes vous "
                          "votre vos usted ustedes tus tuyo vosotros".split())
#: Symbols that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

WORDS = re.compile(r"[^\W_]+(?:[@$*!'][^\W_]+)*")
MIXED = re.compile(r"(?<=[^\W\d_])[\d@$*!]+(?=[^\W\d_])")
DRAWN = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("strong", "any", "mean", "top", "top3", "near", "second", "capitals", "shouted", "exclaims", "marks", "mixed", "drawn", "length")


def stems(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if k <= len(word)] + [word + "$"]


def clean(word: str) -> str:
    w = word.lower()
    return w if w.isalpha() else "".join(c for c in w.translate(LOOKALIKES) if c.isalpha())


def learn_lexicon(bags: list[frozenset], labels: np.ndarray) -> dict[str, float]:
    """Log-odds of the word beginnings and words that toxic texts favour most."""
    seen = {0: Counter(), 1: Counter()}
    for bag, y in zip(bags, labels):
        seen[int(y)].update(bag)
    n1, n0 = float(labels.sum()), float(len(labels) - labels.sum())
    odds = {}
    for s, n in seen[1].items():
        if n >= LEAST_TEXTS:
            o = np.log((n + 0.5) / (n1 + 1)) - np.log((seen[0][s] + 0.5) / (n0 + 1))
            if o >= LEAST_ODDS:
                odds[s] = float(o * n / (n + 2.0))
    return dict(sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])


class Featurizer(dict):
    """text -> features. Per distinct word met: (lexicon weight, addresses someone, capitals,
    shouted, mixed with digits or symbols, drawn out)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows, self.fresh = lexicon, np.zeros((1 << 12, 6)), []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        get, upper = self.lexicon.get, sum(map(str.isupper, word))
        self.fresh.append((max([get(s, 0.0) for s in stems(clean(word))]), word.lower() in SECOND_PERSON, upper,
                           upper > 1 and word.isupper(), MIXED.search(word) is not None, DRAWN.search(word) is not None))
        return i

    def __call__(self, text: str) -> list[float]:
        words = WORDS.findall(text)
        n, chars = len(words), len(text)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self) > MEMO:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if self.fresh:
            while len(self.rows) < len(self):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(self) - len(self.fresh):len(self)] = self.fresh
            self.fresh = []
        table = self.rows[at]
        weights, sums = table[:, 0], table.sum(0)
        hits, you = np.flatnonzero(weights > 0), np.flatnonzero(table[:, 1])
        best = np.sort(weights[hits])[::-1] if len(hits) else np.zeros(1)
        near = 0
        if len(you) and len(hits):
            i = np.searchsorted(hits, you)
            gap = np.minimum(np.abs(hits[np.minimum(i, len(hits) - 1)] - you), np.abs(hits[np.maximum(i - 1, 0)] - you))
            near = int((gap <= NEAR).sum())
        return [float((weights >= 3.0).sum()) / n, len(hits) / n, float(sums[0]) / n, float(best[0]), float(best[:3].sum()),
                near / n, len(you) / n, float(sums[2]) / chars, float(sums[3]) / n,
                text.count("!") / chars, sum(map(text.count, "?*#$%&@")) / chars,
                float(sums[4]) / n, float(sums[5]) / n, float(np.log1p(n))]


@dataclass
class Trees:
    start: float = 0.0
    #: Per tree: split feature and threshold of each inner node (heap order), value of each leaf.
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of trees of fixed depth on quantile bins."""
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    model, edges = Trees(float(np.log(share / (1 - share)))), []
    bins = np.zeros(x.shape, int)
    for j in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(e)
        bins[:, j] = np.searchsorted(e, x[:, j], side="left")
    margin = np.full(len(y), model.start)
    inner = 2 ** DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), int)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, None, None)
            if len(rows) >= 2 * LEAST_LEAF:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    b = bins[rows, j]
                    size = len(e) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl ** 2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs ** 2 / (hs + RIDGE)
                    gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[1] is not None:
                feature[at], cut[at] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * at + 1 + (x[rows, best[1]] > cut[at])
            else:
                node[rows] = 2 * at + 1
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        model.features.append(feature), model.cuts.append(cut), model.leaves.append(value)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, probabilities), increasing, to be interpolated."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # [sum of y, count, sum of margins]
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    margins: np.ndarray
    chances: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.chances[0])
        return np.interp(self.trees.margin(x), self.margins, self.chances)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or len(labels) < 2 * FOLDS:
        return Model({}, None, np.zeros(1), np.array([share]))
    # Only stems that enough toxic texts have can enter a lexicon: the others are dropped text by text.
    bag = lambda t: {s for w in set(map(clean, WORDS.findall(t))) for s in stems(w)}
    often = Counter(s for t, y in zip(texts, labels) if y for s in bag(t))
    often = {s for s, n in often.items() if n >= LEAST_TEXTS}
    bags = [frozenset(bag(t) & often) for t in texts]
    fold = np.random.default_rng(11).permutation(len(texts)) % FOLDS
    x = np.zeros((len(texts), len(FEATURES)))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        f = Featurizer(learn_lexicon([bags[i] for i in rest], labels[rest]))
        for i in np.flatnonzero(fold == k):
            x[i] = f(texts[i])
    unseen = np.zeros(len(texts))
    for k in range(FOLDS):
        unseen[fold == k] = boost(x[fold != k], labels[fold != k]).margin(x[fold == k])
    return Model(learn_lexicon(bags, labels), boost(x, labels), *isotonic(unseen, labels))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled rows (0 or 1) whose text has at most ``MAX_TRAIN_CHARS`` characters."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_docs, MAX_TRAIN_CHARS)
    return fit([t for t, _ in sample], np.array([y for _, y in sample], float))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity_score") -> DataFrame:
    """``docs`` with each whole text's probability of being toxic."""
    def factory():
        features = Featurizer(model.lexicon)

        def fn(texts):
            return [model.probability(np.array([features(t) for t in texts])).tolist()]
        return fn
    return map_texts(docs, text_col, f"`{out}` double", factory)
