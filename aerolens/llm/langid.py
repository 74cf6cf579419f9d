"""Operator 2: language identification of texts that may mix languages.

A text is cut into words of letters. The script range of a word's first letter
narrows the languages that may score it; those score it by smoothed counts of
its letter trigrams and of the word itself. Viterbi over the words, with a
penalty for each switch of language, then labels spans. A text's language is
the one with most letters in its spans, its score that language's share.

The counts are learned by Spark from labelled texts: a sample bounded by
``MAX_TRAIN_DOCS`` documents of at most ``MAX_TRAIN_CHARS`` characters (the
texts that are labelled are read whole, whatever their length). The model is a
table of languages x ``BUCKETS`` numbers.

Defined results: a text that is null or has no letter is ``und`` with score 0
and has no spans; so is every text if there is nothing to learn from. Equal
path scores keep the language that comes first by name. Repeated rows are
labelled one by one.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, map_texts

UNKNOWN = "und"
MAX_TRAIN_DOCS = 4000
MAX_TRAIN_CHARS = 200_000
BUCKETS = 1 << 16
SWITCH_PENALTY = 5.0
#: The lowest log-probability that a word gives a language, and one that its script excludes.
FLOOR, EXCLUDED = -8.0, -16.0
#: A language uses a script that this share of its words is written in.
SCRIPT_SHARE = 0.005
MEMO = 400_000
#: Fewer texts than this still running are decoded one by one.
FEW = 12

#: Where the letters of scripts lie (first code point, script).
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
           (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"),
           (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
           (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han")]
_STARTS = [a for a, _ in SCRIPTS]
_NAMES = sorted({s for _, s in SCRIPTS})


def script(letter: str) -> int:
    """Index into the script names of the range that holds a letter."""
    return _NAMES.index(SCRIPTS[max(0, bisect.bisect_right(_STARTS, ord(letter)) - 1)][1])


def grams(word: str) -> list[int]:
    """Buckets of a word's letter trigrams (its ends marked) and of the whole word."""
    w = f"^{word}$"
    return [zlib.crc32(w[i:i + 3].encode()) & BUCKETS - 1 for i in range(len(w) - 2)] + [zlib.crc32(f"={word}".encode()) & BUCKETS - 1]


def word_pattern():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: languages x BUCKETS log-probabilities
    table: np.ndarray
    #: scripts x languages: may the language be written in the script?
    allowed: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learn from the rows of ``docs`` that have a text and a language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")) \
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS))
    sample = bounded_sample(rows, F.col("id"), max_docs).select("lang", "text")

    def factory():
        from collections import Counter
        find = word_pattern().findall

        def fn(texts):
            out = []
            for t in texts:
                seen = Counter()
                for w, n in Counter(find(t.lower())).items():
                    for g in grams(w):
                        seen[g] += n
                    seen[BUCKETS + script(w[0])] += n
                out.append([{"key": k, "n": n} for k, n in seen.items()])
            return [out]
        return fn

    counts = (map_texts(sample, "text", "counts array<struct<key:int,n:bigint>>", factory)
              .select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.key").agg(F.sum("c.n").alias("n")).collect())
    languages = sorted({r.lang for r in counts})
    at = {lang: i for i, lang in enumerate(languages)}
    seen = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    for r in counts:
        seen[at[r.lang], r.key] = r.n
    gram, scripts = seen[:, :BUCKETS] + 0.2, seen[:, BUCKETS:]
    table = np.log(gram / gram.sum(1, keepdims=True)).astype(np.float32) if languages else gram.astype(np.float32)
    allowed = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1)).T >= SCRIPT_SHARE
    allowed[~allowed.any(1)] = True
    return Model(languages, table, allowed)


class Scorer(dict):
    """word -> row of scores; rows are filled as words are met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.fresh = model, np.empty((0, len(model.languages)), np.float32), []
        self.by_gram = np.ascontiguousarray(model.table.T)

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words (rows) by language: clipped log-probabilities, of the languages that share the word's script."""
        each = [grams(w) for w in words]
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((g for gs in each for g in gs), np.int64, int(size.sum()))
        log = np.add.reduceat(self.by_gram[flat], np.cumsum(size) - size).astype(np.float64)
        may = self.model.allowed[[script(w[0]) for w in words]]
        log[~may] = -np.inf
        log -= log.max(1, keepdims=True)
        log -= np.log(np.exp(log).sum(1, keepdims=True))
        return np.where(may, np.maximum(log, FLOOR), EXCLUDED)

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
            self.rows = self.rows[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.rows = np.concatenate([self.rows, self.score(self.fresh).astype(np.float32)])
            self.fresh = []
        return self.rows[at]


def viterbi(scores: np.ndarray, ends: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best state of every word of texts laid end to end (``ends``: where each text stops).

    All texts advance together, longest first; when only a few are still running, they are
    finished one by one. Either way memory is a few bytes a word.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    first, long = starts[order], size[order]
    n, k = scores.shape
    kind = np.int8 if k < 1 << 7 else np.int16 if k < 1 << 15 else np.int32
    state = np.zeros(n, kind)
    best, jump = np.zeros(n, kind), np.zeros((n, k), bool)
    total = np.zeros((len(order), k))
    active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    step = int((active >= FEW).sum())
    for t in range(step):
        a = active[t]
        at, d = first[:a] + t, total[:a]
        if t:
            b = d.argmax(1)
            m = d[np.arange(a), b] - penalty
            best[at], jump[at] = b, m[:, None] > d
            d = np.maximum(d, m[:, None])
        total[:a] = d + scores[at]
    last = np.zeros(len(order), kind)
    for i in range(len(order)):  # the few long ones: their tails
        if long[i] <= step:
            break
        d = total[i].tolist()
        for t in range(first[i] + step, first[i] + long[i]):
            if t > first[i]:
                top = max(d)
                m = top - penalty
                best[t] = d.index(top)
                for j, x in enumerate(d):
                    if m > x:
                        jump[t, j], d[j] = True, m
            d = [x + s for x, s in zip(d, scores[t].tolist())]
        total[i] = d
        s = d.index(max(d))
        for t in range(first[i] + long[i] - 1, first[i] + step - 1, -1):
            state[t] = s
            if jump[t, s]:
                s = best[t]
        last[i] = s
    for t in range(step - 1, -1, -1):
        a = active[t]
        done = long[:a] == t + 1
        if done.any():
            last[:a][done] = total[:a][done].argmax(1)
        at = first[:a] + t
        state[at] = last[:a]
        turn = jump[at, last[:a]]
        last[:a] = np.where(turn, best[at], last[:a])
    return state


def label(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score",
          spans_col: str = "lang_spans") -> DataFrame:
    """``docs`` with each text's language, its share of the letters, and its spans (lang, start, end)."""
    def factory():
        scorer, pattern, names = Scorer(model), word_pattern(), model.languages

        def spans(text, states):
            edges = [0, *(np.flatnonzero(np.diff(states)) + 1).tolist()]
            if len(edges) == 1:
                inner = [(pattern.search(text).start(), len(text.rstrip()))]
            else:
                starts = [m.start() for m in pattern.finditer(text)]
                marks = [starts[e] for e in edges]
                inner = list(zip(marks, [*marks[1:], len(text.rstrip())]))
            return [{"lang": names[states[e]], "start": a, "end": b} for e, (a, b) in zip(edges, inner)]

        def fn(texts):
            # Lower case word by word: some letters change their length.
            words = [pattern.findall(t) for t in texts] if names else [[] for _ in texts]
            flat = [w.lower() for ws in words for w in ws]
            ends = np.cumsum([len(ws) for ws in words])
            state = viterbi(scorer.look_up(flat), ends) if flat else np.zeros(0, np.int8)
            letters = np.fromiter(map(len, flat), np.int64, len(flat))
            pred, share, parts, start = [], [], [], 0
            for text, end in zip(texts, ends):
                if end == start:
                    pred.append(UNKNOWN), share.append(0.0), parts.append([])
                    continue
                weight = np.bincount(state[start:end], letters[start:end], len(names))
                top = int(weight.argmax())
                pred.append(names[top]), share.append(float(weight[top] / weight.sum())), parts.append(spans(text, state[start:end]))
                start = end
            return [pred, share, parts]
        return fn

    fields = f"`{lang_col}` string, `{score_col}` double, `{spans_col}` array<struct<lang:string,start:int,end:int>>"
    return map_texts(docs, text_col, fields, factory)
