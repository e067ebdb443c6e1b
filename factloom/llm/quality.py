"""Quality rules: fixed rules on word statistics, then gradient-boosted trees over the same statistics.

The trees are trained on the driver from a bounded sample of labelled documents, under monotone
constraints, and flattened into numpy node arrays; executors score all rows of a slice by
stepping every row through every tree at once.

Columns other than those named are not looked at, whatever their names.
Null and empty texts have no words and fail the fixed rules. Repeated rows each get their row.
Without labelled documents of both kinds the trees keep everything that the fixed rules keep.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, only, utf8_of

#: At most so many labelled documents train the trees.
TRAIN_ROWS = 3_000
#: Documents are kept if the probability of good quality is at least this: only clear junk goes.
KEEP_AT = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_CLASS = (_SPACE * 1 + _SYMBOL * 2 + _UPPER * 4 + _DIGIT * 8 + _MARK * 16).astype(np.uint8)
_CLASS[128:192] = 32  # inside a character

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_rate", "upper_rate", "digit_rate", "mark_rate", "dup_lines", "repeats", "distinct", "line_words")
#: +1: more can only raise the score, -1: more can only lower it.
MONOTONE = {"symbol_rate": -1, "dup_lines": -1, "repeats": -1, "upper_rate": -1}


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the five base figures, and the features of the trees."""
    base, features = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            data = np.frombuffer(text, np.uint8)
            base[row] = 0, 0, int(_SYMBOL[data].sum()), 0, 0
            continue
        kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=64)
        chars = int(len(text) - kinds[1] - kinds[32])
        symbols = int(kinds[2])
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        repeated = 0
        if n >= 4 and len(number) < n:
            if len(number) < 1 << 21:
                key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
            else:
                key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            if same.any():
                hit = np.zeros(n, bool)
                at = np.concatenate([order[1:][same], order[:-1][same]])
                hit[at] = hit[at + 1] = hit[at + 2] = True
                repeated = int(hit.sum())
        base[row] = n, chars, symbols, dup, repeated
        size = max(1, chars)
        features[row] = n, chars / n, symbols / size, kinds[4] / size, kinds[8] / size, kinds[16] / size, dup / max(1, len(lines)), repeated / n, len(number) / n, n / max(1, len(lines))
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Forest:
    """All trees in flat arrays; a leaf's feature is -1 and its value counts."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; each step moves every row one level down in every tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 10, penalty: float = 1.0, monotone: dict[str, int] = MONOTONE) -> Forest:
    """Second-order boosting of log loss over 32 quantile bins.

    A split on a constrained feature must order its children's values the right way, and their
    mean bounds the values below each, so that the constraint holds for the whole tree.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    sign = [monotone.get(f, 0) for f in FEATURES]
    nodes: list[list] = []
    roots = []
    rate_of = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(x), start)
    if len(y) == 0 or y.min() == y.max():
        trees = 0

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + penalty), low, high))
        nodes.append([-1, 0.0, me, me, value * rate])
        best = None
        for j in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            k = len(edges[j]) + 1
            sum_g, sum_h, count = (np.bincount(bins[rows, j], w, k) for w in (g[rows], h[rows], None))
            gl, hl, nl = np.cumsum(sum_g)[:-1], np.cumsum(sum_h)[:-1], np.cumsum(count)[:-1]
            gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total_g**2 / (total_h + penalty)
            gain[(nl < least) | (nr < least) | (sign[j] * (vr - vl) < 0)] = -1
            if len(gain) and (best is None or gain.max() > best[0]):
                i = int(gain.argmax())
                best = (gain[i], j, i, vl[i], vr[i])
        if best and best[0] > 1e-6:
            _, j, i, vl, vr = best
            middle = (vl + vr) / 2
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[sign[j]]
            here = bins[rows, j] <= i
            a = grow(rows[here], level + 1, bounds[0], bounds[1], g, h)
            b = grow(rows[~here], level + 1, bounds[2], bounds[3], g, h)
            nodes[me] = [j, float(edges[j][i]), a, b, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
        margin += Forest(f, t, a, b, v, np.array(roots[-1:]), depth, 0.0)._margin(x)
    f, t, a, b, v = (np.array(c) for c in zip(*(nodes or [[-1, 0.0, 0, 0, 0.0]]), strict=True))
    return Forest(f, t, a, b, v, np.array(roots, np.int64), depth, start if trees else 20.0)


def _margin(self: Forest, x: np.ndarray) -> np.ndarray:
    p = self.score(x)
    return np.log(p) - np.log1p(-p)


Forest._margin = _margin


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `rows` labelled documents, chosen by a hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_q"))
    n = known.count()
    parts = 1 << 20
    share = parts if n <= rows else max(1, int(parts * rows * 0.9 / n))
    few = known.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) < share).groupBy("_id").agg(F.min("_q").alias("_q"))
    labels_of = {r["_id"]: r["_q"] for r in few.orderBy(F.xxhash64("_id")).limit(rows).collect()}
    chosen = docs.sparkSession.createDataFrame([(i,) for i in labels_of], "doc_id long")  # at most `rows` numbers
    sampled = only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def work(batch: pa.RecordBatch) -> list:
        return [statistics(utf8_of(batch))[1].tolist()]

    found = map_texts(sampled, "doc_id long, features array<double>", ["features"], work).orderBy("doc_id", "features").limit(rows).collect()
    return np.array([r["features"] for r in found]).reshape(len(found), len(FEATURES)), np.array([labels_of[r["doc_id"]] for r in found], float)


def quality_verdicts(df: DataFrame, forest: Forest, *, keep_at: float = KEEP_AT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: its statistics, whether fixed rules reject it, the trees' probability, and the verdict."""

    def work(batch: pa.RecordBatch) -> list:
        base, x = statistics(utf8_of(batch))
        failed, p = base_failed(base), forest.score(x)
        return [*base.T, failed, p, ~failed & (p >= keep_at)]

    return map_texts(df, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean", [*BASE, "base_failed", "score", "kept"], work, doc_id=doc_id, text=text)


def auc(score: np.ndarray, good: np.ndarray) -> float:
    """How often a good document scores higher than a bad one; ties count half."""
    order = np.argsort(score, kind="stable")
    values, inverse, times = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = (np.cumsum(times) - (times - 1) / 2)[inverse]
    n = int(good.sum())
    return float((rank[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n)))
