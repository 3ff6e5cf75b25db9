"""Quality scores by a generalised additive model with pairwise interactions.

Features of the text are cut into bins at quantiles of the training rows. Boosting goes round the features in a fixed
cycle; each step fits a tree of at most three leaves to the current gradient over one feature's bins and adds it to
that feature's lookup table. Then the pairs of features whose best four-quadrant split gains most are boosted in the
same way over coarse two-dimensional tables. A score is the sigmoid of a sum of table entries, looked up for whole
batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, pieces, utf8

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.15, 5.0
THRESHOLD = 0.7

FEATURES = (
    "log_words", "mean_word", "sd_word", "short_words", "distinct_words", "distinct_pairs", "repeats_before", "words_a_line", "repeated_lines",
    "upper", "digits", "bangs", "bars", "symbols", "stops", "other_bytes",
)
_UPPER, _DIGITS, _SYMBOLS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b".,;:?"
_HIGH = bytes(range(128, 256))


def features(text: str | bytes | None) -> list[float]:
    """The features of one whole text; all zero for a text without words.

    Words are held as 64-bit hashes, so a text of any length takes some 20 bytes a word.
    """
    data = utf8(text)
    sizes, hashes = [], []
    for piece in pieces(data):
        words = piece.split()
        sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
    size, word = np.concatenate(sizes), np.concatenate(hashes)
    n = len(word)
    if not n:
        return [0.0] * len(FEATURES)
    total = float(size.sum())
    n_lines, lines = 0, set()
    for line in _lines(data):
        if line.strip():
            n_lines += 1
            lines.add(line if len(line) < 64 else xxhash.xxh3_128_digest(line))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / total
    pairs = word[:-1] * np.int64(0x5851F42D4C957F2D) + word[1:]
    distinct = lambda x: len(np.unique(x))
    return [
        float(np.log1p(n)), total / n, float(size.astype(np.float64).std()), float((size <= 3).mean()), distinct(word) / n, distinct(pairs) / max(1, n - 1),
        int((word[:-1] == word[1:]).sum()) / n, n / n_lines, 1 - len(lines) / n_lines,
        share(_UPPER), share(_DIGITS), data.count(b"!") / n, data.count(b"|") / n, share(_SYMBOLS), share(_STOPS), share(_HIGH),
    ]


def _lines(data: bytes) -> Iterator[bytes]:
    at = 0
    while at <= len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


@dataclass
class Gam:
    """Cut points, lookup tables and pair tables."""

    base: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray = field(default_factory=lambda: np.zeros((0, PAIR_BINS, PAIR_BINS)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, cuts in enumerate(self.cuts):
            z += self.tables[f][np.searchsorted(cuts, x[:, f], side="right")]
        low = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.coarse)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[low[a], low[b]]
        return 1 / (1 + np.exp(-z))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of one feature: two splits at most, each the best there is."""
    edges = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                at = int(np.argmax(gains))
                if gains[at] > best[0]:
                    best = (float(gains[at]), a + at + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a table into four quadrants: its gain and the leaf values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c):
        a = c[:-1, :-1]
        top, left, total = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, top - a, left - a, total - top - left + a

    gains = sum(_gain(x, y) for x, y in zip(corners(cg), corners(ch), strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of ``y`` (0 or 1); with one class or no rows its score is the smoothed share of ones."""
    n, n_features = len(y), len(FEATURES)
    rate = (y.sum() + 1) / (n + 2)
    model = Gam(float(np.log(rate / (1 - rate))), [np.zeros(0)] * n_features, np.zeros((n_features, BINS)))
    if n == 0 or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, f], BINS) for f in range(n_features)]
    binned = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    z = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(binned):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, BINS), np.bincount(b, h, BINS))
            model.tables[f] += step
            z += step[b]
    model.coarse = [_cuts(x[:, f], PAIR_BINS) for f in range(n_features)]
    low = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.coarse)]
    cells = {(a, b): low[a] * PAIR_BINS + low[b] for a, b in combinations(range(n_features), 2)}

    def grids(pair, g, h):
        return (np.bincount(cells[pair], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))

    g, h = slopes()
    model.pairs = sorted(cells, key=lambda pair: (-_quadrants(*grids(pair, g, h))[0], pair))[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(model.pairs):
            step = RATE * _quadrants(*grids(pair, *slopes()))[1]
            model.pair_tables[k] += step
            z += step.ravel()[cells[pair]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that no label is learned from; a null id isn't in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Gam:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. Several labels of an id count as the least, several texts as the first in order."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("label_id"), "quality").toPandas()
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen.astype({"label_id": "int64", "quality": "int32"}), "label_id long, quality int"))
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(wanted, "label_id").groupBy("label_id", "quality").agg(F.min("text").cast("binary").alias("text"))
    got = arrow_map(texts, "label_id long, quality int, x array<double>", lambda r: {"label_id": r["label_id"], "quality": r["quality"], "x": [features(t) for t in r["text"]]}).toPandas()
    got = got.sort_values("label_id")  # the sums come out alike in every run
    return fit(np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)), (got["quality"] == 1).to_numpy(np.float64))


def scored(model: Gam, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))))

    return score(text.cast("binary"))  # a text may be broken UTF-8


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every whole text.

    Returns ``doc_id, held_out, score, predicted``, one row for each input row. Null and blank texts score as a text
    with all features zero. Null ids stay null. Only the text feeds the score. Without labels every text scores one half.
    """
    model = train(docs, labels)
    rows = bounded_batches(docs).select("doc_id", held_out().alias("held_out"), scored(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with their columns.

    The model is fitted on the labelled rows of ``learn_from`` (else of ``docs``): where an earlier filter has already
    taken the bad ones out of ``docs``, these would have one class only, and every text would get the same score. A null or blank
    text is scored like any other; repeated rows stay or go together; an empty table gives an empty result. Without
    labels every text scores one half and nothing is kept.
    """
    return bounded_batches(docs).where(scored(train(docs if learn_from is None else learn_from, labels), F.col("text")) >= THRESHOLD)
