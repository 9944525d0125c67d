"""Quality scores by histogram gradient-boosted trees over document statistics.

A document becomes ``STATS``: sizes, rates of byte classes, repetition of words
and lines, casing, punctuation. Values are binned by quantiles; each tree grows
level by level, the best split of a node taken from histograms of gradients
(``bincount``), on the logistic loss. The trees are flattened into arrays of
feature, threshold, children and value, and all rows walk all trees at once in
numpy.

Texts are read once, whole, where they lie: the statistics (some 150 bytes a
document) are stored, and both the fit and the scores read those. The fit sees
at most ``max_rows`` rows with labels, those whose ids have the smallest
hashes, so its cost does not grow; labels, language, source and id are never
among the inputs. Rows with crc32(id) mod 3 = 1 are held out: their labels are
never read.

Defined cases: null text is empty, and empty text has statistics like any
other; a label that is not 0 or 1, or has no id, takes no part, and of several
for an id the smallest counts; a null id counts as '' for being held out;
without two kinds of labels every score is the share of label 1 (0.5 without
any); rows may repeat, and each is scored; extra columns stay, but for those
with the names of the results."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored

FOLDS, HELD = 3, 1
RESULTS = ["held_out", "score", "predicted", "_stats"]
STATS = ["chars", "words", "word_mean", "word_spread", "word_longest", "upper", "digit", "space", "high", "mark", "plain_mark", "symbol", "bar",
         "distinct", "top_word", "again", "caps", "bare", "ends_marked", "doubled", "lines", "line_mean", "line_longest", "line_distinct",
         "line_top", "blank_lines", "entropy"]

_BYTE = np.arange(256)
_UPPER, _LOWER = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT, _SPACE, _HIGH = (_BYTE >= 48) & (_BYTE <= 57), (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)), _BYTE >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_PLAIN = np.isin(_BYTE, list(b".,;:?'\"()-"))
_SYMBOL = np.isin(_BYTE, list(b"#$%&*!~^<>=_{}[]\\/@+"))
PIECE = 1 << 22  # bytes counted at a time


def statistics(text: str | None) -> list[float]:
    """The values of ``STATS``; shares are of bytes, words or lines."""
    data = (text or "").encode()
    of = np.zeros(256, np.int64)
    for at in range(0, len(data), PIECE):
        of += np.bincount(np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at), minlength=256)
    n = max(1, len(data))
    words, lines = data.split(), data.split(b"\n")
    w, seen = max(1, len(words)), Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    rows, spans = Counter(lines), np.fromiter(map(len, lines), np.int64, len(lines))
    p = of[of > 0] / n
    return [
        float(len(data)), float(len(words)), float(sizes.mean()), float(sizes.std()), float(sizes.max()),
        of[_UPPER].sum() / max(1, of[_UPPER | _LOWER].sum()), of[_DIGIT].sum() / n, of[_SPACE].sum() / n, of[_HIGH].sum() / n,
        of[_MARK].sum() / n, of[_PLAIN].sum() / n, of[_SYMBOL].sum() / n, of[124] / n,
        len(seen) / w, max(seen.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, sum(map(bytes.isupper, words)) / w,
        sum(not x.strip(b"!#$%&*|.,;:-_=+/<>()[]{}'\"?~^@\\") for x in seen) / w, sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w,
        sum(x[-1] == x[-2] and x[-1] in b"!#$%&*=-_.~" for x in words if len(x) > 1) / w,
        float(len(lines)), float(spans.mean()), float(spans.max()), len(rows) / len(lines), max(rows.values()) / len(lines),
        rows[b""] / len(lines), float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf is its own child. ``roots`` are where
    each tree starts."""

    base: float = 0.0
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``: every row goes down every tree."""
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def predict(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        parts = [1 / (1 + np.exp(-np.clip(self.raw(x[i : i + rows]), -50, 50))) for i in range(0, len(x), rows)]
        return np.concatenate(parts) if parts else np.zeros(0)


def binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers of ``x`` and, by feature, the largest value of each bin but
    the last."""
    cuts = [np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) for column in x.T]
    return np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1), cuts


def grow(bin_of: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, bins: int, l2: float, least: float):
    """One tree, level by level: nodes (feature, threshold, left, right,
    value), and the leaf of each row."""
    nodes = [[0, 0.0, 0, 0, -g.sum() / (h.sum() + l2)]]
    at, level = np.zeros(len(g), np.int64), [0]
    for _ in range(depth):
        place = np.full(len(nodes), -1)
        place[level] = np.arange(len(level))
        mine = np.flatnonzero(place[at] >= 0)
        slot = place[at[mine]]
        best = np.full(len(level), 1e-9)
        split = [None] * len(level)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            cell = slot * bins + bin_of[mine, f]
            hist = [np.bincount(cell, v[mine], len(level) * bins).reshape(len(level), bins).cumsum(axis=1) for v in (g, h)]
            (gl, hl), (gt, ht) = ([v[:, : len(cut)] for v in hist], [v[:, -1:] for v in hist])
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            top = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                best[i], split[i] = gain[i, top[i]], (f, int(top[i]))
        following = []
        for node, to in zip(level, split):
            if to is None:
                continue
            f, b = to
            inside = np.flatnonzero(at == node)
            low = bin_of[inside, f] <= b
            children = []
            for some in (inside[low], inside[~low]):
                children.append(len(nodes))
                at[some] = len(nodes)
                nodes.append([0, 0.0, len(nodes), len(nodes), -g[some].sum() / (h[some].sum() + l2)])
            nodes[node] = [f, float(cuts[f][b]), *children, 0.0]
            following += children
        level = following
        if not level:
            break
    return nodes, at


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for labels ``y`` (0 / 1). ``least``: the smallest sum of
    second derivatives on either side of a split."""
    if not len(y):
        return Trees()
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(base)
    bin_of, cuts = binned(x, bins)
    raw, nodes, roots = np.full(len(y), base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree, leaf = grow(bin_of, cuts, p - y, p * (1 - p), depth, bins, l2, least)
        start = len(nodes)
        roots.append(start)
        for f, t, left, right, v in tree:
            nodes.append((f, t, left + start, right + start, rate * v))
        raw += rate * np.array([v[4] for v in tree])[leaf]
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(base, depth, np.array(roots), feature, threshold, left, right, value)


def held_out(id_col: str, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``_stats``."""
    ship(__name__)

    @F.pandas_udf("array<double>")
    def stats(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.withColumn("_stats", stats(F.col(text))).drop(text)


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_rows: int = 20_000) -> Trees:
    """Fit on rows of ``measured`` documents that have a label and are not
    held out: at most ``max_rows`` ids, and at most ``max_rows`` rows of them."""
    marks = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y in (0, 1)")
             .filter(~held_out("_id")).groupBy("_id").agg(F.min("y").alias("y")))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    known = rows.select(F.col(id_col).alias("_id"), F.col("_stats").alias("x")).join(F.broadcast(marks), "_id")
    some = known.select("x", "y").orderBy(F.xxhash64("_id"), F.xxhash64("x"), "x").limit(max_rows).toArrow()
    x = np.array(some["x"].to_pylist(), float).reshape(len(some), len(STATS))
    return fit(x, some["y"].to_numpy().astype(float))


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """``rows`` of ``measured`` documents with ``score``, without ``_stats``."""
    ship(__name__)

    @F.pandas_udf("double")
    def walk(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for stats in frames:
            yield pd.Series(model.predict(np.array(stats.tolist(), float).reshape(len(stats), len(STATS))))

    return rows.withColumn("score", walk("_stats")).drop("_stats")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """``docs`` without ``text``, with ``held_out``, ``score`` and ``predicted``."""
    rows = stored(measured(docs.drop(*(c for c in RESULTS if c not in (id_col, text))), text), "statistics")
    scored = score(rows, train(rows, labels, id_col, label, max_rows))
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")})
