"""Severity of toxic language by cumulative-link ordinal regression.

A document is a sparse set of features: its distinct lower-cased words and
their first four and five letters, so that inflected forms share a feature.
P(grade > k) = sigmoid(x.w - t_k): one weight vector, ordered thresholds
t_0 < t_1 < ...; the output is the expected severity, the sum of these
probabilities.

Labels hold toxic 0 / 1 only. Their grades come from the labels and the
features: 0 for a clean document; a toxic one is graded 1 to GRADES by the
summed log odds of its features that speak for toxicity, cut at the terciles
of the labelled toxic documents.

The fit sees at most ``max_rows`` labelled documents, half of them toxic (all,
if fewer; else those whose ids have the smallest hashes). Where ids repeat, or
texts are so long that these rows hold more than ``max_bytes``, a share of the
rows by their hashes stays, and none of over a sixteenth of ``max_bytes``. Every feature of
these documents takes part. What a feature's counts say, its ``evidence``, is
its log odds times the probability that it speaks for toxicity at all; how many
features do is estimated from the counts. The regression is on these and has
an l2 penalty, so the weaker a feature's evidence, the more its weight is
shrunk, and none is left out. Scoring sees every whole text of every document;
it uses presence only, so one toxic word in a long text counts.

Defined cases: null or blank text has no feature and the severity of an empty
document, which is clean; labels without a document, and null labels, take no
part; without a toxic and a clean label everything has severity 0 and stays;
rows may repeat, and each is scored; extra columns stay, but for those with
the names of the results."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored

GRADES = 3
NEAR = 9.0  # words of the second kind: Beta(NEAR, 1)
MAX_BYTES = 1 << 28  # of labelled text in the fit
REJECT = 0.25  # a document is rejected if P(any grade above 0) is this or more
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """Words as they are, and stems marked by a hyphen."""
    return found | {w[:n] + "-" for w in found for n in (4, 5) if len(w) > n}


@dataclass
class OrdinalModel:
    """Shared weights by feature and ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def score(self, text: str | None) -> float:
        get, total = self.weights.get, 0.0
        for w in words(text):
            total += get(w, 0.0)
            if len(w) > 4:
                total += get(w[:4] + "-", 0.0)
                if len(w) > 5:
                    total += get(w[:5] + "-", 0.0)
        return total

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold."""
        x = self.score(text)
        return [float(1 / (1 + np.exp(-np.clip(x - t, -50, 50)))) for t in self.thresholds]


def count_features(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents with it; summed up in each task first."""
    ship(__name__)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 200):
                seen = {0: Counter(), 1: Counter()}
                for text, toxic in zip(pdf["text"][start : start + 200], pdf["toxic"][start : start + 200]):
                    seen[int(toxic)].update(features(words(text)))
                both = [*(seen[0].keys() | seen[1].keys())]
                if both:
                    yield pd.DataFrame({"feature": both, "toxic": [seen[1][f] for f in both], "clean": [seen[0][f] for f in both]})

    return (labelled.select("text", "toxic").mapInPandas(count, "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


class Evidence:
    """What counts (toxic, clean) say, fitted on all pairs of counts and how
    many features have each: a feature either has the share of toxic documents
    that all features have together, or one of its own, mostly near 1 (a Beta
    distribution); the second kind's frequency is found by EM."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, times: np.ndarray):
        self.base = float(((toxic * times).sum() + 0.5) / (((toxic + clean) * times).sum() + 1))  # never 0 or 1
        ratio, self.kind = self._ratio(toxic, clean), 0.01
        for _ in range(200):
            self.kind = float(np.clip((self._own(ratio) * times).sum() / max(1, times.sum()), 1e-6, 0.5))

    def _ratio(self, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of the second kind to the first."""
        log_gamma = np.vectorize(math.lgamma, otypes=[float])
        second = log_gamma(toxic + NEAR) + log_gamma(clean + 1.0) - log_gamma(toxic + clean + NEAR + 1.0) + math.log(NEAR)
        return second - toxic * math.log(self.base) - clean * math.log1p(-self.base)

    def _own(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(ratio + math.log(self.kind / (1 - self.kind)), -500, 500)))

    def __call__(self, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        odds = np.log((toxic + self.base) / (clean + 1 - self.base)) - math.log(self.base / (1 - self.base))
        return self._own(self._ratio(toxic, clean)) * np.maximum(odds, 0)  # 0 for none of either


class Sparse:
    """A matrix by its entries; those of a row, or of a column, are alike."""

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int], by_row: np.ndarray | float = 1.0, by_col: np.ndarray | float = 1.0):
        self.row, self.col, self.shape, self.by_row, self.by_col = row, col, shape, by_row, by_col

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.by_row * np.bincount(self.row, (self.by_col * w)[self.col], self.shape[0])

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.col, self.row, self.shape[::-1], self.by_col, self.by_row)


def fit_ordinal(x: np.ndarray | Sparse, grade: np.ndarray, n_grades: int, l2: float = 0.1, steps: int = 800,
                rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link (proportional odds)
    model, by Adam on the penalised log likelihood. Thresholds are kept in
    order by their gaps' logarithms. Weights begin at 0 and stay at 0 or above:
    no word speaks against toxicity, so none can hide another. They share one
    step size, or the many weak ones would grow as fast as the few strong."""
    n, m = x.shape
    p = np.concatenate([np.zeros(m), [2.0], np.zeros(n_grades - 1)])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:m], np.cumsum(np.concatenate([[p[m]], np.exp(p[m + 1 :])]))
        z = (x @ w)[:, None] - t[None, :]
        above = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        pad = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = pad * (1 - pad)
        rows = np.arange(n)
        like = np.maximum(pad[rows, grade] - pad[rows, grade + 1], 1e-9)
        g = np.zeros_like(pad)  # of the log likelihood by each z
        g[rows, grade] += slope[rows, grade] / like
        g[rows, grade + 1] -= slope[rows, grade + 1] / like
        g = g[:, 1:-1] / n
        by_t = -g.sum(axis=0)
        gaps = np.exp(p[m + 1 :])
        tail = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate([x.T @ g.sum(axis=1) - l2 * w / n, [tail[0]], tail[1:] * gaps])
        size = np.concatenate([np.full(m, (grad[:m] ** 2).max(initial=0)), grad[m:] ** 2])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * size
        p = p + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        p[:m] = np.maximum(p[:m], 0)
    return p[:m], np.cumsum(np.concatenate([[p[m]], np.exp(p[m + 1 :])]))


def fit(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features by their evidence, and thresholds, from which
    document (``row``) has which feature (``col``)."""
    x = Sparse(row, col, (len(toxic), len(each)), by_col=each)
    odds = x @ np.ones(len(each))
    grade = np.zeros(len(toxic), int)
    cuts = np.quantile(odds[toxic == 1], np.arange(1, GRADES) / GRADES)
    grade[toxic == 1] = 1 + np.searchsorted(cuts, odds[toxic == 1])
    factor, thresholds = fit_ordinal(x, grade, GRADES, steps=300)
    return factor * each, thresholds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_rows: int = 20000,
          max_bytes: int = MAX_BYTES) -> OrdinalModel:
    """Fit on the documents that ``labels`` (id_col, toxic) covers."""
    ship(__name__)
    marks = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").dropDuplicates(["_id"])
    some = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_rows // 2) for k in (0, 1)]
    # no more than max_rows ids: small enough to go to every executor
    every = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
             .join(F.broadcast(some[0].unionByName(some[1])), "_id").withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))))
    # ids that repeat, or very long texts, would pass the bounds
    seen = every.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    share = min(1.0, max_rows / max(1, seen.n), max_bytes / max(1, seen.bytes or 0))
    if share < 1:
        part = F.pmod(F.xxhash64("_id", "text", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))
        every = every.filter((F.col("size") <= max_bytes // 16) & part).limit(max_rows)
    labelled = stored(every.select("text", "toxic"), "labelled")
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return OrdinalModel()
    counts = stored(count_features(labelled), "toxic-features")
    times = counts.groupBy("toxic", "clean").count().toArrow()
    evidence = Evidence(*(times[c].to_numpy().astype(float) for c in ("toxic", "clean", "count")))
    # the others' evidence is 0, whatever the fit: they matter only by their counts
    known = counts.filter(F.col("toxic") * (1 - evidence.base) > F.col("clean") * evidence.base).toArrow().sort_by("feature")
    if not len(known):
        return OrdinalModel()
    each = evidence(*(known[c].to_numpy().astype(float) for c in ("toxic", "clean")))
    names = known["feature"].to_pylist()
    at = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            on = [np.array(sorted(at[f] for f in features(words(t)) if f in at), "<i4").tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "on": on})

    rows = labelled.mapInPandas(present, "toxic int, on binary").toArrow()  # max_rows at most, of about max_bytes of text
    del at
    rows = sorted(zip(rows["toxic"].to_pylist(), rows["on"].to_pylist()))  # the same order each time
    row = np.repeat(np.arange(len(rows)), [len(on) // 4 for _, on in rows])
    col = np.frombuffer(b"".join(on for _, on in rows), "<i4").astype(np.int64)
    w, t = fit(np.array([toxic for toxic, _ in rows]), row, col, each)
    return OrdinalModel({f: float(v) for f, v in zip(names, w) if v > 0}, [float(v) for v in t])


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade, 0 to GRADES) and
    ``p_toxic`` (the probability of any grade above 0)."""
    ship(__name__)

    @F.pandas_udf("struct<severity: double, p_toxic: double>")
    def grades(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = [model.above(t) or [0.0] for t in texts]
            yield pd.DataFrame({"severity": [sum(x) for x in p], "p_toxic": [x[0] for x in p]})

    return docs.withColumn("_grades", grades(F.col(text))).withColumns({"severity": F.col("_grades.severity"), "p_toxic": F.col("_grades.p_toxic")}).drop("_grades")
