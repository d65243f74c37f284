"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk towards the pooled one and
then towards a multiple of the identity. A document's score is the logistic of the difference of the two log-densities,
each from the Mahalanobis distance by way of the class's Cholesky factor, computed once per fit.

The fit takes at most FIT_ROWS labelled rows, those whose ids hash lowest, so that their ids may go to all executors and
no text is shuffled. It needs only each class's count, sum and sum of outer products, which the tasks add up over
their own rows; the driver gets the two totals.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, valid

#: Statistics of a document, in order.
STATISTICS = (
    "log_bytes", "log_words", "log_mean_word", "word_spread", "distinct_words", "top_word", "word_entropy", "distinct_pairs",
    "upper", "digits", "plain_marks", "odd_marks", "beyond_ascii", "spaces", "log_line_words", "distinct_lines", "short_words", "long_words",
)
POOLED, RIDGE = 0.6, 0.01
#: Divides the log-density difference, which is overconfident where statistics depend on each other.
TEMPERATURE = 4.0
THRESHOLD = 0.3
#: Labelled rows in a fit, at most.
FIT_ROWS = 20_000

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_PLAIN = np.array([chr(b) in ".,;:'\"?-()" for b in range(256)])
_ODD = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()" for b in range(256)])
_BEYOND = np.arange(256) >= 128
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])


def _angle(part: float) -> float:
    return math.asin(math.sqrt(min(1.0, max(0.0, part))))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text: logs of sizes, arc sines of shares. Empty texts have zero shares."""
    size = len(text)
    if not size:
        return [0.0] * len(STATISTICS)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda kind: _angle(byte[kind].sum() / size)
    words = text.split()
    n = len(words)
    if n:
        counts = Counter(words)
        lens = np.fromiter(map(len, words), np.float64, n)
        seen = np.fromiter(counts.values(), np.float64, len(counts))
        entropy = (math.log(n) - float(seen @ np.log(seen)) / n) / math.log(n) if n > 1 else 1.0
        mean, spread = lens.mean(), lens.std()
        distinct, top = len(counts) / n, seen.max() / n
        pairs = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
        short, long = (lens <= 2).mean(), (lens >= 14).mean()
    else:
        entropy = mean = spread = distinct = top = pairs = short = long = 0.0
    lines = text.split(b"\n")
    return [
        math.log1p(size), math.log1p(n), math.log1p(mean), math.log1p(spread), _angle(distinct), _angle(top), max(0.0, entropy), _angle(pairs),
        share(_UPPER), share(_DIGIT), share(_PLAIN), share(_ODD), share(_BEYOND), share(_SPACE),
        math.log1p(n / len(lines)), _angle(len(set(lines)) / len(lines)), _angle(short), _angle(long),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1."""

    means: list[np.ndarray]
    inverse: list[np.ndarray]
    constant: list[float]
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: class 1 likelier."""
        log = []
        for mean, inverse, constant in zip(self.means, self.inverse, self.constant, strict=True):
            z = (x - mean) @ inverse.T
            log.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -500, 500)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE, temperature: float = TEMPERATURE) -> Discriminant:
    """Fit from each class's (count, sum, sum of outer products). A class without rows takes the other's mean; no
    rows at all score 0.5 everywhere."""
    d = len(STATISTICS)
    sums = {k: sums.get(k, (0.0, np.zeros(d), np.zeros((d, d)))) for k in (0, 1)}
    total = sums[0][0] + sums[1][0]
    if not total:
        return Discriminant([np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0] * 2, temperature)
    everything = (sums[0][1] + sums[1][1]) / total
    means = [s[1] / s[0] if s[0] else everything for s in (sums[0], sums[1])]
    scatter = [s[2] - s[0] * np.outer(m, m) for s, m in zip((sums[0], sums[1]), means, strict=True)]
    within = sum(scatter) / total
    # statistics have different units: shrink in units of the pooled spread
    unit = np.sqrt(np.maximum(np.diag(within), 1e-6))
    inverse, constant = [], []
    for k in (0, 1):
        n = sums[k][0]
        own = scatter[k] / n if n > 1 else within
        cov = ((1 - pooled) * own + pooled * within) / np.outer(unit, unit)
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor) / unit)
        constant.append(-float(np.log(np.diag(factor)).sum()) + math.log((n + 1) / (total + 2)))
    return Discriminant(means, inverse, constant, temperature)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **shrinkage: float) -> Discriminant:
    """Fit on the labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality of 0 or 1).

    Of the labels, the ``fit_rows`` whose ids have the lowest hashes are used. Rows without a text count as empty ones;
    rows without a label, or with a null or other one, take no part. A doc_id with several labels is used with each.
    """
    marks = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id", "label")
        .limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("label_id")).select("label", "text")
    d = len(STATISTICS)

    def work(cols: dict) -> dict:
        x = np.array([statistics(t) for t in cols["text"]])
        label = np.array(cols["label"])
        out = {"label": [], "sums": []}
        for k in (0, 1):
            own = x[label == k]
            if len(own):
                out["label"].append(k)
                out["sums"].append(np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel())).tolist())
        return out

    parts = map_texts(rows, work, "label int, sums array<double>")
    size = 1 + d + d * d
    summed = parts.groupBy("label").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size))).collect()
    sums = {}
    for row in summed:
        s = np.array([row[f"s{i}"] for i in range(size)])
        sums[row.label] = (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d))
    return discriminant(sums, **shrinkage)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id`` and ``score`` of every row; null texts count as empty ones."""

    def work(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "score": model.scores(np.array([statistics(t) for t in cols["text"]])).tolist()}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; nothing is shuffled. Null texts count as empty ones."""

    @F.pandas_udf("double")
    def scored(texts):
        return pd.Series(model.scores(np.array([statistics((t or "").encode()) for t in texts])) if len(texts) else [])

    return docs.where(scored(F.coalesce(valid(), F.lit(""))) >= threshold)


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit of the registered query sees: crc32 of the id as text, modulo 5, is 0. Without an id: not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
