"""Document quality by regularised quadratic discriminant analysis.

A document is a few transformed statistics of its whole text. Each class has a mean and a
covariance that is shrunk towards the pooled covariance and its diagonal; the score is the
logistic of the difference of log densities (Mahalanobis distances by cached inverse Cholesky
factors) after a calibrating slope and offset. It is fitted on the driver from statistics of
at most about ``most_rows`` labelled rows, chosen by hash: that is the bound of the sample.

Defined cases: null and empty texts have all statistics zero and get a score like any other;
rows without a label or with a label other than 0 and 1 are not learned from; if a class
has too few rows (under 2), every score is the share of class 1 (one half without labels);
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = ("words", "word_length", "types", "symbols", "bangs", "capitals", "digits", "stutters", "bars", "stops", "sentence", "line_repeats")

_SPACE, _SYMBOL, _BANG, _CAPITAL, _DIGIT, _BAR, _STOP = 1, 2, 3, 4, 5, 6, 7
_CLASS = np.zeros(256, np.uint8)
for _chars, _code in ((b" \t\n\r\x0b\x0c", _SPACE), (b"#*$%&<>{}[]~^=_\\@/", _SYMBOL), (b"!", _BANG), (bytes(range(65, 91)), _CAPITAL), (b"0123456789", _DIGIT), (b"|", _BAR), (b".,;:?", _STOP)):
    _CLASS[list(_chars)] = _code


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.zeros(8, np.int64)
    for at in range(0, len(data), 1 << 20):
        n += np.bincount(_CLASS[data[at : at + (1 << 20)]], minlength=8)
    # a capital beyond ASCII is a letter that lower-casing changes
    upper = n[_CAPITAL] if text.isascii() else sum(map(str.isupper, text))
    chars, count = len(text) - int(n[_SPACE]), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(text.count(x) for x in ".!?")
    root = lambda x: np.sqrt(max(x, 0) / max(chars, 1))
    return np.array([
        np.log1p(count), chars / count, np.log1p(len(set(words))) / np.log1p(count),
        root(n[_SYMBOL]), root(n[_BANG]), upper / max(chars, 1), root(n[_DIGIT]), np.sqrt(stutters / count),
        root(n[_BAR]), root(n[_STOP]), np.log1p(count / (ends + 1)), np.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)),
    ])


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None
    inverse: np.ndarray | None = None  # inverse Cholesky factor of each class
    log_det: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        own = [-0.5 * (((x - self.means[k]) @ self.inverse[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return own[1] - own[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.2, to_diagonal: float = 0.1, ridge: float = 1e-4) -> Model:
    """Regularised discriminant: class covariances shrunk to the pooled one, then to their
    diagonal; slope and offset by Newton's method on the logistic loss, slightly damped."""
    n1 = int(y.sum())
    if min(n1, len(y) - n1) < 2:
        return Model(n1 / len(y) if len(y) else 0.5)
    means = np.array([x[y == k].mean(0) for k in (0, 1)])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = ((len(y) - n1) * own[0] + n1 * own[1]) / len(y)
    inverse, log_det = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + ridge * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    model = Model(n1 / len(y), means, np.array(inverse), np.array(log_det))
    d = np.clip(model.difference(x), -60, 60)
    a, b = 0.5, float(np.log(n1 / (len(y) - n1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * d).sum() + 1e-2 * (a - 1), (p - y).sum()])
        hess = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(a), float(b)
    return model


def with_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, stats) of each row."""
    def run(batches):
        for batch in batches:
            flat = np.concatenate([statistics(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros(0)
            ends = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["id", "stats"])

    return common.mapped(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, stats array<double>")


def fitted(stats: DataFrame, labels: DataFrame, learn: Column, most_rows: int = 20_000) -> Model:
    """Fit on rows of ``stats`` that have a label (``labels``: id, label) and for whose ``id``
    ``learn`` holds."""
    own = labels.where(F.col("label").isin(0, 1)).where(learn)
    share = most_rows / max(own.count(), 1)
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) < share * 1_000_003)
    rows = stats.join(own, "id").select("id", "label", "stats").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.stats))
    x = np.array([r.stats for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.label for r in rows], np.int64))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row of ``stats``."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return stats.select("id", "stats").mapInArrow(run, "id long, score double")
