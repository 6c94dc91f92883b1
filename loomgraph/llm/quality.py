"""Quality by regularised quadratic discriminant analysis of document statistics.

Statistics of each whole text are transformed (logarithms of counts, logits of shares) and written once as a narrow
table. Class moments are summed in Spark, a partial sum a task; the driver shrinks each class covariance towards the
pooled one and factors it once. Scores are logistic in the difference of Mahalanobis log-densities, computed from the
broadcast Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches, written

FEATURES = (
    "log_words", "log_chars", "log_lines", "word_length", "word_length_sd", "letters", "upper", "digits", "space", "beyond_ascii",
    "symbols", "exclaim", "pipes", "period_comma", "distinct_words", "top_word", "distinct_lines", "line_words", "repeats", "marked_words",
)
_KIND = np.zeros((256, 8), np.float64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [_c.isalpha() and _b < 128, "A" <= _c <= "Z", "0" <= _c <= "9", _c in " \t\n\r\x0b\x0c", _b >= 128, _c in "#$%&*+=<>@[]\\^_`{}~/\"", _c in "!?", _c == "|"]


def _logit(share: float, n: float) -> float:
    """Log-odds of a share of n, kept finite."""
    return float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; an empty one has the values of no evidence."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND if size else np.zeros(8)
    dots = raw.count(b".") + raw.count(b",")
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    marked = sum(1 for w in words if not (w[-1:].isalnum() or w[-1:] in b".,;:" or w[-1] >= 128))
    share = lambda k: _logit(k / size, size) if size else 0.0
    of_words = lambda k: _logit(k / n, n) if n else 0.0
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(np.log1p(len(lines))), float(np.log1p(lengths.mean())) if n else 0.0, float(np.log1p(lengths.std())) if n else 0.0,
        share(kinds[0]), share(kinds[1]), share(kinds[2]), share(kinds[3]), share(kinds[4]), share(kinds[5]), share(kinds[6]), share(kinds[7]), share(dots),
        of_words(len(counts)), of_words(max(counts.values())) if n else 0.0, _logit(len(set(lines)) / len(lines), len(lines)) if lines else 0.0, float(np.log1p(n / len(lines))) if lines else 0.0,
        of_words(again), of_words(marked),
    ]


def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Qda:
    """shrinkage towards the pooled covariance, ridge as a part of its mean variance, and the flattening of scores."""

    shrinkage: float = 0.15
    ridge: float = 0.02
    flatten: float = 0.35


class QdaModel:
    """Class means, cached Cholesky factors and log-determinants."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], how: Qda):
        self.how, self.classes = how, {}
        live = {y: m for y, m in moments.items() if m[0] > 0}
        total = sum(m[0] for m in live.values())
        cov = {y: (xx - np.outer(x, x) / n) / n for y, (n, x, xx) in live.items()}
        if len(live) == 2:
            pooled = sum(live[y][0] * cov[y] for y in live) / total
            self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
            unit = np.outer(self.scale, self.scale)
            for y, (n, x, _) in live.items():
                s = (1 - how.shrinkage) * cov[y] / unit + how.shrinkage * pooled / unit + how.ridge * np.eye(len(x))
                factor = np.linalg.cholesky(s)
                self.classes[y] = (np.log(n / total), x / n, factor, 2 * np.log(np.diag(factor)).sum())
        self.prior = live[1][0] / total if 1 in live and total else 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics; with one class only, that class's share."""
        if len(self.classes) < 2:
            return np.full(len(x), float(self.prior))
        density = {}
        for y, (prior, mean, factor, logdet) in self.classes.items():
            z = np.linalg.solve(factor, ((x - mean) / self.scale).T)
            density[y] = prior - 0.5 * (logdet + (z * z).sum(0))
        return 1 / (1 + np.exp(-np.clip(self.how.flatten * (density[1] - density[0]), -40, 40)))


def _sums(batches):
    d = len(FEATURES)
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for batch in batches:
        y = np.array(batch.column(0), np.int64)
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        for k in sums:
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["y", "i", "v"])


def fit(statistics_table: DataFrame, labels: DataFrame, how: Qda = Qda(), id_col: str = "doc_id", label_col: str = "quality") -> QdaModel:
    """Fit on all labelled rows of a table (doc_id, x). Rows with null id or label, or another label than 0 and 1, are
    left out; repeated rows count each time."""
    d = len(FEATURES)
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = statistics_table.join(labels, statistics_table.doc_id == labels.id).select("y", "x").mapInArrow(_sums, "y int, i int, v double")
    moments = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for r in rows.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        moments[r.y][r.i] = r.v
    return QdaModel({y: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for y, v in moments.items()}, how)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (doc_id, x) with the transformed statistics of every whole text, null and empty ones too."""
    small_batches(docs.sparkSession)
    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.arrow_udf(_statistics, "array<double>")(F.col(text_col).cast("string")).alias("x")), "statistics")


def score_quality(statistics_table: DataFrame, model: QdaModel) -> DataFrame:
    """doc_id and score (0 to 1) for every row of a table (doc_id, x); null and repeated ids are rows like others, null and
    empty texts have statistics of their own, and an empty table gives no rows."""
    shared = statistics_table.sparkSession.sparkContext.broadcast(model)

    def score(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else [], pa.float64())

    score.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return statistics_table.select("doc_id", F.arrow_udf(score, "double")("x").alias("score"))
