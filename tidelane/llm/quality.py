"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import labelled_sample
from tidelane.llm.words import mix, slices, words

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 20_000
#: Added words or bytes that pull a short text's ratios to the usual ones.
PRIOR = 25.0

_UPPER, _DIGIT, _PUNCT, _SYMBOL = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = _PUNCT
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL

FEATURES = ("upper", "digits", "punctuation", "symbols", "distinct_words", "distinct_pairs", "repeats", "top_word", "word_bytes", "spread", "log_words")


def _logit(k: np.ndarray, n: np.ndarray, usual: float) -> np.ndarray:
    p = (k + PRIOR * usual) / (n + PRIOR)
    return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-6))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, each ratio smoothed and on the logit scale; null and empty count no words."""
    out = []
    for _, _, data, offsets in slices(column):
        kind = _CLASS[data]
        size = np.diff(offsets).astype(float)
        counts = [np.diff(np.append(0, np.cumsum(kind == c))[offsets]).astype(float) for c in (_UPPER, _DIGIT, _PUNCT, _SYMBOL)]
        h, length, bounds = words(data, offsets)
        n = np.diff(bounds).astype(float)
        rows = np.zeros((len(n), 6))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                w = h[a:b]
                _, times = np.unique(w, return_counts=True)
                pair = mix(w[1:] * np.uint64(3) + w[:-1])
                rows[i] = len(times), len(np.unique(pair)) if b > a + 1 else 0, np.count_nonzero(w[1:] == w[:-1]), times.max(), length[a:b].sum(), (length[a:b].astype(float) ** 2).sum()
        mean = (rows[:, 4] + PRIOR * 6) / (n + PRIOR)
        square = (rows[:, 5] + PRIOR * 45) / (n + PRIOR)
        # a long text has fewer distinct words for each word; the square root of its length undoes most of that
        out.append(
            np.column_stack(
                [
                    *(_logit(c, size / 4, p) for c, p in zip(counts, (0.06, 0.003, 0.09, 0.004), strict=True)),
                    np.log((rows[:, 0] + PRIOR * 0.9) / (n + PRIOR)) + 0.12 * np.log(n + PRIOR),
                    _logit(rows[:, 1], np.maximum(n - 1, 0), 0.97),
                    _logit(rows[:, 2], np.maximum(n - 1, 0), 0.01),
                    _logit(rows[:, 3], n, 0.06),
                    np.log(mean),
                    np.log(np.maximum(square - mean**2, 0.05)),
                    np.log(n + PRIOR),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Two Gaussian classes; each keeps its mean, the inverse Cholesky factor of its covariance and a log density constant."""

    means: np.ndarray
    whiten: np.ndarray
    const: np.ndarray
    temper: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        d = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.const, strict=True)]
        return (d[1] - d[0]) / self.temper

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.05, ridge: float = 0.01, temper: float = 3.0) -> Discriminant:
    """Class covariances shrunk to the pooled one and to a sphere; a class without rows takes the other's shape, far off.

    temper divides the log odds: statistics of one text depend on each other, which makes raw odds too sure.
    """
    p = x.shape[1]
    if not len(x):
        return Discriminant(np.zeros((2, p)), np.array([np.eye(p)] * 2), np.zeros(2), temper)
    # ridge is in units of each statistic's overall variance
    scale = x.std(axis=0) + 1e-6
    within = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1) if (y == c).any()) / len(x)
    means, whiten, const = [], [], []
    for c in (0, 1):
        rows = x[y == c]
        prior = np.log((len(rows) + 1) / (len(x) + 2))
        own = np.cov(rows.T, bias=True) if len(rows) > p else within
        cov = (1 - pooled) * own + pooled * within
        cov = (1 - ridge) * cov + ridge * np.diag(scale**2)
        low = np.linalg.cholesky(cov)
        means.append(rows.mean(axis=0) if len(rows) else x.mean(axis=0))
        whiten.append(np.linalg.inv(low))
        const.append(prior - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(const), temper)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(0))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([flat, batch.column(1)], names=["x", "y"])


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Discriminant:
    """Fits on at most `bound` learnable labelled rows; only their statistics reach the driver."""
    rows = labelled_sample(docs, labels, "quality", bound).select("text", "y").mapInArrow(_measure, "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T) if len(x) else []
    return fit(x[order], rows["y"].to_numpy()[order])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on).

    Every row of docs comes back once with all its columns; columns named score or predicted are replaced. Null and
    empty texts are scored as texts without words. Without labelled rows every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))  # a few kB
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    names = [f"c{i}" for i in range(len(kept))]
    at = [f.name.lower() for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "score"])

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept]).toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True))
    out = rows.mapInArrow(run, f"{schema}, score double").toDF(*[f.name for f in kept], "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
