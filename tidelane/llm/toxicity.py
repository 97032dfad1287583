"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import cut, labelled_sample
from tidelane.llm.words import NO_LETTER, slices, stems

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 20_000
#: The Dirichlet prior of a token: a flat part and this share of its texts in both classes.
PRIOR_FLAT, PRIOR_SHARE = 0.5, 0.05
#: Log-odds of fewer standard errors than this are taken as 0, others are drawn towards it (the nonnegative garrote).
SURE = 2.5
#: What every word costs a passage.
DRIFT = 0.05
#: A word's tokens are itself and its first so many bytes.
STEMS = (4, 5, 6)
#: Chance in clean text of a passage that still counts as significant.
SIGNIFICANT = 0.05

_EULER = 0.5772156649015329


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (first, end, score) of a sequence, left to right, in linear time.

    The stack holds candidates with the running total before them (l) and at their end (r). A new positive score
    joins back over candidates while the nearest one with a smaller l has a smaller r too. `back` links each candidate
    to that one, so that links skip what lies between.
    """
    first, end, left, right, back = [], [], [], [], []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        a, lo, hi = i, total, total + s
        total = hi
        while True:
            j = len(first) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            a, lo = first[j], left[j]
            del first[j:], end[j:], left[j:], right[j:], back[j:]
        first.append(a)
        end.append(i + 1)
        left.append(lo)
        right.append(hi)
        back.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(first, end, left, right, strict=True)]


@dataclass
class Lexicon:
    """Sorted token hashes and the log-odds of each, what a word costs, and the calibration."""

    keys: np.ndarray
    gain: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0)

    def gains(self, tokens: list[np.ndarray]) -> np.ndarray:
        """For each word the log-odds of the one of its tokens that says most."""
        best = np.zeros(len(tokens[0]))
        if len(self.keys):
            for h in tokens:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                own = np.where(self.keys[at] == h, self.gain[at], 0.0)
                best = np.where(np.abs(own) > np.abs(best), own, best)
        return best


def _runs(s: np.ndarray) -> tuple[list[int], list[float]]:
    """Positions and scores with the words between two positive ones summed up; outer negative ones are left out."""
    up = np.flatnonzero(s > 0)
    if not len(up):
        return [], []
    total = np.append(0, np.cumsum(s))
    gaps = total[up[1:]] - total[up[:-1] + 1]
    where, score = np.empty(2 * len(up) - 1, int), np.empty(2 * len(up) - 1)
    where[::2], score[::2] = up, s[up]
    where[1::2], score[1::2] = up[:-1] + 1, gaps
    return where.tolist(), score.tolist()


def passages(s: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments of a text's word scores as (first word, end word, score)."""
    where, score = _runs(s)
    return [(where[a], where[b - 1] + 1, x) for a, b, x in segments(score)]


def texts_gains(model: Lexicon, column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's gains by word; null and empty texts have no words."""
    for _, _, data, offsets in slices(column):
        tokens, bounds = stems(data, offsets, NO_LETTER, STEMS)
        gains = model.gains(tokens)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield gains[a:b]


def normalised(model: Lexicon, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Passages with scores rate * score - log(K n) for a text of n words.

    In clean text of that length the best one exceeds x with probability 1 - exp(-exp(-x)).
    """
    cost = model.log_k + np.log(max(n, 1))
    return [(a, b, model.rate * x - cost) for a, b, x in found]


#: A normalised score from here on is significant.
LEAST = float(-np.log(-np.log1p(-SIGNIFICANT)))


def features(found: list[tuple[int, int, float]]) -> list[float]:
    """The evidence of a text's normalised passages: a constant, the best one and the sum of the significant ones."""
    best = max((x for *_, x in found), default=-5.0)
    return [1.0, float(np.clip(best, -5, 30)) / 10, float(np.log1p(sum(x for *_, x in found if x >= LEAST))) / 3]


def probability(model: Lexicon, x: list[float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(model.weights, x), -40, 40))))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, clean): in how many texts of each label a token stands, counted within slices."""
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for first, _, data, offsets in slices(batch.column(0)):
            tokens, bounds = stems(data, offsets, NO_LETTER, STEMS)
            toxic, clean = [], []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                once = np.unique(np.concatenate([t[a:b] for t in tokens]))
                (toxic if y[first + i] else clean).append(once[once > 0])
            every = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (toxic, clean)]
            keys = np.unique(np.concatenate(every))
            counts = [np.bincount(np.searchsorted(keys, x), minlength=len(keys)) for x in every]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts[0]), pa.array(counts[1])], names=["token", "toxic", "clean"])


def log_odds(sample: DataFrame) -> Lexicon:
    """Token log-odds between the classes with an informative Dirichlet prior; a token counts once for each text.

    Counts are summed over the sample's rows in Spark. Log-odds of either sign keep the part 1 - (SURE / z)^2 of
    themselves, z being their standard errors; tokens that keep none do not come to the driver.
    """
    counts = sample.select("text", "y").mapInArrow(_tokens, "token long, toxic long, clean long").groupBy("token").agg(
        F.sum("toxic").alias("t"),
        F.sum("clean").alias("c"),
    )
    counts = cut(counts.withColumn("p", PRIOR_FLAT + PRIOR_SHARE * (F.col("t") + F.col("c"))))
    nt, nc, a0 = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c"), F.sum("p")).head())
    if not nt or not nc:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    odds = lambda k, n: F.log((F.col(k) + F.col("p")) / (n + a0 - F.col(k) - F.col("p")))
    delta = odds("t", nt) - odds("c", nc)
    error = F.sqrt(1 / (F.col("t") + F.col("p")) + 1 / (F.col("c") + F.col("p")))
    sure = F.greatest(1 - (SURE * error / delta) ** 2, F.lit(0.0))
    rows = counts.where(F.abs(delta) > SURE * error).select("token", (delta * sure).alias("gain")).toPandas()
    keys = rows["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], rows["gain"].to_numpy(float)[order])


def _observed(model: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, values, times = [], [], []
            best: list[list[float]] = []
            for g in texts_gains(model, batch.column(0)):
                up, many = np.unique(g[g != 0], return_counts=True)
                n.append(len(g))
                values.append(up.tolist())
                times.append(many.tolist())
                best.append([x for *_, x in passages(g - model.drift)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(values, pa.list_(pa.float64())),
                    pa.array(times, pa.list_(pa.int64())),
                    pa.array(best, pa.list_(pa.float64())),
                ],
                names=["y", "n", "values", "times", "found"],
            )

    return run


def calibrate(model: Lexicon, y: np.ndarray, n: np.ndarray, values: list, times: list, found: list) -> Lexicon:
    """Fits rate and K to clean texts' word scores and best passages, then the logistic weights of the evidence."""
    tally: dict[float, float] = {}
    clean = [i for i in range(len(y)) if not y[i] and n[i]]
    for i in clean:
        for v, k in zip(values[i], times[i], strict=True):
            tally[v] = tally.get(v, 0) + k
    words_ = float(sum(n[i] for i in clean))
    gained = np.array(sorted(tally))
    often = np.array([tally[v] for v in gained])
    s = np.append(gained - model.drift, -model.drift)
    p = np.append(often, words_ - often.sum()) / max(words_, 1)
    if len(clean) and len(gained) and (p * s).sum() < 0:
        low, high = 1e-6, 1.0
        total = lambda r: (p * np.exp(np.minimum(r * s, 700))).sum()
        while total(high) < 1 and high < 1e3:
            high *= 2
        for _ in range(80):  # the positive root of E exp(rate * score) = 1
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < 1 else (low, mid)
        model.rate = low
        top = [low * max(found[i]) - np.log(n[i]) for i in clean if len(found[i])]
        model.log_k = float(np.mean(top) - _EULER) if top else 0.0
    x = np.array([features(normalised(model, n[i], [(0, 0, z) for z in found[i]])) for i in range(len(y))]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(50):  # ridge Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(3), x.T @ (q - y) + 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = tuple(float(v) for v in w)
    return model


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Lexicon:
    """Fits on at most `bound` learnable labelled rows, equal texts once.

    Log-odds come from one half of the texts and calibration from the other, so that tokens of few texts do not look
    sure; a half without both labels leaves both steps to all texts.
    """
    key = F.xxhash64("text")
    sample = cut(
        labelled_sample(docs, labels, "toxic", bound).withColumn("key", key).groupBy("key").agg(
            F.max_by("text", "doc_id").alias("text"),
            F.max_by("y", "doc_id").alias("y"),
        )
    )
    half = {(r["half"], r["y"]) for r in sample.groupBy((F.col("key") % 2 == 0).alias("half"), "y").count().collect()}
    split = len(half) == 4
    model = log_odds(sample.where("key % 2 = 0") if split else sample)
    rows = (sample.where("key % 2 <> 0") if split else sample).select("text", "y")
    seen = rows.mapInArrow(_observed(model), "y int, n long, values array<double>, times array<long>, found array<double>").toPandas()
    if not len(seen) or seen["y"].nunique() < 2:
        return model
    return calibrate(model, seen["y"].to_numpy(float), seen["n"].to_numpy(), seen["values"].tolist(), seen["times"].tolist(), seen["found"].tolist())


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score, predicted, passages): score 0 to 1, higher where label 1 is likelier, for each row of docs.

    passages are the significant ones as (first, end, score), counted in words of letters, score normalised. Null and
    empty texts have no words and get the score of no evidence. Without labels of both classes every score is that.
    Rows with equal or null ids each get a row.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))  # at most the words of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        kind = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            score, found = [], []
            for g in texts_gains(m, batch.column(1)):
                got = normalised(m, len(g), passages(g - m.drift))
                score.append(probability(m, features(got)))
                found.append([{"first": a, "end": b, "score": x} for a, b, x in got if x >= LEAST])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(found, pa.list_(kind))],
                names=["doc_id", "score", "passages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,end:int,score:double>>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
