"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, held_out, map_pandas, materialize

#: Share of the pooled covariance in each class's, and of its mean variance on the diagonal.
POOLED, RIDGE = 0.2, 0.02
THRESHOLD = 0.7
STATISTICS = ("chars", "words", "letters", "digits", "upper", "space", "stops", "symbols", "lines", "word_mean", "word_sd", "types", "repeats", "line_repeats", "top_word", "shouted", "long_run", "marked")
_CLASSES = {"letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "space": " \t\r\n", "stops": ".,;:?'\"-", "symbols": "!#$%&*+/<=>@[\\]^_`{|}~", "lines": "\n"}
_masks: dict[str, np.ndarray] = {}


def _class_mask(name: str) -> np.ndarray:
    if name not in _masks:
        mask = np.zeros(256)
        mask[list(_CLASSES[name].encode())] = 1
        if name == "letters":
            mask[128:] = 1  # bytes of letters beyond ASCII
        _masks[name] = mask
    return _masks[name]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text: logs of counts, log-odds of shares. An empty text has those of zero counts."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    hist = np.bincount(raw, minlength=256)
    odds = lambda part, whole: float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))
    words = text.split()
    m = len(words)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), float, m) if m else np.zeros(1)
    repeats = sum(map(str.__eq__, words, words[1:])) if m > 1 else 0
    lines = [x for x in text.split("\n") if x]
    longest = float(sizes.max()) if m else 0.0
    share = [odds(hist @ _class_mask(k), n) for k in ("letters", "digits", "upper", "space", "stops", "symbols", "lines")]
    marked = sum(1 for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\"-")
    return [
        np.log1p(n), np.log1p(m), *share, np.log1p(sizes.mean()), np.log1p(sizes.std()), float(np.log((len(counts) + 0.5) / (np.sqrt(m) + 0.5))), odds(repeats, m),
        odds(len(lines) - len(set(lines)), len(lines)), odds(max(counts.values(), default=0), m), odds(sum(map(str.isupper, words)), m), np.log1p(longest), odds(marked, len(counts)),
    ]


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the array stats for each row."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "stats": [statistics(t) for t in b["text"]]})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_pandas, run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """For each class its mean, the inverse Cholesky factor of its covariance, and its constant term."""

    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    temperature: float = 1.0

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant | None:
        """moments: n, sum and sum of outer products by class. None without both classes."""
        if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
            return None
        n = np.array([moments[k][0] for k in (0, 1)])
        means = np.stack([moments[k][1] / moments[k][0] for k in (0, 1)])
        own = np.stack([moments[k][2] / moments[k][0] - np.outer(means[k], means[k]) for k in (0, 1)])
        pooled = (n[:, None, None] * own).sum(axis=0) / n.sum()
        scale = np.maximum(np.diag(pooled), 1e-6)
        whiten, constant = [], []
        for k in (0, 1):
            cov = (1 - POOLED) * own[k] + POOLED * pooled
            cov = (1 - RIDGE) * cov + RIDGE * np.diag(scale)
            factor = np.linalg.cholesky(cov)
            whiten.append(np.linalg.inv(factor))
            constant.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
        return Discriminant(means, np.stack(whiten), np.array(constant))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1, weighed by its share, less that of class 0."""
        density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constant, strict=True)]
        return density[1] - density[0]


def class_moments(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Counts, sums and sums of outer products over every labelled row that isn't held out; the driver gets those sums alone.

    Statistics are joined, not texts. A document with several labels counts once for each."""
    d = len(STATISTICS)
    train = stats.where(~held_out()).join(labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null"), "doc_id")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b["quality"].to_numpy()
            x = np.stack(b["stats"].to_numpy()) if len(b) else np.zeros((0, d))
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame({"quality": np.repeat([0, 1], sums.shape[1]), "at": np.tile(np.arange(sums.shape[1]), 2), "value": sums.ravel()})

    total = np.zeros((2, 1 + d + d * d))
    sums = train.select("quality", "stats").transform(map_pandas, partial, "quality int, at int, value double").groupBy("quality", "at").agg(F.sum("value").alias("value"))
    for k, at, value in sums.collect():
        total[k, at] = value
    return {k: (total[k, 0], total[k, 1 : d + 1], total[k, d + 1 :].reshape(d, d)) for k in (0, 1)}


def fit_model(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant | None]:
    """The statistics of all documents, in the shared folder, and the model."""
    stats = materialize(with_statistics(documents), "statistics")
    return stats, Discriminant.fit(class_moments(stats, labels))


def scores(model: Discriminant | None, x: np.ndarray) -> np.ndarray:
    """Probability of class 1; 0.5 without a model."""
    return np.full(len(x), 0.5) if model is None else 1 / (1 + np.exp(-np.clip(model.log_odds(x), -50, 50)))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score at least `least`, all columns as they are.

    Without a model nothing is rejected. Rows are scored where they are, so no text is shuffled."""
    _, model = fit_model(documents, labels)
    if model is None:
        return documents

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores(model, np.array([statistics(t) for t in text]).reshape(-1, len(STATISTICS))))

    return documents.where(score(F.col("text").cast("string")) >= least)


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of documents.

    Each text is read once; its statistics go to the shared folder, the model is
    fitted on those of all labelled rows that aren't held out, and scores every row.
    Null and empty texts are scored by their statistics like others, equal texts
    alike; a null doc_id is scored and not held out. Without labels of both classes every score is 0.5. Other columns are left out."""
    stats, model = fit_model(documents, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["stats"].to_numpy()) if len(b) else np.zeros((0, len(STATISTICS)))
            s = scores(model, x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    return stats.withColumn("held_out", held_out()).select("doc_id", "held_out", "stats").transform(map_pandas, score, "doc_id long, held_out boolean, score double, predicted int")
