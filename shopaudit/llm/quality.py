"""Quality of page texts: a regularised quadratic discriminant over transformed text statistics."""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches

STATISTICS = ("size", "upper", "digits", "shouts", "signs", "bars", "lines", "stops", "accents", "markup", "blanks",
              "word_length", "distinct_words", "top_word", "distinct_lines", "entropy", "redundancy", "odd_words")
SHRINKAGE = 0.3
RIDGE = 0.02
BYTE_GROUPS = {
    "upper": bytes(range(65, 91)), "digits": b"0123456789", "shouts": b"!?", "signs": b"#$%&*@^~+", "bars": b"|",
    "lines": b"\n", "stops": b".,;:", "accents": bytes(range(128, 256)), "markup": b"<>{}[]=/\\\"", "blanks": b" \t"}


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text, in the order of STATISTICS; null counts as empty.

    Rates are moved to a log scale, which brings them near a normal distribution within a class.
    """
    raw = (text or "").encode("utf-8", "replace")
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / max(size, 1)
    out = [np.log1p(size)]
    out += [np.log(share[list(group)].sum() + 0.002) for group in BYTE_GROUPS.values()]
    words = raw.split()
    many = max(len(words), 1)
    seen = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    out.append(np.log((size - counts[[9, 10, 11, 12, 13, 32]].sum() + 1) / many))
    out.append(np.log((len(seen) + 1) / (many + 1)) / np.log(many + 2))
    out.append(np.log((seen.most_common(1)[0][1] if seen else 0) / many + 0.01))
    out.append(np.log((len(set(lines)) + 1) / (len(lines) + 1)))
    used = share[share > 0]
    out.append(-(used * np.log2(used)).sum())
    out.append(np.log((len(zlib.compress(raw, 1)) + 20) / (size + 20)))
    out.append(np.log(sum(n for w, n in seen.items() if not w[-1:].isalpha() and w[-1] < 128) / many + 0.01))
    return np.array(out, dtype=float)


def measured(documents: DataFrame) -> DataFrame:
    """(page_id, statistics) of every row with a page_id. One narrow pass over the texts."""
    small_batches(documents.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows],
                                                                        pa.list_(pa.float64()))], ["page_id", "statistics"])

    return keyed(documents, "page_id", "text").withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(
        task, "page_id long, statistics array<double>")


@dataclass
class QuadraticDiscriminant:
    """Class means, cached inverse Cholesky factors, and the map from log density differences to scores."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, from Mahalanobis distances."""
        logs = [self.offsets[c] - 0.5 * (((rows - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return logs[1] - logs[0]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the signed root tames differences that grow with the square of the distance."""
        d = self.difference(rows)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.sign(d) * np.sqrt(np.abs(d)) + self.shift, -40, 40)))


def _moments(training: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of each class: added up in the tasks, then by Spark."""
    d = len(STATISTICS)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for frame in frames:
            if len(frame):
                rows, label = np.stack(frame["statistics"]), frame["label"].to_numpy()
                for c in (0, 1):
                    x = rows[label == c]
                    total[c] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "k": np.tile(np.arange(total.shape[1]), 2),
                            "value": total.ravel()})

    sums = np.zeros((2, 1 + d + d * d))
    # 2 * (1 + d + d * d) rows, whatever the input.
    for row in training.mapInPandas(task, "label int, k int, value double").groupBy("label", "k").agg(
            F.sum("value").alias("value")).collect():
        sums[row["label"], row["k"]] = row["value"]
    return {c: (sums[c, 0], sums[c, 1:1 + d], sums[c, 1 + d:].reshape(d, d)) for c in (0, 1)}


def fit(training: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> QuadraticDiscriminant:
    """Fit on all rows of ``training`` (statistics, label 0 or 1).

    A class covariance is shrunk by ``shrinkage`` towards the pooled one and by ``ridge`` towards its diagonal plus
    ``ridge``, so that few rows or constant statistics still give a positive definite matrix. A class without rows takes
    the pooled mean and covariance; without any rows every score is one half.
    """
    training = training.filter("label in (0, 1) and statistics is not null").select("statistics", F.col("label").cast("int").alias("label"))
    moments = _moments(training)
    d = len(STATISTICS)
    n = sum(m[0] for m in moments.values())
    within, means, spreads = np.zeros((d, d)), [], []
    overall = sum(m[1] for m in moments.values()) / max(n, 1)
    for count, total, outer in moments.values():
        mean = total / count if count else overall
        spread = outer - count * np.outer(mean, mean)
        within += spread
        means.append(mean)
        spreads.append(spread / max(count - 1, 1))
    pooled = within / max(n - 2, 1)
    factors, offsets = [], []
    for (count, *_), spread in zip(moments.values(), spreads):
        weight = shrinkage if count > d else 1.0
        mixed = (1 - weight) * spread + weight * pooled
        mixed = (1 - ridge) * mixed + ridge * (np.diag(np.diag(mixed)) + np.eye(d))
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        offsets.append(-np.log(np.diag(lower)).sum() + np.log((count + 1) / (n + 2)))
    model = QuadraticDiscriminant(np.stack(means), np.stack(factors), np.array(offsets))
    return _calibrated(training, model)


def _calibrated(training: DataFrame, model: QuadraticDiscriminant, bins: int = 400) -> QuadraticDiscriminant:
    """Slope and shift of a logistic curve through the classes' histograms of differences (at most 2 * bins rows)."""
    limit = 40.0

    @F.pandas_udf("int")
    def place(column: pd.Series) -> pd.Series:
        d = model.difference(np.stack(column)) if len(column) else np.zeros(0)
        root = np.clip(np.sign(d) * np.sqrt(np.abs(d)), -limit, limit)
        return pd.Series(np.floor((root + limit) / (2 * limit) * (bins - 1)).astype(np.int32))

    found = training.groupBy(place("statistics").alias("place"), "label").count().collect()
    if len({r["label"] for r in found}) < 2:
        return model
    x = np.array([(r["place"] + 0.5) / (bins - 1) * 2 * limit - limit for r in found])
    y, w = np.array([float(r["label"]) for r in found]), np.array([float(r["count"]) for r in found])
    b = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b[0] * x + b[1], -30, 30)))
        rows = np.stack([x, np.ones_like(x)])
        grad = rows @ (w * (y - p)) - 0.1 * b
        hess = (rows * (w * p * (1 - p) + 1e-9)) @ rows.T + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(float(b[0]), 1e-3), float(b[1])
    return model


def scored(statistics_column: Column | str, model: QuadraticDiscriminant) -> Column:
    """Score (0 to 1, higher: likelier label 1) of a column of statistics."""
    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(column)) if len(column) else np.zeros(0))

    return score(statistics_column)


def text_score(text: Column | str, model: QuadraticDiscriminant) -> Column:
    """Score of a column of whole texts, for rows that keep their other columns. Null counts as empty."""
    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(x) for x in column])) if len(column) else np.zeros(0))

    return score(text)


def quality_of_pages(documents: DataFrame, verdicts: DataFrame, held_out: Column, folder) -> DataFrame:
    """Score every page text of ``documents`` (page_id, text) for quality.

    ``verdicts`` (page_id, label) says 1 for good and 0 for bad pages; rows for which the expression ``held_out`` over
    page_id holds are never learned from. Statistics of the whole texts are computed once and kept through ``folder``
    (a function that stores a table); labels meet them by page_id, so texts are not shuffled, and all labelled rows
    count. page_id, site, language and labels are no inputs of a score.

    Returns one row per row with a page_id: page_id, statistics, score. Null texts count as empty. Verdicts that are
    null or neither 0 nor 1 are ignored; a page with several verdicts counts once for each. Other columns are ignored.
    """
    pages = folder(measured(documents), "statistics")
    labels = keyed(verdicts, "page_id", "label").filter(~held_out)
    model = fit(pages.join(labels, "page_id").select("statistics", "label"))
    return pages.withColumn("score", scored("statistics", model))
