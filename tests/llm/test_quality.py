"""The discriminant against a plain one, and vocabularies that are refused."""
import random

import numpy as np
import public_tokenizers
import pytest

from shopaudit.llm import pieces, quality


def sample(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 150))
        label = int(rng.random() < 0.7)
        rows.append((" ".join(w if label or rng.random() < 0.8 else w.upper() + "!" for w in text) + "." * rng.randint(0, 3), label))
    return rows


def plain_differences(x, y, rows, shrinkage, ridge):
    """Log density of class 1 less that of class 0, straight from the definition."""
    classes = [x[y == c] for c in (0, 1)]
    spreads = [np.cov(part.T) for part in classes]
    pooled = sum((len(part) - 1) * spread for part, spread in zip(classes, spreads)) / (len(x) - 2)
    out = []
    for part, spread in zip(classes, spreads):
        mixed = (1 - shrinkage) * spread + shrinkage * pooled
        mixed = (1 - ridge) * mixed + ridge * (np.diag(np.diag(mixed)) + np.eye(len(mixed)))
        away = rows - part.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(mixed), away)
        out.append(-0.5 * distance - 0.5 * np.linalg.slogdet(mixed)[1] + np.log((len(part) + 1) / (len(x) + 2)))
    return out[1] - out[0]


def test_discriminant_against_a_plain_one(spark):
    rows = sample(400, 2)
    x, y = np.array([quality.statistics(t) for t, _ in rows]), np.array([c for _, c in rows])
    training = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y.tolist())] + [(None, 1), (x[0].tolist(), 5), (x[1].tolist(), None)],
                                     "statistics array<double>, label int").repartition(3)
    model = quality.fit(training)
    unseen = np.array([quality.statistics(t) for t in [t for t, _ in sample(80, 3)] + ["", None, "word " * 20_000]])
    want = plain_differences(x, y, unseen, quality.SHRINKAGE, quality.RIDGE)
    assert np.allclose(model.difference(unseen), want, rtol=1e-6, atol=1e-6)
    signed = np.sign(want) * np.sqrt(np.abs(want))
    assert np.allclose(model.score(unseen), 1 / (1 + np.exp(-np.clip(model.slope * signed + model.shift, -40, 40))), atol=1e-6)
    got = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unseen)], "i int, statistics array<double>")
    scores = [r["score"] for r in got.withColumn("score", quality.scored("statistics", model)).orderBy("i").collect()]
    assert np.allclose(scores, model.score(unseen))


def test_a_class_without_rows(spark):
    """One class only: its mean and spread stand for both; no rows: one half everywhere."""
    x = [quality.statistics(t).tolist() for t, _ in sample(50, 4)]
    schema = "statistics array<double>, label int"
    one = quality.fit(spark.createDataFrame([(v, 1) for v in x], schema)).score(np.array(x))
    none = quality.fit(spark.createDataFrame([], schema)).score(np.array(x))
    assert (one > 0.5).all() and np.allclose(none, 0.5)


def test_a_vocabulary_that_normalises_is_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x1a\x03\x12\x01x")
    with pytest.raises(ValueError, match="normalisations"):
        pieces.read_vocabulary(str(path))
    assert pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")).pieces
