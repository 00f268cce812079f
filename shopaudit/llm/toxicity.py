"""Toxicity of page texts by compression distance to two zstandard dictionaries."""
from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches, worker_cache

SAMPLE_PAGES = 4000
SAMPLE_ROWS = 50_000
ORDINARY_WORDS = 20_000
#: Marks and their forms that travel to the driver; the toxic dictionary takes far fewer.
TOXIC_WORDS = 5000
#: Bytes of a part of a window that can be a mark; a whole window always can.
PART_BYTES = (4, 12)
DICTIONARY_BYTES = (16_384, 2048)
LEVEL = 9
WINDOW_BYTES = 48
EDGES = b".,;:!?#$%&*|()[]{}<>\"'"
#: Follows every window: compresses to the same few bytes everywhere, so that zstandard never stores a short window raw.
TAIL = bytes(64)
GAINS = (3, 4, 5)
FEATURES = 2 + len(GAINS)
CACHE_WINDOWS = 400_000


def windows(text: str | None) -> Counter:
    """How often each window occurs in a whole text: its words in lower case without edge marks, long ones cut."""
    out: Counter = Counter()
    for word, n in Counter((text or "").encode("utf-8", "replace").lower().split()).items():
        word = word.strip(EDGES)
        for start in range(0, len(word), WINDOW_BYTES):
            out[word[start:start + WINDOW_BYTES]] += n
    return out


class Distance:
    """Bytes that the toxic dictionary saves on a window against the ordinary one; 0 where it finds nothing."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self.coder(ordinary), self.coder(toxic)
        # What a window of each length takes when the toxic dictionary has nothing of it.
        self.nothing = [self.toxic(bytes(128 + 37 * i % 127 for i in range(n))) for n in range(WINDOW_BYTES + 1)]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def coder(dictionary: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if dictionary:
            data = zstandard.ZstdCompressionDict(dictionary)
            data.precompute_compress(level=LEVEL)
            options["dict_data"] = data
        compress = zstandard.ZstdCompressor(**options).compress
        return lambda window: len(compress(b" " + window + b" " + TAIL))

    def gain(self, window: bytes) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= CACHE_WINDOWS:
                self.known.clear()
            toxic = self.toxic(window)
            found = max(0, self.ordinary(window) - toxic) if toxic <= self.nothing[len(window)] - GAINS[0] else 0
            self.known[window] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Windows with each gain and the number of windows, on a log scale, and whether any gains."""
        found = windows(text)
        hits = [0] * len(GAINS)
        for window, n in found.items():
            gain = self.gain(window)
            if gain >= GAINS[0]:
                for i, least in enumerate(GAINS):
                    hits[i] += n * (gain >= least)
        return [float(hits[0] > 0), math.log1p(sum(found.values()))] + [math.log1p(n) for n in hits]


@dataclass
class CompressionClassifier:
    """The two dictionaries and the logistic curve that calibrates their distances."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def distance(self) -> Distance:
        key = ("toxicity", hashlib.sha256(self.ordinary + self.toxic).hexdigest())
        cache = worker_cache()
        if key not in cache:
            cache[key] = Distance(self.ordinary, self.toxic)
        return cache[key]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -40, 40)))


def sampled(verdicts: DataFrame, pages: int) -> DataFrame:
    """At most ``pages`` labelled rows of each class, those of the smallest hash."""
    order = F.xxhash64("page_id")
    parts = [verdicts.filter(F.col("label") == c).orderBy(order, "page_id").limit(pages) for c in (0, 1)]
    return parts[0].union(parts[1])


def _contexts(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(window, toxic, ordinary): the distinct neighbourhoods of each window in toxic and ordinary pages.

    Neighbourhoods instead of occurrences, so that copies of a page count once.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = [w.strip(EDGES)[:WINDOW_BYTES] for w in (text.as_py() or "").encode("utf-8", "replace").lower().split()]
                seen.update((w, a, e, label) for a, w, e in zip([b""] + words, words, words[1:] + [b""]) if w)
            rows = [(w, int.from_bytes(hashlib.blake2b(a + b" " + e, digest_size=8).digest(), "little", signed=True), x)
                    for w, a, e, x in seen]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.int32())], ["window", "around", "label"])

    # The chosen ids are bounded by twice SAMPLE_PAGES, so they may be broadcast.
    texts = documents.join(F.broadcast(chosen), "page_id").select("text", F.col("label").cast("int").alias("label"))
    found = texts.mapInArrow(task, "window binary, around long, label int").distinct()
    return found.groupBy("window").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))


def _parts(counts: DataFrame) -> DataFrame:
    """(window, toxic, ordinary, part): every window with each of its parts of PART_BYTES and with itself."""
    least, most = PART_BYTES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                own = {w[k:e] for k in range(len(w)) for e in range(k + least, min(len(w), k + most) + 1)} | {w}
                at += [i] * len(own)
                parts += own
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(parts, pa.binary())], ["window", "toxic", "ordinary", "part"])

    return counts.select("window", "toxic", "ordinary").mapInArrow(task, "window binary, toxic long, ordinary long, part binary")


def _marks(counts: DataFrame, toxic_sum: float, ordinary_sum: float) -> list[tuple[bytes, int]]:
    """The marks of toxic pages and the windows that hold them, with their toxic neighbourhoods, commonest first.

    A part of a window, or a whole one, can be a mark if it passes the test of ``dictionaries`` over all windows that hold
    it. Each window goes to the surest of its parts, by the lower limit of the odds, and a mark must pass again by the
    windows that went to it; so a fragment of a mark is none itself, and the forms of one stem count together.
    """
    odds = F.log((F.col("toxic") + 0.5) / (toxic_sum + 1)) - F.log((F.col("ordinary") + 0.5) / (ordinary_sum + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("ordinary") + 0.5))
    passes = (odds > 2) & (odds > 3 * error)
    parts, sums = _parts(counts), [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    good = parts.groupBy("part").agg(*sums).filter(passes).select("part", (odds - 2 * error).alias("surety"))
    # What passes comes from the bounded sample of pages, so it may be broadcast.
    chosen = parts.join(F.broadcast(good), "part").groupBy("window", "toxic", "ordinary").agg(
        F.max(F.struct("surety", F.length("part").alias("size"), "part"))["part"].alias("mark"))
    marks = chosen.groupBy("mark").agg(*sums).filter(passes).select("mark", "toxic")
    forms = chosen.filter("toxic > 0").join(F.broadcast(marks.select("mark")), "mark", "left_semi").select("window", "toxic")
    rows = marks.union(forms).orderBy(F.desc("toxic"), "mark").limit(TOXIC_WORDS).collect()
    return [(bytes(r["mark"]), r["toxic"]) for r in rows]


def dictionaries(documents: DataFrame, verdicts: DataFrame, pages: int = SAMPLE_PAGES, folder=None) -> tuple[bytes, bytes]:
    """Train the ordinary and the toxic dictionary on at most ``pages`` labelled pages of each class.

    Toxic text is what marks toxic pages: words and parts of words seen in neighbourhoods of toxic pages far more often
    than in those of ordinary ones (log odds over 2, over 3 standard errors), however often others are seen, and the words
    that hold them. Ordinary text is the commonest windows of ordinary pages. Both lists are bounded.
    """
    counts = _contexts(documents, sampled(verdicts, pages))
    counts = folder(counts, "windows") if folder else counts
    sums = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    marks = _marks(counts, *(float(x or 0) for x in sums))
    common = counts.filter("ordinary > 0").orderBy(F.desc("ordinary"), "window").limit(ORDINARY_WORDS).collect()
    return (_trained([(bytes(r["window"]), r["ordinary"]) for r in common], DICTIONARY_BYTES[0]),
            _trained(marks, DICTIONARY_BYTES[1]))


def _trained(words: list[tuple[bytes, int]], size: int) -> bytes:
    """A dictionary trained on phrases of the words, each as often as its share says; empty without enough text."""
    if not words:
        return b""
    total = sum(n for _, n in words)
    bag = [w for w, n in words for _ in range(max(1, round(20_000 * n / total)))]
    order = np.random.default_rng(7).permutation(len(bag))
    phrases = [b" " + b" ".join(bag[i] for i in order[at:at + 4]) + b" " for at in range(0, len(bag), 4)]
    try:
        return zstandard.train_dictionary(size, phrases).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(w for w, _ in reversed(words))[-size:]


def measured(documents: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(page_id, features) of every row with a page_id. One narrow pass over the texts."""
    small_batches(documents.sparkSession)
    model = CompressionClassifier(ordinary, toxic, np.zeros(FEATURES + 1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = model.distance()
        for batch in batches:
            rows = [distance.features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["page_id", "features"])

    return keyed(documents, "page_id", "text").withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(
        task, "page_id long, features array<double>")


def calibrate(ordinary: bytes, toxic: bytes, labelled: DataFrame) -> CompressionClassifier:
    """Logistic curve over at most SAMPLE_ROWS rows (page_id, features, label), those of the smallest hash."""
    rows = (labelled.filter("label in (0, 1)").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_ROWS)
            .select("features", "label").collect())
    x = np.array([[1.0, *r["features"]] for r in rows]).reshape(len(rows), FEATURES + 1)
    y = np.array([float(r["label"]) for r in rows])
    weights = np.zeros(FEATURES + 1)
    ridge = np.diag([1e-6] + [1e-2] * FEATURES)
    for _ in range(50 if len(set(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ weights)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if len(y) and len(set(y)) < 2:
        weights[0] = 4.0 if y[0] else -4.0
    return CompressionClassifier(ordinary, toxic, weights)


def scored(features: Column | str, model: CompressionClassifier) -> Column:
    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(column)) if len(column) else np.zeros(0))

    return score(features)


def text_score(text: Column | str, model: CompressionClassifier) -> Column:
    """Score of a column of whole texts, for rows that keep their other columns. Null counts as empty."""
    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        distance = model.distance()
        return pd.Series(model.score(np.array([distance.features(x) for x in column])) if len(column) else np.zeros(0))

    return score(text)


def toxicity_of_pages(documents: DataFrame, verdicts: DataFrame, held_out: Column, calibrated_on: Column, folder
                      ) -> tuple[DataFrame, CompressionClassifier]:
    """Score every page text of ``documents`` (page_id, text) for toxicity.

    ``verdicts`` (page_id, label) says 1 for toxic and 0 for ordinary pages. Rows for which the expression ``held_out``
    over page_id holds are never learned from; of the others those of ``calibrated_on`` fit the curve and the rest the
    dictionaries, from bounded samples (SAMPLE_PAGES of each class, SAMPLE_ROWS). Each whole text is read as windows of
    a word; a window counts where the toxic dictionary compresses it better than the ordinary one by 3, 4 or 5 bytes.
    page_id, site, language and labels are no inputs of a score.

    Returns (page_id, features, score) with one row per row with a page_id, and the classifier. Null texts count as
    empty. Without labels of both classes all scores are alike. Other columns are ignored. ``folder`` stores a table.
    """
    labels = keyed(verdicts, "page_id", "label").filter(~held_out).filter("label in (0, 1)")
    texts = keyed(documents, "page_id", "text")
    ordinary, toxic = dictionaries(texts, labels.filter(~calibrated_on), folder=folder)
    pages = folder(measured(documents, ordinary, toxic), "features")
    model = calibrate(ordinary, toxic, pages.join(labels.filter(calibrated_on), "page_id"))
    return pages.withColumn("score", scored("features", model)), model
