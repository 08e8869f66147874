"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of a document's whole text are transformed to be roughly normal. Each
class gets a mean and a covariance shrunk towards its diagonal; the score is the
logistic of the calibrated difference of the two log densities, computed from
Mahalanobis distances with Cholesky factors that are inverted once at fitting.

Defined results: null and empty texts have the statistics of no words and get a
score like any other; repeated rows get equal scores; an id with clashing labels
has the greater one, and of a labelled id that many documents have, the one with
the least statistics is read; without labels of both classes the model is the
neutral one, whose score is 0.5 for every text; an empty table has no scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, record_batches, text_or_empty

FIT_ROWS = 6000
SHRINKAGE = 0.1
#: Words at which a text's own statistics weigh as much as those of the usual good text.
SMOOTHING = 12.0
WORDS = re.compile(WORD)

# Classes of characters, as code points.
_UPPER, _LETTER, _DIGIT, _STOP, _SYMBOL = 1, 2, 3, 4, 5


def _kind(c: int) -> int:
    x = chr(c)
    if x.isupper():
        return _UPPER
    if x.isalpha():
        return _LETTER
    if x.isdigit():
        return _DIGIT
    if x in ".,;:'\"-()?":
        return _STOP
    return _SYMBOL if c > 32 and not x.isspace() else 0


class _Kinds:
    """The class of every code point, worked out for 256 neighbours when one of them is first seen."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint8)
        self.known = np.zeros(0x1100, bool)
        self.learn(range(0x30))

    def learn(self, rows) -> None:
        for row in rows:
            self.table[row << 8 : (row + 1) << 8] = [_kind(c) for c in range(row << 8, (row + 1) << 8)]
            self.known[row] = True

    def of(self, points: np.ndarray) -> np.ndarray:
        if len(points) and points.max() >= 0x3000:
            rows = np.unique(points >> 8)
            self.learn(rows[~self.known[rows]].tolist())
        return self.table[points]


_KINDS = _Kinds()
FEATURES = ("words", "word_length", "length_spread", "upper", "digits", "stops", "symbols", "distinct", "top_word", "runs", "line_length", "lines_repeated", "short_words", "sentence_length", "capital_words", "bigrams_repeated")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text, in the order of ``FEATURES``."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KINDS.of(points), minlength=6)
    chars = max(1, int(kinds[1:].sum()))
    rate = lambda k: float(np.log(k / chars + 1e-3))
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    runs = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return [
        float(np.log1p(n)),
        float(np.log(sizes.mean())),
        float(np.log1p(sizes.std())),
        rate(kinds[_UPPER]),
        rate(kinds[_DIGIT]),
        rate(kinds[_STOP]),
        rate(kinds[_SYMBOL]),
        float(np.log(len(seen)) / max(1.0, np.log(n + 1))),
        float(np.log(max(seen.values()) / n + 1e-2)),
        float(np.log(runs / n + 1e-3)),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log((len(lines) - len(set(lines))) / max(1, len(lines)) + 1e-2)),
        float(np.log((sizes <= 3).mean() + 1e-2)),
        float(np.log1p(n / (1 + text.count(".")))),
        float(np.log(kinds[_UPPER] / n + 1e-2)),
        float(np.log(1 - pairs / max(1, n - 1) + 1e-2)),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and half log determinants of two classes, and the calibration."""

    usual: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    inverse_factors: tuple[np.ndarray, ...]
    half_logdets: tuple[float, ...]
    slope: float
    offset: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0."""
        z = (smoothed(x, self.usual) - self.centre) / self.scale
        parts = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - h for m, f, h in zip(self.means, self.inverse_factors, self.half_logdets, strict=True)]
        return parts[1] - parts[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.offset, -30, 30)))


def smoothed(x: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Statistics without the number of words, drawn towards ``usual`` in short texts: they have little evidence."""
    n = np.expm1(x[:, :1])
    return usual + n / (n + SMOOTHING) * (x[:, 1:] - usual)


_N = len(FEATURES) - 1
NEUTRAL = Model(np.zeros(_N), np.zeros(_N), np.ones(_N), (np.zeros(_N),) * 2, (np.eye(_N),) * 2, (0.0, 0.0), 0.0, 0.0)


def held_part(y: np.ndarray, least: int = 20) -> np.ndarray:
    """Every fifth row, for calibration; all rows where that leaves a class with fewer than ``least``."""
    held = np.arange(len(y)) % 5 == 4
    return held if min((y[held] == 0).sum(), (y[held] == 1).sum()) >= least else np.ones(len(y), bool)


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Model:
    """Class Gaussians by shrinkage, then a logistic calibration of their margin on rows held out of them."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return NEUTRAL
    held = held_part(y)
    if held.all():
        return _fit(x, y, x, y, shrinkage)
    return _fit(x[~held], y[~held], x[held], y[held], shrinkage)


def _fit(x: np.ndarray, y: np.ndarray, x_held: np.ndarray, y_held: np.ndarray, shrinkage: float) -> Model:
    usual = np.median(x[y == 1], axis=0)[1:]
    own = smoothed(x, usual)
    centre, scale = own.mean(0), own.std(0) + 1e-6
    z = (own - centre) / scale
    means, factors, dets = [], [], []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own.T)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + 1e-2 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        means.append(own.mean(0))
        factors.append(np.linalg.inv(factor))
        dets.append(float(np.log(np.diag(factor)).sum()))
    raw = Model(usual, centre, scale, tuple(means), tuple(factors), tuple(dets), 1.0, 0.0)
    x, y = x_held, y_held
    m = np.clip(raw.margins(x), -60, 60)
    a, b = 0.1, float(np.log((y == 1).sum() / (y == 0).sum()))
    for _ in range(50):  # Newton steps of a logistic regression on the margin
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return Model(usual, centre, scale, tuple(means), tuple(factors), tuple(dets), float(a), float(b))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, each: bool = False) -> DataFrame:
    """(doc_id, text, label_) of at most ``rows`` labelled doc_ids (``each``: of each class), chosen by their hash.

    Only the ids are sorted; the texts of the chosen ids are then looked up in
    one scan. An id with clashing labels has the greater one. A doc_id that
    occurs in several documents gives several rows here: callers reduce them to
    one before anything reaches the driver.
    """
    known = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label_"))
    parts = [known.where(F.col("label_") == c) for c in (0, 1)] if each else [known]
    chosen = [p.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for p in parts]
    ids = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * `rows` pairs of numbers


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model from at most ``rows`` labelled doc_ids outside the held-out fold, one document of each."""
    sample = labelled_sample(docs, labels, "quality", fold(3) != 1, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    measured = sample.select("doc_id", "text", F.col("label_").cast("int")).mapInArrow(run, f"doc_id {ids}, y int, x array<double>")
    found = measured.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).collect()
    if not found:
        return NEUTRAL
    found.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    return fit(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]))


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row. Texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {ids}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    picked = score_table(docs, fitted(docs, labels))
    return picked.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    model, names = fitted(docs, labels), docs.columns
    spot = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            x = np.array([statistics(t) for t in batch.column(spot).to_pylist()])
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
