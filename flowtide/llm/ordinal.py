"""Ordinal quality: cumulative-link regression on graded ratings with hashed words.

One weight vector ``w`` over hashed words is shared by all grades; ordered thresholds
cut its axis::

    P(grade >= k | text) = sigmoid(w . x(text) - t_k),  t_1 < t_2 < ...

so every text gets an expected grade and the tail probability of each grade. ``x``
averages over the words of a text: buckets of the word, of its shape (letters, case,
symbols at its ends) and of its repetition (a word that equals the one before).
Training is full-batch: each round, tasks return the gradient over their rows, which
is summed, and the driver takes an Adam step on the bounded parameters.
"""

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_and, packed, python_tasks, stored, table, texts_of

BUCKETS = 1 << 14
#: Rated documents that the regression is fitted on at most, by hash of their id.
TRAINING_DOCS = 20_000
ROUNDS, STEP, RIDGE = 40, 0.3, 1e-4
#: A document is kept if it is at least of this grade with this probability.
KEEP_GRADE, KEEP_CHANCE = 1, 0.5
REMEMBERED = 400_000
SCALE = 10.0

_SHAPES = (
    (re.compile(rb"[A-Z]+[^A-Za-z]*"), "caps"),
    (re.compile(rb"[^A-Za-z0-9\x80-\xff]+"), "symbols"),
    (re.compile(rb".*[#*$%&|<>]"), "noise"),
    (re.compile(rb".*!!+"), "shout"),
    (re.compile(rb".*[.?!]"), "end"),
    (re.compile(rb".*[0-9].*"), "digit"),
    (re.compile(rb"[A-Z\xc0-\xff].*"), "title"),
)


def _bucket(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text) % BUCKETS


def word_buckets(word: bytes) -> tuple[int, int]:
    """The bucket of a word's letters, and that of its shape."""
    shape = next((name for pattern, name in _SHAPES if pattern.fullmatch(word)), "plain")
    letters = word.lower().strip(b".,;:!?\"'()#*$%&|<>") or word
    return _bucket(letters), _bucket(b"\x00shape:" + shape.encode())


REPEATED, SHORT = _bucket(b"\x00repeated"), _bucket(b"\x00short")


class Buckets(dict):
    def __missing__(self, word: bytes):
        found = self[word] = word_buckets(word)
        return found


def _vector(words: list[bytes], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values for a text; none without words."""
    if not words:
        return np.array([SHORT]), np.array([SCALE])
    both = np.array([buckets[w] for w in words], np.int64)
    again = sum(map(bytes.__eq__, words, words[1:]))
    numbers, counts = np.unique(both, return_counts=True)
    values = counts * (SCALE / len(words))
    return np.append(numbers, [REPEATED, SHORT]), np.append(values, [again * SCALE / len(words), SCALE / (1 + len(words) / 10)])


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = Buckets()
    for batch in chunks(batches):
        if len(buckets) > REMEMBERED:
            buckets.clear()
        found = [_vector((t or b"").split(), buckets) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("grade"),
                pa.array([n.astype(np.int32).tobytes() for n, _ in found], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
            ],
            names=["grade", "numbers", "values"],
        )


def _gradient(batches: Iterable[pa.RecordBatch], weights: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Loss, rows, and gradients of the negative log likelihood of the rows' grades."""
    by_weight, by_cut, loss, rows = np.zeros(len(weights)), np.zeros(len(cuts)), 0.0, 0
    padded = np.concatenate([[-np.inf], cuts, [np.inf]])
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [np.frombuffer(b, np.int32) for b in batch.column("numbers").to_pylist()]
        values = np.concatenate([np.frombuffer(b, np.float32) for b in batch.column("values").to_pylist()]).astype(float)
        grade = batch.column("grade").to_numpy()
        owner = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
        flat = np.concatenate(numbers)
        axis = np.bincount(owner, weights[flat] * values, len(numbers))
        # P(grade) = F(axis - lower) - F(axis - upper)
        low, high = _sigmoid(axis - padded[grade]), _sigmoid(axis - padded[grade + 1])
        p = np.maximum(low - high, 1e-12)
        dlow, dhigh = low * (1 - low), high * (1 - high)
        slope = -(dlow - dhigh) / p
        by_weight += np.bincount(flat, slope[owner] * values, len(weights))
        both = np.bincount(grade, dlow / p, len(cuts) + 1)[1:]
        by_cut += both - np.bincount(grade, dhigh / p, len(cuts) + 1)[:-1]
        loss -= np.log(p).sum()
        rows += len(grade)
    yield pa.RecordBatch.from_arrays(
        [pa.array([loss]), pa.array([rows], pa.int64()), pa.array([by_weight.tobytes()]), pa.array([by_cut.tobytes()])],
        names=["loss", "n", "by_weight", "by_cut"],
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights (``BUCKETS`` numbers) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts


def _cuts(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then log gaps."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def fit(vectors: DataFrame, shares: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit rows of (``grade``, ``numbers``, ``values``); ``shares`` are those of the grades."""
    spark = vectors.sparkSession
    tails = np.clip(np.cumsum(shares[::-1])[::-1][1:], 1e-4, 1 - 1e-4)
    start = -np.log(tails / (1 - tails))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    theta = np.concatenate([np.zeros(BUCKETS), free])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, cuts = theta[:BUCKETS], _cuts(theta[BUCKETS:])
        shared = spark.sparkContext.broadcast((weights, cuts))
        # One row of BUCKETS numbers a task of the bounded sample.
        parts = vectors.mapInArrow(lambda it: _gradient(it, *shared.value), "loss double, n long, by_weight binary, by_cut binary").collect()
        n = max(1, sum(r.n for r in parts))
        by_weight = sum(np.frombuffer(bytes(r.by_weight)) for r in parts) / n + RIDGE * weights
        by_cut = sum(np.frombuffer(bytes(r.by_cut)) for r in parts) / n
        after = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all later thresholds
        gradient = np.concatenate([by_weight, after[:1], after[1:] * np.exp(theta[BUCKETS + 1 :])])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta - STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        shared.destroy()
    return Model(theta[:BUCKETS], _cuts(theta[BUCKETS:]))


def train(docs: DataFrame, ratings: DataFrame, grades: int, most_docs: int = TRAINING_DOCS) -> Model:
    """Fit ``ratings`` (``doc_id``, ``grade`` from 0 to ``grades - 1``) of ``docs``.

    ``most_docs`` ratings at most, the first by hash of the id; null ids and grades
    are left out; of two ratings the lower counts. Without ratings all grades are equally
    likely.
    """
    python_tasks(docs.sparkSession)
    chosen = stored(
        ratings.where("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_docs),
        "ratings",
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most most_docs rows of two numbers.
    rated = texts.join(F.broadcast(chosen), "doc_id").select("grade", "text").repartition(spark_tasks(docs))
    vectors = stored(rated.mapInArrow(_vectors, "grade int, numbers binary, values binary"), "vectors")
    counts = {r.grade: r["n"] for r in vectors.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = np.array([counts.get(g, 0) + 0.5 for g in range(grades)])
    return fit(vectors, shares / shares.sum(), ROUNDS if counts else 0)


def spark_tasks(df: DataFrame) -> int:
    """Tasks for the bounded sample."""
    return max(1, min(8, df.sparkSession.sparkContext.defaultParallelism))


def _axis(batches: Iterable[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    class Worth(dict):
        def __missing__(self, word: bytes) -> float:
            a, b = word_buckets(word)
            worth = self[word] = float(weights[a] + weights[b])
            return worth

    worth = Worth()
    repeated, short = float(weights[REPEATED]), float(weights[SHORT])
    for batch in chunks(batches):
        if len(worth) > REMEMBERED:
            worth.clear()
        out = []
        for text in texts_of(batch.column("text")):
            words = (text or b"").split()
            n = len(words)
            if not n:
                out.append(SCALE * short)
                continue
            again = sum(map(bytes.__eq__, words, words[1:]))
            total = math.fsum(map(worth.__getitem__, words)) + again * repeated
            out.append(SCALE * (total / n + short / (1 + n / 10)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.float64())], names=["doc", "axis"])


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """The struct ``doc``, ``expected_grade``, and ``p_ge_1``, ``p_ge_2``, ... for each threshold.

    Null and empty texts have the grade of a text without words.
    """
    python_tasks(docs.sparkSession)
    rows = packed(docs).drop("rid")
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    out = rows.mapInArrow(lambda it: _axis(it, weights.value), doc_and(rows, "axis double"))
    tails = [1 / (1 + F.exp(-(F.col("axis") - F.lit(float(c))))) for c in model.cuts]
    expected = sum(tails[1:], tails[0])
    return out.select("doc", expected.alias("expected_grade"), *(p.alias(f"p_ge_{k + 1}") for k, p in enumerate(tails)))


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of ``labels``: 0 poor, 1 good but toxic, 2 good and not toxic."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("grade"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, ratings_of(table(spark, sf_dir, "labels")), 3)
    graded = grade(docs, model)
    kept = F.col(f"p_ge_{KEEP_GRADE}") >= KEEP_CHANCE
    return graded.select("doc.doc_id", "expected_grade", "p_ge_1", "p_ge_2", kept.alias("kept"))
