"""Language of texts by hierarchical discrimination: the family first, then duels within it.

A text becomes the square roots of the shares of its character 1- to 3-grams, hashed
(lower case, everything but letters and marks one space, words with their edges), so
every text has length one whatever its size. A softmax regression predicts the language
family. Within a family, each pair of languages has a linear support vector machine
(squared hinge), and the language with the most duels won is the answer.

Training is full-batch on a bounded sample: each round, tasks return the gradients of
all classifiers over their rows, which are summed, and the driver takes an accelerated
gradient step.
"""

import math
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, id_text, python_tasks, stored, table
from .words import mixed

#: Families of languages by ISO 639-1 code (fixed values). A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "jv", "mg", "ms", "su", "tl"),
    "sinitic": ("zh",),
}
BUCKETS = 1 << 15
GRAMS = 3
#: Labelled documents the classifiers are fitted on at most, of each language and together,
#: by hash of their id, and languages they tell apart at most, the most frequent.
PER_LANGUAGE, TRAINING_DOCS, MOST_LANGUAGES = 1500, 12_000, 256
#: Tasks that share the bounded sample.
FIT_TASKS = 6
ROUNDS, RIDGE = 40, 1e-5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, 0 for anything else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all grams, the texts they are of (both ordered by text), and the texts' numbers of letters."""
    kinds = _kinds()
    # A space at both ends; what stands for other characters is a space too.
    padded = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    kind = kinds[points]
    letters = np.bincount(owner[kind == 2], minlength=len(texts))
    inside = kind > 0
    kept = inside.copy()
    # Of a run of spaces the first: after a letter, or at the start of a text.
    kept[1:] |= inside[:-1] | (owner[1:] != owner[:-1])
    kept[:1] = True
    points, owner = np.where(inside, points, 0)[kept].astype(np.uint64), owner[kept]
    found, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(points), np.uint64)
        for n in range(1, GRAMS + 1):
            rolled = rolled[: len(points) - n + 1] * np.uint64(0x110000) + points[n - 1 :]
            whole = owner[: len(rolled)] == owner[n - 1 :]
            if n == 1:
                whole = points > 0
            found.append((mixed(rolled[whole] * np.uint64(4) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[: len(whole)][whole])
    buckets, of = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return buckets[order], of[order], letters


def _vectors(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buckets, their values and the number of letters of each text."""
    buckets, of, letters = gram_buckets(texts)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b, n in zip(ends[:-1], ends[1:], letters.tolist()):
        counts = np.bincount(buckets[a:b], minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield some, np.sqrt(counts[some] / max(1, b - a)).astype(np.float32), n


@dataclass
class Model:
    """Languages by family, and a column of ``weights`` (the last row: bias) for each classifier."""

    families: list[list[str]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @property
    def pairs(self) -> list[tuple[int, str, str]]:
        """Family and languages of each duel, in the order of the columns after the families'."""
        return [(f, a, b) for f, own in enumerate(self.families) for a, b in combinations(own, 2)]

    def predict(self, axes: np.ndarray) -> list[tuple[str, str, float]]:
        """Family, language and score for rows of classifier outputs."""
        n = len(self.families)
        family_axes = axes[:, :n] - axes[:, :n].max(1, keepdims=True)
        chances = np.exp(family_axes)
        chances /= chances.sum(1, keepdims=True)
        pairs = self.pairs
        out = []
        for row, (axis, chance) in enumerate(zip(axes[:, n:], chances)):
            family = int(chance.argmax())
            own = self.families[family]
            won, margins, least = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), dict.fromkeys(own, 1.0)
            for (of, a, b), f in zip(pairs, axis.tolist()):
                if of == family:
                    won[a if f >= 0 else b] += 1
                    for lang, margin in ((a, f), (b, -f)):
                        margins[lang] += margin
                        least[lang] = min(least[lang], 1 / (1 + math.exp(-3 * max(-20.0, min(20.0, margin)))))
            # Most duels won; then by the sum of margins, then the least name.
            best = min(own, key=lambda lang: (-won[lang], -margins[lang], lang))
            out.append((own[0], best, float(chance[family]) * least[best]))
        return out


def family_of(lang: str, families: Mapping[str, Iterable[str]]) -> str:
    return next((name for name, own in families.items() if lang in own), f"={lang}")


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = list(_vectors(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                pa.array([n.astype(np.int32).tobytes() for n, _, _ in found], pa.binary()),
                pa.array([v.tobytes() for _, v, _ in found], pa.binary()),
            ],
            names=["lang", "numbers", "values"],
        )


def _gradient(batches: Iterable[pa.RecordBatch], model: Model, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of the gradients of all classifiers; classes weigh the same in each."""
    weights, pairs = model.weights, model.pairs
    n = len(model.families)
    total = np.zeros_like(weights, dtype=np.float64)
    family = {lang: f for f, own in enumerate(model.families) for lang in own}
    size = [sum(counts[lang] for lang in own) for own in model.families]
    for batch in batches:
        if not batch.num_rows:
            continue
        lang = np.array(batch.column("lang").to_pylist())
        numbers = [np.frombuffer(b, np.int32) for b in batch.column("numbers").to_pylist()]
        values = np.concatenate([np.frombuffer(b, np.float32) for b in batch.column("values").to_pylist()]).astype(float)
        owner = np.repeat(np.arange(len(numbers)), [len(b) for b in numbers])
        flat = np.concatenate(numbers)
        of = np.array([family[x] for x in lang])

        def outputs(column: int) -> np.ndarray:
            return np.bincount(owner, weights[flat, column] * values, len(lang)) + weights[-1, column]

        slopes = np.zeros((len(lang), weights.shape[1]))
        axes = np.column_stack([outputs(f) for f in range(n)])
        chances = np.exp(axes - axes.max(1, keepdims=True))
        chances /= chances.sum(1, keepdims=True)
        chances[np.arange(len(lang)), of] -= 1
        slopes[:, :n] = chances / (n * np.array(size)[of])[:, None]
        for column, (_, a, b) in enumerate(pairs, n):
            side = (lang == a).astype(float) - (lang == b)
            missing = np.maximum(0, 1 - side * outputs(column))
            slopes[:, column] = -side * missing * np.where(side > 0, 1 / counts[a], 1 / counts[b])
        for column in range(weights.shape[1]):
            total[:-1, column] += np.bincount(flat, slopes[owner, column] * values, len(total) - 1)
        total[-1] += slopes.sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["gradient"])


def fit(features: DataFrame, families: Mapping[str, Iterable[str]] = FAMILIES, rounds: int = ROUNDS) -> Model:
    """Fit rows of (``lang``, ``numbers``, ``values``). Without rows there is no language to learn."""
    counts = {r.lang: r["n"] for r in features.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_family: dict[str, list[str]] = {}
    for lang in sorted(counts):
        by_family.setdefault(family_of(lang, families), []).append(lang)
    model = Model([by_family[name] for name in sorted(by_family)])
    if not counts:
        return model
    columns = len(model.families) + len(model.pairs)
    weights = ahead = np.zeros((BUCKETS + 1, columns))
    # Rows have a length of one, and one for the bias: this bounds the curvature.
    step = np.where(np.arange(columns) < len(model.families), 1.0, 0.5)
    momentum = 1.0
    for _ in range(rounds):
        model.weights = ahead.astype(np.float32)
        shared = features.sparkSession.sparkContext.broadcast((model, counts))
        # One row a task of the bounded sample.
        parts = features.mapInArrow(lambda it: _gradient(it, *shared.value), "gradient binary").collect()
        gradient = sum(np.frombuffer(bytes(r.gradient), np.float32).reshape(weights.shape).astype(float) for r in parts)
        following = ahead - step * (gradient + RIDGE * ahead)
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = following + (momentum - 1) / after * (following - weights)
        weights, momentum = following, after
        shared.destroy()
    model.weights = weights.astype(np.float32)
    return model


def train(
    docs: DataFrame,
    families: Mapping[str, Iterable[str]] = FAMILIES,
    per_language: int = PER_LANGUAGE,
    most_docs: int = TRAINING_DOCS,
    rounds: int = ROUNDS,
) -> Model:
    """Learn the languages (``lang``) of ``docs`` (``doc_id``, ``text``, ``lang``).

    Rows of a null language or without a letter teach nothing. At most ``per_language``
    documents of a language and ``most_docs`` in all are used, the first by hash of the
    id; of repeated ids and rows any may count.
    """

    python_tasks(docs.sparkSession)
    labelled = docs.where(r"lang IS NOT NULL AND text RLIKE '\\p{L}'").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = stored(counts, "languages")
    hashed = F.xxhash64("doc_id", "text")
    # A cut by the hash leaves about twice the rows that are wanted; MOST_LANGUAGES rows are broadcast.
    drawn = (
        labelled.withColumn("hash", hashed)
        .join(F.broadcast(counts), "lang")
        .where(F.col("hash").cast("double") / float(1 << 64) + 0.5 <= (2.0 * per_language + 20) / F.col("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
        .where(F.col("rank") <= per_language)
        .orderBy("rank", "hash")
        .limit(most_docs)
    )
    features = drawn.select("lang", "text").repartition(FIT_TASKS).mapInArrow(_features, "lang string, numbers binary, values binary")
    return fit(stored(features, "features"), families, rounds)


OUT = [("lang_pred", pa.string()), ("family", pa.string()), ("score", pa.float64())]


def _identified(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = batch.column("text").to_pylist()
        out: list = [(UNKNOWN, None, 0.0)] * len(texts)
        if model.families:
            axes, lettered = [], []
            for i, (numbers, values, letters) in enumerate(_vectors(texts)):
                if letters:
                    axes.append(values @ model.weights[numbers] + model.weights[-1])
                    lettered.append(i)
            if lettered:
                for i, (first, lang, score) in zip(lettered, model.predict(np.array(axes, float))):
                    out[i] = (lang, first, score)
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out), OUT)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", *(name for name, _ in OUT)])


def identify(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """The struct ``doc`` of the columns ``keep``, ``lang_pred``, ``family``, ``score`` for each row of ``docs``.

    ``score`` is the chance of the family times the least confident duel of the language
    within it. ``family`` is named by its first language. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if no language was learned. Ties
    of duels go by the sum of their margins, then to the least name.
    """

    python_tasks(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("doc"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL("lang_pred string, family string, score double").fields])
    return rows.mapInArrow(lambda it: _identified(it, shared.value), schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(id_text().cast("binary")) % 4 == 2
    model = train(docs.where(~held_out))
    named = identify(docs, model, F.col("doc_id"), held_out.alias("held_out"))
    return named.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "family")
