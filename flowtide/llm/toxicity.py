"""Toxicity of restored text: a noisy channel undone by Viterbi decoding.

1. A character language model: trigram counts of all texts, summed over partitions.
2. Words that look disguised (letters mixed with look-alike digits and symbols,
   letters repeated three times, letters set apart by spaces, dots, hyphens,
   underscores or stars) become a lattice: each character may stand for itself, for the letters it looks
   like, for a repetition of the letter before, or for nothing. The best path under
   channel and language model is the restored word, whatever its length. In a run of
   letters set apart a word may end after each, so a sentence that is spelled out falls
   into words; at scoring, the words that have weights are also sought inside the run.
   Distinct words are decoded once a task; all other words pass as they are.
3. Restored words and their beginnings get weights: the log ratio of their document
   frequencies in toxic and other training documents, for those that clearly differ.
   A logistic regression on two sums of these weights gives the score.
"""

import math
import re
from os.path import commonprefix
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_and, id_text, packed, python_tasks, stored, table, texts_of

#: Characters and the letters they are used for.
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "*": "aeiou",
}
#: Longer words are not remembered by a task, but decoded each time.
REMEMBERED_BYTES = 256
#: Characters after which a decoder puts out what all its paths agree on.
PIECE = 64
SYMBOLS = 29  # 0 anything else, 1-26 letters, 27 other scripts and accents, 28 digits
#: Labelled documents that the classifier is fitted on at most, by hash of their id.
TRAINING_DOCS = 20_000
CUT = 0.7
PREFIXES = (4, 5, 6, 7)

_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = _CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[ord("0") : ord("9") + 1] = 28
_CODE[128:] = 27

_EDGE = "\"'()[]{}<>.,;:?!¡¿%&#*$|~`^=/\\«»“”‘’„…–—-_+"
_DISGUISED = re.compile(r"([A-Za-z])\1\1|[A-Za-z][._*-][A-Za-z]")
_LETTER, _ALIKE = re.compile(r"[A-Za-z]"), re.compile(r"[0-9@$!|+*]")
#: Marks at the end that follow a letter at once may be letters as well.
_ALIKE_END = re.compile(r"[A-Za-z0-9][@$!|+*]+$")
_MARKS = "".join(c for c in _EDGE if c not in LOOKS_LIKE)
_SPACED = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])(?:[A-Za-z0-9@$!][ ._*-]{1,2}){2,}[A-Za-z0-9@$](?![A-Za-z0-9\x80-\xff])")
_APART = re.compile(rb"[ ._*-]+")
_SPELLED = re.compile(rb"([ ._*-]*)([A-Za-z0-9@$!])")
_RUN = re.compile(rb"(.)\1+")


def _trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in chunks(batches):
        joined = b"  ".join(t or b"" for t in texts_of(batch.column("text")))
        codes = _CODE[np.frombuffer(b"  " + joined + b" ", np.uint8)]
        if len(codes) > 2:
            counts += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from all texts: 29 x 29 x 29."""
    python_tasks(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    counts = np.full(SYMBOLS**3, 0.1)
    for row in counted.collect():  # 24,389 rows at most
        counts[row.trigram] += row.n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(counts / counts.sum(2, keepdims=True))


class Decoder:
    """Viterbi decoding of disguised words."""

    SAME, SWAP, REPEAT, DROP = math.log(0.9), math.log(0.6), math.log(0.7), math.log(0.02)
    DIGIT = math.log(1e-5)  # a digit rarely stands for nothing

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def _options(self, char: str) -> list[tuple[str, float]]:
        if char.isascii() and char.isalpha():
            return [(char, self.SAME)]
        if letters := LOOKS_LIKE.get(char):
            return [(letter, self.SWAP - math.log(len(letters))) for letter in letters]
        return []

    def decode(self, word: str, ends: list[tuple[float, float]] | None = None) -> str:
        """The likeliest plain word behind ``word`` (lower case).

        ``ends`` gives for each character the log chances that a word ends before it
        and that none does; then the result is words with spaces in between.
        """
        model = self.model
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before, done = "", []
        for at, char in enumerate(word):
            if ends and at:
                end, on = ends[at]
                parted = {state: (cost + on, text) for state, (cost, text) in paths.items()}
                for (a, b), (cost, text) in paths.items():
                    value = cost + end + model[a][b][0]
                    if b and ((b, 0) not in parted or value > parted[b, 0][0]):
                        parted[b, 0] = (value, text + " ")
                paths = parted
            options, after = self._options(char), {}
            for (a, b), (cost, text) in paths.items():
                steps = [(b2, cost + channel + model[a][b][b2], letter) for letter, channel in options for b2 in (ord(letter) - 96,)]
                moves = [((b, c), value, text + letter) for c, value, letter in steps]
                if b and (char == before or any(c == b for c, _, _ in steps)):
                    moves.append(((a, b), cost + self.REPEAT, text))
                elif not options or not char.isalpha():
                    moves.append(((a, b), cost + (self.DIGIT if char.isdigit() else self.DROP if options else 0.0), text))
                for state, value, to in moves:
                    if state not in after or value > after[state][0]:
                        after[state] = (value, to)
            paths, before = after or paths, char
            if at % PIECE == PIECE - 1:
                agreed = commonprefix([text for _, text in paths.values()])
                done.append(agreed)
                paths = {state: (cost, text[len(agreed) :]) for state, (cost, text) in paths.items()}
        done.append(max((cost + model[a][b][0], text) for (a, b), (cost, text) in paths.items())[1])
        return "".join(done)

    #: Log chances that a word ends at a gap, and that it does not: by one separator, by more than in other gaps.
    GAP, WIDE = (math.log(0.2), math.log(0.8)), (math.log(0.9), math.log(0.1))

    def spelled(self, run: bytes) -> list[str]:
        """The words of a run of letters that are set apart."""
        gaps, letters = zip(*_SPELLED.findall(run.lower()))
        wide = {len(gap) > 1 for gap in gaps[1:]} == {True, False}
        ends = [self.WIDE if wide and len(gap) > 1 else self.GAP for gap in gaps]
        return self.decode(b"".join(letters).decode(), ends).split()


class Words(dict):
    """Values of words as they stand in texts, found once: ``self[raw]``."""

    def __init__(
        self,
        decoder: Decoder,
        value: Callable[[list[str]], object],
        limit: int = 200_000,
        inside: Callable[[str], list[float]] | None = None,
    ):
        super().__init__()
        self.decoder, self.value, self.limit, self.inside = decoder, value, limit, inside

    def __missing__(self, raw: bytes):
        found = self.value(self.readings(raw))
        if len(raw) <= REMEMBERED_BYTES:
            self[raw] = found
        return found

    def readings(self, raw: bytes) -> list[str]:
        """The word in lower case without its edges; the restored word, if it looked disguised."""
        word = raw.decode("utf-8", "replace").lower()
        plain = word.strip(_EDGE)
        out = [plain] if plain else []
        # Marks at the end are marks, at the beginning they may be letters.
        begun = word.lstrip("\"'([{<.,;:?¡¿%&#~`^=/\\«“‘„…–—-_")
        shown, marked = begun.rstrip(_EDGE), begun.rstrip(_MARKS)
        if _DISGUISED.search(shown) or not shown.isalpha() and _LETTER.search(shown) and _ALIKE.search(shown):
            out.append(self.decoder.decode(shown))
        if marked != shown and _LETTER.search(marked) and _ALIKE_END.search(marked):
            out.append(self.decoder.decode(marked))
        return out

    def of(self, text: bytes) -> tuple[int, list]:
        """Number of words of a text, and the values of its words and of its spelled out words."""
        if len(self) > self.limit:
            self.clear()
        words = text.split()
        values = list(map(self.__getitem__, words))
        for match in _SPACED.finditer(text):
            values.extend(self._spelled(match[0]))
        return len(words), values

    def _spelled(self, run: bytes) -> list:
        """Values of a run as one word and as the words it falls into; with ``inside`` the reading of most weight."""
        joined = _RUN.sub(rb"\1", _APART.sub(b"", run)).decode().lower()
        one, parted = self.decoder.decode(joined), self.decoder.spelled(run)
        whole, apart = [self.value([one, joined])], [self.value([word]) for word in parted]
        if self.inside is None:
            return whole + apart
        return max(whole, apart, self.inside("".join(parted)), self.inside(one), key=sum)


def known_inside(weights: dict[str, float]) -> Callable[[str], list[float]]:
    """A function from letters to the weights of the disjoint known words in them of the greatest sum."""
    known = {word: weight for word, weight in weights.items() if not word.endswith("-")}
    lengths = sorted(set(map(len, known)))

    def inside(letters: str) -> list[float]:
        best, last = [0.0] * (len(letters) + 1), [0] * (len(letters) + 1)
        for end in range(1, len(letters) + 1):
            best[end] = best[end - 1]
            for n in lengths:
                if n > end:
                    break
                total = best[end - n] + known.get(letters[end - n : end], 0.0)
                if total > best[end]:
                    best[end], last[end] = total, n
        out, at = [], len(letters)
        while at:
            if last[at]:
                out.append(best[at] - best[at - last[at]])
            at -= last[at] or 1
        return out

    return inside


def features(readings: list[str]) -> tuple[str, ...]:
    """A word and its beginnings, of each reading."""
    out = []
    for word in readings:
        if len(word) > 2:
            out.append(word)
            out.extend(f"{word[:n]}-" for n in PREFIXES if len(word) > n)
    return tuple(out)


def _document_features(batches: Iterable[pa.RecordBatch], decoder: Decoder) -> Iterator[pa.RecordBatch]:
    words = Words(decoder, features)
    for batch in chunks(batches):
        found, kinds = [], []
        for text, toxic, part in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("part").to_pylist()):
            own = set().union(*set(words.of(text or b"")[1]))
            found.extend(own)
            kinds.extend([2 * part + toxic] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(kinds, pa.int32())], names=["feature", "kind"])


def _sums(n_words: int, values: list[float]) -> tuple[float, float, float]:
    """What the regression sees: the weights found, their density, the strongest."""
    total = sum(values)
    return math.log1p(total), math.log1p(100 * total / (n_words + 10)), max(values, default=0.0)


def _with_sums(batches: Iterable[pa.RecordBatch], decoder: Decoder, weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    words = Words(
        decoder, lambda readings: max((weights.get(f, 0.0) for f in features(readings)), default=0.0), inside=known_inside(weights)
    )
    for batch in chunks(batches):
        rows = [_sums(*words.of(text or b"")) for text in texts_of(batch.column("text"))]
        columns = [pa.array(c, pa.float64()) for c in zip(*rows)]
        others = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in others), *columns], names=[*others, "found", "density", "strongest"]
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients by Newton's method; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """Character model, feature weights and regression; a few MB at most."""

    def __init__(self, decoder: Decoder, weights: dict[str, float], coefficients: np.ndarray):
        self.decoder, self.weights, self.coefficients = decoder, weights, coefficients


def _weights(counts: DataFrame, totals: dict[int, int], parts: tuple[int, ...], least: int = 3, sure: float = 3.0) -> dict[str, float]:
    """Log ratios of the features that stand out in the toxic documents of ``parts``."""
    toxic, other = (sum(totals.get(2 * part + kind, 0) for part in parts) for kind in (1, 0))
    if not toxic or not other:
        return {}
    in_toxic, in_other = (sum(F.col(f"n{2 * part + kind}") for part in parts) for kind in (1, 0))
    p, q = (in_toxic + 0.5) / (toxic + 1), (in_other + 0.5) / (other + 1)
    error = F.sqrt(1 / (in_toxic + 0.5) + 1 / (in_other + 0.5))
    strong = (
        counts.where(in_toxic >= least)
        .withColumn("weight", F.log(p / q))
        .where((F.col("weight") >= 1) & (F.col("weight") / error >= sure))
    )
    # Features of a bounded sample of documents.
    return {r.feature: float(r.weight) for r in strong.collect()}


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAINING_DOCS) -> Model:
    """Fit on labelled documents whose ``crc32(doc_id) mod 3`` is not 1.

    ``most_docs`` of them at most, the first by hash of the id. Each half gives the
    features that the other half is summed up by, and the regression is fitted on
    those sums; the final features come from both. Null labels and ids are left out; a document with
    two labels counts as toxic if one says so. The character model takes all texts.
    Without both kinds of labels every score is the share of toxic ones (0 if none).
    """
    python_tasks(docs.sparkSession)
    decoder = Decoder(character_model(docs))
    digest = F.crc32(F.col("doc_id").cast("string"))
    chosen = stored(
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(F.pmod(digest, F.lit(3)) != 1)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_docs)
        .withColumn("part", F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(2)).cast("int")),
        "toxic-sample",
    )
    # The sample is bounded by most_docs rows of three numbers.
    sample = stored(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").repartition("doc_id"),
        "toxic-texts",
    )
    kind = 2 * F.col("part") + F.col("toxic")
    totals = {r.kind: r.n for r in sample.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = stored(
        sample.select("text", "toxic", "part")
        .mapInArrow(lambda it: _document_features(it, decoder), "feature string, kind int")
        .groupBy("feature")
        .agg(*(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)))
        .where(F.col("n1") + F.col("n3") > 1),
        "toxic-features",
    )
    halves = {part: _weights(counts, totals, (1 - part,)) for part in (0, 1)}
    weights = _weights(counts, totals, (0, 1))

    def summed(part: int) -> DataFrame:
        rows = sample.where(F.col("part") == part).select("text", "toxic")
        return rows.mapInArrow(
            lambda it: _with_sums(it, decoder, halves[part]), "toxic int, found double, density double, strongest double"
        )

    rows = summed(0).union(summed(1)).collect()  # the bounded sample, four numbers each
    data = np.array([tuple(r) for r in rows], float).reshape(-1, 4)
    y = data[:, 0]
    if 0 < y.sum() < len(y):
        return Model(decoder, weights, _fit_logistic(data[:, 1:], y))
    share = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
    return Model(decoder, weights, np.array([math.log(share / (1 - share)), 0, 0, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The struct ``doc`` with all columns of ``docs``, and ``score``: 0 to 1.

    Null and empty texts get the score of a text without any toxic word.
    """
    python_tasks(docs.sparkSession)
    rows = packed(docs).drop("rid")
    decoder, weights, coefficients = model.decoder, model.weights, [float(c) for c in model.coefficients]
    summed = rows.mapInArrow(
        lambda it: _with_sums(it, decoder, weights), doc_and(rows, "found double, density double, strongest double")
    )
    linear = F.lit(coefficients[0])
    for name, weight in zip(("found", "density", "strongest"), coefficients[1:]):
        linear = linear + F.col(name) * F.lit(weight)
    return summed.withColumn("score", 1 / (1 + F.exp(-linear)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(id_text("doc.doc_id")), F.lit(3)) == 1
    return score(docs, model).select(
        "doc.doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the documents of a score of ``cut`` or more."""
    return score(docs, train(docs, labels)).where(F.col("score") < cut).select("doc.*")
