"""A hidden Markov language model, trained and applied by partitions.

Tokens are the lower-cased words of a text and one end. The model's alphabet is
bounded whatever the vocabulary: the ``HEADS`` most frequent tokens are classes of
their own, every other token belongs to one of ``TAILS`` classes by a hash of its
last three bytes. A latent state emits a class, and the class emits the token by
its add-one count::

    P(token | state) = P(class | state) * (count + 1) / (tokens + types + 1 of the class)

1. Token counts of the training texts: partial counts in Python tasks, summed by
   token. All tokens count; nothing is cut off.
2. Texts become rows of class numbers with their rarer tokens, stored once.
3. Baum-Welch: each round, tasks run the scaled forward-backward recursion over
   batches of segments and return expected counts of the classes that they saw, which
   are summed over partitions in two steps: first those of some tasks, then all.
   (For training only, texts are cut into segments of ``SEGMENT`` tokens; later
   segments of a text start from the overall shares of the states.)
4. The scaled forward recursion over whole texts gives their exact likelihood; the
   counts of rarer tokens join in by token.
"""

from collections import Counter
from collections.abc import Iterable, Iterator
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_text, numbered, python_tasks, stored, table, texts_of

TAILS = 1 << 10
HEADS = (1 << 16) - TAILS
#: Rarer tokens are no heads: what a state emits is learned for their class instead.
HEAD_COUNT = 10
STATES, ROUNDS = 8, 5
SEGMENT, TOGETHER = 512, 512
#: A state's counts are smoothed with the overall shares of the classes, to the weight
#: of this many tokens for each class seen in it, and of ``PRIOR`` tokens at least.
NEW, PRIOR = 1.5, 200.0
#: Cells of a padded batch of texts in the forward recursion.
CELLS = 4_000_000
BLOCK = 1 << 10
COUNTED = 250_000
END = b""


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "n"]
        )
        counts.clear()
        return out

    for batch in chunks(batches):
        for text in texts_of(batch.column("text")):
            counts.update(text.lower().split())
        counts[END] += batch.num_rows
        if len(counts) > COUNTED:
            yield rows()
    if counts:
        yield rows()


class Classes(dict):
    """Class numbers of tokens; those after the heads by their last bytes."""

    def __init__(self, heads: list[bytes], remembered: int = 300_000):
        super().__init__(zip(heads, range(len(heads))))
        self.heads, self.first, self.limit = heads, len(heads), len(heads) + remembered

    def __missing__(self, token: bytes) -> int:
        number = self[token] = self.first + crc32(token[-3:]) % TAILS
        return number

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.update(zip(self.heads, range(self.first)))


def tail_class(token: str | Column) -> Column:
    """The number of a token's class among those of the tails."""
    token = F.col(token) if isinstance(token, str) else token
    return F.pmod(F.crc32(F.substring(token, -3, 3)), F.lit(TAILS))


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_heads long, heads_log10 double, classes binary, tails array<binary>, times array<int>"


def _encoded(batches: Iterable[pa.RecordBatch], heads: list[bytes], log_counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    classes = Classes(heads)
    first = classes.first
    for batch in chunks(batches):
        classes.trim()
        columns: list[list] = [[] for _ in range(6)]
        for text in texts_of(batch.column("text")):
            tokens = (text or b"").lower().split()
            tokens.append(END)
            numbers = np.fromiter(map(classes.__getitem__, tokens), np.int64, len(tokens))
            rare = np.flatnonzero(numbers >= first)
            found = Counter([tokens[i] for i in rare.tolist()])
            known = numbers[numbers < first]
            row = (
                len(tokens),
                len(known),
                float(log_counts[known].sum()),
                numbers.astype(np.uint16).tobytes(),
                list(found),
                list(found.values()),
            )
            for column, value in zip(columns, row):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        names = ["rid", "doc_id", "held_out", "n_tokens", "n_heads", "heads_log10", "classes", "tails", "times"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names[:3]), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names
        )


class Parameters:
    """Start, carry-on, transition and emission probabilities."""

    def __init__(self, start, carry, moves, emits):
        self.start, self.carry, self.moves, self.emits = start, carry, moves, emits

    @classmethod
    def initial(cls, shares: np.ndarray, states: int, seed: int = 7) -> "Parameters":
        """Sticky states that emit the overall shares with some noise, to part them."""
        noise = np.random.default_rng(seed).uniform(0.5, 1.5, (len(shares), states))
        emits = shares[:, None] * noise
        even = np.full(states, 1 / states)
        moves = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
        return cls(even, even, moves, emits / emits.sum(0))

    @classmethod
    def estimated(cls, counts: dict[int, np.ndarray], shares: np.ndarray, states: int) -> "Parameters":
        """From expected counts: emissions by block, then (block -1) starts, carries and moves."""
        emits = np.zeros((len(shares), states))
        for block, values in counts.items():
            if block >= 0:
                part = emits[block * BLOCK : (block + 1) * BLOCK]
                part[:] = values[: len(part)]
        rest = counts.get(-1, np.zeros((BLOCK, states)))[: states + 2] + 0.1
        normal = rest / rest.sum(1, keepdims=True)
        types = (emits > 0.5).sum(0)
        emits += np.maximum(PRIOR, NEW * types) * shares[:, None]
        return cls(normal[0], emits.sum(0) / emits.sum(), normal[2:], emits / emits.sum(0))


def _padded(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (longest first) as rows of a matrix, time first, and how many reach each time."""
    lengths = np.array([len(p) for p in pieces])
    out = np.zeros((lengths[0], len(pieces)), np.int64)
    for i, piece in enumerate(pieces):
        out[: len(piece), i] = piece
    return out, np.searchsorted(-lengths, -np.arange(lengths[0]), "left")


def expected_counts(pieces: list[np.ndarray], begins: np.ndarray, p: Parameters, emitted: np.ndarray, rest: np.ndarray) -> None:
    """Add the expected counts of a batch of segments (longest first) to ``emitted`` and ``rest``."""
    states = len(p.start)
    seen, active = _padded(pieces)
    steps, n = seen.shape
    emits = p.emits[seen]
    forward = np.zeros((steps, n, states))
    scale = np.ones((steps, n))
    now = np.where(begins[:, None], p.start, p.carry)
    for t in range(steps):
        k = active[t]
        if t:
            now = forward[t - 1, :k] @ p.moves
        now = now[:k] * emits[t, :k]
        total = now.sum(1)
        scale[t, :k] = total
        forward[t, :k] = now / total[:, None]
    backward = np.ones((n, states))
    shares = forward  # becomes the state shares, from the end
    for t in range(steps - 1, 0, -1):
        k = active[t]
        after = emits[t, :k] * backward[:k] / scale[t, :k, None]
        rest[2:] += p.moves * (forward[t - 1, :k].T @ after)
        shares[t, :k] *= backward[:k]
        backward[:k] = after @ p.moves.T
    shares[0] *= backward
    rest[0] += shares[0][begins].sum(0)
    rest[1] += shares[0][~begins].sum(0)
    inside = np.arange(n)[None, :] < active[:, None]
    numbers, weights = seen[inside], shares[inside]
    for s in range(states):
        emitted[:, s] += np.bincount(numbers, weights[:, s], len(emitted))


def _expected(batches: Iterable[pa.RecordBatch], p: Parameters) -> Iterator[pa.RecordBatch]:
    states = len(p.start)
    emitted, rest = np.zeros_like(p.emits), np.zeros((states + 2, states))
    for batch in batches:
        pieces, begins = [], []
        for raw in batch.column("classes").to_pylist():
            numbers = np.frombuffer(raw, np.uint16)
            for low in range(0, len(numbers), SEGMENT):
                pieces.append(numbers[low : low + SEGMENT])
                begins.append(low == 0)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        for low in range(0, len(order), TOGETHER):
            some = order[low : low + TOGETHER]
            expected_counts([pieces[i] for i in some], np.array([begins[i] for i in some]), p, emitted, rest)
    yield _blocks({-1: rest} | {low // BLOCK: emitted[low : low + BLOCK] for low in range(0, len(emitted), BLOCK)})


#: Expected counts of a block of classes: the lines that hold any, and their counts.
COUNTS = "block int, lines binary, counts binary"


def _blocks(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    columns: tuple[list, list, list] = ([], [], [])
    for block, values in counts.items():
        lines = np.flatnonzero(values.any(1))
        if len(lines):
            for column, value in zip(columns, (block, lines.astype(np.uint16).tobytes(), values[lines].tobytes())):
                column.append(value)
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "lines", "counts"])


def _add(totals: dict[int, np.ndarray], block: int, lines: bytes, counts: bytes, states: int) -> None:
    if block not in totals:
        totals[block] = np.zeros((BLOCK, states))
    totals[block][np.frombuffer(lines, np.uint16)] += np.frombuffer(counts).reshape(-1, states)


def _summed(batches: Iterable[pa.RecordBatch], states: int) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, lines, counts in zip(*(batch.column(n).to_pylist() for n in ("block", "lines", "counts"))):
            _add(totals, block, lines, counts, states)
    yield _blocks(totals)


def log_likelihoods(texts: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Exact log10 likelihood of each sequence of classes by the scaled forward recursion."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    low = 0
    while low < len(order):
        high = low + max(1, min(2048, CELLS // max(1, len(texts[order[low]]))))
        some = [i for i in order[low:high] if len(texts[i])]
        low = high
        if not some:
            continue
        seen, active = _padded([texts[i] for i in some])
        logs = np.zeros(len(some))
        now = np.repeat(p.start[None, :], len(some), 0)
        for t, k in enumerate(active.tolist()):
            now = (now[:k] @ p.moves if t else now) * p.emits[seen[t, :k]]
            total = now.sum(1)
            logs[:k] += np.log10(total)
            now /= total[:, None]
        out[some] = logs
    return out


def _scored(batches: Iterable[pa.RecordBatch], p: Parameters, tail_logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    heads = len(p.emits) - len(tail_logs)
    logs = np.concatenate([np.zeros(heads), tail_logs])
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_heads", "heads_log10"]
    for batch in batches:
        texts = [np.frombuffer(raw, np.uint16) for raw in batch.column("classes").to_pylist()]
        model = log_likelihoods(texts, p) - np.array([logs[t].sum() for t in texts])
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(model)], names=[*names, "model_log10"])


def most_frequent(counts: DataFrame, heads: int) -> list:
    """The ``heads`` rows of ``counts`` (``token``, ``count``) with the largest counts, ties by token;
    none of a count below ``HEAD_COUNT``.

    A histogram over eighths of powers of two tells from which count on there are
    enough; so tasks send little more than ``heads`` rows together, not each.
    """
    step = F.floor(8 * F.log2(F.col("count").cast("double"))).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # 8 * 63 rows at most
    least, found = 0, 0
    for row in sorted(sizes, key=lambda r: -r.step):
        least, found = row.step, found + row.n
        if found >= heads:
            break
    frequent = (step >= least) & (F.col("count") >= HEAD_COUNT)
    return counts.where(frequent).orderBy(F.desc("count"), "token").limit(heads).collect()


def fit(encoded: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Parameters:
    """Baum-Welch over all rows of ``encoded`` (``classes``)."""
    spark = encoded.sparkSession
    p = Parameters.initial(shares, states)
    pieces = encoded.select("classes")
    # With the root of the number of tasks as lanes, no sum reads more than that many rows.
    lanes = max(1, isqrt(pieces.rdd.getNumPartitions()))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)  # 2**16 classes by states: 4 MB
        parts = pieces.mapInArrow(lambda it: _expected(it, shared.value), COUNTS)
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")
        some = parts.select("*", lane).repartition("block", "lane").mapInArrow(lambda it: _summed(it, states), COUNTS)
        sums = some.repartition("block").mapInArrow(lambda it: _summed(it, states), COUNTS)
        totals: dict[int, np.ndarray] = {}
        for r in sums.collect():  # one row a block of classes, whatever the corpus
            _add(totals, r.block, bytes(r.lines), bytes(r.counts), states)
        p = Parameters.estimated(totals, shares, states)
        shared.destroy()
    return p


def score_texts(docs: DataFrame, held_out: Column, heads: int = HEADS, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows of ``docs`` that are not ``held_out``, score all.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (log10 probability under add-one
    unigram counts with one unknown type) and ``score`` (log10 probability under the
    model). Null and empty texts are the end alone. Without training rows all tokens
    are unknown and the states stay even. ``docs`` must be a stored table.
    """
    if heads > HEADS:
        raise ValueError(f"at most {HEADS} heads")
    spark = docs.sparkSession
    python_tasks(spark)
    texts = numbered(
        docs,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    counts = stored(
        texts.where("not held_out").select("text").mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("count")),
        "token-counts",
    )
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = most_frequent(counts, heads)
    names, head_counts = [bytes(r.token) for r in top], np.array([r["count"] for r in top], float)
    tail = counts
    if top:
        last, token = int(head_counts[-1]), F.lit(names[-1])
        tail = counts.where((F.col("count") < last) | ((F.col("count") == last) & (F.col("token") > token)))
    tail_sums = np.ones(TAILS)
    for r in tail.groupBy(tail_class("token").alias("g")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_sums[r.g] += r.n + r.v
    shares = np.concatenate([head_counts + 1, tail_sums])
    shares /= shares.sum()
    vocabulary = spark.sparkContext.broadcast((names, np.log10(head_counts + 1)))
    encoded = stored(texts.mapInArrow(lambda it: _encoded(it, *vocabulary.value), ENCODED), "encoded")
    model = spark.sparkContext.broadcast(fit(encoded.where("not held_out"), shares, states, rounds))
    scored = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_heads", "heads_log10", "classes").mapInArrow(
        lambda it: _scored(it, model.value, np.log10(tail_sums)),
        "rid long, doc_id long, held_out boolean, n_tokens long, n_heads long, heads_log10 double, model_log10 double",
    )
    rare = encoded.select("rid", F.explode(F.arrays_zip("tails", "times")).alias("x")).select(
        "rid", F.col("x.tails").alias("token"), F.col("x.times").alias("times")
    )
    found = (
        rare.join(tail, "token")
        .groupBy("rid")
        .agg(F.sum("times").alias("n_tails"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("tails_log10"))
    )
    tails_log10 = F.coalesce("tails_log10", F.lit(0.0))
    return scored.join(found, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_heads") + F.coalesce("n_tails", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("heads_log10") + tails_log10 - F.col("n_tokens") * F.log10(F.lit(float(total.n + total.v + 1)))).alias("base_score"),
        (F.col("model_log10") + tails_log10).alias("score"),
    )


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, F.pmod(F.crc32(id_text()), F.lit(7)) == 2)
