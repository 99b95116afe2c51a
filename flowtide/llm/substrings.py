"""Removal of word sequences that occurred before, with suffix automata.

The reference is the corpus itself, so one set of automata for all documents
would grow with the corpus and could not be broadcast. The method is kept and
dealt out instead:

1. Every window of ``min_words`` words has one anchor, the ``GRAM``-word gram
   with the least hash in it. Equal windows have equal anchors. Anchors that
   occur once in the corpus need no more work; the others go into a Bloom filter
   of bounded size, which is broadcast. (When the corpus outgrows the bound,
   more false positives come through; the result stays exact.) Anchors in very many
   batches of texts are hot: their windows meet by all their words in step 3.
2. Documents stream past the filter and give segments: a repeated anchor and the
   windows around it, at most ``2 * min_words - GRAM`` words. Within a batch of
   texts a window seen earlier is settled at once (ids of words compared, not
   hashes), so a passage that a third of all documents share sends one segment
   a batch and not one a document.
3. Reference shards: segments meet by anchor, in document order. The segments
   read so far form the suffix automaton of the shard; the next one is streamed
   through it, and the matching statistic (longest match that ends at each word)
   tells which of its windows began earlier. A shard holds ``SHARD`` segments;
   windows of later segments that it does not know go on to
4. a comparison of whole windows, by a hash of all their words.

Then the removed spans meet their documents.
"""

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import chunks, doc_and, placed, python_tasks, stored, texts_of, with_text
from .words import Vocabulary, mixed, rolled, runs

GRAM = 10
#: Segments that one suffix automaton holds at most.
SHARD = 2048
#: Anchors that more batches of texts hold are split by the words of their windows.
HOT = 4096
FIRST = -(1 << 63)

SEGMENTS = pa.schema(
    [("anchor", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("text", pa.binary())]
)
SEGMENTS_DDL = "anchor long, doc_id long, rid long, start int, n int, text binary"


class SuffixAutomaton:
    """Generalised suffix automaton over words."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        here = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = here
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return here

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest known sequence that ends there."""
        state = matched = 0
        out = []
        for word in words:
            to = self.next[state].get(word)
            while to is None and state:
                state = self.link[state]
                matched = self.length[state]
                to = self.next[state].get(word)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def _windows(batch: pa.RecordBatch, vocabulary: Vocabulary, min_words: int):
    """Of a chunk, its documents in order: words, ids, offsets, window starts, their documents, anchors, hashes."""
    doc_ids = [FIRST if d is None else d for d in batch.column("doc_id").to_pylist()]
    rids = batch.column("rid").to_pylist()
    texts = texts_of(batch.column("text"))
    order = sorted(range(len(rids)), key=lambda i: (doc_ids[i], rids[i]))
    words, ids, offsets = vocabulary.encode([texts[i] for i in order])
    hashes = vocabulary.hashes[ids]
    starts = len(words) - min_words + 1
    if starts <= 0:
        return None
    grams = mixed(rolled(hashes, GRAM))
    # Leftmost place of the least gram in each window, by doubling.
    span, reach = min_words - GRAM + 1, 1
    at = np.arange(len(grams))
    while reach < span:
        step = min(reach, span - reach)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        reach += step
    doc = np.repeat(np.arange(len(rids)), np.diff(offsets))[:starts]
    inside = np.flatnonzero(np.arange(starts) + min_words <= offsets[doc + 1])
    return (
        [(doc_ids[i], rids[i]) for i in order],
        words,
        ids,
        offsets,
        inside,
        doc[inside],
        at[inside],
        grams,
        rolled(hashes, min_words),
    )


def _anchors(batches: Iterable[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    for batch in chunks(batches):
        if (found := _windows(batch, vocabulary, min_words)) is None:
            continue
        at, grams = found[6], found[7]
        anchors, times = np.unique(grams[np.unique(at)], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.view(np.int64)), pa.array(np.minimum(times, 2))], names=["anchor", "times"]
        )


def _repeated(docs: DataFrame, min_words: int):
    """Filters of the anchors that occur at two places or more, and of those in very many batches of texts."""
    anchors = docs.mapInArrow(lambda it: _anchors(it, min_words), "anchor long, times long")
    repeated = stored(anchors.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1"), "anchors")
    repeated = repeated.withColumnRenamed("anchor", "hash")
    return bloom_of(repeated.select("hash")), bloom_of(repeated.where(F.col("times") > HOT).select("hash"))


def _segments(batches: Iterable[pa.RecordBatch], min_words: int, bloom: Bloom, hot: Bloom) -> Iterator[pa.RecordBatch]:
    """Repeated windows as segments; those settled within the chunk without a text.

    A segment meets others by its anchor. A window at a hot anchor goes alone and meets
    others by a hash of all its words, so that a line which many documents share, with
    other words around it, comes together nowhere.
    """
    vocabulary = Vocabulary()
    for batch in chunks(batches):
        if (found := _windows(batch, vocabulary, min_words)) is None:
            continue
        keys, words, ids, offsets, starts, doc, at, grams, whole = found
        candidate = bloom.has(grams[at])
        starts, doc, at = starts[candidate], doc[candidate], at[candidate]
        _, first, group = np.unique(whole[starts], return_index=True, return_inverse=True)
        earlier = starts[first][group]
        again = earlier != starts
        later, before = starts[again], earlier[again]
        equal = np.ones(len(later), bool)
        for k in range(min_words):
            equal &= ids[later + k] == ids[before + k]
        again[again] = equal
        rows: list[list] = [[] for _ in SEGMENTS]

        def put(anchor, d, start, n, text):
            doc_id, rid = keys[d]
            for column, value in zip(rows, (anchor, doc_id, rid, start - offsets[d], n, text)):
                column.append(value)

        s, d = starts[again], doc[again]
        for i, n in zip(*runs(s, d)):
            put(int(mixed(np.uint64([keys[d[i]][1]]))[0].view(np.int64)), d[i], s[i], n, None)
        s, d, p = starts[~again], doc[~again], at[~again]
        alone = hot.has(grams[p])
        for i, e in zip(s[alone], d[alone]):
            put(int(mixed(whole[i : i + 1])[0].view(np.int64)), e, i, 1, b" ".join(words[i : i + min_words]))
        s, d, p = s[~alone], d[~alone], p[~alone]
        for i, n in zip(*runs(s, d, p)):
            put(int(grams[p[i]].view(np.int64)), d[i], s[i], n, b" ".join(words[s[i] : s[i] + n + min_words - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SEGMENTS)], schema=SEGMENTS)


def _matched(batches: Iterable[pa.RecordBatch], min_words: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor and document to removed windows (no text) and open ones (with it)."""
    anchor = automaton = None
    waiting: list[list[bytes]] = []
    seen: set[bytes] = set()
    held = 0
    for batch in batches:
        rows: list[list] = [[] for _ in SEGMENTS]
        for row in zip(*(batch.column(name).to_pylist() for name in SEGMENTS.names)):
            text = row[5]
            if text is not None:
                key, doc_id, rid, start, n = row[:5]
                if key != anchor:
                    anchor, automaton, waiting, seen, held = key, None, [], set(), 0
                if not held:
                    waiting, seen, held = [text.split()], {text}, 1
                    continue
                if text not in seen:
                    words = text.split()
                    automaton = automaton or SuffixAutomaton()
                    for reference in waiting:
                        automaton.add(reference)
                    waiting = []
                    known = np.fromiter(automaton.matching(words), np.int64, len(words))[min_words - 1 :] >= min_words
                    if not known.all():
                        if held < shard:
                            waiting, held = [words], held + 1
                            seen.add(text)
                        else:
                            for i in np.flatnonzero(~known):
                                window = b" ".join(words[i : i + min_words])
                                for column, value in zip(rows, (key, doc_id, rid, start + i, 1, window)):
                                    column.append(value)
                    places = np.flatnonzero(known)
                    for i, length in zip(*runs(places)):
                        for column, value in zip(rows, (key, doc_id, rid, start + places[i], length, None)):
                            column.append(value)
                    continue
                row = (key, doc_id, rid, start, n, None)
            for column, value in zip(rows, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SEGMENTS)], schema=SEGMENTS)


def repeated_spans(docs: DataFrame, min_words: int = 20, shard: int = SHARD) -> DataFrame:
    """``rid``, ``start``, ``n``: starts of windows whose words began earlier.

    ``docs`` has ``rid``, ``doc_id``, ``text``; earlier is a smaller ``doc_id``
    (null least), then a smaller ``rid``, then an earlier start.
    """
    python_tasks(docs.sparkSession)
    bloom, hot = _repeated(docs, min_words)
    segments = docs.mapInArrow(lambda it: _segments(it, min_words, bloom.value, hot.value), SEGMENTS_DDL)
    found = stored(
        segments.repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id", "rid", "start")
        .mapInArrow(lambda it: _matched(it, min_words, shard), SEGMENTS_DDL),
        "spans",
    )
    late = found.where("text is not null").withColumn("place", F.struct("doc_id", "rid", "start"))
    first = late.groupBy("text").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    late = late.join(first, "text").where("place <> first")
    return found.where("text is null").select("rid", "start", "n").unionByName(late.select("rid", "start", "n"))


DIGEST = [
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept_words_sha256", pa.string()),
    ("kept_text", pa.string()),
]
_SEPARATOR = re.compile(rb"([ \t-\r]+)")


def _cut(text: bytes, flags: np.ndarray) -> bytes:
    """The text without the flagged words and the white space that followed them."""
    pieces = _SEPARATOR.split(text)
    first = 0 if pieces[0] else 2  # pieces alternate; leading and trailing ones may be empty
    out = [] if first == 0 else [pieces[1]] if len(pieces) > 1 else []
    for number, gone in enumerate(flags.tolist()):
        at = first + 2 * number
        if not gone:
            out.append(pieces[at])
            if at + 1 < len(pieces):
                out.append(pieces[at + 1])
    return b"".join(out)


def _cleaned(batches: Iterable[pa.RecordBatch], min_words: int, kept_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(with_text(batches)):
        columns: list[list] = [[] for _ in DIGEST]
        for text, starts, lengths in zip(
            texts_of(batch.column("text")), batch.column("starts").to_pylist(), batch.column("lengths").to_pylist()
        ):
            text = text or b""
            words = text.split()
            kept, removed, rest = words, 0, text
            if starts:
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, np.array(starts), 1)
                np.add.at(depth, np.array(starts) + np.array(lengths) + min_words - 1, -1)
                flags = np.cumsum(depth)[:-1] > 0
                removed = int(flags.sum())
                kept = [w for w, gone in zip(words, flags.tolist()) if not gone]
                rest = _cut(text, flags) if kept_text else b""
            digest = hashlib.sha256(b" ".join(kept)).hexdigest()
            for column, value in zip(columns, (len(words), removed, digest, rest.decode() if kept_text else None)):
                column.append(value)
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, DIGEST)]
        names = [name for name, _ in DIGEST]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", *names])


def remove_repeated(docs: DataFrame, min_words: int = 20, kept_text: bool = True, shard: int = SHARD) -> DataFrame:
    """Documents without the words of any ``min_words`` window that also starts earlier.

    Returns the struct ``doc`` with all columns of ``docs`` and ``n_words``,
    ``n_removed``, ``kept_words_sha256`` and (``kept_text``) ``kept_text``: the
    text with each removed word cut out together with the white space after it.
    Windows are judged on the input. Null and empty texts, and texts shorter than
    a window, lose nothing. Of repeated rows one stays as it is.
    """
    if min_words <= GRAM:
        raise ValueError(f"min_words must be above {GRAM}")
    python_tasks(docs.sparkSession)
    rows = placed(docs, F.struct("*").alias("doc"))
    texts = rows.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    spans = repeated_spans(texts, min_words, shard)
    by_doc = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = rows.join(by_doc, "rid", "left").select("doc", F.col("spans.start").alias("starts"), F.col("spans.n").alias("lengths"))
    out = doc_and(rows, "n_words long, n_removed long, kept_words_sha256 string, kept_text string")
    return joined.mapInArrow(lambda it: _cleaned(it, min_words, kept_text), out)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeated(docs, 20, kept_text=False)
    return done.select("doc.doc_id", "n_words", "n_removed", F.col("kept_words_sha256").alias("kept_sha256"))
