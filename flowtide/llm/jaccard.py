"""Join of documents on the Jaccard similarity of their word n-grams, by MinHash bands.

1. Documents become sets of ``n``-word grams (64-bit hashes of the words) in Python
   tasks over Arrow batches; a document keeps a fingerprint of its set and one hash
   for each band. Equal sets are one class, whatever their number.
2. Classes that share a band hash are linked to the least class of that bucket: one
   edge a row, never the pairs of a bucket. Connected components of these edges
   hold every candidate pair.
3. Sets are read again for classes in components only (a Bloom filter keeps the others
   from the shuffle), and every candidate pair is verified on its full sets. A
   component of one block is verified as a whole. A larger one is dealt out as pairs of
   its blocks, or as its buckets, each pair in the first bucket that it shares:
   whichever sends fewer sets. So copies of one text go as blocks, and a chain of many
   small clusters, which chance meetings tie together, as buckets. A task returns the
   number of links of each class and a spanning forest of its links, not the pairs.
4. Components of the verified links are the classes of the result.

Band and row counts follow from the threshold and the recall: a pair at exactly the
threshold shares a band with a probability of ``1 - (1 - t**rows)**bands``.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import chunks, placed, python_tasks, stored, texts_of
from .components import components
from .words import Vocabulary, mixed, rolled

#: Chance that a pair at the threshold is found.
RECALL = 0.99999
#: Documents and grams of a block in which all pairs are verified.
BLOCK_DOCS, BLOCK_GRAMS = 512, 2_000_000
#: Columns of the 0/1 matrix multiplied at a time.
SLICE = 4096


def bands_and_rows(threshold: float, recall: float = RECALL, most_hashes: int = 200) -> tuple[int, int]:
    """The most selective (most rows) banding that reaches ``recall`` with few enough hashes."""
    best = None
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        bands = 1 if miss <= 0 else int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def _gram_sets(texts: list[bytes | None], vocabulary: Vocabulary, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes of all texts and the offsets of each text's.

    A text of fewer than ``n`` words has one gram of all its words; one without words none.
    """
    words, ids, offsets = vocabulary.encode(texts)
    hashes = vocabulary.hashes[ids]
    lengths = np.diff(offsets)
    grams = mixed(rolled(hashes, n))
    first = np.repeat(offsets[:-1], np.maximum(lengths - n + 1, 0))
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out = np.zeros(counts.sum() + 1, np.int64)[:-1].astype(np.uint64)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    long = np.repeat(lengths >= n, counts)
    at = np.flatnonzero(long)
    within = at - np.repeat(ends[:-1], counts)[at]
    out[at] = grams[first + within] if len(at) else 0
    for i in np.flatnonzero((lengths > 0) & (lengths < n)):
        # Another number of words is another gram.
        out[ends[i]] = xxhash.xxh3_64_intdigest(b" ".join(words[offsets[i] : offsets[i + 1]]), seed=int(lengths[i]))
    return out, ends


def _signed(batches: Iterable[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    random = np.random.default_rng(20)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    for batch in chunks(batches):
        texts = texts_of(batch.column("text"))
        grams, ends = _gram_sets(texts, vocabulary, n)
        sizes, keys = [], []
        for a, b in zip(ends[:-1], ends[1:]):
            own = np.unique(grams[a:b])
            sizes.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()))
        some = np.flatnonzero(np.diff(ends))
        found = np.zeros((bands, len(texts)), np.uint64)
        if len(some):
            # Empty texts share no start with a later one, so reduceat sees the right pieces.
            starts = ends[:-1][some]
            with np.errstate(over="ignore"):
                for band in range(bands):
                    together = np.zeros(len(some), np.uint64)
                    for row in range(band * rows, (band + 1) * rows):
                        value = grams * factors[row]
                        value += shifts[row]
                        together = mixed(together * np.uint64(31) + np.minimum.reduceat(value, starts))
                    found[band, some] = together
        flat = pa.array(found.T.ravel().view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists],
            names=["rid", "doc_id", "gram_set", "n_grams", "bands"],
        )


def _sets(batches: Iterable[pa.RecordBatch], n: int, wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Gram sets of the rows whose ``hash`` may be ``wanted``."""
    vocabulary = Vocabulary()
    for whole in batches:
        some = wanted.has(whole.column("hash").to_numpy().view(np.uint64))
        for batch in chunks([whole.filter(pa.array(some))]):
            grams, ends = _gram_sets(texts_of(batch.column("text")), vocabulary, n)
            own = [np.unique(grams[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(own, pa.binary())], names=["rid", "grams"])


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets reach the threshold with which, as a matrix without the diagonal."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[gram] > 1)
    column = np.cumsum(times > 1)[gram[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, [low, low + SLICE])
        matrix = np.zeros((n, min(SLICE, int(column[-1]) + 1 - low)), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        both += matrix @ matrix.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = both >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _verified(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit, pair of blocks and rid to links of each row and a forest."""

    def task(key, members):
        _, band, _, i, j = key
        linked = _links([grams for _, _, grams, _ in members], threshold)
        block = np.array([b for _, b, _, _ in members])
        if i != j:  # pairs within a block are verified where i = j
            linked &= block[:, None] != block[None, :]
        if band > 0:  # and pairs that share an earlier band in the bucket of that one
            bands = np.array([b for _, _, _, b in members])
            a, b = np.nonzero(linked)
            for first in range(0, len(a), SLICE):
                some = slice(first, first + SLICE)
                earlier = (bands[a[some], :band] == bands[b[some], :band]).any(1)
                linked[a[some][earlier], b[some][earlier]] = False
        counts = linked.sum(1)
        root = np.full(len(members), -1)
        for start in range(len(members)):
            if root[start] < 0:
                todo, root[start] = [start], start
                while todo:
                    near = np.flatnonzero(linked[todo.pop()] & (root < 0))
                    root[near] = start
                    todo.extend(near.tolist())
        for (rid, _, _, _), n, r in zip(members, counts.tolist(), root.tolist()):
            if n:
                out.append((rid, n, members[r][0]))

    key, members, out = None, [], []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in (*UNIT, "i", "j", "rid", "block", "grams", "bands"))
        for *unit, rid, block, grams, bands in zip(*columns):
            if unit != key:
                if len(members) > 1:
                    task(key, members)
                key, members = unit, []
            members.append((rid, block, np.frombuffer(grams, np.uint64), bands))
        if out:
            yield _linked_rows(out)
            out.clear()
    if len(members) > 1:
        task(key, members)
    if out:
        yield _linked_rows(out)


def _linked_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows)], names=["rid", "links", "root"]
    )


#: What is verified together: a component (band -1), or one of its buckets.
UNIT = ("component", "band", "value")


def _blocks(docs: Column, grams: Column) -> Column:
    return F.ceil(F.greatest(docs / BLOCK_DOCS, grams / BLOCK_GRAMS)).cast("int")


def _units(classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rid``, the unit's columns, ``blocks``, and ``bands`` where the unit is a bucket."""
    sizes = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_grams").alias("grams"))
    sizes = stored(sizes.withColumn("blocks", _blocks(F.col("docs"), F.col("grams"))), "components")
    members = stored(
        candidates.select(F.col("node").alias("head"), "root")
        .join(sizes.where("blocks > 1").select("root"), "root")
        .join(classes.select("head", "n_grams", "bands"), "head"),
        "large-components",
    )
    in_buckets = members.select("root", "head", "n_grams", "bands", F.posexplode("bands").alias("band", "value"))
    buckets = (
        in_buckets.groupBy("root", "band", "value")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("n_grams").alias("grams"))
        .where("docs > 1")
    )
    buckets = buckets.withColumn("blocks", _blocks(F.col("docs"), F.col("grams")))
    # Sets that either way sends.
    cost = buckets.groupBy("root").agg(F.sum(F.col("docs") * F.col("blocks")).alias("cost"))
    split = sizes.join(cost, "root").where(F.col("cost") < F.col("docs") * F.col("blocks")).select("root")
    split = stored(split, "split-components")
    whole = candidates.join(sizes.select("root", "blocks").join(split, "root", "left_anti"), "root").select(
        F.col("node").alias("rid"),
        F.col("root").alias("component"),
        F.lit(-1).alias("band"),
        F.lit(0).cast("long").alias("value"),
        "blocks",
        F.lit(None).cast("array<long>").alias("bands"),
    )
    parts = in_buckets.join(buckets.join(split, "root").select("root", "band", "value", "blocks"), ["root", "band", "value"])
    return whole.unionByName(
        parts.select(F.col("head").alias("rid"), F.col("root").alias("component"), "band", "value", "blocks", "bands")
    )


def _candidates(classes: DataFrame) -> DataFrame:
    """``node``, ``root``: classes that share a band hash with another, by component."""
    buckets = classes.where("n_grams > 0").select("head", F.posexplode("bands").alias("band", "value"))
    least = buckets.groupBy("band", "value").agg(F.min("head").alias("least"), F.max("head").alias("most"))
    least = least.where("least < most").drop("most")
    edges = buckets.join(least, ["band", "value"]).select(F.col("head").alias("a"), F.col("least").alias("b"))
    return components(edges)


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """One row a document: ``rid``, ``doc_id``, ``class_rid``, ``class_id``, ``n_links``, ``n_copies``, ``n_grams``.

    A link joins two documents with different gram sets of Jaccard similarity
    ``threshold`` or more; ``n_links`` counts a document's links to different sets
    (copies of one set count once), ``n_copies`` the documents with its own set, itself
    included. ``class_id`` is the least ``doc_id`` (null last) of all documents that
    links and equal sets connect. Documents without words are alone.
    """
    texts = placed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _near_duplicates(texts, n, threshold, recall)


def _near_duplicates(texts: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """:func:`near_duplicates` of rows ``rid``, ``doc_id``, ``text``."""
    python_tasks(texts.sparkSession)
    bands, rows = bands_and_rows(threshold, recall)
    signed = stored(
        texts.mapInArrow(
            lambda it: _signed(it, n, bands, rows), "rid long, doc_id long, gram_set binary, n_grams long, bands array<long>"
        ),
        "signatures",
    )
    # Documents without words: a class each.
    key = F.when(F.col("n_grams") > 0, F.col("gram_set")).otherwise(F.col("rid").cast("string").cast("binary"))
    signed = signed.withColumn("gram_set", key)
    classes = stored(
        signed.groupBy("gram_set").agg(
            F.min("rid").alias("head"),
            F.count(F.lit(1)).alias("n_copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    candidates = stored(
        _candidates(classes).join(classes.select(F.col("head").alias("node"), "n_grams"), "node"), "candidates"
    )
    units = stored(_units(classes, candidates), "units")
    wanted = bloom_of(stored(units.select(F.xxhash64("rid").alias("hash")).distinct(), "wanted"))
    sets = texts.select("rid", F.xxhash64("rid").alias("hash"), "text").mapInArrow(
        lambda it: _sets(it, n, wanted.value), "rid long, grams binary"
    )
    dealt = sets.join(units, "rid").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    others = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block)))")
    pairs = dealt.select(*UNIT, F.explode(others).alias("pair"), "rid", "block", "grams", "bands").select(
        *UNIT, "pair.i", "pair.j", "rid", "block", "grams", "bands"
    )
    verified = stored(
        pairs.repartition(*UNIT, "i", "j")
        .sortWithinPartitions(*UNIT, "i", "j", "rid")
        .mapInArrow(lambda it: _verified(it, threshold), "rid long, links long, root long"),
        "links",
    )
    counts = verified.groupBy("rid").agg(F.sum("links").alias("n_links"))
    groups = components(verified.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    heads = stored(
        classes.select("gram_set", F.col("head").alias("rid"), "n_copies", "first")
        .join(counts, "rid", "left")
        .join(groups.withColumnRenamed("node", "rid"), "rid", "left")
        .select("gram_set", F.coalesce("root", "rid").alias("root"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first"),
        "heads",
    )
    firsts = heads.groupBy("root").agg(F.min("first").alias("first"))
    named = heads.drop("first").join(firsts, "root").select(
        "gram_set", "n_copies", "n_links", F.col("first.rid").alias("class_rid"), F.col("first.doc_id").alias("class_id")
    )
    return signed.join(named, "gram_set").select(
        "rid", "doc_id", "class_rid", "class_id", "n_links", "n_copies", "n_grams"
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, the one with the least ``doc_id``."""
    rows = placed(docs, F.struct("*").alias("doc"))
    texts = rows.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    gone = _near_duplicates(texts, n, threshold, RECALL).where("rid <> class_rid").select("rid")
    return rows.join(gone, "rid", "left_anti").select("doc.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies", "n_grams")
