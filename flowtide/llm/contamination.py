"""Benchmark items inside documents: size-partitioned MinHash containment search.

Built-in functions only. Items are partitioned by the size of their set of word
5-grams. The MinHash sketch of an item is the ``k`` least of its gram hashes, and
``k`` belongs to the partition: one more than the grams that an item of the
partition's largest size may lack at the threshold. So a document that contains an
item to the threshold holds a gram of its sketch: no loss. An item of fewer than five words is one gram of
all its words; grams of these lengths are made of documents too, if there are such
items. Documents stream their gram hashes past the sketches; pairs that meet are
verified on the grams' words.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, numbered, placed, stored, table

GRAM, THRESHOLD = 5, 0.8


def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _grams(words: str, n: int, make: str) -> Column:
    """``make`` over places ``i`` of the n-grams of an array of words."""
    return F.expr(f"if(size({words}) < {n}, array(), transform(sequence(0, size({words}) - {n}), i -> {make}))")


def _gram_hashes(hashes: str, n: int) -> Column:
    parts = ", ".join(f"{hashes}[i + {k}]" if k else f"{hashes}[i]" for k in range(n))
    return _grams(hashes, n, f"xxhash64({parts})")


def _gram_texts(words: str, n: int) -> Column:
    return _grams(words, n, f"concat_ws(' ', slice({words}, i + 1, {n}))")


def _doc_hashes(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """``texts`` with ``hashes``, those of its grams of all ``lengths``."""
    hashed = texts.withColumn("words", F.transform(_words("text"), lambda w: F.xxhash64(w)))
    return hashed.withColumn("hashes", F.concat(*(_gram_hashes("words", k) for k in lengths))).drop("words", "text")


def _item_hashes(items: DataFrame, n: int) -> DataFrame:
    """``items`` with ``hashes``: of its ``n``-word grams, or of all its words if there are fewer."""
    hashed = items.withColumn("words", F.transform(_words("text"), lambda w: F.xxhash64(w)))
    own = F.when(F.size("words") >= n, _gram_hashes("words", n))
    for k in range(1, n):
        own = own.when(F.size("words") == k, _gram_hashes("words", k))
    return hashed.withColumn("hashes", F.coalesce(own, F.expr("cast(array() as array<long>)"))).drop("words", "text")


def sketches(items: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``item``, ``hash``: the MinHash sketch of each item (``item``, ``text``), sized by its partition.

    Partition ``p`` holds the items of ``2**(p - 1) < grams <= 2**p``.
    """
    sized = _item_hashes(items.select("item", "text"), n).select("item", F.array_distinct("hashes").alias("hashes"))
    most = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes").cast("double"))))
    least = F.floor(most * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1
    # explode_outer here and below: the filter that Spark derives from explode would be
    # pushed to the scan with the whole definition of its array in it.
    return (
        sized.select("item", F.slice(F.sort_array("hashes"), F.lit(1), least).alias("sketch"))
        .select("item", F.explode_outer("sketch").alias("hash"))
        .where("hash is not null")
    )


def contained_items(docs: DataFrame, items: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item it contains: ``rid``, ``doc_id``, ``item_id``, ``n_shared``, ``n_grams``, ``containment``.

    Words are compared in lower case. ``containment`` is the share of the item's
    distinct ``n``-word grams that the document holds, ``threshold`` at least. An item of
    fewer than ``n`` words has one gram of all of them, so it is found word for word.
    Null and empty texts hold nothing and are found nowhere. Repeated documents and items
    give a row for each.
    """
    return _contained_items(placed(docs, F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")), items, n, threshold)


def _contained_items(texts: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """:func:`contained_items` of rows ``rid``, ``doc_id``, ``text``."""
    known = stored(numbered(items, F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumnRenamed("rid", "item"), "items")
    probes = stored(sketches(known, n, threshold), "sketches")
    # Lengths of grams: n, and those of the short items, n - 1 numbers at most.
    short = known.select(F.size(_words("text")).alias("k")).where(F.col("k").between(1, n - 1)).distinct()
    lengths = [n, *sorted(r.k for r in short.collect())]
    streamed = _doc_hashes(texts.select("rid", "text"), lengths).select("rid", F.explode_outer("hashes").alias("hash"))
    pairs = stored(streamed.join(probes, "hash").select("rid", "item").distinct(), "pairs")
    item_grams = known.withColumn("words", _words("text")).select(
        "item",
        "item_id",
        F.when(F.size("words") < n, F.array(F.concat_ws(" ", "words")))
        .otherwise(F.array_distinct(_gram_texts("words", n)))
        .alias("item_grams"),
    )
    # Texts are read again for the documents that met a sketch.
    met = stored(pairs.groupBy("rid").agg(F.collect_set("item").alias("items")), "met")
    doc_grams = (
        texts.join(met, "rid")
        .withColumn("words", _words("text"))
        .select("rid", "doc_id", "items", F.concat(*(_gram_texts("words", k) for k in lengths)).alias("doc_grams"))
        .select("rid", "doc_id", F.explode("items").alias("item"), "doc_grams")
    )
    return (
        doc_grams.join(item_grams, "item")
        .select(
            "rid",
            "doc_id",
            "item_id",
            F.size(F.array_intersect("item_grams", "doc_grams")).cast("long").alias("n_shared"),
            F.size("item_grams").cast("long").alias("n_grams"),
        )
        .withColumn("containment", F.col("n_shared") / F.col("n_grams"))
        .where(F.col("n_shared") >= F.col("n_grams") * F.lit(threshold) - F.lit(1e-9))
    )


def without_items(docs: DataFrame, items: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item. Null and empty texts stay."""
    rows = placed(docs, F.struct("*").alias("doc"))
    texts = rows.select("rid", F.col("doc.doc_id").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    leaking = stored(_contained_items(texts, items, n, threshold).select("rid").distinct(), "leaking")
    return rows.join(leaking, "rid", "left_anti").select("doc.*")


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_grams", "containment")


OP10_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), item_words AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM item_words WHERE len(w) > 0
), doc_grams AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i:i+k-1], ' ') AS gram
  FROM (SELECT rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, lengths)
), item_grams AS (
  SELECT DISTINCT item, item_id, array_to_string(w[i:i+k-1], ' ') AS gram
  FROM (SELECT item, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0))
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY item) AS n_grams FROM item_grams
)
SELECT doc_id, item_id, count(*) AS n_shared, n_grams, count(*)::DOUBLE / n_grams AS containment
FROM doc_grams JOIN sized USING (gram)
GROUP BY rid, doc_id, item, item_id, n_grams HAVING count(*) >= n_grams * 0.8::DOUBLE - 1e-9::DOUBLE
"""
