"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

A source has a target of words. Its documents have expected numbers of copies in
proportion to a weight that follows from their size (the number of binary digits of
their words: a text of 1000 words weighs twice one of 31), ``most`` copies at most, so
that the words expected are the target. ``floor`` of it are certain whole copies; what is
left is the inclusion chance ``p`` of a Pareto order sample: documents are ranked by
their random odds ``u / (1 - u)`` over their inclusion odds ``p / (1 - p)``, and taken
from the least up until the words of the rest are reached. The sample's size is thus
fixed, in words. ``u`` is a hash of ``doc_id``, so reruns agree.

Expected copies need the words by source and weight only, a few dozen rows a source. No
source is sorted as a whole: ranks are cut into ``BUCKETS`` buckets, whose words are
summed first (partial sums before the shuffle), and the bucket in which the target falls
into as many again; only the fine bucket in which it falls is ordered.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BUCKETS = 4096
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``number``, ``source``, ``source_size``, ``target`` of each source of ``sizes`` (``source``, ``size``).

    Weights go round over the sources by code point, null last. ``share`` times all
    words are shared by weight; a target stops at ``most`` times its source's words
    and the excess is shared by weight among the others, until none is above: with
    sources in the order of cap by weight, those stop that the level of what is left
    would lift over their cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(float(w)) for w in weights])
    before = Window.orderBy("level", "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("level", "number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(order))
        .withColumn("weight", F.element_at(turns, F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("stops", F.col("cap") * F.col("weights_left") <= F.col("weight") * F.col("words_left"))
    )
    rest = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    words = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * words / rest)
    return per_source.select("number", "source", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, most: float = MOST) -> DataFrame:
    """``number``, ``weight``, ``copies`` for classes of equal weight (``number``, ``target``, ``weight``, ``words``).

    ``copies`` is in proportion to ``weight`` within a source, ``most`` at most, and comes
    to ``target`` words: from the greatest weight down, classes that their share would lift
    over ``most`` stop there, and the others share the rest.
    """
    before = Window.partitionBy("number").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("number")
    weighed = F.col("weight") * F.col("words")
    level = (
        classes.withColumn("left", F.sum(weighed).over(whole) - F.coalesce(F.sum(weighed).over(before), F.lit(0)))
        .withColumn("rest", F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("stops", F.lit(float(most)) * F.col("left") <= F.col("weight") * F.col("rest"))
    )
    going = F.sum(F.when(F.col("stops"), 0).otherwise(weighed)).over(whole)
    words = F.col("target") - F.lit(float(most)) * F.sum(F.when(F.col("stops"), F.col("words")).otherwise(0)).over(whole)
    copies = F.when(F.col("stops"), F.lit(float(most))).when(going > 0, F.col("weight") * words / going).otherwise(F.lit(0.0))
    return level.select("number", "weight", "words", "target", copies.alias("copies"))


def _cut(rows: DataFrame, bucket: str) -> DataFrame:
    """Rows of a source (``number``, ``size``, ``rest``) with the words before and up to their bucket."""
    upto = Window.partitionBy("number").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    words = (
        rows.where(F.col(bucket).isNotNull())
        .groupBy("number", bucket, "start")
        .agg(F.sum("size").alias("words"))
        .withColumn("after", F.col("start") + F.sum("words").over(upto))
        .select("number", bucket, "after", (F.col("after") - F.col("words")).alias("before"))
    )
    return rows.drop("start").join(stored(words, f"mix-{bucket}"), ["number", bucket], "left")


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """One row a document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``expected``, ``copies``, ``taken``.

    ``size`` counts words (null text: 0), ``expected`` are the copies to be expected,
    ``copies`` those that are taken, ``taken = copies * size``. The words taken of a source
    differ from its target by half a document at most. Empty documents and sources take
    nothing that counts. Ties of rank (repeated ``doc_id``, null ids) go by size; rows
    equal in all of that are interchangeable. Null ``source`` is a source of its own.
    """
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    sizes = stored(
        docs.select(
            "doc_id",
            "source",
            word_count("text").alias("size"),
            ((number.cast("double") + 0.5) / F.lit(float(1 << 52))).alias("u"),
        ).withColumn("weight", F.length(F.bin("size"))),
        "mix-sizes",
    )
    targets = stored(source_targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    classes = sizes.groupBy("source", "weight").agg(F.sum("size").alias("words")).join(targets, same)
    classes = expected_copies(classes, most).withColumn("certain", F.floor("copies").cast("long"))
    rest = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("number"))
    classes = stored(classes.select("number", "weight", F.col("copies").alias("expected"), "certain", rest.alias("rest")), "mix-classes")
    chance = F.col("expected") - F.col("certain")
    odds = F.col("u") / (1.0 - F.col("u"))
    rank = F.when(chance > 0, odds / (chance / (1.0 - chance)))
    place = F.col("rank") / (1.0 + F.col("rank")) * F.lit(buckets)
    ranked = (
        sizes.join(targets, same)
        .drop("of")
        .join(classes, ["number", "weight"])
        .withColumn("rank", rank)
        .withColumn("bucket", F.floor(place).cast("int"))
        .withColumn("fine", F.floor((place - F.floor(place)) * F.lit(buckets)).cast("int"))
        .withColumn("start", F.lit(0).cast("long"))
    )
    shown = ["doc_id", "source", "size", "source_size", "target", "expected", "certain"]
    whole = F.col("rest") >= F.col("after")
    none = F.col("rest") < F.col("before")
    out, rows = [], ranked
    for bucket in ("bucket", "fine"):
        placed = _cut(rows, bucket)
        clear = F.col(bucket).isNull() | whole | none
        taken = F.when(F.col(bucket).isNotNull() & whole, 1).otherwise(0)
        out.append(placed.where(clear).select(*shown, taken.alias("drawn")))
        rows = placed.where(~clear).withColumn("start", F.col("before")).drop("after", "before")
    within = Window.partitionBy("number").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("start") + F.sum("size").over(within) - F.col("size") / 2.0
    out.append(rows.select(*shown, F.when(reached <= F.col("rest"), 1).otherwise(0).alias("drawn")))
    copies = F.col("certain") + F.col("drawn")
    return out[0].unionByName(out[1]).unionByName(out[2]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "expected",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((number - 1) % 3) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
    source_size * 2.0::DOUBLE / [5.0, 2.0, 1.0][((number - 1) % 3) + 1]::DOUBLE AS level
  FROM per_source
), filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS weights_left,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0) AS words_left
  FROM weighed
  WINDOW before AS (ORDER BY level, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, cap * weights_left <= weight * words_left AS stops FROM filled
), targets AS (
  SELECT number, source, source_size, CASE WHEN stops THEN cap ELSE weight
    * (total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () END AS target
  FROM stopped
), classes AS (
  SELECT t.number, s.source, w AS weight, any_value(target) AS target, any_value(source_size) AS source_size, sum(size)::BIGINT AS words
  FROM (SELECT *, length(bin(size)) AS w FROM sizes) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), leveled AS (
  SELECT *, (sum(weight * words) OVER (PARTITION BY number)) - coalesce(sum(weight * words) OVER above, 0) AS going,
    target - 2.0::DOUBLE * coalesce(sum(words) OVER above, 0)::DOUBLE AS words_left
  FROM classes WINDOW above AS (PARTITION BY number ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), halted AS (
  SELECT *, 2.0::DOUBLE * going::DOUBLE <= weight * words_left AS halts FROM leveled
), spread AS (
  SELECT *, (sum(CASE WHEN halts THEN 0 ELSE weight * words END) OVER (PARTITION BY number))::DOUBLE AS moving,
    target - 2.0::DOUBLE * (sum(CASE WHEN halts THEN words ELSE 0 END) OVER (PARTITION BY number))::DOUBLE AS free
  FROM halted
), parts AS (
  SELECT *, floor(expected)::BIGINT AS certain
  FROM (SELECT *, CASE WHEN halts THEN 2.0::DOUBLE WHEN moving > 0 THEN weight * free / moving ELSE 0 END AS expected FROM spread)
), rests AS (
  SELECT *, target - (sum(certain * words) OVER (PARTITION BY number))::DOUBLE AS rest, expected - certain AS chance FROM parts
), ranked AS (
  SELECT s.doc_id, s.size, r.*, CASE WHEN chance > 0 THEN (u / (1.0::DOUBLE - u)) / (chance / (1.0::DOUBLE - chance)) END AS rank
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source AND length(bin(s.size)) = r.weight
), drawn AS (
  SELECT *, CASE WHEN rank IS NULL THEN 0 WHEN sum(size) OVER (PARTITION BY number ORDER BY rank, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS more
  FROM ranked
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, ((certain + more) * size)::BIGINT AS taken FROM drawn
"""
