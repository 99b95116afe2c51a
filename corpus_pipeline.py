"""From raw documents to a training mix; each stage works on what the one before kept.

A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs``. So
when a stage begins, the one before has been written, and the intermediate tables that
it left go (but for any that ``docs`` still reads).

Tables without rows go through as such. Null texts are empty texts to every stage; a
null ``doc_id`` is a document of its own, repeated rows are documents of their own.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm.common import stored, table
from flowtide.llm.contamination import without_items
from flowtide.llm.jaccard import one_of_each
from flowtide.llm.mixing import mix_sources
from flowtide.llm.substrings import remove_repeated
from flowtide.llm.toxicity import without_toxic
from flowtide.sources.scratch import clear_scratch, made_folders

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """``stage``, which first deletes the intermediate tables of the one before."""

    @wraps(stage)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        reads = "\n".join(docs.inputFiles())
        clear_scratch(spark, [f for f in _left.pop(app, []) if f.rsplit("/", 1)[-1] not in reads])
        before = set(made_folders(spark))
        result = stage(spark, docs, sf_dir)
        _left[app] = [f for f in made_folders(spark) if f not in before]
        return result

    return tidy


@_tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts stay."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id."""
    return one_of_each(docs)


@_tidy
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds are cut out of the texts.

    A text that loses words is written anew and ``n_chars`` with it; others stay as
    they are, null included. Documents stay, even if nothing is left of them.
    """
    cleaned = remove_repeated(docs)
    cut = F.col("n_removed") > 0
    changed = {
        "text": F.when(cut, F.col("kept_text")).otherwise(F.col("doc.text")),
        "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None,
    }
    return cleaned.select(
        *(changed[c].alias(c) if changed.get(c) is not None else F.col("doc").getField(c).alias(c) for c in docs.columns)
    )


@_tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts stay."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


@_tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes: ``doc_id``, ``source``, ``size``, ..., ``taken``.

    Null and empty texts have size 0 and take nothing that counts.
    """
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Viterbi decoding and trained weights are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")  # not among the stage's own tables
    return STAGES[-1][1](spark, docs, sf_dir)
