"""Queries with an SQL twin against it; the pipeline against brute force."""

import os

import pytest

import brute
import corpus_pipeline
from flowtide.llm import toxicity
from flowtide.llm.common import stored, table
from flowtide.llm.registry import ORACLE, QUERIES
from flowtide.sources.scratch import made_folders
from oracle_check import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_thirteen_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_twin(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) is None


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, copies and no rows go through every stage; texts stay null where nothing is cut."""
    for name in ("labels", "benchmark"):
        table(spark, SF_DIR, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, SF_DIR, "documents")
    clean = docs.where("lang = 'de'").orderBy("doc_id").limit(30)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (-5, None, "de", None, 0), (-4, "", "de", "", 0), (-3, "zwei Wörter", None, "x", 11)], docs.schema
    )
    clean.union(odd).union(odd.where("doc_id = -3")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Documents without words are no near duplicates; of equal ones with words one stays.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.doc_id is None or r.doc_id < 0) == [(False, -5), (False, -4), (False, -3), (True, 0)]
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    none = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF_DIR, name).limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_stages_leave_no_tables_behind(spark):
    docs = stored(table(spark, SF_DIR, "documents").limit(40), "few")
    stages = dict(corpus_pipeline.STAGES)
    first = stored(stages["near_duplicates"](spark, docs, SF_DIR), "first")
    left = corpus_pipeline._left[spark.sparkContext.applicationId]
    assert left
    stages["substring_dedup"](spark, first, SF_DIR)
    assert not set(left) & set(made_folders(spark)) and first.count() > 0


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "mixing"]
    docs = table(spark, SF_DIR, "documents")
    items = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]

    def rows(df):
        return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]

    scored = toxicity.score(docs, toxicity.train(docs, table(spark, SF_DIR, "labels")))
    want = [(r.doc.doc_id, r.doc.text, r.doc.source) for r in scored.collect() if r.score < toxicity.CUT]
    docs = stored(stages["toxicity"](spark, docs, SF_DIR), "t1")
    assert sorted(rows(docs)) == sorted(want) and 0 < len(want)

    _, first = brute.near_duplicates([r[:2] for r in rows(docs)])
    want = [r for r, keep in zip(rows(docs), first) if keep]
    docs = stored(stages["near_duplicates"](spark, docs, SF_DIR), "t2")
    assert sorted(rows(docs)) == sorted(want)

    before = rows(docs)
    flags = brute.removed_words([r[:2] for r in before])
    want = [(d, brute.cut_text(t, f), s) for (d, t, s), f in zip(before, flags)]
    columns = docs.columns
    docs = stored(stages["substring_dedup"](spark, docs, SF_DIR), "t3")
    assert sorted(rows(docs)) == sorted(want) and docs.columns == columns
    assert docs.where("n_chars <> length(text)").count() == 0

    want = [r for r in rows(docs) if not brute.contained(r[1], items)]
    docs = stored(stages["decontamination"](spark, docs, SF_DIR), "t4")
    assert sorted(rows(docs)) == sorted(want)

    mix = stages["mixing"](spark, docs, SF_DIR).collect()
    assert sorted(r.doc_id for r in mix) == sorted(r[0] for r in want)
    for source in {r.source for r in mix}:
        own = [r for r in mix if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert sum({r.source: r.target for r in mix}.values()) == pytest.approx(1.5 * sum(r.size for r in mix))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, mix))
