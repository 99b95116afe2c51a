"""Every operator on odd tables: nulls, empty and long texts, repeated rows, clashing names, no rows."""

import zlib

import pytest

from flowtide.llm import (
    contamination,
    hidden_markov,
    jaccard,
    licenses,
    line_rules,
    mixing,
    ordinal,
    substrings,
    token_counts,
    toxicity,
)
from flowtide.llm.common import stored
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + "."
COPY = " ".join(f"copy{i}" for i in range(60)) + " the end."
ODD = [
    (1, COPY, "a"),
    (1, COPY, "a"),  # a repeated row
    (2, COPY + " More words here.", "b"),
    (3, None, None),
    (4, "", "a"),
    (5, " \t\n\x0b\x0c\r ", "c"),
    (None, "no id but some words.", "b"),
    (None, None, None),
    (6, "two words", None),
    (7, LONG, "a"),
    (8, "idiot " * 30 + "\n\nLicensed under CC BY 4.0.\n", "d"),
    (9, "é ü ñ 漢字  nbsp x 😀", ""),
]
SCHEMA = "doc_id long, text string, source string"
#: Names that operators use inside.
CLASHING = ("rid", "doc", "words", "size", "u", "number", "chars", "tokens", "edits", "spans", "score", "axis", "hash", "item", "a.b")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).coalesce(2)
    return stored(docs.withColumns({name: F.lit(name) for name in CLASHING}), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark.createDataFrame([], SCHEMA), "none")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(d, d % 2, (d // 2) % 2) for d in range(1, 10)] + [(None, 1, 1), (3, None, None), (8, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def every_operator(docs, labels, items):
    """Name, rows, and whether there is one for each document."""
    yield "op1", hidden_markov.score_texts(docs, held_out(), heads=50, states=2, rounds=2).collect(), True
    yield "op2", substrings.remove_repeated(docs).collect(), True
    yield "op3", mixing.mix_sources(docs).collect(), True
    yield "op4", line_rules.clean_lines(docs).collect(), True
    yield "op5", token_counts.apply_edits(token_counts.build_trees(docs, token_counts.sample_edits())).collect(), True
    yield "op6", ordinal.grade(docs, ordinal.train(docs, ordinal.ratings_of(labels), 3)).collect(), True
    yield "op7", toxicity.score(docs, toxicity.train(docs, labels)).collect(), True
    yield "op8", licenses.scan_licenses(docs).collect(), True
    yield "op9", jaccard.near_duplicates(docs).collect(), True
    yield "op10", contamination.contained_items(docs, items).collect(), False


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, COPY[:200]), (2, None), (3, ""), (4, "too short"), (5, "Two words"), (None, COPY[:200])]
    return stored(spark.createDataFrame(rows, "item_id long, text string"), "items")


@pytest.fixture(scope="module")
def results(odd, labels, items):
    return {name: rows for name, rows, _ in every_operator(odd, labels, items)}


def test_one_row_a_document(results):
    for name, rows in results.items():
        if name != "op10":
            assert len(rows) == len(ODD), name


def test_no_rows(empty, labels, items):
    for name, rows, _ in every_operator(empty, labels, items):
        assert rows == [], name


def test_all_columns_pass_through(results):
    for name in ("op2", "op4", "op5", "op6", "op7"):
        for row in results[name]:
            assert all(row.doc[c] == c for c in CLASHING), name


def test_null_and_empty_texts(results):
    for row in results["op1"]:
        if row.doc_id in (3, 4, 5):
            assert row.n_tokens == 1 and row.score < 0
    for name in ("op2", "op4"):
        for row in results[name]:
            if row.doc.doc_id in (3, 4, 5):
                assert row.n_words == 0
    for row in results["op5"]:
        if not row.doc.text:
            assert row.n_tokens_before == 0
    for row in results["op3"]:
        assert row.doc_id not in (3, 4, 5) or (row.size, row.taken) == (0, 0)
    for row in results["op7"]:
        assert 0 <= row.score <= 1
    for row in results["op8"]:
        assert row.license == ("cc-by-4.0" if row.doc_id == 8 else None)


def test_repeated_rows(results):
    removed = sorted(r.n_removed for r in results["op2"] if r.doc.doc_id == 1)
    assert removed == [0, len(COPY.split())]
    copies = [r for r in results["op9"] if r.doc_id == 1]
    assert [(r.class_id, r.n_copies, r.n_links) for r in copies] == [(1, 2, 1)] * 2
    found = sorted((r.doc_id, r.item_id or 0) for r in results["op10"])
    assert found == [(1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (2, 1), (6, 5)]


def test_words_without_links_stand_alone(results):
    alone = [r for r in results["op9"] if r.n_grams == 0]
    assert len(alone) == 4 and len({r.class_rid for r in alone}) == 4


def test_documents_that_stages_keep(odd, labels, items):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    clean = contamination.without_items(odd, items)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 7, 8, 9, None}
    fine = toxicity.without_toxic(odd, labels)
    assert fine.columns == odd.columns


def test_held_out_follows_the_id(results):
    for row in results["op1"]:
        assert row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 2)


@pytest.mark.parametrize("module", [substrings, jaccard, contamination])
def test_numbers_hold_when_splits_change_between_jobs(spark, items, monkeypatch, module):
    """Executors that come or go change the splits of a scan, and so the numbers of its rows."""
    rows = [(d, COPY + f" tail {d}." if d % 3 == 0 else " ".join(f"own{d}x{i}" for i in range(80)), "a") for d in range(24)]
    docs = stored(spark.createDataFrame(rows, SCHEMA).repartition(8, "doc_id"), "splits")
    own = [d for d in range(24) if d % 3]
    key, calls = "spark.sql.files.minPartitionNum", []

    def shift():
        calls.append(1)
        spark.conf.set(key, "1" if len(calls) % 2 else "64")

    def shifted(df, purpose):
        out = stored(df, purpose)
        shift()
        return out

    monkeypatch.setattr(module, "stored", shifted)
    try:
        shift()
        if module is substrings:
            got = {r.doc.doc_id: r.n_removed for r in substrings.remove_repeated(docs).collect()}
            assert got == {d: 0 if d in own or d == 0 else len(COPY.split()) + 1 for d in range(24)}
        elif module is jaccard:
            assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [0, *own]
        else:
            kept = contamination.without_items(docs, items)
            assert sorted(r.doc_id for r in kept.collect()) == own
    finally:
        spark.conf.unset(key)
