"""Language identification: features and gradients by the plainest code, held-out labels, odd tables."""

import os
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowtide.llm import language_id as lid
from flowtide.llm.common import stored
from pyspark.sql import functions as F

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string"
#: Three languages of one family and one of another, by their syllables.
SYLLABLES = {"es": "ción mente ado que los ña", "pt": "ção mente ado que os nha", "it": "zione mente ato che gli gna", "de": "ung keit sch der die ich"}


def texts(seed, n=160):
    random.seed(seed)
    rows = []
    for i in range(n):
        lang = random.choice(list(SYLLABLES))
        words = ["".join(random.choices(SYLLABLES[lang].split(), k=random.randint(1, 3))) for _ in range(random.randint(6, 60))]
        rows.append((i, random.choice([" ", "\n", ", ", " ## "]).join(words).title() + "!", lang))
    return rows


def grams(text):
    """Counts of 1- to 3-grams of the lower-case text, words between single spaces."""
    kept, letters = [" "], 0
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        letters += kind == "L"
        if kind in "LM":
            kept.append(c)
        elif kept[-1] != " ":
            kept.append(" ")
    if kept[-1] != " ":
        kept.append(" ")
    joined = "".join(kept)
    found = Counter(joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1))
    del found[" "]
    return found, letters


def test_vectors_are_shares_of_grams():
    some = ["Hello, World", "", None, "x", "漢字 ñandú", "###", "áb c", "  ab  ", "İ\U0001f600z"]
    for (numbers, values, letters), text in zip(lid._vectors(some), some):
        found, want = grams(text or "")
        assert letters == want
        total = sum(found.values())
        # Grams of one bucket add up; none of these share one.
        assert np.allclose(sorted(values), sorted(np.sqrt(n / max(1, total)) for n in found.values()))
        assert len(numbers) == len(found)
    alone = [list(v[0]) for t in some for v in lid._vectors([t])]
    assert alone == [list(v[0]) for v in lid._vectors(some)]


def loss(model, counts, rows):
    """Class-balanced losses of all classifiers, added up."""
    n, out = len(model.families), 0.0
    sizes = [sum(counts[x] for x in own) for own in model.families]
    for lang, numbers, values in rows:
        axis = values.astype(float) @ model.weights[numbers].astype(float) + model.weights[-1]
        of = next(f for f, own in enumerate(model.families) if lang in own)
        out += (np.log(np.exp(axis[:n]).sum()) - axis[of]) / (n * sizes[of])
        for f, (_, a, b) in zip(axis[n:], model.pairs):
            if lang in (a, b):
                out += 0.5 * max(0.0, 1 - (f if lang == a else -f)) ** 2 / counts[lang]
    return out


def test_gradient_against_finite_differences():
    rows = texts(1, 20)
    vectors = [(lang, n, v) for (_, _, lang), (n, v, _) in zip(rows, lid._vectors([t for _, t, _ in rows]))]
    counts = Counter(lang for lang, _, _ in vectors)
    random = np.random.default_rng(2)
    model = lid.Model([["de"], ["es", "it", "pt"]])
    model.weights = random.normal(0, 0.3, (lid.BUCKETS + 1, 5))
    batch = pa.RecordBatch.from_pydict(
        {"lang": [x for x, _, _ in vectors], "numbers": [n.astype(np.int32).tobytes() for _, n, _ in vectors], "values": [v.tobytes() for _, _, v in vectors]}
    )
    (got,) = lid._gradient([batch], model, counts)
    gradient = np.frombuffer(got.column("gradient")[0].as_py(), np.float32).reshape(model.weights.shape)
    for place in [(int(vectors[0][1][3]), 1), (int(vectors[4][1][0]), 0), (-1, 3), (int(vectors[9][1][5]), 2), (int(vectors[3][1][1]), 4)]:
        old, ends = model.weights[place], []
        for shift in (1e-5, -1e-5):
            model.weights[place] = old + shift
            ends.append(loss(model, counts, vectors))
        model.weights[place] = old
        assert gradient[place] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_duels_within_the_family():
    model = lid.Model([["de"], ["es", "it", "pt"]])
    assert model.pairs == [(1, "es", "it"), (1, "es", "pt"), (1, "it", "pt")]
    axes = np.array([[0, 5, -1, -1, 2], [9, 0, 1, 1, 1], [0, 5, 1, -2, 1]], float)
    found = model.predict(axes)
    assert [(f, x) for f, x, _ in found] == [("es", "it"), ("de", "de"), ("es", "pt")]
    assert all(0 <= s <= 1 for _, _, s in found)


def test_close_languages_and_odd_rows(spark):
    rows = texts(3)
    odd = [(None, None, None), (900, None, "es"), (901, "", "de"), (902, "12 %$ \t", "pt"), (903, "ungkeit", None), (903, "ungkeit", None)]
    odd += [(904, "mente ção " * 40_000, "pt"), (None, "ichich schung", "de")]
    df = stored(spark.createDataFrame(rows + odd, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in ("doc", "score", "lang_pred", "family", "numbers")}), "docs")
    model = lid.train(df.where("doc_id % 4 <> 2"))
    assert model.families == [["de"], ["es", "it", "pt"]]
    got = lid.identify(df, model, "doc_id", "lang", "score").collect()
    assert len(got) == len(rows) + len(odd) and all(r.doc.score == "score" for r in got)
    held = [r for r in got if r.doc.doc_id is not None and r.doc.doc_id < 900 and r.doc.doc_id % 4 == 2]
    assert np.mean([r.lang_pred == r.doc.lang for r in held]) >= 0.95
    by_id = {r.doc.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (900, 901, 902)] == ["und"] * 3 and by_id[903] == "de" and by_id[904] == "pt"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = lid.train(none)
    assert lid.identify(none, model, "doc_id").collect() == []
    some = spark.createDataFrame([(1, "abc", None), (2, None, "en")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in lid.identify(some, lid.train(some), "doc_id").collect()] == [("und", 0.0)] * 2
    one = lid.train(spark.createDataFrame([(1, "abc", "xx")], SCHEMA))
    assert [r.lang_pred for r in lid.identify(some, one, "doc_id").collect()] == ["xx", "und"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_query_on_held_out_labels(spark):
    got = lid.op11_language_id(spark, SF_DIR).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97
