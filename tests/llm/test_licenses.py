"""Licences as they stand in files: wrapped, embedded, commented, changed a little, and texts without any."""

import pytest

from flowtide.llm import licenses as lic
from flowtide.llm.common import stored

PROSE = "Some words of a file that stand before it. "


def wrapped(text, width=60, start="# "):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += (" " if line else "") + word
    return "\n".join(start + x for x in [*lines, line])


def changed(text, every=19):
    """Every so manieth word is another."""
    return " ".join("other" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def cases():
    yield "SPDX-License-Identifier: MIT", {"mit"}
    yield "// spdx-license-identifier: (MIT OR Apache-2.0).\ncode", {"mit", "apache-2.0"}
    yield "x SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 y", {"gpl-2.0-only", "classpath-exception-2.0"}
    yield "The source code is released under the MIT License, see the file LICENSE.", {"mit"}
    yield "Licensed under the Apache License,\nVersion 2.0.", {"apache-2.0"}
    yield lic._MIT_GRANT, {"mit"}
    for name, texts in lic.TEMPLATES.items():
        for text in texts:
            yield text, {name}
            yield PROSE * 3 + wrapped(text) + "\n\n" + PROSE, {name}
            yield PROSE + wrapped(text.upper(), 40, " * ") + PROSE * 20, {name}
            if len(text.split()) >= 25:
                yield PROSE + changed(text), {name}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, text) for i, (text, _) in enumerate(cases())]
    return {r.doc_id: r for r in lic.scan_licenses(stored(spark.createDataFrame(rows, "doc_id long, text string"), "licences")).collect()}


def test_recall(scanned):
    found = [want <= set(scanned[i].licenses) for i, (_, want) in enumerate(cases())]
    assert sum(found) / len(found) > 0.95
    assert all(found[:6])


def test_the_best_is_the_right_one(scanned):
    right = [scanned[i].license in want for i, (_, want) in enumerate(cases())]
    assert sum(right) / len(right) > 0.95


def test_texts_without_licence(spark):
    texts = [PROSE * 40, "", None, "rights", "all rights of man are reserved to him", "the license of the driver was revoked in version 2 of the story",
             "free software is released under many terms", "you can redistribute the public letters, as published by the general"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.license, r.dice, r.n_matches, r.licenses) == (None, None, 0, []) for r in got)


def test_overlapping_licences_yield_the_better_one(spark):
    rows = [(1, lic._GNU.format("", 3)), (2, lic._GNU_2.format("", 2)), (3, lic._GNU.format("", 3) + " " + PROSE + lic._GNU_2.format("", 2))]
    got = {r.doc_id: r.licenses for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["gpl-3.0"] and got[2] == ["gpl-2.0"] and got[3] == ["gpl-2.0", "gpl-3.0"]


def test_no_shuffle_and_no_python(spark):
    plan = lic.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan


def test_long_repetition_of_one_statement(spark):
    rows = [(1, "all rights reserved " * 5000), (2, "w " * 60_000 + "Released under the MIT License.")]
    got = {r.doc_id: r for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == "all-rights-reserved" and got[2].license == "mit"
