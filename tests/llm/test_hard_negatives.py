"""Hard negatives against brute force: trees of many leaves, ties, copies, odd rows."""

import math
import os

import numpy as np
import pytest

from flowtide.llm import hard_negatives as hard
from flowtide.llm.common import stored
from pyspark.sql import functions as F

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, is_anchor, positives=5, negatives=3):
    fit = []
    for at, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fit.append((at, vec_id, label, [math.floor(256 * float(x)) for x in vector]))

    def order(pair):
        score, vec_id = pair
        return -score, vec_id is None, vec_id or 0

    out = []
    for at, vec_id, label, vector in fit:
        if vec_id is None or not is_anchor(vec_id):
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), i, own) for other, i, own, v in fit if other != at]
        for ps, p in sorted(((s, i) for s, i, own in scored if own == label), key=order)[:positives]:
            window = [(s, i) for s, i, own in scored if own != label and 50 * ps <= 100 * s <= 95 * ps]
            for rank, (ns, n) in enumerate(sorted(window, key=order)[:negatives], 1):
                out.append((vec_id, p, rank, n, ps, ns))
    return sorted(out, key=repr)


def mined(df, is_anchor, **sizes):
    found = hard.mine_negatives(df, is_anchor, **sizes)
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, found.collect()), key=repr)


def some_rows(seed, n=600, dims=6):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 1, (5, dims))
    rows = []
    for i in range(n):
        v = centres[i % 5] + random.normal(0, 0.4, dims)
        v = np.round(v / np.linalg.norm(v) * random.choice([1, 1, 1, 2]), 2 if i % 3 else 7)
        rows.append((i, v.astype(np.float32).tolist(), int(random.integers(0, 4))))
    rows += [rows[7], rows[7], (50, rows[9][1], 1), (None, rows[3][1], 2), (-100, rows[3][1], 2)]
    rows += [(100 + i, rows[11][1], i % 2) for i in range(60)]
    rows += [(900, None, 1), (950, rows[1][1], None), (50, [None] * dims, 1), (150, [float("nan")] + [0.0] * (dims - 1), 1)]
    rows += [(1000, [float("inf")] * dims, 0), (1050, [], 1), (1100, rows[2][1][:3], 2), (1150, [0.0] * dims, 1)]
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, {"cell_rows": 16, "ways": 4}), (2, {"cell_rows": 40, "sample": 200, "ways": 8}), (3, {})])
def test_against_brute_force(spark, seed, sizes):
    rows = some_rows(seed)
    df = stored(spark.createDataFrame(rows, SCHEMA).repartition(4), "vectors-in")
    assert mined(df, lambda i: i % 50 == 0, **sizes) == by_hand(rows, lambda i: i % 50 == 0)


def test_other_columns_and_no_rows(spark):
    rows = some_rows(4, 100)
    clashing = ("rid", "leaf", "cell", "vec", "low", "high", "to", "anchor", "rank", "score", "visitor")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in clashing})
    assert mined(df, lambda i: i % 50 == 0, cell_rows=16) == by_hand(rows, lambda i: i % 50 == 0)
    assert mined(spark.createDataFrame([], SCHEMA), None) == []
    assert mined(spark.createDataFrame([(0, [], 1), (50, [], 1), (1, [], 2)], SCHEMA), None) == by_hand(
        [(0, [], 1), (50, [], 1), (1, [], 2)], lambda i: True
    )


def test_scores_beyond_floats_stay_exact(spark):
    rows = [(i, [float(1 << 19) + i / 256, -3.0 * i, 0.5], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert mined(df, None, cell_rows=8) == by_hand(rows, lambda i: True)


def test_annuli_eliminate_and_lose_nothing():
    """What the tree leaves out holds no score of the window; on clustered vectors it leaves out most."""
    random = np.random.default_rng(5)
    x = np.floor(256 * (random.normal(0, 1, (12, 4))[random.integers(0, 12, 4000)] + random.normal(0, 0.05, (4000, 4))))
    tree = hard.fit_tree(x[:1000], 60)
    leaf = tree.leaf_of(x)
    assert tree.leaves > 30
    paths, ranges = tree.paths(), {}
    for of in np.unique(leaf):
        for node, j in paths[of]:
            measured = np.column_stack([tree.distances(node, x[leaf == of]), (x[leaf == of] ** 2).sum(1)])
            for i, (a, b) in enumerate(zip(measured.min(0), measured.max(0))):
                key = (node, -1 if i == measured.shape[1] - 1 else i, j)
                old = ranges.get(key, (np.inf, -np.inf))
                ranges[key] = (min(old[0], a), max(old[1], b))
    from collections import namedtuple

    Range = namedtuple("Range", "node i j least most")
    hard._with_ranges(tree, [Range(*k, *v) for k, v in ranges.items()])
    asked = x[:40]
    scores = asked @ x.T
    low, high = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.95, axis=1)
    open_ = np.zeros((40, tree.leaves), bool)
    for of, rows in tree.reached(asked, low, high):
        open_[rows, of] = True
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    assert not (inside & ~open_[:, leaf]).any()
    assert open_.mean() < 0.5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_query(spark):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in map(tuple, spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect())]
    want = by_hand(rows, lambda i: i % 50 == 0)
    assert sorted(map(tuple, hard.op13_hard_negatives(spark, SF_DIR).collect()), key=repr) == want
