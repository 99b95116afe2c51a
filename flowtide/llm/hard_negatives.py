"""Hard negatives by window search in a multiway hyperplane tree (GNAT).

1. Vectors become whole numbers; the score of two rows is their inner product.
2. The tree is fitted on a bounded sample. A node has up to ``WAYS`` split points and a
   vector goes to the nearest one, so the parts are cut by hyperplanes between them.
   Split points are broadcast: ``MOST_LEAVES`` bounds them.
3. Every row goes down the tree to its leaf. A leaf is cut into cells of about
   ``CELL_ROWS`` rows by a hash of the row number, so that a leaf of a third of all
   rows is many cells. Each node stores, for any two of its split points ``i`` and
   ``j``, the range of distances from ``i`` to the vectors below ``j``, and the range
   of their norms.
4. A window of scores is, given the norms below a split point, an annulus of distances
   around the anchor. What no point of the annulus can reach by the triangle inequality
   over the stored ranges is eliminated; the anchor goes to the cells of all other
   leaves, where scores are computed exactly. So no result is lost.
5. First the window above the fifth best positive that the sample knows gives the
   positives, then one window for each positive gives its negatives; the sample narrows
   those too.

Anchors are the stated query set. They meet the cells in blocks; a task holds one cell
and ``ANCHORS`` anchors at a time.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_tasks, stored, table

#: Rows the tree is fitted on at most, by hash of the row number.
SAMPLE = 16_384
WAYS, MOST_LEAVES, CELL_ROWS = 8, 4096, 1024
#: Anchors whose scores with a cell are computed at a time.
ANCHORS = 256
#: Visits that a task writes at a time.
OUT_ROWS = 4096
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of its positive.
LEAST, MOST = 50, 95
#: Components of this size or more could leave 64-bit scores.
HUGE = 1 << 28
NO_ID = (1 << 63) - 1


class Tree:
    """Split points of each node and where each leads: a node, or a leaf as ``-1 - leaf``."""

    def __init__(self):
        self.points: list[np.ndarray] = []
        self.to: list[np.ndarray] = []
        self.leaves = 0
        #: By node: ranges of distances (i, j, 2) and of norms (j, 2).
        self.spans: list[np.ndarray] = []
        self.norms: list[np.ndarray] = []

    def leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def distances(self, node: int, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.points[node])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            way = self.distances(node, x[rows]).argmin(1)
            for j, to in enumerate(self.to[node]):
                own = rows[way == j]
                if to < 0:
                    out[own] = -1 - to
                elif len(own):
                    todo.append((int(to), own))
        return out

    def paths(self) -> dict[int, list[tuple[int, int]]]:
        """The nodes above each leaf, and the split point that leads there."""
        out, todo = {0: []}, [(0, [])] if self.points else []
        while todo:
            node, above = todo.pop()
            for j, to in enumerate(self.to[node].tolist()):
                path = [*above, (node, j)]
                if to < 0:
                    out[-1 - to] = path
                else:
                    todo.append((to, path))
        return out

    def reached(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Leaves that may hold a row with a score in ``[low, high]`` with ``x``, and for which of the ``x``."""
        norm = (x * x).sum(1)
        if not self.points:
            return [(0, np.flatnonzero(low <= high))]
        out, todo = [], [(0, np.flatnonzero(low <= high))]
        while todo:
            node, rows = todo.pop()
            d = self.distances(node, x[rows])
            near, far = self.spans[node][..., 0], self.spans[node][..., 1]
            least, most = self.norms[node].T
            # Squared distances of the window's scores, for the norms below each j.
            outer = norm[rows, None] + most - 2 * low[rows, None]
            inner = norm[rows, None] + least - 2 * high[rows, None]
            # Room for the rounding of distances.
            room = 1e-6 * (1 + np.sqrt(norm[rows, None]) + np.sqrt(np.maximum(most, 0)) + d.max(1, keepdims=True))
            slack = room * room + 1e-9 * (norm[rows, None] + np.maximum(most, 0))
            outer, inner = np.sqrt(np.maximum(outer + slack, 0)), np.sqrt(np.maximum(inner - slack, 0))
            open_ = (outer > 0) & (most >= least)
            for i in range(d.shape[1]):
                own = d[:, i : i + 1]
                open_ &= own + far[i] + room >= inner
                open_ &= np.maximum(own - far[i], near[i] - own) - room <= outer
            for j, to in enumerate(self.to[node]):
                own = rows[open_[:, j]]
                if len(own):
                    if to >= 0:
                        todo.append((int(to), own))
                    else:
                        out.append((int(-1 - to), own))
        return out


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def fit_tree(sample: np.ndarray, leaves: int, ways: int = WAYS, seed: int = 13) -> Tree:
    """A tree of about ``leaves`` leaves. Split points are far from each other: greedy choice among three times as many."""
    tree, random = Tree(), np.random.default_rng(seed)
    enough = max(1.0, len(sample) / max(leaves, 1))

    def grow(rows: np.ndarray) -> int:
        if len(rows) < max(2, 1.5 * enough) or tree.leaves + ways > MOST_LEAVES:
            return tree.leaf()
        several = int(min(ways, np.ceil(len(rows) / enough)))
        candidates = sample[random.choice(rows, min(len(rows), 3 * several), replace=False)]
        chosen = [0]
        gap = _distances(candidates, candidates[:1])[:, 0]
        while len(chosen) < several and gap.max() > 1e-3:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _distances(candidates, candidates[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return tree.leaf()
        node = len(tree.points)
        tree.points.append(candidates[chosen])
        tree.to.append(np.zeros(len(chosen), np.int64))
        way = tree.distances(node, sample[rows]).argmin(1)
        for j in range(len(chosen)):
            tree.to[node][j] = grow(rows[way == j])
        return node

    if leaves > 1 and len(sample) > 1:
        grow(np.arange(len(sample)))
    if not tree.points:
        tree.leaves = 1
    return tree


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of floats; a shorter one ends in zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def whole_vectors(rows: DataFrame, row_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """Stored ``rid``, ``vec_id``, ``label``, ``vec``: the rows that take part, their components scaled and floored."""
    odd = f"exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) >= {HUGE}.0D)"
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(row_id).cast("long").alias("vec_id"),
            F.col(label).cast("long").alias("label"),
            F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale))).alias("vec"),
        )
        .where(f"label IS NOT NULL AND vec IS NOT NULL AND NOT coalesce({odd}, true)")
        .withColumn("vec", F.expr("transform(vec, x -> CAST(floor(x) AS INT))")),
        "vectors",
    )


RANGES = "node int, i int, j int, least double, most double"


def _leaves(batches: Iterable[pa.RecordBatch], tree: Tree, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf = tree.leaf_of(_matrix(batch.column("vec"), width))
        columns = [*batch.columns, pa.array(leaf, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "leaf"])


def _ranges(batches: Iterable[pa.RecordBatch], tree: Tree, width: int) -> Iterator[pa.RecordBatch]:
    """Ranges of distances (``i``, ``j``) and of norms (``i`` is -1) over a task's rows."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    paths = tree.paths()
    for batch in batches:
        leaf = batch.column("leaf").to_numpy()
        whole = _matrix(batch.column("vec"), width)
        for of in np.unique(leaf).tolist():
            x = whole[leaf == of]
            for node, j in paths[of]:
                measured = np.column_stack([tree.distances(node, x), (x * x).sum(1)])
                k = len(tree.points[node])
                least, most = found.setdefault(node, (np.full((k + 1, k), np.inf), np.full((k + 1, k), -np.inf)))
                least[:, j] = np.minimum(least[:, j], measured.min(0))
                most[:, j] = np.maximum(most[:, j], measured.max(0))
    for node, (least, most) in found.items():
        i, j = np.nonzero(most >= least)
        k = len(least) - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(i), node), pa.int32()),
                pa.array(np.where(i == k, -1, i), pa.int32()),
                pa.array(j, pa.int32()),
                pa.array(least[i, j]),
                pa.array(most[i, j]),
            ],
            names=["node", "i", "j", "least", "most"],
        )


def _with_ranges(tree: Tree, ranges: Iterable) -> Tree:
    for points in tree.points:
        k = len(points)
        span, norm = np.zeros((k, k, 2)), np.zeros((k, 2))
        # An empty part has an empty range.
        span[..., 0], span[..., 1], norm[:, 0], norm[:, 1] = np.inf, 0, np.inf, -1
        tree.spans.append(span)
        tree.norms.append(norm)
    for r in ranges:
        (tree.norms[r.node][r.j] if r.i < 0 else tree.spans[r.node][r.i, r.j])[:] = r.least, r.most
    return tree


class Index:
    """What an anchor needs to know before it meets the cells: broadcast, and bounded by ``SAMPLE`` and ``MOST_LEAVES``."""

    def __init__(self, tree: Tree, cells: np.ndarray, width: int, sample: np.ndarray, sample_labels: np.ndarray, sample_rids: np.ndarray):
        self.tree, self.cells, self.width = tree, cells, width
        self.sample, self.sample_labels, self.sample_rids = sample, sample_labels, sample_rids


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floats while they stay below 2**53, else in whole numbers."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


VISITS = pa.schema(
    [
        ("leaf", pa.int64()),
        ("cell", pa.int64()),
        ("rid", pa.int64()),
        ("vec_id", pa.int64()),
        ("label", pa.int64()),
        ("vec", pa.list_(pa.int32())),
        ("low", pa.list_(pa.int64())),
        ("high", pa.list_(pa.int64())),
        ("to", pa.list_(pa.int64())),
    ]
)
VISITS_DDL = "leaf long, cell long, rid long, vec_id long, label long, vec array<int>, low array<long>, high array<long>, to array<long>"
FAR = 1 << 62


def _narrow(scores: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best allowed score of the window that the sample knows, or ``low``."""
    out = low.copy()
    for a in range(len(scores)):
        known = np.sort(scores[a][allowed[a]])
        for w in range(low.shape[1]):
            last = np.searchsorted(known, high[a, w], "right")
            if last >= k:
                out[a, w] = max(low[a, w], known[last - k])
    return out


def _windows(column: pa.Array, missing: int) -> np.ndarray:
    """Bounds of the windows, as many columns as the most that an anchor has."""
    lists = column.to_pylist()
    most = max(map(len, lists), default=0)
    return np.array([own + [missing] * (most - len(own)) for own in lists], np.int64).reshape(len(lists), most)


def _visits(batches: Iterable[pa.RecordBatch], index: Index, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Anchors with windows to the cells that may hold what they look for."""
    for whole in batches:
        for start in range(0, whole.num_rows, ANCHORS):
            batch = whole.slice(start, ANCHORS)
            x = _matrix(batch.column("vec"), index.width)
            label = batch.column("label").to_numpy()
            # A window that an anchor lacks is empty.
            low, high = _windows(batch.column("low"), FAR), _windows(batch.column("high"), -FAR)
            allowed = index.sample_labels[None, :] == label[:, None]
            if same:
                allowed &= index.sample_rids[None, :] != batch.column("rid").to_numpy()[:, None]
            else:
                allowed = ~allowed
            low = _narrow(_scores(x, index.sample), low, high, allowed, k)
            windows = low.shape[1]
            lows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * windows), pa.array(low.ravel()))
            # Each window of an anchor by itself; a leaf that one of them reaches is visited once.
            many = np.repeat(x, windows, axis=0)
            for leaf, rows in index.tree.reached(many, low.ravel().astype(float), high.ravel().astype(float)):
                own = np.unique(rows // windows)
                n = int(index.cells[leaf])
                for first in range(0, len(own) * n, OUT_ROWS):
                    pair = np.arange(first, min(first + OUT_ROWS, len(own) * n))
                    at = pa.array(own[pair // n])
                    columns = [batch.column(c).take(at) for c in ("rid", "vec_id", "label", "vec")]
                    columns += [lows.take(at), batch.column("high").take(at), batch.column("to").take(at)]
                    columns = [pa.array(np.full(len(pair), leaf), pa.int64()), pa.array(pair % n, pa.int64()), *columns]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, VISITS)], schema=VISITS)


FOUND = "anchor long, anchor_id long, window int, positive_id long, score long, vec_id long"


def _meet(batches: Iterable[pa.RecordBatch], width: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Cells and their visitors, sorted so that a cell's rows come first, to the ``k`` best of each window."""
    cell, parts = None, []
    held = None

    def close():
        """The cell's rows by id, the least first."""
        if not parts:
            return None
        batch = pa.concat_batches(parts)
        ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
        order = np.lexsort((batch.column("vec_id").is_null().to_numpy(zero_copy_only=False), ids))
        batch = batch.take(pa.array(order))
        return _matrix(batch.column("vec"), width), batch.column("label").to_numpy(), batch.column("rid").to_numpy(), batch.column("vec_id")

    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, number = batch.column("leaf").to_numpy(), batch.column("cell").to_numpy()
        visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(number) != 0) | (np.diff(visitor.astype(int)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if (leaf[a], number[a]) != cell:
                cell, parts, held = (leaf[a], number[a]), [], None
            if not visitor[a]:
                parts.append(batch.slice(a, b - a))
                continue
            if held is None:
                held, parts = close(), []
            if held is not None:
                for start in range(a, b, ANCHORS):
                    yield _best(batch.slice(start, min(ANCHORS, b - start)), held, width, same, k)


def _best(visitors: pa.RecordBatch, held: tuple, width: int, same: bool, k: int) -> pa.RecordBatch:
    rows, labels, rids, ids = held
    scores = _scores(_matrix(visitors.column("vec"), width), rows)
    allowed = labels[None, :] == visitors.column("label").to_numpy()[:, None]
    if same:
        allowed &= rids[None, :] != visitors.column("rid").to_numpy()[:, None]
    else:
        allowed = ~allowed
    lows, highs, to = (visitors.column(c).to_pylist() for c in ("low", "high", "to"))
    anchors, anchor_ids = visitors.column("rid").to_pylist(), visitors.column("vec_id").to_pylist()
    out: list[list] = [[] for _ in range(5)]
    places = []
    for a in range(len(scores)):
        some = np.flatnonzero(allowed[a])
        own = scores[a][some]
        # By score, the greatest first; rows are in order of their ids.
        order = np.argsort(-own, kind="stable")
        ranked = -own[order]
        for w, (low, high) in enumerate(zip(lows[a], highs[a])):
            first = np.searchsorted(ranked, -high, "left")
            last = min(first + k, np.searchsorted(ranked, -low, "right"))
            for at in order[first:last]:
                places.append(some[at])
                for column, value in zip(out, (anchors[a], anchor_ids[a], w, to[a][w], own[at])):
                    column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, t) for c, t in zip(out, kinds)), ids.take(pa.array(places, pa.int64()))],
        names=["anchor", "anchor_id", "window", "positive_id", "score", "vec_id"],
    )


def _search(anchors: DataFrame, cells: DataFrame, index, width: int, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each window of ``anchors``, by score, then id: ``FOUND`` and ``rank``."""
    visits = anchors.mapInArrow(lambda it: _visits(it, index.value, same, k), VISITS_DDL)
    met = (
        cells.withColumn("visitor", F.lit(False))
        .unionByName(visits.withColumn("visitor", F.lit(True)), allowMissingColumns=True)
        .repartition("leaf", "cell")
        .sortWithinPartitions("leaf", "cell", "visitor")
        .mapInArrow(lambda it: _meet(it, width, same, k), FOUND)
    )
    # Partial ranks come before the shuffle, so a window brings k rows a task.
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame,
    anchors: Callable[[Column], Column] | None = None,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    scale: int = SCALE,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
    ways: int = WAYS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id ``anchors`` accepts (default: all). The positives of an
    anchor are its ``positives`` best other rows of its label; the negatives of a pair its
    ``negatives`` best rows of other labels whose score is between ``least`` and ``most``
    hundredths of the positive's. Scores are inner products of components scaled and
    floored; ties go to the smaller id, null last. Results are exact, whatever the tree.

    Rows without a label or vector, or with a component that is null, not finite or, once
    scaled, ``HUGE`` or more, take no part. Components that a shorter vector lacks are
    zero. Repeated rows are rows of their own: a copy of an anchor is its positive, or an
    anchor too. Anchors without positives, and pairs without negatives, give no row.
    """
    spark = rows.sparkSession
    python_tasks(spark)
    known = whole_vectors(rows, row_id, vector, label, scale)
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = max(1, size["n"]), max(1, size["width"] or 1)
    # About twice the sample by a cut of the hash, then the least of those: no sort of all rows.
    share = min(1.0, 2 * sample / n)
    hashed = F.xxhash64("rid")
    drawn = known.where(hashed <= F.lit(int((1 << 63) * (2 * share - 1)) - 1 if share < 1 else (1 << 63) - 1))
    drawn = drawn.orderBy(hashed, "rid").limit(sample).select("rid", "label", "vec").toArrow()
    drawn = pa.concat_batches(drawn.to_batches()) if drawn.num_rows else pa.RecordBatch.from_pylist([], drawn.schema)
    points = _matrix(drawn.column("vec"), width) if drawn.num_rows else np.zeros((0, width))
    tree = fit_tree(points, min(MOST_LEAVES, -(-n // cell_rows)), ways)
    splits = spark.sparkContext.broadcast(tree)
    leaved = stored(
        known.mapInArrow(lambda it: _leaves(it, splits.value, width), "rid long, vec_id long, label long, vec array<int>, leaf long"),
        "leaves",
    )
    # A row for each leaf, and for each two split points of a node.
    counts = {r.leaf: r["n"] for r in leaved.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = np.array([max(1, -(-counts.get(leaf, 0) // cell_rows)) if leaf in counts else 0 for leaf in range(tree.leaves)])
    per_leaf = spark.createDataFrame([(leaf, int(c)) for leaf, c in enumerate(cells)], "leaf long, cells long")
    placed = leaved.join(F.broadcast(per_leaf), "leaf").select(
        "leaf", F.pmod(F.xxhash64("rid"), F.col("cells")).alias("cell"), "rid", "vec_id", "label", "vec"
    )
    # By cell, so that a task meets few nodes and returns few ranges.
    ranges = placed.repartition("leaf", "cell").mapInArrow(lambda it: _ranges(it, splits.value, width), RANGES)
    ranges = ranges.groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
    found = Index(
        _with_ranges(tree, ranges),
        cells,
        width,
        points,
        drawn.column("label").to_numpy() if drawn.num_rows else np.zeros(0, np.int64),
        drawn.column("rid").to_numpy() if drawn.num_rows else np.zeros(0, np.int64),
    )
    index = spark.sparkContext.broadcast(found)

    asked = leaved if anchors is None else leaved.where(anchors(F.col("vec_id")))
    asked = asked.select("rid", "vec_id", "label", "vec")
    everything = asked.withColumns({"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR)), "to": F.array(F.lit(None).cast("long"))})
    near = stored(
        _search(everything, placed, index, width, True, positives)
        .groupBy("anchor")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")),
        "positives",
    )
    # Upper and lower whole numbers of hundredths, below zero too.
    windows = near.select(
        F.col("anchor").alias("rid"),
        F.expr(f"transform(positives, p -> p.score * {least} DIV 100 + int(pmod(p.score * {least}, 100) > 0 AND p.score > 0))").alias("low"),
        F.expr(f"transform(positives, p -> p.score * {most} DIV 100 - int(pmod(p.score * {most}, 100) > 0 AND p.score < 0))").alias("high"),
        F.col("positives.vec_id").alias("to"),
        F.col("positives.score").alias("to_scores"),
    )
    hunting = asked.join(windows, "rid")
    found_negatives = _search(hunting, placed, index, width, False, negatives)
    pairs = windows.select(F.col("rid").alias("anchor"), F.posexplode("to_scores").alias("window", "positive_score"))
    return found_negatives.join(pairs, ["anchor", "window"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def noisy_labels(embeddings: DataFrame) -> DataFrame:
    """The query's table: where ``vec_id`` is divisible by 7, the next of ten labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", label.alias("label"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(noisy_labels(table(spark, sf_dir, "embeddings")), lambda vec_id: vec_id % 50 == 0)


OP13_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
), fit AS (
  SELECT rid, vec_id, label, vec FROM vectors
  WHERE label IS NOT NULL AND vec IS NOT NULL AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 50 = 0 AND a.rid <> b.rid
), positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
