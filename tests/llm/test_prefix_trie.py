"""The trie of conversation beginnings against the plainest code, and on odd tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from flowtide.llm import prefix_trie as trie
from flowtide.llm.common import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """Nodes of (conv_id, turn, role, text) rows, walked one by one."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv_id].append(((turn is not None, turn), tie, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = defaultdict(lambda: {"members": [], "ends": [], "children": set()})
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100
        whole = tuple(own.get(base, [])[:h] + path[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]]["members"].append(c)
            if d:
                nodes[whole[: d - 1]]["children"].add(whole[:d])
        nodes[whole]["ends"].append(c)

    def below(key):
        todo, leaves, saved = [key], 0, 0
        while todo:
            at = todo.pop()
            node = nodes[at]
            leaves += not node["children"]
            saved += (len(node["members"]) - 1) * (len(at[-1][1]) if at else 0)
            todo.extend(node["children"])
        return leaves, saved

    out = []
    for key, node in nodes.items():
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        parent = min(nodes[key[:-1]]["members"]) if key else None
        out.append((min(node["members"]), len(key), parent, len(node["members"]), len(node["children"]), *below(key), ends))
    return sorted(out, key=repr)


def nodes_of(df, **sizes):
    found = trie.prefix_trie(*trie.splice_heads(trie.order_turns(df)), **sizes)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, found.collect()), key=repr)


def odd_rows(seed, n=70):
    """Few different turns, so that beginnings are shared, copied, nested and spliced."""
    random.seed(seed)
    rows = []
    for c in [*range(n), *range(96, 112), 200, 300, 301, 399, -5, -100, -107]:
        if random.random() < 0.1:
            continue
        length = random.choice([1, 2, 3, 4, 5, 8, 9, 13, 30])
        start = random.choice([0, 0, 1])
        for t in range(length):
            rows.append((c, t, random.choice(["user", "user", None]), random.choice(["a", "a", "éé", "", None]) if t > start else "hi"))
    rows += [(3, None, "system", "first"), (3, None, None, None), (4, 1, "user", "tie"), (4, 1, "user", "knot")]
    rows += rows[:20] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "run"), [(1, 4, 1024), (2, 4, 2), (3, 1, 1), (4, 3, 2)])
def test_against_a_walk(spark, seed, block, run):
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes_of(df, block=block, run=run) == by_hand(rows)


def test_one_long_conversation_and_many_copies(spark):
    """A conversation over several ranges, and a group of copies."""
    rows = [(500, t, "user", f"turn {t % 7}") for t in range(900)]
    rows += [(501 + c, t, "user", f"turn {t % 7}") for c in range(40) for t in range(6)]
    df = stored(spark.createDataFrame(rows, SCHEMA), "long")
    assert nodes_of(df, block=4, run=8) == by_hand(rows)


def test_clashing_columns_and_no_rows(spark):
    rows = odd_rows(5, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = ("pos", "place", "digest", "chars", "x", "depth", "block", "base", "h", "n_convs", "length")
    from pyspark.sql import functions as F

    assert nodes_of(df.withColumns({c: F.lit(c) for c in clashing})) == by_hand(rows)
    assert nodes_of(spark.createDataFrame([], SCHEMA)) == []
    assert nodes_of(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]
    assert sorted(map(tuple, trie.op12_prefix_trie(spark, SF_DIR).collect()), key=repr) == by_hand(rows)
