"""Trie of the conversations' common beginnings, by fixed-length block hashing.

1. Turns get a position. They are sorted over ranges of (conversation, turn), so a
   conversation of any length is dealt to many tasks; what straddles two ranges is
   put right by the lengths of its stretches, one row for each range it lies in.
2. A turn at a position is a 128-bit term; the digest of a beginning is the XOR of
   its terms. Blocks of ``BLOCK`` turns get the digests before and after them: running
   within runs of ``RUN`` blocks, and over the totals of the runs for the few
   conversations that are longer than a run.
3. Conversations are grouped by their successive block digests. Where all that share
   a beginning share the next block too, its turns are nodes with the same members
   and one copy of the block tells them all.
4. Only in blocks where siblings diverge, turn boundaries are refined: their turns
   are grouped one by one.
5. Sums over subtrees take no walk down the tree. Each node is credited to its
   smallest member, its owner. A conversation owns the nodes of its path from some
   depth on; so the subtree of a node holds the credits of its owner from there on
   and all credits of the other members.
"""

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_tasks, stored, table

#: Turns of a block, and blocks whose digests are strung together at a time.
BLOCK, RUN = 4, 1024

NODE = ["depth", "x", "y"]
PARENT = ["block", "bx", "by"]


def order_turns(conversations: DataFrame) -> DataFrame:
    """Stored rows ``place``, ``conv_id``, ``digest``, ``chars``, ordered by ``place`` within a conversation.

    The order is by turn, null first; turns of one number (ties) by the MD5 digest of
    role and text, so that reruns agree. Null roles and texts are empty; ``chars``
    counts code points of the text. Rows without a ``conv_id`` belong to no
    conversation and take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = ["conv_id", "turn", "digest"]
    return stored(
        conversations.where("conv_id is not null")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
            F.length(text).cast("long").alias("chars"),
        )
        .repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .select(F.monotonically_increasing_id().alias("place"), "conv_id", "digest", "chars"),
        "turns",
    )


def _stretches(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``shift``, ``n_turns``: a turn of a range is at ``place + shift`` in its conversation."""
    of_conversation = Window.partitionBy("conv_id").orderBy("part")
    return (
        turns.groupBy("conv_id", F.shiftright("place", 33).alias("part"))
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("after", F.sum("n").over(of_conversation.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n_turns", F.sum("n").over(Window.partitionBy("conv_id")))
        .selectExpr("conv_id", "part", "after - n - first + 1 AS shift", "n_turns")
    )


def splice_heads(turns: DataFrame, every: int = 100, modulo: int = 6) -> tuple[DataFrame, DataFrame]:
    """Paths in which conversations begin with turns of another.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % every`` (those it
    has), ``h = crc32(decimal c) % modulo``, and goes on with its own turns after its
    first ``h``. Returns paths (``conv_id``, ``pos`` from 1, ``digest``, ``chars``,
    ``length``) and every conversation's ``length``, 0 included.
    """
    stretches = stored(_stretches(turns), "stretches")
    base = F.col("conv_id") - F.col("conv_id") % every
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    convs = (
        stretches.select("conv_id", "n_turns")
        .distinct()
        .withColumn("base", base)
        .withColumn("h", F.when(F.col("base") == F.col("conv_id"), F.lit(0).cast("long")).otherwise(crc % modulo))
    )
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    convs = stored(
        convs.join(lengths, "base", "left").selectExpr(
            "conv_id",
            "base",
            "h",
            "least(h, coalesce(base_turns, 0L)) AS taken",
            "least(h, coalesce(base_turns, 0L)) + greatest(n_turns - h, 0L) AS length",
        ),
        "conversations",
    )
    placed = turns.withColumn("part", F.shiftright("place", 33)).join(
        stretches.join(convs, "conv_id").drop("n_turns"), ["conv_id", "part"]
    )
    own = placed.withColumn("at", F.expr("place + shift")).where("at > h")
    own = own.selectExpr("conv_id", "at - h + taken AS pos", "digest", "chars", "length")
    heads = turns.where(F.col("conv_id") % every == 0).withColumn("part", F.shiftright("place", 33))
    heads = heads.join(stretches, ["conv_id", "part"]).selectExpr(
        "conv_id AS base", "place + shift AS pos", "digest", "chars"
    )
    heads = heads.where(F.col("pos") < modulo)
    borrowed = convs.where("taken > 0").join(heads, "base").where("pos <= taken")
    borrowed = borrowed.select("conv_id", "pos", "digest", "chars", "length")
    return own.unionByName(borrowed), convs.select("conv_id", "length")


def _blocks(paths: DataFrame, block: int, run: int) -> DataFrame:
    """Stored rows of a conversation and block: digests before (``bx``, ``by``) and after it, and its turns."""
    terms = paths.select(
        "conv_id",
        "pos",
        "chars",
        "length",
        F.expr(f"(pos - 1) DIV {block}").alias("block"),
        F.expr(f"(pos - 1) DIV {block * run}").alias("run"),
        F.xxhash64(F.lit(1), "pos", "digest").alias("x"),
        F.xxhash64(F.lit(2), "pos", "digest").alias("y"),
    )
    upto = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    in_run = stored(
        terms.withColumns({"rx": F.bit_xor("x").over(upto), "ry": F.bit_xor("y").over(upto)})
        .groupBy("conv_id", "run", "block")
        .agg(
            F.first("length").alias("length"),
            F.array_sort(F.collect_list(F.struct("pos", "rx", "ry", "chars"))).alias("turns"),
            F.min_by(F.col("rx").bitwiseXOR(F.col("x")), "pos").alias("bx"),
            F.min_by(F.col("ry").bitwiseXOR(F.col("y")), "pos").alias("by"),
        ),
        "blocks",
    )
    # Conversations longer than a run: the digests of their earlier runs.
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        in_run.where(F.col("length") > block * run)
        .groupBy("conv_id", "run")
        .agg(F.max_by(F.element_at("turns", -1), "block").alias("last"))
        .select("conv_id", "run", F.bit_xor("last.rx").over(before).alias("fx"), F.bit_xor("last.ry").over(before).alias("fy"))
        .where("run > 0")
    )
    moved = "transform(turns, t -> named_struct('pos', t.pos, 'rx', t.rx ^ fx, 'ry', t.ry ^ fy, 'chars', t.chars))"
    return (
        in_run.join(stored(runs, "runs"), ["conv_id", "run"], "left")
        .selectExpr("conv_id", "block", "length", "bx", "by", "turns", "coalesce(fx, 0L) AS fx", "coalesce(fy, 0L) AS fy")
        .selectExpr("conv_id", "block", "length", "bx ^ fx AS bx", "by ^ fy AS by", f"{moved} AS turns")
        .selectExpr("*", "turns[size(turns) - 1].rx AS ax", "turns[size(turns) - 1].ry AS ay", "size(turns) AS n")
    )


def _by_turn(blocks: DataFrame, *more: str) -> DataFrame:
    """Blocks to nodes: ``depth``, ``x``, ``y``, the parent's ``px``, ``py``, ``chars``, ``more``."""
    turns = blocks.select(*more, "bx", "by", "turns", F.posexplode("turns").alias("i", "t"))
    return turns.selectExpr(
        *more,
        "t.pos AS depth",
        "t.rx AS x",
        "t.ry AS y",
        "if(i = 0, bx, turns[i - 1].rx) AS px",
        "if(i = 0, by, turns[i - 1].ry) AS py",
        "t.chars AS chars",
    )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conv_id to the SHA-256 of each node's ids, in one stream."""
    node, digest = None, None

    def rows(done):
        depth, x, y, hexes = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(depth, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(hexes, pa.string())],
            names=[*NODE, "ends_sha256"],
        )

    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in (*NODE, "conv_id"))
        for depth, x, y, conv_id in zip(*columns):
            if (depth, x, y) != node:
                if digest is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, x, y), hashlib.sha256(b"%d" % conv_id)
            else:
                digest.update(b",%d" % conv_id)
        if done:
            yield rows(done)
    if digest is not None:
        yield rows([(*node, digest.hexdigest())])


def prefix_trie(paths: DataFrame, convs: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """One row a node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``paths`` has a row for each turn (``conv_id``, ``pos`` from 1 without gaps,
    ``digest``, ``chars``, ``length`` of the conversation), ``convs`` the ``length`` of
    every conversation. A node is a distinct sequence of first ``depth`` turns, the root
    the empty one; ``conv_id`` is its least member, ``n_leaves`` the childless nodes and
    ``saved_tokens`` the sum of ``(n_convs - 1) * chars`` in its subtree, itself included.
    ``ends_sha256`` digests the ids of the members that end there, ascending, with commas
    between. Without conversations there are no nodes.

    Repeated conversations are members of the same nodes and differ by id. The digest of
    ids is a sequence by definition: the ids of one node stream through one task, in order
    and without being held.
    """
    spark = paths.sparkSession
    python_tasks(spark)
    blocks = _blocks(paths, block, run)

    # Groups by block digest; where all of a beginning go the same way, no more is needed.
    key = [*PARENT, "ax", "ay", "n"]
    groups = stored(
        blocks.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
        ),
        "groups",
    )
    parents = stored(
        groups.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_convs").alias("inside")), "parents"
    )
    straight = _by_turn(groups.join(parents.where("kinds = 1"), PARENT), "conv_id", "n_convs")
    diverging = blocks.join(parents.where("kinds > 1"), PARENT, "left_semi")
    refined = (
        _by_turn(diverging, "conv_id")
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            *(F.first(c).alias(c) for c in ("px", "py", "chars")),
        )
    )
    zero = F.lit(0).cast("long")
    root = (
        convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .where("n_convs > 0")
        .select("conv_id", "n_convs", *(zero.alias(c) for c in (*NODE, "px", "py", "chars")))
    )
    bare = stored(straight.unionByName(refined).unionByName(root), "bare-nodes")
    children = (
        bare.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = stored(
        bare.join(children, NODE, "left").selectExpr(
            *bare.columns,
            "coalesce(n_children, 0L) AS n_children",
            "if(n_children IS NULL, 1L, 0L) AS leaf",
            "(n_convs - 1) * chars AS saved",
            f"depth DIV {block * run} AS run",
        ),
        "nodes",
    )

    # Credits of an owner from a depth on: by run, then within the run.
    later = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    per_run = stored(
        nodes.groupBy("conv_id", "run")
        .agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        .select(
            "conv_id",
            "run",
            F.coalesce(F.sum("leaf").over(later), zero).alias("later_leaf"),
            F.coalesce(F.sum("saved").over(later), zero).alias("later_saved"),
            F.sum("leaf").over(whole).alias("owner_leaf"),
            F.sum("saved").over(whole).alias("owner_saved"),
        ),
        "credits",
    )
    from_here = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owned = nodes.join(per_run, ["conv_id", "run"]).withColumns(
        {
            "leaf": F.sum("leaf").over(from_here) + F.col("later_leaf"),
            "saved": F.sum("saved").over(from_here) + F.col("later_saved"),
        }
    )

    # Credits of all members. Copies own nothing, so they are gone from here on.
    owners = per_run.select("conv_id", "owner_leaf", "owner_saved").distinct().where("owner_leaf <> 0 OR owner_saved <> 0")
    owners = stored(owners, "owners")
    shared = blocks.join(parents.where("inside > 1"), PARENT, "left_semi").join(owners, "conv_id")
    sums = [F.sum(f"owner_{c}").alias(f"all_{c}") for c in ("leaf", "saved")]
    members = _by_turn(shared, "owner_leaf", "owner_saved").groupBy(*NODE).agg(*sums)
    members = members.unionByName(owners.agg(*sums).select(*(zero.alias(c) for c in NODE), "all_leaf", "all_saved"))

    last = blocks.where(F.col("block") * block + F.col("n") == F.col("length"))
    ends = last.select(F.col("length").alias("depth"), F.col("ax").alias("x"), F.col("ay").alias("y"), "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(*(zero.alias(c) for c in NODE), "conv_id"))
    ends = (
        ends.repartition(*NODE)
        .sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(_digests, "depth long, x long, y long, ends_sha256 string")
    )

    def subtree(what: str) -> Column:
        others = F.coalesce(f"all_{what}", zero) - F.col(f"owner_{what}")
        return F.when(F.col("n_convs") == 1, F.col(what)).otherwise(F.col(what) + others)

    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        owned.join(members, NODE, "left")
        .join(ends, NODE, "left")
        .join(above, ["depth", "px", "py"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            subtree("leaf").alias("n_leaves"),
            subtree("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*splice_heads(order_turns(table(spark, sf_dir, "conversations"))))


#: The remainders of CRC-32 by its polynomial, reflected (fixed value), then the trie by whole paths.
OP12_SQL = r"""
WITH RECURSIVE rounds(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM rounds WHERE k < 8
), bytes AS (SELECT list(v ORDER BY i) AS t FROM rounds WHERE k = 8
), crc(conv_id, s, place, v) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, s, place + 1, xor(v >> 8, t[(xor(v, ord(s[place + 1])::BIGINT) & 255) + 1]) FROM crc, bytes WHERE place < length(s)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    CASE WHEN conv_id % 100 = 0 THEN 0 ELSE xor(v, 4294967295::BIGINT) % 6 END AS h
  FROM crc WHERE place = length(s)
), turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), paths AS (
  SELECT conv_id, list(digest ORDER BY own, place) AS digests, list(chars ORDER BY own, place) AS sizes FROM rebuilt GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(digests, []) AS digests, coalesce(sizes, []) AS sizes FROM convs LEFT JOIN paths USING (conv_id)
), prefixes AS (
  SELECT conv_id, unnest(range(len(digests) + 1)) AS depth, digests, sizes FROM whole
), named AS (
  SELECT conv_id, depth, array_to_string(digests[1:depth], '') AS path, coalesce(sizes[depth], 0) AS chars,
    depth = len(digests) AS ends FROM prefixes
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM named GROUP BY path
), counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children FROM nodes n
), summed AS (
  SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
  FROM counted a JOIN counted b ON starts_with(b.path, a.path) GROUP BY a.path
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN summed s USING (path) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND starts_with(c.path, p.path)
"""
