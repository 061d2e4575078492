"""The prefix trie of conversations by a splitter skeleton over sorted shards.

A turn is the 128-bit digest of its role and text; a conversation is the path
of its turns.  Every distinct sequence of first turns is a node.

1. *Paths.*  Conversations become rows of (path, characters of each turn);
   equal paths are one row from here on, with their count, smallest id and the
   digest of their ids, which one task streams in order (a sequential digest).
2. *Splitters.*  A sample of distinct paths, cut to ``SPLITTER_TURNS`` turns,
   gives the splitters of a range partition.  The trie of the splitters, the
   skeleton, has at most shards * ``SPLITTER_TURNS`` nodes and is broadcast.
   A path below a skeleton node belongs to the shard of its range, so all
   conversations of a node outside the skeleton are in one shard.
3. *Shards.*  A task reads its shard in path order and keeps a stack as deep as
   the path at hand.  A node that leaves the stack is finished if it is outside
   the skeleton; its row is written once the subtree's top below the skeleton
   is finished, as a node's parent is named by the parent's smallest id.  Of a
   skeleton node the shard writes its part: members, children, leaves, savings.
4. *Reduction.*  The parts of each skeleton node are added up by a grouped
   aggregate, then along the skeleton's ancestors.

The sample decides only where shards begin: the result is the same for any.

Defined results: rows with a null conv_id belong to no conversation; a null
role or text is empty; a null turn comes first, equal turn numbers go by the
turn's digest; repeated rows are repeated turns; an empty table has no node;
other columns are ignored, whatever their names.  A conversation's path, 24
bytes a turn, is one row: a texts' length doesn't matter, a conversation of
more than some 50 million turns wouldn't fit.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.sources.staging import stage

DIGEST = 16
SPLITTER_TURNS = 64
SAMPLES_A_SHARD = 40
SHARED_PREFIX = 5
OUT_ROWS = 5000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

PART_SCHEMA = ("node int, conv_id long, depth long, parent_conv_id long, parent_node int, n_convs long, "
               "n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string")
_PART = pa.schema([("node", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("parent_node", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()),
                   ("ends_sha256", pa.string())])


def turn_lists(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the ordered (turn, digest in hex, characters) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def share_prefixes(convs: DataFrame, every: int = 100) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every, h = crc32(c) % 6."""
    base = convs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_PREFIX).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_PREFIX + 1)).cast("int")
    own = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("of"))
    joined = own.join(base, F.col("of") == F.col("base"), "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("first", none), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, SHA-256 of its comma-joined ids) from (pid, conv_id) sorted by both."""
    last, digest, out = None, None, []
    for batch in batches:
        for pid, conv in zip(batch.column("pid").to_pylist(), batch.column("conv_id").to_pylist()):
            if pid == last:
                digest.update(b",%d" % conv)
                continue
            if last is not None:
                out.append((last, digest.hexdigest()))
            last, digest = pid, hashlib.sha256(b"%d" % conv)
        if len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_pydict({"pid": [r[0] for r in out], "ends_sha256": [r[1] for r in out]})
            out = []
    if last is not None:
        out.append((last, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pydict({"pid": [r[0] for r in out], "ends_sha256": [r[1] for r in out]})


def distinct_paths(convs: DataFrame, parts: int) -> DataFrame:
    """One row a distinct path: (pid, path, chars, n, conv_id, ends_sha256)."""
    rows = convs.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"),
                        F.col("turns.chars").alias("chars"))
    rows = stage(rows.withColumn("pid", F.md5("path")), "trie_paths")
    paths = rows.groupBy("pid").agg(F.first("path").alias("path"), F.first("chars").alias("chars"),
                                    F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    ends = (rows.select("pid", "conv_id").repartition(parts, "pid").sortWithinPartitions("pid", "conv_id")
            .mapInArrow(_ends, "pid string, ends_sha256 string"))
    return paths.join(ends, "pid")


class Skeleton:
    """The trie of splitter paths: node 0 is the root; children by (node, turn digest)."""

    def __init__(self, sample: list[bytes], shards: int):
        sample = sorted(set(sample))
        at = sorted({len(sample) * k // shards for k in range(1, shards)}) if sample else []
        self.splitters = [sample[k] for k in at]
        self.children: dict[tuple[int, bytes], int] = {}
        self.parents: list[int | None] = [None]
        self.depths = [0]
        for path in self.splitters:
            node = 0
            for k in range(0, len(path), DIGEST):
                step = (node, path[k:k + DIGEST])
                if step not in self.children:
                    self.children[step] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(k // DIGEST + 1)
                node = self.children[step]

    def shard(self, path: bytes) -> int:
        return bisect.bisect_right(self.splitters, path)

    def ancestors(self, node: int) -> list[int]:
        """The node and all above it."""
        out: list[int] = []
        at: int | None = node
        while at is not None:
            out.append(at)
            at = self.parents[at]
        return out

    def rows(self) -> list[tuple[int, int | None, int, int, list[int]]]:
        """(node, parent, depth, children in the skeleton, the node and its ancestors)."""
        count = [0] * len(self.parents)
        for p in self.parents[1:]:
            count[p] += 1
        return [(i, p, d, count[i], self.ancestors(i)) for i, (p, d) in enumerate(zip(self.parents, self.depths))]


def _with_shard(batches: Iterator[pa.RecordBatch], skeleton: Broadcast) -> Iterator[pa.RecordBatch]:
    trie = skeleton.value
    for batch in batches:
        shard = [trie.shard(p) for p in batch.column("path").to_pylist()]
        yield batch.append_column("shard", pa.array(shard, pa.int32()))


def _common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    k = 0
    while a[k:k + DIGEST] == b[k:k + DIGEST]:
        k += DIGEST
    return k // DIGEST


class _Node:
    __slots__ = ("skeleton", "chars", "n", "conv", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, skeleton: int | None, chars: int):
        self.skeleton, self.chars = skeleton, chars
        self.n, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends: str | None = None
        self.rows: list[list] = []      # its children's rows, which wait for its smallest id

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


def _part_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART)], schema=_PART)


def _shard_nodes(batches: Iterator[pa.RecordBatch], skeleton: Broadcast) -> Iterator[pa.RecordBatch]:
    """Finished nodes and parts of skeleton nodes, from distinct paths sorted by (shard, path)."""
    trie = skeleton.value
    stack: list[_Node] = []
    subtree: list[list] = []    # finished rows below the skeleton whose parents are unknown yet
    out: list[list] = []
    shard, last = None, b""

    def leave() -> None:
        node, depth = stack.pop(), len(stack)
        if stack:
            stack[-1].add(node.n, node.conv)
        if node.skeleton is not None:
            out.append([node.skeleton, node.conv, depth, None, None, node.n, node.children, node.leaves, node.saved,
                        node.chars, node.ends])
            return
        for row in node.rows:
            row[3] = node.conv
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.chars
        row = [None, node.conv, depth, None, stack[-1].skeleton, node.n, node.children, leaves, saved, None, node.ends]
        subtree.append(row)
        above = stack[-1]
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skeleton is None:
            above.rows.append(row)
        else:
            out.extend(subtree)
            subtree.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "path", "chars", "n", "conv_id", "ends_sha256")]
        for at, path, chars, n, conv, ends in zip(*columns):
            if at != shard:
                while stack:
                    leave()
                shard, last = at, b""
                stack.append(_Node(0, 0))
            same = _common_turns(last, path)
            while len(stack) > same + 1:
                leave()
            for k in range(same, len(path) // DIGEST):
                above = stack[-1].skeleton
                step = None if above is None else trie.children.get((above, path[k * DIGEST:(k + 1) * DIGEST]))
                stack.append(_Node(step, chars[k]))
            stack[-1].add(n, conv)
            stack[-1].ends = ends
            last = path
            if len(out) >= OUT_ROWS:
                yield _part_batch(out)
                out.clear()
    while stack:
        leave()
    if out:
        yield _part_batch(out)


def prefix_trie(convs: DataFrame, samples_a_shard: int = SAMPLES_A_SHARD,
                splitter_turns: int = SPLITTER_TURNS) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turns), as :func:`turn_lists` gives them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): a node is named by its smallest member.
    """
    spark = convs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = stage(distinct_paths(convs, shards), "trie_distinct")
    share = min(1.0, samples_a_shard * shards / max(1, paths.count()))
    steps = 1 << 30
    sample = paths.filter(F.pmod(F.xxhash64("pid"), F.lit(steps)) < int(share * steps)).select(
        F.substring("path", 1, DIGEST * splitter_turns).alias("path"))
    trie = Skeleton([bytes(r[0]) for r in sample.collect()], shards)
    known = spark.sparkContext.broadcast(trie)

    dealt = paths.select("path", "chars", "n", "conv_id", "ends_sha256").mapInArrow(
        lambda b: _with_shard(b, known),
        "path binary, chars array<int>, n long, conv_id long, ends_sha256 string, shard int")
    parts = stage(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path")
                  .mapInArrow(lambda b: _shard_nodes(b, known), PART_SCHEMA), "trie_parts")
    bones = stage(_reduce(spark, parts.filter("node is not null"), trie), "trie_skeleton")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    tops = bones.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("__above"))
    below = parts.filter("node is null").join(F.broadcast(tops), "parent_node", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "__above"))
    return below.select(*names, ends).unionByName(bones.select(*names, ends))


def _reduce(spark: SparkSession, parts: DataFrame, trie: Skeleton) -> DataFrame:
    """Skeleton nodes from the shards' parts: added up a node, then along the ancestors."""
    known = spark.createDataFrame(trie.rows(), "node int, parent int, depth long, inner long, above array<int>")
    own = parts.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"),
        F.max("ends_sha256").alias("ends_sha256")).join(known, "node")
    own = own.withColumn("n_children", F.col("n_children") + F.col("inner"))
    leaf: Column = (F.col("n_children") == 0).cast("long")
    sums = own.select(F.explode("above").alias("node"), (F.col("n_leaves") + leaf).alias("l"),
                      (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("s")).groupBy("node").agg(
        F.sum("l").alias("leaves_below"), F.sum("s").alias("saved_tokens"))
    over = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return own.join(sums, "node").join(over, "parent", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves_below").alias("n_leaves"),
        "saved_tokens", "ends_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations``, each begun with turns of the first of its hundred."""
    return prefix_trie(share_prefixes(turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, md5(length(r) || ':' || r || x) AS g, length(x) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, list_reduce(
      [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda crc, s: CASE WHEN s >= 0 THEN xor(crc, s) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END) AS crc
  FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 6 AS h FROM c),
r AS (
  SELECT h.conv_id, t.k, t.g, t.chars FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.k <= h.h
  UNION ALL
  SELECT h.conv_id, t.k, t.g, t.chars FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
n AS (SELECT conv_id, g, chars, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM r),
m AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS p, CAST(0 AS BIGINT) AS chars FROM h
  UNION ALL
  SELECT conv_id, d, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)), chars FROM n),
s AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS up,
        d = MAX(d) OVER (PARTITION BY conv_id) AS ending FROM m),
node AS (
  SELECT p, d, any_value(up) AS up, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, any_value(chars) AS chars,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending) AS ends
  FROM s GROUP BY p, d),
kids AS (SELECT up, COUNT(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
subtree AS (SELECT DISTINCT a.p AS top, b.p AS p FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT top, SUM((n_convs - 1) * chars) AS saved, COUNT(*) FILTER (n_children IS NULL) AS leaves
  FROM subtree JOIN node USING (p) LEFT JOIN kids ON kids.up = node.p GROUP BY top)
SELECT node.conv_id, node.d AS depth, above.conv_id AS parent_conv_id, node.n_convs,
  ifnull(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(ifnull(node.ends, '')) AS ends_sha256
FROM node JOIN sums ON sums.top = node.p LEFT JOIN kids ON kids.up = node.p LEFT JOIN node above ON above.p = node.up
"""
