"""A trie of conversation prefixes, built as ternary search trees over range shards.

1. Turns become numbers: a dictionary of the distinct turns (role, text) by 128-bit digests, in a table of its own. After that only numbers, sizes
   and ids are shuffled, never texts.
2. A conversation is the path of its turns' numbers. Equal paths are merged before they are dealt out: each is one row per block of
   ``BLOCK_IDS`` ids, with its ids already joined as text, so a path that very many conversations share is summed by many tasks.
3. Paths are dealt into ranges and sorted. A task cuts its range into runs of about ``RUN_TURNS`` turns. For each run it builds a ternary search tree, the
   middle path first, then the middles of both halves, so that every level is balanced. A walk with a stack of its own lists the tree in
   order; going back over that list adds up members, leaves and savings below every node.
4. What lies on the first or last path of a run may go on in its neighbours. These boundary nodes are merged by
   digests of their prefixes. Sums over all members add up across runs; what must count once (a node's own text, a child) is counted by the first
   run that has the node, so the later runs of a node take back the sizes on the part of their first path that an earlier run has; a run whose last path
   goes on in the next takes back a leaf. Both are sums along one path per run.

Turns are ordered by their number, null first, then by the digest of role and text. Null roles and texts count as empty. Rows without a conversation id
belong to no conversation. Repeated rows are turns of their own. An empty table gives no node. Other columns are dropped, so their names
cannot clash. A path holds 12 bytes a turn and is one row, whatever the length of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import releasing
from fiscal_ledger.settings import new_table_path

BLOCK_IDS = 4096
RUN_TURNS = 1 << 17

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_ROOT = b"\0" * 16


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's turns in order, as (id, chars) of the dictionary."""
    folder = new_table_path(conversations.sparkSession, "turns")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps its end apart from the text's beginning.
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.sha2(said, 256), 1, 32).alias("digest"),
        F.length(text).alias("chars"),
    )
    turns = _written(turns, f"{folder}/digests")
    distinct = turns.groupBy("digest").agg(F.max("chars").alias("chars"))
    numbered = distinct.select("digest", "chars", F.monotonically_increasing_id().alias("id"))
    dictionary = _written(numbered, f"{folder}/dictionary")
    # Both sides are tables, so a very frequent turn's join can be split.
    coded = turns.select("conv_id", "turn", "digest").join(dictionary, "digest")
    member = F.struct("turn", "digest", "id", "chars")
    listed = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(member)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t.id.alias("id"), t.chars.alias("chars"))).alias("path"))


def with_shared_heads(paths: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """Rebuild each conversation: its first h turns are those of the first conversation of its hundred, h = crc32(id) % most."""
    folder = new_table_path(paths.sparkSession, "paths")
    paths = _written(paths, f"{folder}/original")
    own = paths.withColumns(
        {
            "base": F.col("conv_id") - F.col("conv_id") % hundred,
            "h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"),
        }
    )
    heads = paths.where(F.col("conv_id") % hundred == 0).select(
        F.col("conv_id").alias("base"), F.slice("path", 1, most - 1).alias("head")
    )
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("path", 1, 0))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("path"))


@dataclass
class Run:
    """Distinct paths of a run in order, with what their members give."""

    paths: list[tuple[int, ...]] = field(default_factory=list)
    chars: list[list[int]] = field(default_factory=list)
    members: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    turns: int = 0


class TernaryTree:
    """Paths in a ternary search tree; every node is a turn after its parent's prefix. Node 0 is the root."""

    def __init__(self) -> None:
        self.turn, self.chars, self.parent, self.depth = [0], [0], [-1], [0]
        self.low, self.high, self.below = [0], [0], [0]  # 0: none
        self.path = [-1]  # the path that ends here

    def _node(self, turn: int, chars: int, parent: int) -> int:
        self.turn.append(turn)
        self.chars.append(chars)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for column in (self.low, self.high, self.below):
            column.append(0)
        self.path.append(-1)
        return len(self.turn) - 1

    def insert(self, path: tuple[int, ...], chars: list[int], number: int) -> None:
        at = 0
        for turn, size in zip(path, chars, strict=True):
            node = self.below[at]
            if not node:
                node = self.below[at] = self._node(turn, size, at)
            while self.turn[node] != turn:
                side = self.low if turn < self.turn[node] else self.high
                if not side[node]:
                    side[node] = self._node(turn, size, at)
                node = side[node]
            at = node
        self.path[at] = number

    def insert_balanced(self, paths: list[tuple[int, ...]], chars: list[list[int]]) -> None:
        """All paths of an ordered list, medians first."""
        stretches = [(0, len(paths))]
        while stretches:
            first, end = stretches.pop()
            if first < end:
                middle = (first + end) // 2
                self.insert(paths[middle], chars[middle], middle)
                stretches += [(first, middle), (middle + 1, end)]

    def in_order(self) -> list[int]:
        """All nodes, each after its parent and, among siblings, by turn."""
        order = [0]
        stack = [(self.below[0], False)]
        while stack:
            node, seen = stack.pop()
            if not node:
                continue
            if not seen:
                stack += [(node, True), (self.low[node], False)]
            else:
                order.append(node)
                stack += [(self.high[node], False), (self.below[node], False)]
        return order


_NODE = (
    "run string, node binary, parent binary, depth int, chars int, n bigint, least bigint, children bigint, leaves bigint, saved bigint, "
    "ends string, parent_least bigint, boundary boolean, on_first boolean, on_last boolean, parent_boundary boolean"
)
_ARROW = pa.schema(
    [
        ("run", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("chars", pa.int32()),
        ("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
        ("ends", pa.string()), ("parent_least", pa.int64()), ("boundary", pa.bool_()), ("on_first", pa.bool_()), ("on_last", pa.bool_()),
        ("parent_boundary", pa.bool_()),
    ]
)


def run_nodes(run: Run, name: str) -> Iterator[pa.RecordBatch]:
    """The nodes of one run; ``children`` of a boundary node leaves out its children on the boundary."""
    tree = TernaryTree()
    tree.insert_balanced(run.paths, run.chars)
    size = len(tree.turn)
    n, least, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    ends = [EMPTY_SHA256] * size
    digest: list[bytes | None] = [None] * size
    digest[0] = _ROOT
    on_first, on_last = [False] * size, [False] * size
    for marks, path in ((on_first, run.paths[0]), (on_last, run.paths[-1])):
        at = 0
        marks[0] = True
        for turn in path:
            node = tree.below[at]
            while tree.turn[node] != turn:
                node = (tree.low if turn < tree.turn[node] else tree.high)[node]
            digest[node] = hashlib.blake2b(digest[at] + turn.to_bytes(8, "little"), digest_size=16).digest()
            marks[node] = True
            at = node
    order = tree.in_order()
    for node in reversed(order):
        at = tree.path[node]
        if at >= 0:
            n[node] += run.members[at]
            least[node] = min(least[node], run.least[at]) if n[node] > run.members[at] else run.least[at]
            ends[node] = run.ends[at]
        if not tree.below[node]:
            leaves[node] = 1
        saved[node] += (n[node] - 1) * tree.chars[node]
        parent = tree.parent[node]
        if parent >= 0:
            least[parent] = min(least[parent], least[node]) if n[parent] else least[node]
            n[parent] += n[node]
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
            if digest[node] is None:
                children[parent] += 1
    for start in range(0, size, 1 << 14):
        part = order[start : start + (1 << 14)]
        up = [tree.parent[i] for i in part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(values, kind)
                for values, kind in zip(
                    (
                        [name] * len(part), [digest[i] for i in part], [digest[p] if p >= 0 else None for p in up],
                        [tree.depth[i] for i in part], [tree.chars[i] for i in part], [n[i] for i in part], [least[i] for i in part],
                        [children[i] for i in part], [leaves[i] for i in part], [saved[i] for i in part], [ends[i] for i in part],
                        [least[p] if p >= 0 else None for p in up], [digest[i] is not None for i in part],
                        [on_first[i] for i in part], [on_last[i] for i in part], [p >= 0 and digest[p] is not None for p in up],
                    ),
                    _ARROW.types,
                    strict=True,
                )
            ],
            schema=_ARROW,
        )


def _tries(batches: Iterable[pa.RecordBatch], run_turns: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows (path, block, n, least, ids) into runs and give their nodes."""
    part = TaskContext.get().partitionId()
    run, number = Run(), 0
    last: tuple[int, ...] | None = None
    sha = hashlib.sha256()

    def close() -> None:
        if last is not None:
            run.ends.append(sha.hexdigest())

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("ids", "chars", "n", "least", "joined"))
        for ids, chars, n, least, joined in zip(*columns, strict=True):
            path = tuple(ids)
            if path == last:
                sha.update(b",")
                run.members[-1] += n
                run.least[-1] = min(run.least[-1], least)
            else:
                close()
                if run.turns > run_turns:
                    yield from run_nodes(run, f"{part:010d}-{number:010d}")
                    run, number = Run(), number + 1
                last, sha = path, hashlib.sha256()
                run.paths.append(path)
                run.chars.append(chars)
                run.members.append(n)
                run.least.append(least)
                run.turns += len(path) + 1
            sha.update(joined.encode())
    close()
    if run.paths:
        yield from run_nodes(run, f"{part:010d}-{number:010d}")


def _text(value: Column) -> Column:
    return value.cast("string")


def prefix_trie(paths: DataFrame, block_ids: int = BLOCK_IDS, run_turns: int = RUN_TURNS) -> DataFrame:
    """One row per distinct prefix of the paths (conv_id, path): members, children, leaves, savings, and who ends there."""
    spark = paths.sparkSession
    folder = new_table_path(spark, "trie")
    block = (F.col("conv_id") - F.pmod("conv_id", F.lit(block_ids))).alias("block")
    ids = F.sort_array(F.collect_list("conv_id"))
    grouped = (
        paths.groupBy(F.col("path.id").alias("ids"), F.col("path.chars").alias("chars"), block)
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.transform(ids, _text), ",").alias("joined"))
    )
    grouped = _written(grouped, f"{folder}/groups")
    ranged = grouped.repartitionByRange("ids").sortWithinPartitions("ids", "block").select("ids", "chars", "n", "least", "joined")
    tries = releasing(lambda batches: _tries(batches, run_turns))
    nodes = _written(ranged.mapInArrow(tries, _NODE), f"{folder}/nodes")
    merged = _merged(nodes.where("boundary"), folder)
    inner = nodes.where("NOT boundary")
    # A boundary parent's smallest member is known per run, so a parent of very many nodes is no hot key.
    parents = merged.select("run", F.col("node").alias("parent"), F.col("least").alias("merged_least"))
    under = inner.where("parent_boundary").join(parents, ["run", "parent"]).withColumn("parent_least", F.col("merged_least"))
    # A node of the boundary is given once, from the first run that has it.
    edge = merged.where("owned").withColumn("parent_least", F.col("parent_merged"))
    return _named(inner.where("NOT parent_boundary")).unionByName(_named(under)).unionByName(_named(edge))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.col("parent_least").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def _merged(boundary: DataFrame, folder: str) -> DataFrame:
    """The boundary nodes of all runs with their values over all runs; ``owned`` in the first run of a node."""
    owners = _written(
        boundary.groupBy("node", "parent").agg(F.min("run").alias("owner"), F.sum("n").alias("all_n")), f"{folder}/owners"
    )
    rows = boundary.join(owners.drop("parent"), "node").withColumn("owned", F.col("run") == F.col("owner"))
    rows = _written(rows, f"{folder}/owned")
    # Children on the boundary, each once; and whether a node that is a leaf in its run has children in another.
    edges = owners.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("edge_children"))
    totals = rows.groupBy("node").agg(F.sum("children").alias("inner_children")).join(edges, "node", "left")
    children = totals.select("node", (F.col("inner_children") + F.coalesce("edge_children", F.lit(0))).alias("all_children"))
    children = _written(children, f"{folder}/children")
    rows = _written(rows.join(children, "node"), f"{folder}/known")
    # What a run takes back: a leaf that goes on elsewhere, for the nodes of its last path; the sizes of nodes that an
    # earlier run has counted, for those on its first path above them.
    ends_on = rows.where("on_last AND leaves = 1 AND children = 0 AND all_children > 0")
    deepest = Window.partitionBy("run")
    last = rows.where("on_last").withColumn("deepest", F.max("depth").over(deepest)).where("depth = deepest")
    goes_on = last.join(ends_on.select("run", "node"), ["run", "node"], "left_semi").select("run", F.lit(1).alias("leaf_less"))
    below = Window.partitionBy("run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    again = F.when(F.col("on_first") & ~F.col("owned"), F.col("chars").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    first = rows.where("on_first").select("run", "node", F.sum(again).over(below).alias("size_again"))
    fixed = rows.join(first, ["run", "node"], "left").join(goes_on, "run", "left").select(
        "run", "node", "least", "ends", "leaves", "saved", "depth", "parent",
        F.coalesce("size_again", F.lit(0)).alias("size_again"),
        F.when(F.col("on_last"), F.coalesce("leaf_less", F.lit(0))).otherwise(F.lit(0)).alias("leaf_less"),
    )
    # A run has counted (its own n - 1) * chars for each node. Over all runs that is n - runs, and runs - 1 are taken back as sizes.
    values = fixed.groupBy("node").agg(
        F.min("least").alias("least"),
        F.max(F.when(F.col("ends") != EMPTY_SHA256, F.col("ends"))).alias("found_ends"),
        F.sum(F.col("leaves") - F.col("leaf_less")).alias("leaves"),
        F.sum(F.col("saved") + F.col("size_again")).alias("saved"),
    )
    values = _written(values, f"{folder}/values")
    least = values.select(F.col("node").alias("parent"), F.col("least").alias("parent_merged"))
    joined = rows.select("run", "node", "parent", "depth", "owned", "all_n", "all_children").join(values, "node")
    return _written(
        joined.join(least, "parent", "left").select(
            "run", "node", "depth", "owned", "least", "parent_merged", F.col("all_n").alias("n"), F.col("all_children").alias("children"),
            "leaves", "saved", F.coalesce("found_ends", F.lit(EMPTY_SHA256)).alias("ends"),
        ),
        f"{folder}/merged",
    )


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with the first turns of their hundred."""
    return prefix_trie(with_shared_heads(turn_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


# The register of a CRC-32 after one more byte, and the whole sum of a decimal number; 3988292384 is the reversed polynomial.
_CRC_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
    f"lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {_CRC_BYTE}), 4294967295)"
)

OP12_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), original AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS path
    FROM turns GROUP BY conv_id
), headed AS (
    SELECT o.conv_id, o.path, b.path AS head, CAST({_CRC.replace("conv_id", "o.conv_id")} % 6 AS BIGINT) AS h
    FROM original o LEFT JOIN original b ON b.conv_id = o.conv_id - o.conv_id % 100
), rebuilt AS (
    SELECT conv_id, CASE WHEN head IS NULL OR h = 0 THEN path[h + 1:] ELSE list_concat(head[1:h], path[h + 1:]) END AS path FROM headed
), prefixes AS (
    SELECT conv_id, d, path[1:d] AS p, d = len(path) AS ends FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, p, min(conv_id) AS least, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS members
    FROM prefixes GROUP BY d, p
), children AS (
    SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), valued AS (
    SELECT nodes.*, coalesce(children.n, 0) AS n_children, CASE WHEN nodes.d = 0 THEN 0 ELSE (nodes.n - 1) * length(nodes.p[-1].text) END AS saved
    FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.p = nodes.p
), below AS (
    SELECT k AS d, p[1:k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM valued) GROUP BY ALL
)
SELECT v.least AS conv_id, v.d AS depth, parent.least AS parent_conv_id, v.n AS n_convs, v.n_children,
       CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.members, '')) AS ends_sha256
FROM valued v JOIN below ON below.d = v.d AND below.p = v.p LEFT JOIN nodes parent ON parent.d = v.d - 1 AND parent.p = v.p[1:v.d - 1]
"""
