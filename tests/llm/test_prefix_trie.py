"""The prefix trie against SQL, however small its runs are, and against a plain version."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from fiscal_ledger.llm.prefix_trie import OP12_SQL, TernaryTree, prefix_trie, turn_paths, with_shared_heads
from tests.llm import fixture

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return fixture.write(spark, str(tmp_path_factory.mktemp("tables")))


def plain(rows) -> list[tuple]:
    """The nodes from sets of prefixes."""
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn, digest, role, text))
    original = {c: [(t[3], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(original.get(base, [])[:h] + path[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
            )
            for p, m in members.items()
        ),
        key=repr,
    )


@pytest.mark.parametrize(("block_ids", "run_turns", "partitions"), [(4096, 1 << 17, 8), (8, 12, 3), (3, 1, 8)])
def test_any_runs_and_blocks(spark, folder, block_ids, run_turns, partitions):
    """Tiny runs put nearly every node on a boundary."""
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").repartition(partitions)
    nodes = prefix_trie(with_shared_heads(turn_paths(conversations)), block_ids, run_turns)
    assert nodes.columns == COLUMNS
    assert sorted(map(tuple, nodes.collect()), key=repr) == plain(fixture.conversations())


def test_sql(folder):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    found = connection.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall()
    assert sorted(found, key=repr) == plain(fixture.conversations())


def test_prefixes_of_others(spark):
    """A conversation that ends inside another is no leaf, also where a run ends between them."""
    rows = [(c, t, "u", f"t{t}") for c in range(1, 8) for t in range(c)]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    nodes = {r.depth: r for r in prefix_trie(turn_paths(conversations), run_turns=1).collect()}
    assert [nodes[d].n_convs for d in range(8)] == [7, 7, 6, 5, 4, 3, 2, 1]
    assert all(nodes[d].n_leaves == 1 and nodes[d].n_children == (d < 7) for d in range(8))
    assert nodes[0].saved_tokens == 2 * sum(range(7)) and nodes[0].parent_conv_id is None and nodes[5].parent_conv_id == 4


def test_median_insertion_is_balanced():
    paths = [(i,) for i in range(1023)]
    tree = TernaryTree()
    tree.insert_balanced(paths, [[1]] * len(paths))
    depth, level = 0, [tree.below[0]]
    while level:
        level, depth = [c for n in level for c in (tree.low[n], tree.high[n]) if c], depth + 1
    assert depth == 10
    assert [tree.turn[n] for n in tree.in_order()[1:]] == list(range(1023))


def test_a_conversation_of_very_many_turns(spark):
    rows = [(1, t, "u", "x" * (t % 3)) for t in range(20_000)]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    deepest = prefix_trie(turn_paths(conversations)).orderBy("depth", ascending=False).first()
    assert deepest.depth == 20_000 and deepest.n_leaves == 1
