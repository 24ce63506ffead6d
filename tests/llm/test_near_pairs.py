"""What is compared in a bucket, and whose columns stay."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from fiscal_ledger.llm import near_duplicates as nd
from tests.llm import fixture


def test_unlike_texts_with_a_stock_phrase_are_hardly_compared(spark, monkeypatch):
    """Each of 2000 texts meets all others in one bucket; hardly any pair leaves the blocks."""
    import random

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + " all rights reserved") for i in range(2000)]
    rows += [(5000, rows[0][1].replace(" all", " nearly all")), (5001, rows[7][1].replace("reserved", "kept"))]
    compared = []
    verified = nd._verified
    monkeypatch.setattr(nd, "_verified", lambda pairs, words: compared.append(pairs.count()) or verified(pairs, words))
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    classes = {r.doc_id: r.class_id for r in found}
    assert classes[5000] == 0 and classes[5001] == 7 and sum(c != d for d, c in classes.items()) == 2
    assert sum(compared) < 20 * 2000 / 10


def test_closest_is_exact_in_the_end():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 30))) for _ in range(60)]
    signs = nd.signs(*nd.hash_words(texts))
    parts = nd._parts(signs)
    allowed = np.ones((60, 60), bool)
    alike = {(i, j) for i in range(60) for j in range(60) if nd.may_be_alike([signs[i]], [signs[j]])[0]}
    x, y, more = nd.closest(parts, parts, allowed, 60)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == alike and not more
    x, y, more = nd.closest(parts, parts, allowed, 1)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) < alike and more
    assert {i for i, _ in alike} == set(x.tolist())


def test_alike_texts_have_neighbouring_spans(spark):
    rows = [(n, n, " ".join(["w"] * n)) for n in range(1, 400)]
    table = nd._sketch_table(spark.createDataFrame(rows, "doc_id bigint, node bigint, text string"))
    spans = {r.doc_id: r.span for r in table.select("doc_id", "span").collect()}
    for n in spans:
        for m in range(n, min(399, int(n / 0.8 + 1e-9)) + 1):
            assert spans[m] - spans[n] in (0, 1)


def test_columns_of_any_name_stay(spark):
    rows = [(i, t, i, f"n{i}", i, "s", 1.5) for i, (_, t, *_) in enumerate(fixture.documents()[:12])]
    rows.append((50, rows[3][1], 50, "copy", 1, "s", 2.5))
    docs = spark.createDataFrame(rows, "doc_id int, text string, node int, _node string, row int, `a.b` string, keys double")
    kept = nd.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] != 50)


def test_distances_as_bits_and_by_diagonals_are_plain_distances(monkeypatch):
    rng = np.random.default_rng(9)
    for _ in range(300):
        one = rng.integers(0, rng.choice((2, 5, 40)), rng.integers(0, 25)).astype(np.uint32)
        other = np.delete(one, rng.integers(0, len(one), 3)) if len(one) and rng.random() < 0.5 else one.copy()
        other = np.insert(other, rng.integers(0, len(other) + 1, rng.integers(0, 4)), rng.integers(0, 40)).astype(np.uint32)
        row = list(range(len(other) + 1))
        for i, word in enumerate(one, 1):
            last, row[0] = row[0], i
            for j, against in enumerate(other, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + int(word != against))
        for most in (0, 1, 2, 4, 9, 30):
            expected = row[-1] if row[-1] <= most else None
            for bits in (2047, -1):
                monkeypatch.setattr(nd, "MOST_BITS", bits)
                assert nd.edit_distance_within(one, other, most) == expected


def test_texts_just_below_the_threshold_leave_no_pairs(spark, monkeypatch):
    """400 texts that share four fifths of their words, but for a few: the signs rule out no pair, and no table grows with the pairs."""
    rng = np.random.default_rng(21)
    heads = [[f"w{w}" for w in rng.integers(0, 10**6, 33)] for _ in range(400)]
    heads[399] = [*heads[0][:30], "x", "y", "z"]
    rows = [(i, " ".join([*head, *["is onhe"] * 60])) for i, head in enumerate(heads)]
    written = []
    table = nd._table

    def counted(frame, path):
        of = table(frame, path)
        written.append(of.count())
        return of

    monkeypatch.setattr(nd, "_table", counted)
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i % 399 for i in range(400)}
    assert max(written) <= 45 * 400 < 400 * 399 / 4


def test_lists_that_share_a_number():
    rng = np.random.default_rng(5)
    one, other = ([rng.integers(0, 60, rng.integers(0, 9)).tolist() for _ in range(n)] for n in (40, 30))
    expected = [[bool(set(a) & set(b)) for b in other] for a in one]
    assert nd._sharing(pa.array(one, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))).tolist() == expected
    sliced = pa.array(one, pa.list_(pa.int64()))[7:20]
    assert nd._sharing(sliced, pa.array([[]], pa.list_(pa.int64()))).tolist() == [[False]] * 13


def test_what_is_joined_is_not_tried_again(monkeypatch):
    tried = []
    monkeypatch.setattr(nd, "alike", lambda one, other: tried.append((one, other)) or one + other != 5)
    pairs = np.array([(0, 1), (1, 2), (0, 2), (2, 3), (1, 3), (3, 4)], np.uint8)
    assert nd.joined(np.array([10, 20, 30, 40, 10]), pairs, [0, 1, 2, 3, 4]) == [(20, 10), (30, 10), (40, 10)]
    assert tried == [(0, 1), (1, 2), (2, 3), (1, 3)]


def test_sides_of_a_tile():
    assert nd._cuts(np.array([5] * 300)).tolist() == [n // nd.TILE for n in range(300)]
    assert nd._cuts(np.array([nd.TILE_WORDS, 1, nd.TILE_WORDS - 1, 1, 2])).tolist() == [0, 1, 1, 2, 2]


def test_a_piece_takes_little_memory():
    """Two workers sketch beside a full heap: the arrays of a piece stay below 32 MB."""
    text = "some words of a text that is sketched " * 30
    texts = [text] * (nd.PIECE_BYTES // len(text))
    tracemalloc.start()
    nd.sketch(*nd.hash_words(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
