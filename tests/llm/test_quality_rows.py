"""Every document comes out of the quality classifier, however rows are dealt over partitions."""

from __future__ import annotations

import numpy as np
import pytest

from fiscal_ledger.llm.quality import BITS, ORDER, ngrams, score_quality
from tests.llm import brute

DOCUMENTS = "doc_id bigint, text string, lang string"


@pytest.mark.parametrize("partitions", [1, 3, 6])
def test_blocks_of_empty_texts(spark, partitions):
    texts = ["a plain sentence of words", "another plain sentence", None, "", None, ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCUMENTS).repartitionByRange(partitions, "doc_id")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    scored = score_quality(docs, labels, keep=("doc_id", "text"))
    rows = sorted(scored.decisions.select("doc_id", "chars", "perplexity", "rejected").collect())
    assert [r.doc_id for r in rows] == list(range(6))
    assert all(r.chars == 0 and r.perplexity is None and not r.rejected for r in rows[2:])
    assert sorted((r.doc_id, r.text) for r in scored.kept().collect()) == [(i, t) for i, t in enumerate(texts)]


def test_nothing_but_empty_texts(spark):
    docs = spark.createDataFrame([(i, None, None) for i in range(4)], DOCUMENTS).repartition(4)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert score_quality(docs, labels, keep=("doc_id",)).kept().count() == 4


WIDE = ["中文文本", "丯旇旇札", "ab中c", "\U0010ffff\u077f\u0780", "", "plain", "ไทย", "한국어"]


def spelt(texts):
    """The last symbol of every n-gram, text by text."""
    keys, lengths = ngrams(texts)
    assert len(keys) == lengths.sum()
    return [list(part & ((1 << BITS) - 1)) for part in np.split(keys, np.cumsum(lengths)[:-1])]


def test_symbols_tell_all_characters_apart():
    found = spelt(WIDE)
    assert found == [spelt([text])[0] for text in WIDE]
    assert [len(f) for f in found] == [sum(1 + (ord(c) >= 0x780) for c in text) for text in WIDE]
    points = [chr(p) for p in [*range(1, 0xD800, 7), *range(0xE000, 0x110000, 31), 0x10FFFF]]
    assert len({tuple(f) for f in spelt(points)}) == len(points)
    assert all(0 <= symbol < 1 << BITS for f in spelt(points) for symbol in f) and ORDER * BITS < 64


def test_wide_characters_are_scored(spark):
    """Chinese text of the trusted kind against characters that have the same low byte."""
    common = "今天天气很好我们一起去公园散步"
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice([common, common[:7], common[5:]], 6)) for _ in range(30)]
    odd = ["".join(chr(ord(c) ^ 0x1100) for c in t) for t in texts[:3]]
    docs = [(i, t, "zh") for i, t in enumerate([*texts, *odd])]
    labels = {i: (1, 0) for i in range(25)}
    scored = score_quality(
        spark.createDataFrame(docs, DOCUMENTS),
        spark.createDataFrame([(i, 1, 0) for i in labels], "doc_id bigint, quality int, toxic int"),
    )
    rows = sorted(scored.decisions.collect(), key=lambda r: r.doc_id)
    plain = brute.quality(docs, labels)
    assert [r.rejected for r in rows] == [rejected for _, rejected in plain]
    assert all(r.rejected for r in rows[30:]) and not any(r.rejected for r in rows[:25])
    assert all(abs(r.perplexity / p - 1) < 1e-6 and r.chars == len(d[1]) for r, (p, _), d in zip(rows, plain, docs, strict=True))
