"""Hard negatives against SQL on random vectors with ties, hot vectors and odd rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscal_ledger.llm import hard_negatives as hn
from tests.llm import fixture

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(folder) -> list:
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return sorted(connection.sql(f"SELECT {', '.join(COLUMNS)} FROM ({hn.OP13_SQL})").fetchall())


def vectors(spark, folder: str, dim: int = 12) -> str:
    """A third of the rows are one vector; others repeat, are zero, or have a few values only, so scores tie."""
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(dim)
    rows = []
    for i in range(900):
        kind = i % 6
        vector = hot if kind < 2 else rng.integers(-2, 3, dim) / 2 if kind < 4 else hot + 0.4 * rng.standard_normal(dim)
        rows.append((i, (np.zeros(dim) if i % 211 == 5 else vector).tolist(), int(i % 5), "clash"))
    rows += [(1000, hot.tolist()[:5], 2, None), (1001, [], 3, None), (1100, [], 3, None), (1200, (hot * 1e30).tolist(), 1, None)]
    rows += [(-100, (-hot).tolist(), 1, None), (None, hot.tolist(), 1, None), (1300, [None] * dim, 1, None), (1400, [float("nan")] * dim, 1, None)]
    rows += [(1500, hot.tolist(), None, None), (1600, None, 2, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cluster string")
    frame.repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize(("pack", "shard"), [(1024, 1 << 15), (2, 64)])
def test_sql(spark, tmp_path, monkeypatch, pack, shard):
    monkeypatch.setattr(hn, "PACK", pack)
    monkeypatch.setattr(hn, "SHARD", shard)
    folder = vectors(spark, str(tmp_path))
    found = hn.op13_hard_negatives(spark, folder)
    assert found.columns == COLUMNS
    assert found.dtypes == list(zip(COLUMNS, ["bigint", "bigint", "int", "bigint", "bigint", "bigint"], strict=True))
    rows = sorted(map(tuple, found.collect()))
    assert rows == expected(folder)
    assert len({r[0] for r in rows}) > 5


def test_fixture(spark, tmp_path):
    folder = fixture.write(spark, str(tmp_path))
    assert sorted(map(tuple, hn.op13_hard_negatives(spark, folder).collect())) == expected(folder)


def test_other_numbers(spark):
    """Other anchors, list lengths and band than the query's."""
    rng = np.random.default_rng(2)
    values = rng.integers(-50, 50, (60, 4)).astype(float)
    rows = [(i, int(i % 3), values[i].tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id int, label int, vector array<double>")
    found = sorted(map(tuple, hn.hard_negatives(frame, F.col("vec_id") < 7, 2, 3, (10, 50)).collect()))
    plain = []
    for a in range(7):
        scores = [(-int(values[a] @ values[i]), i) for i in range(60)]
        for p, i in sorted(s for s in scores if s[1] != a and s[1] % 3 == a % 3)[:2]:
            band = sorted(s for s in scores if s[1] % 3 != a % 3 and 10 * -p <= 100 * -s[0] <= 50 * -p)[:3]
            plain += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(band, 1)]
    assert found == sorted(plain)


def test_walks_end_early():
    """A member of a tight cluster looks at a small part of a large list."""
    rng = np.random.default_rng(4)
    rows = np.floor(256 * rng.standard_normal((20_000, 8)))
    anchor = rows[:1] + 1
    units, norms = hn._units(rows)
    bounds = norms * (units @ hn._units(anchor)[0][0] + hn.SLACK)
    order = np.argsort(-bounds)
    looked = []
    score = hn.exact_scores
    hn.exact_scores = lambda a, b: looked.append(len(b)) or score(a, b)
    try:
        pack = hn.Pack(0, 0.0, np.array([-1]), np.array([1]), anchor, hn._units(anchor)[1], np.array([[hn.NONE + 1]]), np.array([[2**62]]))
        (_, _, at, best), = hn.walk(pack, rows[order], order, np.ones(len(rows), int), bounds[order], 5, True)
    finally:
        hn.exact_scores = score
    assert sum(looked) == hn.STEP
    assert sorted(best.tolist()) == sorted((rows @ anchor[0]).astype(int).tolist())[-5:] and len(at) == 5


def test_exact_scores():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0], [-(2.0**20), 3.0], [2.0**10, -1.0]])
    assert hn.exact_scores(a, b).tolist() == [[2**63 - 1, -(2**60) + 3, 2**50 - 1]]
