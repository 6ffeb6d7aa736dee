"""Nearest vectors in blocks of queries against a plain comparison."""

import numpy as np
import pytest

from melisma.operators import nearest


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = [*rng.integers(-3, 4, (300, 5)).astype(float).tolist(), [0.0] * 5]
    table = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").repartition(5)
    asked = table.where("id % 30 = 0")
    got = {}
    for r in nearest.nearest(table, asked, 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["doc_id"])
    unit = nearest.units(__import__("pyarrow").array(vectors))
    for i in range(0, 301, 30):
        order = sorted((-round(float(s), 6), k) for k, s in enumerate(unit @ unit[i]))[:7]
        assert {k: (-got[i][k][0], got[i][k][1]) for k in got[i]} == {k: x for k, x in enumerate(order, 1)}
    assert nearest.nearest(table, table.limit(0), 7).count() == 0 == nearest.nearest(table.limit(0), asked, 7).count()
