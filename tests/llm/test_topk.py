import math

import numpy as np
import pytest

from cohortry.llm import topk as K

NAN, INF = float("nan"), float("inf")
BASE = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4 + i % 3).round(2)]) for i in range(120)]
ODD = [(200, None), (250, [0.1, NAN]), (300, [INF, 0.0]), (350, [None, 1.0]), (400, []), (None, [1.0, 1.0]), (450, [0.0, 0.0, 5.0]), (7, BASE[7][1]), (100, [9.0, 9.0])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, v int")


def brute_force(rows, k=5):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if i % 50 == 0:
            asked[i] = max(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [BASE, [*BASE, *ODD], BASE[:1], BASE[:3], []], ids=["plain", "odd", "alone", "few", "empty"])
def test_as_by_brute_force(spark, rows):
    assert sorted(tuple(r) for r in K.top_k(frame(spark, rows)).collect()) == brute_force(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BLOCK", 1)
    monkeypatch.setattr(K, "CANDIDATE_ROWS", 7)
    rows = [*BASE, *ODD]
    assert sorted(tuple(r) for r in K.top_k(frame(spark, rows).repartition(5)).collect()) == brute_force(rows)


def test_many_blocks_leave_the_plan_alone(spark, monkeypatch):
    rows = [(50 * i, [float(i % 7), float(i % 5 - 2)]) for i in range(60)]
    one = K.top_k(frame(spark, rows))
    monkeypatch.setattr(K, "QUERY_BLOCK", 5)
    many = K.top_k(frame(spark, rows))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(many) == size(one) == 1
    assert sorted(tuple(r) for r in many.collect()) == brute_force(rows)


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(OverflowError):
        K.top_k(frame(spark, [(0, [1e17, 1.0]), (1, [1e17, 1.0])]))
    assert K.top_k(frame(spark, [(0, [1e6, 1.0]), (1, [1e6, -1.0])])).count() == 1


def test_sql_has_the_same_rule_for_repeated_ids(spark):
    import duckdb

    rows = [r for r in [*BASE, *ODD, (100, [8.0, 99.0])] if r[0] is not None]
    got = sorted(tuple(r) for r in K.top_k(frame(spark, rows)).collect())
    db = duckdb.connect()
    table = frame(spark, rows).select("vec_id", "embedding").toArrow()
    db.register("embeddings", table)
    assert sorted(db.execute(K.SQL).fetchall(), key=lambda r: (r[0], r[1])) == got
