"""Global ranks, quantiles and discoveries against numpy."""

import numpy as np
import pytest

from skyfold.operators.ranking import benjamini_hochberg, quantiles, ranked


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(1)
    return np.round(rng.normal(size=3000), 2), spark


def frame(spark, values, parts=7):
    return spark.createDataFrame([(i, None if v is None else float(v), "x") for i, v in enumerate(values)], "i int, v double, rank_ string").repartition(parts)


def test_ranks_are_those_of_one_sort_and_no_task_sees_all_rows(many):
    values, spark = many
    out = ranked(frame(spark, values), "v", "i")
    got = out.orderBy("rank").select("i", "rank").collect()
    assert [r.i for r in got] == np.lexsort((np.arange(len(values)), values)).tolist() and [r.rank for r in got] == list(range(1, len(values) + 1))
    assert ranked(frame(spark, [1.0]).limit(0), "v").count() == 0
    tied = ranked(frame(spark, [2.0] * 500 + [None] * 3), "v").collect()
    assert sorted(r.rank for r in tied) == list(range(1, 504)) and {r.rank for r in tied if r.v is None} == {1, 2, 3}


def test_quantiles_equal_numpy(many):
    values, spark = many
    shares = {"low": 0.01, "middle": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}
    got = quantiles(frame(spark, [*values, None]), "v", shares).first()
    assert np.allclose([got[n] for n in shares], [np.quantile(values, q) for q in shares.values()])
    assert quantiles(frame(spark, [None]), "v", shares).first().low is None and quantiles(frame(spark, [3.0]), "v", shares).first().high == 3


def test_discoveries_equal_the_rule(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(900), rng.random(60) * 1e-4, [0.0, 0.0, 1.0]])
    order = np.argsort(p)
    for share in (0.05, 0.3):
        ok = np.flatnonzero(p[order] <= np.arange(1, len(p) + 1) * share / len(p))
        want = set(order[: ok.max() + 1].tolist())
        assert {r.i for r in benjamini_hochberg(frame(spark, p), "v", share).collect()} == want
    assert benjamini_hochberg(frame(spark, [0.9, 0.8, None]), "v", 0.01).count() == 0
