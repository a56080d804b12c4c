"""Density from a fine grid against the exact one."""

import numpy as np
import pytest

from cliptide.operators import evaluate


@pytest.fixture(scope="module")
def values(spark):
    draw = np.random.default_rng(8)
    rows = [("a", float(v)) for v in draw.normal(0, 1, 4000)] + [("b", float(v)) for v in draw.lognormal(0, 1, 3000)]
    rows += [("b", 2.5)] * 2000 + [("a", None), ("single", 1.0), ("flat", 3.0), ("flat", 3.0)]
    return spark.createDataFrame(rows, "kind string, x double")


@pytest.mark.parametrize("cells", [51, 2001])
def test_within_the_stated_bound(values, cells):
    exact = {(r.kind, r.point): r for r in evaluate.density(values, "kind", "x").collect()}
    got = {(r.kind, r.point): r for r in evaluate.binned_density(values, "kind", "x", cells=cells).collect()}
    assert exact.keys() == got.keys() and {k for k, _ in got} == {"a", "b"}
    columns = {k: np.array([r.x for r in values.collect() if r.kind == k and r.x is not None]) for k in "ab"}
    for kind, x in columns.items():
        h = x.std(ddof=1) * len(x) ** -0.2
        step = (np.ptp(x) + 6 * h) / (cells - 1)
        off = max(abs(got[kind, p].density - exact[kind, p].density) for p in range(50))
        assert off <= 0.05 * (step / h) ** 2 / h + 1e-12
        assert all(got[kind, p].x == pytest.approx(exact[kind, p].x) for p in range(50))


def test_no_group_empty_and_no_python(values):
    whole = evaluate.binned_density(values, [], "x", bandwidth=0.5)
    assert whole.count() == 50
    assert evaluate.binned_density(values.limit(0), "kind", "x").count() == 0
    plan = evaluate.binned_density(values, "kind", "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
