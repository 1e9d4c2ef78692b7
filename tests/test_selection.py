import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import bands, selection

EDGES = [0.0, -0.0, 1.0, -1.0, 2.0, 0.1, -0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 2.0 ** 52 + 1, math.nextafter(8.0, 0), math.nextafter(8.0, 9), 1e-310]


def test_keys_have_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    many = EDGES + np.frombuffer(rng.bytes(8 * 4000), np.float64).tolist() + [2.0 ** k for k in range(-1074, 1024)] + [math.nextafter(2.0 ** k, 0) for k in range(-1000, 1024)]
    many = [x for x in many if x == x]
    rows = spark.createDataFrame([(x,) for x in many], "v double").select("v", selection.order_key(F.col("v")).alias("k")).collect()
    bits = np.array([r.v for r in rows]).view(np.int64)
    expected = np.where(bits < 0, -(bits & 0x7FFFFFFFFFFFFFFF), bits)
    assert [r.k for r in rows] == expected.tolist()
    assert spark.createDataFrame([(math.nan,)], "v double").select(selection.order_key(F.col("v"))).first()[0] > (2047 << 52)


@pytest.mark.parametrize("few", [100_000, 0])
def test_ranks_equal_a_sort(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW_PREFIXES", few)
    rng = np.random.default_rng(4)
    groups = {"a": EDGES, "b": rng.normal(size=901).tolist(), "c": [1.5], None: (rng.normal(size=40) * 10.0 ** rng.integers(-300, 300, 40)).tolist(), "ties": [0.25] * 500 + rng.random(7).tolist(), "near": [math.nextafter(1.0, 2) if k % 2 else 1.0 for k in range(9)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in selection.select_ranks(frame, ["g"], "v", {"first": lambda n: F.lit(0), "third": lambda n: F.floor((n - 1) / 3), "last": lambda n: n - 1}).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        s = sorted(values)
        assert (got[g].n, got[g].first, got[g].third, got[g].last) == (len(s), s[0], s[(len(s) - 1) // 3], s[-1])
    mids = {r.g: r.mid for r in selection.medians(frame, ["g"], "v").collect()}
    assert mids["b"] == np.median(groups["b"]) and mids["ties"] == 0.25
    assert selection.medians(frame.where("g = 'b'"), [], "v").collect() == [(901, np.median(groups["b"]))]
    assert selection.medians(frame.where("false"), [], "v").collect() == []


def test_no_task_sorts_or_holds_a_group(spark):
    frame = spark.range(5000).selectExpr("'all' as g", "sin(id) as v")
    found = selection.medians(frame, ["g"], "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # values are counted before they are shuffled; windows are over digits
    assert "percentile" not in plan and "collect_list" not in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_d" in line and "_v" not in line


def test_robust_cutoff(spark):
    values = [1.0, 2.0, 2.5, 3.0, 10.0]
    got = bands.robust_high(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v").first()
    mid, mad = np.median(values), np.median(np.abs(np.array(values) - 2.5))
    assert (got.n, got.mid, got.mad) == (5, mid, mad) and abs(got.cutoff - (mid + 3 * 1.4826 * mad)) < 1e-12
