"""Every query with an SQL twin agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("float"):
            frame[c] = frame[c].round(9) + 0.0
    return sorted(map(str, frame.astype(object).itertuples(index=False, name=None)))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    found = entry.queries()[name](spark, DATA).toPandas()
    if name not in plans.SQL:
        assert len(found) and found.notna().any().any()
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    expected = db.execute(plans.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert normal(found) == normal(expected)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_vector_queries_take_every_row(spark, monkeypatch):
    every = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    found = plans.QUERIES["prototype_margins"](spark, DATA)
    assert found.count() == every and found.select("side").distinct().count() == 2
    seen = []
    probes = plans.vectors.probes
    monkeypatch.setattr(plans.vectors, "probes", lambda rows, *a: seen.append(rows.count()) or probes(rows, *a))
    plans.QUERIES["probe_r2"](spark, DATA)
    assert seen == [every]


def test_long_documents_count_whole(spark, tmp_path):
    text = ("stone " * 20 + ". ") * 1000 + "famous " * 900 + "."
    spark.createDataFrame([(1, "en", "s", text)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rates = {r.feature: r.value for r in plans.QUERIES["syntax_flags"](spark, str(tmp_path)).collect()}
    assert rates["adj_rate"] > 0
    words = len(text.split())
    assert plans.QUERIES["style_chunks_whole"](spark, str(tmp_path)).count() == -(-words // 120) > 48


def test_probe_finds_known_noise(spark):
    rows = spark.range(3000).selectExpr("id", "array(sin(id * 12.9898) * 1.41421, cos(id * 78.233))  as v", "pmod(xxhash64(id), 2001) / 1000.0 - 1.0 as u")
    signal, noise = "v[0]", "u * sqrt(3)"
    named = rows.selectExpr("v", f"{signal} as all", f"{signal} + {noise} as half", f"{noise} as none")
    r2 = {r.feature: r.r2 for r in plans.vectors.probes(named, "v", ["all", "half", "none"]).collect()}
    assert r2["all"] > 0.99 and 0.4 < r2["half"] < 0.6 and r2["none"] < 0.05


def test_probes_equal_fits_of_each_fold(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6)) + 3
    y = np.stack([x @ rng.normal(size=6) + rng.normal(size=400) * s for s in (0.1, 3.0)] + [rng.normal(size=400), np.full(400, 2.0)], axis=1)
    data = [(v.tolist(), *t.tolist()) for v, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 2.0), ([1.0], 1.0, 1.0, 1.0, 2.0), ([float("nan")] * 6, 1.0, 1.0, 1.0, 2.0), ([0.0] * 6, None, 1.0, 1.0, 2.0)]
    rows = spark.createDataFrame(data, "v array<double>, a double, b double, c double, d double").repartition(5)
    got = {r.feature: r.r2 for r in plans.vectors.probes(rows, "v", list("abcd"), alpha=2.0).collect()}
    fold = {tuple(r.v): r.k for r in rows.select("v", F.pmod(F.xxhash64("v", F.lit(0)), F.lit(5)).alias("k")).collect() if r.v}
    k = np.array([fold[tuple(v.tolist())] for v in x])
    for t, name in enumerate("abcd"):
        scores = []
        for f in range(5):
            train, test = k != f, k == f
            mx, my = x[train].mean(0), y[train, t].mean()
            w = np.linalg.solve((x[train] - mx).T @ (x[train] - mx) + 2.0 * np.eye(6), (x[train] - mx).T @ (y[train, t] - my))
            off = y[test, t] - (my + (x[test] - mx) @ w)
            spread = ((y[test, t] - y[test, t].mean()) ** 2).sum()
            scores.append(1 - (off**2).sum() / spread if spread > 1e-9 else 0.0)
        assert abs(got[name] - max(0.0, np.mean(scores))) < 1e-8
    assert [r.r2 for r in plans.vectors.probes(rows.where("false"), "v", ["a"]).collect()] in ([], [0.0])
