import os

import numpy as np
import pytest

from quillspark.llm import mih

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)


def data(n=900, dims=32):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, dims))
    rows = (centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dims)) * 0.6).astype(np.float32)
    rows[50:80] = rows[10]
    out = [v.tolist() for v in rows]
    out[3], out[4], out[5], out[6], out[20] = None, [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0, 2.0]
    return out


def brute(vectors, every, k, distance):
    ok = [i for i, v in enumerate(vectors) if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q in ok:
        if q % every == 0:
            yield q, sorted((distance(vectors[q], vectors[i]), i) for i in ok if i != q)[:k]


def test_exact_topk_equals_brute_force(spark):
    vectors = data()
    found = {}
    for r in mih.exact_topk(table(spark, vectors), lambda i: i % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    expected = dict(brute(vectors, 20, 10, lambda a, b: sum((x > 0) != (y > 0) for x, y in zip(a, b))))
    assert {q: [(d, i) for _, d, i in sorted(v)] for q, v in found.items()} == expected


def test_nearest_recall_and_scores(spark):
    vectors = data()
    found = {}
    for r in mih.nearest(table(spark, vectors), lambda i: i % 10 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for q, near in brute(vectors, 10, 10, lambda a, b: float(np.sqrt(((np.array(a, np.float64) - np.array(b, np.float64)) ** 2).sum()))):
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [s for _, s, _ in own] == sorted(s for _, s, _ in own)
        hits += len({i for _, i in near} & {i for _, _, i in own})
        total += 10
        if near[9][0] == 0.0:  # many copies: the smallest ids
            assert [i for _, _, i in own] == [i for _, i in near]
    assert hits >= 0.9 * total


def test_nearest_recall_with_a_small_fit_sample_and_shards(spark, monkeypatch):
    monkeypatch.setattr(mih, "FIT_ROWS", 300)
    monkeypatch.setattr(mih, "SHARD_ROWS", 500)
    vectors = data(3000)
    found = {}
    for r in mih.nearest(table(spark, vectors), lambda i: i % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    matrix = np.array([v if v and len(v) == 32 and all(x is not None for x in v) else [np.nan] * 32 for v in vectors], np.float64)
    ok = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
    hits = total = 0
    for q in range(0, len(vectors), 20):
        if ok[q]:
            far = np.where(ok, np.sqrt(((matrix - matrix[q]) ** 2).sum(1)), np.inf)
            far[q] = np.inf
            hits += len(found[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
            total += 10
    print(f"recall {hits} of {total}")
    assert hits >= 0.9 * total


def test_few_or_no_vectors(spark):
    assert mih.nearest(table(spark, []), lambda i: i % 2 == 0).count() == 0
    assert mih.exact_topk(table(spark, [None]), lambda i: i % 2 == 0).count() == 0
    three = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    assert [(r.query_id, r.vec_id) for r in mih.nearest(table(spark, three), lambda i: i == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_probes_by_masks_equal_a_scan():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    index = mih.MultiIndex(codes)
    words = codes.view("<u2")
    for q in range(20):
        part = index.query(codes[q])[1]
        for j in range(4):
            away = np.bitwise_count(words[:, j] ^ part[j])
            for low, high in ((0, 0), (1, 1), (0, 2), (3, 5), (16, 16)):
                assert sorted(index.probe(part, j, low, high)) == np.flatnonzero((away >= low) & (away <= high)).tolist()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_recall_on_the_embeddings_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = {(r.query_id, r.vec_id) for r in mih.nearest(rows, lambda i: i % 5 == 0).collect()}
    ids, data = zip(*[(r.vec_id, r.embedding) for r in rows.select("vec_id", "embedding").collect()])
    data, right, total = np.array(data, np.float64), 0, 0
    for k, i in enumerate(ids):
        if i % 5 == 0:
            away = ((data - data[k]) ** 2).sum(1)
            away[k] = np.inf
            near = np.argsort(away, kind="stable")[:10]
            right += sum((i, ids[n]) in found for n in near)
            total += len(near)
    assert right >= 0.9 * total
