import hashlib

import numpy as np
import pytest

from quillspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)


def data(n=700, dims=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, dims))
    rows = [(i, v.tolist()) for i, v in enumerate((centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.4).astype(np.float32))]
    rows += [(5, rows[9][1]), (None, rows[3][1]), (700, None), (701, [float("nan")] * dims), (702, [float("inf")] + [0.0] * (dims - 1)), (703, [None] + [0.0] * (dims - 1)), (704, [1.0]), (705, [0.0] * dims)]
    return rows + [(800 + i, [0.5] * dims) for i in range(300)] + [(1200 + i, [0.25 * (i % 2)] * dims) for i in range(40)]


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    v = np.array([x for _, x in kept], dtype=object)
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in named]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for x in v]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            members = [x for x, (_, o) in zip(v, own) if o == j]
            if members:
                c[j] = [sum(m) // len(members) for m in zip(*members)]
    own = assign()
    total = {j: sum(d for d, o in own if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted((-1 if i is None else i, o, d, total[o], sum(total.values()), sha[o]) for (i, _), (d, o) in zip(kept, own))


@pytest.mark.parametrize("k, rounds", [(16, 3), (5, 8), (1, 2), (2, 0), (2000, 1)])
def test_equals_full_scans(spark, k, rounds):
    rows = data(n=150 if k == 2000 else 700)
    found = centroids.digests(*centroids.cluster(table(spark, rows).repartition(5), k=k, rounds=rounds, dims=8)).collect()
    own = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found)
    assert own == brute(rows, k, rounds, 8)


def test_bounds_spare_scans():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 20, (500, 4)), rng.integers(500, 520, (500, 4))])
    c = np.array([[0, 0, 0, 0], [510, 510, 510, 510]])
    cluster, upper, lower = centroids.Bounds(c, None).scan(v)
    later = centroids.Bounds(c + 1, c)
    later.scan = lambda rest: centroids.Bounds.scan(later, rest) if not len(rest) else pytest.fail("scanned")
    assert (later.advance(v, cluster, upper, lower)[0] == cluster).all()


def test_empty_and_unusable(spark):
    found, c = centroids.cluster(table(spark, []), dims=8)
    assert centroids.digests(found, c).collect() == [] and c.shape == (0, 8)
    found, c = centroids.cluster(table(spark, [(1, None), (2, [1.0])]), dims=8)
    assert found.collect() == []
    found, c = centroids.cluster(table(spark, [(None, [1.0] * 8), (None, [2.0] * 8)]), dims=8)
    assert sorted((r.cluster, r.distance) for r in found.collect()) == [(0, 8 * 32 * 32)] * 2  # one centroid, that moves to the mean
    with pytest.raises(Exception, match="component too large"):
        centroids.cluster(table(spark, [(1, [1e30] + [0.0] * 7)]), dims=8)
