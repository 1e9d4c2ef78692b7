import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import similarity, structure, vectors


def brute(parts, most):
    out = []
    for d in {d for d, _ in parts if d is not None}:
        own = sorted((p, Counter(terms)) for (k, p), terms in parts.items() if k == d)
        pairs = []
        for i, (a, x) in enumerate(own):
            for b, y in own[i + 1:]:
                norms = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
                dot = sum(n * y[t] for t, n in x.items())
                pairs.append((-(math.floor(dot / norms * 100 + 0.5) / 100 if norms else 0.0), a, b))
        out += [(d, r + 1, a, b, -c) for r, (c, a, b) in enumerate(sorted(pairs)[:most])]
    return sorted(out)


def frames(spark, parts):
    rows = spark.createDataFrame([(d, p) for d, p in parts], "doc_id int, part int")
    terms = [(d, p, t, n) for (d, p), ts in parts.items() for t, n in Counter(ts).items()]
    return rows, spark.createDataFrame(terms, "doc_id int, part int, term string, n long")


def test_most_similar_equals_all_pairs(spark):
    rng = random.Random(5)
    words = [f"t{int(300 * rng.random() ** 3)}" for _ in range(4000)]
    parts = {(d, p): [rng.choice(words) for _ in range(rng.randint(5, 60))] for d, k in ((1, 40), (2, 3), (3, 1), (4, 25)) for p in range(k)}
    parts |= {(5, p): ["same", "terms"] for p in range(20)} | {(6, p): [f"own{p}"] for p in range(20)} | {(7, p): [] for p in range(3)}  # all tie; nothing shared; empty parts
    parts |= {(8, p): parts[1, p % 4] + [f"x{p}"] for p in range(16)} | {(None, p): ["a"] for p in range(3)}
    for most in (6, 2):
        got = sorted(tuple(r) for r in similarity.most_similar(*frames(spark, parts), "doc_id", most).collect())
        assert got == brute(parts, most)


def test_few_pairs_are_listed(spark):
    rng = random.Random(9)
    parts = {(1, p): [f"common{rng.randint(0, 9)}" for _ in range(3)] + [f"w{rng.randint(0, 20000)}" for _ in range(60)] for p in range(300)}
    for p in range(8):
        parts[1, 290 + p] = parts[1, p][:50] + parts[1, 290 + p][:10]
    rows, counts = frames(spark, parts)
    norms = counts.groupBy("doc_id", "part").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    best = similarity.most_similar(rows, counts, "doc_id").collect()
    assert {(r.a, r.b) for r in best} <= {(p, 290 + p) for p in range(8)}
    bounds = spark.createDataFrame([(1, min(r.cosine for r in best) - similarity.HALF)], "doc_id int, bound double")
    assert similarity.candidate_pairs(counts, norms, bounds, "doc_id").count() < 300  # of 44,850


def test_empty(spark):
    assert similarity.most_similar(*frames(spark, {(1, 1): ["a"]}), "doc_id").collect() == []
    rows, counts = frames(spark, {(1, 1): ["a"]})
    assert similarity.most_similar(rows.where("false"), counts.where("false"), "doc_id").collect() == []


def test_cosines_round_as_numbers_not_as_their_shortest_decimals(spark):
    rows = spark.createDataFrame([(0.575,), (0.125,), (0.145,), (0.57,), (0.0,)], "x double")
    assert [r.c for r in rows.select(similarity.cents(F.col("x")).alias("c")).collect()] == [0.57, 0.13, 0.14, 0.57, 0.0]


def test_blocks_are_compared_in_their_rows_as_across_them(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("tan", "mor", "kel", "vis") for b in ("dor", "pal", "rim") for c in ("ing", "s", "ly", "ness", "ized", "o'x", "é")] + ["the", "of", "(aside)", "*bold*", "<!--", "-->"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((2, 9, 10, 11, 60, 95, 400))]
    rows += [(3, rows[4][1]), (3, None), (8, None), (9, ""), (None, rows[5][1]), (10, "the of " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return sorted(tuple(r) for r in structure.block_redundancy(docs, "doc_id", words=10).collect())

    monkeypatch.setattr(structure, "WITHIN", 0)
    across = found()
    monkeypatch.setattr(structure, "WITHIN", 8)
    assert found() == across
    monkeypatch.undo()
    assert found() == across and {r[0] for r in across} == {3, 4, 5, 6, 10}


def test_a_long_document_is_cut_once(spark):
    docs = spark.createDataFrame([(1, "tandor morpal (so) kelrim " * 60_000)], "doc_id long, text string")
    began = time.time()
    assert vectors.chunks(docs, ["doc_id"], words=100, most=None).count() == 1800
    assert time.time() - began < 30  # 1,801 times before
