import random

import numpy as np
import pytest

from quillspark.llm import chosen_path, ngram_join

SCHEMA = "doc_id long, text string, node long, label string, size int"


def table(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA).repartition(5)


def brute(docs, n=5, num=85, den=100):
    sets = []
    for i, text in docs:
        words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append((i, frozenset(tuple(words[k: k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()))
    group = {i: i for i, _ in sets if i is not None}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                u, v = sorted((root(i), root(j)))
                group[v] = u
    return sorted(((-1 if i is None else i), len(s), -1 if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def result(spark, docs, **how):
    rows = chosen_path.near_duplicates(table(spark, docs), num=85, den=100, **how).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in rows)


def corpus(copies=60):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]

    def text(k):
        return [rng.choice(words) for _ in range(k)]

    docs = [(i, " ".join(text(rng.choice((3, 7, 60, 200))))) for i in range(40)]
    base, shared = text(120), text(60)
    for i in range(copies):  # a group that reaches from clear links over the threshold to none
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((1000 + i, " ".join(own)))
    docs += [(2000 + i, " ".join(shared + text(rng.randint(5, 70)))) for i in range(copies)]  # one passage in many documents
    docs += [(3000 + i, "same words in all of these copies here") for i in range(30)]
    docs += [(4000, "Three Little words"), (4001, "three little\tWORDS"), (4002, "three little"), (4003, None), (4004, ""), (4005, " \n "), (4006, " \n ")]
    docs += [(None, " ".join(base)), (None, None), (5000, " ".join(base)), (5000, docs[0][1]), (5001, "a " * 3000 + "end"), (5002, "a " * 3100 + "end")]
    return docs


@pytest.mark.parametrize("small, share", [(64, 256), (4, 3)])
def test_equals_brute_force(spark, monkeypatch, small, share):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "SHARE", share)
    docs = corpus()
    assert result(spark, docs) == brute(docs)


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert result(spark, [(1, "alone")]) == [(1, 1, 1, True)]


def test_paths_keep_pairs_at_the_threshold_as_often_as_said():
    rng = np.random.default_rng(0)
    trees = chosen_path.trees_for(0.85, 0.99999)
    assert trees == 4 and chosen_path.missed(0.85) ** trees < 1e-5 <= chosen_path.missed(0.85) ** (trees - 1)
    one, lost, met = chosen_path.Paths(1), 0, 0
    for _ in range(1500):
        a = rng.integers(0, 1 << 63, 185).astype(np.uint64)
        b = np.concatenate([a[:170], rng.integers(0, 1 << 63, 15).astype(np.uint64)])  # 170 of 200
        c = rng.integers(0, 1 << 63, 185).astype(np.uint64)
        x, y, z = (set(one.leaves(one.minima(s)).tolist()) for s in (a, b, c))
        lost += not x & y
        met += bool(x & z)
    assert abs(lost / 1500 - chosen_path.missed(0.85)) < 0.015 and met == 0


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:250], rng.integers(0, 1 << 63, 30).astype(np.uint64)]))
    away = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ngram_join.signature(a), ngram_join.signature(b)))
    assert away <= len(a) + len(b) - 2 * 250


def test_ngram_join_keeps_whole_node_ids_beside_null_texts(spark):
    docs = corpus(20)
    rows = ngram_join.similar_components(table(spark, docs), n=5, num=85, den=100).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in rows)
    assert found == [r[:3] for r in brute(docs)]
