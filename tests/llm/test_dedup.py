"""Dedup operators against brute force on small fixtures."""

import random
import time
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import graph, line_dedup, ngram_join, suffix_dedup
from quillspark.llm.graph import components

SCHEMA = "doc_id long, text string, d string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[k], t, "x") for k, (i, t) in enumerate(enumerate(texts))], SCHEMA)


def text(rng, words, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def test_difference_cover_covers():
    for r in (1, 2, 3):
        period, cover = suffix_dedup.difference_cover(r)
        assert {(int(a) - int(b)) % period for a in cover for b in cover} == set(range(period))


def brute_repeats(raws, length):
    seen = Counter(r[k: k + length] for r in raws for k in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k: k + length]] > 1:
                gone[k: k + length] = True
        yield gone


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    shared, other = text(rng, 120), text(rng, 90)
    near = text(rng, 400).split()
    texts = ["", None, "short é", text(rng, 300), shared + " " + text(rng, 60), text(rng, 50) + " " + shared[7:], shared, shared, other * 2, "ab" * 900, text(rng, 10) + other, text(rng, 3000)]
    for k in range(6):
        copy = list(near)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
        texts.append("é".join(copy))
    raws = [(t or "").encode() for t in texts]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), length=400, with_text=True, carry=["d"]).collect()}
    assert len(found) == len(texts)
    for k, (raw, gone) in enumerate(zip(raws, brute_repeats(raws, 400))):
        row, kept = found[k], bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(raw), gone.sum(), spans, sha256(kept).hexdigest()), k
        assert row.text == kept.decode("utf-8", "ignore") and row.d == "x"


def test_suffix_dedup_degenerate(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    rows = suffix_dedup.remove_repeats(frame(spark, ["q" * 500, "q" * 500, None], [7, 7, None])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 500, 500]


def brute_components(texts, ids, n, num, den):
    def grams(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[k: k + n]) for k in range(max(len(ws) - n, 0) + 1)} if ws else set()

    sets, root = [grams(t) for t in texts], {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in zip(ids, sets)}


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, " \t ", "One", "one", "one two three", "ONE two  three", "one two three four"]
    for size in (12, 60, 200):
        base = text(rng, size).split()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = f"e{rng.random()}"
            texts.append(" ".join(copy))
    chain = text(rng, 100).split()
    for k in range(8):  # each links with the next, the ends don't
        chain = chain[4:] + [f"c{k}{j}" for j in range(4)]
        texts.append(" ".join(chain))
    common = text(rng, 40)
    texts += [common + " " + text(rng, 15 + k) for k in range(12)]
    ids = rng.sample(range(1000), len(texts))
    for n, num, den in ((4, 85, 100), (5, 4, 5)):
        found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame(spark, texts, ids), n, num, den).collect()}
        assert found == brute_components(texts, ids, n, num, den)


def test_ngram_sets_of_a_batch_are_those_of_each_text():
    rng = random.Random(3)
    texts = ["", None, " \t ", "One", "a B", "a b c d", " lead \u00dc \x0b x\x0cy\r\nz q ", "a\x1cb c\x85d e f g", "w " * 50, "x\x00y z q r s", *[text(rng, k, 30) for k in range(40)]]
    whole = pa.array(["not read", *texts], pa.string())
    for n in (1, 4, 5, 9):
        # a slice, as arrays with an offset go wrong easily
        flat, bounds = ngram_join.shingle_sets(whole.slice(1), n)
        expected = [ngram_join.shingles(t, n) for t in texts]
        assert flat.tolist() == np.concatenate(expected).tolist() and np.diff(bounds).tolist() == [len(e) for e in expected]
        assert ngram_join.signatures(flat, bounds).tolist() == [ngram_join.signature(e) for e in expected]
        for some in ([], [None], ["a"]):
            assert len(ngram_join.shingle_sets(pa.array(some, pa.string()), n)[1]) == len(some) + 1


def test_ngram_lists_travel_no_wider_than_their_postings(spark):
    """What a window computes from its rows is computed after they are dealt out."""
    listed = spark.createDataFrame([(1, 2, 9, 0), (1, 3, 9, 0)], "token long, node long, size int, place int")
    plan = ngram_join._tries(listed, 4, 5)._jdf.queryExecution().executedPlan().toString()
    # a plan is printed from its result down
    assert plan.rindex("xxhash64(node") < plan.rindex("Exchange")


def test_ngram_lists_of_one_document_alone_are_left_out(spark):
    """Rows that share an id are one document: what only they share links nothing."""
    posts = spark.createDataFrame([(1, 10, 9, 0, 7), (1, 11, 9, 1, 7), (2, 10, 9, 2, 7), (2, 12, 9, 0, 8), (3, 12, 9, 1, 8)], "token long, node long, size int, place int, owner long")
    assert {r.token for r in ngram_join._listed(posts).collect()} == {2}
    rng = random.Random(21)
    base, own = text(rng, 80), text(rng, 30)
    # 1 has two unlike rows, each near another document; 4 has two near ones
    texts = [base, own, base + " x", own + " y", base[:200], base[:200] + " z"]
    ids = [1, 1, 2, 3, 4, 4]
    found = {(r.doc_id, r.component_id) for r in ngram_join.similar_components(frame(spark, texts, ids), 5, 4, 5).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_ngram_blocks_pass_over_no_pair_that_fits(spark):
    for num, den in ((85, 100), (4, 5)):
        rows = [(size, place) for size in range(1, 61) for place in range(int(ngram_join.prefix_length(np.int64(size), num, den)))]
        posts = spark.createDataFrame(rows, "size int, place int")
        band, back = ngram_join._band(F.col("size"), num, den), ngram_join._back(F.col("size"), F.col("place"), num, den)
        x = posts.select(F.col("size").alias("x_size"), F.col("place").alias("x_place"), F.explode(ngram_join._reachable(num, den)).alias("b")).select("*", "b.*").drop("b")
        y = posts.select(F.col("size").alias("y_size"), F.col("place").alias("y_place"), band.alias("band"), back.alias("back"))
        looked_at, fits = x.join(y, ["band", "back"]).drop("band", "back"), ngram_join._fits("x_", "y_", num, den)
        every = x.select("x_size", "x_place").distinct().crossJoin(y.drop("band", "back"))
        found, expected = looked_at.where(fits).collect(), every.where(fits).collect()
        assert len(found) == len(expected) and set(map(tuple, found)) == set(map(tuple, expected))
        by_band = posts.select(F.explode(F.array(band - 1, band, band + 1)).alias("band")).join(y, "band").count()
        assert looked_at.count() < 0.7 * by_band


def test_ngram_pairs_are_made_by_few_of_the_lists_they_share(spark):
    rng = random.Random(8)
    rows, shared = [], {node: set() for node in range(8)}
    for node in shared:  # all hold most of the same 300 shingles
        own = [t for t in range(300) if rng.random() < 0.9]
        shared[node] = set(own)
        rows += [(t, node, 3000, place, node) for place, t in enumerate(own)]
    listed = spark.createDataFrame(rows, "token long, node long, size int, place int, label long")
    first = spark.createDataFrame([(node, *[0] * len(ngram_join.SIGNS)) for node in shared], f"node long, {', '.join(s + ' long' for s in ngram_join.SIGNS)}")
    pairs = Counter((r.a, r.b) for r in ngram_join._across(ngram_join._mixed(listed), first, 4, 5).collect())
    assert set(pairs) == {(a, b) for b in shared for a in range(b)}
    assert sum(pairs.values()) < 0.05 * sum(len(shared[a] & shared[b]) for a, b in pairs)


def test_ngram_neighbours_by_signature_follow_the_postings(spark):
    """A list of many components offers each node its nearest few, not all."""
    rng, base, rows, signs = random.Random(12), random.Random(1).getrandbits(256), [], ngram_join.SIGNS
    for pair in range(150):
        own = base
        for bit in rng.sample(range(256), 20):
            own ^= 1 << bit
        twin = own
        for bit in rng.sample(range(256), 4):
            twin ^= 1 << bit
        for k, s in enumerate((own, twin)):
            words = [(s >> 64 * j) % 2**64 for j in range(len(signs))]
            rows.append((7, 2 * pair + k, 150, 0, *[w - 2**64 if w >> 63 else w for w in words]))
    chained = spark.createDataFrame(rows, f"token long, node long, size int, place int, {', '.join(s + ' long' for s in signs)}")
    answers = spark.createDataFrame([(0, 0), (1, 0)], "node long, label long")
    found = [{(r.a, r.b) for r in ngram_join._neighbours(chained, answers, turn, 85, 100).collect()} for turn in (0, 21)]
    assert set.union(*found) >= {(2 * k, 2 * k + 1) for k in range(1, 150)} and not {(0, 1)} & set.union(*found)
    assert all(len(pairs) <= ngram_join.NEAREST * 300 for pairs in found)


def test_ngram_join_reads_each_row_of_repeated_ids(spark):
    """An id's rows hold different texts: a set is compared by its own row's."""
    rng = random.Random(9)
    near = [text(rng, 80).split() for _ in range(3)]
    texts, ids = [], []
    for k, words in enumerate(near):
        for j in range(3):  # alike but for a word at the end
            texts += [" ".join([*words[:-1], f"e{k}{j}"]), text(rng, 80)]
            ids += [10 * k + j, 10 * k + j]
    texts, ids = texts + texts[:2], ids + ids[:2]
    found = {(r.doc_id, r.component_id) for r in ngram_join.similar_components(frame(spark, texts, ids), 5, 4, 5).collect()}
    assert found == {(i, i - i % 10) for i in ids}


def test_ngram_join_degenerate(spark):
    assert ngram_join.similar_components(frame(spark, [])).count() == 0
    rows = ngram_join.similar_components(frame(spark, ["a b c d e f", "a b c d e f", "x y z q r s", None], [5, None, 5, 2])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (2, 2), (5, 5), (5, 5)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{k: 100 for k in range(100, 130)}}


def test_components_at_once_and_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    edges = [tuple(rng.randrange(-300, 300) for _ in range(2)) for _ in range(260)] + [(2**62, -2**62), (-2**62, 2**61)]
    least = {v: v for e in edges for v in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    expected = {v: k for v, k in least.items() if any(v in e and e[0] != e[1] for e in edges)}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.label for r in components(frame).collect()} == expected
    monkeypatch.setattr(graph, "AT_ONCE", 10)
    assert {r.node: r.label for r in components(frame).collect()} == expected
    monkeypatch.undo()
    assert components(frame.where("false")).count() == 0


def test_components_of_few_edges_take_few_plans(spark):
    """A chain took the driver some twenty plans, which it keeps for a while."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    assert components(chain).where("label = 0").count() == 201
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before <= 4


def brute_lines(texts, num, den):
    seen, out = [], []
    for t in texts:
        kept = []
        for line in t.split("\n") if t is not None else []:
            words = set(line.split())
            if words and any(den * len(words & s) >= num * len(words | s) for s in seen):
                seen.append(words)
                continue
            if words:
                seen.append(words)
            kept.append(line)
        out.append("\n".join(kept) if t is not None else None)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [text(rng, rng.randint(1, 30), 300) for _ in range(40)]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
            lines.append(rng.choice(("", " ", "\t")) + rng.choice((" ", "  ")).join(words))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "a\nb\na", "p q r s\np q r s t"]
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame(spark, texts)).collect()}
    assert [found[k].text for k in range(len(texts))] == brute_lines(texts, 4, 5)
    assert found[len(texts) - 2].n_removed == 1 and found[0].d == "x"


def test_line_dedup_degenerate(spark):
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0
    rows = line_dedup.drop_repeated_lines(frame(spark, ["m n o\nk l", "m n o\nk l", "k l"], [3, 3, None])).collect()
    assert sorted(r.text for r in rows) == ["k l", "m n o", "m n o"]


def test_dropping_lines_is_linear_in_them(spark):
    began, n = time.time(), 400_000
    for gone in (set(range(0, n, 2)), set(range(n)), {0}, {n - 1}, set(range(1000, n))):
        one = spark.createDataFrame([("\n".join(f"line {k}" if k % 3 else "" for k in range(n)), sorted(gone, reverse=True))], "text string, gone array<int>")
        found = one.select(line_dedup.without(F.split("text", "\n"), F.col("gone")).alias("kept")).collect()[0].kept
        assert found == "\n".join(f"line {k}" if k % 3 else "" for k in range(n) if k not in gone)
    assert time.time() - began < 60


def test_line_join_keeps_one_table_of_prefixes(spark, monkeypatch):
    rng, alive, held = random.Random(3), [], []
    stage, unstage = line_dedup.stage, line_dedup.unstage

    def staged(rows, name):
        if name == "crossed":
            held.append(sum("prefix" in rows.columns for rows in alive))
        alive.append(stage(rows, name))
        return alive[-1]

    def unstaged(rows):
        alive[:] = [r for r in alive if r is not rows]
        unstage(rows)

    monkeypatch.setattr(line_dedup, "stage", staged)
    monkeypatch.setattr(line_dedup, "unstage", unstaged)
    line = text(rng, 20)
    rows = frame(spark, [line + " one\n" + text(rng, 9), line + " two\n" + line + " two", None])
    assert {(r.d, r.line_no) for r in line_dedup.removed_lines(rows).collect()} == {(1, 0), (1, 1)}
    assert held and max(held) == 1


def test_line_pivots_travel_no_wider_than_their_postings(spark):
    """A posting's pivot is made after lists are dealt out, not beside every row."""
    first = spark.createDataFrame([(1, 0, 0, 0, 9, 0, 0, 0, 0, 0, [5, 6]), (2, 1, 0, 0, 9, 0, 0, 0, 0, 0, [5, 6])], "node long, d long, t long, line_no int, size int, parity long, q0 long, q1 long, q2 long, once int, prefix array<long>")
    plan = line_dedup._pivots(first, 0, 4, 5)._jdf.queryExecution().executedPlan().toString()
    # a plan is printed from its result down
    assert plan.rindex("struct(node") < plan.rindex("Exchange")


def test_line_verification_cuts_up_only_documents_of_asked_lines(spark, monkeypatch):
    docs = spark.range(50).selectExpr("id as d", "id * 7 as t", "concat('a b c d e f g h i ', id, '\\nx', id) as text")
    first = docs.selectExpr("d as node", "d", "t", "0 as line_no", "10 as size")
    pairs = spark.createDataFrame([(4, 3)], "y long, x long")
    asked = []
    whole = line_dedup.KeyFilter.holds
    monkeypatch.setattr(line_dedup.KeyFilter, "holds", lambda self, key: asked.append(str(key)) or whole(self, key))
    assert [r.node for r in line_dedup._similar(docs, first, pairs, 4, 5).collect()] == [4]
    assert "xxhash64(d, t)" in asked[0]
