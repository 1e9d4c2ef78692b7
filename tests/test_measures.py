"""Hand-computed rows, degenerate inputs and invariants of the measures."""

import math

from pyspark.sql import functions as F

from quillspark.functions import discourse, lexical, shape
from quillspark.functions import lexicons as L
from quillspark.functions import text as T
from quillspark.operators import bands, contrast, distance, panel, structure, vectors
from quillspark.plans import fixtures


def docs(spark, *texts):
    return spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "doc_id int, grp string, text string")


def counts(spark, *texts):
    return {r.doc_id: r.asDict() for r in shape.shape_counts(docs(spark, *texts), ["doc_id"]).collect()}


def test_prose_drops_markup_and_back_matter(spark):
    text = "# Title\nKept line, with words.\n- item\n| a |\n> quote\n[^1]: note\n**bold** gone\n<!-- a\nb -->After.\n## References\nlost"
    got = docs(spark, text, None, "").select("doc_id", T.prose(F.col("text")).alias("p")).collect()
    assert [r.p for r in got] == ["Kept line, with words. After.", "", ""]


def test_shape_counts_one_and_two_hits(spark):
    got = counts(
        spark, "It works, not fails, and ends; it is rather than was.", "a, b, and c. Then d, e, or f.", "What matters is this. It is odd that we go.",
        "The point is clear. Yes. The tension lies here.", "We use i.e. this and i.e.x that.",
    )
    assert (got[0]["comma_not"], got[0]["compound_and"], got[0]["semicolon"], got[0]["rather_than"]) == (1, 1, 1, 1)
    assert got[1]["triadic"] == 2
    assert (got[2]["what_cleft"], got[2]["first_person"]) == (2, 1)
    assert got[3]["abstract_subj"] == 2
    assert got[4]["reformulation"] == 1  # only before a word character


def test_bold_runs_skip_list_items(spark):
    assert counts(spark, "A **bold** and **more**\n- **item**: x\n1. **b**\nplain **c** d")[0]["bold_run"] == 2
    assert counts(spark, "- **item**: x\n* **b** y")[0]["inline_bold_list"] == 2


def test_empty_document_features(spark):
    row = shape.features(docs(spark, ""), ["doc_id"]).first()
    assert (row.mean_sent, row.burstiness_CV, row.pct_short, row.triadic) == (1.0, 0.0, 100.0, 0.0)


def test_possessive_triadic_equals_plain(spark):
    text = "one, two, and three; red, blue, or green. x (a, b, and c) y, z, and w, v, or u"
    row = docs(spark, text).select(F.regexp_count("text", F.lit(shape.L.TRIADIC_ANCHORED)).alias("a"), F.regexp_count("text", F.lit(shape.L.SHAPE["triadic"][1][0])).alias("b")).first()
    assert row.a == row.b


def test_syllables(spark):
    words = {"cake": 1, "table": 2, "the": 1, "idea": 2, "rhythm": 1, "able": 2, "beautiful": 3}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lexical.syllables(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in got} == words


def test_diversity_resets_and_short_texts():
    assert lexical.lexical_diversity(["a"] * 49) == 0.0
    assert lexical.lexical_diversity(["a"] * 50) == 2.0
    assert lexical.lexical_diversity([str(i) for i in range(60)]) == 60.0


def test_mtld_of_arrays_equals_the_fold(spark):
    import math
    import random

    rng = random.Random(6)
    lists = [None, [], ["a"] * 49, ["a"] * 50, [str(i) for i in range(60)]]
    lists += [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, k) for _ in range(rng.randint(40, 900))] for k in (1, 2, 3, 9) for _ in range(12)]
    lists.append([str(i) for i in range(60_000)])  # one run that never ends: not quadratic
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>")
    plan = rows.select(lexical.mtld(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in rows.select("id", lexical.mtld(F.col("t")).alias("m")).collect():
        # the fold rounds ties to even, the column up
        assert math.isclose(r.m, lexical.lexical_diversity(lists[r.id] or []), abs_tol=0.1000001 if (lists[r.id] and r.id > 4) else 1e-9)
    exact = [abs(r.m - lexical.lexical_diversity(lists[r.id] or [])) < 1e-9 for r in rows.select("id", lexical.mtld(F.col("t")).alias("m")).collect()]
    assert sum(exact) >= len(exact) - 1


def test_stems_take_first_suffix(spark):
    row = docs(spark, "Organization runs quickly; the classes are being tested <!-- x --> happiness").select(lexical.stems(F.col("text")).alias("s")).first()
    assert row.s == ["organ", "run", "quick", "class", "test", "happi"]


def test_percentile_rules(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 10)], "g string, v double")
    got = bands.order_statistics(rows, ["g"], "v", {"r": (0.8, "round"), "f": (0.8, "floor"), "h": (0.5, "round")}).first()
    assert (got.r, got.f, got.h) == (3.0, 3.0, 3.0)


def test_auc_is_antisymmetric(spark):
    rows = [("f", s, float(v)) for s, v in [(1, 3), (1, 2), (0, 1), (0, 2), (0, 5)]]
    one = contrast.auc(spark.createDataFrame(rows, "f string, side int, v double"), ["f"], "side", "v").first().auc
    two = contrast.auc(spark.createDataFrame([(f, 1 - s, v) for f, s, v in rows], "f string, side int, v double"), ["f"], "side", "v").first().auc
    assert math.isclose(one, 3.5 / 6) and math.isclose(one + two, 1.0)


def test_log_odds_flips_sign(spark):
    rows = [(1, "a", 5), (0, "a", 1), (1, "b", 2), (0, "b", 9), (0, "c", 4)]
    schema = "side int, word string, n long"
    one = {r.word: r.z for r in contrast.log_odds(spark.createDataFrame(rows, schema), "side").collect()}
    two = {r.word: r.z for r in contrast.log_odds(spark.createDataFrame([(1 - s, w, n) for s, w, n in rows], schema), "side").collect()}
    assert all(math.isclose(one[w], -two[w], abs_tol=1e-9) for w in one)


def test_leave_one_out_handles_no_spread(spark):
    rates = spark.createDataFrame([("g", i, "w", r) for i, r in enumerate([1.0, 1.0, 1.0, 4.0])], "grp string, doc_id int, word string, rate double")
    got = {r.doc_id: (r.sd, r.z) for r in distance.leave_one_out(rates, "grp", "doc_id").collect()}
    assert got[3] == (0.0, None) and got[0][0] > 0


def test_partitions_do_not_matter(spark):
    frame = fixtures.frame(spark, "f_docs")
    one = shape.features(frame.repartition(1), ["doc_id"]).orderBy("doc_id").collect()
    many = shape.features(frame.repartition(7), ["doc_id"]).orderBy("doc_id").collect()
    assert one == many


def test_caveats_before_payoff(spark):
    got = discourse.caveat_order(docs(spark, "This is a caveat here. We show that it works. It has a limitation now.", "A preliminary view of it.", ""), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.caveats for r in got] == [1, 1, 0]


def test_sections_and_types(spark):
    rows = structure.sections(docs(spark, "pre\n## 1. Related work\nbody a\n### Results\nbody b", "none"), ["doc_id"]).collect()
    assert [(r.pos, r.title, r.body.strip()) for r in rows] == [(0, "1. Related work", "body a"), (1, "Results", "body b")]


def test_genre_registry(spark):
    structure.register_genre("poem", lambda: F.sum(F.when(F.col("text").contains("rhyme"), 1).otherwise(0)) > 0, lambda: {"hook_rate": F.col("type_hook")}, "essay")
    try:
        assert structure.resolve_genre(docs(spark, "a rhyme"), "grp").first().genre == "poem"
        assert structure.resolve_genre(docs(spark, "a"), "grp", forced="essay").first().genre == "essay"
    finally:
        del structure.GENRES["poem"]


def test_alpha_cases(spark):
    def alpha(*rows):
        return panel.interval_alpha(spark.createDataFrame(rows, "unit string, judge string, rating double")).collect()

    assert alpha(("u", "a", 1.0), ("u", "b", 1.0), ("v", "a", 5.0), ("v", "b", 5.0))[0].alpha == 1.0
    assert alpha(("u", "a", 3.0), ("u", "b", 3.0))[0].alpha is None
    assert alpha(("u", "a", 3.0), ("u", "b", None))[0].alpha is None


def test_judges_that_fail_give_null(spark):
    prompts = spark.createDataFrame([("p1",), ("p2",)], "prompt string")

    def broken(prompt):
        raise ValueError(prompt)

    got = panel.ask(prompts, {"ok": lambda p: f"PROB_AI: {len(p)}", "bad": broken})
    assert {(r.judge, r.s) for r in got.select("judge", panel.score(F.col("reply")).alias("s")).collect()} == {("ok", 2), ("bad", None)}


def test_chunks_for_judges():
    text = "\n\n".join(["x" * 9000] * 3)
    parts = panel.fit_or_chunk(text, 12000 + 4000)
    assert len(parts) == 3 and "".join(parts).count("x") == 27000
    assert panel.fit_or_chunk("short", 64000) == ["short"]


def test_prototype_margins_leave_self_out(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 0, [0.0, 1.0]), (4, 0, [0.1, 0.9])], "k int, side int, v array<float>")
    got = {r.k: r.margin for r in vectors.prototype_margins(rows, "k", "side", "v").collect()}
    assert got[1] > 0 > got[3]


def test_vector_leave_one_out_equals_the_long_form(spark):
    import random

    rng = random.Random(2)
    docs = [(g, i * 10 + j, " ".join(rng.choice(["the", "of", "and", "stone", "But", "which"]) for _ in range(rng.randint(1, 60)))) for j, g in enumerate(("a", "b", None)) for i in range(15)]
    docs += [("pair", 901, "the of the"), ("pair", 902, "of"), ("one", 903, "the"), ("equal", 904, "the cat"), ("equal", 905, "the dog"), ("equal", 906, "the of"), ("a", 907, None), ("a", 908, "")]
    frame = spark.createDataFrame(docs, "grp string, doc_id long, text string")
    counts = distance.function_word_counts(frame, ["grp", "doc_id"])
    assert counts.count() == len(docs) * len(distance.WORDS)
    words = {(r.doc_id, r.word): (r.n, r.w) for r in counts.where("n > 0").collect()}
    assert words[901, "the"] == (2, 3) and (908, "the") not in words
    rates = counts.selectExpr("grp", "doc_id", "word", "1000.0D * n / w as rate")
    long = {(r.doc_id, r.word): r.z for r in distance.leave_one_out(rates, "grp", "doc_id").collect()}
    wide = {(r.doc_id, w): z for r in distance._scored(frame, "grp", "doc_id").collect() for w, z in zip(distance.WORDS, r.z)}
    assert set(long) == set(wide) and 903 not in {d for d, _ in wide}
    assert all((long[k] is None and wide[k] is None) or abs(long[k] - wide[k]) < 1e-9 for k in long)
    # brute force: the others' mean and deviation
    by = {}
    for g, d, _ in docs:
        by.setdefault(g, []).append(d)
    for g, d, _ in docs:
        for w in ("the", "of", "which"):
            others = [1000.0 * words.get((o, w), (0, 1))[0] / words.get((o, w), (0, 1))[1] for o in by[g] if o != d]
            if others:
                mean = sum(others) / len(others)
                sd = (sum((x - mean) ** 2 for x in others) / len(others)) ** 0.5
                n, t = words.get((d, w), (0, 1))
                assert (wide[d, w] is None) == (sd <= 1e-9)
                assert sd <= 1e-9 or abs(wide[d, w] - (1000.0 * n / t - mean) / sd) < 1e-6


def test_context_parts_equal_the_fold_over_paragraphs(spark):
    import random

    rng = random.Random(11)
    budget = panel.context_budget(0)
    texts = [None, "", "short \n\n", "x" * budget, "x" * (budget + 1), "y" * (3 * budget) + "\n\nend", "\n\n" * budget]
    for _ in range(25):
        texts.append("\n\n".join("é " * rng.randint(0, 6000) if rng.random() < 0.9 else "z" * rng.randint(budget - 3, 3 * budget) for _ in range(rng.randint(1, 30))))
    texts += ["a" * (budget - 6) + "\n\n" + "b" * k for k in (1, 2, 3, 4, 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in panel.context_parts(rows, ["id"], budget).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, text in enumerate(texts):
        assert got.get(i, []) == panel.fit_or_chunk(text or "", 0), i
        assert all(len(p) <= budget for p in got.get(i, []))


def test_guarded_patterns_count_the_same(spark):
    assert T.quick(r"(?i)\b(?:may|could)\b") == r"(?i)(?=[\x63\x6d])(?:\b(?:may|could)\b)"
    assert T.quick(r"(?:a?|\bnot )b") == r"(?=[\x61\x62\x6e])(?:(?:a?|\bnot )b)"
    # any character, an empty match, Java's own classes
    for p in (r"[^,]+,", r"a*", r"[\p{L}\p{N}_]+", "—"):
        assert T.quick(p) == p
    text = "May we? In other words, it is what it is, the point is: lorem ipsum XXX, and [TODO]; KEEP it in view. " * 3
    row = spark.createDataFrame([(text,)], "t string")
    patterns = [p for _, ps in L.SHAPE.values() for p in ps] + [L.HEDGE, L.CONNECTIVE, L.WASTE, L.PREPOSITION]
    plain = row.select(*[F.regexp_count("t", F.lit(p)) for p in patterns]).first()
    assert tuple(plain) == tuple(row.select(*[T.count(F.col("t"), p) for p in patterns]).first())


def test_features_read_twice_are_computed_once(spark):
    features = shape.features(docs(spark, "One two three four. " * 9, "The case is that. " * 9), ["grp", "doc_id"])
    for rows in (bands.threshold_flags(features, "grp", ["doc_id"]), bands.alignment(features, "grp", ["doc_id"])):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_count" not in plan.lower() and rows.count() > 0


def test_trigrams_are_dealt_out_for_shared_keys_only(spark):
    one, two = "winter garden lantern winter garden lantern winter", "garden lantern winter silver"
    rows = [(1, one), (2, two), (3, one), (3, two), (None, two), (None, two), (4, None), (5, "winter garden")]
    found = lexical.trigram_repetition(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    by_id = {r.doc_id: (r.trigrams, r.repeated) for r in found.collect()}
    assert by_id == {1: (5, 4), 2: (2, 0), 3: (7, 5), None: (4, 4), 4: (0, 0), 5: (0, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_verdicts_compute_their_deltas_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("g", k, float(k % 7)) for k in range(39)] + [("g", 39, 900.0), ("h", 40, 1.0)], "grp string, doc_id long, x double")
    got = distance.verdicts(rows.select("grp", "doc_id", counted("x").alias("delta")), "grp", "doc_id").collect()
    assert seen.value == 41
    assert {r.doc_id for r in got if r.verdict == "OUTLIER"} == {39} and len(got) == 40
