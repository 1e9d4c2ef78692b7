import statistics

from pyspark.sql import functions as F

from quillspark.operators import structure, syntax
from quillspark.plans import fixtures, reports


def test_sections_run(spark):
    docs = fixtures.frame(spark, "f_headed")
    for report in (reports.mirror(docs), reports.check(docs), reports.density(docs), reports.describe(docs)):
        for frame in report.values():
            frame.collect()
    found = reports.conventions(docs)
    assert found["rates"]["essay"].count() == 2
    assert {r.doc_id for r in found["conclusions"].collect()} == {1, 3}
    assert reports.taste(docs, docs).where("measure = 'embedded_self_score' and verdict = 'FAIL'").count() == 0


def test_topics(spark):
    rows = spark.createDataFrame([(1, "# Abstract\n## The Topic\nx"), (2, "just some words")], "doc_id int, text string")
    assert {r.doc_id: r.topic for r in reports.topics(rows).collect()} == {1: "The Topic", 2: "just some words"}


def test_baseline_resumes(spark):
    prompts = spark.createDataFrame([("a", "p"), ("b", "p")], "file string, prompt string")
    done = spark.createDataFrame([("a",)], "file string")
    assert [(r.file, r.score) for r in reports.baseline(prompts, {"j": lambda p: "PROB_AI: 7"}, done).collect()] == [("b", 7)]


def test_style_profile_and_fit(spark):
    docs = fixtures.frame(spark, "f_docs")
    long = docs.withColumn("text", F.concat_ws(" ", "text", F.lit("The old harbour wall keeps the worst of the weather from the boats that lie inside it. " * 2)))

    def profile(prompt):
        assert "mean_sent" in prompt and "harbour" in prompt
        return '{"categories": [{"name": "stance", "does": "hedges", "does_not": "boasts", "intensity": 60}]}'

    found = reports.style_profile(long, profile)
    assert {(r.name, r.does, r.intensity) for r in found.collect()} == {("stance", "hedges", 60.0)}

    def high(prompt):
        assert "does hedges" in prompt
        return '{"categories": [{"name": "stance", "alignment": 90}]}'

    fit = reports.style_fit(long, found, {"a": high, "b": lambda p: '{"categories": [{"name": "stance", "alignment": 70}]}', "c": lambda p: 1 / 0})
    rows = fit["categories"].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert {(r.n, r.mid, r.spread) for r in rows} == {(2, 80.0, 20.0)}
    assert reports.style_profile(long, lambda p: "no").count() == 0


def test_infer_ranks_syntax_beside_the_surface(spark):
    plain, nominal = "The dog ran home and it was glad. ", "The careful consideration of institutional organisation demands attention. "
    rows = [(i, i % 2, (nominal if i % 2 else plain) * (5 + i)) for i in range(8)] + [(8, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id int, side int, text string")
    found = reports.infer(docs)
    features = {r.feature: r for r in found["features"].collect()}
    values = reports.side_features(docs).toPandas()
    names = [c for c in values.columns if c not in ("doc_id", "side")]
    assert set(features) == set(names) and sum(n.startswith("synt_") for n in names) == 10
    for n in names:
        one, zero = values[values.side == 1][n], values[values.side == 0][n]
        auc = sum((x > y) + 0.5 * (x == y) for x in one for y in zero) / (len(one) * len(zero))
        assert abs(features[n].auc - auc) < 1e-6 and abs(features[n].mid1 - one.median()) < 1e-4, n
    # nouns by the stand-in's rules: 4 words of 8 in both sentences; adjectives: none and 2
    assert features["synt_noun_rate"].mid0 == features["synt_noun_rate"].mid1 == 500.0
    assert features["synt_adj_rate"].auc == 1.0 and features["synt_adj_rate"].mark == "strong"
    assert found["composite"].collect()[0].auc > 0.9


def test_verdict_has_both_channels_of_conformance(spark):
    # without spread among the others a bigram has no z, so their sentences vary in number
    plain, other = "The dog ran home and it was glad of it. ", "They saw that the old cat slept in the barn. "
    docs = spark.createDataFrame([(i, "g", plain * (4 + i % 3) + other * (3 + i % 4)) for i in range(9)] + [(9, "g", "Institutional careful organisational total formal. " * 6)], "doc_id int, grp string, text string")
    style = spark.createDataFrame([(i, i % 2, [float(i % 2), 1.0, i / 10]) for i in range(10)], "doc_id int, side int, embedding array<double>")
    rows = {r.doc_id: r for r in reports.verdict(docs, style).collect()}
    assert set(rows) == set(range(10))
    brute = bigram_deltas(syntax.bigrams(syntax.annotate(docs)).collect())
    assert all(abs(rows[i].tag_delta - brute[i]) < 1e-9 for i in rows)
    assert rows[9].tags == "OFF-VENUE" and rows[1].tags == "CONFORMS" and max(rows, key=lambda i: rows[i].tag_delta) == 9


def bigram_deltas(rows):
    """Mean |z| of each document's bigram shares from those of all others."""
    counts = {}
    for r in rows:
        counts.setdefault(r.doc_id, {})[r.pos1, r.pos2] = r.n
    shares = {d: {b: n / sum(c.values()) for b, n in c.items()} for d, c in counts.items()}
    terms, out = {b for c in counts.values() for b in c}, {}
    for d in shares:
        zs = []
        for b in terms:
            rest = [shares[e].get(b, 0.0) for e in shares if e != d]
            if statistics.pstdev(rest) > 1e-9:
                zs.append(abs(shares[d].get(b, 0.0) - statistics.mean(rest)) / statistics.pstdev(rest))
        out[d] = statistics.mean(zs) if zs else 0.0
    return out


def test_genre_lines(spark):
    text = "## Introduction\nWords.\n## Related Work\nOthers.\n## Method\nHow.\n## Conclusion\nSo."
    late = "## Introduction\nWords.\n## Method\nHow.\n## Results\nWhat.\n## Discussion\nWhy.\n## Related Work\nOthers."
    docs = spark.createDataFrame([(1, "g", text), (2, "g", text), (3, "g", late), (4, "g", "no sections"), (5, "g", None), (6, "h", "## Notes\nx")], "doc_id int, grp string, text string")
    lines = {(r.doc_id, r.measure): r for r in structure.genre_lines(docs, "grp", "doc_id", "academic").collect()}
    assert lines[1, "flow"].draft.startswith("intro") and lines[1, "flow"].draft.endswith("conclusion") and lines[4, "flow"].draft == ""
    assert (lines[1, "related_position"].note, lines[3, "related_position"].note) == ("in band", "earlier") and (4, "related_position") not in lines
    assert (lines[1, "conclusion"].draft, lines[3, "conclusion"].draft, lines[5, "conclusion"].draft) == ("yes", "no", "no")
    assert lines[1, "conclusion"].corpus == 0.4 and lines[6, "conclusion"].corpus == 0.0
    essay = structure.genre_lines(docs, "grp", "doc_id", "essay")
    assert {r.measure for r in essay.collect()} == {"flow", "hook", "example", "objection"}
    assert structure.genre_lines(docs.limit(0), "grp", "doc_id", "design-doc").count() == 0


def test_matched_references_tell_slop_from_repetition(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# Topic {i}\n" + "The river carried the boats along the harbour wall. " * 40) for i in range(6)], "doc_id int, text string")
    draft = spark.createDataFrame([(1, "# Drafts\n" + "We delve into gardens near the harbour. " * 30 + "The gardens carried boats. " * 20)], "doc_id int, text string")
    models = {"m": lambda p: "People delve into boats near the harbour wall. " * 30, "n": lambda p: "People delve into boats. " * 10}
    path = str(tmp_path / "kept")
    found = {r.word: r.channel for r in reports.matched_excess(draft, docs, models, path).collect()}
    assert found["delve"] == "generic_slop"
    assert "over_repetition" in {c for w, c in found.items() if w.startswith("garden")}
    # every text is there: nothing is asked again
    again = {r.word: r.channel for r in reports.matched_excess(draft, docs, {"m": None, "n": None}, path).collect()}
    assert again == found


def test_register_with_a_group_s_own_categories(spark, tmp_path):
    docs = fixtures.frame(spark, "f_docs")
    long = docs.withColumn("text", F.concat_ws(" ", "text", F.lit("The old harbour wall keeps the worst of the weather from the boats that lie inside it. " * 2)))
    path = str(tmp_path / "profile")
    judges = {"a": lambda p: '{"categories": [{"name": "stance", "alignment": 90}]}', "b": lambda p: '{"categories": [{"name": "stance", "alignment": 70}]}'}
    found = reports.register_fit(long, lambda p: '{"categories": [{"name": "stance", "does": "hedges", "does_not": "boasts", "intensity": 60}]}', judges, path)
    assert {(r.mid, r.spread) for r in found["categories"].collect()} == {(80.0, 20.0)}
    assert set(found) >= {"tells", "profile", "categories"}
    # the profile is kept: a judge that fails now isn't asked
    assert reports.register_fit(long, lambda p: 1 / 0, judges, path)["profile"].collect() == found["profile"].collect()
