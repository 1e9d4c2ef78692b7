import random

import pandas as pd

from quillspark.functions import lexicons as L
from quillspark.operators import syntax


def test_tokens_leave_a_worker_in_bounded_pieces():
    batch = pd.DataFrame({"doc_id": range(400), "p": ["one two three. " * 150] * 400})
    frames = list(syntax.token_frames(iter([batch]), syntax.simple_annotator))
    assert max(map(len, frames)) <= syntax.CHUNK < sum(map(len, frames))
    whole = [(d, *row) for d, p in zip(batch["doc_id"], batch["p"]) for row in syntax.simple_annotator(p)]
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == whole


def test_rates_deal_tokens_out_once_and_join_nothing(spark):
    docs = spark.createDataFrame([(1, "We argue that it is so. The nation is not big."), (2, "")], "doc_id long, text string")
    rates = syntax.rates(syntax.annotate(docs))
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1
    assert [r.doc_id for r in rates.collect()] == [1]


def test_rates_find_heads_in_other_sentences_and_count_every_root(spark):
    rows = [
        (1, 0, 0, "Claims", "claim", "NOUN", "ccomp", 0), (1, 0, 1, "is", "be", "AUX", "attr", 1), (1, 0, 2, "new", L.STATUS_ADJECTIVES[0], "ADJ", "acomp", 1), (1, 0, 3, "now", "now", "ADV", "dep", 1),
        (1, 1, 4, "that", "that", "PRON", "dep", 0),
    ]
    got = syntax.rates(spark.createDataFrame(rows, syntax.TOKENS)).first()
    assert (got.that_subj_pm, got.metanarr_synt, got.parse_depth, got.subcl_ratio) == (200.0, 50.0, 1.0, 0.5)


def test_card_rates_are_those_of_the_token_table(spark):
    """The card's rates, counted where tokens are made, for any annotator."""
    rng = random.Random(2)
    lemmas = ["be", "concede", "claim", "modest", "contribution", "section", "Reflection", "we", "it", "note"]

    def wild(text):
        out, i = [], 0
        for sent in range(len(text) % 7 + 1):
            first, own = i, random.Random(f"{text}{sent}")
            for _ in range(own.randint(1, 8)):
                word = own.choice([*lemmas, "We", "I", "nation", "kindness", None, "."])
                pos = own.choice(["NOUN", "PRON", "VERB", "PUNCT", "SPACE", None])
                dep = own.choice(["nsubj", "csubj", "acomp", "attr", "neg", "root", "dep", None])
                out.append((sent, i, word, own.choice([*lemmas, None]), pos, dep, own.choice([i, first, first, first, i - 1, None])))
                i += 1
        return out

    texts = ["x" * rng.randint(1, 300) for _ in range(60)] + ["We note the kindness of nations. It is (so) done, I claim.", "!?", "", None, "(all aside)"]
    docs = spark.createDataFrame([(k, "g", t) for k, t in enumerate(texts)], "doc_id long, grp string, text string")
    for annotator in (wild, syntax.simple_annotator):
        names = ["doc_id", *syntax.CARD]
        found = sorted(tuple(r) for r in syntax.card_rates(docs, ["doc_id"], annotator).select(names).collect())
        assert found == sorted(tuple(r) for r in syntax.rates(syntax.annotate(docs, annotator=annotator, most=None)).select(names).collect())
    assert len(found) >= 61
