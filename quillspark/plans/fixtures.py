"""Small inline tables for measures the driver's tables can't exercise."""

from __future__ import annotations

LONG = " ".join(["The model of the system shows that measured results depend on the careful design of every part."] * 9)
OTHER = " ".join(["A short walk by the river brought them home before the rain had started to fall again."] * 9)

DOCS = [
    (1, "a", ""),
    (2, "a", "One sentence of plain words stands here alone."),
    (3, "a", "# Title of the Paper\n\nIt is not the cost but the time that matters. We delve into a robust, comprehensive, and nuanced view; indeed, it is simply crucial.\n\n- **Bold**: item\n\nSome **bold words** run here. Furthermore, this claim may fail, and we stop."),
    (4, "b", "What matters is speed — rather than size. The tension is real. In other words, as discussed above, the key insight turns out that dozens of experiments ran.\n\n<!-- hidden, and gone -->\n| a | b |\n\nTODO [cite] here, to win, it plays a crucial role."),
    (5, "b", "Text before (a remark, and more) goes on. Smith et al. show that. The question comes back, which is a problem, the obvious one, for all.\n\n## References\nThe rest, and all of it, is cut."),
    (6, "b", "We show that this works. The result is clear? Consider the case. However, it is not a claim; e.g. 3 of 40 failed. I think you will see it, for example in Figure 2. There is a limit, and there are caveats."),
]

HEADED = [
    (1, "v", "# Two Predictions and a Minimal Model\n\n## 1. Introduction\n\n" + LONG + "\n\n## 2 Related work\n\n" + OTHER + "\n\n## What Survives the Floor?\n\n" + LONG + "\n\n## Conclusion\n\n" + LONG + "\n"),
    (2, "v", "# A plain title\n\n## Background\n\n" + OTHER + "\n\n### The governance of the residual\n\nShort body.\n\n## Methods and results\n\n" + LONG + "\n\n## Discussion, with care\n\n" + OTHER + "\n"),
    (3, "w", "\\title{On the \\emph{Shape} of Things}\n\\section{Introduction}\n" + LONG + "\n\\subsection{Why it is not enough}\n" + OTHER + "\n\\caption{How the floor works}\n\\section*{Conclusions}\n" + OTHER + "\n"),
    (4, "w", "No headings at all. Just text that runs on for a while."),
    (5, "w", "# Toward an Honest Institution\n\n## TL;DR\n\n" + OTHER + "\n\n## Motivation: why now\n\n" + LONG + "\n\n## Alternatives considered\n\n" + OTHER + "\n\n## For example\n\n" + LONG + "\n\n## Abstract\n\nshort\n"),
]

CITED = [
    (1, "As Smith and Jones (2010) shows, and Müller (1999) proves more than Lee et al. 2005 did. Enron 2001 fell.", "@book{muller99, author={Muller}}"),
    (2, "See \\cite{lee05} and Lee (2005). \\cite{roe} clearly establishes it. O'Neil's (2016) view.", ""),
    (3, "Nothing here.", None),
    (4, "Dvořák (2010) and Erdős (1959) agree, Sørensen (1948) doesn't; Łukasiewicz (1920) and Œuvre (1999) stand alone.", "author = {Dvořák, A.}\nauthor = {Erdos, P.}\nauthor = {Sorensen, T.}"),
    (5, "Nguyễn (2001), Novák and Čapek (1999), Kovač (2003).", "x = {Nguyen}\ny = {NOVÁK}\nz = {Kova\nc}"),
]

RATINGS = [
    ("u1", "j1", 80.0), ("u1", "j2", 70.0), ("u1", "j3", None), ("u2", "j1", 20.0), ("u2", "j2", 30.0), ("u2", "j3", 25.0),
    ("u3", "j1", 50.0), ("u3", "j2", None), ("u3", "j3", 60.0), ("u4", "j1", 90.0), ("u4", "j2", None), ("u4", "j3", None), ("u5", "j1", None), ("u5", "j2", None), ("u5", "j3", None),
]

REPLIES = [
    ("d1", "j1", "v", "PROB_AI: 85\nUNCATALOGUED: Stacked colons — \"a: b: c\" — nearest is emdash\nUNCATALOGUED: none"),
    ("d2", "j2", "v", "- UNCATALOGUED: stacked colons - 'x: y' - odd\nI would say 40 of 100."),
    ("d3", "j1", "v", "```json\n{\"categories\": [{\"name\": \"a\", \"score\": 7}]}\n```"),
    ("d4", "j2", "v", "Here: [1, 2, 3] PROB_AI: 250"),
    ("d5", "j1", "v", "UNCATALOGUED: Elegant variation — known — skip\nUNCATALOGUED: **Lone tell**"),
    ("d6", "j3", "v", "no number"),
]

COUNTS = [
    ("draft", "signal", 900), ("draft", "model", 1200), ("draft", "river", 2), ("draft", "loop", 700), ("draft", "field", 500),
    ("human", "model", 4000), ("human", "river", 3000), ("human", "signal", 100), ("human", "field", 4500), ("human", "loop", 600),
    ("matched", "signal", 3000), ("matched", "model", 3000), ("matched", "field", 400), ("on_topic", "model", 3000), ("on_topic", "signal", 2500), ("on_topic", "loop", 10), ("on_topic", "field", 900),
]
ZIPF = [("signal", 4.5), ("model", 5.0)]

# doc, sentence, i, text, lemma, pos, dep, head
TOKENS = [
    (1, 0, 0, "We", "we", "PRON", "nsubj", 3), (1, 0, 1, "do", "do", "AUX", "aux", 3), (1, 0, 2, "not", "not", "PART", "neg", 3), (1, 0, 3, "claim", "claim", "VERB", "root", 3),
    (1, 0, 4, "that", "that", "SCONJ", "mark", 6), (1, 0, 5, "models", "model", "NOUN", "nsubj", 6), (1, 0, 6, "work", "work", "VERB", "ccomp", 3), (1, 0, 7, ".", ".", "PUNCT", "punct", 3),
    (1, 1, 8, "The", "the", "DET", "det", 9), (1, 1, 9, "point", "point", "NOUN", "nsubj", 10), (1, 1, 10, "is", "be", "AUX", "root", 10), (1, 1, 11, "modest", "modest", "ADJ", "acomp", 10), (1, 1, 12, ".", ".", "PUNCT", "punct", 10),
    (1, 2, 13, "So", "so", "ADV", "root", 13), (1, 2, 14, "be", "be", "AUX", "dep", 13), (1, 2, 15, ".", ".", "PUNCT", "punct", 13),
    (2, 0, 0, "This", "this", "DET", "det", 1), (2, 0, 1, "section", "section", "NOUN", "nsubj", 2), (2, 0, 2, "notes", "note", "VERB", "root", 2), (2, 0, 3, "the", "the", "DET", "det", 4), (2, 0, 4, "limitation", "limitation", "NOUN", "dobj", 2), (2, 0, 5, "of", "of", "ADP", "prep", 4), (2, 0, 6, "measurement", "measurement", "NOUN", "pobj", 5), (2, 0, 7, ".", ".", "PUNCT", "punct", 2),
    (3, 0, 0, "Dogs", "dog", "NOUN", "nsubj", 1), (3, 0, 1, "run", "run", "VERB", "root", 1), (3, 0, 2, "very", "very", "ADV", "advmod", 3), (3, 0, 3, "fast", "fast", "ADV", "advmod", 1), (3, 0, 4, "home", "home", "ADV", "advmod", 1),
    (4, 0, 0, "Cats", "cat", "NOUN", "nsubj", 1), (4, 0, 1, "sleep", "sleep", "VERB", "root", 1), (4, 0, 2, "in", "in", "ADP", "prep", 1), (4, 0, 3, "the", "the", "DET", "det", 4), (4, 0, 4, "sun", "sun", "NOUN", "pobj", 2),
]

# doc, group, surface features, syntax rates, heading features (none: no headings)
CARDS = [
    (1, "g", 12.5, 3.25, 0.5, 6.0, 1.5, 0.75, 0.0, 0.4, 0.55, 21.3, 30.1, 210.4, 25.7, 4.0, 0.2, 0.0, 4.5, 0.5),
    (2, "g", 10.0, 1.0, 1.5, 4.0, 2.5, 0.25, 0.5, 0.9, 0.35, 18.0, 41.7, 260.0, 15.0, 8.0, 0.9, 0.24, 3.0, 0.26),
    (3, "g", 14.0, 0.0, 0.0, 9.0, 3.0, 1.0, 0.25, 0.1, 0.61, 24.9, 22.2, 199.9, 31.3, 0.0, None, None, None, None),
    (4, "h", 7.5, 22.0, 0.25, 2.0, 0.4, 2.0, 1.0, 0.0, 0.3, 12.4, 11.0, 150.5, 90.1, 2.6, 0.75, 0.5, 6.0, 0.0),
    (5, "h", 9.0, 18.5, 0.75, 1.0, 4.5, 1.5, 0.0, 0.3, 0.2, 14.1, 13.5, 171.3, 75.6, 0.0, 0.69, 0.0, 5.0, 0.4),
    (6, "i", 9.0, 18.5, 0.75, 1.1, 4.5, 1.5, 0.0, 0.32, 0.5, 14.1, 13.5, 171.0, 75.6, 0.0, None, None, None, None),
]
GENRES = [
    (1, "readme", "# Tool\n\nBecause we like it, consider our tool.\n"), (2, "readme", "Run `git clone` first.\n"), (3, "readme", "# Notes\n\nPlain words of no kind.\n"),
    (4, "essay", "I think that you and I agree because we must. However, suppose my friend and our guest do not. Imagine that.\n"),
    (5, "essay", "# End\n\nTherefore we part, and you go your way.\n"),
    (6, "fenced", "I think that you and I agree because we must. However, suppose my friend and our guest do not. Imagine that.\n\n```\nx = 1\n```\n"),
    (7, "paper", "# Abstract\n\nA method is shown.\n\n## Related work\n\nOthers did so.\n"), (8, "paper", "# Abstract\n\nAnother method is shown \\cite{x}.\n"),
    (9, "design", "# Choice\n\nThe cache holds rows.\n\n## Tradeoffs\n\nIt costs memory.\n"), (10, "plain", "Words without a heading or a voice.\n"),
    (11, "few", "I say that my dog barks because our cat runs.\n"),
]

PROFILES = [
    ("g", 'Here it is: ```json\n{"venue_voice": "dry", "categories": [{"name": "stance", "does": "hedges", "does_not": "boast", "intensity": 70, "example": ""}, {"name": "rhythm", "does": "varies", "does_not": "drum", "intensity": null}, {"name": "stance", "does": "again", "intensity": 5}]}\n```'),
    ("h", '{"categories": [{"name": "diction", "does": "plain words", "does_not": "jargon", "intensity": 12.5}, {"name": "appeal"}]}'), ("i", "I would rather not."), ("j", None),
]
ALIGNED = [
    (1, "g", "a", '{"categories": [{"name": "stance", "alignment": 80}, {"name": "rhythm", "alignment": 40}], "summary": "close"}'),
    (1, "g", "b", 'Sure. {"categories": [{"name": "stance", "alignment": 71}, {"name": "rhythm", "alignment": 45}, {"name": "other", "alignment": 1}]}'),
    (1, "g", "c", '{"categories": [{"name": "stance", "alignment": 10}, {"name": "stance", "alignment": 75.5}, {"name": "rhythm", "alignment": null}]}'),
    (2, "g", "a", '{"categories": [{"name": "rhythm", "alignment": 20}]}'), (2, "g", "b", "no"), (3, "h", "a", '{"categories": [{"name": "diction", "alignment": 90}, {"name": "appeal", "alignment": 10}]}'),
    (3, "h", "b", '{"categories": [{"name": "diction", "alignment": 30}, {"name": "appeal", "alignment": 85}]}'), (4, "i", "a", '{"categories": [{"name": "stance", "alignment": 50}]}'), (5, "h", "a", None),
]

SCHEMAS = {
    "f_profiles": ("grp string, reply string", PROFILES), "f_aligned": ("doc_id int, grp string, judge string, reply string", ALIGNED),
    "f_cards": (
        "doc_id int, grp string, that_density double, first_person double, meta_narration double, hedge_modal double, vague_eval_adj double, intensifier double, not_but double, "
        "abstract_subj double, burstiness_CV double, mean_sent double, nominal_rate double, noun_rate double, pron_rate double, metanarr_synt double, title_case double, colon double, "
        "mean_words double, compound double", CARDS,
    ),
    "f_genres": ("doc_id int, grp string, text string", GENRES),
    "f_docs": ("doc_id int, grp string, text string", DOCS), "f_headed": ("doc_id int, grp string, text string", HEADED), "f_cites": ("doc_id int, text string, bib string", CITED),
    "f_ratings": ("unit string, judge string, rating double", RATINGS), "f_replies": ("doc string, judge string, venue string, reply string", REPLIES),
    "f_counts": ("role string, word string, n long", COUNTS), "f_zipf": ("word string, zipf double", ZIPF),
    "f_tokens": ("doc_id int, sent_id int, i int, text string, lemma string, pos string, dep string, head_i int", TOKENS),
}


def frame(spark, name: str):
    schema, rows = SCHEMAS[name]
    return spark.createDataFrame(rows, schema)


def sql(name: str) -> str:
    """The same rows as a named SQL subquery."""
    schema, rows = SCHEMAS[name]
    columns = [c.split()[0] for c in schema.split(", ")]

    def literal(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"
