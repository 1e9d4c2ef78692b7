"""Whole reports as sets of DataFrames, one lazy plan per section.

``docs`` has doc_id, a group column and text; reports over two sides have a
``side`` column of 0 (human) and 1 (generated).  Nothing runs until a section is
read, and each section is computed for all documents of all groups at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import discourse, lexical, shape
from ..functions import text as T
from ..operators import bands, contrast, distance, panel, structure, syntax, vectors
from ..sources import corpus, replies
from ..sources.staged import staged

KEY = "doc_id"


def mirror(docs: DataFrame, group: str = "grp", annotator=syntax.simple_annotator) -> dict[str, DataFrame]:
    """Every document against the other documents of its group: two distances
    with verdicts, syntax and surface flags, over-used words, headings."""
    places = docs.select(KEY, group)
    tokens = syntax.annotate(docs, KEY, annotator)
    words = distance.function_word_delta(docs, group, KEY)
    tags = distance.bigram_delta(syntax.bigrams(tokens).join(places, KEY), group, KEY)
    return {
        "words": distance.verdicts(words, group, KEY),
        "tags": distance.verdicts(tags.drop("bigrams"), group, KEY),
        "syntax": syntax.syntax_flags(syntax.rates(tokens).join(places, KEY), group, [KEY]),
        "surface": bands.threshold_flags(shape.features(docs, [group, KEY]), group, [KEY]),
        "overused": distance.overused(docs, group, KEY),
        "headings": structure.heading_flags(structure.heading_features(docs, [group, KEY]), group, [KEY]),
    }


def check(docs: DataFrame, group: str = "grp") -> dict[str, DataFrame]:
    """Flags per feature, and documents that are clean (at most two flags)."""
    flags = bands.threshold_flags(shape.features(docs, [group, KEY]), group, [KEY])
    totals = flags.groupBy(group, KEY).agg(F.sum(F.when(F.col("flag") != "ok", 1).otherwise(0)).alias("flags"))
    return {"features": flags, "documents": totals.withColumn("clean", F.col("flags") <= 2)}


def side_features(docs: DataFrame, annotator=syntax.simple_annotator) -> DataFrame:
    """doc_id, side, the surface features and, named synt_, those of the syntax;
    staged, as patterns and annotator run once for all that reads them.  Documents
    without a token have rates of zero."""
    rates = syntax.rates(syntax.annotate(docs, KEY, annotator, most=None))
    names = [c for c in rates.columns if c != KEY]
    rates = rates.select(KEY, *[F.col(c).cast("double").alias(contrast.SYNTAX + c) for c in names])
    return staged(shape.features(docs, [KEY, "side"]).join(rates, KEY, "left").fillna(0.0, [contrast.SYNTAX + c for c in names]), "side_features")


def infer(docs: DataFrame, annotator=syntax.simple_annotator) -> dict[str, DataFrame]:
    """What tells side 1 from side 0: features of surface and syntax, categories,
    words, composite.  doc_id tells documents apart."""
    features = side_features(docs, annotator)
    names = [c for c in features.columns if c not in (KEY, "side")]
    ranking = contrast.feature_ranking(features, "side", KEY, names)
    return {"features": ranking, "categories": contrast.category_support(ranking), "words": contrast.excess_words(docs, "side"), "composite": contrast.loo_composite(features, "side", KEY, names)}


def describe(docs: DataFrame, group: str = "grp") -> dict[str, DataFrame]:
    """A group's diction, the texture it keeps near zero, and sample sentences."""
    return {"diction": contrast.diction(docs, group), "near_zero": contrast.near_zero(shape.features(docs, [group, KEY]), group), "samples": contrast.sentence_samples(docs, group, KEY)}


def register(docs: DataFrame, group: str = "grp") -> DataFrame:
    """Glossed features that set a document apart from its group."""
    return bands.alignment(shape.features(docs, [group, KEY]), group, [KEY]).where("tells")


def register_fit(docs: DataFrame, judge, judges: dict, path: str, group: str = "grp", refresh: bool = False) -> dict[str, DataFrame]:
    """What sets documents apart from their group, by fixed features and by the
    group's own categories: ``judge`` names those once (kept at ``path``, read from
    there until refreshed), ``judges`` say how each document fits them."""
    profile = corpus.cached(style_profile(docs, judge, group), path, refresh)
    return {"tells": register(docs, group), "profile": profile, **style_fit(docs, profile, judges, group)}


#: What a judge is asked for a group's own categories, and for a draft's fit.
ASK_PROFILE = """Name the six to nine categories of tone and style that set this group of texts apart, judging only by its sentences and
medians below.  Answer with JSON alone: {"venue_voice": "...", "categories": [{"name": "...", "does": "...", "does_not": "...",
"intensity": 0 to 100 or null, "example": "..."}]}."""
ASK_FIT = """Say for each category below how well the draft fits it.  Answer with JSON alone: {"categories": [{"name": "...",
"alignment": 0 to 100 or null, "verdict": "...", "evidence": "..."}], "summary": "..."}."""
PROFILE_MEDIANS = ["mean_sent", "burstiness_CV", "first_person", "hedge_modal", "meta_narration", "vague_eval_adj", "ai_vocab", "emdash", "semicolon"]


def style_profile(docs: DataFrame, judge, group: str = "grp") -> DataFrame:
    """The categories that a judge (prompt to reply) finds for each group from
    sample sentences and medians; a judge that fails gives a group none."""
    mid = shape.features(docs, [group, KEY]).groupBy(group).agg(*[F.round(F.median(f), 2).alias(f) for f in PROFILE_MEDIANS])
    samples = contrast.sentence_samples(docs, group, KEY).groupBy(group).agg(F.concat_ws("\n- ", F.array_sort(F.collect_list("sentence"))).alias("samples"))
    medians = F.concat_ws(", ", *[F.concat(F.lit(f + " "), F.col(f).cast("string")) for f in PROFILE_MEDIANS])
    prompt = F.concat_ws("\n\n", F.lit(ASK_PROFILE), medians, F.concat(F.lit("- "), F.col("samples")))
    return panel.profile_categories(panel.ask(mid.join(samples, group).select(group, prompt.alias("prompt")), {"profile": judge}), group)


def style_fit(docs: DataFrame, categories: DataFrame, judges: dict, group: str = "grp", most: int = 22_000) -> dict[str, DataFrame]:
    """How documents fit their group's categories, by a panel of judges; a judge
    reads the first ``most`` characters of a document's prose, as the measure
    defines."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": does "), F.coalesce("does", F.lit("")), F.lit("; does not "), F.coalesce("does_not", F.lit("")))
    # a handful of categories a group
    lines = categories.groupBy(group).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])).alias("lines"))
    prompt = F.concat_ws("\n\n", F.lit(ASK_FIT), "lines", F.substring(T.prose(F.col("text")), 1, most))
    prompts = docs.join(lines, group).select(group, KEY, prompt.alias("prompt"))
    return panel.profile_alignment(categories, panel.ask(prompts, judges), group, KEY)


def density(docs: DataFrame) -> dict[str, DataFrame]:
    """Readability, densities, repetition, and a document's heavy sections."""
    return {
        "readability": lexical.readability(docs, [KEY]), "densities": lexical.densities(docs, [KEY]), "repetition": lexical.trigram_repetition(docs, [KEY]),
        "densest": structure.densest_sections(docs, KEY), "redundant": structure.section_redundancy(docs, KEY),
    }


def conventions(docs: DataFrame, group: str = "grp", genre: str | None = None) -> dict[str, DataFrame]:
    """Structure of groups and how documents depart from it.  A conclusion
    restates when its cosine is 0.08 over the group's median."""
    restated = structure.conclusion_restatement(docs, KEY).join(docs.select(KEY, group), KEY)
    mid = restated.groupBy(group).agg(F.median("cosine").alias("mid"))
    return {
        "profile": structure.structure_profile(docs, group, KEY), "genre": structure.resolve_genre(docs, group, genre), "order": structure.section_order(docs, [KEY]),
        "conclusions": restated.join(mid, group).withColumn("restates", F.col("cosine") > F.col("mid") + 0.08),
        "headings": structure.heading_flags(structure.heading_features(docs, [group, KEY]), group, [KEY], "conventions"),
        "rates": {name: structure.genre_rates(docs, group, KEY, name) for name in structure.GENRES},
        "lines": {name: structure.genre_lines(docs, group, KEY, name) for name in structure.GENRES},
    }


def taste(docs: DataFrame, exemplars: DataFrame, group: str = "grp") -> DataFrame:
    """Discourse measures against the exemplars' band; any self-score fails."""
    band = discourse.exemplar_band(discourse.measures(exemplars, [group, KEY]), group)
    rows = discourse.against_band(discourse.measures(docs, [group, KEY]), [group, KEY], band, group)
    scored = discourse.counts(docs, [group, KEY]).select(group, KEY, F.lit("embedded_self_score").alias("measure"), F.col("self_scores").cast("double").alias("value"))
    return rows.unionByName(scored.withColumn("verdict", F.when(F.col("value") > 0, "FAIL").otherwise("PASS")))


def excess(counts: DataFrame, zipf: DataFrame | None = None) -> DataFrame:
    """Over-used words of a draft against matched references, by channel."""
    return contrast.overuse_channels(counts, zipf)


ASK_REFERENCE = "Write some 450 words of connected prose as they might stand in a journal article, without title, headings or lists.  Topic: "


def topic_prompts(docs: DataFrame, variations: int = 0) -> DataFrame:
    """A prompt for a text on each document's topic, or so many variations."""
    prompt = F.concat(F.lit(ASK_REFERENCE), "topic")
    if not variations:
        return topics(docs).select(prompt.alias("prompt"))
    each = F.explode(F.sequence(F.lit(1), F.lit(variations)))
    return topics(docs).select("topic", each.alias("k")).select(F.concat(prompt, F.lit(" (variation "), F.col("k").cast("string"), F.lit(")")).alias("prompt"))


def role_counts(texts: DataFrame) -> DataFrame:
    """role, word and n of content stems.  texts: role, text."""
    return contrast.term_counts(texts, "role", lexical.stems(T.prose(F.col("text")))).where("word is not null")


def matched_excess(drafts: DataFrame, docs: DataFrame, models: dict, path: str, matched_by: str | None = None, zipf: DataFrame | None = None) -> DataFrame:
    """Over-used words of drafts (read as one) against the documents and against
    generated references: two texts of every model on each draft's topic, and one of
    the model ``matched_by`` (else the first) on each document's.  Texts are kept at
    ``path`` and asked for once; those a model failed to give are left out."""
    one = matched_by or next(iter(models))
    on_topic = replies.requests(topic_prompts(drafts, 2), list(models))
    matched = replies.requests(topic_prompts(docs), [one])
    kept = replies.fulfil(on_topic.unionByName(matched), models, path)
    sides = [drafts.select(F.lit("draft").alias("role"), "text"), docs.select(F.lit("human").alias("role"), "text")]
    for role, wanted in (("on_topic", on_topic), ("matched", matched)):
        sides.append(kept.join(wanted.select("key"), "key", "left_semi").select(F.lit(role).alias("role"), F.col("reply").alias("text")))
    return excess(role_counts(reduce(DataFrame.unionByName, sides)), zipf)


def cites(docs: DataFrame) -> dict[str, DataFrame]:
    return {"missing": structure.missing_citations(docs, [KEY]), "overclaims": structure.overclaims(docs, [KEY])}


def style(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Prototype margins and sides of style vectors; rows: doc_id, side, vector."""
    return vectors.margin_verdicts(vectors.prototype_margins(rows, KEY, "side", vector), "side", KEY)


def verdict(docs: DataFrame, style_rows: DataFrame, group: str = "grp", vector: str = "embedding", annotator=syntax.simple_annotator) -> DataFrame:
    """Two separate questions per document: which side its style is nearer to, and
    whether its function words and its tag bigrams conform to its group."""
    conforms = F.when(F.col("verdict") == "MIRRORS", "CONFORMS").otherwise("OFF-VENUE")
    words = distance.verdicts(distance.function_word_delta(docs, group, KEY), group, KEY).select(KEY, "delta", conforms.alias("words"))
    pairs = syntax.bigrams(syntax.annotate(docs, KEY, annotator)).join(docs.select(KEY, group), KEY)
    tags = distance.verdicts(distance.bigram_delta(pairs, group, KEY).drop("bigrams"), group, KEY).select(KEY, F.col("delta").alias("tag_delta"), conforms.alias("tags"))
    return style(style_rows, vector).select(KEY, "margin", "side_1").join(words, KEY).join(tags, KEY, "left")


def topics(docs: DataFrame) -> DataFrame:
    """A document's topic: its first heading that isn't "abstract", else its
    first 25 words of prose; at most 200 characters."""
    marked = F.filter(T.lines(T.clean(F.col("text"))), lambda x: F.ltrim(x).startswith("#"))
    names = F.filter(F.transform(marked, lambda x: F.trim(F.regexp_replace(F.ltrim(x), "^#+", ""))), lambda h: (h != "") & (F.lower(h) != "abstract"))
    words = F.array_join(F.slice(F.split(F.trim(T.prose(F.col("text"))), r"\s+"), 1, 25), " ")
    return docs.select(KEY, F.substring(F.coalesce(F.get(names, F.lit(0)), words), 1, 200).alias("topic"))


def baseline(prompts: DataFrame, judges: dict, done: DataFrame | None = None) -> DataFrame:
    """One 0..100 rating per file and judge; files in ``done`` are left out."""
    left = panel.pending(prompts, done) if done is not None else prompts
    return panel.ask(left, judges).select("file", "judge", panel.score(F.col("reply")).alias("score"))
