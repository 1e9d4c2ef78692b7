"""Syntax measures over a token table.

Tokens: doc_id, sent_id, i, text, lemma, pos, dep, head_i; a root's head is
itself.  Any annotator that fills such rows can be plugged in with ``annotate``;
the one shipped is a transparent stand-in (suffix rules, the word before as
head), so numbers depend on the annotator used.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import text as T

TOKENS = "doc_id long, sent_id int, i int, text string, lemma string, pos string, dep string, head_i int"
NOT_WORDS = ["PUNCT", "SPACE"]
#: About so many tokens leave a worker at a time, however many documents it gets.
CHUNK = 1 << 16


CLOSED = {
    "DET": "the a an this that these those", "ADP": "of in on to for with by at from into over under", "PRON": "i you he she it we they who which",
    "AUX": "is are was were be been has have had do does did will would can could may might must", "CCONJ": "and or but nor", "PART": "not",
}
TAGS = {w: pos for pos, words in CLOSED.items() for w in words.split()}
MEMO_WORDS = 200_000


class _Tagged(dict):
    """A word's lower case and tag."""

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) > MEMO_WORDS:
            self.clear()
        low = word.lower()
        pos = TAGS.get(low) or (
            "PUNCT" if not word[0].isalnum() else "NUM" if word[0].isdigit() else "ADV" if low.endswith("ly") else "ADJ" if re.search(r"(?:ous|ful|ive|able|ible|al|ic)$", low)
            else "VERB" if re.search(r"(?:ed|ing|ize|ise)$", low) else "NOUN"
        )
        value = self[word] = low, pos
        return value


_tagged = _Tagged()


def simple_annotator(text: str) -> list[tuple]:
    """(sent_id, i, text, lemma, pos, dep, head_i) by suffix and closed lists."""
    rows, i = [], 0
    for sent, sentence in enumerate(re.split(r"(?<=[.!?])\s+", text)):
        first = i
        for word in re.findall(r"[^\W_]+(?:'[^\W_]+)?|[^\w\s]", sentence):
            low, pos = _tagged[word]
            rows.append((sent, i, word, low, pos, "root" if i == first else "dep", first if i == first else i - 1))
            i += 1
    return rows


def annotate(docs: DataFrame, key: str = "doc_id", annotator: Callable[[str], list[tuple]] = simple_annotator, most: int | None = 120_000) -> DataFrame:
    """The token table of documents, read up to ``most`` characters of prose, as
    the measure is defined, or whole if it is None."""
    prose = T.without_parentheses(T.prose(F.col("text")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (prose if most is None else F.substring(prose, 1, most)).alias("p"))

    return rows.mapInPandas(lambda batches: token_frames(batches, annotator), TOKENS)


def token_frames(batches: Iterator[pd.DataFrame], annotator: Callable[[str], list[tuple]]) -> Iterator[pd.DataFrame]:
    """Token rows of batches of doc_id and prose (p), ``CHUNK`` of them at a time."""
    names = ["doc_id", "sent_id", "i", "text", "lemma", "pos", "dep", "head_i"]
    for batch in batches:
        out: list[tuple] = []
        for d, p in zip(batch["doc_id"].tolist(), batch["p"]):
            out.extend((d, *row) for row in annotator(p))
            while len(out) >= CHUNK:
                yield pd.DataFrame(out[:CHUNK], columns=names)
                del out[:CHUNK]
        if out:
            yield pd.DataFrame(out, columns=names)


def _sentences(tokens: DataFrame, over: int = 3) -> DataFrame:
    return tokens.groupBy("doc_id", "sent_id").agg(F.count("*").alias("k")).where(F.col("k") > over).drop("k")


def bigrams(tokens: DataFrame) -> DataFrame:
    """Tag bigrams inside sentences of more than three tokens, punctuation out."""
    words = tokens.where(~F.col("pos").isin(NOT_WORDS)).join(_sentences(tokens), ["doc_id", "sent_id"])
    after = F.lead("pos").over(Window.partitionBy("doc_id", "sent_id").orderBy("i"))
    return words.select("doc_id", F.col("pos").alias("pos1"), after.alias("pos2")).where("pos2 is not null").groupBy("doc_id", "pos1", "pos2").agg(F.count("*").alias("n"))


def _depth(cap: int) -> Column:
    """Longest way to the root of a sentence: t has its tokens in order, heads
    their heads' places from its first token.  Ways double in length each round;
    one that leaves the sentence ends there, and a cycle counts as the cap."""
    steps = F.least(F.size("heads"), F.lit(cap))

    def moves(h, k):
        return h.isNotNull() & (h != k)

    begun = F.struct(F.transform("heads", lambda h, k: F.when(moves(h, k), h).otherwise(k)).alias("up"), F.transform("heads", lambda h, k: F.when(moves(h, k), 1).otherwise(0)).alias("d"))

    def double(state, _):
        up = F.transform(state["up"], lambda u: F.coalesce(F.get(state["up"], u), u))
        d = F.transform(state["d"], lambda x, k: x + F.coalesce(F.get(state["d"], F.get(state["up"], k)), F.lit(0)))
        return F.struct(up.alias("up"), d.alias("d"))

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(steps)), F.lit(1)).cast("int"))
    words = F.transform(F.filter("t", lambda z: z["pos"] != "SPACE"), lambda z: z["i"] - F.col("first"))
    return F.aggregate(rounds, begun, double, lambda state: F.array_max(F.transform(words, lambda at: F.least(F.coalesce(F.get(state["d"], at), F.lit(0)), steps))))


def parse_depths(tokens: DataFrame, cap: int = 100) -> DataFrame:
    """Longest way to the root of each sentence of more than three tokens, from
    the sentence's array of heads: one shuffle, whatever the depth."""
    rows = tokens.join(_sentences(tokens), ["doc_id", "sent_id"])
    trees = rows.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("i", "head_i", "pos"))).alias("t"), F.min("i").alias("first"))
    trees = trees.withColumn("heads", F.transform("t", lambda z: z["head_i"] - F.col("first")))
    return trees.select("doc_id", "sent_id", _depth(cap).alias("depth"))


def meta_sentences(tokens: DataFrame) -> DataFrame:
    """Sentences of more than three tokens, and whether they narrate the text's
    own moves: a status or move predicated with "be"; a first-person or
    discourse subject of a stance verb; a negated first-person claim."""
    root = tokens.where("head_i = i").select("doc_id", "sent_id", F.col("i").alias("root_i"), F.lower("lemma").alias("root"))
    kids = tokens.where("head_i <> i").join(root, ["doc_id", "sent_id"]).where("head_i = root_i")
    lemma, subject = F.lower("lemma"), F.col("dep").isin("nsubj", "nsubjpass", "csubj")
    predicate = F.col("dep").isin("acomp", "attr")
    marks = kids.groupBy("doc_id", "sent_id").agg(
        F.max((subject & F.lower("text").isin("we", "i")).cast("int")).alias("fp"), F.max((subject & lemma.isin(L.DISCOURSE_NOUNS)).cast("int")).alias("disc"),
        F.max((predicate & (lemma.isin(L.STATUS_ADJECTIVES) | lemma.isin(L.PREDICATE_NOUNS))).cast("int")).alias("pred"), F.max((F.col("dep") == "neg").cast("int")).alias("neg"),
    )
    rows = _sentences(tokens).join(root, ["doc_id", "sent_id"], "left").join(marks, ["doc_id", "sent_id"], "left").fillna(0, ["fp", "disc", "pred", "neg"])
    meta = ((F.col("root") == "be") & (F.col("pred") == 1)) | (((F.col("fp") == 1) | (F.col("disc") == 1)) & F.col("root").isin(L.STANCE_VERBS))
    meta = meta | ((F.col("fp") == 1) & F.col("root").isin(L.CLAIM_VERBS) & (F.col("neg") == 1))
    return rows.select("doc_id", "sent_id", F.coalesce(meta, F.lit(False)).alias("meta"))


def _trees(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id and a sentence's tokens in order (t), its words, roots and
    the tokens that hang on a root (kids)."""
    token = F.struct("i", "head_i", "pos", "dep", F.lower("lemma").alias("lemma"), F.lower("text").alias("text"))
    rows = tokens.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(token)).alias("t"), F.min("i").alias("first"))
    rows = rows.withColumns({
        "heads": F.transform("t", lambda z: z["head_i"] - F.col("first")), "words": F.filter("t", lambda z: ~z["pos"].isin(NOT_WORDS)), "roots": F.filter("t", lambda z: z["head_i"] == z["i"]),
    })
    return rows.withColumn("kids", F.filter("t", lambda z: (z["head_i"] != z["i"]) & F.array_contains(F.transform("roots", lambda r: r["i"]), z["head_i"])))


def _narrating() -> Column:
    """How many of a sentence's roots ``meta_sentences`` counts."""

    def some(test) -> Column:
        return F.coalesce(F.exists("kids", test), F.lit(False))

    def subject(z):
        return z["dep"].isin("nsubj", "nsubjpass", "csubj")

    marks = F.struct(
        some(lambda z: subject(z) & z["text"].isin("we", "i")).alias("fp"), some(lambda z: subject(z) & z["lemma"].isin(L.DISCOURSE_NOUNS)).alias("disc"), some(lambda z: z["dep"] == "neg").alias("neg"),
        some(lambda z: z["dep"].isin("acomp", "attr") & (z["lemma"].isin(L.STATUS_ADJECTIVES) | z["lemma"].isin(L.PREDICATE_NOUNS))).alias("pred"),
    )

    def narrates(r):
        said = ((r["lemma"] == "be") & marks["pred"]) | ((marks["fp"] | marks["disc"]) & r["lemma"].isin(L.STANCE_VERBS))
        return said | (marks["fp"] & r["lemma"].isin(L.CLAIM_VERBS) & marks["neg"])

    return F.size(F.filter("roots", narrates))


def rates(tokens: DataFrame) -> DataFrame:
    """The syntax measures of each document.

    Tokens are read and dealt out once: a sentence becomes a row of numbers, and
    nothing is joined."""

    def n(array: str, test) -> Column:
        return F.size(F.filter(array, test))

    def tagged(p: str):
        return lambda z: z["pos"] == p

    tags = ("NOUN", "ADJ", "PRON", "ADP")
    long = F.size("t") > 3
    per = _trees(tokens).select(
        "doc_id", F.size("words").alias("n"), F.aggregate("words", F.lit(0), lambda a, z: a + F.coalesce(F.abs(z["i"] - z["head_i"]), F.lit(0))).alias("away"),
        *[n("words", tagged(p)).alias(p) for p in tags], n("words", lambda z: (z["pos"] == "NOUN") & z["text"].rlike(L.NOUN_SUFFIX)).alias("nominal"),
        n("words", lambda z: z["dep"].isin(L.CLAUSE_DEPS)).alias("clauses"),
        # a head may stand in another sentence
        F.transform(F.filter("t", lambda z: z["text"] == "that"), lambda z: z["head_i"]).alias("that"),
        F.transform(F.filter("t", lambda z: z["dep"].isin("csubj", "ccomp", "acl")), lambda z: z["i"]).alias("marked"),
        F.when(long, F.greatest(F.size("roots"), F.lit(1))).otherwise(0).alias("ns"), F.when(long, _narrating()).otherwise(0).alias("meta"), F.when(long, _depth(100)).alias("depth"),
    )
    names = ("away", *tags, "nominal", "clauses", "ns", "meta")
    rows = per.groupBy("doc_id").agg(
        F.greatest(F.sum("n"), F.lit(1)).alias("total"), *[F.sum(c).alias(c) for c in names], F.coalesce(F.round(F.avg("depth"), 4), F.lit(0.0)).alias("parse_depth"),
        F.flatten(F.collect_list("that")).alias("that"), F.flatten(F.collect_list("marked")).alias("marked"),
    )
    rows = rows.withColumn("that_subj", F.size(F.filter("that", lambda h: F.array_contains("marked", h))))

    def share(c: str) -> Column:
        return F.round(F.lit(1000.0) * F.col(c) / F.col("total"), 4)

    ns = F.greatest("ns", F.lit(1))
    return rows.select(
        "doc_id", F.round(F.col("away") / F.col("total"), 4).alias("mean_dep_dist"), "parse_depth", *[share(p).alias(f"{p.lower()}_rate") for p in tags], share("nominal").alias("nominal_rate"),
        F.round(F.col("clauses") / ns, 4).alias("subcl_ratio"), share("that_subj").alias("that_subj_pm"), F.round(F.lit(100.0) * F.col("meta") / ns, 4).alias("metanarr_synt"),
    )


@lru_cache(MEMO_WORDS)
def _nominal(text: str) -> bool:
    return re.search(L.NOUN_SUFFIX, text.lower()) is not None


SUBJECTS = {"nsubj", "nsubjpass", "csubj"}


def _narrates(root: tuple, kids: list[tuple]) -> bool:
    """Whether ``meta_sentences`` counts a root beside its sentence's kids."""
    subjects = [k for k in kids if k[5] in SUBJECTS]
    first = any((k[2] or "").lower() in ("we", "i") for k in subjects)
    told = first or any((k[3] or "").lower() in L.DISCOURSE_NOUNS for k in subjects)
    said = any(k[5] in ("acomp", "attr") and ((k[3] or "").lower() in L.STATUS_ADJECTIVES or (k[3] or "").lower() in L.PREDICATE_NOUNS) for k in kids)
    lemma = (root[3] or "").lower()
    return (lemma == "be" and said) or (told and lemma in L.STANCE_VERBS) or (first and lemma in L.CLAIM_VERBS and any(k[5] == "neg" for k in kids))


def card_counts(tokens: list[tuple]) -> tuple[int, ...]:
    """A document's tokens, words, nouns, pronouns and nominalisations, the roots of
    its sentences of more than three tokens (one at least), and those that narrate."""
    tags = Counter(t[4] for t in tokens)
    nominal = sum(t[4] == "NOUN" and t[2] is not None and _nominal(t[2]) for t in tokens)
    sizes, roots = Counter(t[0] for t in tokens), Counter(t[0] for t in tokens if t[6] == t[1])
    long = [s for s, k in sizes.items() if k > 3]
    meta = 0
    if not SUBJECTS.union(("acomp", "attr")).isdisjoint(t[5] for t in tokens):
        kept, by = set(long), defaultdict(list)
        for t in tokens:
            if t[0] in kept:
                by[t[0]].append(t)
        for own in by.values():
            heads = [t for t in own if t[6] == t[1]]
            at = {t[1] for t in heads}
            kids = [t for t in own if t[6] != t[1] and t[6] in at]
            meta += sum(_narrates(r, kids) for r in heads)
    words = len(tokens) - sum(tags[p] for p in (*NOT_WORDS, None))
    return len(tokens), words, tags["NOUN"], tags["PRON"], nominal, sum(max(roots[s], 1) for s in long), meta


CARD = ["nominal_rate", "noun_rate", "pron_rate", "metanarr_synt"]


def card_rates(docs: DataFrame, keys: list[str], annotator: Callable[[str], list[tuple]] = simple_annotator, most: int | None = None) -> DataFrame:
    """keys and the ``CARD`` part of the ``rates`` of rows that share their id
    with no other; rows without tokens are left out.  Tokens are counted where they
    are made, and none is dealt out."""
    p = T.without_parentheses(T.prose(F.col("text")))
    names = ["tokens", "total", "nouns", "prons", "nominals", "ns", "meta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [card_counts(annotator(text.as_py())) if text.is_valid else (0,) * len(names) for text in batch.column(len(keys))]
            made = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *names])

    rows = docs.select(*keys, (p if most is None else F.substring(p, 1, most)).alias("_p"))
    types = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    counted = rows.mapInArrow(run, ", ".join([*types, *(f"{c} long" for c in names)])).where("tokens > 0")

    def share(c: str) -> Column:
        return F.round(F.lit(1000.0) * F.col(c) / F.greatest("total", F.lit(1)), 4)

    meta = F.round(F.lit(100.0) * F.col("meta") / F.greatest("ns", F.lit(1)), 4)
    return counted.select(*keys, share("nominals").alias("nominal_rate"), share("nouns").alias("noun_rate"), share("prons").alias("pron_rate"), meta.alias("metanarr_synt"))


def syntax_flags(features: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """HIGH over the group's 85th percentile, LOW under its 15th, rounding the
    rank down."""
    from .bands import order_statistics

    names = [c for c in features.columns if c not in (group, *keys)]
    long = features.unpivot([group, *keys], names, "feature", "value")
    band = order_statistics(long, [group, "feature"], "value", {"p15": (0.15, "floor"), "p85": (0.85, "floor")})
    flag = F.when(F.col("value") > F.col("p85"), "HIGH").when(F.col("value") < F.col("p15"), "LOW").otherwise("ok")
    return long.join(band, [group, "feature"]).select(group, *keys, "feature", "value", flag.alias("flag"))
