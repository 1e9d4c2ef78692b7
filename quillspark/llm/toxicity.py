"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat verb, modal, target, negation, reported
speech, other).  Five small transducers read a clause's classes and add weights:
insults, insults aimed at a target, threats, negation and reported speech, the
last two lowering what follows them.  They are composed once into one
deterministic machine, so a clause is scored as a whole in a single run; a word
on its own decides nothing until its clause is read.

Insult stems and their weights are learned from labelled rows: prefixes and
whole words that toxic texts use in many different contexts and clean texts do
not.  A logistic layer over clause scores is fitted on the same rows.  At most
``FIT_ROWS`` labelled rows of each label are used, chosen by a hash of the
document id; everything else reads whole texts of all rows.

Null and empty texts get the score of a text without any matched clause.
Repeated rows each give a row; without labelled rows a small built-in lexicon
serves; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stage, unstage

#: Labelled rows of each label that fitting reads at most.
FIT_ROWS = 2000
#: Lengths of the word prefixes that may become stems.
STEM_LENGTHS = range(3, 9)
#: A stem needs this many different contexts in toxic texts ...
LEAST_CONTEXTS = 5
#: ... and a rate in toxic texts so many times that in clean ones.
LEAST_RATIO = 40.0

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT = range(7)
CLASSES = 7

# Words of the closed classes in four languages.
WORDS = {
    THREAT: "kill hurt beat destroy punch stab shoot burn crush smash töten verletzen schlagen umbringen tuer frapper blesser détruire matar golpear herir destruir",
    MODAL: "will gonna going shall must should werde wird soll vais va doit voy debe",
    TARGET: "you your u ya him her them he she they he's you're du dich dir ihr sie er tu toi te vous vos lui tú te ti usted ustedes él",
    NEGATION: "not never no isn't aren't wasn't don't without nicht kein keine nie pas jamais sans nunca sin",
    REPORT: "said says called calls quoted wrote claimed reported alleged sagte nannte schrieb appelé écrit llamó escribió",
    INSULT: "idiot idiots moron stupid scum loser losers trash worthless pathetic disgusting clown imbecile dumbass scumbag idiota estúpido imbécil dummkopf trottel connard",
}
BUILT_IN_WEIGHT = 1.0

CLAUSE_END = re.compile(r"[.!?;:\n\r]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Transducer:
    """A deterministic weighted machine over classes.

    An arc's output is a pair: what the read word's own weight is multiplied by,
    and what is added to the clause.  A class without an arc keeps the state and
    leaves the weight as it is.
    """

    def __init__(self):
        self.arcs: dict[tuple[int, int], tuple[int, float, float]] = {}
        self.states = 1

    def arc(self, state: int, symbol: int, target: int, times: float = 1.0, plus: float = 0.0) -> Transducer:
        self.arcs[state, symbol] = (target, times, plus)
        self.states = max(self.states, state + 1, target + 1)
        return self

    def step(self, state: int, symbol: int) -> tuple[int, float, float]:
        return self.arcs.get((state, symbol), (state, 1.0, 0.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines over the same classes: factors multiply, additions add."""
    out, names, waiting = Transducer(), {(0, 0): 0}, [(0, 0)]
    while waiting:
        pair = waiting.pop()
        for symbol in range(CLASSES):
            (s, f, p), (t, g, q) = a.step(pair[0], symbol), b.step(pair[1], symbol)
            if (s, t) not in names:
                names[s, t] = len(names)
                waiting.append((s, t))
            out.arc(names[pair], symbol, names[s, t], f * g, p + q)
    return out


def near(opening: int, words: int) -> Iterator[tuple[int, int, int]]:
    """Arcs of a machine that remembers ``opening`` for some words."""
    for state in range(words + 1):
        for symbol in range(CLASSES):
            yield state, symbol, words if symbol == opening else max(state - 1, 0)


def grammar() -> Transducer:
    insult = Transducer()  # a second insult in the clause counts half again
    insult.arc(0, INSULT, 1).arc(1, INSULT, 1, times=0.5)
    target = Transducer()  # an insult within four words after a target
    for s, c, t in near(TARGET, 4):
        target.arc(s, c, t, plus=0.5 if c == INSULT and s else 0.0)
    threat = Transducer()  # modal, threat verb within 3 words, target within 3
    for symbol in range(CLASSES):
        for s in range(7):  # 1 to 3: modal seen; 4 to 6: verb after it seen
            after = s - 1 if s not in (1, 4) else 0
            if symbol == MODAL:
                threat.arc(s, symbol, 3)
            elif symbol == THREAT and 1 <= s <= 3:
                threat.arc(s, symbol, 6)
            elif symbol == TARGET and s >= 4:
                threat.arc(s, symbol, 0, plus=3.0)
            else:
                threat.arc(s, symbol, after if s else 0)
    negation = Transducer()  # an insult within two words after a negation
    for s, c, t in near(NEGATION, 2):
        negation.arc(s, c, t, times=0.3 if c == INSULT and s else 1.0)
    report = Transducer()  # whatever follows a verb of reporting in the clause
    report.arc(0, REPORT, 1).arc(1, INSULT, 1, times=0.6)
    machine = insult
    for part in (target, threat, negation, report):
        machine = compose(machine, part)
    return machine


@dataclass
class Model:
    """Stems (``word`` as it stands, ``stem*`` for a prefix) with weights, and
    the logistic layer."""

    stems: dict[str, float] = field(default_factory=dict)
    layer: tuple[float, ...] = (-3.0, 2.5, 1.0)


class Scorer:
    """Finds lexicon words by one Aho-Corasick scan, then runs the grammar over
    the clauses around them."""

    def __init__(self, model: Model):
        self.model = model
        machine = grammar()
        self.table = [[machine.step(s, c) for c in range(CLASSES)] for s in range(machine.states)]
        self.closed = {w: c for c, words in WORDS.items() if c != INSULT for w in words.split()}
        self.whole = {w: BUILT_IN_WEIGHT for w in WORDS[INSULT].split()}
        self.whole.update({s: w for s, w in model.stems.items() if s[-1] != "*"})
        self.prefixes = {s[:-1]: w for s, w in model.stems.items() if s[-1] == "*"}
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.finder = ahocorasick.Automaton()
        for key in {*self.whole, *self.prefixes, *WORDS[THREAT].split()}:
            self.finder.add_word(key, len(key))
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        best = self.whole.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.prefixes.get(word[:n], 0.0))
        return best

    def clause(self, words: list[str]) -> float:
        state = 0
        total = 0.0
        for word in words:
            symbol, weight = self.closed.get(word, OTHER), 0.0
            if symbol == OTHER and (weight := self.weight(word)):
                symbol = INSULT
            state, times, plus = self.table[state][symbol]
            total += weight * times + plus
        return total

    def clauses(self, text: str) -> list[float]:
        """Scores above zero of the clauses that hold a lexicon word."""
        text = text.lower()
        out, done = [], 0
        for end, length in self.finder.iter(text):
            begin = end - length + 1
            if begin < done or (begin and (text[begin - 1].isalpha() or text[begin - 1] == "'")):
                continue
            # the clause around the word; its end may be the text's
            start = begin
            while start > done and text[start - 1] not in ".!?;:\n\r":
                start -= 1
            stop = CLAUSE_END.search(text, end + 1)
            done = stop.start() if stop else len(text)
            if score := self.clause(WORD.findall(text, start, done)):
                out.append(score)
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        found = self.clauses(text or "")
        return (min(max(found, default=0.0), 8.0), math.log1p(sum(found)))

    def score(self, text: str | None) -> float:
        a, b, c = self.layer_of(text)
        return 1 / (1 + math.exp(-max(min(a + b + c, 30.0), -30.0)))

    def layer_of(self, text: str | None) -> tuple[float, float, float]:
        bias, most, total = self.model.layer
        x, y = self.features(text)
        return bias, most * x, total * y


def stems(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEM_LENGTHS if k <= len(word))]


def stem_counts(training: DataFrame) -> DataFrame:
    """stem, and over all rows and over those of the first half (_h): contexts (the
    different words before it in toxic texts, so copies of one text count once),
    toxic and clean (the texts that hold it); stems of ``LEAST_CONTEXTS`` or more.

    training: text, toxic, first.  Counts are made by Spark, texts stay in tasks."""

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, first in zip(batch["text"].tolist(), batch["first"].tolist()):
                words = WORD.findall((text or "").lower())
                found = {(s, before) for before, word in set(zip(["", *words], words)) for s in stems(word)}
                yield pd.DataFrame(list(found), columns=["stem", "before"]).assign(first=int(first)).astype({"stem": object, "before": object})

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for text, label, first in zip(batch["text"].tolist(), batch["toxic"].tolist(), batch["first"].tolist()):
                for s in {s for w in set(WORD.findall((text or "").lower())) for s in stems(w)}:
                    own = counts[s]
                    own[1 - label] += 1
                    own[3 - label] += int(first)
            yield pd.DataFrame([(s, *c) for s, c in counts.items()], columns=["stem", "toxic", "clean", "toxic_h", "clean_h"]).astype({"stem": object})

    pairs = training.where("toxic = 1").select("text", "first").mapInPandas(contexts, "stem string, before string, first int")
    pairs = pairs.groupBy("stem", "before").agg(F.max("first").alias("first"))
    wide = pairs.groupBy("stem").agg(F.count("*").alias("contexts"), F.sum("first").alias("contexts_h")).where(F.col("contexts") >= LEAST_CONTEXTS)
    held = training.select("text", "toxic", "first").mapInPandas(texts, "stem string, toxic long, clean long, toxic_h long, clean_h long")
    held = held.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_h", "clean_h")])
    return wide.join(held, "stem")


def choose_stems(counts: dict[str, tuple[int, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems with weights, of counts (contexts, toxic, clean) by stem."""
    candidates = {s: c for s, c in counts.items() if c[0] >= LEAST_CONTEXTS}
    toxic, clean = ({s: c[k] for s, c in candidates.items()} for k in (1, 2))
    longer: dict[str, list[str]] = defaultdict(list)
    for e in candidates:
        for k in STEM_LENGTHS:
            if k <= len(e.rstrip("*")) and (p := e[:k] + "*") != e:
                longer[p].append(e)
    chosen: dict[str, float] = {}
    for s in sorted(candidates, key=lambda s: (len(s.rstrip("*")), s[-1] != "*", s)):
        contexts = candidates[s][0]
        support = min(toxic[s], contexts) if contexts < 64 else toxic[s]
        rate, base = (support + 0.5) / (n_toxic + 1), (clean[s] + 0.5) / (n_clean + 1)
        if rate < LEAST_RATIO * base or any(s.startswith(p[:-1]) for k in STEM_LENGTHS if (p := s[:k] + "*") in chosen and p != s):
            continue  # too common in clean texts, or a shorter stem covers it
        if any(toxic[e] >= (0.8 if clean[e] < clean[s] else 0.95) * toxic[s] for e in longer.get(s, ()) if clean[e] <= clean[s]):
            continue  # a longer stem says the same more narrowly
        chosen[s] = round(math.log(rate / base), 6)
    return chosen


def fit_layer(features: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, classes weighted alike."""
    x = np.column_stack([np.ones(len(features)), features])
    weight = np.where(labels == 1, len(labels) / max(2 * labels.sum(), 1), len(labels) / max(2 * (1 - labels).sum(), 1))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (labels - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows whose id's crc32 isn't divisible by 5, at most
    ``rows`` of each label."""
    key = F.col("doc_id").cast("long")
    training = labels.where("doc_id is not null and toxic is not null").select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    training = training.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id", F.lit(5))
    sample = training.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(training.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    sample = sample.repartition(1)  # 2 x rows ids
    found = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    # texts may be long, so the driver sees none: at most 2 x rows of them, staged once
    found = stage(found, "training")
    # halves: stems from one, the layer from the other, so it sees unseen texts
    place = F.row_number().over(Window.orderBy("doc_id"))
    halves = found.select("doc_id").repartition(1).select("doc_id", (place % 2 == 1).alias("first"))  # 2 x rows ids
    training = stage(found.repartition("doc_id").join(F.broadcast(halves), "doc_id"), "halves")
    n = {(r.toxic, r.first): r.k for r in training.groupBy("toxic", "first").agg(F.count("*").alias("k")).collect()}  # four numbers
    whole, half = ([sum(k for (y, first), k in n.items() if y == label and (first or every)) for label in (1, 0)] for every in (True, False))
    if not all(whole):
        unstage(found)
        unstage(training)
        return Model()
    counts = list(stem_counts(training).toLocalIterator())  # bounded by the words of 2 x rows texts
    model = Model(choose_stems({r.stem: (r.contexts_h, r.toxic_h, r.clean_h) for r in counts}, *half))
    layer = model.layer
    if any(not first for _, first in n):
        features = _features(training.where("not first"), model).orderBy("doc_id").collect()  # two numbers an id
        layer = fit_layer(np.array([(r.most, r.total) for r in features]).reshape(-1, 2), np.array([r.toxic for r in features], float))
    unstage(found)
    unstage(training)
    return Model(choose_stems({r.stem: (r.contexts, r.toxic, r.clean) for r in counts}, *whole), layer)


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic and the features most and total."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            most, total = zip(*(scorer.features(t) for t in batch["text"].tolist()), strict=True) if len(batch) else ((), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "most": np.array(most, float), "total": np.array(total, float)})

    return rows.select("doc_id", "toxic", "text").mapInPandas(run, "doc_id long, toxic int, most double, total double")


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``score`` in 0 to 1 and ``predicted`` for every document, whole texts.

    ``keep``: columns to carry; those named as the results are replaced."""
    kept = [c for c in (keep or ["doc_id"]) if c not in ("score", "predicted")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch.tolist()], dtype="float64")

    scored = docs.select(*[F.col(f"`{c}`") for c in kept], toxic(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
