"""Near-duplicate groups by a chosen-path similarity join over min-hashes.

A document's set holds its distinct word shingles; equal sets become one node, so
copies cost one row.  A node is known by min-hash tokens, one of each hash
function.  Every tree sends a node down ``BRANCH`` randomly chosen tokens at each
of ``LEVELS`` levels: nodes that end at the same leaf agreed on all tokens of its
path.  The top of a tree always holds more nodes than can be compared, so its
levels are taken where the document is read; a leaf that still holds many nodes
is branched further, by tokens chosen from the leaf's name, level by level.  Trees
use tokens of their own, so they miss a pair independently, and there are as many
as ``recall`` asks for at the threshold: a pair that survives a tree's levels with
probability 1 - q is missed by t trees with q^t.

Small leaves are compared exhaustively, but only where it can change an answer:

* first each node is compared with the nearest pivot of its leaves, and linked nodes
  get a common label: in the first round a leaf's pivot is the node that meets most
  others in its leaves, which stands in the middle of a group of copies, in the
  second the least by hash;
* leaves whose nodes have one label are done; in the others the nodes outside the
  largest label are compared with all that have another label;
* of two labels the nearest pair is verified first, and the rest only if that
  isn't a link.

Before sets are read a pair must pass its sizes and its signatures: the parity of
a set's shingles in 1024 cells, which differ in no more bits than the sets differ
in shingles, so no link is lost there.  Links are confirmed on whole sets: those of
a pivot and of a bounded share of the nodes that ask for it meet in one task, which
reads them one after the other.

Leaves, pivots and labels of any size are handled by joins and map-side
aggregates; nothing is capped.  Nodes are 64-bit hashes of sets and shingles 64-bit
hashes of words: about one wrong pair in 10^10 documents.

Null or empty text, and text of white space alone, is an empty set linked with
nothing.  Fewer than n words make one shingle of the whole sequence.  Rows that
share a doc_id count as one linked document; rows with a null doc_id get a null
component, take part in nothing and are kept.  An empty table gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import KeyFilter
from .graph import components
from .ngram_join import apart, merge_repeated, node_of, possible, shingles, signature
from .runtime import release, stage, unstage

LEVELS = 3
BRANCH = 2
#: Tokens kept for branching full leaves, and how many levels of that at most.
DEEP = 64
DEEPER = 6
#: Nodes of a leaf, or of its lesser labels, whose signatures are all compared.
SMALL = 1024
#: Cells of a signature; the more, the fewer sets are read in vain.
SIGNATURE = 1024
SIGNS = [f"s{k}" for k in range(SIGNATURE // 64)]
#: Nodes that share one copy of their pivot's set while they are verified.
SHARE = 256
ROUNDS = 2
#: Shingles hashed at a time.
BLOCK = 2048


def missed(similarity: float) -> float:
    """Probability that no path of one tree keeps a pair together."""
    q = 0.0
    for _ in range(LEVELS):
        q = (1 - similarity + similarity * q) ** BRANCH
    return q


def trees_for(similarity: float, recall: float) -> int:
    """Independent trees that together find a pair at the threshold with
    probability ``recall``."""
    q = missed(similarity)
    return 1 if q <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(q)))


class Paths:
    """The hash functions, and which tokens each leaf's path is made of."""

    def __init__(self, trees: int, seed: int = 1):
        nodes = [sum(BRANCH ** j for j in range(1, k + 1)) for k in range(LEVELS + 1)]  # tokens of the levels above
        leaves = np.arange(BRANCH ** LEVELS)
        tree = np.stack([nodes[k] + leaves // BRANCH ** (LEVELS - 1 - k) for k in range(LEVELS)], axis=1)
        self.tokens = np.concatenate([tree + t * nodes[LEVELS] for t in range(trees)])
        rng = np.random.default_rng(seed)
        count = trees * nodes[LEVELS] + DEEP
        self.flip = rng.integers(0, 1 << 64, count, np.uint64)
        self.odd = rng.integers(0, 1 << 64, count, np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 64, len(self.tokens), np.uint64)

    def minima(self, own: np.ndarray) -> np.ndarray:
        """The least hash of the set's shingles under each function."""
        out = np.full(len(self.flip), ~np.uint64(0))
        for at in range(0, len(own), BLOCK):
            np.minimum(out, ((own[at: at + BLOCK, None] ^ self.flip) * self.odd).min(0), out=out)
        return out

    def leaves(self, minima: np.ndarray) -> np.ndarray:
        """The leaves' names, as signed 64-bit numbers."""
        name = self.salt.copy()
        for k in range(LEVELS):
            name = (name ^ minima[self.tokens[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            name ^= name >> np.uint64(31)
        return name.view(np.int64)


def _read(docs: DataFrame, n: int, paths: Paths) -> DataFrame:
    """doc_id, node and size of every document, and with a node's first document in
    a task its signature, leaves and tokens for further branching."""
    shipped = docs.sparkSession.sparkContext.broadcast(paths)  # a few hundred numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc_id, named, text in zip(batch["doc_id"].tolist(), batch["named"].tolist(), batch["text"].tolist()):
                own = shingles(text, n)
                node = node_of(own) if len(own) else 0
                if not len(own) or not named or node in seen:
                    rows.append((doc_id, named, node, len(own), None, None, None))
                    continue
                seen.add(node)
                minima = shipped.value.minima(own)
                deep = (minima[-DEEP:] >> np.uint64(1)).astype(np.uint16).view(np.int16)
                rows.append((doc_id, named, node, len(own), signature(own, SIGNATURE), shipped.value.leaves(minima), deep))
            yield pd.DataFrame(rows, columns=["doc_id", "named", "node", "size", "signs", "leaves", "deep"])

    # no nulls among the numbers: pandas would make floats of them
    whole = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    rows = whole.mapInPandas(run, "doc_id long, named boolean, node long, size int, signs array<long>, leaves array<long>, deep array<short>")
    return rows.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), F.when(F.col("size") > 0, F.col("node")).alias("node"), "size", "signs", "leaves", "deep")


def _shared(nodes: DataFrame) -> DataFrame:
    """Staged leaf and node of the leaves that hold more than one node."""
    places = nodes.select(F.explode("leaves").alias("leaf"), "node")
    shared = stage(places.groupBy("leaf").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("leaf"), "shared")
    # most leaves hold one node: those never reach the shuffle
    wanted = KeyFilter(shared.select(F.col("leaf").alias("key")), shared.count())
    rows = stage(places.where(wanted.holds(F.col("leaf"))).join(shared, "leaf", "left_semi").distinct(), "leaves")
    wanted.drop()
    unstage(shared)
    return rows


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """Staged rows of the leaves that hold more than one label."""
    spread = rows.groupBy("leaf").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("leaf")
    return stage(rows.join(spread, "leaf"), name)


def _met(rows: DataFrame) -> DataFrame:
    """The rows with how many nodes their node meets in all its leaves."""
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("k"))
    met = rows.join(sizes, "leaf").groupBy("node").agg(F.sum("k").alias("met"))
    return rows.join(met, "node").withColumn("label", F.col("node"))


def _labels(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the labels that the links give their nodes."""
    answers = components(links).withColumnRenamed("label", "now")
    return rows.drop("label").join(answers, "node", "left").withColumn("label", F.coalesce("now", "node")).drop("now")


def _as(rows: DataFrame, side: str, *more: str) -> DataFrame:
    names = ["node", "label", "size", *SIGNS, *more]
    return rows.select("leaf", *[F.col(c).alias(f"{side}_{c}") for c in names])


def _worth(num: int, den: int) -> Column:
    """Different labels, sizes and signatures that leave the threshold possible."""
    x, y = F.col("x_size").cast("long"), F.col("y_size").cast("long")
    return (F.col("x_label") != F.col("y_label")) & (F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)) & possible("x_", "y_", num, den, SIGNS)


def _pivots(rows: DataFrame, about: DataFrame, num: int, den: int, salt: int) -> DataFrame:
    """a and b: each node and the nearest of its leaves' pivots that may be
    similar."""
    order = F.xxhash64("node", F.lit(salt))
    by = F.struct(F.col("met"), order, "node", "label") if salt == 0 else F.struct(order, "node", "label")
    pivots = rows.groupBy("leaf").agg(F.max(by).alias("p")).select("leaf", F.col("p.node").alias("b"), F.col("p.label").alias("b_label"))
    tries = rows.join(pivots, "leaf").where("label <> b_label").select(F.col("node").alias("a"), "b", F.col("label").alias("x_label"), F.col("b_label").alias("y_label")).distinct()
    for side, c in (("x", "a"), ("y", "b")):
        tries = tries.join(about.select(F.col("node").alias(c), *[F.col(k).alias(f"{side}_{k}") for k in ("size", *SIGNS)]), c)
    best = tries.where(_worth(num, den)).groupBy("a").agg(F.min(F.struct(apart("x_", "y_", SIGNS).alias("apart"), "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def _verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the staged pairs (a, b) whose similarity is num / den or more.

    Texts of the asked nodes are read once more.  Up to about ``SHARE`` sets of a's
    follow one copy of their b's set through a task."""
    spark = docs.sparkSession
    shares = pairs.groupBy("b").agg(F.count("*").alias("k")).select("b", F.ceil(F.col("k") / SHARE).cast("int").alias("shares"))
    asking = pairs.join(shares, "b").select(F.col("a").alias("node"), F.col("b").alias("to"), F.pmod(F.xxhash64("a", "b"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"))
    asked = shares.select(F.col("b").alias("node"), F.col("b").alias("to"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    asks = stage(asking.unionByName(asked).join(first.select("node", F.col("first").alias("doc_id")), "node"), "asks")
    wanted = KeyFilter(asks.select(F.xxhash64("doc_id").alias("key")), asks.count())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            last, own, found = None, None, None
            for text, node, to, share, role in zip(*(batch[c].tolist() for c in ("text", "node", "to", "share", "role"))):
                if last != text:
                    last, own = text, shingles(text, n)
                    found = node_of(own) if len(own) else None
                if found == node:  # not another text of the same id
                    rows.append((to, share, role, node, own.view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["to", "share", "role", "node", "own"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, whole = None, None
        for batch in batches:
            found = []
            for to, share, role, node, own in zip(*(batch[c].tolist() for c in ("to", "share", "role", "node", "own"))):
                if role == 0:
                    place, whole = (to, share), own
                elif place == (to, share):
                    common = len(np.intersect1d(own, whole, assume_unique=True))
                    if common * den >= (len(own) + len(whole) - common) * num:
                        found.append((node, to))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    some = docs.where(wanted.holds(F.xxhash64("doc_id"))).join(asks, "doc_id").select("text", "node", "to", "share", "role")
    met = some.mapInPandas(sets, "to long, share int, role int, node long, own array<long>").repartition("to", "share").sortWithinPartitions("to", "share", "role")
    out = stage(met.mapInPandas(check, "a long, b long"), "links")
    wanted.drop()
    unstage(asks)
    release(spark)
    return out


def _branched(rows: DataFrame, deep: DataFrame) -> DataFrame:
    """The rows one level further down, by tokens chosen from the leaf's name."""
    chosen = [F.pmod(F.xxhash64("leaf", F.lit(j)), F.lit(DEEP)).cast("int") for j in range(BRANCH)]
    names = F.array_distinct(F.array(*[F.xxhash64("leaf", c, F.get("deep", c)) for c in chosen]))
    return rows.join(deep, "node").withColumn("leaf", F.explode(names)).drop("deep")


def _candidates(rows: DataFrame, about: DataFrame, num: int, den: int) -> DataFrame:
    """Staged pairs (a < b) of nodes of different labels that may be similar, with
    the distance of their signatures."""
    found, now = [], rows
    for level in range(DEEPER + 1):
        counted = now.groupBy("leaf", "label").agg(F.count("*").alias("k"))
        sizes = counted.groupBy("leaf").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("main"))
        sizes = sizes.select("leaf", F.col("main.label").alias("main"), ((F.col("n") <= SMALL) | (F.col("n") - F.col("main.k") <= SMALL) | F.lit(level == DEEPER)).alias("small"))
        sized = now.join(sizes, "leaf")
        small = sized.where("small").join(about.drop("deep"), "node")
        x, y = _as(small.where("label <> main"), "x"), _as(small, "y", "main")
        once = (F.col("y_label") == F.col("y_main")) | (F.col("x_node") < F.col("y_node"))
        pairs = x.join(y, "leaf").where(_worth(num, den) & once)
        ends = {"a": F.least, "b": F.greatest}
        pairs = pairs.select(*[f("x_node", "y_node").alias(c) for c, f in ends.items()], apart("x_", "y_", SIGNS).alias("apart"), *[F.when(F.col("x_node") == f("x_node", "y_node"), F.col("x_label")).otherwise(F.col("y_label")).alias(f"{c}_label") for c, f in ends.items()])
        found.append(stage(pairs.distinct(), "pairs"))
        large = sized.where("not small").drop("main", "small")
        if level == DEEPER or large.isEmpty():
            break
        now = _mixed(_branched(large, about.select("node", "deep")).distinct(), "deeper")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return stage(every.distinct(), "pairs")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, recall: float = 0.99999) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of
    similarity num / den or more) and kept (the component's first document) of
    every document.  ``recall`` is the least chance that a pair at the threshold
    meets in a leaf; more similar pairs have a higher one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, known = docs.sparkSession, docs.where("doc_id is not null")
    read = stage(_read(docs, n, Paths(trees_for(num / den, recall))), "read")
    nodes = read.where("leaves is not null")
    first = stage(read.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("first")), "first")
    shared = _shared(nodes)
    release(spark)
    signs = [F.element_at("signs", k + 1).alias(s) for k, s in enumerate(SIGNS)]
    about = nodes.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    about = stage(about.select("node", "size", *signs, "deep"), "about")
    rows = stage(_met(shared), "leaves")
    unstage(shared)
    release(spark)
    links, tried = None, None
    for salt in range(ROUNDS):
        star = stage(_pivots(rows, about, num, den, salt), "star")
        more = _verified(known, star, first, n, num, den)
        links = more if links is None else links.unionByName(more)
        tried = star if tried is None else tried.unionByName(star)
        before, rows = rows, _mixed(_labels(rows, links), "leaves")
        unstage(before)
        release(spark)
    pairs = _candidates(rows.drop("met"), about, num, den)
    unstage(rows)
    unstage(about)
    release(spark)
    left = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    # of two labels the nearest pair first
    nearest = left.groupBy(F.least("a_label", "b_label").alias("u"), F.greatest("a_label", "b_label").alias("v")).agg(F.min(F.struct("apart", "a", "b")).alias("best"))
    nearest = stage(nearest.select("best.a", "best.b"), "nearest")
    links = links.unionByName(_verified(known, nearest, first, n, num, den))
    answers = components(links)
    rest = left.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(answers.select(F.col("node").alias(side), F.col("label").alias(f"{side}_now")), side, "left")
    rest = stage(rest.where("coalesce(a_now, a) <> coalesce(b_now, b)").select("a", "b"), "rest")
    if not rest.isEmpty():
        answers = components(links.unionByName(_verified(known, rest, first, n, num, den)))
    for done in (pairs, nearest, rest):
        unstage(done)
    release(spark)
    least = first.join(answers, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    named = least.groupBy("label").agg(F.min("first").alias("component"))
    found = read.select("doc_id", "node", F.col("size").cast("long").alias("n_shingles")).join(least.join(named, "label").select("node", "component"), "node", "left")
    found = merge_repeated(found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
