r"""Spelling variants: a vocabulary's words at edit distance one, by a trie
self-join with active-node sets.

Counting walks whole texts in slices that end between words; words are counted
per document and task before they are shuffled.

Two words of equal length m, or of m and m + 1, that differ by one edit share
their first or their last half: the edit is in one of them.  So the vocabulary is
partitioned by (length class, shared half), and what a partition's words have
beyond it is a trie of its own.  A partition of more than ``GROUP`` words is split
again by the halves of those rests; a rest that can't be split is one code point
long, so such a partition holds no more words than the alphabet has letters.  No
partition is beyond a task's memory and none drops a word.

Within a trie, each node hands its children the nodes within distance one of it:
of distance 0 only the node itself, of distance 1 its parent, siblings and
children, and those of the parent's set that have the same next letter.  Words
that end in a node and in one of its active nodes at distance 1 are a pair.

A word's form is its near word of largest count (ties: smallest in code-point
order), if that count is ``ratio`` times its own or more; roots follow forms by
pointer doubling, which ends as counts grow along them.

Null texts hold no words; a null doc_id is written as an empty string in hashes.
Rows of a repeated doc_id count as often as they occur.  Texts and words may be of
any length.  Ties are settled as said, so results don't depend on partitions.  An
empty table gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stage, unstage

#: A run of letters, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
#: Code points of a slice of text, and words a task counts before it hands on.
SLICE = 1 << 20
HELD = 400_000
#: Words of a partition's trie.
GROUP = 4096


def _slices(text: str) -> Iterator[str]:
    """The text in parts that end between runs, only A-Z lower-cased."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            gap = NO_LETTER.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        at = end


def _runs(name: str, text: str, every: int, least: int) -> Iterator[tuple[str, int]]:
    """Words of ``least`` code points or more and how often they occur, letters
    deleted as the hashes say."""
    begun = zlib.crc32(f"{name}:".encode())
    for part in _slices(text):
        for run, n in Counter(RUN.findall(part)).items():
            if len(run) < least:
                continue
            h = zlib.crc32(run.encode("utf-8", "surrogatepass"), begun)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least:
                    continue
            yield run, n


def vocabulary(docs: DataFrame, every: int, least_length: int, least_count: int) -> DataFrame:
    """word and n (occurrences) of the words that are long and common enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch["name"].tolist(), batch["text"].tolist()):
                for word, n in _runs(name, text, every, least_length):
                    held[word] += n
                    if len(held) >= HELD:
                        yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                        held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _classes(words: DataFrame) -> DataFrame:
    """Each word in its length classes: key, more (lengths m and m + 1, not m
    alone), m, the rest of the word that may differ, word and n."""
    size = F.char_length("word")
    kinds = [(False, size), (True, size), (True, size - 1)]
    classes = F.array(*[F.struct(F.lit(more).alias("more"), m.alias("m")) for more, m in kinds])
    rows = words.select("word", "n", F.explode(classes).alias("c"))
    return rows.select(F.concat(F.when(F.col("c.more"), "+").otherwise("="), F.col("c.m").cast("string")).alias("key"), "c.more", "c.m", F.col("word").alias("rest"), "word", "n")


def _half() -> Column:
    """Code points that a near pair's rests share at one end at least."""
    return F.when(F.col("more"), F.floor((F.col("m") + 1) / 2)).otherwise(F.floor(F.col("m") / 2)).cast("int")


def _split(rows: DataFrame) -> DataFrame:
    """Each row under its rest's first half and under its last half."""
    size, h = F.char_length("rest"), F.col("h")
    front = F.struct(F.concat(F.lit("<"), F.substring("rest", F.lit(1), h)).alias("by"), F.substring("rest", h + 1, size).alias("rest"))
    back = F.struct(F.concat(F.lit(">"), F.substring("rest", size - h + 1, h)).alias("by"), F.substring("rest", F.lit(1), size - h).alias("rest"))
    both = rows.withColumn("h", _half()).select("key", "more", F.col("m") - F.col("h"), F.explode(F.array(front, back)).alias("side"), "word", "n")
    return both.toDF("key", "more", "m", "side", "word", "n").select(F.concat("key", "side.by").alias("key"), "more", "m", "side.rest", "word", "n")


def _partitioned(words: DataFrame) -> DataFrame:
    """Rows of partitions of two words or more, none over ``GROUP`` words unless
    its rests are single code points."""
    now, done = stage(_split(_classes(words)), "tries"), []
    while True:
        sizes = now.groupBy("key").agg(F.count("*").alias("k"))
        sized = now.join(sizes.where("k > 1"), "key")
        large = (F.col("k") > GROUP) & (_half() > 0)
        small = stage(sized.where(~large).drop("k"), "trie_rows")
        rest = stage(_split(sized.where(large).drop("k")), "tries")
        unstage(now)
        done.append(small)
        if rest.isEmpty():
            unstage(rest)
            break
        now = rest
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows


def trie_pairs(rests: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), in both directions, of strings that differ by one edit.
    Strings are distinct."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, rest in enumerate(rests):
        node = 0
        for letter in rest:
            after = children[node].get(letter)
            if after is None:
                after = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = after
        ends[node] = i
    # nodes at distance exactly one of each node; at distance zero is itself
    stack = [(0, list(children[0].values()))]
    while stack:
        node, active = stack.pop()
        own = children[node]
        if ends[node] >= 0:
            for other in active:
                if ends[other] >= 0:
                    yield ends[node], ends[other]
        if not own:
            continue
        siblings = list(own.values())
        for letter, child in own.items():
            reached = {node, *siblings, *children[child].values()}
            for other in active:
                after = children[other].get(letter)
                if after is not None:
                    reached.add(after)
            reached.discard(child)
            stack.append((child, list(reached)))


def _pairs_of(key: str, rests: list[str], words: list[str], counts: list[int]) -> Iterator[tuple[str, str, int]]:
    apart = key.startswith("+")  # this class is of pairs of different lengths
    for i, j in trie_pairs(rests):
        if (len(rests[i]) != len(rests[j])) == apart:
            yield words[i], words[j], counts[j]


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n (near's n), each pair in both directions once."""
    rows = _partitioned(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rests, own, counts = None, [], [], []
        out: list[tuple[str, str, int]] = []
        for batch in batches:
            for k, rest, word, n in zip(batch["key"].tolist(), batch["rest"].tolist(), batch["word"].tolist(), batch["n"].tolist()):
                if k != key:
                    out.extend(_pairs_of(key, rests, own, counts) if len(rests) > 1 else ())
                    key, rests, own, counts = k, [], [], []
                rests.append(rest)
                own.append(word)
                counts.append(n)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["word", "near", "near_n"])
                out = []
        if len(rests) > 1:
            out.extend(_pairs_of(key, rests, own, counts))
        if out:
            yield pd.DataFrame(out, columns=["word", "near", "near_n"])

    dealt = rows.select("key", "rest", "word", "n").repartition("key").sortWithinPartitions("key")
    # a pair that shares both halves is found in both partitions
    return dealt.mapInPandas(run, "word string, near string, near_n long").dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms lead to, by pointer doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unstage(now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    A run whose hash ``every`` divides loses one letter; ``every`` of 1 << 33
    deletes nothing."""
    words = stage(vocabulary(docs, every, least_length, least_count), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    known = F.col("form_n") >= F.lit(ratio) * F.col("n")
    found = stage(found.select("word", F.when(known, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("form_n")).alias("form_n")), "forms")
    unstage(words)
    roots = _roots(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
