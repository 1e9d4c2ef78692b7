"""N-gram Jaccard join: which documents' shingle sets are similar, exactly.

A document's set holds its distinct word n-grams.  Equal sets become one node,
so copies cost one row.  Shingles get one global order: those a bounded count
sketch shows as common go last, the rest follow by hash.  By that order each
node posts its prefix, and nodes that may reach the threshold share a posted
shingle.  A shingle's posting list is cut into blocks by set size and position:

* index-level skipping: a list's blocks are its size bands, each cut into the
  front and the back of its sets.  Two blocks are joined only if their bands are
  the same or adjacent and their best places leave room for the overlap the
  threshold asks for; rows of joined blocks are then filtered by their own;
* answer-level skipping: in each round every list offers a few pivots; each node
  is compared with the one whose signature is nearest among those it shares more
  than one posted shingle with.  Nodes similar to a pivot take over the pivot's
  component as their answer.  Lists that still hold many nodes outside their
  largest component, as those of near copies without a common centre do, are sorted
  by each word of the signatures, and nodes are compared with the nearest of their
  neighbours there; afterwards only pairs still in different components are
  compared.

A signature is the parity of a set's shingles in 256 cells.  Two signatures
differ in no more bits than the sets differ in shingles, so a pair whose
signatures are too far apart is passed over without reading its sets; such
pairs are never links.

Links not needed for the components are never listed, none that joins two
components is missed, and list sizes are bounded by nothing: pairs of a common
shingle are made by joins that spill and split.

Nodes are 64-bit hashes of sets, shingles 64-bit hashes of their words; results
are exact up to collisions of those (about one wrong pair in 10^10 documents).

Null or empty text, and text of white space alone, is an empty set linked with
nothing.  Fewer than n words make one shingle of the whole sequence.  Rows that
share a doc_id count as one linked document; rows with a null doc_id get a null
component and take part in nothing.  An empty table gives no rows.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import KeyFilter
from .graph import components
from .runtime import release, stage, unstage

#: Width of the count sketch: bounds what is broadcast, not what is counted.
SKETCH_CELLS = 1 << 23
#: Only shingles in this share of the hash range are counted; prefixes of
#: ordinary sets lie inside it.
SKETCH_SHARE = 0.18
SKETCH_PARTS = 64
#: Cells of a set's signature; rounds of pivots, and pivots of a list in each.
SIGNATURE = 256
ROUNDS = 2
PIVOTS = 3
#: Sets up to this size may try a pivot that they share one posting with.
FEW = 20
#: Nodes outside its largest component from which on a list is sorted by signatures;
#: rounds of that, neighbours before a node in each order, and how many it tries.
CHAIN = 32
CHAIN_ROUNDS = 2
NEIGHBOURS = 2
NEAREST = 3
#: Listed shingles before it that a posting carries, which tell whether a pair has
#: met already.
BEFORE = 6
MEMO_WORDS = 200_000
#: Bytes of text whose sets a task makes at once.
SLICE_BYTES = 1 << 21

# Odd multipliers for combining word hashes.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.  Words are cut
    at ASCII white space; only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64) * np.uint64(0x27D4EB2F165667C5)
    for k in range(width):
        total += _mix(h[k: len(h) - width + 1 + k] + MULTIPLIERS[k % 8] * np.uint64(k // 8 + 1)) * MULTIPLIERS[k % 8]
    return np.unique(_mix(total))


def _hashed(words: pa.Array) -> np.ndarray:
    """The hash of every word, from the array's own bytes."""
    wide = np.int64 if pa.types.is_large_string(words.type) else np.int32
    ends = np.frombuffer(words.buffers()[1], wide)[words.offset: words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2]
    data = data.to_pybytes() if data else b""
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(words))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``shingles`` of each text, one set after the other, and the bounds of the
    sets: set k is ``flat[bounds[k]: bounds[k + 1]]``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    rows = rows[real.to_numpy(zero_copy_only=False)]
    codes = coded.indices.to_numpy()
    distinct = _hashed(coded.dictionary)
    total = np.full(max(0, len(codes) - n + 1), n, np.uint64) * np.uint64(0x27D4EB2F165667C5)
    for k in range(n if len(total) else 0):
        total += (_mix(distinct + MULTIPLIERS[k % 8] * np.uint64(k // 8 + 1)) * MULTIPLIERS[k % 8])[codes[k: len(codes) - n + 1 + k]]
    # windows inside one text; texts of fewer words are one window of their own width
    inside = rows[: len(total)] == rows[n - 1:]
    hashes, owner = _mix(total[inside]), rows[: len(total)][inside]
    words = np.bincount(rows, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        own = np.concatenate([shingles(texts[int(k)].as_py(), n) for k in short])
        hashes, owner = np.concatenate([hashes, own]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        hashes[ends[k]: ends[k + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _slices(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows of about SLICE_BYTES of text, or of one row."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in texts:
        total += pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(total) // SLICE_BYTES
    at = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def node_of(own: np.ndarray) -> int:
    """A set's node id, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def signature(own: np.ndarray, cells: int = SIGNATURE) -> list[int]:
    """The parity of a set's shingles in each cell, as signed numbers of 64 cells."""
    parity = np.bincount((own >> np.uint64(20)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()


def signatures(flat: np.ndarray, bounds: np.ndarray, cells: int = SIGNATURE) -> np.ndarray:
    """The ``signature`` of every set, a row each."""
    sets = len(bounds) - 1
    at = np.repeat(np.arange(sets) * cells, np.diff(bounds)) + (flat >> np.uint64(20)).astype(np.int64) % cells
    parity = np.bincount(at, minlength=sets * cells).astype(np.uint8) & 1
    return np.packbits(parity.reshape(sets, cells), axis=1).view(np.int64)


def prefix_length(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Places that two sets at the threshold must share one of."""
    return size - (size * num + den - 1) // den + 1


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


class Order:
    """The global order of shingles: common ones last, else by hash."""

    def __init__(self, counts: np.ndarray):
        # what chance alone puts into a cell
        usual = counts.mean() + 3 * np.sqrt(counts.mean()) + 2
        steps = np.ceil(np.log2(np.maximum(np.arange(65536) / usual, 1))).astype(np.uint8)
        self.level = steps[counts]
        self.top = np.uint64(int(SKETCH_SHARE * 2**64))

    def _levels(self, own: np.ndarray) -> np.ndarray:
        return np.where(own < self.top, self.level[_cells(own)], 0)

    def prefix(self, own: np.ndarray, length: int) -> np.ndarray:
        if not self._levels(own[:length]).any():
            return own[:length]
        return own[np.argsort(self._levels(own), kind="stable")[:length]]


SIGNS = [f"s{k}" for k in range(SIGNATURE // 64)]


def _key():
    """The name of a row by its id and text."""
    return F.xxhash64("doc_id", "text")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, key, node, size, signature) and of the sketch
    (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, top = np.zeros(SKETCH_CELLS, np.uint8), np.uint64(int(SKETCH_SHARE * 2**64))
        seen: set[int] = set()
        for batch in batches:
            for rows in _slices(batch, "text"):
                flat, bounds = shingle_sets(rows.column("text"), n)
                sizes, signs = np.diff(bounds), signatures(flat, bounds)
                nodes, fresh = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
                for k in np.flatnonzero(sizes).tolist():
                    node = nodes[k] = node_of(flat[bounds[k]: bounds[k + 1]])
                    if node not in seen:  # copies count once a task
                        seen.add(node)
                        fresh[k] = True
                cells, more = np.unique(_cells(flat[np.repeat(fresh, sizes) & (flat < top)]), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + more, 255)
                numbers = [nodes, sizes.astype(np.int32), *(np.ascontiguousarray(signs[:, k]) for k in range(len(SIGNS)))]
                none = [pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], *map(pa.array, numbers), *none], names=columns)
        width = SKETCH_CELLS // SKETCH_PARTS
        if seen:
            own = [counts[k * width: (k + 1) * width].tobytes() for k in range(SKETCH_PARTS)]
            zero = pa.array(np.zeros(SKETCH_PARTS, np.int64))
            yield pa.RecordBatch.from_arrays([zero, zero.cast(pa.bool_()), zero, zero, zero.cast(pa.int32()), *[zero] * len(SIGNS), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(own, pa.binary())], names=columns)

    columns = ["doc_id", "named", "key", "node", "size", *SIGNS, "part", "counts"]
    whole = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), _key().alias("key"), "text")
    rows = whole.mapInArrow(run, f"doc_id long, named boolean, key long, node long, size int, {', '.join(s + ' long' for s in SIGNS)}, part int, counts binary")
    return rows.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "key", F.when(F.col("size") > 0, F.col("node")).alias("node"), "size", *SIGNS, "part", "counts")


def _order(sets: DataFrame) -> Order:
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_CELLS // SKETCH_PARTS, np.uint32)
        for c in frame["counts"]:
            total += np.frombuffer(c, np.uint8)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [np.minimum(total, 65535).astype(np.uint16).tobytes()]})

    parts = sets.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect()  # SKETCH_CELLS numbers
    counts = np.zeros(SKETCH_CELLS, np.uint16)
    width = SKETCH_CELLS // SKETCH_PARTS
    for r in parts:
        counts[r.part * width: (r.part + 1) * width] = np.frombuffer(r.counts, np.uint16)
    return Order(counts)


def _postings(docs: DataFrame, n: int, num: int, den: int, order: Order, owned: bool = False) -> DataFrame:
    """token, node, size and place of every node's prefix; if ``owned``, with the
    doc_id that it was made from."""
    names = ["token", "node", "size", "place", *["owner"] * owned]
    shipped = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows in _slices(batch, "text"):
                flat, bounds = shingle_sets(rows.column("text"), n)
                tokens, nodes, sizes, places, owners = [], [], [], [], []
                for a, b, owner in zip(bounds[:-1].tolist(), bounds[1:].tolist(), rows.column("doc_id").to_pylist()):
                    if a == b or (node := node_of(flat[a:b])) in seen:
                        continue
                    seen.add(node)
                    length = int(prefix_length(np.int64(b - a), num, den))
                    tokens.append(shipped.value.prefix(flat[a:b], length).view(np.int64))
                    nodes.append(np.full(length, node))
                    sizes.append(np.full(length, b - a, np.int32))
                    places.append(np.arange(length, dtype=np.int32))
                    owners.append(np.full(length, owner))
                if tokens:
                    made = [pa.array(np.concatenate(c)) for c in (tokens, nodes, sizes, places, owners)]
                    yield pa.RecordBatch.from_arrays(made[: len(names)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "token long, node long, size int, place int" + ", owner long" * owned)


def _fits(a: str, b: str, num: int, den: int):
    """Whether places and sizes leave room for the threshold: the first shared
    shingle's places bound the overlap by what follows them."""
    size_a, size_b = F.col(f"{a}size").cast("long"), F.col(f"{b}size").cast("long")
    room = F.least(size_a - F.col(f"{a}place"), size_b - F.col(f"{b}place"))
    sizes = F.lit(den) * F.least(size_a, size_b) >= F.lit(num) * F.greatest(size_a, size_b)
    return sizes & (F.lit(den) * room >= F.lit(num) * (size_a + size_b - room))


def _band(size, num: int, den: int):
    """The size band: sizes in it are within den / num of each other."""
    return F.floor(F.log(size.cast("double")) / np.log(den / num)).cast("int")


def _back(size, place, num: int, den: int):
    """Whether a place lies in the back block: from it on there are fewer shingles
    than two sets of this size must share.  So it fits only smaller sets, and two
    places in back blocks never fit."""
    return F.lit(num + den) * (size.cast("long") - place) < F.lit(2 * num) * size.cast("long")


def _reachable(num: int, den: int):
    """band and back of the blocks that a posting (size, place) may fit."""
    size, place = F.col("size").cast("long"), F.col("place")
    band, back = _band(size, num, den), _back(size, place, num, den)
    # the largest partner that the room behind this place allows
    most = (F.lit(num + den) * (size - place) / F.lit(float(num)) - size) * (1 + 1e-9)
    blocks = []
    for step in (-1, 0, 1):
        # of a pair that fits, only the larger set's place may be in a back block
        for other in (False, True):
            if other and step < 0:
                continue
            fits = F.pow(F.lit(den / num), band + step) * (1 - 1e-9) <= most
            if other or step > 0:
                fits = fits & ~back
            blocks.append(F.when(fits, F.struct((band + step).alias("band"), F.lit(other).alias("back"))))
    return F.filter(F.array(*blocks), lambda b: b.isNotNull())


def apart(a: str, b: str, signs: list[str] = SIGNS):
    """In how many bits two signatures differ."""
    return sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in signs), F.lit(0)).cast("long")


def possible(a: str, b: str, num: int, den: int, signs: list[str] = SIGNS):
    """Whether signatures leave the threshold possible: there, num of num + den
    shingles of both sets are shared twice."""
    return F.lit(num + den) * apart(a, b, signs) <= F.lit(den - num) * (F.col(f"{a}size").cast("long") + F.col(f"{b}size"))


def _close(pairs: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that signatures and sizes leave possible, with the distance
    of their signatures."""
    x, y = (first.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), *[F.col(s).alias(f"{c}_{s}") for s in SIGNS]) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")
    return both.where(possible("a_", "b_", num, den)).select("a", "b", apart("a_", "b_").alias("apart"))


def _verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the staged pairs (a, b) whose similarity is num / den or more.

    Texts travel, not sets, which are several times as large: one text a node,
    that of its first document.  Pairs come sorted by b, whose set is made once."""
    spark = docs.sparkSession
    x, y = (first.select(F.col("node").alias(c), F.col("key").alias(f"{c}_key")) for c in "ab")
    named = stage(pairs.select("a", "b").join(x, "a").join(y, "b"), "named")
    asked = named.select(F.col("a_key").alias("key")).unionByName(named.select(F.col("b_key").alias("key"))).distinct()
    wanted = KeyFilter(asked, 2 * named.count())
    some = docs.select(_key().alias("key"), "text").where(wanted.holds(F.col("key")))
    # rows that repeat are one text
    texts = stage(some.groupBy("key").agg(F.first("text").alias("text")), "texts")
    release(spark)
    both = named.join(texts.select(F.col("key").alias("a_key"), F.col("text").alias("x")), "a_key").join(texts.select(F.col("key").alias("b_key"), F.col("text").alias("y")), "b_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, "x", "y"):
                a, b = (rows.column(c).to_numpy() for c in "ab")
                turns = np.concatenate([[True], b[1:] != b[:-1]])
                own, at = shingle_sets(rows.column("x"), n)
                other, of = shingle_sets(rows.column("y").take(pa.array(np.flatnonzero(turns))), n)
                links = np.zeros(len(a), bool)
                for k, t in enumerate((np.cumsum(turns) - 1).tolist()):
                    both = np.concatenate([own[at[k]: at[k + 1]], other[of[t]: of[t + 1]]])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    links[k] = common * den >= (len(both) - common) * num
                yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], names=["a", "b"])

    out = stage(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    wanted.drop()
    for table in (named, texts):
        unstage(table)
    release(spark)
    return out


def _labelled(rows: DataFrame, answers: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """Rows with the label of their node: its component's, else its own."""
    named = answers.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def _tries(listed: DataFrame, num: int, den: int) -> DataFrame:
    """For each round the nodes (a) and the pivots that they meet (b), how often
    (k) and a's least size, from one pass over the lists: a list's pivots are its
    nodes least by salted hashes.  Lists are dealt out first, as a window's inputs
    are computed before its own exchange and would travel with every posting."""
    listed = listed.repartition("token")
    names = ["node", "size", "place"]
    by_token = Window.partitionBy("token")
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("by"), *names)).over(by_token).alias(f"p{k}") for k in range(ROUNDS * PIVOTS)]
    pivots = [F.struct(F.lit(k // PIVOTS).alias("round"), *[F.col(f"p{k}.{c}").alias(f"p_{c}") for c in names]) for k in range(ROUNDS * PIVOTS)]
    met = listed.select(*names, *least).select(*names, F.explode(F.array_distinct(F.array(*pivots))).alias("p")).select(*names, "p.*")
    met = met.where("node <> p_node").where(_fits("", "p_", num, den))
    return met.groupBy("round", F.col("node").alias("a"), F.col("p_node").alias("b")).agg(F.count("*").alias("k"), F.min("size").alias("size"))


def _same(rows: DataFrame) -> DataFrame | None:
    """Links (a, b) between the nodes of rows that share a doc_id, staged, if any do:
    those are one document whether similar or not."""
    named = rows.where("doc_id is not null and node is not null")
    least = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").drop("last")
    same = stage(named.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "same")
    if same.isEmpty():
        unstage(same)
        return None
    return same


def _listed(postings: DataFrame) -> DataFrame:
    """The postings of lists that can link anything: those of one node end here, and
    those that one document's rows alone have made."""
    by_token = Window.partitionBy("token")
    told = [c for c in ("node", "owner") if c in postings.columns]
    least = [F.min(c).over(by_token).alias(f"least_{c}") for c in told]
    last = [F.max(c).over(by_token).alias(f"last_{c}") for c in told]
    some = reduce(Column.__and__, [F.col(f"least_{c}") != F.col(f"last_{c}") for c in told])
    return postings.select("*", *least, *last).where(some).select("token", "node", "size", "place")


def _pivots(tries: DataFrame, first: DataFrame, num: int, den: int, answers: DataFrame | None) -> DataFrame:
    """For each node the pivot of another component with the nearest signature."""
    shared = tries.where((F.col("k") > 1) | (F.col("size") <= FEW)).select("a", "b")
    if answers is not None:
        shared = _labelled(_labelled(shared, answers, "a", "x"), answers, "b", "y").where("x <> y").select("a", "b")
    close = _close(shared, first, num, den)
    best = close.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"))
    return stage(best.select("a", F.col("best.b").alias("b")), "star")


def _either(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _met(a: str, b: str, earlier: list[str]):
    """Whether two postings carry the same shingle from before."""
    return F.coalesce(reduce(Column.__or__, [F.col(f"{a}{s}") == F.col(f"{b}{t}") for s in earlier for t in earlier]), F.lit(False))


def _mixed(labelled: DataFrame) -> DataFrame:
    """The postings of lists that hold more than one component, with the one that
    most of the list is in (main) and how many are in others (minors); a node that
    several tasks posted is there once."""
    sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("main"), F.count("*").alias("labels"), F.sum("k").alias("rows")).where("labels > 1")
    main = main.select("token", F.col("main.label").alias("main"), (F.col("rows") - F.col("main.k")).alias("minors"))
    return labelled.join(main, "token").distinct()


def _neighbours(chained: DataFrame, answers: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """For each node the nearest few, by signature, of those of other components that
    stand next to it when its lists are sorted by one word of the signatures, turned
    by some bits: a number of comparisons in proportion to the postings."""
    names = ["node", "size", "place", "label", *SIGNS]
    near = []
    for s in SIGNS:
        word = F.shiftleft(s, turn).bitwiseOR(F.shiftrightunsigned(s, 64 - turn)) if turn else F.col(s)
        by_word = Window.partitionBy("token").orderBy(word, "node")
        near += [F.lag(F.struct(*names), k + 1).over(by_word) for k in range(NEIGHBOURS)]
    met = _labelled(chained, answers).select(*names, F.array(*near).alias("near")).select(*names, F.explode("near").alias("b")).where("b is not null")
    met = met.select(*[F.col(c).alias(f"a_{c}") for c in names], *[F.col(f"b.{c}").alias(f"b_{c}") for c in names])
    met = met.where((F.col("a_label") != F.col("b_label")) & _fits("a_", "b_", num, den) & possible("a_", "b_", num, den))
    met = met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), apart("a_", "b_").alias("apart"))
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart")).distinct()
    best = both.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).where(F.col("k") <= NEAREST)
    return stage(_either(best).distinct(), "star")


def _across(mixed: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components whose blocks, places and
    signatures fit, once for each list that makes them.

    Two nodes meet in every list that they share.  A pair is left out of a list if
    one of the last listed shingles before it is among the other's too, as it met
    there, with more room: the first list that a pair shares always makes it."""
    by_place = Window.partitionBy("node").orderBy("place")
    earlier = [f"t{k}" for k in range(BEFORE)]
    rows = mixed.select("*", *[F.lag("token", k + 1).over(by_place).alias(c) for k, c in enumerate(earlier)])
    apart = rows.join(first.select("node", *SIGNS), "node")
    names = ["node", "size", "place", "label", *earlier, *SIGNS]
    minor = apart.where("label <> main").select("token", *[F.col(c).alias(f"x_{c}") for c in names], F.explode(_reachable(num, den)).alias("block")).select("*", "block.*").drop("block")
    other = apart.select("token", _band(F.col("size"), num, den).alias("band"), _back(F.col("size"), F.col("place"), num, den).alias("back"), "main", *[F.col(c).alias(f"y_{c}") for c in names])
    once = (F.col("y_label") == F.col("main")) | (F.col("x_node") < F.col("y_node"))
    fits = (F.col("x_label") != F.col("y_label")) & once & _fits("x_", "y_", num, den) & possible("x_", "y_", num, den) & ~_met("x_", "y_", earlier)
    cross = minor.join(other, ["token", "band", "back"]).where(fits)
    return cross.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def similar_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over
    links of similarity num / den or more) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    sets = stage(_sets(docs, n), "sets")
    rows = sets.where("part is null").select("doc_id", "key", "node", "size", *SIGNS)
    known = docs.where("doc_id is not null")
    same = _same(rows)
    listed = stage(_listed(_postings(known, n, num, den, _order(sets), same is not None)), "lists")
    release(spark)
    # documents of equal sets are one node, known by the first of them
    least = [F.min(c).alias(c) for c in ("size", *SIGNS)]
    first = stage(rows.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min_by("key", "doc_id").alias("key"), *least), "first")
    release(spark)
    # first each node against one pivot, a few times
    tries = stage(_tries(listed, num, den), "tries")
    release(spark)
    links, answers, tried = same, same and components(same), []
    for salt in range(ROUNDS):
        star = _pivots(tries.where(F.col("round") == salt), first, num, den, answers)
        release(spark)
        found = _verified(known, star, first, n, num, den)
        links = found if links is None else links.unionByName(found)
        answers = components(links)
        tried.append(star)
    unstage(tries)
    # then pairs that are still apart
    mixed = stage(_mixed(_labelled(listed, answers)), "mixed")
    unstage(listed)
    release(spark)
    # a list with many nodes outside its largest component would make pairs by the square of them
    posted = ["token", "node", "size", "place"]
    chained = stage(mixed.where(F.col("minors") > CHAIN).select(*posted).join(first.select("node", *SIGNS), "node"), "chained")
    if not chained.isEmpty():
        for k in range(CHAIN_ROUNDS):
            star = _neighbours(chained, answers, 21 * k, num, den)
            release(spark)
            links = links.unionByName(_verified(known, star, first, n, num, den))
            answers = components(links)
            tried.append(star)
        still = stage(_mixed(_labelled(mixed.select(*posted), answers)), "mixed")
        unstage(mixed)
        mixed = still
        release(spark)
    unstage(chained)
    compared = reduce(DataFrame.unionByName, [_either(star) for star in tried]).distinct()
    cross = _across(mixed, first, num, den).distinct().join(compared, ["a", "b"], "left_anti")
    close = stage(cross, "cross")
    unstage(mixed)
    release(spark)
    more = _verified(known, close, first, n, num, den)
    named = answers.join(first, "node").groupBy("label").agg(F.min("first").alias("least"))
    direct = first.join(answers, "node", "left").join(named, "label", "left").select("node", F.coalesce("least", "first").alias("component"))
    if not more.isEmpty():
        joined = more.join(direct.select(F.col("node").alias("a"), F.col("component").alias("u")), "a").join(direct.select(F.col("node").alias("b"), F.col("component").alias("v")), "b")
        merged = components(joined.select(F.col("u").alias("a"), F.col("v").alias("b")))
        direct = direct.join(merged, direct["component"] == merged["node"], "left").select(direct["node"], F.coalesce("label", "component").alias("component"))
    for table in (close, *tried):
        unstage(table)
    found = rows.select("doc_id", "node", "size").join(direct, "node", "left")
    return merge_repeated(found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def merge_repeated(found: DataFrame) -> DataFrame:
    """Rows of one doc_id in different components join them."""
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b"))
    pairs = found.join(repeated.where("a <> b"), "doc_id").select("a", F.col("component_id").alias("b"))
    if pairs.isEmpty():
        return found
    merged = components(pairs)
    return found.join(merged, found["component_id"] == merged["node"], "left").select("doc_id", "n_shingles", F.coalesce("label", "component_id").alias("component_id"))
