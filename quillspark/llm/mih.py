"""Multi-index hashing over binary codes: exact top-k, and approximate
neighbours through learned codes.

A code is split into 16-bit substrings, each with its own table.  By the
pigeonhole principle a code within distance r of a query has a substring within
r // m of the query's.  ``exact_topk`` grows the substring radius step by step
until the k-th verified distance is covered by what has been probed.
``nearest`` retrieves every code within one radius of learned, rotated codes
and reranks by the original vectors.

Each table is an array of offsets by substring value: a probe of radius r looks
up the query's substring under every mask of r bits, or, where the table holds
fewer values than there are masks, compares those values.

Rows with equal payloads are searched once and carry only the smallest k + 1
ids, which is exact: no other copy can be among k answers.  The rest is dealt to
shards, and distinct queries to blocks of as many as a task may hold; each
(shard, block) pair is one bounded task that indexes its shard, and the shards'
answers are merged by a window per query.  Rows are sent once per block, so up
to ``BLOCK_QUERIES`` distinct queries once.

Null vectors, vectors with null or non-finite components, zero vectors, and
vectors whose length isn't the table's most common one (ties: the shorter) take
no part.  Repeated ids count once, with the smallest payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stage

BITS = 16
#: Rows of a shard and distinct queries of a block at most: bounds of a task.
SHARD_ROWS = 1 << 16
BLOCK_QUERIES = 8192
#: Rows that make a shard worth a task of its own where partitions are free.
LEAST_ROWS = 1 << 11
#: Rows that rotations and the radius are learned from.
FIT_ROWS = 4096
#: Code length of ``nearest`` in rotations of the vector's length.
ROTATIONS = 4
#: Share of true neighbours in the sample that the radius must cover.
COVERED = 0.985


_values = np.arange(1 << BITS, dtype=np.uint16)
_weights = np.bitwise_count(_values)
#: All masks, by weight, and where each weight begins.
MASKS = _values[np.argsort(_weights, kind="stable")]
MASK_STARTS = np.concatenate([[0], np.cumsum(np.bincount(_weights, minlength=BITS + 1))])


class MultiIndex:
    """Tables over the substrings of codes, an array of n x bytes."""

    def __init__(self, codes: np.ndarray):
        width = -(-codes.shape[1] // 8) * 8
        padded = np.zeros((len(codes), width), np.uint8)
        padded[:, : codes.shape[1]] = codes
        self.n, self.words = len(codes), padded.view("<u8")
        self.used = -(-codes.shape[1] * 8 // BITS)
        self.parts = padded.view("<u2")[:, : self.used]
        self.order, self.values, self.offsets = [], [], []
        for j in range(self.used):
            sizes = np.bincount(self.parts[:, j], minlength=1 << BITS)
            self.order.append(np.argsort(self.parts[:, j], kind="stable"))
            self.values.append(np.flatnonzero(sizes).astype(np.uint16))
            self.offsets.append(np.concatenate([[0], np.cumsum(sizes)]))

    def query(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.zeros(self.words.shape[1] * 8, np.uint8)
        padded[: len(code)] = code
        return padded.view("<u8"), padded.view("<u2")[: self.used]

    def probe(self, part: np.ndarray, j: int, low: int, high: int) -> np.ndarray:
        """Rows whose j-th substring is ``low`` to ``high`` bits from the query's."""
        first, last = MASK_STARTS[low], MASK_STARTS[high + 1]
        if last - first < len(self.values[j]):
            values = part[j] ^ MASKS[first:last]
        else:
            away = np.bitwise_count(self.values[j] ^ part[j])
            values = self.values[j][(away >= low) & (away <= high)]
        at = values.astype(np.int64)
        starts, ends = self.offsets[j][at], self.offsets[j][at + 1]
        held = ends > starts
        starts, sizes = starts[held], (ends - starts)[held]
        if not len(sizes):
            return np.zeros(0, np.int64)
        rows = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return self.order[j][rows]

    def distance(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[rows] ^ words).sum(1).astype(np.int64)

    def nearest(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes up to the k-th nearest's distance."""
        words, part = self.query(code)
        seen = np.zeros(self.n, bool)
        rows, away = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(BITS + 1):
            for j in range(self.used):
                new = self.probe(part, j, radius, radius)
                new = new[~seen[new]]
                seen[new] = True
                rows, away = np.concatenate([rows, new]), np.concatenate([away, self.distance(words, new)])
                # tables 0..j at this radius: distances up to here are complete
                covered = self.used * radius + j
                if np.count_nonzero(away <= covered) >= k:
                    kth = np.partition(away, k - 1)[k - 1]
                    keep = away <= kth
                    return rows[keep], away[keep]
        return rows, away

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code at most ``radius`` bits away."""
        words, part = self.query(code)
        seen = np.zeros(self.n, bool)
        for j in range(self.used):
            seen[self.probe(part, j, 0, radius // self.used)] = True
        rows = np.flatnonzero(seen)
        return rows[self.distance(words, rows) <= radius]


def sign_codes(vectors: np.ndarray) -> np.ndarray:
    """A bit per component: whether it is above zero."""
    return np.packbits(vectors > 0, axis=1)


class LearnedCodes:
    """Signs of centred vectors under learned rotations (iterative
    quantisation from several random starts), and a search radius."""

    def __init__(self, sample: np.ndarray, k: int, rotations: int = ROTATIONS, rounds: int = 30):
        rng = np.random.default_rng(7)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        parts = []
        for _ in range(rotations):
            rotation = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.sign(centred @ rotation).T @ centred)
                rotation = (u @ v).T
            parts.append(rotation)
        self.rotation = np.hstack(parts)
        codes = self(sample)
        queries = np.arange(0, len(sample), max(1, len(sample) // 256))
        found = []
        words = MultiIndex(codes).words
        for q in queries:
            d = ((sample - sample[q]) ** 2).sum(1)
            d[q] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            found.append(np.bitwise_count(words[near] ^ words[q]).sum(1))
        found = np.sort(np.concatenate(found)) if found else np.zeros(0, int)
        self.radius = int(found[min(int(COVERED * len(found)), len(found) - 1)]) if len(found) else codes.shape[1] * 8

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0].n if lengths else 0))


def _search(rows: DataFrame, queries: DataFrame, k: int, kernel, score: str) -> DataFrame:
    """``rows`` (id, payload) against ``queries`` (id, payload): query_id, rank,
    vec_id and the score, nearest first, own ids left out."""
    spark = rows.sparkSession
    keep = k + 1
    salted = rows.groupBy("payload", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"))
    distinct = salted.groupBy("payload").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    distinct = stage(distinct.withColumn("key", F.xxhash64("payload")), "distinct")
    asked = queries.select("payload").distinct().withColumn("key", F.xxhash64("payload"))
    n_rows, n_asked = distinct.count(), asked.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n_rows // SHARD_ROWS), min(partitions, -(-n_rows // LEAST_ROWS)))
    blocks = max(1, -(-n_asked // BLOCK_QUERIES))
    rows_out = distinct.select(F.lit(0).alias("asks"), "payload", "ids", F.pmod(F.hash("key"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked_out = asked.select(F.lit(1).alias("asks"), "payload", F.lit(None).cast("array<long>").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.hash("key", F.lit(1)), F.lit(blocks)).alias("block"))
    kind = dict(distinct.dtypes)["payload"]

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        base, ask = frame[frame["asks"] == 0], frame[frame["asks"] == 1]
        payload, found, ids, scores = [], [], [], []
        if len(base) and len(ask):
            search = kernel(base["payload"].tolist(), k=keep)
            own = base["ids"].tolist()
            for q in ask["payload"].tolist():
                at, score_of = search(q)
                pairs = sorted((s, int(i)) for a, s in zip(at.tolist(), score_of.tolist()) for i in own[a])[:keep]
                payload += [q] * len(pairs)
                scores += [s for s, _ in pairs]
                ids += [i for _, i in pairs]
        return pd.DataFrame({"payload": payload, "vec_id": ids, "score": scores})

    found = rows_out.unionByName(asked_out).groupBy("shard", "block").applyInPandas(task, f"payload {kind}, vec_id long, score double")
    best = Window.partitionBy("payload").orderBy("score", "vec_id")
    merged = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).drop("place")
    # copies of a query share an answer list; each leaves out only itself
    answers = queries.select(F.col("id").alias("query_id"), "payload").join(merged, "payload").where("query_id <> vec_id")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").alias(score))


def exact_topk(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest sign codes of every query row by Hamming distance, exactly;
    ties to the smaller id.  Columns: query_id, rank, vec_id, distance."""
    rows = usable(vectors, id_column, vector_column)

    @F.pandas_udf("binary")
    def code(batch: pd.Series) -> pd.Series:
        return pd.Series([bytes(c) for c in sign_codes(np.stack(batch.tolist()))]) if len(batch) else pd.Series([], dtype=object)

    coded = rows.select("id", code("vector").alias("payload")).groupBy("id").agg(F.min("payload").alias("payload"))

    def kernel(payload: list, k: int):
        index = MultiIndex(np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1))
        return lambda q: index.nearest(np.frombuffer(q, np.uint8), min(k, index.n))

    found = _search(coded, coded.where(is_query(F.col("id"))), k, kernel, "distance")
    return found.withColumn("distance", F.col("distance").cast("int"))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """About the k nearest vectors by Euclidean distance of every query row.
    Columns: query_id, rank, vec_id, score (the distance in double precision).

    Rotations and radius are learned from at most ``FIT_ROWS`` rows chosen by a
    hash; every row is indexed.  A query with fewer than k codes in the radius
    widens it until it has them."""
    rows = usable(vectors, id_column, vector_column).groupBy("id").agg(F.min("vector").alias("payload"))
    sample = rows.dropDuplicates(["payload"]).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("payload").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = rows.sparkSession.sparkContext.broadcast(LearnedCodes(np.array([r.payload for r in sample]), k))

    def kernel(payload: list, k: int):
        data, learned = np.array(payload, np.float64), codes.value
        index = MultiIndex(learned(data))

        def search(q) -> tuple[np.ndarray, np.ndarray]:
            q = np.array(q, np.float64)
            code, radius = learned(q[None])[0], learned.radius
            at = index.within(code, radius)
            while len(at) < min(k, index.n):
                radius = radius + max(1, radius // 8)
                at = index.within(code, radius)
            away = np.sqrt(((data[at] - q) ** 2).sum(1))
            best = np.argsort(away, kind="stable")
            if len(best) > k:
                best = best[away[best] <= away[best[k - 1]]]
            return at[best], away[best]

        return search

    return _search(rows, rows.where(is_query(F.col("id"))), k, kernel, "score")
