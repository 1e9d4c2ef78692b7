"""Removal of byte strings that occur more than once, by blockwise suffix ranks.

A byte goes if some string of ``length`` bytes that covers it also starts
anywhere else, in the same document or another.  What is needed of the suffix
array is only which suffixes agree on their first ``length`` bytes, so suffixes
are named, not ordered: a name is a 64-bit hash of a stretch of bytes, and equal
names fall into one bucket.  Buckets (ranges of names) are sorted one at a time,
each in its own bounded task.

1. Content-chosen samples: every stretch of ``GRAM`` bytes whose name ends in
   zero bits.  A start whose string holds a sample that occurs once can't be a
   repeat.  A bitmap of fixed size tells repeated samples; when it fills up it
   lets more starts through, and the exact steps below decide all the same.
2. Difference cover: places p with p mod ``PERIOD`` in the cover.  For any two
   places some shift below ``PERIOD`` takes both into the cover, so long ties
   are resolved by ranks of cover places alone: a cover place whose name over
   length + PERIOD - 1 bytes repeats settles PERIOD starts at once.
3. The starts left, near the ends of repeats, are named over ``length`` bytes.
   Their match may be a settled start, so settled starts that a second bitmap
   can't tell from one of theirs are named as well.

Only documents with a start that passes step 1 are kept as chunks in the shared
folder; each chunk sends a name once per bucket and gets a bit per name back, so
a string in a third of all rows costs a bucket one name per chunk.

Null text is empty; texts shorter than ``length`` keep all bytes; repeated rows
are documents of their own, so they remove each other; an empty table gives no
rows.  Texts are whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, stage

GRAM = 64
SAMPLE_BITS = 5
#: Bits of the bitmap of repeated samples: a bound on what is broadcast.
BITMAP_BITS = 27
#: Bytes of text in a chunk, and in a stretch whose samples are sent together.
CHUNK_BYTES = 4 << 20
SEND_BYTES = 32 << 20
#: Bytes of text whose names make one bucket.
BUCKET_TEXT = 256 << 20


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """A difference cover of 6r + 4 places and its period 24r^2 + 36r + 13, by
    the published rule of step lengths."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


PERIOD, COVER = difference_cover(1)
IN_COVER = np.isin(np.arange(PERIOD), COVER)

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            column = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            column[0] = 1
            _powers[k] = np.multiply.accumulate(column)
    return _powers[0], _powers[1]


class Names:
    """Names of stretches of one byte array, any start and length."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def _valid(bounds: np.ndarray, length: int) -> np.ndarray:
    """Which places start ``length`` bytes inside one document."""
    edge = np.zeros(bounds[-1] + 1, np.int32)
    begin, end = bounds[:-1], np.maximum(bounds[1:] - length + 1, bounds[:-1])
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def samples(names: Names, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the content-chosen samples."""
    places = np.flatnonzero(_valid(bounds, GRAM))
    h = names(places, GRAM)
    chosen = (h & np.uint64((1 << SAMPLE_BITS) - 1)) == 0
    return places[chosen], h[chosen]


def candidates(names: Names, bounds: np.ndarray, length: int, bitmap: np.ndarray) -> np.ndarray:
    """Starts whose string holds no sample that occurs once."""
    places, h = samples(names, bounds)
    single = places[~_marked(bitmap, h)]
    edge = np.zeros(bounds[-1] + 1, np.int32)
    np.add.at(edge, np.maximum(single + GRAM - length, 0), 1)
    np.add.at(edge, single + 1, -1)
    return _valid(bounds, length) & (np.cumsum(edge[:-1]) == 0)


def _named(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, whether each occurs twice, and their places."""
    distinct, back, counts = np.unique(values, return_inverse=True, return_counts=True)
    return distinct, counts > 1, back


def _by_bucket(values: np.ndarray, twice: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted names cut into buckets, ranges of their top bits."""
    edges = np.searchsorted(values, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits))
    edges = np.append(edges, len(values))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        yield b, values[part].tobytes(), np.packbits(twice[part]).tobytes()


def _repeats(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """One bucket: its names, whether each is a repeat, and the parts' sizes."""
    parts = [np.frombuffer(v, np.uint64) for v in frame["names"]]
    values = np.concatenate(parts)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)) for t, p in zip(frame["twice"], parts)]) > 0
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    equal = sorted_values[1:] == sorted_values[:-1]
    repeat = twice[order]
    repeat[1:] |= equal
    repeat[:-1] |= equal
    back = np.empty(len(values), bool)
    back[order] = repeat
    return values, back, [len(p) for p in parts]


def _texts(batches: Iterator[pd.DataFrame], least: int, most: int) -> Iterator[tuple[list, list[bytes], list]]:
    """Groups of documents of about ``most`` bytes: long and short ones apart.
    A document's id goes with its other columns, as one string."""
    ids, texts, short, size = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["rest"].tolist(), batch["text"].tolist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < least:
                short.append((doc_id, raw))
            else:
                if texts and size + len(raw) > most:
                    yield ids, texts, short
                    ids, texts, short, size = [], [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
    yield ids, texts, short


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _sample_bitmap(docs: DataFrame, length: int, bucket_bits: int) -> np.ndarray:
    """The bitmap of samples that occur more than once, over all documents."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0

        def flush() -> pd.DataFrame:
            values, twice, _ = _named(np.concatenate(waiting))
            return pd.DataFrame(list(_by_bucket(values, twice, bucket_bits)), columns=["bucket", "names", "twice"])

        for _, texts, _ in _texts(batches, length, CHUNK_BYTES):
            if not texts:
                continue
            data, bounds = _joined(texts)
            waiting.append(samples(Names(data), bounds)[1])
            size += len(data)
            if size >= SEND_BYTES:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()

    return _bitmap(docs.mapInPandas(send, "bucket int, names binary, twice binary"), bucket_bits, lambda values, repeat: values[repeat])


def _bitmap(sent: DataFrame, bucket_bits: int, chosen) -> np.ndarray:
    """The bitmap of chosen names of every bucket."""
    shift = np.uint64(64 - BITMAP_BITS)

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        values, repeat, _ = _repeats(frame)
        cell = np.unique((chosen(values, repeat) >> shift).astype(np.int64))
        first = int((np.uint64(frame["bucket"].iloc[0]) << np.uint64(64 - bucket_bits)) >> shift) >> 3
        bits = np.zeros(int(cell[-1] >> 3) - first + 1 if len(cell) else 0, np.uint8)
        np.bitwise_or.at(bits, (cell >> 3) - first, (1 << (cell & 7)).astype(np.uint8))
        return pd.DataFrame({"first": [first], "bits": [bits.tobytes()]})

    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    slices = sent.groupBy("bucket").applyInPandas(mark, "first long, bits binary")
    for r in slices.toLocalIterator():  # the fixed size of the bitmap in all
        part = np.frombuffer(r.bits, np.uint8)
        bitmap[r.first: r.first + len(part)] |= part
    return bitmap


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


CHUNKS = "chunk long, rest string, data binary, rests array<string>, bounds binary, starts binary, n_bytes long, sha256 string, text string"


def _chunks(docs: DataFrame, length: int, bitmap: np.ndarray, with_text: bool) -> DataFrame:
    """Documents with candidates, in chunks; a finished row for any other."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        for ids, texts, short in _texts(batches, length, CHUNK_BYTES):
            plain, kept_ids, kept, kept_starts = list(short), [], [], []
            if texts:
                data, bounds = _joined(texts)
                starts = candidates(Names(data), bounds, length, shipped.value)
                for doc_id, raw, a, b in zip(ids, texts, bounds[:-1].tolist(), bounds[1:].tolist()):
                    if starts[a:b].any():
                        kept_ids.append(doc_id)
                        kept.append(raw)
                        kept_starts.append(starts[a:b])
                    else:
                        plain.append((doc_id, raw))
            rows = [(None, d, None, None, None, None, len(raw), sha256(raw).hexdigest(), raw.decode("utf-8", "surrogatepass") if with_text else None) for d, raw in plain]
            if kept:
                data, bounds = _joined(kept)
                rows.append((number, None, data.tobytes(), kept_ids, bounds.tobytes(), np.packbits(np.concatenate(kept_starts)).tobytes(), len(data), None, None))
                number += 1
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"chunk": "Int64"})

    return docs.mapInPandas(run, CHUNKS)


class Chunk:
    """A chunk's bytes, names and candidate starts."""

    def __init__(self, data: bytes, bounds: bytes, starts: bytes, length: int):
        self.length = length
        self.data = np.frombuffer(data, np.uint8)
        self.bounds = np.frombuffer(bounds, np.int64)
        self.starts = np.unpackbits(np.frombuffer(starts, np.uint8), count=len(self.data)) > 0
        self.names = Names(self.data)

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover places whose next PERIOD starts are all candidates, and names."""
        runs = np.concatenate([[0], np.cumsum(self.starts)])
        offset = np.arange(len(self.data)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        fits = _valid(self.bounds, self.length + PERIOD - 1)
        places = np.flatnonzero(fits & IN_COVER[offset % PERIOD])
        places = places[runs[places + PERIOD] - runs[places] == PERIOD]
        return places, self.names(places, self.length + PERIOD - 1)

    def settle(self, places: np.ndarray) -> np.ndarray:
        """Starts that repeated cover places settle."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + PERIOD, -1)
        return np.cumsum(edge[:-1]) > 0

    def left(self, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(self.starts & ~settled)
        return places, self.names(places, self.length)


def _bits(answers) -> np.ndarray:
    """A chunk's bits over its distinct names in order, from all buckets."""
    if answers is None or not len(answers):
        return np.zeros(0, bool)
    ordered = sorted((a["bucket"], a["n"], a["bits"]) for a in answers)
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in ordered]) > 0


def _answers(sent: DataFrame, name: str) -> DataFrame:
    """Sort each bucket of names; per chunk, its buckets' answer bits."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        _, repeat, sizes = _repeats(frame)
        ends = np.cumsum(sizes)
        bits = [np.packbits(repeat[e - n: e]).tobytes() for e, n in zip(ends, sizes)]
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "n": sizes, "bits": bits})

    back = sent.groupBy("bucket").applyInPandas(task, "chunk long, bucket int, n int, bits binary").where("chunk is not null")
    return back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document;
    ``with_text`` adds the text that stays (a character cut in two goes).
    ``carry`` names other columns to keep beside doc_id; those named as the
    results are replaced."""
    results = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "text"}
    carried = ["doc_id", *(c for c in carry or [] if c not in results and c != "doc_id")]
    kinds = docs.select(*[F.col(f"`{c}`") for c in carried]).schema
    docs = docs.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in carried])).alias("rest"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = max(6, int(np.ceil(np.log2(max(total / BUCKET_TEXT, 1)))))
    staged = stage(_chunks(docs, length, _sample_bitmap(docs, length, bucket_bits), with_text), "chunks")
    release(docs.sparkSession)
    chunks = staged.where("chunk is not null").select("chunk", "data", "rests", "bounds", "starts")

    def send_cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                values, twice, _ = _named(Chunk(r.data, r.bounds, r.starts, length).cover()[1])
                rows = list(_by_bucket(values, twice, bucket_bits))
                yield pd.DataFrame(rows, columns=["bucket", "names", "twice"]).assign(chunk=r.chunk)[["chunk", "bucket", "names", "twice"]]

    def settled(chunk: Chunk, answers) -> np.ndarray:
        places, values = chunk.cover()
        bits = _bits(answers)
        return chunk.settle(places[bits[_named(values)[2]]] if len(bits) else places[:0])

    def send_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                chunk = Chunk(r.data, r.bounds, r.starts, length)
                values, twice, _ = _named(chunk.left(settled(chunk, r.cover))[1])
                rows = list(_by_bucket(values, twice, bucket_bits))
                yield pd.DataFrame(rows, columns=["bucket", "names", "twice"]).assign(chunk=r.chunk)[["chunk", "bucket", "names", "twice"]]

    def send_witnesses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                chunk = Chunk(r.data, r.bounds, r.starts, length)
                values = chunk.names(np.flatnonzero(settled(chunk, r.cover)), length)
                values, twice, _ = _named(values[_marked(open_names.value, values)])
                rows = list(_by_bucket(values, twice, bucket_bits))
                yield pd.DataFrame(rows, columns=["bucket", "names", "twice"]).assign(chunk=pd.array([None] * len(rows), "Int64"))[["chunk", "bucket", "names", "twice"]]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                chunk = Chunk(r.data, r.bounds, r.starts, length)
                repeated = settled(chunk, r.cover)
                places, values = chunk.left(repeated)
                bits = _bits(r.left)
                if len(bits):
                    repeated[places[bits[_named(values)[2]]]] = True
                edge = np.zeros(len(repeated) + length + 1, np.int32)
                at = np.flatnonzero(repeated)
                edge[at] += 1
                edge[at + length] -= 1
                gone = np.cumsum(edge)[: len(repeated)] > 0
                rows = []
                for k, (a, b) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist())):
                    own = gone[a:b]
                    kept = chunk.data[a:b][~own].tobytes()
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    rows.append((r.rests[k], b - a, int(own.sum()), spans, sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                yield pd.DataFrame(rows, columns=["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    names = "chunk long, bucket int, names binary, twice binary"
    cover = stage(_answers(chunks.mapInPandas(send_cover, names), "cover"), "cover")
    release(docs.sparkSession)
    with_cover = chunks.join(cover, "chunk", "left")
    sent = stage(with_cover.mapInPandas(send_left, names), "left")
    open_names = docs.sparkSession.sparkContext.broadcast(_bitmap(sent, bucket_bits, lambda values, repeat: values))
    left = _answers(sent.unionByName(with_cover.mapInPandas(send_witnesses, names)), "left")
    done = with_cover.join(left, "chunk", "left").mapInPandas(finish, "rest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    zero = F.lit(0).cast("long")
    plain = staged.where("chunk is null").select("rest", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"), "text")
    out = plain.unionByName(done).withColumn("rest", F.from_json("rest", kinds)).select("rest.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
    return out if with_text else out.drop("text")
