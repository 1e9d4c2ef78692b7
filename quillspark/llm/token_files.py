"""Token-id files: patched frame-of-reference blocks with an index of starts.

A shard file is a header, a document table, an index of block starts, and the
blocks.  A block holds up to 256 ids: the block minimum is subtracted, every
difference is packed at the width that covers a chosen percentile of them, and
the upper bits of the rest go to an exception list of places and values.

Packing is lane-wise: value ``k`` of a block lies in lane ``k % 8``, and each
lane is a stream of ``ceil(32 * width / 32) = width`` 32-bit words.

Documents are range-partitioned by id, so shard order is document order.  Null
texts count as empty and still get their end id; repeated rows are all written,
ties ordered by text; an empty table writes one empty shard.  A shard is closed
at ``SHARD_IDS`` ids and goes on in a further file, so files, their writers and
their readers are bounded by that and one document.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .runtime import SharedFiles, stage_path

MAGIC = b"QPFR0001"
LANES, STEPS = 8, 32
BLOCK = LANES * STEPS
END_ID = 0
#: Share of a block's differences that its width must cover.
PERCENTILE = 0.90
#: Ids held before a shard part is packed; bounds a writer's memory.
FLUSH_IDS = 1 << 22
#: Ids after which a file is closed; packed, 64 MB or less of usual ids.
SHARD_IDS = 1 << 25


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks of whole ``ids`` (the last is padded with its own minimum) and the
    byte size of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.empty(n_blocks * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids):] = ids[(n_blocks - 1) * BLOCK:].min()
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(1)
    grid = grid - low[:, None]
    ranked = np.partition(grid, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    width = _bit_length(ranked)
    over = grid >> np.minimum(width, 31)[:, None]
    over[width == 32] = 0
    n_over = np.count_nonzero(over, axis=1).astype(np.int64)
    sizes = 8 + 4 * LANES * width.astype(np.int64) + 5 * n_over
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), np.uint8)
    head = np.zeros((n_blocks, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4] = width
    head[:, 5:7] = n_over.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[starts[:-1, None] + np.arange(8)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            mask = np.uint64((1 << int(w)) - 1)
            lanes = (grid[rows].astype(np.uint64) & mask).reshape(len(rows), STEPS, LANES)
            words = np.zeros((len(rows), int(w) + 1, LANES), np.uint64)
            for k in range(STEPS):
                word, shift = divmod(k * int(w), 32)
                value = lanes[:, k, :] << np.uint64(shift)
                words[:, word, :] |= value & np.uint64(0xFFFFFFFF)
                words[:, word + 1, :] |= value >> np.uint64(32)
            data = words[:, : int(w), :].astype("<u4").reshape(len(rows), -1).view(np.uint8)
            out[(starts[rows] + 8)[:, None] + np.arange(data.shape[1])] = data
    at_row, place = np.nonzero(over)
    if len(at_row):
        rank = np.arange(len(at_row)) - np.concatenate([[0], np.cumsum(n_over)])[at_row]
        base = starts[at_row] + 8 + 4 * LANES * width[at_row].astype(np.int64)
        out[base + rank] = place.astype(np.uint8)
        values = over[at_row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_over[at_row] + 4 * rank)[:, None] + np.arange(4)] = values
    return out.tobytes(), sizes


def unpack_blocks(data: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of consecutive blocks that begin at ``starts`` in ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4]
    n_over = np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    grid = np.zeros((len(starts), STEPS, LANES), np.uint32)
    for w in np.unique(width[width > 0]):
        rows, w = np.flatnonzero(width == w), int(w)
        raw = data[(starts[rows] + 8)[:, None] + np.arange(4 * LANES * w)]
        words = np.zeros((len(rows), w + 1, LANES), np.uint64)
        words[:, :w, :] = raw.view("<u4").reshape(len(rows), w, LANES)
        part = np.empty((len(rows), STEPS, LANES), np.uint32)
        mask = np.uint64((1 << w) - 1)
        for k in range(STEPS):
            word, shift = divmod(k * w, 32)
            part[:, k, :] = ((words[:, word, :] | words[:, word + 1, :] << np.uint64(32)) >> np.uint64(shift)) & mask
        grid[rows] = part
    grid = grid.reshape(len(starts), BLOCK)
    row = np.repeat(np.arange(len(starts)), n_over)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = starts[row] + 8 + 4 * LANES * width[row].astype(np.int64)
        place = data[base + rank]
        value = np.ascontiguousarray(data[(base + n_over[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        grid[row, place] |= value << width[row].astype(np.uint32)
    return (grid + low[:, None]).reshape(-1)[:n_ids]


class ShardWriter:
    """Gathers documents' ids and yields the parts of one shard file."""

    def __init__(self):
        self.doc_ids: list = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = 0
        self.parts: list[bytes] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= FLUSH_IDS:
            self._pack(last=False)

    def _pack(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        data, sizes = pack_blocks(ids[:whole])
        self.parts.append(data)
        self.sizes.append(sizes)
        self.n_ids += whole
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def chunks(self) -> Iterator[bytes]:
        self._pack(last=True)
        sizes = np.concatenate(self.sizes)
        yield MAGIC + struct.pack("<QQQ", len(self.doc_ids), self.n_ids, len(sizes))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        yield np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + known.tobytes() + np.array(self.lengths, "<u8").tobytes()
        yield (np.cumsum(sizes) - sizes).astype("<u8").tobytes()
        yield from self.parts


def read_shard(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids of a shard file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n_ids, n_blocks = struct.unpack("<QQQ", raw[8:32])
    at = 32
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    known = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    starts = np.frombuffer(raw, "<u8", n_blocks, at).astype(np.int64)
    data = np.frombuffer(raw, np.uint8, offset=at + 8 * n_blocks)
    out = np.empty(n_ids, np.uint32)
    for b in range(0, n_blocks, 1 << 14):
        e = min(b + (1 << 14), n_blocks)
        out[b * BLOCK: e * BLOCK] = unpack_blocks(data, starts[b:e], min(e * BLOCK, n_ids) - b * BLOCK)
    return [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, out


def read_document(raw: bytes, place: int) -> np.ndarray:
    """One document's ids from a shard file: only its blocks are unpacked."""
    n_docs, n_ids, n_blocks = struct.unpack("<QQQ", raw[8:32])
    lengths = np.frombuffer(raw, "<u8", n_docs, 32 + 9 * n_docs).astype(np.int64)
    begin = int(lengths[:place].sum())
    end = begin + int(lengths[place])
    at = 32 + 17 * n_docs
    starts = np.frombuffer(raw, "<u8", n_blocks, at).astype(np.int64)
    first, last = begin // BLOCK, -(-end // BLOCK)
    data = np.frombuffer(raw, np.uint8, offset=at + 8 * n_blocks)
    ids = unpack_blocks(data, starts[first:last], min(last * BLOCK, n_ids) - first * BLOCK)
    return ids[begin - first * BLOCK: end - first * BLOCK]


def write_token_files(docs: DataFrame, tokenizer: str, uri: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write every document's ids to shard files under ``uri`` in id order.

    Returns the manifest, a row per file: shard, part, file, n_docs, n_tokens.
    Files in order of (shard, part) hold the documents in order.
    """
    files = SharedFiles(uri)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, writer, encode = TaskContext.get().partitionId(), ShardWriter(), byte_bpe(tokenizer).encode
        end, part = np.array([END_ID], "<u4").tobytes(), 0

        def close() -> pd.DataFrame:
            name = f"shard-{shard:07d}-{part:07d}.pfor"
            files.write(name, writer.chunks())
            return pd.DataFrame({"shard": [shard], "part": [part], "file": [name], "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.n_ids]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                if writer.n_ids + writer.n_waiting >= shard_ids:
                    yield close()
                    writer, part = ShardWriter(), part + 1
                writer.add(None if pd.isna(doc_id) else int(doc_id), encode(text or "") + end)
        yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInPandas(write, "shard int, part int, file string, n_docs long, n_tokens long")


def read_token_files(spark, uri: str, starts: dict[str, int]) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``starts`` has each file's first global place; one entry a file.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                base = starts[path.rpartition("/")[2]]
                doc_ids, lengths, ids = read_shard(content)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": base + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(uri).select("path", "content")
    return files.mapInPandas(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, then read them back."""
    spark = docs.sparkSession
    uri = stage_path(spark, "tokens")
    manifest = sorted(write_token_files(docs, tokenizer, uri, shard_ids).collect())  # a row per file
    starts, total = {}, 0
    for row in manifest:
        starts[row.file] = total
        total += row.n_tokens
    SharedFiles(uri).write("manifest.json", [json.dumps([r.asDict() for r in manifest]).encode()])
    return read_token_files(spark, uri, starts)
