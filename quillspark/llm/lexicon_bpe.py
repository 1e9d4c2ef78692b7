"""Word-end BPE through a minimal acyclic transducer of frequent words.

``frequent_words`` counts the words of all documents.  The top ones, with their
exact ids, become a minimal acyclic automaton: common prefixes and suffixes are
shared, every arc carries a number, and the sum of the numbers on a word's path
is its place in the table of ids.  The automaton is laid out as flat arrays, one
file, which workers memory-map.  Words outside it are merged exactly by rank.

Special tokens' strings in a text are their ids, as the tokenizers library has
it; null text is empty; decoding joins token strings by a space, which is what
that library does for a vocabulary without a decoder.
"""

from __future__ import annotations

import json
import os
import tempfile
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet
from .runtime import stage, unstage

#: The vocabulary's word pattern and word-end mark.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Words compiled into the automaton; a bound on its size, not on the corpus.
LEXICON_WORDS = 50_000
#: Entries kept per worker before the memo is emptied; bounds memory only.
MEMO_ENTRIES = 400_000


NO_PAIR = 1 << 60
#: Words of more bytes are merged one at a time.
LONG_WORD = 80


class Vocabulary:
    """Ids, token strings, merges and normalisation of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in {**self.ids, **self.specials}.items()}
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pair_keys = np.array(sorted((a << 32) | b for a, b in self.ranks), np.int64)
        found = [self.ranks[k >> 32, k & 0xFFFFFFFF] for k in self.pair_keys.tolist()]
        self.pair_ranks = np.array([r for r, _ in found] + [NO_PAIR], np.int64)
        self.merged = np.zeros(len(found) + 1, np.int64)
        self.merged[[r for r, _ in found]] = [i for _, i in found]
        self.stand_in = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]
        self.byte_ids = [self.ids[c] for c in self.stand_in]
        self.end_ids = [self.ids[c + WORD_END] for c in self.stand_in]
        self.pattern = regex.compile(WORD)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self._normalizer = None

    def normalise(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        if max(chunk) < "ɐ" and "İ" not in chunk:
            return unicodedata.normalize("NFC", chunk).lower()
        if self._normalizer is None:
            from tokenizers import Tokenizer

            self._normalizer = Tokenizer.from_file(self.path).normalizer
        return self._normalizer.normalize_str(chunk)

    def symbols(self, word: bytes) -> list[int]:
        return [self.byte_ids[b] for b in word[:-1]] + [self.end_ids[word[-1]]]

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of a word: the lowest-ranked pair is merged, leftmost first.

        Symbols form a linked list and pairs wait in a heap of (rank, place), so
        the work is n log n in the word's bytes; a waiting pair whose symbols have
        changed since is passed over.
        """
        ids, ranks = self.symbols(word), self.ranks
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        waiting = [(found[0], at) for at, p in enumerate(zip(ids, ids[1:])) if (found := ranks.get(p))]
        heapify(waiting)
        while waiting:
            rank, at = heappop(waiting)
            right = after[at]
            found = ranks.get((ids[at], ids[right])) if right < end else None
            if found is None or found[0] != rank:
                continue
            ids[at], ids[right] = found[1], -1
            after[at] = right = after[right]
            if right < end:
                before[right] = at
                if found := ranks.get((ids[at], ids[right])):
                    heappush(waiting, (found[0], at))
            if (left := before[at]) >= 0 and (found := ranks.get((ids[left], ids[at]))):
                heappush(waiting, (found[0], left))
        return [i for i in ids if i >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key
        return self.pair_ranks[np.where(hit, at, len(self.pair_keys))]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words, one merge of every word a step."""
        out: list[list[int]] = [[]] * len(words)
        for k in [k for k, w in enumerate(words) if len(w) > LONG_WORD]:
            out[k] = self.merge(words[k])
        order = sorted((k for k, w in enumerate(words) if len(w) <= LONG_WORD), key=lambda k: len(words[k]))
        for begin in range(0, len(order), 8192):
            part = order[begin: begin + 8192]
            widest = len(words[part[-1]])
            ids = np.full((len(part), widest), -1, np.int64)
            for row, k in enumerate(part):
                ids[row, : len(words[k])] = self.symbols(words[k])
            ranks = np.where(ids[:, 1:] >= 0, self._rank(ids[:, :-1], np.maximum(ids[:, 1:], 0)), NO_PAIR)
            rows, places = np.arange(len(part)), np.arange(widest)
            while ranks.shape[1]:
                best = ranks[rows].min(1)
                rows, best = rows[best < NO_PAIR], best[best < NO_PAIR]
                if not len(rows):
                    break
                own = ranks[rows]
                at = own.argmin(1)
                shift = places + (places > at[:, None])
                now = np.take_along_axis(np.pad(ids[rows], ((0, 0), (0, 1)), constant_values=-1), shift, 1)
                k = np.arange(len(rows))
                now[k, at] = self.merged[best]
                own = np.take_along_axis(np.pad(own, ((0, 0), (0, 1)), constant_values=NO_PAIR), places[:-1] + (places[:-1] >= at[:, None]), 1)
                before = at > 0
                own[k[before], at[before] - 1] = self._rank(now[k[before], at[before] - 1], now[k[before], at[before]])
                after = at + 1 < widest
                follow = np.where(after, now[k, np.minimum(at + 1, widest - 1)], -1)
                after &= follow >= 0
                own[k[after], at[after]] = self._rank(now[k[after], at[after]], follow[after])
                ids[rows], ranks[rows] = now, own
            for k, own in zip(part, ids.tolist()):
                out[k] = own[: own.index(-1)] if own[-1] < 0 else own
        return out


def build_automaton(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of distinct words as flat arrays.

    Sorted words are added one by one; a finished suffix is replaced by an equal
    state that is already registered.  States are stored as runs of arcs sorted
    by byte: ``first[s]`` to ``first[s + 1]``.  ``skip`` on an arc counts the
    words that sort before those behind it, so a path's sum numbers the word.
    """
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    labels: list[int] = []
    previous = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            path[-2][1].append((labels.pop(), freeze(path.pop())))

    for word in sorted(set(words)):
        shared = 0
        while shared < min(len(previous), len(word)) and previous[shared] == word[shared]:
            shared += 1
        close(shared)
        for b in word[shared:]:
            path.append([False, []])
            labels.append(b)
        path[-1][0] = True
        previous = word
    close(0)
    root = freeze(path[0])
    words_in = np.zeros(len(arcs_of), np.int64)
    first, label, target, skip = [0], [], [], []
    for s, (final, arcs) in enumerate(arcs_of):  # a state's targets precede it
        n = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(n)
            n += int(words_in[t])
        words_in[s] = n
        first.append(len(label))
    return {
        "first": np.array(first, np.int64), "label": np.array(label, np.int64), "target": np.array(target, np.int64),
        "skip": np.array(skip, np.int64), "final": np.array([a[0] for a in arcs_of], np.int64), "root": np.array([root], np.int64),
    }


class Lexicon:
    """Words with id outputs in one memory-mapped file."""

    PARTS = ("first", "label", "target", "skip", "final", "root", "id_starts", "ids")

    @classmethod
    def compile(cls, words: Iterable[bytes], vocabulary: Vocabulary) -> bytes:
        words = sorted(set(words))
        parts = build_automaton(words)
        outputs = vocabulary.merge_all(words)
        parts["id_starts"] = np.cumsum([0, *map(len, outputs)], dtype=np.int64)
        parts["ids"] = np.array([i for o in outputs for i in o], np.int64)
        sizes = np.array([len(parts[p]) for p in cls.PARTS], "<i8")
        return sizes.tobytes() + b"".join(parts[p].astype("<i4").tobytes() for p in cls.PARTS)

    def __init__(self, path: str):
        flat = np.memmap(path, "<i4", "r")
        sizes = flat[: 2 * len(self.PARTS)].view("<i8")
        at = 2 * len(self.PARTS)
        for name, size in zip(self.PARTS, sizes.tolist()):
            setattr(self, name, np.asarray(flat[at: at + size]))
            at += size
        states = len(self.first) - 1
        # arcs in order of (state, byte): one search finds an arc
        self.keys = np.repeat(np.arange(states), np.diff(self.first)) * 256 + self.label

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 where it isn't in the lexicon; all at once."""
        number = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return number
        length = np.array(list(map(len, words)), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        live, state, total = np.arange(len(words)), np.full(len(words), int(self.root[0])), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            done = length[live] == depth
            ended = live[done]
            number[ended] = np.where(self.final[state[done]] == 1, total[done], -1)
            live, state, total = live[~done], state[~done], total[~done]
            key = state * 256 + data[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            live, arc = live[found], arc[found]
            state, total = self.target[arc].astype(np.int64), total[found] + self.skip[arc]
            depth += 1
        return number

    def output(self, number: int) -> list[int]:
        starts = self.id_starts
        return self.ids[starts[number]: starts[number + 1]].tolist()


class LexiconBpe:
    """Encoder and decoder of a worker: automaton first, exact merges after."""

    def __init__(self, path: str, compiled: bytes):
        self.vocabulary = Vocabulary(path)
        handle, name = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as f:
            f.write(compiled)
        self.lexicon = Lexicon(name)
        os.unlink(name)  # the mapping stays; nothing is left in the folder
        self.memo: dict[str, tuple[bytes, str]] = {}

    def _learn(self, chunks: list[str]) -> None:
        vocabulary, words_of = self.vocabulary, []
        for chunk in chunks:
            words_of.append([w.encode() for w in vocabulary.pattern.findall(vocabulary.normalise(chunk))])
        distinct = list({w for ws in words_of for w in ws})
        number, strings = self.lexicon.look_up(distinct).tolist(), vocabulary.strings
        ids = {w: self.lexicon.output(n) for w, n in zip(distinct, number) if n >= 0}
        unseen = [w for w, n in zip(distinct, number) if n < 0]
        ids.update(zip(unseen, vocabulary.merge_all(unseen)))
        for chunk, ws in zip(chunks, words_of):
            own = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            self.memo[chunk] = (array("I", own).tobytes(), " ".join([strings[i] for i in own]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Each text's ids as bytes, and its decoded text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        special = self.vocabulary.specials
        split = [[p for p in self.vocabulary.special_pattern.split(t)] if "<|" in t else [t] for t in texts]
        chunks = [[[p] if p in special else self._chunks(p) for p in parts] for parts in split]
        new = {c for parts in chunks for cs in parts for c in cs}.difference(self.memo)
        self._learn([c for c in new if c not in special])
        for s, i in special.items():
            self.memo[s] = (array("I", [i]).tobytes(), s)
        memo = self.memo
        for parts in chunks:
            found = [memo[c] for cs in parts for c in cs]
            yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])

    @staticmethod
    def _chunks(text: str) -> list[str]:
        # the vocabulary's white space: str.split() also cuts at four controls
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.split(r"\s+", text)
        return text.split()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.vocabulary.strings[i] for i in ids)


_worker: dict[tuple[str, str], LexiconBpe] = {}


def _cut(rows: list, most: int) -> tuple[int, int]:
    """The first of the ordered (place, n) rows that doesn't fit into ``most``
    whole, and what is left for it; past the last place if all fit."""
    for place, n in rows:
        if n > most:
            return place, most
        most -= n
    return (rows[-1][0] + 1 if rows else 0), 0


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words over all documents: a top-k report of bounded size.

    Counting is a map-side aggregate in the JVM; words are cut the way English and
    most other text is, and the exact path covers the rest.  Two small histograms,
    of counts on a scale of 64 steps a doubling and, at the step that doesn't fit
    whole, of a hash, say where to stop, so the driver is sent the chosen words
    and at most one hash value's more.  Counts of one step (equal ones up to 64)
    are ties, taken by hash.
    """
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = found.groupBy("word").count().where("count > 1")
    step = -F.floor(F.log2("count") * 64).cast("int")
    counted = stage(counted.select("word", step.alias("step"), F.pmod(F.xxhash64("word"), F.lit(1 << 16)).cast("int").alias("part")), "words")
    last, left = _cut(sorted(tuple(r) for r in counted.groupBy("step").count().collect()), words)
    at_last = counted.where(F.col("step") == last)
    stop, _ = _cut(sorted(tuple(r) for r in at_last.groupBy("part").count().collect()), left)
    chosen = counted.where((F.col("step") < last) | ((F.col("step") == last) & (F.col("part") <= stop))).collect()
    unstage(counted)
    return [r.word.encode() for r in sorted(chosen, key=lambda r: (r.step, r.part, r.word))[:words]]


def encode_decode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Ids and decoded text of each document: doc_id, n_tokens, ids, decoded.

    Repeated rows each give a row; an empty table gives none.
    """
    return _run(docs, path, lexicon_words, "doc_id long, n_tokens long, ids binary, decoded string", lambda doc_id, ids, text: (doc_id, len(ids) // 4, ids, text))


def digests(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """As ``encode_decode`` with digests in place of ids and text."""
    return _run(docs, path, lexicon_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda doc_id, ids, text: (doc_id, len(ids) // 4, sha256(ids).hexdigest(), sha256(text.encode()).hexdigest()))


def _run(docs: DataFrame, path: str, lexicon_words: int, schema: str, row) -> DataFrame:
    compiled = Lexicon.compile(frequent_words(docs, lexicon_words), Vocabulary(path))
    shipped = docs.sparkSession.sparkContext.broadcast(compiled)
    key, columns = (path, sha256(compiled).hexdigest()), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = LexiconBpe(path, shipped.value)
        encoder = _worker[key]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at: at + 500]
                texts = [t or "" for t in part["text"].tolist()]
                rows = [row(d, *found) for d, found in zip(part["doc_id"].tolist(), encoder.encode_all(texts))]
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
