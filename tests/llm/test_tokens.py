"""Tokenizer paths, token files, packing and lexicon BPE against the library."""

import random
import time
from array import array
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import lexicon_bpe, packing, token_files
from quillspark.llm.byte_bpe import byte_bpe
from quillspark.llm.registry import BYTE_BPE, WORD_BPE
from quillspark.llm.runtime import stage_path

ODD = [
    "", " ", "  a", "a   b", "a\n b", "x  \ny", " \n\n z", "tab\tq", "it's I'll'd", "<|endoftext|> a<|startoftext|>", "é à", "日本 語 12345", "a \x1c b", "é e",
    "İSTANBUL ΣΑΣ", "😀 ﬁ x y", "!!! ... ---", "word " * 300, "x" * 5000, "ThiS\r\nthat\x0bq",
]
SCHEMA = "doc_id long, text string, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA)


def test_byte_bpe_equals_library():
    library, own = Tokenizer.from_file(BYTE_BPE), byte_bpe(BYTE_BPE)
    for text in ODD:
        assert own.encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000, 70000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50257, n).astype(np.uint32)
    ids[: n // 3] = 7
    ids[n // 2: n // 2 + 3] = 2**32 - 1
    data, sizes = token_files.pack_blocks(ids)
    assert (token_files.unpack_blocks(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, n) == ids).all()


def test_files_round_trip_and_random_access(spark):
    texts = [*ODD, None]
    library = Tokenizer.from_file(BYTE_BPE)
    found = sorted(token_files.token_files(frame(spark, texts), BYTE_BPE).collect())
    at = 0
    for row, text in zip(found, texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens) == (at, len(ids))
        assert row.ids_crc32 == __import__("zlib").crc32(array("I", ids).tobytes())
        at += len(ids)
    writer = token_files.ShardWriter()
    for k, text in enumerate(texts):
        writer.add(k, byte_bpe(BYTE_BPE).encode(text or ""))
    raw = b"".join(writer.chunks())
    for k, text in enumerate(texts):
        assert token_files.read_document(raw, k).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_small_files_hold_the_same_documents(spark):
    texts = [*ODD, None, *ODD]
    whole = sorted(token_files.token_files(frame(spark, texts), BYTE_BPE).collect())
    assert sorted(token_files.token_files(frame(spark, texts), BYTE_BPE, shard_ids=5).collect()) == whole
    uri = stage_path(spark, "small")
    manifest = token_files.write_token_files(frame(spark, texts), BYTE_BPE, uri, shard_ids=5).collect()
    assert len(manifest) > len(texts) // 5 and sum(r.n_docs for r in manifest) == len(texts)
    assert all(r.n_docs <= 5 for r in manifest)


def test_files_of_empty_table_and_repeated_rows(spark):
    assert token_files.token_files(frame(spark, []), BYTE_BPE).count() == 0
    twice = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, "b", 0)], SCHEMA)
    assert sorted((r.start, r.n_tokens) for r in token_files.token_files(twice, BYTE_BPE).collect()) == [(0, 2), (2, 2), (4, 2)]


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for capacity, n in [(10, 50), (64, 500), (2048, 3000)]:
        histogram = defaultdict(int)
        for _ in range(n):
            histogram[rng.randint(1, capacity)] += 1
        used = defaultdict(int)
        for shape, times in packing.plan(dict(histogram), capacity):
            assert sum(shape) <= capacity and times > 0
            for length in shape:
                used[length] += times
        assert used == histogram


def test_two_smaller_pieces_replace_the_smallest():
    # greedy: 6 + 3 leaves 1; 3 gives way to 2 + 2, which fill the bin
    shapes = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert shapes[0] == ([6, 2, 2], 1)


def test_pack_is_gapless_and_whole(spark):
    texts = [*ODD, None, *ODD, "the quick brown fox " * 200]
    found = packing.pack(frame(spark, texts), BYTE_BPE, capacity=64).toPandas()
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 64
    for k, own in found.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own["length"].sum() == len(byte_bpe(BYTE_BPE).encode(texts[k] or "")) // 4 + 1
        assert (own["start"] == own["length"].cumsum() - own["length"]).all() and (own["length"].iloc[1:] == 64).all()
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 64) + 1
    assert packing.pack(frame(spark, []), BYTE_BPE).count() == 0


def test_automaton_numbers_words_and_shares_suffixes(tmp_path):
    words = sorted({w.encode() for w in "stop stops top tops tap taps a".split()})
    parts = lexicon_bpe.build_automaton(words)
    trie = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(parts["final"]) < len(trie)  # fewer states than a trie has
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon_bpe.Lexicon.compile(words, lexicon_bpe.Vocabulary(WORD_BPE)))
    lexicon = lexicon_bpe.Lexicon(str(path))
    assert lexicon.look_up(words).tolist() == list(range(len(words)))
    assert lexicon.look_up([b"", b"sto", b"stopss", b"zz"]).tolist() == [-1] * 4


def test_merges_equal_library():
    vocabulary, library = lexicon_bpe.Vocabulary(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["a" * 200]
    expected = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert vocabulary.merge_all([w.encode() for w in words]) == expected
    assert [vocabulary.merge(w.encode()) for w in words] == expected


def test_very_long_word_merges_in_near_linear_time():
    vocabulary, library = lexicon_bpe.Vocabulary(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(6)
    mixed = "".join(rng.choice("etaoinshrdluab") for _ in range(30_000))
    for word in (mixed, "a" * 30_000, "ab" * 10_000):
        assert vocabulary.merge_all([b"the", word.encode()])[1] == library.encode(word, add_special_tokens=False).ids
    began = time.process_time()
    vocabulary.merge((mixed * 10).encode())
    assert time.process_time() - began < 20  # the square of 300,000 letters takes many minutes


def test_frequent_words_by_count(spark):
    texts = [f"w{'abcdefghij'[k]} " * (k + 2) for k in range(10)] + ["once", None, ""]
    ranked = [f"w{c}".encode() for c in "jihgfedcba"]
    for most in (0, 1, 4, 10, 50):
        assert lexicon_bpe.frequent_words(frame(spark, texts), most) == ranked[:most]
    ties = frame(spark, [f"{a}{b} {a}{b}" for a in "abcdefgh" for b in "abcdefgh"])
    found = lexicon_bpe.frequent_words(ties, 20)
    assert len(set(found)) == 20 and found == lexicon_bpe.frequent_words(ties, 64)[:20]
    assert lexicon_bpe.frequent_words(frame(spark, [])) == []


def test_encode_decode_equals_library(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, None, "the and of the and of"]
    for row in lexicon_bpe.encode_decode(frame(spark, texts), WORD_BPE, lexicon_words=10).collect():
        encoded = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert bytes(row.ids) == array("I", encoded).tobytes()
        assert row.decoded == library.decode(encoded, skip_special_tokens=False)
    assert lexicon_bpe.digests(frame(spark, []), WORD_BPE).count() == 0
