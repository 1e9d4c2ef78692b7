"""Byte-level BPE ids for whole texts, memoised by space-delimited chunk.

A single space between two non-spaces always starts a new pre-token, so a text
without longer white-space runs can be cut there and each distinct chunk needs
encoding once per worker.  Any other text is pre-tokenised as a whole.  The memo is keyed by what follows the space.  Texts
holding a special token's string go to the tokenizers library unchanged.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
import tiktoken

#: The pre-token pattern of the byte-level BPE vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries kept per worker before the memo is emptied; bounds memory only.
MEMO_ENTRIES = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    spare = 256
    for b in range(256):
        if b not in keep:
            table[chr(spare)] = b
            spare += 1
    return table


class _Memo(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        ids = self[chunk] = self.encode(chunk)
        return ids


class ByteBpe:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    #: What makes a text's white space need the whole pattern: every space
    #: character but the plain space and newline, and runs that hold a space.
    _odd_space = [chr(c) for c in range(0x3001) if (chr(c).isspace() or regex.match(r"\s", chr(c))) and c not in (10, 32)] + ["  ", " \n", "\n "]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, alphabet = path, byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(PRETOKEN)
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PRETOKEN, mergeable_ranks={t: i for t, i in vocab.items() if t.decode("latin-1") not in self.special}, special_tokens={})
        self.memo = _Memo(lambda after_space: self._chunk(" " + after_space))
        self._library = None

    def _chunk(self, chunk: str) -> bytes:
        core = self.core._core_bpe
        ids = core.encode_single_piece(chunk.encode()) if chunk[1:].isalpha() and chunk[0] == " " else core.encode_ordinary(chunk)
        return array("I", ids).tobytes()

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def encode(self, text: str) -> bytes:
        if "<" in text and any(s in text for s in self.special):
            return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if text[:1] == " " or any(s in text for s in self._odd_space):
            return self._chunk(text)
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.memo.__getitem__, rest))


_cached: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    if path not in _cached:
        _cached[path] = ByteBpe(path)
    return _cached[path]
