"""Token ids of texts under a tokenizer that drops white space and ignores case: each distinct word is encoded once.

The vocabulary's pre-tokenizer removes white space and never joins a letter to a sign, so a batch of texts is cut at
blanks, tabs, line ends, and between an ASCII letter and another ASCII character. The words are numbered and the library encodes
only those not met before. Not cut, and left to the library as they are: what is beside an apostrophe (contractions), beside ``<``, ``|``, ``>`` or an
underscore (special tokens), and beside characters beyond ASCII, which may join those before them. ASCII letters are lowered first for the same
reason only before ASCII, and not at all in a batch with the start of a special token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

# Bytes cut into words at once; words and ids that are kept before all are let go.
PIECE_BYTES = 8 << 20
KEPT_WORDS = 1 << 20
KEPT_IDS = 1 << 23

_BLANK = re.compile(rb"[ \t\n\r]")
_SPECIAL = b"<|"


def _bytes(chosen: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen.encode())] = True
    return table


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_SIGN = ~_LETTER & ~_bytes(" \t\n\r'<|>_") & (np.arange(256) < 128)
# The kind of a byte: inside a word, a letter, a sign, a capital, beyond ASCII.
_KIND = (~_bytes(" \t\n\r") + 2 * _LETTER + 4 * _SIGN + 8 * _UPPER + 16 * (np.arange(256) > 127)).astype(np.uint8)
# Words of letters alone that are handed to the library as one text. Letters of Latin-1 are whole characters, so nothing joins them.
JOINED = 32
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordEncoder:
    """The ids of a tokenizers file, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        # Where the vocabulary marks ends of words, words of letters can share a text and be told apart again.
        suffix = getattr(self._library.model, "end_of_word_suffix", None)
        vocabulary = self._library.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self._ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _library_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end, and how many each has."""
        found = [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters."""
        if self._ends.any():
            joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            flat, _ = self._library_ids(joined)
            upto = np.flatnonzero(self._ends[flat]) + 1
            if len(upto) == len(words):
                return flat, np.diff(upto, prepend=0)
        return self._library_ids(words)

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids = np.empty(0, np.uint32)
        self._upto = np.zeros(1, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of some words; new ones are encoded."""
        if len(self._number) > KEPT_WORDS or len(self._ids) > KEPT_IDS:
            self._forget()
        number = self._number
        new = [w for w in words if w not in number]
        if new:
            plain = [w for w in new if _LETTERS.fullmatch(w)]
            others = [w for w in new if not _LETTERS.fullmatch(w)]
            number.update(zip(plain + others, range(len(number), len(number) + len(new)), strict=True))
            (one, one_sizes), (two, two_sizes) = self._word_ids(plain), self._library_ids(others)
            sizes = np.concatenate((one_sizes, two_sizes))
            self._ids = np.concatenate((self._ids, one, two))
            self._upto = np.concatenate((self._upto, self._upto[-1] + np.cumsum(sizes)))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def _encode(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many of them stand before each text's end."""
        raw = np.frombuffer(data, np.uint8)
        kind = _KIND[raw]
        inside = (kind & 1).view(bool)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | ((kind[1:] ^ kind[:-1]) & 6 == 6)
        begins = ends[:-1][ends[:-1] < len(raw)]
        starts[begins] = inside[begins]
        first = np.flatnonzero(starts)
        if not len(first):
            return np.empty(0, np.uint32), np.zeros(len(ends), np.int64)
        if _SPECIAL not in data:
            low = kind & 8
            low[:-1] &= ~(kind[1:] >> 1)
            raw = raw + (low << 2)
        solid = raw if inside.all() else raw[inside]
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[first] - np.int32(1), np.int32(len(solid)))
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(solid)).dictionary_encode()
        number = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist()).astype(np.int32)[words.indices.to_numpy()]
        base = self._upto[number].astype(np.int32)
        lengths = self._upto[number + 1].astype(np.int32) - base
        upto = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        at = np.repeat(base - upto[:-1].astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self._ids[at], upto[np.searchsorted(first, ends)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; memory is bounded by PIECE_BYTES and one text's ids."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if held and size + len(data) > PIECE_BYTES:
                yield from self._group(held)
                held, size = [], 0
            if len(data) > PIECE_BYTES:
                yield self._long(data)
            else:
                held.append(data)
                size += len(data)
                continue
        if held:
            yield from self._group(held)

    def _group(self, held: list[bytes]) -> Iterator[np.ndarray]:
        ends = np.concatenate(([0], np.cumsum([len(d) for d in held])))
        ids, upto = self._encode(b"".join(held), ends)
        for start, end in zip(upto[:-1], upto[1:], strict=True):
            yield ids[start:end]

    def _long(self, data: bytes) -> np.ndarray:
        """A text beyond PIECE_BYTES, cut at blanks; a stretch without any stays whole."""
        parts, start = [], 0
        while start < len(data):
            found = _BLANK.search(data, min(len(data), start + PIECE_BYTES))
            end = found.end() if found else len(data)
            parts.append(self._encode(data[start:end], np.array([0, end - start]))[0])
            start = end
        return np.concatenate(parts)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps its words for the tasks that follow."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
