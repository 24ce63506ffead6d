"""Byte-level BPE by a deterministic token automaton compiled from the merge list.

**Compilation.** The automaton reads tokens. It starts with one state per byte in
which every byte may follow every byte. The merges are then applied in order of
priority, each as one gadget. Merging (u, v) into w

* removes the arc from u's state to v: u followed by v is never left standing;
* adds a state for w whose arcs are those v's state has at that moment;
* adds an arc labelled w to each state that still has an arc labelled u.

A merge whose arc from u to v does not stand any more, or never did, has no gadget: an earlier merge has always
taken one of its parts before. A list that names a merge before those that make its parts is refused.

After the last gadget the paths of the automaton are exactly the token sequences
that applying the merges in order can produce, and each byte string has one path. A gadget
differs from the automaton before it in one removed arc and copied rows and
columns, so it is stored as that difference: two parents per state and one removed
arc. Looking an arc up follows the parents back in time, and is memoised.

**Encoding.** Beginnings of paths are paths, so each beginning of a word has one path too, and a last token. A word is
read byte by byte along a second table, of the labels' beginnings with links to their longest ends, which names the tokens
that end at a byte, longest first. Exactly one of them has an arc from the last token of the path before it: that
is the transition. Nothing is read twice or taken back; at the end the last tokens give the path.
**Decoding** concatenates the labels of the arcs.

Nulls count as empty text. Rows come out one for one: ties, repeated rows and ids stay,
an empty table gives an empty table, and other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import releasing

# Fixed value: how byte-level BPE splits text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same for text that is all ASCII.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

# Encoded words, in two generations, and looked-up arcs that a Python worker keeps: some 150 MB.
KEPT_WORDS = 240_000
KEPT_ARCS = 300_000
# Rows encoded or decoded at once.
ROWS = 500


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the other bytes take
    the code points from 256 on in order.
    """
    symbols, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            symbols[chr(byte)] = byte
        else:
            symbols[chr(spare)] = byte
            spare += 1
    return symbols


class MergeAutomaton:
    """The token automaton of a merge list; states are numbered by the token last read."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """``labels``: the bytes of each token; ``merges``: (u, v, w) by priority."""
        self.labels = labels
        self.start = -1
        size = max(labels) + 1
        self.born = [-1] * size  # the gadget that made a state; bytes are there from the beginning
        self.first = [-1] * size  # whose incoming arcs it copies
        self.last = [-1] * size  # whose outgoing arcs it copies
        self.removed_at: dict[int, int] = {}
        self._gadgets = len(merges)
        self._arcs: dict[int, bool] = {}
        named: set[int] = set()  # parts that no merge before had made
        for at, (u, v, w) in enumerate(merges):
            missing = [t for t in (u, v) if len(labels[t]) > 1 and self.first[t] < 0]
            named.update(missing)
            if missing or not self._lookup(u, v, at):
                continue
            if w in named:
                raise ValueError(f"a merge of token {w} comes before the one that makes it")
            self.born[w], self.first[w], self.last[w] = at, u, v
            self.removed_at[u << 24 | v] = at
        self._read_labels([t for t in labels if len(labels[t]) == 1 or self.first[t] >= 0])

    def _read_labels(self, tokens: list[int]) -> None:
        """Compile the table that names the tokens ending at each byte of a word."""
        self.moves: dict[int, int] = {}  # (node, byte) -> node
        ends = [-1]  # the token whose label leads to a node
        for token in sorted(tokens):
            node = 0
            for byte in self.labels[token]:
                node = self.moves.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = token
        self.sizes = [0] * len(self.born)
        for token in tokens:
            self.sizes[token] = len(self.labels[token])
        # The node of a node's longest proper end; a node's longest token; a token's longest proper end that is one.
        self.links, self.longest, self.shorter = [0] * len(ends), ends, [-1] * len(self.born)
        level = [0]
        moves_of: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.moves.items():
            moves_of.setdefault(key >> 8, []).append((key & 255, child))
        while level:
            further = []
            for node in level:
                for byte, child in moves_of.get(node, ()):
                    link = self.links[node]
                    while link and (link << 8 | byte) not in self.moves:
                        link = self.links[link]
                    link = self.moves.get(link << 8 | byte, 0) if node else 0
                    self.links[child] = link
                    if ends[child] >= 0:
                        self.shorter[ends[child]] = ends[link]
                    else:
                        ends[child] = ends[link]
                    further.append(child)
            level = further

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc labelled ``token`` from ``state``."""
        if state == self.start:
            return True
        known = self._arcs.get(state << 24 | token)
        if known is None:
            if len(self._arcs) >= KEPT_ARCS:
                self._arcs.clear()
            known = self._arcs[state << 24 | token] = self._lookup(state, token, self._gadgets)
        return known

    def _lookup(self, state: int, token: int, moment: int) -> bool:
        # Back through the gadgets: the younger end copied its side of the arc from a parent when it was made,
        # and the arc then stood unless a gadget of its own removed it, before the moment asked for.
        while True:
            if self.removed_at.get(state << 24 | token, moment) < moment:
                return False
            born, joined = self.born[state], self.born[token]
            if born < 0 and joined < 0:
                return True
            if joined >= born:
                # w's incoming arcs: those u still has once the merge itself has been removed.
                moment, token = joined + 1, self.first[token]
            else:
                # w's outgoing arcs: those v has just before the merge is removed.
                moment, state = born, self.last[state]

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The one path of the automaton that spells the word."""
        moves, links, longest, shorter, sizes, arc = self.moves, self.links, self.longest, self.shorter, self.sizes, self.arc
        node, at, last = 0, 0, [self.start]
        for byte in word:
            at += 1
            while (follows := moves.get(node << 8 | byte)) is None:
                node = links[node]
            node = follows
            token = longest[node]
            size = sizes[token]
            while size != at and not arc(last[at - size], token):
                token = shorter[token]
                size = sizes[token]
            last.append(token)
        path: list[int] = []
        while at:
            path.append(last[at])
            at -= sizes[last[at]]
        return tuple(reversed(path))


class ByteLevelBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        if (
            model.get("type", "BPE") != "BPE"
            or any(model.get(key) not in (value, "") for key, value in plain.items())
            or model.get("byte_fallback")
            or model.get("ignore_merges")
            or pre["type"] != "ByteLevel"
            or pre["add_prefix_space"]
            or not pre.get("use_regex", True)
            or spec.get("normalizer")
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        symbols = byte_symbols()

        def spelt(token: str) -> bytes:
            return bytes(symbols[c] for c in token)

        vocabulary = model["vocab"]
        labels = {number: spelt(token) for token, number in vocabulary.items()}
        if len({label for label in labels.values() if len(label) == 1}) < 256:
            raise ValueError(f"{path} has no token for some bytes")
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
        self._compile = lambda: MergeAutomaton(labels, merges)
        self.special: dict[str, int] = {}
        for added in spec.get("added_tokens", ()):
            if added["single_word"] or added["lstrip"] or added["rstrip"]:
                raise ValueError(f"added token {added['content']!r} takes in its surroundings")
            self.special[added["content"]] = added["id"]
        self.labels: dict[int, bytes] = labels | {number: text.encode() for text, number in self.special.items()}
        self._split = regex.compile(SPLIT)
        self._split_ascii = re.compile(ASCII_SPLIT)
        self._known_classes: dict[str, bool] = {}
        alternatives = "|".join(regex.escape(text) for text in sorted(self.special, key=len, reverse=True))
        self._cut = regex.compile(f"({alternatives})")
        self._words = _Words(self)

    @cached_property
    def automaton(self) -> MergeAutomaton:
        """Compiled when the first word is encoded: decoding needs the labels only."""
        compiled = self._compile()
        del self._compile
        return compiled

    def encode_word(self, word: str) -> tuple[int, ...]:
        return self.automaton.encode(word.encode())

    def words(self, text: str) -> list[str]:
        """The words of a text, as the library splits it.

        Its Unicode tables may be older than those of ``regex``. Each character
        beyond ASCII is tried once, and a text with one that the two class
        differently is split by the library.
        """
        if text.isascii():
            return self._split_ascii.findall(text)
        odd = [self._known_classes.get(c) for c in set(text)]
        if None in odd:
            odd = [self._agrees(c) for c in set(text)]
        if False in odd:
            return [text[begin:end] for _, (begin, end) in _library_splitter().pre_tokenize_str(text)]
        return self._split.findall(text)

    def _agrees(self, char: str) -> bool:
        known = self._known_classes.get(char)
        if known is None:
            trial = f"a{char}1{char}.{char} {char}"
            theirs = [span for _, span in _library_splitter().pre_tokenize_str(trial)]
            known = self._known_classes[char] = char.isascii() or theirs == [
                found.span() for found in self._split.finditer(trial)
            ]
        return known

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; the strings of special tokens in it become those tokens."""
        special = any(content in text for content in self.special)
        parts = self._cut.split(text) if special else [text]
        found = []
        for at, part in enumerate(parts):
            if at % 2:
                found.append((self.special[part],))
            else:
                found.extend(map(self._words.__getitem__, self.words(part)))
        return np.fromiter(chain.from_iterable(found), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the labels of the arcs, special tokens kept; broken UTF-8 is replaced."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Words encoded lately: two generations, so frequent ones stay and memory does not grow with the corpus."""

    def __init__(self, owner: ByteLevelBpe):
        super().__init__()
        self._owner = owner
        self._older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self._older.get(word) or self._owner.encode_word(word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS // 2:
                self._older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _library_splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


_loaded: dict[str, ByteLevelBpe] = {}


def load(path: str) -> ByteLevelBpe:
    """The compiled vocabulary, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteLevelBpe(path)
    return _loaded[path]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def bpe_encode(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False
) -> DataFrame:
    """(id, ids array<int>) per row, and the text, empty for null, if asked for."""
    rows = docs.select(F.col(id_column).alias(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    schema = rows.select(
        id_column, F.array(F.lit(0)).alias("ids"), *([F.col("_text").alias("text")] if with_text else [])
    ).schema

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in _parts(batches):
            encoded = [bpe.encode(text.as_py()) for text in batch.column("_text")]
            offsets = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum([len(ids) for ids in encoded], out=offsets[1:])
            values = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            columns = [batch.column(id_column), ids, *([batch.column("_text")] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(releasing(encode), schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """The frame with the text of its ids added; null ids give a null text, other columns pass through."""
    schema = encoded.withColumn(to, F.lit("")).schema

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in _parts(batches):
            column = batch.column(ids_column)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [
                bpe.decode(values[begin:end].tolist()) if valid else None
                for begin, end, valid in zip(
                    offsets[:-1], offsets[1:], column.is_valid().to_numpy(zero_copy_only=False), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to]
            )

    return encoded.mapInArrow(releasing(decode), schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe_decode(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
