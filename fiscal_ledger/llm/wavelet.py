"""Token ids as wavelet matrices, one compressed file per shard.

A wavelet matrix holds a sequence of ids as bit planes, the highest bit first. Each plane orders the
sequence by the bits above it: those with a 0 come first, then those with a 1, both in their order before.
A plane is stored in blocks of ``BLOCK_BITS``, each compressed on its own, with a directory of the ones before every
block. So a token is read from one block per plane (access), occurrences before a place are counted by
two ranks per plane, and the places of an id are found by walking back up with selects; nothing else of the file is read.

File format: the blocks, plane by plane; the directory (per plane the zeros, per block its end in the file and the ones
before it); the documents (ids, whether they are null, lengths); a footer that says where these are. Integers are little-endian; directory
and documents are Zstandard frames; a block that does not shrink is stored as it is.

Documents are dealt into ranges of their ids, and each task writes its range as shards of about ``SHARD_TOKENS``
tokens. A document is not split, so a longer one has a shard of its own size. Null ids come last; rows of
one id are ordered by a hash of their text, equal rows are interchangeable and spread over tasks like all others. Null texts count as
empty; every document has at least its end id. An empty table writes no shard and reads back as an empty
table. Other columns are dropped, so their names cannot clash. A task that runs again writes new files;
only the shards in the manifest, which Spark commits, belong to the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import dealt, releasing
from fiscal_ledger.llm.word_ids import encoder
from fiscal_ledger.settings import new_table_path

BLOCK_BITS = 1 << 16
SHARD_TOKENS = 4 << 20
HELD_BLOCKS = 256

MAGIC = b"wvmat-01"
_FOOTER = struct.Struct("<QQQQIIII8s")  # tokens, directory at, documents at, documents, planes, block bits, their sizes, magic

MANIFEST_SCHEMA = "part int, seq int, shard string, tokens bigint, documents bigint, bytes bigint"


def matrix_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard."""
    count = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if count else 1
    row = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    parts: list[bytes] = []
    at = 0
    zeros, ends, ones = [], [], []
    for plane in range(planes - 1, -1, -1):
        bits = (row & row.dtype.type(1 << plane)).astype(bool)
        packed = np.packbits(bits, bitorder="little").tobytes()
        before = 0
        for start in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[start : start + BLOCK_BITS // 8]
            small = pack.compress(raw)
            parts.append(small if len(small) < len(raw) else raw)
            at += len(parts[-1])
            ends.append(at)
            ones.append(before)
            before += int(np.count_nonzero(bits[start * 8 : start * 8 + BLOCK_BITS]))
        zeros.append(count - before)
        moved = np.empty_like(row)
        np.compress(~bits, row, out=moved[: count - before])
        np.compress(bits, row, out=moved[count - before :])
        row = moved
    directory = pack.compress(b"".join(np.array(a, "<u8").tobytes() for a in (zeros, ends, ones)))
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    documents = pack.compress(numbers.tobytes() + np.asarray(lengths, "<u8").tobytes() + known.tobytes())
    footer = _FOOTER.pack(count, at, at + len(directory), len(doc_ids), planes, BLOCK_BITS, len(directory), len(documents), MAGIC)
    return b"".join([*parts, directory, documents, footer])


class WaveletFile:
    """A shard, read block by block from a random-access file."""

    def __init__(self, file: Any, size: int):
        self._file = file
        file.seek(size - _FOOTER.size)
        fields = _FOOTER.unpack(file.read(_FOOTER.size))
        self.tokens, at, docs_at, self.n_documents, self.planes, self._bits, dir_size, docs_size, magic = fields
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._docs_at, self._docs_size = docs_at, docs_size
        self._blocks = -(-self.tokens // self._bits)
        table = np.frombuffer(zstandard.decompress(self._read(at, dir_size)), "<u8").astype(np.int64)
        self._zeros = table[: self.planes]
        ends, ones = table[self.planes :].reshape(2, self.planes * self._blocks)
        self._ends = np.concatenate(([0], ends))
        self._ones = ones.reshape(self.planes, self._blocks)
        self._block = lru_cache(HELD_BLOCKS)(self._load)

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _size(self, block: int) -> int:
        return min(self._bits, self.tokens - block * self._bits)

    def _load(self, level: int, block: int) -> np.ndarray:
        """The bits of a block."""
        number = level * self._blocks + block
        start, end = int(self._ends[number]), int(self._ends[number + 1])
        data = self._read(start, end - start)
        size = self._size(block)
        if len(data) < -(-size // 8):
            data = zstandard.decompress(data)
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=size).view(bool)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and their numbers of tokens."""
        data = zstandard.decompress(self._read(self._docs_at, self._docs_size)) if self.n_documents else b""
        n = self.n_documents
        numbers, lengths = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u8", n, 8 * n).astype(np.int64)
        known = np.frombuffer(data, np.uint8, n, 16 * n)
        return [int(i) if k else None for i, k in zip(numbers, known, strict=True)], lengths

    def all(self) -> np.ndarray:
        """Every id in order, plane by plane from the lowest: what a plane has moved is moved back."""
        row = np.zeros(self.tokens, np.uint16 if self.planes <= 16 else np.uint32)
        for level in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._load(level, b) for b in range(self._blocks)]) if self._blocks else np.zeros(0, bool)
            zeros = int(self._zeros[level])
            back = np.empty_like(row)
            back[~bits] = row[:zeros]
            back[bits] = row[zeros:] | row.dtype.type(1 << (self.planes - 1 - level))
            row = back
        return row.astype(np.uint32)

    def _bit_and_rank(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at some places of a plane, and the ones before each; a place may be the end."""
        bits, ranks = np.zeros(len(places), bool), np.empty(len(places), np.int64)
        block = np.minimum(places // self._bits, max(0, self._blocks - 1))
        for number in np.unique(block):
            own = block == number
            held = self._block(level, int(number))
            within = places[own] - number * self._bits
            upto = np.concatenate(([0], np.cumsum(held)))
            ranks[own] = self._ones[level, number] + upto[within]
            bits[own] = held[np.minimum(within, len(held) - 1)]
        return bits, ranks

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.tokens):
            raise IndexError("no such place")
        ids = np.zeros(len(places), np.uint32)
        for level in range(self.planes if len(places) else 0):
            bits, ones = self._bit_and_rank(level, places)
            ids = ids << np.uint32(1) | bits
            places = np.where(bits, self._zeros[level] + ones, places - ones)
        return ids

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id between two places stand below the last plane."""
        if token < 0 or token >> self.planes or start >= end:
            return 0, 0
        span = np.array([start, end], np.int64)
        for level in range(self.planes):
            _, ones = self._bit_and_rank(level, span)
            span = self._zeros[level] + ones if token >> (self.planes - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id at the places from start up to end."""
        first, last = self._span(token, start, self.tokens if end is None else end)
        return last - first

    def _select(self, level: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """The places of the bits with these ranks among the ones, or the zeros, of a plane; ranks ascend."""
        starts = np.arange(self._blocks, dtype=np.int64) * self._bits
        before = self._ones[level] if bit else starts - self._ones[level]
        block = np.searchsorted(before, ranks, side="right") - 1
        places = np.empty(len(ranks), np.int64)
        for number in np.unique(block):
            own = block == number
            held = self._block(level, int(number))
            places[own] = starts[number] + np.flatnonzero(held if bit else ~held)[ranks[own] - before[number]]
        return places

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """The places of an id, ascending, from start up to end."""
        first, last = self._span(token, start, self.tokens if end is None else end)
        places = np.arange(first, last, dtype=np.int64)
        for level in range(self.planes - 1 if len(places) else -1, -1, -1):
            bit = token >> (self.planes - 1 - level) & 1
            places = self._select(level, bit, places - self._zeros[level] if bit else places)
        return places


def write_shards(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode the documents, each followed by ``end_id``, and write them in ascending order of ids; the manifest of the shards.

    The tokenizer must be one that drops white space (see ``word_ids``).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    # The last column keeps any number of equal rows from being one range.
    placed = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        words = encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        lengths: list[int] = []
        seq = tokens = 0

        def finish() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wvm"
            content = matrix_bytes(np.concatenate(held), ids, np.array(lengths))
            with filesystem.open_output_stream(f"{root}/{name}") as stream:
                stream.write(content)
            values = [[part], [seq], [name], [tokens], [len(ids)], [len(content)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["part", "seq", "shard", "tokens", "documents", "bytes"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), strict=True):
                if held and tokens + len(found) + 1 > SHARD_TOKENS:
                    yield finish()
                    held, ids, lengths, seq, tokens = [], [], [], seq + 1, 0
                held += (found, end)
                ids.append(doc_id)
                lengths.append(len(found) + 1)
                tokens += len(found) + 1
        if held:
            yield finish()

    manifest = f"{folder}/manifest"
    ranged.mapInArrow(releasing(write), MANIFEST_SCHEMA).write.parquet(manifest)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(manifest)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``start``, the tokens of all shards before each.

    Sums run within each range, and over one row per range for the ranges before it.
    """
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")

    def before(window: Any) -> Any:
        return F.coalesce(F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("part", before(Window.orderBy("part")).alias("base"))
    within = manifest.withColumn("within", before(Window.partitionBy("part").orderBy("seq")))
    return within.join(ranges, "part").withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def _on_shards(listed: DataFrame, folder: str, schema: str, read: Any) -> DataFrame:
    """Rows that ``read(file, row)`` gives as columns for each listed shard."""
    fields = [column.split()[0] for column in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with filesystem.open_input_file(f"{root}/{row['shard']}") as file:
                    for columns in read(WaveletFile(file, row["bytes"]), row):
                        yield pa.RecordBatch.from_arrays(columns, names=fields)

    return dealt(listed).mapInArrow(releasing(run), schema)


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards; with ``ids`` if asked for."""

    def read(file: WaveletFile, row: dict[str, Any]) -> Iterator[list[pa.Array]]:
        doc_ids, lengths = file.documents()
        ids = file.all().astype("<u4")
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = memoryview(ids.tobytes())
        crcs = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crcs, pa.int64())]
        if with_ids:
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
        yield columns

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return _on_shards(shards(spark, folder), folder, schema, read)


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of some ids over all shards, by ranks alone."""

    def read(file: WaveletFile, row: dict[str, Any]) -> Iterator[list[pa.Array]]:
        yield [pa.array(tokens, pa.int64()), pa.array([file.count(token) for token in tokens], pa.int64())]

    found = _on_shards(shards(spark, folder), folder, "token bigint, n bigint", read)
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, ``place`` counted from the document's first token."""

    def read(file: WaveletFile, row: dict[str, Any]) -> Iterator[list[pa.Array]]:
        places = file.occurrences(token)
        if len(places):
            doc_ids, lengths = file.documents()
            ends = np.cumsum(lengths)
            document = np.searchsorted(ends, places, side="right")
            owners = pa.array(doc_ids, pa.int64()).take(pa.array(document))
            yield [owners, pa.array(places - (ends - lengths)[document])]

    return _on_shards(shards(spark, folder), folder, "doc_id bigint, place bigint", read)


def read_tokens(spark: SparkSession, folder: str, start: int, count: int) -> DataFrame:
    """(place, token): a stretch of the whole sequence; shards outside it are not opened."""
    end = start + count
    listed = shards(spark, folder).where((F.col("start") < end) & (F.col("start") + F.col("tokens") > start))

    def read(file: WaveletFile, row: dict[str, Any]) -> Iterator[list[pa.Array]]:
        places = np.arange(max(start, row["start"]), min(end, row["start"] + row["tokens"]))
        yield [pa.array(places), pa.array(file.access(places - row["start"]).astype(np.int64))]

    return _on_shards(listed, folder, "place bigint, token bigint", read)


def op11_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as wavelet matrices and read back."""
    import public_tokenizers

    folder = new_table_path(spark, "wavelet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)
