"""Token counts of texts: encoded in batches inside Arrow functions, only the lengths come back.

Nulls count as empty text. Rows come out as they go in, one for one: ties, repeated
rows and repeated ids are kept, an empty table gives an empty table, and columns
other than the id and the text are dropped, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import releasing

# Bytes handed to the tokenizer at once, and the length from which a text is split.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

# No split pattern of byte-level BPE joins a word character to white space after it, no special token
# holds white space, and what precedes a position never changes how the text from it on is split.
_SAFE = re.compile(r"\w(?=[ \n])")

_tokenizers: dict[str, Any] = {}


def _counter(path: str) -> Any:
    """The tokenizer's batch-length function, loaded once per Python worker."""
    if path not in _tokenizers:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _tokenizers[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _tokenizers[path] = lambda texts: [
                len(encoding) for encoding in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
    return _tokenizers[path]


def split_safely(text: str, chars: int = PIECE_CHARS) -> list[str]:
    """Pieces of about the given length whose token counts add up to that of the whole text.

    A cut is made only between a word character and white space. A stretch
    without such a place stays whole, however long it is.
    """
    pieces, start = [], 0
    while len(text) - start > chars:
        found = _SAFE.search(text, start + chars - 1)
        if found is None:
            break
        pieces.append(text[start : found.end()])
        start = found.end()
    pieces.append(text[start:])
    return pieces


def batches_by_bytes(pieces: Iterable[tuple[int, str]], limit: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Group (row, piece) pairs until a batch holds about ``limit`` bytes."""
    batch: list[tuple[int, str]] = []
    held = 0
    for row, piece in pieces:
        size = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append((row, piece))
        held += size
    if batch:
        yield batch


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as the tokenizer's own library counts.

    No begin, end or padding tokens are counted and nothing is truncated;
    strings of special tokens inside a text count as the library's default has it.
    A ``.model`` file is read by sentencepiece, whose white-space handling
    rules out cuts, so its texts are encoded whole.
    """
    splits = not tokenizer_path.endswith(".model")
    rows = docs.select(F.col(id_column).alias(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    schema = rows.select(
        id_column,
        F.octet_length("_text").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_tokens"),
        F.lit(False).alias("over_limit"),
    ).schema

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_of = _counter(tokenizer_path)
        for batch in batches:
            texts = batch.column("_text")
            tokens = [0] * len(texts)
            pieces = (
                (row, piece)
                for row, text in enumerate(texts)
                for piece in (split_safely(text.as_py()) if splits else [text.as_py()])
            )
            for group in batches_by_bytes(pieces):
                for (row, _), length in zip(group, lengths_of([piece for _, piece in group]), strict=True):
                    tokens[row] += length
            counts = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column),
                    pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()),
                    counts,
                    pc.greater(counts, limit),
                ],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(releasing(count), schema)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the public byte-level BPE vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
