"""Dictionary-compressed WARC archives (``.warc.zst``).

Each task writes archives of about ``ARCHIVE_BYTES`` of records. An archive begins with a skippable
frame that holds a Zstandard dictionary trained on its own records; after it every record is a
frame of its own, compressed with that dictionary. So a record can be read alone, and an archive needs nothing beside it.

Records whose payload of ``DEDUP_BYTES`` or more equals that of a page with a smaller id are written as
``revisit`` without the payload. A null page body counts as empty. Smaller payloads are never deduplicated. Rows that share
both the payload and the smallest id are all responses; a null id counts as the largest. Repeated
rows and ids stay. An empty table writes no archive and reads back as an empty table. Columns other than page_id, url
and html are dropped, so their names cannot clash.

A task that runs again writes new files. Only the archives named in the manifest, which Spark
commits, belong to the result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import dealt, releasing
from fiscal_ledger.settings import new_table_path

DEDUP_BYTES = 100
ARCHIVE_BYTES = 64 << 20
# The dictionary, and the records it is trained on: the first of an archive. They bear on the size of
# the archive, not on what is read back.
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3

# The frame magic of the WARC-zstd and Zstandard formats, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_START = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "archive string, records bigint, bytes bigint"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    marked = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html"), 256))
    repeated = (
        marked.where(F.octet_length("html") >= DEDUP_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    # A table of its own: Spark splits a hot payload only where both sides of the join come straight from a shuffle.
    path = new_table_path(pages.sparkSession, "warc-repeated")
    repeated.write.parquet(path)
    repeated = pages.sparkSession.read.schema(repeated.schema).parquet(path)
    joined = marked.join(repeated, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def build_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        # Line ends cannot stand in a header.
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for the records; raw content where there is too little to train on."""
    sample, size = [], 0
    for record in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(record[: 128 << 10])  # the trainer takes no larger samples
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(sample)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    """The archive of some records: the dictionary in a skippable frame, then a frame per record."""
    dictionary = train(records)
    content = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    frames = [struct.pack("<II", DICTIONARY_MAGIC, len(content)), content]
    frames += map(compressor.compress, records)
    return b"".join(frames)


def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame that begins at ``start`` ends, by its block headers."""
    at = start + zstandard.frame_header_size(bytes(data[start : start + 18]))
    checksum = data[start + 4] & 4
    while True:
        header = int.from_bytes(data[at : at + 3], "little")
        kind, size = header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)
        if header & 1:
            return at + (4 if checksum else 0)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order."""
    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICTIONARY_MAGIC and at == 0:
            content = bytes(view[8 : 8 + size])
            trained = content.startswith(DICTIONARY_START)
            kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
            at = 8 + size
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            head, _, rest = decompressor.decompress(view[at:end]).partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            headers = dict(line.split(": ", 1) for line in lines)
            yield headers, rest[: int(headers["Content-Length"])]
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the pages as archives below a folder URI that all executors reach; the manifest of the archives."""
    spark = pages.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)

        def finish(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            content = archive_bytes(records)
            with filesystem.open_output_stream(f"{root}/{name}") as stream:
                stream.write(content)
            row: dict[str, list[Any]] = {"archive": [name], "records": [len(records)], "bytes": [len(content)]}
            return pa.RecordBatch.from_pydict(
                row, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
            )

        records, held = [], 0
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                record = build_record(
                    page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py(), date
                )
                if records and held + len(record) > ARCHIVE_BYTES:
                    yield finish(records)
                    records, held = [], 0
                records.append(record)
                held += len(record)
        if records:
            yield finish(records)

    manifest = f"{folder}/manifest"
    with_revisits(pages).mapInArrow(releasing(write), MANIFEST_SCHEMA).write.parquet(manifest)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(manifest)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The pages of the archives that the folder's manifest names, payloads checked against their digests.

    With ``payloads`` the body of each response comes along.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    fields = [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
    if payloads:
        schema += ", payload binary"
        fields.append(("payload", pa.binary()))
    arrow = pa.schema(fields)

    def row(headers: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.rsplit(b"Content-Length: ", 1)[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        is_response = headers["WARC-Type"] == "response"
        if is_response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
        url = headers.get("WARC-Target-URI")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        refers = None if is_response else _page_of(headers["WARC-Refers-To"])
        found = (_page_of(headers["WARC-Record-ID"]), url, length, digest, headers["WARC-Type"], refers)
        return (*found, payload if is_response else None) if payloads else found

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with filesystem.open_input_stream(f"{root}/{name}") as stream:
                    data = stream.read()
                rows = []
                for headers, block in read_archive(data):
                    rows.append(row(headers, block))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), arrow.types)), schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), arrow.types)), schema=arrow)

    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    return dealt(manifest).mapInArrow(releasing(read), schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    folder = new_table_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).drop("url")


OP2_SQL = """
WITH marked AS (
    SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
           CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
    FROM pages
), grouped AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
    FROM marked
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""
