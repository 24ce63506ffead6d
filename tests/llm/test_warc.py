"""The archive format: dictionary frame, single frames, records."""

from __future__ import annotations

import struct

import pytest
import zstandard

from fiscal_ledger.llm import warc
from fiscal_ledger.settings import new_table_path
from tests.llm import fixture


@pytest.mark.parametrize("count", [1, 3, 400])
def test_archive_round_trip(count):
    payloads = [f"<p>page {i} {'text ' * (i % 50)}</p>".encode() for i in range(count)]
    records = [warc.build_record(i, f"http://x/{i}", p, "d", None, "2000-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    data = warc.archive_bytes(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    read = list(warc.read_archive(data))
    assert [block.partition(b"\r\n\r\n")[2] for _, block in read] == payloads
    assert [h["WARC-Record-ID"] for h, _ in read] == [warc.record_name(i) for i in range(count)]
    # Each record is a frame of its own: the last can be read without the others.
    last = data.rindex(struct.pack("<I", warc.FRAME_MAGIC))
    kind = zstandard.DICT_TYPE_FULLDICT if data[8:12] == warc.DICTIONARY_START else zstandard.DICT_TYPE_RAWCONTENT
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size], dict_type=kind)
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[last:]) == records[-1]


def test_damage_is_noticed():
    data = bytearray(warc.archive_bytes([b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]))
    data[8 + struct.unpack_from("<II", data)[1]] ^= 1
    with pytest.raises(ValueError, match="no frame"):
        list(warc.read_archive(bytes(data)))


def test_payloads_and_urls_come_back(spark, tmp_path):
    pages = spark.createDataFrame(fixture.pages(), fixture.PAGES)
    folder = new_table_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder)
    assert manifest.selectExpr("sum(records)").first()[0] == len(fixture.pages())
    rows = warc.read_archives(spark, folder, payloads=True).collect()
    by_id = {(r.page_id, r.url): r for r in rows}
    for page_id, url, html, _ in fixture.pages():
        row = by_id[page_id, url]
        if row.record_type == "response":
            assert row.payload.decode() == (html or "")
        else:
            assert row.payload is None and row.refers_to == 1
    assert sum(r.record_type == "revisit" for r in rows) == 3
