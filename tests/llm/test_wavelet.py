"""Wavelet matrix shards: ids as the library gives them, ranks and selects against plain counting."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fiscal_ledger.llm import wavelet, word_ids
from fiscal_ledger.settings import new_table_path
from tests.llm import brute, fixture

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(rows, library) -> list[tuple]:
    """(doc_id, start, n_tokens, crc) in ascending order of ids; null last, equal ids by Spark's hash of the text."""
    docs = sorted(((d[0], d[1] or "") for d in rows), key=lambda d: (d[0] is None, d[0] or 0, brute.spark_xxhash64(d[1])))
    out, start = [], 0
    for doc_id, text in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [4 << 20, 300])
def test_documents(spark, tmp_path, monkeypatch, library, shard_tokens):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard_tokens)
    folder = fixture.write(spark, str(tmp_path))
    rows = wavelet.op11_wavelet(spark, folder).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(plain(fixture.documents(), library), key=repr)


def test_lookups(spark, tmp_path, monkeypatch, library):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 2000)
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(d[1] or "" for d in fixture.documents()))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    folder = new_table_path(spark, "wavelet-test")
    wavelet.write_shards(docs, folder, PATH, end_id=7)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 7] for _, t in rows]
    whole = [i for doc in ids for i in doc]
    tokens = [7, ids[0][0], ids[3][2], 99_999]
    counted = {r.token: r.n for r in wavelet.count_tokens(spark, folder, tokens).collect()}
    assert counted == {t: whole.count(t) for t in tokens}
    found = sorted(map(tuple, wavelet.find_token(spark, folder, ids[0][0]).collect()))
    assert found == [(d, place) for d, doc in enumerate(ids) for place, i in enumerate(doc) if i == ids[0][0]]
    stretch = sorted(map(tuple, wavelet.read_tokens(spark, folder, 1500, 3000).collect()))
    assert stretch == list(enumerate(whole))[1500:4500]
    with_ids = {r.doc_id: r.ids for r in wavelet.read_documents(spark, folder, with_ids=True).collect()}
    assert with_ids == dict(enumerate(ids))
    assert wavelet.shards(spark, folder).count() > 3


@pytest.mark.parametrize("count", [1, 7, 70_000, 200_001])
@pytest.mark.parametrize("largest", [0, 1, 49_407, 70_000])
def test_matrix(count, largest):
    rng = np.random.default_rng(count + largest)
    ids = np.minimum(rng.geometric(0.001, count), largest).astype(np.uint32)
    data = wavelet.matrix_bytes(ids, [None, 5], np.array([0, count]))
    file = wavelet.WaveletFile(io.BytesIO(data), len(data))
    assert np.array_equal(file.all(), ids)
    assert file.documents()[0] == [None, 5] and file.documents()[1].tolist() == [0, count]
    places = rng.integers(0, count, 50)
    assert np.array_equal(file.access(places), ids[places])
    for token in {int(ids[0]), int(ids[-1]), largest, largest + 1, 1 << 20}:
        assert np.array_equal(file.occurrences(token), np.flatnonzero(ids == token))
        assert file.count(token, count // 3, count // 2) == np.count_nonzero(ids[count // 3 : count // 2] == token)
        assert np.array_equal(file.occurrences(token, count // 3), count // 3 + np.flatnonzero(ids[count // 3 :] == token))
    with pytest.raises(IndexError):
        file.access(np.array([count]))


def test_few_bytes_are_read_for_a_lookup():
    ids = np.random.default_rng(1).integers(0, 40_000, 1 << 20).astype(np.uint32)
    data = wavelet.matrix_bytes(ids, [1], np.array([len(ids)]))

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, size=-1):
            self.read_bytes += size
            return super().read(size)

    file = Counted(data)
    assert wavelet.WaveletFile(file, len(data)).access(np.array([777_777])) == ids[777_777]
    assert file.read_bytes < len(data) / 10


def test_empty(spark, tmp_path):
    folder = fixture.write(spark, str(tmp_path), empty=True)
    found = wavelet.op11_wavelet(spark, folder)
    assert found.collect() == [] and found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


ODD = [
    "It's the dog's, they'LL 'S 'stop rock'n'roll ' 's' can't", "<|endoftext|> <|ENDOFTEXT|>a<|startoftext|>B", "a<|endoftext|>b, C<|x|>",
    "J̌ X́y ≠ a,̸b ,́ Å", "Été, À!! İstanbul ΣΣ Σa", "x y z\u0085w\x1cv \x0b \x0c q",
    "ABC123def4.5,6-7_8__9 a_b A_B", "日本語 a日,b 한글", "\U0001f642\U0001f642 a\U0001f642b", "...!!!,,, a..b", "\t\n\r ", "", "Don’t 1st 2ND ½ Ⅸ x²",
    "a" * 3000 + "B" * 10, "ẞ ﬁ ǅ Ω Å ͅa", "foo\u0000bar ​‍ ؀",
]


@pytest.mark.parametrize("piece", [8 << 20, 40])
def test_encoder_is_the_library(library, monkeypatch, piece):
    monkeypatch.setattr(word_ids, "PIECE_BYTES", piece)
    texts = [*ODD, None, *(d[1] for d in fixture.documents()), " ".join(ODD), "".join(ODD)]
    for group in (texts, [t for t in texts if t and "<|" not in t]):
        encoder = word_ids.WordEncoder(PATH)
        for _ in range(2):
            found = [ids.tolist() for ids in encoder.encode(pa.array(group, pa.string()))]
            assert found == [library.encode(t or "", add_special_tokens=False).ids for t in group]


def test_encoder_on_random_text(library):
    rng = np.random.default_rng(6)
    letters = list("aAbBzZ09.,!?'-_<|>sStT \n\téÉ̸́̌ßΣ日\U0001f642 =")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(6000)]
    for part in (texts[:3000], [t for t in texts[3000:] if "<|" not in t]):
        encoder = word_ids.WordEncoder(PATH)
        found = [ids.tolist() for ids in encoder.encode(pa.array(part))]
        assert found == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
