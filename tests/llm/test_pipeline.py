"""The pipeline against the plain versions of its stages, one after the other."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute, fixture


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The fixture without repeated and null ids, which the plain versions don't take."""
    folder = fixture.write(spark, str(tmp_path_factory.mktemp("tables")))
    clean = str(tmp_path_factory.mktemp("clean"))
    spark.createDataFrame(fixture.documents()[:-3], fixture.DOCUMENTS).write.parquet(f"{clean}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{clean}/labels.parquet")
    return folder, clean


def plain_run():
    docs = [list(d) for d in fixture.documents()[:-3]]
    labels: dict = {}
    for doc_id, good, toxic in fixture.labels():
        old = labels.get(doc_id, (good, toxic))
        labels[doc_id] = (min(old[0], good) if good is not None else old[0], max(old[1] or 0, toxic or 0))
    out = brute.quality([(d[0], d[1], d[2]) for d in docs], labels)
    docs = [d for d, (_, rejected) in zip(docs, out, strict=True) if not rejected]
    classes = brute.near_duplicate_classes([(d[0], d[1]) for d in docs])
    docs = [d for d, c in zip(docs, classes, strict=True) if d[0] == c]
    data = [(d[1] or "").encode() for d in docs]
    for doc, text, gone in zip(docs, data, brute.removed_bytes(data, corpus_pipeline.PASSAGE_BYTES), strict=True):
        doc[1] = bytes(np.frombuffer(text, np.uint8)[~gone]).decode("utf-8", "ignore")
    taken = brute.mix([(d[0], d[1], d[3]) for d in docs])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted(
        (d[0], library.encode(d[1], add_special_tokens=False).ids) for d, times in zip(docs, taken, strict=True) for _ in range(times)
    )


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables[1]).collect()
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in rows)
    assert sorted((r.doc_id, r.ids) for r in rows) == plain_run()


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        made = stage(spark, docs, tables[0])
        assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
        assert 0 < made.count() <= before
    assert len(corpus_pipeline.STAGES) == 5


def test_empty(spark, tmp_path):
    folder = fixture.write(spark, str(tmp_path), empty=True)
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_a_stage_that_is_not_written_keeps_its_tables(spark, tables):
    docs = spark.read.parquet(f"{tables[1]}/documents.parquet")
    checked = corpus_pipeline.quality(spark, docs, tables[1])
    corpus_pipeline.near_duplicates(spark, checked, tables[1])
    assert checked.count() > 0
