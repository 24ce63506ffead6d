"""The corpus pipeline: from raw documents to encoded training data.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next one's documents. All but the last give the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscal_ledger.llm.bpe import bpe_decode, bpe_encode
from fiscal_ledger.llm.mixing import mixed
from fiscal_ledger.llm.near_duplicates import one_of_each
from fiscal_ledger.llm.quality import score_quality
from fiscal_ledger.llm.repeats import without_repeats
from fiscal_ledger.settings import new_table_path, remove_paths, table_paths


# A passage of 50 words is some 300 bytes long, and seldom less than 240.
PASSAGE_BYTES = 200


# The tables that a stage made for itself, by session, folder of the tables and stage.
_own_tables: dict[tuple[str, str, str], list[str]] = {}


def _stage(of: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Before a stage, the tables that the stage before it made for itself go, unless its documents still read them."""

    @wraps(of)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [stage.__name__ for _, stage in STAGES]
        application, at = spark.sparkContext.applicationId, names.index(of.__name__)
        if at > 0:
            finished = _own_tables.get((application, sf_dir, names[at - 1]), [])
            read = docs.inputFiles() if finished else []
            if not any(path in file for path in map(_bare, finished) for file in read):
                remove_paths(spark, finished)
                _own_tables.pop((application, sf_dir, names[at - 1]), None)
        known = len(table_paths())
        made = of(spark, docs, sf_dir)
        _own_tables.setdefault((application, sf_dir, of.__name__), []).extend(table_paths()[known:])
        return made

    return run_stage


def _bare(path: str) -> str:
    """A table's path from the application's folder on: names in it are used once, whatever the scheme is spelt like."""
    return "/".join(path.split("/")[-2:]) + "/"


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, keep=tuple(docs.columns)).kept()


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages that occur elsewhere; documents stay, even when nothing is left."""
    return without_repeats(docs, length=PASSAGE_BYTES)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, in training order; a document comes as often as it is taken."""
    return mixed(docs)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe_decode(bpe_encode(docs, path, with_text=True), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.col("text")).alias("decodes"),
    )


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixing),
    ("bpe encoding and decoding", encoding),
]

# SQL cannot express the language model, the sketches or the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        path = new_table_path(spark, f"pipeline-{number}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
