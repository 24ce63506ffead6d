"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, one per language.

Characters up to U+077F are symbols, others are written as two, so different texts have different symbols.
A text's n-grams begin with empty symbols. The steps:

1. Documents are packed into blocks of some ``BLOCK_BYTES``, as compressed files in the shared folder. From then on only
   n-grams, counts and scores are shuffled, never texts. The manifest that Spark commits names the blocks.
2. The n-grams of all trusted documents are counted, summed per task first. Counts of
   shorter n-grams are continuation counts: of how many longer ones they are the end.
3. Every distinct n-gram of the corpus gets its probability by joining counts, contexts and the shorter
   n-gram's probability, order by order. The tables are dealt by language and n-gram, so no key is hot.
4. The probabilities are joined to the blocks that ask for them, and each block scores its documents.
5. A language's threshold is a quantile of the scores of its own trusted documents, moved towards those of
   its known bad ones. Documents above it are rejected.

A document's score is its mean negative log probability per character; PRIOR_CHARS characters of the
language's trusted mean are mixed in, so a few odd characters don't condemn a short text.

Null text counts as empty, has a null perplexity and is kept. A null language is a language of its own.
Documents of a language without trusted text have null perplexity and threshold and are kept. Repeated
rows and ids come out one for one; repeated labels of an id count as bad if any is. Columns not
named are dropped, so their names cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fiscal_ledger.llm.memory import dealt, release, releasing
from fiscal_ledger.settings import new_table_path

ORDER = 4
BLOCK_BYTES = 16 << 20
PRIOR_CHARS = 50
# The threshold: this quantile of trusted scores, and so far from it towards this quantile of bad scores.
TRUSTED_QUANTILE = 0.995
BAD_QUANTILE = 0.05
TOWARDS_BAD = 0.5

# n-grams are numbers of 12 bits per symbol, the last symbol lowest. Code points from PLAIN on are a first symbol
# from PLAIN on and a second one, of 10 bits of them, from SECOND on.
BITS = 12
PLAIN = 0x780
SECOND = 0xBC0
# Keys that a language is dealt over where rows join something known per language.
SALTS = 64
# No document's language: those are empty or begin with "=".
NO_LANGUAGE = "-"
# Distinct n-grams a task holds before it hands on their counts.
HELD_COUNTS = 1 << 20


def _low(order: int) -> int:
    return (1 << BITS * order) - 1


def ngrams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram at every symbol of some texts, end to end, and the number of symbols of each."""
    pad = "\0" * (order - 1)
    clean = [t.replace("\0", "\ufffd") if "\0" in t else t for t in texts]
    points = np.frombuffer((pad + pad.join(clean)).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = points.astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    wide = points >= PLAIN
    if wide.any():
        before = np.concatenate(([0], np.cumsum(wide)))
        firsts = np.cumsum(lengths + order - 1) - lengths
        rest = symbols[wide] - PLAIN
        seconds = np.flatnonzero(wide) + before[:-1][wide] + 1
        symbols[wide] = PLAIN + (rest >> 10)
        symbols = np.repeat(symbols, 1 + wide)
        symbols[seconds] = SECOND + (rest & 0x3FF)
        lengths = lengths + before[firsts + lengths] - before[firsts]
    count = max(0, len(symbols) - order + 1)
    keys = np.zeros(count, np.int64)
    for step in range(order):
        keys = keys << BITS | symbols[step : step + count]
    return keys[symbols[order - 1 :] != 0], lengths


def _slices(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about so many characters, with the number of the first."""
    first, held = 0, 0
    for number, text in enumerate(texts):
        if number > first and held + len(text) > chars:
            yield first, texts[first:number]
            first, held = number, 0
        held += len(text)
    if first < len(texts):
        yield first, texts[first:]


def _by_language(table: pa.Table) -> dict[str, np.ndarray]:
    """Row numbers of each language."""
    languages: dict[str, list[int]] = {}
    for row, language in enumerate(table.column("_lang").to_pylist()):
        languages.setdefault(language, []).append(row)
    return {language: np.array(rows) for language, rows in languages.items()}


def _read_block(folder: str, name: str) -> pa.Table:
    filesystem, root = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_stream(f"{root}/{name}") as stream:
        return pa.ipc.open_stream(stream).read_all()


_MANIFEST = "block string, rows array<struct<row int, doc_id bigint>>, asked array<struct<lang string, keys array<bigint>>>"


def _pack(docs: DataFrame, folder: str) -> DataFrame:
    """Write the documents (with ``_id``, ``_lang``, ``_text``) as block files; the manifest of them."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)

        def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            name = f"{uuid.uuid4().hex}.arrow"
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            with filesystem.open_output_stream(f"{root}/{name}") as stream:
                with pa.ipc.new_stream(stream, table.schema, options=options) as writer:
                    writer.write_table(table)
            asked = []
            for language, rows in _by_language(table).items():
                texts = table.column("_text").take(pa.array(rows)).to_pylist()
                found = [np.unique(ngrams(part)[0]) for _, part in _slices(texts)]
                asked.append({"lang": language, "keys": np.unique(np.concatenate(found))})
            ids = [{"row": row, "doc_id": value} for row, value in enumerate(table.column("_id").to_pylist())]
            return pa.RecordBatch.from_pydict(
                {"block": [name], "rows": [ids], "asked": [asked]},
                schema=pa.schema(
                    [
                        ("block", pa.string()),
                        ("rows", pa.list_(pa.struct([("row", pa.int32()), ("doc_id", pa.int64())]))),
                        ("asked", pa.list_(pa.struct([("lang", pa.string()), ("keys", pa.list_(pa.int64()))]))),
                    ]
                ),
            )

        held, size = [], 0
        for batch in batches:
            step = max(1, int(batch.num_rows * BLOCK_BYTES / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield finish(held)
                    held, size = [], 0
        if held:
            yield finish(held)

    manifest = f"{folder}/manifest"
    docs.mapInArrow(releasing(pack), _MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(_MANIFEST).parquet(manifest)


def _with_language(rows: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """Join a small table of one row per language; each language is dealt over SALTS keys."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    return placed.join(salted, ["lang", "_salt"], "left").drop("_salt")


def _written(frame: DataFrame, folder: str, name: str) -> DataFrame:
    frame.write.parquet(f"{folder}/{name}")
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")


def _trusted_counts(chosen: DataFrame, folder: str) -> DataFrame:
    """(lang, key, c): occurrences of each n-gram in the chosen rows (block, rows) of the blocks."""
    schema = "lang string, key bigint, c bigint"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("c", pa.int64())])
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for language, (keys, counts) in sums.items():
                lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([language]))
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(keys), pa.array(counts)], schema=arrow)
            sums.clear()

        for batch in batches:
            for name, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                table = _read_block(folder, name).take(pa.array(sorted(rows)))
                for language, numbers in _by_language(table).items():
                    texts = table.column("_text").take(pa.array(numbers)).to_pylist()
                    for _, part in _slices(texts):
                        keys, counts = np.unique(ngrams(part)[0], return_counts=True)
                        if language in sums:
                            keys = np.concatenate((keys, sums[language][0]))
                            counts = np.concatenate((counts, sums[language][1]))
                            keys, at = np.unique(keys, return_inverse=True)
                            counts = np.bincount(at, counts).astype(np.int64)
                        sums[language] = keys, counts
                if sum(len(keys) for keys, _ in sums.values()) > HELD_COUNTS:
                    yield from handed_on()
        yield from handed_on()

    return dealt(chosen).mapInArrow(releasing(count), schema).groupBy("lang", "key").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of modified Kneser-Ney from the counts of counts; 0.5, 1, 1.5 where they can't be told."""

    def having(n: int) -> Column:
        return F.sum((F.col("c") == n).cast("bigint")).cast("double")

    of = counts.groupBy("lang").agg(*(having(n).alias(f"n{n}") for n in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(n: int) -> Column:
        least = F.least(*(F.col(f"n{i}") for i in (1, 2, 3, 4)))
        value = F.lit(float(n)) - (n + 1) * y * F.try_divide(F.col(f"n{n + 1}"), F.col(f"n{n}"))
        usual = F.lit(n / 2)
        return F.when((least > 0) & (value > 0) & (value <= n), value).otherwise(usual).alias(f"d{n}")

    return of.withColumn("n1", F.greatest("n1", F.lit(1.0))).select("lang", discount(1), discount(2), discount(3))


def _model(counts: DataFrame, folder: str, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1 up: n-grams (lang, key, kept: count less discount) and contexts (lang, context, total, removed)."""
    levels = []
    for size in range(order, 0, -1):
        if size < order:
            counts = counts.groupBy("lang", F.col("key").bitwiseAND(F.lit(_low(size))).alias("key")).agg(
                F.count(F.lit(1)).alias("c")
            )
        counts = _written(counts, folder, f"counts-{size}")
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        discounted = _with_language(counts, _discounts(counts), "key").select(
            "lang", "key", (F.col("c") - discount).alias("kept"), discount.alias("removed"), "c"
        )
        contexts = discounted.groupBy("lang", F.shiftright("key", BITS).alias("context")).agg(
            F.sum("c").alias("total"), F.sum("removed").alias("removed")
        )
        levels.append((discounted.select("lang", "key", "kept"), _written(contexts, folder, f"contexts-{size}")))
    return levels[::-1]


def _probabilities(asked: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, key, p) for distinct asked n-grams (lang, key) of the highest order."""
    wanted = [asked]
    for size in range(len(levels) - 1, 0, -1):
        wanted.append(
            wanted[-1].select("lang", F.col("key").bitwiseAND(F.lit(_low(size))).alias("key")).distinct()
        )
    shorter = None
    for size, ((grams, contexts), of) in enumerate(zip(levels, reversed(wanted), strict=True), start=1):
        found = of.withColumn("context", F.shiftright("key", BITS)).join(grams, ["lang", "key"], "left")
        found = found.join(contexts, ["lang", "context"], "left")
        if shorter is None:
            below = F.lit(1.0 / (1 << BITS))
        else:
            found = found.withColumn("end", F.col("key").bitwiseAND(F.lit(_low(size - 1))))
            found = found.join(shorter.select("lang", F.col("key").alias("end"), F.col("p").alias("below")), ["lang", "end"])
            below = F.col("below")
        p = F.when(F.col("total").isNull(), below).otherwise(
            (F.coalesce("kept", F.lit(0.0)) + F.col("removed") * below) / F.col("total")
        )
        shorter = found.select("lang", "key", p.alias("p"))
    return shorter


_SCORES = "block string, row int, lang string, doc_id bigint, chars bigint, nll double"


def _block_scores(answered: DataFrame, folder: str) -> DataFrame:
    """Score the documents of each block from the answers (block, lang, key, logp) to its questions."""

    def score(table: pa.Table) -> pa.Table:
        release()  # what the block before has left
        name = table.column("block")[0].as_py()
        keys, logs = table.column("key").to_numpy(), table.column("logp").to_numpy()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        if isinstance(langs, pa.ChunkedArray):
            langs = langs.combine_chunks()
        codes, dictionary = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        block = _read_block(folder, name)
        chars = np.zeros(block.num_rows, np.int64)
        nll = np.zeros(block.num_rows)
        for language, rows in _by_language(block).items():
            own = codes == (dictionary.index(language) if language in dictionary else -1)
            known, values = keys[own], logs[own]
            order = np.argsort(known)
            known, values = known[order], values[order]
            texts = block.column("_text").take(pa.array(rows)).to_pylist()
            for first, part in _slices(texts):
                grams, lengths = ngrams(part)
                total = np.concatenate(([0.0], np.cumsum(values[np.searchsorted(known, grams)]) if len(grams) else []))
                ends = np.cumsum(lengths)
                at = rows[first : first + len(part)]
                chars[at] = [len(text) for text in part]
                nll[at] = -(total[ends] - total[ends - lengths])
        return pa.Table.from_arrays(
            [
                pa.array([name] * block.num_rows, pa.string()),
                pa.array(np.arange(block.num_rows), pa.int32()),
                block.column("_lang"),
                block.column("_id").cast(pa.int64()),
                pa.array(chars),
                pa.array(nll),
            ],
            names=["block", "row", "lang", "doc_id", "chars", "nll"],
        )

    return answered.groupBy("block").applyInArrow(score, _SCORES)


class Scored:
    """Scored documents, and the blocks that hold them."""

    def __init__(self, decisions: DataFrame, folder: str, kept: StructType):
        self.decisions = decisions  # block, row, doc_id, lang, chars, perplexity, threshold, rejected
        self._folder = folder
        self._schema = kept

    def kept(self) -> DataFrame:
        """The documents that are not rejected, with the columns named at scoring."""
        folder = self._folder
        rows = _written(
            self.decisions.where("NOT rejected").groupBy("block").agg(F.collect_list("row").alias("rows")), folder, f"kept-{uuid.uuid4().hex}"
        )
        names = self._schema.names

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, numbers in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                    table = _read_block(folder, name).select([f"c{i}" for i in range(len(names))])
                    kept = table.take(pa.array(sorted(numbers))).rename_columns(names)
                    yield from kept.to_batches(max_chunksize=2000)

        return dealt(rows).mapInArrow(releasing(read), self._schema)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    keep: tuple[str, ...] = (),
    order: int = ORDER,
) -> Scored:
    """Train on the trusted documents (label quality 1, not toxic) and score all; ``keep`` names columns to keep."""
    spark = docs.sparkSession
    folder = new_table_path(spark, "quality")
    if order != ORDER:
        raise ValueError("blocks are packed for one order")
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    packed = docs.select(
        F.col(id_column).cast("bigint").alias("_id"),
        F.coalesce(F.concat(F.lit("="), lang_column), F.lit("")).alias("_lang"),
        F.coalesce(text_column, F.lit("")).alias("_text"),
        *columns,
    )
    manifest = _pack(packed, folder)
    verdicts = labels.groupBy("doc_id").agg(
        (F.min(F.coalesce("quality", F.lit(0))) * (1 - F.max(F.coalesce("toxic", F.lit(0))))).alias("trusted"),
        (1 - F.min("quality")).alias("bad"),
    )
    members = manifest.select("block", F.explode("rows").alias("m")).select("block", "m.row", "m.doc_id")
    chosen = _written(
        members.join(verdicts.where("trusted = 1"), "doc_id").groupBy("block").agg(F.collect_list("row").alias("rows")),
        folder,
        "chosen",
    )
    levels = _model(_trusted_counts(chosen, folder), folder, order)
    questions = manifest.select("block", F.explode("asked").alias("q")).select(
        "block", "q.lang", F.explode("q.keys").alias("key")
    )
    answers = _probabilities(questions.select("lang", "key").distinct(), levels)
    answers = _written(answers.select("lang", "key", F.log("p").alias("logp")), folder, "answers")
    # A block of empty texts asks nothing; the row of its own that each block gets brings its documents along.
    present = manifest.select("block", F.lit(NO_LANGUAGE).alias("lang"), F.lit(0).cast("bigint").alias("key"), F.lit(0.0).alias("logp"))
    answered = questions.join(answers, ["lang", "key"]).select("block", "lang", "key", "logp").unionByName(present)
    scores = _written(_block_scores(answered, folder), folder, "scores")

    judged = scores.join(verdicts, "doc_id", "left")
    means = judged.where("trusted = 1 AND chars > 0").groupBy("lang").agg((F.sum("nll") / F.sum("chars")).alias("mean"))
    shrunk = _with_language(judged, means, "block", "row").withColumn(
        "score", (F.col("nll") + PRIOR_CHARS * F.col("mean")) / (F.col("chars") + PRIOR_CHARS)
    )
    good = F.percentile_approx(F.when(F.col("trusted") == 1, F.col("score")), F.lit(TRUSTED_QUANTILE), F.lit(10000))
    bad = F.percentile_approx(F.when(F.col("bad") == 1, F.col("score")), F.lit(BAD_QUANTILE), F.lit(10000))
    thresholds = shrunk.groupBy("lang").agg(good.alias("good"), bad.alias("low_bad"))
    apart = F.greatest(F.col("low_bad") - F.col("good"), F.lit(0.0))
    thresholds = thresholds.select(
        "lang", (F.col("good") + TOWARDS_BAD * F.coalesce(apart, F.lit(0.0))).alias("limit")
    )
    is_scored = F.col("mean").isNotNull() & (F.col("chars") > 0)
    decisions = _with_language(shrunk, thresholds, "block", "row").select(
        "block",
        "row",
        "doc_id",
        F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30)).alias("lang"),
        "chars",
        F.when(is_scored, F.exp(F.col("nll") / F.col("chars"))).alias("perplexity"),
        F.when(is_scored, F.exp("score")).alias("adjusted_perplexity"),
        F.exp("limit").alias("threshold"),
        F.coalesce(is_scored & (F.col("score") > F.col("limit")), F.lit(False)).alias("rejected"),
    )
    return Scored(_written(decisions, folder, "decisions"), folder, docs.select(*keep).schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).decisions.drop("block", "row")
