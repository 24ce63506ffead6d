"""Mixing sources to target weights along a time-varying curriculum, in built-in functions only.

**Targets.** The sources share the words of all documents by weight. No source gives
more than ``most`` times its own words; what it cannot give goes to the others by weight.

**Taking.** A source's documents stand in a fixed pseudo-random order (by the MD5 of the id), repeated ``most``
times. A document is taken each time its middle word lies within the target.

**Curriculum.** Over training time t from 0 to 1 a source's rate is linear,
``target * (1 + a * (2 t - 1))``; the slopes ``a`` run from late to early sources and
balance, so all sources together are drawn at an even rate. Integrated, the share of the target demanded
until t is ``a t^2 + (1 - a) t``. Inverting that at the share of a document's middle word gives
its position in training; documents are sorted by it in ranges.

Null texts have 0 words. Rows equal in id, source and size are planned as one unit and
share its fate, so repeated rows stay repeated. Documents of a null source form a source of their own, last in order.
An empty table gives an empty plan. Other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscal_ledger.settings import new_table_path

WEIGHTS = (1, 2, 3)
MOST = 3
RAMP = 0.8
# Rows of a source that one task orders, on average.
BUCKET_ROWS = 65_536


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, place, target) per source from (source, source_size).

    Sources are sorted by how soon they run out, capacity over weight. Those that run
    out before the level of the rest is reached give all they have; the
    others share what is left by weight. The windows see one row per source.
    """
    named = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(named) - 1) % len(weights))
    weighed = sizes.select(
        "source",
        "source_size",
        F.row_number().over(named).alias("place"),
        weight.alias("weight"),
        (F.lit(most) * F.col("source_size")).alias("capacity"),
    )
    by_end = Window.orderBy(F.col("capacity") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("capacity").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_end.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumn(
        "level", (F.sum("source_size").over(everything) - before).cast("double") / left
    )
    # The level of the sources that don't run out; under a wrong assumption the level is lower, so the largest is right.
    open_level = F.max(F.when(F.col("capacity") > F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("capacity").cast("double"), open_level * F.col("weight"))
    return levelled.select("source", "source_size", "place", F.coalesce(target, F.lit(0.0)).alias("target"))


def _slopes(targets: DataFrame, ramp: float) -> DataFrame:
    """Add ``slope``: late sources rise, early ones fall; weighted by target the slopes add up to 0."""
    everything = Window.partitionBy()
    weighted = F.sum(F.col("place") * F.col("target")).over(everything)
    centre = F.try_divide(weighted, F.sum("target").over(everything))
    off = targets.withColumn("_off", F.coalesce(F.col("place") - centre, F.lit(0.0)))
    widest = F.max(F.abs("_off")).over(everything)
    return off.withColumn(
        "slope", F.when(widest > 0, F.lit(ramp) * F.col("_off") / widest).otherwise(F.lit(0.0))
    ).drop("_off")


def position(share: Column, slope: Column) -> Column:
    """The training time at which the given share of a source's target has been demanded."""
    steady = F.lit(1.0) - slope
    return 2 * share / (steady + F.sqrt(steady * steady + 4 * slope * share))


def mix_plan(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    ramp: float = RAMP,
) -> DataFrame:
    """One row per distinct (doc_id, source, size) of the input.

    Adds ``rows`` (how many input rows it stands for), ``source_size``, ``target``, ``taken``
    (words per input row, repeats counted) and ``positions`` (training time of each copy, none if not taken).
    Positions of a source are made in two steps: sums per slice of the order, then within slices, so a
    source that holds most of the rows is still spread over many tasks.
    """
    spark = sized.sparkSession
    path = new_table_path(spark, "mix-units")
    grouped = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    grouped.withColumns(
        {
            "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
            "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
            "_words": F.col("rows") * F.col("size"),
        }
    ).write.parquet(path)
    units = spark.read.parquet(path)
    largest = units.groupBy("_source").count().agg(F.max("count")).first()[0] or 0
    digits = 2
    while largest > BUCKET_ROWS * 16**digits:
        digits += 1
    units = units.withColumn("_slice", F.substring("_key", 1, digits))

    slices = units.groupBy("_source", "_slice").agg(F.sum("_words").alias("_slice_words"), F.first("source").alias("source"))
    sizes = slices.groupBy("_source").agg(F.sum("_slice_words").alias("source_size"), F.first("source").alias("source"))
    targets = _slopes(source_targets(sizes.select("source", "source_size"), weights, most), ramp)
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        "_source", "_slice", F.coalesce(F.sum("_slice_words").over(earlier), F.lit(0)).alias("_start")
    ).join(
        targets.select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "source_size", "target", "slope"
        ),
        "_source",
    )
    within = (
        Window.partitionBy("_source", "_slice")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = units.withColumn("_within", F.coalesce(F.sum("_words").over(within), F.lit(0))).join(
        starts, ["_source", "_slice"]
    )
    middle = (F.col("_start") + F.col("_within")).cast("double") + F.col("_words") / 2

    def at(copy: int) -> Column:
        words = F.lit(copy) * F.col("source_size") + middle
        share = F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))
        return F.when(words <= F.col("target"), position(share, F.col("slope")))

    planned = placed.withColumn("positions", F.array_compact(F.array(*(at(copy) for copy in range(most)))))
    return planned.select(
        "doc_id",
        "source",
        "size",
        "rows",
        "source_size",
        "target",
        (F.size("positions") * F.col("size")).cast("bigint").alias("taken"),
        "positions",
    )


def training_order(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents, all columns, each as often as the plan takes it, sorted by training position."""
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("from"),
        word_count(F.col("text")).alias("words"),
    )
    chosen = plan.where(F.size("positions") > 0).select("doc_id", "source", "size", "positions")
    same = (
        packed["id"].eqNullSafe(chosen["doc_id"])
        & packed["from"].eqNullSafe(chosen["source"])
        & (packed["words"] == chosen["size"])
    )
    taken = packed.join(chosen, same).select("row", "id", F.explode("positions").alias("position"))
    return taken.orderBy("position", "id").select("row.*")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, all columns."""
    return training_order(docs, mix_plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes, in training order, documents left out at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mix_plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per_row = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return per_row.orderBy(F.asc_nulls_last(F.get("positions", F.lit(0))), "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP10_SQL = r"""
WITH sized AS (
    SELECT doc_id, source,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, 3 * source_size AS capacity,
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
           row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sizes
), levelled AS (
    SELECT *,
           CAST(sum(source_size) OVER () - coalesce(sum(capacity) OVER (
               ORDER BY capacity / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(weight) OVER (ORDER BY capacity / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           AS level
    FROM weighed
), targets AS (
    SELECT source, source_size,
           coalesce(least(CAST(capacity AS DOUBLE),
               weight * max(CASE WHEN capacity > level * weight THEN level END) OVER ()), 0.0) AS target
    FROM levelled
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + s.size / 2 AS middle
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(middle <= target AS INT) + CAST(source_size + middle <= target AS INT)
           + CAST(2 * source_size + middle <= target AS INT)) AS BIGINT) AS taken
FROM placed
"""
