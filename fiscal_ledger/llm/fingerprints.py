"""Document fingerprints by Order MinHash, in built-in functions only.

A text becomes its overlapping runs of ``k`` words. A run met before in the same
text gets a new identity from the number of times it has occurred. One hash deals the runs to ``bins``; of
each bin the ``picked`` smallest are selected, put back in text order and hashed as a
tuple. A bin then agrees between two texts only if the same runs were selected
and stand in the same order, so moving text about counts as a change, as it does for edit distance.

Null texts count as empty; an empty text has the empty fingerprint, and a text of fewer than
``k`` words is one run. An empty table gives an empty table. Columns other than the id and
the text are dropped, so their names cannot clash. Ids are expected to be
unique; repeated ones are put in order by a hash of their text, null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
BINS = 32
PICKED = 2
# Rows meant for one group of neighbouring ids, and the most groups, whose bounds the driver holds.
GROUP_ROWS = 1000
MOST_GROUPS = 16_384

# A run is one number: 40 bits of its hash, then 24 bits of its place in the text.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    # A lambda's argument is evaluated once, however often the body mentions it.
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words between ASCII white space; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _runs(hashes: Column, k: int) -> Column:
    """Every run of k words, sorted by hash; nulls past the end of a short text don't count in the hash."""
    last = F.greatest(F.size(hashes) - k, F.lit(0))

    def run(i: Column) -> Column:
        whole = F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))
        return whole.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.least(i, F.lit(_PLACE >> 1)).cast("bigint"))

    return F.sort_array(F.transform(F.sequence(F.lit(0), last), run))


def _numbered(runs: Column) -> Column:
    """Give repeated runs an identity of their own: the hash of the run and of how often it came before."""

    def with_starts(starts: Column) -> Column:
        # Equal runs are neighbours; within a stretch of them the numbers count up from 0.
        counts = F.flatten(
            F.transform(
                starts,
                lambda start, at: F.sequence(
                    F.lit(0), F.coalesce(F.get(starts, at + 1), F.size(runs)) - start - 1
                ),
            )
        )
        renamed = F.zip_with(
            runs,
            counts,
            lambda run, seen: F.when(seen == 0, run).otherwise(
                F.xxhash64(run.bitwiseAND(F.lit(~_PLACE)), seen)
                .bitwiseAND(F.lit(~_PLACE))
                .bitwiseOR(run.bitwiseAND(F.lit(_PLACE)))
            ),
        )
        return F.when(F.size(starts) == F.size(runs), runs).otherwise(F.sort_array(renamed))

    def opens(i: Column) -> Column:
        here, before = F.get(runs, i), F.get(runs, i - 1)
        return (i == 0) | (F.shiftright(here, _PLACE_BITS) != F.shiftright(before, _PLACE_BITS))

    return _let(F.filter(F.sequence(F.lit(0), F.size(runs) - 1), opens), with_starts)


def _bin(run: Column, bins: int) -> Column:
    return F.shiftrightunsigned(run, 64 - (bins.bit_length() - 1))


def _tuples(runs: Column, bins: int, picked: int) -> Column:
    """Per bin that has runs: its number in the top byte, the hash of its tuple in text order below."""
    selected = F.filter(
        runs, lambda run, i: (i < picked) | (_bin(F.get(runs, i - picked), bins) != _bin(run, bins))
    )

    def of(chosen: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(chosen) - 1),
            lambda i: (i == 0) | (_bin(F.get(chosen, i - 1), bins) != _bin(F.get(chosen, i), bins)),
        )

        def signature(i: Column) -> Column:
            number = _bin(F.get(chosen, i), bins)
            members = F.filter(F.slice(chosen, i + 1, picked), lambda run: _bin(run, bins) == number)
            in_order = F.sort_array(
                F.transform(
                    members,
                    lambda run: F.shiftleft(run, 64 - _PLACE_BITS).bitwiseOR(F.shiftrightunsigned(run, _PLACE_BITS)),
                )
            )
            hashed = F.aggregate(
                in_order, number, lambda found, run: F.xxhash64(found, F.shiftleft(run, _PLACE_BITS))
            )
            return F.shiftleft(number, 56).bitwiseOR(F.shiftrightunsigned(hashed, 8))

        return F.transform(first, signature)

    return _let(selected, of)


def order_minhash(text: Column, k: int = K, bins: int = BINS, picked: int = PICKED) -> Column:
    """The signature of a text: one number per bin that has runs, in order of the bins.

    ``bins`` is a power of two up to 128.
    """

    def of(hashes: Column) -> Column:
        return _let(
            _runs(hashes, k), lambda runs: _let(_numbered(runs), lambda own: F.array_sort(_tuples(own, bins, picked)))
        )

    hashes = F.transform(words(text), lambda word: F.xxhash64(word))
    none = F.array().cast("array<bigint>")
    return _let(hashes, lambda found: F.when(F.size(found) == 0, none).otherwise(of(found)))


def as_text(signature: Column) -> Column:
    """A signature as a string of 16 hexadecimal digits per bin."""
    return F.array_join(F.transform(signature, lambda number: F.lpad(F.lower(F.hex(number)), 16, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """The share of bins, of those either text has, whose tuples agree: 0 to 1; two empty texts are alike."""
    bins = F.size(
        F.array_union(
            F.transform(one, lambda n: F.shiftrightunsigned(n, 56)),
            F.transform(other, lambda n: F.shiftrightunsigned(n, 56)),
        )
    )
    same = F.size(F.array_intersect(one, other))
    return F.when(bins == 0, F.lit(1.0)).otherwise(same / bins).cast("double")


def with_next(docs: DataFrame, id_column: str, columns: tuple[str, ...], tie: str) -> DataFrame:
    """Add ``next_<column>`` of the row with the next smaller id; after the smallest comes the largest.

    Rows are dealt by id into groups of neighbours, bounded by approximate
    quantiles. The first row of each group is also dealt, as a guest, to the group that ends before it.
    So one shuffle suffices, and no task sees more than its group. The driver holds
    the bounds only, MOST_GROUPS at most.
    """
    ids = docs.agg(F.count(id_column).alias("n")).first()
    groups = min(MOST_GROUPS, max(1, -(-ids.n // GROUP_ROWS)))
    bounds: list[int] = []
    if groups > 1:
        shares = [i / groups for i in range(1, groups)]
        found = docs.agg(F.percentile_approx(id_column, shares, F.lit(10 * groups)).alias("at")).first()
        bounds = sorted(set(found["at"]))
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    table = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else None

    # Binary search: how many bounds are smaller than the id. Rows without an id come after all others.
    if table is None:
        searched = F.lit(0)
    else:
        searched = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda at, step: F.when(F.get(table, at + step - 1) < F.col(id_column), at + step).otherwise(at),
        )
    dealt = docs.withColumn("_group", F.when(F.col(id_column).isNull(), -1).otherwise(searched))
    firsts = {
        row["_group"]: row["top"] for row in dealt.groupBy("_group").agg(F.max(id_column).alias("top")).collect()
    }
    order = sorted(firsts, reverse=True)
    hosts = dict(zip(order[1:] + order[:1], order, strict=True))  # group -> the group its first row visits
    own = F.struct(F.col("_group").alias("group"), F.lit(0).alias("guest"))
    numbers = range(-1, max(firsts, default=-1) + 1)  # looked up by place in an array, from group -1 on

    def of_group(values: dict, kind: str) -> Column:
        return F.get(F.array(*(F.lit(values.get(g)).cast(kind) for g in numbers)), F.col("_group") + 1)

    visits = F.col(id_column).eqNullSafe(of_group(firsts, "bigint"))
    host = of_group(hosts, "int")
    places = F.when(visits, F.array(own, F.struct(host.alias("group"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    placed = dealt.withColumn("_place", F.explode(places))
    row = Window.partitionBy("_place.group").orderBy("_place.guest", F.desc(id_column), tie)
    led = placed.withColumns({f"next_{c}": F.lead(c).over(row) for c in columns})
    return led.where("_place.guest = 0").drop("_group", "_place")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, n_chars, signature) per row."""
    read = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias(text_column))
    return read.withColumns(
        {
            "n_chars": F.char_length(text_column).cast("bigint"),
            "signature": order_minhash(F.col(text_column)),
        }
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts, and of each with its second half taken from the next document's beginning."""
    marked = fingerprints(docs).withColumn("_tie", F.xxhash64("text"))
    led = with_next(marked, "doc_id", ("text", "signature"), "_tie")
    half = F.expr("cast(n_chars div 2 as int)")
    edited = led.select(
        "doc_id",
        "n_chars",
        "signature",
        "next_signature",
        F.concat(
            F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half)
        ).alias("edited"),
    )
    signed = edited.withColumn("edited_signature", order_minhash(F.col("edited")))
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
