"""Hard negatives by shared candidate lists per anchor cluster, walked until certified.

An anchor's score for a row is the integer inner product of their vectors. Its positives are the best rows of its own label; for each of these,
its hard negatives are the best rows of other labels whose scores lie in a band below the positive's.

1. Anchors are clustered by direction, around centroids fitted on a bounded sample of anchors (``SAMPLE``). Each cluster is packed into
   files of at most ``PACK`` anchors in the shared folder, so a cluster that holds a third of all anchors is just many files.
2. Rows are dealt into ranges of nearest centroid and angle, so neighbouring rows lie together. A task holds some
   ``SHARD`` rows at a time, whatever cluster they are near.
3. For an anchor cluster of half angle b, no member scores a row of norm r, at angle t from the centroid, above |u| r cos(max(0, t - b)). A task
   sorts its rows by this bound once per cluster, and every member of every pack walks that list, best bounds
   first, until what it still asks for is above the bound of all rows that are left: then it is certified. Whole packs that ask for more than
   the first bound are not walked.
4. Members first walk the rows near their own centroid. The scores found there are what they ask for at least when
   they walk all other rows, so hardly anything but the final rows leaves the tasks. The best per anchor are then taken from both walks.

The walk and its bounds are exact: no row is left out by them, ties included. Scores are exact integers; those beyond
64 bits are set to the nearest 64-bit integer.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of vectors of different
lengths, the shorter counts as if it went on in zeros. Rows that repeat an id are rows of their own, but no row is the positive of
its own id; a repeated anchor id has its rows repeated. An empty table gives an empty table. Other columns are dropped, so
their names cannot clash.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import releasing
from fiscal_ledger.settings import new_table_path

# Anchors that centroids are fitted on, centroids at most, steps of the fit.
SAMPLE = 4096
MOST_CLUSTERS = 128
FIT_STEPS = 8
# Anchors in a pack, rows that a task holds at once, rows that a member looks at in a step.
PACK = 1024
SHARD = 1 << 15
STEP = 512
# What rounding may add to a bound, as a share of the norms.
SLACK = 1e-6

NONE = np.iinfo(np.int64).min
_LARGEST = np.iinfo(np.int64).max


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number vectors, as 64-bit integers."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    largest = float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1]
    if largest < 2**53:  # every partial sum is a whole number that a double holds
        return (anchors @ rows.T).astype(np.int64)
    if largest < 2**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(anchors) @ whole(rows).T, NONE + 1, _LARGEST).astype(np.int64)


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros behind the shorter ones."""
    lengths = vectors.value_lengths().to_numpy()
    made = np.zeros((len(vectors), width))
    made[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy()
    return made


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms; the scale is taken out first, so squares cannot overflow."""
    largest = np.maximum(np.abs(vectors).max(axis=1, initial=0.0), 1e-300)
    scaled = vectors / largest[:, None]
    size = np.maximum(np.sqrt((scaled * scaled).sum(axis=1)), 1e-300)
    return scaled / size[:, None], np.where(largest > 1e-300, largest * size, 0.0)


def fit_centroids(vectors: np.ndarray) -> np.ndarray:
    """Directions of clusters: the vectors' own directions that are farthest apart, then means of those nearest."""
    units, _ = _units(vectors)
    count = min(MOST_CLUSTERS, max(1, int(np.sqrt(len(units)))))
    chosen = [0]
    nearest = units @ units[0]
    for _ in range(count - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centroids = units[chosen]
    for _ in range(FIT_STEPS):
        own = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        means, size = _units(sums)
        centroids = np.where(size[:, None] > 1e-9, means, centroids)
    return centroids


@dataclass
class Pack:
    """Anchors of one cluster, what each asks for, and the half angle around the centroid that holds them."""

    cluster: int
    angle: float
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    lows: np.ndarray  # anchors x wishes: no score below is wanted
    highs: np.ndarray  # nor above

    def asked(self) -> np.ndarray:
        """The least score that any wish of an anchor still wants."""
        wanted = np.where(self.lows <= self.highs, self.lows, _LARGEST)
        return wanted.min(axis=1, initial=_LARGEST)


def walk(pack: Pack, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray, keep: int, same: bool) -> Iterator[tuple]:
    """The best ``keep`` rows for each wish, as (anchor, wish, row, score) arrays.

    Rows come in descending order of ``bounds``, their greatest score for an anchor of norm 1. ``same`` asks
    for rows of the anchor's label and another id, otherwise for rows of other labels.
    """
    wishes = pack.lows.shape[1]
    lows, highs = pack.lows.copy(), pack.highs
    asked = pack.asked()
    best = np.full((len(pack.ids), wishes, keep), NONE)
    best_row = np.full((len(pack.ids), wishes, keep), -1)
    active = np.arange(len(pack.ids))
    for start in range(0, len(rows), STEP):
        # A member stops when no row from here on can reach what it asks for.
        active = active[pack.norms[active] * bounds[start] >= asked[active].astype(float)]
        if not len(active):
            break
        end = min(len(rows), start + STEP)
        scores = exact_scores(pack.vectors[active], rows[start:end])
        alike = pack.labels[active][:, None] == labels[start:end]
        fits = alike & (pack.ids[active][:, None] != ids[start:end]) if same else ~alike
        for wish in range(wishes):
            fitting = fits & (scores >= lows[active, wish][:, None]) & (scores <= highs[active, wish][:, None])
            who, row = np.nonzero(fitting)
            if not len(who):
                continue
            at = np.unique(active[who])
            held, place = np.nonzero(best_row[at, wish] >= 0)
            owner = np.concatenate((active[who], at[held]))
            number = np.concatenate((row + start, best_row[at[held], wish, place]))
            score = np.concatenate((scores[who, row], best[at[held], wish, place]))
            order = np.lexsort((ids[number], -score, owner))
            owner, number, score = owner[order], number[order], score[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            first = rank < keep
            best[owner[first], wish, rank[first]] = score[first]
            best_row[owner[first], wish, rank[first]] = number[first]
            full = best_row[at, wish, -1] >= 0
            lows[at[full], wish] = np.maximum(best[at[full], wish, -1], lows[at[full], wish])
        asked[active] = np.where(lows[active] <= highs[active], lows[active], _LARGEST).min(axis=1)
    anchor, wish, place = np.nonzero(best_row >= 0)
    if len(anchor):
        yield anchor, wish, best_row[anchor, wish, place], best[anchor, wish, place]


_PACK_SCHEMA = "pack string, cluster int, angle double, top_norm double, asked bigint"
_FOUND = "anchor_id bigint, copy bigint, wish int, other_id bigint, score bigint"


def _write_packs(anchors: DataFrame, folder: str, centroids: np.ndarray, wishes: int) -> DataFrame:
    """Write packs of anchors (vec_id, copy, label, vector, cluster, lows, highs); the list of them."""
    width = centroids.shape[1]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)

        def finish(table: pa.Table) -> pa.RecordBatch:
            cluster = table.column("cluster")[0].as_py()
            vectors = matrix(table.column("vector").combine_chunks(), width)
            units, norms = _units(vectors)
            angle = float(np.arccos(np.clip(units @ centroids[cluster], -1, 1)).max())
            name = f"{uuid.uuid4().hex}.parquet"
            with filesystem.open_output_stream(f"{root}/{name}") as stream:
                pq.write_table(table, stream, compression="zstd")
            lows, highs = (matrix64(table.column(c).combine_chunks(), wishes) for c in ("lows", "highs"))
            asked = int(np.where(lows <= highs, lows, _LARGEST).min())
            return pa.RecordBatch.from_pydict(
                {"pack": [name], "cluster": [cluster], "angle": [angle], "top_norm": [float(norms.max())], "asked": [asked]},
                schema=pa.schema(
                    [("pack", pa.string()), ("cluster", pa.int32()), ("angle", pa.float64()), ("top_norm", pa.float64()), ("asked", pa.int64())]
                ),
            )

        held: list[pa.RecordBatch] = []
        size, cluster = 0, None
        for batch in batches:
            clusters = batch.column("cluster").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(clusters)) + 1).tolist(), len(clusters)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                while start < end:
                    if size and (clusters[start] != cluster or size == PACK):
                        yield finish(pa.Table.from_batches(held))
                        held, size = [], 0
                    step = min(end - start, PACK - size)
                    held.append(batch.slice(start, step))
                    size, cluster, start = size + step, clusters[start], start + step
        if held:
            yield finish(pa.Table.from_batches(held))

    sorted_anchors = anchors.repartitionByRange("cluster", "vec_id", "copy").sortWithinPartitions("cluster")
    listed = f"{folder}/listed"
    sorted_anchors.mapInArrow(releasing(write), _PACK_SCHEMA).write.parquet(listed)
    return anchors.sparkSession.read.schema(_PACK_SCHEMA).parquet(listed)


def matrix64(values: pa.ListArray, width: int) -> np.ndarray:
    """Lists of one length as rows of integers."""
    return values.flatten().to_numpy().astype(np.int64).reshape(len(values), width)


def _pack_list(folder: str) -> list[dict]:
    """The packs' list, read by a task: one short row for each pack of anchors."""
    filesystem, root = fs.FileSystem.from_uri(f"{folder}/listed")
    files = filesystem.get_file_info(fs.FileSelector(root))
    rows: list[dict] = []
    for file in files:
        if file.base_name.startswith("part-"):
            with filesystem.open_input_stream(file.path) as stream:
                rows += pq.read_table(io.BytesIO(stream.read())).to_pylist()
    return sorted(rows, key=lambda r: (r["cluster"], r["pack"]))


def _read_pack(filesystem: fs.FileSystem, path: str, row: dict, width: int, wishes: int) -> tuple[Pack, np.ndarray]:
    with filesystem.open_input_stream(path) as stream:
        table = pq.read_table(io.BytesIO(stream.read()))
    vectors = matrix(table.column("vector").combine_chunks(), width)
    columns = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    lows, highs = (matrix64(table.column(c).combine_chunks(), wishes) for c in ("lows", "highs"))
    pack = Pack(row["cluster"], row["angle"], *columns, vectors, _units(vectors)[1], lows, highs)
    return pack, table.column("copy").to_numpy()


def _walked(rows: DataFrame, folder: str, centroids: np.ndarray, keep: int, wishes: int, same: bool, near: bool) -> DataFrame:
    """What the anchors of the packs find among the rows: near their own centroids, or among all others."""
    width = centroids.shape[1]

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                if held and size + part.num_rows > SHARD:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        listed = None
        for table in shards(batches):
            if listed is None:
                listed = _pack_list(folder)
                angle = {c: max(r["angle"] for r in listed if r["cluster"] == c) for c in {r["cluster"] for r in listed}}
            every_id, every_label, every_cluster = (table.column(c).to_numpy() for c in ("vec_id", "label", "cluster"))
            every_vector = matrix(table.column("vector").combine_chunks(), width)
            units, norms = _units(every_vector)
            angles = np.arccos(np.clip(units @ centroids.T, -1, 1))
            cluster = -1
            for row in listed:
                if row["cluster"] != cluster:
                    cluster = row["cluster"]
                    own = np.flatnonzero((every_cluster == cluster) == near)
                    # The list that all members of the cluster share.
                    bounds = norms[own] * (np.cos(np.maximum(0.0, angles[own, cluster] - angle[cluster])) + SLACK)
                    order = np.argsort(-bounds, kind="stable")
                    at, bounds = own[order], bounds[order]
                if not len(at) or row["top_norm"] * max(0.0, float(bounds[0])) < row["asked"]:
                    continue
                pack, copies = _read_pack(filesystem, f"{root}/{row['pack']}", row, width, wishes)
                for anchor, wish, found, score in walk(pack, every_vector[at], every_id[at], every_label[at], bounds, keep, same):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pack.ids[anchor]), pa.array(copies[anchor]), pa.array(wish.astype(np.int32)), pa.array(every_id[at][found]), pa.array(score)],
                        names=["anchor_id", "copy", "wish", "other_id", "score"],
                    )

    return rows.mapInArrow(releasing(run), _FOUND)


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best rows of each wish with their rank; each task has already left at most ``keep`` of them."""
    by = Window.partitionBy("anchor_id", "copy", "wish").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _search(anchors: DataFrame, rows: DataFrame, folder: str, centroids: np.ndarray, keep: int, wishes: int, same: bool) -> DataFrame:
    """The best rows of each wish of the anchors: walk what is near, ask for as much of the rest, walk that."""
    _write_packs(anchors, f"{folder}/near-packs", centroids, wishes)
    near = _written(_walked(rows, f"{folder}/near-packs", centroids, keep, wishes, same, True), f"{folder}/near")
    reached = _best(near, keep).where(F.col("rank") == keep).groupBy("anchor_id", "copy").agg(
        F.map_from_entries(F.collect_list(F.struct("wish", "score"))).alias("reached")
    )
    raised = anchors.join(reached.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "copy"], "left").withColumn(
        "lows",
        F.transform("lows", lambda low, wish: F.greatest(low, F.coalesce(F.try_element_at("reached", wish), low))),
    )
    _write_packs(raised.drop("reached"), f"{folder}/packs", centroids, wishes)
    others = _walked(rows, f"{folder}/packs", centroids, keep, wishes, same, False)
    return _written(_best(near.unionByName(others), keep), f"{folder}/best")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, vector).

    ``vector`` holds whole numbers as doubles; ``band`` is the share of the positive's score, in hundredths, that a
    negative's may have.
    """
    spark = rows.sparkSession
    folder = new_table_path(spark, "hard-negatives")
    usable = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(usable).where(F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("vector").cast("array<double>")
    )
    rows = _written(rows, f"{folder}/rows")
    # The sample is bounded; the widest vector is one number.
    sample = rows.where(is_anchor).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    sampled = matrix(sample.column("vector").combine_chunks(), width) if len(sample) else np.zeros((1, width))
    centroids = fit_centroids(sampled)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                likeness = _units(matrix(part.column("vector"), width))[0] @ centroids.T
                cluster = likeness.argmax(axis=1)
                cosine = likeness[np.arange(len(cluster)), cluster]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cluster.astype(np.int32)), pa.array(cosine)], names=[*part.schema.names, "cluster", "cosine"]
                )

    placed = rows.mapInArrow(near, "vec_id bigint, label bigint, vector array<double>, cluster int, cosine double")
    placed = placed.repartitionByRange("cluster", "cosine", "vec_id").sortWithinPartitions("cluster", "cosine", "vec_id")
    placed = _written(placed.withColumn("copy", F.monotonically_increasing_id()), f"{folder}/placed")
    anchors = placed.where(is_anchor).select("vec_id", "copy", "label", "vector", "cluster")
    whole = F.lit(NONE + 1), F.lit(_LARGEST)
    wanting = anchors.withColumns({"lows": F.array(whole[0]), "highs": F.array(whole[1])})
    best = _search(wanting, placed, f"{folder}/positives", centroids, positives, 1, True)
    best = best.select("anchor_id", "copy", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # One wish per place of a positive: the scores in its band, in whole numbers. That of a negative score is empty.
    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(score * band[0] / 100).cast("bigint"), F.floor(score * band[1] / 100).cast("bigint")
    bands = best.select("anchor_id", "copy", "place", low.alias("low"), high.alias("high"))
    none = F.struct(F.lit(_LARGEST).alias("low"), F.lit(NONE + 1).alias("high"))
    by_place = bands.groupBy("anchor_id", "copy").agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.struct("low", "high")))).alias("bands")
    )
    places = F.sequence(F.lit(1), F.lit(positives))
    wished = anchors.join(by_place.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "copy"]).withColumn(
        "wished", F.transform(places, lambda place: F.coalesce(F.try_element_at("bands", place), none))
    )
    wanting = wished.select("vec_id", "copy", "label", "vector", "cluster", F.col("wished.low").alias("lows"), F.col("wished.high").alias("highs"))
    found = _search(wanting, placed, f"{folder}/negatives", centroids, negatives, positives, False)
    return (
        found.withColumn("place", F.col("wish") + 1)
        .join(best, ["anchor_id", "copy", "place"])
        .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all, with every seventh label moved on by one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    # A double from 2^53 on is whole; floor would make a bigint of it, and a number of what is none.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    rows = table.select("vec_id", moved.alias("label"), whole.alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), multiplied AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, a.vec_id <> b.vec_id AS other,
           coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS exact
    FROM valid a JOIN valid b ON a.vec_id % 100 = 0
), scored AS (
    SELECT *, CASE WHEN exact >= 9.2e18 THEN 9223372036854775807 WHEN exact <= -9.2e18 THEN -9223372036854775807
              ELSE CAST(exact AS BIGINT) END AS score
    FROM multiplied
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same AND other
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * CAST(p.positive_score AS HUGEINT) <= 100 * CAST(s.score AS HUGEINT)
  AND 100 * CAST(s.score AS HUGEINT) <= 90 * CAST(p.positive_score AS HUGEINT)
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
