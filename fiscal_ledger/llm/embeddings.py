"""Near-duplicate embeddings by NN-descent.

Vectors are compared with those of the same label and length only. Equal vectors are one node with a weight.

1. **Start.** Sets of random hyperplanes deal each label into blocks; in its block each node finds its
   ``NEIGHBOURS`` nearest. There are as many sets as it takes for a pair at the threshold to share a
   block with a chance of ``RECALL``. Blocks beyond ``MOST_BLOCK`` are dealt on by hash.
   Wherever nodes are compared, a spanning forest of all links among them is kept besides the lists, so clumps with
   more near members than a list holds are still joined by the links between them.
2. **Descent.** Each node brings together the nodes on its list and those that list it. They are compared with
   each other, and every list keeps the nearest. Nodes that are on very many lists are split into
   chunks of ``CHUNK``, so a hub is spread over many tasks.
   It goes on until the lists gain no link.
3. **Links.** Pairs on the lists and forests are verified in double precision. Where a list is saturated, full of
   linked nodes, it is enlarged to the whole connected component: its members are compared block by block and
   only counts leave a task. No list of all pairs is ever made.
4. **Audit.** The true links of nodes chosen by hash are counted against all rows, for ``AUDITED`` nodes at a time until enough
   linked ones are met. Where none has a link, probes are made at the threshold from ``AUDITED`` vectors, and those that
   share a block with their vector are counted. If the result has less than ``RECALL`` of the links, or of the probes less by
   more than chance explains, the search goes on with twice the sets of hyperplanes; if that does not help
   ``MOST_SEARCHES`` times, it is an error.

Null, zero and non-finite vectors and vectors without a label link with nothing: no links, their own component. Repeated
rows are copies like any others. Ids may repeat; a component's id is its smallest id. An empty table gives an empty
table. Other columns are dropped, so their names cannot clash. Nodes are 64-bit hashes of label and vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.llm.graph import components
from fiscal_ledger.llm.memory import releasing
from fiscal_ledger.settings import new_table_path

THRESHOLD = 0.93
NEIGHBOURS = 8
TABLES = 4
BLOCK = 256
MOST_BLOCK = 1024
CHUNK = 128
AUDITED = 1000
# Linked nodes an audit should have, and how many times AUDITED nodes are asked for them.
AUDITED_LINKED = 100
MOST_AUDITS = 8
RECALL = 0.995
# Three standard deviations of a share of RECALL among AUDITED probes.
PROBE_ERROR = 0.007
MOST_SEARCHES = 4
MOST_ROUNDS = 8
SEED = 7
# Lists are made from half-precision vectors; pairs this far below the threshold are verified still.
SLACK = 0.01
# Rounding to half precision moves a similarity by less than this.
ROUNDING = 0.002


def _table(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    if not len(values):
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1)


def _nodes(vectors: DataFrame) -> DataFrame:
    """(node, grp, unit, half, weight, least): distinct valid vectors, scaled to length 1."""

    def scale(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, halves = [], []
            for embedding in batch.column("embedding"):
                values = embedding.values
                unit = half = None
                if values is not None and len(values) and not values.null_count:
                    vector = values.to_numpy().astype(np.float64)
                    top = np.abs(vector).max()
                    if np.isfinite(top) and top > 0 and np.isfinite(vector).all():
                        vector = vector / top  # so that squares neither overflow nor vanish
                        vector = vector / np.sqrt(vector @ vector)
                        unit, half = vector.tobytes(), vector.astype(np.float16).tobytes()
                units.append(unit)
                halves.append(half)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "embedding"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(units, pa.binary()), pa.array(halves, pa.binary())],
                names=["node", "grp", "weight", "least", "unit", "half"],
            )

    labelled = vectors.where("label IS NOT NULL AND embedding IS NOT NULL")
    grouped = labelled.groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")
    )
    named = grouped.select(
        F.xxhash64("label", "embedding").alias("node"),
        F.concat_ws("/", F.size("embedding").cast("string"), F.col("label").cast("string")).alias("grp"),
        "weight",
        "least",
        "embedding",
    )
    schema = "node bigint, grp string, weight bigint, least bigint, unit binary, half binary"
    return named.mapInArrow(releasing(scale), schema).where("unit IS NOT NULL")


def _nearest(
    names: np.ndarray, vectors: np.ndarray, count: int, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, similarity, tree): each vector's nearest ``count`` others, and links that connect all that are linked.

    Worked off in strips. Links within rounding of the threshold are all given between what surer links
    leave apart, since some of them may not hold.
    """
    count = min(count, len(names) - 1)
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
    us, vs, sims = [], [], []
    near = np.zeros((len(names), len(names)), bool)
    sure = np.zeros((len(names), len(names)), bool)
    for first in range(0, len(names), 512):
        strip = vectors[first : first + 512] @ vectors.T
        strip[np.arange(len(strip)), np.arange(first, first + len(strip))] = -2
        best = np.argpartition(-strip, count - 1, axis=1)[:, :count]
        us.append(np.repeat(np.arange(first, first + len(strip)), count))
        vs.append(best.ravel())
        sims.append(np.take_along_axis(strip, best, axis=1).ravel())
        near[first : first + 512] = strip >= threshold - ROUNDING
        sure[first : first + 512] = strip >= threshold + ROUNDING
    children, parents, group = _forest(sure)
    linked = np.flatnonzero(near.any(axis=1))
    one, other = np.nonzero(np.triu((near & ~sure)[np.ix_(linked, linked)]))
    one, other = linked[one], linked[other]
    apart = group[one] != group[other]
    children, parents = np.concatenate((children, one[apart])), np.concatenate((parents, other[apart]))
    u, v = np.concatenate((*us, children)), np.concatenate((*vs, parents))
    sim = np.concatenate((*sims, np.einsum("ij,ij->i", vectors[children], vectors[parents])))
    tree = np.arange(len(u)) >= len(u) - len(children)
    return names[u], names[v], sim.astype(np.float32), tree


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children and parents of a spanning forest of a symmetric matrix, and the root of every row."""
    root = np.arange(len(linked))
    children, parents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_ = linked.any(axis=1)
    for start in np.flatnonzero(open_):
        if not open_[start]:
            continue
        open_[start] = False
        edge = np.array([start])
        while len(edge):
            left = np.flatnonzero(open_)
            met = linked[np.ix_(edge, left)]
            hit = met.any(axis=0)
            children.append(left[hit])
            parents.append(edge[met[:, hit].argmax(axis=0)] if hit.any() else left[hit])
            edge = left[hit]
            open_[edge] = False
            root[edge] = start
    return np.concatenate(children), np.concatenate(parents), root


_PAIRS = "u bigint, v bigint, sim float, tree boolean"
_PAIR_NAMES = ["u", "v", "sim", "tree"]


def _best_within(groups, threshold: float) -> DataFrame:
    """Nearest others of each member of grouped (node, half), and forests of their links."""

    def best(table: pa.Table) -> pa.Table:
        halves = _matrix(table.column("half"), np.float16).astype(np.float32)
        found = _nearest(table.column("node").to_numpy(), halves, NEIGHBOURS, threshold)
        return pa.Table.from_arrays(list(map(pa.array, found)), names=_PAIR_NAMES)

    return groups.applyInArrow(best, _PAIRS)


def _chance(bits: int, tables: int, threshold: float) -> float:
    """Chance that two vectors at the threshold share a block: a plane parts them with their angle over pi."""
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return 1 - (1 - together) ** tables


def _tables(bits: int, threshold: float) -> int:
    """How many sets of hyperplanes find a pair at the threshold with a chance of RECALL."""
    tables = TABLES
    while _chance(bits, tables, threshold) < RECALL:
        tables += 1
    return tables


_BLOCK_OF = ["grp", "part", "signs"]


def _dealt(nodes: DataFrame, bits: int, tables: range) -> DataFrame:
    """(grp, part, signs, node, half): the sides of random hyperplanes that each node is on, per set of them."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.frombuffer(half, np.float16) for half in batch.column("half").to_pylist()]
            lengths = np.array([len(vector) for vector in vectors])
            sides = np.zeros((len(tables), batch.num_rows), np.int64)
            for length in set(lengths.tolist()):
                if length not in planes:
                    drawn = [np.random.default_rng([SEED, number]).standard_normal((bits, length)) for number in tables]
                    planes[length] = np.array(drawn, np.float32)
                rows = np.flatnonzero(lengths == length)
                matrix = np.array([vectors[row] for row in rows], np.float32)
                for place, plane in enumerate(planes[length]):
                    sides[place, rows] = (matrix @ plane.T > 0) @ (1 << np.arange(bits, dtype=np.int64))
            for place, number in enumerate(tables):
                part = pa.array(np.full(batch.num_rows, number), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp"), part, pa.array(sides[place]), batch.column("node"), batch.column("half")],
                    names=["grp", "part", "signs", "node", "half"],
                )

    return nodes.select("grp", "node", "half").mapInArrow(
        releasing(deal), "grp string, part bigint, signs bigint, node bigint, half binary"
    )


def _large(dealt: DataFrame) -> DataFrame:
    """(grp, part, signs, count) of blocks with too many nodes."""
    return dealt.groupBy(_BLOCK_OF).count().where(F.col("count") > MOST_BLOCK)


def _salted(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """Large blocks dealt on by hash, the part as a column salt."""
    return dealt.join(large, _BLOCK_OF, "left").withColumn(
        "salt", F.pmod(F.xxhash64("node", "part"), F.ceil(F.coalesce("count", F.lit(1)) / MOST_BLOCK))
    )


def _start(nodes: DataFrame, bits: int, tables: range, threshold: float) -> DataFrame:
    """Candidate pairs from blocks of nodes on the same side of random hyperplanes."""
    dealt = _dealt(nodes, bits, tables)
    return _best_within(_salted(dealt, _large(dealt)).groupBy(*_BLOCK_OF, "salt"), threshold)


def _probed(nodes: DataFrame, bits: int, tables: int, threshold: float) -> float:
    """Share of AUDITED nodes that share a block with a probe, a vector made at the threshold from the node's.

    Probes are dealt into the blocks of all nodes but compared with none, so no result depends on them.
    """
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", "grp", "unit").collect()
    if not chosen:
        return 1.0
    rng = np.random.default_rng([SEED, tables])
    cosine = min(1.0, threshold + ROUNDING)
    rows = []
    for number, row in enumerate(chosen):
        unit = np.frombuffer(row.unit, np.float64)
        side = rng.standard_normal(len(unit))
        side -= (side @ unit) * unit
        length = np.sqrt(side @ side)
        # In one dimension nothing is at the threshold; the node's copy stands for it.
        probe = cosine * unit + np.sqrt(1 - cosine**2) * side / length if len(unit) > 1 else unit
        rows.append((row.node, number, row.grp, unit.astype(np.float16).tobytes(), probe.astype(np.float16).tobytes()))
    pairs = nodes.sparkSession.createDataFrame(rows, "origin bigint, probe bigint, grp string, own binary, turned binary")
    large = _large(_dealt(nodes, bits, range(tables)))

    def blocks(name: str, half: str) -> DataFrame:
        one = pairs.select(F.col(name).alias("node"), "grp", F.col(half).alias("half"))
        return _salted(_dealt(one, bits, range(tables)), large).select(*_BLOCK_OF, "salt", F.col("node").alias(name))

    origins = blocks("origin", "own").join(pairs.select("origin", "probe"), "origin")
    met = origins.join(blocks("probe", "turned"), [*_BLOCK_OF, "salt", "probe"])
    return met.select("probe").distinct().count() / len(chosen)


def _lists(pairs: DataFrame) -> DataFrame:
    """The nearest of each u and its links on forests, as pairs again; near: whether on the list."""
    best = (
        pairs.repartition(F.col("u"))
        .groupBy("u", "v")
        .agg(F.max("sim").alias("sim"), F.max("tree").alias("tree"))
        .groupBy("u")
        .agg(F.collect_list(F.struct("sim", "v", "tree")).alias("found"))
    )
    placed = best.select("u", F.posexplode(F.sort_array("found", asc=False)).alias("place", "one"))
    kept = placed.select("u", "one.v", "one.sim", "one.tree", (F.col("place") < NEIGHBOURS).alias("near"))
    return kept.where("near OR tree")


def _descend(lists: DataFrame, nodes: DataFrame, path: str, threshold: float) -> DataFrame:
    """One round: compare the nodes that meet around each node with each other."""
    near = lists.where("near")
    meeting = (
        near.select(F.col("u").alias("centre"), F.col("v").alias("node"))
        .unionByName(near.select(F.col("v").alias("centre"), F.col("u").alias("node")))
        .distinct()
    )
    # A table of its own: Spark splits a hub only where both sides of the join come straight from a shuffle.
    counts = _table(meeting.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), f"{path}-counts")
    placed = meeting.join(counts, "centre").select(
        "centre", "node", F.pmod(F.xxhash64("node", "centre"), "chunks").alias("chunk")
    )
    # The centre itself meets every chunk.
    itself = counts.select(
        "centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk")
    )
    members = placed.unionByName(itself).join(nodes.select("node", "half"), "node")
    found = _best_within(members.groupBy("centre", "chunk"), threshold)
    return _lists(found.unionByName(lists.drop("near")))


def _true_links(nodes: DataFrame, threshold: float) -> dict[int, int]:
    """The weight of the nodes each audited node is linked with, counted against all rows."""
    truth: dict[int, int] = {}
    for turn in range(MOST_AUDITS):
        chosen = (
            nodes.orderBy(F.xxhash64("node"), "node").offset(turn * AUDITED).limit(AUDITED).select("node", "grp", "unit").collect()
        )
        if chosen:
            truth |= _links_of(chosen, nodes, threshold)
        if len(chosen) < AUDITED or sum(links > 0 for links in truth.values()) >= AUDITED_LINKED:
            break
    return truth


def _links_of(chosen: list, nodes: DataFrame, threshold: float) -> dict[int, int]:
    asked: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for group in {row.grp for row in chosen}:
        rows = [row for row in chosen if row.grp == group]
        asked[group] = (
            np.array([row.node for row in rows]),
            np.stack([np.frombuffer(row.unit, np.float64) for row in rows]),
        )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            names, weights = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            for group in set(groups) & asked.keys():
                rows = np.array([i for i, g in enumerate(groups) if g == group])
                units = _matrix(batch.column("unit").take(pa.array(rows)), np.float64)
                queries, vectors = asked[group]
                linked = (vectors @ units.T >= threshold) & (queries[:, None] != names[rows][None, :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries), pa.array(linked @ weights[rows])], names=["node", "links"]
                )

    counted = nodes.select("node", "grp", "weight", "unit").mapInArrow(releasing(count), "node bigint, links bigint")
    return {row.node: row.links for row in counted.groupBy("node").agg(F.sum("links").alias("links")).collect()}


def _audit(counts: DataFrame, truth: dict[int, int]) -> float | None:
    """Share of the audited nodes' true links that are in the counts; None without true links."""
    wanted = {node: links for node, links in truth.items() if links}
    if not wanted:
        return None
    held = {row.node: row.links for row in counts.where(F.col("node").isin(list(wanted))).collect()}
    return sum(min(held.get(node, 0), links) for node, links in wanted.items()) / sum(wanted.values())


def _verify(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = _matrix(batch.column("one"), np.float64), _matrix(batch.column("other"), np.float64)
            kept = np.einsum("ij,ij->i", one, other) >= threshold if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["u", "v"]).filter(pa.array(kept))

    joined = pairs.join(nodes.select(F.col("node").alias("u"), "grp", F.col("unit").alias("one")), "u").join(
        nodes.select(F.col("node").alias("v"), F.col("unit").alias("other")), "v"
    )
    # One length per batch: lists hold nodes of one group only, and sorting by group keeps those together.
    return joined.sortWithinPartitions("grp").mapInArrow(releasing(_per_length(check)), "u bigint, v bigint")


def _per_length(of):
    """Cut batches where the length of the vectors changes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(value.as_buffer()) for value in batch.column("one")])
            edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1), len(lengths)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                yield from of([batch.slice(first, last - first)])

    return cut


def _component_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): links inside the component, weighted, from (component, node, weight, unit).

    Blocks of a component meet in pairs; a task sees two blocks and gives a count per node.
    """
    size = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keyed = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def count(table: pa.Table) -> pa.Table:
        names, weights = table.column("node").to_numpy(), table.column("weight").to_numpy()
        units, block = _matrix(table.column("unit"), np.float64), table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        linked = units[one] @ units[two].T >= threshold
        if low == high:
            np.fill_diagonal(linked, False)
            return pa.Table.from_arrays([pa.array(names[one]), pa.array(linked @ weights[two])], names=["node", "links"])
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate((names[one], names[two]))),
                pa.array(np.concatenate((linked @ weights[two], linked.T @ weights[one]))),
            ],
            names=["node", "links"],
        )

    counted = keyed.groupBy("component", "low", "high").applyInArrow(count, "node bigint, links bigint")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _linked(lists: DataFrame, nodes: DataFrame, threshold: float, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables (node, component, ...) and (node, links) of the nodes with links."""
    pairs = (
        lists.where(F.col("sim") >= threshold - SLACK)
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = _table(_verify(pairs, nodes, threshold), f"{path}/links")
    members = _table(components(links).join(nodes, "node"), f"{path}/members")
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        links.select(F.col("v").alias("node"), F.col("u").alias("other"))
    )
    weights = members.select(F.col("node").alias("other"), "weight", "component")
    listed = both.join(weights, "other").groupBy("node", "component").agg(
        F.sum("weight").alias("links"), F.count(F.lit(1)).alias("linked")
    )
    # A full list may have left linked nodes out, so its component is compared as a whole; so are small ones, at little cost.
    sized = listed.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("linked").alias("linked"))
    full = sized.where((F.col("linked") >= NEIGHBOURS) | F.col("size").between(3, BLOCK)).select("component")
    enlarged = _component_counts(members.join(full, "component").select("component", "node", "weight", "unit"), threshold)
    short = listed.join(full, "component", "left_anti").select("node", "links")
    return members, _table(short.unionByName(enlarged), f"{path}/counts")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, rounds: int = MOST_ROUNDS
) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label), and the audited recall.

    ``rounds``: descents between audits at most. Without any true link to audit, the recall is that of the probes.
    """
    path = new_table_path(vectors.sparkSession, "embeddings")
    read = vectors.select("vec_id", "embedding", "label")
    nodes = _table(_nodes(read), f"{path}/nodes")
    largest = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, largest) / BLOCK))))
    truth = _true_links(nodes, threshold)
    lists, done, tables = None, 0, _tables(bits, threshold)
    for search in range(MOST_SEARCHES):
        at = f"{path}/search-{search}"
        found = _start(nodes, bits, range(done, tables), threshold)
        lists = _table(_lists(found if lists is None else found.unionByName(lists.drop("near"))), f"{at}/lists-0")
        seen = None
        for number in range(1, rounds + 1):
            linked = lists.where("near").where(F.col("sim") >= threshold - SLACK)
            state = linked.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen:
                break
            seen = state
            lists = _table(_descend(lists, nodes, f"{at}/lists-{number}", threshold), f"{at}/lists-{number}")
        members, counts = _linked(lists, nodes, threshold, at)
        recall, least_recall = _audit(counts, truth), RECALL
        if recall is None:
            recall, least_recall = _probed(nodes, bits, tables, threshold), RECALL - PROBE_ERROR
        if recall >= least_recall:
            break
        done, tables = tables, 2 * tables
    else:
        raise RuntimeError(f"near-duplicate embeddings: {recall:.4f} of the audited links found, {RECALL} needed")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = (
        nodes.select("node", "weight", "least")
        .join(members.select("node", "component"), "node", "left")
        .join(least, "component", "left")
        .join(counts, "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    rows = read.select("vec_id", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")).alias("node"))
    result = rows.join(of_node, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
