"""Near-duplicate documents by Order MinHash, candidates verified by banded alignment.

Words are runs of letters and digits, case aside. A text becomes its overlapping runs of ``K`` words, a run that
was met before numbered by how often. Each of ``SKETCHES`` hashes picks the ``PICKED`` smallest runs; the
tuple of them, in text order, is a bucket. Two texts that share runs in the same order meet in many of them.
Of texts of up to ``SHORT`` words, and of those that could be like them, every run is a bucket: edits within the
threshold leave texts of 6 words or more a run of 3 words in common, and shorter ones (up to 5) a run of 2, so these meet for certain.

Each text is first compared with the smallest member of one of its buckets, then, where they are not in one class by then, with those of
the others. Buckets whose other members are of more than one class after that are cut into blocks of about ``BLOCK`` members by length class and hash. Only
blocks whose lengths can be alike meet, and a task compares the signs of two blocks at once, as arrays: how many words of each of
``KINDS`` classes a text has, which rules out nearly all unlike texts. A pair is looked at in one bucket only, the smallest that both texts are in.
What this leaves are tiles of up to ``TILE`` texts of either block, a row each, with the pairs in two bytes each. A task gets the words of a tile's texts and
tries its pairs, the closest first, but for those that are in one class by then; only the links that join classes leave it, fewer than the tile has texts.
So every pair of different classes in a bucket has been ruled out or tried, in one round. Pairs are verified by the
exact word edit distance inside the band that the threshold allows, ``1 - distance / longer >= 0.8``. Classes are
the connected components.

Equal texts are one node from the start, whatever their number. Nulls count as empty text; texts without any words
match equal texts only; of fewer than K words there is one run, and all their pairs of words. Ids may repeat or be null: a row's
class is the smallest id in it, null if no row of it has one. An empty table gives an empty table. Other
columns are dropped, so their names cannot clash. Nodes are 64-bit hashes of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.llm.graph import components
from fiscal_ledger.llm.memory import release, releasing
from fiscal_ledger.settings import new_table_path

K = 3
SKETCHES = 40
PICKED = 2
# Words of texts whose every run is a bucket; texts like one of them have at most this over SIMILARITY.
SHORT = 40
# Members of a block; texts, and words if there are several texts, on one side of a tile.
BLOCK = 512
TILE = 128
TILE_WORDS = 1 << 21
# Word counts of a text are kept by so many classes of words.
KINDS = 64
SIMILARITY = 0.8
# Edits up to which a band is aligned as bits; a wider one by diagonals, with the same result.
MOST_BITS = 2047
# Bytes of text sketched at once; the arrays of a piece take some 30 times as many.
PIECE_BYTES = 1 << 19

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


# Bytes of words: ASCII letters and digits, and all bytes of other characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, end to end, and the offsets of the texts in them."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    # A word's hash is a polynomial in its bytes, by prefix sums over the piece.
    powers = np.full(len(data) + 1, _ODD, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers[:-1], out=sums[1:])
    # Divided by the power at the word's place, so equal words are equal wherever they stand.
    inverse = _U(pow(int(powers[len(data)]), -1, 1 << 64))
    hashes = _mix((sums[end] - sums[begin]) * powers[len(data) - begin] * inverse)
    ends = np.cumsum([len(c) + 1 for c in coded])
    return hashes, np.concatenate(([0], np.searchsorted(begin, ends))).astype(np.int64)


def sketch(hashes: np.ndarray, offsets: np.ndarray, k: int = K, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the texts, end to end, and how many each text has."""
    lengths = np.diff(offsets)
    worded = np.flatnonzero(lengths > 0)
    counts = np.maximum(lengths[worded] - k + 1, 1)
    starts = np.concatenate(([0], np.cumsum(counts)))
    if not len(worded):
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    owner = np.repeat(np.arange(len(worded)), counts)
    place = np.arange(starts[-1]) - starts[owner]
    first = offsets[worded][owner] + place
    last = offsets[worded + 1][owner]
    runs = np.zeros(len(first), np.uint64)
    for step in range(k):
        at = first + step
        runs = runs * _U(0xC2B2AE3D27D4EB4F) + np.where(at < last, hashes[np.minimum(at, len(hashes) - 1)], _U(step + 1))
    runs = _mix(runs)
    # Buckets of short texts: all runs, and pairs of words where an edit may leave no longer run.
    sizes = lengths[worded]
    brief = (sizes <= SHORT / SIMILARITY)[owner]
    exact, exact_owner = [_mix(runs[brief] + _U(1))], [owner[brief]]
    tiny = np.flatnonzero((lengths > 1) & (lengths <= 5))
    for step in range(4):
        long_enough = tiny[lengths[tiny] > step + 1]
        at = offsets[long_enough] + step
        exact.append(_mix(hashes[at] * _ODD + hashes[at + 1] + _U(2)))
        exact_owner.append(np.searchsorted(worded, long_enough))
    # Number equal runs of a text by their order.
    owned = _mix(runs + owner.astype(np.uint64) * _ODD)
    order = np.argsort(owned, kind="stable")
    fresh = np.concatenate(([True], owned[order][1:] != owned[order][:-1]))
    seen = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    times = np.empty(len(order), np.uint64)
    times[order] = seen
    runs = _mix(runs + times * _U(0x165667B19E3779F9))

    bits = _U(24)
    low = (_U(1) << bits) - _U(1)
    where = np.minimum(place, (1 << 24) - 1).astype(np.uint64)
    keys = np.zeros((len(worded), sketches), np.uint64)
    for number in range(sketches):
        seed = _mix(np.array([number + 1], np.uint64) * _ODD)[0] | _U(1)
        ranked = ((runs * seed) >> bits << bits) | where
        chosen = []
        for _ in range(PICKED):
            least = np.minimum.reduceat(ranked, starts[:-1])
            # A text of fewer runs than are picked names its last one again.
            chosen.append(np.minimum((least & low).astype(np.int64), counts - 1))
            taken = starts[:-1] + chosen[-1]
            ranked[taken] = np.iinfo(np.uint64).max
        spots = np.sort(np.stack(chosen), axis=0)
        found = np.full(len(worded), number, np.uint64)
        for spot in spots:
            found = _mix(found * _ODD + runs[starts[:-1] + spot])
        keys[:, number] = found
    sketched = np.flatnonzero(sizes > SHORT)
    owners = np.concatenate((*exact_owner, np.repeat(sketched, sketches)))
    order = np.argsort(owners, kind="stable")
    counts = np.zeros(len(lengths), np.int64)
    counts[worded] = np.bincount(owners, minlength=len(worded))
    return np.concatenate((*exact, keys[sketched].ravel()))[order].view(np.int64), counts


def signs(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per text how many words it has, and how many of each of ``KINDS`` classes of words."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    kinds = (_mix(hashes[: len(owner)]) % _U(KINDS)).astype(np.int64)
    counts = np.bincount(owner * KINDS + kinds, minlength=len(lengths) * KINDS).reshape(-1, KINDS)
    # Counts beyond 16 bits are cut to them, which only brings texts closer.
    small = np.minimum(counts, 65535).astype("<u2")
    return [int(n).to_bytes(8, "little") + row.tobytes() for n, row in zip(lengths, small, strict=True)]


def _parts(of: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its counts by class of words."""
    table = np.frombuffer(b"".join(of), np.uint8).reshape(len(of), 8 + 2 * KINDS)
    return table[:, :8].copy().view("<i8")[:, 0], table[:, 8:].copy().view("<u2").astype(np.int32)


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of edits between texts with these counts: an edit changes one word for another at most."""
    gone = a - b
    more = np.maximum(gone, 0).sum(axis=-1)
    return np.maximum(more, more - gone.sum(axis=-1))


def may_be_alike(one: list[bytes], other: list[bytes], similarity: float = SIMILARITY) -> np.ndarray:
    """False where the signs of two texts rule out that they are alike."""
    (n, a), (m, b) = _parts(one), _parts(other)
    most = np.floor((1 - similarity) * np.maximum(n, m) + 1e-9)
    return (np.abs(n - m) <= most) & (_edits(a, b) <= most)


def closest(
    one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], allowed: np.ndarray, most_each: int, similarity: float = SIMILARITY
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of two blocks (words, counts) that may be alike: each text's closest on the other side, closest first, and whether there are more."""
    (n, a), (m, b) = one, other
    longer = np.maximum(n[:, None], m[None])
    most = np.floor((1 - similarity) * longer + 1e-9)
    x, y = np.nonzero(allowed & (np.abs(n[:, None] - m[None]) <= most))
    share = np.full(allowed.shape, np.inf)
    step = (1 << 22) // KINDS
    for start in range(0, len(x), step):
        i, j = x[start : start + step], y[start : start + step]
        edits = _edits(a[i], b[j])
        share[i, j] = np.where(edits <= most[i, j], edits / np.maximum(longer[i, j], 1), np.inf)
    possible = share < np.inf
    chosen = np.zeros(possible.shape, bool)
    for axis in (0, 1):
        if possible.shape[axis] <= most_each:
            chosen |= possible
        else:
            least = np.argpartition(share, most_each - 1, axis=axis)
            best = np.take(least, np.arange(most_each), axis=axis)
            marks = np.zeros(possible.shape, bool)
            np.put_along_axis(marks, best, True, axis=axis)
            chosen |= marks & possible
    x, y = np.nonzero(chosen)
    order = np.argsort(share[x, y], kind="stable")
    return x[order], y[order], bool((possible & ~chosen).any())


def _sketch_table(texts: DataFrame) -> DataFrame:
    """(doc_id, node, keys, sign, span) of (doc_id, node, text); texts that are alike have spans of at most one apart."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what an earlier stage has left in this worker
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            first = 0
            while first < len(sizes):
                last, held = first, 0
                while last < len(sizes) and (last == first or held + sizes[last] <= PIECE_BYTES):
                    held += int(sizes[last])
                    last += 1
                hashes, ends = hash_words(batch.column("text").slice(first, last - first).to_pylist())
                keys, counts = sketch(hashes, ends)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
                part = batch.slice(first, last - first)
                # A little wider than the similarity asks for, so that rounding can't put alike texts two apart.
                spans = np.floor(np.log(np.maximum(np.diff(ends), 1)) / (np.log(1 / SIMILARITY) + 1e-6)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"), lists, pa.array(signs(hashes, ends), pa.binary()), pa.array(spans)],
                    names=["doc_id", "node", "keys", "sign", "span"],
                )
                first = last

    return texts.mapInArrow(releasing(of), "doc_id bigint, node bigint, keys array<bigint>, sign binary, span int")


def _distance_in_bits(one: list[int], other: list[int], most: int) -> int:
    """The edit distance if it is at most ``most``, else a number beyond it, for lengths that differ by at most ``most``.

    A column of the band is a whole number per sign: in which of its ``2 * most + 1`` rows the distance is one
    more, or one less, than in the row above. From column to column the band moves down by one row.
    """
    n, top = len(one), 2 * most
    band = (1 << top + 1) - 1
    more, less = band ^ ((1 << most) - 1), 0
    # Rows of the band by word, and the column that they are stated for.
    rows: dict[int, tuple[int, int]] = {}

    def of(word: int, column: int) -> int:
        bits, since = rows.get(word, (0, column))
        return bits >> column - since

    for row in range(min(most, n)):
        rows[one[row]] = (of(one[row], 0) | 1 << most + row, 0)
    # Followed along the lower edge until that meets the last row, and along this row from there.
    distance = min(most, n)
    for column, word in enumerate(other):
        entering = column + most
        if entering < n:
            rows[one[entering]] = (of(one[entering], column) | 1 << top, column)
        equal = of(word, column)
        kept = ((((equal & more) + more) & band) ^ more) | equal | less
        right_more = less | (band ^ (kept | more))
        right_less = kept & more
        if entering < n:
            distance += not kept >> top
        else:
            place = n - 1 - column + most
            distance += (right_more >> place & 1) - (right_less >> place & 1)
        kept >>= 1
        more, less = right_less | (band ^ (kept | right_more)), kept & right_more
    return distance


def edit_distance_within(one: np.ndarray, other: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    Up to ``MOST_BITS`` the columns of the band are worked off as bits. Beyond, round d holds, for each diagonal of the
    band, how far d edits reach. Equal stretches are passed over by comparing prefix hashes, by bisection for the
    whole band at once.
    """
    short = min(len(one), len(other))
    if abs(len(one) - len(other)) > most:
        return None
    differs = np.flatnonzero(one[:short] != other[:short])
    head = int(differs[0]) if len(differs) else short
    one, other = one[head:], other[head:]
    short = min(len(one), len(other))
    if not short:
        return max(len(one), len(other))
    differs = np.flatnonzero(one[::-1][:short] != other[::-1][:short])
    tail = int(differs[0]) if len(differs) else short
    one, other = one[: len(one) - tail], other[: len(other) - tail]
    n, m = len(one), len(other)
    if not min(n, m):
        return max(n, m) if max(n, m) <= most else None
    # Words only one of the two has must be edited away.
    _, codes = np.unique(np.concatenate((one, other)), return_inverse=True)
    kinds = int(codes.max()) + 1
    common = int(np.minimum(np.bincount(codes[:n], minlength=kinds), np.bincount(codes[n:], minlength=kinds)).sum())
    if max(n, m) - common > most:
        return None
    if most <= MOST_BITS:
        edits = _distance_in_bits(codes[:n].tolist(), codes[n:].tolist(), most)
        return edits if edits <= most else None

    powers = np.full(max(n, m) + 1, _ODD, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(max(n, m) + 1, pow(int(_ODD), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)

    def prefixes(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_mix(values.astype(np.uint64) + _U(1)) * powers[: len(values)], out=sums[1:])
        return sums

    left, right = prefixes(one), prefixes(other)
    steps = [1 << b for b in reversed(range(min(n, m).bit_length()))]

    def passed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i in one and j in the other."""
        length = np.zeros(len(i), np.int64)
        room = np.minimum(n - i, m - j)
        for step in steps:
            longer = length + step
            fits = np.flatnonzero(longer <= room)
            if len(fits):
                a, b, to = i[fits], j[fits], longer[fits]
                same = (left[a + to] - left[a]) * inverse[a] == (right[b + to] - right[b]) * inverse[b]
                length[fits[same]] = to[same]
        return length

    # reach[x]: how far in ``one`` on diagonal x - most, j = i + diagonal; -1 where nothing reaches.
    goal, width = m - n, 2 * most + 3
    reach = np.full(width, -2, np.int64)
    centre = most + 1
    for edits in range(most + 1):
        if edits == 0:
            low = high = centre
            fresh = np.zeros(1, np.int64)
        else:
            low, high = max(1, centre - edits), min(width - 2, centre + edits)
            fresh = np.maximum(reach[low - 1 : high], np.maximum(reach[low : high + 1], reach[low + 1 : high + 2]) + 1)
            # From the diagonal below a word of the other is passed, from above one of the first, both on the same.
        diagonal = np.arange(low, high + 1) - centre
        fresh = np.minimum(fresh, np.minimum(n, m - diagonal))
        valid = (fresh >= 0) & (fresh + diagonal >= 0)
        i = np.where(valid, fresh, 0)
        run = passed(i[valid], (i + diagonal)[valid])
        fresh = np.where(valid, fresh, -2)
        fresh[valid] += run
        reach[low : high + 1] = fresh
        at = goal + centre
        if low <= at <= high and reach[at] >= n:
            return edits
    return None


def alike(one: np.ndarray, other: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches the similarity."""
    longer = max(len(one), len(other))
    most = int(np.floor((1 - similarity) * longer + 1e-9))
    return edit_distance_within(one, other, most) is not None


def _table(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are alike."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                alike(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32))
                for a, b in zip(batch.column("one"), batch.column("other"), strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    sides = pairs.join(words.select(F.col("node").alias("u"), F.col("words").alias("one")), "u").join(
        words.select(F.col("node").alias("v"), F.col("words").alias("other")), "v"
    )
    return sides.mapInArrow(releasing(check), "u bigint, v bigint")


def _word_table(texts: DataFrame) -> DataFrame:
    """(node, words): 32 bits of hash per word."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hash_words([t])[0].astype(np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "words"])

    return texts.mapInArrow(releasing(of), "node bigint, words binary")


def _possible(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of (u, v, one, other) that the signs do not rule out."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = may_be_alike(batch.column("one").to_pylist(), batch.column("other").to_pylist())
                yield batch.select(["u", "v"]).filter(pa.array(kept))

    return pairs.mapInArrow(releasing(check), "u bigint, v bigint")


def _words_of(nodes: DataFrame, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, words) of the text of one document for each of the nodes."""
    wanted = nodes.distinct().join(ids, "node")
    same = texts["node"].eqNullSafe(wanted["node"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    return _word_table(texts.join(wanted, same, "left_semi"))


def _ruled(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (u, v) that the signs do not rule out."""
    one = signed.select(F.col("node").alias("u"), F.col("sign").alias("one"))
    other = signed.select(F.col("node").alias("v"), F.col("sign").alias("other"))
    return _possible(pairs.join(one, "u").join(other, "v"))


def _sharing(one: pa.ListArray, other: pa.ListArray) -> np.ndarray:
    """Whether the lists of two blocks have a number in common."""
    owners = [np.repeat(np.arange(len(of)), np.diff(of.offsets.to_numpy())) for of in (one, other)]
    values = [of.values.to_numpy()[of.offsets[0].as_py() : of.offsets[-1].as_py()] for of in (one, other)]
    found = np.zeros((len(one), len(other)), bool)
    common = np.intersect1d(*values)
    sides = []
    for own, numbers in zip(owners, values, strict=True):
        inside = np.isin(numbers, common)
        own, numbers = own[inside], numbers[inside]
        order = np.argsort(numbers, kind="stable")
        sides.append(np.split(own[order], np.searchsorted(numbers[order], common[1:])) if len(common) else [])
    for x, y in zip(*sides, strict=True):
        found[np.ix_(x, y)] = True
    return found


def _cuts(words: np.ndarray) -> np.ndarray:
    """Numbers of the parts of a block, of at most ``TILE`` texts and ``TILE_WORDS`` words, or of one text."""
    parts, part, texts, held = np.zeros(len(words), np.int64), 0, 0, 0
    for at, size in enumerate(words.tolist()):
        if texts and (texts == TILE or held + size > TILE_WORDS):
            part, texts, held = part + 1, 0, 0
        parts[at], texts, held = part, texts + 1, held + size
    return parts


_TILES = pa.schema([("nodes", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64())), ("pairs", pa.binary())])


def _tiles(members: DataFrame, path: str) -> DataFrame:
    """Tiles (nodes, classes, pairs) of what the signs do not rule out, from members (node, class, sign, span, keys) of buckets.

    The pairs are of different classes, two bytes each, places among the nodes, the closest first. Each pair comes once.
    """
    rows = members.withColumn("key", F.explode("keys")).withColumn("lesser", F.filter("keys", lambda key: key < F.col("key"))).drop("keys")
    parts = members.select("span", F.explode("keys").alias("key")).groupBy("key", "span")
    parts = _table(parts.agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), f"{path}/parts")
    salted = rows.join(parts, ["key", "span"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    blocks = _table(
        salted.groupBy("key", "span", "part").agg(F.collect_list(F.struct("node", "class", "sign", "lesser")).alias("texts")), f"{path}/blocks"
    )
    # Only blocks of one length class, each two once, or of neighbouring ones.
    one = blocks.select("key", F.explode(F.array("span", F.col("span") + 1)).alias("span"), F.col("span").alias("own"), F.col("part").alias("own_part"), F.col("texts").alias("one"))
    other = blocks.select("key", "span", "part", F.col("texts").alias("other"))
    met = one.join(other, ["key", "span"]).where((F.col("own") < F.col("span")) | (F.col("own_part") <= F.col("part")))
    same = (F.col("own") == F.col("span")) & (F.col("own_part") == F.col("part"))

    def side(texts: pa.StructArray) -> tuple:
        return texts.field("node").to_numpy(), texts.field("class").to_numpy(), _parts(texts.field("sign").to_pylist()), texts.field("lesser")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[list, list, bytes]] = []
            for first, second, itself in zip(batch.column("one"), batch.column("other"), batch.column("same").to_pylist(), strict=True):
                (u, u_class, u_sign, u_keys), (v, v_class, v_sign, v_keys) = side(first.values), side(second.values)
                allowed = u_class[:, None] != v_class[None]
                if itself:
                    allowed = np.triu(allowed, 1)
                if not allowed.any():
                    continue
                allowed &= ~_sharing(u_keys, v_keys)
                x, y, _ = closest(u_sign, v_sign, allowed, max(allowed.shape))
                if not len(x):
                    continue
                of = _cuts(u_sign[0])[x] * len(v) + _cuts(v_sign[0])[y]
                order = np.argsort(of, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    ends = np.concatenate((u[x[at]], v[y[at]]))
                    nodes, once, places = np.unique(ends, return_index=True, return_inverse=True)
                    classes = np.concatenate((u_class[x[at]], v_class[y[at]]))[once]
                    pairs = places.astype(np.uint8).reshape(2, -1).T.tobytes()
                    found.append((nodes.tolist(), classes.tolist(), pairs))
                if sum(len(pairs) for *_, pairs in found) > PIECE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), _TILES, strict=True)], schema=_TILES)
                    found.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), _TILES, strict=True)], schema=_TILES)

    return met.select("one", "other", same.alias("same")).mapInArrow(releasing(compare), "nodes array<bigint>, classes array<bigint>, pairs binary")


def joined(classes: np.ndarray, pairs: np.ndarray, words: list[np.ndarray]) -> list[tuple[int, int]]:
    """The pairs of classes that the pairs of alike texts join, without those that others have joined."""
    names, own = np.unique(classes, return_inverse=True)
    above, links = list(range(len(names))), []

    def top(of: int) -> int:
        while above[of] != of:
            above[of] = of = above[above[of]]
        return of

    for one, other in pairs.tolist():
        a, b = top(int(own[one])), top(int(own[other]))
        if a != b and alike(words[one], words[other]):
            above[max(a, b)] = min(a, b)
            links.append((int(names[max(a, b)]), int(names[min(a, b)])))
    return links


def _tried(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the classes that the pairs of the tiles (tile, classes, pairs) join, from their texts (of, at, words)."""

    def join(tile: pa.Table, members: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if tile.num_rows:
            words = {at: np.frombuffer(w, np.uint32) for at, w in zip(members.column("at").to_pylist(), members.column("words").to_pylist(), strict=True)}
            pairs = np.frombuffer(tile.column("pairs")[0].as_py(), np.uint8).reshape(-1, 2)
            links = joined(np.array(tile.column("classes")[0].as_py()), pairs, [words[at] for at in range(len(words))])
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return tiles.groupBy("tile").cogroup(texts.groupBy("of")).applyInArrow(join, "u bigint, v bigint")


def _merged(classes: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """The classes (node, component) joined by links (u, v) between classes, or nodes without one."""
    found = _table(components(links), f"{path}/joined")
    known = classes.unionByName(found.select("node", F.col("node").alias("component"))).distinct()
    to = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return _table(known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{path}/classes")


def _classes(single: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """(node, component) of the nodes with links."""
    rows = single.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size"))
    # Tables of their own: Spark splits a hot key only where both sides of a join come straight from a shuffle.
    leaders = _table(sizes.where("size > 1").select("key", "leader"), f"{path}/leaders")
    rows = _table(rows.join(leaders, "key").where("node <> leader"), f"{path}/rows")
    signed, ids = single.select("node", "sign", "span"), single.select("node", "doc_id")

    def links(pairs: DataFrame, at: str) -> DataFrame:
        """The pairs (a table) that are alike."""
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
        return _table(_verified(pairs, _table(_words_of(ends, ids, texts), f"{at}/words")), f"{at}/links")

    def classed(frame: DataFrame, column: str, name: str) -> DataFrame:
        """With the class of a column's nodes."""
        of = classes.select(F.col("node").alias(column), F.col("component").alias("_component"))
        return frame.join(of, column, "left").withColumn(name, F.coalesce("_component", column)).drop("_component")

    # Each node and one leader: in a group of copies nearly all then have one class, and the other leaders need no look.
    first = rows.groupBy("node").agg(F.min("leader").alias("leader")).select(F.col("node").alias("u"), F.col("leader").alias("v"))
    first = _table(_ruled(first, signed), f"{path}/first-pairs")
    classes = _table(components(links(first, f"{path}/first")), f"{path}/first/classes")

    others = _table(rows.select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), f"{path}/leader-pairs")
    others = classed(classed(others, "u", "u_class"), "v", "v_class").where("u_class <> v_class").join(first, ["u", "v"], "left_anti")
    others = _table(_ruled(others.select("u", "v"), signed), f"{path}/other-pairs")
    found = classed(classed(links(others, f"{path}/others"), "u", "u_class"), "v", "v_class")
    classes = _merged(classes, found.select(F.col("u_class").alias("u"), F.col("v_class").alias("v")), f"{path}/others")

    # All have met their leaders now; the others of a bucket meet where they are not of one class.
    placed = _table(classed(rows.select("key", "node"), "node", "class"), f"{path}/placed")
    several = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    members = placed.join(_table(several, f"{path}/open"), "key", "left_semi").groupBy("node", "class").agg(F.collect_list("key").alias("keys"))
    members = _table(members.join(signed, "node"), f"{path}/members")
    tiles = _table(_tiles(members, path).withColumn("tile", F.monotonically_increasing_id()), f"{path}/tiles")
    if tiles.isEmpty():
        return classes
    nodes = tiles.select(F.col("tile").alias("of"), F.posexplode("nodes").alias("at", "node"))
    words = _table(_words_of(nodes.select("node"), ids, texts), f"{path}/tile-words")
    joins = _tried(tiles.select("tile", "classes", "pairs"), nodes.join(words, "node").select("of", "at", "words"))
    return _merged(classes, _table(joins, f"{path}/tiled/joins"), f"{path}/tiled")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, node, class_id): the text's hash and the smallest id among the documents it is linked with."""
    path = new_table_path(docs.sparkSession, "near-duplicates")
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("node"), "text")
    sketches = _table(_sketch_table(texts), f"{path}/sketches")
    single = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("keys", "sign", "span")))
    classes = _classes(_table(single, f"{path}/single"), texts, path)
    members = sketches.select("doc_id", "node").join(classes, "node", "left").select(
        "doc_id", "node", F.coalesce("component", "node").alias("class")
    )
    least = _table(members.groupBy("class").agg(F.min("doc_id").alias("class_id")), f"{path}/classes")
    return members.join(least, "class").select("doc_id", "node", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without near duplicates: of each class the one with the smallest id stays."""
    found = near_duplicates(docs)
    kept = _table(
        found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "node").distinct(),
        new_table_path(docs.sparkSession, "near-duplicates-kept"),
    )
    # The row as one column, so that no name of the user's can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    keyed = keyed.withColumn("doc_id", F.col("row.doc_id"))
    same = keyed["node"].eqNullSafe(kept["node"]) & keyed["doc_id"].eqNullSafe(kept["doc_id"])
    stay = keyed.join(kept, same, "left_semi")
    twice = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).count() > kept.count()
    if twice:  # the same row more than once: an id and its text stand for it
        stay = stay.dropDuplicates(["doc_id", "node"])
    return stay.select("row.*")


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
