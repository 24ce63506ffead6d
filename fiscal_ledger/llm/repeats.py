"""Exact removal of long repeated byte strings, by a run-length index over candidate passages.

A byte goes if a string of ``LENGTH`` bytes (or another length of ANCHOR or more) that covers it also starts anywhere else in the corpus.

1. **Anchors.** In every window of LENGTH bytes the ``ANCHOR`` bytes with the smallest hash are
   its anchor. Equal windows choose the same anchor at the same offset, so strings can only be
   equal if they lie around equal anchors. A text has about one anchor in 180 bytes.
2. **Contexts.** An anchor's context is all the windows it is the anchor of. Anchors that
   occur once are done. Contexts that occur more than once are repeated as a whole. What is left are
   contexts seen once around an anchor seen more often.
3. **Index.** Contexts of the same anchors meet in one task, some ``BLOCK_BYTES`` at a time. There a
   Burrows-Wheeler transform is built and run-length compressed. Match lengths are computed at the heads of its
   runs only; inside a run each is one less than its predecessor's in the text, so they stream from head to head.
   Where a match reaches LENGTH and lies at another place, the window is marked.
4. **Hot anchors.** An anchor with more than ``MOST_KINDS`` distinct contexts is split into two longer ones:
   every window around it holds either the left or the right one. That repeats until few contexts
   share an anchor or the anchor is the whole window, so no task ever holds a large group. All contexts take part.

Nulls count as empty text. Rows equal in id and text are copies of each other, like any other copies: all
their bytes go if there are LENGTH of them. A null id is an id of its own. Texts
shorter than LENGTH bytes stay whole. An empty table gives an empty table. Columns not named are
dropped, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import releasing
from fiscal_ledger.settings import new_table_path

LENGTH = 400
ANCHOR = 32
# Bytes of text that are hashed at once, and bytes of contexts that are indexed at once.
PIECE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19
MOST_KINDS = 256

_NO_ID = -(1 << 63)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Rolling:
    """Polynomial hashes modulo 2^64 of all substrings of a byte array, by prefix sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        size = len(data)
        have = self._powers.get(base)
        if have is None or len(have[0]) < size + 1:
            room = max(size + 1, PIECE_BYTES + 1)
            up, down = np.full(room, base, np.uint64), np.full(room, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
            if size <= PIECE_BYTES:
                self._powers[base] = have
        up, self._down = have
        values = _mix(np.arange(1, 257, dtype=np.uint64) * _U(base))
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data] * up[:size], out=self._sums[1:], dtype=np.uint64)

    @classmethod
    def forget(cls) -> None:
        cls._powers.clear()

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._sums[end] - self._sums[begin]) * self._down[begin])

    def all(self, length: int) -> np.ndarray:
        count = len(self._sums) - length
        return _mix((self._sums[length:] - self._sums[:count]) * self._down[:count])


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours: smallest so far from either side of each block of that width."""
    count = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def context_hash(rolling: _Rolling, begin: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the context from ``begin`` to ``end`` with its anchor at ``at``."""
    place = ((at - begin).astype(np.uint64) << _U(32)) | (end - at).astype(np.uint64)
    return _mix(rolling.of(begin, end) ^ _mix(place + _U(1)))


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, place, context's begin and end, anchor hash, context hash) of every anchor of some texts, end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    anchors = _Rolling(data, _BASES[0])
    hashes = anchors.all(ANCHOR)
    bits = _U(len(data).bit_length())
    places = np.arange(len(hashes), dtype=np.uint64)
    minima = _window_minima((hashes >> bits << bits) | places, length - ANCHOR + 1)
    # Windows that lie inside one text.
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= length
    change = np.zeros(len(minima) + 1, np.int64)
    np.add.at(change, starts[long], 1)
    np.add.at(change, np.minimum(ends[long] - length + 1, len(minima)), -1)
    windows = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    chosen = (minima[windows] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    if not len(chosen):
        return (none,) * 6
    # From window to window the anchor stays or moves on, so the windows of an anchor are neighbours.
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((first[1:], [len(chosen)])) - 1
    chosen, begin, end = chosen[first], windows[first], windows[last] + length
    document = np.searchsorted(offsets, chosen, side="right") - 1
    contexts = context_hash(_Rolling(data, _BASES[1]), begin, chosen, end)
    start = starts[document]
    return document, chosen - start, begin - start, end - start, hashes[chosen].view(np.int64), contexts.view(np.int64)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about PIECE_BYTES: (number of the first, bytes, offsets)."""
    binary = texts.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    buffer = binary.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(binary):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = max(last, first + 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_ANCHOR_SCHEMA = "id bigint, hash bigint, at int, begin int, end int, g bigint, ctx bigint"


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """Every anchor of every text (id, hash, text)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = batch.column("hash").to_numpy(zero_copy_only=False)
            for first, data, offsets in _pieces(batch.column("text")):
                document, *places, anchors, contexts = find_anchors(data, offsets, length)
                columns = (
                    ids[first + document], keys[first + document], *(p.astype(np.int32) for p in places), anchors, contexts
                )
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, columns)), names=["id", "hash", "at", "begin", "end", "g", "ctx"]
                )
        _Rolling.forget()

    return texts.mapInArrow(releasing(find), _ANCHOR_SCHEMA)


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = new_table_path(frame.sparkSession, f"repeats-{name}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _classify(rows: DataFrame, level: int) -> DataFrame:
    """Add per row: ``n`` (equal contexts), ``kinds`` (distinct contexts of the anchor), ``stands`` (for its equals).

    Everything is counted before it is shuffled; rows join a table of the counts, where Spark splits hot keys.
    """
    me = F.xxhash64("id", "hash", "at")
    equals = rows.groupBy("g", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("_one"))
    anchors = equals.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"))
    counts = _written(equals.join(anchors, "g"), f"counts-{level}")
    known = rows.join(counts, ["g", "ctx"]).withColumn("stands", F.col("_one") == me).drop("_one")
    return _written(known, f"classified-{level}")


def _marks(rows: DataFrame) -> DataFrame:
    """The contexts that occur more than once, as marked spans."""
    return rows.where("n > 1").select("id", "hash", "begin", "end")


def _open(rows: DataFrame) -> DataFrame:
    """Rows whose windows may still match those of another context: single ones, and one of each repeated kind."""
    return rows.where((F.col("kinds") > 1) & ((F.col("n") == 1) | F.col("stands")))


_CONTEXT_SCHEMA = (
    "id bigint, hash bigint, at int, until int, begin int, end int, g bigint, kinds bigint, origin int, context binary"
)


def _cut(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of the contexts of open anchors."""
    wanted = rows.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "until", "begin", "end", "g", "kinds")).alias("wanted"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {name.split()[0]: [] for name in _CONTEXT_SCHEMA.split(", ")}
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_buffer().to_pybytes()
                seen = set()
                for want in batch.column("wanted")[row].as_py():
                    if (want["at"], want["g"]) in seen:
                        continue  # the list of a row that occurs twice names its places twice
                    seen.add((want["at"], want["g"]))
                    values = (
                        batch.column("id")[row].as_py(), batch.column("hash")[row].as_py(), want["at"], want["until"],
                        want["begin"], want["end"], want["g"], want["kinds"], want["begin"],
                        text[want["begin"] : want["end"]],
                    )
                    for column, value in zip(found.values(), values, strict=True):
                        column.append(value)
                if len(found["id"]) >= 2000:
                    yield pa.RecordBatch.from_pydict(found, schema=_arrow_contexts())
                    found = {name: [] for name in found}
            yield pa.RecordBatch.from_pydict(found, schema=_arrow_contexts())

    return texts.join(wanted, ["id", "hash"]).mapInArrow(releasing(cut), _CONTEXT_SCHEMA)


def _arrow_contexts() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in _CONTEXT_SCHEMA.split(", "))])


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """Two longer anchors for each hot one.

    A window around [at, until) has ``slack`` bytes outside it. It holds either half of the slack, rounded up,
    on the left, or at least the rest and one byte more on the right.
    """
    schema = f"{_CONTEXT_SCHEMA}, ctx bigint"

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for first, data, offsets in _pieces(column["context"]):
                count = len(offsets) - 1
                part = {
                    name: column[name].slice(first, count).to_numpy(zero_copy_only=False).astype(np.int64)
                    for name in ("at", "until", "begin", "end", "g", "origin")
                }
                slack = length - (part["until"] - part["at"])
                left = (slack + 1) // 2
                rolled, others = _Rolling(data, _BASES[0]), _Rolling(data, _BASES[1])
                shift = offsets[:-1] - part["origin"]  # from places in the text to places in the piece
                for side, at, until in (
                    (1, part["at"] - left, part["until"]),
                    (2, part["at"], part["until"] + slack - left + 1),
                ):
                    # The parent's windows that contain the longer anchor.
                    begin, end = np.maximum(part["begin"], until - length), np.minimum(part["end"], at + length)
                    fits = np.flatnonzero((begin + length <= end) & (slack > 0))
                    if not len(fits):
                        continue
                    at, until, begin, end, move = (values[fits] for values in (at, until, begin, end, shift))
                    anchors = _mix(rolled.of(at + move, until + move) ^ _mix(part["g"][fits].view(np.uint64) + _U(side)))
                    hashes = context_hash(others, begin + move, at + move, end + move)
                    taken = pa.array(fits + first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            column["id"].take(taken),
                            column["hash"].take(taken),
                            pa.array(at.astype(np.int32)),
                            pa.array(until.astype(np.int32)),
                            pa.array(begin.astype(np.int32)),
                            pa.array(end.astype(np.int32)),
                            pa.array(anchors.view(np.int64)),
                            column["kinds"].take(taken),
                            column["origin"].take(taken),
                            column["context"].take(taken),
                            pa.array(hashes.view(np.int64)),
                        ],
                        names=[field.split()[0] for field in schema.split(", ")],
                    )
        _Rolling.forget()

    return contexts.mapInArrow(releasing(split), schema)


# --- the run-length index -------------------------------------------------------------------------


# Symbols that fit a 64-bit key, and masks that keep the first so many of them.
_PACK = 7
_FIRST = np.array([((1 << 9 * n) - 1) << 9 * (_PACK - n) for n in range(_PACK + 1)], np.int64)


def _packed(symbols: np.ndarray) -> np.ndarray:
    """The symbols from each place on as one number, the first highest."""
    keys = np.zeros(len(symbols), np.int64)
    for step in range(_PACK):
        keys <<= 9
        keys[: max(0, len(symbols) - step)] |= symbols[step:]
    return keys


def suffix_array(keys: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling, from packed symbols.

    Symbol 0 ends a text; ``to_end`` is the distance to the next end. Ends count as different symbols in order
    of place, so a suffix that runs into one is settled there.
    """
    size = len(keys)
    key = keys & _FIRST[np.minimum(to_end, _PACK)]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(size, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(size, dtype=np.int32), 0))
    length = _PACK
    while True:
        slots = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True])))).astype(np.int32)
        if not len(slots):
            return order
        members = order[slots]
        # Those that have met an end within the length are equal up to it; the place decides.
        second = np.where(to_end[members] < length, members, rank[np.minimum(members + length, size - 1)])
        both = rank[members].astype(np.int64) << 32 | second
        arranged = np.argsort(both, kind="stable")
        members, both = members[arranged], both[arranged]
        order[slots] = members
        new = np.concatenate(([True], both[1:] != both[:-1]))
        fresh[slots] = new
        rank[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots), dtype=np.int32), 0))]
        length *= 2


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of some texts, with the text places of its run heads."""

    def __init__(self, texts: list[bytes]):
        total = sum(map(len, texts)) + len(texts)
        self.symbols = np.zeros(total, np.int16)
        self.starts = np.zeros(len(texts), np.int64)
        at = 0
        for number, text in enumerate(texts):
            self.starts[number] = at
            self.symbols[at : at + len(text)] = np.frombuffer(text, np.uint8)
            self.symbols[at : at + len(text)] += 1
            at += len(text) + 1
        ends = np.flatnonzero(self.symbols == 0)
        lengths = np.diff(np.concatenate(([-1], ends)))
        self.to_end = (np.repeat(ends, lengths) - np.arange(total)).astype(np.int32)
        self.keys = _packed(self.symbols)
        self.order = suffix_array(self.keys, self.to_end)
        transform = self.symbols[self.order - 1]  # the first place follows the last end
        heads = np.concatenate(([True], (transform[1:] != transform[:-1]) | (transform[1:] == 0)))
        self.runs = np.flatnonzero(heads)
        self.run_symbols = transform[self.runs]

    def match_lengths(self) -> np.ndarray:
        """Per text place, how far it agrees with the suffix before it in order.

        Compared at run heads only. Inside a run the suffix before is the one before for
        the preceding place too, moved on by one, so the length falls by one from place to place.
        """
        here, before = self.order[self.runs], self.order[np.maximum(self.runs - 1, 0)]
        lengths = self._common(here, before)
        lengths[self.runs == 0] = 0
        # At a head: the length plus the place, which stays the same until the next head.
        places = np.arange(len(self.symbols), dtype=np.int32)
        reach = np.zeros(len(places), np.int32)
        reach[here] = lengths + here
        head = np.zeros(len(places), np.int32)
        head[here] = here
        return np.maximum(reach[np.maximum.accumulate(head)] - places, 0)

    def _common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        limit = np.minimum(self.to_end[one], self.to_end[other])
        lengths = np.zeros(len(one), np.int32)
        for step, values in ((_PACK, self.keys), (1, self.symbols)):
            going = np.flatnonzero(lengths + step <= limit)
            while len(going):
                equal = values[one[going] + lengths[going]] == values[other[going] + lengths[going]]
                going = going[equal]
                lengths[going] += step
                going = going[lengths[going] + step <= limit[going]]
        return lengths

    def repeated(self, places: np.ndarray, length: int) -> np.ndarray:
        """Whether each text place starts a string of the length that also starts at another of ``places``.

        ``places`` names where in the corpus each place lies: contexts that overlap hold the same place twice.
        """
        lengths = self.match_lengths()[self.order]
        group = np.cumsum(lengths < length) - 1
        starts = np.flatnonzero(lengths < length)
        named = places[self.order]
        differs = np.minimum.reduceat(named, starts) != np.maximum.reduceat(named, starts)
        found = np.zeros(len(places), bool)
        found[self.order] = differs[group]
        return found & (self.to_end >= length)


def marked_spans(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(id, hash, begin, end) of the repeated strings among contexts (id, hash, origin, bytes)."""
    index = RunLengthIndex([row[3] for row in rows])
    texts: dict[tuple[int, int], int] = {}
    places = np.zeros(len(index.symbols), np.int64)
    for row, start in zip(rows, index.starts, strict=True):
        number = texts.setdefault((row[0], row[1]), len(texts))
        span = len(row[3]) + 1
        places[start : start + span] = (number << 40) + row[2] + np.arange(span)
    marked = index.repeated(places, length).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked, [0]))))
    numbers = (np.searchsorted(index.starts, edges[::2], side="right") - 1).tolist()
    spans = []
    for number, begin, end in zip(numbers, edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        shift = rows[number][2] - int(index.starts[number])
        spans.append((*rows[number][:2], begin + shift, end - 1 + length + shift))
    return spans


_SPAN_SCHEMA = "id bigint, hash bigint, begin int, end int"


def _index_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Index the contexts in blocks; all of an anchor's are in one block."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

        def finish(rows: list) -> pa.RecordBatch:
            columns = list(zip(*marked_spans(rows, length), strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        rows, held, last = [], 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("g", "id", "hash", "begin", "end", "origin", "context"))
            for g, doc_id, key, begin, end, origin, context in zip(*columns, strict=True):
                if held >= BLOCK_BYTES and g != last:
                    yield finish(rows)
                    rows, held = [], 0
                rows.append((doc_id, key, begin, context[begin - origin : end - origin]))
                held += end - begin
                last = g
        if rows:
            yield finish(rows)

    return contexts.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(releasing(mark), _SPAN_SCHEMA)


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, begin, end) of all repeated strings of (id, hash, text); spans may overlap."""
    anchors = _written(_anchor_table(texts, length), "anchors")
    # Tables of their own: Spark splits a hot key only where both sides of a join come straight from a shuffle.
    shared = _written(anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "repeated")
    rows = _written(
        anchors.join(shared, "g").withColumn("until", F.col("at") + F.lit(ANCHOR)), "shared"
    )
    spans, indexed = [], []
    known = _classify(rows, 0)
    contexts = _written(_cut(texts, _open(known)), "contexts-0")
    level = 0
    while True:
        spans.append(_marks(known))
        indexed.append(contexts.where(F.col("kinds") <= MOST_KINDS))
        hot = contexts.where(F.col("kinds") > MOST_KINDS)
        if hot.isEmpty():
            break
        level += 1
        # Counts without the bytes; the bytes join them once.
        children = _written(_split(hot, length), f"split-{level}")
        known = _classify(children.drop("kinds"), level)
        contexts = _open(known).select(*(field.split()[0] for field in _CONTEXT_SCHEMA.split(", ")))
    every = reduce(DataFrame.unionByName, indexed)
    spans.append(_written(_index_spans(every, length), "indexed"))
    return reduce(DataFrame.unionByName, spans)


def _removed(
    docs: DataFrame, id_column: str, text_column: str, keep: list[str], length: int, whole_characters: bool
) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): ``row`` holds the columns to keep."""
    read = docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
    ).withColumn("hash", F.xxhash64("text"))
    spans = repeated_spans(read.select("id", "hash", "text"), length)
    listed = spans.distinct().groupBy("id", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = read.join(listed, ["id", "hash"], "left").select("row", "text", "spans")
    schema = joined.select(
        "row",
        F.lit(0).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.lit(b"").alias("kept"),
    ).schema

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_buffer().to_pybytes()
                parts, at, removed, runs = [], 0, 0, 0
                end = -1
                for span in sorted((s["begin"], s["end"]) for s in spans.as_py() or ()):
                    if span[0] > end:
                        runs += 1
                        parts.append(data[at : span[0]])
                        removed += span[1] - span[0]
                        end = at = span[1]
                    elif span[1] > end:
                        removed += span[1] - end
                        end = at = span[1]
                parts.append(data[at:])
                kept = b"".join(parts)
                if whole_characters and runs:
                    kept = kept.decode("utf-8", "ignore").encode()
                found.append((len(data), removed, runs, kept))
            sizes, gone, runs, kept = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(releasing(remove), schema)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row; ``kept`` holds the remaining bytes."""
    done = _removed(docs, id_column, text_column, [id_column], length, whole_characters=False)
    return done.select(
        F.col("row").getField(id_column).alias(id_column), "n_bytes", "n_removed", "n_spans", "kept"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, with what is left of their texts; ``n_chars`` follows the text.

    A character of which a span took some bytes goes as a whole.
    """
    others = [c for c in docs.columns if c != "text"]
    done = _removed(docs, "doc_id", "text", others, length, whole_characters=True)
    text = F.col("kept").cast("string")

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.char_length(text).cast(docs.schema[name].dataType).alias(name)
        return F.col("row").getField(name).alias(name)

    return done.select(*map(column, docs.columns))


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of 400 bytes; the text has marks where a character was cut."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)
