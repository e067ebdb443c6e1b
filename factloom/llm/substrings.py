"""Repeated substrings: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Searching each shard's suffix array in every other's costs a pass over every pair of shards, so
suffix arrays are built where strings can meet at all:

1. Documents are packed into shards of some MB, a bucketed table that later steps join to
   without moving the texts again.
2. In every 50-byte window the 20-byte string with the smallest hash is its anchor. Equal windows
   have equal anchors, so a window can only repeat if its anchor does. Anchors are counted over
   groups of shards; those in one document only are dropped.
3. Each shard names its distinct contexts (the 80 bytes in which all windows of an anchor lie) by
   hash, with their smallest id. A context known from a smaller id is a repeat as a whole. Only
   the first context of each kind, of anchors that have several kinds, still has to be compared,
   and only those are fetched as bytes.
4. Fetched contexts meet by anchor. A task sorts blocks of them as suffixes by Larsson-Sadakane
   refinement; Kasai's common prefixes part them into groups of equal windows, and each window gets
   the smallest id of its group. Contexts whose both sides cannot make up a window with any other
   are found before, among the sorted sides, and left out. An anchor's contexts are dealt over as
   many tasks as they fill blocks; where that is more than one, its windows are merged across
   blocks by an aggregate of their hashes, so that no task grows with the number of a string's kinds.
5. The answers go back to the shards, a bit for each window of a context, and these mark windows
   found in smaller ids, and report.

Anchors only choose what is compared; equality is that of bytes, or of 64-bit hashes of 50 or 80
bytes under a 64-bit anchor. Null and empty texts have no windows. A null id is smaller than all
others; equal ids are never smaller than each other. Columns other than the two named are not
looked at. A document is never split, so a task needs memory in proportion to its longest one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import lineage
from .common import attach, cut_lineage, pa_schema, scratch, settle, slices, utf8_of
from .neardup import mixed

LENGTH = 50
ANCHOR = 20
SPAN = LENGTH - ANCHOR  # windows lie up to so many bytes to either side of an anchor
CONTEXT = ANCHOR + 2 * SPAN
SHARD_BYTES = 3 << 20
#: Later steps have two tasks for each partition of the input, and no more than this.
MOST_BUCKETS = 100_000
#: Shards whose anchors are counted together before they are shuffled: an anchor has at most one row
#: for so many bytes of text, wherever it occurs.
GROUP_BYTES = 64 << 20
#: Contexts that are sorted together.
BLOCK_CONTEXTS = 4_000
#: An anchor has a task of its own for each so many contexts.
MOST_CONTEXTS = 16_000
#: Anchors whose contexts are read, or whose windows are marked, together.
MARK_ANCHORS = 20_000
#: Anchors of a group of shards that are counted together.
COUNT_ANCHORS = 200_000
#: Bytes that are hashed at a time, in whole documents or parts of a long one.
PIECE_BYTES = 256 << 10
_PLACE = np.uint64((1 << 30) - 1)
LOWEST = -(1 << 63)


# -- suffix arrays

def place_type(n: int) -> type:
    """Integers that hold places among n bytes and sums of two: half as wide wherever they do, as arrays of them are a task's memory."""
    return np.int32 if n < 1 << 30 else np.int64


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data in order of their first `depth` bytes at least, and each suffix's rank (its group's first place).

    Starts from 8-byte keys and doubles: only groups of more than one suffix are sorted on.
    """
    n = len(data)
    small = place_type(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    order = np.argsort(key, kind="stable").astype(small)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    # Zero bytes past the end sort as such; a suffix that ends differs in length, which deeper ranks tell.
    rank = np.empty(n, small)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=small), small(0)))
    h = 8
    open_ = np.flatnonzero(~head | np.append(~head[1:], False)).astype(small)
    while h < depth and len(open_):
        suffix = order[open_]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0).astype(small)
        group = rank[suffix]
        both = group * np.int64(n + 1)
        both += follow
        by = np.argsort(both, kind="stable").astype(small)
        del both
        suffix, group, follow = suffix[by], group[by], follow[by]
        del by
        order[open_] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        start = np.maximum.accumulate(np.where(new, open_, small(0)))
        rank[suffix] = start
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int, most: int) -> np.ndarray:
    """For each suffix, how many bytes it shares with the one before it in `order`, up to `most`.

    Kasai's rule along each row of `width` bytes, all rows in step: dropping the first byte
    loses at most one byte of the common prefix.
    """
    n = len(data)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(most, np.uint8)])
    out = np.zeros(n, np.int32)
    rows = np.arange(0, n, width)
    known = np.zeros(len(rows), np.int64)
    for o in range(width):
        at = rows + o
        other = before[at]
        known = np.where(other < 0, 0, np.maximum(known - 1, 0))
        live = np.flatnonzero((other >= 0) & (known < most))
        while len(live):
            same = (padded[at[live] + known[live]] == padded[other[live] + known[live]]) & (at[live] + known[live] < n) & (other[live] + known[live] < n)
            live = live[same]
            known[live] += 1
            live = live[known[live] < most]
        out[at] = known
    return out


def smallest_ids(contexts: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(context, offset): the smallest id among contexts with the same 50 bytes at any offset; LOWEST + 1 at least where no window fits.

    contexts: (context, 80) bytes, of which left and right count how many around the anchor belong to the text.
    """
    n = len(contexts)
    offset = np.arange(SPAN + 1)
    fits = (SPAN - offset[None, :] <= left[:, None]) & (ANCHOR + offset[None, :] <= right[:, None])
    out = np.where(fits, ids[:, None], np.iinfo(np.int64).max)
    if n < 2:
        return out
    data = contexts.reshape(-1)
    order = suffix_array(data, len(data))[0]  # Kasai's rule needs the full order
    group = np.cumsum(common_prefixes(data, order, CONTEXT, LENGTH)[order] < LENGTH, dtype=order.dtype) - 1
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    ok = order % CONTEXT <= SPAN  # a window starts there, if the text goes on for as long
    order, group = order[ok], group[ok]
    owner, place = order // CONTEXT, order % CONTEXT
    ok = fits[owner, place]
    owner, place, group = owner[ok], place[ok], group[ok]
    np.minimum.at(least, group, ids[owner])
    out[owner, place] = least[group]
    return out


# -- anchors of a shard

def anchor_hash(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Of 20 bytes, given as three 8-byte words of which the last counts half."""
    h = mixed(first)
    h ^= second * np.uint64(0x9E3779B97F4A7C15)
    h = mixed(h)
    h ^= third & np.uint64(0xFFFFFFFF)
    return mixed(h)


def context_hash(bytes_: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(bytes_).view("<u8")
    h = mixed((left * 128 + right).astype(np.uint64) + np.uint64(1))
    for k in range(words.shape[1]):
        h = mixed((h * np.uint64(0x9E3779B97F4A7C15)) ^ words[:, k])
    return h

class Shard:
    """The texts of a shard end to end, where each ends, and where its anchors are."""

    def __init__(self, data: bytes, lengths: list[int], ids: list[int | None], places: np.ndarray | None = None) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.ids = np.array([LOWEST if i is None else i for i in ids], np.int64)
        self.places = self.find_anchors() if places is None else places

    def find_anchors(self) -> np.ndarray:
        places, first = [np.zeros(0, np.int64)], 0
        while first < len(self.lengths):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + PIECE_BYTES)))
            a, b = int(self.starts[first]), int(self.ends[last - 1])
            if last == first + 1:  # windows that start in each part of a long document
                for x in range(a, b - LENGTH + 1, PIECE_BYTES):
                    y = min(b, x + PIECE_BYTES + LENGTH - 1)
                    places.append(self._piece(self.data[x:y], np.array([y - x])) + x)
            elif b - a >= LENGTH:
                places.append(self._piece(self.data[a:b], self.ends[first:last] - a) + a)
            first = last
        found = np.concatenate(places)
        return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, document, hash) of each anchor."""
        padded = np.concatenate([self.data, np.zeros(32, np.uint8)])
        rows = np.ascontiguousarray(sliding_window_view(padded, 24)[self.places]).view("<u8")
        return self.places, np.searchsorted(self.ends, self.places, side="right"), anchor_hash(rows[:, 0], rows[:, 1], rows[:, 2])

    @staticmethod
    def _piece(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        word = np.empty(n + 16, np.uint64)
        for k in range(8):
            part = word[k::8]
            part[:] = padded[k : k + 8 * len(part)].view("<u8")
        h = anchor_hash(word[:n], word[8 : n + 8], word[16 : n + 16])
        low = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
        for s in (1, 2, 4, 8):
            low = np.minimum(low[:-s], low[s:])
        low = np.minimum(low[:-15], low[15:])  # windows of 31
        start = np.arange(len(low))
        end = ends[np.searchsorted(ends, start, side="right").clip(max=len(ends) - 1)]
        place = (low[end - start >= LENGTH] & _PLACE).astype(np.int64)
        return place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place

    def sides(self, place: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes around each anchor's place belong to its document on either side, as far as windows go."""
        return np.minimum(SPAN, place - self.starts[document]), np.minimum(ANCHOR + SPAN, self.ends[document] - place)

    def contexts(self, place: np.ndarray, document: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The 80 bytes around each anchor, zero outside its document, and the sides of it, some anchors at a time."""
        padded = np.concatenate([np.zeros(SPAN, np.uint8), self.data, np.zeros(ANCHOR + SPAN, np.uint8)])
        at = np.arange(CONTEXT)[None, :] - SPAN
        for a in range(0, len(place), MARK_ANCHORS):
            p, d = place[a : a + MARK_ANCHORS], document[a : a + MARK_ANCHORS]
            left, right = self.sides(p, d)
            found = np.ascontiguousarray(sliding_window_view(padded, CONTEXT)[p])
            cut = np.flatnonzero((left < SPAN) | (right < ANCHOR + SPAN))
            found[cut] *= (at >= -left[cut, None]) & (at < right[cut, None])
            yield found, left, right

    def shared(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, document, slot) of each anchor in `wanted`, and by slot, for each distinct context: its anchor's hash, its own, and a row that has it."""
        place, document, h = self.anchors()
        wanted = np.sort(wanted.view(np.uint64))
        hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
        place, document, h = place[hit], document[hit], h[hit]
        c = np.concatenate([np.zeros(0, np.uint64), *(context_hash(*x) for x in self.contexts(place, document))])
        slot, first = distinct(h, c)
        return place, document, slot, h[first], c[first], first


def distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's distinct context, by anchor first, and a row for each number."""
    order = np.lexsort((c, h))
    new = np.concatenate([np.ones(min(1, len(h)), bool), (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])
    slot = np.empty(len(h), np.int64)
    slot[order] = np.cumsum(new) - 1
    return slot, order[new]


# -- the job

_BLOCKS = "shard long, ids array<long>, lengths array<long>, size long, packed binary, n_places long, places binary"
def shard_table(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    schema = pa_schema(df.sparkSession, _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        codec = pa.Codec("zstd", 3)
        for part in slices(batches, limit=SHARD_BYTES):
            data = utf8_of(part)
            whole = b"".join(data)
            shard = Shard(whole, [len(x) for x in data], part.column(0).to_pylist())
            gaps = np.diff(shard.places, prepend=0).astype("<u4").tobytes()
            yield pa.RecordBatch.from_pylist([{"shard": number, "ids": part.column(0).to_pylist(), "lengths": shard.lengths.tolist(), "size": len(whole), "packed": codec.compress(whole, asbytes=True), "n_places": len(shard.places), "places": codec.compress(gaps, asbytes=True)}], schema=schema)
            number += 1

    spark = df.sparkSession
    blocks = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _BLOCKS)
    buckets = max(8, min(MOST_BUCKETS, 2 * blocks._jdf.queryExecution().toRdd().getNumPartitions()))
    name = f"factloom_shards_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "shard").options(**lineage.LONG_ROWS).option("path", f"{scratch(spark)}/shards").option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what has been read from the catalogue
    return table


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard, dict]]:
    codec = pa.Codec("zstd")
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            size, n = row["size"].as_py(), row["n_places"].as_py()
            data = codec.decompress(row["packed"].as_buffer(), size) if size else b""
            places = np.cumsum(np.frombuffer(codec.decompress(row["places"].as_buffer(), 4 * n), "<u4"), dtype=np.int64) if n else np.zeros(0, np.int64)
            yield row["shard"].as_py(), Shard(data, row["lengths"].as_py(), row["ids"].as_py(), places), row


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each anchor of a group of shards: the shards that have it, and whether it stands in several documents."""
    settle()
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for number, shard, _ in shards_of(batches):
        _, document, h = shard.anchors()
        order = np.argsort(h, kind="stable")
        h, ids = h[order], shard.ids[document[order]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if len(first):
            low = np.minimum.reduceat(ids, first)
            held.append((number, h[first], low, low != np.maximum.reduceat(ids, first)))
        size += len(shard.data)
        if size >= GROUP_BYTES:
            yield from _grouped(held)
            held, size = [], 0
    yield from _grouped(held)


def _grouped(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Shards' anchors, each shard's in order, put together by ranges of hashes: only a range is sorted at a time."""
    if not held:
        return
    some = np.sort(np.concatenate([h[::64] for _, h, _, _ in held]))  # being minima, most hashes are low
    bounds = np.unique(some[:: max(1, COUNT_ANCHORS // 64)])[1:]
    cuts = [[0, *np.searchsorted(h, bounds).tolist(), len(h)] for _, h, _, _ in held]
    for k in range(len(bounds) + 1):
        part = [(number, *(x[c[k] : c[k + 1]] for x in columns)) for (number, *columns), c in zip(held, cuts, strict=True)]
        shard = np.concatenate([np.full(len(h), number) for number, h, _, _ in part])
        h, low, several = (np.concatenate([x[i] for x in part]) for i in (1, 2, 3))
        order = np.argsort(h, kind="stable")
        h, shard, low, several = h[order], shard[order], low[order], several[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.logical_or.reduceat(several, first) | (np.minimum.reduceat(low, first) != np.maximum.reduceat(low, first))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(shard))
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), lists, pa.array(several)], names=["anchor", "shards", "several"])


def _wanted(row: dict) -> np.ndarray:
    return row["anchors"].values.to_numpy(zero_copy_only=False) if row["anchors"].is_valid else np.zeros(0, np.int64)


def _window_hashes(bytes_: np.ndarray) -> np.ndarray:
    """(context, 31): a hash of each window and of its offset."""
    out = np.empty((len(bytes_), SPAN + 1), np.uint64)
    window = np.zeros((len(bytes_), 56), np.uint8)
    for o in range(SPAN + 1):
        window[:, :LENGTH] = bytes_[:, o : o + LENGTH]
        out[:, o] = context_hash(window, np.full(len(bytes_), o), np.zeros(len(bytes_), np.int64))
    return out


def _lowest(shard: Shard, document: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, slot, shard.ids[document])
    return low


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settle()
    for number, shard, row in shards_of(batches):
        _, document, slot, h, c, _ = shard.shared(_wanted(row))
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(_lowest(shard, document, slot, len(h))), pa.array(np.full(len(h), number)), pa.array(np.arange(len(h)), pa.int32())], names=["anchor", "context", "low", "shard", "slot"])


def sort_out(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, repeats, asked), and (anchor, n), the kinds of each anchor that has several: the slots of contexts that a smaller id has as well, and of those that
    must be compared: the first of each kind, where an anchor has several kinds.

    Minima are aggregated before they are shuffled, and written down, so that the joins have two
    plain shuffles, of which the adaptive engine splits a hot anchor's part.
    """
    best = cut_lineage(kinds.groupBy("anchor", "context").agg(F.min("low").alias("least")), "kinds")
    several = cut_lineage(best.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    met = kinds.join(best, ["anchor", "context"]).select("anchor", "shard", "slot", (F.col("low") > F.col("least")).alias("repeat"))
    repeats = met.where("repeat").select("shard", "slot", "repeat")
    asked = met.where("not repeat").join(several, "anchor").select("shard", "slot", "repeat")
    both = repeats.unionByName(asked)
    return both.groupBy("shard").agg(F.collect_list(F.when(F.col("repeat"), F.col("slot"))).alias("repeats"), F.collect_list(F.when(~F.col("repeat"), F.col("slot"))).alias("asked")), several


_FOUND = "anchor long, lead int, follow int, context binary, low long, shard long, slot int"
_ANSWERS = "shard long, slot int, found int, low long, windows array<long>"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that are asked for, as bytes."""
    settle()
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for number, shard, row in shards_of(batches):
        place, document, slot, h, _, first = shard.shared(_wanted(row))
        low = _lowest(shard, document, slot, len(h))
        ask = np.sort(row["asked"].values.to_numpy(zero_copy_only=False))
        at = 0
        for bytes_, left, right in shard.contexts(place[first[ask]], document[first[ask]]):
            some = ask[at : at + len(bytes_)]
            at += len(bytes_)
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), len(some), [None, pa.py_buffer(bytes_)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), whole, pa.array(low[some]), pa.array(np.full(len(some), number)), pa.array(some.astype(np.int32))], names=names)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by anchor, with the number of tasks that have a part of it. Anchors that are
    here as a whole are taken some thousand contexts at a time; windows of the others are sent on."""
    settle()
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        anchor = table.column(0).to_numpy()
        end = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
        for a, b in blocks_of(anchor[:end]) if end else ():
            yield _answer(table.slice(a, b - a))
        held[:] = table.slice(end).to_batches()

    for batch in batches:
        parted = pa.compute.greater(batch.column(batch.schema.get_field_index("parts")), 1)
        if batch.num_rows and pa.compute.any(parted).as_py():
            yield _sent_on(pa.Table.from_batches([batch.filter(parted)]))
            batch = batch.filter(pa.compute.invert(parted))
        held.append(batch)
        count += batch.num_rows
        if count >= BLOCK_CONTEXTS:
            yield from flush(pa.Table.from_batches(held).combine_chunks(), False)
            count = sum(b.num_rows for b in held)
    if count:
        yield from flush(pa.Table.from_batches(held).combine_chunks(), True)


def _bytes_of(table: pa.Table) -> np.ndarray:
    held = table.column("context").combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    return np.frombuffer(held.buffers()[2], np.uint8)[CONTEXT * held.offset :][: CONTEXT * len(held)].reshape(-1, CONTEXT)


def _sent_on(table: pa.Table) -> pa.RecordBatch:
    left, right = table.column("lead").to_numpy(), table.column("follow").to_numpy()
    offset = np.arange(SPAN + 1)
    fits = (SPAN - offset[None, :] <= left[:, None]) & (ANCHOR + offset[None, :] <= right[:, None])
    anchor = table.column("anchor").to_numpy().view(np.uint64)
    hashes = mixed(_window_hashes(_bytes_of(table)) ^ mixed(anchor)[:, None])
    windows = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1) * (SPAN + 1), pa.int32()), pa.array(hashes.view(np.int64).ravel(), mask=~fits.ravel()))
    columns = [table.column(c).combine_chunks() for c in ("shard", "slot", "low")]
    return pa.RecordBatch.from_arrays([columns[0], columns[1], pa.nulls(len(left), pa.list_(pa.int64())), columns[2], windows], names=["shard", "slot", "smallest", "low", "windows"])


def blocks_of(anchor: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about BLOCK_CONTEXTS rows that end where an anchor ends."""
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
    out, a = [], 0
    while a < len(anchor):
        b = int(ends[min(len(ends) - 1, np.searchsorted(ends, a + BLOCK_CONTEXTS))])
        out.append((a, b))
        a = b
    return out


def longest_match(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row the longest prefix of `side` that another row of its anchor shares: that with a neighbour in sorted order."""
    row = np.concatenate([anchor.astype(">u8").view(np.uint8).reshape(-1, 8), side], 1)
    order = np.argsort(np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel(), kind="stable")
    s = row[order]
    same = np.concatenate([s[1:] == s[:-1], np.zeros((max(0, len(s) - 1), 1), bool)], 1)
    match = np.argmin(same, 1) - 8  # below 0: another anchor
    out = np.zeros(len(row), np.int64)
    out[order[1:]] = np.maximum(0, match)
    out[order[:-1]] = np.maximum(out[order[:-1]], match)
    return out


def _answer(table: pa.Table) -> pa.RecordBatch:
    anchor = table.column("anchor").to_numpy().view(np.uint64)
    left, right = table.column("lead").to_numpy().astype(np.int64), table.column("follow").to_numpy().astype(np.int64)
    bytes_, low = _bytes_of(table), table.column("low").to_numpy()
    before = np.minimum(left, longest_match(anchor, bytes_[:, SPAN - 1 :: -1]))
    after = np.minimum(right - ANCHOR, longest_match(anchor, bytes_[:, SPAN + ANCHOR :]))
    some = np.flatnonzero(before + after >= SPAN)
    smallest = smallest_ids(bytes_[some], left[some], right[some], low[some])
    hit = (smallest < low[some][:, None]).any(1)
    smallest, some = smallest[hit], some[hit]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (SPAN + 1), pa.int32()), pa.array(smallest.ravel()))
    shard, slot = (table.column(c).to_numpy()[some] for c in ("shard", "slot"))
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot, pa.int32()), lists, pa.array(low[some]), pa.nulls(len(some), pa.list_(pa.int64()))], names=["shard", "slot", "smallest", "low", "windows"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers with a bit for each offset whose window a smaller id has. It is smaller than all that the context has in its shard, so that is all there is to know."""
    for batch in _answers(batches):
        shard, slot, smallest, low, windows = batch.columns
        given = np.flatnonzero(smallest.is_valid().to_numpy(zero_copy_only=False))
        found = np.zeros(len(smallest), np.int32)
        found[given] = (smallest.flatten().to_numpy().reshape(-1, SPAN + 1) < low.to_numpy()[given, None]) @ (1 << np.arange(SPAN + 1))
        yield pa.RecordBatch.from_arrays([shard, slot, pa.array(found, mask=found == 0), low, windows], names=[c.split()[0] for c in _ANSWERS.split(", ")])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settle()
    offset = np.arange(SPAN + 1)
    for _, shard, row in shards_of(batches):
        n = len(shard.data)
        place, document, slot, h, _, _ = shard.shared(_wanted(row))
        # What is known without answers: the smallest id that has the context in this shard.
        lowest, found, repeated = _lowest(shard, document, slot, len(h)), np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        if row["answers"].is_valid:
            answers = row["answers"].values.to_numpy(zero_copy_only=False)
            found[answers >> SPAN + 1] = answers & (1 << SPAN + 1) - 1
        if row["repeats"].is_valid:
            repeated[row["repeats"].values.to_numpy(zero_copy_only=False)] = True
        starts = np.zeros(n, bool)  # of windows that are repeats
        for a in range(0, len(place), MARK_ANCHORS):
            p, d, s = place[a : a + MARK_ANCHORS], document[a : a + MARK_ANCHORS], slot[a : a + MARK_ANCHORS]
            whole = (lowest[s] < shard.ids[d]) | repeated[s]
            some = np.flatnonzero(whole | (found[s] != 0))
            p, d, s, whole = p[some], d[some], s[some], whole[some]
            left, right = shard.sides(p, d)
            hit = whole[:, None] | (found[s][:, None] >> offset[None, :] & 1).astype(bool)
            hit &= (SPAN - offset[None, :] <= left[:, None]) & (ANCHOR + offset[None, :] <= right[:, None])
            which, o = np.nonzero(hit)
            starts[p[which] - SPAN + o] = True
        so_far = np.zeros(n + 1, place_type(n))
        np.cumsum(starts, out=so_far[1:])
        gone = np.empty(n, bool)  # a window starts at a byte or less than LENGTH before
        gone[:LENGTH] = so_far[1 : LENGTH + 1] > 0
        np.greater(so_far[LENGTH + 1 :], so_far[1:-LENGTH], out=gone[LENGTH:])
        np.cumsum(gone, out=so_far[1:])
        removed = so_far[shard.ends] - so_far[shard.starts]
        step = gone.copy()
        step[1:] &= ~gone[:-1]
        filled = shard.starts[shard.lengths > 0]
        step[filled] = gone[filled]
        np.cumsum(step, out=so_far[1:])
        spans = so_far[shard.ends] - so_far[shard.starts]
        digests = [hashlib.sha256(shard.data[a:b][~gone[a:b]] if r else shard.data[a:b]).hexdigest() for a, b, r in zip(shard.starts.tolist(), shard.ends.tolist(), removed.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(shard.lengths), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged_answers(sent: DataFrame) -> DataFrame:
    """(shard, slot, found) for contexts whose anchors are dealt over tasks. Minima are aggregated
    before they are shuffled, and joined back salted."""
    each = sent.where(F.col("windows").isNotNull()).select("shard", "slot", "low", F.posexplode("windows").alias("o", "window")).where(F.col("window").isNotNull())
    least = each.groupBy("window").agg(F.min("low").alias("least"))
    hit = attach(each, least, ["window"], F.struct("shard", "slot")).where(F.col("least") < F.col("low"))
    return hit.groupBy("shard", "slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("o"))).alias("found"))


def repeated_substrings(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: its bytes, how many of them are repeats in how many runs, and a hash of the others."""
    blocks = shard_table(df, doc_id, text)
    rows = blocks.mapInArrow(_anchor_rows, "anchor long, shards array<long>, several boolean")
    same = Window.partitionBy("anchor")  # a row for each group of shards at most
    met = rows.withColumns({"n": F.count("*").over(same), "any": F.max("several").over(same)}).where((F.col("n") > 1) | F.col("any"))
    wanted = met.select("anchor", F.explode("shards").alias("shard")).groupBy("shard").agg(F.collect_list("anchor").alias("anchors"))
    wanted = cut_lineage(wanted, "anchors", long_rows=True)
    # Written tables go as soon as what is made of them is written.
    spark, start = df.sparkSession, lineage.mark()
    kinds = blocks.join(wanted, "shard").mapInArrow(_context_rows, "anchor long, context long, low long, shard long, slot int")
    sorted_out, several = sort_out(cut_lineage(kinds, "contexts"))
    end = lineage.mark()
    by_shard = cut_lineage(sorted_out, "repeats", long_rows=True)
    large = cut_lineage(several.where(F.col("n") > MOST_CONTEXTS).select("anchor", F.ceil(F.col("n") / MOST_CONTEXTS).cast("int").alias("parts")), "large")
    lineage.discard(spark, start, end)
    asked = by_shard.where(F.size("asked") > 0).select("shard", "asked")
    start = lineage.mark()
    found = cut_lineage(blocks.join(wanted, "shard").join(asked, "shard").mapInArrow(_fetch, _FOUND), "bytes")
    dealt = found.join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("shard", "slot"), F.col("parts"))).repartition("anchor", "part").sortWithinPartitions("anchor")
    end = lineage.mark()
    sent = cut_lineage(dealt.select(*found.columns, "parts").mapInArrow(_marked, _ANSWERS), "sent")
    lineage.discard(spark, start, end)
    start = lineage.mark()
    answers = sent.where(F.col("found").isNotNull()).select("shard", "slot", "found").unionByName(merged_answers(sent))
    slot_and_bits = F.shiftleft(F.col("slot").cast("long"), SPAN + 1).bitwiseOR(F.col("found").cast("long"))
    answers = cut_lineage(answers.groupBy("shard").agg(F.collect_list(slot_and_bits).alias("answers")), "answers", long_rows=True)
    lineage.discard(spark, start - 1, start)
    whole = blocks.join(wanted, "shard", "left").join(by_shard.select("shard", "repeats"), "shard", "left").join(answers, "shard", "left")
    return whole.mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
