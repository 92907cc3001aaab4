"""Exact substring dedup with suffix arrays built by linear grouping.

Every byte covered by a 100-byte string that also starts earlier (in a smaller ``doc_id``, or earlier in
the same document) is removed. No suffix array spans the corpus; equal strings are brought together first:

1. Each 100-byte window has a minimizer, the leftmost smallest hash of its ``GRAM``-byte grams, which depends
   on the window's bytes alone. A maximal run of windows with one minimizer is a record: (minimizer hash,
   content hash, document, start, run). Equal windows always have equal minimizer hashes.
2. Records of equal minimizer and content are copies: all but the first are covered whole. Each task
   settles its own copies first, so a passage that a third of all rows hold sends one record per task. The
   rest travels packed, about 20 bytes for each 40 of text, to the bucket of its minimizer. A minimizer with more
   than ``CHUNK_CONTENTS`` contents in one chunk is frequent: its records go to buckets by content, and a
   marker tells the minimizer's own bucket, so no bucket gathers a frequent minimizer.
3. A window holds its minimizer ``r`` bytes after its start, r = 0 .. 80. Equal windows have equal r, and windows
   with r in one cell of ``CELLS[0]`` agree on all bytes that every window of the cell holds. Records of one
   minimizer that differ in content (the ends of shared passages) are cut to the cells that they share with another.
4. Their bytes, in blocks of at most about ``BLOCK_STRINGS`` strings, are sorted by grouping suffixes by
   their Lyndon prefixes. Neighbours with equal 100-byte prefixes form the classes of equal windows.
5. A frequent minimizer, or one with more records than a block, is split by the bytes of its cells, into finer and
   finer cells, until the groups fit a block or a cell is one window, whose smallest place is a grouped minimum. A
   record makes a row for each cell that it shares, never one for each window and group.

Records are compared by a 64-bit minimizer hash and a 64-bit content hash together, single windows of frequent
minimizers by 128 bits; within blocks the bytes themselves are compared.

Defined results: null texts are empty; texts under 100 bytes lose nothing; the same row given twice is
judged as one and answered twice; different texts under one ``doc_id`` are ordered by text; rows with a null
``doc_id`` come after all others, ordered by text; ids may be any long; very long texts are read in segments of
``SEGMENT`` bytes; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, by_value, materialize, mix64, row_blocks, text_buffer, text_or_empty

LENGTH = 100
GRAM = 20
#: First places of the minimizer in a window, by cell: quarters, then fives, then single windows.
CELLS = ((0, 20, 40, 60), tuple(range(0, 80, 5)), tuple(range(LENGTH - GRAM + 1)))
#: Contents of one minimizer in a chunk beyond which it is frequent.
CHUNK_CONTENTS = 64
SEGMENT = 1 << 18
CHUNK_RECORDS = 600_000
#: Bytes of an Arrow batch between the JVM and Python, rows permitting.
BATCH_BYTES = 4 << 20
#: Texts that are Python objects at a time while they are cut.
CUT_ROWS = 500
BUCKET_BYTES = 24 << 20
BLOCK_STRINGS = 512
BLOCK_BYTES = 64 << 10
TASK_BYTES = 2 << 20


def cells(level: int) -> list[tuple[int, int]]:
    """First and last place of the minimizer in the windows of each cell."""
    return list(zip(CELLS[level], [*(a - 1 for a in CELLS[level][1:]), LENGTH - GRAM]))


# --------------------------------------------------------------------------------------- suffix array


def lyndon_groups(s: bytes) -> tuple[list[int], list[list[int]], list[int]]:
    """Phase 1: group suffixes by their Lyndon prefix.

    Returns the group of each suffix, the members of each group, both in ascending group order, and each
    suffix's previous smaller suffix. Groups start as first characters. They are processed from the highest
    down: a member's previous-smaller pointer skips everything in the same or a higher group; suffixes that
    are pointed at leave their group for a new one right above it, those with more pointers higher.
    """
    n = len(s)
    members: list[list[int]] = []
    group = [0] * n
    places: dict[int, list[int]] = {}
    for i, ch in enumerate(s):
        places.setdefault(ch, []).append(i)
    for ch in sorted(places):
        for i in places[ch]:
            group[i] = len(members)
        members.append(places[ch])
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    prev, skip, done = [-1] * n, [-1] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        members[g] = own
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            if p >= 0 and done[p]:
                q = skip[p]
                while q >= 0 and done[q]:
                    skip[p] = q = skip[q]
                p = q
            prev[i] = skip[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moves.setdefault((-times, group[p]), []).append(p)
        for key in sorted(moves) if len(moves) > 1 else moves:
            old, moved = key[1], moves[key]
            if len(moved) == size[old]:
                continue  # the whole group moves to just above its own place
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            up = above[old]
            above[old] = new
            below.append(old)
            above.append(up)
            if up >= 0:
                below[up] = new
            for p in moved:
                group[p] = new
        g = below[g]
    order, first = [], 0
    while first >= 0:
        order.append(first)
        first = above[first]
    rank = {g: k for k, g in enumerate(order)}
    return [rank[g] for g in group], [members[g] for g in order], prev


def suffix_array(s: bytes) -> list[int]:
    """Suffix array of ``s``, whose last byte must be smaller than all others.

    Phase 2: suffixes are emitted in ascending order. Each emitted suffix lets the suffixes whose Lyndon prefix
    ends at its start, reached by previous-smaller pointers, take the next place of their groups.
    """
    group, members, prev = lyndon_groups(s)
    place, at = [], 0
    for m in members:
        place.append(at)
        at += len(m)
    out = [-1] * len(s)
    put = bytearray(len(s))
    out[0] = len(s) - 1
    put[-1] = 1
    for i in range(len(s)):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            put[j] = 1
            j = prev[j]
    return out


#: UTF-8 has no bytes above 0xF4: all move up by one for the sentinel 0 and the separator 0xFF.
_SHIFT = bytes(min(b + 1, 255) for b in range(256))


def equal_windows(strings: list[bytes], length: int = LENGTH):
    """Classes of equal windows: (class, string, offset) of all windows, classes in suffix order."""
    text = b"\xff".join(x.translate(_SHIFT) for x in strings) + b"\xff\x00"
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    whole = np.append(offset + length <= sizes[string], False)
    order = np.array(suffix_array(text), np.int64)
    order = order[whole[order]]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (windows[1:] != windows[:-1]).any(axis=1)
    return np.cumsum(fresh) - 1, string[order], offset[order]


# -------------------------------------------------------------------------------------------- records


def record_kernel():
    """A function from a block (bytes, offsets) to its records: row, start in the row, run, minimizer, content, place of
    the minimizer in the record, and a hash of the bytes of each cell of ``CELLS[0]`` (0 where it has no window there)."""
    grams, content = RangeHash(0xA11), RangeHash(0xC0DE)
    n_grams = LENGTH - GRAM + 1
    bits = np.uint64(22)
    low = np.uint64((1 << 22) - 1)

    def records(data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        valid = np.arange(n) + LENGTH <= ends
        if not valid.any():
            return None
        places = np.arange(n - GRAM + 1)
        hashes = mix64(grams.ranges(grams.sums(data), places, places + GRAM))
        best = ((hashes >> bits) << bits) | places.astype(np.uint64)  # of equal hashes, the leftmost
        width = 1
        while 2 * width <= n_grams:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        rest = n_grams - width
        best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
        at = (best & low).astype(np.int64)  # for windows 0 .. n - LENGTH
        valid = valid[: len(at)]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        starts = offsets[(offsets > 0) & (offsets < len(at))]
        change[starts] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(at)) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        sums = content.sums(data)
        whole = mix64(content.ranges(sums, first, last + LENGTH) ^ (last - first).astype(np.uint64))
        row = np.searchsorted(offsets, first, side="right") - 1
        gram = at[first]
        sides = []
        for a, b in cells(0):
            inside = np.flatnonzero((gram - last <= b) & (gram - first >= a))
            side = np.zeros(len(first), np.uint32)
            own = gram[inside]
            side[inside] = np.maximum(mix64(content.ranges(sums, own - a, own + LENGTH - b)).astype(np.uint32), 1)
            sides.append(side)
        start, run = (first - offsets[row]).astype(np.int32), (last - first + 1).astype(np.int32)
        return row, start, run, hashes[gram], whole, (gram - first).astype(np.uint8), *sides

    return records


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Blocks (bytes, offsets, rows, shift); texts beyond a segment come in parts that overlap by a window less one."""
    for i, j in row_blocks(offsets, SEGMENT):
        own = offsets[i : j + 1]
        if own[-1] - own[0] <= SEGMENT:
            yield data[own[0] : own[-1]], own - own[0], np.arange(i, j), 0
            continue
        for a in range(0, int(own[-1] - own[0]) - LENGTH + 1, SEGMENT - LENGTH):
            part = data[own[0] + a : min(own[0] + a + SEGMENT - 1, own[-1])]
            yield part, np.array([0, len(part)]), np.array([i]), a


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals by document, sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    block = np.cumsum(new_doc) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + block * far) - block * far
    fresh = new_doc.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


_PACKED = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("blob", pa.binary())])
_PACKED_SQL = "bucket int, doc long, start int, end int, blob binary"


#: Marks a record of a minimizer that is frequent in its chunk, beside the minimizer's place.
_HOT = 0x80
_KINDS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.int32, np.uint8, np.uint8)


def _pack_batches(n_buckets: int):
    def home(x):
        return (mix64(x ^ np.uint64(0xB0C)) % np.uint64(n_buckets)).astype(np.int32)

    def settle(parts):
        """Takes what is in ``parts``, column by column, so that no record is held twice."""
        columns = [list(x) for x in zip(*parts)]
        parts.clear()
        doc, start, run, key, whole, gram, *sides = [np.concatenate(columns.pop(0)) for _ in range(len(columns))]
        order = np.lexsort((start, doc, whole, key))
        k, w = key[order], whole[order]
        copy = np.zeros(len(order), bool)
        copy[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
        gone, kept = order[copy], order[~copy]
        k, w = k[~copy], w[~copy]
        d, a, b = _merged(doc[gone], start[gone], start[gone] + run[gone] + (LENGTH - 1))
        if len(d):
            to = (mix64(d.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.nulls(len(d), pa.binary())],
                schema=_PACKED,
            )
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        times = np.diff(np.append(at, len(k)))
        frequent = k[at[times > CHUNK_CONTENTS]]  # a marker is a record without a run
        hot = np.repeat(times > CHUNK_CONTENTS, times)
        gram[kept[hot]] |= np.uint8(_HOT)
        bucket = np.concatenate((np.where(hot, home(k ^ mix64(w)), home(k)), home(frequent)))
        fields = [doc, key, whole, *sides, start, run, gram]
        del doc, start, run, key, whole, gram, sides, order, copy, gone, k, w, hot, d, a, b
        for i, x in enumerate(fields):
            fields[i] = np.concatenate((x[kept], frequent if i == 1 else np.zeros(len(frequent), x.dtype)))
        order = np.lexsort((fields[-3], fields[0], bucket))
        bucket = bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        names, blobs, size = [], [], 0
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            doc, *own = (x[order[i:j]] for x in fields)
            ids, times = np.unique(doc, return_counts=True)
            head = np.array([j - i, len(ids)], np.int64)
            blobs.append(b"".join([head.tobytes(), ids.tobytes(), times.astype(np.int32).tobytes(), *(x.astype(kind, copy=False).tobytes() for x, kind in zip(own, _KINDS))]))
            names.append(bucket[i])
            size += len(blobs[-1])
            if size >= BATCH_BYTES or j == len(bucket):
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(blobs, pa.binary())],
                    schema=_PACKED,
                )
                names, blobs, size = [], [], 0

    def run(batches):
        kernel = record_kernel()
        parts, size = [], 0
        for batch in batches:
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            for data, offsets, rows, shift in _segments(*text_buffer(batch.column("text"))):
                found = kernel(data, offsets)
                if found is None:
                    continue
                row, start, *rest = found
                parts.append((doc[rows[row]], start + np.int32(shift), *rest))
                size += len(row)
                if size >= CHUNK_RECORDS:
                    del found, row, start, rest
                    yield from settle(parts)
                    size = 0
        if parts:
            yield from settle(parts)

    return run


def _unpack(blob: bytes):
    n, m = np.frombuffer(blob, np.int64, 2)
    at = 16
    out = []
    for kind, count in ((np.int64, m), (np.int32, m), *((kind, n) for kind in _KINDS)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    ids, times, *fields, start, run, gram = out
    return np.repeat(ids, times), *fields, start.astype(np.int64), run.astype(np.int64), gram


def _meets(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row has this key and this side."""
    _, where, times = np.unique(mix64(key ^ mix64(side.astype(np.uint64))), return_inverse=True, return_counts=True)
    return (side > 0) & (times[where] > 1)


_FOUND_SQL = "key long, hot boolean, doc long, start int, end int, gram int"


def _settle_bucket(table: pa.Table) -> pa.Table:
    """Copies across tasks become intervals (null key); of the first records of minimizers with several contents, what
    lies in the cells that they share stays. ``gram`` is the minimizer's place from ``start``."""
    blobs = [x for x in table.column("blob").to_pylist() if x is not None]
    plain = table.filter(table.column("doc").is_valid())
    doc, start, end = (plain.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "end"))
    kd = ks = ke = kk = kg = np.zeros(0, np.int64)
    hot = np.zeros(0, bool)
    if blobs:
        rdoc, key, whole, *sides, rstart, run, gram = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        marked = np.unique(key[run == 0])
        order = np.lexsort((rstart, rdoc, whole, key))
        order = order[run[order] > 0]
        k, w = key[order], whole[order]
        copy = np.zeros(len(order), bool)
        copy[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
        gone, kept = order[copy], order[~copy]
        doc = np.concatenate((doc, rdoc[gone]))
        start = np.concatenate((start, rstart[gone]))
        end = np.concatenate((end, rstart[gone] + run[gone] + LENGTH - 1))
        k = key[kept]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        far = (gram[kept] >= _HOT) | np.isin(k, marked)
        some = same[1:] | same[:-1] | far
        kept, k, far = kept[some], k[some], far[some]
        low, high = np.full(len(k), LENGTH, np.int64), np.full(len(k), -1, np.int64)
        for side, (a, b) in zip(sides, cells(0)):
            own = side[kept]
            met = _meets(k, own) | (far & (own > 0))
            low[met] = np.minimum(low[met], a)
            high[met] = b
        place = gram[kept].astype(np.int64) & (_HOT - 1)
        low, high = np.maximum(low, place - run[kept] + 1), np.minimum(high, place)
        some = low <= high
        kept, k, far, low, high, place = (x[some] for x in (kept, k, far, low, high, place))
        _, where, times = np.unique(k, return_inverse=True, return_counts=True)
        hot = far | (times[where] > BLOCK_STRINGS)
        kk, kd, ks, kg = k.view(np.int64), rdoc[kept], rstart[kept] + place - high, high
        ke = ks + (high - low) + LENGTH
    doc, start, end = _merged(doc, start, end)
    n = len(doc)
    return pa.table(
        {
            "key": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(kk, pa.int64())]),
            "hot": pa.array(np.concatenate((np.zeros(n, bool), hot))),
            "doc": pa.array(np.concatenate((doc, kd)), pa.int64()),
            "start": pa.array(np.concatenate((start, ks)).astype(np.int32)),
            "end": pa.array(np.concatenate((end, ke)).astype(np.int32)),
            "gram": pa.array(np.concatenate((np.zeros(n, np.int64), kg)).astype(np.int32)),
        }
    )


# ------------------------------------------------------------------------------------- suffix-array blocks


_BLOCK_SQL = "doc long, start int, end int"


def _settle_block(docs, starts, strings):
    """Intervals of all but the first window of each class."""
    cls, string, offset = equal_windows(strings)
    doc, start = np.array(docs, np.int64)[string], np.array(starts, np.int64)[string] + offset
    order = np.lexsort((start, doc, cls))
    cls, doc, start = cls[order], doc[order], start[order]
    first = np.ones(len(cls), bool)
    first[1:] = cls[1:] != cls[:-1]
    heads = np.flatnonzero(first)
    own = heads[cls] if len(heads) else heads
    later = (doc != doc[own]) | (start != start[own])
    d, s, e = _merged(doc[later], start[later], start[later] + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc", "start", "end"])


def _sort_blocks(batches):
    """Rows (key, doc, start, bytes), sorted by key, gathered to blocks."""
    held, size, last = ([], [], []), 0, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("key", "doc", "start", "bytes")]
        for key, *row in zip(*cols):
            if size >= BLOCK_BYTES and key != last:
                yield _settle_block(*held)
                held, size = ([], [], []), 0
            last = key
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[2])
    if size:
        yield _settle_block(*held)


# ------------------------------------------------------------------------------------ frequent minimizers


_CELL_SQL = "k1 long, k2 long, doc long, start int, gram int, bytes binary"


def _cell_batches(level: int):
    """Rows (doc, start, gram, bytes) cut to the cells of a level; (k1, k2) is a hash of the bytes that all windows of the
    cell hold, and of the cell."""

    def run(batches):
        hashers = RangeHash(0x51), RangeHash(0x52)
        for batch in batches:
            doc, start, gram = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "gram"))
            strings = batch.column("bytes").to_pylist()
            size = np.fromiter(map(len, strings), np.int64, len(strings))
            data = np.frombuffer(b"".join(strings), np.uint8)
            base = np.cumsum(size) - size
            sums = [h.sums(data) for h in hashers]
            least = gram - (size - LENGTH)
            for a, b in cells(level):
                own = np.flatnonzero((least <= b) & (gram >= a))
                if not len(own):
                    continue
                at = base[own] + gram[own]
                keys = [mix64(h.ranges(x, at - a, at + LENGTH - b) ^ np.uint64(a << 8 | b)).view(np.int64) for h, x in zip(hashers, sums)]
                high, low = np.minimum(gram[own], b), np.maximum(least[own], a)
                cut, to = gram[own] - high, gram[own] - low + LENGTH
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(pa.array, keys), pa.array(doc[own]), pa.array((start[own] + cut).astype(np.int32)), pa.array(high.astype(np.int32)),
                        pa.array([strings[i][x:y] for i, x, y in zip(own.tolist(), cut.tolist(), to.tolist())], pa.binary()),
                    ],
                    ["k1", "k2", "doc", "start", "gram", "bytes"],
                )

    return run


def _split_frequent(hot: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows (key, doc, start, bytes) that fit blocks, and intervals, of the records of frequent minimizers.

    Each level drops what stands alone in its cell. Counts are written before they are joined, so that a
    group of any size is dealt to as many tasks as its bytes need.
    """
    fit, found = [], []
    for level in range(len(CELLS)):
        parts = materialize(hot.mapInArrow(_cell_batches(level), _CELL_SQL), "cells")
        first = F.min(F.struct("doc", "start"))
        groups = materialize(parts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1"), "cell-counts")
        shared = materialize(parts.join(groups, ["k1", "k2"]), "shared-cells")
        if level == len(CELLS) - 1:
            later = F.struct("doc", "start") != F.col("first")
            found.append(shared.filter(later).select("doc", "start", (F.col("start") + LENGTH).alias("end")))
            break
        fit.append(shared.filter(F.col("n") <= BLOCK_STRINGS).select(F.col("k1").alias("key"), "doc", "start", "bytes"))
        hot = shared.filter(F.col("n") > BLOCK_STRINGS).select("doc", "start", "gram", "bytes")
        if hot.isEmpty():
            break
    return fit, found


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, doc, text): ``doc`` orders documents. Where ids repeat or are null, equal rows are made one and numbered
    in the order of their ids and texts. Also whether that was needed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    stats = rows.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if not stats.nulls and (stats.most or 1) == 1:
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "text"), False
    placed = rows.distinct().orderBy(F.col("doc_id").isNull(), "doc_id", "text")
    return materialize(placed.select("doc_id", F.monotonically_increasing_id().alias("doc"), "text"), "ordered"), True


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of about ``BATCH_BYTES`` for what runs inside, unless the session sets their size: 10,000 rows of long
    texts would be far more."""
    if spark.conf.get(_BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES)


def later_intervals(rows: DataFrame) -> DataFrame:
    """(doc, start, end): bytes covered by windows that also start earlier, as intervals that may overlap."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packed = rows.select("doc", "text").mapInArrow(_pack_batches(int(total // 2 // BUCKET_BYTES) + partitions), _PACKED_SQL)
    found = materialize(packed.groupBy("bucket").applyInArrow(_settle_bucket, _FOUND_SQL), "records")
    open_ = found.filter(F.col("key").isNotNull())
    with_bytes = materialize(
        open_.join(rows.select("doc", "text"), "doc").select(
            "key", "hot", "doc", "start", "gram", F.expr("substring(cast(text as binary), start + 1, end - start)").alias("bytes")
        ),
        "open-records",
    )
    strings = [with_bytes.filter("not hot").select("key", "doc", "start", "bytes")]
    intervals = [found.filter(F.col("key").isNull()).select("doc", "start", "end")]
    hot = with_bytes.filter("hot").select("doc", "start", "gram", "bytes")
    if not hot.isEmpty():
        fit, single = _split_frequent(hot)
        strings, intervals = strings + fit, intervals + single
    size = open_.agg(F.sum((F.col("end") - F.col("start")).cast("long"))).first()[0] or 0
    blocks = reduce(DataFrame.union, strings).repartition(max(partitions, int(size // TASK_BYTES)), "key").sortWithinPartitions("key")
    intervals.append(materialize(blocks.mapInArrow(_sort_blocks, _BLOCK_SQL), "windows"))
    return reduce(DataFrame.union, intervals)


def _cut_batches(keep_bytes: bool):
    def run(batches):
        for batch in (x.slice(i, CUT_ROWS) for x in batches for i in range(0, x.num_rows, CUT_ROWS)):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            spans = batch.column("spans").to_pylist()
            for text, own in zip(batch.column("text").to_pylist(), spans):
                raw = text.encode()
                parts, at, removed, runs = [], 0, 0, 0
                if own:
                    reach = -1
                    for a, b in sorted((x["start"], x["end"]) for x in own):
                        if a > reach:
                            parts.append(raw[at:a])
                            runs += 1
                            removed += b - a
                            reach = b
                        elif b > reach:
                            removed += b - reach
                            reach = b
                        at = reach
                parts.append(raw[at:])
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(runs)
                left = b"".join(parts)
                kept.append(left if keep_bytes else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(kept, pa.binary() if keep_bytes else pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is the remaining bytes, or their SHA-256 in hex."""
    rows, changed = _keyed(docs)
    with _small_batches(docs.sparkSession):
        found = later_intervals(rows)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = "binary" if keep_bytes else "string"
    out = (
        rows.join(spans, "doc", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut_batches(keep_bytes), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
    )
    if not changed:
        return out
    # rows that were made one are answered as often as they came
    times = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).groupBy("doc_id", "text").count()
    again = (
        rows.join(spans, "doc", "left")
        .join(times.withColumnRenamed("doc_id", "__id").withColumnRenamed("text", "__text"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text") == F.col("__text")))
        .select("doc_id", "text", "spans", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("__k"))
        .select("doc_id", "text", "spans")
    )
    return again.mapInArrow(_cut_batches(keep_bytes), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")


by_value(__name__)
