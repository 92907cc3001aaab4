"""Chroma audio fingerprints: extraction, grouping of equal recordings, and search by alignment.

A recording is cut into overlapping frames; each frame's spectrum is folded into 12 pitch classes, smoothed
over five frames and scaled to unit length. Over the integral image of these chroma frames 16 filters
compare areas of a 16-frame window; each is quantised to two Gray-coded bits, which gives one packed 32-bit
integer per window position. Two recordings are aligned by the histogram of offsets at which their integers
are equal; the bit error rate over the overlap at the best offset decides.

Search: every query is compared to all recordings. Recordings with equal fingerprints are one class and
are compared once. Two classes are linked if their integers agree exactly at ``needed`` positions or more, at one
offset, and the bit error rate over the overlap there is at most ``MAX_BER``. What is needed is ``MIN_HITS`` of the
longer one's positions or, with ``excerpts``, of the shorter one's: then ``EVIDENCE`` integers at least, or all of the
shorter one, unless ``MIN_HITS`` of the longer one's positions are fewer. Equal integers at one offset lie in the
shorter one's positions, so two of them are near each other: both sides hold these two integers at the same distance,
and only pairs with such a landmark are aligned. Where one equal integer is enough, the integer itself is the landmark.
Queries' landmarks set bits of a Bloom filter, so that of the other recordings' landmarks those that no query holds are
dropped where they are made. It grows with the queries up to ``MOST_BITS``; beyond, it lets more pass, and the join on the
landmarks themselves decides as ever. No candidate is capped.

Codes are written once, with the recordings. A class is the smallest id with a digest; the codes of its own row are read
where they lie, found by a filter of the classes, and copies that it lets through get no link.

Media come as WAV bytes (8 to 32 bit PCM, any number of channels) or as raw unsigned 8-bit samples.

Media too short for an integer are repeated up to ``Audio.fill`` integers where that is set.

Defined results: null, empty and too short media have no fingerprint, are a class each and have no links;
repeated rows are equal recordings; ties between offsets go to the smallest; an empty table gives an empty
result; extra columns are ignored. A null ``id`` takes part in a class but is no query.
"""

from __future__ import annotations

import io
import wave

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, discard, materialize, mix64, row_blocks

WINDOW = 16
#: Added to mean energies of unit-length frames, so that silent pitch classes are not compared by their noise.
FLOOR = 0.02
MIN_HITS, MAX_BER, EVIDENCE = 0.2, 0.3, 5
#: Bits and probes of the filter for each landmark of a query, its largest size (128 MB) and that of a page, in bits.
KEY_BITS, PROBES, MOST_BITS, PAGE_BITS = 16, 4, 1 << 30, 1 << 19
#: What a landmark's recording can be in a pair.
HELD, ASKED = 1, 2
#: Integers whose landmarks are made at once.
BLOCK = 200_000
#: Bytes of codes of a cell of the alignment on either side, and below which the held ones are not dealt further.
CELL_BYTES, LEAST_CELL = 64 << 20, 8 << 20


@dataclass(frozen=True)
class Audio:
    """Frame geometry and the folded range; ``raw_rate`` is the sample rate of raw media. Media without an integer
    are repeated until they have ``fill``; with 0 they stay without."""

    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0
    raw_rate: int = 11025
    fill: int = 0

    def length(self, n_codes: int) -> int:
        """Samples of a recording with so many integers."""
        return self.frame + (n_codes + WINDOW + len(_SMOOTH) - 3) * self.hop


#: Raw bytes are short recordings: small frames and repeats give them fingerprints. The folded range covers the spectrum.
BYTES = Audio(frame=256, hop=32, low=300.0, high=5500.0, fill=8)

#: (kind, first pitch class, pitch classes, frames, thresholds): areas compared by the filters.
FILTERS = (
    (0, 6, 6, 15, (-0.10, 0.0, 0.10)), (1, 4, 6, 15, (-0.10, 0.0, 0.10)), (2, 0, 4, 16, (-0.08, 0.0, 0.08)),
    (3, 8, 4, 14, (-0.08, 0.0, 0.08)), (4, 0, 8, 8, (-0.08, 0.0, 0.08)), (1, 0, 12, 4, (-0.10, 0.0, 0.10)),
    (5, 2, 6, 12, (-0.08, 0.0, 0.08)), (2, 6, 6, 12, (-0.08, 0.0, 0.08)), (3, 0, 6, 16, (-0.08, 0.0, 0.08)),
    (1, 2, 4, 8, (-0.10, 0.0, 0.10)), (4, 4, 8, 16, (-0.08, 0.0, 0.08)), (2, 2, 4, 6, (-0.10, 0.0, 0.10)),
    (1, 8, 4, 6, (-0.10, 0.0, 0.10)), (5, 4, 6, 9, (-0.08, 0.0, 0.08)), (3, 4, 8, 8, (-0.08, 0.0, 0.08)),
    (4, 2, 6, 4, (-0.10, 0.0, 0.10)),
)
_GRAY = np.array([0, 1, 3, 2], np.uint32)
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def samples_of(blob: bytes, audio: Audio) -> tuple[np.ndarray, int]:
    """Mono samples around zero and their rate."""
    if blob[:4] == b"RIFF" and blob[8:12] == b"WAVE":
        with wave.open(io.BytesIO(blob)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0
        elif width == 3:
            b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8).astype(np.float32)
        else:
            x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float32)
        return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate
    return np.frombuffer(blob, np.uint8).astype(np.float32) - 128.0, audio.raw_rate


def fold_matrix(audio: Audio, rate: int) -> np.ndarray:
    """Spectrum bins to the mean of their pitch class, for the bins of the folded range."""
    hz = np.arange(audio.frame // 2 + 1) * rate / audio.frame
    out = np.zeros((len(hz), 12), np.float32)
    inside = np.flatnonzero((hz >= audio.low) & (hz <= audio.high))
    out[inside, np.round(12 * np.log2(hz[inside] / 440.0)).astype(int) % 12] = 1.0
    return out / np.maximum(out.sum(axis=0), 1.0)


def chroma_frames(x: np.ndarray, audio: Audio, fold: np.ndarray, taper: np.ndarray) -> np.ndarray:
    """Pitch-class energies of all frames, in blocks so that memory does not follow the recording's length."""
    n = (len(x) - audio.frame) // audio.hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    views = np.lib.stride_tricks.sliding_window_view(x, audio.frame)[:: audio.hop]
    parts = []
    for i in range(0, n, 1024):
        spectrum = np.fft.rfft(views[i : i + 1024] * taper, axis=1)
        parts.append((spectrum.real**2 + spectrum.imag**2) @ fold)
    return np.concatenate(parts).astype(np.float64)


def packed_codes(chroma: np.ndarray) -> np.ndarray:
    """One uint32 for each position of the 16-frame window over smoothed, scaled chroma frames."""
    n = len(chroma) - len(_SMOOTH) + 1
    if n < WINDOW:
        return np.zeros(0, np.uint32)
    smooth = sum(w * chroma[i : i + n] for i, w in enumerate(_SMOOTH))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    smooth = np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-9)
    image = np.zeros((n + 1, 13))
    image[1:, 1:] = smooth.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n - WINDOW + 1)

    def area(t0, t1, p0, p1):
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    codes = np.zeros(len(at), np.uint32)
    for kind, p, h, w, cuts in FILTERS:
        q = p + h
        mid_t, mid_p = w // 2, p + h // 2
        whole, cells = area(0, w, p, q), w * h
        if kind == 0:  # low against all pitch classes
            a, part = area(0, w, p, mid_p), w * (mid_p - p)
        elif kind == 1:  # low against high pitch classes
            a, part = area(0, w, mid_p, q), w * (q - mid_p)
        elif kind == 2:  # early against late
            a, part = area(mid_t, w, p, q), (w - mid_t) * h
        elif kind == 3:  # two opposite quarters against the others
            a = area(0, mid_t, mid_p, q) + area(mid_t, w, p, mid_p)
            part = mid_t * (q - mid_p) + (w - mid_t) * (mid_p - p)
        elif kind == 4:  # middle third of pitch classes against the rest
            a, part = area(0, w, p + h // 3, q - h // 3), w * (h - 2 * (h // 3))
        else:  # middle third of time against the rest
            a, part = area(w // 3, w - w // 3, p, q), (w - 2 * (w // 3)) * h
        value = np.log((a / part + FLOOR) / (np.maximum(whole - a, 0) / (cells - part) + FLOOR))
        codes = (codes << np.uint32(2)) | _GRAY[np.searchsorted(np.array(cuts), value, side="right")]
    return codes


def _print_batches(audio: Audio):
    def run(batches):
        taper = np.hamming(audio.frame).astype(np.float32)
        folds: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for blob in batch.column("media"):
                blob = blob.as_py() or b""
                x, rate = samples_of(blob, audio)
                if audio.fill and 0 < len(x) < audio.length(1):
                    x = np.resize(x, audio.length(audio.fill))
                if rate not in folds:
                    folds[rate] = fold_matrix(audio, rate)
                out.append(packed_codes(chroma_frames(x, audio, folds[rate], taper)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "codes"])

    return run


def fingerprints(media: DataFrame, audio: Audio = Audio()) -> DataFrame:
    """(id, codes) for rows (id, media): packed little-endian uint32s, empty where the recording is too short."""
    return media.select("id", "media").mapInArrow(_print_batches(audio), "id long, codes binary")


# ---------------------------------------------------------------------------------------------- search


def needed(n: int, m: int, min_hits: float, excerpts: bool) -> int:
    """Equal integers that recordings of ``n`` and ``m`` positions must have at one offset."""
    low, most = min(n, m), int(np.ceil(max(n, m) * min_hits))
    return max(int(np.ceil(low * min_hits)), min(EVIDENCE, low, most)) if excerpts else most


def farthest(n: int, min_hits: float, excerpts: bool) -> int:
    """How far apart two neighbouring equal integers may be at most, where a recording of ``n`` positions is linked and
    needs two or more. Longer partners need no fewer than one of ``n`` positions, and two at least."""
    m = np.arange(1, n + 1)
    most = np.ceil(n * min_hits)
    need = np.maximum(np.ceil(m * min_hits), np.minimum(np.minimum(EVIDENCE, m), most)) if excerpts else np.full(n, most)
    return int(((m - 1) // np.maximum(need - 1, 1))[need > 1].max(initial=0 if need[-1] > 1 else n - 1))


def _placed(batches):
    """Rows (id, n, marks) of rows (id, codes): all integers of a recording with their places."""
    for batch in batches:
        parts = [np.frombuffer(blob.as_py(), "<i4") for blob in batch.column("codes")]
        size = np.array([len(x) for x in parts], np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        pos = (np.arange(ends[-1]) - np.repeat(ends[:-1], size)).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        marks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(pos), pa.array(flat)], ["pos", "mark"]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), marks], ["id", "n", "marks"])


def _probes(low: np.ndarray):
    """The bits of its page that each key sets, by the key's lower half."""
    low = low.astype(np.uint64)
    step = mix64(low) | np.uint64(1)
    for i in range(PROBES):
        yield (low + np.uint64(i) * step) & np.uint64(PAGE_BITS - 1)


def _held_by(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter holds."""
    at, low = np.arange(len(keys)), keys & np.uint64(0xFFFFFFFF)
    page = (keys >> np.uint64(32)) % np.uint64(8 * len(bits) // PAGE_BITS) * np.uint64(PAGE_BITS)
    step = mix64(low) | np.uint64(1)
    for i in range(PROBES):
        bit = page[at] + ((low[at] + np.uint64(i) * step[at]) & np.uint64(PAGE_BITS - 1))
        at = at[(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _page_batches(size: int):
    """Rows (page, lows) of rows of keys: the lower halves of the keys of a page, a quarter of what the bits would take."""

    def run(batches):
        for batch in batches:
            keys = np.unique(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            pages = (keys >> np.uint64(32)) % np.uint64(size // PAGE_BITS)
            order = np.argsort(pages, kind="stable")
            page, first = np.unique(pages[order], return_index=True)
            parts = np.split(keys[order].astype("<u4"), first[1:]) if len(page) else []
            yield pa.RecordBatch.from_arrays([pa.array(page.astype(np.int64)), pa.array([x.tobytes() for x in parts], pa.binary())], ["page", "lows"])

    return run


def _join_page(page: pa.Table) -> pa.Table:
    whole = np.zeros(PAGE_BITS, np.uint8)
    for x in page.column("lows"):
        for bits in _probes(np.frombuffer(x.as_py(), "<u4")):
            whole[bits.astype(np.int64)] = 1
    return pa.table({"page": page.column("page").slice(0, 1), "bits": pa.array([np.packbits(whole, bitorder="little").tobytes()], pa.binary())})


def landmark_filter(keys: DataFrame) -> np.ndarray:
    """The bytes of a Bloom filter of the column ``key``; pages are put together apart, and the driver lines them up."""
    wish, size = KEY_BITS * keys.count(), PAGE_BITS
    while size < min(wish, MOST_BITS):
        size *= 2
    parts = keys.select("key").mapInArrow(_page_batches(size), "page long, lows binary")
    pages = materialize(parts.groupBy("page").applyInArrow(_join_page, "page long, bits binary"), "pages")
    out = np.zeros(size // 8, np.uint8)
    for row in pages.toLocalIterator():
        out[row.page * (PAGE_BITS // 8) : (row.page + 1) * (PAGE_BITS // 8)] = np.frombuffer(row.bits, np.uint8)
    discard(pages)
    return out


def _wanted_batches(wanted):
    """Rows without their ``key``, those whose key the filter holds."""

    def run(batches):
        for batch in batches:
            some = _held_by(wanted.value, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select([c for c in batch.schema.names if c != "key"]).take(pa.array(some))

    return run


def _landmark_batches(min_hits: float, excerpts: bool, asked: bool, wanted=None, both: bool = False):
    """Rows (key, id, role) of recordings (id, n, marks), ``marks`` being integers of theirs, by place: a key for every two
    integers that are near enough, and keys of single integers for partners where one is enough: both sides short, or
    one of them of a single position. With ``wanted``, a filter sent to the executors, only the keys that it holds.
    The recordings are queries or, without ``asked``, held; or ``both``, and then a key of both is one row."""
    reach: dict[int, int] = {}

    def keys_of(owner: np.ndarray, n: np.ndarray, far: np.ndarray, pos: np.ndarray, marks: np.ndarray):
        """Keys, the places of the (first) integers they are of, and their roles."""
        role = HELD | ASKED if both else ASKED if asked else HELD
        for step in range(1, len(marks)):
            gap = pos[step:] - pos[:-step]
            near = np.flatnonzero((owner[step:] == owner[:-step]) & (gap <= far[step:]))
            if not len(near):
                break
            yield mix64(mix64(marks[near] << np.uint64(32) | marks[near + step]) + gap[near].astype(np.uint64)), near, np.full(len(near), role, np.int8)
        kinds = {1: np.where(np.ceil(n * min_hits) <= 1, role, 0)}
        if excerpts:  # 2: the held one has a single position; 3: the query has
            kinds |= {2: np.where(n == 1, role, role & ASKED), 3: np.where(n == 1, role, role & HELD)}
        for kind, roles in kinds.items():
            at = np.flatnonzero(roles)
            yield mix64(marks[at] | np.uint64(kind << 40)), at, roles[at].astype(np.int8)

    def run(batches):
        for batch in batches:
            n, both = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("marks")
            ends = both.offsets.to_numpy().astype(np.int64)
            ids, parts, owners, kinds = batch.column("id").to_numpy(zero_copy_only=False), [], [], []
            for x in set(n.tolist()) - reach.keys():
                reach[x] = farthest(x, min_hits, excerpts) if x else 0
            far = np.array([reach[x] for x in n.tolist()], np.int64)
            for i, j in row_blocks(ends, BLOCK):
                own = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                flat = both.values.slice(ends[i], ends[j] - ends[i])
                pos = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                marks = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32).astype(np.uint64)
                found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8))]
                for keys, at, roles in keys_of(own, n[own], far[own], pos, marks):
                    some = slice(None) if wanted is None else _held_by(wanted.value, keys)
                    found.append((keys[some], own[at[some]], roles[some]))
                keys, owner, roles = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((keys, owner))
                keys, owner, roles = keys[order], owner[order], roles[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                parts.append(keys[new].view(np.int64))
                owners.append(ids[owner[new]])
                kinds.append(roles[new])
            if parts:
                made = [np.concatenate(parts), np.concatenate(owners).astype(np.int64), np.concatenate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "id", "role"])

    return run


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Best offset of ``b`` in ``a`` (positions of a minus positions of b), equal integers there, bit error rate there."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = hi - lo
    if not count.any():
        return 0, 0, 1.0
    heads = np.cumsum(count) - count
    where = order[np.repeat(lo - heads, count) + np.arange(int(count.sum()))]
    offsets = np.repeat(np.arange(len(a)), count) - where + len(b)
    votes = np.bincount(offsets, minlength=len(a) + len(b))
    best = int(votes.argmax()) - len(b)
    x, y = (a[best:], b) if best >= 0 else (a, b[-best:])
    m = min(len(x), len(y))
    return best, int(votes[best + len(b)]), float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32.0 * m)


def _align_cell(max_ber: float, min_hits: float, excerpts: bool):
    """Links of a cell: its held classes (id, codes) against its queries (query, query_codes, ids), each with its candidates."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        code = {i: x.as_buffer() for i, x in zip(held.column("id").to_pylist(), held.column("codes"))}
        out: list[tuple] = []
        for q, own, ids in zip(asked.column("query").to_pylist(), asked.column("query_codes"), asked.column("ids")):
            a = np.frombuffer(own.as_buffer(), "<u4")
            for d in filter(code.__contains__, ids.values.to_pylist()):
                b = np.frombuffer(code[d], "<u4")
                o, h, e = align(a, b)
                if e <= max_ber and h >= needed(len(a), len(b), min_hits, excerpts):
                    out.append((q, d, o, h, e))
        kinds = {"query": pa.int64(), "id": pa.int64(), "offset": pa.int32(), "hits": pa.int32(), "ber": pa.float64()}
        columns = list(zip(*out)) or [()] * len(kinds)
        return pa.table({c: pa.array(x, kind) for (c, kind), x in zip(kinds.items(), columns)})

    return run


def _aligned(
    pairs: DataFrame, classes: DataFrame, max_ber: float, min_hits: float, excerpts: bool,
    asking: DataFrame | None = None, own: DataFrame | None = None,
) -> DataFrame:
    """(query, id, offset, hits, ber) of the pairs (query, id) that are linked, ``classes`` being (id, asks, codes); or all
    recordings (id, digest, codes), with the classes that ask, ``asking`` (id, codes), and all classes, ``own`` (id, digest).

    Classes are dealt to blocks, and so are those that ask. A query's codes are sent once to each block that holds a
    candidate of it, and not with each candidate, whose number grows with the square of the input; held codes are sent
    once for each block of queries that needs them. Most classes are no candidates, and a filter keeps these at their place.
    """
    asking = classes.filter("asks") if asking is None else asking
    whole, some = (x.agg(F.coalesce(F.sum(F.octet_length("codes")), F.lit(0))).first()[0] for x in (classes, asking))
    n_held, n_asked = max(-(-whole // CELL_BYTES), min(-(-whole // LEAST_CELL), 64), 1), -(-some // CELL_BYTES) or 1
    cell = F.pmod(F.xxhash64("id"), F.lit(n_held)) * n_asked + F.pmod(F.xxhash64("query"), F.lit(n_asked))
    dealt = pairs.withColumn("cell", cell)
    codes = asking.select(F.col("id").alias("query"), F.col("codes").alias("query_codes"))
    asked = dealt.groupBy(F.col("cell").alias("at"), "query").agg(F.collect_list("id").alias("ids")).join(codes, "query")
    wanted = pairs.sparkSession.sparkContext.broadcast(landmark_filter(pairs.select(F.xxhash64("id").alias("key")).distinct()))
    names, kinds = ["id", "codes"], "id long, codes binary"
    held = dealt.select("cell", "id").distinct()
    if own is not None:
        names, kinds, held = ["id", "digest", "codes"], "id long, digest binary, codes binary", held.join(own, "id")
    candidates = classes.select(F.xxhash64("id").alias("key"), *names).mapInArrow(_wanted_batches(wanted), kinds)
    held = held.join(candidates, names[:-1]).select("cell", "id", "codes")
    return held.groupBy("cell").cogroup(asked.groupBy("at")).applyInArrow(
        _align_cell(max_ber, min_hits, excerpts), "query long, id long, offset int, hits int, ber double"
    )


def search(prints: DataFrame, is_query, min_hits: float = MIN_HITS, max_ber: float = MAX_BER, excerpts: bool = False) -> DataFrame:
    """One row per recording: (id, class_id, n_codes, codes_crc32, is_query, links).

    ``class_id`` is the smallest id with this fingerprint. ``links``, held by the class's own row (id = class_id),
    lists the classes that hold a query and align with it: (query_class, offset, hits, ber).
    """
    length = (F.octet_length("codes") / 4).cast("int")
    prints = prints.withColumn("digest", F.unhex(F.md5("codes"))).withColumn("is_query", is_query)
    prints = materialize(prints.withColumn("n_codes", length).withColumn("codes_crc32", F.crc32("codes")), "fingerprints")
    full = prints.filter((F.octet_length("codes") > 0) & F.col("id").isNotNull())
    classes = prints.filter(F.octet_length("codes") > 0).groupBy("digest").agg(F.min("id").alias("id"), F.bool_or("is_query").alias("asks"))
    classes = materialize(classes.filter("id is not null"), "print-classes")
    send = prints.sparkSession.sparkContext.broadcast
    own_row = F.xxhash64("digest", "id").alias("key")

    def rows_of(some):
        """The filter of these classes' own rows."""
        return send(landmark_filter(some.select(own_row)))

    asks = rows_of(classes.filter("asks"))
    asking = full.select(own_row, "digest", "id", "codes").mapInArrow(_wanted_batches(asks), "digest binary, id long, codes binary")
    asking = asking.dropDuplicates(["digest", "id"]).join(classes.filter("asks").select("digest", "id"), ["digest", "id"])
    asking = materialize(asking.select("id", "codes").repartition(prints.sparkSession.sparkContext.defaultParallelism, "id"), "asking")
    kinds = "key long, id long, role byte"
    both = _landmark_batches(min_hits, excerpts, True, both=True)
    queries = materialize(asking.mapInArrow(lambda batches: both(_placed(batches)), kinds), "asked")
    wanted = send(landmark_filter(queries.filter(F.col("role").bitwiseAND(ASKED) > 0)))
    others = rows_of(classes.filter("not asks"))
    own_rows, marked = _wanted_batches(others), _landmark_batches(min_hits, excerpts, False, wanted)
    mine = full.select(own_row, "id", "codes").mapInArrow(lambda batches: marked(_placed(own_rows(batches))), kinds)
    # all that queries ask is in the filter; of what they only hold, little is
    theirs = queries.withColumn("mark", F.col("key")).mapInArrow(_wanted_batches(wanted), "id long, role byte, mark long")
    lists = [F.collect_list(F.when(F.col("role") == x, F.col("id"))).alias(f"l{x}") for x in (HELD, ASKED, HELD | ASKED)]
    ids, asked = (F.array_sort(F.concat(f"l{HELD | ASKED}", f"l{x}")) for x in (HELD, ASKED))
    # near copies share most of their landmarks: equal lists of holders are paired once
    holders = (
        mine.union(theirs.select("mark", "id", "role"))
        .groupBy("key").agg(*lists).select(ids.alias("ids"), asked.alias("queries"))
        .filter((F.size("queries") > 0) & (F.size("ids") > F.when(F.array_contains("ids", F.get("queries", F.lit(0))) & (F.size("queries") == 1), 1).otherwise(0)))
        .select("ids", "queries").distinct()
    )
    pairs = holders.select("ids", F.explode("queries").alias("query")).select("query", F.explode("ids").alias("id"))
    pairs = materialize(pairs.filter("query <> id").distinct(), "pairs")
    for x in (asks, wanted, others):
        x.destroy()
    discard(queries)
    links = (
        _aligned(pairs, full, max_ber, min_hits, excerpts, asking, classes.select("id", "digest"))
        .groupBy(F.col("id").alias("class_id"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("query").alias("query_class"), "offset", "hits", F.round("ber", 6).alias("ber")))).alias("links"))
    )
    links = materialize(links, "links")
    discard(pairs, asking)
    ids = classes.select(F.col("digest"), F.col("id").alias("class_id"))
    out = prints.drop("codes").join(ids, "digest", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    mine = F.col("id").eqNullSafe(F.col("class_id"))  # other rows have no links: dealt by their id, not together by a null key
    links = links.select(F.col("class_id").alias("__class"), F.lit(0).cast("long").alias("__other"), "links")
    other = F.when(mine, F.lit(0).cast("long")).otherwise(F.xxhash64("id").bitwiseOR(F.lit(1).cast("long")))
    return out.join(links, (F.col("class_id") == F.col("__class")) & (other == F.col("__other")), "left").select(
        "id", "class_id", "n_codes", "codes_crc32", "is_query",
        F.coalesce("links", F.array().cast("array<struct<query_class:bigint,offset:int,hits:int,ber:double>>")).alias("links"),
    )


by_value(__name__)
