"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are hashes of five consecutive words (A-Z lowered); a document of one to four words is one
   shingle. Weight = tf * ln(1 + N / df), with the exact df of every shingle: rows are dealt to blocks of bounded size,
   a block's distinct shingles are sent with their counts to buckets of the hash range, and a bucket sends back to each
   block those of its shingles that two documents or more hold. Nothing is collected or broadcast, and a frequent
   shingle is one entry for each block. Each document keeps the df of its shingles beside its text.
2. Each shingle hashes to one of ``K`` bins; in its bin it draws the consistent weighted sample of its
   weight (r, c ~ Gamma(2, 1), beta ~ U(0, 1)); the smallest draw represents the bin. Empty bins take the
   next bin's sample. Drawing in one bin instead of K keeps the sample consistent at 1/K of the cost.
3. ``BANDS`` bands of ``ROWS`` samples are keys. A key's documents are linked to its smallest member
   (counting and minimum only, so no key gathers its documents), the pairs are made distinct, and each is
   verified by the exact weighted Jaccard similarity of the whole texts.
4. Links are closed to components. Documents that still share a key with another component try again under
   keys of two bands and with the largest member, where other partners meet them.
5. Documents that share a key with another component even then are joined exactly: all pairs of different
   components that can reach the threshold by their prefixes of rare shingles are verified, so no pair that
   meets under a key is lost, however large the key is.

Equal texts are one node from the start and are not compared.

Defined results: null and blank texts have no shingles; equal ones form a class, like all equal texts; null is the empty
text. Rows that repeat a ``doc_id`` are one document; ``keep_one`` returns the one of the smallest text. Rows without an id
come after all others, in the order of their texts, and equal ones are one document; a class of such rows only has a
made ``class_id`` below 0. Ids may be any long. Very long texts are compared whole. An empty table gives an empty
result. Extra columns of any name pass through ``keep_one``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    RangeHash,
    SetAside,
    by_value,
    digest16,
    discard,
    materialize,
    mix64,
    row_blocks,
    text_buffer,
    text_or_empty,
    uniform,
)

SHINGLE, THRESHOLD = 5, 0.8
#: Share of the documents below which all shingles weigh alike: none, every df counts.
DF_FLOOR = 0.0
BANDS, ROWS = 24, 5
K = BANDS * ROWS
BLOCK_BYTES = 2 << 20
#: Text bytes of a block of rows that share a table of document frequencies, and of what a bucket of the hash range counts.
DF_BLOCK, DF_BUCKET = 4 << 20, 4 << 20
#: Rows of a shingle that meet in one cell of the exact join; a more frequent one is dealt to pairs of blocks.
CELL = 500


# --------------------------------------------------------------------------------------- shingle kernel


def word_kernel():
    """A function from a text block (bytes, offsets) to word hashes and each row's first word."""
    hasher = RangeHash(0x5EED)
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        solid = ~space[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True  # rows do not run into each other
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | first[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:-1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        hashes = mix64(hasher.ranges(hasher.sums(lower[data]), start, end) ^ (end - start).astype(np.uint64))
        return hashes, np.searchsorted(start, offsets)

    return words


_STEP = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def shingle_rows(hashes: np.ndarray, first: np.ndarray):
    """Shingle hashes of each row, unsorted and with repeats, as an array per row."""
    n = len(hashes)
    total = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        total += hashes[j : n - SHINGLE + 1 + j] * _STEP[j] if n >= SHINGLE else np.uint64(0)
    total = mix64(total)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= SHINGLE:
            yield total[a : b - SHINGLE + 1]
        elif b > a:
            short = (hashes[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix64(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingles_of(column, words):
    """(row, shingles) of a string column, in blocks of bounded size."""
    data, offsets = text_buffer(column)
    for i, j in row_blocks(offsets, BLOCK_BYTES):
        own = offsets[i : j + 1]
        hashes, first = words(data[own[0] : own[-1]], own - own[0])
        yield from zip(range(i, j), shingle_rows(hashes, first))


# ------------------------------------------------------------------------------------------------- idf


def _block_batches(batches):
    """Rows with a block: a number of its own for rows in a run whose texts have ``DF_BLOCK`` bytes or so."""
    block, size = uuid.uuid4().int >> 65, 0
    for batch in batches:
        sizes, out = np.diff(text_buffer(batch.column("text"))[1]), np.empty(batch.num_rows, np.int64)
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > DF_BLOCK:
                block, size = uuid.uuid4().int >> 65, 0
            out[i], size = block, size + n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "block"])


def _pack(values: np.ndarray) -> bytes:
    """Bytes of the same place together: those of sorted or small numbers compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpack(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _block_shingles(buckets: int):
    """(block, bucket, codes, n): a block's distinct shingles in that part of the hash range, and its documents with each."""

    def run(batches):
        words = word_kernel()
        bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        block, held, size = None, [], 0

        def report():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.concatenate(([0], np.searchsorted(codes, bounds), [len(codes)]))
            some = np.flatnonzero(np.diff(cuts))
            parts = [(codes[a:b], n[a:b].astype(np.uint32)) for a, b in zip(cuts[some], cuts[some + 1])]
            arrays = [np.full(len(some), block), some, [_pack(c) for c, _ in parts], [_pack(k) for _, k in parts]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], ["block", "bucket", "codes", "n"])

        for batch in batches:
            own = batch.column("block").to_pylist()
            for row, shingles in shingles_of(batch.column("text"), words):
                if held and (own[row] != block or size > 4_000_000):
                    yield report()
                    held, size = [], 0
                block = own[row]
                held.append(np.unique(shingles))
                size += len(held[-1])
        if held:
            yield report()

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """(block, codes, df) of the shingles of a bucket that two documents or more hold, for each block that has them."""
    codes = [_unpack(x.as_py(), np.uint64) for x in table.column("codes")]
    ends = np.cumsum([len(c) for c in codes])
    flat = np.concatenate(codes)
    _, at = np.unique(flat, return_inverse=True)
    n = np.concatenate([_unpack(x.as_py(), np.uint32) for x in table.column("n")])
    df = np.bincount(at, n)[at].astype(np.int32)
    out = []
    for a, b in zip(ends - [len(c) for c in codes], ends):
        some = a + np.flatnonzero(df[a:b] > 1)
        out.append((_pack(flat[some]), _pack(df[some])))
    arrays = [table.column("block").combine_chunks(), pa.array([c for c, _ in out], pa.binary()), pa.array([d for _, d in out], pa.binary())]
    return pa.Table.from_arrays(arrays, ["block", "codes", "df"])


class Idf:
    """Documents, their rows in blocks (doc, text, digest, block), and the df above 1 of each block's shingles."""

    def __init__(self, n_docs: int, blocks: DataFrame, table: DataFrame):
        self.n_docs, self.blocks, self.table = n_docs, blocks, table

    def _collected(self) -> tuple[np.ndarray, np.ndarray]:
        """All shingles with a df above 1, sorted, and their df; for small tables."""
        rows = self.table.select("codes", "df").collect()
        codes = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r.codes, np.uint64) for r in rows)])
        df = np.concatenate([np.zeros(0, np.int32), *(_unpack(r.df, np.int32) for r in rows)])
        codes, first = np.unique(codes, return_index=True)
        return codes, df[first]

    @property
    def codes(self) -> np.ndarray:
        return self._collected()[0]

    @property
    def values(self) -> np.ndarray:
        return idf_of(self._collected()[1], self.n_docs)


def idf_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p(n_docs / np.maximum(df, DF_FLOOR * n_docs))


def learn_idf(docs: DataFrame) -> Idf:
    """Exact document frequencies of all shingles of the rows (doc, text)."""
    kinds = "doc long, text string, digest binary, block long"
    blocks = materialize(docs.select("doc", "text", digest16(F.col("text")).alias("digest")).mapInArrow(_block_batches, kinds), "blocks")
    n, size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = blocks.select("block", "text").mapInArrow(
        _block_shingles(-(-size // DF_BUCKET) or 1), "block long, bucket long, codes binary, n binary"
    )
    counted = parts.groupBy("bucket").applyInArrow(_count_bucket, "block long, codes binary, df binary")
    return Idf(n, blocks, materialize(counted.filter(F.octet_length("df") > 0), "frequencies"))


# ------------------------------------------------------------------------------------------ signatures


def icws(codes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_rows: int) -> np.ndarray:
    """Samples of all rows: a K-column matrix of 64-bit values; rows without elements are zero.

    ``owner`` is each element's row. r, c and beta depend on the element alone, so equal elements of equal
    weight draw alike everywhere.
    """
    bins = (mix64(codes ^ np.uint64(0xB1)) % np.uint64(K)).astype(np.int64)
    g = lambda a, b: -np.log(uniform(codes ^ np.uint64(a)) * uniform(codes ^ np.uint64(b)))
    r, c, beta = g(0x11, 0x12), g(0x21, 0x22), uniform(codes ^ np.uint64(0x31))
    t = np.floor(np.log(weights) / r + beta)
    score = np.log(c) - r * (t - beta + 1.0)
    cell = owner * K + bins
    best = np.full(n_rows * K, np.inf)
    np.minimum.at(best, cell, score)
    win = score == best[cell]
    sample = np.zeros(n_rows * K, np.uint64)
    sample[cell[win]] = mix64(codes[win] ^ mix64(t[win].astype(np.int64).view(np.uint64)))
    sample, filled = sample.reshape(n_rows, K), np.isfinite(best).reshape(n_rows, K)
    # an empty bin takes the sample of the next filled one, going round
    at = np.where(np.concatenate((filled, filled), axis=1), np.arange(2 * K), 4 * K)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :K]
    some = filled.any(axis=1)
    out = np.zeros((n_rows, K), np.uint64)
    out[some] = np.take_along_axis(sample[some], nearest[some] % K, axis=1)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for equal samples in different bands."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix64(keys ^ samples[:, j::ROWS][:, :BANDS])
    return mix64(keys ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)))


def _weighted(shingles: np.ndarray, dfs: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights. ``dfs`` are their df, or nothing where all are 1."""
    codes, tf = np.unique(shingles, return_counts=True)
    return codes, tf * idf_of(np.frombuffer(dfs, np.int32) if dfs else np.ones(1, np.int32), n_docs)


def _sign_block(n_docs: int):
    """(doc, digest, keys, dfs) of a block's rows, given the df above 1 of its shingles."""

    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        words = word_kernel()
        codes = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x.as_py(), np.uint64) for x in table.column("codes"))])
        df = np.concatenate([np.zeros(0, np.int32), *(_unpack(x.as_py(), np.int32) for x in table.column("df"))])
        order = np.argsort(codes)
        codes, df = np.append(codes[order], ~np.uint64(0)), np.append(df[order], np.int32(1))
        n = rows.num_rows
        keys = np.zeros((n, BANDS), np.uint64)
        full = np.zeros(n, bool)
        dfs = [b""] * n
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            count = np.array([len(c) for _, c, _ in held])
            own = np.concatenate([c for _, c, _ in held])
            at = np.searchsorted(codes, own)
            found = np.where(codes[at] == own, df[at], np.int32(1))
            weights = np.concatenate([t for _, _, t in held]) * idf_of(found, n_docs)
            owner = np.repeat(np.arange(len(held)), count)
            keys[[row for row, _, _ in held]] = band_keys(icws(own, weights, owner, len(held)))
            heads = np.cumsum(count) - count
            for i in np.flatnonzero(np.maximum.reduceat(found, heads) > 1).tolist():
                dfs[held[i][0]] = found[heads[i] : heads[i] + count[i]].tobytes()

        for row, shingles in shingles_of(rows.column("text"), words):
            if not len(shingles):
                continue
            full[row] = True
            held.append((row, *np.unique(shingles, return_counts=True)))
            size += len(held[-1][1])
            if size > 200_000:
                flush()
                held, size = [], 0
        if held:
            flush()
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)),
            pa.array(keys[full].view(np.int64).ravel()),
        )
        own = [rows.column(c).combine_chunks() for c in ("doc", "digest")]
        return pa.Table.from_arrays([*own, lists, pa.array(dfs, pa.binary())], ["doc", "digest", "keys", "dfs"])

    return run


def sign(idf: Idf) -> DataFrame:
    """(doc, digest, keys, dfs) of every row: band keys, none without shingles, and the df of its sorted distinct shingles."""
    by_block = idf.blocks.select("block", "doc", "digest", "text").groupBy("block").cogroup(idf.table.groupBy("block"))
    return by_block.applyInArrow(_sign_block(idf.n_docs), "doc long, digest binary, keys array<long>, dfs binary")


# ------------------------------------------------------------------------------------------ verification


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets with sorted codes."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - common
    return common / whole if whole > 0 else 1.0


def _verify_batches(n_docs: int, threshold: float):
    def run(batches):
        words = word_kernel()
        last: dict[int, tuple] = {}
        for batch in batches:
            left = batch.column("rep").to_numpy(zero_copy_only=False)
            dfs, rep_dfs = batch.column("dfs"), batch.column("rep_dfs")
            right = [_weighted(s, dfs[i].as_py(), n_docs) for i, s in shingles_of(batch.column("text"), words)]
            texts, ok = batch.column("rep_text"), np.zeros(batch.num_rows, bool)
            for i, rep in enumerate(left):
                if rep not in last:  # rows come sorted by rep
                    last = {rep: _weighted(next(shingles_of(texts.slice(i, 1), words))[1], rep_dfs[i].as_py(), n_docs)}
                ok[i] = weighted_jaccard(last[rep], right[i]) >= threshold
            yield batch.select(["rep", "doc"]).filter(pa.array(ok))

    return run


def verify(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (rep, doc) whose texts are similar enough. ``texts`` is (doc, text, dfs), one row per node."""
    with_text = pairs.join(texts, "doc")
    reps = texts.select(F.col("doc").alias("rep"), F.col("text").alias("rep_text"), F.col("dfs").alias("rep_dfs"))
    both = with_text.join(reps, "rep").select("rep", "doc", "text", "dfs", "rep_text", "rep_dfs")
    return both.mapInArrow(_verify_batches(idf.n_docs, threshold), "rep long, doc long")


# -------------------------------------------------------------------------------------------- exact pairs


def _term_batches(n_docs: int):
    def run(batches):
        words = word_kernel()
        for batch in batches:
            held, size = [], 0

            def flush():
                at, codes, w, whole = (np.concatenate(x) for x in zip(*held))
                own = [batch.column(c).take(pa.array(at)) for c in ("doc", "part", "root")]
                return pa.RecordBatch.from_arrays(
                    [*own, pa.array(codes.view(np.int64)), pa.array(w), pa.array(whole)], ["doc", "part", "root", "h", "w", "whole"]
                )

            for row, shingles in shingles_of(batch.column("text"), words):
                codes, w = _weighted(shingles, batch.column("dfs")[row].as_py(), n_docs)
                held.append((np.full(len(codes), row), codes, w, np.full(len(codes), w.sum())))
                size += len(codes)
                if size > 200_000:
                    yield flush()
                    held, size = [], 0
            if size:
                yield flush()

    return run


def exact_pairs(root_of: DataFrame, texts: DataFrame, idf: Idf, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (rep, doc) of different roots, among them all whose weighted Jaccard similarity reaches the threshold.

    ``root_of`` is (doc, root). Shingles are ordered by their documents here; a pair's first common shingle in order
    of rarity has all common ones from there on, so the weights from there on are at least t / (1 + t) of both whole
    weights on either side. Shingles of one root make no pair and come first.
    """
    terms = materialize(
        root_of.join(texts, "doc").select("doc", F.xxhash64("text").alias("part"), "root", "text", "dfs")
        .mapInArrow(_term_batches(idf.n_docs), "doc long, part long, root long, h long, w double, whole double"),
        "terms",
    )
    mixed = F.min("root") != F.max("root")
    shared = terms.groupBy("h").agg(F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).filter("mixed").select("h", "n")
    onward = Window.partitionBy("doc", "part").orderBy(F.desc("n"), "h").rowsBetween(Window.unboundedPreceding, 0)
    low = 1 - 1e-9
    prefix = materialize(
        terms.join(shared, "h").withColumn("s", F.sum("w").over(onward)).filter(F.col("s") >= F.col("whole") * (threshold * low)).drop("w", "n"),
        "prefixes",
    )
    discard(terms)
    cells = prefix.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("blocks"), mixed.alias("mixed")).filter("mixed")
    dealt = (
        prefix.join(cells, "h")
        .withColumn("own", F.pmod(F.xxhash64("doc"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "root", "s", "whole")
    )
    left = dealt.select("h", "lo", "hi", *[F.col(c).alias(f"l_{c}") for c in ("own", "doc", "root", "s", "whole")])
    pair = (
        (F.col("l_doc") < F.col("doc")) & (F.col("l_root") != F.col("root"))
        & ((F.col("l_own") == F.col("own")) == (left["lo"] == left["hi"]))
        & (F.least("l_s", "s") >= (F.col("l_whole") + F.col("whole")) * (threshold / (1 + threshold) * low))
    )
    same = (left["h"] == dealt["h"]) & (left["lo"] == dealt["lo"]) & (left["hi"] == dealt["hi"])
    return _from(prefix, left.join(dealt, same & pair).select(F.col("l_doc").alias("rep"), "doc").distinct())


# -------------------------------------------------------------------------------------------- components


def _from(table: DataFrame, result: DataFrame) -> DataFrame:
    """``result``, which is read from ``table`` and can be discarded as it can."""
    result.scratch = table.scratch
    return result


def _spread(df: DataFrame, key: str) -> DataFrame:
    """With a second key that follows from the first. A join on both deals its sides anew even where one is grouped by
    the first, so that adaptive execution may split a hot key's rows over tasks."""
    return df.withColumn("__and", F.xxhash64(key))


def star_pairs(keyed: DataFrame, largest: bool = False) -> DataFrame:
    """Distinct pairs (rep, doc): every document of a key with the key's smallest (or largest) one."""
    pick = F.max if largest else F.min
    hubs = keyed.groupBy("key").agg(pick("doc").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = _spread(keyed, "key").join(_spread(hubs.select("key", "hub"), "key"), ["key", "__and"]).filter("doc <> hub")
    return linked.select(F.least("doc", "hub").alias("rep"), F.greatest("doc", "hub").alias("doc")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc, root) for every node of ``edges`` (rep, doc); root is the component's smallest node.

    Alternating large-star and small-star rounds: each node's larger, then smaller, neighbours move to its
    smallest neighbour, until no edge changes. Minima are partial sums, and a hub's edges may be split over tasks.
    """
    edges = materialize(edges.select(F.least("rep", "doc").alias("u"), F.greatest("rep", "doc").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _spread(both.filter("v > u"), "u").join(_spread(low, "u"), ["u", "__and"]).select(F.col("m").alias("u"), "v")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = _spread(large, "v").join(_spread(low, "v"), ["v", "__and"]).select("u", "v", "m")
        moved = materialize(
            small.select(F.col("m").alias("u"), "v").union(small.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u < v").distinct(),
            "edges",
        )
        discard(edges)
        edges = moved
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return _from(edges, edges.select(F.col("v").alias("doc"), F.col("u").alias("root")))
        before = now


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text), and how rows without an id were numbered: (doc, doc_id, own), None where all have one. ``own`` is the
    text of a row without an id; numbers follow the ids, and then those texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
    if rows.filter("doc is null").isEmpty():
        return rows, None
    keys = rows.select(F.col("doc").alias("doc_id"), F.when(F.col("doc").isNull(), F.col("text")).alias("own")).distinct()
    keys = materialize(keys.orderBy(F.col("doc_id").isNull(), "doc_id", "own").withColumn("doc", F.monotonically_increasing_id()), "numbers")
    return materialize(_with_number(docs.select("doc_id", "text"), keys).select(F.col("__doc").alias("doc"), text_or_empty().alias("text")), "numbered"), keys


def _with_number(docs: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """``docs`` with ``__doc``."""
    if numbers is None:
        return docs.withColumn("__doc", F.col("doc_id").cast("long"))
    own = F.when(F.col("doc_id").isNull(), text_or_empty())
    keys = numbers.select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"), F.col("doc").alias("__doc"))
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & own.eqNullSafe(F.col("__own"))).drop("__id", "__own")


def _finer_keys(keys):
    """Keys of two bands each: every band with its neighbour and with its fifth."""
    pair = lambda g: F.transform(keys, lambda x, i: F.xxhash64(x, F.get(keys, (i + g) % BANDS), F.lit(g)))
    return F.flatten(F.array(pair(1), pair(5)))


def _unsettled(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc, root) of the documents that meet another component under a key."""
    rooted = keyed.join(found, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    return materialize(_spread(rooted, "key").join(_spread(mixed, "key"), ["key", "__and"], "left_semi").drop("__and"), "unsettled")


def near_duplicate_classes(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, bool]:
    """(doc, class_id), a row per row of ``rows`` (doc, text); ``class_id`` is the smallest of the class. Also whether
    some ``doc`` repeats."""
    idf = learn_idf(rows)
    signed = materialize(sign(idf), "signatures")
    discard(idf.table)
    nodes = materialize(signed.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("keys").alias("keys")), "nodes")
    repeats = not signed.groupBy("doc").count().filter("count > 1").isEmpty()
    texts, dfs = idf.blocks.select("doc", "digest", "text"), signed.select("doc", "digest", "dfs")
    if repeats:
        texts, dfs = (x.dropDuplicates(["doc", "digest"]) for x in (texts, dfs))
    texts = texts.join(dfs, ["doc", "digest"] if repeats else "doc").select("doc", "text", "dfs")
    keyed = nodes.filter(F.size("keys") > 0).select(F.explode("keys").alias("key"), "doc")
    first = materialize(verify(star_pairs(keyed), texts, idf, threshold), "links")
    links = first
    if repeats:  # the texts of one id are one document
        links = links.union(
            signed.join(nodes.select("digest", F.col("doc").alias("rep")), "digest").filter("rep <> doc").select("rep", "doc")
        ).distinct()
    found = components(links)
    unsettled = _unsettled(keyed, found)
    root_of = unsettled.select("doc", "root").distinct()
    finer = nodes.join(root_of, "doc", "left_semi").select(F.explode(_finer_keys(F.col("keys"))).alias("key"), "doc")
    tries = star_pairs(finer).union(star_pairs(unsettled.select("key", "doc"), largest=True)).distinct()
    tries = (
        tries.join(root_of, "doc")
        .join(root_of.select(F.col("doc").alias("rep"), F.col("root").alias("rep_root")), "rep")
        .filter("root <> rep_root")
        .select("rep", "doc")
    )
    links = materialize(links.union(verify(tries, texts, idf, threshold)), "links")
    discard(first, found)
    found = components(links)
    still = _unsettled(unsettled.select("key", "doc"), found)
    exact = exact_pairs(still.select("doc", "root").distinct(), texts, idf, threshold)
    last = materialize(verify(exact, texts, idf, threshold), "links")
    discard(unsettled, still, exact, idf.blocks)
    if not last.isEmpty():
        discard(found)
        found = components(links.union(last))
    discard(links, last)
    classes = nodes.join(found, "doc", "left").select("digest", F.coalesce("root", "doc").alias("class_id"))
    return signed.select("doc", "digest").join(classes, "digest").select("doc", "class_id"), repeats


def classed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for each document; a null ``doc_id`` stays null."""
    rows, numbers = numbered(docs)
    found, repeats = near_duplicate_classes(rows, threshold)
    if repeats:
        found = found.distinct()
    if numbers is None:
        return found.select(F.col("doc").alias("doc_id"), "class_id")
    made = F.coalesce("doc_id", F.lit(-1) - F.shiftrightunsigned(F.xxhash64("own"), 1))
    found = found.join(numbers.select("doc", "doc_id"), "doc").select("doc_id", F.col("class_id").alias("root"))
    return found.join(numbers.select(F.col("doc").alias("root"), made.alias("class_id")), "root").select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the document with the smallest id stays, once."""
    given = SetAside(docs, ("__doc", "__id", "__own", "__rank"))
    rows, numbers = numbered(given.docs)
    found, repeats = near_duplicate_classes(rows, threshold)
    gone = found.filter("doc <> class_id").select(F.col("doc").alias("__doc"))
    keyed = _with_number(given.docs, numbers)
    if repeats:
        keyed = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("__doc").orderBy(text_or_empty()))).filter("__rank = 1")
    return keyed.join(gone, "__doc", "left_anti").select(*given.as_given())


by_value(__name__)
