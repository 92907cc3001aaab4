"""Helpers that the corpus operators share: scratch tables, Arrow text blocks, numpy hashing."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def by_value(module_name: str) -> None:
    """Ship a module's functions with the tasks, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a temporary one in local mode and an
    error on a cluster, whose machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrygraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors. The shuffle files
    of the write go with its end, as nothing reads them again; the driver's garbage collector would leave them for long."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing that is still to be read may come from them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class SetAside:
    """``docs`` with the columns renamed whose names an operator uses itself (letter case aside).

    ``as_given`` gives the columns back under their own names. ``beside`` does so too, but for those that share a name with
    a result: they keep their new name, ``<name>_input``, with more underscores where that is taken.
    """

    def __init__(self, docs: DataFrame, inner: tuple[str, ...], results: tuple[str, ...] = ()):
        mine = {c.lower() for c in (*inner, *results)}
        used = mine | {c.lower() for c in docs.columns}
        self.results = {c.lower() for c in results}
        self.names: list[tuple[str, str]] = []
        for given in docs.columns:
            now = given
            while now.lower() in mine or (now != given and now.lower() in used):
                now += "_input" if now == given else "_"
            used.add(now.lower())
            self.names.append((given, now))
        self.docs = docs.select([column(given).alias(now) for given, now in self.names])

    def as_given(self, **changed: Column) -> list[Column]:
        return [changed.get(given, column(now)).alias(given) for given, now in self.names]

    def beside(self, **changed: Column) -> list[Column]:
        return [changed.get(given, column(now)).alias(now if given.lower() in self.results else given) for given, now in self.names]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def digest16(col: Column) -> Column:
    """128-bit digest of a string column as 16 bytes."""
    return F.unhex(F.md5(col))


# ---------------------------------------------------------------------------------------------- Arrow


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column and the n + 1 offsets of its values; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    _, offsets, data = arr.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offsets: np.ndarray, max_bytes: int):
    """Row ranges whose texts hold at most ``max_bytes`` together, or one row each where a text is longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# --------------------------------------------------------------------------------------------- hashing

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64; the argument is not changed."""
    z = x + _GOLD
    z ^= z >> np.uint64(30)
    z *= _M1
    z ^= z >> np.uint64(27)
    z *= _M2
    z ^= z >> np.uint64(31)
    return z


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash uint64 keys to doubles strictly inside (0, 1)."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / 9007199254740992.0)


def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed))


class RangeHash:
    """64-bit polynomial hashes of any byte range of a block in constant time per range."""

    def __init__(self, seed: int):
        self.table = byte_table(seed)
        base = int(mix64(np.array([seed], np.uint64))[0]) | 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            for name, step in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n + 1, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


by_value(__name__)
