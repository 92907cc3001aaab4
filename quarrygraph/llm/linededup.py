"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table (key, n_docs, max_doc), sorted by key within its buckets; no two runs hold the same key. Each
batch of documents is summed to such a table and merge-anti-joined with every run, bucket by bucket and without an
exchange: the keys that are in none, the fresh ones, become a run of level 0; what the batch adds to known keys is merged
into one table of additions. When a level holds ``fanout`` runs they are merged into one run of the next level, so a key is looked
up in a number of runs that grows with the logarithm of the number of batches. Totals are the runs with the
additions joined to them: since no key is in two runs, runs are never grouped again.

The rule: a line's key is the line without white space (space, 0x09 to 0x0D) at both ends and with
A-Z lower-cased. Keys of ``min_chars`` code points or more, found in ``min_docs`` documents or more,
keep their lines only in the largest ``doc_id`` that holds them.

Defined results: a null or empty text is one empty line and stays as it is; a null ``doc_id`` is never
the largest and counts in no document total; rows that repeat a ``doc_id`` are judged as one document; very long texts
and lines are judged whole; empty tables give empty results; extra columns pass through, those named like a result as
``<name>_input`` (``drop_repeated_lines`` gives all columns back under their own names).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SetAside, digest16, materialize, scratch_path, text_or_empty

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Trimmed line with A-Z lowered; ``lower`` does it where the line is ASCII, at a fraction of the cost."""
    trimmed = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, _UPPER, _LOWER))


def keyed_lines(docs: DataFrame, min_chars: int, n_batches: int = 1) -> DataFrame:
    """(batch, doc_id, text_id, pos, key): a row for each line long enough to be judged. ``text_id`` tells
    apart rows that repeat a ``doc_id`` with another text."""
    text = text_or_empty()
    return (
        docs.select(
            F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch"),
            "doc_id",
            F.xxhash64(text).alias("text_id"),
            F.posexplode(lines_of(text)).alias("pos", "line"),
        )
        .filter(F.char_length(F.btrim("line", F.lit(_BLANKS))) >= min_chars)
        .select("batch", "doc_id", "text_id", "pos", digest16(line_key(F.col("line"))).alias("key"))
    )


class Runs:
    """Levelled runs, as bucketed tables in a folder that all executors share. ``close`` forgets the tables."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.additions: str | None = None
        self.tables: list[str] = []

    def _write(self, rows: DataFrame, tag: str) -> str:
        name = f"{tag}_{uuid.uuid4().hex}"
        out = rows.select("key", "n_docs", "max_doc").write.format("parquet").option("path", f"{self.path}/{name}")
        out.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.tables.append(name)
        return name

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Add one batch of (doc_id, key); a document's lines must all be in one batch."""
        sums = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if not self.runs:
            self.levels[0].append(self._write(sums, "run"))
            return
        batch = self.spark.table(self._write(sums, "batch"))
        fresh = batch
        for name in self.runs:
            fresh = fresh.join(self.spark.table(name).select("key"), "key", "left_anti")
        run = self._write(fresh, "run")
        known = batch.join(self.spark.table(run).select("key"), "key", "left_anti")
        if self.additions:
            known = _merged(self.spark.table(self.additions), known)
        self.additions = self._write(known, "added")
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(reduce(_merged, map(self.spark.table, merged)), "run"))
            level += 1

    def totals(self) -> DataFrame:
        """(key, n_docs, max_doc), one row for each key."""
        if not self.runs:
            return self.spark.createDataFrame([], "key binary, n_docs long, max_doc long")
        runs = list(map(self.spark.table, self.runs))
        if self.additions:
            more = self.spark.table(self.additions).select("key", F.col("n_docs").alias("more"), F.col("max_doc").alias("later"))
            total = F.col("n_docs") + F.coalesce("more", F.lit(0))
            runs = [
                run.join(more, "key", "left").select("key", total.alias("n_docs"), F.greatest("max_doc", "later").alias("max_doc"))
                for run in runs
            ]
        return reduce(DataFrame.union, runs)

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted tables as one, by a merge join that keeps both sides. (A union of bucketed tables keeps their partitioning
    in the plan but not in the rows, so nothing may be grouped after one.)"""
    b = b.select("key", F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
    none = F.lit(0).cast("long")
    total = F.coalesce("n_docs", none) + F.coalesce("n", none)
    return a.join(b, "key", "full_outer").select("key", total.alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a plain column would be inlined in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_INNER = ("__doc", "__text", "__drop", "__lines")
RESULTS = ("n_lines", "n_dropped")


def _dropped(docs: DataFrame, min_chars: int, min_docs: int, n_batches: int, fanout: int) -> DataFrame:
    """(__doc, __text, __drop): the positions that each text loses."""
    spark = docs.sparkSession
    lines = materialize(keyed_lines(docs, min_chars, n_batches), "lines")
    runs = Runs(spark, scratch_path(spark, "line-runs"), fanout)
    try:
        for b in range(n_batches):
            runs.add(lines.filter(F.col("batch") == b).select("doc_id", "key"))
        hot = materialize(runs.totals().filter(F.col("n_docs") >= min_docs).select("key", "max_doc"), "hot-lines")
    finally:
        runs.close()
    return (
        lines.join(hot, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        .groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"))
        .agg(F.collect_set("pos").alias("__drop"))
    )


def _cut(given: SetAside, min_chars: int, min_docs: int, n_batches: int, fanout: int) -> tuple[DataFrame, Column]:
    docs, text = given.docs, text_or_empty()
    dropped = _dropped(docs, min_chars, min_docs, n_batches, fanout)
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(text_or_empty()) == F.col("__text"))
    kept = _let(
        lines_of(text),
        lambda ls: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drop")), lambda i: F.get(ls, i)
            ),
            "\n",
        ),
    )
    return docs.join(dropped, same, "left"), F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fanout: int = 2
) -> DataFrame:
    """All columns of ``docs`` with the text deduplicated, plus ``n_lines`` (before) and ``n_dropped``."""
    given = SetAside(docs, _INNER, RESULTS)
    out, kept = _cut(given, min_chars, min_docs, n_batches, fanout)
    return out.select(
        *given.beside(text=kept),
        F.size(lines_of(text_or_empty())).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with the text deduplicated and its own columns only."""
    given = SetAside(docs, _INNER, RESULTS)
    out, kept = _cut(given, min_chars, min_docs, n_batches, fanout)
    return out.select(*given.as_given(text=kept))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.max_doc AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
