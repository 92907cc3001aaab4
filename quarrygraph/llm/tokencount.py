"""Token counts behind a digest cache.

A count depends on the normalised content and on the tokenizer alone, so it is stored under the
digests of both. Documents come in batches. Each batch joins its digests to the stored counts, encodes each distinct
miss once, and appends those counts; at the end every document's count is read from the cache. Since misses only are
appended, one after the other, a digest is stored once.

Defined results: a null text counts as empty; copies share one cache row; rows may repeat, and ids may be null; very long
texts are encoded whole; an empty table adds nothing and returns no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, scratch_path, text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


class TokenizerFile:
    """A tokenizer's file, read once on the driver; its digest is the version in the cache."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.blob = f.read()
        self.kind = path.rsplit(".", 1)[-1]
        self.version = hashlib.sha256(self.blob).hexdigest()

    def counter(self):
        """A function from a list of texts to their token counts, made on the executor."""
        if self.kind == "model":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=self.blob)
            return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer

        tok = Tokenizer.from_buffer(self.blob)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def count_batches(tokenizer: TokenizerFile, texts_at_once: int = 64):
    def run(batches):
        count = tokenizer.counter()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for i in range(0, len(texts), texts_at_once):
                counts += count(texts[i : i + texts_at_once])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return run


class TokenCache:
    """Counts in a folder of Parquet files, one subfolder per appended batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, version: str) -> DataFrame | None:
        """Counts for one tokenizer version, one row per digest even if two runs stored the same miss; None
        before the first append."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        rows = self.spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.parquet(
            f"{self.path}/batch-{uuid.uuid4().hex}"
        )


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, n_batches: int = 3
) -> DataFrame:
    """Token counts of every text.

    Copies meet before the shuffle: the grouping by digest keeps one text per digest and task, so a
    text that a third of all rows share is sent once by each task and encoded once.
    """
    spark = docs.sparkSession
    tokenizer = TokenizerFile(tokenizer_path)
    cache = TokenCache(spark, cache_path or scratch_path(spark, "token-cache"))
    text = text_or_empty()
    for b in range(n_batches):
        batch = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)) == b)
        misses = batch.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest").agg(F.first("text").alias("text"))
        known = cache.read(tokenizer.version)
        if known is not None:
            misses = misses.join(known, "digest", "left_anti")
        cache.append(misses.mapInArrow(count_batches(tokenizer), "digest binary, n_tokens long"), tokenizer.version)
    rows = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    # a join on two keys deals the grouped counts anew, so that the rows of a common text may be split over tasks
    known = cache.read(tokenizer.version).withColumn("and", F.xxhash64("digest"))
    return rows.withColumn("and", F.xxhash64("digest")).join(known, ["digest", "and"], "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


by_value(__name__)
