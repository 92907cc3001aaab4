"""A corpus pipeline of five stages over ``documents``: each is a function (spark, docs, sf_dir) whose result is
written as Parquet and read back as the next one's ``docs``.

Quality rules drop the documents they reject; line dedup takes common lines out of all but one document;
near-duplicates leave one document of each class; mixing draws documents towards the target weights of sources,
languages and topics; the last stage encodes what is left as sampled segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import documents, materialize
from quarrygraph.llm.lattice import sample_segmentations
from quarrygraph.llm.linededup import drop_repeated_lines
from quarrygraph.llm.mixing import Mix, sample_documents
from quarrygraph.llm.neardup import keep_one
from quarrygraph.llm.quality import keep_documents

#: The mix keeps this share of the tokens that reach it.
MIX = Mix(keep=0.8, seed="pipeline")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, each row as it came. Null, blank and short texts are rejected; copies are judged
    alike; very long texts are judged whole; an empty table stays empty; columns of any name come back."""
    return keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that five documents hold, but for the largest ``doc_id``; ``n_chars`` follows the text.
    A null text stays null; a null ``doc_id`` never keeps a common line; repeated rows are one document; an empty table
    stays empty; columns of any name come back."""
    out = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest ``doc_id``, a null one after all others. All blank
    texts of one spelling are a class; rows that repeat an id are one document; an empty table stays empty; columns of any
    name come back."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by the rate of their cell. Null categories are one of their own; rows that repeat a ``doc_id``, or have
    none, share one fate; texts without words follow their cell; an empty table stays empty; columns of any name come back."""
    return sample_documents(docs, MIX)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, samples, round_trip) for every row. Null and empty texts have one empty segmentation; repeated rows get
    equal samples; very long texts are encoded whole; an empty table stays empty; extra columns are ignored."""
    import public_tokenizers

    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mixing),
    ("segmentation", segmentation),
]

#: SQL can express neither the near-duplicate classes nor the segmentations; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
