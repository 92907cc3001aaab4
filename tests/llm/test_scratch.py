"""What the corpus operators leave on disk while they run."""

import re

from pyspark.sql import functions as F


def shuffle_files(spark):
    jvm = spark._jvm
    manager = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
    return {f.getName() for f in found if f.getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    import time

    from quarrygraph.llm.common import materialize

    before = shuffle_files(spark)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    out = materialize(rows.join(rows.groupBy("k").agg(F.sum("id").alias("s")).repartition(3, "k"), "k"), "cleaned")
    for _ in range(50):  # files are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == 1000 and out.select("s").distinct().count() == 7


def test_near_duplicates_delete_the_tables_they_are_done_with(spark, monkeypatch):
    import os

    from quarrygraph.llm import neardup

    made, write = {}, neardup.materialize

    def noted(df, tag):
        out = write(df, tag)
        path = re.sub("^file:(//)?", "", out.inputFiles()[0] if out.inputFiles() else out.scratch).rsplit(f"/{tag}-", 1)
        made[f"{path[0]}/{tag}-{path[1].split('/')[0]}"] = tag
        return out

    monkeypatch.setattr(neardup, "materialize", noted)
    texts = [" ".join(f"w{i % 40}x{j}" for j in range(60)) for i in range(80)]
    texts += [t.replace("x7 ", "y ") for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.classed(docs)
    left = sorted(tag for path, tag in made.items() if os.path.exists(path))
    assert left == ["edges", "nodes", "signatures"] and {"blocks", "frequencies", "links"} <= set(made.values())
    assert {(r.doc_id, r.class_id) for r in got.collect()} == {(i, i % 40) for i in range(120)}


def test_the_near_duplicate_stage_leaves_no_texts_behind(spark, monkeypatch):
    import os

    import corpus_pipeline

    from quarrygraph.llm import neardup

    made, write = {}, neardup.materialize

    def noted(df, tag):
        out = write(df, tag)
        made[out.scratch] = tag
        return out

    monkeypatch.setattr(neardup, "materialize", noted)
    texts = [" ".join(f"w{i % 30}x{j}" for j in range(60)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    left = sorted(tag for path, tag in made.items() if os.path.exists(path.removeprefix("file://")))
    assert left == ["edges", "nodes", "signatures"] and "blocks" in made.values()
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
