"""Every stage of the pipeline works on what its predecessor kept."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_stages_filter_and_keep_columns(spark):
    import corpus_pipeline as p
    from test_free import classes_by_brute_force

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        if k == len(p.STAGES) - 1:
            assert docs.filter("not round_trip").count() == 0 and docs.count() == before.count()
            break
        docs = docs.cache()
        assert docs.columns == columns and docs.count() <= n
        if name == "near-duplicates":
            rows = [(r.doc_id, r["text"]) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == set(classes_by_brute_force(rows).values())
        n = docs.count()
    assert 0 < n < 200


def test_registered_names():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names
    assert {int(x[2:].split("_")[0]) for x in names if x.startswith("op")} == set(range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
