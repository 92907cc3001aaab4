"""Every operator and every pipeline stage over clashing names, nulls, long texts, ties, repeated rows, odd ids, no rows."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

TOP, LOW = 2**63 - 1, -(2**63)
#: Names that the operators use themselves, as columns of the user's.
CLASHES = (
    "__text __words __lines __n_lines __again __doc __drop __own __id __rank __source __lang __topic __tokens __ratio __prob __and __class "
    "n_words n_dup_lines base_failed rejected_by ratio prob sampled n_lines n_dropped n_dropped_input key digest batch pos line text_id "
    "doc root class_id size shard slot vslot law bytes rows rank ahead and n_tokens n_bytes lang_pred score held_out ids samples round_trip "
    "spans start end bucket id media codes links KEPT"
).split()


def table():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    shared, body, huge = words(12), words(150), words(180_000)
    rows = [(i, f"{words(60)}\n{shared}\n{words(20)}", "en", "s") for i in range(8)]
    rows += [(20, body, "en", "s"), (21, body, "en", "s"), (22, body + " tail", "fr", "t"), (22, body + " tail", "fr", "t")]
    rows += [(30, None, None, None), (31, "", "en", "s"), (32, " \n\t ", "en", None), (40, huge, "en", "s"), (41, huge + " end", "en", "s")]
    rows += [(LOW, words(80), "en", "s"), (-5, words(70), "fr", "s"), (-4, body, "en", "s"), (TOP, words(90), "en", "t"), (TOP, words(90), "en", "t")]
    return rows + [(None, words(50), "en", "s"), (None, words(50), "en", "s"), (None, body, "en", "s"), (None, None, None, None)]


BASE = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(table(), BASE).repartition(3)
    return rows.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs, spark):
    return spark.createDataFrame([], docs.schema)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def prints(docs):
    from quarrygraph.llm.chroma import BYTES, fingerprints, search

    media = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("media"))
    return search(fingerprints(media, BYTES), F.coalesce(F.col("id") % 50 == 0, F.lit(False)), excerpts=True)


def languages(docs):
    from quarrygraph.llm.langid import learn_profiles, predict_languages

    rows = docs.withColumn("held_out", F.lit(False))
    return predict_languages(rows, learn_profiles(rows))


def scored(docs):
    from quarrygraph.llm.quality import score_documents

    return score_documents(docs)


def mixed(docs):
    from quarrygraph.llm.mixing import mix_documents

    return mix_documents(docs)


def counted(docs):
    from quarrygraph.llm.tokencount import count_tokens

    return count_tokens(docs, tokenizer())


def cut(docs):
    from quarrygraph.llm.linededup import dedup_lines

    return dedup_lines(docs)


def segmented(docs):
    from quarrygraph.llm.lattice import sample_segmentations

    return sample_segmentations(docs, tokenizer(), brief=True)


def sharded(docs):
    from quarrygraph.llm.sharding import shard_documents

    return shard_documents(docs, 5, 64)


def stripped(docs):
    from quarrygraph.llm.suffixdedup import dedup_substrings

    return dedup_substrings(docs, keep_bytes=False)


ONE_ROW_EACH = [prints, languages, scored, mixed, counted, cut, segmented, sharded, stripped]


@pytest.mark.parametrize("operator", ONE_ROW_EACH, ids=lambda f: f.__name__)
def test_a_row_for_every_row(operator, docs, none):
    out = operator(docs)
    name = "id" if operator is prints else "doc_id"
    assert collections.Counter(r[0] for r in out.select(name).collect()) == collections.Counter(r[0] for r in table())
    assert operator(none).count() == 0


@pytest.mark.parametrize("operator", [scored, mixed, cut], ids=lambda f: f.__name__)
def test_clashing_columns_come_back(operator, docs):
    """Under their own names, or as ``<name>_input`` where a result has the name."""
    out = operator(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    for c in CLASHES:
        now = c
        if out.schema[c].dataType.simpleString() != "string" or c == "rejected_by" or c.startswith("__") and f"{c}_input" in out.columns:
            now = f"{c}_input_" if f"{c}_input" in CLASHES else f"{c}_input"
        assert out.filter(~F.col(now).eqNullSafe(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))).isEmpty(), c


def test_near_duplicate_classes_of_awkward_rows(docs, none):
    from quarrygraph.llm.neardup import classed, keep_one

    got = collections.Counter((r.doc_id, r.class_id) for r in classed(docs).collect())
    by = dict(k for k in got if k[0] is not None)
    assert by[20] == by[21] == by[22] == by[-4] == -4 and by[40] == by[41] == 40 and by[30] == by[31] == 30
    assert all(by[i] == i for i in (LOW, -5, TOP, 32, *range(8)))
    assert max(got.values()) == 1 and sum(k[0] is None for k in got) == 4
    nulls = sorted(k[1] for k in got if k[0] is None)
    assert nulls[0] < 0 and set(nulls) >= {-4, 30}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert collections.Counter(ids) == collections.Counter([*range(8), -4, 30, 32, 40, LOW, -5, TOP, None, None])
    assert kept.filter(F.col("`__doc`") == F.concat(F.lit("__doc:"), F.col("doc_id").cast("string"))).count() == len(ids) - 2
    assert classed(none).count() == 0 and keep_one(none).count() == 0


def test_stages_take_awkward_rows(spark, docs, none):
    import corpus_pipeline as p

    columns, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, "")
        empty = stage(spark, none, "")
        assert empty.count() == 0, name
        if k == len(p.STAGES) - 1:
            assert out.count() == rows and out.filter("not round_trip").isEmpty()
            break
        assert out.columns == empty.columns == columns, name
        assert out.filter(~F.col("`__text`").eqNullSafe(F.concat(F.lit("__text:"), F.col("doc_id").cast("string")))).isEmpty(), name
        n = out.count()
        assert (n == rows) if name == "line dedup" else 0 < n < rows, name


def test_near_duplicates_do_not_depend_on_partitions(spark):
    """A passage that is frequent in the whole table and seen once in most partitions weighs the same everywhere."""
    from quarrygraph.llm.neardup import classed, learn_idf, numbered

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(30)], []
    for i in range(240):
        own = [word() for _ in range(rng.randint(20, 80))]
        rows.append((2 * i, own + (passage if i % 20 == 0 else [])))
        if i % 10 == 0:
            rows.append((2 * i + 1, own + (passage if i % 20 == 0 else []) + [word() for _ in range(rng.randint(1, 9))]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    results, idfs = [], []
    for n in (1, 7, 211):
        part = docs.repartition(n, "doc_id")
        idf = learn_idf(numbered(part)[0])
        idfs.append((idf.codes.tolist(), idf.values.tolist()))
        if n < 211 or os.environ.get("SLOW_TESTS"):
            results.append({r.doc_id: r.class_id for r in classed(part).collect()})
    assert all(x == results[0] for x in results) and idfs[0] == idfs[1] == idfs[2]
    assert len(idfs[0][0]) >= 26


def test_shared_folder_is_required_on_a_cluster():
    from quarrygraph.llm.common import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
