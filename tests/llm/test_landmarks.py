"""Landmarks that no query holds are dropped where they are made."""

import random

import numpy as np
import pyarrow as pa


def batch_of(prints):
    codes = [np.array(x, "<u4").tobytes() for x in prints.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(prints)), pa.array(codes, pa.binary())], ["id", "codes"])


def test_integers_that_queries_hold_elsewhere_make_no_landmarks(spark):
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from quarrygraph.llm import chroma

    rng = random.Random(4)
    queries = {i: [rng.getrandbits(32) for _ in range(70)] for i in range(60)}
    common = [x for codes in queries.values() for x in codes]
    others = {100 + i: rng.sample(common, 70) for i in range(300)}  # each integer is held by a query, at another place
    near = {1000 + i: codes[:40] + [rng.getrandbits(32) for _ in range(30)] for i, codes in queries.items()}

    def rows(prints, asked, wanted=None):
        made = chroma._landmark_batches(0.2, True, asked, wanted)
        return [(k, i) for out in made(chroma._placed(iter([batch_of(prints)]))) for k, i in zip(out["key"].to_pylist(), out["id"].to_pylist())]

    asked = rows(queries, True)
    bits = chroma.landmark_filter(spark.createDataFrame(asked, "key long, id long"))
    held = rows(others | near, False, SimpleNamespace(value=bits))
    every = rows(others | near, False)
    assert len({i for _, i in held}) >= 60 and {i for _, i in held} >= near.keys()
    theirs = {k for k, _ in asked}
    assert {x for x in every if x[0] in theirs} <= set(held)  # none that a query holds is lost
    assert sum(i < 1000 for _, i in held) < 0.02 * sum(i < 1000 for _, i in every)

    media = [(i, bytearray(np.array(c, "<u4").tobytes())) for i, c in (queries | others | near).items()]
    found = chroma.search(spark.createDataFrame(media, "id long, codes binary"), F.col("id") < 60, excerpts=True).collect()
    links = {r.id: [x.query_class for x in r.links] for r in found}
    assert all(links[i] == ([i - 1000] if i >= 1000 else []) for i in links)


def test_a_full_filter_lets_all_pass_and_changes_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarrygraph.llm import chroma

    rng = random.Random(5)
    base = [[rng.getrandbits(32) for _ in range(50)] for _ in range(4)]
    prints = [(i, [x if rng.random() < 0.7 else x ^ 1 for x in base[i % 4][: rng.choice([1, 4, 20, 50])]]) for i in range(80)]
    frame = spark.createDataFrame([(i, bytearray(np.array(c, "<u4").tobytes())) for i, c in prints], "id long, codes binary")
    search = lambda: sorted(map(str, chroma.search(frame, F.col("id") % 5 == 0, excerpts=True).collect()))
    want = search()
    monkeypatch.setattr(chroma, "landmark_filter", lambda keys: np.full(chroma.PAGE_BITS // 8, 255, np.uint8))
    assert search() == want and any("query_class=" in x for x in want)


def test_pairs_are_aligned_in_cells_that_hold_codes_once(spark, monkeypatch):
    from quarrygraph.llm import chroma

    rng = random.Random(6)
    base = [[rng.getrandbits(32) for _ in range(60)] for _ in range(3)]
    code = {i: np.array([x if rng.random() < 0.8 else x ^ 1 for x in base[i % 3][rng.randrange(9) :]], "<u4") for i in range(60)}
    rows = [(i, i % 4 == 0, bytearray(c.tobytes())) for i, c in code.items()]
    classes = spark.createDataFrame(rows, "id long, asks boolean, codes binary")
    pairs = [(q, d) for q in range(0, 60, 4) for d in range(60) if q != d]
    want = {(q, d): chroma.align(code[q], code[d]) for q, d in pairs}
    want = {(q, d, o, h) for (q, d), (o, h, e) in want.items() if h >= 12 and e <= chroma.MAX_BER}
    for cell in (chroma.CELL_BYTES, 1500):
        monkeypatch.setattr(chroma, "CELL_BYTES", cell)
        got = chroma._aligned(spark.createDataFrame(pairs, "query long, id long"), classes, chroma.MAX_BER, 0.2, False).collect()
        assert {(r.query, r.id, r.offset, r.hits) for r in got} == want and len(got) == len(want) > 50


def test_codes_are_written_once_and_landmarks_of_queries_sent_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarrygraph.llm import chroma

    rng = random.Random(7)
    some = lambda n: [rng.getrandbits(32) for _ in range(n)]
    rows = [(i, some(60)) for i in range(1, 41)]
    rows += [(100 + i, codes) for i, codes in rows[:20]]  # copies
    a, b = some(60), some(60)
    rows += [(3000, b), (5000, a), (5000, b), (5000, a), (None, a), (None, some(60)), (None, []), (6000, [])]
    near = lambda codes: codes[:40] + some(20)
    rows += [(50, near(a)), (150, near(b)), (200, near(rows[0][1])), (250, near(rows[0][1])), (1000, rows[30][1][:1]), (1050, rows[30][1][:1] + some(2)), (1100, near(rows[0][1]))]
    frame = spark.createDataFrame([(i, bytearray(np.array(c, "<u4").tobytes())) for i, c in rows], "id long, codes binary")
    size, made, write = 4 * sum(len(c) for _, c in rows), {}, chroma.materialize

    def noted(df, tag):
        out = made[tag] = write(df, tag)
        out.code_bytes = out.agg(F.sum(F.octet_length("codes"))).first()[0] if "codes" in out.columns else 0
        out.n_rows = out.count()
        return out

    def search():
        found = chroma.search(frame, F.coalesce(F.col("id") % 50 == 0, F.lit(False)), excerpts=True).collect()
        return sorted(((r.id, r.class_id, [(x.query_class, x.offset, x.hits) for x in r.links]) for r in found), key=str)

    monkeypatch.setattr(chroma, "materialize", noted)
    got = search()
    assert sum(x.code_bytes for x in made.values()) < 1.3 * size  # the queries' are a fifth
    asked = made["asking"].code_bytes // 4
    assert made["asked"].n_rows < 9 * asked  # six neighbours, two kinds of single integers
    links = {(i, c): {q for q, _, _ in x} for i, c, x in got if x}
    codes_of = {}
    for i, c in rows:
        codes_of.setdefault(tuple(c), []).append(i)
    own = {min(x for x in ids if x is not None): np.array(c, "<u4") for c, ids in codes_of.items() if c and any(x is not None for x in ids)}
    asks = {min(x for x in ids if x is not None) for c, ids in codes_of.items() if c and any(x is not None and x % 50 == 0 for x in ids)}
    want = {}
    for q in asks:
        for d in own.keys() - {q}:
            _, h, e = chroma.align(own[q], own[d])
            if e <= chroma.MAX_BER and h >= chroma.needed(len(own[q]), len(own[d]), chroma.MIN_HITS, True):
                want.setdefault((d, d), set()).add(q)
    assert links == want and len(want) > 6
    monkeypatch.setattr(chroma, "landmark_filter", lambda keys: np.full(chroma.PAGE_BITS // 8, 255, np.uint8))
    assert search() == got  # copies that a filter lets through get no link


def test_a_filter_is_put_together_from_half_keys(spark):
    from quarrygraph.llm import chroma

    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), 1 << 63, 100_000, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])
    (out,) = chroma._page_batches(1 << 21)(iter([batch]))
    assert sum(len(x) for x in out.column(1).to_pylist()) <= 4 * len(keys)
    bits = chroma.landmark_filter(spark.createDataFrame([(int(x),) for x in keys], "key long"))
    assert len(bits) * 8 == 1 << 21 and len(chroma._held_by(bits, keys.view(np.uint64))) == len(keys)
    others = rng.integers(0, 1 << 63, 200_000, np.int64).view(np.uint64)
    assert len(chroma._held_by(bits, others)) < 0.005 * len(others)
