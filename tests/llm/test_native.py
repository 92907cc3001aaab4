"""Quality cascade, mixing, line dedup, sharding and token counts against brute force, with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, __tokens long"
LINE = "a line that is long enough to be judged by the rule x"


def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "über", "zeta"]
    out = []
    for i in range(40):
        n = rng.choice([3, 30, 120])
        text = "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(n // 3)) for _ in range(3))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1"]), len(text), "k", 1))
    for i in range(40, 47):
        out.append((i, f"  {LINE.upper()}\nown {i}\n{LINE}\t", "en", "s0", 1, None, None))
    out += [
        (50, None, None, None, None, None, None),
        (51, "", "en", "s0", 0, "k", 1),
        (52, " \t\n\x0b ", "en", "s1", 5, "k", 1),
        (53, "word " * 3000, "en", "s0", 1, "k", 1),
        (54, " ".join(f"w{i % 11}" for i in range(4000)), "en", "s0", 1, "k", 1),
        (55, "### $$$ %%% " * 30, "en", "s0", 1, "k", 1),
        (55, "### $$$ %%% " * 30, "en", "s0", 1, "k", 1),
        (None, "a row without an id " + " ".join(f"u{i}" for i in range(40)), "en", "s0", 1, "k", 1),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = ws(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if ws(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_equal_brute_force(docs, none):
    from quarrygraph.llm.quality import score_documents

    got = score_documents(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        text = r["text"]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.rejected_by is None)
        assert not (r.base_failed and r.kept)
    assert next(r for r in got if r.doc_id == 55).kept is False
    assert score_documents(none).count() == 0


def test_quality_verdict_does_not_depend_on_rule_order(docs, monkeypatch):
    from quarrygraph.llm import quality

    kept = lambda: {(r.doc_id, r["text"], r.kept) for r in quality.score_documents(docs).collect()}
    first = kept()
    monkeypatch.setattr(quality, "order_rules", lambda d, rules, n: list(reversed(rules)))
    assert kept() == first


def test_rules_are_ordered_by_rejection_per_cost(docs):
    from pyspark.sql import functions as F

    from quarrygraph.llm.quality import Rule, order_rules

    rules = (Rule("never", lambda: F.lit(False)), Rule("always", lambda: F.lit(True)))
    assert [r.name for r in order_rules(docs, rules)] == ["always", "never"]


def lines_expected(table):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for r in table:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(r[0])
    out = []
    for r in table:
        ls = (r[1] or "").split("\n")
        hot = lambda x: len(key(x)) >= 40 and len(holders[key(x)] - {None}) >= 5
        kept = [x for x in ls if not (hot(x) and r[0] != max(holders[key(x)] - {None}))]
        out.append((r[0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup_equals_brute_force(docs, none, batches, fanout):
    from quarrygraph.llm.linededup import dedup_lines

    got = [(r.doc_id, r.n_lines, r.n_dropped, r["text"] or "") for r in dedup_lines(docs, n_batches=batches, fanout=fanout).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(got, key=key) == sorted(lines_expected(rows()), key=key)
    assert sum(g[2] for g in got) == 12
    assert dedup_lines(none).count() == 0


def test_runs_are_levelled_and_disjoint(docs, spark):
    """Totals need the anti-join: a key that were in two runs would have two totals."""
    from pyspark.sql import functions as F

    from quarrygraph.llm.common import scratch_path
    from quarrygraph.llm.linededup import Runs, keyed_lines

    lines = keyed_lines(docs, 10, 5)
    runs, shape = Runs(spark, scratch_path(spark, "t"), 2), []
    for b in range(5):
        runs.add(lines.filter(f"batch = {b}").select("doc_id", "key"))
        shape.append([len(x) for x in runs.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    want = {bytes(r.key): (r.n, r.m) for r in lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("m")).collect()}
    got = [(bytes(r.key), (r.n_docs, r.max_doc)) for r in runs.totals().collect()]
    assert len(got) == len(want) and dict(got) == want
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("run_", "batch_", "added_"))]


def test_runs_are_joined_without_an_exchange(docs, spark):
    from quarrygraph.llm.common import scratch_path
    from quarrygraph.llm.linededup import Runs, keyed_lines

    lines = keyed_lines(docs, 10, 2)
    runs = Runs(spark, scratch_path(spark, "t"), 3)
    for b in range(2):
        runs.add(lines.filter(f"batch = {b}").select("doc_id", "key"))
    a, b = map(spark.table, runs.runs)
    plan = a.hint("merge").join(b.select("key"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_mixing_meets_targets_and_budget(spark, none):
    from pyspark.sql import functions as F

    from quarrygraph.llm.mixing import Mix, mix_documents, sample_documents

    rng = random.Random(1)
    table = [(i, " ".join(["w"] * rng.randint(1, 80)), rng.choice(["en", "en", "fr"]), rng.choice(["a", "a", "a", "b"]), 1, "k", 1) for i in range(3000)]
    docs = spark.createDataFrame(table, SCHEMA)
    mix = Mix(keep=0.3)
    out = mix_documents(docs, mix, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}}).cache()
    total = out.agg(F.sum("__tokens")).first()[0]
    for dim, want in (("__source", {"a": 0.5, "b": 0.5}), ("__lang", {"en": 0.6, "fr": 0.4})):
        got = {r[0]: r[1] / total for r in out.groupBy(dim).agg(F.sum(F.col("ratio") * F.col("__tokens"))).collect()}
        assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    assert abs(out.agg(F.sum(F.col("prob") * F.col("__tokens"))).first()[0] / total - 0.3) < 1e-6
    drawn = out.filter("sampled").agg(F.sum("__tokens")).first()[0] / total
    assert abs(drawn - 0.3) < 0.05
    assert sample_documents(docs, mix).columns == docs.columns
    assert mix_documents(none).count() == 0


def test_mixing_takes_awkward_rows(docs):
    from quarrygraph.llm.mixing import Mix, mix_documents

    got = mix_documents(docs, Mix(keep=0.5)).collect()
    assert len(got) == len(rows())
    assert {r["__source"] for r in got if r.source is None} == {"(null)"}
    assert len({r.sampled for r in got if r.doc_id == 55}) == 1
    assert all(0 <= r.prob <= 1 for r in got)


def test_shards_are_near_equal_and_places_gapless(docs, none):
    from quarrygraph.llm.sharding import shard_documents

    got = shard_documents(docs, 5, 64).collect()
    assert len(got) == len(rows())
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    owner = {}
    assert all(owner.setdefault(r.vslot, r.shard) == r.shard for r in got)
    assert shard_documents(none, 5, 64).count() == 0


def test_slot_map_is_edited_little(spark):
    from quarrygraph.llm.common import scratch_path
    from quarrygraph.llm.sharding import SlotMap, pack, rebalance

    rng = random.Random(2)
    loads = {v: rng.randint(1, 1000) for v in range(512)}
    owner = pack(loads, 8, 512)
    per = [sum(loads[v] for v in range(512) if owner[v] == s) for s in range(8)]
    assert max(per) - min(per) <= 1000 and max(per) < 1.02 * min(per)
    grown = rebalance(owner, loads, 9)
    moved = [v for v in range(512) if owner[v] != grown[v]]
    assert all(grown[v] == 8 for v in moved) and len(moved) < 512 / 4
    per = [sum(loads[v] for v in range(512) if grown[v] == s) for s in range(9)]
    assert max(per) < 1.06 * min(per)
    shrunk = rebalance(grown, loads, 8)
    assert all(shrunk[v] == grown[v] for v in range(512) if grown[v] < 8 and v not in moved) or max(shrunk) == 7
    m = SlotMap(spark, scratch_path(spark, "map"), 512)
    m.write(0, owner, loads)
    m.edit(0, loads, 9)
    assert m.owner(0) == owner and m.owner(1) == grown


def test_token_counts_use_the_cache(docs, none, spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    from quarrygraph.llm import tokencount
    from quarrygraph.llm.common import scratch_path

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows())
    half = docs.filter("doc_id < 20")
    tokencount.count_tokens(half, path, cache).count()
    stored = tokencount.TokenCache(spark, cache).read(tokencount.TokenizerFile(path).version).count()
    assert stored == len({r[1] for r in rows() if r[0] is not None and r[0] < 20})
    for _ in range(2):
        got = tokencount.count_tokens(docs, path, cache).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    total = spark.read.schema(tokencount.CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(cache).count()
    assert total == len({r[1] or "" for r in rows()})  # nothing was encoded twice
    other = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(other)
    got = tokencount.count_tokens(half, other, cache).collect()
    assert all(r.n_tokens == len(tok.encode(next(x[1] for x in rows() if x[0] == r.doc_id), add_special_tokens=False).ids) for r in got)
    assert tokencount.count_tokens(none, path).count() == 0


def test_kept_digest_of_query(spark, tmp_path):
    from quarrygraph.llm.queries import op6_line_dedup

    spark.createDataFrame(rows(), SCHEMA).drop("key", "__tokens").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.kept_sha256) for r in op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, _, _, t in lines_expected(rows())}
