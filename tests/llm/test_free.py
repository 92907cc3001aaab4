"""Fingerprints, languages, segmentations, near-duplicates and substring dedup against brute force."""

import collections
import hashlib
import io
import math
import random
import wave
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "d") for i, t in rows], DOCS).repartition(3)


# ----------------------------------------------------------------------------------------------- audio


def melody(seed, seconds=12, rate=11025):
    rng = np.random.default_rng(seed)
    notes = [np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * np.arange(rate // 4) / rate) for _ in range(seconds * 4)]
    return (np.concatenate(notes) * 9000).astype("<i2")


def wav(x, rate=11025):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, len(x), "NONE", ""))
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_recordings_align_at_their_offset(spark):
    from pyspark.sql import functions as F

    from quarrygraph.llm.chroma import Audio, fingerprints, search

    audio, a, b = Audio(), melody(1), melody(2)
    hop = audio.hop
    noise = np.random.default_rng(0).normal(0, 1500, len(a)).astype("<i2")
    media = [(0, wav(a)), (1, wav(a)), (2, wav(a[20 * hop :])), (3, wav(a + noise)), (4, wav(b)), (5, None), (6, b""), (7, b"short"), (100, wav(a[:10]))]
    rows = spark.createDataFrame(media, "id long, media binary")
    got = {r.id: r for r in search(fingerprints(rows, audio), F.col("id") % 50 == 0).collect()}
    assert got[0].class_id == got[1].class_id == 0 and got[4].class_id == 4
    links = {r.id: {x.query_class: x for x in r.links} for r in got.values()}
    assert links[2][0].offset == 20 and links[2][0].ber < 0.01
    assert links[3][0].offset == 0 and links[3][0].ber < 0.2
    assert not links[4] and not links[1]
    assert all(got[i].n_codes == 0 and got[i].class_id == i and not got[i].links for i in (5, 6, 7, 100))
    empty = spark.createDataFrame([], "id long, media binary")
    assert search(fingerprints(empty), F.col("id") % 50 == 0).count() == 0


def test_search_misses_no_link(spark):
    """All pairs of queries and recordings by brute force."""
    from pyspark.sql import functions as F

    from quarrygraph.llm import chroma

    rng, media = random.Random(3), []
    tunes = [melody(s, 6) for s in range(6)]
    for i in range(60):
        x = tunes[rng.randrange(6)].copy()
        if rng.random() < 0.7:
            at = rng.randrange(len(x) // 2)
            x[at : at + rng.randrange(200, len(x) // 3)] = 0
        media.append((i, wav(x[rng.randrange(3) * 1365 :])))
    got = chroma.search(chroma.fingerprints(spark.createDataFrame(media, "id long, media binary")), F.col("id") % 5 == 0).collect()
    prints = {}
    for i, blob in media:
        x, rate = chroma.samples_of(blob, chroma.Audio())
        prints[i] = chroma.packed_codes(chroma.chroma_frames(x, chroma.Audio(), chroma.fold_matrix(chroma.Audio(), rate), np.hamming(4096).astype(np.float32)))
    class_of = {r.id: r.class_id for r in got}
    want = set()
    for q in {class_of[i] for i in class_of if i % 5 == 0}:
        for d in set(class_of.values()) - {q}:
            _, hits, ber = chroma.align(prints[q], prints[d])
            if hits >= chroma.MIN_HITS * max(len(prints[q]), len(prints[d])) and ber <= chroma.MAX_BER:
                want.add((q, d))
    assert {(x.query_class, r.id) for r in got for x in r.links} == want and want


@pytest.mark.parametrize("excerpts", [False, True])
def test_landmarks_miss_no_link(spark, excerpts):
    """Short and long prints of few integers, cut, changed and shifted, against all pairs by brute force."""
    from pyspark.sql import functions as F

    from quarrygraph.llm import chroma

    rng, rows = random.Random(12), []
    base = [[rng.getrandbits(32) for _ in range(70)] for _ in range(5)]
    for i in range(260):
        b = rng.choice(base)
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 21, 26, 31, 40, 60])
        at = rng.randrange(len(b) - n + 1)
        kept = rng.choice([0.1, 0.25, 0.4, 0.8, 1.0])
        rows.append((i, [x if rng.random() < kept else x ^ (1 << rng.randrange(32)) for x in b[at : at + n]]))
    prints = [(i, bytearray(np.array(c, "<u4").tobytes())) for i, c in rows]
    frame = spark.createDataFrame(prints, "id long, codes binary")
    got = chroma.search(frame, F.col("id") % 3 == 0, excerpts=excerpts).collect()
    code, class_of = {i: np.array(c, "<u4") for i, c in rows}, {r.id: r.class_id for r in got}
    want = set()
    for q in {class_of[i] for i in code if i % 3 == 0}:
        for d in set(class_of.values()) - {q}:
            _, hits, ber = chroma.align(code[q], code[d])
            low, high = sorted((len(code[q]), len(code[d])))
            need = math.ceil(high * chroma.MIN_HITS)
            if excerpts:
                need = max(math.ceil(low * chroma.MIN_HITS), min(chroma.EVIDENCE, low, need))
            if hits >= need and ber <= chroma.MAX_BER:
                want.add((q, d))
    assert {(x.query_class, r.id) for r in got for x in r.links} == want
    assert len(want) > 150


def test_integers_shared_by_chance_make_no_candidates():
    """Two recordings are brought together by integers at the same distance, not by one that both hold."""
    import pyarrow as pa

    from quarrygraph.llm.chroma import _landmark_batches, farthest

    rng = random.Random(2)
    a = [rng.getrandbits(31) for _ in range(80)]
    b = [rng.getrandbits(31) for _ in range(80)]
    for i in range(0, 80, 8):
        b[(i + 3) % 80] = a[i * 3 % 80]  # the same integers at other distances
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("mark", pa.int32())]))

    def keys(codes, asked):
        marks = pa.array([[{"pos": p, "mark": m} for p, m in enumerate(codes)]], kind)
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(codes)]), marks], ["id", "n", "marks"])
        (out,) = _landmark_batches(0.2, True, asked)(iter([batch]))
        return set(out["key"].to_pylist())

    assert len(set(a) & set(b)) == 10 and not keys(a, True) & keys(b, False)
    assert len(keys(a, True) & keys(a, False)) >= 79
    assert [farthest(n, 0.2, True) for n in (1, 5, 8, 10, 25, 80)] == [0, 4, 7, 9, 6, 6]


def test_excerpts_find_their_recording(spark):
    from pyspark.sql import functions as F

    from quarrygraph.llm.chroma import BYTES, fingerprints, search

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ,.") for _ in range(6000)).encode() for _ in range(3)]
    media = [(50, texts[0]), (1, texts[0][1600:3200]), (2, texts[1]), (100, texts[1][:1500]), (3, texts[2])]
    got = search(fingerprints(spark.createDataFrame(media, "id long, media binary"), BYTES), F.col("id") % 50 == 0, excerpts=True)
    links = {r.id: {x.query_class: x for x in r.links} for r in got.collect()}
    assert set(links[1]) == {50} and links[1][50].offset == 50 and links[1][50].ber < 0.01
    assert set(links[2]) == {100} and not links[3]


def test_short_media_have_fingerprints(spark):
    from pyspark.sql import functions as F

    from quarrygraph.llm.chroma import BYTES, fingerprints, search

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ,.") for _ in range(n)).encode()
    a, b = text(800), text(500)
    media = [(1, b"x"), (2, a), (3, a), (50, a[:600] + text(200)), (4, b), (5, b""), (6, None), (7, text(863)), (8, text(864))]
    got = {r.id: r for r in search(fingerprints(spark.createDataFrame(media, "id long, media binary"), BYTES), F.col("id") % 50 == 0, excerpts=True).collect()}
    assert {i: r.n_codes for i, r in got.items()} == {1: 8, 2: 8, 3: 8, 50: 8, 4: 8, 5: 0, 6: 0, 7: 8, 8: 1}
    assert got[2].class_id == got[3].class_id == 2 and got[4].class_id == 4


# -------------------------------------------------------------------------------------------- language


def test_languages_are_told_apart(spark):
    from quarrygraph.llm.langid import learn_profiles, predict_languages

    vocab = {"en": "the of and to in that thing with was".split(), "fr": "le la les des que pour être aux vous".split(), "xx": "qwz zwq kwz wqk zzk kkq".split()}
    rng = random.Random(1)
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(i, text(lang, 60), lang, i % 4 == 2) for i, lang in enumerate(rng.choice(list(vocab)) for _ in range(200))]
    rows += [(900, None, "en", True), (901, "", "en", True), (902, "12 34 !!", "en", False), (903, text("fr", 30000), "fr", True), (None, text("en", 40), None, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean").repartition(3)
    profiles = learn_profiles(df.filter("not held_out"))
    assert set(profiles) == set(vocab)
    got = predict_languages(df, profiles).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, t, lang, _ in rows if lang and t and any(c.isalpha() for c in t))
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)
    assert by[None].lang_pred == "en"
    assert {r.lang_pred for r in predict_languages(df, learn_profiles(df.limit(0))).collect()} == {"und"}


# ---------------------------------------------------------------------------------------- segmentation


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    from quarrygraph.llm.lattice import Pieces

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return Pieces(f.read())


def all_paths(pieces, word):
    """Every segmentation of a word with its mass."""
    from quarrygraph.llm.lattice import UNKNOWN

    def go(i):
        if i == len(word):
            return [((), 0.0)]
        out, node, j = [], 0, i
        edges = []
        while j < len(word):
            step = int(pieces.step(np.array([node]), np.array([ord(word[j])]))[0])
            if step < 0:
                break
            node, j = step, j + 1
            if pieces.ids[node] >= 0:
                edges.append((j, int(pieces.ids[node]), pieces.score[node]))
        if not any(e[0] == i + 1 for e in edges):
            edges.append((i + 1, -1 - ord(word[i]), UNKNOWN))
        for end, piece, score in edges:
            out += [((piece, *rest), score + s) for rest, s in go(end)]
        return out

    return go(0)


def test_samples_follow_the_lattice(pieces):
    from quarrygraph.llm.lattice import MARK, ids_of, sample_texts  # noqa: F401

    text = "cats x"
    paths = [((), 0.0)]
    for w in (chr(MARK) + "cats", chr(MARK) + "x"):
        paths = [(a + b, x + y) for a, x in paths for b, y in all_paths(pieces, w)]
    z = np.logaddexp.reduce([x for _, x in paths])
    p = {a: math.exp(x - z) for a, x in paths}
    n, k = 4000, 3
    first, estimate = collections.Counter(), collections.Counter()
    for found in sample_texts(pieces, list(range(n)), [text] * n, k, 1):
        ids = [tuple(i.tolist()) for i, _, _ in found]
        assert len(set(ids)) == len(ids) == k
        first[ids[0]] += 1
        for i, (_, logp, q) in zip(ids, found):
            assert abs(logp - math.log(p[i])) < 1e-5 and 0 < q <= 1
            estimate[i] += math.exp(logp) / q / n
    for path, mass in p.items():
        if mass > 0.01:
            assert abs(first[path] / n - mass) < 4 * math.sqrt(mass / n)
            assert abs(estimate[path] - mass) < 0.05
    assert abs(sum(estimate.values()) - 1) < 0.03


def test_few_segmentations_are_all_returned(pieces):
    from quarrygraph.llm.lattice import sample_texts

    (found,) = sample_texts(pieces, [1], ["a"], 50, 3)
    assert {tuple(i.tolist()) for i, _, _ in found} == {a for a, _ in all_paths(pieces, "▁a")}
    assert all(q == 1.0 for _, _, q in found)
    (empty,) = sample_texts(pieces, [1], [""], 3, 3)
    assert len(empty) == 1 and not len(empty[0][0]) and empty[0][1:] == (0.0, 1.0)


def test_samples_do_not_depend_on_batches_and_round_trip(spark, pieces):
    import public_tokenizers
    import sentencepiece

    from quarrygraph.llm import lattice

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = ["", None, " ", "  two  spaces ", "tab\there\nnew\r\nline", "𐍈 œuvre ñandú 漢字", "x" * 3000, "ab " * 2000]
    texts += [" ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no key")]
    a = lattice.sample_segmentations(frame(spark, rows), path, 3).collect()
    b = lattice.sample_segmentations(frame(spark, rows).repartition(1), path, 3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.samples))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(rows)
    for r in sorted(a, key=key):
        text = (texts[r.doc_id] if r.doc_id is not None else "no key") or ""
        assert r.round_trip
        for s in r.samples:
            assert sp.decode(s.ids) == text
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)
    brief = lattice.sample_segmentations(frame(spark, rows), path, 3, brief=True).collect()
    assert sorted((r.doc_id or -1, [s.n_pieces for s in r.samples]) for r in brief) == sorted((r.doc_id or -1, [len(s.ids) for s in r.samples]) for r in a)
    again = lattice.decode(lattice.encode(frame(spark, rows), path), path).collect()
    assert collections.Counter((r.doc_id, r["text"]) for r in again) == collections.Counter((i, t or "") for i, t in rows)
    assert lattice.sample_segmentations(frame(spark, rows).limit(0), path).count() == 0


def test_query_returns_the_segmentations(spark, tmp_path):
    """The ids themselves, which decode to the text; the digests are of these ids."""
    import public_tokenizers
    import sentencepiece

    from quarrygraph.llm.queries import op7_gumbel_segmentations

    texts = {1: "cats and dogs", 2: "", 3: None, 4: "  漢字 two  spaces\n", 5: "word " * 400}
    frame(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in op7_gumbel_segmentations(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert all(sp.decode(ids) == (texts[i] or "") for ids in r.ids) and r.round_trip
        assert r.n_samples == len(r.ids) == (2 if texts[i] else 1) and r.n_pieces == [len(ids) for ids in r.ids]
        assert r.ids_crc32 == [zlib.crc32(np.array(ids, "<i4").tobytes()) for ids in r.ids]


def test_every_sample_must_round_trip(spark, monkeypatch):
    import public_tokenizers

    from quarrygraph.llm import lattice

    def broken(pieces, keys, texts, k, seed, words):
        for (first, p, q), (second, *rest) in lattice_samples(pieces, keys, texts, k, seed, words):
            yield [(first, p, q), (second[:-1], *rest)]

    lattice_samples = lattice.sample_texts
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = frame(spark, [(1, "cats and dogs")])
    assert lattice.sample_segmentations(rows, path).first().round_trip
    monkeypatch.setattr(lattice, "sample_texts", broken)
    assert not lattice.sample_segmentations(rows, path).first().round_trip


# ---------------------------------------------------------------------------------------- near-duplicates


def near_rows(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(120):
        rows.append((i, " ".join([word() for _ in range(rng.randint(1, 150))] + (passage if i % 3 == 0 else []))))
    n = 120
    for b in range(12):  # near copies of all degrees
        words = rows[b][1].split(" ") + [word() for _ in range(120)]
        rows.append((n, " ".join(words)))
        n += 1
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def classes_by_brute_force(rows):
    from quarrygraph.llm.neardup import DF_FLOOR

    n, texts = len(rows), dict(rows)
    sets = {i: shingles(t) for i, t in rows}
    df = collections.Counter(s for i, t in rows for s in shingles(t))
    weight = {i: {s: c * math.log1p(n / max(df[s], n * DF_FLOOR)) for s, c in v.items()} for i, v in sets.items()}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            wa, wb = weight[a], weight[b]
            low = sum(min(wa[s], wb[s]) for s in wa.keys() & wb.keys())
            whole = sum(wa.values()) + sum(wb.values()) - low
            same = (texts[a] or "") == (texts[b] or "")
            if same or whole and low / whole >= 0.8:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicate_classes_equal_brute_force(spark):
    from quarrygraph.llm.neardup import classed, keep_one

    rows = near_rows()
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (502, None), (503, ""), (504, " \n"), (505, "one two"), (506, "one  two"), (507, "one three")]
    got = {r.doc_id: r.class_id for r in classed(frame(spark, rows)).collect()}
    want = classes_by_brute_force(rows)
    assert got == want
    assert len(set(want.values())) < len(rows) - 40
    kept = keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_every_shingle_weighs_by_its_own_df(spark, monkeypatch):
    """Eight documents of 400 share a passage: common words of so few documents still weigh less than words of one."""
    from quarrygraph.llm import neardup

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage, rows = [word() for _ in range(104)], []
    for i in range(400):
        rows.append((i, " ".join(passage + [word() for _ in range(11)] if i % 50 == 7 else [word() for _ in range(rng.randint(1, 30))])))
    rows += [(900, rows[7][1]), (901, rows[8][1] + " " + word())]
    df = collections.Counter(s for _, t in rows for s in shingles(t))
    want = sorted(math.log1p(len(rows) / n) for n in df.values() if n > 1)
    for block, bucket in ((neardup.DF_BLOCK, neardup.DF_BUCKET), (2000, 5000)):
        monkeypatch.setattr(neardup, "DF_BLOCK", block)
        monkeypatch.setattr(neardup, "DF_BUCKET", bucket)
        idf = neardup.learn_idf(neardup.numbered(frame(spark, rows))[0])
        assert np.allclose(sorted(idf.values), want)
        got = {r.doc_id: r.class_id for r in neardup.classed(frame(spark, rows)).collect()}
        assert got == classes_by_brute_force(rows)
        assert len({got[i] for i in range(7, 400, 50)}) == 8 and got[900] == 7


def test_near_duplicates_of_a_large_family_are_all_found(spark):
    """A template family below the threshold shares keys by the thousand; the pairs in its middle are above it."""
    from quarrygraph.llm.neardup import classed

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    body, rows = [word() for _ in range(685)], []
    for i in range(2000):
        rows.append((2 * i + 1, body + [word() for _ in range(19)]))
    twins = rng.sample(range(200, 1800), 150)
    for i in twins:
        own = rows[i][1]
        rows.append((2 * i + 2, own[:-7] + [word() for _ in range(7)]))
    got = {r.doc_id: r.class_id for r in classed(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    want = {i: i for i, _ in rows} | {2 * i + 2: 2 * i + 1 for i in twins}
    assert got == want


def test_near_duplicates_take_awkward_ids(spark):
    from quarrygraph.llm.neardup import classed, keep_one

    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text + " x"), (None, text), (None, "other words are here now"), (3, "something else"), (3, text + " y z")]
    kept = keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) in ([(True, 0), (True, 0)], [(False, 1), (True, 0)], [(True, 0)], [(False, 1)])
    assert classed(frame(spark, rows)).count() >= 4
    empty = frame(spark, rows).limit(0)
    assert classed(empty).count() == 0 and keep_one(empty).count() == 0


def test_icws_collides_as_weighted_jaccard():
    from quarrygraph.llm.neardup import K, icws

    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    wa = rng.choice([0.0, 1.0, 2.0, 5.0], len(codes))
    wb = np.where(rng.random(len(codes)) < 0.7, wa, rng.choice([0.0, 1.0, 3.0], len(codes)))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    hits = 0
    for seed in range(40):
        c = codes ^ np.uint64(seed * 7919)
        s = [icws(c[w > 0], w[w > 0], np.zeros(int((w > 0).sum()), np.int64), 1) for w in (wa, wb)]
        hits += int((s[0] == s[1]).sum())
    assert abs(hits / (40 * K) - true) < 0.03


def test_components_of_chains_and_hubs(spark):
    from quarrygraph.llm.neardup import components

    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250)]
    got = {r.doc: r.root for r in components(spark.createDataFrame(edges, "rep long, doc long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and {got[i] for i in range(101, 160)} == {100} and got[300] == got[250] == 200


# ------------------------------------------------------------------------------------------ substrings


@pytest.mark.parametrize("alphabet", [2, 3, 26])
def test_suffix_arrays(alphabet):
    from quarrygraph.llm.suffixdedup import suffix_array

    rng = random.Random(alphabet)
    for _ in range(150):
        s = bytes(rng.randint(1, alphabet) for _ in range(rng.randint(0, 80))) + b"\0"
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def cut_by_brute_force(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def substring_rows(rng, n=60):
    passages = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randint(1, 200))))
        rows.append((i, "".join(parts)))
    return rows + [(n, "a" * 700), (n + 1, "ab" * 300), (n + 2, None), (n + 3, ""), (n + 4, passages[0]), (n + 5, passages[0])]


@pytest.mark.parametrize("small", [False, True])
def test_substrings_equal_brute_force(spark, small, monkeypatch):
    from quarrygraph.llm import suffixdedup as sd

    if small:  # several segments, chunks and salted blocks
        monkeypatch.setattr(sd, "SEGMENT", 300)
        monkeypatch.setattr(sd, "CHUNK_RECORDS", 20)
        monkeypatch.setattr(sd, "BLOCK_STRINGS", 2)
        monkeypatch.setattr(sd, "BLOCK_BYTES", 300)
        monkeypatch.setattr(sd, "CHUNK_CONTENTS", 3)
    rows = substring_rows(random.Random(11))
    got = sd.dedup_substrings(frame(spark, rows), keep_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got} == cut_by_brute_force(rows)
    assert sum(r.n_removed for r in got) > 3000


@pytest.mark.parametrize("partitions", [1, 7])
def test_one_passage_in_thousands_of_documents(spark, partitions):
    """One passage, with slightly different surroundings, in 2,000 documents: its ends are frequent minimizers."""
    from quarrygraph.llm import suffixdedup as sd

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, tails = word(260), [word(40) for _ in range(40)]
    rows = [(i, word(rng.randint(0, 60)) + passage[rng.randint(0, 3) :] + rng.choice(tails)[: rng.randint(5, 40)] + word(30)) for i in range(2000)]
    docs = frame(spark, rows).repartition(partitions)
    got = sd.dedup_substrings(docs, keep_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got} == cut_by_brute_force(rows)


def test_frequent_minimizers_make_no_row_for_each_window(spark):
    """Rows of the cells follow the records that share something, not their windows."""
    from quarrygraph.llm import suffixdedup as sd

    rng = random.Random(4)
    shared = bytes(rng.randint(97, 105) for _ in range(100))
    rows = [(i, i * 7, 80, bytes(rng.randint(97, 122) for _ in range(80)) + shared) for i in range(3000)]
    hot = spark.createDataFrame(rows, "doc long, start int, gram int, bytes binary")
    fit, single = sd._split_frequent(hot)
    assert sum(x.count() for x in fit) < 3000
    assert {(r.doc, r.start) for x in single for r in x.collect()} >= {(i, i * 7 + 80) for i in range(1, 3000)}


def test_substrings_take_repeated_and_null_ids(spark):
    from quarrygraph.llm.suffixdedup import dedup_substrings

    rng = random.Random(1)
    a = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, a), (1, a), (1, "x" + a), (None, a + "tail"), (2, "short")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in dedup_substrings(frame(spark, rows)).collect())
    assert got == [(False, 1, 300, 0), (False, 1, 300, 0), (False, 1, 301, 300), (False, 2, 5, 0), (True, 0, 304, 300)]
    top, low = 2**63 - 1, -(2**63)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in dedup_substrings(frame(spark, [(top, a), (top, "y" + a), (low, a + "z")])).collect())
    assert got == [(low, 301, 0), (top, 300, 300), (top, 301, 300)]
    assert dedup_substrings(frame(spark, rows).limit(0)).count() == 0


def test_packing_of_substring_records_takes_little_memory():
    """Records of 12 MB of text: hashes of one segment at a time, and no second copy of the records."""
    import tracemalloc

    import pyarrow as pa

    from quarrygraph.llm import suffixdedup as sd

    rng = random.Random(7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([rng.randbytes(2000).hex() for _ in range(3000)])], ["doc", "text"])
    packed = 0
    tracemalloc.start()
    try:
        for out in sd._pack_batches(64)(iter([batch])):
            packed += sum(sd._unpack(x)[0].size for x in out.column("blob").to_pylist() if x is not None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert packed > 200_000
    assert peak < 100e6


def test_substrings_are_read_in_small_batches(spark, monkeypatch):
    from quarrygraph.llm import suffixdedup as sd

    pack = sd._pack_batches

    def strict(n_buckets):
        run = pack(n_buckets)

        def checked(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 8_000_000
                    yield batch

            yield from run(small())

        return checked

    monkeypatch.setattr(sd, "_pack_batches", strict)
    rng = random.Random(9)
    rows = [(i, rng.randbytes(5000).hex()) for i in range(1500)]
    rows += [(2000 + i, "z" + rows[i][1]) for i in range(0, 1500, 50)]
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    got = sd.dedup_substrings(frame(spark, rows).repartition(1), keep_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {i: (len(x), *((10_000, 1) if i >= 2000 else (0, 0))) for i, x in rows}
    assert spark.conf.get(setting, None) == before
