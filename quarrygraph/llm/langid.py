"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent n-grams (1 to 3 characters of lower-cased, space-padded words)
in order of frequency. A document is ranked the same way; its out-of-place distance to a profile is the
sum, over its own top n-grams, of how far each is from its place there, with the profile's length where
it is absent. The nearest profile wins.

Learning reads at most about ``per_language`` documents of each language (a hash sample of the labelled
rows); everything predicted reads whole texts. Only profiles, ``profile_size`` n-grams for each language,
reach the driver.

Defined results: a text that is null or has no letter gets ``und`` and score 0; ties between languages go
to the name that sorts first, ties between n-grams to the smaller code; repeated rows get equal answers; an
empty training set makes every answer ``und``; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value

PROFILE_SIZE = 400
PER_LANGUAGE = 3000
_BITS = 21


def _letters_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for cp in range(0x30000):  # no letters are assigned beyond plane 3
        if chr(cp).isalpha():
            table[cp] = True
    for cp in range(0x30000, 0x33000):
        table[cp] = chr(cp).isalpha()
    return table


def ngram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text's words, each padded by one space at both ends.

    A gram is coded as its code points in 21 bits each; runs of non-letters count as one space.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[cp]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(is_letter, cp, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    cp = np.concatenate(([32], cp[keep], [32]))
    pair = (cp[:-1] << _BITS) | cp[1:]
    triple = (pair[:-1] << _BITS) | cp[2:]
    grams = np.concatenate((cp[cp != 32], pair[pair != ((32 << _BITS) | 32)], triple))
    return np.unique(grams, return_counts=True)


def top_ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes in order; ties by code, which comes sorted."""
    if len(codes) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        more = counts > cut
        ties = np.flatnonzero(counts == cut)[: size - int(more.sum())]
        pick = np.concatenate((np.flatnonzero(more), ties))
        pick.sort()
        codes, counts = codes[pick], counts[pick]
    return codes[np.argsort(-counts, kind="stable")]


def _count_partition(batches):
    letters = _letters_table()
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merged(parts):
        codes = np.concatenate([c for c, _ in parts])
        counts = np.concatenate([n for _, n in parts])
        unique, where = np.unique(codes, return_inverse=True)
        return unique, np.bincount(where, counts, len(unique)).astype(np.int64)

    pending: dict[str, list] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            pending.setdefault(lang, []).append(ngram_counts(text, letters))
            if len(pending[lang]) >= 256:
                pending[lang] = [merged(pending[lang])]
    for lang, parts in pending.items():
        totals[lang] = merged(parts)
    for lang, (codes, counts) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"]
        )


def learn_profiles(
    labelled: DataFrame, profile_size: int = PROFILE_SIZE, per_language: int = PER_LANGUAGE
) -> dict[str, list[int]]:
    """Profiles from rows (doc_id, text, lang); rows with null text or lang are left out."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(shares, F.col("lang")) * F.lit(float(1 << 30))
    counts = (
        rows.filter(chance)
        .select("text", "lang")
        .mapInArrow(_count_partition, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile_size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r["rank"])):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Ranker:
    """Out-of-place distances to all profiles at once: a sorted table of grams with a rank per language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.size = max(map(len, profiles.values()))
        self.grams = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, ranked)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == ranked, at, len(self.grams))
        ranks = self.ranks[at]
        places = np.arange(len(ranked))[:, None]
        return np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - places), self.size)).sum(axis=0)

    def predict(self, ranked: np.ndarray) -> tuple[str, float]:
        d = self.distances(ranked)
        best = int(np.argmin(d))
        return self.langs[best], float(1.0 - d[best] / (self.size * len(ranked)))


def predict_batches(profiles: dict[str, list[int]], profile_size: int):
    def run(batches):
        letters = _letters_table()
        ranker = Ranker(profiles) if profiles else None
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                text = text.as_py()
                lang, score = "und", 0.0
                if text and ranker is not None:
                    codes, counts = ngram_counts(text, letters)
                    if len(codes):
                        lang, score = ranker.predict(top_ranked(codes, counts, profile_size))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], profile_size: int = PROFILE_SIZE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for rows (doc_id, text, held_out), without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(
        predict_batches(profiles, profile_size), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


by_value(__name__)
