"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed to cells (source, language, topic). A cell's weight is its tokens times one factor for each of
its categories. Sweeps rake the factors: each sets the factors of the sources, then of the languages, then of the
topics, so that every category meets its target share; sweeps end when all shares are met to ``TOLERANCE``, or after
``SWEEPS``. A cell's fitted share over its token share is the weight of its tokens; a sampling rate proportional to it,
capped at one and solved so that the expected tokens meet the budget, is the calibrated probability of its documents.

Cells, as many as combinations of categories, stay a distributed table: a step joins them to the factors, sums by category,
and writes one row for each category. The rate is solved by sums over all cells. The driver sees only totals.

Defined results: null source, language or topic is the category ``(null)``; a null or blank text has
no tokens, so it weighs nothing and is drawn at its cell's rate (1 where the whole cell has none);
repeated rows share one fate, since the draw hashes ``doc_id``, and so do rows without one; very long texts are counted
whole; an empty table gives an empty result; extra columns pass through, those that share a name with a result as
``<name>_input`` (``sample_documents`` gives all columns back under their own names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SetAside, materialize, text_or_empty

SWEEPS, TOLERANCE = 20, 1e-11
DIMS = ("__source", "__lang", "__topic")
RESULTS = (*DIMS, "__tokens", "ratio", "prob", "sampled")


@dataclass(frozen=True)
class Mix:
    """Target shares are proportional to tokens ** power (0: uniform, 1: as found); ``keep`` is the budget as a
    share of all tokens. ``targets`` may give explicit shares: {"source": {"web": 0.5, ...}, ...}."""

    source_power: float = 0.5
    lang_power: float = 0.7
    topic_power: float = 0.8
    keep: float = 0.5
    seed: str = "mix"

    @property
    def powers(self) -> tuple[float, float, float]:
        return self.source_power, self.lang_power, self.topic_power


_BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.lit(0).cast("long")).otherwise(F.size(F.split(trimmed, SPACE + "+", -1)).cast("long"))


def topic_of(text: Column, words: Column) -> Column:
    """A document's genre as its topic: markup, short, listing, long or prose."""
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(symbols * 10 > words, "markup")
        .when(words < 50, "short")
        .when(words < 12 * lines, "listing")
        .when(words >= 1000, "long")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with the raking dimensions and ``__tokens``."""
    text = text_or_empty()
    out = docs.withColumn("__tokens", n_words(text))
    named = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    return out.withColumns(
        {
            "__source": named(F.col("source")),
            "__lang": named(F.col("lang")),
            "__topic": named(topic if topic is not None else topic_of(text, F.col("__tokens"))),
        }
    )


def fit(cells: DataFrame, total: float, mix: Mix, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Rake (dims, n) to (dims, n, ratio): the weight of a token against the unweighted mix."""
    factors: dict[str, DataFrame] = {}
    for dim, power in zip(DIMS, mix.powers):
        margin = cells.groupBy(dim).agg(F.sum("n").alias("n"))
        given = (targets or {}).get(dim.strip("_"))
        if given is None:
            share = F.pow(F.col("n"), F.lit(power))
        else:
            share = F.coalesce(
                F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(dim)), F.lit(0.0)
            ).cast("double")
        shares = materialize(margin.select(dim, share.alias("t")), "target-shares")
        whole = shares.agg(F.sum("t")).first()[0] or 1.0
        factors[dim] = shares.select(dim, (F.col("t") / F.lit(whole)).alias("t"), F.lit(1.0).alias("f"), F.lit(0.0).alias("off"))
    for _ in range(SWEEPS):
        for dim in DIMS:
            others = [d for d in DIMS if d != dim]
            raked, weight = cells, F.col("n").cast("double")
            for other in others:
                raked = raked.join(factors[other].select(other, F.col("f").alias(f"f{other}")), other)
                weight = weight * F.col(f"f{other}")
            sums = raked.groupBy(dim).agg(F.sum(weight).alias("m"))
            some = F.col("m") > 0
            moved = factors[dim].join(sums, dim).select(
                dim, "t",
                F.when(some, F.try_divide("t", "m")).otherwise(0.0).alias("f"),
                F.abs(F.col("m") * F.col("f") - F.col("t")).alias("off"),
            )
            factors[dim] = materialize(moved, "raking")
        off = [factors[d].agg(F.max("off").alias("off")) for d in DIMS]
        if (off[0].union(off[1]).union(off[2]).agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    ratio = F.lit(float(total))
    for dim in DIMS:
        cells = cells.join(factors[dim].select(dim, F.col("f").alias(f"f{dim}")), dim)
        ratio = ratio * F.col(f"f{dim}")
    return materialize(cells.select(*DIMS, "n", ratio.alias("ratio")), "fitted")


def solve_rate(cells: DataFrame, total: float, keep: float) -> float | None:
    """The ``a`` for which probabilities min(1, a * ratio) give ``keep`` of all tokens; None where every rate is 1.

    With the cells of rate 1 settled, ``a`` is the rest of the budget over the rest of the weight. A larger ``a`` settles
    more cells and never fewer, so this is repeated until none is added.
    """
    budget, a, settled = keep * total, keep, 0
    while True:
        full = F.lit(a) * F.col("ratio") > 1.0
        r = cells.agg(
            F.count_if(full).alias("k"), F.sum(F.when(full, F.col("n"))).alias("n"), F.sum(F.when(~full, F.col("n") * F.col("ratio"))).alias("w")
        ).first()
        if r.k == settled:
            return a
        if not r.w:
            return None
        settled, a = r.k, (budget - (r.n or 0)) / r.w


def draw(seed: str) -> Column:
    """A uniform number in [0, 1) from 48 bits of the md5 of the seed and ``doc_id``."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def fitted_cells(keyed: DataFrame, mix: Mix, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dims, __ratio, __prob) of all cells with tokens."""
    cells = materialize(keyed.groupBy(*DIMS).agg(F.sum("__tokens").alias("n")).filter("n > 0"), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    fitted = fit(cells, total, mix, targets)
    a = solve_rate(fitted, total, mix.keep) if total else None
    prob = F.lit(1.0) if a is None else F.least(F.lit(1.0), F.lit(a) * F.col("ratio"))
    return materialize(fitted.select(*DIMS, F.col("ratio").alias("__ratio"), prob.alias("__prob")), "rates")


def _mixed(docs: DataFrame, mix: Mix, targets, topic) -> DataFrame:
    keyed = with_cells(docs, topic)
    out = keyed.join(fitted_cells(keyed, mix, targets), list(DIMS), "left")
    prob = F.coalesce(F.col("__prob"), F.lit(1.0))
    return out.withColumns({"ratio": F.coalesce(F.col("__ratio"), F.lit(0.0)), "prob": prob, "sampled": draw(mix.seed) < prob})


def mix_documents(
    docs: DataFrame,
    mix: Mix = Mix(),
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
) -> DataFrame:
    """All columns of ``docs`` plus the dimensions, ``__tokens``, ``ratio``, ``prob`` and ``sampled``."""
    given = SetAside(docs, ("__ratio", "__prob"), RESULTS)
    return _mixed(given.docs, mix, targets, topic).select(*given.beside(), *RESULTS)


def sample_documents(
    docs: DataFrame, mix: Mix = Mix(), targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None
) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns only."""
    given = SetAside(docs, ("__ratio", "__prob"), RESULTS)
    return _mixed(given.docs, mix, targets, topic).filter("sampled").select(*given.as_given())


def sql(mix: Mix = Mix(), docs: str = "documents") -> str:
    """DuckDB SQL of ``mix_documents``: the sweeps unrolled into one step each."""
    steps = []
    last = "c0"
    k = 0
    for _ in range(SWEEPS):
        for d in ("source", "lang", "topic"):
            k += 1
            steps.append(
                f"c{k} AS MATERIALIZED (SELECT * REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})"
            )
            last = f"c{k}"
    shares = ",\n".join(
        f"s_{d} AS (SELECT {d}, m / sum(m) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(n), {p}) AS m FROM cells GROUP BY {d}))"
        for d, p in zip(("source", "lang", "topic"), mix.powers)
    )
    return rf"""
WITH base AS (
  SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM {docs}
), keyed AS (
  SELECT * EXCLUDE (source, lang), coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    CASE WHEN (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) * 10 > n_tokens THEN 'markup'
         WHEN n_tokens < 50 THEN 'short'
         WHEN n_tokens < 12 * (length(t) - length(replace(t, chr(10), '')) + 1) THEN 'listing'
         WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic
  FROM base
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM keyed GROUP BY ALL HAVING sum(n_tokens) > 0
), {shares},
c0 AS MATERIALIZED (
  SELECT *, n / sum(n) OVER () AS weight FROM cells JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic)
), {", ".join(steps)},
ratios AS (SELECT *, sum(n) OVER () AS total, weight * sum(n) OVER () / n AS ratio FROM {last}),
ranked AS (
  SELECT *, row_number() OVER o AS rank,
    ({mix.keep} * total - coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * total) AS a
  FROM ratios WINDOW o AS (ORDER BY ratio DESC, source, lang, topic)
), best AS (SELECT min_by(a, rank) AS a FROM ranked WHERE ranked.a * ratio <= 1.0),
rates AS (SELECT source, lang, topic, ratio, least(1.0, coalesce(best.a * ratio, 1.0)) AS prob FROM ranked, best),
mixed AS (
  SELECT k.* EXCLUDE (t), coalesce(r.ratio, 0.0) AS ratio, coalesce(r.prob, 1.0) AS prob,
    ('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / {float(16**12)} AS u
  FROM keyed k LEFT JOIN rates r USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, round(ratio, 6) AS weight, round(prob, 6) AS prob, u < prob AS sampled
FROM mixed
"""


SQL = sql()
