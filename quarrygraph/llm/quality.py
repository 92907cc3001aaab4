"""Quality rules as a short-circuit cascade.

The base rule (too short, too repetitive) is judged for every document, because its counts are
results. The other rules form a cascade: on a sample, each rule's cost (seconds beyond reading the
sample) and selectivity (share rejected) are measured, and the rules run in order of rejection per
cost inside one lazily evaluated CASE, so a rejected document pays for no later rule. The order
changes the cost and ``rejected_by`` only; ``kept`` is the same under every order. One job judges every row of the
sample ``REPEATS`` times, so that a rule's cost stands out from the job's own.

Defined results: a null or blank text has no words and fails the base rule; ties between rules go to
the rule's name; repeated rows are judged alike; a null ``doc_id`` is judged by its text; very long texts are judged
whole; on an empty table the rules keep their given order; extra columns pass through, those that share a name with a
result as ``<name>_input`` (``keep_documents`` gives all columns back under their own names).
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, SetAside, materialize, text_or_empty

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
REPEATS = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULTS = (*COUNTS, "rejected_by", "kept")
_INNER = ("__text", "__words", "__lines", "__n_lines", "__again")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a plain column would be inlined in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are hashed to 64 bits. Where none repeats that is all; else positions sorted by hash show
    the repeated windows, and one pass over their sorted starts adds up what they cover.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, e: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            mark = F.transform(s, lambda e, k: F.when(same(k - 1, e) | same(k + 1, e), e["i"]).otherwise(F.lit(-1)))
            return F.array_sort(F.filter(mark, lambda i: i >= 0))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            _let(by_hash, starts),
            zero,
            lambda acc, i: F.struct(
                (acc["n"] + window - F.greatest(F.lit(0), acc["end"] - i)).cast("long").alias("n"),
                (i + window).alias("end"),
            ),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    n = F.size(words)
    hashes = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(window)))
    )
    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(_let(words, lambda w: _let(hashes(w), covered)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds a condition over the columns of ``features`` and ``__words``, ``__text``."""

    name: str
    rejects: Callable[[], Column]


RULES = (
    Rule("symbol_share", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 2 > F.col("__n_lines")),
    Rule(
        "word_length",
        lambda: (F.col("word_chars") * 2 < F.col("n_words") * 5) | (F.col("word_chars") > F.col("n_words") * 12),
    ),
    Rule(
        "stutter",
        lambda: _let(
            F.col("__words"),
            lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))),
        )
        * 5
        > F.col("n_words"),
    ),
    Rule(
        "letterless_words",
        lambda: F.size(F.filter(F.col("__words"), lambda x: ~x.rlike(r"\p{L}"))) * 4 > F.col("n_words"),
    ),
    Rule("few_distinct_words", lambda: F.size(F.array_distinct("__words")) * 10 < F.col("n_words")),
)


def features(docs: DataFrame) -> DataFrame:
    """``docs``, free of the names used here, with the base counts, ``base_failed`` and the cascade's inputs."""
    lines = F.filter(F.split(F.col("__text"), "\n", -1), lambda x: x.rlike(NOT_SPACE))
    return (
        docs.withColumn("__text", text_or_empty())
        .withColumns({"__words": words_of(F.col("__text")), "__lines": lines})
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
                "n_symbols": (
                    F.octet_length("__text") - F.octet_length(F.regexp_replace("__text", SYMBOLS, ""))
                ).cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "__n_lines": F.size("__lines"),
                "n_repeat_words": repeated_words(F.col("__words")),
            }
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def measure_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """(rule, seconds for a row, share rejected) over a hash sample of about ``sample_rows`` rows that pass the base rule."""
    n = docs.count()
    if n == 0:
        return [(rule, 0.0, 0.0) for rule in rules]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, -(-sample_rows * 1_000_000 // n)))
    kept = features(docs.filter(part)).filter(~F.col("base_failed"))
    sample = materialize(kept.select(*COUNTS, "__text", "__words", "__n_lines").repartition(4), "rule-sample")
    again = F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))

    def seconds(condition: Column) -> tuple[float, int, int]:
        probe = sample.withColumn("__again", again).agg(
            F.count_if(F.coalesce(condition, F.lit(False))).alias("n"), F.sum(F.size("__words")), F.count(F.lit(1)).alias("rows")
        )
        best, found = float("inf"), None
        for _ in range(2):
            began = time.perf_counter()
            found = probe.first()
            best = min(best, time.perf_counter() - began)
        return best, found.n, found.rows

    floor, _, rows = seconds(F.lit(False))
    out = []
    for rule in rules:
        took, found, _ = seconds(rule.rejects())
        out.append((rule, max(took - floor, 1e-6) / max(rows, 1), found / max(rows, 1)))
    return out


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """Rules by falling rejection per second, as measured on the sample."""
    measured = measure_rules(docs, rules, sample_rows)
    if not any(cost for _, cost, _ in measured):
        return list(rules)
    return [rule for rule, _, _ in sorted(measured, key=lambda m: (-m[2] / m[1], m[0].name))]


def _scored(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> DataFrame:
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order_rules(docs, rules, sample_rows):
        verdict = verdict.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name))
    return features(docs).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def score_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """All columns of ``docs`` with the base counts, ``base_failed``, ``rejected_by`` and ``kept``."""
    given = SetAside(docs, _INNER, RESULTS)
    return _scored(given.docs, rules, sample_rows).select(*given.beside(), *RESULTS)


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    given = SetAside(docs, _INNER, RESULTS)
    return _scored(given.docs, rules, sample_rows).filter("kept").select(*given.as_given())


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 9)
), repeated AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM repeated GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, w, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR n_symbols * 10 > n_words
            OR n_dup_lines * 2 > n_lines
            OR word_chars * 2 < n_words * 5 OR word_chars > n_words * 12
            OR len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) * 5 > n_words
            OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) * 4 > n_words
            OR len(list_distinct(w)) * 10 < n_words) AS kept
FROM judged
"""
