"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a DataFrame expression over the whole text; nothing is shuffled and
no Python runs on the executors. A rule is (metric, least, most); ``None`` leaves a
side open. A text keeps its place if the base rules and all thresholds hold.

Defined results: a null text counts as empty; an empty text has no words, all counts
zero, and fails the base rules; ratios over no words or no lines are zero; repeated
rows are judged alike; other columns pass through, except that a column with the name
of an output replaces nothing: :func:`quality_metrics` returns only its own columns and
:func:`keep_good` returns only the input's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import WORD
from millrace.workspace import spread, table

SYMBOLS = "#*$%&|<>"
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by this from at or an a he not "
    "le la les et des un une du de dans en que qui pour par sur est au avec pas "
    "der die und den von zu das mit sich ist im nicht ein eine auf für als dem "
    "el los las y se del con su para al no una lo como es"
).split()
#: (metric, least, most).
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def compile_thresholds(m: Column, rules: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """One boolean expression: every metric of the struct ``m`` inside its bounds."""
    verdict = F.lit(True)
    for metric, least, most in rules:
        if least is not None:
            verdict = verdict & (m[metric] >= F.lit(least))
        if most is not None:
            verdict = verdict & (m[metric] <= F.lit(most))
    return verdict


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once. Columns of a projection would be put
    in place of their names wherever a filter is pushed below it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    places = F.when(F.size(words) < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))))
    # The windows' hashes with their places, in order of the hash: equal windows meet.
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    twice = lambda s: F.transform(
        F.filter(
            F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"], F.lit(False)).alias("twice"))),
            lambda x: x["twice"],
        ),
        lambda x: x["i"],
    )
    covered = lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2)))
    return _let(F.sort_array(F.transform(places, window)), lambda s: _let(twice(s), covered))


def metrics(text: Column, rules=THRESHOLDS, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, the ratios,
    base_failed and kept of a text, as one struct."""
    t = F.coalesce(text, F.lit(""))
    counts = lambda w, lines: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("long").alias("n_stop"),
        _repeated(w).cast("long").alias("n_repeat_words"),
    )
    ratios = lambda c: F.struct(
        *(c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")),
        _ratio(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
        _ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
        _ratio(c["n_stop"], c["n_words"]).alias("stop_word_ratio"),
        _ratio(c["n_dup_lines"], c["n_lines"]).alias("dup_line_ratio"),
        ((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])).alias("base_failed"),
    )
    judged = lambda m: m.withField("kept", ~m["base_failed"] & compile_thresholds(m, rules))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(t, F.lit(WORD), 0)
    return _let(_let(_let(words, lambda w: _let(lines, lambda x: counts(w, x))), ratios), judged)


def quality_metrics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules=THRESHOLDS, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``keep`` columns, then the fields of :func:`metrics`."""
    docs = spread(docs.select(*dict.fromkeys([*keep, text])))
    return docs.select(*keep, metrics(F.col(text), rules, stop_words).alias("_m")).select(*keep, "_m.*")


def keep_good(docs: DataFrame, text: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return spread(docs).where(metrics(F.col(text), rules)["kept"])


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
      len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) BETWEEN 2.0 AND 12.0
  AND coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) <= 0.1
  AND coalesce(n_stop::DOUBLE / nullif(n_words, 0), 0) >= 0.04
  AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM b
"""
