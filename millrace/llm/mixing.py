"""Mixing sources to target weights, in DataFrame operations only.

Source weights are token shares raised to an exponent and normalised. The exponent is
bisected (in one expression over the sources' counts) to the greatest in [0, 1] at which
the weights' entropy reaches its target, or the least at which no source is repeated
more than a limit. The weights are then realised: each source gets its weight's part of
the token budget; its documents are dealt in whole permutations, each pass a new one, and
the last is cut where the budget ends. The mixed stream is cut into blocks of
``block_tokens``; every block holds each source in the weights' proportion, its rows in
hashed order.

Rows are first dealt to a written table, tokenised once: equal rows are one row there with a
count, so no key, null ids included, is a third of what follows. A permutation's order is that
of a digest of seed, pass and row. A row's place is a sum over what comes before it: bins of
the permutation are summed first, then each bin alone is summed in order, so a source with a
third of all rows is spread over many bins. :func:`select_mix` gives the same rows without
their places: each source's last row within its budget is found in one bin, and every row of
the input is compared with it where it stands.

Defined results: a null source is a source of its own; a null or empty text has no
tokens, and takes part wherever its place falls; of equal rows, which is which does not
matter, and rows that differ in any column given are never equal; an empty table gives an
empty mix; with budget null the mix is as large as the input; a budget of more tokens than
``max_passes`` allows is refused with ValueError; extra columns pass through
:func:`mix_documents`, whose own columns have names of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.text import SPACE, WORD
from millrace.workspace import Written, partitions, spread, table

MAX_PASSES, BLOCK_TOKENS, SEED, STEPS = 1.25, 100_000, 17, 60
#: Rows in a bin of a permutation, about; copies of one row that one task makes.
BIN_ROWS, COPIES = 2_000, 10_000
#: Rows of a table of sources that is broadcast; beyond, sources are joined by a shuffle.
BROADCAST_ROWS = 50_000


def token_count(text: Column) -> Column:
    """Words of a text: what white space splits it into, less the empty ends."""
    t = F.coalesce(text, F.lit(""))
    edge = lambda c: c.isin(*SPACE).cast("int")
    n = F.size(F.split(t, r"[\x20\x09-\x0D]+", -1)) - edge(F.substring(t, 1, 1)) - edge(F.substring(t, -1, 1))
    return F.when(t == "", 0).otherwise(n).cast("long")


def source_weights(sources: DataFrame, budget: float | None = None, max_passes: float | None = MAX_PASSES, entropy: float | None = None) -> DataFrame:
    """``sources(source, tokens, rows)`` -> the same with ``exponent``, ``weight``, ``budget``
    (tokens of the source in the mix). ``max_passes`` and ``entropy`` (a share of the
    greatest, 0 to 1): give one. Sources without tokens get nothing."""
    if (max_passes is None) == (entropy is None):
        raise ValueError("give either max_passes or entropy")
    one = sources.where("tokens > 0").agg(
        F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t")  # one number for each source
    )
    total = "aggregate(t, 0D, (a, x) -> a + x)"
    whole = f"double({budget!r})" if budget is not None else total
    part = "aggregate(t, 0D, (a, x) -> a + pow(x / {total}, mid))".format(total=total)
    if entropy is not None:
        # Entropy falls as the exponent grows: the greatest exponent that still reaches the target.
        h = f"aggregate(t, 0D, (a, x) -> a - (pow(x / {total}, mid) / {part}) * ln(pow(x / {total}, mid) / {part}))"
        good, keep = f"{h} >= {float(entropy)!r} * ln(size(t))", "low"
    else:
        # Passes of the least source grow as the exponent falls: the least exponent within the limit.
        good = f"array_max(transform(t, x -> pow(x / {total}, mid) / {part} * {whole} / x)) <= {float(max_passes)!r}"
        keep = "high"
    moved = f"if({good}, struct(mid as low, s.high as high), struct(s.low as low, mid as high))" if keep == "low" else f"if({good}, struct(s.low as low, mid as high), struct(mid as low, s.high as high))"
    moved = moved.replace("mid", "((s.low + s.high) / 2D)")
    at_end = good.replace("mid", "0D" if keep == "high" else "1D")
    bisected = f"aggregate(sequence(1, {STEPS}), struct(0D as low, 1D as high), (s, _) -> {moved}).{keep}"
    exponent = f"if(size(t) < 2, 1D, if({at_end}, {'0D' if keep == 'high' else '1D'}, {bisected}))"
    one = one.select("t", F.expr(total).alias("total"), F.expr(exponent).alias("exponent"))
    one = one.select("total", "exponent", F.expr("aggregate(t, 0D, (a, x) -> a + pow(x / total, exponent))").alias("norm"))
    # A scalar subquery: the one row goes to every source without a join.
    d = sources.withColumn("_one", one.select(F.struct("total", "exponent", "norm")).scalar()).select("*", "_one.*")
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("norm")).otherwise(0.0)
    d = d.withColumn("weight", weight)
    most = F.lit(float(budget)) if budget is not None else F.col("total")
    d = d.withColumn("budget", F.floor(F.col("weight") * most + 0.5).cast("long"))
    if max_passes is not None:
        d = d.withColumn("budget", F.least("budget", F.floor(F.col("tokens") * F.lit(float(max_passes))).cast("long")))
    return d.select("source", "tokens", "rows", "exponent", "weight", F.coalesce("budget", F.lit(0)).alias("budget"))


def row_digest(docs: DataFrame, text: str, columns: Sequence[str]) -> Column:
    """A digest of a row's columns and text."""
    binary = {f.name for f in docs.schema.fields if f.dataType.typeName() == "binary"}
    said = [F.hex(c) if c in binary else F.col(c).cast("string") for c in dict.fromkeys(columns) if c != text]
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x1e")) for c in [*said, F.md5(F.col(text).cast("binary"))])))


def _order(seed: int, number: Column, digest: Column) -> Column:
    """The key of a permutation: 32 bits of a digest of seed, pass and row."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), number, digest)), 1, 8), 16, 10).cast("long")


def _dealt(docs: DataFrame, key: str, text: str, source: str, carry: Sequence[str], keep: bool) -> DataFrame:
    """(_d, _s, _n, _m, row if ``keep``): distinct rows, tokenised, with how often they occur."""
    rows = spread(docs).select(
        F.struct(*carry).alias("row"), row_digest(docs, text, [key, source, *carry]).alias("_d"), F.col(source).cast("string").alias("_s"), token_count(F.col(text)).alias("_n")
    )
    found = [F.first("_s").alias("_s"), F.first("_n").alias("_n"), F.count("*").alias("_m")]
    return Written(rows.groupBy("_d").agg(*found, *([F.first("row").alias("row")] if keep else [])), "dealt").df


def _shares(dealt: DataFrame, budget: float | None, max_passes: float | None, entropy: float | None) -> DataFrame:
    """(_s2, tokens, budget, weight, _bins) of the sources that have a budget."""
    counted = dealt.groupBy(F.col("_s").alias("source")).agg(F.sum(F.col("_n") * F.col("_m")).alias("tokens"), F.sum("_m").alias("rows"), F.count("*").alias("distinct"))
    if budget is not None and max_passes is not None:
        total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        if budget > total * max_passes:
            raise ValueError(f"a budget of {budget} tokens is more than {max_passes} passes over {total}")
    bins = counted.select(F.col("source").alias("_s4"), F.ceil(F.col("distinct") / BIN_ROWS).cast("long").alias("_bins"))
    shares = source_weights(counted.select("source", "tokens", "rows"), budget, max_passes, entropy)
    shares = shares.join(bins, F.col("source").eqNullSafe(F.col("_s4"))).where("budget > 0")
    return Written(shares.select(F.col("source").alias("_s2"), "tokens", "budget", "weight", "_bins"), "shares", few=True).df


def _in_bins(placed: DataFrame, number: Column, seed: int) -> DataFrame:
    """With ``_h``, ``_bin`` and ``_before``: the tokens of a source's pass before a row."""
    placed = placed.withColumn("_h", _order(seed, number, F.col("_d"))).withColumn("_bin", F.floor(F.col("_h") * F.col("_bins") / F.lit(1 << 32)).cast("long"))
    return placed.withColumn("_pass", number)


def _starts(binned: DataFrame) -> DataFrame:
    """(_s3, _p3, _b3, _start): the tokens of a source's pass before each bin."""
    sums = binned.groupBy("_s", "_pass", "_bin").agg(F.sum(F.col("_n") * F.col("_m")).alias("_sum"))
    before = Window.partitionBy("_s", "_pass").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("_s").alias("_s3"), F.col("_pass").alias("_p3"), F.col("_bin").alias("_b3"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))


def _placed(binned: DataFrame, starts: DataFrame) -> DataFrame:
    """With ``_before``: the tokens of a source's pass before a row."""
    d = binned.join(starts, F.col("_s").eqNullSafe(F.col("_s3")) & (F.col("_pass") == F.col("_p3")) & (F.col("_bin") == F.col("_b3")))
    inside = Window.partitionBy("_s", "_pass", "_bin").orderBy("_h", "_d").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_before", F.col("_start") + F.coalesce(F.sum(F.col("_n") * F.col("_m")).over(inside), F.lit(0)))


def _within(budget: Column) -> Column:
    """How many of a row's occurrences begin before the budget ends."""
    room = F.ceil((budget - F.col("_before")) / F.col("_n")).cast("long")
    return F.when(F.col("_before") >= budget, 0).when(F.col("_n") == 0, F.col("_m")).otherwise(F.least("_m", room)).cast("long")


def _repeated(rows: DataFrame, times: Column, most: int) -> DataFrame:
    """Each row ``times`` times, numbered ``_j``; beyond COPIES by several tasks."""
    d = rows.withColumn("_times", times).where("_times > 0")
    zero, step = F.lit(0).cast("long"), F.lit(COPIES).cast("long")
    if most > COPIES:
        d = d.withColumn("_part", F.explode(F.sequence(zero, F.floor((F.col("_times") - 1) / step))))
        d = d.repartition(partitions(rows.sparkSession), "_d", "_part")
    else:
        d = d.withColumn("_part", zero)
    first = F.col("_part") * step
    return d.withColumn("_j", F.explode(F.sequence(first, F.least(first + step, F.col("_times")) - 1)))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = None, max_passes: float | None = MAX_PASSES, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, carry: Sequence[str] | None = None) -> DataFrame:
    """A row for each document of each pass: the struct ``row`` of the input's columns (or of ``carry``),
    ``mix_pass`` (from 0), ``mix_tokens``, ``mix_before`` (tokens of the source before it),
    ``mix_block`` and ``mix_order`` (sort by both for the stream)."""
    dealt = _dealt(docs, key, text, source, carry or docs.columns, True)
    shares = _shares(dealt, budget, max_passes, entropy)
    most = dealt.agg(F.coalesce(F.max("_m"), F.lit(0))).first()[0]
    placed = dealt.join(_few(shares), F.col("_s").eqNullSafe(F.col("_s2")))
    placed = placed.withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / F.col("tokens")))))
    binned = _in_bins(placed, F.col("mix_pass"), seed)
    placed = _placed(binned, _starts(binned)).withColumn("_before", F.col("_before") + F.col("mix_pass") * F.col("tokens"))
    out = _repeated(placed, _within(F.col("budget")), most)
    before, share = F.col("_before") + F.col("_j") * F.col("_n"), F.greatest(F.lit(1.0), F.col("weight") * F.lit(float(block_tokens)))
    return out.select("row", "mix_pass", F.col("_n").alias("mix_tokens"), before.alias("mix_before"), F.floor(before / share).cast("long").alias("mix_block"), F.col("_h").alias("mix_order"))


def select_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = None, max_passes: float | None = MAX_PASSES, entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of :func:`mix_documents` without their places: ``docs``' own columns. A source's
    last pass ends at one row of its permutation; what comes before that row is in. Texts stay
    where they are."""
    dealt = _dealt(docs, key, text, source, docs.columns, False)
    # The pass that the budget ends in, from 0, and the tokens of it that are within.
    last = F.floor((F.col("budget") - 1) / F.col("tokens"))
    shares = _shares(dealt, budget, max_passes, entropy).withColumn("_last", last).withColumn("_rest", F.col("budget") - F.col("_last") * F.col("tokens"))
    binned = _in_bins(dealt.join(_few(shares), F.col("_s").eqNullSafe(F.col("_s2"))), F.col("_last"), seed)
    # Only the bin where the budget ends is put in order: the last that starts before it.
    starts = _starts(binned).join(_few(shares.select(F.col("_s2").alias("_s5"), "_rest")), F.col("_s3").eqNullSafe(F.col("_s5"))).where("_start < _rest")
    ends = starts.groupBy("_s3", "_p3").agg(F.max(F.struct("_b3", "_start")).alias("e")).select("_s3", "_p3", "e._b3", "e._start")
    within = _placed(binned, ends).withColumn("_q", _within(F.col("_rest"))).where("_q > 0")
    cut = within.groupBy("_s", "_last").agg(F.max(F.struct("_h", "_d", "_q", "_m")).alias("c"))
    cut = Written(cut.select(F.col("_s").alias("_s6"), "_last", F.col("c._h").alias("_ch"), F.col("c._d").alias("_cd"), F.col("c._q").alias("_cq"), F.col("c._m").alias("_cm")), "cut", few=True).df
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_digest(docs, text, [key, source, *docs.columns]).alias("_d"), F.col(source).cast("string").alias("_s"))
    rows = rows.join(_few(cut), F.col("_s").eqNullSafe(F.col("_s6"))).withColumn("_h", _order(seed, F.col("_last"), F.col("_d")))
    at = F.col("_d") == F.col("_cd")
    more = F.when(at, (F.col("_cq") == F.col("_cm")).cast("long")).otherwise((F.struct("_h", "_d") < F.struct("_ch", "_cd")).cast("long"))
    sure = _repeated(rows, F.col("_last") + more, 1)
    cuts_copies, most = cut.agg(F.max((F.col("_cq") < F.col("_cm")).cast("int")), F.max("_cq")).first()
    if not cuts_copies:
        return sure.select("row.*")
    # The budget ends among copies of one row: so many more of it as fit.
    one = rows.where(at & (F.col("_cq") < F.col("_cm"))).groupBy("_d").agg(F.first("row").alias("row"), F.first("_cq").alias("_cq"))
    return sure.select("row.*").unionAll(_repeated(one, F.col("_cq"), most).select("row.*"))


def _few(df: DataFrame) -> DataFrame:
    """A table of a row for each source, broadcast if that is counted few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mix, once for each pass."""
    d = mix_documents(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return d.select("row.doc_id", "row.source", "mix_pass", "mix_tokens", "mix_before", "mix_block")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: rows of ``docs``, some once, some twice, some not."""
    return select_mix(docs)


_DIGEST = "md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(30)), coalesce(source, chr(30)), coalesce(md5(text), chr(30))))"
_HASH = f"('0x' || substr(md5('{SEED}:' || mix_pass || ':' || d), 1, 8))::BIGINT"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_DIGEST} AS d, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source),
t AS (SELECT list(tokens::DOUBLE ORDER BY tokens) FILTER (tokens > 0) AS t, sum(tokens)::DOUBLE AS total FROM s),
b AS (
  SELECT 0 AS k, 0::DOUBLE AS low, 1::DOUBLE AS high
  UNION ALL
  SELECT k + 1, CASE WHEN good THEN low ELSE (low + high) / 2 END, CASE WHEN good THEN (low + high) / 2 ELSE high END
  FROM (SELECT b.*, list_max(list_transform(t, lambda x: pow(x / total, (low + high) / 2)
    / list_sum(list_transform(t, lambda y: pow(y / total, (low + high) / 2))) * total / x)) <= {MAX_PASSES} AS good FROM b, t WHERE k < {STEPS})),
e AS (SELECT CASE WHEN len(t) < 2 THEN 1.0
  WHEN list_max(list_transform(t, lambda x: 1.0 / len(t) * total / x)) <= {MAX_PASSES} THEN 0.0
  ELSE (SELECT high FROM b WHERE k = {STEPS}) END AS exponent, t, total FROM t),
w AS (SELECT source, tokens, pow(tokens / total, exponent) / list_sum(list_transform(t, lambda y: pow(y / total, exponent))) AS weight, total FROM s, e WHERE tokens > 0),
q AS (SELECT source, tokens, weight, least(floor(weight * total + 0.5)::BIGINT, floor(tokens * {MAX_PASSES})::BIGINT) AS budget FROM w),
p AS (SELECT d.*, tokens, weight, budget, unnest(range(0, (budget - 1) // tokens + 1)) AS mix_pass FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE budget > 0),
h AS (SELECT *, {_HASH} AS h FROM p),
c AS (SELECT *, mix_pass * tokens + coalesce(sum(n) OVER (PARTITION BY source, mix_pass ORDER BY h, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS mix_before FROM h)
SELECT doc_id, source, mix_pass::BIGINT AS mix_pass, n AS mix_tokens, mix_before::BIGINT AS mix_before,
  floor(mix_before / greatest(1.0, weight * {float(BLOCK_TOKENS)}))::BIGINT AS mix_block
FROM c WHERE mix_before < budget
"""
