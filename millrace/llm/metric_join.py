"""Embedding near-dedup: an exact metric range join over cells around pivots.

Vectors are brought to length 1, where cosine >= c means a distance of at most
``r = sqrt(2 - 2c)``. Equal vectors of a label are joined first into one with a count.
Every label is split around pivots drawn from it, about one for each CELL vectors: a vector
is at home with its nearest pivot ``p``. By the triangle inequality a partner at home
with ``q`` is no nearer than the bisector of ``p`` and ``q``, which is
``(cos(v, p) - cos(v, q)) / d(p, q)`` away, so ``v`` is copied to ``q`` only if that is at most
``r``; and of two cells one receives the other's copies, so that every pair meets once. Cells
with more than AGAIN vectors at home are split again, as often as that takes; a copy then
goes to every cell within reach. In many dimensions the inequality may spare little; the cells
then share out all pairs of a label, each pair once.

Cells join independently: blocks of what is at home meet each other and the copies, in
jobs of bounded size. Links are counted, never listed; what leaves a job is one edge per row
at most, and components come from those.

Defined results: a vector that is null, zero, or has null or non-finite components, or
whose label is null, links with nothing; so do vectors of different lengths; repeated
rows are vectors of their own and link; a null id has no component id of its own (its
component's least other id, else null) and is not kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.grouping import forest, grouped
from millrace.plans.components import connected_components
from millrace.workspace import Written, mapped, partitions, table

LEAST_COSINE = 0.98
#: Vectors at home with a pivot, about; pivots of a split at most; vectors at home in a cell that is split again; splits.
CELL, PIVOTS, AGAIN, LEVELS = 512, 256, 8192, 8
#: Numbers in a block of vectors at home, and blocks of that size in one of copies.
BLOCK_NUMBERS, COPIES = 1 << 17, 4
SLACK = 1e-9  # for the rounding of distances


def linkable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of the rows that can link."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("unit"))
    return d.where(F.col("label").isNotNull() & F.col("unit").isNotNull() & F.forall("unit", finite) & F.exists("unit", lambda x: x != 0))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles. Divided by the greatest component first, so that no
    square overflows or vanishes."""
    v = vectors.astype(float)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _lists(matrix: np.ndarray) -> pa.Array:
    n, w = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(matrix.ravel()))


def reached(cosines: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and which pivots' cells may hold a partner of it."""
    near = cosines.argmax(1)
    ahead = cosines[np.arange(len(near)), near][:, None] - cosines
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    return near, ahead <= (radius + SLACK) * apart[near] + SLACK


def receives(k: int) -> np.ndarray:
    """Of two cells, which one gets the copies: [from, to]. Every cell gets those of about half the others."""
    ahead = (np.arange(k)[None, :] - np.arange(k)[:, None]) % k
    return (ahead > 0) & ((2 * ahead < k) | (2 * ahead == k) & (np.arange(k)[:, None] < np.arange(k)[None, :]))


def _split(rows: DataFrame, radius: float, level: int) -> DataFrame:
    """``rows`` with their cells split around pivots. A cell's pivots go once to each block of its rows."""
    spark = rows.sparkSession
    large = rows.where("home").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > (AGAIN if level else 1))
    large = Written(large.withColumn("blocks", F.ceil(F.col("n") / AGAIN).cast("long")), "large", few=True).df
    split = rows.join(large, "cell")
    # Drawn by hash, as many as the cell is to have and two more, on average.
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL)) + 2
    drawn = split.where("home").where(F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * wanted / F.col("n"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pivots = drawn.select("cell", "rep", "unit", F.lit(0).alias("side"), F.lit(0).cast("long").alias("mult"), every.alias("b"))
    moving = split.select("cell", "rep", "unit", F.when(F.col("home"), 1).otherwise(2).alias("side"), "mult", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).alias("b"))
    at = F.pmod(F.xxhash64("cell") + F.col("b"), F.lit(partitions(spark))).cast("int")
    jobs = pivots.unionByName(moving).select(at.alias("at"), F.xxhash64("cell", "b").alias("job"), "cell", "side", "rep", "mult", "unit")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (g for groups in grouped(batches) for g in groups):
            at, row = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] > 0)
            order = at[np.argsort(g["rep"][at])]
            pivot = units(np.stack([g["unit"][k] for k in order])) if len(order) else None
            to_copy = receives(len(order))
            for k in range(0, len(row), 8192):
                part = row[k : k + 8192]
                unit = np.stack([g["unit"][j] for j in part])
                if pivot is None:  # none was drawn: the cell stays as it is
                    r, home, to = np.arange(len(part)), g["side"][part] == 1, np.zeros(len(part), np.int64)
                else:
                    near, within = reached(units(unit) @ pivot.T, pivot, radius)
                    own = g["side"][part] == 1
                    within &= ~own[:, None] | to_copy[near]
                    within[np.arange(len(part)), near] = True
                    r, q = np.nonzero(within)
                    home, to = own[r] & (near[r] == q), g["rep"][order[q]]
                for n in range(0, len(r), 8192):
                    x = r[n : n + 8192]
                    at = part[x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g["cell"][at]), pa.array(to[n : n + 8192]), pa.array(g["rep"][at]), pa.array(g["mult"][at]), _lists(unit[x]), pa.array(home[n : n + 8192])],
                        names=["cell", "pivot", "rep", "mult", "unit", "home"],
                    )

    spread = jobs.repartitionById(partitions(spark), "at").drop("at").sortWithinPartitions("job")
    spread = mapped(spread, assign, f"cell long, pivot long, rep long, mult long, unit {rows.schema['unit'].dataType.simpleString()}, home boolean")
    kept = rows.join(large, "cell", "left_anti").select("cell", "rep", "mult", "unit", "home")
    return kept.unionByName(spread.select(F.xxhash64("cell", F.lit(level), "pivot").alias("cell"), "rep", "mult", "unit", "home"))


def cells(rows: DataFrame, radius: float) -> DataFrame:
    """(cell, rep, mult, unit, home): every row at home in one cell, and its copies."""
    for level in range(LEVELS):
        split = Written(_split(rows, radius, level), "cells").df
        most = split.where("home").groupBy("cell").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        rows = split
        if most <= AGAIN:
            break
    return rows


def _jobs(rows: DataFrame) -> DataFrame:
    """(job, side, rep, mult, unit), dealt and sorted: side 2 is a block at home that meets
    itself; sides 0 and 1 are two blocks that meet."""
    n = partitions(rows.sparkSession)
    size = rows.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum((~F.col("home")).cast("long")).alias("c"), F.max(F.size("unit")).alias("dim"))
    block = F.greatest(F.lit(16), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")))
    size = size.where("h > 0").select("cell", F.ceil(F.col("h") / block).cast("long").alias("hb"), F.ceil(F.col("c") / (block * COPIES)).cast("long").alias("cp"))
    d = rows.join(Written(size, "sizes", few=True).df, "cell").withColumn("x", F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("home"), F.col("hb")).otherwise(F.col("cp"))))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<long>"))
    pair = lambda a, b: (F.greatest(a, b) * (F.greatest(a, b) + 1) / 2).cast("long") + F.least(a, b)
    copied = lambda a, j: pair(F.col("hb"), F.lit(0)) + a * F.col("cp") + j
    job = lambda at, side: F.struct(at.alias("at"), side.cast("int").alias("side"))
    x = F.col("x")
    at_home = F.concat(
        F.transform(upto("hb"), lambda o: job(pair(x, o), F.when(x == o, 2).when(x > o, 1).otherwise(0))),
        F.transform(upto("cp"), lambda j: job(copied(x, j), F.lit(0))),
    )
    d = d.withColumn("j", F.explode(F.when(F.col("home"), at_home).otherwise(F.transform(upto("hb"), lambda a: job(copied(a, x), F.lit(1))))))
    at = F.pmod(F.xxhash64("cell") + F.col("j.at"), F.lit(n)).cast("int")
    d = d.select(at.alias("at"), F.xxhash64("cell", "j.at").alias("job"), "j.side", "rep", "mult", "unit")
    return d.repartitionById(n, "at").drop("at").sortWithinPartitions("job")


def _join_blocks(least: float):
    """Links of both blocks of a job, and edges between what is linked."""

    def one(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        i, j = np.flatnonzero(g["side"] != 1), np.flatnonzero(g["side"] != 0)
        if not (len(i) and len(j)):
            return None
        unit, rep, mult = units(np.stack(g["unit"])), g["rep"], g["mult"]
        linked = unit[i] @ unit[j].T >= least
        linked &= rep[i][:, None] != rep[j][None, :]
        if not linked.any():
            return None
        ids, n = rep[i], linked @ mult[j]
        if g["side"][0] != 2:
            ids, n = np.concatenate([ids, rep[j]]), np.concatenate([n, mult[i] @ linked])
        some = np.flatnonzero(n)
        return ids[some], n[some], forest(linked, rep[i], rep[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches, at_once=64):
            found = [x for x in map(one, groups) if x is not None]
            if not found:
                continue
            rep, n, edges = (np.concatenate([x[k] for x in found]) for k in range(3))
            none = pa.nulls(max(len(rep), len(edges)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep, edges[:, 0]])), pa.concat_arrays([none[: len(rep)], pa.array(edges[:, 1])]), pa.concat_arrays([pa.array(n.astype(np.int64)), none[: len(edges)]])],
                names=["u", "v", "n"],
            )

    return run


def range_join(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """``key``, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    good = linkable(df, key, vector, label)
    good = Written(good.withColumn("code", F.md5(F.to_json(F.struct("label", "unit")))), "vectors").df
    # Equal vectors of a label: one row with its count.
    reps = good.groupBy("code").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    whole = Written(reps.select(F.xxhash64("code").alias("rep"), "id", "mult", F.xxhash64("label", F.size("unit")).alias("cell"), "unit"), "reps").df
    rows = whole.select("cell", "rep", "mult", "unit", F.lit(True).alias("home"))
    jobs = _jobs(cells(rows, math.sqrt(max(0.0, 2 - 2 * least))))
    found = Written(mapped(jobs, _join_blocks(least), "u long, v long, n long"), "links").df
    links = found.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    member = whole.select("rep", "id", "mult").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.withColumn("component", F.coalesce("component", "rep"))
    # Written before its join: a key is split only where both sides come straight from a shuffle.
    least_id = Written(member.groupBy("component").agg(F.min("id").alias("component_id")), "least", few=True).df
    member = member.join(least_id, "component").select("rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = good.select("id", F.xxhash64("code").alias("rep")).join(member, "rep").select("id", "n_links", "component_id")
    alone = _alone(df, key, vector, label)
    out = linked.union(alone.select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _alone(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """The rows that :func:`linkable` leaves out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= F.lit(float("inf")))
    d = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("_l"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("_e"))
    return d.where(F.col("_l").isNull() | F.col("_e").isNull() | F.exists("_e", bad) | F.forall("_e", lambda x: x == 0)).select("id")


def op2_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))
