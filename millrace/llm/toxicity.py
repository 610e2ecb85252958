"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words and their prefixes of four to six letters, hashed to
2**20 buckets; prefixes let inflected forms share weight. The model adds to every linear
weight the inner products of pairs of term vectors, so a pair such as an insult and the
mention of a group counts beyond its parts.

Training uses a bounded sample of labelled rows outside the held-out fold, the
``sample`` rows of least hashed id (a documented parameter, 10,000). Every bucket that
LEAST_ROWS sampled rows hold is a feature, whatever it says by itself, so a pair of words
that are neutral alone can be learned; beyond that only L2 prunes. The penalty of a linear weight is ``SURE`` for a
bucket that speaks surely for the toxic class and ``NEUTRAL`` mean texts' terms for all
others (what speaks against it is mostly the language or the length of a text); the
penalty of the pair vectors is ``PAIR`` mean texts' terms, more than learning a single
text by heart gains. The machine is fitted on the driver. Every text is scored whole.
Labels, language, source and id are no inputs.

Defined results: a null or empty text has no terms and scores the bias; repeated rows
score alike; labels that are null, or of no document, teach nothing; of several labels of
a document the greatest counts; with no labels, or labels of one class, there are no
terms and the score is the smoothed share of toxic rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import bucket_of, free_names, pieces, strings
from millrace.workspace import Written, give_back, mapped, spread, table

BITS = 20
SAMPLE, FACTORS = 10_000, 8
LEAST_ROWS = 3
#: Words whose terms a task remembers.
KNOWN_WORDS = 200_000
#: L2: of a linear weight with evidence; of one without, and of pair vectors, in terms of a mean text.
SURE, NEUTRAL, PAIR = 1.0, 0.5, 1.0
#: Share of the weights' rate at which pair vectors learn: early steps are as large as the rate, and a text has many pairs.
CARE = 0.2
#: Evidence of a bucket: deviations of its log odds from none, the log odds, sampled rows.
LEAST_Z, LEAST_ODDS, LEAST_DOCS = 3.0, 1.5, 3
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
_LETTERS = re.compile(r"[^\W\d_]+")
_MASK = (1 << BITS) - 1


def word_buckets(words: list[str]) -> np.ndarray:
    """Buckets of each word: of itself and of its first four, five and six letters; -1 if it has fewer."""
    out = np.full((len(words), 4), -1, np.int64)
    if not words:
        return out
    out[:, 0] = [xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) & _MASK for w in words]
    letters = np.array(words, "U6").view(np.uint32).reshape(-1, 6).astype(np.uint64)
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(6):
        h = (h ^ letters[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        if k >= 3:
            out[:, k - 2] = np.where(letters[:, k] > 0, (h & np.uint64(_MASK)).astype(np.int64), -1)
    return out


def text_words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def text_terms(text: str) -> np.ndarray:
    found = np.unique(word_buckets(list(text_words(text))))
    return found[found >= 0].astype(np.int32)


class _Sums:
    """Sums of ``source[at]`` over consecutive segments, a chunk at a time."""

    def __init__(self, at: np.ndarray, size: np.ndarray, chunk: int = 1 << 19):
        self.at, self.n, self.full = at, len(size), np.flatnonzero(size)
        begin = (np.cumsum(size) - size)[self.full]
        cuts = np.flatnonzero(np.diff(begin // chunk)) + 1 if len(begin) else []
        self.parts = [(b[0], e, k, b - b[0]) for b, e, k in zip(np.split(begin, cuts), [*(begin[c] for c in cuts), len(at)], np.split(self.full, cuts), strict=True) if len(b)]

    def __call__(self, source: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, source.dtype)
        for a, b, segments, begin in self.parts:
            out[segments] = np.add.reduceat(source[self.at[a:b]], begin)
        return out


class FactorizationMachine:
    """Second-order, logistic, over binary features; terms are numbered from 0."""

    def __init__(self, n: int, factors: int = FACTORS, seed: int = 7):
        self.b, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, factors)).astype(np.float32)

    def logits(self, at: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """at: term numbers; row: the row of each, ascending."""
        z = np.full(n_rows, self.b)
        size = np.bincount(row, minlength=n_rows)
        some = np.flatnonzero(size)
        if len(some):
            # All pairs of a row: half of (the sum's square less the squares' sum).
            alone = self.w.astype(np.float64) - 0.5 * (self.v.astype(np.float64) ** 2).sum(1)
            begin = (np.cumsum(size) - size)[some]
            total = np.add.reduceat(self.v[at], begin, axis=0, dtype=np.float64)
            z[some] += np.add.reduceat(alone[at], begin) + 0.5 * (total * total).sum(1)
        return z

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 60, rate: float = 0.05, l2: np.ndarray | float = SURE) -> FactorizationMachine:
        """Adam on the whole sample; ``l2`` is of the linear weights. The same rows give the same weights."""
        n, factors = self.v.shape
        size = np.array([len(r) for r in rows])
        at = np.concatenate(rows).astype(np.int32)
        of_rows = _Sums(at, size)
        of_terms = _Sums(np.repeat(np.arange(len(rows), dtype=np.int32), size)[np.argsort(at, kind="stable")], np.bincount(at, minlength=n))
        self.b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        params = np.vstack([self.w[None], self.v.T])
        m, s, bm, bs = np.zeros_like(params), np.zeros_like(params), 0.0, 0.0
        with ThreadPoolExecutor(4) as pool:
            for t in range(1, epochs + 1):
                squares = (params[1:] ** 2).sum(0)
                linear, square, *total = pool.map(of_rows, [params[0], squares, *params[1:]])
                z = self.b + linear + 0.5 * (sum(a * a for a in total) - square)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
                alone = of_terms(e)

                def step(f: int) -> None:
                    p = params[f]
                    g = alone + l2 * p if f == 0 else of_terms(e * total[f - 1]) + (PAIR * size.mean() - alone) * p
                    m[f] += 0.1 * (g - m[f])
                    s[f] += 0.01 * (g * g - s[f])
                    p -= (rate if f == 0 else rate * CARE) * (m[f] / (1 - 0.9**t)) / (np.sqrt(s[f] / (1 - 0.99**t)) + 1e-3)

                list(pool.map(step, range(factors + 1)))
                g = float(e.sum())
                bm, bs = bm + 0.1 * (g - bm), bs + 0.01 * (g * g - bs)
                self.b -= rate * (bm / (1 - 0.9**t)) / (np.sqrt(bs / (1 - 0.99**t)) + 1e-8)
        self.w, self.v = params[0].copy(), np.ascontiguousarray(params[1:].T)
        return self


class Scorer:
    """A fitted machine with the buckets its terms stand for."""

    def __init__(self, buckets: np.ndarray, machine: FactorizationMachine):
        #: The term of each bucket, -1 if it has none; one more for no bucket.
        self.number = np.full((1 << BITS) + 1, -1, np.int32)
        self.number[buckets] = np.arange(len(buckets), dtype=np.int32)
        self.machine = machine

    def learn(self, words: list[str], known: dict[str, list[int]]) -> None:
        """The terms of words, each with those that it has."""
        terms = self.number[word_buckets(words)]
        some = terms >= 0
        ends = np.cumsum(some.sum(1)).tolist()
        flat, at = terms[some].tolist(), 0
        for w, end in zip(words, ends, strict=True):
            known[w] = flat[at:end]
            at = end

    def score(self, texts: list[str], known: dict[str, list[int]]) -> np.ndarray:
        words = [text_words(t) for t in texts]
        self.learn(list(set().union(*words).difference(known)), known)
        at: list[int] = []
        size = np.zeros(len(texts), np.int64)
        for k, ws in enumerate(words):
            found = sorted(set().union(*map(known.__getitem__, ws)))
            at += found
            size[k] = len(found)
        z = self.machine.logits(np.array(at, np.int64), np.repeat(np.arange(len(texts)), size), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sample_terms(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> Written:
    """(y, terms) of the sampled rows."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (bucket_of(F.col(key), FOLDS) != HELD))
        .groupBy(F.col(key).cast("long").alias("_k"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t"):
                terms = [text_terms(t) for t in strings(piece, "t")]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(terms, pa.list_(pa.int32()))], names=["y", "terms"])

    # The sample's size is bounded by the parameter, so its ids can be broadcast.
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("t")).join(F.broadcast(chosen), "_k").select("y", "t")
    return Written(mapped(rows, run, "y int, terms array<int>"), "toxic-sample")


def _penalty(at: np.ndarray, size: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """L2 of each linear weight: little with evidence for the toxic class, much without."""
    both = np.bincount(at, minlength=n)
    toxic = np.bincount(at[np.repeat(y > 0, size)], minlength=n)
    clean, all_toxic, all_clean = both - toxic, (y > 0).sum(), (y == 0).sum()
    odds = np.log((toxic + 0.5) / (all_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (all_clean - clean + 0.5))
    z = odds / np.sqrt(sum(1 / (c + 0.5) for c in (toxic, clean, all_toxic - toxic, all_clean - clean)))
    sure = (z >= LEAST_Z) & (odds >= LEAST_ODDS) & (both >= LEAST_DOCS)
    return np.where(sure, SURE, max(SURE, NEUTRAL * size.mean())).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """A scorer from a bounded sample of labelled rows."""
    rows = _sample_terms(docs, labels, key, text, label, sample)
    got = rows.df.toArrow().combine_chunks()  # at most ``sample`` rows
    rows.drop()
    y = (got["y"].to_numpy() > 0).astype(float)
    toxic, clean = y.sum(), len(y) - y.sum()
    if not (toxic and clean):
        machine = FactorizationMachine(0)
        machine.b = float(np.log((toxic + 0.5) / (clean + 0.5)))
        return Scorer(np.zeros(0, np.int64), machine)
    terms = [r.values.to_numpy() for r in got["terms"].combine_chunks()]
    order = sorted(range(len(y)), key=lambda k: (y[k], len(terms[k]), zlib.crc32(terms[k].tobytes()), terms[k].tobytes()[:64]))
    y, terms = y[order], [terms[k] for k in order]
    del got
    rows_with = np.zeros(1 << BITS, np.int32)
    for t in terms:  # a row's terms are distinct
        rows_with[t] += 1
    there = rows_with >= LEAST_ROWS
    buckets, number = np.flatnonzero(there), np.cumsum(there, dtype=np.int32) - 1
    terms = [number[t[there[t]]] for t in terms]
    size, at = np.array([len(t) for t in terms]), np.concatenate(terms)
    del terms
    machine = FactorizationMachine(len(buckets))
    machine.fit(np.split(at, np.cumsum(size)[:-1]), y, l2=_penalty(at, size, y, len(buckets)))
    scorer = Scorer(buckets, machine)
    give_back()
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """``key`` and score; with ``whole_rows`` all columns of ``docs`` and ``_score``."""
    docs = spread(docs if whole_rows else docs.select(key, text))
    name = free_names(docs.columns, "score")[0] if whole_rows else "score"
    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema.fields)).add(name, "double")
    if not whole_rows:
        schema = docs.select(key).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for piece in pieces(batch, text):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                s = pa.array(scorer.score(strings(piece, text), known))
                cols = piece.columns if whole_rows else [piece.column(0)]
                yield pa.RecordBatch.from_arrays([*cols, s], names=schema.names)

    return mapped(docs, run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, scorer).select(
        "doc_id",
        (bucket_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that are not toxic. The model learns from labelled rows of
    ``docs`` itself, so each run of the stage is about its own input."""
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, scorer, whole_rows=True)
    return scored.where(F.col(scored.columns[-1]) < THRESHOLD).select(*docs.columns)
