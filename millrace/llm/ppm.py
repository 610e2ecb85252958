"""LM scoring: prediction by partial matching over bytes, pretrained on a fold.

A text is its words, A-Z lower-cased, each followed by one space, then one end byte; the
model gives every byte a probability after the ORDER bytes before it. The context trie
is a table of byte n-grams with counts from the training fold, one table for each length;
its nodes are the n-grams' prefixes. A byte seen after the longest context has
``(2c - 1) / 2T`` there (T: what followed, Q: how many kinds); else the model escapes with
``Q / 2T`` to the context one byte shorter, where the bytes that the longer one has
seen are excluded from T and Q; below order 0 the bytes left are equally likely. The
probability thus depends on the last ORDER + 1 bytes alone and is worked out once for
each distinct n-gram.

Texts are dealt to blocks by a hash of id and text, and blocks to tasks by number; rows that
are equal in both are one block's work. Each block is counted alone and hands on its
distinct words and n-grams with their counts: that, not the tokens, is what is shuffled.
Totals and probabilities go back to the blocks that asked, and each block scores its texts
against tables of its own vocabulary. The tables are as large as the corpus makes them
and are held on the executors only.

Defined results: a null text is empty; an empty text is its end token alone; repeated
rows are scored each; a null id counts as the text ``null`` for its fold; with no
training rows N and V are 0, every base probability is 1, and every byte has 1/256; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import bucket_of
from millrace.workspace import Written, mapped, slots, table

ORDER = 4
FOLDS, HELD = 7, 2
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 64
END = b"\0"
#: Words have the key's top bit; n-grams of ORDER + 1 bytes do not.
END_KEY = -(1 << 63)


def word_key(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word) >> 1 | 1 << 63) - (1 << 64) if word else END_KEY


def grams_of(stream: bytes) -> np.ndarray:
    """The ORDER + 1 bytes that end at each byte of the stream, packed; ORDER end bytes stand before it."""
    a = np.frombuffer(END * ORDER + stream, np.uint8)
    out = np.zeros(len(stream), np.int64)
    for j in range(ORDER + 1):
        out <<= 8
        out |= a[j : j + len(stream)]
    return out


def serialise(words: list[bytes]) -> bytes:
    return b" ".join(words) + (b" \0" if words else END)


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n) of rows sorted by block: distinct words and n-grams with their
    training counts, 0 for those of other texts alone."""
    block, words, seen, grams, waiting, size = None, Counter(), set(), [], [[], []], 0

    def fold() -> None:
        nonlocal size
        for learn in (0, 1):
            if waiting[learn]:
                # A text's start sees end bytes only: each stream brings its own.
                g = grams_of(b"".join(END * ORDER + s for s in waiting[learn]))
                lengths = np.array([len(s) + ORDER for s in waiting[learn]])
                keep = np.ones(len(g), bool)
                starts = np.cumsum(lengths) - lengths
                keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
                u, n = np.unique(g[keep], return_counts=True)
                grams.append((u, n if learn else np.zeros(len(u), np.int64)))
                waiting[learn].clear()
        size = 0
        if len(grams) > 8:
            grams[:] = [merge()]

    def merge() -> tuple[np.ndarray, np.ndarray]:
        u, back = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
        return u, np.bincount(back, np.concatenate([n for _, n in grams]), len(u)).astype(np.int64)

    def emit() -> Iterator[pa.RecordBatch]:
        fold()
        if not grams:
            return
        u, n = merge()
        key = np.fromiter((word_key(w) for w in seen), np.int64, len(seen))
        m = np.fromiter((words[w] for w in seen), np.int64, len(seen))
        key, m = np.concatenate([u, key]), np.concatenate([n, m])
        for k in range(0, len(key), 65_536):
            part = key[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(part), pa.array(m[k : k + 65_536])], names=["block", "key", "n"])
        words.clear(), seen.clear(), grams.clear()

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        learns = batch.column(1).to_numpy(zero_copy_only=False)
        for k, text in enumerate(batch.column(2)):
            if blocks[k] != block:
                if block is not None:
                    yield from emit()
                block = int(blocks[k])
            w = text.as_py().lower().split()
            s = serialise(w)
            w.append(b"")
            if learns[k]:
                words.update(w)
            seen.update(w)
            waiting[int(learns[k])].append(s)
            size += len(s)
            if size > 4 << 20:
                fold()
    if block is not None:
        yield from emit()


def _log_probability(grams: DataFrame) -> DataFrame:
    """(key, lp): log10 of the last byte's probability, for each n-gram of ``grams(key, n)``.

    Seen n-grams of each length, and their contexts with T, Q and X: what the bytes seen
    after a context have after the context one byte shorter."""
    size = {k: 256**k for k in range(ORDER + 2)}
    seen: dict[int, DataFrame] = {ORDER + 1: grams.where("n > 0").select(F.col("key").alias("g"), F.col("n").alias("c"))}
    for k in range(ORDER, 0, -1):
        seen[k] = Written(seen[k + 1].groupBy(F.pmod("g", F.lit(size[k])).alias("g")).agg(F.sum("c").alias("c")), "seen").df
    out = grams.select("key")
    for k in range(ORDER, -1, -1):
        known = seen[k + 1]
        if k:
            lower = seen[k].select(F.col("g").alias("low"), F.col("c").alias("below"))
            known = known.withColumn("low", F.pmod("g", F.lit(size[k]))).join(lower, "low")
        else:
            known = known.withColumn("below", F.lit(0).cast("long"))
        context = known.groupBy(F.shiftright("g", 8).alias(f"ctx{k}")).agg(F.sum("c").alias(f"T{k}"), F.count("*").alias(f"Q{k}"), F.sum("below").alias(f"X{k}"))
        out = out.withColumn(f"g{k}", F.pmod("key", F.lit(size[k + 1]))).withColumn(f"ctx{k}", F.shiftright(f"g{k}", 8))
        out = out.join(seen[k + 1].select(F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}")), f"g{k}", "left").join(context, f"ctx{k}", "left").drop(f"g{k}", f"ctx{k}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # From the shortest context up: what a byte has if every longer one escaped to here.
    lp: Column = -F.log10(F.greatest(F.lit(1), 256 - zero("Q0")))
    for k in range(ORDER + 1):
        longer = k < ORDER
        t = zero(f"T{k}") - (zero(f"X{k + 1}") if longer else 0)
        q = zero(f"Q{k}") - (zero(f"Q{k + 1}") if longer else 0)
        lp = F.when(zero(f"c{k}") > 0, F.log10((2 * zero(f"c{k}") - 1) / (2 * t))).when(q > 0, F.log10(q / (2 * t)) + lp).otherwise(lp)
    return out.select("key", lp.alias("lp"))


class _Tables:
    """A block's vocabulary: what its n-grams and words are worth."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, n: np.ndarray, lp: np.ndarray) -> None:
        self.parts.append((key, n, lp))

    def seal(self) -> None:
        key, n, lp = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        self.parts.clear()
        words = key < 0
        self.count = dict(zip(key[words].tolist(), n[words].tolist(), strict=True))
        order = np.argsort(key[~words])
        self.gram, self.lp = key[~words][order], lp[~words][order]
        self.known: dict[bytes, int] = {}
        self._trie()

    def _trie(self) -> None:
        """Child tables over the block's own bytes: node times width, plus byte, gives the child."""
        used = np.unique(np.concatenate([(self.gram >> 8 * j) & 255 for j in range(ORDER + 1)]))
        self.code = np.full(256, 0, np.int64)
        self.code[used] = np.arange(len(used))
        self.width, self.child = len(used), []
        node, n = np.zeros(len(self.gram), np.int64), 1
        for j in range(ORDER, -1, -1):
            if n * self.width > 1 << 25:  # too sparse for tables: by binary search instead
                self.child = None
                return
            edge = node * self.width + self.code[(self.gram >> 8 * j) & 255]
            at = np.unique(edge)
            child = np.zeros(n * self.width, np.int32)
            child[at] = np.arange(len(at))
            node, n = child[edge].astype(np.int64), len(at)
            self.child.append(child)

    def bytes_lp(self, stream: bytes) -> np.ndarray:
        """Of each byte of a stream; bytes whose n-gram is not the block's get any value."""
        if self.child is None:
            return self.lp[np.minimum(np.searchsorted(self.gram, grams_of(stream)), len(self.gram) - 1)]
        a = self.code[np.frombuffer(END * ORDER + stream, np.uint8)]
        node = np.zeros(len(stream), np.int64)
        for j, child in enumerate(self.child):
            node = child[node * self.width + a[j : j + len(stream)]].astype(np.int64)
        return self.lp[node]

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        known, count = self.known, self.count
        for w in set(words).difference(known):
            known[w] = count[word_key(w)]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _score_blocks(total: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tables, sealed = None, _Tables(), False
        waiting: list[tuple[int | None, bool, list[bytes]]] = []

        def score() -> pa.RecordBatch:
            streams = [serialise(w) for _, _, w in waiting]
            size = np.array([len(s) + ORDER for s in streams])
            lp = tables_lp(tables, streams, size)
            counts = [tables.word_counts([*w, b""]) for _, _, w in waiting]
            n = np.array([len(c) for c in counts])
            c = np.concatenate(counts)
            starts = np.cumsum(n) - n
            base = np.add.reduceat(np.log10((c + 1) / (total + kinds + 1)), starts)
            known = np.add.reduceat((c > 0).astype(np.int64), starts)
            ids = pa.array([i for i, _, _ in waiting], pa.int64())
            held = pa.array([h for _, h, _ in waiting], pa.bool_())
            waiting.clear()
            return pa.RecordBatch.from_arrays([ids, held, pa.array(n), pa.array(known), pa.array(base), pa.array(lp)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        bytes_waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            blocks = col["block"].to_numpy(zero_copy_only=False)
            kind = col["kind"].to_numpy(zero_copy_only=False)
            for at in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks) | np.diff(kind)) + 1):
                a, n = int(at[0]), len(at)
                if blocks[a] != block:
                    if waiting:
                        yield score()
                        bytes_waiting = 0
                    block, tables, sealed = blocks[a], _Tables(), False
                part = {k: c.slice(a, n) for k, c in col.items()}
                if kind[a] == 0:
                    tables.add(*(part[k].to_numpy(zero_copy_only=False) for k in ("key", "n", "lp")))
                    continue
                if not sealed:
                    tables.seal()
                    sealed = True
                for i, h, t in zip(part["doc_id"].to_pylist(), part["held"].to_pylist(), part["text"], strict=True):
                    raw = t.as_py()
                    waiting.append((i, h, raw.lower().split()))
                    bytes_waiting += len(raw)
                    if bytes_waiting > 2 << 20:
                        yield score()
                        bytes_waiting = 0
        if waiting:
            yield score()

    return run


def tables_lp(tables: _Tables, streams: list[bytes], size: np.ndarray) -> np.ndarray:
    """Sum of the bytes' log10 probabilities of each stream."""
    whole = b"".join(END * ORDER + s for s in streams)
    starts = np.cumsum(size) - size
    # A text's start sees end bytes only: each stream brings its own, which count nothing.
    lead = (starts[:, None] + np.arange(ORDER)).ravel()
    lp = tables.bytes_lp(whole)
    lp[lead] = 0
    return np.add.reduceat(lp, starts)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    volume = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(LEAST_BLOCKS, slots(spark) * 4, -(-volume // BLOCK_BYTES))
    d = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), (bucket_of(F.col("doc_id"), FOLDS) == HELD).alias("held"), "doc_id", "text")
    asked = d.select("block", (~F.col("held")).cast("int").alias("learn"), "text").repartitionById(blocks, "block").sortWithinPartitions("block")
    asked = mapped(asked, _count_blocks, "block int, key long, n long")
    asked = Written(asked, "asked").df
    totals = asked.groupBy("key").agg(F.sum("n").alias("n"))
    totals = Written(totals, "totals").df
    words = totals.where("key < 0")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    worth = _log_probability(totals.where("key >= 0").select("key", "n")).select("key", F.lit(0).cast("long").alias("n"), "lp").union(words.select("key", "n", F.lit(0.0)))
    back = asked.select("block", "key").join(worth, "key")
    rows = back.select("block", F.lit(0).alias("kind"), "key", "n", "lp", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held"), F.lit(None).cast("binary").alias("text"))
    texts = d.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("lp"), "doc_id", "held", "text")
    scored = mapped(
        rows.union(texts).repartitionById(blocks, "block").sortWithinPartitions("block", "kind"), _score_blocks(total, kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
