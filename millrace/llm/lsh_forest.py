"""N-gram Jaccard join: an LSH forest of MinHash signatures, then exact verification.

Texts are sets of shingles of five words (lower-cased; a text of fewer words is one
shingle). Texts of equal words are one class, found first. Every class has a label in each of
TREES trees: its minima, the first ``roots`` of them as one hash, which deals the labels out,
and EXTRA more, by which those of a root are sorted. So a root's labels lie together in the
order of a prefix trie, and every shared prefix is a run of them. ``roots`` is the longest
prefix by which the forest finds any pair at the threshold with the target recall
(:func:`prefix_depth`); a pair of greater similarity mostly shares more.

A trie is walked from its full labels up. Under each prefix, pairs are screened by one bit of
each minimum (a cut five deviations below the threshold), and joined by edges, one for each
class that is joined at most. Each tree also says, from the screened pairs of each
prefix length, how many pairs there must be and how many all trees together miss at that
length (a pair of similarity s is met by ``TREES * s**depth`` trees on average, and by
none with ``(1 - s**depth)**TREES``). The matched prefix is then shortened, from the full
label, until the recall measured so over the whole corpus reaches the target, at ``roots`` at
the latest.

A prefix of many classes is read in blocks. A block's pairs are screened among themselves and
with the leaders of what came before: each class read is a leader or passes the screen with
one, so by the triangle inequality of Jaccard distance a partner of it is within reach of that
leader at ``screen + threshold - 1``. Candidates make groups; pairs are never listed. Every
group's shingle sets meet, two blocks of a group at a time, each pair once, and Jaccard is
computed exactly: links are counted there, and the classes' components come from one edge per
class.

Defined results: a null text is empty; a text without words links with nothing, not even
with its like; copies link with each other; repeated rows count as documents of their
own; a null id takes part but is nobody's class id (a class of null ids alone has none);
other columns are not read, and pass through :func:`drop_near_copies` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.grouping import blocks, forest, grouped
from millrace.llm.text import free_names, pieces
from millrace.plans.components import connected_components
from millrace.workspace import Written, mapped, partitions, spread, table

WORDS, THRESHOLD = 5, 0.8
#: Minima of a label beyond its root's; of 16 bits each.
TREES, EXTRA, RECALL = 36, 2, 0.9999
#: Classes of a block under a prefix; classes and shingles of a verified block.
SCREENED, BLOCK, BLOCK_SHINGLES = 1024, 1024, 1 << 18
#: Rows (of some 100 bytes) of a table of ids that is broadcast.
BROADCAST_ROWS = 200_000
#: Words whose hashes a task remembers, and the longest of them.
KNOWN_WORDS, KNOWN_BYTES = 200_000, 64


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest shared prefix by which ``trees`` trees find a pair at the threshold with the target recall."""
    depth = 1
    while depth < 32 and 1 - (1 - threshold ** (depth + 1)) ** trees >= recall:
        depth += 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Hashed shingles of texts; remembers words' hashes up to a bound."""

    def __init__(self, words: int = WORDS):
        self.k, self.known = words, {}
        rng = np.random.default_rng(20)
        self.odd = rng.integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def words(self, text: bytes) -> list[bytes]:
        return text.lower().split() if text.isascii() else text.decode("utf-8", "replace").lower().encode().split()

    def shingles(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' shingles in one array, and how many each text has (repeats included)."""
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        flat = [w for ws in lists for w in ws]
        new = set(flat).difference(known)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        for w in new:
            if len(w) > KNOWN_BYTES:
                del known[w]
        size = np.array([len(ws) for ws in lists], np.int64)
        n = np.where(size >= self.k, size - self.k + 1, np.minimum(size, 1))
        first = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        padded = np.concatenate([h, np.zeros(self.k, np.uint64)])
        out = np.zeros(len(first), np.uint64)
        inside = np.repeat(size, n)  # words of a short text end before the window does
        for j in range(self.k):
            w = padded[first + j] * self.odd[j]
            out += w if j == 0 else np.where(inside > j, w, np.uint64(j))
        return _mixed(out), n


class Signer:
    def __init__(self, trees: int, roots: int):
        rng = np.random.default_rng(21)
        self.trees, self.roots, self.depth = trees, roots, roots + EXTRA
        self.flip = rng.integers(0, 1 << 32, trees * self.depth, np.uint32)
        self.odd = rng.integers(0, 1 << 31, trees * self.depth, np.uint32) * np.uint32(2) + np.uint32(1)

    def sign(self, shingles: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text (all have shingles): each tree's root, the minima after it (16 bits
        each, the first highest), and one bit of each minimum, packed."""
        starts = np.cumsum(n) - n
        s = (shingles >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(s)
        least = np.empty((len(n), self.trees * self.depth), np.uint32)
        for k in range(self.trees * self.depth):
            np.bitwise_xor(s, self.flip[k], out=v)
            np.multiply(v, self.odd[k], out=v)
            least[:, k] = np.minimum.reduceat(v, starts)
        roots = np.empty((len(n), self.trees), np.uint64)
        tails = np.zeros((len(n), self.trees), np.int64)
        for t in range(self.trees):
            h = np.full(len(n), t + 1, np.uint64)
            for k in range(t * self.depth, t * self.depth + self.roots):
                h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
            roots[:, t] = h
            for k in range(t * self.depth + self.roots, (t + 1) * self.depth):
                tails[:, t] = tails[:, t] << 16 | (_mixed(least[:, k].astype(np.uint64)) >> np.uint64(48)).astype(np.int64)
        bits = (_mixed(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        return roots.view(np.int64), tails, np.packbits(bits, axis=1)


def _sign(roots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer(TREES, roots)
        lists_of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TREES), pa.array(x.ravel()))
        for batch in batches:
            for piece in pieces(batch, "text", 512 << 10):
                lists = [shingler.words(t.as_py() or b"") for t in piece.column(2)]
                some = np.array([bool(ws) for ws in lists])
                code = pa.array([xxhash.xxh3_128_digest(b" ".join(ws)) for ws in lists], pa.binary())
                root, tail = np.zeros((2, len(lists), TREES), np.int64)
                bits = np.zeros((len(lists), (TREES * signer.depth + 7) // 8), np.uint8)
                if some.any():
                    root[some], tail[some], bits[some] = signer.sign(*shingler.shingles([ws for ws in lists if ws]))
                size = pa.array([len(ws) for ws in lists], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), code, pa.array(some), size, lists_of(root), lists_of(tail), pa.array([bytes(b) for b in bits], pa.binary())],
                    names=["id", "mark", "code", "some", "size", "roots", "tails", "bits"],
                )

    return run


class _Root:
    """The classes under one root, in the order of their labels, block by block."""

    def __init__(self, threshold: float, roots: int):
        self.threshold, self.roots, self.width = threshold, roots, TREES * (roots + EXTRA)
        slack = 5 * np.sqrt((1 + threshold) * (1 - threshold) / self.width)
        self.near = threshold - slack
        self.reach = max(-1.0, self.near + threshold - 1 - slack)
        self.lead_bits = np.empty((0, self.width), np.float32)
        self.lead_rep, self.lead_tail = np.empty(0, np.int64), np.empty(0, np.int64)
        self.edges: list[np.ndarray] = []
        self.pairs, self.missed = np.zeros(EXTRA + 1), np.zeros(EXTRA + 1)

    def add(self, g: dict) -> None:
        rep, tail = g["rep"], g["tail"]
        order = np.lexsort((rep, tail))
        rep, tail = rep[order], tail[order]
        raw = np.frombuffer(b"".join(g["bits"]), np.uint8).reshape(len(rep), -1)[order]
        bits = np.unpackbits(raw, axis=1, count=self.width).astype(np.float32) * 2 - 1
        alike = bits @ bits.T / self.width  # the estimate of similarity
        self.count(alike)
        near = alike >= self.near
        self.walk(np.triu(near, 1), rep, tail)  # each pair once
        near &= self.same(tail, tail, EXTRA)
        led = np.zeros(len(rep), bool)
        if len(self.lead_rep):
            alike = bits @ self.lead_bits.T / self.width
            self.join(alike >= self.reach, rep, tail)
            led = ((alike >= self.near) & self.same(tail, self.lead_tail, EXTRA)).any(1)
        new = []
        for k in range(len(rep)):  # a class that no leader of its own label is near becomes one
            if not led[k]:
                new.append(k)
                led |= near[k]
        self.lead_bits = np.concatenate([self.lead_bits, bits[new]])
        self.lead_rep, self.lead_tail = np.concatenate([self.lead_rep, rep[new]]), np.concatenate([self.lead_tail, tail[new]])

    def join(self, far: np.ndarray, rep: np.ndarray, tail: np.ndarray) -> None:
        """Edges between a block and the leaders before it."""
        ids = np.concatenate([self.lead_rep, rep])
        left, right, low = np.arange(len(self.lead_rep), len(ids)), np.arange(len(self.lead_rep)), np.arange(len(ids))
        for level in range(EXTRA, -1, -1):
            low = self.joined(far & self.same(tail, self.lead_tail, level), left, right, low, ids, level)

    def joined(self, linked: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, ids: np.ndarray, level: int) -> np.ndarray:
        """``low`` after ``linked``; edges join only what longer prefixes have not."""
        moved = forest(linked, left, right, low)
        if not len(moved):
            return low
        self.edges.append(np.stack([ids[moved[:, 0]], ids[moved[:, 1]], np.full(len(moved), level)], 1))
        low = low.copy()
        low[moved[:, 0]] = moved[:, 1]
        return low[low]

    def same(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """Which labels share ``level`` minima after the root's."""
        cut = 16 * (EXTRA - level)
        return (a >> cut)[:, None] == (b >> cut)[None, :]

    def walk(self, near: np.ndarray, rep: np.ndarray, tail: np.ndarray) -> None:
        """Edges within a block, from the full labels up."""
        low = every = np.arange(len(rep))
        for level in range(EXTRA, -1, -1):
            low = self.joined(near & self.same(tail, tail, level), every, every, low, rep, level)

    def count(self, alike: np.ndarray) -> None:
        """How many pairs there are, by those met here, and how many each length misses."""
        s = np.minimum(alike[np.triu(alike >= self.threshold, 1)].astype(float), 1)
        if len(s):
            w = 1 / (TREES * s**self.roots)
            self.pairs += w.sum()
            self.missed += [(w * (1 - s ** (self.roots + level)) ** TREES).sum() for level in range(EXTRA + 1)]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(self.edges) if self.edges else np.empty((0, 3), np.int64), self.pairs, self.missed


EDGES = "u long, v long, level int, pairs double, missed double"


def _nodes(roots: int, threshold: float):
    """Edges (u, v) between classes that share a root, with how many minima more they share;
    and, with null ends, what the recall at each length is measured by. Rows sorted by ``job``, ``tail``."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        edges = np.concatenate([f[0] for f in found])
        n, none = len(edges), pa.nulls(EXTRA + 1, pa.int64())
        pairs, missed = sum(f[1] for f in found), sum(f[2] for f in found)
        level = np.concatenate([edges[:, 2], np.arange(EXTRA + 1)]).astype(np.int32)
        blank = pa.nulls(n, pa.float64())
        cols = [pa.concat_arrays([pa.array(edges[:, k]), none]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(level), pa.concat_arrays([blank, pa.array(pairs)]), pa.concat_arrays([blank, pa.array(missed)])], names=["u", "v", "level", "pairs", "missed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, at, root = [], 0, None, None
        for job, g in blocks(batches, SCREENED):
            if job != at:
                if root is not None:
                    found.append(root.rows())
                    held += len(found[-1][0])
                if held > 50_000 or len(found) > 4096:
                    yield out(found)
                    found, held = [], 0
                at, root = job, _Root(threshold, roots)
            root.add(g)
        if root is not None:
            found.append(root.rows())
        if found:
            yield out(found)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the classes asked for."""
    shingler = Shingler()
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            lists = [shingler.words(t.as_py() or b"") for t in piece.column(piece.schema.get_field_index("text"))]
            s, n = shingler.shingles(lists)
            sets = [np.unique(x).view(np.int64) for x in np.split(s, np.cumsum(n)[:-1])]
            names = ["rep", "mult", "group", "blocks", "b"]
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in names), pa.array(sets, pa.list_(pa.int64()))], names=[*names, "set"])


def _verify(threshold: float):
    """Links and edges of two blocks of a group (sides 0 and 1), or of one with itself (side 2)."""

    def one(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        side, rep, mult, sets = g["side"], g["rep"], g["mult"], g["set"]
        i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not (len(i) and len(j)):  # one of the blocks holds nothing
            return None
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[col] > 1
        row, (_, col) = row[shared], np.unique(col[shared], return_inverse=True)
        both = np.zeros((len(i), len(j)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        width = 4096
        for low in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [low, low + width])
            m = np.zeros((len(sets), width), np.float32)
            m[row[a:b], col[a:b] - low] = 1
            both += m[i] @ m[j].T
        both = both.astype(float)
        linked = both / (size[i][:, None] + size[j][None, :] - both) >= threshold
        linked &= rep[i][:, None] != rep[j][None, :]
        if not linked.any():
            return None
        ids, n = rep[i], linked @ mult[j]
        if side[0] != 2:
            ids, n = np.concatenate([ids, rep[j]]), np.concatenate([n, mult[i] @ linked])
        some = np.flatnonzero(n)
        return ids[some], n[some], forest(linked, rep[i], rep[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, least=2):
            found = [x for x in map(one, group) if x is not None]
            if not found:
                continue
            rep, n, edges = (np.concatenate([x[k] for x in found]) for k in range(3))
            none = pa.nulls(max(len(rep), len(edges)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep, edges[:, 0]])), pa.concat_arrays([none[: len(rep)], pa.array(edges[:, 1])]), pa.concat_arrays([pa.array(n.astype(np.int64)), none[: len(edges)]])],
                names=["u", "v", "n"],
            )

    return run


def _few(df: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it is counted small; else texts are shuffled to it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, text): the mark is a digest of the text as it stands."""
    t = F.col(text).cast("string").cast("binary")
    return docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(t)).alias("mark"), t.alias("text"))


def _matched(edges: DataFrame) -> int:
    """How many minima after a root's a shared prefix needs: as many as reach the target recall."""
    measured = edges.where("u is null").groupBy("level").agg(F.sum("pairs").alias("pairs"), F.sum("missed").alias("missed")).collect()
    return max((r.level for r in measured if r.pairs and 1 - r.missed / r.pairs >= RECALL), default=0)


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, mark, some, rep) of every row, and (rep, mult, class_id, n_links) of every class."""
    spark, roots = docs.sparkSession, prefix_depth(threshold)
    d = _marked(docs, key, text)
    signed = Written(mapped(spread(d), _sign(roots), "id long, mark binary, code binary, some boolean, size long, roots array<long>, tails array<long>, bits binary").withColumn("rep", F.xxhash64("code")), "signed").df
    # Of a class's rows that with the least id, and of those with the least text, is its text.
    chosen = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("at")
    whole = signed.where("some").groupBy("rep", "code").agg(chosen, F.count("*").alias("mult"), *(F.first(c).alias(c) for c in ("size", "roots", "tails", "bits")))
    whole = Written(whole.select("rep", "at.id", "at.mark", "mult", "size", "roots", "tails", "bits"), "classes").df
    labels = whole.select("rep", "bits", F.explode(F.arrays_zip("roots", "tails")).alias("x")).select(F.col("x.roots").alias("job"), F.col("x.tails").alias("tail"), "rep", "bits")
    labels = labels.repartition(partitions(spark), "job").sortWithinPartitions("job", "tail")
    edges = Written(mapped(labels, _nodes(roots, threshold), EDGES), "edges").df
    groups = connected_components(edges.where(F.col("u").isNotNull() & (F.col("level") >= _matched(edges))).select("u", "v"))
    asked = groups.join(whole.select("rep", "id", "mark", "mult", "size"), F.col("node") == F.col("rep"))
    sizes = asked.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    asked = asked.join(Written(sizes, "sizes", few=True).df, "component")
    asked = asked.select("rep", F.col("id").alias("_id"), F.col("mark").alias("_mark"), "mult", F.col("component").alias("group"), "blocks", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).alias("b"))
    found = d.join(_few(Written(asked, "asked", few=True).df), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    # Repeated rows have one text: it is taken once.
    texts = found.groupBy("rep", "mult", "group", "blocks", "b").agg(F.first("text").alias("text"))
    sets = mapped(texts, _sets, "rep long, mult long, group long, blocks long, b long, set array<long>")
    jobs = sets.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("b", "o"), F.greatest("b", "o")
    # A group's jobs go to partitions one after another.
    at = F.pmod(F.xxhash64("group") + (high * (high + 1) / 2).cast("long") + low, F.lit(partitions(spark))).cast("int")
    jobs = jobs.select(at.alias("at"), F.xxhash64("group", low, high).alias("job"), F.when(F.col("b") == F.col("o"), 2).otherwise((F.col("b") > F.col("o")).cast("int")).alias("side"), "rep", "mult", "set")
    jobs = jobs.repartitionById(partitions(spark), "at").drop("at").sortWithinPartitions("job")
    found = Written(mapped(jobs, _verify(threshold), "u long, v long, n long"), "found").df
    links = found.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    member = whole.select("rep", "id", "mark", "mult").join(links, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # Written before its join: a key is split only where both sides come straight from a shuffle.
    least = Written(member.groupBy("component").agg(F.min("id").alias("class_id")), "least", few=True).df
    member = member.join(least, "component").select("rep", "component", "mult", "id", "mark", "class_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    return signed.select("id", "mark", "some", "rep"), Written(member, "members", few=True).df


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, class_id (least id of the component), n_links (other documents linked
    directly), kept (one row's id of each class) of every row."""
    signed, member = _classes(docs, key, text, threshold)
    linked = signed.where("some").select("id", "rep").join(member.select("rep", "class_id", "n_links"), "rep").select("id", "class_id", "n_links")
    alone = signed.where("not some").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone).select(F.col("id").alias(key), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: that with the least id.
    Rows without words all stay."""
    signed, member = _classes(docs, key, text, threshold)
    # What goes: every row that is not its class's chosen (id, text); of that, if it is repeated, all rows but one.
    rows = signed.where("some").groupBy("rep", "id", "mark").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rep", "mark")).alias("c")
    chosen = member.groupBy("component").agg(least).select(F.col("c.rep").alias("_rep"), F.col("c.id").alias("_id"), F.col("c.mark").alias("_mark"))
    own = (F.col("rep") == F.col("_rep")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    rows = rows.join(chosen, own, "left").withColumn("stays", F.col("_rep").isNotNull())
    out_id, out_mark, stays = free_names(docs.columns, "out_id", "out_mark", "stays")
    out = Written(rows.where("not stays or n > 1").select(F.col("id").alias(out_id), F.col("mark").alias(out_mark), F.col("stays").alias(stays)), "dropped", few=True).df
    mark = F.unhex(F.md5(F.col(text).cast("string").cast("binary")))
    d = docs.join(_few(out), F.col(key).cast("long").eqNullSafe(F.col(out_id)) & (mark == F.col(out_mark)), "left")
    once = d.where(F.col(stays).isNull()).select(*docs.columns)
    if not out.where(F.col(stays)).limit(1).count():
        return once
    return once.unionByName(d.where(F.col(stays)).dropDuplicates([out_id, out_mark]).select(*docs.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)
