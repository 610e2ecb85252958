"""BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a slice of rows lie as symbols in one flat array. Each round looks
up every new pair by binary search over the sorted pair keys, finds the lowest rank in
every word, and merges there; a word leaves the array when no pair of it merges. Ids
equal those of the tokenizers library for BPE files with a word-end suffix, byte-level
symbols and a Split pre-tokenizer with the pattern below (checked on load).

Several occurrences of a word's lowest pair are merged in one round unless the merged
symbol takes part in a merge of lower rank; then only the first is, as the library's
queue would. So the result is the library's in either case.

Defined results: null is empty; an empty text has no ids and decodes to the empty text;
repeated rows encode alike; other columns are not read. A slice holds a bounded number
of bytes, one text at least, so a very long text is encoded alone.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import pieces, strings
from millrace.workspace import mapped, spread, table

DEFAULT = "word_bpe_49k.json"
#: Fixed value: the pre-tokenizer's pattern in the vocabulary file.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same with its engine's white space spelt out.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\p{Z}\p{L}\p{N}]+")
NO_RANK = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary file with a word-end suffix, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if split["pattern"]["Regex"] != FILE_PATTERN or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: another pre-tokenizer, normalizer or decoder")
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.token = [""] * self.size
        for t, i in vocab.items():
            self.token[i] = t
        marks = byte_characters()
        self.inside = np.array([vocab[c] for c in marks], np.int64)
        self.last = np.array([vocab[c + end] for c in marks], np.int64)
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        c = np.array([vocab[x + y] for x, y in merges], np.int64)
        key, rank = a * self.size + b, np.arange(len(merges))
        order = np.lexsort((-rank, key))  # of one pair listed twice the later rank counts
        keep = order[np.r_[True, np.diff(key[order]) != 0]] if len(order) else order
        self.key, self.rank, self.made = key[keep], rank[keep], c
        low = np.full(self.size, NO_RANK)
        np.minimum.at(low, a, rank)
        np.minimum.at(low, b, rank)
        self.one_by_one = low[c] < rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marker = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has. No word is empty."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inside[raw], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        rank = np.full(len(sym), NO_RANK)  # of the pair that starts here
        if len(sym) > 1:
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            live = np.repeat(least < NO_RANK, count)
            if not live.all():
                done.append((word[~live], sym[~live]))
                going = least < NO_RANK
                least, count, sym, word, rank = least[going], count[going], sym[live], word[live], rank[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, count)
            at = np.flatnonzero(hit)
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            run = np.r_[True, (np.diff(at) != 1) | first[1:]]  # a run of one pair upon itself merges at every second place
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
            at = at[np.where(self.one_by_one[rank[at]], first, even)]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, rank, at = sym[stay], word[stay], rank[stay], moved[at]
            new = np.union1d(at, at[at > 0] - 1)
            rank[new] = NO_RANK
            new = new[new < len(sym) - 1]
            new = new[word[new] == word[new + 1]]
            rank[new] = self.ranks(sym[new], sym[new + 1])
        word = np.concatenate([w for w, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def split(self, text: str) -> list[str | int]:
        """Words of a text in order; the id of a special token stands for itself."""
        if self.marker is None or "<|" not in text:
            return PATTERN.findall(normal(text))
        out: list[str | int] = []
        at = 0
        for m in self.marker.finditer(text):
            out += PATTERN.findall(normal(text[at : m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        return out + PATTERN.findall(normal(text[at:]))


def normal(text: str) -> str:
    """NFC, then lower case by character: a final sigma is not special."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


#: Characters' worth of what is remembered of a word beside itself.
REMEMBERED = 24


class Coder:
    """Encodes slices of texts; remembers words between slices, up to ``remember`` characters
    of them (and REMEMBERED for what stands around each)."""

    def __init__(self, path: str, remember: int = 8 << 20):
        self.bpe, self.remember = load(path), remember
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | int, int] = {}
        self.shown: dict[str | int, str] = {}
        self.held = 0
        self.ids, self.start, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str | int]) -> None:
        plain = [w for w in words if isinstance(w, str)]
        ids, count = self.bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in plain])
        for w in words:
            if not isinstance(w, str):
                plain.append(w)
                ids, count = np.append(ids, w), np.append(count, 1)
        token = self.bpe.token + [t for t, _ in sorted(self.bpe.special.items(), key=lambda x: x[1])] if self.bpe.special else self.bpe.token
        strings_of = [token[i] for i in ids.tolist()]
        ends = np.cumsum(count)
        base, at = len(self.number), len(self.ids)
        for k, (w, a, b) in enumerate(zip(plain, (ends - count).tolist(), ends.tolist(), strict=True)):
            self.number[w] = base + k
            self.held += REMEMBERED + (len(w) if isinstance(w, str) else 1)
            self.shown[w] = strings_of[a] if b - a == 1 else " ".join(strings_of[a:b])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.start = np.concatenate([self.start, at + ends - count])
        self.count = np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decoded text) of each text."""
        split = [self.bpe.split(t) for t in texts]
        if self.held > self.remember:
            self.clear()
        if fresh := list(dict.fromkeys(w for s in split for w in s if w not in self.number)):
            self.learn(fresh)
        for s in split:
            if not s:
                yield np.empty(0, np.uint32), ""
                continue
            k = np.fromiter(map(self.number.__getitem__, s), np.int64, len(s))
            n = self.count[k]
            past = np.cumsum(n)
            yield self.ids[np.repeat(self.start[k] - past + n, n) + np.arange(past[-1])], " ".join(map(self.shown.__getitem__, s))


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_output: bool = False) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256; with ``with_output`` also ids and decoded."""
    path = path or default_path()
    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_output:
        from pyspark.sql.types import ArrayType, LongType

        schema = schema.add("ids", ArrayType(LongType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for piece in pieces(batch, text):
                out: list[list] = [[], [], [], [], []]
                for ids, decoded in coder.encode(strings(piece, text)):
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_output:
                        out[3].append(ids.astype(np.int64))
                        out[4].append(decoded)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                if with_output:
                    cols += [pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *cols], names=schema.names)

    return mapped(spread(docs.select(F.col(key), F.col(text))), run, schema)


COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last of the pipeline: every row of ``docs`` with its ids as a digest."""
    return encode_documents(docs)
