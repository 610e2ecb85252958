"""Token counts: unigram segmentation by dynamic programming shared over a trie.

The distinct pre-tokens of a slice of rows (words, each with the word mark before it) are
inserted in a trie, level by level. A node's forward score is the best sum of piece
scores that spells its prefix, and is worked out once however many words share it: from
the node back over its ancestors, along the trie of reversed pieces. A word's count of
tokens is stored at its terminal node, and a text's is the sum over its words.

Among segmentations of equal score that of fewest tokens counts. A character that no
piece covers costs ``UNKNOWN`` below the least score and counts as its UTF-8 bytes. The
scores are those of the vocabulary file, as they are.

Defined results: null is empty; an empty text has no tokens; repeated rows count alike;
other columns are not read. Words of over LONG characters are segmented one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import pieces
from millrace.workspace import mapped, spread, table

DEFAULT = "piece_bpe_32k.model"
MARK, UNKNOWN, LONG = "▁", 10.0, 256
_CHARS = 1 << 21


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


@lru_cache(2)
def load_scores(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file, without control, byte and unused pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i) or p.is_unused(i))}


def segment(word: str, scores: Mapping[str, float], longest: int, unknown: float) -> tuple[float, int]:
    """(score, tokens) of one word."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        s, n = best[-1]
        found = (s + unknown, n - len(word[end - 1].encode("utf-8", "surrogatepass")))
        for start in range(max(0, end - longest), end):
            piece = scores.get(word[start:end])
            if piece is not None:
                s, n = best[start]
                found = max(found, (s + piece, n - 1))
        best.append(found)
    return best[-1][0], -best[-1][1]


class Unigram:
    def __init__(self, scores: Mapping[str, float]):
        self.scores = dict(scores)
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        # The trie of reversed pieces, as sorted edges (state, character) -> state.
        state, edges, value = {"": 0}, [], [np.nan]
        for p in scores:
            r = p[::-1]
            for k in range(1, len(r) + 1):
                if r[:k] not in state:
                    state[r[:k]] = len(state)
                    edges.append((state[r[: k - 1]] * _CHARS + ord(r[k - 1]), state[r[:k]]))
                    value.append(np.nan)
            value[state[r]] = scores[p]
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int64)
        self.value = np.array(value)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each of some distinct words."""
        out = np.zeros(len(words), np.int64)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = segment(w, self.scores, self.longest, self.unknown)[1]
            else:
                short.append(k)
        if short:
            out[short] = self._shared([words[k] for k in short])
        return out

    def _shared(self, words: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")  # at depth d the first live[d] words of this order have a node
        live = np.searchsorted(-size[order], -np.arange(size.max() + 1), "right")
        out = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)
        # Of each depth: the nodes' parents and characters, best score and tokens.
        parent, char, best, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for depth in range(1, int(size.max()) + 1):
            at = order[: live[depth]]
            key, back = np.unique(node[: len(at)] * _CHARS + chars[start[at] + depth - 1], return_inverse=True)
            node = back
            parent.append(key // _CHARS)
            char.append(key % _CHARS)
            c, up = char[depth], parent[depth]
            width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            s, n = best[depth - 1][up] + self.unknown, tokens[depth - 1][up] + width
            who, state, back_to = np.arange(len(c)), np.zeros(len(c), np.int64), np.arange(len(c))
            for k in range(1, min(depth, self.longest) + 1):
                edge = state * _CHARS + char[depth - k + 1][back_to]
                e = np.minimum(np.searchsorted(self.edge, edge), len(self.edge) - 1)
                hit = self.edge[e] == edge
                who, state, back_to = who[hit], self.to[e[hit]], parent[depth - k + 1][back_to[hit]]
                if not len(who):
                    break
                v = self.value[state]
                whole = ~np.isnan(v)
                w = who[whole]
                ns, nn = best[depth - k][back_to[whole]] + v[whole], tokens[depth - k][back_to[whole]] + 1
                better = (ns > s[w]) | (ns == s[w]) & (nn < n[w])
                s[w[better]], n[w[better]] = ns[better], nn[better]
            best.append(s)
            tokens.append(n)
            ends = size[at] == depth
            out[at[ends]] = n[node[ends]]
        return out


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, scores: Mapping[str, float] | None = None) -> DataFrame:
    """``key``, n_words, n_tokens of every row. ``scores`` in place of a file's."""
    path = path or default_path()
    schema = docs.select(key).schema.add("n_words", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(scores if scores is not None else load_scores(path))
        known: dict[bytes, int] = {}
        for batch in batches:
            for piece in pieces(batch, "_text"):
                lists = [(t.as_py() or b"").split() for t in piece.column(1)]
                if len(known) > 500_000:
                    known.clear()
                fresh = list({w for ws in lists for w in ws}.difference(known))
                n = model.counts([MARK + w.decode("utf-8", "replace") for w in fresh])
                known.update(zip(fresh, n.tolist(), strict=True))
                words = pa.array([len(ws) for ws in lists], pa.int64())
                tokens = pa.array([sum(map(known.__getitem__, ws)) for ws in lists], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), words, tokens], names=schema.names)

    return mapped(spread(docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("_text"))), run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
