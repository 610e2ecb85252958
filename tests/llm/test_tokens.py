"""BPE against the tokenizers library; unigram counts and PPM against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import ppm, token_counts, word_bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.default_path())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())


def test_bpe_of_documents(spark, sf, odd_docs, no_docs, library):
    from millrace.workspace import table

    for d in (table(spark, sf, "documents"), odd_docs):
        got = [tuple(r) for r in word_bpe.encode_documents(d).collect()]
        assert sorted(got, key=str) == sorted([(r.doc_id, *digests(library, r.text)) for r in d.collect()], key=str)
    assert word_bpe.encode_documents(no_docs).count() == 0
    r = word_bpe.encode_documents(odd_docs.where("doc_id = 7"), with_output=True).first()
    assert r.ids == library.encode("short text", add_special_tokens=False).ids and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_bpe_of_strange_texts(library):
    rng = random.Random(11)
    chars = "aàAbB'sStTrevlmdΣσςİıſK1٣½²!#$%&<>|\t\n\x0b\x1c\x85\xa0 é한日😀🏽\u200d\0ß"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += [rng.choice(["ab", "aba", "ing", "haha", "th", "ee", "!?"]) * rng.randint(1, 300) for _ in range(200)]
    texts += ["<|endoftext|>a<|startoftext|> <|endoftext", "<|ENDOFTEXT|>", "a" * 5000]
    coder = word_bpe.Coder(word_bpe.default_path(), remember=500)
    out = [x for k in range(0, len(texts), 200) for x in coder.encode(texts[k : k + 200])]
    for t, ref, (ids, decoded) in zip(texts, library.encode_batch(texts, add_special_tokens=False), out, strict=True):
        assert ids.tolist() == ref.ids and decoded == library.decode(ref.ids, skip_special_tokens=False), repr(t)


def test_unigram_counts(spark, odd_docs, no_docs):
    scores = token_counts.load_scores(token_counts.default_path())
    m = token_counts.Unigram(scores)
    plain = lambda t: sum(token_counts.segment(token_counts.MARK + w, scores, m.longest, m.unknown)[1] for w in t)
    words = {r.doc_id: [w.decode() for w in (r.text or "").encode().split()] for r in odd_docs.collect()}
    got = token_counts.count_tokens(odd_docs).collect()
    assert len(got) == odd_docs.count() and token_counts.count_tokens(no_docs).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_tokens) == (len(words[r.doc_id]), plain(words[r.doc_id]))


@pytest.mark.parametrize("alphabet", ["abc", "aé日😀▁"])
def test_unigram_ties_and_unknowns(alphabet):
    scores = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "abab": -3.5, "é": -0.5, "éa": -1.5}
    m, rng = token_counts.Unigram(scores), random.Random(2)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(2000)} | {"ab" * 300})
    assert m.counts(words).tolist() == [token_counts.segment(w, scores, m.longest, m.unknown)[1] for w in words]


def plain_ppm(docs):
    """The same model from dictionaries of contexts."""
    count, tokens = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], Counter()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    words = [(i, (t or "").encode().lower().split()) for i, t in docs]
    for i, w in words:
        if not held(i):
            tokens.update([*w, b""])
            s = b"\0" * ppm.ORDER + ppm.serialise(w)
            for p in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    count[k][s[p - k : p]][s[p]] += 1
    total, kinds = sum(tokens.values()), len(tokens)

    def lp(context, byte):
        out, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = count[k].get(context[len(context) - k :])
            left = {b: n for b, n in (seen or {}).items() if b not in gone}
            if not left:
                continue
            t = sum(left.values())
            if byte in left:
                return out + math.log10((left[byte] - 0.5) / t)
            out += math.log10(len(left) / (2 * t))
            gone |= set(seen)
        return out - math.log10(max(1, 256 - len(gone)))

    for i, w in words:
        s = b"\0" * ppm.ORDER + ppm.serialise(w)
        yield (
            i, held(i), len(w) + 1, sum(tokens[x] > 0 for x in [*w, b""]), total, sum(math.log10((tokens[x] + 1) / (total + kinds + 1)) for x in [*w, b""]),
            sum(lp(s[p - ppm.ORDER : p], s[p]) for p in range(ppm.ORDER, len(s))),
        )


def test_ppm(spark, sf, odd_docs, no_docs):
    from millrace.workspace import table

    for d in (table(spark, sf, "documents").where("doc_id < 60").select("doc_id", "text"), odd_docs):
        docs = [(r.doc_id, r.text) for r in d.collect()]
        got = sorted((tuple(r) for r in ppm.score_texts(d).collect()), key=lambda r: (str(r[:4]), r[-1]))
        want = sorted(plain_ppm(docs), key=lambda r: (str(r[:4]), r[-1]))
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)
    assert ppm.score_texts(no_docs).count() == 0
    only_held = ppm.score_texts(odd_docs.where("doc_id is null and text is null")).collect()
    assert len(only_held) == 1
