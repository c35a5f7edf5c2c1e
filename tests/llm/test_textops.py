import re

import numpy as np
import pyarrow as pa

from tactus.llm import textops as T

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def chunk(texts, size=T.CHUNK_BYTES):
    return list(T.chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), size=size))


def test_words_against_regex():
    texts = ["Hello, World 12!", None, "", "über-größe", "a", "..", "x" * 50 + " y", "abcdefgh abcdefghi"]
    for size in (1, 20, 1 << 20):
        got = [[w.bytes_at(i) for i in range(a, b)] for c in chunk(texts, size) for w in [T.words(c.data, c.offs, T.ALNUM)] for a, b in zip(w.first[:-1], w.first[1:])]
        lower = [bytes(T.LOWER[np.frombuffer((t or "").encode(), np.uint8)]) for t in texts]
        assert got == [WORD.findall(t) for t in lower]


def test_hashes_distinguish_and_agree():
    texts = [f"w{i} " + "p" * (i % 40) for i in range(500)] * 2
    seen = {}
    for c in chunk(texts, 100):
        w = T.words(c.data, c.offs, T.NONSPACE)
        for i, h in enumerate(w.hash.tolist()):
            assert seen.setdefault(w.bytes_at(i), h) == h
    assert len(set(seen.values())) == len(seen)


def test_kmers_and_occurrence():
    (c,) = chunk(["a b c a b c a", "x y", "", "a b c"])
    w = T.words(c.data, c.offs, T.ALNUM)
    h, first = T.kmers(w, 3)
    assert np.diff(first).tolist() == [5, 1, 0, 1] and h[0] == h[3] == h[6] != h[1]
    assert T.occurrence(h, first).tolist() == [0, 0, 0, 1, 1, 0, 0]
    values, at, number = T.distinct(h)
    assert (values[number] == h).all() and (h[at] == values).all()
