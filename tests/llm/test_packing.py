import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tactus.llm import packing


def reference_ids(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, seq_len=2048):
    ids = {k: np.array(reference_ids(t), "<u4") for k, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[key]):
            assert start == at
            at += length
        assert at == len(x)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= seq_len
    return sum(seq_len - sum(n for _, n in p) for p in by_seq.values())


def test_round_trip(docs):
    rows = packing.pack(docs).collect()
    padding = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert padding <= 2048 * docs.rdd.getNumPartitions()


def test_small_windows(docs):
    few = docs.where("doc_id < 30")
    check(packing.pack(few, seq_len=64, window_tokens=500).collect(), {r.doc_id: r.text for r in few.collect()}, 64)


def test_edges(edge, empty):
    one = edge.where("doc_id is not null and doc_id <> 6").coalesce(1)
    check(packing.pack(one).collect(), {r.doc_id: r.text for r in one.collect()})
    assert packing.pack(edge).where("doc_id = 6").count() == 2
    assert packing.pack(edge).where("doc_id = 1").first().length == 1
    assert packing.pack(empty).count() == 0


def test_encoders_agree():
    encode = packing.encoder("byte_bpe_50k.json")
    for t in ["<|endoftext|> hi", "  a\n\n b", "Ä é 中文 \U0001f600́", "it's 12345 don'T", "\x00\x7f", "x" * 5000, " " * 3000]:
        assert [*encode(t), 1] == reference_ids(t)


def test_balance():
    pieces, costs = packing.assign([900, 800, 700, 600, 500, 400, 300, 200, 100, 50], 1000, 1.0, 0.001)
    assert sum(p[2] for p in pieces) == 4550 and len(costs) == 5
    room = {}
    for _, _, n, s, _ in pieces:
        room[s] = room.get(s, 0) + n
    assert sorted(room.values())[0] >= 500


def plain(lengths, seq_len, linear, quadratic):
    """The same packing with plain loops: pieces by falling cost to the cheapest sequence with room."""
    cost_of = lambda n: linear * n + quadratic * n * n
    full = [(d, k * seq_len, seq_len, 0) for d, n in enumerate(lengths) for k in range(n // seq_len)]
    rest = sorted(((n % seq_len, d, n - n % seq_len) for d, n in enumerate(lengths) if n % seq_len), key=lambda x: (-cost_of(x[0]), x[1]))
    bins = [[0, 0.0] for _ in range(-(-sum(n for n, _, _ in rest) // seq_len))]
    out = [(d, s, n, k, at) for k, (d, s, n, at) in enumerate(full)]
    for n, d, start in rest:
        while n:
            fits = [k for k, (used, _) in enumerate(bins) if seq_len - used >= n]
            k = min(fits, key=lambda i: (bins[i][1], i)) if fits else max(range(len(bins)), key=lambda i: (seq_len - bins[i][0], -i))
            put = min(n, seq_len - bins[k][0])
            out.append((d, start, put, len(full) + k, bins[k][0]))
            bins[k][0] += put
            bins[k][1] += cost_of(put)
            n, start = n - put, start + put
    return out, [cost_of(seq_len)] * len(full) + [c for _, c in bins]


def test_assign_equals_plain_greedy(rng):
    for _ in range(60):
        lengths = [rng.choice([rng.randrange(1, 40), rng.randrange(1, 8), 16, 5, 5]) for _ in range(rng.randrange(0, 40))]  # ties among them
        want, costs = plain(lengths, 16, 1.0, 0.25)
        got, got_costs = packing.assign(lengths, 16, 1.0, 0.25)
        assert sorted(map(tuple, got)) == sorted(want) and np.allclose(got_costs, costs)


def test_windows_are_bounded_by_rows(spark):
    many = spark.createDataFrame([(i, None if i % 2 else "") for i in range(1000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(many, window_rows=100).collect()
    check(rows, {i: "" for i in range(1000)})
    assert len({r.sequence_id for r in rows}) == 10
