import math
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactus.llm import lm
from tactus.llm import spelling as S

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, train):
    counts = {}
    toks = {k: [*TOKEN.findall((t or "").translate(UP)), "\n"] for k, t in texts.items()}
    for k in train:
        for w in toks[k]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return {k: (len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws in toks.items()}


def test_base_and_gain(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = lm.score(docs, held).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts, [k for k in texts if zlib.crc32(str(k).encode()) % 5 != 1])
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.base_score == pytest.approx(w[3])
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / max(len((texts[r.doc_id] or "").encode()), 1))
    train = [r for r in rows if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def learned_spelling(words):
    counts, learner = S.learn_words(iter([words] * 50), S.table_bits(len(words)))
    return S.Model(counts, S.table_bits(len(words)), learner.weights.astype(np.float32), S.map_from(learner.hits.reshape(256, -1), learner.tries.reshape(256, -1)))


def test_spelling_is_a_distribution():
    """Over all words of up to two bytes, probabilities add up to at most 1; known first bytes cost nothing."""
    model = learned_spelling(pa.array(["ab", "ba", "abc", "c", "b"]))
    each = [chr(i) for i in range(33, 128)]
    all_words = pa.array(each + [x + y for x in each for y in each])
    mass = (10 ** model.log10(all_words)).sum()
    assert 0.3 < mass <= 1 + 1e-9
    whole, rest = model.log10(pa.array(["ab"]))[0], model.log10(pa.array(["ab"]), np.array([2]))[0]
    assert whole < rest < 0


def small(rng, n_texts=12):
    """Texts of a small vocabulary as lm.Texts with its code; words 0 to 5 are frequent, 6 to 13 are rarer, 14 and 15 new."""
    n_words = 16
    rank = np.array([0, 1, 2, 3, 300, 400] + [lm.FREQUENT + g for g in (0, 1, 2, 3, 0, 1, 2, lm.OTHER, 5, lm.OTHER)])
    count = np.array([90, 80, 70, 60, 50, 40] + [1, 2, 3, 5, 8, 13, 21, 34] + [0, 0])
    spelled = np.where(count == 0, 20.5, 0.0)
    texts = [[rng.randrange(n_words) for _ in range(rng.randrange(0, 40))] for _ in range(n_texts)]
    local = np.array([x for t in texts for x in [*t, -1]])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    weights = np.ones(lm.SYMBOLS)
    weights[rank[:6]] += count[:6]
    sizes = np.ones((lm.N_CLASSES, lm.GROUPS)) * 3
    code = lm.Code(weights, np.arange(1, lm.GROUPS + 1, dtype=float), sizes)
    return lm.Texts(local, first, rank, count, spelled), code, texts


def path(code, symbol):
    a, b = code.first[symbol : symbol + 2]
    return list(zip(code.nodes[a:b].tolist(), code.bits[a:b].tolist()))


def group_path(code, g):
    a, b = code.group_first[g : g + 2]
    return list(zip(code.nodes[a:b].tolist(), code.bits[a:b].tolist()))


def test_codes_are_prefix_free():
    first, nodes, bits = lm.huffman(np.array([5, 1, 1, 2, 9, 1.0]))
    codes = ["".join(map(str, bits[a:b])) for a, b in zip(first, first[1:])]
    assert sum(2.0 ** -len(c) for c in codes) == 1 and len(set(codes)) == 6 and min(map(len, codes)) == len(codes[4])
    assert all(nodes[a] == 0 for a in first[:-1])


def test_whole_text_by_hand(rng):
    """Total bits of each text equal a walk decision by decision with plain dictionaries."""
    t, code, texts = small(rng)
    counts, learner = None, None
    real = lm.texts_of
    lm.texts_of = lambda r: t
    try:
        counts, learner = lm.learn_texts(iter([{"held": [False] * len(texts)}] * 3), code)
    finally:
        lm.texts_of = real
    model = lm.Model(counts, learner.weights.astype(np.float32), S.map_from(learner.hits.reshape(-1, S.BUCKETS), learner.tries.reshape(-1, S.BUCKETS)))
    got = lm.text_bits(model, code, t, 0, len(texts))
    mix = lambda v: int(lm.T.mix(np.array([v], np.uint64))[0])
    sure = lambda n: bisect_left([0.5, 4, 40], n)
    for i, words in enumerate(texts):
        total, own, prev, guide = 0.0, {}, lm.START, lm.GUIDES
        seen: list[int] = []
        for w in [*words, None]:
            group = None
            if w is None:
                symbol = lm.END
            elif w < 6:
                symbol = int(t.rank[w])
            elif w in seen:
                symbol = lm.REPEAT
                total += math.log2(len(seen) / seen.count(w))
            else:
                symbol = lm.FREQUENT + bisect_right(lm.EDGES.tolist(), int(t.count[w])) - 1 if t.count[w] else lm.NEW
                group = int(t.rank[w]) - lm.FREQUENT
                total += math.log2(3) if t.count[w] else t.spelled[w]
            if w is not None and w >= 6:
                seen.append(w)
            for d, (node, bit) in enumerate(path(code, symbol) + (group_path(code, group) if group is not None else [])):
                inside = d - len(path(code, symbol))
                step = (node + 1) * int(lm.T._M1)
                context = mix((prev if inside < 0 else symbol + lm.SYMBOLS + 1) * (lm.GUIDES + 1) + guide + int(lm.T._M2))
                at = [node, int(lm.BASE[1]) + guide * lm.NODES + node]
                at.append(int(lm.BASE[2]) + ((context + step) * int(lm.T._M2) % (1 << 64) >> 64 - lm.HASH_BITS))
                c0, c1 = own.get(node, (0, 0))
                x = [math.log((counts[s, 1] + 0.3) / (counts[s, 0] + 0.3)) for s in at] + [math.log((c1 + 0.3) / (c0 + 0.3)), 0.3]
                depth = min(d, 5) if inside < 0 else 6 + (inside > 0)
                gate = (depth * 4 + sure(counts[at[2]].sum())) * 4 + sure(c0 + c1)
                mixed = sum(a * b for a, b in zip(x, learner.weights[gate]))
                p = float(S.refine(model.map, S.squash(np.array([mixed])), np.array([mixed]), np.array([guide]))[0])
                total -= math.log2(p if bit else 1 - p)
                own[node] = (c0 + 1 - bit, c1 + bit)
            prev = symbol
            guide = symbol if symbol < lm.GUIDES else guide
        assert got[i] == pytest.approx(total, rel=1e-4), i


def test_parts_and_runs_do_not_change_bits(rng, monkeypatch):
    t, code, texts = small(rng, 30)
    model = lm.Model(np.zeros((lm.BASE[-1], 2), np.float32), S.Learner(lm.GATES, lm.INPUTS, 1).weights, S.map_from(np.zeros((lm.GUIDES + 1, S.BUCKETS)), np.zeros((lm.GUIDES + 1, S.BUCKETS))))
    want = lm.text_bits(model, code, t, 0, len(texts))
    monkeypatch.setattr(lm, "PART", 7)
    assert np.allclose(lm.text_bits(model, code, t, 0, len(texts)), want)
    some = np.arange(len(texts)) % 3 == 0
    alone = np.concatenate([lm.text_bits(model, code, s, a, b) for s, a, b in lm.groups_of(t, some)])
    assert np.allclose(alone, want[some])


def test_left_out_counts_are_of_other_texts(rng):
    t, code, texts = small(rng)
    symbol, group, _ = lm.symbols(t, 0, len(texts), code, True)
    at = 0
    for words in texts:
        for k, w in enumerate([*words, None]):
            if w is not None and w >= 6 and w not in words[:k]:
                left = int(t.count[w]) - words.count(w)
                assert symbol[at] == (lm.FREQUENT + bisect_right(lm.EDGES.tolist(), left) - 1 if left > 0 else lm.NEW) and group[at] == t.rank[w] - lm.FREQUENT
            at += 1


def test_edges(edge, empty):
    rows = lm.score(edge, F.lit(False)).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r.score) for r in rows)
    one = {r.doc_id: r.n_tokens for r in rows}
    assert one[1] == one[2] == one[3] == 1 and one[9] == 30001
    assert lm.score(empty, F.lit(False)).count() == 0
    none = lm.score(edge, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_tables_of_many_tasks_add_up(spark):
    """Blocks of 200 tasks are added in two rounds; the sum is that of the parts."""
    rng = np.random.default_rng(4)
    size = S.BLOCK + 100
    parts = [(k, rng.integers(0, size, 30)) for k in range(200)]
    want = np.zeros((size, 2), np.float32)
    rows = []
    for k, at in parts:
        own = np.zeros((size, 2), np.float32)
        np.add.at(own, (at, at % 2), 1)
        want += own
        rows += [(k, b, bytearray(S._squeeze(own[b * S.BLOCK : (b + 1) * S.BLOCK])), None, None) for b in range(2)]
    found = spark.createDataFrame(rows, S.FOUND)
    assert (S.summed(found, size) == want).all()


def test_counts_in_the_text_by_plain_counting(rng, monkeypatch):
    """Whatever the blocks that texts are scored in, each decision has its node's earlier bits in its text (up to
    what LOGS holds), and bits don't change."""
    t, code, texts = small(rng, 5)
    local = np.concatenate([t.local, np.tile(np.array([0, 1, 0, 2]), 400), [-1]])  # a long text at the end
    t = lm.Texts(local, np.append(t.first, len(local)), t.rank, t.count, t.spelled)
    symbol, group, _ = lm.symbols(t, 0, len(t.first) - 1, code, False)
    for most in (7, 300, 10**6):
        seen = {}
        for p in lm.decisions(symbol, group, t.first, code, most):
            for text, node, bit, c0, c1 in zip(p.text, p.node, p.bit, *p.own):
                own = seen.setdefault((text, node), [0, 0])
                assert (c0, c1) == tuple(min(x, len(lm.LOGS) - 1) for x in own)
                own[bit] += 1
        assert max(map(max, seen.values())) >= len(lm.LOGS)
    model = lm.Model(np.zeros((lm.BASE[-1], 2), np.float32), S.Learner(lm.GATES, lm.INPUTS, 1).weights, S.map_from(np.zeros((lm.GUIDES + 1, S.BUCKETS)), np.zeros((lm.GUIDES + 1, S.BUCKETS))))
    want = lm.text_bits(model, code, t, 0, len(t.first) - 1)
    monkeypatch.setattr(lm, "SCORED", 50)
    assert np.allclose(lm.text_bits(model, code, t, 0, len(t.first) - 1), want)


def test_hashed_odds_tell_how_often_they_were_seen():
    counts = np.zeros((lm.BASE[-1], 2), np.float32)
    n = np.array([0, 1, 4, 5, 40, 41, 10**6])
    counts[lm.BASE[2] : lm.BASE[2] + len(n), 0] = n
    counts[lm.BASE[2] : lm.BASE[2] + len(n), 1] = 2
    counts[lm.BASE[2], 1] = 0
    model = lm.Model(counts, np.zeros((lm.GATES, lm.INPUTS), np.float32), np.zeros((1, S.BUCKETS), np.float32))
    odds = model.odds[lm.BASE[2] :][: len(n)]
    assert (odds.view(np.uint32) & 3).tolist() == [bisect_left([0.5, 4, 40], x) for x in (n + counts[lm.BASE[2] :][: len(n), 1]).tolist()]
    assert odds == pytest.approx(np.log((counts[lm.BASE[2] :][: len(n), 1] + 0.3) / (n + 0.3)), abs=1e-5)


def test_sums_by_gate_are_plain_sums():
    rng = np.random.default_rng(6)
    x, miss, gate = rng.normal(size=(4, 3000)).astype(np.float32), rng.normal(size=3000).astype(np.float32), rng.integers(0, 200, 3000) // 3 * 3
    x[-1] = S.BIAS
    per = np.bincount(gate, minlength=256)
    want = np.stack([np.bincount(gate, (row * miss).astype(float), 256) for row in x], 1)
    assert S.by_gate(x, miss, gate, per) == pytest.approx(want, abs=1e-4)
    assert not S.by_gate(x[:, :0], miss[:0], gate[:0], np.zeros(256, np.int64)).any()


def test_a_text_of_many_tokens_is_counted_whole(rng):
    """However many tokens are asked for at a time, and with texts of one token between long ones."""
    _, code, _ = small(rng)
    size = [1, 70_000, 1, 1, 5, 66_000, 1]
    first = np.concatenate([[0], np.cumsum(size)])
    symbol = np.full(first[-1], 3)
    symbol[first[1:] - 1] = lm.END
    parts = list(lm.decisions(symbol, np.full(len(symbol), -1), first, code, 10**6))
    assert sum(len(p.bit) for p in parts) == code.size[symbol].sum()
    of = np.concatenate([p.text for p in parts])
    assert np.bincount(of).tolist() == [int(code.size[symbol[a:b]].sum()) for a, b in zip(first, first[1:])]
    root = np.concatenate([p.node for p in parts]) == 0
    met = np.concatenate([p.own[0].astype(int) + p.own[1] for p in parts])[root]
    before = np.arange(first[-1]) - np.repeat(first[:-1], size)
    assert (np.where(before < 1000, met, 0) == np.where(before < 1000, before, 0)).all() and met[before > 3000].min() >= len(lm.LOGS) - 1


def test_chunks_share_their_words(spark, monkeypatch):
    """A word of several chunks of a task is one row with their counts, and token numbers lead back to each text."""
    monkeypatch.setattr(lm, "CHUNK", 60)
    texts = [(i, " ".join(["Same", f"w{i % 7}", "same", f"x{i}"]), i % 5 == 1) for i in range(40)] + [(40, "", False)]
    found = lm.chunked(spark.createDataFrame(texts, "doc_id long, text string, held_out boolean").coalesce(1)).collect()
    words = {(r.chunk, r.local): r for r in found if r.word is not None}
    parts = [r for r in found if r.word is None]
    assert len(parts) > 1 and len({k[0] for k in words}) == 1 and len(words) == len({r.word for r in words.values()}) == 1 + 7 + 40
    back = {}
    for r in parts:
        at = iter(lm._numbers(r.tokens, sum(r.n_tokens)).tolist())
        back |= {i: " ".join(words[r.chunk, next(at)].word for _ in range(n)) for i, n in zip(r.doc_ids, r.n_tokens)}
    assert back == {i: t.lower() for i, t, _ in texts}
    assert {r.word: r.n_train for r in words.values()}["same"] == 2 * sum(not h for _, t, h in texts if t)


def test_chunking_holds_little(monkeypatch):
    """Words of some 14 MB are found a piece at a time and leave in small batches: the same words, counts and numbers
    as by plain counting, without the memory of the whole at once."""
    import tracemalloc

    import pyspark

    class Docs:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"Word{x}" for x in rng.integers(0, 150_000, 2500)) for _ in range(600)] + ["", "a " * 700_000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([i % 5 == 1 for i in range(len(texts))])], names=["doc_id", "text", "held_out"])
    tracemalloc.start()
    found, most = [], 0
    for b in lm.chunked(Docs())(iter([rows])):
        found.append(b)
        most = max(most, b.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 1 << 15 and peak < 130e6
    names, got, at = {}, {}, {}
    for b in found:
        for r in b.select(["word", "local", "n_train"]).to_pylist() if b.column("word").null_count == 0 else []:
            names[r["local"]], got[r["word"]] = r["word"], r["n_train"]
        for r in b.to_pylist() if b.column("word").null_count else []:
            number = iter(lm._numbers(r["tokens"], sum(r["n_tokens"])).tolist())
            at |= {i: " ".join(names[next(number)] for _ in range(n)) for i, n in zip(r["doc_ids"], r["n_tokens"])}
    want = {}
    for i, t in enumerate(texts):
        for w in t.lower().split():
            want[w] = want.get(w, 0) + (i % 5 != 1)
    assert got == want and at == {i: " ".join(t.lower().split()) for i, t in enumerate(texts)}


def test_words_are_in_no_more_files_than_chunks(spark, monkeypatch):
    """However many partitions the shuffle of words has."""
    files, real = {}, lm.staged

    def staged(df, name):
        made = real(df, name)
        files[name] = len(made.inputFiles())
        return made

    monkeypatch.setattr(lm, "staged", staged)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 101}" for k in range(60))) for i in range(40)], "doc_id long, text string").coalesce(1)
        assert lm.score(docs, F.col("doc_id") % 5 == 1).count() == 40
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert files["lm-words"] <= max(spark.sparkContext.defaultParallelism, files["lm-chunks"])


def test_tables_widen_by_parts():
    counts = np.random.default_rng(9).poisson(0.5, (1000, 2)).astype(np.float32)
    counts[7] = 1 << 23, 300
    raw = S._squeeze(counts)
    parts = list(S._widened(raw, 64))
    assert max(map(len, parts)) <= 64 and (np.concatenate(parts) == counts).all() and (S._widen(raw) == counts).all()
    assert S._widen(S._squeeze(counts[:0])).shape == (0, 2)
