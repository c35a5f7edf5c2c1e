"""Language, quality and toxicity: held-out accuracy, brute force of their parts, and edges."""

import itertools
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactus.llm import langid, quality, toxicity
from tactus.llm import textops as T
from tactus.llm.queries import QUERIES, held_out

BIG = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = QUERIES["op4_language"](spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.98


def plain_grams(text):
    """1 to 4 bytes of lower-cased words, each framed by one space of which a gram holds at most one, with plain loops."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    word, counts = bytearray(), {}
    for b in [*low, 32]:
        if 97 <= b <= 122 or b >= 128:
            word.append(b)
            continue
        if word:
            framed = b" " + bytes(word) + b" "
            for n in range(1, 5):
                for i in range(len(framed) - n + 1):
                    g = framed[i : i + n]
                    if g.strip(b" ") and not (g[0] == g[-1] == 32):
                        counts[g] = counts.get(g, 0) + 1
        word = bytearray()
    return counts


def gram_bytes(key):
    return (key & (1 << 40) - 1).to_bytes(5, "big")[5 - (key >> 40) :]


def test_grams_and_profiles_by_hand(spark):
    texts = ["Der the, the 12ab", "É日本 x", " a b ", ""]
    (c,) = T.chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array([f" {t} " for t in texts])})]))
    keys, rows = langid.grams(c)
    for r, t in enumerate(texts):
        got = {}
        for k in keys[rows == r].tolist():
            got[gram_bytes(k)] = got.get(gram_bytes(k), 0) + 1
        assert got == plain_grams(t)
    rows = [("en", " the theatre then "), ("en", " there "), ("de", " der die das "), (None, " zzz ")]
    got = langid.profiles(spark.createDataFrame(rows, "lang string, text string"), 12)
    for lang in ("en", "de"):
        total = {}
        for k, t in rows:
            if k == lang:
                for g, n in plain_grams(t).items():
                    total[g] = total.get(g, 0) + n
        key = lambda g: len(g) << 40 | int.from_bytes(g, "big")
        assert [gram_bytes(int(k)) for k in got[lang]] == sorted(total, key=lambda g: (-total[g], key(g)))[:12]
    assert set(got) == {"en", "de"}


def test_language_ties_go_to_the_smaller_name(spark):
    same = spark.createDataFrame([("b", " one two "), ("a", " one two ")], "lang string, text string")
    d = spark.createDataFrame([(1, "one"), (2, "other")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.identify(d, langid.profiles(same)).collect()} == {"a"}


def test_language_distance_against_brute_force(docs):
    size = 50
    profiles = langid.profiles(docs.where("doc_id < 60"), size)
    ranker = langid.Ranker(profiles, size)
    texts = [r.text for r in docs.where("doc_id between 60 and 70").collect()] + ["", "ab a"]
    (c,) = T.chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]))
    d, n = ranker.distances(*langid.grams(c), len(texts))
    for r in range(len(texts)):
        (one,) = T.chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array([texts[r]])})]))
        counts = {}
        for k in langid.grams(one)[0].tolist():
            counts[k] = counts.get(k, 0) + 1
        top = sorted(counts, key=lambda k: (-counts[k], k))[:size]
        for j, lang in enumerate(ranker.langs):
            place = {int(g): i for i, g in enumerate(profiles[lang])}
            assert d[r, j] == sum(abs(place[g] - i) if g in place else size for i, g in enumerate(top))
        assert n[r] == len(top)


def test_language_edges(edge, empty, docs):
    p = langid.profiles(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(edge, p).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0) and got[5][0] in p and got[8][0] in p
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(empty, p).count() == 0 and langid.profiles(empty) == {}
    assert {r.lang_pred for r in langid.identify(edge, {}).collect()} == {"und"}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 4, 4, 5, 8])
    u, tie = rng.normal(size=8), 0.7
    good, equal = quality.marginals(u, tie, first)
    for a, b in zip(first[:-1], first[1:]):
        total, one, same = 0.0, np.zeros(b - a), np.zeros(b - a)
        for y in itertools.product([0, 1], repeat=b - a):
            w = math.exp(sum(v * x for v, x in zip(y, u[a:b])) + sum(tie * (p == q) for p, q in zip(y, y[1:])))
            total += w
            one += w * np.array(y)
            same[1:] += w * np.array([p == q for p, q in zip(y, y[1:])], float)
        if b > a:
            assert good[a:b] == pytest.approx(one / total) and equal[a:b] == pytest.approx(same / total)


def plain_lines(text):
    """Bins of each line's features with plain loops."""
    import re

    out, before = [], {}
    for line in (x for x in text.encode().split(b"\n") if x):
        n = len(line)
        share = lambda f: sum(map(f, line))
        capital, small, digit = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122 or b >= 128), share(lambda b: 48 <= b <= 57)
        sign, space = share(lambda b: b in b",.;:'?-"), share(lambda b: b in b"\t\x0b\x0c\r ")
        tokens = [t for t in re.split(rb"[\x20\x09-\x0D]+", line) if t]
        k = max(len(tokens), 1)
        same = sum(x == y for x, y in zip(tokens, tokens[1:]))
        seen = sum(t in tokens[:i] for i, t in enumerate(tokens))
        f = [n, capital / max(capital + small, 1), digit / n, sign / n, (n - capital - small - digit - sign - space) / n, space / n, (n - space) / k, same / k, seen / k, before.get(line, 0)]
        before[line] = before.get(line, 0) + 1
        out.append([sum(e < x for e in edges) for x, edges in zip(f, quality.EDGES.tolist())])
    return out


def test_quality_of_whole_texts_by_hand(spark, docs, labels):
    """Features by plain loops and marginals by enumeration give the score of every short text."""
    model = quality.fit(docs, labels, max_docs=40)
    texts = ["One line, with 2 signs!", "A\nA\n\nb b  b c\n", "\n\n", " \t\nÄÖ é 中\r\nx", *[r.text[:300] for r in docs.limit(20).collect()]]
    texts = [t for t in texts if t.count("\n") < 10]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    none = [quality.BINS] * quality.FEATURES
    for i, t in enumerate(texts):
        bins, sizes = plain_lines(t), [len(x) for x in t.encode().split(b"\n") if x]
        if not bins:
            assert got[i].score == pytest.approx(model.good)
            continue
        u = []
        for k in range(len(bins)):
            near = [*bins[k], *(bins[k - 1] if k else none), *(bins[k + 1] if k + 1 < len(bins) else none)]
            u.append(model.bias + sum(model.w[j * (quality.BINS + 1) + b] for j, b in enumerate(near)))
        total, good = 0.0, [0.0] * len(u)
        for y in itertools.product([0, 1], repeat=len(u)):
            w = math.exp(sum(a * b for a, b in zip(y, u)) + model.tie * sum(a == b for a, b in zip(y, y[1:])))
            total += w
            good = [g + w * a for g, a in zip(good, y)]
        p = [g / total for g in good]
        assert got[i].score == pytest.approx(sum(a * n for a, n in zip(p, sizes)) / sum(sizes)) and got[i].n_lines == len(p) and got[i].bad_lines == sum(x < 0.5 for x in p)


def test_quality_training_climbs_the_likelihood():
    """No small step from the fitted weights raises the penalised likelihood, which enumeration reckons."""
    rng = np.random.default_rng(1)
    n = rng.integers(1, 5, 14)
    first = np.concatenate([[0], np.cumsum(n)])
    label = np.arange(14) % 2
    bins = (rng.integers(0, 3, (first[-1], quality.FEATURES)) + 2 * np.repeat(label, n)[:, None]).astype(np.uint8)
    model = quality.train(bins, first, label, steps=600, rate=0.02)
    at = quality.wide(bins, first)

    def value(theta):
        u = theta[at].sum(1) + theta[-2]
        total = 0.0
        for d, (a, b) in enumerate(zip(first, first[1:])):
            own = sum(u[a:b]) * label[d] + theta[-1] * (b - a - 1)
            z = sum(math.exp(sum(v * x for v, x in zip(y, u[a:b])) + theta[-1] * sum(p == q for p, q in zip(y, y[1:]))) for y in itertools.product([0, 1], repeat=b - a))
            total += (own - math.log(z)) / (b - a)
        return total - 0.15 * (theta[:-2] ** 2).sum() - 0.75 * theta[-1] ** 2

    theta = np.append(model.w, [model.bias, model.tie])
    top = value(theta)
    for j in [*np.unique(at)[:40].tolist(), len(theta) - 2, len(theta) - 1]:
        for step in (-0.05, 0.05):
            other = theta.copy()
            other[j] += step
            assert value(other) < top + 1e-4


def test_quality_held_out(spark):
    got = QUERIES["op5_quality"](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("quality") == F.col("predicted"))).first()
    assert right / n > 0.93


def test_quality_edges(edge, empty, docs, labels):
    model = quality.fit(docs, labels, max_docs=60)
    rows = {r.doc_id: r for r in quality.score(edge, model).collect()}
    assert rows[1].score == rows[2].score == pytest.approx(model.good) and all(0 <= r.score <= 1 for r in rows.values())
    assert quality.score(empty, model).count() == 0
    assert quality.score(edge, quality.fit(empty, labels)).where("score between 0 and 1").count() == edge.count()


def brute_segments(scores):
    """Maximal segments by their definition: recursively, the best segment and what is left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    return [(a, b, s) for a, b, s in brute_segments(scores[:i])] + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_against_definition(rng):
    for _ in range(200):
        scores = [rng.choice([-0.37, -0.37, -0.91, 1.1, 0.53, 2.3]) for _ in range(rng.randrange(1, 14))]
        place = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(place, np.concatenate([[0.0], np.cumsum(scores)]))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in brute_segments(scores)])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = {(x.toxic, x.predicted): x["count"] for x in got.groupBy("toxic", "predicted").count().collect()}
    assert r[(1, 1)] / (r[(1, 1)] + r.get((1, 0), 0)) > 0.85  # the rest are labelled but hold no insult
    assert r.get((0, 1), 0) / r[(0, 0)] < 0.01


def test_toxicity_of_whole_texts_by_hand(spark, rng):
    """Learning and scoring of a small table equal plain counting and the recursive definition."""
    import re

    bad, good = ["scum", "vermin"], [f"w{k}" for k in range(12)] + ["kindness"]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        w = [rng.choice(good) for _ in range(rng.randrange(5, 40))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "", "hood"]))
        elif i % 3:
            w.append("kindness")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000 + k, rows[0][1]) for k in range(5)]  # copies, which count as one
    labels += [(1000 + k, 1) for k in range(5)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)

    words = {i: re.findall(r"[a-z0-9]+", t) for i, t in rows}
    tokens = lambda w: {w} | {w[:k] for k in toxicity.PREFIXES if len(w) > k}
    label, once = dict(labels), {i: 1 for i, _ in rows[:240]}
    a, b = {}, {}
    for i in once:
        for t in {t for w in words[i] for t in tokens(w)}:
            into = a if label[i] else b
            into[t] = into.get(t, 0) + 1
    n_a, n_b = sum(label[i] for i in once), sum(1 - label[i] for i in once)
    clean_words = sum(len(words[i]) for i in once if not label[i])
    score, p = {}, {}
    whole = {w for i in once for w in words[i]}
    for t in {*a, *b}:
        x, y = a.get(t, 0), b.get(t, 0)
        share = n_a / (n_a + n_b)
        g = 2 * sum(v * math.log(v / ((x + y) * s)) for v, s in ((x, share), (y, 1 - share)) if v)
        root = math.copysign(math.sqrt(max(g, 0)), x - (x + y) * share)
        at = 0.5 + 10 * (x + y) / (n_a + n_b)
        odds = math.log((x + at) / max(n_a + 11 - x - at, 0.5)) - math.log((y + at) / max(n_b + 11 - y - at, 0.5))
        if root > 6 and x >= 0.9 * (x + y) and odds > 0.05:
            score[t] = odds
        elif t in whole and odds < -0.1 and not (root > 6 and x >= 0.9 * (x + y)):
            score[t] = max(odds, -1.0) - 0.05
        if t in score:
            p[t] = (y + 0.5) / clean_words
    assert len(model.hashes) == len(score) and sorted(model.scores) == pytest.approx(sorted(score.values()))
    assert {t for t, s in score.items() if s > 0} >= {"scum", "vermin"} and score["kindness"] < -0.05
    assert sum(q * math.exp(model.lam * score[t]) for t, q in p.items()) + (1 - sum(p.values())) * math.exp(-0.05 * model.lam) == pytest.approx(1)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, w in words.items():
        each = []
        for x in w:
            toxic = [score[t] for t in tokens(x) if score.get(t, 0) > 0]
            each.append(max(toxic) if toxic else score.get(x, -0.05))
        normal = [(s, e, model.lam * v - math.log(model.k * len(w))) for s, e, v in brute_segments(each)] if len(w) < 45 else None
        want = [x for x in normal if x[2] > 0]
        assert [(x["start"], x["end"]) for x in got[i].passages] == [x[:2] for x in want]
        assert got[i].score == pytest.approx(toxicity.evidence(toxicity.tail([x[2] for x in want])) if any(v > 0 for v in each) else 0)


def test_toxicity_edges(edge, empty, docs, labels):
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(edge, model).collect()}
    assert got[1] == got[2] == got[9] == 0 and toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(empty, labels)
    assert toxicity.score(edge, blank).agg(F.max("score")).first()[0] == 0
    assert toxicity.keep_civil(edge, model).columns == edge.columns and toxicity.keep_civil(edge, blank).count() == edge.count()


def test_folds(docs):
    import zlib

    got = {r.doc_id: r.h for r in docs.select("doc_id", held_out(3, 1).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in got}


def test_toxicity_tables_are_few_files(spark, docs, labels):
    """Of documents dealt over many partitions, learning writes as many files a table as tasks run at once at
    most, and learns the same."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    want, old = toxicity.fit(docs, labels), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = set(shared.glob("tactus-toxicity-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = toxicity.fit(docs.repartition(37), labels)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    new = set(shared.glob("tactus-toxicity-*")) - before
    assert new and all(len(list(p.glob("part-*"))) <= spark.sparkContext.defaultParallelism for p in new)
    assert (got.hashes == want.hashes).all() and (got.scores == want.scores).all() and (got.lam, got.k) == (want.lam, want.k)


def test_toxicity_counts_hold_little_at_a_time(rng):
    """The arrays that a batch of 8 MB takes are bounded, and its counts are those of its texts one by one."""
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 12))) for _ in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=2000)) for _ in range(500)]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([int(i % 3 == 0) for i in range(500)], pa.int32()), pa.array([toxicity.UNIT] * 500)], names=["text", "label", "weight"])
    tracemalloc.start()
    try:
        got = list(toxicity.token_counts(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6
    total = lambda parts: pa.Table.from_batches(parts).group_by("h").aggregate([("a", "sum"), ("b", "sum")]).sort_by("h")
    assert total(got).equals(total([x for i in range(500) for x in toxicity.token_counts(iter([rows.slice(i, 1)]))]))
