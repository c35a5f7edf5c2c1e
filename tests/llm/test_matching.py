"""Licenses, near-duplicates, exact duplicates and the pipeline against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tactus.llm import exact, licenses, minhash
from tactus.llm.queries import OP9_SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UP))


def test_licenses_exact_lines(docs):
    got = {(r.doc_id, r.template) for r in licenses.scan(docs).where("coverage = 1").collect()}
    for r in docs.collect():
        w = " " + " ".join(words(r.text)) + " "
        for name, t in licenses.default_templates().items():
            assert ((r.doc_id, name) in got) == (" " + " ".join(words(t)) + " " in w)


def full_alignment(doc, template):
    """Best local alignment (match 1, others -1) over all cells: score and matched words of the best end."""
    best, above = (0, 0), [(0, 0)] * (len(doc) + 1)
    for t in template:
        row = [(0, 0)]
        for j, d in enumerate(doc):
            x = above[j]
            x = (x[0] + 1, x[1] + 1) if t == d else (x[0] - 1, x[1])
            x = max(x, (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), (0, 0))
            row.append(x)
            best = max(best, x)
        above = row
    return best


def test_align_equals_full_alignment(rng):
    import numpy as np

    for _ in range(60):
        template = [rng.randrange(12) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(12) for _ in range(rng.randrange(0, 8))] + [x for x in template if rng.random() > 0.1] + [rng.randrange(12) for _ in range(rng.randrange(0, 8))]
        got = licenses.align(np.array(doc), np.array(template), -len(template), len(doc))
        score, matched = full_alignment(doc, template)
        part = full_alignment(doc[got[1] : got[2]], template)
        assert part[0] == score and got[0] <= got[2] - got[1] and got[0] >= min(matched, part[1]) - 1


def test_licenses_adjacent_altered_copies(spark, rng):
    """Copies side by side, each with words dropped, put in or changed, are all reported where they lie."""
    names = ["MIT", "BSD-2-Clause", "Apache-2.0 notice", "MIT line"]
    templates = {n: licenses.default_templates()[n] for n in names}
    texts, want = [], []
    for i in range(24):
        out, spans = [], []
        for _ in range(rng.randrange(1, 4)):
            out += [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 3]))]
            name = rng.choice(names)
            t = words(templates[name])
            changed = list(t)
            for _ in range(len(t) // 25 if len(t) >= 20 else 0):
                j = rng.randrange(4, len(changed) - 4)
                changed[j : j + 1] = rng.choice([[], ["zz"], [changed[j], "zz"]])
            spans.append((name, len(out), len(out) + len(changed)))
            out += changed
        texts.append((i, " ".join(out)))
        want.append(spans)
    got = {}
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), templates).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, spans in enumerate(want):
        for name, s, e in spans:
            near = [r for r in got[i] if r.template == name and abs(r.start - s) <= 3 and abs(r.end - e) <= 3]
            assert len(near) == 1 and near[0].coverage >= 0.9, (i, name, s, e, got[i])
        of = [r for r in got[i] if r.coverage >= 0.8]
        for r in of:
            assert all(r.end <= x.start or x.end <= r.start for x in of if x.template == r.template and x is not r)


def test_licenses_altered_and_edges(spark, edge, empty):
    notice = licenses.full_texts()["MIT"].split()
    changed = notice[:10] + ["kindly"] + notice[10:25] + notice[27:]
    d = spark.createDataFrame([(1, "some words before " + " ".join(changed) + " and after", "x"), (2, " ".join(notice[:12]), "x"), (3, " ".join(notice + notice), "x"), (4, " ".join(notice[40:90]), "x")], "doc_id long, text string, template string")
    rows = [r for r in licenses.scan(d).collect() if r.template == "MIT"]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 3, 4} and len(by[3]) == 2 and len(by[4]) == 1
    r = by[1][0]
    assert r.matched == r.template_words - 2 and (r.start, r.end) == (3, 3 + len(words(" ".join(changed))))
    assert by[4][0].coverage < 0.5 and by[4][0].matched == len(words(" ".join(notice[40:90])))
    assert licenses.scan(edge).count() == 0 and licenses.scan(empty).count() == 0 and licenses.scan(d, {}).count() == 0
    with pytest.raises(ValueError):
        licenses.build({"a": "x" * 100}, max_template_bytes=10)


def test_full_bodies_are_found(spark):
    full = licenses.full_texts()
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(full)
    d = spark.createDataFrame([(i, f"/* {t} */") for i, t in enumerate(full.values())], "doc_id long, text string")
    best = {(r.doc_id, r.template) for r in licenses.scan(d).where("coverage = 1").collect()}
    assert {(i, n) for i, n in enumerate(full)} <= best
    two = {r.template: r.coverage for r in licenses.scan(d.where(f"doc_id = {list(full).index('BSD-2-Clause')}")).collect()}
    assert two["BSD-2-Clause"] == 1 and two.get("BSD-3-Clause", 0) < 1


def kmers(text, k=5):
    w = words(text)
    out, seen = [], {}
    for g in [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []:
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def similarity(a, b):
    """c / (|a| + |b| - c), c the longest common subsequence of labelled shingles (quadratic)."""
    place = {x: i for i, x in enumerate(b)}
    seq = [place[x] for x in a if x in place]
    best = []
    for i, x in enumerate(seq):
        best.append(1 + max([best[j] for j in range(i) if seq[j] < x], default=0))
    c = max(best, default=0)
    return c / (len(a) + len(b) - c) if a and b else 0.0


def classes(rows):
    keys = {i: kmers(t) for i, t in rows if i is not None}
    parent = {i: i for i in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(keys)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if keys[i] and keys[j] and root(i) != root(j) and 0.75 * len(keys[i]) <= len(keys[j]) <= len(keys[i]) / 0.75 and similarity(keys[i], keys[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, docs, rng, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 3000]
    base = [t for _, t in rows if 60 < len(t.split()) < 300][:6]
    for n, t in enumerate(base):  # families of copies with more and more words changed
        for copy in range(12):
            w = t.split()
            for _ in range(rng.randrange(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma"])
            rows.append((10_000 + n * 100 + copy, " ".join(w)))
    want = classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {k: r.class_id for k, r in got.items()} == want
    assert all(r.class_size == sum(x == r.class_id for x in want.values()) and r.kept == (k == r.class_id) for k, r in got.items())
    monkeypatch.setattr(minhash, "FAMILY", 3)  # families over many block pairs give the same
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == want
    monkeypatch.setattr(minhash, "FAMILY", 500)
    monkeypatch.setattr(minhash, "FAMILY_WORDS", 1500)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == want


def test_family_links_short_texts_that_share_one_entry():
    """8 words and the same with one more are 4 of 5 shingles, and may share just one entry."""
    import numpy as np
    import pyarrow as pa

    from tactus.llm import textops as T

    short = "w507616 w50853 w382455 w487733 w511832 w378968 w19142 w360703"
    texts = [short, short + " z962347"]
    raw = [t.encode() for t in texts]
    w = T.words(np.frombuffer(b"".join(raw) + bytes(16), np.uint8), np.cumsum([0, *map(len, raw)]), T.ALNUM)
    sketches = [x.view(np.int64) for x in minhash.sketch(*minhash.labelled(w, 5), 3, 20)]
    assert len(np.intersect1d(*sketches)) == 1 and similarity(kmers(texts[0]), kmers(texts[1])) == 0.8
    family = pa.table({"doc_id": [1, 2], "own": [1, 2], "block": [0, 0], "sketch": pa.array([x.tolist() for x in sketches], pa.list_(pa.int64())), "text": texts})
    assert minhash._family(5, 0.8)(family).to_pylist() == [{"a": 2, "b": 1, "similarity": 0.8}]


def test_recall_of_sketches(rng):
    """Of pairs at similarity 0.8 to 0.9, nearly all share a sketch entry and so can be met."""
    import numpy as np

    from tactus.llm import textops as T

    met = total = 0
    while total < 400:
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        b = list(a)
        for _ in range(rng.randrange(1, 1 + len(a) // 35 + 1)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice([[], ["new"]])
        if not 0.8 <= similarity(kmers(" ".join(a)), kmers(" ".join(b))) < 0.9:
            continue
        raw = [" ".join(x).encode() for x in (a, b)]
        w = T.words(np.frombuffer(b"".join(raw) + bytes(16), np.uint8), np.cumsum([0, *map(len, raw)]), T.ALNUM)
        x, y = minhash.sketch(*minhash.labelled(w, 5), 3, 20)
        met, total = met + bool(len(np.intersect1d(x, y))), total + 1
    assert met / total >= 0.99


def test_near_duplicate_edges(edge, empty):
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(edge).collect()}
    assert got[1] == (1, True) and got[2] == (2, True) and got[7] == (7, True) and got[6] == (5, False) and got[None] == (None, True)
    assert minhash.near_duplicates(edge).count() == edge.count() and minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 2


def test_chain_is_the_longest_common_subsequence(rng):
    import numpy as np

    for _ in range(100):
        a = rng.sample(range(60), 40)
        b = list(a)
        for _ in range(rng.randrange(4)):
            i, j = rng.randrange(len(b)), rng.randrange(len(b))
            b[i], b[j] = b[j], b[i]
        b = [x if rng.random() > 0.04 else x + 1000 for x in b]
        s = similarity([(x,) for x in a], [(x,) for x in b])
        assert minhash.chain(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == pytest.approx(s if s >= 0.8 else 0.0)


def normal(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def check_exact(rows, edge):
    ids = {}
    for r in edge.collect():
        ids.setdefault(normal(r.text), []).append(r.doc_id)
    assert len(rows) == edge.count()
    for r in rows:
        own = ids[r.text_sha256]
        keep = min([x for x in own if x is not None], default=None)
        assert r.keep_id == keep and r.group_size == len(own) and r.kept == (r.doc_id == keep)
    return ids


def test_exact(spark, edge, empty):
    index = exact.new_index(spark)
    check_exact(exact.deduplicate(edge, index).collect(), edge)
    index.drop()
    for batches in (1, 2, 5):
        ids = check_exact(exact.deduplicate_table(edge, batches).collect(), edge)
        assert exact.deduplicate_table(empty, batches).count() == 0
    kept = exact.keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == len(ids)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tactus_digests")]


def test_keep_first_with_repeated_ids(spark, monkeypatch):
    from tactus.llm import storage

    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "c"), (None, "d"), (None, "a"), (3, "d"), (4, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert sorted(tuple(r) for r in exact.keep_first(d).collect()) == want
    monkeypatch.setattr(storage, "MOST_IDS", 0)  # as with too many ids to broadcast
    assert sorted(tuple(r) for r in exact.keep_first(d).collect()) == want


def test_index_persists(spark):
    index = exact.DigestIndex(spark, "tactus_digests_test", 4)
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a\n b"), (2, "d"), (3, "d")], "doc_id long, text string")
    exact.deduplicate(first, index).count()
    index = exact.DigestIndex(spark, "tactus_digests_test")
    assert index.buckets == 4
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.deduplicate(second, index).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)} and index.table().count() == 3
    before = sorted(map(tuple, index.table().collect()))
    index.compact()
    assert sorted(map(tuple, index.table().collect())) == before and exact.DigestIndex(spark, "tactus_digests_test").buckets == 4
    assert exact.deduplicate(first, index).where("kept").count() == 2 and index.table().count() == 3
    index.drop()
    assert not index.exists() and "keep_id" in OP9_SQL


def test_index_side_is_not_shuffled(spark):
    index = exact.DigestIndex(spark, "tactus_digests_plan", 4)
    groups = spark.createDataFrame([(bytes([k]) * 32, k, 1) for k in range(50)], "digest binary, min_id long, n long")
    index.append(groups)
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    index.drop()
    join = plan[plan.index("SortMergeJoin") :]
    assert "LeftAnti" in join and join.count("Exchange") == 1 and "Bucketed: true" in plan


def test_pipeline(spark, sf_dir, docs, benchmark_):
    import corpus_pipeline
    from tactus.llm.storage import staged
    from test_decontamination import brute as contaminated

    kept = docs
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = staged(stage(spark, kept, sf_dir), "test")
        tables[name] = {r.doc_id: getattr(r, "text", None) for r in kept.collect()}
    seen = {}
    for k, t in sorted(tables["toxicity"].items()):
        seen.setdefault(normal(t), k)
    assert set(tables["exact_dedup"]) == set(seen.values())
    near = classes(list(tables["exact_dedup"].items()))
    assert set(tables["near_dedup"]) == {k for k, v in near.items() if k == v}
    hit = contaminated(list(tables["near_dedup"].items()), [tuple(r) for r in benchmark_.collect()])
    assert set(tables["decontamination"]) == {r[0] for r in hit if not r[5]}
    assert set(tables["packing"]) == set(tables["decontamination"])
    ran = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert ran == set(tables["packing"])
    assert docs.agg(F.count("*")).first()[0] > len(ran) > 0
