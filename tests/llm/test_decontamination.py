import hashlib
import re

from tactus.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=10):
    pats = {}
    for key, text in items:
        w = WORD.findall((text or "").translate(UP))
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if w else 0):
            pats.setdefault(tuple(w[i : i + m]), set()).add(str(key if key is not None else ""))
    sizes = {len(p) for p in pats}
    out = []
    for key, text in docs:
        w = WORD.findall((text or "").translate(UP))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if ids := pats.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= ids
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


def test_against_brute_force(docs, benchmark_):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in benchmark_.collect()])
    assert any(r[5] for r in want)
    assert rows(D.scan(docs, benchmark_)) == want
    assert rows(D.scan(docs, benchmark_, block_bytes=1500)) == want
    kept = {r.doc_id for r in D.keep_clean(docs, benchmark_, block_bytes=4000).collect()}
    assert kept == {r[0] for r in want if not r[5]}


def test_short_items_and_long_texts(spark, rng):
    words = ["ab", "cd", "ef", "Gh"]
    items = [(1, "ab cd"), (2, "cd"), (3, None), (4, "..."), (None, "ef gh ab"), (5, "ab cd"), (6, " ".join(rng.choices(words, k=14)))]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 700, 2000])))) for i in range(30)] + [(99, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(D.scan(d, b)) == brute(texts, items)


def test_edges(spark, edge, empty, benchmark_):
    assert rows(D.scan(edge, benchmark_)) == brute([(r.doc_id, r.text) for r in edge.collect()], [tuple(r) for r in benchmark_.collect()])
    assert D.scan(empty, benchmark_).count() == 0 and D.keep_clean(edge, benchmark_).count() == edge.count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(edge, none).where("contaminated").count() == 0
    assert D.keep_clean(edge, none).columns == edge.columns


def test_blocks_keep_every_row(spark, edge, benchmark_):
    """Rows without id or with the id of another row stay apart when the items are several blocks."""
    items = [tuple(r) for r in benchmark_.collect()]
    leak = next(t for _, t in items if len(WORD.findall(t)) >= 10)
    texts = [(r.doc_id, r.text) for r in edge.collect()] + [(None, leak), (None, "clean and short"), (4, "before " + leak), (5, leak), (5, "another clean text")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = brute(texts, items)
    assert sum(r[5] for r in want) == 3
    assert len([*D.pattern_blocks(benchmark_, 10, 1500)]) > 1
    assert sorted(rows(D.scan(d, benchmark_, block_bytes=1500)), key=repr) == sorted(want, key=repr)
    assert sorted(rows(D.scan(d, benchmark_)), key=repr) == sorted(want, key=repr)


def test_shift_table_skips_and_tables_are_bounded(rng):
    """With many items most blocks of unrelated text jump far, and tables stay near the text's size."""
    import pickle

    import numpy as np

    from tactus.llm import textops as T

    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(str(k), " ".join([*(word() for _ in range(60)), "and", "so", "on"])) for k in range(1500)]
    patterns = D.Patterns(items)
    one = patterns.lengths[0][0]
    assert one.shift.mean() > 0.7 * (one.m - 1)
    assert len(pickle.dumps(patterns)) < 20 * sum(len(t) for _, t in items)
    raw = (" ".join(word() for _ in range(5000)) + " " + items[7][1] + " " + items[9][1]).encode()
    w = T.words(np.frombuffer(raw + bytes(16), np.uint8), np.array([0, len(raw)]), T.ALNUM)
    assert patterns.hits(w)[2] == {0: {"7", "9"}}
