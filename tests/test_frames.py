import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import align as G
from tactus.operators import audio as A
from tactus.operators import compare as C
from tactus.operators import lines as L
from tactus.operators import spans as S
from tactus.sources import tables, wav
from tactus.streaming import silence


def brute(scores, labels):
    state = [0 if k % 2 == 0 else labels[k // 2] for k in range(2 * len(labels) + 1)]
    best = -math.inf
    for path in itertools.product(range(len(state)), repeat=len(scores)):
        ok = path[0] < 2 and path[-1] >= len(state) - 2
        for a, b in zip(path, path[1:]):
            ok = ok and (b - a in (0, 1) or b - a == 2 and b % 2 == 1 and state[a] != state[b])
        if ok:
            best = max(best, sum(0.0 if state[s] == G.STAR else float(scores[t][state[s]]) for t, s in enumerate(path)))
    return best


@pytest.mark.parametrize("labels", [[1, 2], [1, 1], [1, 2, 1], [G.STAR, 1, G.STAR]])
def test_search_is_optimal(labels):
    rng = np.random.default_rng(len(labels))
    for _ in range(5):
        scores = np.log(rng.dirichlet(np.ones(3), 6)).astype(np.float32)
        path = G.search(scores, labels)
        state = [0 if k % 2 == 0 else labels[k // 2] for k in range(2 * len(labels) + 1)]
        assert all(b - a in (0, 1, 2) for a, b in zip(path, path[1:]))
        assert sum(0.0 if state[s] == G.STAR else float(scores[t][state[s]]) for t, s in enumerate(path)) == pytest.approx(brute(scores, labels), abs=1e-4)


def test_align_to_lines(spark):
    """Certain frames for 'ab c' come back as spans, words and line times."""
    labels = [0, 4, 4, 0, 5, 0, 6, 6]
    rows = [("d", t, [0.0 if v == k else -9.0 for v in range(8)]) for t, k in enumerate(labels)]
    em = spark.createDataFrame(rows, "doc_id string, frame int, values array<double>").withColumn("doc_id", F.lit(1).cast("long"))
    toks = spark.createDataFrame([(1, i, t, s == 0 or i == 2, i // 2, 0) for i, (t, s) in enumerate([(4, 0), (5, 1), (6, 0)])], "doc_id long, token_index int, token_id int, starts_segment boolean, segment_index int, line_index int")
    path = G.align(em, toks)
    assert [r.token_id for r in path.orderBy("frame").collect()] == labels
    spans = S.token_spans(path)
    assert [(r.start_frame, r.end_frame) for r in spans.orderBy("token_index").collect()] == [(1, 3), (4, 5), (6, 8)]
    words = S.words_by_segment(spans, toks)
    lines = spark.createDataFrame([(1, 0, "ALIGNABLE"), (1, 1, "BLANK"), (1, 2, "ALIGNABLE")], "doc_id long, line_index int, kind string")
    times = S.line_times(lines, words).orderBy("line_index").collect()
    assert [(r.line_index, r.kind) for r in times] == [(0, "ALIGNABLE"), (1, "BLANK")] and times[0].start_s == pytest.approx(0.02) and times[0].end_s == pytest.approx(0.16)
    short = em.where("frame < 2")
    assert G.align(short, toks).count() == 0 and G.infeasible(short, toks).first().required == 3


def test_viterbi_align_takes_whole_targets_of_all_items(spark, tmp_path):
    """Every item and token has frames; a short item's path is the best of all paths."""
    from tactus.plans import frame_queries

    items = [(0, "ab"), (1, "aa"), (2, "the quick brown fox jumps over\nthe lazy dog"), (70, "c")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vectors = np.random.default_rng(3).normal(size=(50, 31)) * 2
    spark.createDataFrame([(i * 300, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {}
    for r in frame_queries.viterbi_align(spark, str(tmp_path)).orderBy("doc_id", "frame").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {i for i, _ in items}
    for key, text in items:
        said = text.replace(" ", "").replace("\n", "")
        heard = dict.fromkeys((r.token_index, r.token_id) for r in found[key] if r.token_index is not None)
        assert [*heard] == [(i, L.TOKENS.index(c)) for i, c in enumerate(said)]
        labels = [G.STAR, *map(L.TOKENS.index, said), G.STAR]
        n = 2 * (len(labels) + sum(a == b for a, b in zip(said, said[1:])))
        assert [r.frame for r in found[key]] == [*range(n)]
        rows = [vectors[(key * 40 + t) % 50] for t in range(n)]
        scores = [v - np.log(np.exp(v).sum()) for v in rows]
        state = [0 if k % 2 == 0 else labels[k // 2] for k in range(2 * len(labels) + 1)]
        worth = lambda t, s: 0.0 if state[s] == G.STAR else float(scores[t][state[s]])
        assert sum(r.score for r in found[key]) == pytest.approx(sum(worth(r.frame, r.state) for r in found[key]), abs=1e-4)
        if len(said) > 2:
            continue

        def best(t, s):  # over every path, none left out
            if t == n - 1:
                return worth(t, s) if s >= len(state) - 2 else -math.inf
            steps = [s, s + 1] + ([s + 2] if s % 2 == 1 and s + 2 < len(state) and state[s] != state[s + 2] else [])
            return worth(t, s) + max(best(t + 1, x) for x in steps if x < len(state))

        assert sum(r.score for r in found[key]) == pytest.approx(max(best(0, 0), best(0, 1)), abs=1e-3)


def test_clear_lines(spark):
    cases = [(0.99, False), (1.0, True), (0.0, False), (-0.5, False)]
    rows = [(i, k, "ALIGNABLE", 1.0 if k == 0 else 2.0 + gap, 2.0 if k == 0 else 9.0, "x") for i, (gap, _) in enumerate(cases) for k in (0, 1)]
    rows += [(9, 0, "ALIGNABLE", 1.0, 1.0, "x"), (9, 1, "ALIGNABLE", 5.0, 6.0, "x")]
    times = spark.createDataFrame(rows, "doc_id int, line_index int, kind string, start_s double, end_s double, text string")
    n = {r.doc_id: r.n for r in S.output_lines(times).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert [n[i] == 3 for i in range(4)] == [want for _, want in cases] and n[9] == 2


def test_padding(spark):
    rows = [("d", i, lab, a, b, 1.0, lab == "b") for i, (lab, a, b) in enumerate([("b", 0, 2), ("x", 2, 4), ("b", 4, 9), ("y", 9, 10), ("b", 10, 12)])]
    segs = spark.createDataFrame(rows, "doc_id string, seg int, label string, start_frame int, end_frame int, score double, is_blank boolean")
    got = [(r.padded_start, r.padded_end) for r in S.pad_with_blanks(segs).orderBy("seg").collect()]
    assert got == [(0, 6), (6, 12)]


def test_silence_after_tone(spark):
    rate = 1000
    tone = [0.5 * math.sin(2 * math.pi * 100 * t / rate) for t in range(rate)] + [0.0] * rate
    audio = spark.createDataFrame([("d", tone), ("short", [0.1])], "doc_id string, samples array<double>")
    levels = A.windows(audio, 40, 10).select("doc_id", (F.col("start") / rate).alias("at_s"), A.decibel(F.col("rms")).alias("db"))
    quiet = A.silences(levels.join(A.silence_threshold(levels), "doc_id"), 0.04)
    assert quiet.first().start_s == pytest.approx(1.0, abs=0.011)
    times = spark.createDataFrame([("d", 0, 0.5, 2.0)], "doc_id string, line_index int, end_s double, next_start double")
    assert A.correct_ends(times, quiet).first().end_s == pytest.approx(1.0, abs=0.011)


def test_chunks_and_trim(spark):
    audio = spark.createDataFrame([("d", [float(x) for x in range(1, 9)]), ("s", [1.0])], "doc_id string, samples array<float>")
    got = {(r.doc_id, r.chunk_index): r.samples for r in A.chunks(audio, 4, 2).collect()}
    assert got == {("d", 0): [0, 0, 1, 2, 3, 4, 5, 6], ("d", 1): [3, 4, 5, 6, 7, 8, 0, 0], ("s", 0): [1.0]}
    out = spark.createDataFrame([("d", c, f, 100 * c + f) for c in range(3) for f in range(6)], "doc_id string, chunk_index int, frame_in_chunk int, values int")
    kept = A.trimmed(out, 2, 3, spark.createDataFrame([("d", 8)], "doc_id string, n_frames int"))
    assert [r["values"] for r in kept.orderBy("frame").collect()] == [2, 3, 4, 102, 103, 104, 202, 203]


def test_log_softmax(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],)], "v array<double>").select(A.log_softmax(F.col("v")).alias("v"))
    assert [pytest.approx(r.v) for r in df.collect()] == [[-math.log(2)] * 2, [2 - math.log(math.e**2 + 1), -math.log(math.e**2 + 1)]]
    with pytest.raises(Exception):
        spark.createDataFrame([([0.0, 1.0],)], "v array<double>").select(A.log_probabilities(F.col("v"), "probabilities")).collect()


def test_spectra_roundtrip(spark):
    x = np.random.default_rng(1).normal(size=200).tolist()
    audio = spark.createDataFrame([("d", x)], "doc_id string, samples array<double>")
    back = A.resynthesis(A.spectra(audio, 32, 8), 32, 8).first().samples
    assert np.allclose(back, x[: len(back)], atol=1e-9)


def test_metrics_and_offset(spark):
    x = np.random.default_rng(2).normal(size=50)
    a = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate(x)], "doc_id string, i int, x double")
    b = a.withColumn("i", F.col("i") + 2)
    assert A.best_offset(a, b, 3).first().offset == -2
    same = a.select("doc_id", F.col("x").alias("a"), F.col("x").alias("b"))
    assert tuple(A.error_metrics(same).first())[1:] == (50, 0.0, 0.0, 999.0)
    # 33 s of samples for each region, 254,976 new ones a window: ceil(1455300 / 254976) = 6 each
    assert A.separation_regions(44100 * 60).windows.tolist() == [6, 6]


def test_compare_positions(spark):
    a = spark.createDataFrame([("d", 0, "x", 1.0), ("d", 1, "y", 2.0), ("d", 2, "z", 3.0)], "doc_id string, n int, text string, at double")
    b = spark.createDataFrame([("d", 0, "x", 1.4), ("d", 1, "q", 2.0)], "doc_id string, n int, text string, at double")
    assert [r.outcome for r in C.by_position(a, b, "n", 0.5).orderBy("k").collect()] == ["equal", "text", "missing"]


def test_violations(spark):
    rows = [("d", 0, 0.0, 1.0, 0.5), ("d", 2, -1.0, -2.0, float("nan"))]
    v = S.violations(spark.createDataFrame(rows, "doc_id string, number int, start double, end double, score double"))
    assert {r.problem for r in v.collect()} == {"negative start", "end before start", "number not one more", "start before the one before", "score not finite"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Hi\r\nyou\n".encode())
    (tmp_path / "b.txt").write_bytes(b"ab\xff")
    got = {r.doc_id.rsplit("/", 1)[1]: (r.text, r.bad_offset) for r in tables.read_sheets(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a.txt": ("Hi\nyou\n", None), "b.txt": (None, 2)}
    (tmp_path / "v.tok").write_text("<blank>\n<unk>\n<space>\na\na\n")
    vocab = tables.read_vocabulary(spark, str(tmp_path / "v.tok"))
    assert [r.text for r in vocab.orderBy("token_id").collect()] == ["<blank>", "<unk>", " ", "a", "a"]
    assert [r.problem for r in tables.vocabulary_problems(vocab).collect()] == ["duplicate"]
    (tmp_path / "v.json").write_text('{"a": 1, "b": 0}')
    assert {(r.token_id, r.text) for r in tables.vocabulary_from_json(spark, str(tmp_path / "v.json")).collect()} == {(1, "a"), (0, "b")}
    (tmp_path / "x.tsv").write_text("# head\nname\t6869\te78cab\n")
    r = tables.read_fixture(spark, str(tmp_path / "x.tsv")).first()
    assert (r.name, r.fields) == ("name", ["hi", "猫"])
    (tmp_path / "x.f32").write_bytes(struct.pack("<4f", 1, 2, 3, 4))
    assert [r.samples for r in wav.read_samples(spark, str(tmp_path / "x.f32"), 2).orderBy("channel").collect()] == [[1, 3], [2, 4]]
    dump = spark.createDataFrame([("d", i, x) for i, x in enumerate(["# v1", "[config]", "rate=16000", "name=a\\tb", "[rows]", "1\\t2"])], "doc_id string, line_index int, line string")
    assert [(r.section, r.row, r.key, r.value) for r in tables.parse_dump(dump).orderBy("section", "row").collect()] == [("config", 0, "rate", "16000"), ("config", 1, "name", "a\tb"), ("rows", 0, None, "1\t2")]


def test_stamped_roundtrip(spark, tmp_path):
    sheet = "[00:01.00]one\n\n[61:02.34]two\n"
    lines = tables.read_stamped(spark.createDataFrame([("d", sheet)], "doc_id string, text string"))
    assert tables.stamped_sheets(lines, "line_index").first().text == sheet
    tables.write_stamped(lines.withColumnRenamed("line_index", "out_index"), str(tmp_path / "out"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sheet.rstrip("\n")
    tables.write_stamped(lines.withColumnRenamed("line_index", "out_index"), str(tmp_path / "table"), by_document=False)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).collect()] == [("d", sheet)]


def test_stream_sessions(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = silence.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    batch = silence.levels(e)
    assert batch.agg(F.sum("n")).first()[0] == e.count()


def test_generate_with_blank_lines_and_silence(spark):
    from tactus.operators import lines as L
    from tactus.plans import generate as whole

    sheet = spark.createDataFrame([(1, "ab\n\n[Chorus]\ncd e\n"), (2, "zz")], "doc_id long, text string")
    vocab = L.vocabulary(spark)
    options = whole.Options(stars="none", emissions="log-probabilities")
    _, tokens = whole.target_tokens(sheet, vocab)
    said = whole.made_up_emissions(tokens.where("doc_id = 1"), len(L.TOKENS))
    late = said.withColumn("frame", F.when(F.col("frame") >= 6, F.col("frame") + 100).otherwise(F.col("frame")))
    still = late.where("frame = 0").select("doc_id", F.explode(F.sequence(F.lit(6), F.lit(105))).alias("frame"), "values")
    got = whole.generate(sheet, late.unionByName(still), vocab, options).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "[00:00.02]ab\n[00:00.12]\n\n[00:02.14]cd e\n")]
    quiet = spark.createDataFrame([(1, 0.5)], "doc_id long, start_s double")
    moved = whole.generate(sheet, late.unionByName(still), vocab, options, quiet).first().text
    assert moved == "[00:00.02]ab\n[00:00.50]\n\n[00:02.14]cd e\n"
    with pytest.raises(ValueError):
        whole.Options(split="sentence")
