"""Checks, options, WAV files, separation, and the corners of text and times that queries don't reach."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.functions import clock, frames, text
from tactus.operators import align as G
from tactus.operators import audio as A
from tactus.operators import checks as K
from tactus.operators import lines as L
from tactus.operators import separation as X
from tactus.plans import dumps
from tactus.plans import generate as whole
from tactus.plans import options as O
from tactus.sources import tables, wav


def test_default_vocabulary():
    letters = {"a": 4, "i": 5, "e": 6, "n": 7, "o": 8, "u": 9, "t": 10, "s": 11, "r": 12, "m": 13, "k": 14, "l": 15, "d": 16, "g": 17, "h": 18, "y": 19, "b": 20, "p": 21, "w": 22, "c": 23, "v": 24, "j": 25, "z": 26, "f": 27, "'": 28, "q": 29, "x": 30}
    assert {t: i for i, t in enumerate(L.TOKENS)} == {"<blank>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3} | letters


def test_stamps_beyond_range(spark):
    cases = {"[357913:56.00]x": (357913 * 60 + 56) * 100, "[357914:00.00]x": None, "[400000:00.00]": None, "[99999999999999999999:00.00]": None, "[0000000000000000000001:02.03]": 6203, "[1:60.00]": None, "[-1:00.00]": None}
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r.line: r.h for r in df.select("line", clock.parse_stamp(F.col("line")).alias("h")).collect()}
    assert got == cases
    sheet = spark.createDataFrame([("d", "[400000:00.00]x\n[00:01.00]y")], "doc_id string, text string")
    assert [r.kind for r in tables.read_stamped(sheet).orderBy("line_index").collect()] == ["BAD", "TIMESTAMPED"]


def test_escapes(spark):
    cases = {"a\\b\tc\nd\re": "a\\\\b\\tc\\nd\\re", "\x00\x1f\x7f": "\\x00\\x1F\\x7F", "\\n": "\\\\n", "\\\\\n": "\\\\\\\\\\n", "\\x00": "\\\\x00", "": "", "é猫": "é猫"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", text.escape(F.col("t")).alias("e"), text.unescape(text.escape(F.col("t"))).alias("b")).collect()
    assert {r.t: r.e for r in rows} == cases and all(r.b == r.t for r in rows)
    token = spark.createDataFrame([("a\t", False), (None, True), (None, False)], "t string, s boolean")
    assert [r[0] for r in token.select(text.dump_token(F.col("t"), F.col("s"))).collect()] == ["a\\t", "<star>", "<invalid>"]


def test_extensions(spark):
    cases = {"a/b.wav": "wav", "a.b/c": None, ".wav": None, "x/.wav": None, "a.tar.gz": "gz", "a.": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", text.extension(F.col("p"))).collect()} == cases


def test_split_modes(spark):
    lines = spark.createDataFrame([(1, 0, "Hey, Ünï 3!")], "doc_id long, line_index int, line string")
    norms = lambda **k: [r.norm for r in L.segments(lines, **k).orderBy("segment_index").collect()]
    assert norms(split="current") == ["hey", "Ünï", "3"]
    assert norms(language="jpn")[:3] == ["h", "e", "y"] and norms(split="current", language="jpn") == ["hey", "Ünï", "3"]
    assert norms() == ["hey", "uni", "3"] or norms()[:2] == ["hey", "uni"]


def test_romanize_in_blocks_equals_word_by_word(spark):
    words = ["猫", "Привет", "你好", "größe", "ελληνικός", "שלום", "مرحبا", "नमस्ते", "東京", "ſ", "ß", "Ñandú", "日本語", "한국어", "σς", "a\nб"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII")
    one = spark.createDataFrame([(w, icu.transliterate(w)) for w in words], "word string, latin string")
    want = {r.word: r.r for r in one.select("word", text.letters_only(F.col("latin")).alias("r")).collect()}
    for block in (2, 5, 100):
        assert {r.word: r.romanized for r in text.romanize(df, block=block).collect()} == want


def test_infeasible_counts_stars(spark):
    tokens = spark.createDataFrame([(1, i, 5 + i, i == 0) for i in range(3)], "doc_id long, token_index int, token_id int, starts_segment boolean")
    em = spark.createDataFrame([(1, i, [0.0] * 10) for i in range(3)], "doc_id long, frame int, values array<double>")
    for stars, required in (("none", 3), ("edges", 5), ("segment", 4)):
        assert G.required_frames(tokens, stars).first().required == required
        searched = G.align(em, tokens, stars=stars).count()
        assert (searched > 0) == (required <= 3) == (G.infeasible(em, tokens, stars).count() == 0)


def test_search_keeps_ties_over_many_frames():
    """Paths found from kept rows equal those of a full table of predecessors, ties included."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        labels = rng.integers(1, 4, rng.integers(1, 6)).tolist()
        t = int(rng.integers(2 * len(labels), 60))
        scores = rng.integers(-3, 0, (t, 4)).astype(np.float32)  # many ties
        state = [0 if k % 2 == 0 else labels[k // 2] for k in range(2 * len(labels) + 1)]
        best = [[-math.inf] * len(state) for _ in range(t)]
        back = [[0] * len(state) for _ in range(t)]
        best[0][:2] = [float(scores[0][state[0]]), float(scores[0][state[1]])]
        for f, s in itertools.product(range(1, t), range(len(state))):
            top, k = best[f - 1][s], 0
            for j in (1, 2):
                if s >= j and (j == 1 or s % 2 and state[s] != state[s - 2]) and best[f - 1][s - j] > top:
                    top, k = best[f - 1][s - j], j
            best[f][s], back[f][s] = top + float(scores[f][state[s]]), k
        at = len(state) - 1 if best[-1][-1] > best[-1][-2] else len(state) - 2
        want = [at]
        for f in range(t - 1, 0, -1):
            at -= back[f][at]
            want.append(at)
        assert G.search(scores, labels).tolist() == want[::-1]


def test_stars_in_labels(spark):
    tokens = spark.createDataFrame([(1, 0, 7, True), (1, 1, 8, False), (1, 2, 9, True)], "doc_id long, token_index int, token_id int, starts_segment boolean")
    shown = lambda stars: [r.token_index for r in K.graph_labels(tokens, stars).orderBy("label_index").collect()]
    assert shown("none") == [0, 1, 2] and shown("edges") == [None, 0, 1, 2, None] and shown("segment") == [None, 0, 1, None, 2]


def test_stars_through_the_padded_pipeline(spark):
    tokens = spark.createDataFrame([(1, 0, 5, True), (1, 1, 5, False), (1, 2, 6, True)], "doc_id long, token_index int, token_id int, starts_segment boolean")
    rng = np.random.default_rng(0)
    em = spark.createDataFrame([(1, i, np.log(rng.dirichlet(np.ones(8))).tolist()) for i in range(30)], "doc_id long, frame int, values array<double>")
    for stars in ("none", "edges", "segment"):
        path = G.align(em, tokens, stars=stars)
        got = K.padded_spans(path, tokens, stars).orderBy("token_index").collect()
        assert [r.token_index for r in got] == [0, 1, 2] and all(r.problem is None and r.padded_start <= r.start_frame < r.end_frame <= r.padded_end for r in got)
        steps = path.select("doc_id", F.col("frame").alias("number"), "state", "score")
        assert K.stage_problems("steps", steps).count() == 0
        segs = K.path_segments(path).select("doc_id", F.col("seg").alias("number"), "start_frame", "end_frame", "score")
        assert K.stage_problems("segments", segs).count() == 0
        K.require(K.token_matches(K.S.token_spans(path), tokens))
    wrong = tokens.withColumn("token_id", F.col("token_id") + 1)
    assert K.padded_spans(path, wrong, "segment").where("problem = 'label differs'").count() == 3
    with pytest.raises(ValueError):
        K.require(K.token_matches(K.S.token_spans(path), wrong))
    with pytest.raises(Exception, match="label differs"):
        K.strict(K.padded_spans(path, wrong, "segment")).collect()


def test_strict_names_the_least_problem(spark):
    kind = "doc_id long, problem string"
    rows = spark.createDataFrame([(1, "span without interval"), (2, "label differs"), (1, "label differs"), (3, None)], kind).coalesce(1)
    with pytest.raises(Exception, match="integrity: label differs in 1"):
        K.strict(rows).collect()
    good = K.strict(rows.where("problem is null"))
    assert good.columns == ["doc_id"] and [r.doc_id for r in good.collect()] == [3]


def test_step_and_line_problems(spark):
    steps = spark.createDataFrame([(1, 0, 2, -1.0), (1, 1, 1, float("nan")), (1, 3, 4, -1.0)], "doc_id long, number int, state int, score double")
    assert sorted((r.number, r.problem) for r in K.stage_problems("steps", steps).collect()) == [(0, "first state beyond 1"), (1, "score not finite"), (1, "state goes back"), (3, "number not one more"), (3, "state jumps")]
    lines = spark.createDataFrame([(1, 0, "ALIGNABLE", 1.0, 2.0), (1, 1, "BLANK", None, None), (1, 2, "ALIGNABLE", 0.5, 0.4), (1, 3, "BLANK", 1.0, None), (1, 4, "ALIGNABLE", None, 3.0)], "doc_id long, number int, kind string, start_s double, end_s double")
    assert {(r.number, r.problem) for r in K.stage_problems("lines", lines).collect()} == {(2, "end before start"), (2, "start before the one before"), (3, "blank with times"), (4, "timed without times")}


def test_shapes(spark):
    df = spark.createDataFrame([([2, 3],), ([1, 4, 5],), ([2, 4, 5],), ([0, 3],), ([2**40, 2**40],), ([7],)], "s array<long>")
    rows = df.select(frames.elements(F.col("s")), frames.emission_shape(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(6, [2, 3]), (20, [4, 5]), (40, None), (None, None), (None, [2**40, 2**40]), (7, None)]


@pytest.mark.parametrize("depth", [16, 24, 32])
def test_wav_roundtrip(spark, depth):
    rng = np.random.default_rng(1)
    x = [rng.uniform(-1, 1, 101).astype(np.float32) for _ in range(2)]
    audio = spark.createDataFrame([("a", c, 16000, [float(v) for v in s]) for c, s in enumerate(x)], "doc_id string, channel int, sample_rate int, samples array<float>")
    raw = wav.encoded(audio, depth).first().content
    rate, back = wav.parse(bytes(raw))
    assert rate == 16000 and back.shape == (101, 2) and np.abs(back - np.stack(x, 1)).max() < 2.0 ** (1 - min(depth, 24))


def test_wav_files_of_all_kinds(spark, tmp_path):
    wav_of = lambda code, depth, body, extra=b"": b"RIFF\0\0\0\0WAVELIST\x03\0\0\0abc\0fmt " + (16 + len(extra)).to_bytes(4, "little") + b"".join(v.to_bytes(n, "little") for v, n in ((code, 2), (1, 2), (8000, 4), (0, 4), (0, 2), (depth, 2))) + extra + b"data" + len(body).to_bytes(4, "little") + body
    files = {"8.wav": wav_of(1, 8, bytes([0, 128, 192])), "24.wav": wav_of(1, 24, b"\0\0\x40\0\0\xc0"), "64.wav": wav_of(3, 64, np.array([0.25]).tobytes()), "x.wav": wav_of(0xFFFE, 16, b"\0\x40", bytes([22, 0, 16, 0, 4, 0, 0, 0, 1, 0]) + bytes(14)), "bad.wav": b"RIFF\0\0", "none.wav": b"RIFF\0\0\0\0WAVE", "law.wav": wav_of(7, 8, b"\0"), "odd.f32": b"12345"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.doc_id.rsplit("/", 1)[1]: r for r in wav.read_samples(spark, str(tmp_path)).collect()}
    assert got["8.wav"].samples == [-1, 0, 0.5] and got["24.wav"].samples == [0.5, -0.5] and got["64.wav"].samples == [0.25] and got["x.wav"].samples == [0.5]
    assert {k: got[k].problem for k in ("bad.wav", "none.wav", "law.wav", "odd.f32")} == {"bad.wav": "no RIFF WAVE header", "none.wav": "no data chunk", "law.wav": "format 7 of 8 bits", "odd.f32": "length is no multiple of the sample size"}


def test_mono_and_resampling(spark):
    audio = spark.createDataFrame([("a", 0, 4, [0.0, 1.0, 2.0, 3.0], None), ("a", 1, 4, [2.0, 1.0, 0.0, 3.0], None)], "doc_id string, channel int, sample_rate int, samples array<float>, problem string")
    r = wav.mono(audio).first()
    assert r.samples == [1, 1, 1, 3] and r.seconds == 1
    assert wav.mono(audio, 8).first().samples == [1, 1, 1, 1, 1, 2, 3, 3] and wav.mono(audio, 2).first().samples == [1, 1]


def test_separation(spark):
    g = X.Geometry(n_fft=16, hop=4, dim_f=9, dim_t=17, rate=10, chunk_seconds=10, margin_seconds=3, compensate=1.0)
    rng = np.random.default_rng(5)
    sound = [rng.uniform(-0.9, 0.9, n) for n in (5, 100, 333)]
    songs = spark.createDataFrame([(k, x.tolist(), (-x).tolist()) for k, x in enumerate(sound)], "doc_id long, left array<double>, right array<double>")
    for denoise in (False, True):
        for r in X.joined(X.separate(songs, lambda t: t * 0.5, g, denoise)).collect():
            assert np.allclose(r.left, sound[r.doc_id] * 0.5, atol=1e-5) and np.allclose(r.right, -sound[r.doc_id] * 0.5, atol=1e-5)
    for r in X.joined(X.separate(songs, lambda t: t * 0.25, g, residual=True)).collect():
        assert np.allclose(r.left, sound[r.doc_id] * 0.75, atol=1e-5)
    for bad in ({"n_fft": 15}, {"dim_f": 10}, {"hop": 0}, {"margin_seconds": -1}, {"dim_t": 5}):
        with pytest.raises(ValueError):
            X.Geometry(**({"n_fft": 16, "hop": 4, "dim_f": 9, "dim_t": 17} | bad))


def test_pack_leaves_high_bins_out():
    g = X.Geometry(n_fft=16, hop=4, dim_f=3, dim_t=17)
    t = np.arange(g.chunk)
    low, high = np.cos(2 * np.pi * t / 16), np.cos(2 * np.pi * 6 * t / 16)
    left, right = X.unpack(X.pack(low, high, g), g)
    middle = slice(16, -16)
    assert np.allclose(left[middle], low[middle], atol=0.02) and np.abs(right[middle]).max() < 0.1


def test_emitter(spark):
    chunks = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [5.0])], "doc_id long, chunk_index int, samples array<double>")
    rows = X.emitted(chunks, lambda x: np.repeat(x[:, :, None], 3, 2)).collect()
    assert sorted((r.doc_id, r.chunk_index, r.frame_in_chunk, r["values"][2]) for r in rows) == [(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 3), (1, 1, 1, 4), (2, 0, 0, 5)]
    with pytest.raises(Exception, match="chunks x frames x vocabulary"):
        X.emitted(chunks, lambda x: x).collect()
    with pytest.raises(ValueError):
        X.onnx_model("x", "tpu")


def test_options():
    env = {"TACTUS_MODEL_CTC": "m", "TACTUS_TOKENIZER": "t"}
    o = O.parse(["--input-vocals", "a.b/song.wav", "--language", "POR", "-o", "out", "--chunk-seconds", "7"], env)
    assert (o["--input-lyrics"], o["--output-lrc"], o["--language"], o["--chunk-seconds"], o["--star-frequency"], o["--model-ctc"]) == ("a.b/song.txt", "out", "por", 7, "edges", "m")
    assert O.parse(["--emissions-table", "e", "-l", "x/y.txt"], {})["--output-lrc"] == "x/y.lrc"
    for argv in ([], ["--input-song", "a", "--input-vocals", "b"], ["--input-song", "a"], ["--emissions-table", "e", "--margin-seconds", "-1"], ["--emissions-table", "e", "--hop", "0"], ["--emissions-table", "e", "--language", "en"], ["--emissions-table", "e", "--split-size", "sentence"], ["--emissions-table", "e", "--compensate", "nan"]):
        with pytest.raises(SystemExit):
            O.parse(argv, {})
    assert O.option_name("--lyrics") == "--input-lyrics" and O.option_name("--nothing") is None
    assert O.enum_name("STAR_MODE_EDGES", "STAR_MODE_") == "edges" and O.enum_name("OTHER", "STAR_") == "invalid"
    assert O.sibling("a.b/c", ".lrc") == "a.b/c.lrc" and O.sibling(".hidden", ".x") == ".hidden.x"
    assert O.missing_assets({"a": None, "b": "/no/such", "c": "/"}) == {"a": "not given", "b": "not there"} and O.first_existing([None, "/no", "/"]) == "/"
    assert len(O.VALUES) == 27 and whole.Options().stars == "edges" and whole.Options().emissions == "logits"
    with pytest.raises(ValueError):
        whole.Options(language="english")


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "song.txt").write_text("ab\n\ncd\n")
    sheet = spark.createDataFrame([("song", "ab\n\ncd\n")], "doc_id string, text string")
    _, tokens = whole.target_tokens(sheet, L.vocabulary(spark))
    whole.made_up_emissions(tokens, len(L.TOKENS)).write.parquet(str(tmp_path / "em"))
    O.main(["--emissions-table", str(tmp_path / "em"), "-l", str(tmp_path / "song.txt"), "--output-lrc", str(tmp_path / "out"), "--star-frequency", "none", "--emissions", "log-probabilities"])
    assert [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("song", "[00:00.02]ab\n\n[00:00.14]cd\n")]


def test_first_frames_and_merges(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.2, 2.0), (1, 2, 3.0, 4.0)], "doc_id long, number int, start_s double, end_s double")
    assert [r.start_s for r in A.merged_spans(spans, 0.5).orderBy("number").collect()] == [0.0, 1.0, 3.0]


def test_dumps(spark):
    sheet = spark.createDataFrame([(1, "ab c\n\nd\te\n")], "doc_id long, text string")
    vocab = L.vocabulary(spark)
    options = whole.Options(emissions="log-probabilities", stars="none")
    _, tokens = whole.target_tokens(sheet, vocab, options)
    em = whole.made_up_emissions(tokens, len(L.TOKENS))
    found = dumps.sections(sheet, em, vocab, options)
    rows = dumps.dump_lines(found).orderBy("section", "row").collect()
    heads = [r.line for r in rows if r.row == -2]
    assert heads == ["[config]", "[normalized_text]", "[target_text]", "[target_tokens]", "[frames]", "[merged_path_segments]", "[word_spans_after_padding]"]
    lines = [r.line for r in rows]
    assert "language=eng" in lines and "text=ab c d e" in lines and "text=a b c d e" in lines and "emission_frame_count=15" in lines
    assert "0\t4\ta\t0\t0\t1\t0\t1" in lines and "index\tline_index\tword_index\ttext\tnormalized_start\tnormalized_end\tstart_seconds\tend_seconds\tscore" in lines
    words = found["word_spans_after_padding"].orderBy("index").collect()
    assert [w.text for w in words] == ["ab", "c", "d", "e"] and [round(w.start_seconds, 2) for w in words] == [0.0, 0.12, 0.18, 0.24]
    assert dumps.compare(found, found).count() == 0
    moved = found | {"word_spans_after_padding": found["word_spans_after_padding"].withColumn("end_seconds", F.col("end_seconds") + F.when(F.col("index") == 2, 1.0).otherwise(0.0)), "target_tokens": found["target_tokens"].where("index < 4")}
    assert sorted((r.section, r["index"], r.field) for r in dumps.compare(found, moved).collect()) == [("target_tokens", 4, "count"), ("word_spans_after_padding", 2, "end_seconds")]
    assert [r.end_delta for r in dumps.word_deltas(found["word_spans_after_padding"], moved["word_spans_after_padding"], 3).orderBy("index").collect()] == [0, 0, -1]
