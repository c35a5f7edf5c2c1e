import unicodedata

import pytest
from pyspark.sql import functions as F

from tactus.functions import clock, text
from tactus.operators import lines as L


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Hello, WORLD!", ["hello", "world"]),
        ("Don’t stop, I'm yours", ["don't", "stop", "i'm", "yours"]),
        ("Track 01: go!!! 2024", ["track", "", "go", "2024"]),
        ("Café coração déjà vu", ["café", "coração", "déjà", "vu"]),
        ("", []),
    ],
)
def test_words(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string").select(F.transform(text.split_words(text.nfkc_lower("line")), text.clean_chunk).alias("w"))
    assert df.first().w == expected


@pytest.mark.parametrize("line, expected", [("Hi, yo!", ["h", "i", "", "", "y", "o", ""]), ("歌う猫", ["歌", "う", "猫"]), ("你好！", ["你", "好", ""])])
def test_chars(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string").select(F.transform(text.split_chars(text.nfkc_lower("line")), text.clean_chunk).alias("w"))
    assert df.first().w == expected


def test_clean_chunk_stages(spark):
    cases = {"a(12)b": "a b", "(1)(2)x": "x", "&lt;b&gt;": "b", "x​y": "xy", "¿qué?": "qué", "7": "7", "a 7 b": "a b", "no.5": "no", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.clean_chunk(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases


def test_lines_and_kinds(spark):
    sheet = "﻿  Hello, WORLD!!\r\n[Chorus]\r\n\r\n...\nBang-bang\n"
    df = L.line_kinds(L.lines(spark.createDataFrame([("d", sheet), ("e", ""), ("n", None)], "doc_id string, text string"))).orderBy("doc_id", "line_index")
    assert [(r.doc_id, r.kind) for r in df.collect()] == [("d", "ALIGNABLE"), ("d", "SECTION_MARKER"), ("d", "BLANK"), ("d", "PUNCTUATION_ONLY"), ("d", "ALIGNABLE"), ("e", "BLANK")]


def test_target_and_segments(spark):
    df = spark.createDataFrame([(["hello", "", "world"],)], "w array<string>").select(text.target_text(F.col("w")).alias("t"))
    assert df.first().t == "h e l l o w o r l d"
    lines = spark.createDataFrame([("d", 0, "Hello, WORLD!!"), ("d", 1, "?! x")], "doc_id string, line_index int, line string")
    got = [(r.norm, r.norm_start, r.norm_end) for r in L.segments(lines).orderBy("segment_index").collect()]
    assert got == [("hello", 0, 5), ("world", 6, 11), ("", 11, 11), ("x", 12, 13)]
    toks = L.tokens(L.segments(lines), L.vocabulary(spark)).orderBy("token_index").collect()
    assert "".join(r.ch for r in toks) == "helloworldx" and [r.starts_segment for r in toks].count(True) == 3
    assert toks[0].token_id == L.TOKENS.index("h")


def test_segments_take_the_whole_normalisation(spark):
    """NFKC and romanisation reach the tokens: none of these letters is unknown."""
    lines = spark.createDataFrame([("d", 0, "Ｃafé ﬁn\u00a0Straße Привет 猫 77"), ("d", 1, "l’Été")], "doc_id string, line_index int, line string")
    segs = L.segments(lines)
    assert [r.norm for r in segs.orderBy("segment_index").collect()] == ["cafe", "fin strasse", "privet", "mao", "", "l'ete"]
    toks = L.tokens(segs, L.vocabulary(spark))
    assert toks.where("token_id = 3").count() == 0 and toks.count() == 4 + 10 + 6 + 3 + 5
    plain = [r.norm for r in L.segments(lines, romanize=False).orderBy("segment_index").collect()]
    assert plain == ["café", "fin straße", "привет", "猫", "77", "l'été"]


def test_generation_romanizes_unless_told(spark):
    from tactus.plans import generate as whole

    sheet = spark.createDataFrame([(1, "Été")], "doc_id long, text string")
    ids = lambda o: [r.token_id for r in whole.target_tokens(sheet, L.vocabulary(spark), o)[1].orderBy("token_index").collect()]
    assert ids(whole.Options()) == [L.TOKENS.index(c) for c in "ete"]
    assert ids(whole.Options(romanize=False)) == [3, L.TOKENS.index("t"), 3]


def test_romanize(spark):
    words = spark.createDataFrame([("猫",), ("Привет",), ("你好",), ("hello",)], "word string")
    got = {r.word: r.romanized for r in text.romanize(words).collect()}
    assert got == {"猫": "mao", "Привет": "privet", "你好": "ni hao", "hello": "hello"}


def test_effective_split():
    assert [text.effective_split(*x) for x in (("jpn", "word"), ("chi", "current"), ("eng", "word"))] == ["char", "current", "word"]


def test_nfkc_matches_unicodedata(spark):
    s = ["Ａｂ①ﬁ", "ÅΣ", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in s], "t string").select(text.nfkc_lower("t")).collect()]
    assert got == [None if x is None else unicodedata.normalize("NFKC", x).lower() for x in s]


def test_escape_roundtrip(spark):
    s = "a\\tb\tc\nd\re\\\\"
    r = spark.createDataFrame([(s,)], "t string").select(text.escape(F.col("t")).alias("e"), text.unescape(text.escape(F.col("t"))).alias("b")).first()
    assert r.b == s and "\n" not in r.e and "\t" not in r.e


@pytest.mark.parametrize("h, stamp", [(0, "[00:00.00]"), (1, "[00:00.01]"), (5999, "[00:59.99]"), (6000, "[01:00.00]"), (6234, "[01:02.34]"), (360000, "[60:00.00]")])
def test_stamps(spark, h, stamp):
    df = spark.createDataFrame([(h, stamp + "x y")], "h int, line string")
    r = df.select(clock.stamp(F.col("h")), clock.parse_stamp(F.col("line")), clock.stamped_text(F.col("line"))).first()
    assert tuple(r) == (stamp, h, "x y")


def test_bad_stamps_and_rounding(spark):
    df = spark.createDataFrame([("[00:60.00]Bad",), ("[00:00.1]Bad",)], "line string").select(clock.parse_stamp(F.col("line")))
    assert [r[0] for r in df.collect()] == [None, None]
    s = spark.createDataFrame([(1.231,), (1.236,), (59.996,), (-1.0,), (float("nan"),)], "s double").select(clock.hundredths(F.col("s")))
    assert [r[0] for r in s.collect()] == [123, 124, 6000, None, None]
