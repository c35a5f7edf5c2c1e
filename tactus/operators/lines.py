"""Lines, words, segments and tokens of text sheets (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.functions import text

#: The default vocabulary, one token an id; 0 is the blank.
TOKENS = ["<blank>", "<pad>", "</s>", "<unk>", *"aienoutsrmkldghybpwcvjzf'qx"]


def lines(sheets: DataFrame) -> DataFrame:
    """doc_id, line_index, line."""
    return sheets.select("doc_id", F.posexplode(text.split_lines(text.canonical_newlines(F.col("text")))).alias("line_index", "line"))


def normalized_line(line, ascii_only: bool = False):
    """Words of a line normalised one by one and joined by a space."""
    lowered = F.lower(line) if ascii_only else text.nfkc_lower(line)
    return F.array_join(F.transform(text.split_words(lowered), text.clean_chunk), " ")


def line_kinds(of: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds kind; blank and section lines are decided before any normalisation."""
    body = F.trim(normalized_line(F.col("line"), ascii_only))
    # in Latin-1 a letter decides without normalising, unless parentheses or entities may take it away
    letter = F.col("line").rlike(r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]") & ~F.col("line").rlike(r"[(&]|[^\x{0}-\x{FF}]")
    kind = F.when(~text.has_text(F.col("line")), "BLANK").when(text.is_section_marker(F.col("line")), "SECTION_MARKER").when(letter, "ALIGNABLE").when(body != "", "ALIGNABLE").otherwise("PUNCTUATION_ONLY")
    return of.withColumn("kind", kind)


def segments(of: DataFrame, split: str = "word", romanize: bool = True, language: str = "eng") -> DataFrame:
    """Words or characters of lines with their normalised text and offsets in the document's
    normalised text (chunks joined by a space between words, by nothing between characters).
    A chunk is split off first, then normalised (NFKC, lower case, clean_chunk) and, with
    ``romanize``, brought to a-z and '.  Chunks that normalise to nothing keep their number and
    are empty.  Japanese and Chinese are always split into characters, but for the split 'current',
    which takes words under the older ASCII rule (``current_mode``) and neither NFKC nor romanises."""
    split = text.effective_split(language, split)
    line = F.col("line")
    pieces = {"word": text.split_words, "char": text.split_chars, "current": lambda x: text.split_words(text.current_mode(x))}[split](line)
    rows = of.select("doc_id", "line_index", F.posexplode(pieces).alias("place", "piece"))
    norm = F.col("piece") if split == "current" else text.clean_chunk(text.nfkc_lower("piece"))
    rows = rows.select("doc_id", "line_index", "place", F.lower("piece").alias("source"), norm.alias("norm"))
    if romanize and split != "current":
        rows = text.romanize(rows, "norm").withColumn("norm", F.col("romanized")).drop("romanized")
    w = Window.partitionBy("doc_id").orderBy("line_index", "place")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.lit(0 if split == "char" else 1) * F.count_if(F.col("norm") != "").over(before)
    start = F.coalesce(F.sum(F.length("norm")).over(before), F.lit(0)) + F.when(F.col("norm") != "", gap).otherwise(F.greatest(gap - 1, F.lit(0)))
    return rows.select("doc_id", "line_index", (F.row_number().over(w) - 1).alias("segment_index"), "source", "norm", start.cast("long").alias("norm_start"), (start + F.length("norm")).cast("long").alias("norm_end"))


def source_ranges(of: DataFrame) -> DataFrame:
    """Where each word of lines stands in the document's text: doc_id, line_index, place, piece, and its
    range in bytes of UTF-8 and in characters.  ``place`` is that of ``segments`` split by word."""
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(size("line") + 1).over(w), F.lit(0)).alias(name) for name, size in (("line_byte", F.octet_length), ("line_char", F.length))]
    runs = F.regexp_extract_all("line", F.lit(f"([{text.BLANKS}]+|[^{text.BLANKS}]+)"))
    rows = of.select("doc_id", "line_index", "line", *before).select("doc_id", "line_index", "line_byte", "line_char", F.posexplode(runs).alias("k", "piece"))
    inside = Window.partitionBy("doc_id", "line_index").orderBy("k")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[(F.col(f"line_{name}") + F.sum(size("piece")).over(upto)).alias(f"{name}_end") for name, size in (("byte", F.octet_length), ("char", F.length))])
    words = rows.where(~F.col("piece").rlike(f"^[{text.BLANKS}]"))
    place = F.row_number().over(inside) - 1
    return words.select("doc_id", "line_index", place.alias("place"), "piece", (F.col("byte_end") - F.octet_length("piece")).alias("byte_start"), "byte_end", (F.col("char_end") - F.length("piece")).alias("char_start"), "char_end")


def vocabulary(spark, tokens: list[str] = TOKENS) -> DataFrame:
    return spark.createDataFrame([(i, t, i == 0, t == "<unk>") for i, t in enumerate(tokens)], "token_id int, text string, is_blank boolean, is_unknown boolean")


def tokens(of: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per character of segments with its token; characters outside the vocabulary take
    the unknown token (null where there is none).  The vocabulary is a bounded parameter."""
    chars = of.select("doc_id", "line_index", "segment_index", "norm_start", F.posexplode(text.split_chars(F.col("norm"))).alias("place", "ch")).where("ch <> ' '")
    known = F.broadcast(vocab.where("not is_blank and not is_unknown").select("token_id", F.col("text").alias("ch")))
    unknown = F.lit(vocab.agg(F.max(F.when(F.col("is_unknown"), F.col("token_id")))).first()[0]).cast("int")
    w = Window.partitionBy("doc_id").orderBy("segment_index", "place")
    return chars.join(known, "ch", "left").select("doc_id", (F.row_number().over(w) - 1).alias("token_index"), "ch", F.coalesce(F.col("token_id").cast("int"), unknown).alias("token_id"), "line_index", "segment_index", (F.col("place") == 0).alias("starts_segment"), (F.col("norm_start") + F.col("place")).alias("norm_start"))


def longest_matches(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """For each offset of ``texts`` (key, text) the longest vocabulary entry that starts there, the
    lowest id of equal ones: equi-joins on substrings, one for each entry length."""
    words = vocab.where("not is_blank and not is_unknown and text <> ''").select("token_id", F.col("text").alias("piece"))
    sizes = [r[0] for r in words.select(F.length("piece")).distinct().collect()]
    at = texts.where("text <> ''").select("key", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("pos"))
    pieces = at.select("key", "pos", F.explode(F.array(*[F.substring(F.col("text"), F.col("pos"), F.lit(n)) for n in sorted(sizes)])).alias("piece"))
    found = pieces.join(F.broadcast(words), "piece")
    return found.groupBy("key", "pos").agg(F.max(F.struct(F.length("piece").alias("size"), (-F.col("token_id")).alias("id"))).alias("best")).select("key", (F.col("pos") - 1).alias("pos"), F.col("best.size").alias("size"), (-F.col("best.id")).alias("token_id"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The outer range (doc_id, number, start, end) that contains each inner one, if any.  Outer ranges
    don't overlap, so it can only be the last that starts at or before the inner one: one ordered pass
    over both, without pairing them."""
    o = outer.where("end > start").select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("number", "end").alias("outer"), F.lit(None).cast(inner.schema["number"].dataType).alias("own"), F.lit(None).cast(inner.schema["end"].dataType).alias("own_end"))
    i = inner.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(o.schema["outer"].dataType).alias("outer"), F.col("number").alias("own"), F.col("end").alias("own_end"))
    w = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = o.unionByName(i).withColumn("outer", F.last("outer", True).over(w)).where("kind = 1 and own_end <= outer.end")
    return inner.join(last.select("doc_id", F.col("own").alias("number"), F.col("outer.number").alias("outer_number")), ["doc_id", "number"], "left")
