"""Text functions as Column expressions: line predicates, normalisation, target text, escapes.

Only Unicode normalisation (``nfkc_lower``) needs Python; it is a vectorised UDF.
Romanisation uses the ICU library that Spark ships, on distinct words only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _class(*points: int | tuple[int, int]) -> str:
    """Code points and ranges as the inside of a regular-expression class."""
    return "".join("-".join(f"\\x{{{x:X}}}" for x in (p if isinstance(p, tuple) else (p,))) for p in points)


# Character classes that normalisation is defined by.
SPACE = _class(0x20, (0x09, 0x0D), 0x85, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
DIGIT = _class((0x30, 0x39), (0x09E6, 0x09EF), (0x17E0, 0x17E9), (0x0966, 0x096F), (0x0B66, 0x0B6F), (0x06F0, 0x06F9), (0xA900, 0xA909), (0xFF10, 0xFF19), (0x0D66, 0x0D6F), (0x1040, 0x1049), (0x2170, 0x2179), 0x206F)
DELETE = _class(0x200B, 0x200C, 0x200E, 0x200F, 0x202A, 0x202C, (0x064B, 0x0652), (0x0656, 0x0657))
QUOTE = _class(0x2018, 0x2019, 0x201B)
PUNCTUATION = (
    _class(*map(ord, '.?,:!{};()[]<>/-_|"'), 0x5C, 0xA1, 0xBF, 0x060C, 0x061B, 0x061F, 0x0964, 0xAB, 0xBB, (0x2039, 0x203A))
    + _class((0x3002, 0x300F), 0x22EF, 0x2500, (0xFF01, 0xFF0F), (0xFF1A, 0xFF1B), (0xFF1F, 0xFF20), (0xFF3B, 0xFF3F), (0xFF5B, 0xFF5E), 0xFE4F)
    + _class((0x055A, 0x055F), 0x0589, (0x2000, 0x206F))
)
BLANKS = r" \t\n\x0B\f"

KINDS = ("BLANK", "SECTION_MARKER", "PUNCTUATION_ONLY", "ALIGNABLE")


def canonical_newlines(text: Column) -> Column:
    """Byte-order mark dropped, CR LF and CR to LF."""
    return F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines of a text; a trailing newline adds none, and an empty text is one line."""
    return F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1)


def has_text(line: Column) -> Column:
    return line.rlike(r"[^ \t\n]")


def ascii_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def is_section_marker(line: Column) -> Column:
    """'[...]' or '(...)' after trimming; mismatched pairs count."""
    return ascii_trim(line).rlike(r"(?s)^[\[(].*[\])]$")


def split_words(line: Column) -> Column:
    """ASCII white space separates words; others, such as NBSP, don't."""
    return F.filter(F.split(line, f"[{BLANKS}]+", -1), lambda w: w != "")


def split_chars(line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "")


def remove_number_parentheses(text: Column) -> Column:
    number = rf"\([^)]*[{DIGIT}][^)]*\)"
    return F.regexp_replace(F.regexp_replace(text, f"^(?:{number})+", ""), number, " ")


def map_quotes_and_entities(text: Column) -> Column:
    quoted = F.regexp_replace(text, rf"(?<=[^{SPACE}])(?<!&lt;|&gt;|&nbsp)[{QUOTE}](?=[^{SPACE}])", "'")
    return F.regexp_replace(quoted, "&lt;|&gt;|&nbsp", "")


def replace_punctuation(text: Column) -> Column:
    """Delete set away, then runs of punctuation to one space; a leading run vanishes."""
    bare = F.regexp_replace(text, f"[{DELETE}]", "")
    return F.regexp_replace(F.regexp_replace(bare, f"^[{PUNCTUATION}]+", ""), f"[{PUNCTUATION}]+", " ")


def remove_numbers(text: Column) -> Column:
    """Digit runs that a space bounds; a text of digits alone stays."""
    d, s = f"[{DIGIT}]+", f"[{SPACE}]"
    return F.regexp_replace(text, f"^{d}(?={s})|(?<={s}){d}(?={s})|(?<={s}){d}$", " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def clean_chunk(lowered: Column) -> Column:
    """A word or character after NFKC and lower-casing, normalised for alignment."""
    return collapse_spaces(remove_numbers(replace_punctuation(map_quotes_and_entities(remove_number_parentheses(lowered)))))


def letters_only(text: Column) -> Column:
    """[a-z'] kept, all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z']+", " "))


def current_mode(line: Column) -> Column:
    """ASCII letters and digits lower-cased, blanks to one space, other ASCII dropped, the rest copied."""
    lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, f"[{BLANKS}]+", " "), r"[\x00-\x1F!-/:-@\[-`{-\x7F]+", ""))


def target_text(words: Column) -> Column:
    """Characters of each chunk with spaces between, chunks with a space between."""
    spaced = F.transform(words, lambda w: F.array_join(split_chars(w), " "))
    return F.array_join(F.filter(spaced, lambda w: w != ""), " ")


@F.pandas_udf(T.StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    """Unicode NFKC, then lower case."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


@F.pandas_udf(T.IntegerType())
def first_bad_byte(raw: pd.Series) -> pd.Series:
    """Offset of the first byte that isn't valid UTF-8, or null."""

    def of(b: bytes | None) -> int | None:
        try:
            bytes(b or b"").decode("utf-8")
        except UnicodeDecodeError as e:
            return e.start
        return None

    return raw.map(of).astype("Int32")


def effective_split(language: str, split: str) -> str:
    """Japanese and Chinese split into characters unless the mode is 'current'."""
    return "char" if split != "current" and language in ("jpn", "chi") else split


def romanize(words: DataFrame, column: str = "word", block: int = 20_000) -> DataFrame:
    """``words`` with ``romanized``: Any-Latin; Latin-ASCII, then letters only.

    Distinct non-ASCII words are transliterated on the driver, a block of ``block`` at a time in one
    call (they are streamed, never collected whole), and joined back; ASCII words need none.  A word
    that holds a line break is transliterated alone.
    """
    from tactus.sources.tables import scratch

    spark = words.sparkSession
    other = words.select(column).where(~F.col(column).rlike(r"^[\x00-\x7F]*$")).distinct()
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII")
    parts, held = [], []

    def flush() -> None:
        plain = [w for w in held if "\n" not in w]
        latin = icu.transliterate("\n".join(plain)).split("\n") if plain else []
        if len(latin) != len(plain):
            latin = [icu.transliterate(w) for w in plain]
        pairs = [*zip(plain, latin), *((w, icu.transliterate(w)) for w in held if "\n" in w)]
        parts.append(scratch(spark.createDataFrame(pairs, f"{column} string, latin string")))
        held.clear()

    for r in other.toLocalIterator():
        held.append(r[0])
        if len(held) >= block:
            flush()
    if held:
        flush()
    table = parts[0] if parts else spark.createDataFrame([], f"{column} string, latin string")
    for p in parts[1:]:
        table = table.unionByName(p)
    return words.join(table, column, "left").withColumn("romanized", letters_only(F.coalesce("latin", column))).drop("latin")


#: Control characters that a dump writes as \\xHH.
CONTROLS = [*(k for k in range(32) if chr(k) not in "\t\n\r"), 127]


def escape(text: Column) -> Column:
    """Backslash, tab, newline and carriage return as two-character escapes, other controls as \\xHH."""
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), *((chr(k), f"\\x{k:02X}") for k in CONTROLS)):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``; an escape that it doesn't write stays as it is."""

    def piece(x: Column) -> Column:
        for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), *((f"\\x{k:02X}", chr(k)) for k in CONTROLS)):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    # what stands between escaped backslashes, which are met from the left
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def dump_token(token: Column, is_star: Column) -> Column:
    """A token as dumps show it: '<star>' for a star, '<invalid>' for none."""
    return F.when(is_star, "<star>").otherwise(F.coalesce(escape(token), F.lit("<invalid>")))


def extension(path: Column) -> Column:
    """What follows the last dot of the last path part; null if nothing does, or if the part begins with its only dot."""
    return F.nullif(F.regexp_extract(path, r"^(?:.*/)?[^/]+\.([^./]+)$", 1), F.lit(""))
