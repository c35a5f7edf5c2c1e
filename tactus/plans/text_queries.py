"""Queries over text tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import clock, text
from tactus.operators import lines as L
from tactus.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheets(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), "text")


def lines_sql(name: str = "documents", key: str = "doc_id") -> str:
    body = r"string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10))"
    return f"l as (select doc_id, unnest(range(0, len(a))) as line_index, unnest(a) as line from (select {key} as doc_id, {body} as a from {name}))"


BL = r"[ \t\n\x0B\f]"


def lowered_words_sql(of: str = "l") -> str:
    return rf"w as (select doc_id, line_index, unnest(range(0, len(a))) as place, unnest(a) as source from (select doc_id, line_index, list_filter(regexp_split_to_array(lower(line), '{BL}+'), lambda x: x <> '') as a from {of}))"


def q(x: str) -> str:
    """A regular-expression class as a SQL literal's inside."""
    return x.replace("'", "''")


def paren_sql(x: str) -> str:
    n = rf"\([^)]*[{text.DIGIT}][^)]*\)"
    return f"regexp_replace(regexp_replace({x}, '^(?:{n})+', ''), '{n}', ' ', 'g')"


def punct_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[{text.DELETE}]', '', 'g'), '^[{text.PUNCTUATION}]+', ''), '[{text.PUNCTUATION}]+', ' ', 'g')"


def spaces_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{text.SPACE}]+', ' ', 'g'))"


def numbers_sql(x: str) -> str:
    """Tokens of digits alone away where any space bounds them, for texts whose spaces are plain."""
    return f"case when contains({x}, ' ') then array_to_string(list_filter(string_split({x}, ' '), lambda t: not regexp_full_match(t, '[{text.DIGIT}]+')), ' ') else {x} end"


def quotes_sql(x: str) -> str:
    s, qu = text.SPACE, text.QUOTE
    return rf"regexp_replace(regexp_replace({x}, '([^{s}])[{qu}]([^{s}])', '\1''\2', 'g'), '&lt;|&gt;|&nbsp', '', 'g')"


def clean_sql(of: str, source: str = "source") -> str:
    """CTEs that add norm to ``of``."""
    return f"c1 as (select *, {punct_sql(quotes_sql(paren_sql(source)))} as p from {of}), c as (select * exclude (p), {spaces_sql(numbers_sql('p'))} as norm from c1)"


@query(f"with {lines_sql()} select doc_id, line_index, line from l")
def lines_split(spark, sf_dir):
    return L.lines(sheets(spark, sf_dir))


KIND_SQL = rf"""
with {lines_sql()}, {lowered_words_sql()}, {clean_sql("w")},
n as (select doc_id, line_index, count(*) filter (norm <> '') as k from c group by all)
select l.doc_id, l.line_index, case when not regexp_matches(line, '[^ \t\n]') then 'BLANK'
  when regexp_matches(regexp_replace(regexp_replace(line, '^{BL}+', ''), '{BL}+$', ''), '(?s)^[\[(].*[\])]$') then 'SECTION_MARKER'
  when coalesce(k, 0) > 0 then 'ALIGNABLE' else 'PUNCTUATION_ONLY' end as kind
from l left join n using (doc_id, line_index)"""


@query(KIND_SQL)
def line_kinds(spark, sf_dir):
    return L.line_kinds(L.lines(sheets(spark, sf_dir))).select("doc_id", "line_index", "kind")


@query(f"select doc_id, kind, count(*) as n_lines from ({KIND_SQL}) group by all")
def line_kind_counts(spark, sf_dir):
    return L.line_kinds(L.lines(sheets(spark, sf_dir))).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"with {lines_sql()}, {lowered_words_sql()} select doc_id, line_index, place, source as word from w")
def word_segments(spark, sf_dir):
    rows = L.lines(sheets(spark, sf_dir))
    return rows.select("doc_id", "line_index", F.posexplode(text.split_words(F.lower("line"))).alias("place", "word"))


@query(f"with {lines_sql('benchmark', 'item_id')} select doc_id, line_index, unnest(range(0, len(line))) as place, unnest(string_split(line, '')) as ch from l where line <> ''")
def char_segments(spark, sf_dir):
    rows = L.lines(sheets(spark, sf_dir, "benchmark", "item_id"))
    return rows.select("doc_id", "line_index", F.posexplode(text.split_chars(F.col("line"))).alias("place", "ch"))


@query(f"with {lines_sql('conversations', 'conv_id * 1000 + turn')}, {lowered_words_sql()}, {clean_sql('w')} select doc_id, line_index, place, source, norm from c")
def normalize_words(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    rows = L.lines(conv).select("doc_id", "line_index", F.posexplode(text.split_words(F.lower("line"))).alias("place", "source"))
    return rows.withColumn("norm", text.clean_chunk(F.col("source")))


_PAREN = "concat('(', cast({c} as varchar), ') ', {t}, ' (', cast({c} % 97 as varchar), 'x) ', cast({c} as varchar))"


def _numbered(spark, sf_dir) -> DataFrame:
    """Item texts with numbers around, in and out of parentheses."""
    c = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("("), c, F.lit(") "), "text", F.lit(" ("), (F.col("item_id") % 97).cast("string"), F.lit("x) "), c).alias("t"))


_N_SQL = f"n as (select item_id, {_PAREN.format(c='item_id', t='text')} as t from benchmark)"


@query(f"with {_N_SQL} select item_id, {paren_sql('t')} as out from n")
def number_paren_removed(spark, sf_dir):
    return _numbered(spark, sf_dir).select("item_id", text.remove_number_parentheses(F.col("t")).alias("out"))


@query(f"with {_N_SQL}, s as (select item_id, replace(t, chr(10), ' ') as t from n) select item_id, {spaces_sql(numbers_sql('t'))} as out from s")
def digit_runs_removed(spark, sf_dir):
    return _numbered(spark, sf_dir).select("item_id", text.collapse_spaces(text.remove_numbers(F.replace("t", F.lit("\n"), F.lit(" ")))).alias("out"))


@query(f"with {_N_SQL} select item_id, {spaces_sql(punct_sql('t'))} as out from n")
def punctuation_replaced(spark, sf_dir):
    return _numbered(spark, sf_dir).select("item_id", text.collapse_spaces(text.replace_punctuation(F.col("t"))).alias("out"))


@query(f"select doc_id, {spaces_sql('text')} as out from documents")
def spaces_collapsed(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", text.collapse_spaces(F.col("text")).alias("out"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^a-z'']+', ' ', 'g')) as out from documents")
def letters_only(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", text.letters_only(F.col("text")).alias("out"))


@query(rf"""select doc_id, trim(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BL}+', ' ', 'g'), '[\x00-\x1F!-/:-@\[-`{{-\x7F]+', '', 'g')) as out from documents""")
def current_mode(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", text.current_mode(F.col("text")).alias("out"))


def _segments(spark, sf_dir, romanize: bool) -> DataFrame:
    """Segments of item texts; the queries with SQL have no romanisation, as their SQL has none."""
    return L.segments(L.lines(sheets(spark, sf_dir, "benchmark", "item_id")), romanize=romanize)


def _targets(spark, sf_dir, romanize: bool) -> DataFrame:
    words = _segments(spark, sf_dir, romanize).groupBy("doc_id", "line_index").agg(F.array_sort(F.collect_list(F.struct("segment_index", "norm"))).alias("w"))
    return words.select("doc_id", "line_index", text.target_text(F.col("w.norm")).alias("target"))


@query(
    f"with {lines_sql('benchmark', 'item_id')}, {lowered_words_sql()}, {clean_sql('w')} select doc_id, line_index, array_to_string(list(array_to_string(string_split(norm, ''), ' ') order by place) filter (norm <> ''), ' ') as target from c group by all"
)
def target_text(spark, sf_dir):
    return _targets(spark, sf_dir, False)


SEGMENTS_SQL = f"""{lines_sql('benchmark', 'item_id')}, {lowered_words_sql()}, {clean_sql('w')},
s1 as (select *, coalesce(sum(length(norm)) over b, 0) as chars, coalesce(count(*) filter (norm <> '') over b, 0) as gaps, row_number() over (partition by doc_id order by line_index, place) - 1 as segment_index
  from c window b as (partition by doc_id order by line_index, place rows between unbounded preceding and 1 preceding)),
s as (select doc_id, line_index, segment_index, source, norm, cast(chars + case when norm <> '' then gaps else greatest(gaps - 1, 0) end as bigint) as norm_start from s1)"""


@query(f"with {SEGMENTS_SQL} select *, norm_start + length(norm) as norm_end from s")
def segment_offsets(spark, sf_dir):
    return _segments(spark, sf_dir, False)


@query()
def romanized_segments(spark, sf_dir):
    """The whole normalisation of words, with their offsets."""
    return _segments(spark, sf_dir, True)


@query()
def romanized_targets(spark, sf_dir):
    return _targets(spark, sf_dir, True)


VOCAB_SQL = "v as (select * from (values " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(L.TOKENS)) + ") as t(token_id, text))"
TOKENS_SQL = f"""{SEGMENTS_SQL}, {VOCAB_SQL},
t1 as (select doc_id, line_index, segment_index, norm_start, unnest(range(0, len(norm))) as place, unnest(string_split(norm, '')) as ch from s where norm <> ''),
t as (select doc_id, row_number() over (partition by doc_id order by segment_index, place) - 1 as token_index, ch, coalesce(token_id, 3) as token_id, line_index, segment_index, place = 0 as starts_segment, norm_start + place as norm_start
  from t1 left join v on v.text = ch and token_id not in (0, 3) where ch <> ' ')"""


def _tokens(spark, sf_dir, romanize: bool = False) -> DataFrame:
    return L.tokens(_segments(spark, sf_dir, romanize), L.vocabulary(spark))


@query(f"with {TOKENS_SQL} select * from t")
def vocab_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir)


@query()
def romanized_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, True)


@query(f"with {TOKENS_SQL} select ch, count(*) as n from t where token_id = 3 group by ch")
def unknown_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).where("token_id = 3").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


PIECES = ["<blank>", "a", "e", "en", "er", "th", "the", "ción", "ion", "an", "and", "the", "ó"]
_PIECES_SQL = "v as (select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(PIECES)) + ") as t(token_id, piece) where token_id > 0)"


@query(
    f"with {_PIECES_SQL}, p as (select item_id as key, text, unnest(range(1, len(text) + 1)) as pos from benchmark), m as (select key, pos, token_id, len(piece) as size from p join v on substring(text, pos, len(piece)) = piece) select key, pos - 1 as pos, arg_max(size, size * 1000 - token_id) as size, arg_max(token_id, size * 1000 - token_id) as token_id from m group by key, pos"
)
def longest_match(spark, sf_dir):
    vocab = L.vocabulary(spark, PIECES)
    return L.longest_matches(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text"), vocab)


@query(
    f"with {TOKENS_SQL}, o as (select doc_id, line_index as number, min(norm_start) as a, max(norm_start + length(norm)) as b from s where norm <> '' group by all) select t.doc_id, token_index as number, t.norm_start as start, t.norm_start + 1 as \"end\", min(o.number) as outer_number from t left join o on o.doc_id = t.doc_id and t.norm_start >= a and t.norm_start + 1 <= b group by all"
)
def token_line_containment(spark, sf_dir):
    segs = _segments(spark, sf_dir, False)
    toks = L.tokens(segs, L.vocabulary(spark)).select("doc_id", F.col("token_index").alias("number"), F.col("norm_start").alias("start"), (F.col("norm_start") + 1).alias("end"))
    outer = segs.where("norm <> ''").groupBy("doc_id", F.col("line_index").alias("number")).agg(F.min("norm_start").alias("start"), F.max("norm_end").alias("end"))
    return L.contained(toks, outer)


@query(f"with {TOKENS_SQL}, r as (select *, token_id = lag(token_id) over (partition by doc_id order by token_index) as again from t) select doc_id, count(*) as labels, count(*) filter (again) as repeats, count(*) + count(*) filter (again) as required from r group by doc_id")
def required_frames(spark, sf_dir):
    from tactus.operators import align

    return align.required_frames(_tokens(spark, sf_dir))


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return sheets(spark, sf_dir).groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"with {lines_sql()}, {lowered_words_sql()}, k as (select distinct doc_id, line_index from w) select l.doc_id, l.line_index from l join k using (doc_id, line_index)")
def lines_with_words(spark, sf_dir):
    rows = L.lines(sheets(spark, sf_dir))
    words = rows.select("doc_id", "line_index", F.explode(text.split_words(F.lower("line"))))
    return rows.join(words, ["doc_id", "line_index"], "left_semi").select("doc_id", "line_index")


@query(f"with {lines_sql()} select doc_id, line_index from l where not regexp_matches(line, '[^ \\t\\n\\x0B\\f]')")
def lines_without_words(spark, sf_dir):
    rows = L.lines(sheets(spark, sf_dir))
    words = rows.select("doc_id", "line_index", F.explode(text.split_words(F.lower("line"))))
    return rows.join(words, ["doc_id", "line_index"], "left_anti").select("doc_id", "line_index")


@query("select item_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') as escaped, text as back from benchmark")
def dump_escape(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("escaped", text.escape(F.col("text")))
    return b.select("item_id", "escaped", text.unescape(F.col("escaped")).alias("back"))


@query("select item_id, hex(encode(text)) as coded, text as back from benchmark")
def hex_roundtrip(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("coded", F.hex(F.encode("text", "UTF-8")))
    return b.select("item_id", "coded", F.decode(F.unhex("coded"), "UTF-8").alias("back"))


@query("select doc_id, cast(octet_length(encode(text)) as bigint) as n_bytes, cast(length(text) as bigint) as n_points, true as valid from documents")
def utf8_lengths(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_points"), F.is_valid_utf8("text").alias("valid"))


@query()
def nfkc_lower(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", text.nfkc_lower(F.col("text")).alias("lowered"))


@query()
def romanize(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.split_words(F.lower("text"))).alias("place", "word"))
    return text.romanize(words)


@query("select event_id, cast(floor(cast(cast(value as float) as double) * 100 + 0.5) as integer) as hundredths from events")
def hundredths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clock.hundredths(F.col("value")).alias("hundredths"))


_STAMP = "printf('[%02d:%02d.%02d]', h // 6000, (h % 6000) // 100, h % 100)"


@query(f"with x as (select event_id, event_type, cast(floor(cast(cast(value * 100 as float) as double) * 100 + 0.5) as integer) as h from events) select event_id, {_STAMP} || event_type as line from x")
def stamp_format(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(clock.stamp(clock.hundredths(F.col("value") * 100)), "event_type").alias("line"))


@query(f"with x as (select event_id, event_type, cast(floor(cast(cast(value * 100 as float) as double) * 100 + 0.5) as integer) as h from events) select event_id, h as hundredths, event_type as text, case when h % 7 = 0 then 'BAD' else 'TIMESTAMPED' end as kind from x where h % 7 <> 0 union all select event_id, null, null, 'BAD' from x where h % 7 = 0")
def stamp_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("h", clock.hundredths(F.col("value") * 100))
    line = F.concat(F.when(F.col("h") % 7 == 0, F.lit("[0:60.00]")).otherwise(clock.stamp(F.col("h"))), "event_type")
    parsed = tables.read_stamped(e.select(F.col("event_id").alias("doc_id"), line.alias("text")))
    return parsed.select(F.col("doc_id").alias("event_id"), "hundredths", "text", "kind")


@query(f"with x as (select user_id, event_id, event_type, cast(floor(cast(cast(value as float) as double) * 100 + 0.5) as integer) as h from events), y as (select user_id, event_id, {_STAMP} || event_type as line from x) select user_id as doc_id, string_agg(line, chr(10) order by event_id) || chr(10) as text from y group by user_id")
def stamped_sheets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("out_index"), F.lit("TIMED").alias("kind"), clock.hundredths(F.col("value")).alias("hundredths"), F.col("event_type").alias("text"))
    return tables.stamped_sheets(e)


@query(f"with {lines_sql()}, x as (select doc_id, line_index, line from l where line <> ''), s as (select *, sum(case when regexp_full_match(line, '.*\\.') then 1 else 0 end) over (partition by doc_id order by line_index) as section from x) select doc_id, cast(section as bigint) as section, count(*) as n from s group by all")
def running_sections(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = L.lines(sheets(spark, sf_dir)).where("line <> ''")
    ends = F.when(F.col("line").endswith("."), 1).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("line_index")
    return rows.withColumn("section", F.sum(ends).over(w)).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {TOKENS_SQL},
g as (select doc_id, line_index, cast(floor(cast(cast((3 * min(token_index) + 1) * 0.02 as float) as double) * 100 + 0.5) as integer) as h from t group by all)
select g.doc_id, string_agg({_STAMP} || line, chr(10) order by g.line_index) || chr(10) as text from g join l using (doc_id, line_index) group by g.doc_id"""
)
def generated_sheets(spark, sf_dir):
    """The whole chain over item texts, with emissions that say their tokens; not romanised, as its SQL."""
    return _generated(spark, sf_dir, False)


@query()
def romanized_sheets(spark, sf_dir):
    return _generated(spark, sf_dir, True)


def _generated(spark, sf_dir, romanize: bool) -> DataFrame:
    from tactus.plans import generate as whole

    vocab, options = L.vocabulary(spark), whole.Options(romanize=romanize, stars="none", emissions="log-probabilities")
    own = sheets(spark, sf_dir, "benchmark", "item_id")
    _, tokens = whole.target_tokens(own, vocab, options)
    return whole.generate(own, whole.made_up_emissions(tokens, len(L.TOKENS)), vocab, options)


@query(
    f"with {lines_sql()}, b as (select *, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by line_index rows between unbounded preceding and 1 preceding), 0) as lb, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_index rows between unbounded preceding and 1 preceding), 0) as lc, regexp_extract_all(line, '({BL}+|[^ \\t\\n\\x0B\\f]+)') as a from l), e as (select doc_id, line_index, lb, lc, unnest(range(0, len(a))) as k, unnest(a) as piece from b), c as (select *, sum(strlen(piece)) over w as be, sum(length(piece)) over w as ce from e window w as (partition by doc_id, line_index order by k)), x as (select *, row_number() over (partition by doc_id, line_index order by k) - 1 as place from c where not regexp_matches(piece, '^{BL}')) select doc_id, cast(line_index as integer) as line_index, place, piece, cast(lb + be - strlen(piece) as bigint) as byte_start, cast(lb + be as bigint) as byte_end, cast(lc + ce - length(piece) as bigint) as char_start, cast(lc + ce as bigint) as char_end from x"
)
def source_ranges(spark, sf_dir):
    return L.source_ranges(L.lines(sheets(spark, sf_dir)))
