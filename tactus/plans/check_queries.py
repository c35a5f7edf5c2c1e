"""Queries over checks, positional joins, arithmetic, options and separation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.functions import clock, frames, text
from tactus.operators import align as G
from tactus.operators import audio as A
from tactus.operators import checks as K
from tactus.operators import separation as X
from tactus.operators import spans as S
from tactus.plans import dumps as D
from tactus.plans import frame_queries as Q
from tactus.plans import options as O
from tactus.plans.text_queries import table
from tactus.sources import wav

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- positional joins


def _segments(spark, sf_dir):
    runs = Q._runs(spark, sf_dir)
    return runs.select("doc_id", "seg", F.col("label").alias("token_id"), (F.col("label") == "view").alias("is_blank"), (F.col("label") == "error").alias("is_star"), "start_frame", "end_frame", "score")


LABELS_SQL = f"""{Q.RUNS_SQL},
nb as (select *, row_number() over (partition by doc_id order by seg) - 1 as label_index, count(*) over (partition by doc_id) as many from r where label <> 'view'),
lb as (select doc_id, label_index, label_index as token_index, case when label_index % 17 = 5 then 'other' when label = 'error' then null else label end as token_id, label = 'error' and label_index % 17 <> 5 as is_star from nb where not (doc_id % 3 = 0 and label_index = many - 1)
  union all select doc_id, many, many, 'more', false from nb where label_index = 0 and doc_id % 5 = 0 and doc_id % 3 <> 0)"""


@query(f"with {LABELS_SQL} select coalesce(lb.doc_id, nb.doc_id) as doc_id, coalesce(lb.label_index, nb.label_index) as label_index, seg, start_frame, end_frame, case when nb.doc_id is null then 'label without segment' when lb.doc_id is null then 'segment without label' when lb.is_star <> (nb.label = 'error') or not lb.is_star and lb.token_id <> nb.label then 'label differs' end as problem from lb full outer join nb on lb.doc_id = nb.doc_id and lb.label_index = nb.label_index")
def interval_labels(spark, sf_dir):
    """Segments against labels of which some differ, lack or are too many."""
    segs = _segments(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("seg")
    own = segs.where("not is_blank").withColumn("label_index", F.row_number().over(w) - 1).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    other = F.col("label_index") % 17 == 5
    labels = own.where("not (doc_id % 3 = 0 and label_index = many - 1)").select("doc_id", "label_index", F.col("label_index").alias("token_index"), F.when(other, "other").when(~F.col("is_star"), F.col("token_id")).alias("token_id"), (F.col("is_star") & ~other).alias("is_star"))
    more = own.where("label_index = 0 and doc_id % 5 = 0 and doc_id % 3 <> 0").select("doc_id", F.col("many").cast("int").alias("label_index"), F.col("many").cast("int").alias("token_index"), F.lit("more").alias("token_id"), F.lit(False).alias("is_star"))
    return K.aligned_intervals(segs, labels.unionByName(more)).select("doc_id", F.col("label_index").cast("long").alias("label_index"), "seg", "start_frame", "end_frame", "problem")


@query(f"with {Q.STEPS_SQL}, iv as (select doc_id, token_index, start_frame, end_frame + case when token_index % 13 = 4 then 1 else 0 end as end_frame, start_frame - 1 as padded_start, end_frame + 2 as padded_end from spans where token_index % 19 <> 7), sp as (select * from spans where token_index % 23 <> 9) select coalesce(sp.doc_id, iv.doc_id) as doc_id, coalesce(sp.token_index, iv.token_index) as token_index, sp.start_frame, sp.end_frame, padded_start, padded_end, case when iv.doc_id is null then 'span without interval' when sp.doc_id is null then 'interval without span' when iv.end_frame <> sp.end_frame then 'frames differ' end as problem from sp full outer join iv on sp.doc_id = iv.doc_id and sp.token_index = iv.token_index")
def span_intervals(spark, sf_dir):
    spans = S.token_spans(Q._steps(spark, sf_dir))
    intervals = spans.where("token_index % 19 <> 7").select("doc_id", "token_index", "start_frame", (F.col("end_frame") + (F.col("token_index") % 13 == 4).cast("int")).alias("end_frame"), (F.col("start_frame") - 1).alias("padded_start"), (F.col("end_frame") + 2).alias("padded_end"))
    return K.padded_intervals(spans.where("token_index % 23 <> 9"), intervals).select("doc_id", "token_index", "start_frame", "end_frame", "padded_start", "padded_end", "problem")


_NO_ERRORS = Q.PADDED_SQL.replace("from events window", "from events where event_type <> 'error' window")


@query(f"with {_NO_ERRORS} select doc_id, row_number() over (partition by doc_id order by seg) - 1 as token_index, start_frame, end_frame, padded_start, padded_end, cast(null as varchar) as problem from z")
def padded_pipeline(spark, sf_dir):
    """From a path to padded token spans; 'view' is blank, every other run a token."""
    e = Q._path(spark, sf_dir).where("label <> 'error'")
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    path = e.withColumn("frame", F.row_number().over(w) - 1).withColumn("is_blank", F.col("label") == "view").withColumn("is_star", F.lit(False)).withColumn("token_id", F.col("label"))
    new = ~F.col("is_blank") & ~F.lag("label").over(w).eqNullSafe(F.col("label"))
    path = path.withColumn("token_index", F.sum(new.cast("int")).over(w) - 1)
    tokens = S.token_spans(path).select("doc_id", "token_index", "token_id")
    return K.padded_spans(path, tokens).select("doc_id", "token_index", "start_frame", "end_frame", "padded_start", "padded_end", "problem")


@query(f"with {Q.STEPS_SQL}, st as (select doc_id, token_index, token_id, token_index as pos, 1 as side, false as is_star from spans union all select doc_id, null, null, token_index, 0, true from spans where token_index % 3 = 0) select doc_id, row_number() over (partition by doc_id order by pos, side) - 1 as label_index, token_index, token_id, is_star from st")
def star_labels(spark, sf_dir):
    spans = S.token_spans(Q._steps(spark, sf_dir)).withColumn("starts_segment", F.col("token_index") % 3 == 0)
    return K.graph_labels(spans, "segment")


@query(f"with {Q.STEPS_SQL}, m as (select *, token_id = lag(token_id) over (partition by doc_id order by token_index) and token_index % 3 <> 0 as again from spans), g as (select doc_id, count(*) as n, count(*) filter (token_index % 3 = 0) as stars, count(*) filter (again) as repeats from m group by doc_id) select doc_id, stars, n + stars as labels, repeats, n + stars + repeats as required from g")
def required_with_stars(spark, sf_dir):
    spans = S.token_spans(Q._steps(spark, sf_dir)).withColumn("starts_segment", F.col("token_index") % 3 == 0)
    return G.required_frames(spans, "segment").join(G.segment_stars(spans), "doc_id")


# --- integrity


@query(f"with {Q.RUNS_SQL}, v as (select doc_id, seg as number, case when seg % 11 = 3 then start_frame + 1 else start_frame end as s, end_frame as e, score - 60 as score, lag(end_frame) over (partition by doc_id order by seg) as pe, lag(seg) over (partition by doc_id order by seg) as pn from r where seg % 31 <> 30), c as (select doc_id, number, unnest([case when e <= s then 'end not after start' end, case when score > 0 then 'score above 0' end, case when number <> coalesce(pn + 1, 0) then 'number not one more' end, case when s <> coalesce(pe, 0) then 'start not at the end before' end]) as problem from v) select * from c where problem is not null")
def segment_problems(spark, sf_dir):
    rows = Q._runs(spark, sf_dir).where("seg % 31 <> 30").select("doc_id", F.col("seg").alias("number"), (F.col("start_frame") + (F.col("seg") % 11 == 3).cast("int")).alias("start_frame"), "end_frame", (F.col("score") - 60).alias("score"))
    return K.stage_problems("segments", rows)


@query(f"with {Q.WORDS_SQL}, v as (select doc_id, segment_index as number, case when segment_index % 7 = 2 then start_frame - 4 else start_frame end as s, end_frame as e, case when segment_index % 9 = 4 then 0 else line_index end as line, score - 1000 as score from words), l as (select *, lag(e) over w as pe, lag(line) over w as pl from v window w as (partition by doc_id order by number)), found as (select doc_id, cast(number as bigint) as number, unnest([case when s < 0 then 'negative start' end, case when line < pl then 'line goes back' end, case when s < pe then 'start before the end before' end]) as problem from l) select * from found where problem is not null")
def word_problems(spark, sf_dir):
    w = Q._words(spark, sf_dir)
    rows = w.select("doc_id", F.col("segment_index").alias("number"), (F.col("start_frame") - F.when(F.col("segment_index") % 7 == 2, 4).otherwise(0)).alias("start_frame"), "end_frame", F.when(F.col("segment_index") % 9 == 4, 0).otherwise(F.col("line_index")).alias("line_index"), (F.col("score") - 1000).alias("score"))
    return K.stage_problems("words", rows)


@query("with v as (select user_id as doc_id, row_number() over w - 1 as number, case when event_type = 'view' then 'BLANK' when event_type = 'error' then 'OTHER' else 'TIMED' end as kind, case when event_type = 'click' and value < 20 then null else value - 10 end as at_s from events window w as (partition by user_id order by ts, event_id)), c as (select doc_id, number, unnest([case when kind = 'TIMED' and at_s is null then 'timed without stamp' end, case when kind = 'TIMED' and at_s < 0 then 'negative stamp' end, case when kind = 'OTHER' then 'unknown kind' end]) as problem from v) select * from c where problem is not null")
def output_problems(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "view", "BLANK").when(F.col("event_type") == "error", "OTHER").otherwise("TIMED")
    at = F.when(~((F.col("event_type") == "click") & (F.col("value") < 20)), F.col("value") - 10)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("number"), kind.alias("kind"), at.alias("at_s"), F.lit("x").alias("text"))
    return K.stage_problems("output", rows)


@query(f"with {Q.STEPS_SQL} select doc_id, token_index as number, 'token differs' as problem from spans where token_index % 10 = 1 and token_index % 14 <> 0 union all select doc_id, token_index, 'no such token' from spans where token_index % 14 = 0")
def token_id_problems(spark, sf_dir):
    spans = S.token_spans(Q._steps(spark, sf_dir))
    theirs = spans.where("token_index % 14 <> 0").select("doc_id", "token_index", (F.col("token_id") + (F.col("token_index") % 10 == 1).cast("int")).alias("token_id"))
    return K.token_matches(spans, theirs)


# --- arithmetic


@query("select l_orderkey, l_linenumber, case when l_discount <= 0 then 0 else cast(floor(cast(cast(l_discount * l_quantity as float) as double) * 16000) as bigint) end as sample, case when l_discount <= 0 then 0 else cast(floor(cast(cast(l_discount * l_quantity as float) as double) * 44100 + 0.5) as bigint) end as samples from lineitem")
def sample_indexes(spark, sf_dir):
    at = F.col("l_discount") * F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.second_to_sample(at, F.lit(16000)).alias("sample"), frames.second_to_sample(at, F.lit(44100), True).alias("samples"))


@query("select o_orderkey, cast(o_orderkey * 37 // 320 as bigint) as whole, cast((o_orderkey * 37 + 319) // 320 as bigint) as every, case when o_orderkey % 9 > 0 then cast((o_orderkey + (o_orderkey % 9) - 1) // (o_orderkey % 9) * (o_orderkey % 9) as bigint) end as multiple from orders")
def frame_counts(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.frames_floor(k * 37, 320).alias("whole"), frames.frames_ceil(k * 37, 320).alias("every"), frames.ceil_to_multiple(k, k % 9).alias("multiple"))


@query("select o_orderkey, cast(greatest(2, length(cast(cast(o_totalprice * 100 as bigint) // 6000 as varchar))) + 8 as integer) as size from orders")
def stamp_lengths(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.stamp_length((F.col("o_totalprice") * 100).cast("long")).alias("size"))


@query("select l_orderkey, l_linenumber, case when l_linenumber - 2 <= 0 then 100 else cast(floor(greatest(0.0, least(1.0, l_quantity / ((l_linenumber - 2) * 10.0))) * 100 + 0.5) as integer) end as percent from lineitem")
def percent_done(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.percent(F.col("l_quantity"), (F.col("l_linenumber") - 2) * 10.0).alias("percent"))


@query("select o_orderkey, case when o_orderkey % 7 > 0 and o_custkey > 0 then cast((o_orderkey % 7) * 40 * o_custkey as bigint) end as elements, o_orderkey % 7 in (0, 3) as fits, case when o_orderkey % 7 = 1 and o_custkey > 0 then 40 end as n_frames, case when o_orderkey % 7 = 1 and o_custkey > 0 then cast(o_custkey as bigint) end as vocabulary from orders")
def shape_elements(spark, sf_dir):
    """Shapes of three dimensions: their elements, whether they fit a model of 3 or 0 x any x any, and as emissions."""
    first = (F.col("o_orderkey") % 7).cast("long")
    shape = F.array(first, F.lit(40).cast("long"), F.col("o_custkey").cast("long"))
    model = F.when(first == 0, F.array(F.lit(0), F.lit(-1), F.lit(-1))).otherwise(F.array(F.lit(3), F.lit(-1), F.lit(-1))).cast("array<long>")
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.elements(shape).alias("elements"), frames.shape_matches(shape, model).alias("fits"), frames.emission_shape(shape)[0].alias("n_frames"), frames.emission_shape(shape)[1].alias("vocabulary"))


@query("select vec_id, case when vec_id % 7 = 3 then vec_id % 64 end as bad from embeddings")
def first_bad_value(spark, sf_dir):
    bad = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 3) & (i >= F.col("vec_id") % 64), F.lit(float("nan"))).otherwise(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", frames.first_not_finite(bad).cast("long").alias("bad"))


# --- text and options


@query(r"select doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r'), 'e', '\x01') as escaped, true as back from documents")
def control_escapes(spark, sf_dir):
    """Whole texts with every e made a control character, escaped and back."""
    raw = F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("\x01"))
    return table(spark, sf_dir, "documents").select("doc_id", text.escape(raw).alias("escaped"), (text.unescape(text.escape(raw)) == raw).alias("back"))


_WIDE = "".join(chr(0xFF21 + k) for k in range(26))


@query("with w as (select item_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') as ws from benchmark) select item_id, lower(array_to_string(ws, ' ')) || ' é fi' as text from w")
def normalize_nfkc(spark, sf_dir):
    """Letters made full-width, a decomposed accent and a ligature come back as plain lower-case text."""
    plain = F.regexp_replace("text", "[^A-Za-z ]", "")
    wide = F.translate(F.upper(plain), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _WIDE)
    return table(spark, sf_dir, "benchmark").select("item_id", text.nfkc_lower(F.concat(wide, F.lit(" É ﬁ"))).alias("text"))


@query("with p as (select page_id, 'a.b/c' || page_id || case page_id % 6 when 0 then '.wav' when 1 then '.flac' when 2 then '.tar.mp3' when 3 then '.opus' when 4 then '' else '.WAV' end as path from pages) select page_id, case page_id % 6 when 0 then 'wav' when 1 then 'flac' when 2 then 'mp3' when 3 then 'opus' end as format, case when page_id % 6 = 3 then 48000 else 44100 end as rate, 'a.b/c' || page_id || case when page_id % 6 = 2 then '.tar' else '' end || '.lrc' as output from p")
def file_formats(spark, sf_dir):
    from tactus.sources.tables import sibling_path

    ends = F.element_at(F.array(*map(F.lit, [".wav", ".flac", ".tar.mp3", ".opus", "", ".WAV"])), (F.col("page_id") % 6 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a.b/c"), F.col("page_id").cast("string"), ends).alias("path"))
    return wav.with_format(files).select("page_id", "format", wav.output_rate(F.col("format"), F.lit(44100)).alias("rate"), sibling_path(F.col("path"), ".lrc").alias("output"))


@query("select o_orderkey, case when o_orderkey % 5 < 3 and o_custkey <= 1000 then cast(case o_orderkey % 5 when 1 then -o_custkey else o_custkey end as integer) end as n from orders")
def parsed_numbers(spark, sf_dir):
    """Texts as whole numbers between -1000 and 1000: plain, negative, signed, with a letter, and too long."""
    k = F.col("o_custkey").cast("string")
    said = F.element_at(F.array(k, F.concat(F.lit("-"), k), F.concat(F.lit("+"), k), F.concat(k, F.lit("x")), F.concat(k, F.lit("1" * 20))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", O.parsed_number(said, -1000, 1000).alias("n"))


# --- separation and samples


GEOMETRY = X.Geometry(n_fft=16, hop=4, dim_f=9, dim_t=9, rate=10, chunk_seconds=20, margin_seconds=2)


@query("with s as (select o_orderkey as doc_id, o_orderkey % 997 as n from orders), g as (select doc_id, n, unnest(range(0, n, 200)) as start from s where n > 0), r as (select doc_id, start // 200 as region, start, least(n, start + 200) as fin, greatest(0, start - 20) as rs, least(n, least(n, start + 200) + 20) as re from g) select doc_id, region, rs as read_start, re as read_end, cast((re - rs + 15) // 16 as bigint) as windows from r")
def separation_windows(spark, sf_dir):
    songs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 997).alias("n_samples"))
    return X.windows(songs, GEOMETRY).groupBy("doc_id", "region", "read_start", "read_end").agg(F.count(F.lit(1)).alias("windows"))


@query("with p as (select user_id as doc_id, case when event_type = 'error' then 'nan'::double else value end as a, case when event_type = 'view' and value > 90 then 'inf'::double else value / 2 end as b from events) select doc_id, round(max(a) filter (not isnan(a)), 6) as peak_a, round(max(b) filter (not isinf(b)), 6) as peak_b, count(*) filter (isnan(a)) as nan, count(*) filter (isinf(b)) as infinite from p group by doc_id")
def level_metrics(spark, sf_dir):
    a = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    b = F.when((F.col("event_type") == "view") & (F.col("value") > 90), float("inf")).otherwise(F.col("value") / 2)
    return Q._round(A.level_metrics(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), a.alias("a"), b.alias("b"))), "peak_a", "peak_b")


@query("with n as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x, event_type as t from events) select doc_id, count(*) as n, round(max(abs(x - case when t = 'error' then 0.25 * x else x end)), 6) as max_abs from n group by doc_id")
def stem_reconstruction(spark, sf_dir):
    """A mixture against the sum of a stem of a quarter and one of the rest that lacks some places."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("i"), F.col("value").alias("x"), "event_type")
    stems = [m.withColumn("x", F.col("x") * 0.25), m.where("event_type <> 'error'").withColumn("x", F.col("x") * 0.75)]
    pairs = A.reconstruction(m, [s.select("doc_id", "i", "x") for s in stems])
    return Q._round(A.error_metrics(pairs).select("doc_id", "n", "max_abs"), "max_abs")


@query(f"with {Q.PADDED_SQL}, sc as (select doc_id, frame, score from q) select z.doc_id, z.seg as token_index, padded_start, padded_end, round(avg(sc.score), 6) as score from z join sc on sc.doc_id = z.doc_id and frame >= padded_start and frame < padded_end group by all")
def padded_scores(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    scores = Q._path(spark, sf_dir).select("doc_id", (F.row_number().over(w) - 1).alias("frame"), "score")
    spans = S.pad_with_blanks(Q._blanked(spark, sf_dir)).select("doc_id", F.col("seg").alias("token_index"), "padded_start", "padded_end")
    return Q._round(A.padded_scores(scores, spans), "score")


@query(f"with {Q.RUNS_SQL}, k as (select doc_id, seg as number, start_frame * 1.0 as s, end_frame - 0.5 as e from r), l as (select *, lag(e) over (partition by doc_id order by number) as pe from k) select doc_id, number, round(case when s - pe < 0.75 then pe else s end, 6) as start_s, round(e, 6) as end_s from l")
def merged_spans(spark, sf_dir):
    spans = Q._runs(spark, sf_dir).select("doc_id", F.col("seg").alias("number"), F.col("start_frame").cast("double").alias("start_s"), (F.col("end_frame") - 0.5).alias("end_s"))
    return Q._round(A.merged_spans(spans, 0.75), "start_s", "end_s")


COMPARE_SQL = f"""{Q.RUNS_SQL},
b as (select doc_id, seg, case when seg % 13 = 4 then 'other' else label end as label, end_frame + case when seg % 11 = 2 then 0.5 else 0.01 end as e from r where seg % 29 <> 11),
j as (select coalesce(r.doc_id, b.doc_id) as doc_id, coalesce(r.seg, b.seg) as i, b.seg is null as gone, r.label as la, b.label as lb, cast(r.end_frame as double) as ea, b.e as eb from r full outer join b on r.doc_id = b.doc_id and r.seg = b.seg)"""


@query(f"with {COMPARE_SQL} select doc_id, i as index, case when gone then 'count' when la <> lb then 'label' else 'end' end as field, case when gone then null when la <> lb then la else cast(ea as varchar) end as a, case when gone then null when la <> lb then lb else cast(cast(eb as double) as varchar) end as b from j where gone or la <> lb or abs(ea - eb) > 0.02")
def section_compare(spark, sf_dir):
    """Runs against runs of which some are gone, some say another label, and some end elsewhere."""
    runs = Q._runs(spark, sf_dir).select("doc_id", F.col("seg").alias("index"), "label", F.col("end_frame").cast("double").alias("end"))
    other = runs.where("index % 29 <> 11").withColumn("label", F.when(F.col("index") % 13 == 4, "other").otherwise(F.col("label"))).withColumn("end", F.col("end") + F.when(F.col("index") % 11 == 2, 0.5).otherwise(0.01))
    return D.compare_rows(runs, other, ["label"], {"end": 0.02})
