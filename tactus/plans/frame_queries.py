"""Queries over frames, spans, samples and times with their SQL.

Stand-ins: events of a user in order of time are frames (event_type the label, value the score
or sample); embeddings are emissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.operators import align as G
from tactus.operators import audio as A
from tactus.operators import compare as C
from tactus.operators import lines as L
from tactus.operators import spans as S
from tactus.plans.text_queries import sheets, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _path(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id"), "ts", "event_id", F.col("event_type").alias("label"), F.col("value").alias("score"))


RUNS_SQL = """
p as (select user_id as doc_id, ts, event_id, event_type as label, value as score, row_number() over w - 1 as frame, case when event_type = lag(event_type) over w then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
q as (select *, sum(new) over (partition by doc_id order by ts, event_id) - 1 as seg from p),
r as (select doc_id, cast(seg as bigint) as seg, label, min(frame) as start_frame, max(frame) + 1 as end_frame, avg(score) as score from q group by doc_id, seg, label)"""


def _runs(spark, sf_dir) -> DataFrame:
    return S.runs(_path(spark, sf_dir), order=("ts", "event_id"))


@query(f"with {RUNS_SQL} select * replace (round(score, 6) as score) from r")
def run_length_segments(spark, sf_dir):
    return _round(_runs(spark, sf_dir), "score")


def _blanked(spark, sf_dir) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("is_blank", F.col("label") == "view")


PADDED_SQL = f"""{RUNS_SQL},
x as (select *, label = 'view' as is_blank from r),
y as (select *, lag(is_blank) over w as pb, lag(start_frame) over w as ps, lag(end_frame) over w as pe, lead(is_blank) over w as nb, lead(start_frame) over w as ns, lead(end_frame) over w as ne, min(case when not is_blank then seg end) over (partition by doc_id) as f, max(case when not is_blank then seg end) over (partition by doc_id) as t from x window w as (partition by doc_id order by seg)),
z as (select doc_id, seg, label, start_frame, end_frame, score, case when not coalesce(pb, false) then start_frame when seg = f then ps else (ps + pe) // 2 end as padded_start, case when not coalesce(nb, false) then end_frame when seg = t then ne else (ns + ne) // 2 end as padded_end from y where not is_blank)"""


@query(f"with {PADDED_SQL} select * replace (round(score, 6) as score) from z")
def blank_padding(spark, sf_dir):
    return _round(S.pad_with_blanks(_blanked(spark, sf_dir)), "score")


def _steps(spark, sf_dir) -> DataFrame:
    """Runs numbered as tokens over their frames: a path with token indexes; 'view' is blank, 'error' a star."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    p = _path(spark, sf_dir).withColumn("frame", F.row_number().over(w) - 1)
    p = p.withColumn("is_blank", F.col("label") == "view").withColumn("is_star", F.col("label") == "error")
    real = ~F.col("is_blank") & ~F.col("is_star")
    new = real & ~F.coalesce(F.lag(F.when(real, F.col("label"))).over(w).eqNullSafe(F.col("label")), F.lit(False))
    return p.withColumn("token_index", F.sum(new.cast("int")).over(w) - 1).withColumn("token_id", F.length("label"))


STEPS_SQL = """
a as (select user_id as doc_id, ts, event_id, event_type as label, value as score, row_number() over w - 1 as frame, event_type not in ('view', 'error') as real from events window w as (partition by user_id order by ts, event_id)),
b as (select *, case when real and lag(case when real then label end) over (partition by doc_id order by frame) is distinct from label then 1 else 0 end as new from a),
c as (select *, sum(new) over (partition by doc_id order by frame) - 1 as token_index from b),
spans as (select doc_id, cast(token_index as bigint) as token_index, min(length(label)) as token_id, min(frame) as start_frame, max(frame) + 1 as end_frame, avg(score) as score from c where real group by doc_id, token_index)"""


@query(f"with {STEPS_SQL} select * replace (round(score, 6) as score) from spans")
def token_spans(spark, sf_dir):
    return _round(S.token_spans(_steps(spark, sf_dir)), "score")


WORDS_SQL = f"""{STEPS_SQL},
words as (select doc_id, token_index // 3 as segment_index, token_index // 9 as line_index, min(start_frame) as start_frame, max(end_frame) as end_frame, avg(score) as score from spans group by all)"""


def _words(spark, sf_dir) -> DataFrame:
    spans = S.token_spans(_steps(spark, sf_dir))
    owner = spans.select("doc_id", "token_index", F.floor(F.col("token_index") / 3).alias("segment_index"), F.floor(F.col("token_index") / 9).alias("line_index"))
    return S.words_by_segment(spans, owner)


@query(f"with {WORDS_SQL} select * replace (round(score, 6) as score) from words")
def word_mean_of_means(spark, sf_dir):
    return _round(_words(spark, sf_dir), "score")


@query(f"with {STEPS_SQL}, g as (select *, sum(case when token_id >= 6 then 1 else 0 end) over (partition by doc_id order by token_index) as word_index from spans) select doc_id, cast(word_index as bigint) as word_index, min(start_frame) as start_frame, max(end_frame) as end_frame, round(avg(score), 6) as score from g group by doc_id, word_index")
def words_by_gap(spark, sf_dir):
    spans = S.token_spans(_steps(spark, sf_dir)).withColumn("is_space", F.col("token_id") >= 6)
    return _round(S.words_by_gap(spans), "score")


LINES_SQL = f"""{WORDS_SQL},
timed as (select doc_id, line_index, min(start_frame) * 0.02 as start_s, max(end_frame) * 0.02 as end_s, avg(score) as score from words group by all),
ln as (select distinct doc_id, line_index * 2 as line_index, 'ALIGNABLE' as kind from words union all select distinct doc_id, line_index * 2 + 1, 'BLANK' from words union all select distinct doc_id, line_index * 2 + 1000000, 'ALIGNABLE' from words),
times as (select ln.doc_id, ln.line_index, kind, case when kind = 'ALIGNABLE' then start_s end as start_s, case when kind = 'ALIGNABLE' then end_s end as end_s, case when kind = 'ALIGNABLE' then score end as score from ln left join timed on timed.doc_id = ln.doc_id and timed.line_index * 2 = ln.line_index where kind = 'BLANK' or start_s is not null)"""


def _times(spark, sf_dir) -> DataFrame:
    words = _words(spark, sf_dir)
    at = words.select("doc_id", "line_index").distinct()
    sets = [at.select("doc_id", (F.col("line_index") * 2 + k).alias("line_index"), F.lit(kind).alias("kind")) for k, kind in ((0, "ALIGNABLE"), (1, "BLANK"), (1000000, "ALIGNABLE"))]
    own = sets[0].unionByName(sets[1]).unionByName(sets[2])
    return S.line_times(own, words.withColumn("line_index", F.col("line_index") * 2))


@query(f"with {LINES_SQL} select * replace (round(start_s, 6) as start_s, round(end_s, 6) as end_s, round(score, 6) as score) from times")
def line_timing(spark, sf_dir):
    return _round(_times(spark, sf_dir), "start_s", "end_s", "score")


NEXT_SQL = f"""{LINES_SQL},
nx as (select *, first_value(start_s ignore nulls) over (partition by doc_id order by line_index rows between 1 following and unbounded following) as next_start from times)"""


@query(f"with {NEXT_SQL} select doc_id, line_index, round(start_s, 6) as start_s, round(next_start, 6) as next_start from nx")
def next_timed_line(spark, sf_dir):
    return _round(S.next_timed(_times(spark, sf_dir)).select("doc_id", "line_index", "start_s", "next_start"), "start_s", "next_start")


OUT_SQL = f"""{NEXT_SQL},
o as (select doc_id, line_index, 0 as place, case when start_s is null then 'BLANK' else 'TIMED' end as kind, start_s as at_s, kind as text from nx
  union all select doc_id, line_index, 1, 'TIMED', end_s, '' from nx where end_s > start_s and round(next_start - end_s, 6) >= 0.02)"""


@query(f"with {OUT_SQL} select doc_id, row_number() over (partition by doc_id order by line_index, place) - 1 as out_index, kind, round(at_s, 6) as at_s, text from o")
def output_union(spark, sf_dir):
    return _round(S.output_lines(_times(spark, sf_dir).withColumn("text", F.col("kind")), 0.02 - 1e-9), "at_s")


@query(f"with {NEXT_SQL} select doc_id, line_index, round(next_start - end_s, 6) as gap_s from nx where end_s > start_s and round(next_start - end_s, 6) >= 0.02")
def gap_clear_lines(spark, sf_dir):
    t = S.next_timed(_times(spark, sf_dir)).withColumn("gap_s", F.round(F.col("next_start") - F.col("end_s"), 6))
    return t.where("end_s > start_s and gap_s >= 0.02").select("doc_id", "line_index", "gap_s")


@query("with x as (select user_id as doc_id, row_number() over w - 1 as number, epoch(ts) as start, epoch(ts) + value - 20 as \"end\", value as score, lag(value) over w as bv from events window w as (partition by user_id order by ts, event_id)) select doc_id, number, 'end before start' as problem from x where \"end\" < start")
def order_violations(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("number"), at.alias("start"), (at + F.col("value") - 20).alias("end"), F.col("value").alias("score"))
    return S.violations(e)


# --- emissions


EM_SQL = "e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), s as (select vec_id, v, list_max(v) as top, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) as total from e)"


@query(f"with {EM_SQL} select vec_id, round(top - top - ln(total), 6) as best, round(list_sum(list_transform(v, lambda x: exp(x - top - ln(total)))), 6) as mass, round(v[1] - top - ln(total), 6) as first from s")
def log_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", A.log_softmax(F.col("embedding")).alias("lp"))
    return e.select("vec_id", F.round(F.array_max("lp"), 6).alias("best"), F.round(F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x)), 6).alias("mass"), F.round(F.element_at("lp", 1), 6).alias("first"))


@query("select vec_id, list_position(embedding, list_max(embedding)) - 1 as token_id from embeddings")
def emission_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("token_id"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: ln(abs(cast(x as double)) + 0.5))), 5) as total from embeddings")
def probabilities_log(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.5).alias("p"))
    return p.select("vec_id", F.round(F.aggregate(A.log_probabilities(F.col("p"), "probabilities"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("with s as (select vec_id, list_transform(embedding, lambda x: abs(cast(x as double))) as a from embeddings) select vec_id, round(list_max(a), 6) as max_abs, true as finite from s")
def max_abs(spark, sf_dir):
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), 6).alias("max_abs"), finite.alias("finite"))


@query(
    "with c as (select vec_id, unnest(range(0, 4)) as chunk_index, embedding as x from embeddings), f as (select vec_id, chunk_index, unnest(range(0, 22)) as j, x from c) select vec_id as doc_id, chunk_index, round(sum(case when chunk_index * 16 - 3 + j between 0 and 63 then cast(x[chunk_index * 16 - 3 + j + 1] as double) else 0 end * (j + 1)), 4) as weighted, count(*) as n from f group by all"
)
def overlapped_chunks(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("samples"))
    c = A.chunks(a, 16, 3)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return c.select("doc_id", "chunk_index", F.round(weighted, 4).alias("weighted"), F.size("samples").cast("long").alias("n"))


@query("with f as (select vec_id as doc_id, unnest(range(0, 60)) as frame, embedding as x from embeddings) select doc_id, frame, round(cast(x[frame + 1] as double), 6) as v from f")
def chunk_trim_concat(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("samples"))
    out = A.chunks(e, 16, 3).select("doc_id", "chunk_index", F.posexplode("samples").alias("frame_in_chunk", "values"))
    kept = A.trimmed(out, 3, 16, e.select("doc_id", F.lit(60).alias("n_frames")))
    return kept.select("doc_id", F.col("frame").cast("long").alias("frame"), F.round(F.col("values").cast("double"), 6).alias("v"))


# --- samples


def _audio(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 400).alias("x")))).alias("s"))
    return e.select(F.col("user_id").alias("doc_id"), F.transform("s", lambda r: r["x"]).alias("samples"))


WIN_SQL = """
n as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value / 400 as x from events),
t as (select doc_id, count(*) as k from n group by doc_id),
st as (select doc_id, unnest(range(0, k - 7, 2)) as start from t where k >= 8),
win as (select st.doc_id, start, sqrt(sum(x * x) / 8) as rms from st join n on n.doc_id = st.doc_id and i >= start and i < start + 8 group by all),
lv as (select doc_id, start, case when rms <= 1e-6 then -120.0 else 20 * log10(rms) end as db from win)"""


@query(f"with {WIN_SQL} select doc_id, start, round(rms, 6) as rms from win")
def sliding_rms(spark, sf_dir):
    return _round(A.windows(_audio(spark, sf_dir), 8, 2), "rms")


def _levels(spark, sf_dir) -> DataFrame:
    return A.windows(_audio(spark, sf_dir), 8, 2).select("doc_id", "start", A.decibel(F.col("rms")).alias("db"))


HIST_SQL = f"{WIN_SQL}, h as (select doc_id, cast(greatest(0, least(180, floor(db + 120))) as integer) as bin, count(*) as n from lv group by all)"


@query(f"with {HIST_SQL} select * from h")
def db_histogram(spark, sf_dir):
    return A.histogram(_levels(spark, sf_dir))


FLOOR_SQL = f"{HIST_SQL}, cu as (select doc_id, bin, sum(n) over (partition by doc_id order by bin) as below, sum(n) over (partition by doc_id) as total from h), fl as (select doc_id, min(bin) - 120.0 as floor_db from cu where below > total // 10 group by doc_id)"


@query(f"with {FLOOR_SQL} select doc_id, cast(floor_db as double) as floor_db from fl")
def noise_floor_percentile(spark, sf_dir):
    return A.noise_floor(A.histogram(_levels(spark, sf_dir)))


THR_SQL = f"{FLOOR_SQL}, pk as (select doc_id, max(db) as peak from lv group by doc_id), th as (select doc_id, case when peak <= -90 then peak else least(floor_db + 6.0, peak - 12) end as threshold_db from fl join pk using (doc_id))"


@query(f"with {THR_SQL} select doc_id, round(threshold_db, 6) as threshold_db from th")
def silence_threshold(spark, sf_dir):
    return _round(A.silence_threshold(_levels(spark, sf_dir)), "threshold_db")


def _quiet(spark, sf_dir) -> DataFrame:
    lv = _levels(spark, sf_dir)
    at = lv.join(A.silence_threshold(lv, 6.0), "doc_id").withColumn("at_s", F.col("start") * 0.01)
    return A.silences(at, 0.08, 0.1)


QUIET_SQL = f"""{THR_SQL},
sl as (select doc_id, start, db <= threshold_db as silent from lv join th using (doc_id)),
sm as (select *, case when silent is not distinct from lag(silent) over (partition by doc_id order by start) then 0 else 1 end as new from sl),
sr as (select *, sum(new) over (partition by doc_id order by start) as run from sm),
qt as (select doc_id, min(start) * 0.01 as start_s, max(start) * 0.01 + 0.08 as end_s from sr where silent group by doc_id, run having (max(start) - min(start)) * 0.01 + 0.08 >= 0.1 - 1e-9)"""


@query(f"with {QUIET_SQL} select doc_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s from qt")
def silence_runs(spark, sf_dir):
    return _round(_quiet(spark, sf_dir), "start_s", "end_s")


@query(f"with {QUIET_SQL} select doc_id, round(min(start_s), 6) as start_s from qt group by doc_id")
def first_sustained_silence(spark, sf_dir):
    return _round(_quiet(spark, sf_dir).groupBy("doc_id").agg(F.min("start_s").alias("start_s")), "start_s")


@query(
    f"with {QUIET_SQL}, g as (select doc_id, i as line_index, i * 0.01 as end_s, (i + 25) * 0.01 as next_start from n where i % 20 = 0), f as (select g.doc_id, line_index, min(qt.start_s) as q from g join qt on qt.doc_id = g.doc_id and qt.start_s >= g.end_s - 1e-9 and qt.start_s < g.next_start - 1e-9 group by all) select g.doc_id, line_index, round(coalesce(q, g.end_s), 6) as end_s, round(g.next_start, 6) as next_start from g left join f using (doc_id, line_index)"
)
def range_join_gap_windows(spark, sf_dir):
    n = _audio(spark, sf_dir).select("doc_id", F.posexplode("samples").alias("i", "x"))
    gaps = n.where("i % 20 = 0").select("doc_id", F.col("i").alias("line_index"), F.round(F.col("i") * 0.01 - 1e-9, 10).alias("end_s"), F.round((F.col("i") + 25) * 0.01 - 1e-9, 10).alias("next_start"))
    return _round(A.correct_ends(gaps, _quiet(spark, sf_dir), 0.5), "end_s", "next_start")


@query("select l_orderkey as doc_id, count(*) as n, round(max(abs(l_discount - l_tax)), 6) as max_abs, round(sqrt(sum((l_discount - l_tax) * (l_discount - l_tax)) / count(*)), 6) as rms_error, round(case when sum((l_discount - l_tax) * (l_discount - l_tax)) = 0 then 999.0 when sum(l_discount * l_discount) = 0 then -999.0 else 10 * log10(sum(l_discount * l_discount) / sum((l_discount - l_tax) * (l_discount - l_tax))) end, 5) + 0.0 as snr_db from lineitem group by l_orderkey")
def error_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return _round(_round(A.error_metrics(li), "max_abs", "rms_error"), "snr_db", digits=5).withColumn("snr_db", F.col("snr_db") + 0.0)


@query(
    "with n as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x from events), o as (select unnest(range(-3, 4)) as off), p as (select n.doc_id, off, count(*) as k, max(abs(n.x - b.x)) as m, sum((n.x - b.x) * (n.x - b.x)) as e from o, n join n b on b.doc_id = n.doc_id and b.i + off + 2 = n.i group by all), s as (select doc_id, off, round(sqrt(e / k), 6) as r, m, row_number() over (partition by doc_id order by sqrt(e / k), m, off) as rn from p) select doc_id, cast(off as integer) as \"offset\", r as rms_error, round(m, 6) as max_abs from s where rn = 1"
)
def best_offset(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("i"), F.col("value").alias("x"))
    return _round(A.best_offset(a, a.withColumn("i", F.col("i") + 2), 3), "rms_error", "max_abs")


@query(
    "with w as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as k, event_type as t, value as v from events where event_type <> 'error'), z as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as k, event_type as t, value as v from events where event_type <> 'view') select coalesce(w.doc_id, z.doc_id) as doc_id, coalesce(w.k, z.k) as k, case when z.v is null then 'missing' when w.v is null then 'extra' when w.t <> z.t then 'text' when abs(w.v - z.v) > 0.5 then 'time' else 'equal' end as outcome from w full outer join z on w.doc_id = z.doc_id and w.k = z.k"
)
def positional_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.struct("ts", "event_id").alias("place"), F.col("event_type").alias("text"), F.col("value").alias("at"))
    return C.by_position(e.where("text <> 'error'"), e.where("text <> 'view'"), "place", 0.5)


@query("select l_orderkey, l_linenumber, round(greatest(-1.0, least(1.0, l_discount - l_tax * 10 * 1.035)), 6) as residual, round(greatest(-1.0, least(1.0, l_tax * 10 * 1.035)), 6) as vocal from lineitem")
def output_samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    model = F.col("l_tax") * 10
    return li.select("l_orderkey", "l_linenumber", F.round(A.output_sample(model, F.col("l_discount")), 6).alias("residual"), F.round(A.output_sample(model), 6).alias("vocal"))


def dealt_emissions(embeddings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Emissions (doc_id, frame, values) for every document of ``tokens``: twice the frames that its
    labels and edge stars need, read from the embeddings in order of vec_id, a document 40 further
    on than the one before and from the first again after the last."""
    # numbered within ranges of ids, so that no task holds all of them
    ranged = embeddings.withColumn("range", F.floor(F.col("vec_id") / 4096))
    before = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("vec_id")) - 1
    numbered = ranged.withColumn("place", place).join(before, "range").select((F.col("before") + F.col("place")).alias("number"), A.log_softmax(F.slice("embedding", 1, 31)).alias("values"))
    need = G.required_frames(tokens, "edges").select("doc_id", (2 * F.col("required")).alias("n"))
    frames = need.crossJoin(F.broadcast(embeddings.agg(F.count(F.lit(1)).alias("total")))).where("total > 0")
    at = frames.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return at.withColumn("number", F.pmod(F.col("doc_id") * 40 + F.col("frame"), F.col("total"))).join(numbered, "number").select("doc_id", F.col("frame").cast("int").alias("frame"), "values")


@query()
def viterbi_align(spark, sf_dir):
    """Every item's whole target against frames of embeddings."""
    segs = L.segments(L.lines(sheets(spark, sf_dir, "benchmark", "item_id")))
    toks = L.tokens(segs, L.vocabulary(spark))
    return G.align(dealt_emissions(table(spark, sf_dir, "embeddings"), toks), toks, stars="edges")


# half of (16 times the energy of a windowed frame, and its first and last bins once more)
STFT_SQL = """
n as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value / 400 as x from events),
t as (select doc_id, count(*) as k from n group by doc_id),
fr as (select doc_id, unnest(range(0, k // 4 + 1)) as frame from t),
sm as (select doc_id, frame, unnest(range(0, 16)) as j from fr),
xw as (select sm.doc_id, frame, j, coalesce(x, 0) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) as v from sm left join n on n.doc_id = sm.doc_id and i = frame * 4 + j - 8)"""


@query(f"with {STFT_SQL} select doc_id, cast(frame as integer) as frame, round((16 * sum(v * v) + sum(v) ** 2 + sum(v * case when j % 2 = 0 then 1 else -1 end) ** 2) / 2, 6) as energy from xw group by doc_id, frame")
def stft_energy(spark, sf_dir):
    s = A.spectra(_audio(spark, sf_dir), n_fft=16, hop=4)
    return s.select("doc_id", "frame", F.round(F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda x, y: x + y), 6).alias("energy"))


@query("with n as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as k, round(value / 400, 6) as x from events) select doc_id, cast(i as integer) as i, x from n where i < k // 4 * 4")
def stft_roundtrip(spark, sf_dir):
    back = A.resynthesis(A.spectra(_audio(spark, sf_dir), n_fft=16, hop=4), 16, 4)
    return back.select("doc_id", F.posexplode("samples").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("select user_id, session_start as start, max(ts) + interval 1 hour as \"end\", count(*) as n from (select *, max(case when new then ts end) over (partition by user_id order by ts rows unbounded preceding) as session_start from (select *, lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval 1 hour as new from events)) group by user_id, session_start")
def event_sessions(spark, sf_dir):
    """Batch form of the streaming session extension."""
    from tactus.streaming import silence

    s = silence.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


