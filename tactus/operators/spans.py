"""From a path of frames to runs, token spans, words, line times and output lines.

All are joins, aggregations and windows over documents; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(path: DataFrame, label: str = "label", order: tuple[str, ...] = ("frame",), score: str = "score") -> DataFrame:
    """Runs of equal labels: doc_id, seg, label, start_frame, end_frame, score (mean of its frames)."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    at = F.row_number().over(w) - 1
    marked = path.select("doc_id", F.col(label).alias("label"), F.col(score).alias("score"), at.alias("frame_at"), new.alias("new"), *order)
    numbered = marked.withColumn("seg", F.sum("new").over(w) - 1)
    return numbered.groupBy("doc_id", "seg", "label").agg(F.min("frame_at").alias("start_frame"), (F.max("frame_at") + 1).alias("end_frame"), F.avg("score").alias("score"))


def token_spans(path: DataFrame) -> DataFrame:
    """Spans of steps (doc_id, frame, token_index, token_id, score, is_blank, is_star) by token index."""
    kept = path.where("not is_blank and not is_star")
    return kept.groupBy("doc_id", "token_index").agg(F.min("token_id").alias("token_id"), F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.avg("score").alias("score"))


def pad_with_blanks(segs: DataFrame) -> DataFrame:
    """Runs that aren't blank, widened over neighbouring blank runs: the first takes all of a
    leading blank, the last all of a trailing one, others go to its middle frame (rounded down)."""
    w = Window.partitionBy("doc_id").orderBy("seg")
    all_of = Window.partitionBy("doc_id")
    real = F.when(~F.col("is_blank"), F.col("seg"))
    shown = segs.select("*", *[f(c).over(w).alias(f"{n}_{c}") for n, f in (("prev", F.lag), ("next", F.lead)) for c in ("is_blank", "start_frame", "end_frame")], F.min(real).over(all_of).alias("first"), F.max(real).over(all_of).alias("last"))
    middle = lambda side: F.floor((F.col(f"{side}_start_frame") + F.col(f"{side}_end_frame")) / 2)
    start = F.when(~F.coalesce("prev_is_blank", F.lit(False)), F.col("start_frame")).when(F.col("seg") == F.col("first"), F.col("prev_start_frame")).otherwise(middle("prev"))
    end = F.when(~F.coalesce("next_is_blank", F.lit(False)), F.col("end_frame")).when(F.col("seg") == F.col("last"), F.col("next_end_frame")).otherwise(middle("next"))
    return shown.where("not is_blank").select("doc_id", "seg", "label", "start_frame", "end_frame", "score", start.cast("long").alias("padded_start"), end.cast("long").alias("padded_end"))


def words_by_segment(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Words: spans of a text segment's tokens; the score is the mean of token means."""
    met = spans.join(tokens.select("doc_id", "token_index", "segment_index", "line_index"), ["doc_id", "token_index"])
    return met.groupBy("doc_id", "segment_index", "line_index").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.avg("score").alias("score"))


def words_by_gap(spans: DataFrame) -> DataFrame:
    """Words where tokens carry is_space (the text before them holds a space): a running count of breaks."""
    w = Window.partitionBy("doc_id").orderBy("token_index")
    numbered = spans.withColumn("word_index", F.sum(F.col("is_space").cast("int")).over(w))
    return numbered.groupBy("doc_id", "word_index").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.avg("score").alias("score"))


def line_times(lines: DataFrame, words: DataFrame, second_per_frame: float = 0.02) -> DataFrame:
    """Blank lines and alignable lines that have words: kind, start_s, end_s, score."""
    timed = words.groupBy("doc_id", "line_index").agg((F.min("start_frame") * second_per_frame).alias("start_s"), (F.max("end_frame") * second_per_frame).alias("end_s"), F.avg("score").alias("score"))
    joined = lines.select("doc_id", "line_index", "kind").join(timed, ["doc_id", "line_index"], "left")
    return joined.where("kind = 'BLANK' or kind = 'ALIGNABLE' and start_s is not null")


def next_timed(times: DataFrame) -> DataFrame:
    """Adds next_start: the start of the next line that has one (forward as-of)."""
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(1, Window.unboundedFollowing)
    return times.withColumn("next_start", F.first("start_s", True).over(w))


def output_lines(times: DataFrame, gap_s: float = 1.0) -> DataFrame:
    """Output lines in order: each timed line, and an empty one at its end if ``gap_s`` or more
    pass until the next; blank lines as they are.  doc_id, out_index, kind, at_s, text."""
    clear = (F.col("end_s") > F.col("start_s")) & (F.col("next_start") - F.col("end_s") >= gap_s)
    line = F.struct(F.when(F.col("start_s").isNull(), "BLANK").otherwise("TIMED").alias("kind"), F.col("start_s").alias("at_s"), F.coalesce("text", F.lit("")).alias("text"))
    empty = F.struct(F.lit("TIMED").alias("kind"), F.col("end_s").alias("at_s"), F.lit("").alias("text"))
    rows = next_timed(times).select("doc_id", "line_index", F.posexplode(F.when(clear, F.array(line, empty)).otherwise(F.array(line))).alias("place", "row"))
    w = Window.partitionBy("doc_id").orderBy("line_index", "place")
    return rows.select("doc_id", (F.row_number().over(w) - 1).alias("out_index"), "row.*")


def violations(spans: DataFrame, slack: float = 1e-5) -> DataFrame:
    """Integrity checks over spans (doc_id, number, start, end, score): (doc_id, number, problem)."""
    w = Window.partitionBy("doc_id").orderBy("number")
    seen = spans.withColumn("before", F.lag("number").over(w)).withColumn("before_start", F.lag("start").over(w))
    checks = {
        "negative start": F.col("start") < 0,
        "end before start": F.col("end") < F.col("start"),
        "number not one more": F.col("before").isNotNull() & (F.col("number") != F.col("before") + 1),
        "start before the one before": F.col("start") < F.col("before_start") - slack,
        "score not finite": F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull(),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return seen.select("doc_id", "number", F.explode(found).alias("problem"))
