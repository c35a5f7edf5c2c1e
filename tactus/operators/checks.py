"""Positional joins with checks, and integrity checks of every stage.

Each join gives all rows of both sides with ``problem`` (null where all is well), so a caller
filters, reports or, by ``strict``, stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.operators import spans as S

#: Times may go back by so much.
SLACK = 1e-5


def graph_labels(tokens: DataFrame, stars: str = "none") -> DataFrame:
    """The label stream of tokens (doc_id, token_index, token_id, starts_segment): doc_id, label_index,
    token_index and token_id (null for a star), is_star."""
    own = tokens.select("doc_id", "token_index", "token_id", F.lit(False).alias("is_star"), F.col("token_index").alias("at"), F.lit(1).alias("side"))
    none = [F.lit(None).cast(tokens.schema[c].dataType).alias(c) for c in ("token_index", "token_id")]
    if stars == "segment":
        own = own.unionByName(tokens.where("starts_segment").select("doc_id", *none, F.lit(True).alias("is_star"), F.col("token_index").alias("at"), F.lit(0).alias("side")))
    if stars == "edges":
        ends = tokens.groupBy("doc_id").agg(F.min("token_index").alias("low"), F.max("token_index").alias("high"))
        at = F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(0).alias("side")), F.struct(F.col("high").alias("at"), F.lit(2).alias("side"))))
        own = own.unionByName(ends.select("doc_id", *none, F.lit(True).alias("is_star"), at.alias("e")).select("doc_id", "token_index", "token_id", "is_star", "e.at", "e.side"))
    w = Window.partitionBy("doc_id").orderBy("at", "side")
    return own.select("doc_id", (F.row_number().over(w) - 1).alias("label_index"), "token_index", "token_id", "is_star")


def aligned_intervals(segs: DataFrame, labels: DataFrame) -> DataFrame:
    """The k-th segment that isn't blank (doc_id, seg, token_id, is_blank, is_star, ...) beside the k-th
    label: all must be there and agree."""
    w = Window.partitionBy("doc_id").orderBy("seg")
    own = segs.where("not is_blank").withColumn("label_index", F.row_number().over(w) - 1).drop("is_blank")
    own = own.withColumnsRenamed({"token_id": "said_id", "is_star": "said_star"})
    same = (F.col("is_star") == F.col("said_star")) & (F.col("is_star") | F.col("token_id").eqNullSafe(F.col("said_id")))
    problem = F.when(F.col("seg").isNull(), "label without segment").when(F.col("is_star").isNull(), "segment without label").when(~same, "label differs")
    return labels.join(own, ["doc_id", "label_index"], "full_outer").withColumn("problem", problem).drop("said_id", "said_star")


def padded_intervals(spans: DataFrame, intervals: DataFrame) -> DataFrame:
    """Token spans (doc_id, token_index, start_frame, end_frame, ...) with the padded frames of the
    interval (doc_id, token_index, start_frame, end_frame, padded_start, padded_end) of their token:
    both must be there and their own frames agree."""
    theirs = intervals.select("doc_id", "token_index", F.col("start_frame").alias("i_start"), F.col("end_frame").alias("i_end"), "padded_start", "padded_end")
    problem = F.when(F.col("i_start").isNull(), "span without interval").when(F.col("start_frame").isNull(), "interval without span").when((F.col("i_start") != F.col("start_frame")) | (F.col("i_end") != F.col("end_frame")), "frames differ")
    return spans.join(theirs, ["doc_id", "token_index"], "full_outer").withColumn("problem", problem).drop("i_start", "i_end")


def path_segments(path: DataFrame) -> DataFrame:
    """Runs of a path (doc_id, frame, token_id, is_blank, is_star, score) by what it says."""
    said = path.withColumn("said", F.struct(F.when(~F.col("is_star"), F.col("token_id")).alias("token_id"), "is_blank", "is_star"))
    return S.runs(said, "said", ("frame",)).select("doc_id", "seg", "label.*", "start_frame", "end_frame", "score")


def padded_spans(path: DataFrame, tokens: DataFrame, stars: str = "none") -> DataFrame:
    """From a path to token spans with padded frames: runs, the positional join with the labels, blank
    padding, and the join with the token spans, each checked (``problem``)."""
    segs = path_segments(path)
    padded = S.pad_with_blanks(segs.withColumn("label", F.col("token_id"))).drop("label")
    flags = segs.select("doc_id", "seg", "token_id", "is_blank", "is_star")
    met = aligned_intervals(padded.join(flags, ["doc_id", "seg"]), graph_labels(tokens, stars))
    bad = met.where("problem is not null").select("doc_id", "token_index", "problem")
    good = padded_intervals(S.token_spans(path), met.where("problem is null and not is_star"))
    return good.unionByName(bad, allowMissingColumns=True)


def token_matches(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Problems of spans against text tokens by index: (doc_id, number, problem)."""
    theirs = tokens.select("doc_id", "token_index", F.col("token_id").alias("text_id"))
    both = spans.select("doc_id", "token_index", "token_id").join(theirs, ["doc_id", "token_index"], "left")
    problem = F.when(F.col("text_id").isNull(), "no such token").when(F.col("text_id") != F.col("token_id"), "token differs")
    return both.select("doc_id", F.col("token_index").alias("number"), problem.alias("problem")).where("problem is not null")


def _not_finite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def _before(c: str) -> Column:
    return F.lag(c).over(Window.partitionBy("doc_id").orderBy("number"))


def stage_checks(stage: str) -> dict[str, Column]:
    """The named checks of a stage, true where a row (doc_id, number, ...) breaks one."""
    frames = {
        "negative start": F.col("start_frame") < 0,
        "end not after start": F.col("end_frame") <= F.col("start_frame"),
        "score not finite": _not_finite("score"),
        "score above 0": F.col("score") > 0,
    }
    step = F.col("state") - _before("state")
    return {
        "steps": {
            "number not one more": F.col("number") != F.coalesce(_before("number") + 1, F.lit(0)),
            "state goes back": step < 0,
            "state jumps": step > 2,
            "first state beyond 1": _before("state").isNull() & (F.col("state") > 1),
            "score not finite": _not_finite("score"),
        },
        "segments": frames | {
            "number not one more": F.col("number") != F.coalesce(_before("number") + 1, F.lit(0)),
            "start not at the end before": F.col("start_frame") != F.coalesce(_before("end_frame"), F.lit(0)),
        },
        "tokens": frames | {
            "number not one more": F.col("number") != F.coalesce(_before("number") + 1, F.lit(0)),
            "start before the end before": F.col("start_frame") < _before("end_frame"),
        },
        "words": frames | {
            "number not above": F.col("number") <= _before("number"),
            "line goes back": F.col("line_index") < _before("line_index"),
            "start before the end before": F.col("start_frame") < _before("end_frame"),
        },
        "lines": {
            "number not above": F.col("number") <= _before("number"),
            "blank with times": (F.col("kind") == "BLANK") & (F.col("start_s").isNotNull() | F.col("end_s").isNotNull()),
            "timed without times": (F.col("kind") != "BLANK") & (F.col("start_s").isNull() | F.col("end_s").isNull()),
            "negative start": F.col("start_s") < 0,
            "end before start": F.col("end_s") < F.col("start_s") - SLACK,
            "start before the one before": F.col("start_s") < F.last("start_s", True).over(Window.partitionBy("doc_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)) - SLACK,
        },
        "output": {
            "number not one more": F.col("number") != F.coalesce(_before("number") + 1, F.lit(0)),
            "timed without stamp": (F.col("kind") == "TIMED") & F.col("at_s").isNull(),
            "negative stamp": (F.col("kind") == "TIMED") & (F.col("at_s") < 0),
            "no text": F.col("text").isNull(),
            "line break in text": F.col("text").rlike("[\r\n]"),
            "unknown kind": ~F.col("kind").isin("TIMED", "BLANK"),
        },
    }[stage]


def stage_problems(stage: str, rows: DataFrame) -> DataFrame:
    """(doc_id, number, problem) of rows of a stage: steps, segments, tokens, words, lines or output."""
    checks = stage_checks(stage)
    marked = rows.select("doc_id", "number", F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]).alias("found"))
    return marked.select("doc_id", "number", F.explode(F.array_compact("found")).alias("problem"))


def strict(rows: DataFrame) -> DataFrame:
    """Rows of which none has a problem: else the job stops with the least one by name and doc_id, whichever
    task met one first (a label that differs also leaves a span without interval).  Reads ``rows`` twice."""
    least = rows.where("problem is not null").agg(F.min(F.struct("problem", F.col("doc_id").cast("string").alias("doc_id"))).alias("__least"))
    said = F.concat(F.lit("integrity: "), F.col("__least.problem"), F.lit(" in "), F.coalesce("__least.doc_id", F.lit("null")))
    stop = F.when(F.col("__least").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(least)).where(stop).drop("problem", "__least")


def require(problems: DataFrame) -> None:
    """Raises if there are any problems (doc_id, number, problem)."""
    first = problems.first()
    if first is not None:
        raise ValueError(f"integrity: {first.problem} at {first.number} in {first.doc_id}")
