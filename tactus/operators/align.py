"""Forced alignment: a grouped Viterbi search over frame scores, with stars, one group a document.

The state graph alternates blanks and labels.  A step stays, moves one on, or two where the
labels differ; of equal predecessors staying wins, then one on, then two.  Score rows are kept
every so many frames and the predecessors between two of them are found again on the way back,
so a document of T frames and S states takes about 5 S sqrt(T) bytes.  Documents whose frames
can't hold their labels are reported, not searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAR = -1
PATH = "doc_id {}, frame int, state int, token_index int, token_id int, is_blank boolean, is_star boolean, score double"


def required_frames(tokens: DataFrame, stars: str = "none") -> DataFrame:
    """Per document: labels, adjacent equal labels, and the frames they need, stars included."""
    w = Window.partitionBy("doc_id").orderBy("token_index")
    again = F.col("token_id") == F.lag("token_id").over(w)
    if stars == "segment":  # a star stands between
        again = again & ~F.col("starts_segment")
    marked = tokens.withColumn("again", again)
    more = {"none": F.lit(0), "edges": F.lit(2), "segment": F.count_if("starts_segment") if "starts_segment" in tokens.columns else F.lit(0)}[stars]
    return marked.groupBy("doc_id").agg((F.count(F.lit(1)) + more).alias("labels"), F.count_if("again").alias("repeats")).withColumn("required", F.col("labels") + F.col("repeats"))


def segment_stars(tokens: DataFrame) -> DataFrame:
    """(doc_id, stars): the stars that 'segment' puts in."""
    return tokens.groupBy("doc_id").agg(F.count_if("starts_segment").alias("stars"))


def with_stars(token_ids: list[int], starts: list[bool] | None, mode: str) -> tuple[list[int], list[int]]:
    """Labels and their token indexes (-1 for a star): 'none', 'edges', or one before each 'segment'."""
    labels, at = [], []
    for i, t in enumerate(token_ids):
        if mode == "segment" and starts and starts[i] or mode == "edges" and i == 0:
            labels.append(STAR)
            at.append(-1)
        labels.append(t)
        at.append(i)
    if mode == "edges" and token_ids:
        labels.append(STAR)
        at.append(-1)
    return labels, at


def search(scores: np.ndarray, labels: list[int], blank: int = 0) -> np.ndarray:
    """The best path: a state for each frame.  ``scores``: frames x vocabulary log-probabilities."""
    frames, n = len(scores), len(labels)
    state = np.full(2 * n + 1, blank)
    state[1::2] = labels
    star = state == STAR
    use = np.where(star, 0, state)
    skip = np.zeros(len(state), bool)
    skip[3::2] = np.asarray(labels)[1:] != np.asarray(labels)[:-1]
    def step(best: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores after frame t and each state's predecessor (states back)."""
        emit = np.where(star, np.float32(0), scores[t][use].astype(np.float32))
        one = np.concatenate([[np.float32(-np.inf)], best[:-1]])
        two = np.where(skip, np.concatenate([np.full(2, -np.inf, np.float32), best[:-2]])[: len(state)], np.float32(-np.inf))
        back = np.zeros(len(state), np.uint8)
        top = best.copy()
        for k, other in ((1, one), (2, two)):
            more = other > top
            back[more], top[more] = k, other[more]
        return (top + emit).astype(np.float32), back

    best = np.full(len(state), -np.inf, np.float32)
    best[:2] = np.where(star, np.float32(0), scores[0][use].astype(np.float32))[:2]
    every = max(1, int(2 * np.sqrt(frames)))
    kept = {0: best}
    for t in range(1, frames):
        best, _ = step(best, t)
        if t % every == 0:
            kept[t] = best
    out = np.empty(frames, np.int64)
    out[-1] = len(state) - 1 if len(state) == 1 or best[-1] > best[-2] else len(state) - 2
    for low in range((frames - 1) // every * every, -1, -every):
        row, backs = kept.pop(low), []
        high = min(low + every, frames - 1)
        for t in range(low + 1, high + 1):
            row, back = step(row, t)
            backs.append(back)
        for t in range(high, low, -1):
            out[t - 1] = out[t] - backs[t - low - 1][out[t]]
    return out


def align(emissions: DataFrame, tokens: DataFrame, blank: int = 0, stars: str = "none") -> DataFrame:
    """Path steps of each document from emissions (doc_id, frame, values: log-probabilities) and
    tokens (doc_id, token_index, token_id, starts_segment).  Infeasible documents give no rows
    (see ``infeasible``)."""

    def run(frames: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if frames.empty or targets.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in PATH.split(", ")])
        frames, targets = frames.sort_values("frame"), targets.sort_values("token_index")
        labels, at = with_stars(targets.token_id.tolist(), targets.starts_segment.tolist(), stars)
        scores = np.stack(frames["values"].to_numpy())
        if len(scores) < len(labels) + sum(a == b for a, b in zip(labels, labels[1:])):
            return pd.DataFrame(columns=[c.split()[0] for c in PATH.split(", ")])
        state = search(scores, labels, blank)
        label = np.where(state % 2 == 1, np.array(labels)[state // 2 - (state // 2 == len(labels))], blank)
        is_blank, is_star = state % 2 == 0, (state % 2 == 1) & (label == STAR)
        index = np.where(is_blank | is_star, -1, np.array(at)[np.minimum(state // 2, len(labels) - 1)])
        value = np.where(is_star, 0.0, scores[np.arange(len(scores)), np.where(is_star, 0, label)])
        return pd.DataFrame({"doc_id": frames.doc_id.to_numpy(), "frame": frames.frame.to_numpy(), "state": state, "token_index": pd.array(np.where(index < 0, None, index), "Int32"), "token_id": label, "is_blank": is_blank, "is_star": is_star, "score": value})

    left = emissions.select("doc_id", "frame", "values").groupBy("doc_id")
    return left.cogroup(tokens.select(F.col("doc_id").alias("owner"), "token_index", "token_id", "starts_segment").groupBy("owner")).applyInPandas(run, PATH.format(dict(emissions.dtypes)["doc_id"]))


def infeasible(emissions: DataFrame, tokens: DataFrame, stars: str = "none") -> DataFrame:
    """Documents with fewer frames than their labels need, stars included."""
    frames = emissions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("frames"))
    return required_frames(tokens, stars).join(frames, "doc_id", "left").where("coalesce(frames, 0) < required")
