"""Windows over samples: energy, noise floor, silence, chunks of frames, separation geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rms(samples: Column) -> Column:
    """Root mean square of an array; values that aren't finite count as 0."""
    finite = F.transform(samples, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    return F.sqrt(F.aggregate(finite, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(F.size(samples), F.lit(1)))


def decibel(value: Column) -> Column:
    return F.when(value <= 1e-6, F.lit(-120.0)).otherwise(20 * F.log10(value))


def windows(audio: DataFrame, window: int, hop: int) -> DataFrame:
    """(doc_id, start, rms) of windows of ``window`` samples every ``hop``, from arrays of samples."""
    some = audio.where(F.size("samples") >= window)
    at = some.select("doc_id", "samples", F.explode(F.sequence(F.lit(0), F.size("samples") - window, F.lit(hop))).alias("start"))
    return at.select("doc_id", "start", rms(F.slice("samples", F.col("start") + 1, F.lit(window))).alias("rms"))


def histogram(levels: DataFrame) -> DataFrame:
    """(doc_id, bin, n) of one-decibel bins from -120 (bin 0) to 60 (bin 180)."""
    at = F.greatest(F.lit(0), F.least(F.lit(180), F.floor(F.col("db") + 120))).cast("int")
    return levels.select("doc_id", at.alias("bin")).groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def noise_floor(bins: DataFrame) -> DataFrame:
    """(doc_id, floor_db): lower edge of the lowest bin whose cumulative count exceeds a tenth."""
    w = Window.partitionBy("doc_id")
    run = bins.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return run.where(F.col("below") > F.floor(F.col("total") / 10)).groupBy("doc_id").agg((F.min("bin") - 120.0).alias("floor_db"))


def silence_threshold(levels: DataFrame, margin_db: float = 6.0) -> DataFrame:
    """(doc_id, threshold_db): least of floor plus margin and peak less 12; peak itself if all is silent."""
    peak = levels.groupBy("doc_id").agg(F.max("db").alias("peak_db"))
    joined = noise_floor(histogram(levels)).join(peak, "doc_id")
    return joined.select("doc_id", F.when(F.col("peak_db") <= -90, F.col("peak_db")).otherwise(F.least(F.col("floor_db") + margin_db, F.col("peak_db") - 12)).alias("threshold_db"))


def silences(levels: DataFrame, window_s: float, least_s: float = 0.25) -> DataFrame:
    """Sustained silences of levels (doc_id, at_s, db, threshold_db): doc_id, start_s, end_s of runs
    of windows at or below the threshold that last ``least_s`` up to their last window's end."""
    w = Window.partitionBy("doc_id").orderBy("at_s")
    silent = levels.withColumn("silent", F.col("db") <= F.col("threshold_db"))
    run = silent.withColumn("new", (F.col("silent") != F.coalesce(F.lag("silent").over(w), ~F.col("silent"))).cast("int")).withColumn("run", F.sum("new").over(w))
    spans = run.where("silent").groupBy("doc_id", "run").agg(F.min("at_s").alias("start_s"), (F.max("at_s") + window_s).alias("end_s"))
    return spans.where(F.col("end_s") - F.col("start_s") >= least_s - 1e-9).drop("run")


def correct_ends(times: DataFrame, quiet: DataFrame, bucket_s: float = 8.0) -> DataFrame:
    """Line ends (doc_id, line_index, end_s, next_start) moved to the first silence that starts in
    [end_s, next_start).  A range join on time buckets."""
    last = F.floor(F.greatest(F.col("next_start"), F.col("end_s")) / bucket_s)
    gaps = times.where("next_start > end_s").select("doc_id", "line_index", "end_s", "next_start", F.explode(F.sequence(F.floor(F.col("end_s") / bucket_s), last)).alias("bucket"))
    starts = quiet.select("doc_id", F.col("start_s").alias("quiet_s"), F.floor(F.col("start_s") / bucket_s).alias("bucket"))
    first = gaps.join(starts, ["doc_id", "bucket"]).where("quiet_s >= end_s and quiet_s < next_start").groupBy("doc_id", "line_index").agg(F.min("quiet_s").alias("quiet_s"))
    return times.join(first, ["doc_id", "line_index"], "left").withColumn("end_s", F.coalesce("quiet_s", "end_s")).drop("quiet_s")


def chunks(audio: DataFrame, window: int, context: int) -> DataFrame:
    """Overlapped chunks of samples, zero padded: doc_id, chunk_index, samples of window + 2 context.
    Audio shorter than a window is one chunk as it is."""
    n = F.size("samples")
    rows = audio.select("doc_id", "samples", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / window) - 1, F.lit(0)).cast("int"))).alias("chunk_index"))
    zeros = lambda k: F.array_repeat(F.lit(0.0).cast("float"), k)
    start = F.col("chunk_index") * window - context
    body = F.slice("samples", F.greatest(start, F.lit(0)) + 1, F.lit(window + 2 * context) - F.greatest(-start, F.lit(0)))
    left = F.greatest(-start, F.lit(0))
    padded = F.concat(zeros(left), body, zeros(F.lit(window + 2 * context) - left - F.size(body)))
    return rows.select("doc_id", "chunk_index", F.when(n < window, F.col("samples")).otherwise(padded).alias("samples"))


def trimmed(outputs: DataFrame, left: int, keep: int, frames: DataFrame) -> DataFrame:
    """Frames of chunk outputs (doc_id, chunk_index, frame_in_chunk, values) without context, numbered
    through, up to each document's ``frames`` (doc_id, n_frames)."""
    kept = outputs.where((F.col("frame_in_chunk") >= left) & (F.col("frame_in_chunk") < left + keep))
    at = kept.select("doc_id", (F.col("chunk_index") * keep + F.col("frame_in_chunk") - left).alias("frame"), "values")
    return at.join(frames, "doc_id").where("frame < n_frames").drop("n_frames")


def log_softmax(values: Column) -> Column:
    """Natural-log softmax of an array in doubles."""
    bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  evaluates x once for all elements

    def with_top(top: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
        return bind(F.log(total), lambda log: F.transform(values, lambda x: x.cast("double") - top - log))

    return bind(F.array_max(values).cast("double"), with_top)


def log_probabilities(values: Column, kind: str) -> Column:
    """Emissions of a kind ('logits', 'probabilities', 'log-probabilities') as log-probabilities."""
    if kind == "logits":
        return log_softmax(values)
    if kind == "probabilities":
        ok = F.forall(values, lambda x: (x > 0) & ~F.isnan(x) & (x < float("inf")))
        return F.when(F.assert_true(ok).isNull(), F.transform(values, lambda x: F.log(x.cast("double"))))
    if kind == "log-probabilities":
        return values
    raise ValueError(f"unknown emission kind {kind!r}")


def error_metrics(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of sample pairs (key, a, b): count, max_abs, rms_error, snr_db (999 without error, -999 without signal)."""
    d = F.col("a") - F.col("b")
    agg = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(d)).alias("max_abs"), F.sum(d * d).alias("err"), F.sum(F.col("a") * F.col("a")).alias("sig"))
    snr = F.when(F.col("err") == 0, 999.0).when(F.col("sig") == 0, -999.0).otherwise(10 * F.log10(F.col("sig") / F.col("err")))
    return agg.select(key, "n", "max_abs", F.sqrt(F.col("err") / F.col("n")).alias("rms_error"), snr.alias("snr_db"))


def best_offset(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Offset in [-most, most] of b (doc_id, i, x) against a that gives the least rms error, then
    max_abs, then the first: a shifted equi-join for each candidate."""
    shifts = b.select("doc_id", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("offset"), F.col("i"), F.col("x").alias("b"))
    pairs = a.select("doc_id", F.col("i"), F.col("x").alias("a")).join(shifts.withColumn("i", F.col("i") + F.col("offset")), ["doc_id", "i"])
    scored = error_metrics(pairs.withColumn("key", F.struct("doc_id", "offset")), "key")
    best = scored.groupBy(F.col("key.doc_id").alias("doc_id")).agg(F.min(F.struct("rms_error", "max_abs", F.col("key.offset").alias("offset"))).alias("best"))
    return best.select("doc_id", "best.offset", "best.rms_error", "best.max_abs")


def output_sample(model: Column, source: Column | None = None, gain: float = 1.035) -> Column:
    """A separated sample: with ``source`` the residual, else the model's; gained and clipped."""
    x = (source - model * gain) if source is not None else model * gain
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def separation_regions(n_samples: int, region: int = 30 * 44100, margin: int = 3 * 44100, n_fft: int = 6144, hop: int = 1024, dim_t: int = 256) -> pd.DataFrame:
    """Geometry of source separation: regions with margins, and the windows of each."""
    chunk, trim = hop * (dim_t - 1), n_fft // 2
    gen = chunk - 2 * trim
    rows = []
    for k, start in enumerate(range(0, max(n_samples, 1), region)):
        a, b = max(0, start - margin), min(n_samples, start + region + margin)
        rows.append((k, start, min(n_samples, start + region), a, b, -(-(b - a) // gen)))
    return pd.DataFrame(rows, columns=["region", "start", "end", "read_start", "read_end", "windows"])


def spectra(audio: DataFrame, n_fft: int = 6144, hop: int = 1024) -> DataFrame:
    """Centred short-time spectra under a periodic Hann window: doc_id, frame, re, im."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        for rows in batches:
            for key, x in zip(rows.doc_id, rows.samples):
                padded = np.pad(np.asarray(x, float), n_fft // 2)
                frames = len(x) // hop + 1
                s = np.fft.rfft(np.stack([padded[k * hop : k * hop + n_fft] * hann for k in range(frames)]), axis=1)
                yield pd.DataFrame({"doc_id": key, "frame": np.arange(frames), "re": list(s.real), "im": list(s.imag)})

    return audio.select("doc_id", "samples").mapInPandas(run, f"doc_id {dict(audio.dtypes)['doc_id']}, frame int, re array<double>, im array<double>")


def resynthesis(of: DataFrame, n_fft: int = 6144, hop: int = 1024) -> DataFrame:
    """Inverse of ``spectra`` by overlap-add with squared-window normalisation: doc_id, samples."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        n = (len(rows) - 1) * hop + n_fft
        total, norm = np.zeros(n), np.zeros(n)
        for k, (re, im) in enumerate(zip(rows.re, rows.im)):
            total[k * hop : k * hop + n_fft] += np.fft.irfft(np.asarray(re) + 1j * np.asarray(im), n_fft) * hann
            norm[k * hop : k * hop + n_fft] += hann * hann
        x = np.where(norm > 1e-7, total / np.where(norm > 1e-7, norm, 1), total)[n_fft // 2 : n - n_fft // 2]
        return pd.DataFrame({"doc_id": [rows.doc_id.iloc[0]], "samples": [x]})

    return of.groupBy("doc_id").applyInPandas(run, f"doc_id {dict(of.dtypes)['doc_id']}, samples array<double>")


def resampled(samples: Column, rate: Column, to: int) -> Column:
    """An array of samples at another rate, by linear interpolation."""

    def of(s: Column) -> Column:  # a variable, so that the array is evaluated once
        n = F.size(s)
        count = F.floor(n * F.lit(to) / rate).cast("int")
        at = lambda i: i * rate / F.lit(to)
        low = lambda i: F.floor(at(i)).cast("int")
        get = lambda i: F.element_at(s, F.least(i + 1, n))
        value = lambda i: get(low(i)) + (get(low(i) + 1) - get(low(i))) * (at(i) - low(i))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), value)).otherwise(F.array().cast("array<double>"))

    return F.element_at(F.transform(F.array(samples), of), 1)


def level_metrics(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of sample pairs (key, a, b): peaks of both and numbers of values that are NaN or infinite."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    peak = lambda c: F.max(F.when(~bad(c), F.abs(F.col(c))))
    return pairs.groupBy(key).agg(peak("a").alias("peak_a"), peak("b").alias("peak_b"), F.count_if(F.isnan("a") | F.isnan("b")).alias("nan"), F.count_if((F.abs(F.col("a")) == float("inf")) | (F.abs(F.col("b")) == float("inf"))).alias("infinite"))


def reconstruction(mixture: DataFrame, stems: list[DataFrame]) -> DataFrame:
    """Pairs (doc_id, i, a, b) of a mixture (doc_id, i, x) and the sum of its stems, by place; a place that
    a stem lacks counts as 0 there."""
    total = stems[0]
    for s in stems[1:]:
        total = total.unionByName(s)
    summed = total.groupBy("doc_id", "i").agg(F.sum("x").alias("b"))
    return mixture.select("doc_id", "i", F.col("x").alias("a")).join(summed, ["doc_id", "i"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))


def padded_scores(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (doc_id, token_index, padded_start, padded_end) with the mean score of all frames (doc_id,
    frame, score) they are padded to.  Means come from running sums at both ends: no range join."""
    w = Window.partitionBy("doc_id").orderBy("frame")
    total = frames.select("doc_id", (F.col("frame") + 1).alias("at"), F.sum("score").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("n"))
    ends = [total.select("doc_id", F.col("at").cast("long").alias(c), F.col("total").alias(f"{c}_total"), F.col("n").alias(f"{c}_n")) for c in ("padded_start", "padded_end")]
    met = spans.join(ends[0], ["doc_id", "padded_start"], "left").join(ends[1], ["doc_id", "padded_end"])
    sum_, n = (F.col(f"padded_end_{x}") - F.coalesce(f"padded_start_{x}", F.lit(0)) for x in ("total", "n"))
    return met.select("doc_id", "token_index", "padded_start", "padded_end", (sum_ / n).alias("score"))


def merged_spans(spans: DataFrame, threshold_s: float = 0.0) -> DataFrame:
    """Spans (doc_id, number, start_s, end_s) with starts moved back to the end before where the gap is
    under ``threshold_s``."""
    w = Window.partitionBy("doc_id").orderBy("number")
    gap = F.col("start_s") - F.lag("end_s").over(w)
    return spans.withColumn("start_s", F.when(gap < threshold_s, F.lag("end_s").over(w)).otherwise(F.col("start_s")))
