"""WAV files as rows: header, samples of every depth, and writing.

A damaged file is a row with ``problem``, not a failed job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
_COLUMNS = "doc_id string, channel int, sample_rate int, samples array<float>, problem string"


def parse(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (frames x channels, float32) of a WAV file; ValueError says what is wrong."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, kind = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("short fmt chunk")
            code, channels, rate, _, _, depth = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENSIBLE and len(body) >= 26:
                code = int.from_bytes(body[24:26], "little")
            kind = code, depth
        elif name == b"data":
            if kind is None:
                raise ValueError("data before fmt")
            if not channels or not rate:
                raise ValueError("no channels or no rate")
            x = _decode(body, *kind)
            return rate, x[: len(x) // channels * channels].reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _decode(body: bytes, code: int, depth: int) -> np.ndarray:
    if (code, depth) == (FLOAT, 32):
        return np.frombuffer(body[: len(body) // 4 * 4], "<f4").astype(np.float32)
    if (code, depth) == (FLOAT, 64):
        return np.frombuffer(body[: len(body) // 8 * 8], "<f8").astype(np.float32)
    if code != PCM or depth not in (8, 16, 24, 32):
        raise ValueError(f"format {code} of {depth} bits")
    if depth == 8:
        return ((np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128).astype(np.float32)
    if depth == 24:
        three = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        wide = np.zeros((len(three), 4), np.uint8)
        wide[:, 1:] = three
        return (wide.view("<i4").ravel() / np.float64(1 << 31)).astype(np.float32)
    size = depth // 8
    return (np.frombuffer(body[: len(body) // size * size], f"<i{size}") / np.float64(1 << depth - 1)).astype(np.float32)


def read_samples(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """WAV files, and others as raw little-endian float32 of ``channels``, as planar blocks: doc_id,
    channel, sample_rate (null if raw), samples, problem (null if whole)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, raw in zip(rows.path, rows.content):
                try:
                    if raw[:4] == b"RIFF":
                        rate, x = parse(raw)
                    else:
                        if len(raw) % (4 * channels):
                            raise ValueError("length is no multiple of the sample size")
                        rate, x = None, np.frombuffer(raw, "<f4").reshape(-1, channels)
                    out += [(key, c, rate, np.ascontiguousarray(x[:, c]), None) for c in range(x.shape[1])]
                except ValueError as e:
                    out.append((key, None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=["doc_id", "channel", "sample_rate", "samples", "problem"])
            yield frame.astype({"channel": "Int32", "sample_rate": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _COLUMNS)


def mono(audio: DataFrame, rate: int | None = None) -> DataFrame:
    """Channels averaged to one, and resampled to ``rate`` by linear interpolation: doc_id, sample_rate,
    samples, seconds."""
    from tactus.operators.audio import resampled

    n = F.count(F.lit(1))
    planes = audio.where("problem is null").groupBy("doc_id", "sample_rate").agg(n.alias("n"), F.collect_list("samples").alias("planes"))
    total = F.aggregate(F.slice("planes", 2, 1 << 16), F.element_at("planes", 1).cast("array<double>"), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    one = planes.select("doc_id", "sample_rate", F.transform(total, lambda x: x / F.col("n")).alias("samples"))
    if rate is not None:
        same = F.col("sample_rate").isNull() | (F.col("sample_rate") == rate)
        # the samples first: beside a new column of its name, a lambda would read that one's rate
        one = one.withColumn("samples", F.when(same, F.col("samples")).otherwise(resampled(F.col("samples"), F.col("sample_rate"), rate)))
        one = one.withColumn("sample_rate", F.lit(rate))
    return one.withColumn("seconds", F.size("samples") / F.col("sample_rate"))


def encode(samples: list[np.ndarray], rate: int, depth: int = 16) -> bytes:
    """A WAV file of planar samples: PCM of 16 or 24 bits, or 32-bit float; values are clipped to -1..1."""
    x = np.stack([np.asarray(s, float) for s in samples], 1) if samples else np.zeros((0, 1))
    code = FLOAT if depth == 32 else PCM
    if depth == 32:
        body = x.astype("<f4").tobytes()
    else:
        top = (1 << depth - 1) - 1
        whole = np.clip(np.rint(np.clip(x, -1, 1) * (top + 1)), -top - 1, top).astype("<i4")
        body = whole.astype("<i2").tobytes() if depth == 16 else np.ascontiguousarray(whole.reshape(-1, 1).view(np.uint8)[:, :3]).tobytes()
    frame = x.shape[1] * depth // 8
    head = struct.pack("<HHIIHH", code, x.shape[1], rate, rate * frame, frame, depth)
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body + pad


def encoded(audio: DataFrame, depth: int = 16) -> DataFrame:
    """(doc_id, content): a WAV file for each document of planar blocks (doc_id, channel, sample_rate, samples)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("channel")
        return pd.DataFrame({"doc_id": [rows.doc_id.iloc[0]], "content": [encode(list(rows.samples), int(rows.sample_rate.iloc[0]), depth)]})

    return audio.select("doc_id", "channel", "sample_rate", "samples").groupBy("doc_id").applyInPandas(run, f"doc_id {dict(audio.dtypes)['doc_id']}, content binary")


def write_wav(audio: DataFrame, path: str, depth: int = 16) -> None:
    """WAV files as rows (doc_id, content) of a Parquet table: one row a file, in any store that Spark writes."""
    encoded(audio, depth).write.mode("errorifexists").parquet(path)


# Container formats by name, extension, whether they stream, and whether they keep all.
FORMATS = [("wav", "wav", True, True), ("flac", "flac", True, True), ("mp3", "mp3", True, False), ("opus", "opus", True, False)]
OPUS_RATES = [8000, 12000, 16000, 24000, 48000]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, extension string, streams boolean, lossless boolean")


def with_format(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds the container format of each path's extension (null if none is known)."""
    from tactus.functions.text import extension

    known = F.broadcast(formats(files.sparkSession).select("format", F.col("extension").alias("__extension")))
    return files.withColumn("__extension", extension(F.col(path))).join(known, "__extension", "left").drop("__extension")


def output_rate(format_, rate) -> F.Column:
    """The rate that a container is written at: Opus knows a few only, and takes 48,000 for others."""
    return F.when((format_ == "opus") & ~rate.isin(OPUS_RATES), 48000).otherwise(rate)
