"""Source separation over windows: geometry, windows as rows, tensors, and a pluggable model.

A model is a Python function from a batch of tensors (windows x 4 x bins x frames, float32: real and
imaginary parts of left and right) to tensors of the same shape; it is called on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Geometry:
    """Sizes of a separation, checked when made; all in samples."""

    n_fft: int = 6144
    hop: int = 1024
    dim_f: int = 2048
    dim_t: int = 256
    rate: int = 44100
    chunk_seconds: int = 30
    margin_seconds: int = 3
    compensate: float = 1.035

    def __post_init__(self) -> None:
        if min(self.n_fft, self.hop, self.dim_f, self.dim_t, self.rate, self.chunk_seconds) <= 0 or self.margin_seconds < 0:
            raise ValueError("sizes must be above 0 and the margin not below")
        if self.n_fft % 2 or self.dim_f > self.bins:
            raise ValueError("n_fft must be even, and dim_f at most n_fft / 2 + 1")
        if self.generated <= 0:
            raise ValueError("a window must be longer than what is trimmed off it")

    @property
    def bins(self) -> int:
        return self.n_fft // 2 + 1

    @property
    def chunk(self) -> int:
        return self.hop * (self.dim_t - 1)

    @property
    def trim(self) -> int:
        return self.n_fft // 2

    @property
    def generated(self) -> int:
        return self.chunk - 2 * self.trim


def regions(songs: DataFrame, g: Geometry) -> DataFrame:
    """Regions of songs (doc_id, n_samples): doc_id, region, start, end, read_start, read_end (with
    margins inside the song), windows."""
    size, margin = g.chunk_seconds * g.rate, min(g.margin_seconds, g.chunk_seconds) * g.rate
    n = F.col("n_samples").cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start")
    rows = songs.where(n > 0).select("doc_id", n.alias("n"), at).withColumn("end", F.least("n", F.col("start") + size))
    rows = rows.withColumn("read_start", F.greatest(F.lit(0), F.col("start") - margin)).withColumn("read_end", F.least("n", F.col("end") + margin))
    return rows.select("doc_id", F.floor(F.col("start") / size).alias("region"), "start", "end", "read_start", "read_end", F.ceil((F.col("read_end") - F.col("read_start")) / g.generated).alias("windows"))


def windows(songs: DataFrame, g: Geometry) -> DataFrame:
    """One row per window: region columns, window, and what it puts out: out_start, out_end of the song
    (null where only margin is left); a window reads ``trim`` samples more on either side."""
    rows = regions(songs, g).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("window"))
    low = F.col("read_start") + F.col("window") * g.generated
    rows = rows.withColumn("at", low)
    start, end = F.greatest("at", "start"), F.least(F.col("at") + g.generated, F.col("end"))
    return rows.select("doc_id", "region", "window", "read_start", "read_end", "at", F.when(start < end, start).alias("out_start"), F.when(start < end, end).alias("out_end"))


def pack(left: np.ndarray, right: np.ndarray, g: Geometry) -> np.ndarray:
    """A window's two channels of ``chunk`` samples as a tensor 4 x dim_f x dim_t: the low ``dim_f`` bins."""
    out = np.empty((4, g.dim_f, g.dim_t), np.float32)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(g.n_fft) / g.n_fft)
    for k, x in enumerate((left, right)):
        padded = np.pad(np.asarray(x, float), g.n_fft // 2, "reflect")
        frames = np.stack([padded[t * g.hop : t * g.hop + g.n_fft] * hann for t in range(g.dim_t)])
        s = np.fft.rfft(frames, axis=1)[:, : g.dim_f].T
        out[2 * k], out[2 * k + 1] = s.real, s.imag
    return out


def unpack(tensor: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """The two channels of a tensor, bins above ``dim_f`` being 0: the inverse of ``pack`` for such sound."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(g.n_fft) / g.n_fft)
    out = []
    for k in range(2):
        s = np.zeros((g.dim_t, g.bins), complex)
        s[:, : g.dim_f] = tensor[2 * k].T + 1j * tensor[2 * k + 1].T
        total, norm = np.zeros(g.chunk + g.n_fft), np.zeros(g.chunk + g.n_fft)
        for t, frame in enumerate(np.fft.irfft(s, g.n_fft, axis=1)):
            total[t * g.hop : t * g.hop + g.n_fft] += frame * hann
            norm[t * g.hop : t * g.hop + g.n_fft] += hann * hann
        x = np.where(norm > 1e-7, total / np.where(norm > 1e-7, norm, 1), total)
        out.append(x[g.n_fft // 2 : g.n_fft // 2 + g.chunk])
    return out[0], out[1]


def separate(songs: DataFrame, model: Model, g: Geometry = Geometry(), denoise: bool = False, residual: bool = False) -> DataFrame:
    """What a model takes from songs (doc_id, left, right: arrays of samples): doc_id, region, start, left,
    right, one row per region, gained and clipped to -1..1.

    A region with its margins is the unit of work, so a long song is dealt over tasks.  ``denoise``
    averages the model on the sound and on its negative; ``residual`` gives the sound less the result."""
    sized = songs.withColumn("n_samples", F.size("left"))
    at = regions(sized.select("doc_id", "n_samples"), g)
    read = lambda c: F.slice(c, F.col("read_start").cast("int") + 1, (F.col("read_end") - F.col("read_start")).cast("int"))
    rows = sized.join(at, "doc_id").select("doc_id", "region", "start", "end", "read_start", read("left").alias("left"), read("right").alias("right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                own = [np.asarray(r.left, float), np.asarray(r.right, float)]
                n = len(own[0])
                count = -(-n // g.generated)
                padded = [np.pad(x, (g.trim, count * g.generated - n + g.trim)) for x in own]
                made = [np.zeros(count * g.generated) for _ in own]
                for w in range(count):
                    cut = slice(w * g.generated, w * g.generated + g.chunk)
                    tensor = pack(padded[0][cut], padded[1][cut], g)[None]
                    result = (model(tensor) - model(-tensor)) / 2 if denoise else model(tensor)
                    for x, y in zip(made, unpack(np.asarray(result)[0], g)):
                        x[w * g.generated : (w + 1) * g.generated] = y[g.trim : g.trim + g.generated]
                a, b = r.start - r.read_start, r.end - r.read_start
                done = [np.clip((x[a:b] - y[a:b] * g.compensate) if residual else y[a:b] * g.compensate, -1, 1) for x, y in zip(own, made)]
                out.append((r.doc_id, r.region, r.start, done[0], done[1]))
            yield pd.DataFrame(out, columns=["doc_id", "region", "start", "left", "right"])

    key = dict(songs.dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {key}, region long, start long, left array<double>, right array<double>")


def joined(parts: DataFrame) -> DataFrame:
    """The regions of each song in order, as whole channels: doc_id, left, right."""
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region", "left", "right"))).alias("r"))
    return rows.select("doc_id", *[F.flatten(f"r.{c}").alias(c) for c in ("left", "right")])


def emitted(chunks: DataFrame, emitter: Callable[[np.ndarray], np.ndarray], batch: int = 8) -> DataFrame:
    """Outputs of a pluggable emitter on chunks of samples (doc_id, chunk_index, samples): doc_id,
    chunk_index, frame_in_chunk, values.  The emitter takes samples (chunks x samples) of one length and
    gives values (chunks x frames x vocabulary); chunks of a length go to it ``batch`` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, same in rows.groupby(rows.samples.map(len)):
                for a in range(0, len(same), batch):
                    part = same.iloc[a : a + batch]
                    values = np.asarray(emitter(np.stack([np.asarray(x, np.float32) for x in part.samples])))
                    if values.ndim != 3 or len(values) != len(part):
                        raise ValueError(f"an emitter must give chunks x frames x vocabulary, not {values.shape}")
                    frames = values.shape[1]
                    yield pd.DataFrame({"doc_id": np.repeat(part.doc_id.to_numpy(), frames), "chunk_index": np.repeat(part.chunk_index.to_numpy(), frames), "frame_in_chunk": np.tile(np.arange(frames), len(part)), "values": [v for c in values for v in c.astype(float)]})

    key = dict(chunks.dtypes)["doc_id"]
    return chunks.mapInPandas(run, f"doc_id {key}, chunk_index int, frame_in_chunk int, values array<double>")


def onnx_model(path: str, provider: str = "auto", device: int = 0) -> Model:
    """An ONNX model as a function, opened once in each Python worker: provider 'auto', 'cpu' or 'cuda'
    ('auto' is CUDA where it is there)."""
    if provider not in ("auto", "cpu", "cuda"):
        raise ValueError(f"unknown provider {provider!r}")
    opened: list = []

    def run(x: np.ndarray) -> np.ndarray:
        if not opened:
            import onnxruntime as ort

            cuda = "CUDAExecutionProvider" in ort.get_available_providers()
            if provider == "cuda" and not cuda:
                raise ValueError("no CUDA provider")
            use = [("CUDAExecutionProvider", {"device_id": device})] if cuda and provider != "cpu" else []
            opened.append(ort.InferenceSession(path, providers=[*use, "CPUExecutionProvider"]))
        s = opened[0]
        return s.run(None, {s.get_inputs()[0].name: x})[0]

    return run
