"""Operator 1: cost-balanced packing of documents into fixed-size training sequences.

Each task tokenizes its documents, gathers them in windows of about ``window_tokens``
tokens (two thousand full sequences) and at most ``window_rows`` documents, which bounds
its memory, and packs each window on its own:
no shuffle, and a task run again after a lost executor gives the same rows.

Within a window a document of more than ``seq_len`` tokens gives full sequences and a
rest.  Pieces are taken in descending order of their estimated cost
``linear * n + quadratic * n * n`` (attention is quadratic in a piece, the rest of the
network linear) and go to the sequence of lowest cost that still has room.  A piece that
no sequence has room for is cut over the sequences with most room, so only the last
sequence of a window is padded.

Defined results: null and empty texts are one end token; texts of any length are cut;
repeated rows and ids are packed each for itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

_ENCODERS: dict[str, object] = {}


def encoder(name: str):
    """ids of a text under a public vocabulary, special strings being ordinary text.

    For ``byte_bpe_50k.json`` the same vocabulary's rank file is run by tiktoken where it
    is present: equal ids (tests/llm/test_packing.py), a quarter of the time.
    """
    if name not in _ENCODERS:
        import public_tokenizers as P

        if name == "byte_bpe_50k.json":
            import tiktoken

            lines = open(P.path("byte_bpe_50k.tiktoken"), "rb")  # noqa: SIM115
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            _ENCODERS[name] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(P.path(name))
            t.encode_special_tokens = True
            _ENCODERS[name] = lambda s: t.encode(s, add_special_tokens=False).ids
    return _ENCODERS[name]


def assign(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pack one window: (document, start, length, sequence, offset) for each piece, and the sequences' costs."""
    cost_of = lambda n: linear * n + quadratic * n * n
    out, costs = [], []
    rest = []
    for d, n in enumerate(lengths):
        full = n // seq_len
        for k in range(full):
            out.append((d, k * seq_len, seq_len, len(costs), 0))
            costs.append(cost_of(seq_len))
        if n % seq_len:
            rest.append((n % seq_len, d, full * seq_len))
    base = len(costs)
    bins = -(-sum(n for n, _, _ in rest) // seq_len)
    room, cost = np.full(bins, seq_len, np.int64), np.zeros(bins)
    for n, d, start in sorted(rest, key=lambda x: (-cost_of(x[0]), x[1])):
        while n:
            fits = room >= n
            k = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            put = min(n, int(room[k]))
            out.append((d, start, put, base + k, int(seq_len - room[k])))
            room[k] -= put
            cost[k] += cost_of(put)
            n, start = n - put, start + put
    return out, np.concatenate([np.array(costs), cost])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", eos_id: int = 1, seq_len: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 4096, window_tokens: int = 2048 * 2048, window_rows: int = 1 << 17) -> DataFrame:
    """One row per piece; ``cost`` is the estimated cost of the whole sequence it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            pieces, costs = assign([len(x) for _, x in held], seq_len, linear, quadratic)
            pieces.sort(key=lambda p: (p[3], p[4]))
            rows = [(held[d][0], start, n, zlib.crc32(held[d][1][start : start + n].tobytes()), len(held[d][1]), sequence + s, at, float(costs[s])) for d, start, n, s, at in pieces]
            sequence += len(costs)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 7 + [pa.float64()])], names=NAMES)

        for rows in batches:
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                ids = np.array([*encode(text.as_py() or ""), eos_id], "<u4")
                held.append((key, ids))
                size += len(ids)
                if size >= window_tokens or len(held) >= window_rows:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
