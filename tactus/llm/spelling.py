"""Byte-level context mixing: the probability of a word's spelling (part of operator 6).

A word is coded byte by byte with a closing space, and each byte as eight binary decisions from
the high bit down.  A bit predictor for each of ORDERS looks a decision up in a hashed table of
counts by its context: the last two to six bytes of the word, or the whole word so far.  Their
log-odds are mixed by the weights of a gate (bit number and how often the two longest contexts
were seen), and an adaptive map by preceding byte refines the mixed probability.

``fit`` learns from all words given in one online pass: some words are predicted with what the task
has counted so far, weights and map are moved, and then the words are counted.  Tables have 2^16 to 2^MOST_BITS slots, by
the number of words; contexts that share a slot are counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import textops as T
from tactus.llm.storage import staged

#: Bytes of context of each predictor, 0 for the whole word so far.
ORDERS = [2, 3, 4, 6, 0]
MOST_BITS = 20
GATES = 8 * 5 * 4
BUCKETS = 33
LIMIT = 12.0
#: Gates by how often the two longest contexts were seen: counts above these.
LONG, MID = (0.5, 3.5, 30.5, 1000.5), (0.5, 5.5, 100.5)
PRIOR = np.float32(0.02)
#: The last input of every decision.
BIAS = np.float32(0.3)
#: Slots that travel in one row.
BLOCK = 1 << 14


def table_bits(words: int) -> list[int]:
    """Slots of each order's table, as powers of two."""
    some = int(np.clip(np.ceil(np.log2(16.0 * words + 1)), 16, MOST_BITS))
    return [min(some, 18), *[some] * (len(ORDERS) - 1)]


@dataclass
class Words:
    """Symbols of some words: byte, its word and place in it, preceding byte, and for each predictor a context hash."""

    symbol: np.ndarray
    word: np.ndarray
    place: np.ndarray
    before: np.ndarray
    context: list[np.ndarray]


def spell(words: pa.Array) -> Words:
    """The coded bytes of words (strings), each closed by a space."""
    col = words.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    size = np.diff(offs)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(start[-1] + 16, 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size + 1)
    at = np.arange(start[-1])
    place = at - start[:-1][word]
    text[np.flatnonzero(place < size[word])] = raw[offs[0] : offs[-1]]
    last = [np.where(place >= k, text[np.maximum(at - k, 0)], 0).astype(np.uint64) for k in range(1, 7)]
    packed, context = np.zeros(len(at), np.uint64), {}
    for k in range(6):
        packed = packed | (last[k] << np.uint64(8 * k))
        context[k + 1] = T.mix(packed + np.uint64((k + 1) << 56))
    context[0] = T.hash_runs(text, start[:-1][word], at)
    return Words(text[: start[-1]], word, place, last[0].astype(np.int64), [T.mix(context[k]) for k in ORDERS])


def slots(w: Words, bit: int, bits: list[int]) -> list[np.ndarray]:
    """Table slots of a bit of every symbol, one array a predictor."""
    node = ((1 << bit) | (w.symbol.astype(np.uint64) >> np.uint64(8 - bit))) * T._M1
    found = []
    for c, b in zip(w.context, bits):
        at = c + node
        at *= T._M2
        at >>= np.uint64(64 - b)
        found.append(at.view(np.int64))
    return found


def bases(bits: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([1 << b for b in bits])])


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))


def bucket(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bucket of a log-odds and how far it lies towards the next."""
    at = (np.clip(x, -LIMIT, LIMIT - 1e-3) + x.dtype.type(LIMIT)) * x.dtype.type((BUCKETS - 1) / (2 * LIMIT))
    low = np.floor(at)
    return low.astype(np.int64), at - low


def map_from(hits: np.ndarray, tries: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """The adaptive map: of each context (row) the probability at each bucket."""
    middle = squash(np.arange(BUCKETS) * 2 * LIMIT / (BUCKETS - 1) - LIMIT)
    return ((hits + prior * middle) / (tries + prior)).astype(np.float32)


def refine(map_: np.ndarray, p: np.ndarray, x: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The mixed probability and its mapped value, averaged."""
    low, part = bucket(x)
    at = context * BUCKETS + low
    flat = map_.ravel()
    mapped = flat.take(at)
    at += 1
    more = flat.take(at)
    more -= mapped
    more *= part
    mapped += more
    mapped += p
    mapped *= 0.5
    return np.clip(mapped, 1e-6, 1 - 1e-6, out=mapped)


def by_gate(x: np.ndarray, miss: np.ndarray, gate: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of each input (BIAS last) times ``miss`` over the decisions of each gate (256 gates at most), of which there are ``per``."""
    order = np.argsort(gate.astype(np.uint8), kind="stable")
    some = np.flatnonzero(per)
    start = (np.cumsum(per) - per)[some]
    miss = miss.take(order, mode="clip")
    total = np.zeros((len(per), len(x)))
    if not len(some):
        return total
    for j, row in enumerate(x[:-1]):
        row = row.take(order, mode="clip")
        row *= miss
        total[some, j] = np.add.reduceat(row, start)
    total[some, -1] = np.add.reduceat(miss, start) * BIAS
    return total


class Learner:
    """Mixer weights by gate and the sums of an adaptive map, learned online in steps of some decisions."""

    def __init__(self, gates: int, inputs: int, contexts: int, rate: float = 0.02):
        self.weights = np.full((gates, inputs), 0.3)
        self.speed = np.full((gates, 1), 1e-8)
        self.hits, self.tries = np.zeros(contexts * BUCKETS), np.zeros(contexts * BUCKETS)
        self.rate, self.steps, self.seen = rate, 0, 0

    def step(self, x: np.ndarray, gate: np.ndarray, set_: np.ndarray, context: np.ndarray) -> None:
        """x: inputs x decisions, bias (the same for all) last; set_: 0 or 1."""
        gates = len(self.weights)
        self.steps += 1
        mixed = mix(x, self.weights.astype(np.float32), gate)
        miss = set_.astype(np.float32) - squash(mixed)
        per = np.bincount(gate, minlength=gates)[:, None]
        slope = by_gate(x, miss, gate, per[:, 0]) / np.maximum(per, 1)
        self.speed = np.where(per > 0, 0.95 * self.speed + 0.05 * (slope**2).mean(1, keepdims=True), self.speed)
        self.weights += self.rate * (per / (20 + per)) * slope / (np.sqrt(self.speed) + 1e-3) / np.sqrt(1 + self.steps / 800)
        if self.steps > 20:
            low, part = bucket(mixed)
            found = np.bincount(2 * (context * BUCKETS + low + (part > 0.5)) + set_, minlength=2 * len(self.hits)).reshape(-1, 2)
            self.hits += found[:, 1]
            self.tries += found[:, 0] + found[:, 1]

    def vector(self) -> np.ndarray:
        """Weights times ``seen``, hits, tries and ``seen``: what adds up over tasks."""
        return np.concatenate([self.weights.ravel() * self.seen, self.hits, self.tries, [self.seen]])


#: What tasks find: blocks of a table, and parts of a vector.
FOUND = "part long, block long, counts binary, at int, value double"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def vector_rows(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(x)
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(x)], names=_NAMES)


def table_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts as one row a block of slots that has any, compressed."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k in range(-(-len(counts) // BLOCK)):
        some = counts[k * BLOCK : (k + 1) * BLOCK]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([_squeeze(some)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64())], names=_NAMES)


def learned(found: DataFrame, gates: int, inputs: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map from the vectors of all tasks' learners, which are added up in Spark."""
    blank = Learner(gates, inputs, contexts)
    flat = np.zeros(gates * inputs + 2 * contexts * BUCKETS + 1)
    for r in found.where("at is not null").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    a, b = gates * inputs, gates * inputs + contexts * BUCKETS
    weights = (flat[:a] / flat[-1]).reshape(gates, inputs) if flat[-1] else blank.weights
    return weights.astype(np.float32), map_from(flat[a:b].reshape(contexts, BUCKETS), flat[b:-1].reshape(contexts, BUCKETS))


def summed(found: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' tables (slots, 2).  Blocks are added in groups of 64 tasks, these again so, until
    64 or fewer are left; the driver gets one table."""

    def add(table: pa.Table) -> pa.Table:
        total = sum((_widen(x.as_py()) for x in table["counts"]), np.float32(0))
        return pa.table({"part": pa.array([table["part"][0].as_py() // 64]), "block": pa.array([table["block"][0].as_py()]), "counts": pa.array([_squeeze(total)], pa.binary())})

    kind = "part long, block long, counts binary"
    some = found.where("block is not null").select("part", "block", "counts")
    left = (some.agg(F.max("part")).first()[0] or 0) + 1
    while left > 64:
        some = some.groupBy(F.floor(F.col("part") / 64), "block").applyInArrow(add, kind)
        left = -(-left // 64)
    counts = np.zeros((size, 2), np.float32)
    for r in some.groupBy("block").applyInArrow(add, kind).collect():
        got = _widen(r.counts)
        counts[r.block * BLOCK : r.block * BLOCK + len(got)] = got
    return counts


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts, mostly small, as compressed byte planes with their number before them."""
    planes = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return counts.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _widened(raw: bytes, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """What ``_squeeze`` was given, ``most`` slots at a time."""
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(memoryview(raw)[8:], 4 * n, "zstd"), np.uint8, 4 * n).reshape(4, n)
    for a in range(0, n, 2 * most):
        yield np.ascontiguousarray(planes[:, a : a + 2 * most].T).view("<u4").astype(np.float32).reshape(-1, 2)


def _widen(raw: bytes) -> np.ndarray:
    counts, at = np.empty((int.from_bytes(raw[:8], "little") // 2, 2), np.float32), 0
    for some in _widened(raw):
        counts[at : at + len(some)] = some
        at += len(some)
    return counts


def mix(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Log-odds (inputs x decisions, BIAS last) added up by the weights of each decision's gate."""
    total = (weights[:, -1] * BIAS).take(gate, mode="clip")
    for j in range(len(x) - 1):
        some = weights[:, j].take(gate, mode="clip")
        some *= x[j]
        total += some
    return total


def inputs(counts: np.ndarray, at: list[np.ndarray], bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each predictor with the bias, and the gate."""
    pairs = counts.view(np.uint64).ravel()
    x = np.empty((len(ORDERS) + 1, len(at[0])), np.float32)
    for j, s in enumerate(at):
        n = pairs.take(s).view(np.float32)
        n += PRIOR
        np.divide(n[1::2], n[::2], out=x[j])
        if j >= len(ORDERS) - 2:
            seen = n[::2] + n[1::2] - 2 * PRIOR
            level = sum((seen > edge).view(np.uint8) for edge in (MID if j == len(ORDERS) - 2 else LONG))
            gate = level if j == len(ORDERS) - 2 else (bit * 5 + level.astype(np.int64)) * 4 + gate
    np.log(x[:-1], out=x[:-1])
    x[-1] = BIAS
    return x, gate


@dataclass
class Model:
    """Bit counts (slots, 2), the mixer's weights (gate, predictor and bias) and the adaptive map (byte, bucket)."""

    counts: np.ndarray
    bits: list[int]
    weights: np.ndarray
    map: np.ndarray

    def __getstate__(self) -> tuple:
        """Travels with its counts compressed."""
        return _squeeze(self.counts), self.bits, self.weights, self.map

    def __setstate__(self, state: tuple) -> None:
        self.counts = _widen(state[0])
        self.bits, self.weights, self.map = state[1:]

    def log10(self, words: pa.Array, skip: np.ndarray | int = 0) -> np.ndarray:
        """log10 probability of each word's spelling, but for its first ``skip`` bytes, which are known."""
        w = spell(words)
        total = np.zeros(len(w.symbol))
        for bit in range(8):
            x, gate = inputs(self.counts, [s + b for s, b in zip(slots(w, bit, self.bits), bases(self.bits))], bit)
            mixed = mix(x, self.weights, gate)
            p = refine(self.map, squash(mixed), mixed, w.before)
            total += np.log10(np.where((w.symbol >> (7 - bit)) & 1 > 0, p, 1 - p))
        total[w.place < (skip[w.word] if isinstance(skip, np.ndarray) else skip)] = 0
        return np.bincount(w.word, total, len(words))


def learn_words(parts: Iterator[pa.Array], bits: list[int], step: int = 2048) -> tuple[np.ndarray, Learner]:
    """One online pass over words: counts, weights and map."""
    base = bases(bits)
    counts = np.zeros((base[-1], 2), np.float32)
    flat = counts.ravel()
    learner = Learner(GATES, len(ORDERS) + 1, 256)
    for words in parts:
        for a in range(0, len(words), step):
            w = spell(words.slice(a, step))
            for bit in range(8):
                set_ = (w.symbol >> (7 - bit)) & 1
                at = [s + b for s, b in zip(slots(w, bit, bits), base)]
                x, gate = inputs(counts, at, bit)
                learner.step(x, gate, set_, w.before)
                for s in at:
                    s <<= 1
                    s += set_
                    np.add.at(flat, s, np.float32(1))
        learner.seen += len(words)
    return counts, learner


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for rows in batches:
        for a in range(0, rows.num_rows, 16384):
            yield rows.column(0).slice(a, 16384)


def fit(words: DataFrame, n: int) -> Model:
    """Learn from ``words`` (one column), of which there are about ``n``."""
    bits = table_bits(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, learner = learn_words(_parts(batches), bits)
        if learner.seen:
            yield from table_rows(counts)
            yield from vector_rows(learner.vector())

    found = staged(words.mapInArrow(T.tidy(run), FOUND), "spelling")
    return Model(summed(found, int(bases(bits)[-1])), bits, *learned(found, GATES, len(ORDERS) + 1, 256))
