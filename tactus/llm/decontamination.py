"""Operator 3: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive item words (an item of fewer words, but
not none, is one pattern).  For patterns of one length m a shift table over blocks of two
words tells how far the search may jump: the least distance of the block from a pattern's
end, or m - 1 for a block in no pattern; it has eight slots or more for each window.  Where the
shift is 0 the block's suffix-hash bucket, ordered by the hash of the first block as Wu and
Manber's prefix table is, gives the patterns to compare; word hashes and then the words
themselves confirm.  All segments of a chunk's texts advance together, so numpy does each jump
for thousands.

Items are taken in blocks of at most ``block_bytes`` of text, about eight times as much in
tables, which are broadcast and destroyed one block at a time.  Most benchmarks are one block;
with more, documents are numbered and staged once, each block is searched against all of them,
and the hits of a row are merged by its number.

Defined results: null and empty texts have no words and are clean; items without words have
no windows; repeated items each count; texts of any length are searched whole; a null item
id reads as ''; other columns are kept or ignored as stated, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import textops as T
from tactus.llm.storage import staged, without

SEGMENT = 512
#: Slots of the shift table, as powers of two.
LEAST_BITS, MOST_BITS = 10, 24


class _OneLength:
    """Search tables for the distinct windows of m words; start: the number of each one's first word."""

    def __init__(self, m: int, items: T.Words, start: np.ndarray):
        self.m, self.block = m, min(2, m)
        self.bits = int(np.clip(np.ceil(np.log2(8.0 * len(start) + m)), LEAST_BITS, MOST_BITS))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int16)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self._slot(self._block(items.hash, start + end)), m - 1 - end)
        key = self._bucket(items.hash, start + m - 1)
        order = np.argsort(key, kind="stable")
        self.key, self.start = key[order], start[order]

    def _block(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each place."""
        return h[at] if self.block == 1 else T.mix(h[at - 1] * T._M2 ^ h[at])

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bucket(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Last block, then first block of the window that ends at each place."""
        return T.mix(self._block(h, end) * T._M1 ^ self._block(h, end - self.m + self.block))

    def search(self, items: T.Words, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """End positions (word numbers) and windows (numbers in ``start``) of all occurrences."""
        room = np.maximum(w.counts() - self.m + 1, 0)
        parts = -(-room // SEGMENT)
        row = np.repeat(np.arange(len(room)), parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        pos = w.first[:-1][row] + k * SEGMENT + self.m - 1
        end = np.minimum(pos + SEGMENT, w.first[1:][row])
        found = []
        while len(pos):
            shift = self.shift[self._slot(self._block(w.hash, pos))]
            found.append(pos[shift == 0])
            pos = pos + np.maximum(shift, 1)
            going = pos < end
            pos, end = pos[going], end[going]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        key = self._bucket(w.hash, at)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        ends, pats = [], []
        depth = 0
        live = np.flatnonzero(lo < hi)
        while len(live):
            e, p = at[live], lo[live] + depth
            same = np.ones(len(e), bool)
            for j in range(self.m):
                same &= w.hash[e - self.m + 1 + j] == items.hash[self.start[p] + j]
            ends.append(e[same])
            pats.append(p[same])
            depth += 1
            live = live[lo[live] + depth < hi[live]]
        e, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, pats))
        exact = np.fromiter((all(w.bytes_at(x - self.m + 1 + j) == items.bytes_at(y + j) for j in range(self.m)) for x, y in zip(e.tolist(), self.start[p].tolist())), bool, len(e))
        return e[exact], p[exact]


class Patterns:
    """Search tables for items [(id, text)], by pattern length."""

    def __init__(self, items: list[tuple[str, str]], window: int = 10):
        raw = [(text or "").encode() for _, text in items]
        self.ids = [key for key, _ in items]
        self.words = T.words(np.frombuffer(b"".join(raw) + bytes(16), np.uint8), np.cumsum([0, *map(len, raw)]), T.ALNUM)
        n = self.words.counts()
        self.lengths: list[tuple[_OneLength, np.ndarray, np.ndarray]] = []
        size = np.minimum(n, window)
        for m in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == m)
            many = n[rows] - m + 1
            item = np.repeat(rows, many)
            start = self.words.first[item] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            both = np.zeros((2, len(start)), np.uint64)
            for j in range(m):
                both = np.stack([T.mix(h * f ^ self.words.hash[start + j]) for h, f in zip(both, (T._M1, T._M2))])
            order = np.lexsort((item, *both))
            both, item, start = both[:, order], item[order], start[order]
            first = np.flatnonzero(np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)]))
            one = _OneLength(m, self.words, start[first])
            owners = dict(zip(start[first].tolist(), np.split(item, first[1:])))
            cuts = [owners[x] for x in one.start.tolist()]
            self.lengths.append((one, np.concatenate(cuts), np.cumsum([0, *map(len, cuts)])))

    def hits(self, w: T.Words) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Word starts and ends of all occurrences, and the items of each row that has any."""
        row_of = w.row_of()
        starts, ends, items = [], [], {}
        for one, item, first in self.lengths:
            e, p = one.search(self.words, w)
            starts.append(e - one.m + 1)
            ends.append(e + 1)
            for r, x in {*zip(row_of[e].tolist(), p.tolist())}:
                items.setdefault(r, set()).update(self.ids[i] for i in item[first[x] : first[x + 1]].tolist())
        return (np.concatenate(starts), np.concatenate(ends), items) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64), items)


def _merged(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True where a word lies in any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _spans(hit: np.ndarray) -> list[int]:
    """start, end, start, end ... of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Patterns]:
    """Search tables of the items, a bounded block at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        part = items.distinct().where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Patterns([(r.id, r.text) for r in part.collect()], window)


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256,
    contaminated, spans (word starts and ends of the hit passages) and items (their ids, sorted)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = pattern_blocks(benchmark, window, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return own.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(first)), f"doc_id long, {RESULT}")
    rows = _numbered(own)
    whole = None
    for k, p in enumerate(chain((first, second), blocks)):
        part = _passed(rows, p, f"row long, {RESULT}", lambda b, k=k: _searcher(b, "row", k > 0), "decontamination-hits")
        whole = part if whole is None else whole.unionByName(part)
    lists = whole.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return rows.select("row", "doc_id").join(lists, "row").drop("row").mapInArrow(_combine, f"doc_id long, {RESULT}")


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows numbered once and kept, so that every block's results say which row they are of."""
    return staged(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")


def _passed(rows: DataFrame, patterns: Patterns, schema: str, searcher, name: str) -> DataFrame:
    """What one block finds in all rows (row, text), staged, so that its tables can go before the next ones come."""
    shared = rows.sparkSession.sparkContext.broadcast(patterns)
    found = staged(rows.select("row", "text").mapInArrow(searcher(shared), schema), name)
    shared.destroy()
    return found


def _row(n: int, hit: np.ndarray, items: list[str]) -> tuple:
    n_hit = int(hit.sum())
    return n, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, _spans(hit), items


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string())]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _batch(ids: pa.Array, rows: list[tuple], key: str = "doc_id") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), _TYPES))], names=[key, *_NAMES])


def _searcher(patterns, key: str = "doc_id", only_hits: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches):
            w = T.words(c.data, c.offs, T.ALNUM)
            s, e, items = patterns.value.hits(w)
            hit = _merged(s, e, len(w.start))
            rows = [_row(int(b - a), hit[a:b], sorted(items.get(r, ()))) for r, (a, b) in enumerate(zip(w.first[:-1], w.first[1:]))]
            out = _batch(c.rows.column(0), rows, key)
            yield out.filter(out.column(5)) if only_hits else out

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if rows.num_rows:
            out = []
            for x in rows.to_pylist():
                at = np.array(x["spans"], np.int64)
                out.append(_row(x["n_words"], _merged(at[0::2], at[1::2], x["n_words"]), sorted(set(x["items"]))))
            yield _batch(rows.column(0), out)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    blocks = pattern_blocks(benchmark, window, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast(first)), docs.schema)
    if "row" in docs.columns:  # a column of that name goes round by another
        return keep_clean(docs.withColumnRenamed("row", "__row"), benchmark, window, block_bytes).withColumnRenamed("__row", "row")
    rows = _numbered(docs)
    gone = None
    for p in chain((first, second), blocks):
        part = _passed(rows, p, "row long, text string", lambda b: _sieve(b, False), "decontamination-hits").select("row")
        gone = part if gone is None else gone.unionByName(part)
    return without(rows, staged(gone.distinct(), "decontamination-gone"), "row").drop("row")


def _sieve(patterns, clean: bool = True):
    """The rows without a hit, or those with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, size=1 << 20):
            w = T.words(c.data, c.offs, T.ALNUM)
            s, _, _ = patterns.value.hits(w)
            kept = np.full(c.rows.num_rows, clean)
            kept[w.row_of()[s]] = not clean
            yield c.rows.filter(pa.array(kept))

    return run
