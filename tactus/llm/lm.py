"""Operator 6: language-model scores by online logistic context mixing over the bits of a text.

A text is lower-cased in A-Z and is its tokens: words ([^\x20\x09-\x0D]+) and one end.  Each
token is coded as binary decisions, and the sum of their costs is the text's total bits.

Code.  A Huffman tree holds the FREQUENT commonest training words, the end, one symbol for each
class of counts (words met 1, 2, 3 ... times; EDGES), REPEAT (a word outside the commonest that
the text has had) and NEW (a word never met).  A class or NEW is followed by the word's group, a
second tree over its first two bytes (the commonest pairs, else OTHER).  A word of a class then
costs the logarithm of the number of the class's words in the group, a REPEAT that of the word's
share of the text's rarer tokens; a new word the spelling of its bytes after the group (see
``spelling``), which is mixed bit by bit too.

Decisions.  Four bit predictors give log-odds for a node of the trees: its counts over the
corpus; under the last of the GUIDES commonest words (which tells language and register); under a
hash of that and the symbol before (for a group: its class); and its counts in the text so far,
which adapt to the text.  They are mixed by the weights of a gate (depth in the tree, how often
the hashed context and the node in the text were seen), and an adaptive map by guide refines the
result.

Learning takes all training documents in one online pass: each part is predicted with what the
task has counted so far, weights and map are moved, and then the part is counted.  Tasks' counts
are added up, their weights averaged.  A word's class is that of its count in the other
documents, so that words of one document are NEW (the Good-Turing estimate).  Spelling learns
from all words of one training occurrence.  Scoring leaves weights as learned, so a score depends
neither on the order of documents nor on how they are dealt; what adapts in a text are its own
counts.

What is gathered grows with the corpus in the words and their counts, which are a partitioned
table.  Decision tables have a fixed size by construction: their contexts are symbols of the trees,
of which there are about FREQUENT + 160 whatever the corpus (2^HASH_BITS slots for the pairs).

Flow: tasks cut their documents into chunks of about CHUNK bytes and write each one's token numbers as one
row, and the distinct words of up to SHARED bytes of chunks; words are counted over all of these lists by one
shuffle; a list's words get their counts back and are met with the token numbers of its chunks, which gives the
table that the two passes read.

Defined results: a null text is empty, and an empty text is one end; no training documents:
every word is NEW and is spelled by an empty model; repeated rows and ids are each scored; texts
of any length are scored whole, PART tokens at a time; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.llm import spelling as S
from tactus.llm import textops as T
from tactus.llm.storage import discard, staged

CHUNK = 8 << 20
#: Bytes of text whose chunks share one list of distinct words.
SHARED = 32 << 20
#: Bytes of text whose words are found at a time, and distinct words in a row batch; neither decides a result.
PIECE = 2 << 20
ROWS = 1 << 15
#: Tokens whose decisions are held at a time.
PART = 16_000
#: The same when texts are scored, which decides no result.
SCORED = 6_000
FREQUENT, GUIDES = 2048, 256
#: Least counts of the classes: 1 to 8, then by half more.
EDGES = np.unique(np.concatenate([np.arange(1, 9), (8 * 1.5 ** np.arange(1, 90)).astype(np.int64)]))
N_CLASSES = len(EDGES)
#: Symbols: the commonest words, the classes, then these.
END, REPEAT, NEW, START = (FREQUENT + N_CLASSES + k for k in range(4))
SYMBOLS = START
GROUPS = 64
OTHER = GROUPS - 1
NODES = SYMBOLS - 1 + GROUPS - 1
assert NODES <= 1 << 12  # as keys of 32 bits hold them
HASH_BITS = 22
BASE = np.cumsum([0, NODES, (GUIDES + 1) * NODES, 1 << HASH_BITS])
STEPS = np.arange(1, NODES + 1, dtype=np.uint64) * T._M1
INPUTS, GATES, STEP = 5, 8 * 4 * 4, 32_768
#: Chunks that a task of the learning passes takes, at least.
CHUNKS_A_TASK = 16
PRIOR = np.float32(0.3)
LOGS = np.log(np.arange(1024, dtype=np.float32) + PRIOR)


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each symbol: first (symbols + 1) into (nodes, bits) of its path from the root, node 0."""
    heap = [(float(w), s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    new = len(weights)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (new, 0), (new, 1)
        heapq.heappush(heap, (a + b, new))
        new += 1
    paths = []
    for s in range(len(weights)):
        path = []
        while s in up:
            s, bit = up[s]
            path.append((new - 1 - s, bit))
        paths.append(path[::-1])
    first = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    nodes, bits = (np.array([x[i] for p in paths for x in p], t) for i, t in ((0, np.int32), (1, np.uint8)))
    return first, nodes, bits


def class_of(count: np.ndarray) -> np.ndarray:
    """Symbol of a word outside the commonest by its count; NEW for 0."""
    k = np.searchsorted(EDGES, count, "right")
    return np.where(k > 0, FREQUENT + k - 1, NEW)


class Code:
    """The trees, by weights of symbols and groups, and log2 of the number of words of each class and group.
    The paths lie one after another, with node, bit, gate by depth and hash step of each decision."""

    def __init__(self, weights: np.ndarray, group_weights: np.ndarray, sizes: np.ndarray):
        (self.first, a, x), (g, b, y) = huffman(weights), huffman(group_weights)
        self.nodes, self.bits = np.concatenate([a, b + SYMBOLS - 1]).astype(np.int64), np.concatenate([x, y]).astype(np.int64)
        self.first, self.group_first = self.first.astype(np.int64), (g + len(a)).astype(np.int64)
        self.size, self.group_size = np.diff(self.first), np.diff(self.group_first)
        depth, inside = (np.arange(f[-1] - f[0]) - np.repeat(f[:-1] - f[0], n) for f, n in ((self.first, self.size), (self.group_first, self.group_size)))
        self.gates = np.concatenate([np.minimum(depth, 5), 6 + (inside > 0)]) * 16
        self.steps, self.short = STEPS[self.nodes] * T._M2, self.nodes.astype(np.uint16)
        self.keys = (self.nodes << 20 | self.bits).astype(np.uint32)
        self.number = np.log2(np.maximum(sizes, 1))


@dataclass
class Texts:
    """The texts of a chunk: tokens as local word numbers (-1 for the end), text i being
    first[i]:first[i + 1], with each local word's rank (FREQUENT + group if not of the commonest),
    count and spelling cost in bits."""

    local: np.ndarray
    first: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    spelled: np.ndarray


def _met(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some codes (0, 1, ... without gaps), how many equal ones come before it; and how often each code is there."""
    many = np.bincount(code)
    order = np.argsort(code.astype(np.uint16) if len(many) <= 1 << 16 else code, kind="stable")
    before = np.empty(len(code), np.int64)
    before[order] = np.arange(len(code)) - np.repeat(np.cumsum(many) - many, many)
    return before, many


def symbols(t: Texts, a: int, b: int, code: Code, left_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol and group (-1 for none) of each token of texts a to b, and what its number or spelling
    costs in bits.  left_out: words are counted without the text they are in."""
    at = t.local[t.first[a] : t.first[b]]
    first = t.first[a : b + 1] - t.first[a]
    out, group = np.full(len(at), END, np.int64), np.full(len(at), -1, np.int64)
    extra = np.zeros(len(at))
    word = np.flatnonzero(at >= 0)
    out[word] = t.rank[at[word]]
    rare = word[out[word] >= FREQUENT]
    if not len(rare):
        return out, group, extra
    w, own = at[rare], out[rare] - FREQUENT
    rare_first = np.searchsorted(rare, first)
    row = np.repeat(np.arange(b - a), np.diff(rare_first))
    code_of = pd.factorize(row * (len(t.rank) + 1) + w)[0]
    before, many = _met(code_of)
    count = t.count[w]
    if left_out:
        count = count - many[code_of]
    symbol = class_of(count)
    new = symbol == NEW
    cost = code.number[np.where(new, 0, symbol - FREQUENT), own]
    cost[new] = t.spelled[w[new]]
    seen = before > 0
    place = np.arange(len(rare)) - rare_first[row]
    symbol[seen] = REPEAT
    own[seen] = -1
    cost[seen] = np.log2(place[seen] / before[seen])
    out[rare], group[rare], extra[rare] = symbol, own, cost
    return out, group, extra


@dataclass
class Part:
    """Decisions of some tokens: the texts that they are of, in order, with the first decision of each;
    node, bit, for each predictor the table slot, guide, gate by depth, and counts of 0 and 1 at the node
    in the text so far."""

    texts: np.ndarray
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    guide: np.ndarray
    gate: np.ndarray
    own: list[np.ndarray]

    @property
    def text(self) -> np.ndarray:
        """The text of each decision."""
        return np.repeat(self.texts, np.diff(np.append(self.first, len(self.node))))


def decisions(symbol: np.ndarray, group: np.ndarray, first: np.ndarray, code: Code, most: int) -> Iterator[Part]:
    """The decisions of texts' tokens (text i is symbol[first[i]:first[i + 1]]), ``most`` tokens or less at a time."""
    n, most = len(symbol), min(most, (1 << 16) - 1)  # a node's decisions are counted in 16 bits
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    prev = np.concatenate([[START], symbol[:-1]])[:n]
    prev[first[:-1][np.diff(first) > 0]] = START
    at = np.maximum.accumulate(np.where(symbol < GUIDES, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    at = np.concatenate([[-1], at[:-1]])[:n]
    guide = np.where(at >= first.take(row), symbol.take(np.maximum(at, 0)), GUIDES) if n else at
    grouped = group >= 0
    # one path a token, and that of its group after it
    token = np.repeat(np.arange(n), 1 + grouped)
    inner = np.flatnonzero(grouped) + np.cumsum(grouped)[grouped]
    coded = symbol.take(token)
    start, size, context = code.first.take(coded), code.size.take(coded), prev.take(token)
    start[inner], size[inner], context[inner] = code.group_first[group[grouped]], code.group_size[group[grouped]], symbol[grouped] + SYMBOLS + 1
    guide, row = guide.take(token), row.take(token)
    context = T.mix((context * (GUIDES + 1) + guide).astype(np.uint64) + T._M2) * T._M2
    under = guide * NODES + BASE[1]
    cuts = np.searchsorted(token, np.arange(0, n + most, most))
    carried = None
    for a, b in zip(cuts, cuts[1:]):
        ends = np.cumsum(size[a:b])
        path = np.repeat(np.arange(b - a), size[a:b])
        where = (start[a:b] - ends + size[a:b]).take(path, mode="clip")
        where += np.arange(len(where))
        node, bit = code.nodes.take(where, mode="clip"), code.bits.take(where, mode="clip")
        slots = [node, under[a:b].take(path, mode="clip")]
        slots[1] += node
        hashed = context[a:b].take(path, mode="clip")
        hashed += code.steps.take(where, mode="clip")
        hashed >>= np.uint64(64 - HASH_BITS)
        slots.append(hashed.view(np.int64))
        slots[2] += BASE[2]
        texts = row[a:b]
        changes = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        first_of = np.concatenate([[0], ends[changes[1:] - 1]])
        key = ((row[a:b] - row[a]) << 1).astype(np.uint32).take(path, mode="clip")
        key += code.keys.take(where, mode="clip")
        own = _met_before(code.short.take(where, mode="clip"), key)
        if carried is not None and carried[0] == row[a]:  # a text that began in the part before
            same = slice(0, first_of[1] if len(first_of) > 1 else None)
            for k in range(2):
                own[k][same] = np.minimum(own[k][same] + carried[1][k][node[same]], len(LOGS) - 1)
        if b < len(row) and row[b] == row[b - 1]:
            last = slice(first_of[-1], None)
            past = carried[1] if carried is not None and carried[0] == row[b] else np.zeros((2, NODES), np.int64)
            carried = row[b], past + np.stack([np.bincount(node[last], bit[last] == k, NODES).astype(np.int64) for k in range(2)])
        yield Part(texts[changes], first_of, node, bit, slots, guide[a:b].take(path, mode="clip"), code.gates.take(where, mode="clip"), own)


def _met_before(node: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """For each decision, how many of its text at its node before it were 0 and 1, as far as LOGS goes.  ``key``
    is node, text (up to 2^19) and bit.  Texts come in order, so that after a stable sort by node those of a
    text stand together."""
    order = np.argsort(node, kind="stable")
    key = key.take(order)
    met = key & 1
    met *= np.uint32((1 << 16) - 1)
    met += np.uint32(1)  # a 0 counts in the low half, a 1 in the high one
    before = np.cumsum(met, dtype=np.uint32)
    before -= met
    key >>= 1
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    before -= np.repeat(before[start], np.diff(np.append(start, len(key))))
    both = np.empty(len(key), np.uint32)
    both[order] = before
    zeros = both.astype(np.uint16)
    both >>= 16
    ones = both.astype(np.uint16)
    return [np.minimum(x, np.uint16(len(LOGS) - 1), out=x) for x in (zeros, ones)]


def _sure(n: np.ndarray) -> np.ndarray:
    """0 for no count, 1 up to 4, 2 up to 40, else 3."""
    return (n > 0.5).view(np.uint8) + (n > 4.5).view(np.uint8) + (n > 40.5).view(np.uint8)


def _gate(depth: np.ndarray, sure: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    n = own[0] + own[1]
    sure = sure * np.uint8(4)
    for edge in (0, 4, 40):
        sure += (n > edge).view(np.uint8)
    return depth + sure


@dataclass
class Model:
    """Counts of decisions (slots, 2), the mixer's weights and the adaptive map (guide, bucket)."""

    counts: np.ndarray
    weights: np.ndarray
    map: np.ndarray

    def __post_init__(self) -> None:
        self._weigh(self.counts[a : a + (1 << 18)] for a in range(0, len(self.counts), 1 << 18))

    def _weigh(self, parts: Iterator[np.ndarray]) -> None:
        """Log-odds of the counts, which come in parts."""
        self.odds, at = np.empty(BASE[-1], np.float32), 0
        for n in parts:
            odds = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)).astype(np.float32)
            rest = max(0, int(BASE[2]) - at)
            hashed = odds[rest:].view(np.uint32)  # their last two bits tell how often a context was seen
            hashed &= ~np.uint32(3)
            hashed |= _sure(n[rest:, 0] + n[rest:, 1])
            self.odds[at : at + len(n)] = odds
            at += len(n)

    def __getstate__(self) -> tuple:
        return S._squeeze(self.counts), self.weights, self.map

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.map = state[1:]
        self._weigh(S._widened(state[0]))

    def bits(self, p: Part) -> np.ndarray:
        """Cost of each decision in bits."""
        mixed = self.odds.take(p.slots[2], mode="clip")
        gate = _gate(p.gate, (mixed.view(np.uint32) & 3).astype(np.uint8), p.own)
        mixed *= self.weights[:, 2].take(gate, mode="clip")
        mixed += (self.weights[:, INPUTS - 1] * np.float32(0.3)).astype(np.float32).take(gate, mode="clip")
        for j in range(2):
            x = self.odds.take(p.slots[j], mode="clip")
            x *= self.weights[:, j].take(gate, mode="clip")
            mixed += x
        x = LOGS.take(p.own[1], mode="clip")
        x -= LOGS.take(p.own[0], mode="clip")
        x *= self.weights[:, 3].take(gate, mode="clip")
        mixed += x
        q = S.refine(self.map, S.squash(mixed), mixed, p.guide)
        cost = p.bit.astype(np.float32)
        cost -= 1
        cost += q
        np.abs(cost, out=cost)
        np.log2(cost, out=cost)
        return np.negative(cost, out=cost)


def text_bits(model: Model, code: Code, t: Texts, a: int, b: int) -> np.ndarray:
    """Total bits of texts a to b."""
    symbol, group, extra = symbols(t, a, b, code, False)
    first = t.first[a : b + 1] - t.first[a]
    total = T.segment_sum(extra, first)
    for p in decisions(symbol, group, first, code, min(PART, SCORED)):
        total[p.texts] += np.add.reduceat(model.bits(p), p.first, dtype=float)
    return total


def groups_of(t: Texts, rows: np.ndarray) -> Iterator[tuple[Texts, int, int]]:
    """The texts ``rows`` (boolean) alone, in runs a to b of about PART tokens."""
    if not rows.all():
        n = np.diff(t.first)
        t = Texts(t.local[np.repeat(rows, n)], np.concatenate([[0], np.cumsum(n[rows])]), t.rank, t.count, t.spelled)
    a = 0
    while a < len(t.first) - 1:
        b = max(a + 1, int(np.searchsorted(t.first, t.first[a] + PART, "right")) - 1)
        yield t, a, b
        a = b


_CHUNKS = "chunk long, word string, local int, n_train long, doc_ids array<long>, held array<boolean>, n_bytes array<long>, n_tokens array<long>, tokens binary"
_CHUNK_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings data[start:end]."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(start - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data[at])).cast(pa.string())


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def _numbers(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _distinct_words(c: T.Chunk, counted: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and strings of a chunk's distinct words in order of appearance, how often they are in the rows
    ``counted`` (boolean), each token's number, and the tokens of each row.  Words are found in PIECE bytes of
    text at a time (one row at least), which bounds memory and decides no result."""
    hashes, words, local, n_tokens = np.zeros(0, np.uint64), [], [], []
    counts = np.zeros(0, np.int64)
    a = 0
    while a < len(c.offs) - 1:
        b = max(a + 1, int(np.searchsorted(c.offs, c.offs[a] + PIECE, "right")) - 1)
        w = T.words(c.data[c.offs[a] : c.offs[b] + 16], c.offs[a : b + 1] - c.offs[a], T.NONSPACE)
        h, first, code = T.distinct(w.hash)
        known = len(hashes)
        hashes, place, number = T.distinct(np.concatenate([hashes, h]))
        new = first[place[known:] - known]
        words.append(_gather(w.data, w.start[new], w.end[new]))
        number = number[known:].astype(np.int32)
        counts = np.concatenate([counts, np.zeros(len(hashes) - known, np.int64)])
        counts[number] += np.bincount(code, counted[a:b][w.row_of()], len(h)).astype(np.int64)
        local.append(number.take(code))
        n_tokens.append(w.counts())
        a = b
    return hashes, pa.concat_arrays(words), counts, np.concatenate(local), np.concatenate(n_tokens)


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out) as chunks: a row for each distinct word of some chunks, and one with the token
    numbers of each.  What is numbered together has one number ``chunk``."""

    def merged(chunk: int, values: np.ndarray, words: list[pa.Array], n: np.ndarray, texts: list[list]) -> Iterator[pa.RecordBatch]:
        at = 0
        for some in words:
            for a in range(0, len(some), ROWS):
                own, rows = some.slice(a, ROWS), min(ROWS, len(some) - a)
                here = [pa.array(np.full(rows, chunk)), own, pa.array(np.arange(at, at + rows, dtype=np.int32)), pa.array(n[at : at + rows])]
                yield pa.RecordBatch.from_arrays([*here, *(pa.nulls(rows, t) for t in _CHUNK_TYPES[4:])], names=_names(_CHUNKS))
                at += rows
        for one in texts:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([chunk, None, None, None, *one], _CHUNK_TYPES)], names=_names(_CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blank = lambda: (np.zeros(0, np.uint64), [], np.zeros(0, np.int64), [])
        chunk, size = TaskContext.get().partitionId() << 32, 0
        values, words, n, texts = blank()
        for c in T.chunks(batches, "text", CHUNK):
            if texts and size + len(c.data) > SHARED:
                yield from merged(chunk, values, words, n, texts)
                chunk, size = chunk + 1, 0
                values, words, n, texts = blank()
            size += len(c.data)
            held = c.rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            h, own, counts, local, n_tokens = _distinct_words(c, ~held)
            values, first, code = T.distinct(np.concatenate([values, h]))
            known, code = len(n), code[len(n) :]
            words.append(own.take(pa.array(first[known:] - known)))
            n = np.concatenate([n, np.zeros(len(values) - known, np.int64)])
            n[code] += counts
            texts.append([c.rows.column(0).to_pylist(), held.tolist(), np.diff(c.offs).tolist(), n_tokens.tolist(), _planes(code.astype(np.int32).take(local))])
        if texts:
            yield from merged(chunk, values, words, n, texts)

    return docs.mapInArrow(T.tidy(run), _CHUNKS)


_VALUE = np.dtype([("local", "<i4"), ("rank", "<i4"), ("c", "<i8"), ("spelled", "<f4")])


def _bundle(shared):
    """The rows (chunk, local and rank, c, word) of a task as one row a chunk of packed values, half a
    million rows at a time; words of no training occurrence (only those are given) are spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            chunk, packed = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(chunk, kind="stable")
            chunk, packed = chunk[order], packed[order]
            cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]]))
            return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["of_chunk", "packed"])

        for b in batches:
            if not b.num_rows:
                continue
            packed = np.zeros(b.num_rows, _VALUE)
            both = b.column(1).to_numpy()
            packed["local"], packed["rank"], packed["c"] = both & 0xFFFFFFFF, both >> 32, b.column(2).to_numpy()
            new = np.flatnonzero(packed["c"] == 0)
            for a in range(0, len(new), 8192):
                at = new[a : a + 8192]
                skip = np.where(packed["rank"][at] == FREQUENT + OTHER, 0, 2)
                packed["spelled"][at] = shared.value.log10(b.column(3).take(pa.array(at)), skip) / -np.log10(2)
            held.append((b.column(0).to_numpy(), packed))
            size += b.num_rows
            if size >= 500_000:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return run


_TEXTS = "doc_ids array<long>, held array<boolean>, n_bytes array<long>, n_tokens array<long>, n_known array<long>, base array<double>, tokens binary, values binary, n_words long"
_TEXT_TYPES = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.int64()]


def _assemble(tokens: int, distinct: int, ends: int):
    """Chunks' token numbers met with their words' values, of which each chunk gets its own; base scores are made here."""
    base = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(right["packed"].to_pylist()), _VALUE)
        got = got[np.argsort(got["local"])]
        based, known = base(got["c"]), (got["c"] > 0).astype(np.int64)
        out: list[list] = [[] for _ in _TEXT_TYPES]
        for r in left.to_pylist():
            n = np.array(r["n_tokens"], np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            at = _numbers(r["tokens"], int(first[-1]))
            there = np.zeros(len(got), bool)
            there[at] = True
            own, renumbered = got[there], _planes((np.cumsum(there) - 1).take(at))
            values = pa.compress(b"".join(np.ascontiguousarray(own[x]).tobytes() for x in ("rank", "c", "spelled")), "zstd", asbytes=True)
            row = [r["doc_ids"], r["held"], r["n_bytes"], n, T.segment_sum(known.take(at), first) + (ends > 0), T.segment_sum(based.take(at), first) + base(ends), renumbered, values, len(own)]
            for o, x in zip(out, row):
                o.append(x)
        return pa.table([pa.array(o, t) for o, t in zip(out, _TEXT_TYPES)], names=_names(_TEXTS))

    return run


def texts_of(r: dict) -> Texts:
    """A row of _TEXTS as texts, with the end after each one's words."""
    k = r["n_words"]
    values = pa.decompress(r["values"], 16 * k, "zstd", asbytes=True) if k else b""
    rank, count, spelled = np.frombuffer(values, "<i4", k), np.frombuffer(values, "<i8", k, 4 * k), np.frombuffer(values, "<f4", k, 12 * k)
    n = np.array(r["n_tokens"], np.int64)
    local = np.insert(_numbers(r["tokens"], int(n.sum())), np.cumsum(n), -1)
    return Texts(local, np.concatenate([[0], np.cumsum(n + 1)]), rank.astype(np.int64), count, spelled.astype(float))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def learn_texts(rows: Iterator[dict], code: Code) -> tuple[np.ndarray, S.Learner]:
    """One online pass over training texts: counts of all decisions, weights and map."""
    counts = np.zeros((BASE[-1], 2), np.float32)
    flat, pairs = counts.ravel(), counts.view(np.uint64).ravel()
    learner = S.Learner(GATES, INPUTS, GUIDES + 1)
    for r in rows:
        whole = texts_of(r)
        for t, a, b in groups_of(whole, ~np.array(r["held"], bool)):
            symbol, group, _ = symbols(t, a, b, code, True)
            for p in decisions(symbol, group, t.first[a : b + 1] - t.first[a], code, PART):
                static = np.log((counts[:NODES, 1] + PRIOR) / (counts[:NODES, 0] + PRIOR))
                for k in range(0, len(p.bit), STEP):
                    some = slice(k, k + STEP)
                    own = [x[some] for x in p.own]
                    x = np.empty((INPUTS, len(own[0])), np.float32)
                    static.take(p.node[some], out=x[0], mode="clip")
                    for j in (1, 2):
                        n = pairs.take(p.slots[j][some], mode="clip").view(np.float32)
                        n += PRIOR
                        np.divide(n[1::2], n[::2], out=x[j])
                    np.log(x[1:3], out=x[1:3])
                    np.subtract(LOGS.take(own[1]), LOGS.take(own[0]), out=x[3])
                    x[4] = S.BIAS
                    sure = _sure(n[::2] + n[1::2] - 2 * PRIOR)
                    learner.step(x, _gate(p.gate[some], sure, own), p.bit[some], p.guide[some])
                learner.seen += len(p.bit)
                counts[:NODES] += np.bincount(2 * p.node + p.bit, minlength=2 * NODES).reshape(-1, 2)
                for s in p.slots[1:]:
                    s <<= 1
                    s += p.bit
                    np.add.at(flat, s, np.float32(1))
    return counts, learner


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents where ``held_out`` is false and score all: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score (log10 probability), bits_per_byte."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    spark = docs.sparkSession
    chunks = staged(chunked(own), "lm-chunks")
    docs_of = chunks.where("word is null").select("chunk", "doc_ids", "held", "n_bytes", "n_tokens", "tokens")
    of_word = Window.partitionBy("word")
    counted = chunks.where("word is not null").select("word", "chunk", "local", F.sum("n_train").over(of_word).alias("c"), (F.min("chunk").over(of_word) == F.col("chunk")).alias("first"))
    # not more files than those of the chunks: each costs its executor processes forked for its mode (see storage)
    counted = staged(counted.coalesce(max(spark.sparkContext.defaultParallelism, len(chunks.inputFiles()))), "lm-words")
    known = counted.where("first and c > 0")
    top = known.select("word", "c").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    ranks = F.broadcast(spark.createDataFrame([(r.word, k) for k, r in enumerate(top)], "top string, rank int"))
    edge_of = lambda c: sum(((c >= int(e)).cast("int") for e in EDGES[1:]), (c >= 1).cast("int"))
    pair = F.substring(F.col("word").cast("binary"), 1, 2).alias("pair")
    often = F.when(F.col("c") >= (top[-1].c if top else 0), F.col("word")) == F.col("top")  # so that rarer words are not looked up
    rare = known.join(ranks, often, "left_anti").select("c", pair)
    pairs = rare.groupBy("pair").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "pair").limit(GROUPS - 1).collect()
    group_ids = F.broadcast(spark.createDataFrame([(r.pair, k) for k, r in enumerate(pairs)], "pair binary, g int"))
    group = F.coalesce("g", F.lit(OTHER))
    by_count = rare.join(group_ids, "pair", "left").groupBy(group.alias("g"), "c").agg(F.count(F.lit(1)).alias("words"))
    by_class = by_count.groupBy("g", edge_of(F.col("c")).alias("k"), edge_of(F.col("c") - 1).alias("k_out"))
    stats = by_class.agg(F.sum("words").alias("words"), F.sum(F.col("c") * F.col("words")).alias("tokens")).collect()
    ends = docs_of.select(F.explode("held").alias("held")).where("not held").count()
    once = sum(r.words for r in stats if r.k_out == 0)
    tokens = sum(r.c for r in top) + sum(r.tokens for r in stats) + ends
    distinct = len(top) + sum(r.words for r in stats) + (ends > 0)
    weights, group_weights, sizes = np.ones(SYMBOLS), np.ones(GROUPS), np.zeros((N_CLASSES, GROUPS))
    weights[: len(top)] += [r.c for r in top]
    weights[END] += ends
    for r in stats:
        weights[FREQUENT + r.k_out - 1 if r.k_out else NEW] += 0.9 * r.tokens
        weights[REPEAT] += 0.1 * r.tokens
        group_weights[r.g] += r.tokens
        sizes[r.k - 1, r.g] += r.words
    code = Code(weights, group_weights, sizes)

    speller = spark.sparkContext.broadcast(S.fit(known.where("c = 1").select("word"), once))
    ranked = counted.join(ranks, often, "left").drop("top").withColumn("pair", pair).join(group_ids, "pair", "left")
    both = F.shiftleft(F.coalesce("rank", F.lit(FREQUENT) + group).cast("long"), 32) + F.col("local")
    ranked = ranked.select("chunk", both.alias("both"), "c", F.when(F.col("c") == 0, F.col("word")).alias("word"))
    values = ranked.mapInArrow(T.tidy(_bundle(speller)), "of_chunk long, packed binary")
    texts = staged(docs_of.groupBy("chunk").cogroup(values.groupBy("of_chunk")).applyInArrow(_assemble(tokens, distinct, ends), _TEXTS), "lm-texts")
    speller.destroy()
    discard(chunks)
    discard(counted)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, learner = learn_texts(rows_of(batches), code)
        if learner.seen:
            yield from S.table_rows(counts)
            yield from S.vector_rows(learner.vector())

    tasks = max(spark.sparkContext.defaultParallelism, texts.count() // CHUNKS_A_TASK)
    found = staged(texts.coalesce(tasks).mapInArrow(T.tidy(learn), S.FOUND), "lm-learned")
    counts = S.summed(found, int(BASE[-1]))
    weights, map_ = S.learned(found, GATES, INPUTS, GUIDES + 1)
    shared = spark.sparkContext.broadcast(Model(counts, weights, map_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            t = texts_of(r)
            n = len(r["held"])
            total = np.zeros(n)
            for t, a, b in groups_of(t, np.ones(n, bool)):
                total[a:b] = text_bits(shared.value, code, t, a, b)
            size = np.maximum(np.array(r["n_bytes"], float), 1)
            cols = [r["doc_ids"], r["held"], np.array(r["n_tokens"]) + 1, r["n_known"], np.full(n, tokens), r["base"], total * -np.log10(2), total / size]
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=_names(RESULT))

    return texts.mapInArrow(T.tidy(run), RESULT)
