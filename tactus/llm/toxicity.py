"""Operator 10: toxic passages as maximum-scoring segments over token log-odds.

Tokens are words and their beginnings of PREFIXES bytes (insults are inflected and
compounded); a word scores as the best of these.

Learning: over labelled documents (copies of one another count as one between them), each token's
document frequency among toxic and clean ones gives a log-odds with Dirichlet priors (``prior``
pseudo-documents, dealt by the word's overall share, and half a document each).  Every token that
was met has its signed log-odds: a toxic one in full, if the signed root of its G statistic exceeds
``significance`` and a share of ``precision`` or more of its documents is toxic, any other word's at
most 0 and no less than -``most``; and every word costs ``drift`` besides.  A word without evidence
costs ``drift`` alone.  Odds are reckoned and chosen in Spark; the driver gets toxic tokens, and the
clean ones whose log-odds is under -``least``.

Scoring: Ruzzo and Tompa's linear-time scan lists all maximal scoring segments of a text.
Karlin and Altschul's extreme-value law for the clean word distribution (lambda solves
sum p e^(lambda s) = 1, and K bounds the rate of single words of score x or more against
e^(-lambda x)) turns a segment's score S in a text of n words to lambda S - ln(K n); segments above 0 are significant.  Their sum statistic over r segments has the tail
probability p of r such segments by chance.  The largest Bayes factor that p supports,
B = -1 / (e p ln p), gives score = B / (1 + B); above p = 1/e, B falls linearly to 0.

Defined results: null and empty texts score 0; without toxic labels all score 0; of labels
that repeat an id the largest counts; null labels don't train; texts of any length are
scanned whole; repeated rows are each scored; other columns are kept or ignored as stated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tactus.llm import textops as T
from tactus.llm.storage import staged_small

#: Labelled rows that a model is fitted on at most; with more, those of least id hash.
MAX_LABELLED = 200_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int = MAX_LABELLED, with_id: bool = False) -> DataFrame:
    """(text, label) of labelled documents.  The labels of at most ``bound`` rows are broadcast; texts stay where they are."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = own.count()
    if n > bound:
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select(*["doc_id"] * with_id, "text", F.col("label").cast("int").alias("label"))


#: Lengths of the word beginnings that are tokens, in bytes.
PREFIXES = (4, 5, 6, 7, 8)
FILTER_BITS = 22
#: Bytes of text handled at a time: a word has up to six tokens, some 60 bytes of arrays for each byte of text.
CHUNK = 1 << 20


def beginnings(w: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and hashes of the words, then for each length of the beginnings of longer words."""
    yield np.arange(len(w.hash)), w.hash
    for k in PREFIXES:
        at = np.flatnonzero(w.end - w.start > k)
        yield at, T.hash_runs(w.data, w.start[at], w.start[at] + k)


@dataclass
class Model:
    """Sorted token hashes with scores (above 0 of toxic tokens, below of clean words); the drift of other
    words; lambda and K of the extreme-value law."""

    hashes: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float
    k: float


#: A document counts as 1/UNIT parts, so that sums are exact in any order.
UNIT = 1 << 20


def _weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Row]:
    """(doc_id, weight) of the labelled documents: those of one label that share their least five-word
    shingle, as copies do, weigh UNIT together.  At most MAX_LABELLED.  And the weighed totals: toxic
    documents a, clean ones b, and words of clean ones."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, size=CHUNK):
            w = T.words(c.data, c.offs, T.ALNUM)
            h, first = T.kmers(w, 5)
            key = np.zeros(c.rows.num_rows, np.uint64)
            some = np.diff(first) > 0
            if some.any():
                key[some] = np.minimum.reduceat(h, first[:-1][some])
            yield pa.RecordBatch.from_arrays([*T.take_columns(c.rows, ["doc_id", "label"]), pa.array(key.view(np.int64)), pa.array(w.counts())], names=["doc_id", "label", "key", "words"])

    keys = staged_small(labelled(docs, labels, "toxic", with_id=True).mapInArrow(least, "doc_id long, label int, key long, words long"), "toxicity-keys")
    sizes = keys.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"))
    weights = keys.join(sizes, ["label", "key"]).groupBy("doc_id").agg(F.min(F.ceil(F.lit(UNIT) / F.col("n"))).alias("weight"))
    of = lambda x, which: F.sum(F.when(which, x))
    toxic, weight = F.col("label") > 0, F.col("weight")
    return weights, keys.join(F.broadcast(weights), "doc_id").agg(of(weight, toxic).alias("a"), of(weight, ~toxic).alias("b"), of(weight * F.col("words"), ~toxic).alias("words")).first()


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's tokens (text, label, weight): hash, weight of its toxic and of its clean documents, and
    whether it is a word there."""
    for c in T.chunks(batches, size=CHUNK):
        toxic, weight = (x.to_numpy(zero_copy_only=False) for x in T.take_columns(c.rows, ["label", "weight"]))
        toxic = toxic > 0
        w = T.words(c.data, c.offs, T.ALNUM)
        row_of = w.row_of()
        at_word, hashes = (np.concatenate(x) for x in zip(*beginnings(w)))
        whole = np.arange(len(at_word)) < len(w.hash)
        order = np.argsort(at_word, kind="stable")
        hashes, rows, whole = hashes[order], row_of[at_word[order]], whole[order]
        once = T.occurrence(hashes, np.searchsorted(rows, np.arange(len(w.first)))) == 0
        h, at = np.unique(hashes[once], return_inverse=True)
        rows = rows[once]
        a, b = (np.rint(np.bincount(at, weight[rows] * x[rows], len(h))).astype(np.int64) for x in (toxic, ~toxic))
        words = np.bincount(at, whole[once], len(h)) > 0  # tokens that are words, not only beginnings
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(a), pa.array(b), pa.array(words.astype(np.int64))], names=["h", "a", "b", "words"])


def fit(docs: DataFrame, labels: DataFrame, prior: float = 10.0, significance: float = 6.0, precision: float = 0.9, drift: float = 0.05, most: float = 1.0, least: float = 0.1) -> Model:
    """Learn from all labelled documents given (up to MAX_LABELLED)."""

    weights, totals = _weights(docs, labels)
    if not totals.a or not totals.b:
        return Model(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0)
    weighed = labelled(docs, labels, "toxic", with_id=True).join(F.broadcast(weights), "doc_id")
    counts = weighed.select("text", "label", "weight").mapInArrow(token_counts, "h long, a long, b long, words long")
    counts = counts.groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("words").alias("words"))
    docs_a, docs_b, clean_words = (float(totals[c]) / UNIT for c in ("a", "b", "words"))
    share = docs_a / (docs_a + docs_b)
    a, b = F.col("a") / UNIT, F.col("b") / UNIT
    part = lambda x, of: F.when(x > 0, x * F.log(x / ((a + b) * of))).otherwise(0.0)
    root = F.signum(a - (a + b) * share) * F.sqrt(F.greatest(2 * (part(a, share) + part(b, 1 - share)), F.lit(0.0)))
    at = 0.5 + prior * (a + b) / (docs_a + docs_b)
    odds = lambda x, n: F.log((x + at) / F.greatest(n + prior + 1 - x - at, F.lit(0.5)))
    scored = counts.select("h", b.alias("b"), (odds(a, docs_a) - odds(b, docs_b)).alias("score"), ((root > significance) & (a >= precision * (a + b))).alias("toxic"), (F.col("words") > 0).alias("word"))
    chosen = scored.where(F.col("toxic") & (F.col("score") > drift) | F.col("word") & ~F.col("toxic") & (F.col("score") < -least))
    found = chosen.select("h", "b", F.when(F.col("toxic"), F.col("score")).otherwise(F.greatest(F.col("score"), F.lit(-most))).alias("score")).toPandas().sort_values("h")
    # hashes are compared as unsigned numbers
    h, s, p = found.h.to_numpy(np.int64).view(np.uint64), found.score.to_numpy(float), (found.b.to_numpy(float) + 0.5) / max(clean_words, 1)
    order = np.argsort(h)
    h, s, p = h[order], s[order], p[order]
    up = s > 0
    s = np.where(up, s, s - drift)
    lam = _lambda(p, s, drift)
    down = np.argsort(-s[up])
    k = float((np.cumsum(p[up][down]) * np.exp(np.minimum(lam * s[up][down], 600))).max()) if up.any() else 1.0
    return Model(h, s, drift, lam, k)


def _lambda(p: np.ndarray, s: np.ndarray, drift: float) -> float:
    """The positive solution of sum p e^(lambda s) = 1, the other words scoring -drift."""
    rest = 1 - p.sum()
    f = lambda x: float((p * np.exp(np.minimum(x * s, 600))).sum() + rest * math.exp(-x * drift) - 1)
    if not (s > 0).any() or f(1e-6) >= 0:
        return 1e-3
    lo, hi = 1e-6, 1.0
    while f(hi) < 0:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def segments(place: list[int], total: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence by its running sums (one more
    than its elements) and the places of its elements above 0.  Linear in these: elements between
    them are one step."""
    found: list[list] = []  # start, end, sum before it, sum to its end, last one before it of a lower sum before
    for p, before, after in zip(place, total[place].tolist(), total[np.asarray(place, int) + 1].tolist()):
        own = [p, p + 1, before, after]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= own[3]:
                found.append([*own, j])
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in found]


def tail(normal: list[float]) -> float:
    """Probability of r chance segments with this sum of normalised scores."""
    r, t = len(normal), sum(normal)
    if not r:
        return 1.0
    return min(1.0, math.exp(-t + (r - 1) * math.log(max(t, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r)) if r > 1 else 1 - math.exp(-math.exp(-t)))


def evidence(p: float) -> float:
    """B / (1 + B) for the Bayes factor bound B of a tail probability."""
    if p >= 1 / math.e:
        b = (1 - p) / (1 - 1 / math.e)
    else:
        b = -1 / (math.e * max(p, 1e-300) * math.log(max(p, 1e-300)))
    return b / (1 + b)


def word_scores(model: Model, w: T.Words) -> np.ndarray:
    """The best of the toxic tokens that a word is or begins with; without any, its own clean one's
    score, or the drift."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    possible = np.zeros(1 << FILTER_BITS, bool)
    possible[(model.hashes & mask).astype(np.int64)] = True
    best = np.full(len(w.hash), -model.drift)
    for k, (place, h) in enumerate(beginnings(w)):
        some = np.flatnonzero(possible[(h & mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.hashes, h[some]), len(model.hashes) - 1)
        same = model.hashes[at] == h[some]
        place, value = place[some[same]], model.scores[at[same]]
        if k == 0:
            best[place] = value
        else:
            toxic = value > 0
            np.maximum.at(best, place[toxic], value[toxic])
    return best


def score_chunk(model: Model, c: T.Chunk) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Score and significant passages (word start, word end, normalised score) of each row."""
    w = T.words(c.data, c.offs, T.ALNUM)
    rows = c.rows.num_rows
    score, passages = np.zeros(rows), [[] for _ in range(rows)]
    if not len(model.hashes) or not len(w.hash):
        return score, passages
    best = word_scores(model, w)
    hit = np.flatnonzero(best > 0)
    row = np.searchsorted(w.first, hit, "right") - 1
    for r in np.unique(row):
        a, b = int(w.first[r]), int(w.first[r + 1])
        mine = slice(*np.searchsorted(row, [r, r + 1]))
        all_of = segments((hit[mine] - a).tolist(), np.concatenate([[0.0], np.cumsum(best[a:b])]))
        passages[r] = [(s, e, x) for s, e, v in all_of if (x := model.lam * v - math.log(model.k * (b - a))) > 0]
        score[r] = evidence(tail([x for _, _, x in passages[r]]))
    return score, passages


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, passages (array of word start, word end, normalised score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, size=CHUNK):
            s, found = score_chunk(shared.value, c)
            spans = pa.array([[{"start": a, "end": b, "score": x} for a, b, x in p] for p in found], kind)
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array(s), spans], names=["doc_id", "score", "passages"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, size=CHUNK):
            yield c.rows.filter(pa.array(score_chunk(shared.value, c)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
