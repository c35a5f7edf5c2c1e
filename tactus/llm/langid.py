"""Operator 4: language identification by rank-order n-gram profiles.

N-grams are runs of 1 to 4 bytes of UTF-8, lower-cased in A-Z, inside words (digits and
punctuation are boundaries; every word is framed by one space, and an n-gram holds at most one
of the two).  A language's profile is its
``size`` most frequent n-grams over all training documents, in order.  A document's own most
frequent n-grams are compared with each profile: the out-of-place distance sums how far each
n-gram's rank is from its rank in the profile, or ``size`` if the profile lacks it.  The
language at the least distance wins; ties go to the smaller name.

The score is how far the winner's distance lies below the mean of all, from 0 to 1: it is
1 - winner / mean, scaled by 2 and cut at 1; with one language 1 - distance / worst.

Defined results: a null text and a text without a letter are 'und' with score 0; no learned
language: 'und'; null languages don't train; long texts count whole; repeated rows count each;
ties of n-gram counts go by n-gram value.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.llm import textops as T

SIZE = 400
LETTERS = T.ALNUM.copy()
LETTERS[48:58] = False


def grams(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of a chunk (length n in the top byte) and their rows."""
    text = T.LOWER[c.data]
    n = len(text) - 16
    letter = LETTERS[text[:n]]
    row = np.repeat(np.arange(len(c.offs) - 1), np.diff(c.offs))
    # each word framed by spaces: a non-letter byte reads as a space, of several only those beside letters
    framed = np.where(letter, text[:n], 32).astype(np.uint64)
    keys, rows = [], []
    value = framed
    inside = letter
    for size in range(1, 5):
        if size > 1:
            if n < size:
                break
            value = (value[:-1] << np.uint64(8)) | framed[size - 1 :]
            # no space but at either end; all bytes in one row
            starts = n - size + 1
            inside = (letter[:starts] | letter[size - 1 :]) & (row[:starts] == row[size - 1 :])
            for k in range(1, size - 1):
                inside &= letter[k : starts + k]
        keys.append(value[inside] | np.uint64(size << 40))
        rows.append(row[: len(inside)][inside])
    return np.concatenate(keys), np.concatenate(rows)


def profiles(docs: DataFrame, size: int = SIZE, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over all of ``docs``; at most languages x size reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, size=2 << 20):
            key, row = grams(c)
            langs = c.rows.column(0).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            both, n = np.unique(key | (code[row].astype(np.uint64) << np.uint64(44)), return_counts=True)
            names = langs.dictionary.take(pa.array((both >> np.uint64(44)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array((both & np.uint64((1 << 44) - 1)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    own = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = own.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.uint64) for k, v in out.items()}


class Ranker:
    """Out-of-place distances to every profile at once."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = SIZE):
        self.langs, self.size = sorted(by_lang), size
        self.known = np.unique(np.concatenate([*by_lang.values(), np.zeros(0, np.uint64)]))
        self.rank = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def distances(self, key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the distance to each language and the number of own n-grams compared."""
        both, n = np.unique(key | (row.astype(np.uint64) << np.uint64(44)), return_counts=True)
        r, gram = (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1)
        order = np.lexsort((gram, -n, r))
        r, gram = r[order], gram[order]
        first = np.searchsorted(r, np.arange(rows + 1))
        own = np.arange(len(r)) - first[r]
        top = own < self.size
        r, gram, own = r[top], gram[top], own[top]
        at = np.minimum(np.searchsorted(self.known, gram), max(0, len(self.known) - 1))
        at = np.where(self.known[at] == gram, at, len(self.known)) if len(self.known) else np.zeros(len(gram), np.int64)
        out = np.zeros((rows, len(self.langs)))
        for j in range(len(self.langs)):
            theirs = self.rank[at, j]
            out[:, j] = np.bincount(r, np.where(theirs < 0, self.size, np.abs(theirs - own)), rows)
        return out, np.bincount(r, minlength=rows)


def identify(docs: DataFrame, by_lang: dict[str, np.ndarray], size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    ranker = docs.sparkSession.sparkContext.broadcast(Ranker(by_lang, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranker.value
        for c in T.chunks(batches, size=1 << 20):
            rows = c.rows.num_rows
            has = _has_letter(c)
            langs, score = np.full(rows, "und", object), np.zeros(rows)
            if model.langs:
                d, n = model.distances(*grams(c), rows)
                best = d.argmin(1)
                least = d[np.arange(rows), best]
                rest = d.mean(1) if len(model.langs) > 1 else np.maximum(n * model.size, 1)
                scale = 2 if len(model.langs) > 1 else 1
                langs = np.where(has, np.array(model.langs, object)[best], "und")
                score = np.where(has & (rest > 0), np.clip(scale * (1 - least / np.where(rest > 0, rest, 1)), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _has_letter(c: T.Chunk) -> np.ndarray:
    """Whether each text holds a Unicode letter."""
    n = len(c.data) - 16
    ascii_letter = LETTERS[:128][c.data[:n] & 127] & (c.data[:n] < 128)
    out = T.segment_sum(ascii_letter.astype(np.int64), c.offs) > 0
    for r in np.flatnonzero(~out & (np.diff(c.offs) > 0)):
        out[r] = any(ch.isalpha() for ch in c.text(r).decode("utf-8", "replace"))
    return out
