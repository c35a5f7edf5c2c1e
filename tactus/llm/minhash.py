"""Operator 8: near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words (lower-cased in A-Z; see textops.ALNUM) and its k-mers are
the runs of ``k`` words, each labelled with how many equal ones precede it.  For each of
``m`` hash functions the sketch holds the ``l`` minimum k-mers *in text order*, so texts
share an entry only where they share k-mers and their order: sensitive to edit similarity.

1. Texts of equal word sequence are one class from the start; one representative each goes on.
2. Representatives that share a sketch entry are candidates.  The leader of an entry is the
   smallest id of its group; each text is compared with the one leader it shares most entries
   with, which joins a group of similar texts in one pass.  Entries whose texts are then not
   all connected make families (connected over such entries).  A family is dealt into blocks of
   about FAMILY texts and FAMILY_WORDS words at most, and each pair of its blocks is one task of
   bounded size that compares the texts sharing an entry unless they are connected already.
3. A pair is verified by aligning its labelled k-mers: the longest common chain inside the
   diagonal band that a pair at the threshold can't leave.  With c chained of a and b k-mers,
   the similarity is c / (a + b - c), the Jaccard index of the k-mers met in the same order.
4. Connected pairs make classes (least labels, by contraction).

With l = 3 and m = 20 a pair at similarity s has no common entry with probability
(1 - s^3)^20 if both are long: 6e-7 at 0.8.  Short ones share less: 4 of 5 k-mers make an entry
equal with chance C(4,3) / C(5,3) = 0.4, and none of 20 with 3.7e-5.

Defined results: null texts and texts without words are each their own class; a text of
fewer than k words is one k-mer; rows that repeat an id are one document; a null id is in no
class and stays; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import textops as T
from tactus.llm.storage import attach, staged, without


def labelled(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers, distinct within a row, and row starts."""
    h, first = T.kmers(w, k)
    return T.mix(h ^ T.mix(T.occurrence(h, first).astype(np.uint64) + T._M1)), first


def sketch(key: np.ndarray, first: np.ndarray, l: int, m: int) -> list[np.ndarray]:
    """m entries for a row of l k-mers or more; one of all its k-mers for a shorter one, none for an empty one."""
    n = np.diff(first)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(n)
    for r in np.flatnonzero((n > 0) & (n < l)):
        v = np.array([n[r]], np.uint64)
        for x in key[first[r] : first[r + 1]]:
            v = T.mix(v * T._M2 ^ x)
        out[r] = v
    big = np.flatnonzero(n >= l)
    if len(big):
        inside = np.repeat(n >= l, n)
        own, size = key[inside], n[big]
        at = np.cumsum(size) - size
        entries = np.empty((len(big), m), np.uint64)
        for j in range(m):
            v = T.mix(own ^ np.uint64(0x5851F42D4C957F2D * (j + 1) & (1 << 64) - 1))
            places = []
            for i in range(l):
                least = np.minimum.reduceat(v, at)
                p = np.flatnonzero(v == np.repeat(least, size))
                if len(p) != len(big):  # two k-mers of one hash
                    p = p[np.unique(np.searchsorted(at, p, "right"), return_index=True)[1]]
                places.append(p)
                v[p] = np.uint64((1 << 64) - 1)
            entry = np.full(len(big), j, np.uint64)
            for p in np.sort(np.stack(places), axis=0):
                entry = T.mix(entry * T._M2 ^ own[p])
            entries[:, j] = entry
        for i, r in enumerate(big):
            out[r] = entries[i]
    return out


def sketches(docs: DataFrame, k: int, l: int, m: int) -> DataFrame:
    """doc_id, n_words, two hashes of the word sequence, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, size=2 << 20):
            w = T.words(c.data, c.offs, T.ALNUM)
            place = (np.arange(len(w.start)) - np.repeat(w.first[:-1], w.counts())).astype(np.uint64)
            sums = []
            for seed in (T._M1, T._M2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(w.hash ^ (place * seed)), dtype=np.uint64)])
                sums.append(pa.array((total[w.first[1:]] - total[w.first[:-1]]).view(np.int64)))
            rows = sketch(*labelled(w, k), l, m)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
            flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array(w.counts()), *sums, pa.ListArray.from_arrays(offs, flat)], names=["doc_id", "n_words", "d1", "d2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_words long, d1 long, d2 long, sketch array<long>")


def chain(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity c / (a + b - c) of two labelled k-mer sequences, or 0 below the threshold."""
    least = threshold / (1 + threshold) * (len(a) + len(b))
    if not len(a) or not len(b) or min(len(a), len(b)) < least - 1e-9:
        return 0.0
    order = np.argsort(b)
    place = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    place = order[place]
    i = np.flatnonzero(b[place] == a)
    p = place[i]
    p = p[np.abs(p - i) <= max(len(a), len(b)) - least + 1]
    if len(p) < least - 1e-9:
        return 0.0
    c = len(p)
    if c > 1 and (np.diff(p) <= 0).any():
        tails: list[int] = []
        for x in p.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        c = len(tails)
    s = c / (len(a) + len(b) - c)
    return s if s >= threshold - 1e-12 else 0.0


def verify(pairs: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches, "a_text", 1 << 20):
            sides = [c, next(T.chunks(iter([c.rows]), "b_text", 1 << 40))]
            (ka, fa), (kb, fb) = (labelled(T.words(x.data, x.offs, T.ALNUM), k) for x in sides)
            s = np.array([chain(ka[fa[i] : fa[i + 1]], kb[fb[i] : fb[i + 1]], threshold) for i in range(c.rows.num_rows)])
            yield pa.RecordBatch.from_arrays([c.rows.column(0), c.rows.column(1), pa.array(s)], names=["a", "b", "similarity"]).filter(pa.array(s > 0))

    with_a = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")).hint("merge"), "a")
    both = with_a.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")).hint("merge"), "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(run, "a long, b long, similarity double").dropDuplicates(["a", "b"])


#: Texts and words of a family that one task is meant to hold from each of two blocks.
FAMILY, FAMILY_WORDS = 500, 1 << 19


def links(docs: DataFrame, reps: DataFrame, total: int, k: int, threshold: float) -> DataFrame:
    """Verified pairs (a, b, similarity) that connect all similar representatives (doc_id, n_words, sketch)."""
    entries = staged(reps.select("doc_id", F.posexplode("sketch").alias("j", "v")).select(F.xxhash64("j", "v").alias("entry"), F.col("doc_id").alias("a")), "entries")
    n = entries.count()
    groups = staged(entries.groupBy("entry").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    members = staged(attach(entries, groups, ["entry"], "n", n), "members")
    shared = members.where("a <> b").groupBy("a", "b").count()
    pairs = shared.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
    good = staged(verify(pairs, docs, k, threshold), "links")
    found = components(good)
    labelled_ = staged(members.join(found.withColumnRenamed("doc_id", "a"), "a", "left").select("entry", "a", F.coalesce("label", "a").alias("own")), "member-labels")
    split = staged(labelled_.groupBy("entry").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most"), "split-entries")
    open_ = staged(attach(labelled_, split, ["entry"], "n", n).select("a", "own", "least").distinct(), "family-members")
    edges = open_.where("own > least").select(F.col("own").alias("a"), F.col("least").alias("b")).distinct()
    if open_.isEmpty():
        return good
    rows = staged(open_.select(F.col("a").alias("doc_id"), "own").distinct(), "family-rows")
    n = rows.count()
    grouped = components(edges).select(F.col("doc_id").alias("own"), "label")
    of_own = staged(rows.groupBy("own").agg(F.count(F.lit(1)).alias("n")).join(grouped, "own"), "family-labels")
    sized = reps.select("doc_id", "n_words").hint("merge")
    families = staged(attach(rows, of_own, ["own"], "n", n).drop("n").join(sized, "doc_id"), "families")
    sizes = staged(families.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")), "family-sizes")
    many = F.greatest(F.ceil(F.col("n") / FAMILY), F.ceil(F.col("words") / FAMILY_WORDS))
    blocks = attach(families, sizes, ["label"], "n", n).withColumn("blocks", many).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    tasks = blocks.select("doc_id", "own", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("doc_id", "own", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    texts = tasks.join(reps.select("doc_id", "sketch").hint("merge"), "doc_id").join(docs.select("doc_id", "text").hint("merge"), "doc_id")
    more = texts.groupBy("label", "i", "j").applyInArrow(_family(k, threshold), "a long, b long, similarity double")
    return good.unionByName(more)


def _family(k: int, threshold: float):
    """Links among the texts of two blocks of a family (or of one): a forest of verified pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, block = table["doc_id"].to_numpy(), table["block"].to_numpy()
        across = bool((block != block[0]).any())
        keys: list[np.ndarray] = []
        for rows in table.select(["doc_id", "text"]).combine_chunks().to_batches():
            for c in T.chunks(iter([rows])):
                key, first = labelled(T.words(c.data, c.offs, T.ALNUM), k)
                keys += [key[x:y] for x, y in zip(first[:-1], first[1:])]
        first_of: dict[int, int] = {}  # texts that are connected already
        parent = [first_of.setdefault(x, i) for i, x in enumerate(table["own"].to_pylist())]

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        met: dict[int, list[int]] = {}
        out = []
        for i, entries in enumerate(table["sketch"].to_pylist()):
            shared = [x for e in entries for x in met.get(e, ())]
            if shared:
                others, times = np.unique(shared, return_counts=True)
                for j in others[np.argsort(-times, kind="stable")].tolist():
                    if across and block[i] == block[j] or root(i) == root(j):
                        continue
                    s = chain(keys[i], keys[j], threshold)
                    if s:
                        out.append((int(ids[i]), int(ids[j]), s))
                        parent[root(i)] = root(j)
            for e in entries:
                met.setdefault(e, []).append(i)
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id reachable from each id in ``edges`` (a, b).

    Every round joins each node with its least neighbour and contracts the edges to the nodes left."""
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("to"))
        further = least.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        step = staged(least.join(further, "to").select("node", F.col("beyond").alias("to")), "steps")
        if labels is None:
            labels = step.select(F.col("node").alias("doc_id"), F.col("to").alias("label"))
        else:
            moved = labels.join(step.withColumnRenamed("node", "label"), "label", "left")
            labels = staged(moved.select("doc_id", F.coalesce("to", "label").alias("label")), "labels")
        ends = [step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        left = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct()
        edges = staged(left, "edges")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, l: int = 3, m: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), class_size, kept (doc_id is class_id)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(sketches(own, k, l, m), "sketches")
    total = rows.count()
    some = rows.where("n_words > 0 and doc_id is not null")
    reps = staged(some.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch"), F.count(F.lit(1)).alias("n")), "reps")
    pairs = links(own, reps.select(F.col("rep").alias("doc_id"), "n_words", "sketch"), total, k, threshold)
    labels = components(pairs)
    classed = reps.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("d1", "d2", "n_words", "n", F.coalesce("label", "rep").alias("class_id"))
    sizes = classed.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    classed = staged(classed.join(sizes, "class_id"), "classes")
    found = attach(rows.drop("sketch").where("n_words > 0 and doc_id is not null"), classed, ["d1", "d2", "n_words"], "n", total)
    lone = rows.where("n_words = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.select("doc_id", "class_id", "class_size").unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, the smallest id, with all columns.  Only ids are shuffled, if there
    are few enough to drop (see ``without``)."""
    return without(docs, staged(near_duplicates(docs, threshold).where("not kept").select("doc_id").distinct(), "near-duplicates"))
