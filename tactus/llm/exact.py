"""Operator 9 [native]: exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest (SHA-256 of the text with white space
runs made one space).  A batch is grouped by digest with map-side combination, anti-joined
against the index by sort-merge without a shuffle of the index, and its new digests are
appended with the row that stays.  ``compact`` makes each bucket one sorted file again after
many appends.  DataFrame functions only.

Defined results: null and empty texts are equal; of equal texts the smallest id in the
first batch that had the text stays; rows that repeat an id are one document and share its
decision; null ids sort last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.storage import attach, staged, without

#: Digests that a bucket is meant to hold.
BUCKET_ROWS = 1 << 20


def digest(text) -> F.Column:
    """32 bytes of SHA-256 of the normalised text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def buckets_for(rows: int) -> int:
    """A power of two of buckets, at least 16, of about BUCKET_ROWS digests each."""
    return max(16, 1 << max(0, (max(rows, 1) - 1) // BUCKET_ROWS).bit_length())


class DigestIndex:
    """Digests seen so far: table ``name`` (digest binary, keep_id long), bucketed and sorted by digest.

    The table is made, empty, when the index is opened for the first time; ``buckets`` counts then only."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if self.exists():
            found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
            self.buckets = int(found["Num Buckets"])
        else:
            self._write(spark.createDataFrame([], "digest binary, keep_id long"), name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups (digest, ...) whose digest the index lacks: a sort-merge anti-join that deals the
        groups by the index's buckets and leaves the index where it is."""
        return groups.repartition(self.buckets, "digest").hint("merge").join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Append the groups (digest, min_id) whose digest the index lacks."""
        self._write(self.unseen(groups).where("digest is not null").select("digest", F.col("min_id").alias("keep_id")), self.name)

    def add(self, rows: DataFrame) -> DataFrame:
        """Append what is new in a batch (doc_id, digest) and return its groups (digest, min_id, n), staged."""
        groups = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("n")), "digest-groups")
        self.append(groups)
        return groups

    def compact(self) -> None:
        """One sorted file a bucket.  The new table is whole before it takes the name."""
        new, old = f"{self.name}_new_{uuid.uuid4().hex[:8]}", f"{self.name}_old_{uuid.uuid4().hex[:8]}"
        self._write(self.table(), new)
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {old}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row, staged."""
    return staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")


def _decided(rows: DataFrame, groups: DataFrame, index: DigestIndex) -> DataFrame:
    """Each row (doc_id, digest; staged) with keep_id, group_size and kept, from groups (digest, n) that
    the index has met.  All reading of the index is over when this returns."""
    met = groups.select("digest", "n").repartition(index.buckets, "digest").hint("merge").join(index.table().hint("merge"), "digest")
    found = attach(rows, staged(met, "digest-kept"), ["digest"], "n", rows.count())
    stays = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against ``index`` and itself and append what is new.

    One row per document: doc_id, keep_id (the id that stays), group_size (rows of the batch
    with the text), kept, text_sha256.
    """
    rows = digests(docs, id_col, text_col)
    return _shown(_decided(rows, index.add(rows), index))


def new_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An index of its own, empty, with buckets for about ``rows`` digests."""
    return DigestIndex(spark, f"tactus_digests_{uuid.uuid4().hex}", buckets_for(rows))


def _whole(docs: DataFrame, batches: int) -> DataFrame:
    rows = digests(docs)
    index = new_index(docs.sparkSession, rows.count())
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    last = F.coalesce(F.col("doc_id") > F.lit(cuts[-1]), F.lit(True)) if cuts else F.lit(True)
    ranges = [F.col("doc_id") <= b if a is None else F.col("doc_id").between(a + 1, b) for a, b in zip([None, *cuts], cuts)]
    groups = None
    for part in [*ranges, last]:
        more = index.add(rows.where(part))
        groups = more if groups is None else groups.unionByName(more)
    found = _decided(rows, groups.groupBy("digest").agg(F.sum("n").alias("n")), index)
    index.drop()
    return found


def deduplicate_table(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Deduplicate a whole table through an index of its own, as its ids would arrive: in ``batches`` of
    ascending ids (null ids last), each anti-joined against what those before it appended.
    The same columns as ``deduplicate``; group_size counts rows of the table.  The index is dropped."""
    return _shown(_whole(docs, batches))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat both id and text, one.

    Only ids are shuffled: texts are dealt again only for ids that several rows have."""
    found = staged(_whole(docs, 1), "digest-decisions")
    ids = staged(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay")).where("n > 1 or stay = 0"), "digest-ids")
    rest = without(docs, ids.select("doc_id"))
    again = ids.where("n > 1 and stay > 0").select(F.col("doc_id").alias("__id"))
    if again.isEmpty():
        return rest
    stays = found.where("kept").join(again.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of")).distinct()
    marked = docs.join(again.hint("merge"), docs["doc_id"].eqNullSafe(again["__id"]), "left_semi").withColumn("__digest", digest(F.col("text")))
    same = marked["doc_id"].eqNullSafe(stays["__id"]) & (marked["__digest"] == stays["__of"])
    return rest.unionByName(marked.join(stays.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__digest"]).select(*docs.columns))
