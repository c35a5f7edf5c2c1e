"""Shared-folder staging and skew-safe joins used by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds at least 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 256
#: Ids that are broadcast at most (about 50 MB); more go through a shuffle.
MOST_IDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines must share.  A session of one
    machine (master local) that names none gets a temporary one; elsewhere it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"file://{tempfile.gettempdir()}/tactus-checkpoints"
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither
    recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tactus-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_small(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for rows that are few and short whatever the corpus, dealt into as many files as tasks run at
    once: each file costs its executor processes forked for the mode of it and its checksum."""
    return staged(df.repartition(df.sparkSession.sparkContext.defaultParallelism), name)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def attach(rows: DataFrame, groups: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key from ``groups``.

    Keys with at least ``total / HOT_SHARE`` rows (at most HOT_SHARE of them, however
    large the data) are joined by broadcast, so that their rows stay where they are;
    all others by a shuffle.  Both inputs are read twice and should be staged.
    Rows with a null in the key have no partner.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(count) >= least))
    cold = groups.where(F.col(count) < least)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id (null too) isn't in ``gone`` (one column of distinct ids, staged).

    Up to MOST_IDS ids, counted first, are broadcast, so that texts stay where they are; more are
    met by a sort-merge anti-join, where a hot id's rows can be split as none are collected."""
    few = gone.count() <= MOST_IDS
    ids = gone.select(F.col(gone.columns[0]).alias("__gone"))
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), docs[id_col].eqNullSafe(ids["__gone"]), "left_anti")
