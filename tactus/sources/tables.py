"""Readers and writers: text sheets, stamped lines, vocabularies, dumps, fixtures."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.functions import clock, text


def scratch(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder (a temporary one only on a single machine) and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"file://{tempfile.gettempdir()}/tactus-checkpoints"
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{base.rstrip('/')}/tactus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row each: doc_id, text, bad_offset (first invalid byte), blank."""
    raw = spark.read.format("binaryFile").load(path)
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), text.canonical_newlines(F.decode("content", "UTF-8")))
    sheets = raw.select(F.col("path").alias("doc_id"), decoded.alias("text"), text.first_bad_byte("content").alias("bad_offset"))
    return sheets.withColumn("blank", ~text.has_text(F.col("text")))


def read_stamped(sheets: DataFrame) -> DataFrame:
    """Lines of stamped sheets: doc_id, line_index, kind TIMESTAMPED, BLANK or BAD, hundredths, text."""
    lines = sheets.select("doc_id", F.posexplode(text.split_lines(F.col("text"))).alias("line_index", "line"))
    kind = F.when(F.col("line") == "", "BLANK").when(clock.parse_stamp(F.col("line")).isNotNull(), "TIMESTAMPED").otherwise("BAD")
    return lines.select("doc_id", "line_index", kind.alias("kind"), clock.parse_stamp(F.col("line")).alias("hundredths"), F.when(kind == "TIMESTAMPED", clock.stamped_text(F.col("line"))).alias("text"))


def stamped_line() -> Column:
    """The text of an output line (kind, hundredths, text)."""
    return F.when(F.col("kind") == "BLANK", "").otherwise(F.concat(clock.stamp(F.col("hundredths")), F.coalesce("text", F.lit(""))))


def stamped_sheets(lines: DataFrame, order: str = "out_index") -> DataFrame:
    """One row per document with its stamped lines in order, each ending in a newline."""
    rows = lines.select("doc_id", F.struct(F.col(order), stamped_line().alias("line")).alias("row"))
    sheets = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return sheets.select("doc_id", F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def write_stamped(lines: DataFrame, path: str, mode: str = "errorifexists", by_document: bool = True) -> None:
    """A folder with a text file for each document, or, not ``by_document``, a Parquet table of
    (doc_id, text) for sets too large for a file each.  Spark's commit makes files visible when whole."""
    sheets = stamped_sheets(lines)
    if not by_document:
        sheets.write.mode(mode).parquet(path)
        return
    sheets.select("doc_id", F.regexp_replace("text", "\n\\z", "").alias("value")).write.partitionBy("doc_id").mode(mode).text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One token a line, its number the id; markers for blank, space, tab and unknown."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text"))
    rows = raw.select(F.posexplode(text.split_lines(text.canonical_newlines(F.col("text")))).alias("token_id", "line"))
    value = F.when(F.col("line") == "<space>", " ").when(F.col("line") == "<tab>", "\t").otherwise(F.col("line"))
    return rows.select("token_id", value.alias("text"), (F.col("line") == "<blank>").alias("is_blank"), (F.col("line") == "<unk>").alias("is_unknown"))


def vocabulary_problems(vocab: DataFrame) -> DataFrame:
    """(problem, text): duplicate and empty tokens, and a missing blank."""
    twice = vocab.groupBy("text").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "text")
    empty = vocab.where("text = ''").select(F.lit("empty").alias("problem"), "text")
    blank = vocab.agg(F.coalesce(F.max("is_blank"), F.lit(False)).alias("has")).where("not has").select(F.lit("no blank").alias("problem"), F.lit(None).cast("string").alias("text"))
    return twice.unionByName(empty).unionByName(blank)


def vocabulary_from_json(spark: SparkSession, path: str) -> DataFrame:
    """token -> id JSON object as (token_id, text)."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("text", "token_id"))
    return raw.select("token_id", "text")


def write_dump(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as tab-separated rows in a folder of its name; text columns escaped."""
    for name, df in sections.items():
        cols = [text.escape(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
        df.select(*cols).write.option("sep", "\t").option("header", True).option("quote", "").mode("errorifexists").csv(f"{path}/{name}")


def parse_dump(lines: DataFrame) -> DataFrame:
    """'[section]' headers and 'key=value' rows (doc_id, line_index, line) as (doc_id, section, row, key, value)."""
    w = Window.partitionBy("doc_id").orderBy("line_index")
    head = F.when(F.col("line").rlike(r"^\[.*\]$"), F.expr("substring(line, 2, length(line) - 2)"))
    marked = lines.withColumn("section", F.last(head, True).over(w)).where(head.isNull() & (F.col("line") != "") & ~F.col("line").startswith("#"))
    in_section = Window.partitionBy("doc_id", "section").orderBy("line_index")
    at = F.instr("line", "=")
    return marked.select(
        "doc_id",
        "section",
        (F.row_number().over(in_section) - 1).alias("row"),
        F.when(at > 0, F.expr("substring(line, 1, instr(line, '=') - 1)")).alias("key"),
        text.unescape(F.when(at > 0, F.expr("substring(line, instr(line, '=') + 1)")).otherwise(F.col("line"))).alias("value"),
    )


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows whose payload fields are hexadecimal UTF-8: name, then decoded fields."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    return raw.select(F.element_at("f", 1).alias("name"), F.transform(F.slice("f", 2, 1 << 20), lambda x: F.decode(F.unhex(x), "UTF-8")).alias("fields"))


def sibling_path(path: Column, extension: str) -> Column:
    """The path with its last extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))
