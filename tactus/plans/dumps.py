"""Debug dumps of a run: its sections as tables and as text, and their comparison row by row."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.functions import text
from tactus.operators import align as G
from tactus.operators import audio as A
from tactus.operators import checks as K
from tactus.operators import lines as L
from tactus.operators import spans as S
from tactus.plans.generate import Options
from tactus.sources.tables import scratch

#: Columns that must be equal and those that may differ by a tolerance, by section.
COMPARED = {
    "target_tokens": (["token_id"], []),
    "merged_path_segments": (["token_id", "token_text", "start_frame", "end_frame", "is_blank", "is_star"], ["start_seconds", "end_seconds", "score"]),
    "word_spans_after_padding": ([], ["start_seconds", "end_seconds", "score"]),
}


def sections(sheets: DataFrame, emissions: DataFrame, vocab: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """The sections of a run as tables, each with doc_id: config, normalized_text, target_text,
    target_tokens, frames, merged_path_segments and word_spans_after_padding."""
    lines = L.line_kinds(L.lines(sheets))
    segs = scratch(L.segments(lines.where("kind = 'ALIGNABLE'"), options.split, options.romanize, options.language))
    tokens = scratch(L.tokens(segs, vocab))
    scores = emissions.withColumn("values", A.log_probabilities(F.col("values"), options.emissions))
    path = scratch(G.align(scores, tokens, options.blank_id, options.stars))
    names = F.broadcast(vocab.select(F.col("token_id").cast("int").alias("token_id"), F.col("text").alias("token_text")))
    second = options.second_per_frame

    order = F.struct("segment_index", "norm")
    texts = segs.where("norm <> ''").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["norm"]).alias("words"))
    gap = "" if text.effective_split(options.language, options.split) == "char" else " "
    chosen = {k: str(v) for k, v in asdict(options).items()}
    config = sheets.select("doc_id", F.explode(F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv])).alias("key", "value"))
    normalized = texts.select("doc_id", F.lit("text").alias("key"), F.array_join("words", gap).alias("value"))
    target = texts.select("doc_id", F.lit("text").alias("key"), text.target_text(F.col("words")).alias("value"))
    target_tokens = tokens.join(names, "token_id", "left").select("doc_id", F.col("token_index").alias("index"), "token_id", text.dump_token(F.col("token_text"), F.lit(False)).alias("token_text"), "line_index", "segment_index", F.col("starts_segment").cast("int").alias("starts_segment"), F.col("norm_start").alias("normalized_start"), (F.col("norm_start") + F.length("ch")).alias("normalized_end"))
    size = emissions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("v"))
    told = {"emission_frame_count": F.col("n"), "emission_vocabulary_size": F.col("v"), "frame_duration_seconds": F.lit(second), "blank_token_id": F.lit(options.blank_id)}
    frames = size.select("doc_id", F.explode(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v.cast("string"))])).alias("key", "value"))
    merged = K.path_segments(path).join(names, "token_id", "left")
    merged = merged.select("doc_id", F.col("seg").alias("index"), "token_id", text.dump_token(F.col("token_text"), F.col("is_star")).alias("token_text"), "start_frame", "end_frame", (F.col("start_frame") * second).alias("start_seconds"), (F.col("end_frame") * second).alias("end_seconds"), "score", F.col("is_blank").cast("int").alias("is_blank"), F.col("is_star").cast("int").alias("is_star"))
    padded = K.padded_spans(path, tokens, options.stars).where("problem is null")
    spans = padded.select("doc_id", "token_index", F.col("padded_start").alias("start_frame"), F.col("padded_end").alias("end_frame"), "score")
    own = segs.select("doc_id", "segment_index", F.col("norm").alias("text"), F.col("norm_start").alias("normalized_start"), F.col("norm_end").alias("normalized_end"))
    met = S.words_by_segment(spans, tokens).join(own, ["doc_id", "segment_index"])
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment_index")) - 1
    words = met.select("doc_id", index.alias("index"), "line_index", F.col("segment_index").alias("word_index"), "text", "normalized_start", "normalized_end", (F.col("start_frame") * second).alias("start_seconds"), (F.col("end_frame") * second).alias("end_seconds"), "score")
    return {"config": config, "normalized_text": normalized, "target_text": target, "target_tokens": target_tokens, "frames": frames, "merged_path_segments": merged, "word_spans_after_padding": words}


def dump_lines(found: dict[str, DataFrame]) -> DataFrame:
    """A dump's lines: doc_id, section (its number), row (-2 and -1 for '[name]' and a table's header), line."""
    out = None
    for number, (name, df) in enumerate(found.items()):
        keyed = {"key", "value"} <= set(df.columns)
        cols = [c for c in df.columns if c != "doc_id"]
        shown = lambda c, df=df: text.escape(F.col(c)) if dict(df.dtypes)[c] == "string" and c != "token_text" else F.col(c).cast("string")
        if keyed:
            row, line = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1, F.concat("key", F.lit("="), F.coalesce(shown("value"), F.lit("<null>")))
        else:
            row, line = F.col("index"), F.concat_ws("\t", *[F.coalesce(shown(c), F.lit("<null>")) for c in cols])
        body = df.select("doc_id", row.cast("int").alias("row"), line.alias("line"))
        heads = [(-2, f"[{name}]")] + ([] if keyed else [(-1, "\t".join(cols))])
        head = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(x).alias("line")) for r, x in heads]))
        part = body.unionByName(df.select("doc_id").distinct().select("doc_id", head.alias("h")).select("doc_id", "h.row", "h.line")).withColumn("section", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "section", "row", "line")


def compare_rows(a: DataFrame, b: DataFrame, equal: list[str], near: dict[str, float]) -> DataFrame:
    """Rows of two tables by (doc_id, index) that differ: doc_id, index, field, a, b (as text); field is
    'count' where one side has no such row, else the first column that differs or is beyond its tolerance."""
    cols = [*equal, *near]
    left, right = ([df.select("doc_id", "index", *[F.col(c).alias(f"{n}_{c}") for c in cols], F.lit(True).alias(f"{n}_is")) for n, df in (("a", a), ("b", b))])
    both = left.join(right, ["doc_id", "index"], "full_outer")

    def shown(c: str, n: str) -> Column:
        return F.col(f"{n}_{c}").cast("string")

    differs = [(c, ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))) for c in equal]
    differs += [(c, ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= t, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())) for c, t in near.items()]
    field = F.when(F.col("a_is").isNull() | F.col("b_is").isNull(), "count")
    values = {n: F.lit(None).cast("string") for n in "ab"}
    for c, bad in differs:
        for n in "ab":
            values[n] = F.when(field.isNull() & bad, shown(c, n)).otherwise(values[n])
        field = field.when(bad, c)
    return both.select("doc_id", "index", field.alias("field"), values["a"].alias("a"), values["b"].alias("b")).where("field is not null")


def compare(a: dict[str, DataFrame], b: dict[str, DataFrame], seconds: float = 0.021, score: float = 1e-3) -> DataFrame:
    """Differences of two dumps' compared sections: section, doc_id, index, field, a, b."""
    out = None
    for name, (equal, near) in COMPARED.items():
        part = compare_rows(a[name], b[name], equal, {c: score if c == "score" else seconds for c in near}).select(F.lit(name).alias("section"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def word_deltas(a: DataFrame, b: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` words of each document in both dumps with how far their times are apart."""
    left, right = ([df.where(F.col("index") < most).select("doc_id", "index", *[F.col(c).alias(f"{n}_{c}") for c in ("text", "start_seconds", "end_seconds")]) for n, df in (("a", a), ("b", b))])
    both = left.join(right, ["doc_id", "index"])
    return both.select("doc_id", "index", "a_text", "b_text", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c.split('_')[0]}_delta") for c in ("start_seconds", "end_seconds")])
