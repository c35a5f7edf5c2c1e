"""The whole chain: text sheets and emissions to stamped sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.functions import clock
from tactus.operators import align as G
from tactus.operators import audio as A
from tactus.operators import lines as L
from tactus.operators import spans as S
from tactus.sources import tables


#: What an option may be.
CHOICES = {"split": ("word", "char", "current"), "stars": ("edges", "none", "segment"), "emissions": ("logits", "probabilities", "log-probabilities")}


@dataclass(frozen=True)
class Options:
    """Choices of a run, checked when made."""

    split: str = "word"
    romanize: bool = True
    language: str = "eng"
    stars: str = "edges"
    emissions: str = "logits"
    blank_id: int = 0
    second_per_frame: float = 0.02
    gap_s: float = 1.0

    def __post_init__(self) -> None:
        for name, known in CHOICES.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} {getattr(self, name)!r} is none of {known}")
        if not (len(self.language) == 3 and self.language.isascii() and self.language.isalpha()):
            raise ValueError(f"language {self.language!r} is no 3-letter code")
        if self.second_per_frame <= 0 or self.gap_s < 0 or self.blank_id < 0:
            raise ValueError("second_per_frame must be above 0, gap_s and blank_id not below")


def made_up_emissions(tokens: DataFrame, vocabulary_size: int, hold: int = 2, low: float = -9.0) -> DataFrame:
    """Emissions that say each token for ``hold`` frames after one blank frame: (doc_id, frame, values)."""
    frames = tokens.select("doc_id", "token_index", "token_id", F.posexplode(F.concat(F.array(F.lit(0)), F.array_repeat(F.col("token_id"), hold))).alias("k", "said"))
    values = F.transform(F.sequence(F.lit(0), F.lit(vocabulary_size - 1)), lambda v: F.when(v == F.col("said"), 0.0).otherwise(low))
    return frames.select("doc_id", (F.col("token_index") * (hold + 1) + F.col("k")).cast("int").alias("frame"), values.alias("values"))


def target_tokens(sheets: DataFrame, vocab: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Lines with kinds, and the tokens of the alignable ones."""
    lines = L.line_kinds(L.lines(sheets))
    return lines, L.tokens(L.segments(lines.where("kind = 'ALIGNABLE'"), options.split, options.romanize, options.language), vocab)


def generate(sheets: DataFrame, emissions: DataFrame, vocab: DataFrame, options: Options = Options(), quiet: DataFrame | None = None) -> DataFrame:
    """Stamped sheets (doc_id, text) of ``sheets`` aligned to ``emissions``; with ``quiet`` (doc_id,
    start_s of silences) line ends move to the first silence before the next line.  Documents whose
    frames can't hold their tokens give none (see align.infeasible)."""
    lines, tokens = (tables.scratch(x) for x in target_tokens(sheets, vocab, options))  # read several times below
    scores = emissions.withColumn("values", A.log_probabilities(F.col("values"), options.emissions))
    path = G.align(scores, tokens, options.blank_id, options.stars)
    words = S.words_by_segment(S.token_spans(path), tokens)
    aligned = lines.join(words.select("doc_id").distinct(), "doc_id", "left_semi")
    times = S.line_times(aligned, words, options.second_per_frame).join(lines.select("doc_id", "line_index", F.col("line").alias("text")), ["doc_id", "line_index"])
    if quiet is not None:
        times = A.correct_ends(S.next_timed(times), quiet).drop("next_start")
    shown = times.withColumn("text", F.when(F.col("kind") != "BLANK", F.col("text")))
    out = S.output_lines(shown, options.gap_s).withColumn("hundredths", clock.hundredths(F.col("at_s")))
    return tables.stamped_sheets(out)
