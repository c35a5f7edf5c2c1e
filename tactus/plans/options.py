"""The public options: names, aliases, kinds, defaults, parsing and checks, and a command line.

The command line aligns text sheets to a table of emissions (doc_id, frame, values) and writes
stamped sheets; the options of separation are parsed and checked for ``separation.Geometry``.
"""

from __future__ import annotations

import argparse
import math
import os
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Option names with their kinds and defaults.
VALUES = {
    "--input-song": ("path", None),
    "--input-vocals": ("path", None),
    "--output-vocals": ("path", None),
    "--input-lyrics": ("path", None),
    "--output-lrc": ("path", None),
    "--model-vocal": ("path", None),
    "--model-ctc": ("path", None),
    "--tokenizer": ("path", None),
    "--onnx-provider": (("auto", "cpu", "cuda"), "auto"),
    "--onnx-device": ("int", 0),
    "--temp-dir": ("path", None),
    "--vocals-format": (("wav", "flac", "mp3", "opus"), "wav"),
    "--chunk-seconds": ("positive", 30),
    "--margin-seconds": ("int", 3),
    "--compensate": ("float", 1.035),
    "--n-fft": ("positive", 6144),
    "--hop": ("positive", 1024),
    "--dim-f": ("positive", None),
    "--dim-t": ("positive", None),
    "--model-output": (("vocals", "instrumental"), "vocals"),
    "--clip-mode": (("clamp", "none"), "clamp"),
    "--ctc-debug-dump": ("path", None),
    "--split-size": (("current", "word", "char"), "word"),
    "--star-frequency": (("none", "edges", "segment"), "edges"),
    "--romanization": (("off", "icu"), "icu"),
    "--language": ("language", "eng"),
    "--emissions": (("logits", "probabilities", "log-probabilities"), "logits"),
}
FLAGS = ["--denoise", "--keep-temp-files", "--romanize"]
ALIASES = {"--vocals-output": "--output-vocals", "--lyrics": "--input-lyrics", "-l": "--input-lyrics", "--output": "--output-lrc", "-o": "--output-lrc", "--format": "--vocals-format"}


def option_name(name: str) -> str | None:
    """The option that a name or alias stands for."""
    name = ALIASES.get(name, name)
    return name if name in VALUES or name in FLAGS else None


def enum_name(constant: str, prefix: str) -> str:
    """The lower-cased rest of a constant's name after ``prefix``; 'invalid' without the prefix or a rest."""
    rest = constant.removeprefix(prefix)
    return rest.lower() if constant.startswith(prefix) and rest else "invalid"


def language(code: str) -> str:
    if not (len(code) == 3 and code.isascii() and code.isalpha()):
        raise ValueError(f"{code!r} is no 3-letter language code")
    return code.lower()


def number(text: str, low: int | None = None) -> int:
    """A whole number of 32 bits."""
    n = int(text) if text.strip() == text and text.lstrip("+-").isdecimal() and text.isascii() else None
    if n is None or not -(2**31) <= n < 2**31 or low is not None and n < low:
        raise ValueError(f"{text!r} is no whole number{'' if low is None else f' of {low} or more'}")
    return n


def real(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"{text!r} is not finite")
    return x


def parsed_number(text: Column, low: int = -(2**31), high: int = 2**31 - 1) -> Column:
    """A column of texts as whole numbers between low and high; null for others."""
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.when(n.between(low, high), n.cast("int"))


def parse_value(name: str, text: str):
    """An option's value; ValueError says what is wrong."""
    kind = VALUES[option_name(name)][0]
    if isinstance(kind, tuple):
        if text not in kind:
            raise ValueError(f"{name}: {text!r} is none of {', '.join(kind)}")
        return text
    return {"path": str, "int": number, "positive": lambda t: number(t, 1), "float": real, "language": language}[kind](text)


def first_existing(paths: Iterable[str | None]) -> str | None:
    """The first path that there is; paths with a scheme are taken to be there."""
    return next((p for p in paths if p and ("://" in p or os.path.exists(p))), None)


def missing_assets(assets: dict[str, str | None]) -> dict[str, str]:
    """What is wrong with named files: 'not given' or 'not there'."""
    found = {k: "not given" if not p else None if first_existing([p]) else "not there" for k, p in assets.items()}
    return {k: v for k, v in found.items() if v}


def defaults(environment: dict[str, str] | None = None) -> dict[str, str | None]:
    """Paths of model and vocabulary: from TACTUS_MODEL_VOCAL, TACTUS_MODEL_CTC and TACTUS_TOKENIZER."""
    env = os.environ if environment is None else environment
    return {k: env.get("TACTUS_" + k.removeprefix("--").replace("-", "_").upper()) for k in ("--model-vocal", "--model-ctc", "--tokenizer")}


def sibling(path: str, extension: str) -> str:
    """The path with its last extension, if any, replaced."""
    head, slash, last = path.rpartition("/")
    stem, dot, _ = last.rpartition(".")
    return head + slash + (stem if dot and stem else last) + extension


def problems(options: dict) -> list[str]:
    """What a set of options (by name) lacks or contradicts; empty if it can run."""
    has = lambda k: bool(options.get(k))
    out = []
    if has("--input-song") and has("--input-vocals"):
        out.append("--input-song and --input-vocals exclude each other")
    if not has("--input-song") and not has("--input-vocals") and not has("--emissions-table"):
        out.append("one of --input-song, --input-vocals and --emissions-table is needed")
    if has("--input-lyrics") and not has("--output-lrc"):
        out.append("--output-lrc is needed")
    if has("--input-song") and not has("--model-vocal"):
        out.append("--model-vocal is needed for a song")
    if has("--input-lyrics") and not has("--emissions-table"):
        out += [f"{k} is needed for text" for k in ("--model-ctc", "--tokenizer") if not has(k)]
    out += [f"{k} must not be negative" for k in ("--margin-seconds", "--onnx-device") if (options.get(k) or 0) < 0]
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tactus", description="Align text sheets to emissions and write stamped sheets.", allow_abbrev=False)
    p.add_argument("--emissions-table", metavar="PATH", help="Parquet of doc_id, frame, values, in place of a model")
    for name, (kind, default) in VALUES.items():
        def value(text: str, name=name):
            try:
                return parse_value(name, text)
            except ValueError as e:
                raise argparse.ArgumentTypeError(str(e)) from None

        p.add_argument(name, *(a for a, n in ALIASES.items() if n == name), type=value, default=default, dest=name, metavar=kind.upper() if isinstance(kind, str) else "KIND")
    for name in FLAGS:
        p.add_argument(name, action="store_true", dest=name)
    return p


def parse(argv: list[str], environment: dict[str, str] | None = None) -> dict:
    """Options by name, with defaults and what follows from them; exits with a message if they can't run."""
    p = parser()
    found = vars(p.parse_args(argv))
    found["--emissions-table"] = found.pop("emissions_table")
    for k, v in defaults(environment).items():
        found[k] = found[k] or v
    source = found["--input-song"] or found["--input-vocals"]
    if source and not found["--input-lyrics"]:
        found["--input-lyrics"] = sibling(source, ".txt")
    if found["--input-lyrics"] and not found["--output-lrc"]:
        found["--output-lrc"] = sibling(found["--input-lyrics"], ".lrc")
    if found["--romanize"]:
        found["--romanization"] = "icu"
    if wrong := problems(found):
        p.error("; ".join(wrong))
    return found


def main(argv: list[str] | None = None) -> None:
    import sys

    from pyspark.sql import SparkSession

    from tactus.operators import lines as L
    from tactus.plans import generate as G
    from tactus.sources import tables

    o = parse(sys.argv[1:] if argv is None else argv)
    if not o["--emissions-table"]:
        raise SystemExit("without a model, --emissions-table is needed")
    spark = SparkSession.builder.getOrCreate()
    vocab = tables.read_vocabulary(spark, o["--tokenizer"]) if o["--tokenizer"] else L.vocabulary(spark)
    sheets = tables.read_sheets(spark, o["--input-lyrics"]).where("text is not null and not blank")
    sheets = sheets.withColumn("doc_id", F.regexp_extract("doc_id", r"([^/]+?)(?:\.[^./]*)?$", 1))
    chosen = G.Options(split=o["--split-size"], romanize=o["--romanization"] == "icu", language=o["--language"], stars=o["--star-frequency"], emissions=o["--emissions"])
    stamped = G.generate(sheets.select("doc_id", "text"), spark.read.parquet(o["--emissions-table"]), vocab, chosen)
    stamped.write.mode("errorifexists").parquet(o["--output-lrc"])
