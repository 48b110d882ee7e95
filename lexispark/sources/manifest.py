"""JSON-lines manifests: flat rows (audio and text) or conversations of turns."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.nested import TURNS, audio_duration, first_audio, first_text, from_flat

FLAT = "id string, audio_filepath string, duration double, offset double, text string"
NESTED = f"id string, conversations {TURNS}, dataset_name string, speaker string, language string, split string"


def expand_shards(path: str) -> list[str]:
    """..._OP_a..b_CL_... as the paths with a to b."""
    m = re.search(r"_OP_(\d+)\.\.(\d+)_CL_", path)
    if not m:
        return [path]
    width = len(m[1]) if m[1].startswith("0") and len(m[1]) > 1 else 0
    return [p for i in range(int(m[1]), int(m[2]) + 1) for p in expand_shards(path[: m.start()] + str(i).zfill(width) + path[m.end() :])]


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """${oc.env:NAME} from the environment; an unset name is an error."""
    source = os.environ if env is None else env

    def value(m: re.Match) -> str:
        if m[1] not in source:
            raise KeyError(f"{m[1]} is not set")
        return source[m[1]]

    return re.sub(r"\$\{oc\.env:([^}]+)\}", value, text)


def resolve(paths: str | list[str], env: dict[str, str] | None = None) -> list[str]:
    """Sorted distinct paths of a list, with variables and shard ranges resolved; folders and globs are left to Spark."""
    given = [paths] if isinstance(paths, str) else paths
    return sorted({p for g in given for p in expand_shards(interpolate(g, env))})


def read(spark: SparkSession, paths: str | list[str], env: dict[str, str] | None = None) -> DataFrame:
    """id, turns, metadata (map of all other keys) and _bad (a line that is no JSON) of flat and nested manifests alike."""
    lines = spark.read.text(resolve(paths, env))
    raw = F.from_json("value", "map<string,string>")
    # of a nested row only these keys are read as structs
    rows = lines.select("value", raw.alias("m"), F.from_json("value", NESTED).alias("n"), F.from_json("value", FLAT).alias("f"))
    nested = F.map_contains_key("m", F.lit("conversations"))
    flat = from_flat(F.col("f.audio_filepath"), F.col("f.duration"), F.col("f.offset"), F.col("f.text"))
    known = ["id", "conversations", "audio_filepath", "duration", "offset", "text"]
    rest = F.map_filter("m", lambda k, v: ~k.isin(*known) & v.isNotNull())
    return rows.select(
        F.coalesce(F.col("n.id"), F.col("f.id")).alias("id"),
        F.when(nested, F.col("n.conversations")).otherwise(flat).alias("turns"),
        rest.alias("metadata"),
        (F.col("m").isNull() | (F.size("m") == 0)).alias("_bad"),
    )


def to_lines(df: DataFrame, kind: str = "multiturn") -> DataFrame:
    """Rows of `read` as JSON lines, "multiturn" or flat ("asr"); null fields are left out."""
    if kind == "asr":
        audio = first_audio(F.col("turns"))
        row = F.struct("id", audio["value"].alias("audio_filepath"), audio["duration"].alias("duration"), audio["offset"].alias("offset"), first_text(F.col("turns"))["value"].alias("text"))
    else:
        row = F.struct("id", F.col("turns").alias("conversations"), *([F.col("metadata").alias("custom_metadata")] if "metadata" in df.columns else []))
    return df.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("value"))


def write(df: DataFrame, path: str, kind: str = "multiturn", compression: str | None = None, mode: str = "error") -> None:
    to_lines(df, kind).write.mode(mode).text(path, compression=compression or "none")


def write_cuts(df: DataFrame, path: str) -> None:
    """One gzipped cut a row: id, recording, start, duration, text."""
    audio = first_audio(F.col("turns"))
    cut = F.struct("id", audio["value"].alias("recording"), F.coalesce(audio["offset"], F.lit(0.0)).alias("start"), audio_duration(F.col("turns")).alias("duration"), first_text(F.col("turns"))["value"].alias("text"))
    df.select(F.to_json(cut).alias("value")).write.text(path, compression="gzip")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of a folder's new manifest lines, with id, turns' JSON and the line."""
    lines = spark.readStream.schema("value string").text(folder)
    return lines.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.conversations").alias("conversations"), "value")


def summary_json(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True)
