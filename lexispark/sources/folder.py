"""Utterance folders: relations of space-separated fields, one row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.join import keep_one


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def _field(i: int) -> Column:
    return F.get(F.split(F.trim("value"), r"\s+"), F.lit(i))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """utt, text: the first field and the rest, spaces collapsed; of repeated ids the last line stays."""
    # within a split of a file the id follows the lines; splits follow one another by their start
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("o")).filter(F.trim("value") != "")
    rows = lines.select(_field(0).alias("utt"), F.regexp_replace(F.trim(F.regexp_extract("value", r"^\s*\S+(.*)$", 1)), r"\s+", " ").alias("text"), "o")
    return keep_one(rows, ["utt"], "o", True).drop("o")


def read_pairs(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    return _lines(spark, path).select(_field(0).alias(key), _field(1).alias(value))


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "utt", "duration").select("utt", F.round(F.col("duration").try_cast("double"), 3).alias("duration"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(
        _field(0).alias("utt"), _field(1).alias("rec"), F.round(_field(2).try_cast("double"), 3).alias("start"), F.round(_field(3).try_cast("double"), 3).alias("end")
    )


def audio_path(command: Column, env: dict[str, str] | None = None) -> Column:
    """The path in a recording's command: between quotes, behind "sox", last of "flac ... |", or the first word; $NAMES from `env`."""
    c = F.trim(F.regexp_replace(F.trim(command), r"\|$", ""))
    words = F.split(F.trim(c), r"\s+")
    path = (
        F.when(c.rlike("'[^']*'"), F.regexp_extract(c, "'([^']*)'", 1))
        .when(c.rlike('"[^"]*"'), F.regexp_extract(c, '"([^"]*)"', 1))
        .when(F.get(words, F.lit(0)) == "sox", F.get(words, F.lit(1)))
        .when(F.get(words, F.lit(0)) == "flac", F.element_at(words, -1))
        .otherwise(c)
    )
    for name, value in (env or {}).items():
        path = F.replace(F.replace(path, F.lit(f"${{{name}}}"), F.lit(value)), F.lit(f"${name}"), F.lit(value))
    return path


def read_recordings(spark: SparkSession, path: str, env: dict[str, str] | None = None) -> DataFrame:
    return _lines(spark, path).select(_field(0).alias("rec"), audio_path(F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1), env).alias("path"))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load(spark: SparkSession, folder: str, env: dict[str, str] | None = None) -> DataFrame:
    """utt, rec, path, start, end, duration, text, spk, gender. Without segments an utterance is a whole recording; an utterance without text goes."""
    wav = read_recordings(spark, f"{folder}/wav.scp", env)
    if exists(spark, f"{folder}/segments"):
        segments = read_segments(spark, f"{folder}/segments")
    else:
        segments = read_durations(spark, f"{folder}/utt2dur").select("utt", F.col("utt").alias("rec"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    out = segments.join(wav, "rec").join(read_text(spark, f"{folder}/text"), "utt").withColumn("duration", F.round(F.col("end") - F.col("start"), 3))
    for name, key, value in (("utt2spk", "utt", "spk"), ("spk2gender", "spk", "gender")):
        if key in out.columns and exists(spark, f"{folder}/{name}"):
            out = out.join(read_pairs(spark, f"{folder}/{name}", key, value), key, "left")
        else:
            out = out.withColumn(value, F.lit(None).cast("string"))
    return out.select("utt", "rec", "path", "start", "end", "duration", "text", "spk", "gender")


def relations(df: DataFrame) -> dict[str, DataFrame]:
    """The folder's relations as single-column lines, from rows as `load` gives them."""
    line = lambda d, *cols: d.select(F.concat_ws(" ", *cols).alias("value")).distinct()
    three = lambda c: F.format_string("%.3f", F.col(c))
    speakers = df.filter("spk is not null")
    spk2utt = speakers.groupBy("spk").agg(F.array_join(F.sort_array(F.collect_set("utt")), " ").alias("utts"))
    return {
        "text": line(df, "utt", "text"),
        "segments": line(df, "utt", "rec", three("start"), three("end")),
        "utt2dur": line(df, "utt", three("duration")),
        "wav.scp": line(df, "rec", "path"),
        "utt2spk": line(speakers, "utt", "spk"),
        "spk2utt": line(spk2utt, "spk", "utts"),
        "spk2gender": line(df.filter("spk is not null and gender is not null"), "spk", "gender"),
    }


def save(df: DataFrame, folder: str, split: str | None = None) -> None:
    """Each relation as a folder of sorted lines; with a split column, one folder for each of its values."""
    if split is not None:
        for r in df.select(split).distinct().collect():  # a few names
            save(df.filter(F.col(split).eqNullSafe(r[0])).drop(split), f"{folder}/{r[0]}")
        return
    for name, lines in relations(df).items():
        lines.sort("value").write.text(f"{folder}/{name}")


def weighted(spark: SparkSession, folders: dict[str, float], env: dict[str, str] | None = None) -> DataFrame:
    """The union of folders, each with its weight."""
    out = None
    for folder, weight in folders.items():
        one = load(spark, folder, env).withColumn("weight", F.lit(float(weight)))
        out = one if out is None else out.unionByName(one)
    return out


def read_weighted_list(spark: SparkSession, path: str) -> dict[str, float]:
    """Folder and weight (1 if none) of each line of a short list."""
    rows = _lines(spark, path).select(_field(0).alias("f"), F.coalesce(_field(1).try_cast("double"), F.lit(1.0)).alias("w")).collect()
    return {r["f"]: r["w"] for r in rows}
