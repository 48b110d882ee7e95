"""Transcript and diarization formats. Line formats are expressions; formats with a tree or blocks are parsed file by file in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.text import clock_seconds
from lexispark.session import ship

SEGMENT = "speaker string, start double, end double, text string"


def read_lines(spark: SparkSession, path: str, columns: list[str], separator: str = " ") -> DataFrame:
    """Columns split at the first separators of each line; the last holds the rest."""
    parts = F.split("value", f"{re.escape(separator)}+" if separator == " " else re.escape(separator), len(columns))
    return spark.read.text(path).filter(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_delimited(spark: SparkSession, path: str, separator: str = ",", aliases: dict[str, str] | None = None) -> DataFrame:
    """A table with a header; values trimmed, headers renamed by `aliases`."""
    df = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', multiLine=False)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias((aliases or {}).get(c.strip(), c.strip())) for c in df.columns])


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """rec, speaker, start, end of SPEAKER lines."""
    f = lambda i: F.get(F.split(F.trim("value"), r"\s+"), F.lit(i))
    rows = spark.read.text(path).filter(F.trim("value") != "")
    start = f(3).try_cast("double")
    return rows.select(f(1).alias("rec"), f(7).alias("speaker"), start.alias("start"), F.round(start + f(4).try_cast("double"), 3).alias("end"))


def rttm_lines(df: DataFrame) -> DataFrame:
    """Lines of rec, speaker, start, end."""
    return df.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "rec", "start", F.col("end") - F.col("start"), "speaker").alias("value"))


def diarization_document(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with ids from 1 in order, and each speaker's duration and number of segments, per recording."""
    order = Window.partitionBy("rec").orderBy("start", "end", "speaker")
    segments = df.withColumn("seg_id", F.row_number().over(order))
    speakers = df.groupBy("rec", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("duration"), F.count(F.lit(1)).alias("n_segments"))
    return segments, speakers


def read_stm(spark: SparkSession, path: str) -> DataFrame:
    """file, channel, speaker, start, end, gender and text; _ in ids becomes -."""
    pattern = r"^(\S+)\s+(\S+)\s+(\S+)\s+([0-9.]+)\s+([0-9.]+)\s+(<[^>]*>)?\s*(.*)$"
    g = lambda i: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern) & ~F.startswith("value", F.lit(";;")))
    gender = F.regexp_extract(g(6), r"(?i)[,<](f|m)(?:emale|ale)?[,>]", 1)
    return rows.select(
        F.translate(g(1), "_", "-").alias("file"), g(2).alias("channel"), F.translate(g(3), "_", "-").alias("speaker"), g(4).cast("double").alias("start"),
        g(5).cast("double").alias("end"), F.nullif(F.lower(gender), F.lit("")).alias("gender"), F.trim(g(7)).alias("text"),
    )


def read_simple_csv(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """text, start, end of a table with start and end or duration."""
    df = read_delimited(spark, path, separator)
    number = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.select("text", number("start").alias("start"), F.coalesce(number("end"), number("start") + number("duration")).alias("end")).orderBy("start")


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, name and size of the files that a path or pattern names (in folders, those within), empty ones too, as the store lists them.

    Spark's file sources leave out files of length 0. Only names reach the driver, as in any scan.
    """
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [(s, 0) for s in fs.globStatus(pattern) or []]
    while todo:
        status, depth = todo.pop()
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if status.isFile():
            found.append((status.getPath().toString(), name, status.getLen()))
        elif recursive or not depth:
            todo += [(s, depth + 1) for s in fs.listStatus(status.getPath())]
    return spark.createDataFrame(sorted(found), "path string, name string, size long")


def _read_files(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]], schema: str = SEGMENT) -> DataFrame:
    ship(spark)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i, *row) for f, text in zip(b["file"], b["value"], strict=True) for i, row in enumerate(parse(text))]
            yield pd.DataFrame(rows, columns=["file", "idx", *names])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, f"file string, idx long, {schema}")


def _seconds(clock: str) -> float:
    total = 0.0
    for part in clock.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return round(total, 3)


def parse_srt(text: str) -> list[tuple]:
    """(speaker or None, start, end, text) of each block of SRT or VTT; "NAME: " or <v NAME> names a speaker."""
    out = []
    for block in re.split(r"\n\s*\n", text.replace("\r", "").lstrip("﻿")):
        lines = block.strip().split("\n")
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        a, b = re.findall(r"[0-9:]+[.,][0-9]+", lines[at])[:2]
        said = " ".join(x.strip() for x in lines[at + 1 :]).strip()
        m = re.match(r"<v ([^>]+)>(.*?)(?:</v>)?$", said) or re.match(r"([A-Z][\w .-]{0,30}?)\s?:\s+(.*)$", said)
        out.append((m[1].strip() if m else None, _seconds(a), _seconds(b), (m[2] if m else said).strip()))
    return out


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    return _read_files(spark, path, parse_srt)


def parse_textgrid(text: str) -> list[tuple]:
    """(tier, start, end, text) of the intervals with text of a long-form TextGrid."""
    out = []
    for tier in re.split(r"item\s*\[\d+\]\s*:", text)[1:]:
        name = m[1] if (m := re.search(r'name\s*=\s*"([^"]*)"', tier)) else ""
        for a, b, said in re.findall(r'xmin\s*=\s*([0-9.]+)\s*xmax\s*=\s*([0-9.]+)\s*text\s*=\s*"((?:[^"]|"")*)"', tier):
            said = said.replace('""', '"').strip()
            if said and said.count("<") == said.count(">"):
                out.append((name, float(a), float(b), said))
    return out


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    return _read_files(spark, path, parse_textgrid)


def parse_trs(text: str) -> list[tuple]:
    """(speaker, start, end, text) between the marks of a Transcriber file; a piece ends where the next begins or its turn ends."""
    root = ET.fromstring(text.encode("utf-8") if text.lstrip().startswith("<?xml") else text)
    names = {s.get("id"): s.get("name") for s in root.iter("Speaker")}
    out = []
    for turn in root.iter("Turn"):
        end, speakers = float(turn.get("endTime")), (turn.get("speaker") or "").split()
        start, who, pieces = float(turn.get("startTime")), 0, [(turn.text or "", float(turn.get("startTime")), 0)]
        for node in turn:
            if node.tag == "Sync":
                start, who = float(node.get("time")), 0
            elif node.tag == "Who":
                who = int(node.get("nb", "1")) - 1
            pieces.append((node.tail or "", start, who))
        for i, (said, at, nb) in enumerate(pieces):
            stop = next((p[1] for p in pieces[i + 1 :] if p[1] > at), end)
            said = " ".join(said.split())
            if said:
                speaker = speakers[nb] if nb < len(speakers) else None
                out.append((names.get(speaker, speaker), at, stop, said))
    return out


def read_trs(spark: SparkSession, path: str) -> DataFrame:
    return _read_files(spark, path, parse_trs)


def read_timestamped(spark: SparkSession, path: str) -> DataFrame:
    """file, word, start, end of lines "[a b] word"; punctuation and what follows an apostrophe is glued to the word before."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").rlike(r"^\["))
    g = lambda i: F.regexp_extract("value", r"^\[\s*([0-9.:]+)\s+([0-9.:]+)\s*\]\s*(.*)$", i)
    rows = rows.select("file", clock_seconds(g(1)).alias("start"), clock_seconds(g(2)).alias("end"), F.trim(g(3)).alias("word"))
    w = Window.partitionBy("file").orderBy("start", "end", F.desc("word"))
    glued = F.col("word").rlike(r"^[.,:;?!]+$") | F.lag("word").over(w).rlike("'$")
    runs = rows.withColumn("g", F.sum((~F.coalesce(glued, F.lit(False))).cast("int")).over(w))
    item = F.sort_array(F.collect_list(F.struct("start", "end", "word")))
    return runs.groupBy("file", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(item, lambda x: x["word"]), "").alias("word")).drop("g")


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """id (the file's name without its ending) and its lines joined by spaces; an empty file has an empty text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    files = files.unionByName(list_files(spark, path).filter("size = 0").select("name", F.lit("").alias("value")))
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), F.trim(F.regexp_replace("value", r"\s*\n\s*", " ")).alias("text"))


def list_audio(spark: SparkSession, path: str, endings: tuple[str, ...] = ("wav", "mp3", "flac", "ogg")) -> DataFrame:
    """id and path of a folder's audio files, without reading them; empty files count."""
    files = list_files(spark, path, True).filter(F.lower("name").rlike(rf"\.({'|'.join(endings)})$"))
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), "path")


def parse_ranges(spec: Column) -> Column:
    """file:start-end[,start-end...] as an array of struct(file, start, end); no ranges means the whole file."""
    file = F.regexp_extract(spec, r"^(.*?)(?::[0-9.]+-[0-9.]+(?:,[0-9.]+-[0-9.]+)*)?$", 1)
    found = F.regexp_extract_all(F.regexp_extract(spec, r":([0-9.,-]+)$", 1), F.lit(r"[0-9.]+-[0-9.]+"), F.lit(0))
    one = lambda r: F.struct(file.alias("file"), F.get(F.split(r, "-"), F.lit(0)).cast("double").alias("start"), F.get(F.split(r, "-"), F.lit(1)).cast("double").alias("end"))
    whole = F.array(F.struct(file.alias("file"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")))
    return F.when(F.size(found) > 0, F.transform(found, one)).otherwise(whole)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """step, epoch, metric and value of a trainer's JSON log_history."""
    history = F.from_json(F.get_json_object("value", "$.log_history"), "array<map<string,string>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(history).alias("m"))
    rows = rows.select(F.col("m")["step"].cast("long").alias("step"), F.col("m")["epoch"].cast("double").alias("epoch"), F.explode("m").alias("metric", "value"))
    return rows.filter(~F.col("metric").isin("step", "epoch")).select("step", "epoch", "metric", F.col("value").try_cast("double").alias("value")).filter("value is not null")
