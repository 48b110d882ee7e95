"""Renderings of diarized turns: arrays of struct(speaker, start, end, text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.text import seconds_clock

TURNS = "array<struct<speaker:int,start:double,end:double,text:string>>"


def _letter(n: Column) -> Column:
    return F.char(F.lit(64) + n)


def _lines(turns: Column, line, separator: str = "\n") -> Column:
    return F.array_join(F.transform(turns, line), separator)


def _srt_clock(seconds: Column) -> Column:
    return F.replace(seconds_clock(seconds), F.lit("."), F.lit(","))


#: name -> turns to text
STYLES = {
    "letter": lambda t: _lines(t, lambda x: F.concat(_letter(x["speaker"]), F.lit(": "), x["text"])),
    "number": lambda t: _lines(t, lambda x: F.concat(F.lit("S"), x["speaker"].cast("string"), F.lit(": "), x["text"])),
    "speaker": lambda t: _lines(t, lambda x: F.concat(F.lit("Speaker "), x["speaker"].cast("string"), F.lit(": "), x["text"])),
    "bracket": lambda t: _lines(t, lambda x: F.concat(F.lit("[S"), x["speaker"].cast("string"), F.lit("] "), x["text"])),
    "tag": lambda t: _lines(t, lambda x: F.concat(F.lit("<s"), x["speaker"].cast("string"), F.lit(">"), x["text"], F.lit("</s"), x["speaker"].cast("string"), F.lit(">")), ""),
    "inline": lambda t: _lines(t, lambda x: F.concat(F.lit("("), _letter(x["speaker"]), F.lit(") "), x["text"]), " "),
    "dash": lambda t: _lines(t, lambda x: F.concat(F.lit("- "), x["text"])),
    "markdown": lambda t: _lines(t, lambda x: F.concat(F.lit("**Speaker "), x["speaker"].cast("string"), F.lit("**: "), x["text"])),
    "timed": lambda t: _lines(t, lambda x: F.concat(F.lit("["), seconds_clock(x["start"]), F.lit(" - "), seconds_clock(x["end"]), F.lit("] "), _letter(x["speaker"]), F.lit(": "), x["text"])),
    "seconds": lambda t: _lines(t, lambda x: F.format_string("%.2f-%.2f S%d: %s", x["start"], x["end"], x["speaker"], x["text"])),
    "tsv": lambda t: _lines(t, lambda x: F.format_string("%.2f\t%.2f\tS%d\t%s", x["start"], x["end"], x["speaker"], x["text"])),
    "rttm": lambda t: _lines(t, lambda x: F.format_string("SPEAKER rec 1 %.3f %.3f <NA> <NA> S%d <NA> <NA>", x["start"], x["end"] - x["start"], x["speaker"])),
    "srt": lambda t: F.array_join(F.transform(t, lambda x, i: F.concat(F.format_string("%d\n", i + 1), _srt_clock(x["start"]), F.lit(" --> "), _srt_clock(x["end"]), F.lit("\n"), _letter(x["speaker"]), F.lit(": "), x["text"])), "\n\n"),
    "vtt": lambda t: F.concat(F.lit("WEBVTT\n\n"), _lines(t, lambda x: F.concat(seconds_clock(x["start"]), F.lit(" --> "), seconds_clock(x["end"]), F.lit("\n<v S"), x["speaker"].cast("string"), F.lit(">"), x["text"]), "\n\n")),
    "json": lambda t: F.to_json(F.transform(t, lambda x: F.struct(F.concat(F.lit("S"), x["speaker"].cast("string")).alias("speaker"), x["text"].alias("text")))),
    "json_timed": lambda t: F.to_json(t),
    "csv": lambda t: F.concat(F.lit("speaker;start;end;text\n"), _lines(t, lambda x: F.format_string("S%d;%.2f;%.2f;%s", x["speaker"], x["start"], x["end"], F.replace(x["text"], F.lit(";"), F.lit(",")))))
}


def render(turns: Column, style: str) -> Column:
    """The turns in one of the STYLES."""
    if style not in STYLES:
        raise ValueError(f"no style {style}")
    return STYLES[style](turns)
