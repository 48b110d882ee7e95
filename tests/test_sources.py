"""Readers and writers, by round trips and small files."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexispark.sources import folder, manifest, transcripts
from tests.conftest import ROOT


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def utterances(tmp_path):
    base = tmp_path / "folder"
    base.mkdir()
    write(base / "text", "u1 bonjour  <noise> à tous\nu2 ok\nu3 sans segment\n")
    write(base / "segments", "u1 r1 0 1.5\nu2 r1 1.5 2.25\n")
    write(base / "wav.scp", "r1 sox $DATA/audio/r1.mp3 -t wav -r 16k - |\nr2 '/a b/r2.wav'\n")
    write(base / "utt2spk", "u1 s1\nu2 s2\n")
    write(base / "spk2gender", "s1 f\n")
    return str(base)


def test_folder(spark, utterances, tmp_path):
    rows = folder.load(spark, utterances, {"DATA": "/data"}).orderBy("utt").collect()
    assert [tuple(r) for r in rows] == [
        ("u1", "r1", "/data/audio/r1.mp3", 0.0, 1.5, 1.5, "bonjour <noise> à tous", "s1", "f"),
        ("u2", "r1", "/data/audio/r1.mp3", 1.5, 2.25, 0.75, "ok", "s2", None),
    ]
    out = str(tmp_path / "saved")
    folder.save(folder.load(spark, utterances, {"DATA": "/data"}), out)
    again = folder.load(spark, out).orderBy("utt").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_minimal_folder(spark, tmp_path):
    write(tmp_path / "text", "a x y\n")
    write(tmp_path / "wav.scp", "a flac -d -c /x/a.flac |\n")
    write(tmp_path / "utt2dur", "a 3.25  \n")
    r = folder.load(spark, str(tmp_path)).first()
    assert (r.start, r.end, r.spk, r.path) == (0.0, 3.25, None, "/x/a.flac")


def test_weighted_list(spark, tmp_path):
    assert folder.read_weighted_list(spark, write(tmp_path / "l.txt", "/a/b    2\n/c\n\n")) == {"/a/b": 2.0, "/c": 1.0}


def test_manifest(spark, tmp_path):
    flat = {"id": "1", "audio_filepath": "/a.wav", "duration": 2.5, "text": "hi", "lang": "en"}
    nested = {"id": "2", "conversations": [{"from": "User", "value": "/b.wav", "type": "audio", "duration": 1.0, "offset": 0.5}, {"from": "Assistant", "value": "yo", "type": "text"}]}
    path = write(tmp_path / "m.jsonl", json.dumps(flat) + "\n" + json.dumps(nested) + "\n{broken\n")
    rows = {r.id: r for r in manifest.read(spark, path).collect()}
    assert rows["1"].turns[0].value == "/a.wav" and rows["1"].turns[0].offset == 0.0 and rows["1"].metadata == {"lang": "en"}
    assert rows["2"].turns[1].value == "yo" and rows["2"].turns[1].duration is None
    assert rows[None]._bad
    good = manifest.read(spark, path).filter("not _bad")
    manifest.write(good, str(tmp_path / "out"), "asr")
    back = {r.id: r for r in manifest.read(spark, str(tmp_path / "out")).collect()}
    assert back["2"].turns[0].duration == 1.0 and back["2"].turns[1].value == "yo"
    manifest.write_cuts(good, str(tmp_path / "cuts"))
    assert spark.read.json(str(tmp_path / "cuts")).count() == 2


def test_paths(monkeypatch):
    assert manifest.expand_shards("x__OP_1..3_CL_.json") == ["x_1.json", "x_2.json", "x_3.json"]
    assert manifest.resolve(["${oc.env:D}/b", "a"], {"D": "/d"}) == ["/d/b", "a"]
    with pytest.raises(KeyError):
        manifest.interpolate("${oc.env:NOPE}", {})


def test_rttm(spark, tmp_path):
    path = write(tmp_path / "x.rttm", "SPEAKER r1 1 0.5 1.25 <NA> <NA> A <NA> <NA>\nSPEAKER\tr1\t1\t2.0\t1.0\t<NA>\t<NA>\tB\t<NA>\n")
    df = transcripts.read_rttm(spark, path)
    assert sorted(tuple(r) for r in df.collect()) == [("r1", "A", 0.5, 1.75), ("r1", "B", 2.0, 3.0)]
    transcripts.rttm_lines(df).write.text(str(tmp_path / "o"))
    assert sorted(tuple(r) for r in transcripts.read_rttm(spark, str(tmp_path / "o")).collect()) == [("r1", "A", 0.5, 1.75), ("r1", "B", 2.0, 3.0)]
    segments, speakers = transcripts.diarization_document(df)
    assert [r.seg_id for r in segments.orderBy("start").collect()] == [1, 2]
    assert {r.speaker: r.duration for r in speakers.collect()} == {"A": 1.25, "B": 1.0}


def test_stm(spark, tmp_path):
    r = transcripts.read_stm(spark, write(tmp_path / "x.stm", ";; c\nf_1 A s_p 0.5 2.0 <o,f0,female> bonjour à tous\n")).first()
    assert tuple(r) == ("f-1", "A", "s-p", 0.5, 2.0, "f", "bonjour à tous")


def test_subtitles(spark, tmp_path):
    path = write(tmp_path / "x.srt", "1\n00:00:01,000 --> 00:00:02,500\nAnna: Hello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nok\n")
    rows = transcripts.read_subtitles(spark, path).orderBy("idx").collect()
    assert [(r.speaker, r.start, r.end, r.text) for r in rows] == [("Anna", 1.0, 2.5, "Hello there"), (None, 3.0, 4.0, "ok")]


def test_textgrid():
    text = 'item [1]:\n name = "S1"\n intervals [1]:\n xmin = 0\n xmax = 1.5\n text = "a ""b"""\n intervals [2]:\n xmin = 1.5\n xmax = 2\n text = ""\n'
    assert transcripts.parse_textgrid(text) == [("S1", 0.0, 1.5, 'a "b"')]


def test_trs():
    text = (
        '<?xml version="1.0" encoding="UTF-8"?><Trans><Speakers><Speaker id="a" name="Ann"/><Speaker id="b" name="Bob"/></Speakers><Episode><Section><Turn speaker="a b" startTime="0" endTime="4">'
        '<Sync time="0"/>hello<Sync time="2"/><Who nb="1"/>yes<Who nb="2"/>no</Turn></Section></Episode></Trans>'
    )
    assert transcripts.parse_trs(text) == [("Ann", 0.0, 2.0, "hello"), ("Ann", 2.0, 4.0, "yes"), ("Bob", 2.0, 4.0, "no")]


def test_tables(spark, tmp_path):
    path = write(tmp_path / "t.csv", "text;start;duration\nb ;2;1\na;0;1.5\n")
    assert [tuple(r) for r in transcripts.read_simple_csv(spark, path).collect()] == [("a", 0.0, 1.5), ("b", 2.0, 3.0)]
    path = write(tmp_path / "l.txt", "id1 the text here\n")
    assert tuple(transcripts.read_lines(spark, path, ["id", "text"]).first()) == ("id1", "the text here")
    path = write(tmp_path / "w.txt", "[0 1] l'\n[1 2] eau\n[2 2.5] .\n[3 4] ok\n")
    assert sorted((r.start, r.end, r.word) for r in transcripts.read_timestamped(spark, path).collect()) == [(0.0, 2.5, "l'eau."), (3.0, 4.0, "ok")]


def test_ranges(spark):
    df = spark.createDataFrame([("a.wav:0-1.5,2-3",), ("b.wav",)], "s string")
    got = [[tuple(x) for x in r[0]] for r in df.select(transcripts.parse_ranges(F.col("s"))).collect()]
    assert got == [[("a.wav", 0.0, 1.5), ("a.wav", 2.0, 3.0)], [("b.wav", None, None)]]


def test_text_folder_and_audio(spark, tmp_path):
    write(tmp_path / "one.txt", "a\nb\n")
    assert tuple(transcripts.read_text_folder(spark, str(tmp_path / "*.txt")).first()) == ("one", "a b")
    write(tmp_path / "two.txt", "")
    assert sorted(tuple(r) for r in transcripts.read_text_folder(spark, str(tmp_path / "*.txt")).collect()) == [("one", "a b"), ("two", "")]
    (tmp_path / "au" / "deep" / "er").mkdir(parents=True)
    write(tmp_path / "au" / "x.wav", "")
    write(tmp_path / "au" / "deep" / "er" / "y.FLAC", "1")
    write(tmp_path / "au" / "z.txt", "1")
    assert sorted(r.id for r in transcripts.list_audio(spark, str(tmp_path / "au")).collect()) == ["x", "y"]


def test_last_text_of_an_id(spark, tmp_path):
    path = write(tmp_path / "text", "a  z  last of all\nb one\na first\n\na  m   middle\n")
    assert {r.utt: r.text for r in folder.read_text(spark, path).collect()} == {"a": "m middle", "b": "one"}


def test_functions_reach_executors(tmp_path):
    """A query with a Python function runs with the driver started in another folder, where the workers can't import the package by themselves."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
from lexispark.functions import numbers
from lexispark.operators import evaluate
df = spark.createDataFrame([("a 2 b", "a b")], "r string, h string")
row = df.select(numbers.to_words(F.col("r"), "en").alias("w"), evaluate.edit_count_column(F.col("r"), F.col("h")).alias("e")).first()
print("GOT", row.w, row.e["del"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GOT a two b 1" in done.stdout, done.stderr[-2000:]


def test_training_log(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps({"log_history": [{"step": 1, "epoch": 0.5, "loss": 2.0}, {"step": 1, "epoch": 0.5, "eval_wer": 0.25}]}))
    assert sorted(tuple(r) for r in transcripts.training_log(spark, path).collect()) == [(1, 0.5, "eval_wer", 0.25), (1, 0.5, "loss", 2.0)]
