"""Queries that write files of the speech formats to the shared folder and read them back with their readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexispark.operators import scratch
from lexispark.plans.sequences import _S, _segments
from lexispark.sources import folder, transcripts


def _place(spark, name):
    return f"{scratch.folder(spark)}/lexispark/{uuid.uuid4().hex}/{name}"


def utterance_folder(spark, d):
    """Every event as an utterance of its user's recording, through a folder's relations and `folder.load`."""
    named = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    user, voice = F.col("user_id").cast("string"), F.col("user_id") % 50
    df = _segments(spark, d).select(
        named("u", F.col("event_id").cast("string")).alias("utt"), named("r", user).alias("rec"), named("/audio/", user, ".wav").alias("path"), "start", "end",
        (F.col("end") - F.col("start")).alias("duration"), named("said  ", F.col("text")).alias("text"), named("s", voice.cast("string")).alias("spk"),
        F.when(voice % 3 == 0, "f").when(voice % 3 == 1, "m").alias("gender"),
    )
    path = _place(spark, "folder")
    folder.save(df, path)
    return folder.load(spark, path)


def rttm_files(spark, d):
    """Events as speaker turns, through RTTM lines."""
    path = _place(spark, "rttm")
    segments = _segments(spark, d).select(F.col("user_id").cast("string").alias("rec"), F.col("spk").alias("speaker"), "start", "end")
    transcripts.rttm_lines(segments).write.text(path)
    return transcripts.read_rttm(spark, path)


def stm_files(spark, d):
    """Events as lines of an STM file, with the speaker's gender for some."""
    path = _place(spark, "stm")
    s = _segments(spark, d)
    gender = F.when(F.col("event_id") % 3 == 0, "<o,f0,female>").when(F.col("event_id") % 3 == 1, "<o,f0,male>").otherwise("<o,,>")
    s.select(F.format_string("rec_%d A spk_%s %.2f %.2f %s %s", "user_id", "spk", "start", "end", gender, "text").alias("value")).write.text(path)
    return transcripts.read_stm(spark, path)


QUERIES = {f.__name__: f for f in (utterance_folder, rttm_files, stm_files)}
ORACLES = {
    "utterance_folder": f"""WITH {_S} SELECT 'u' || event_id AS utt, 'r' || user_id AS rec, '/audio/' || user_id || '.wav' AS path, s AS start, e AS "end", e - s AS duration,
'said ' || text AS text, 's' || user_id % 50 AS spk, CASE user_id % 50 % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' END AS gender FROM s""",
    "rttm_files": f"""WITH {_S} SELECT user_id::VARCHAR AS rec, spk AS speaker, s AS start, e AS "end" FROM s""",
    "stm_files": f"""WITH {_S} SELECT 'rec-' || user_id AS file, 'A' AS channel, replace('spk_' || spk, '_', '-') AS speaker, s AS start, e AS "end",
CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' END AS gender, text FROM s""",
}
