"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispark.operators import ordered as O
from lexispark.plans.common import epoch_seconds, table


def _segments(spark, d):
    """Events as segments of a recording (user): whole seconds, so that both engines add alike."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(w))
    e = e.withColumn("start", (F.col("k") * 4 + F.col("event_id") % 5).cast("double")).withColumn("end", F.col("start") + 1 + F.floor(F.col("value")) % 7)
    return e.select("user_id", "event_id", F.col("event_type").alias("spk"), "start", F.col("end").cast("double").alias("end"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 4 == 0, ".").otherwise("")).alias("text"))


ORDER = ["start", "event_id"]


def fuse_turns(spark, d):
    return O.fuse_turns(_segments(spark, d), ["user_id"], ORDER, "spk", "start", "end", "text")


def merge_gap_turns(spark, d):
    return O.merge_gap(_segments(spark, d), ["user_id"], ORDER, "spk", "start", "end", 2.0)


def overlaps_lag_lead(spark, d):
    return O.overlap_flags(_segments(spark, d), ["user_id"], ORDER, "spk", "start", "end").select("event_id", "overlap")


def silence_cut(spark, d):
    return O.silence_cut(_segments(spark, d), ["user_id"], ORDER, "start", "end", "text", 2.0).groupBy("user_id", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def drop_included(spark, d):
    return O.drop_included(_segments(spark, d), ["user_id"], ORDER, "end").select("event_id")


def midpoints(spark, d):
    return O.midpoints(_segments(spark, d), ["user_id"], ORDER, "start", "end").select("event_id", "mid_start", "mid_end")


def vad_dilate(spark, d):
    return O.dilate_merge(_segments(spark, d), ["user_id"], "start", "end", 0.5)


def reprojected(spark, d):
    s = _segments(spark, d)
    merged = O.dilate_merge(s, ["user_id"], "start", "end", 0.0)
    times = s.select("user_id", "event_id", (F.col("start") / 2).alias("t"))
    return O.reproject(times, merged, ["user_id"], "t").select("event_id", "original")


def punctuation_glue(spark, d):
    s = _segments(spark, d).withColumn("text", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(", "), F.col("text"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit(".."), F.col("text"))).otherwise(F.col("text")))
    return O.donate_punctuation(s, ["user_id"], ORDER, "text").select("event_id", "text")


def edge_flags(spark, d):
    return O.edge_flags(_segments(spark, d), ["user_id"], ORDER).select("event_id", "is_first", "is_last")


def unique_ids(spark, d):
    return O.unique_ids(_segments(spark, d), "user_id", ["event_id"]).select("event_id", "uid")


def greedy_concat(spark, d):
    return O.glue_segments(_segments(spark, d), ["user_id"], ORDER, "start", "end", "text")


def greedy_windows(spark, d):
    win = O.greedy_windows(_segments(spark, d), ["user_id"], ORDER, "start", "end", ["spk"], 30.0, 6)
    win = O.local_speakers(win, ["user_id", "window"], ORDER, "spk")
    return O.relative_times(win, ["user_id", "window"], "start", "end").select("user_id", "event_id", "window", "local_speaker", "rel_start", "rel_end")


def word_cuts(spark, d):
    """Each user's segments as the words of one long utterance, cut at 20 seconds."""
    s = _segments(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("start", "event_id", "end", F.col("spk").alias("word")))).alias("w"))
    words = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    return O.cut_words(s.select("user_id", words.alias("w")), "user_id", "w", 20.0)


def even_word_times(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit(0.0).alias("s"), F.length("text").cast("double").alias("e"))
    return O.even_words(df, ["conv_id", "turn"], "text", "s", "e")


def stride_cut(spark, d):
    return O.stride_pieces(_segments(spark, d), ["event_id"], "start", "end", "text", 2.5)


def session_windows(spark, d):
    """Extension: event-time sessions with a gap of an hour, and tumbling days."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    # the gap with its fraction; rows without a time join the last session
    order = F.asc_nulls_last("ts")
    gap = epoch_seconds("ts") - F.lag(epoch_seconds("ts")).over(Window.partitionBy("user_id").orderBy(order))
    runs = O.islands(e.withColumn("__gap", gap), ["user_id"], [order], F.col("__gap") > 3600, "session")
    return runs.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    fuse_turns, merge_gap_turns, overlaps_lag_lead, silence_cut, drop_included, midpoints, vad_dilate, reprojected, punctuation_glue, edge_flags, unique_ids,
    greedy_concat, greedy_windows, word_cuts, even_word_times, stride_cut, session_windows,
)}

_S = """k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, event_type AS spk, (k * 4 + event_id % 5)::DOUBLE AS s, (k * 4 + event_id % 5 + 1 + floor(value)::BIGINT % 7)::DOUBLE AS e,
  event_type || CASE WHEN event_id % 4 = 0 THEN '.' ELSE '' END AS text FROM k)"""
_W = "(PARTITION BY user_id ORDER BY s, event_id)"
_N = f"n AS (SELECT *, row_number() OVER {_W} AS i FROM s)"
ORACLES = {
    "fuse_turns": f"""WITH {_S}, b AS (SELECT *, CASE WHEN lag(spk) OVER {_W} <> spk THEN 1 ELSE 0 END AS br FROM s), g AS (SELECT *, sum(br) OVER {_W} AS island FROM b)
SELECT user_id, island::BIGINT AS island, spk, min(s) AS start, arg_max(e, (s, event_id)) AS "end", sum(e - s) AS duration, count(*) AS n, string_agg(text, ' ' ORDER BY s, event_id) AS text FROM g GROUP BY 1, 2, 3""",
    "merge_gap_turns": f"""WITH {_S}, b AS (SELECT *, CASE WHEN lag(spk) OVER {_W} <> spk THEN 1 ELSE 0 END AS br FROM s), g AS (SELECT *, sum(br) OVER {_W} AS run FROM b),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id, run ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
p AS (SELECT *, sum(CASE WHEN s - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY s, event_id) AS part FROM m)
SELECT user_id, spk, min(s) AS start, max(e) AS "end", count(*) AS n FROM p GROUP BY user_id, run, part, spk""",
    "overlaps_lag_lead": f"""WITH {_S} SELECT event_id, coalesce(lag(e) OVER {_W} > s, false) OR coalesce(lead(s) OVER {_W} < e AND lead(spk) OVER {_W} <> spk, false) AS overlap FROM s""",
    "silence_cut": f"""WITH {_S}, b AS (SELECT *, CASE WHEN s - lag(e) OVER {_W} > 2 OR regexp_matches(lag(text) OVER {_W}, '[.?!]$') THEN 1 ELSE 0 END AS br FROM s), g AS (SELECT *, sum(br) OVER {_W} AS segment FROM b)
SELECT user_id, segment::BIGINT AS segment, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY 1, 2""",
    "drop_included": f"""WITH {_S}, b AS (SELECT *, lag(e) OVER {_W} AS p FROM s) SELECT event_id FROM b WHERE p IS NULL OR e > p""",
    "midpoints": f"""WITH {_S} SELECT event_id, coalesce((lag(e) OVER {_W} + s) / 2, 0) AS mid_start, coalesce((e + lead(s) OVER {_W}) / 2, e) AS mid_end FROM s""",
    "vad_dilate": f"""WITH {_S}, w AS (SELECT user_id, greatest(s - 0.5, 0) AS s, e + 0.5 AS e FROM s),
b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w),
g AS (SELECT *, sum(CASE WHEN s > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM b) SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, i""",
    "reprojected": f"""WITH {_S}, b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
g AS (SELECT *, sum(CASE WHEN s > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM b), m AS (SELECT user_id, min(s) AS a, max(e) AS z FROM g GROUP BY user_id, i),
c AS (SELECT *, coalesce(sum(z - a) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM m)
SELECT event_id, a + s.s / 2 - f AS original FROM s LEFT JOIN c ON s.user_id = c.user_id AND s.s / 2 >= f AND s.s / 2 < f + z - a""",
    "punctuation_glue": f"""WITH {_S}, t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN ', ' || text WHEN event_id % 7 = 0 THEN '..' || text ELSE text END AS x FROM s),
m AS (SELECT *, CASE WHEN x LIKE ', %' THEN ',' ELSE '' END AS mark, lag(1) OVER {_W} IS NULL AS first FROM t)
SELECT event_id, CASE WHEN first OR mark = '' THEN x ELSE ltrim(substr(x, 2)) END || coalesce(lead(mark) OVER {_W}, '') AS text FROM m""",
    "edge_flags": f"""WITH {_S} SELECT event_id, lag(1) OVER {_W} IS NULL AS is_first, lead(1) OVER {_W} IS NULL AS is_last FROM s""",
    "unique_ids": f"""WITH {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM s) SELECT event_id, user_id || CASE WHEN i = 1 THEN '' ELSE '_' || i END AS uid FROM n""",
    "greedy_concat": f"""WITH RECURSIVE {_S}, {_N}, r AS (SELECT user_id, i, 0 AS segment, s AS a, e AS z, text, 1 AS n FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, CASE WHEN f THEN segment ELSE segment + 1 END, CASE WHEN f THEN a ELSE n.s END, CASE WHEN f THEN greatest(n.e, z) ELSE n.e END,
  CASE WHEN f THEN r.text || CASE WHEN n.s - z <= 0.2 OR regexp_matches(r.text, '[.,:;?!]$') THEN ' ' WHEN regexp_matches(n.text, '^[A-Z]') THEN '. ' ELSE ', ' END || n.text ELSE n.text END, CASE WHEN f THEN r.n + 1 ELSE 1 END
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1, LATERAL (SELECT n.s - z <= 1 AND greatest(n.e, z) - a <= 30 AS f))
SELECT user_id, segment, max(a) AS start, max(z) AS "end", arg_max(text, i) AS text, max(n) AS n FROM r GROUP BY 1, 2""",
    "greedy_windows": f"""WITH RECURSIVE {_S}, {_N}, r AS (SELECT user_id, i, 0 AS "window", s AS a, 1 AS n, event_id, spk, s, e FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, CASE WHEN f THEN "window" + 1 ELSE "window" END, CASE WHEN f THEN n.s ELSE a END, CASE WHEN f THEN 1 ELSE r.n + 1 END, n.event_id, n.spk, n.s, n.e
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1, LATERAL (SELECT n.e - a > 30 OR r.n >= 6 AS f)),
l AS (SELECT *, min(i) OVER (PARTITION BY user_id, "window", spk) AS f FROM r)
SELECT user_id, event_id, "window", dense_rank() OVER (PARTITION BY user_id, "window" ORDER BY f)::INT AS local_speaker, round(s - min(s) OVER (PARTITION BY user_id, "window"), 2) AS rel_start,
  round(e - min(s) OVER (PARTITION BY user_id, "window"), 2) AS rel_end FROM l""",
    "word_cuts": f"""WITH RECURSIVE {_S}, {_N}, r AS (SELECT user_id, i, 1 AS piece, s AS a, e AS z, spk AS text FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, CASE WHEN f THEN piece + 1 ELSE piece END, CASE WHEN f THEN n.s ELSE a END, n.e, CASE WHEN f THEN n.spk ELSE r.text || ' ' || n.spk END
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1, LATERAL (SELECT n.e - a > 20 AS f))
SELECT user_id, printf('%d_cut%02d', user_id, piece) AS cut_id, max(a) AS start, arg_max(z, i) AS "end", arg_max(text, i) AS text FROM r GROUP BY user_id, piece""",
    "even_word_times": r"""WITH w AS (SELECT conv_id, turn, length(text)::DOUBLE AS d, [x FOR x IN string_split_regex(trim(text), '\s+') IF x <> ''] AS w FROM conversations)
SELECT conv_id, turn, i - 1 AS i, w[i] AS word, (i - 1) * (d / len(w)) AS start, i * (d / len(w)) AS "end" FROM (SELECT *, unnest(range(1, len(w) + 1))::INT AS i FROM w)""",
    "stride_cut": f"""WITH {_S}, p AS (SELECT *, unnest(range(0, greatest(ceil((e - s) / 2.5), 1)::BIGINT)) AS piece FROM s)
SELECT event_id, piece, s + piece * 2.5::DOUBLE AS start, least(e, s + (piece + 1) * 2.5::DOUBLE) AS "end", CASE WHEN piece = 0 THEN text ELSE '' END AS text FROM p""",
    "session_windows": """WITH b AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600 THEN 1 ELSE 0 END AS br FROM events),
g AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM b) SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM g GROUP BY 1, 2""",
}
