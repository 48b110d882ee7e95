"""Queries of speakers, channels and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import diarize as Z
from lexispark.operators import partition as S
from lexispark.plans.common import table
from lexispark.plans.sequences import _S, _segments


def glue_overlapping(spark, d):
    return Z.glue_overlapping(_segments(spark, d), "user_id", "spk", ["start", "event_id"], "start", "end", "text", 4.0, 20.0)


def overlaps_removed(spark, d):
    """Rows only: a fold that SQL has no form for; the tests check it."""
    return Z.remove_overlaps(_segments(spark, d), "user_id", "start", "end", "spk")


def word_speakers(spark, d):
    s = _segments(spark, d)
    words = s.filter("event_id % 2 = 0").select("user_id", "event_id", "start", F.col("start").alias("s"), (F.col("start") + 0.5).alias("end"), F.when(F.col("event_id") % 12 == 0, ".").otherwise("w").alias("word"))
    turns = s.filter("event_id % 2 = 1").select("user_id", "start", "end", F.col("event_id").alias("idx"), F.col("spk").alias("speaker"))
    return Z.word_speakers(words, turns, ["user_id"], "event_id", "word").select("event_id", "speaker")


def merged_channels(spark, d):
    s = _segments(spark, d).withColumn("channel", (F.col("event_id") % 3).cast("int"))
    return Z.merge_channels(s, "user_id", "channel", "start", "end", 3.0, ["event_id"]).select("event_id", "channel", "start", "end")


def speaker_chunks(spark, d):
    return S.speaker_chunks(table(spark, d, "lineitem"), "l_suppkey", 8)


def explicit_lists(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/a/rec"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"))
    return S.split_by_lists(df, "path", {"test": ["rec17", "rec4"], "dev": ["rec30"]}).filter("split is not null").select("o_orderkey", "split")


def row_versions(spark, d):
    return S.versions(table(spark, d, "documents").select("doc_id"), ["doc_id"], 0.25, 4)


def dataset_modes(spark, d):
    name = F.concat(F.lit("corpus_"), F.element_at(F.array(*[F.lit(x) for x in ("train", "dev", "test", "valid", "testimony", "eval")]), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("_v2"))
    return table(spark, d, "part").select("p_partkey", S.dataset_mode(name).alias("mode"))


def translation_contexts(spark, d):
    n = table(spark, d, "nation")
    code = F.when(F.col("n_nationkey") == 0, "fr").when(F.col("n_nationkey") == 1, "en").otherwise(F.lower("n_name"))
    names = n.select(code.alias("code"), F.lower("n_name").alias("name")).join(n.select(code.alias("prompt_lang")))
    templates = n.select(code.alias("prompt_lang"), F.when(F.col("n_nationkey") == 0, "du {source} vers le {target}").otherwise("from {source} to {target}").alias("template"))
    return S.translation_contexts(names, templates)


QUERIES = {f.__name__: f for f in (glue_overlapping, overlaps_removed, word_speakers, merged_channels, speaker_chunks, explicit_lists, row_versions, dataset_modes, translation_contexts)}

_U = "(('0x' || substr(md5('4|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
ORACLES = {
    "glue_overlapping": f"""WITH RECURSIVE {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, spk ORDER BY s, event_id) AS i FROM s),
r AS (SELECT user_id, spk, i, 0 AS g, s AS a, e AS z, text, 1 AS n FROM n WHERE i = 1 UNION ALL
SELECT n.user_id, n.spk, n.i, CASE WHEN f THEN g ELSE g + 1 END, CASE WHEN f THEN a ELSE n.s END, CASE WHEN f THEN greatest(n.e, z) ELSE n.e END, CASE WHEN f THEN r.text || ' ' || n.text ELSE n.text END, CASE WHEN f THEN r.n + 1 ELSE 1 END
FROM r JOIN n ON n.user_id = r.user_id AND n.spk = r.spk AND n.i = r.i + 1, LATERAL (SELECT n.s - z <= 4 AND greatest(n.e, z) - a <= 20 AS f))
SELECT user_id, spk, max(a) AS start, max(z) AS "end", arg_max(text, i) AS text, max(n) AS n FROM r GROUP BY user_id, spk, g""",
    "word_speakers": f"""WITH {_S}, w AS (SELECT *, s AS ws, s + 0.5::DOUBLE AS we FROM s WHERE event_id % 2 = 0), t AS (SELECT * FROM s WHERE event_id % 2 = 1),
j AS (SELECT w.user_id, w.event_id, w.ws, w.we, t.spk, row_number() OVER (PARTITION BY w.event_id ORDER BY least(we, t.e) - greatest(ws, t.s) DESC, t.event_id) AS k FROM w JOIN t ON t.user_id = w.user_id AND ws < t.e AND t.s < we),
m AS (SELECT w.user_id, w.event_id, w.ws, w.we, CASE WHEN w.event_id % 12 <> 0 THEN j.spk END AS spk FROM w LEFT JOIN (SELECT * FROM j WHERE k = 1) j ON j.event_id = w.event_id)
SELECT event_id, coalesce(last_value(spk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ws, we, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(spk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ws, we, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM m""",
    "merged_channels": f"""WITH {_S}, c AS (SELECT *, (event_id % 3)::INT AS channel FROM s), m AS (SELECT *, lag(channel) OVER w AS p, lead(channel) OVER w AS q FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s, channel, event_id)),
kept AS (SELECT * FROM m WHERE NOT coalesce(p = q AND p <> channel AND e - s < 3, false))
SELECT event_id, channel, s AS start, least(e, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, channel, event_id), e)) AS "end" FROM kept""",
    "speaker_chunks": """WITH p AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, (coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 // sum(n) OVER ())::INT AS chunk FROM p""",
    "explicit_lists": """SELECT o_orderkey, CASE WHEN o_orderkey = 30 THEN 'dev' ELSE 'test' END AS split FROM orders WHERE o_orderkey IN (4, 17, 30)""",
    "row_versions": f"""SELECT doc_id, 0 AS version FROM documents UNION ALL SELECT doc_id, 1 FROM documents WHERE {_U} < 0.25""",
    "dataset_modes": """SELECT p_partkey, ['train', 'dev', 'test', 'dev', 'train', 'test'][(p_partkey % 6 + 1)::INT] AS mode FROM part""",
    "translation_contexts": """WITH n AS (SELECT CASE n_nationkey WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE lower(n_name) END AS code, lower(n_name) AS name FROM nation)
SELECT s.code AS source, t.code AS target, p.code AS prompt_lang, CASE WHEN p.code = 'fr' THEN CASE WHEN regexp_matches(s.name, '^[aeiouhéà]') THEN 'de l''' ELSE 'du ' END || s.name || ' vers ' || CASE WHEN regexp_matches(t.name, '^[aeiouhéà]') THEN 'l''' ELSE 'le ' END || t.name
ELSE 'from ' || s.name || ' to ' || t.name END AS context, CASE WHEN p.code IN (s.code, t.code) THEN 0.94 WHEN p.code IN ('en', 'fr') THEN 0.04 ELSE 0.02 END::DOUBLE AS weight FROM n s, n t, n p WHERE s.code <> t.code""",
}
