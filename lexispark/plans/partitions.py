"""Queries of splits, shards, buckets and samples, and of turn arrays and their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import nested as N
from lexispark.operators import partition as S
from lexispark.operators import validate as V
from lexispark.plans.common import table


def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", S.hash_split(F.col("doc_id"), 0.1, 0.1).alias("split"))


def listed_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.listed_split(F.col("c_mktsegment"), {"test": ["BUILDING"]}, {"dev": "^AUTO"}).alias("split"))


def ratio_split(spark, d):
    spk = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", S.speaker_split(spk, F.col("doc_id"), {"train": 0.8, "dev": 0.1, "test": 0.1}, 3).alias("split"))


def dev_speakers(spark, d):
    return S.dev_speakers(table(spark, d, "lineitem"), "l_suppkey", 0.13, 1)


def shards(spark, d):
    return S.shards_of_size(table(spark, d, "documents").select("doc_id", "lang", "source"), ["doc_id"], 64)


def even_shards(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "source")
    return S.even_shards(t, ["doc_id"], 7, t.count())


def duration_buckets(spark, d):
    q = F.col("l_quantity")
    df = table(spark, d, "lineitem").select(S.linear_bucket(q, 1, 50, 8).alias("linear"), S.log_bucket(q, 0.9, 51, 8).alias("log"), S.hybrid_bucket(q, 1, 10.5, 51, 4, 4).alias("hybrid"))
    return df.groupBy("linear", "log", "hybrid").agg(F.count(F.lit(1)).alias("n"))


def equal_total_bins(spark, d):
    return S.equal_total_buckets(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 6).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


def duration_fill(spark, d):
    return S.duration_fill(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 500.0)


def disjoint_split(spark, d):
    """Runs of eight orders as speakers and of fifty as audio: they share borders every two hundred."""
    li = table(spark, d, "lineitem").select(F.expr("l_orderkey div 8").alias("speaker"), F.expr("l_orderkey div 50").alias("audio"))
    return S.disjoint_split(li, "speaker", "audio", li.filter("speaker in (11, 60)"))


def head_proportion(spark, d):
    return S.head(table(spark, d, "documents").select("doc_id"), ["doc_id"], 0.05).unionByName(S.tail(table(spark, d, "documents").select("doc_id"), ["doc_id"], 10))


def random_rows(spark, d):
    return S.random_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], 50, 9)


def topk_longest(spark, d):
    return S.longest(table(spark, d, "documents").select("doc_id", "n_chars", "text"), "n_chars", "text", ["doc_id"], 25).select("doc_id", "n_chars")


def first_per_source(spark, d):
    return S.first_per_key(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 3)


def oversample(spark, d):
    w = F.when(F.col("lang") == "en", 0.3).when(F.col("lang") == "fr", 2.5).otherwise(1.0)
    return S.oversample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", w).select("doc_id", "lang", "copy")


def prompt_choice(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.weighted_choice(["conv_id", "turn"], {"json": 5.0, "generic": 40.0, "plain": 55.0}, 2).alias("prompt"))


def pair_sampling(spark, d):
    """Rows only: pairs are checked by the tests."""
    df = table(spark, d, "events").select(F.col("user_id").alias("spk"), F.col("event_type").alias("session"), F.col("event_id").alias("utt"))
    return S.balanced_pairs(df, "spk", "session", "utt")


def microbatches(spark, d):
    n = S.numbered(table(spark, d, "events").select("event_id", "value"), ["event_id"], "i")
    return n.groupBy(F.expr("i div 128").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def _turns(spark, d):
    kind = F.when(F.col("turn") % 3 == 1, "audio").otherwise("text")
    role = F.when(F.col("role") == "assistant", "Assistant").otherwise("User")
    value = F.when(kind == "audio", F.concat(F.lit("/old/"), F.col("conv_id").cast("string"), F.lit(".wav"))).otherwise(F.col("text"))
    t = N.turn(role, value, kind, F.when(kind == "audio", F.length("text") / 10.0))
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", t.alias("t")).alias("x"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("conv_id", F.transform("x", lambda y: y["t"]).alias("turns"))


def first_audio_text_context(spark, d):
    t = F.col("turns")
    return _turns(spark, d).select("conv_id", N.first_audio(t)["value"].alias("audio"), F.md5(N.first_text(t)["value"]).alias("text"), F.md5(N.context(t)["value"]).alias("context"), F.round(N.audio_duration(t), 3).alias("duration"))


def duration_bounds(spark, d):
    return _turns(spark, d).filter(N.audio_duration(F.col("turns")).between(10, 40)).select("conv_id")


def explode_audio(spark, d):
    rows = _turns(spark, d).select("conv_id", F.posexplode("turns").alias("pos", "t"))
    return rows.filter("t.type = 'audio'").select("conv_id", "pos", F.col("t.value").alias("path"), F.col("t.duration").alias("duration"))


def rewritten_paths(spark, d):
    moved, n = N.rewrite_prefix(F.col("turns"), "/old/", "/new/place/")
    return _turns(spark, d).select("conv_id", n.alias("n"), F.array_join(F.transform(F.filter(moved, lambda t: t["type"] == "audio"), lambda t: t["value"]), ";").alias("paths"))


def turn_surgery(spark, d):
    t = F.col("turns")
    ctx = N.turn(F.lit("User"), F.lit("Listen."), F.lit("text"))
    kinds = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["from"], x["type"])), " ")
    return _turns(spark, d).select("conv_id", kinds(N.swap_first_two(t)).alias("swapped"), kinds(N.set_context(N.swap_first_two(t), ctx)).alias("with_context"), kinds(N.with_system(t, "Be brief.")).alias("with_system"))


def flat_to_turns(spark, d):
    li = table(spark, d, "lineitem")
    t = N.from_flat(F.concat(F.lit("/a/"), F.col("l_orderkey").cast("string")), F.col("l_quantity"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")), F.col("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber", F.get(t, F.lit(0))["value"].alias("audio"), F.get(t, F.lit(0))["offset"].alias("offset"), F.get(t, F.lit(1))["value"].alias("text"), F.size(t).alias("n"))


def randomised_turns(spark, d):
    """Rows only: the choice of runs is a hash."""
    df = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 < 3, "user").otherwise("assistant").alias("role"), F.when(F.col("turn") % 2 == 0, "text").otherwise("audio").alias("kind"))
    return N.shuffle_user_runs(df, "conv_id", "turn", "role", "kind")


def last_turn_check(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last")).filter("last <> 'assistant'").select("conv_id", "last")


def manifest_rules(spark, d):
    df = _turns(spark, d).withColumn("duration", F.when(F.col("conv_id") % 5 == 0, None).when(F.col("conv_id") % 7 == 0, "abc").otherwise("1.5")).withColumn("offset", F.when(F.col("conv_id") % 3 == 0, "x"))
    return V.split_valid(df, V.turn_rules(600))[1].select("conv_id", F.array_join("_errors", ",").alias("errors"))


def file_rules(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 2, F.col("l_tax") * 100).alias("offset"), F.col("l_quantity").alias("duration"))
    probe = table(spark, d, "orders").filter("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 8000).alias("file_duration"),
                                                                             F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1).alias("channels"), F.when(F.col("o_orderkey") % 6 == 0, 8000).otherwise(16000).alias("rate"))
    joined = df.join(probe, "l_orderkey", "left")
    return V.split_valid(joined, V.file_rules())[1].select(F.explode("_errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def early_stop(spark, d):
    df = table(spark, d, "events").select("user_id", "event_id", "value")
    stop = V.until_bad_line(df, "user_id", "event_id", F.col("value") > 95)
    return V.until_errors(stop, "user_id", "event_id", F.col("value") > 60, 5).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def folder_invariants(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("utt"), F.col("l_orderkey").alias("rec"), "l_quantity", "l_tax")
    return V.folder_invariants(li.filter("l_quantity > 2").select("utt").distinct(), li.select("utt", "rec"), li.filter("l_tax > 0.01").select("utt").distinct(),
                               table(spark, d, "orders").filter("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("rec")))


QUERIES = {f.__name__: f for f in (
    hash_split, listed_split, ratio_split, dev_speakers, shards, even_shards, duration_buckets, equal_total_bins, duration_fill, disjoint_split, head_proportion,
    random_rows, topk_longest, first_per_source, oversample, prompt_choice, pair_sampling, microbatches, first_audio_text_context, duration_bounds, explode_audio,
    rewritten_paths, turn_surgery, flat_to_turns, randomised_turns, last_turn_check, manifest_rules, file_rules, early_stop, folder_invariants,
)}


def _u(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_MD5 = "md5(doc_id::VARCHAR)"
_MOD = "0"
for _i in range(4):
    _MOD = f"(({_MOD} * 296 + ('0x' || substr({_MD5}, {1 + 8 * _i}, 8))::BIGINT) % 1000)"
_T = """t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END AS who, CASE WHEN turn % 3 = 1 THEN 'audio' ELSE 'text' END AS kind,
CASE WHEN turn % 3 = 1 THEN '/old/' || conv_id || '.wav' ELSE text END AS value, CASE WHEN turn % 3 = 1 THEN length(text) / 10.0::DOUBLE END AS dur FROM conversations)"""
ORACLES = {
    "hash_split": f"""SELECT doc_id, CASE WHEN {_MOD} / 1000.0::DOUBLE < 0.1::DOUBLE THEN 'test' WHEN {_MOD} / 1000.0::DOUBLE < 0.2::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "listed_split": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' WHEN c_mktsegment LIKE 'AUTO%' THEN 'dev' ELSE 'train' END AS split FROM customer""",
    "ratio_split": f"""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN {_u("source", 3)} ELSE {_u("doc_id", 3)} END AS u FROM documents)
SELECT doc_id, CASE WHEN u < 1.0::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE THEN 'train' WHEN u < 1.0::DOUBLE - 0.1::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM u""",
    "dev_speakers": f"""WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem), r AS (SELECT l_suppkey, row_number() OVER (ORDER BY {_u("l_suppkey", 1)}, l_suppkey) AS k, count(*) OVER () AS n FROM s)
SELECT l_suppkey, CASE WHEN k <= greatest(1, round(n * 0.13)) THEN 'dev' ELSE 'train' END AS split FROM r""",
    "shards": """SELECT doc_id, lang, source, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS shard FROM documents""",
    "even_shards": """WITH n AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, (count(*) OVER ()) // 7 AS size FROM documents) SELECT doc_id, lang, source, (i // size)::BIGINT AS shard FROM n WHERE i < size * 7""",
    "duration_buckets": """WITH b AS (SELECT least(floor((l_quantity - 1) / (49 / 8.0::DOUBLE)), 7)::INT AS linear, least(floor((ln(l_quantity) - ln(0.9::DOUBLE)) / ((ln(51.0::DOUBLE) - ln(0.9::DOUBLE)) / 8)), 7)::INT AS log,
CASE WHEN l_quantity < 10.5 THEN least(floor((l_quantity - 1) / (9.5::DOUBLE / 4)), 3)::INT ELSE 4 + least(floor((ln(l_quantity) - ln(10.5::DOUBLE)) / ((ln(51.0::DOUBLE) - ln(10.5::DOUBLE)) / 4)), 3)::INT END AS hybrid FROM lineitem)
SELECT linear, log, hybrid, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "equal_total_bins": """WITH s AS (SELECT l_quantity AS v, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT v, s, n, least(floor(coalesce(sum(s) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(s) OVER () * 6), 5)::INT AS bucket FROM s)
SELECT bucket, sum(n)::BIGINT AS n, sum(s) AS total FROM b GROUP BY 1""",
    "duration_fill": """WITH RECURSIVE p AS (SELECT l_orderkey, sum(l_quantity) AS d, row_number() OVER (ORDER BY l_orderkey) AS i FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, d, i, d AS s, 0 AS split FROM p WHERE i = 1 UNION ALL SELECT p.l_orderkey, p.d, p.i, CASE WHEN s + p.d > 500 THEN p.d ELSE s + p.d END, CASE WHEN s + p.d > 500 THEN split + 1 ELSE split END FROM r JOIN p ON p.i = r.i + 1)
SELECT l_orderkey, d AS duration, split FROM r""",
    "disjoint_split": """WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey // 8 AS s, l_orderkey // 50 AS a FROM lineitem),
r AS (SELECT DISTINCT s FROM p WHERE s IN (11, 60) UNION SELECT b.s FROM r JOIN p a ON a.s = r.s JOIN p b ON b.a = a.a)
SELECT DISTINCT s AS speaker, CASE WHEN s IN (SELECT s FROM r) THEN 'test' ELSE 'train' END AS split FROM p""",
    "head_proportion": """(SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT floor(count(*) * 0.05)::BIGINT FROM documents)) UNION ALL (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10)""",
    "random_rows": f"""SELECT doc_id FROM documents ORDER BY {_u("doc_id", 9)}, doc_id LIMIT 50""",
    "topk_longest": """SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, length(text) DESC, doc_id LIMIT 25""",
    "first_per_source": """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3""",
    "oversample": f"""WITH w AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0.3::DOUBLE WHEN 'fr' THEN 2.5::DOUBLE ELSE 1 END AS w FROM documents),
c AS (SELECT doc_id, lang, unnest(range(0, floor(w)::BIGINT + CASE WHEN {_u("doc_id", 45)} < w - floor(w) THEN 1 ELSE 0 END)) AS copy FROM w)
SELECT doc_id || CASE WHEN copy = 0 THEN '' ELSE '_' || copy END AS doc_id, lang, copy FROM c""",
    "prompt_choice": f"""WITH u AS (SELECT conv_id, turn, {_u("conv_id || '|' || turn", 2)} * 100 AS u FROM conversations) SELECT conv_id, turn, CASE WHEN u < 5 THEN 'json' WHEN u < 45 THEN 'generic' ELSE 'plain' END AS prompt FROM u""",
    "microbatches": """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT (i // 128)::BIGINT AS batch, count(*) AS n, min(event_id) AS first FROM n GROUP BY 1""",
    "first_audio_text_context": f"""WITH {_T}, a AS (SELECT conv_id, min(turn) FILTER (kind = 'audio') AS t0, arg_min(kind, turn) AS k0, arg_min(value, turn) AS v0, coalesce(sum(dur), 0) AS d FROM t GROUP BY 1),
x AS (SELECT t.conv_id, arg_min(value, turn) FILTER (turn = t0) AS audio, arg_min(value, turn) FILTER (turn > t0 AND kind = 'text') AS text FROM t JOIN a ON t.conv_id = a.conv_id GROUP BY 1)
SELECT a.conv_id, audio, md5(text) AS text, CASE WHEN k0 = 'text' THEN md5(v0) END AS context, round(d, 3) AS duration FROM a JOIN x ON x.conv_id = a.conv_id""",
    "duration_bounds": f"""WITH {_T} SELECT conv_id FROM t GROUP BY 1 HAVING coalesce(sum(dur), 0) BETWEEN 10 AND 40""",
    "explode_audio": f"""WITH {_T}, n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos FROM t) SELECT conv_id, pos, value AS path, dur AS duration FROM n WHERE kind = 'audio'""",
    "rewritten_paths": f"""WITH {_T} SELECT conv_id, count(*) FILTER (kind = 'audio')::INT AS n, coalesce(string_agg(replace(value, '/old/', '/new/place/'), ';' ORDER BY turn) FILTER (kind = 'audio'), '') AS paths FROM t GROUP BY 1""",
    "turn_surgery": f"""WITH {_T}, l AS (SELECT conv_id, list(who || ':' || kind ORDER BY turn) AS l, list(kind ORDER BY turn) AS k FROM t GROUP BY 1),
s AS (SELECT conv_id, l, CASE WHEN k[1] = 'text' AND k[2] = 'audio' THEN list_concat([l[2], l[1]], l[3:]) ELSE l END AS w FROM l)
SELECT conv_id, array_to_string(w, ' ') AS swapped, CASE WHEN w[1] LIKE '%:audio' THEN 'User:text ' ELSE '' END || array_to_string(w, ' ') AS with_context, 'system:text ' || array_to_string(l, ' ') AS with_system FROM s""",
    "flat_to_turns": """SELECT l_orderkey, l_linenumber, '/a/' || l_orderkey AS audio, CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE 0 END AS "offset", l_returnflag AS text, 2 AS n FROM lineitem""",
    "last_turn_check": """SELECT conv_id, arg_max(role, turn) AS last FROM conversations GROUP BY 1 HAVING arg_max(role, turn) <> 'assistant'""",
    "manifest_rules": f"""WITH {_T}, c AS (SELECT conv_id, arg_max(who, turn) AS last, max(length(value)) AS m FROM t GROUP BY 1),
e AS (SELECT conv_id, 'invalid_duration' AS e FROM c WHERE conv_id % 5 = 0 OR conv_id % 7 = 0 UNION ALL SELECT conv_id, 'invalid_offset' FROM c WHERE conv_id % 3 = 0
UNION ALL SELECT conv_id, 'wrong_last_turn' FROM c WHERE last <> 'Assistant' UNION ALL SELECT conv_id, 'long_text' FROM c WHERE m > 600) SELECT conv_id, string_agg(e, ',' ORDER BY e) AS errors FROM e GROUP BY 1""",
    "file_rules": """WITH x AS (SELECT CASE WHEN l_linenumber > 2 THEN l_tax * 100 END AS o, l_quantity AS d, o_totalprice / 8000 AS f, o_orderkey AS k FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 10 > 0)
SELECT error, count(*) AS n FROM (SELECT 'missing_file' AS error FROM x WHERE f IS NULL UNION ALL SELECT 'segment_out_of_bounds' FROM x WHERE coalesce(o, 0) > 0 AND o + d > f + 0.5
UNION ALL SELECT 'duration_mismatch' FROM x WHERE coalesce(o, 0) = 0 AND d > f + 0.5 UNION ALL SELECT 'wrong_channels' FROM x WHERE k % 4 = 0 UNION ALL SELECT 'wrong_rate' FROM x WHERE k % 6 = 0) GROUP BY 1""",
    "early_stop": """WITH f AS (SELECT *, min(CASE WHEN value > 95 THEN event_id END) OVER (PARTITION BY user_id) AS b FROM events),
g AS (SELECT *, coalesce(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM f WHERE b IS NULL OR event_id < b)
SELECT user_id, count(*) AS n FROM g WHERE e < 5 GROUP BY 1""",
    "folder_invariants": """WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS utt, l_orderkey AS rec, l_quantity AS q, l_tax AS x FROM lineitem), t AS (SELECT DISTINCT utt FROM li WHERE q > 2), s AS (SELECT DISTINCT utt FROM li WHERE x > 0.01)
SELECT 'text_not_unique' AS rule, 0::BIGINT AS n UNION ALL SELECT 'segments_not_unique', count(*) FROM (SELECT utt FROM li GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'segment_without_text', count(*) FROM li WHERE utt NOT IN (SELECT utt FROM t)
UNION ALL SELECT 'text_without_segment', 0 UNION ALL SELECT 'text_without_speaker', count(*) FROM t WHERE utt NOT IN (SELECT utt FROM s) UNION ALL SELECT 'recording_without_audio', count(DISTINCT rec) FROM li WHERE rec NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 > 0)
UNION ALL SELECT 'illegal_id', 0""",
}
