"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import aggregate as A
from lexispark.plans.common import table


def stats_by_source(spark, d):
    df = table(spark, d, "documents")
    return A.with_total(df, "source", [*A.summary("n_chars"), F.count_distinct("lang").alias("n_langs")])


def stats_by_manifest_total(spark, d):
    """Per-source counts and a total whose n_distinct is the sum of the sources' own, beside the true one."""
    df = table(spark, d, "documents")
    per = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_distinct"), F.sum("n_chars").alias("chars"))
    total = per.agg(F.lit("TOTAL").alias("source"), F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.sum("chars").alias("chars"))
    return per.unionByName(total).select("source", "n", "n_distinct", "chars", F.format_string("%d:%02d:%06.3f", F.floor(F.col("chars") / 3600000), F.floor(F.col("chars") / 60000) % 60, (F.col("chars") % 60000) / 1000).alias("clock"))


def recording_stats_rollup(spark, d):
    df = table(spark, d, "lineitem").withColumn("dur", F.col("l_quantity") - 1)
    return A.roll_up(A.recording_stats(df, "l_orderkey", "dur", ["l_returnflag"]), "l_returnflag")


def duration_histogram(spark, d):
    return A.histogram(table(spark, d, "events"), "value", 60)


def duration_histogram_range(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_quantity", 10, 5, 40)


def dataset_duration(spark, d):
    li = table(spark, d, "lineitem")
    parts = [A.dataset_duration(li, "l_quantity", m).select(F.lit(m).alias("mode"), "duration") for m in ("sum", "min", "max")]
    parts += [A.dataset_duration(li, "l_quantity", m, "l_orderkey").select(F.lit(m + "_rec").alias("mode"), "duration") for m in ("sum", "max")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_ids(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.count_distinct("l_orderkey").alias("recordings"), F.count_distinct("l_orderkey", "l_linenumber").alias("utterances"), F.count_distinct("l_suppkey").alias("speakers"))


def spk2utt(spark, d):
    return A.grouped_list(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey")


def speaker_stats(spark, d):
    df = table(spark, d, "events")
    return df.groupBy("user_id").agg(F.round(F.sum("value"), 3).alias("duration"), F.count(F.lit(1)).alias("n_segments"))


def vote_winner(spark, d):
    df = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    weight = F.when(F.col("value") > 50, 1.0).when(F.col("value") > 20, 0.5).otherwise(0.1)
    return A.weighted_vote(df, ["user_id"], "event_type", F.round(weight, 1), "event_id").select("user_id", "event_type", F.round("score", 3).alias("score"), "first_row")


def speaker_gender(spark, d):
    df = table(spark, d, "lineitem").withColumn("label", F.when(F.col("l_linestatus") == "O", "m").otherwise("f"))
    seconds = F.least(F.lit(10.0), F.col("l_quantity"))
    out = df.groupBy("l_suppkey").agg(F.sum(F.when(F.col("label") == "m", seconds).otherwise(0.0)).alias("m"), F.sum(F.when(F.col("label") == "f", seconds).otherwise(0.0)).alias("f"))
    return out.select("l_suppkey", F.when(F.col("m") > F.col("f"), "m").otherwise("f").alias("gender"))


def majority_status(spark, d):
    return A.majority_class(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "O", "F", default="P")


def label_f1(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    guess = (F.col("n_chars") % 2 == 0).cast("int")
    c = lambda cond: F.count_if(cond).alias
    counts = df.groupBy("lang").agg(
        c((guess == 1) & (F.col("quality") == 1))("tp"), c((guess == 1) & (F.col("quality") == 0))("fp"), c((guess == 0) & (F.col("quality") == 1))("fn")
    )
    return counts.select("*", *[v.alias(k) for k, v in A.f1(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def duration_weighted_score(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("score"), F.avg("l_tax").alias("confidence"))


def char_vocab(spark, d):
    return A.characters(table(spark, d, "documents"), "text")


def dataset_meta(spark, d):
    """Samples and hours, with and without the duplicates that a weight of 2 makes."""
    df = table(spark, d, "lineitem").withColumn("weight", F.when(F.col("l_returnflag") == "R", 2).otherwise(1))
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        (F.sum("l_quantity") / 3600).alias("hours"),
        F.sum("weight").alias("samples_dup"),
        (F.sum(F.col("l_quantity") * F.col("weight")) / 3600).alias("hours_dup"),
    )


def metadata_samples(spark, d):
    df = table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    return A.metadata_samples(df, "m", 10).select("key", F.array_join("examples", ",").alias("examples"))


def path_common_prefix(spark, d):
    return A.common_prefix(table(spark, d, "part").select(F.concat(F.lit("/data/corpus/part_"), F.col("p_partkey").cast("string"), F.lit("/a.wav")).alias("p")), "p")


def issue_counters(spark, d):
    df = table(spark, d, "lineitem").withColumn(
        "status", F.when(F.col("l_quantity") < 3, "too_short").when(F.col("l_discount") > 0.09, "mismatch").when(F.col("l_tax") > 0.07, "long_text")
    )
    return A.issue_counts(df, ["l_returnflag"], "status", ["too_short"], ["mismatch"], 0.1)


def text_per_group(spark, d):
    """Turns of a conversation joined in order, with the span of their numbers."""
    df = table(spark, d, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return df.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda t: t["text"]), " ")).alias("digest"), F.min("turn").alias("first"), F.max("turn").alias("last"))


QUERIES = {f.__name__: f for f in (
    stats_by_source, stats_by_manifest_total, recording_stats_rollup, duration_histogram, duration_histogram_range, dataset_duration, distinct_ids, spk2utt,
    speaker_stats, vote_winner, speaker_gender, majority_status, label_f1, duration_weighted_score, char_vocab, dataset_meta, metadata_samples,
    path_common_prefix, issue_counters, text_per_group,
)}

_SUMMARY = """count(x) AS "count", min(x) AS "min", max(x) AS "max", avg(x) AS mean, stddev_pop(x) AS std, sum(x) AS "sum", """ + ", ".join(
    f"quantile_cont(x, {p / 100}) AS p{p}" for p in A.PERCENTILES
)
ORACLES = {
    "stats_by_source": f"""WITH t AS (SELECT source, n_chars::DOUBLE AS x, lang FROM documents)
SELECT source, {_SUMMARY}, count(DISTINCT lang) AS n_langs FROM t GROUP BY source UNION ALL SELECT 'TOTAL', {_SUMMARY}, count(DISTINCT lang) FROM t""",
    "stats_by_manifest_total": """WITH p AS (SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source),
u AS (SELECT * FROM p UNION ALL SELECT 'TOTAL', sum(n)::BIGINT, sum(n_distinct)::BIGINT, sum(chars)::BIGINT FROM p)
SELECT *, printf('%d:%02d:%06.3f', chars // 3600000, (chars // 60000) % 60, (chars % 60000) / 1000.0) AS clock FROM u""",
    "recording_stats_rollup": """WITH s AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_recordings, count(*) AS n_segments, sum(l_quantity - 1) AS total,
min(CASE WHEN l_quantity - 1 > 0 THEN l_quantity - 1 END) AS shortest, greatest(max(l_quantity - 1), 0.0) AS longest FROM lineitem GROUP BY 1)
SELECT * FROM s UNION ALL SELECT 'TOTAL', sum(n_recordings)::BIGINT, sum(n_segments)::BIGINT, sum(total), min(shortest), max(longest) FROM s""",
    "duration_histogram": """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(floor((value - lo) / ((hi - lo) / 60)), 59)::INT AS bin, lo, (hi - lo) / 60 AS w FROM events, e)
SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS n FROM b GROUP BY bin, lo, w""",
    "duration_histogram_range": """WITH b AS (SELECT least(floor((l_quantity - 5) / 3.5::DOUBLE), 9)::INT AS bin FROM lineitem WHERE l_quantity BETWEEN 5 AND 40)
SELECT bin, 5.0::DOUBLE + bin * 3.5::DOUBLE AS low, 5.0::DOUBLE + (bin + 1) * 3.5::DOUBLE AS high, count(*) AS n FROM b GROUP BY bin""",
    "dataset_duration": """WITH r AS (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT 'sum' AS mode, sum(l_quantity) AS duration FROM lineitem UNION ALL SELECT 'min', min(l_quantity) FROM lineitem UNION ALL SELECT 'max', max(l_quantity) FROM lineitem
UNION ALL SELECT 'sum_rec', sum(q) FROM r UNION ALL SELECT 'max_rec', max(q) FROM r""",
    "distinct_ids": """SELECT count(DISTINCT l_orderkey) AS recordings, count(DISTINCT (l_orderkey, l_linenumber)) AS utterances, count(DISTINCT l_suppkey) AS speakers FROM lineitem""",
    "spk2utt": """SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS items, count(*) AS n FROM orders GROUP BY 1""",
    "speaker_stats": """SELECT user_id, round(sum(value), 3) AS duration, count(*) AS n_segments FROM events GROUP BY 1""",
    "vote_winner": """WITH s AS (SELECT user_id, event_type, sum(CASE WHEN value > 50 THEN 1.0::DOUBLE WHEN value > 20 THEN 0.5 ELSE 0.1 END) AS score, min(event_id) AS first_row FROM events GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS k FROM s), t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS ties FROM r WHERE k = 1)
SELECT user_id, event_type, round(score, 3) AS score, first_row FROM t WHERE ties = 1 AND score > 1""",
    "speaker_gender": """SELECT l_suppkey, CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN least(10.0, l_quantity) ELSE 0 END) > sum(CASE WHEN l_linestatus <> 'O' THEN least(10.0, l_quantity) ELSE 0 END) THEN 'm' ELSE 'f' END AS gender FROM lineitem GROUP BY 1""",
    "majority_status": """SELECT o_custkey, CASE WHEN a = 0 AND b = 0 THEN 'P' WHEN a > b THEN 'O' ELSE 'F' END AS label FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS a, count(*) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1)""",
    "label_f1": """WITH g AS (SELECT lang, n_chars % 2 = 0 AS y, quality FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (y AND quality = 1) AS tp, count(*) FILTER (y AND quality = 0) AS fp, count(*) FILTER (NOT y AND quality = 1) AS fn FROM g GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c""",
    "duration_weighted_score": """SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS score, avg(l_tax) AS confidence FROM lineitem GROUP BY 1""",
    "char_vocab": """SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1""",
    "dataset_meta": """SELECT count(*) AS samples, sum(l_quantity) / 3600 AS hours, sum(w)::BIGINT AS samples_dup, sum(l_quantity * w) / 3600 AS hours_dup FROM (SELECT l_quantity, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS w FROM lineitem)""",
    "metadata_samples": """WITH p AS (SELECT DISTINCT k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value) AS i FROM p)
SELECT key, string_agg(value, ',' ORDER BY value) AS examples FROM r WHERE i <= 10 GROUP BY key""",
    "path_common_prefix": """SELECT '/data/corpus/' AS prefix""",
    "issue_counters": """WITH s AS (SELECT l_returnflag, CASE WHEN l_quantity < 3 THEN 'too_short' WHEN l_discount > 0.09 THEN 'mismatch' WHEN l_tax > 0.07 THEN 'long_text' ELSE 'ok' END AS st FROM lineitem),
c AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (st <> 'ok') AS problems, count(*) FILTER (st = 'too_short') AS hard, count(*) FILTER (st = 'mismatch') AS soft FROM s GROUP BY 1)
SELECT l_returnflag, n, problems, hard + CASE WHEN soft / n::DOUBLE > 0.1 THEN soft ELSE 0 END AS critical FROM c""",
    "text_per_group": """SELECT conv_id, md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn, coalesce(text, ''))) AS digest, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1""",
}
