"""Queries of the joins, filters, set operators and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import dedup as D
from lexispark.operators import filter as P
from lexispark.operators import join as J
from lexispark.plans.common import epoch_seconds, table


def _old_new(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 3 < 2").select((F.col("o_orderkey") % 500).alias("utt"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("row_idx"))
    new = o.filter("o_orderkey % 3 > 0").select((F.col("o_orderkey") % 700).alias("utt"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("spk"), F.col("o_orderkey").alias("row_idx"))
    return old, new


def merge_keep_last(spark, d):
    return J.keyed_merge(*_old_new(spark, d), ["utt"], "row_idx").select("utt", "status", "price", "spk")


def merge_unmatched(spark, d):
    return J.unmatched(*_old_new(spark, d), ["utt"])


def lookup_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("row_idx"))
    return J.lookup_merge(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "row_idx")


def zip_merge(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("row_idx"), F.col("event_type").alias("lang"), "value")
    b = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), "lang", "n_chars")
    return J.zip_merge(a, b, "row_idx")


def semi_filter_speakers(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi(table(spark, d, "orders"), rich, ["o_custkey"]).select("o_orderkey", "o_custkey")


def anti_missing(spark, d):
    return J.semi(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], True).select("c_custkey")


def folder_load(spark, d):
    """Segments with their recording, text (inner) and speaker (left)."""
    seg = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec"), "l_linenumber", F.col("l_partkey").alias("pk"), F.col("l_quantity").alias("dur"))
    wav = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec"), F.concat(F.lit("/wav/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("spk"))
    text = table(spark, d, "part").filter("p_size < 40").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("text"))
    spk = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("spk"), F.col("c_name").alias("speaker"))
    return seg.join(wav, "rec").join(text, "pk").join(spk, "spk", "left").select("rec", "l_linenumber", "path", "text", "speaker", "dur")


def repair_folder(spark, d):
    seg = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("utt"))
    text = table(spark, d, "lineitem").filter("l_quantity > 5").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("utt"))
    spk = table(spark, d, "lineitem").filter("l_tax < 0.07").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("utt"), F.col("l_suppkey").alias("spk"))
    wav = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("rec"))
    out = J.repair_folder(seg, text, spk, wav)
    return out["utt2spk"].join(out["segments"], "utt").groupBy("spk").agg(F.count_distinct("utt").alias("n_utts"), F.count_distinct("rec").alias("n_recs"))


def _timed(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("start", epoch_seconds("ts")).withColumn("end", F.col("start") + F.col("value"))


def topic_overlap_argmax(spark, d):
    e = _timed(spark, d)
    items = e.filter("event_id % 3 = 0").select("user_id", "event_id", "start", (F.col("start") + F.col("value") * 60).alias("end"))
    spans = e.filter("event_id % 3 = 1").select("user_id", "start", (F.col("start") + F.col("value") * 120).alias("end"), F.col("event_id").alias("idx"))
    return J.best_overlap(items, spans, ["user_id"], ["event_id"], 3600.0).select("user_id", "event_id", "span_idx", F.round("overlap", 3).alias("overlap"))


def linked_span(spark, d):
    """Each order's span of linked line items, clipped."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + F.col("l_linenumber")).alias("e"))
    return table(spark, d, "orders").join(li, "o_orderkey").groupBy("o_orderkey").agg(F.min("s").alias("start"), F.least(F.max("e"), F.lit(50.0)).alias("end"))


def compare_manifests(spark, d):
    o = table(spark, d, "orders")
    parts = {"a": o.filter("o_orderkey % 2 = 0"), "b": o.filter("o_orderkey % 3 = 0"), "c": o.filter("o_orderkey % 5 = 0")}
    return J.compare_many(parts, "o_orderkey", "o_totalprice")


def id_prefix_match(spark, d):
    left = table(spark, d, "customer").select("c_name")
    right = table(spark, d, "orders").select(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") % 50).cast("string"), 9, "0"), F.lit("_"), F.col("o_orderkey").cast("string")).alias("file"))
    return J.prefix_match(left, right, "c_name", "file", 18)


def composite_lookup(spark, d):
    """Speaker of (recording, channel); keys with conflicting ones are reported."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("speaker"))
    return li.groupBy("l_orderkey", "channel").agg(F.min("speaker").alias("speaker"), (F.count_distinct("speaker") > 1).alias("conflict"))


def nearest_next(spark, d):
    e = _timed(spark, d)
    out = J.next_start(e, ["user_id"], "start", ["start", "event_id"], F.col("value") < 10, "end")
    return out.select("event_id", F.round("end", 3).alias("end"))


def split_assign(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def filter_columns(spark, d):
    df = table(spark, d, "part").select("p_partkey", P.regex_match(F.col("p_type"), "(STANDARD|SMALL)").alias("filter_type"), (F.col("p_size") > 10).alias("filter_size"))
    ok, failed = P.apply_filters(df)
    return failed.unionByName(ok.withColumn("failed", F.lit("")))


def regex_modes(spark, d):
    n = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", *[P.regex_match(n, "[A-Z]+ [A-Z]+", m).alias(m) for m in ("match", "fullmatch", "search")],
                                          P.include_exclude(n, ["[A-Z]+ .*"], [".*STEEL", "SMALL.*"]).alias("any_excluded"), P.include_exclude(n, (), [".*STEEL", "SMALL.*"], True).alias("all_excluded"))


def validity_rules(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_quantity") - 3).alias("s"), (F.col("l_quantity") - F.col("l_linenumber")).alias("e"), F.col("l_returnflag").alias("t"))
    status = P.row_status(F.col("s"), F.col("e"), F.col("e") - F.col("s"), F.when(F.col("t") == "N", "").otherwise(F.col("t")))
    return li.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def derived_times(spark, d):
    li = table(spark, d, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    t = P.derive_times(F.when(n % 2 == 0, q), F.when(n % 3 == 0, q + 5), F.when(n % 3 != 0, q / 2))
    return li.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in t.items()])


def segments_inside(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + F.col("l_linenumber")).alias("e"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("dur"))
    return li.join(o, "o_orderkey").filter((F.col("s") < F.col("dur")) & (F.col("e") <= F.col("dur") + 0.25)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


def charset_ok(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(P.FRENCH).alias("ok"))


def coherence_curve(spark, d):
    df = table(spark, d, "documents").withColumn("dur", (F.col("doc_id") % 40).cast("double"))
    return df.select("doc_id", F.round(P.spline(F.col("dur"), P.TOO_LONG), 6).alias("hi"), (F.col("n_chars") > P.spline(F.col("dur"), P.TOO_LONG)).alias("too_long"), (F.col("n_chars") < P.spline(F.col("dur"), P.TOO_SHORT)).alias("too_short"))


def words_blacklist(spark, d):
    return table(spark, d, "documents").filter(P.without_words(F.col("text"), ["the", "que", "der"])).select("doc_id")


def machine_made(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.looks_machine_made(F.col("text")).alias("asr"))


def backchannel_turns(spark, d):
    """Each run of four words of a turn."""
    words = F.split("text", " ")
    df = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 4)), lambda i: F.array_join(F.slice(words, (i * 4 + 1).cast("int"), 4), " "))).alias("i", "t"))
    return df.select("conv_id", "turn", "i", P.backchannel_only(F.col("t"), ["the", "and", "of", "that", "in", "is", "he", "it"]).alias("backchannel"))


def suspicious_entries(spark, d):
    return table(spark, d, "documents").select("doc_id", P.suspicious(F.col("text")).alias("suspicious"))


def special_characters(spark, d):
    """Each character outside the plain ones with its code point and the first document that has it."""
    df = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter(~F.col("ch").rlike("^[A-Za-z0-9\\s.,;:!?'-]*$"))
    return df.groupBy("ch").agg(F.min("doc_id").alias("example"), F.count(F.lit(1)).alias("n_docs")).withColumn("code", F.ascii("ch"))


def blacklist_anti(spark, d):
    bad = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(bad, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def union_manifests(spark, d):
    o = table(spark, d, "orders")
    parts = {"fr_train_a": o.select("o_orderkey").filter("o_orderkey % 7 = 0"), "dev_b_en": o.select("o_orderkey", "o_orderstatus").filter("o_orderkey % 11 = 0"), "misc": o.select("o_orderkey").filter("o_orderkey % 13 = 0")}
    return D.merge_manifests(parts).select("o_orderkey", "o_orderstatus", "manifest", "split", "language")


def keep_first(spark, d):
    return D.keep_first(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def line_dedup_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(D.distinct_lines(F.col("text"))).alias("digest"))


def conflicting_ids(spark, d):
    return D.conflicting(table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 400), ["k"], "o_orderstatus")


def common_keys(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return D.in_all("k", o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"))


QUERIES = {f.__name__: f for f in (
    merge_keep_last, merge_unmatched, lookup_merge, zip_merge, semi_filter_speakers, anti_missing, folder_load, repair_folder, topic_overlap_argmax, linked_span,
    compare_manifests, id_prefix_match, composite_lookup, nearest_next, split_assign, filter_columns, regex_modes, validity_rules, derived_times, segments_inside,
    charset_ok, coherence_curve, words_blacklist, machine_made, backchannel_turns, suspicious_entries, special_characters, blacklist_anti, union_manifests, keep_first,
    line_dedup_text, conflicting_ids, common_keys,
)}


def _spline_sql(knots) -> str:
    """The same curve as SQL, from the second derivatives solved by plain elimination."""
    n = len(knots)
    xs, ys = [k[0] for k in knots], [k[1] for k in knots]
    h = [xs[i + 1] - xs[i] for i in range(n - 1)]
    m = [[0.0] * (n + 1) for _ in range(n)]
    m[0][:3], m[-1][n - 3 : n] = [h[1], -(h[0] + h[1]), h[0]], [h[-1], -(h[-2] + h[-1]), h[-2]]
    for i in range(1, n - 1):
        m[i][i - 1 : i + 2] = [h[i - 1], 2 * (h[i - 1] + h[i]), h[i]]
        m[i][n] = 6 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(m[r][c]))
        m[c], m[p] = m[p], m[c]
        for r in range(n):
            if r != c:
                f = m[r][c] / m[c][c]
                m[r] = [a - f * b for a, b in zip(m[r], m[c], strict=True)]
    z = [m[i][n] / m[i][i] for i in range(n)]
    cases = [f"WHEN dur <= {xs[0]} THEN {ys[0]}"]
    for i in range(n - 1):
        c1 = (ys[i + 1] - ys[i]) / h[i] - h[i] * (2 * z[i] + z[i + 1]) / 6
        t = f"(dur - {xs[i]}::DOUBLE)"
        cases.append(f"WHEN dur < {xs[i + 1]} THEN {ys[i]}::DOUBLE + {t} * ({c1!r}::DOUBLE + {t} * ({z[i] / 2!r}::DOUBLE + {t} * {(z[i + 1] - z[i]) / (6 * h[i])!r}::DOUBLE))")
    return f"CASE {' '.join(cases)} ELSE {ys[-1]}::DOUBLE END"


_OLD_NEW = """o AS (SELECT o_orderkey % 500 AS utt, o_totalprice AS price, o_orderstatus AS status, o_orderkey AS i FROM orders WHERE o_orderkey % 3 < 2),
n AS (SELECT o_orderkey % 700 AS utt, o_totalprice AS price, o_custkey AS spk, o_orderkey AS i FROM orders WHERE o_orderkey % 3 > 0)"""
_TIMED = "e AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS s, epoch_us(ts) / 1e6::DOUBLE + value AS t FROM events)"
ORACLES = {
    "merge_keep_last": f"""WITH {_OLD_NEW} SELECT utt, status, n1.price, spk FROM (SELECT utt, arg_max(status, i) AS status FROM o GROUP BY 1) o1
JOIN (SELECT utt, arg_max(price, i) AS price, arg_max(spk, i) AS spk FROM n GROUP BY 1) n1 USING (utt)""",
    "merge_unmatched": f"""WITH {_OLD_NEW} SELECT DISTINCT utt, 'old' AS side FROM o WHERE utt NOT IN (SELECT utt FROM n) UNION ALL SELECT DISTINCT utt, 'new' FROM n WHERE utt NOT IN (SELECT utt FROM o)""",
    "lookup_merge": """SELECT o_custkey, o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey""",
    "zip_merge": """SELECT event_id AS row_idx, CASE WHEN doc_id IS NULL THEN event_type ELSE lang END AS lang, value, n_chars FROM events LEFT JOIN documents ON doc_id = event_id""",
    "semi_filter_speakers": """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
    "anti_missing": """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "folder_load": """SELECT l_orderkey AS rec, l_linenumber, '/wav/' || o_orderkey AS path, p_name AS text, c_name AS speaker, l_quantity AS dur FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey AND p_size < 40 LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
    "repair_folder": """WITH u AS (SELECT *, l_orderkey * 10 + l_linenumber AS utt FROM lineitem),
k AS (SELECT DISTINCT utt, l_orderkey AS rec FROM u WHERE utt IN (SELECT utt FROM u WHERE l_quantity > 5) AND utt IN (SELECT utt FROM u WHERE l_tax < 0.07)
  AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
SELECT l_suppkey AS spk, count(DISTINCT utt) AS n_utts, count(DISTINCT rec) AS n_recs FROM (SELECT utt, l_suppkey FROM u WHERE l_tax < 0.07) JOIN k USING (utt) GROUP BY 1""",
    "topic_overlap_argmax": f"""WITH {_TIMED}, j AS (SELECT a.user_id, a.event_id, b.event_id AS span_idx, least(a.s + a.value * 60, b.s + b.value * 120) - greatest(a.s, b.s) AS ov
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id % 3 = 0 AND b.event_id % 3 = 1 AND a.s < b.s + b.value * 120 AND b.s < a.s + a.value * 60),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ov DESC, span_idx) AS k FROM j WHERE ov > 0) SELECT user_id, event_id, span_idx, round(ov, 3) AS overlap FROM r WHERE k = 1""",
    "linked_span": """SELECT o_orderkey, min(l_quantity) AS start, least(max(l_quantity + l_linenumber), 50.0) AS "end" FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "compare_manifests": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS c,
(o_orderkey % 2 = 0)::BIGINT + (o_orderkey % 3 = 0)::BIGINT + (o_orderkey % 5 = 0)::BIGINT AS n_tables FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""",
    "id_prefix_match": """WITH r AS (SELECT 'Customer#' || lpad((o_custkey % 50)::VARCHAR, 9, '0') || '_' || o_orderkey AS file FROM orders)
SELECT c_name, min(file) AS file FROM customer JOIN r ON substr(file, 1, 18) = substr(c_name, 1, 18) GROUP BY c_name""",
    "composite_lookup": """SELECT l_orderkey, l_returnflag AS channel, min(l_linestatus) AS speaker, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY 1, 2""",
    "nearest_next": f"""WITH {_TIMED} SELECT event_id, round(CASE WHEN value < 10 THEN coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id), t) ELSE t END, 3) AS "end" FROM e""",
    "split_assign": """SELECT split, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split FROM labels) USING (doc_id) GROUP BY 1""",
    "filter_columns": """WITH f AS (SELECT p_partkey, regexp_matches(p_type, '^(STANDARD|SMALL)') AS a, p_size > 10 AS b FROM part)
SELECT p_partkey, 'filter_type' AS failed FROM f WHERE NOT a UNION ALL SELECT p_partkey, 'filter_size' FROM f WHERE NOT b UNION ALL SELECT p_partkey, '' FROM f WHERE a AND b""",
    "regex_modes": """SELECT p_partkey, regexp_matches(p_type, '^(?:[A-Z]+ [A-Z]+)') AS "match", regexp_full_match(p_type, '[A-Z]+ [A-Z]+') AS fullmatch, regexp_matches(p_type, '[A-Z]+ [A-Z]+') AS search,
regexp_full_match(p_type, '[A-Z]+ .*') AND NOT (regexp_full_match(p_type, '.*STEEL') OR regexp_full_match(p_type, 'SMALL.*')) AS any_excluded,
NOT (regexp_full_match(p_type, '.*STEEL') AND regexp_full_match(p_type, 'SMALL.*')) AS all_excluded FROM part""",
    "validity_rules": """WITH x AS (SELECT l_quantity - 3 AS s, l_quantity - l_linenumber AS e, l_returnflag AS t FROM lineitem)
SELECT CASE WHEN s < 0 THEN 'negative_start' WHEN e <= s THEN 'end_before_start' WHEN e - s < 0.1 THEN 'too_short' WHEN e - s >= 3600 THEN 'too_long' WHEN t = 'N' THEN 'empty_text' ELSE 'ok' END AS status, count(*) AS n FROM x GROUP BY 1""",
    "derived_times": """WITH x AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS s0, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 5 END AS e0, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 2 END AS d0 FROM lineitem),
y AS (SELECT *, CASE WHEN s0 IS NOT NULL THEN s0 WHEN e0 IS NOT NULL AND d0 IS NOT NULL THEN e0 - d0 WHEN e0 IS NULL AND d0 IS NOT NULL THEN 0 END AS s FROM x)
SELECT l_orderkey, l_linenumber, s AS start, coalesce(e0, s + d0) AS "end", coalesce(d0, e0 - s) AS duration FROM y""",
    "segments_inside": """SELECT o_orderkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < o_totalprice / 5000 AND l_quantity + l_linenumber <= o_totalprice / 5000 + 0.25 GROUP BY 1""",
    "charset_ok": "SELECT doc_id, regexp_matches(text, '" + P.FRENCH.replace("'", "''") + "') AS ok FROM documents",
    "coherence_curve": f"""WITH t AS (SELECT doc_id, n_chars, (doc_id % 40)::DOUBLE AS dur FROM documents)
SELECT doc_id, round({_spline_sql(P.TOO_LONG)}, 6) AS hi, n_chars > {_spline_sql(P.TOO_LONG)} AS too_long, n_chars < {_spline_sql(P.TOO_SHORT)} AS too_short FROM t""",
    "words_blacklist": r"""SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(^|[^\p{L}\p{N}_])(the|que|der)($|[^\p{L}\p{N}_])')""",
    "machine_made": r"""SELECT conv_id, turn, (text = lower(text) AND regexp_matches(text, '\p{L}')) OR NOT contains(text, ',') AS asr FROM conversations""",
    "backchannel_turns": r"""WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations), n AS (SELECT *, unnest(range(0, (len(s) + 3) // 4))::INT AS i FROM s),
t AS (SELECT conv_id, turn, i, array_to_string(s[i * 4 + 1:i * 4 + 4], ' ') AS t FROM n), k AS (SELECT conv_id, turn, i, [x FOR x IN string_split_regex(lower(regexp_replace(t, '[^\p{L}\p{N}\s''-]', ' ', 'g')), '\s+') IF x <> ''] AS w FROM t)
SELECT conv_id, turn, i, len(w) > 0 AND len(w) <= 4 AND len([x FOR x IN w IF x NOT IN ('the', 'and', 'of', 'that', 'in', 'is', 'he', 'it')]) = 0 AS backchannel FROM k""",
    "suspicious_entries": "SELECT doc_id, contains(text, 'familyfont') OR "
    + " OR ".join(f"regexp_matches(text, '{c}{{3}}') OR regexp_matches(t, '(^|[^a-z0-9_]){c}{c}')" for c in "abcdefghijklmnopqrstuvwxyz")
    + " AS suspicious FROM (SELECT *, regexp_replace(lower(strip_accents(nfc_normalize(text))), '[^\\x00-\\x7F]', '', 'g') AS t FROM documents)",
    "special_characters": r"""WITH c AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, min(doc_id) AS example, count(*) AS n_docs, unicode(ch) AS code FROM c WHERE NOT regexp_matches(ch, '^[A-Za-z0-9\s.,;:!?''-]*$') GROUP BY ch""",
    "blacklist_anti": """SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""",
    "union_manifests": """SELECT o_orderkey, NULL::VARCHAR AS o_orderstatus, 'fr_train_a' AS manifest, 'train' AS split, 'fr' AS language FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, o_orderstatus, 'dev_b_en', 'validation', 'en' FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, NULL, 'misc', NULL, NULL FROM orders WHERE o_orderkey % 13 = 0""",
    "keep_first": """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""",
    "line_dedup_text": """WITH l AS (SELECT doc_id, trim(x, ' ') AS x, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY 1, 2), g AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM f GROUP BY 1) SELECT doc_id, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN g USING (doc_id)""",
    "conflicting_ids": """SELECT o_orderkey % 400 AS k, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""",
    "common_keys": """SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3""",
}
