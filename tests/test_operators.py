"""Operators against small hand-made cases and brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import evaluate as E
from lexispark.operators import filter as P
from lexispark.operators import ordered as O
from lexispark.operators import partition as S


def slow_counts(ref, hyp):
    best = {}

    def go(i, j):
        if (i, j) not in best:
            if i == len(ref) or j == len(hyp):
                best[i, j] = (len(ref) - i + len(hyp) - j, len(ref) - i + len(hyp) - j)
            else:
                c, g = go(i + 1, j + 1)
                options = [(c + (ref[i] != hyp[j]), g)]
                for a, b in ((i + 1, j), (i, j + 1)):
                    c, g = go(a, b)
                    options.append((c + 1, g + 1))
                best[i, j] = min(options)
        return best[i, j]

    return go(0, 0)


def test_edit_counts():
    r = random.Random(1)
    for _ in range(200):
        a = [r.choice("abc") for _ in range(r.randrange(7))]
        b = [r.choice("abc") for _ in range(r.randrange(7))]
        hits, sub, dele, ins = E.edit_counts(a, b)
        cost, gaps = slow_counts(a, b)
        assert (sub + dele + ins, dele + ins) == (cost, gaps)
        assert hits + sub + dele == len(a) and hits + sub + ins == len(b)


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "u v"), (None, None)], "ref string, hyp string")
    r = E.error_rates(df).first()
    assert (r.n_hits, r.n_sub, r.n_del, r.n_ins, r["count"]) == (2, 1, 0, 3, 3)
    assert r.wer == pytest.approx(4 / 3)


def test_dtw_and_ctc():
    assert E.dtw(np.array([[0.0, 1], [1, 0], [1, 0]])) == [(0, 0), (1, 1), (2, 1)]
    em = np.log(np.full((6, 3), 0.05))
    for t, k in enumerate([0, 1, 1, 0, 2, 2]):
        em[t, k] = np.log(0.9)
    found = E.ctc_align(em, [1, 2])
    # the last token ends where it is likeliest, not where the frames do
    assert [(i, s, e) for i, s, e, _ in found] == [(0, 1, 4), (1, 4, 5)]
    assert [p for *_, p in found] == [pytest.approx(0.9), pytest.approx(0.9)]
    em[2, 1] = np.log(0.5)  # a frame that stays, with a lesser probability
    assert E.ctc_align(em, [1, 2])[0][3] == pytest.approx((0.9 + 0.5 + 0.9) / 3)
    assert E.ctc_align(em, []) == [] and E.ctc_align(em[:1], [1, 2]) == []


def test_glue(spark):
    rows = [("r", 0.0, 1.0, "Hello"), ("r", 1.1, 2.0, "world"), ("r", 2.5, 3.0, "Next"), ("r", 5.0, 6.0, "far"), ("q", 0.0, 29.0, "long"), ("q", 29.5, 31.0, "more")]
    df = spark.createDataFrame(rows, "rec string, start double, end double, text string")
    got = {(r.rec, r.segment): (r.start, r.end, r.text) for r in O.glue_segments(df, ["rec"], ["start"], "start", "end", "text").collect()}
    assert got == {("r", 0): (0.0, 3.0, "Hello world. Next"), ("r", 1): (5.0, 6.0, "far"), ("q", 0): (0.0, 29.0, "long"), ("q", 1): (29.5, 31.0, "more")}


def test_glue_empty(spark):
    df = spark.createDataFrame([], "rec string, start double, end double, text string")
    assert O.glue_segments(df, ["rec"], ["start"], "start", "end", "text").count() == 0


def test_spline(spark):
    xs = spark.createDataFrame([(x,) for x, _ in P.TOO_LONG], "x double")
    assert [round(r[0], 6) for r in xs.select(P.spline(F.col("x"), P.TOO_LONG)).collect()] == [y for _, y in P.TOO_LONG]


def test_suspicious(spark):
    df = spark.createDataFrame([("looool",), ("LOOOL",), ("un Éérable",), ("a llama",), ("xx_y",), ("familyfont",), ("belle",)], "t string")
    assert [r[0] for r in df.select(P.suspicious(F.col("t"))).collect()] == [True, False, True, True, True, True, False]


def test_pairs(spark):
    rows = [(f"u{i}", f"s{i % 5}", f"x{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "utt string, spk string, session string")
    who = {u: s for u, s, _ in rows}
    got = S.balanced_pairs(df, "spk", "session", "utt").collect()
    assert len({(r.a, r.b) for r in got}) == len(got)
    assert all((who[r.a] == who[r.b]) == bool(r.same) and r.a < r.b for r in got)
    assert {r.same for r in got} == {0, 1}


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert [r.row_idx for r in S.numbered(df, ["id"]).orderBy("id").collect()] == list(range(1000))


def test_numbered_with_payload(spark):
    """Numbers follow the order and leave no gap, whatever columns go along."""
    n = 2_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("payload "), 4).alias("wide"), F.md5(F.col("id").cast("string")).alias("more"))
        out = S.numbered(df, ["k"])
        wrong, rows = out.agg(F.count_if(F.col("row_idx") != F.col("k")), F.count("wide")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (wrong, rows) == (0, n)


def test_disjoint_split_error(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "spk string, audio long")
    with pytest.raises(ValueError):
        S.disjoint_split(df, "spk", "audio", df.filter("spk = 'a'"))


def test_language_accepted(spark):
    df = spark.sql("select map('fr', 0.5D, 'en', 0.44D, 'de', 0.0D) as s")
    assert [df.select(P.language_accepted(F.col("s"), x)).first()[0] for x in ("fr", "en", "de")] == [True, False, False]
    assert df.select(P.language_accepted(F.col("s"), "en", 0.13)).first()[0]


def test_cut_overlaps():
    from lexispark.operators.diarize import cut_overlaps

    assert cut_overlaps([(0.0, 5.0, "a"), (2.0, 3.0, "b")]) == [(0.0, 2.0, "a"), (2.0, 3.0, "b"), (3.0, 5.0, "a")]
    assert cut_overlaps([(0.0, 2.0, "a"), (1.0, 3.0, "b"), (5.0, 6.0, "c")]) == [(0.0, 1.0, "a"), (1.0, 3.0, "b"), (5.0, 6.0, "c")]
    assert cut_overlaps([]) == []
