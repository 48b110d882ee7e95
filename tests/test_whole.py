"""Queries without SQL see their whole tables and whole texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark import plans
from lexispark.operators import evaluate as E
from lexispark.plans import texts
from tests.conftest import DATA

QUERIES = plans.queries()


@pytest.fixture(scope="module")
def pairs(duck):
    """doc_id, lang, reference and hypothesis of whole documents, from the SQL."""
    return duck.execute(f"WITH {texts._PAIRS} SELECT doc_id, lang, array_to_string(w, ' '), array_to_string(h, ' ') FROM p ORDER BY doc_id").fetchall()


def test_pairs_are_whole(spark, pairs):
    assert [tuple(r) for r in texts._pairs(spark, DATA).orderBy("doc_id").collect()] == pairs


@pytest.mark.parametrize(("name", "unit"), [("corpus_wer", str.split), ("corpus_cer", list)])
def test_error_rates_are_whole(spark, pairs, name, unit):
    size: dict[str, list[int]] = {}
    for _, lang, ref, hyp in pairs:
        n = size.setdefault(lang, [0, 0])
        n[0] += len(unit(ref))
        n[1] += len(unit(hyp))
    got = {r.lang: [r.n_hits + r.n_sub + r.n_del, r.n_hits + r.n_sub + r.n_ins] for r in QUERIES[name](spark, DATA).collect()}
    assert got == size


def test_bootstrap_is_whole(spark, pairs):
    counts = [(i, *E.edit_counts(r.split(), h.split())) for i, _, r, h in pairs]
    df = spark.createDataFrame([(i, s + d + n, h + s + d) for i, h, s, d, n in counts], "doc_id long, err long, n long")
    assert QUERIES["wer_bootstrap"](spark, DATA).first().asDict() == pytest.approx(E.bootstrap(df, "err", "n", "doc_id", 10_000).first().asDict())


def test_word_path():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    for _ in range(100):
        a, b = [word() for _ in range(r.randrange(1, 12))], [word() for _ in range(r.randrange(1, 12))]
        assert E.word_path(a, b) == E.dtw(np.array([[E.word_distance(u, v) for v in b] for u in a], float))
    assert E.word_path([], ["a"]) == E.word_path(["a"], []) == []


def test_word_alignment_is_whole(spark, pairs):
    ends = QUERIES["word_alignment"](spark, DATA).groupBy("doc_id").agg(F.min("ref"), F.min("hyp"), F.max("ref"), F.max("hyp")).orderBy("doc_id").collect()
    assert [tuple(r) for r in ends] == [(i, 0, 0, len(r.split()) - 1, len(h.split()) - 1) for i, _, r, h in pairs if r and h]


@pytest.mark.parametrize(("name", "key", "table"), [("number_words", "o_orderkey", "orders"), ("ctc_positions", "vec_id", "embeddings")])
def test_tables_are_whole(spark, duck, name, key, table):
    assert {r[0] for r in QUERIES[name](spark, DATA).select(key).collect()} == {r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall()}


def test_overlaps_removed_is_whole(spark, duck):
    from lexispark.operators.diarize import cut_overlaps

    rows = duck.execute("SELECT user_id, event_type, event_id, value FROM events ORDER BY user_id, event_id").fetchall()
    of: dict[int, list] = {}
    for user, kind, event, value in rows:
        mine = of.setdefault(user, [])
        start = (len(mine) + 1) * 4 + event % 5
        mine.append((float(start), float(start + 1 + int(value) % 7), kind))
    expected = sorted((u, *s) for u, mine in of.items() for s in cut_overlaps(mine))
    assert sorted(tuple(r) for r in QUERIES["overlaps_removed"](spark, DATA).collect()) == expected
