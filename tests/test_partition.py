"""Splits against brute force."""

from __future__ import annotations

import random

import pytest

from lexispark.operators import partition as S


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_duration_fill(spark, range_rows):
    r = random.Random(7)
    rows = [(i, r.choice([0.5, 2.0, 3.25, 9.0, 40.0])) for i in range(100) for _ in range(r.randrange(1, 3))]
    total, split, expected = 0.0, 0, []
    for i in range(100):
        d = sum(x for j, x in rows if j == i)
        if total > 0 and total + d > 20:
            total, split = d, split + 1
        else:
            total += d
        expected.append((i, d, split))
    df = spark.createDataFrame(rows, "rec long, d double")
    got = S.duration_fill(df, "rec", "d", 20.0, range_rows)
    assert sorted(tuple(x) for x in got.collect()) == expected
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_duration_fill_empty(spark):
    assert S.duration_fill(spark.createDataFrame([], "rec long, d double"), "rec", "d", 20.0).count() == 0


def test_disjoint_split_follows_long_chains(spark):
    """Speaker i shares audio with speaker i + 1: a chain of 55 steps, and one apart."""
    chain = [(f"s{i:02d}", a) for i in range(56) for a in (i, i + 1)]
    df = spark.createDataFrame([*chain, ("apart", 999)], "spk string, audio long")
    got = {r.spk: r.split for r in S.disjoint_split(df, "spk", "audio", df.filter("spk = 's00'")).collect()}
    assert got == {s: "test" for s, _ in chain} | {"apart": "train"}


@pytest.mark.parametrize("n", [12, 600])
def test_pairs_reach_every_utterance(spark, n):
    """A third of the rows are of one speaker; each speaker but the last has three sessions."""
    rows = [(f"u{i:03d}", "big" if i % 3 == 0 else f"s{i % 5}", f"x{i // 5 % 3}" if i % 5 < 4 or i % 3 == 0 else "only") for i in range(n)]
    spk, session = {u: s for u, s, _ in rows}, {u: x for u, _, x in rows}
    got = S.balanced_pairs(spark.createDataFrame(rows, "utt string, spk string, session string"), "spk", "session", "utt").collect()
    assert len({(r.a, r.b) for r in got}) == len(got) <= 2 * n
    assert all((spk[r.a] == spk[r.b]) == bool(r.same) for r in got)
    assert {u for r in got if not r.same for u in (r.a, r.b)} == set(spk)
    many = {s for s in set(spk.values()) if len({session[u] for u in spk if spk[u] == s}) > 1}
    assert {u for r in got if r.same and session[r.a] != session[r.b] for u in (r.a, r.b)} == {u for u in spk if spk[u] in many}
    assert all(session[r.a] != session[r.b] for r in got if r.same and spk[r.a] in many)
