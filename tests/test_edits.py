"""Edit distances of many texts at once against brute force."""

from __future__ import annotations

import random
import time

from lexispark import plans
from lexispark.operators import edits
from lexispark.operators import evaluate as E
from tests.conftest import DATA


def changed(r: random.Random, text: str, letters: str, share: float) -> str:
    piece = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 20)))
    return "".join(c if r.random() > share else r.choice(["", c + piece(), r.choice(letters)]) for c in text)


def some_pairs(n: int, longest: int) -> list[tuple[str, str]]:
    r, out = random.Random(4), []
    for _ in range(n):
        letters = r.choice(["ab", "abcdefgh é😀"])
        text = lambda: "".join(r.choice(letters) for _ in range(r.randrange(longest)))  # noqa: B023, E731
        a = text()
        out.append((a, changed(r, a, letters, r.choice([0, 0.02, 0.2, 0.6])) if r.random() < 0.8 else text()))
    return out


def test_distances():
    pairs = some_pairs(200, 300)
    true = [E.word_distance(a, b) for a, b in pairs]
    assert edits.distances(pairs).tolist() == true
    limits = [random.Random(i).randrange(150) for i in range(len(pairs))]
    assert edits.distances(pairs, limits).tolist() == [d if d <= k else -1 for d, k in zip(true, limits, strict=True)]
    assert edits.distances([]).tolist() == []


def test_distance_of_long_texts():
    """Two texts of 100,000 letters, with some deleted and as many appended: the cost is known, 10^10 cells are not filled."""
    r = random.Random(7)
    a = "".join(r.choice("abcdefghij") for _ in range(100_000))
    b = a[:20_000] + a[20_300:] + "z" * 300
    assert edits.distances([(a, b), (b, a), (a, a)]).tolist() == [600, 600, 0]


def test_char_distance_of_nulls(spark):
    df = spark.createDataFrame([("a b", "ab"), ("", ""), (" ", ""), (None, "a"), ("abcdefghij", "abcdefghiX"), ("abcdefghij", "abcdefghXY")], "r string, h string")
    got = df.select(E.char_distance_column(df.r, df.h), E.mismatch(df.r, df.h, 0.1)).collect()
    assert [tuple(x) for x in got] == [(1, False), (0, None), (1, None), (None, None), (1, False), (2, True)]


def test_char_counts(spark):
    """Compiled counts are those of the whole table; texts of 200,000 letters, of which it would have 4 * 10^10 cells, take seconds."""
    pairs = [*some_pairs(150, 300), (None, "a b"), ("a", None), (None, None), ("", ""), (" a\t b c ", "a b\nc")]
    df = spark.createDataFrame(pairs, "r string, h string")
    cut = lambda t: list(" ".join((t or "").split()))
    assert [tuple(x.e) for x in df.select(E.edit_count_column(df.r, df.h, "char").alias("e")).collect()] == [E.edit_counts(cut(a), cut(b)) for a, b in pairs]
    r = random.Random(7)
    a = "".join(r.choice("abcdefghij") for _ in range(200_000))
    b = a[:20_000] + a[20_300:] + "z" * 300
    df, begin = spark.createDataFrame([(a, b), (b, a)], "r string, h string"), time.monotonic()
    assert [tuple(x.e) for x in df.select(E.edit_count_column(df.r, df.h, "char").alias("e")).collect()] == [(199_700, 0, 300, 300)] * 2
    assert time.monotonic() - begin < 60


def test_align_words(spark):
    """Compiled paths are those of the whole table; texts of 20,000 words, of which it would have 4 * 10^8 cells, take seconds."""
    r = random.Random(9)
    pairs = [*some_pairs(150, 300), (None, "a b"), ("a", None), ("", ""), (" a\t b c ", "a b\nc"), ("a" * 70 + " b", "b " + "a" * 80)]
    df = spark.createDataFrame(pairs, "r string, h string")
    got = [[tuple(p) for p in x.p] for x in df.select(E.align_words(df.r, df.h).alias("p")).collect()]
    assert got == [E.word_path((a or "").split(), (b or "").split()) for a, b in pairs]
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(20_000)]
    ref, hyp = " ".join(words), " ".join(w for i, w in enumerate(words) for w in [w] * (1 + (i % 7 == 0)))
    df, begin = spark.createDataFrame([(ref, hyp)] * 4, "r string, h string").coalesce(1), time.monotonic()
    paths = [x.p for x in df.select(E.align_words(df.r, df.h).alias("p")).collect()]
    assert all([p.ref for p in path] == [i for i in range(20_000) for _ in range(1 + (i % 7 == 0))] and [p.hyp for p in path] == list(range(len(hyp.split()))) for path in paths)
    assert time.monotonic() - begin < 60


def test_paths_are_worked_out_once(spark):
    plan = plans.queries()["word_alignment"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WordPath(") == 1
