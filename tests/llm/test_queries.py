"""The operators' queries against SQL, where there is one, and the pipeline as a whole."""

from __future__ import annotations

import re

import pytest

from lexispark.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, same, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    rows = out.collect()
    assert len(corpus_pipeline.STAGES) == 5 and rows
    assert set(docs.columns) <= set(out.columns)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in rows)
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_stages_against_brute_force(spark):
    """Which documents each stage keeps, and how often, each stage on what the one before has left."""
    import corpus_pipeline
    from lexispark.llm import langid
    from lexispark.llm.common import materialize
    from tests.llm import test_operators as slow

    table = lambda df: [(r.doc_id, r.text, r.source, r.lang) for r in df.collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, found = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], DATA), name))
    tables = [table(df) for df in found]
    assert all(df.columns == names for df in found[:-1])

    model = langid.fit(docs)
    fitted = {r.doc_id for r in docs.filter(langid._sampled("doc_id", "text", "lang", model.edges)).collect()}
    rows = [(i, t, lang if lang in langid.LANGUAGES and i not in fitted else None, None, source, "") for i, t, source, lang in tables[0]]
    kept = {}
    for i, p in slow.slow_posteriors(rows, model).items():
        best = langid.CLASSES[int(p.argmax())]
        if best != "other" and p.max() >= 0.5 and len(langid.trigram_buckets(next(r[1] for r in rows if r[0] == i))):
            kept[i] = best
    assert {i: lang for i, _, _, lang in tables[1]} == kept

    prints = {i: slow.slow_fingerprint(t) for i, t, _, _ in tables[1]}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if root[i] < root[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[j], changed = root[i], True
    assert sorted(r[0] for r in tables[2]) == sorted(set(root.values()))

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert sorted(r[0] for r in tables[3]) == sorted(r[0] for r in tables[2] if not hit(words(r[1])))

    copies = [r[0] for r, n in slow.slow_copies([r[:3] for r in tables[3]]) for _ in range(n)]
    assert sorted(r[0] for r in tables[4]) == sorted(copies)

    placed = found[5].collect()
    assert sorted(r.doc_id for r in placed) == sorted(copies)
    order = sorted(placed, key=lambda r: (r.curve, r.text_crc32, r.doc_id))
    assert sorted((r.shard, r.slot) for r in placed) == sorted((k * 16 // len(order), k - -(-(k * 16 // len(order)) * len(order) // 16)) for k in range(len(order)))
    assert [r.shard for r in order] == [k * 16 // len(order) for k in range(len(order))]


def test_stages_on_odd_tables(spark, documents):
    """Null and repeated rows: each stage's rows are of those it got, and what is known of each holds."""
    import corpus_pipeline
    from lexispark.llm.common import materialize

    odd = documents([(1, "the same words in a text"), (1, "the same words in a text"), (2, None), (None, ""), (3, "la même chose en français pour voir"), (4, "x " * 3000)])
    for table in (odd, odd.limit(0), odd.withColumn("source", odd.text.substr(1, 0)).withColumn("lang", odd.text.substr(1, 0))):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before = [(r.doc_id, r.text) for r in docs.collect()]
            docs = materialize(stage(spark, docs, DATA), name)
            after = [(r.doc_id, r.text) for r in docs.collect()]
            assert set(after) <= set(before)
            if name == "language_id":
                # no letters, no language
                assert not {t for _, t in after} & {None, ""} and set(before) - set(after) <= {(2, None), (None, ""), (4, "x " * 3000)}
            elif name == "near_duplicates":
                assert len(after) == len(set(before)) == len(set(after))
            elif name == "decontamination":
                assert after == before or sorted(after) == sorted(before)
            elif name == "mixture":
                assert all(after.count(r) <= 2 * before.count(r) for r in before)
            else:
                assert sorted(after) == sorted(before)
