"""The pipeline against plain Python, and what its stages must keep."""

import random

import pytest

import corpus_pipeline
from boxweave.llm import common, lang_id, mixture, pii
from tests.llm.test_ops import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "benchmark", "personal_data", "mix"]
    model = lang_id.train(docs)
    told = {r.doc_id for r in lang_id.identify(docs, model).where(~lang_id.is_rejected()).collect()}
    one = common.stored(steps["language"](spark, docs, SF), "one")
    assert {r.doc_id for r in one.collect()} == told and one.columns == docs.columns
    texts = {r.doc_id: r.text for r in one.collect()}
    two = common.stored(steps["near_duplicates"](spark, one, SF), "two")
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, c in brute_groups(texts, 5).values()})
    three = common.stored(steps["benchmark"](spark, two, SF), "three")
    clean = set()
    for r in two.collect():
        n, hit, _ = brute_hits(r.text, bench)
        if not hit or 20 * len(hit) < n:
            clean.add(r.doc_id)
    assert {r.doc_id for r in three.collect()} == clean and three.columns == docs.columns
    four = common.stored(steps["personal_data"](spark, three, SF), "four")
    before, trained = {r.doc_id: r.text for r in three.collect()}, pii.train()
    for r in four.collect():
        t = before[r.doc_id]
        assert r.text == pii.masked(t, pii.find([t], trained)[0][1]) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text)
    last = steps["mix"](spark, four, SF).collect()
    mixed = {r.doc_id: r.taken for r in mixture.mix(four).collect() if r.taken}
    assert [r.position for r in last] == sorted(r.position for r in last)
    for k, taken in mixed.items():
        assert sum(r.words for r in last if r.doc_id == k) == taken
    assert {r.doc_id for r in last} == set(mixed)
    assert sorted((r.doc_id, r["pass"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r["pass"]) for r in last)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, stage):
    rng = random.Random(1)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (None, "no id", "en", None, 5), (3, " ".join(f"w{rng.randrange(9)}" for _ in range(90_000)), "fr", "s", 1), (3, "twice", "de", "t", 5), (5, "twice", "de", "t", 5)]
    step = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(rows, kind)
    out = step(spark, docs, SF)
    assert out.columns[:5] == docs.columns or stage == "mix" and set(docs.columns) <= set(out.columns)
    assert out.count() <= 2 * len(rows)
    assert step(spark, docs.limit(0), SF).count() == 0
