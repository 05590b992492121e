"""The pipeline's stages on their own inputs, and its registration."""

import os

from quarry.llm import common, language, neighbours, simhash

import corpus_pipeline
from test_operators import SMALL, brute_lines
from test_shingles import kept as kept_texts


def test_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    columns, kept = docs.columns, {}
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in state.collect()}
        state = common.materialize(stage(spark, state, SMALL), name)
        assert state.columns == columns
        after = {r.doc_id: r for r in state.collect()}
        kept[name] = (before, after)
    before, after = kept["language_id"]
    kernel = language.fit(docs)
    langs, scores = kernel.predict([r.text for r in before.values()])
    assert set(after) == {i for i, g, s in zip(before, langs, scores, strict=True) if g != "und" and s >= language.SURE}
    before, after = kept["quality_classifier"]
    voter = neighbours.fit(docs, common.table(spark, SMALL, "labels"))
    want = {i for i, r in before.items() if voter.score([r.text])[0] >= neighbours.THRESHOLD}
    assert len(want ^ set(after)) == 0
    before, after = kept["line_dedup"]
    for i, _, _, text in brute_lines([(i, r.text) for i, r in before.items()], 10):
        assert after[i].text == text and after[i].n_chars == len(text)
    before, after = kept["simhash_near_dedup"]
    order = sorted(before)
    assert set(after) == {order[k] for k in kept_texts([before[i].text for i in order])}
    packed = corpus_pipeline.STAGES[-1][1](spark, state, SMALL).collect()
    assert {r.doc_id for r in packed} == set(after)


def test_models_run_once_in_a_stage(spark):
    docs = common.table(spark, SMALL, "documents")
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.quality_stage):
        plan = stage(spark, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_an_empty_table(spark):
    state = common.table(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        state = common.materialize(stage(spark, state, SMALL), name)
    assert state.count() == 0


def test_only_the_entry_point_guards_imports():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for d, _, names in os.walk(os.path.join(top, "quarry", "llm")):
        for n in names:
            if n.endswith(".py"):
                assert "except ImportError" not in open(os.path.join(d, n)).read()
    assert simhash.MAX_BITS == 2
