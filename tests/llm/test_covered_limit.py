"""Operator 2's limit on the covered fraction rejects where no other rule does."""

from quarry.llm import repetition


def test_only_the_covered_limit_rejects(spark):
    word = iter(f"w{k}" for k in range(10_000))
    some = lambda n: [next(word) for _ in range(n)]
    much, little = some(8), some(8)
    texts = {1: [*much, *some(100), *much], 2: [*little, *some(200), *little]}  # 14 % and 7 % covered
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.quality_rules(df).collect()}
    assert all(not r.base_failed and r.longest_repeat == 8 and r.n_span_words == 16 for r in got.values())
    assert not got[1].kept and got[2].kept
