"""The pipeline's near-duplicate stage against brute force, with near copies planted at 0.8 to 0.95."""

import random

import corpus_pipeline
from quarry.llm import shingles, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(texts):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i in range(len(texts)):
        first.setdefault(find(i), i)
    return set(first.values())


def planted():
    rnd = random.Random(11)
    some = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, near = [None, "", "one two", "One  two", "one two three"], 0
    for k in range(40):
        base = some(204)
        copy = list(base)
        for at in rnd.sample(range(0, 200, 6), 1 + k % 6):  # a changed word changes five shingles
            copy[at] = "changed"
        share = len(grams(" ".join(base)) & grams(" ".join(copy))) / len(grams(" ".join(base)) | grams(" ".join(copy)))
        near += 0.8 <= share <= 0.96
        texts += [" ".join(base), " ".join(copy)]
    base = some(300)
    texts += [" ".join([*base, f"tail{k}"]) for k in range(60)]  # one large group
    for k in range(60):  # a large family that shares much but is no group, with links between its later members
        texts.append(" ".join([*base[:200], *some(90 if k % 2 else 30)]))
    return texts, near


def test_stage_links_near_copies(spark):
    texts, near = planted()
    assert near > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, None).collect()}
    assert got == kept(texts)


def test_prefixes_find_the_same_groups(spark):
    texts, _ = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = {}
    for r in shingles.groups(df, crowd=1, centres=2).collect():
        roots.setdefault(r.root, []).append(r.doc_id)
    assert {min(x) for x in roots.values()} == kept(texts)


def test_bands_find_pairs_at_the_threshold():
    rnd = random.Random(2)
    for _ in range(200):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(94)]
        a, b = shingles.shingles(" ".join(words)), shingles.shingles(" ".join([*words, *"abcdefghij"]))
        assert set(shingles.buckets(a)) & set(shingles.buckets(b))


def test_each_row_of_a_prefix_is_a_centre_once(spark, monkeypatch):
    rnd = random.Random(5)
    some = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rare, pool = some(40), [some(40) for _ in range(8)]  # a passage of 30 unlike texts, rarer than what else is in them
    texts = [" ".join(sum(rnd.sample(pool, 3), rare if k < 30 else [])) for k in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    join, rounds = shingles.common.join_counted, []

    def noted(rows, one, *a, **b):
        if "c" in one.columns:
            rounds.append([(r.bucket, r.c) for r in one.select("bucket", "c").collect()])
        return join(rows, one, *a, **b)

    monkeypatch.setattr(shingles.common, "join_counted", noted)
    monkeypatch.setattr(shingles.simhash, "FEW", 0)
    roots = {}
    for r in shingles.groups(df, crowd=1, centres=2).collect():
        roots.setdefault(r.root, []).append(r.doc_id)
    assert {min(x) for x in roots.values()} == kept(texts)
    centres = sum(rounds, [])
    assert len(rounds) > 1 and len(centres) == len(set(centres))


def test_fingerprints_and_pivots_give_candidates(spark, monkeypatch):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    same = "one passage often said again " * 200
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(base[:1500]), same, f"{same}{' '.join(base[:40])}"]
    fps = [simhash.fingerprint(t) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and (fps[3] ^ fps[4]).bit_count() <= 2
    monkeypatch.setattr(shingles, "buckets", lambda hashes: [])  # no minhashes: what is found is found by pivots
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in shingles.groups(df).collect()}
    assert root[0] == root[1] and len(set(root.values())) == 4  # fingerprints as close as the last two's are verified
