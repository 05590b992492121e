"""Each operator against a brute-force version, a round trip or held-out labels, over awkward rows."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quarry.llm import avi, common, language, lines, neighbours, packing, repetition, seekable, sentence, simhash, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, fp long, length int, score string, start string, id string, _kept string"


def rows():
    """Nulls, empty and long texts, ties, repeats; the other columns' names are those that operators use."""
    rnd = random.Random(5)
    words = [w + s for w in "alpha beta gamma delta eps zeta eta theta".split() for s in ("", ".", "É", "x9")]
    texts = [None, "", " ", "\n", "\n\n", "One", "same line\nSAME LINE\t\nother", "a b c", "###", "é è ê", "word " * 3000, "日本語テキスト", "x" * 5000]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 12, 40, 300]))) + "\nshared line " + str(k % 2) for k in range(40)]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(100 + k, texts[20]) for k in range(15)] + [(7, "a b c"), (7, "another text of seven"), (None, "no id"), (None, "no id"), (None, None), (-3, texts[21] + " tail")]
    return [(i, t, "r", 1, 2, "s", "t", "u", "v") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1]) for r in rows()]


def brute_lines(data, least):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    where = defaultdict(set)
    for i, t in set(data):
        for x in (t or "").split("\n"):
            where[key(x)].add((i, t))
    return [(i, (t or "").count("\n") + 1, sum(1 for x in (t or "").split("\n") if key(x) and len(where[key(x)]) >= least), "\n".join(x for x in (t or "").split("\n") if not (key(x) and len(where[key(x)]) >= least))) for i, t in data]


def test_line_dedup(docs, empty):
    got = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=10))
    assert set(docs.columns) <= set(got.columns)
    assert Counter((r.doc_id, r["_lines"], r["_dropped"], r["_kept"]) for r in got.select("doc_id", "_lines", "_dropped", lines.F.col("_kept")).collect()) == Counter(brute_lines(pairs(), 10))
    assert lines.apply_bitmaps(empty, lines.keep_bitmaps(empty)).count() == 0


def test_line_dedup_keeps_firsts(spark):
    df = spark.createDataFrame([(2, "a\nb\nA "), (1, "b\nc"), (3, "\n".join(map(str, range(200))) + "\nc")], "doc_id long, text string")
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_docs=1, keep="first")).select("doc_id", "_kept").collect()
    assert dict(got) == {1: "b\nc", 2: "a", 3: "\n".join(map(str, range(200)))}


def test_line_dedup_runs_no_python(docs):
    plan = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def brute_repeats(words, least):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    covered = {p for i in range(n) if best[i] >= least for p in range(i, i + best[i])}
    return len(covered), max(best, default=0)


def test_suffix_array_repetition():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abc"[: rnd.choice([1, 2, 3])]) for _ in range(rnd.randrange(60))) for _ in range(60)] + [None, "", "a", "a a", "x\ny\nx\n\n", "#*$ é%&|<>"]
    for text, got in zip(texts, repetition.measure(texts), strict=True):
        words = (text or "").split()
        assert got[0] == len(words) and got[1] == sum(map(len, words))
        assert got[2] == sum(c in "#*$%&|<>" for c in text or "")
        full = [x for x in (text or "").split("\n") if x.strip()]
        assert got[3] == len(full) - len(set(full))
        assert got[4] == brute_repeats(words, 5)[0]
        assert got[5:] == brute_repeats(words, repetition.SPAN)


def test_quality_rules_rows(docs, empty):
    got = repetition.quality_rules(docs).collect()
    assert len(got) == len(rows()) and all(not r.kept for r in got if r.n_words < 10)
    assert [r.base_failed for r in got if r.n_words == 3000] == [True]
    assert repetition.quality_rules(empty).count() == 0


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(items)):
        groups[find(i)].append(items[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(items))]


def test_simhash_near_dedup(docs, empty):
    data = [(i, brute_fp(t)) for i, t in pairs()]
    want = Counter((i, f, c) for (i, f), c in zip(data, brute_components(data), strict=True))
    got = simhash.near_dedup(docs).select("doc_id", "fp", "component_id").collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_links_agree_with_all_pairs_in_crowded_cells(spark, crowd):
    rnd = random.Random(crowd)
    fps = {0, 1, 2**63}
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.choice([1, 2, 3, 4]))) & (2**64 - 1))
    items = sorted((f - 2**64 if f >= 2**63 else f, f) for f in fps)
    nodes = spark.createDataFrame([(f,) for f, _ in items], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, crowd)).collect()}
    assert [roots.get(f, f) for f, _ in items] == brute_components(items)


def test_one_row_of_each_group_stays(docs):
    data = [(i, t, brute_fp(t)) for i, t in pairs()]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", "text").collect()
    comp = brute_components([(i, f) for i, _, f in data])
    assert len(got) == len(set(brute_components([(k, f) for k, (_, _, f) in enumerate(data)])))
    assert {r.doc_id for r in got if r.doc_id is not None} == {c for c in comp if c is not None}


def test_quality_classifier(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    voter = neighbours.fit(d, labels)
    got = neighbours.classify(d, voter).join(labels, "doc_id").select("doc_id", "predicted", "quality").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    out = neighbours.classify(docs, voter)
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == len(rows())
    assert neighbours.classify(empty, voter).count() == 0
    nothing = neighbours.fit(empty, labels.limit(0))
    assert {r.score for r in neighbours.classify(docs, nothing).collect()} == {0.5}


def test_votes_are_exact():
    rnd = np.random.default_rng(3)
    texts = ["".join(rnd.choice(list("abc ABC!#\n"), 80)) for _ in range(60)]
    y = rnd.integers(0, 2, 60)
    v = neighbours.Voter(np.stack([neighbours.terms(t) for t in texts]), y, dims=8, k=5)
    for t, got in zip(texts, v.score(texts), strict=True):
        near = v.vectors @ v.embed(neighbours.terms(t)[None])[0]
        top = np.argsort(-near)[:5]
        w = np.maximum(near[top], 0) ** neighbours.POWER
        assert got == pytest.approx((w * y[top]).sum() / w.sum(), abs=1e-4)


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kernel = language.fit(d)
    got = language.identify(d, kernel).select("doc_id", "lang", "lang_pred").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    out = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in language.identify(docs, kernel).collect()}
    assert out[0, None] == out[1, ""] == out[8, "###"] == ("und", 0.0) and out[9, "é è ê"][0] != "und"
    assert language.identify(empty, kernel).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.Kernel([], [])).collect()} == {"und"}


@pytest.mark.parametrize("seed", range(30))
def test_packing_plans(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 37, 100, 1024])
    h = Counter(min(cap, max(1, int(rnd.expovariate(1 / (cap * rnd.choice([0.1, 0.3, 0.6])))))) for _ in range(rnd.choice([3, 20, 200, 2000])))
    plan = packing.solve(h, cap)
    bins = defaultdict(list)
    for size, n in h.items():
        runs = sorted(r[1:] for r in plan.runs if r[0] == size)
        for k in range(n):
            rank0, per, bin0, off = [r for r in runs if r[0] <= k][-1]
            q, m = divmod(k - rank0, per)
            bins[bin0 + q].append((off + m * size, size))
    assert sorted(bins) == list(range(plan.bins))
    for b in bins.values():
        at = 0
        for off, size in sorted(b):
            assert off == at
            at += size
        assert at <= cap


def fewest(sizes, cap):
    best = len(sizes)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for i in {f: i for i, f in enumerate(free)}.values():
            if free[i] >= sizes[k]:
                go(k + 1, free[:i] + [free[i] - sizes[k]] + free[i + 1 :])
        go(k + 1, [*free, cap - sizes[k]])

    go(0, [])
    return best


def test_dominance_never_costs_a_sequence():
    rnd = random.Random(9)
    for _ in range(60):
        sizes = sorted((rnd.randint(4, 12) for _ in range(9)), reverse=True)
        assert packing.solve(Counter(sizes), 12).bins == fewest(sizes, 12)


def test_best_fit_packing(docs, empty):
    t = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in pairs()}
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        if r.doc_id not in (7, None):
            piece = ids[r.doc_id][r.start : r.start + r.length]
            assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in pairs())
    assert sum(r.length for r in got) == total and len(seqs) <= max(-(-total // 1024), sum(r.length > 512 for r in got)) + 1
    assert packing.pack(empty, BPE).count() == 0


def test_seekable_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = seekable.read_files(seekable.write_files(docs, path, 1, str(tmp_path / "a")), str(tmp_path / "a")).collect()
    want = Counter((i, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, x in pairs())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in got if r.doc_id is not None]
    assert keys == sorted(keys)
    assert seekable.read_files(seekable.write_files(empty, path, 1, str(tmp_path / "b")), str(tmp_path / "b")).count() == 0


def test_readers_decompress_only_what_they_need():
    docs = [(k, bytes([k % 251]) * 4 * (k % 7)) for k in range(2000)]
    out = io.BytesIO()
    assert seekable.write(out, docs, frame=256) == (2000, sum(len(b) // 4 for _, b in docs))
    raw = out.getvalue()
    r = seekable.Reader(io.BytesIO(raw), len(raw))
    assert [(k, b) for k, _, b in r.documents()] == docs
    r = seekable.Reader(io.BytesIO(raw), len(raw))
    assert [(k, b) for k, _, b in r.documents({1234})] == [docs[1234]] and r.frames_read == 1
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(b for _, b in docs)
    bad = bytearray(raw)
    bad[30] ^= 1
    with pytest.raises((seekable.Corrupt, zstandard.ZstdError)):
        list(seekable.Reader(io.BytesIO(bytes(bad)), len(bad)).documents())


def test_sentencepiece_matches_the_library(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentence.model(path).library
    for chunk in (40, 100_000):
        parts = defaultdict(dict)
        for r in sentence.encode(docs, path, chunk=chunk).collect():
            parts[r.row, r.doc_id][r.chunk] = (r.ids, r.chunks)
        got = []
        for (_, i), p in parts.items():
            assert sorted(p) == list(range(p[0][1]))
            got.append((i, tuple(x for k in sorted(p) for x in p[k][0])))
        assert Counter(got) == Counter((i, tuple(lib.encode(x or ""))) for i, x in pairs())
    assert sentence.encode(empty, path).count() == 0


def test_sentencepiece_chunks_of_any_place():
    m = sentence.model(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(4)
    for k in range(120):
        pool = [list("abcdeinrst"), ["  ", " ", "   ", "a", "the", "\n", "é", "日本", "😀", "==", "ing"], ["=", "0"], ["in", " "]][k % 4]
        text = "".join(rnd.choice(pool) for _ in range(rnd.choice([1, 20, 200])))
        for size in (1, 7, 33):
            cut = sentence.split(text, size, m.longest)
            chunks = [sentence.Chunk(m, s, a, e, n == 0, n == len(cut) - 1) for n, s, a, e in cut]
            at = sentence.combine([c.transfer() for c in chunks])
            ids = [c.trace(at[n], at[n + 1]) for n, c in enumerate(chunks)]
            assert [x for y in ids for x in y] == m.library.encode(text)
            assert "".join(m.decode(y, n == 0) for n, y in enumerate(ids)) == text


def test_crc_of_parts():
    parts = [bytes([k]) * (k * 37) for k in range(12)]
    assert sentence.crc_join([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("size", [0, 1, 64, 1023, 1024, 1025, 70_000])
def test_avi_round_trip(size):
    payload = random.Random(size).randbytes(size)
    media = avi.write_avi(payload)
    back, samples = avi.read_avi(media)
    assert back == payload and len(samples) == max(1, -(-size // avi.FRAME))
    with pytest.raises(ValueError):
        avi.read_avi(media[:-1])


def test_shots_lie_where_pictures_change():
    a, b = np.full((10, avi.FRAME), 20, np.uint8), np.full((5, avi.FRAME), 200, np.uint8)
    assert avi.shots(np.concatenate([a, b, a])) == [(0, 10), (10, 15), (15, 25)]
    assert avi.shots(a[:1]) == [(0, 1)]


def test_media_columns(spark, docs, empty):
    got = [r for r in avi.store_texts(docs).collect()]
    want = Counter((i, len((t or "").encode())) for i, t in pairs())
    assert Counter((r.doc_id, r.n_bytes) for r in got) == want
    for r in got:
        d = avi.digest(r.doc_id, r.media, r.n_bytes)
        assert d[2] % 64 == 0 and d[2] >= max(64, r.n_bytes) and d[5] == len(r.media)
    data = spark.createDataFrame([(1, b"\x10" * 5120 + b"\xf0" * 5120), (2, None)], "k long, p binary")
    out = avi.clips(avi.encode_column(data, "p"), "k").orderBy("clip").collect()
    assert [(r.k, r.clip, r.start_ms, r.end_ms, r.frames) for r in out] == [(1, 0, 0, 200, 5), (1, 1, 200, 400, 5)]
    assert avi.store_texts(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, small = "x" * 200 + "é", "tiny"
    data = [(5, "http://a/1", big), (3, "http://b\r\nX: y", big), (9, None, big), (1, "http://c/", small), (2, "http://c/", small), (4, "u", None), (6, "u", ""), (3, "again", big), (None, "u", "y" * 150)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in data], "page_id long, url string, html string, payload int, digest string")
    folder = str(tmp_path / "w")
    files = warc.write_archives(pages, folder)
    recs = warc.read_archives(files, folder)
    assert recs.count() == 3 * len(data)
    caps = warc.resolve(common.materialize(warc.assemble(recs), "captures")).collect()
    got = Counter((c.main.page_id, c.main.kind, c.refers_to_page, c.main.payload_bytes, c.main.payload_digest) for c in caps)
    want = Counter()
    for i, _, h in data:
        b = (h or "").encode()
        first = 3 if h == big else None
        revisit = first is not None and i > first
        want[i, "revisit" if revisit else "response", first if revisit else None, len(b), hashlib.sha256(b).hexdigest()] += 1
    assert got == want
    assert all(len(c.requests) == len(c.metadata) == 1 for c in caps)
    none = warc.write_archives(pages.limit(0), folder)
    assert warc.assemble(warc.read_archives(none, folder)).count() == 0


def test_warc_orphans_are_kept(spark):
    recs = spark.createDataFrame([("a", "request", "gone"), ("b", "metadata", "gone"), ("c", "response", None)], "record_id string, kind string, concurrent_to string")
    got = {r.capture_id: r for r in warc.assemble(recs).collect()}
    assert got["gone"].main is None and len(got["gone"].requests) == 1 and got["c"].main.record_id == "c"


def test_cleanup_removes_what_was_written(spark, empty):
    import os

    before = set(common._made)
    df = common.materialize(empty, "some")
    path = common._made[-1]
    assert path not in before and df.count() == 0
    assert os.path.isdir(path)
    saved, common._made[:] = common._made[:-1], [path]
    common.cleanup(spark)
    common._made.extend(saved)
    assert not os.path.exists(path)
