"""The methods decide: limits that reject, kernels as they are defined, frames of other writers, archives of other writers."""

import gzip
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from quarry.llm import avi, common, jpeg, language, lines, neighbours, packing, registry, repetition, sampling, simhash, warc

SMALL = "/root/testdata/sf0.001"


# ---- operator 1


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_map", "_doc", "_a", "_b", "_row_a", "_row_b", "_dense", "_hash_a", "_hash_b", "_drops", "h1", "nth", "doc", "_hot", "_salt", "n", "pos"]
    df = spark.createDataFrame([(k, "same\nown %d" % k, *range(len(names))) for k in range(12)], ["doc_id", "text", *names])
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df)).collect()
    assert len(got) == 12 and all(r["_kept"] == "own %d" % r.doc_id and [r[n] for n in names] == list(range(len(names))) for r in got)


def test_hot_keys_are_joined_in_parts(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 1, id) AS k", "id AS v")
    one = common.materialize(rows.groupBy("k").count().withColumnRenamed("count", "n"), "one")
    got = common.join_counted(rows, one, ["k"], ["v"]).agg({"n": "sum", "v": "count"}).first()
    assert {got["count(v)"], got["sum(n)"]} == {6000, sum(r.n * r.n for r in one.collect())}
    some = rows.selectExpr("if(v % 2 = 0, NULL, k) AS k", "v")
    assert common.join_counted(some, one.filter("k < 100"), ["k"], ["v"], how="left").count() == 6000


# ---- operator 2


def test_limits_bind_beyond_the_base_rules(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = repetition.quality_rules(d).filter("NOT base_failed").collect()
    rejected = [r for r in got if not r.kept]
    assert rejected and len(rejected) < len(got) / 20


def test_intervals_are_those_of_the_definition():
    rnd = random.Random(3)
    for _ in range(200):
        lcp = np.array([rnd.randrange(4) for _ in range(rnd.randrange(20))], np.int64)
        want = set()
        for i in range(len(lcp)):
            for j in range(i, len(lcp)):
                n = lcp[i : j + 1].min()
                if n >= 1 and (i == 0 or lcp[i - 1] < n) and (j == len(lcp) - 1 or lcp[j + 1] < n):
                    want.add((int(n), i, j + 1))
        assert set(zip(*(x.tolist() for x in repetition.intervals(lcp, 1)), strict=True)) == want


def test_a_giant_periodic_text():
    n = 200_000
    assert repetition.measure(["lorem ipsum " * (n // 2)])[0][4:] == (n, n, n - 2)


# ---- operator 3


def test_cells_hold_all_pairs_within_two_bits(spark):
    rnd = random.Random(8)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    pairs = []
    for k in range(300):
        a = rnd.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rnd.sample(range(64), k % 3))))
    df = spark.createDataFrame([(signed(f),) for p in pairs for f in p], "fp long").distinct()
    cells = {}
    for r in simhash.cells(simhash.distances(df)).collect():
        cells.setdefault(r.fp % 2**64, set()).add(r.cell)
    assert all(len(c) <= 33 and len(c) >= 17 for c in cells.values())
    assert all(cells[a] & cells[b] for a, b in pairs)


def test_representatives_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7), (3, "d e f g", 5, 6, 7)], ["doc_id", "text", "_id", "_row", "_n"])
    got = simhash.representatives(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


# ---- operators 4 and 7


def test_documents_of_both_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"text number {k} with words") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    used = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(20) if k != 3)
    assert len(neighbours.fit(docs, labels).y) == used


def test_latent_space_is_the_truncated_svd():
    rnd = np.random.default_rng(5)
    x = (rnd.random((60, 200)) * (rnd.random((60, 200)) < 0.2) * np.linspace(3, 0.1, 60)[:, None]).astype(np.float32)
    scale = rnd.uniform(1, 3, 200).astype(np.float32)
    v = neighbours.right_vectors(x, scale, 8, rounds=60)
    want = np.linalg.svd(x * scale)[2][:8].T
    assert np.allclose(v @ v.T, want @ want.T, atol=2e-2)


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k, f"word{k % 300:03d} " * 5, f"l{k % 300:03d}") for k in range(1500)], "doc_id long, text string, lang string")
    kernel = language.fit(docs)
    assert len(kernel.langs) == 300
    some = sampling.per_class(docs, "lang", 300, total=600).groupBy("key").count().collect()
    assert len(some) == 300 and {r["count"] for r in some} == {2}


def test_letters_are_category_l():
    assert not any(map(language.has_letter, [None, "", "½ ²", "Ⅷ", "12 # _", "①"]))
    assert all(map(language.has_letter, ["a", "½x", "日", "ª", "ǅ"]))


def brute_grams(text):
    b = b" " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b" "
    return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}


def test_scores_are_those_of_kernel_ridge_regression():
    rnd = random.Random(2)
    pools = {"aa": "abcde", "bb": "defgh", "cc": "hijklé"}
    make = lambda g: " ".join("".join(rnd.choice(pools[g]) for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(2, 12)))
    train = [(g, make(g)) for g in pools for _ in range(rnd.randrange(9, 14))]
    tests = [make(g) for g in pools for _ in range(5)] + ["", "Z", "zzzz yyyy", None]
    kernel = language.Kernel([language.grams(t) for _, t in train], [g for g, _ in train], landmarks=6)
    k = lambda s, t: len(brute_grams(s) & brute_grams(t)) / np.sqrt(len(brute_grams(s)) * len(brute_grams(t)))
    marks = [t for g in sorted(pools) for t in [x for h, x in train if h == g][:6]]
    gram = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    half = vectors / np.sqrt(np.maximum(values, 1e-6))
    feature = lambda t: np.append(np.array([k(t or "", m) for m in marks]) @ half, 1)
    z = np.array([feature(t) for _, t in train])
    count = {g: sum(h == g for h, _ in train) for g in pools}
    w = np.diag([len(train) / count[g] for g, _ in train])
    y = np.array([[1.0 if g == h else -1.0 for h in sorted(pools)] for g, _ in train])
    coef = np.linalg.solve(z.T @ w @ z + language.RIDGE * len(train) * np.eye(z.shape[1]), z.T @ w @ y)
    got = kernel.block([language.grams(t) for t in tests]) @ kernel.matrix + kernel.bias
    assert np.allclose(got, [feature(t) @ coef for t in tests], atol=5e-3)


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op7_language_id"])
def test_contract_columns(spark, name):
    mod, rest = (5, 0) if name.startswith("op4") else (4, 2)
    got = registry.QUERIES[name](spark, SMALL).collect()
    assert len(got) == common.table(spark, SMALL, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in got)


# ---- operator 9


def put_bits(codes):
    bits = "".join(format(v, f"0{n}b") for v, n in codes if n)
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def code_book(counts, symbols):
    out, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for s in symbols[at : at + k]:
            out[s] = (code, n)
            code += 1
        at += k
        code <<= 1
    return out


def magnitude(v):
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1, n)


def encode_jpeg(planes, factors, quant, tables=True, restart=0):
    """A plain encoder: float transform, the standard's codes."""
    h, w = planes[0].shape
    u = np.arange(8)
    basis = np.where(u[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    zig = sorted(range(64), key=lambda k: ((k // 8 + k % 8), (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
    book = {key: (bytes.fromhex(a), bytes.fromhex(b)) for key, (a, b) in jpeg.STANDARD.items()}
    most = max(f for f, _ in factors), max(f for _, f in factors)
    rows, cols = -(-h // (8 * most[1])), -(-w // (8 * most[0]))
    grids = []
    for p, (fh, fv) in zip(planes, factors, strict=True):
        small = p[:: most[1] // fv, :: most[0] // fh].astype(float)
        full = np.pad(small, ((0, 8 * fv * rows - small.shape[0]), (0, 8 * fh * cols - small.shape[1])), mode="edge") - 128
        grids.append({(y, x): np.rint((basis @ full[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] @ basis.T).ravel()[zig] / quant).astype(int) for y in range(fv * rows) for x in range(fh * cols)})
    scans, codes, before = [], [], [0] * len(planes)
    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            scans.append(put_bits(codes))
            codes, before = [], [0] * len(planes)
        y, x = divmod(unit, cols)
        for i, (fh, fv) in enumerate(factors):
            dc, ac = code_book(*book[0, int(i > 0)]), code_book(*book[1, int(i > 0)])
            for j in range(fh * fv):
                c = grids[i][y * fv + j // fh, x * fh + j % fh].tolist()
                n, bits = magnitude(c[0] - before[i])
                codes += [dc[n], bits]
                before[i], run = c[0], 0
                last = max((k for k in range(1, 64) if c[k]), default=0)
                for v in c[1 : last + 1]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        codes.append(ac[0xF0])
                        run -= 16
                    n, bits = magnitude(v)
                    codes += [ac[run << 4 | n], bits]
                    run = 0
                if last < 63:
                    codes.append(ac[0])
    scans.append(put_bits(codes))
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(quant.tolist())) + seg(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(factors)))
    if tables:
        head += b"".join(seg(0xC4, bytes([k << 4 | i]) + a + b) for (k, i), (a, b) in book.items())
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    head += seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0x11 * (i > 0)]) for i in range(len(planes))) + b"\x00\x3f\x00")
    body = scans[0] + b"".join(b"\xff" + bytes([0xD0 + k % 8]) + s for k, s in enumerate(scans[1:]))
    return head + body + b"\xff\xd9"


def picture(h, w, seed):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 60 * np.sin(x / (3 + seed)) + 50 * np.cos(y / 5 + seed) + np.random.default_rng(seed).integers(-9, 10, (h, w)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("tables", "restart"), [(True, 0), (False, 0), (True, 3)])
def test_frames_of_another_encoder(tables, restart):
    p = picture(37, 51, 1)
    back = jpeg.decode(encode_jpeg([p], [(1, 1)], np.ones(64, int), tables, restart))
    assert back.shape == p.shape and np.abs(back.astype(int) - p).max() <= 2
    coarse = jpeg.decode(encode_jpeg([p], [(1, 1)], np.full(64, 12), tables, restart))
    assert np.abs(coarse.astype(int) - p).mean() < 6


def test_colour_frames():
    y, cb, cr = picture(40, 56, 2), np.full((40, 56), 90, np.uint8), np.full((40, 56), 170, np.uint8)
    back = jpeg.decode(encode_jpeg([y, cb, cr], [(2, 2), (1, 1), (1, 1)], np.ones(64, int))).astype(float)
    want = np.stack([y + 1.402 * 42, y - 0.344136 * -38 - 0.714136 * 42, y + 1.772 * -38], -1).clip(0, 255)
    assert back.shape == (40, 56, 3) and np.abs(back - want).max() <= 4


def test_own_frames_are_plain_jpeg():
    x = np.random.default_rng(0).integers(0, 256, (3, avi.FRAME)).astype(np.uint8)
    for row, f in zip(x, avi.encode_frames(x), strict=True):
        assert (jpeg.decode(f) == row.reshape(avi.SIDE, avi.SIDE).repeat(8, 0).repeat(8, 1)).all()


@pytest.mark.parametrize("harm", [lambda f: f[:-40], lambda f: b"", lambda f: f[:30], lambda f: f.replace(b"\xff\xc0", b"\xff\xc2"), lambda f: b"\xff\xd8\xff\xd9"])
def test_broken_frames_are_errors(harm):
    with pytest.raises(ValueError):
        jpeg.decode(harm(encode_jpeg([picture(16, 16, 3)], [(1, 1)], np.ones(64, int))))


def foreign_avi(frames, rate=30000, scale=1001, absolute=False, index=True):
    avih = struct.pack("<14I", 33_367, 0, 0, 0x10, len(frames), 0, 1, 0, 16, 16, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, scale, rate, 0, len(frames), 0, 0, 0, 0, 0, 16, 16)
    head = avi._chunk(b"LIST", b"hdrl" + avi._chunk(b"avih", avih) + avi._chunk(b"LIST", b"strl" + avi._chunk(b"strh", strh)))
    movi, entries = b"movi", []
    for f in frames:
        entries.append((len(movi), len(f)))
        movi += avi._chunk(b"00dc", f) + avi._chunk(b"01wb", b"sound")
    base = 12 + len(head) + 8 if absolute else 0
    idx = avi._chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, base + a, n) for a, n in entries)) if index else b""
    body = b"AVI " + head + avi._chunk(b"LIST", movi) + idx
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(("absolute", "index"), [(False, True), (True, True), (False, False)])
def test_clips_of_another_writers_file(spark, absolute, index):
    dark, light = (encode_jpeg([np.full((16, 16), v, np.uint8)], [(1, 1)], np.ones(64, int), tables=False) for v in (20, 200))
    media = foreign_avi([dark] * 30 + [light] * 15, absolute=absolute, index=index)
    df = spark.createDataFrame([(1, media), (2, b"no avi"), (3, None), (4, foreign_avi([dark[:-9]])), (5, foreign_avi([]))], "clip long, media binary")
    got = avi.clips(df.withColumnRenamed("clip", "k"), "k").collect()
    assert [(r.start_ms, r.end_ms, r.frames, round(r["mean"])) for r in got if r.k == 1] == [(0, 1001, 30, 20), (1001, 1501, 15, 200)]
    assert sorted(r.k for r in got if r.error) == [2, 4, 5] and all(r["clip"] is None for r in got if r.error)


def test_op9_columns(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op9_avi"](spark, SMALL).collect()}
    for d in common.table(spark, SMALL, "documents").collect():
        raw = (d.text or "").encode()
        full = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[d.doc_id]
        samples = np.frombuffer(full.ljust(-(-len(full) // 1024) * 1024, b"\0"), np.uint8).reshape(-1, 1024)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = avi.write_avi(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"frames={len(samples)};shots={len(r.clips)};") and r.feature.endswith(f"mean={int(samples.sum()) // samples.size}")
        assert r.clips[0].start_ms == 0 and r.clips[-1].end_ms == len(samples) * 40 and sum(c.frames for c in r.clips) == len(samples)
        frames = avi.index_avi(media).frames
        assert (jpeg.decode(frames[-1])[::8, ::8].ravel() == samples[-1]).all()


# ---- operator 10


def test_damaged_payloads_are_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 300)], "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path))
    path = next(tmp_path.glob("*.warc.gz"))
    raw = gzip.decompress(path.read_bytes())
    path.write_bytes(gzip.compress(raw.replace(b"xxx", b"xyx", 1)))
    with pytest.raises(Exception, match="payload digest"):
        warc.read_archives(files, str(tmp_path)).collect()


def test_archives_of_another_writer(spark, tmp_path):
    body = b"y" * 120
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 120\r\n\r\n"
    import base64

    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    kind = ("Content-Type", "application/http; msgtype=response")
    one = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Target-URI", "http://u/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", sha1), ("X-Page-Id", "7"), kind]
    two = [("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:b>"), ("WARC-Target-URI", "http://v/"), ("WARC-Date", "2021-01-01T00:00:00Z"), ("WARC-Payload-Digest", sha1), ("WARC-Refers-To", "<urn:a>"), kind]
    out = io.BytesIO()
    for h, b in ((one, http + body), (two, http), ([*two[:1], ("WARC-Record-ID", "<urn:c>"), *two[2:5], ("WARC-Refers-To", "<urn:gone>"), kind], http)):
        out.write(warc.record(h, b))
    (tmp_path / "f.warc.gz").write_bytes(out.getvalue())
    recs = warc.read_archives(spark.createDataFrame([("f.warc.gz",)], "file string"), str(tmp_path))
    got = {r.capture_id: r for r in warc.resolve(common.materialize(warc.assemble(recs), "captures")).collect()}
    assert got["<urn:a>"].main.payload_digest == hashlib.sha256(body).hexdigest() and got["<urn:a>"].refers_to_page is None
    assert got["<urn:b>"].refers_to_page == 7 and got["<urn:b>"].main.payload_bytes == 120 and got["<urn:c>"].refers_to_page is None


def test_revisits_carry_the_standard_headers(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://p/{k}", "z" * 200) for k in (4, 2, 9)], "page_id long, url string, html string")
    recs = warc.read_archives(warc.write_archives(pages, str(tmp_path)), str(tmp_path)).filter("kind = 'revisit'").collect()
    digest = hashlib.sha256(b"z" * 200).hexdigest()
    assert len(recs) == 2 and {(r.refers_to, r.refers_to_uri, r.refers_to_date) for r in recs} == {(warc.page_urn(2, digest), "http://p/2", warc.DATE)}


# ---- operator 5


def test_reductions_are_counted():
    plan = packing.solve({10: 3, 7: 2, 3: 2, 6: 5}, 10)
    assert plan.bins == 3 + 2 + 5
