"""Golden values of functions, text search, space, storage and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates, documents, fts, numbers, spatial, text, vectors
from quarry.operators import recursive, search
from quarry.sources import copy
from quarry.storage import tables
from quarry.streaming import changes, events


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


L = F.lit


def test_text(value):
    assert value(text.initcap(L("ola-mundo DO norte"))) == "Ola-Mundo Do Norte"
    assert value(text.concat(L("a"), L(None), L("b"))) == "ab"
    assert [value(text.substr(L("hello"), *a)) for a in ((0, 3), (1, 3), (-3,), (-3, 2), (2,), (0, 1), (-9, 6))] == ["he", "hel", "llo", "ll", "ello", "", "he"]
    assert [value(text.split_part(L("a,b,c"), ",", n)) for n in (1, 3, 4, -1, -9)] == ["a", "c", "", "c", "a"]
    assert value(text.trim(L("\t x \n"))) == "x" and value(text.unicode(L(""))) is None
    assert value(text.char(L(72), L(233), L(128512))) == "Hé😀"
    assert value(text.quote_literal(L("it's"))) == "'it''s'" and value(text.quote_nullable(L(None).cast("string"))) == "NULL"
    assert value(text.like(L("ABC"), "a_c")) and value(text.like(L("a\\b"), "a\\%"))
    assert [value(text.glob(L("file1.txt"), p)) for p in ("file?.*", "FILE*", "file[0-9].txt", "file[!0-9].txt", "*[x]t")] == [True, False, True, False, True]


def test_numbers(value):
    assert value(numbers.int_div(L(-7), L(2))) == -3 and value(numbers.int_div(L(1), L(0))) is None and value(numbers.mod(L(1), L(0))) is None
    assert value(numbers.shift_left(L(1), 65)) == 0 and value(numbers.shift_left(L(8), -2)) == 2
    assert value(numbers.round_half_away(L(-2.5))) == -3.0 and value(numbers.round_half_away(L(1.005), 2)) == 1.0
    assert value(numbers.log(L(100.0))) == 2.0 and value(numbers.to_int(L("3.9"))) == 3 and value(numbers.trunc(L(-2.77), 1)) == -2.7


def test_dates(value):
    t = L(datetime.datetime(2024, 1, 31, 10, 30)).cast("timestamp_ntz")
    assert value(dates.date(t, "+1 month")) == "2024-03-02" and value(dates.datetime(t, "start of month", "+1 day")) == "2024-01-02 00:00:00"
    assert value(dates.date(t, "weekday 0")) == "2024-02-04" and value(dates.date(t, "-1 year")) == "2023-01-31"
    assert value(dates.strftime("%d/%m %H:%M %j %w%%", t)) == "31/01 10:30 031 3%" and value(dates.weekday(t)) == 3
    assert value(dates.diff(t, L("2024-01-01").cast("timestamp_ntz"))) == 30 and value(dates.julianday(L("2000-01-01 12:00:00").cast("timestamp_ntz"))) == 2451545.0


def test_documents(value):
    doc = L('{"b": [1, {"c": "x"}], "a": 2.5}')
    assert value(documents.json_extract(doc, "$.b[1].c")) == "x" and value(documents.json_extract(L("{"), "$.a")) is None
    assert value(documents.json_normal(doc)) == '{"a":2.5,"b":[1,{"c":"x"}]}' and value(documents.json_array_length(doc)) == 0
    assert [value(documents.json_type(L(x))) for x in ("[1]", "{}", "1", '"s"', "true", "1.5", "null")] == ["array", "object", "integer", "text", "boolean", "real", "null"]
    assert value(documents.regexp_replace_first(L("banana"), "(a)n", r"<\1>")) == "b<a>ana" and value(documents.regexp_replace_first(L("banana"), "A", "o", "gi")) == "bonono"
    assert value(documents.regexp_substr(L("abc"), "x")) is None
    assert value(documents.array_from_text(L("{a,b}"))) == ["a", "b"] and value(documents.array_from_text(L('["x"]'))) == ["x"]
    assert value(documents.typeof(L(1))) == "integer" and value(documents.typeof(L(1.5))) == "real"


def test_search(spark, value):
    assert value(fts.tokens(L("Os Jogos, correções e playing!"))) == fts.words("Os Jogos, correções e playing!") == ["os", "jogo", "correcao", "e", "play"]
    docs = spark.createDataFrame([(1, "motor do jogo"), (2, "sombra e luz"), (3, "luz do motor"), (4, "")], "id int, body string")
    hit = lambda q: sorted(r.id for r in search.match(docs, ["body"], q).collect())
    assert hit("motor jogo") == [1] and hit("jogo OR luz") == [1, 2, 3] and hit("motor -jogo") == [3] and hit('"motor do"') == [1]
    assert hit('"do motor"') == [3] and hit("somb*") == [2] and hit("-motor") == []
    assert value(fts.highlight(L("Motor do jogo"), fts.parse("motores OR jog*"))) in ("[Motor] do [jogo]", "Motor do [jogo]")
    import math

    got = {r.id: r.score for r in search.bm25(docs, "id", ["body"], "motor").collect()}
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    assert got[1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2.25))) and set(got) == {1, 3}


def test_counts_agree_with_tokens(spark):
    text = "correções correção coes party parties paes pao es e the thes thing things playing play plays aes ao y ies caes cao " * 2
    df = spark.createDataFrame([(text,)], "t string")
    own = fts.words(text)
    for w in sorted(set(own)) + ["zz"]:
        for prefix in (False, True):
            want = sum(x.startswith(w) if prefix else x == w for x in own)
            assert df.select(fts.count(fts.unstemmed(F.col("t")), w, prefix)).first()[0] == want, (w, prefix)


def test_vectors_and_space(spark, value):
    a, z = F.array(L(3.0), L(4.0)), F.array(L(0.0), L(0.0))
    assert value(vectors.norm(a)) == 5.0 and value(vectors.cosine(a, z)) == 1.0 and value(vectors.l2(a, F.array(L(1.0)))) is None and value(vectors.parse(L("[1, 2.5]"))) == [1.0, 2.5]
    pts = spark.range(2000).select("id", ((F.col("id") % 50) * 2.0 - 50).alias("x"), (F.floor(F.col("id") / 50) * 2.5 - 50).alias("y"))
    coded = pts.withColumn("code", spatial.morton(F.col("x"), F.col("y")))
    low, high = [-3.0, 0.0], [4.5, 7.0]
    found = spatial.ranges(low, high)
    assert len(found) <= 64
    exact = {r.id for r in search.box(pts, ["x", "y"], low, high).collect()}
    assert exact and {r.id for r in search.box(coded, ["x", "y"], low, high, "code").collect()} == exact
    assert value(spatial.morton(L(1.0), L(2.0), L(3.0))) == sum(spatial.spread(spatial.cell_of(v, 21), 3, 21) << k for k, v in enumerate((1.0, 2.0, 3.0)))
    assert abs(value(spatial.sphere(L(0.0), L(0.0), L(0.0), L(180.0))) - 3.141592653589793 * spatial.EARTH) < 1


def test_fixpoint(spark):
    g = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src long, dst long")
    step = lambda f: f.join(g, f.n == g.src).select("dst")
    assert sorted(r.n for r in recursive.union_fixpoint(spark.range(1, 2).toDF("n"), step).collect()) == [1, 2, 3, 4]
    double = recursive.union_fixpoint(spark.range(1, 2).toDF("n"), lambda f: f.selectExpr("n * 2"), limit=6)
    assert max(r.n for r in double.collect()) == 32
    with pytest.raises(recursive.RoundLimit):
        recursive.union_fixpoint(spark.range(1, 2).toDF("n"), lambda f: f.selectExpr("n + 1"), max_rounds=3)


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    t = tables.Table(spark, root, "t", tables.Constraints(key=("k",), unique=(("u",),), checks={"v": "v >= 0"}))
    t.create(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, u string, v int"))
    new = spark.createDataFrame([(2, "c", 5), (3, "a", 7)], "k int, u string, v int")
    with pytest.raises(tables.ConstraintError):
        t.insert(new)
    with pytest.raises(tables.ConstraintError):
        t.update("k = 1", {"v": F.lit(-1)})
    assert t.version() == 0
    t.insert(new, "replace")
    assert sorted(map(tuple, t.read().collect())) == [(2, "c", 5), (3, "a", 7)] and t.read(0).count() == 2
    t.add_column("w", "string", "x")
    t.rename_column("w", "z")
    assert t.read().columns == ["k", "u", "v", "z"]
    t.restore(0)
    assert sorted(r.k for r in t.read().collect()) == [1, 2]
    with pytest.raises(tables.Conflict):
        t._publish(t.read(), 0)
    child = tables.Table(spark, root, "c", tables.Constraints(foreign=(tables.ForeignKey("p", "t", "k", "restrict"),)))
    child.create(spark.createDataFrame([(1,)], "p int"))
    with pytest.raises(tables.ConstraintError):
        t.delete("k = 1", [child])
    assert {r["_kind"] for r in t.changes().collect()} >= {"insert", "upsert"}


def test_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, "tab\there", None), (2, "back\\slash \\N \\t", 1.5), (3, "", 2.0), (None, "line\nend\r", 0.0)], "a int, b string, c double")
    copy.copy_to(df, str(tmp_path / "c"))
    assert sorted(map(repr, copy.copy_from(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(map(repr, df.collect()))


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b") for m in range(0, 60, 7)]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(str(tmp_path / "e"))
    got = events.collect(events.tumbling(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e")), "ts", "10 minutes", ["k"], F.count("k").alias("n")))
    want = spark.read.parquet(str(tmp_path / "e")).groupBy(F.window("ts", "10 minutes"), "k").count()
    assert sorted((r.window_start, r.k, r.n) for r in got.collect()) == sorted((r.window.start, r.k, r["count"]) for r in want.collect())


def test_change_feeds(spark, tmp_path):
    root = str(tmp_path)
    one = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    t = tables.Table(spark, root, "t", tables.Constraints(key=("k",))).create(one((1, "a"), (2, "b")))
    log = []
    changes.on_commit(t, lambda kind, rows: log.append((kind, rows.count())))
    view = tables.MaterializedView(spark, root, "n", lambda: t.read().groupBy().count(), (t,))
    copy_ = tables.Table(spark, root, "copy", t.constraints).create(t.read(0).limit(0))
    changes.replicate(t, copy_, f"{root}/_cp")
    t.insert(one((3, "c")))
    t.update("k = 1", {"v": F.lit("z")})
    t.delete("k = 2")
    assert view.read().first()[0] == 2 and log == [("insert", 1), ("update", 1), ("delete", 1)]
    changes.replicate(t, copy_, f"{root}/_cp")
    assert sorted(map(tuple, copy_.read().collect())) == sorted(map(tuple, t.read().collect())) == [(1, "z"), (3, "c")]
    ch = changes.Channel(spark, root, "news")
    ch.notify("x", "y")
    ch.notify("z")
    assert [r.payload for r in ch.since(0).collect()] == ["z"] and ch.since().count() == 3
