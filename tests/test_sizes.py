"""Queries on rows that only larger tables have: keys beyond limits, crowded groups, many windows."""

import datetime
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from quarry import plans
from quarry.functions import fts
from quarry.operators import search


def both(spark, tmp_path, name, table, rows, schema):
    """Sorted rows of a query and of its SQL over one written table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}")
    (part,) = tmp_path.glob(f"{table}/*.parquet")
    part.rename(tmp_path / f"{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = c.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, df.select(*names).collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_morton_code_beyond_the_limits(spark, tmp_path):
    rows = [(1, 5.0), (286_001, -7.25), (900_000, 9999.99), (5_400_000, 0.0), (-500_000, 3.0), (7, 2e6), (8, -3e6), (9, None)]
    got, want = both(spark, tmp_path, "morton_code", "customer", rows, "c_custkey long, c_acctbal double")
    assert got == want


def test_range_counts_of_a_crowded_user_and_type(spark, tmp_path):
    """A frame that is filled anew for every row of the type would read 8 * 10^8 rows."""
    odd = [(1, None, "a", 5.0), (2, None, "a", 10.0), (3, 7, None, 0.1), (4, 7, None, 5.1), (5, 7, "a", 10.1), (6, 7, "b", None), (7, 7, "b", -0.0), (8, 7, "b", 5.0), (9, -3, "b", 1e300), (10, 8, "b", float("inf"))]
    crowd = [(100 + k, 1, "view", float(k % 40) / 4) for k in range(3000)] + [(10_000 + k, 50 + k, "view", 3.5) for k in range(40_000)]
    start = time.perf_counter()
    got, want = both(spark, tmp_path, "win_range_offset", "events", odd + crowd, "event_id long, user_id long, event_type string, value double")
    assert got == want
    assert time.perf_counter() - start < 60


def test_streams_leave_their_rows_in_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(hours=3 * (k // 50), minutes=k), k % 50, "click") for k in range(1000)]
    rows += [(2000 + k, at + datetime.timedelta(hours=2 * k), 99, "view") for k in range(3)]  # just the gap apart
    for name in ("stream_session", "stream_dedup"):
        got, want = both(spark, tmp_path / name, name, "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
        assert got == want
    df = plans.QUERIES["stream_session"](spark, str(tmp_path / "stream_session"))
    assert df.inputFiles() and df._jdf.queryExecution().analyzed().toString().find("MemoryPlan") < 0


def test_band_join_deals_its_pairs_to_many_tasks(spark, tmp_path):
    values = [99.99999999999999, 200.0, 199.99999999999997, 0.0, -0.0, -999.5, -899.5, 1e300, -1e300, float("nan"), float("inf"), float("-inf"), None, 0.1, 100.1, 100.09999999999999]
    rows = list(enumerate(values + [float(k * 37 % 5000) / 4 for k in range(1500)]))
    got, want = both(spark, tmp_path, "join_theta_band", "supplier", rows, "s_suppkey long, s_acctbal double")
    assert got == want and (0, 1) in got
    df = plans.QUERIES["join_theta_band"](spark, str(tmp_path))
    each = [n for (n,) in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").collect()]
    assert len(each) > 64 and max(each) < len(got) / 16


WORDS = ["of", "OF", "ofs", "Öf", "ÓF", "ofİ", "İ", "İx", "xi", "Xİ", "xiİ", "motor", "Motores", "MOTORS", "motoring", "naçao", "NAÇÕES", "nacoes", "city", "cities", "citys", "Kelvin", "οδοΣ", "1Σ", "\U0001d400of", "of\U0001d400", "日本of", "of2", "á", "_", "²", ""]


def test_highlight_in_one_pass_marks_as_word_by_word(spark):
    """Against each word's own token, with the marks that replacements escape."""
    rnd = random.Random(5)
    texts = [rnd.choice(["", " "]) + "".join(rnd.choice(WORDS) + rnd.choice([" ", "_", " , ", "\n", "\U0001f600"]) for _ in range(30)) + rnd.choice(WORDS) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    queries = ["of", "i OR xi", "motor", "nacao OR city", "kelvin", "οδος", "of motor", "-of", "cit*"]
    got = df.select("text", *[fts.highlight(F.col("text"), fts.parse(q), "$1\\[", "]$").alias(f"q{k}") for k, q in enumerate(queries)]).collect()
    for r in got:
        for k, q in enumerate(queries):
            single = {w for g in fts.parse(q).groups for t in g for w in t.words if not t.prefix}
            hit = lambda w, s=single, q=q: (x := fts.words(w)[0]) in s or q == "cit*" and x.startswith("cit")
            assert r[f"q{k}"] == (None if r.text is None else re.sub(r"[^\W_]+", lambda m: f"$1\\[{m[0]}]$" if hit(m[0]) else m[0], r.text)), q
    plan = df.select(fts.highlight(F.col("text"), fts.parse("of")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "lambda" not in plan


def test_frequencies_are_the_lengths_of_postings(spark, tmp_path):
    texts = ["Café cafe CAFÉS, naçao nações", "cafe", "", None, "motoring motor Motors_motor", "İx of²", "the thing"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(4, "motors again"), (None, "the the")], "id long, text string")
    want = {(r.id, r.term): r.n for r in search.postings(docs, "id", ["text"]).select("id", "term", F.size("positions").alias("n")).collect()}
    out = search.frequencies(docs, "id", ["text"])
    assert {(r.id, r.term): r.n for r in out.collect()} == want and want[4, "motor"] == 5
    out = search.frequencies(docs, "id", ["text"])  # its plan before it runs
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of texts, none of words


def test_postings_count_documents_as_their_sql(spark, tmp_path):
    rows = [(k % 60, f"word{k % 3} été {k}s") for k in range(240)] + [(None, "word1 word1")]
    got, want = both(spark, tmp_path, "fts_postings", "documents", rows, "doc_id long, text string")
    assert got == want and len(got) == 1
