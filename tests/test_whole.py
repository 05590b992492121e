"""Queries over whole tables: brute force on small fixtures and SQL without cuts."""

import re

import duckdb
import numpy as np
import pytest

from quarry import plans
from quarry.functions import fts
from quarry.operators import search

SF = "/root/testdata/sf0.001"


def sql(text):
    c = duckdb.connect()
    for t in plans.base.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.sql(text).fetchall()


def marked(text):
    return None if text is None else re.sub(r"[^\W_]+", lambda m: f"[{m[0]}]" if fts.words(m[0]) == ["of"] else m[0], text)


def test_highlight_marks_whole_texts_of_all_documents(spark, tmp_path):
    long = "x " * 150
    texts = [long + "of", "é of OF", "Öf offen of.", "le chat", "", None, "of_of 日本 of"]
    spark.createDataFrame([(k, t, "en" if k < 2 else "fr") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(plans.QUERIES["fts_highlight"](spark, str(tmp_path)).collect())
    assert got == {k: marked(t) for k, t in enumerate(texts)}
    assert got[0].endswith("[of]") and got[1] == "é [of] [OF]"
    real = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert dict(plans.QUERIES["fts_highlight"](spark, SF).collect()) == {k: marked(t) for k, t in real.items()}


def test_unnest_gives_all_words(spark):
    got = [tuple(r) for r in plans.QUERIES["unnest_ordinality"](spark, SF).select("doc_id", "word", "ordinality").collect()]
    want = sql("SELECT doc_id, unnest(str_split(text, ' ')), CAST(generate_subscripts(str_split(text, ' '), 1) AS BIGINT) FROM documents")
    assert sorted(got) == sorted(want) and max(r[2] for r in got) > 5


def test_batch_search_takes_every_twentieth_row(spark):
    got = [tuple(r) for r in plans.QUERIES["knn_batch"](spark, SF).select("query_id", "vec_id", "rank").collect()]
    want = sql("""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), e.vec_id) AS INTEGER) AS rank
      FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5""")
    assert sorted(got) == sorted(want) and {r[0] for r in got} == set(range(0, 500, 20))


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_batch_search_goes_on_over_blocks_of_queries(spark, metric):
    rnd = np.random.default_rng(3)
    vectors = [*rnd.normal(size=(120, 4)).tolist(), *[[1.0, 0.1, 2.0, 0.3]] * 30, [0.0] * 4]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    got = search.knn_batch(df, "id", "v", df.withColumnRenamed("id", "q"), "q", 4, metric, block=1)  # 64 queries a pass
    x = np.array(vectors)

    def far(a, b):
        if metric == "l2":
            return round(float(np.sqrt(((a - b) ** 2).sum())), 9)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(-float((a * b).sum()) if metric == "dot" else 1.0 if n == 0 else float(1 - (a * b).sum() / n), 9)

    want = {(i, j, r + 1) for i, a in enumerate(x) for r, (_, j) in enumerate(sorted((far(a, b) + 0.0, j) for j, b in enumerate(x))[:4])}
    assert {(r.q, r.id, r["rank"]) for r in got.collect()} == want


A, B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
SETS = {"union_distinct": "UNION", "union_all": "UNION ALL", "intersect_distinct": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}
WHOLE = {name: f"({A}) {op} ({B})" for name, op in SETS.items()} | {
    "setop_left_assoc": f"(({A}) UNION ({B})) INTERSECT (SELECT r_regionkey AS k FROM region)",
    "join_right": "SELECT o_orderkey, s_name, r_name FROM supplier RIGHT JOIN orders ON o_custkey = s_suppkey LEFT JOIN region ON r_regionkey = o_orderkey % 7",
    "join_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "join_using": "SELECT c_custkey AS k, c_name AS v, s_name AS w FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "quantified_any": "SELECT s_suppkey, s_acctbal < ANY (SELECT nullif(c_acctbal, 0) FROM customer WHERE c_nationkey = s_nationkey) AS hit FROM supplier",
    "recursive_reachability": "WITH RECURSIVE r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT o_orderkey FROM r JOIN orders ON o_custkey = r.node) SELECT node FROM r",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_tables(spark, name):
    got = [tuple(r) for r in plans.QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(sql(WHOLE[name]), key=repr)


def test_reachability_takes_every_order_and_no_folding(spark, tmp_path):
    edges = [(1, 50), (50, 977), (977, 1), (3, 11), (977, 22)]
    spark.createDataFrame(edges, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.node for r in plans.QUERIES["recursive_reachability"](spark, str(tmp_path)).collect()) == [1, 22, 50, 977]
