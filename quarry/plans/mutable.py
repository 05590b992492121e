"""Tables that change, views of them, key-value scans and copies."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import copy
from ..storage import keyvalue, tables
from .base import load, query


def _root(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "quarry-shared")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _customers(spark, sf_dir, **constraints):
    t = tables.Table(spark, _root(spark), "customer", tables.Constraints(key=("c_custkey",), **constraints))
    return t.create(load(spark, sf_dir, "customer"))


_NEW = "SELECT c_custkey + 1400 AS c_custkey, 'new ' || c_name AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey <= 300"


def _new(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_NEW)


@query(f"WITH n AS ({_NEW}) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE round(o.c_acctbal + n.c_acctbal, 2) END AS c_acctbal FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey")
def dml_upsert(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.insert(_new(spark, sf_dir), "update", {"c_acctbal": F.round(F.col("old_c_acctbal") + F.col("excluded_c_acctbal"), 2)})
    return t.read().select("c_custkey", "c_name", "c_acctbal")


@query(f"WITH n AS ({_NEW}) SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def dml_insert_ignore(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.insert(_new(spark, sf_dir), "nothing")
    return t.read().select("c_custkey", "c_name")


@query(f"WITH n AS ({_NEW}) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, c_name FROM n")
def dml_replace(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.insert(_new(spark, sf_dir), "replace")
    return t.read().select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 1000 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.update("c_acctbal < 1000", {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.concat(F.upper("c_mktsegment"), F.lit("!"))})
    return t.read().select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_acctbal > 0)")
def dml_delete(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.delete("c_custkey % 3 = 0 AND c_acctbal > 0")
    return t.read().select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 0")
def dml_returning(spark, sf_dir):
    return _customers(spark, sf_dir).delete("c_custkey % 3 = 0 AND c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 <> 0")
def fk_cascade(spark, sf_dir):
    c = _customers(spark, sf_dir)
    o = tables.Table(spark, c.root, "orders", tables.Constraints(key=("o_orderkey",), foreign=(tables.ForeignKey("o_custkey", "customer", "c_custkey", "cascade"),)))
    o.create(load(spark, sf_dir, "orders"))
    c.delete("c_custkey % 5 = 0", [o])
    return o.read().select("o_orderkey", "o_custkey")


@query("SELECT 'check positive' AS rule, count(*) AS n FROM customer WHERE NOT c_acctbal > 0 UNION ALL SELECT 'not null seg', count(*) FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL UNION ALL SELECT 'unique c_nationkey', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1)")
def constraint_violations(spark, sf_dir):
    df = load(spark, sf_dir, "customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    found = tables.violations(df, tables.Constraints(not_null=("seg",), unique=(("c_nationkey",),), checks={"positive": "c_acctbal > 0"}), {})
    return spark.createDataFrame(sorted(found.items()), "rule string, n bigint")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_orderstatus")
def matview_refresh(spark, sf_dir):
    t = tables.Table(spark, _root(spark), "orders").create(load(spark, sf_dir, "orders"))
    view = tables.MaterializedView(spark, t.root, "by_status", lambda: t.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")))
    t.delete("o_orderkey % 4 = 0")
    view.refresh()
    return view.read()


@query("SELECT 'n_nationkey' AS column_name, count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_distinct, count(*) - count(n_nationkey) AS n_null, CAST(min(n_nationkey) AS VARCHAR) AS min, CAST(max(n_nationkey) AS VARCHAR) AS max FROM nation UNION ALL SELECT 'n_name', count(*), count(DISTINCT n_name), count(*) - count(n_name), min(n_name), max(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(DISTINCT n_regionkey), count(*) - count(n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation")
def analyze_stats(spark, sf_dir):
    return tables.analyze(load(spark, sf_dir, "nation"))


@query("SELECT c_custkey, c_name FROM customer")
def read_as_of(spark, sf_dir):
    """An earlier version stays readable after later commits."""
    t = _customers(spark, sf_dir)
    t.delete("c_custkey > 10")
    return t.read(0).select("c_custkey", "c_name")


@query("SELECT * FROM (SELECT 'insert' AS kind, CAST(0 AS BIGINT) AS lsn, count(*) AS n FROM customer UNION ALL SELECT 'update', 1, count(*) FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 'delete', 2, count(*) FROM customer WHERE c_custkey > 1000) WHERE n > 0")
def cdc_replay(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.update("c_custkey <= 20", {"c_name": F.lit("x")})
    t.delete("c_custkey > 1000")
    return t.changes().groupBy(F.col("_kind").alias("kind"), F.col("_lsn").alias("lsn")).agg(F.count(F.lit(1)).alias("n"))


def _kv(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 6, "0")).alias("key"), F.col("user_id").alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("expires_at"))


_KV = "kv AS (SELECT event_type || '/' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS key, user_id AS value, CASE WHEN event_id % 3 = 0 THEN ts END AS expires_at FROM events)"


@query(f"WITH {_KV} SELECT key, value FROM kv WHERE starts_with(key, 'click/') ORDER BY key LIMIT 50")
def kv_prefix_scan(spark, sf_dir):
    return keyvalue.page(keyvalue.prefix(_kv(spark, sf_dir), "click/"), None, 50).select("key", "value")


@query(f"WITH {_KV} SELECT key, value FROM kv WHERE key >= 'error/' AND key < 'purchase/' AND value = 7")
def kv_range_value(spark, sf_dir):
    return keyvalue.by_value(keyvalue.scan(_kv(spark, sf_dir), "error/", "purchase/"), 7).select("key", "value")


@query(f"WITH {_KV} SELECT key, value FROM kv WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-15 00:00:00'")
def kv_ttl_visible(spark, sf_dir):
    return keyvalue.visible(_kv(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("key", "value")


@query("SELECT doc_id, text, nullif(lang, 'en') AS lang FROM documents")
def copy_roundtrip(spark, sf_dir):
    df = load(spark, sf_dir, "documents").select("doc_id", "text", F.expr("nullif(lang, 'en')").alias("lang"))
    path = f"{_root(spark)}/copy"
    copy.copy_to(df, path)
    return copy.copy_from(spark, path, df.schema)


@query("SELECT r_regionkey, r_name FROM region")
def jsonl_roundtrip(spark, sf_dir):
    df, path = load(spark, sf_dir, "region"), f"{_root(spark)}/json"
    df.write.json(path)
    return spark.read.schema(df.schema).json(path)
