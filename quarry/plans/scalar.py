"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, documents, numbers, text
from .base import by_sql, load, query

C = F.col


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, CAST(length(p_name) AS BIGINT) AS n, replace(p_name, 'a', '_') AS rep, CAST(strpos(p_name, 'e') AS BIGINT) AS pos,
 left(p_name, 3) AS l, right(p_name, 3) AS r, reverse(p_name) AS rev, repeat(p_brand, 2) AS twice, lpad(p_name, 8, '*') AS lp, rpad(p_name, 40, '-') AS rp,
 starts_with(p_name, 'b') AS sw, ends_with(p_name, 'e') AS ew, contains(p_name, 'r') AS has, split_part(p_brand, '#', 2) AS part2, concat(p_name, nullif(p_size, 7), 'x') AS cat, concat_ws('|', p_brand, p_size) AS ws,
 substr(p_name, 0, 3) AS s0, substr(p_name, -3) AS sm, sha256(p_name) AS digest, ascii(p_name) AS code, trim(chr(9) || p_name || ' ', chr(9) || ' ') AS tr, upper(hex(p_brand)) AS hx FROM part""")
def fn_text(spark, sf_dir):
    n = C("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower("p_type").alias("low"), F.length(n).cast("long").alias("n"), F.replace(n, F.lit("a"), F.lit("_")).alias("rep"), F.instr(n, "e").cast("long").alias("pos"),
        F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(3)).alias("r"), F.reverse(n).alias("rev"), F.repeat("p_brand", 2).alias("twice"), F.lpad(n, 8, "*").alias("lp"), F.rpad(n, 40, "-").alias("rp"),
        F.startswith(n, F.lit("b")).alias("sw"), F.endswith(n, F.lit("e")).alias("ew"), F.contains(n, F.lit("r")).alias("has"), text.split_part(C("p_brand"), "#", 2).alias("part2"),
        text.concat(n, F.expr("nullif(p_size, 7)").cast("string"), F.lit("x")).alias("cat"), F.concat_ws("|", "p_brand", C("p_size").cast("string")).alias("ws"), text.substr(n, 0, 3).alias("s0"), text.substr(n, -3).alias("sm"),
        F.sha2(n, 256).alias("digest"), text.unicode(n).alias("code"), text.trim(F.concat(F.lit("\t"), n, F.lit(" "))).alias("tr"), F.hex("p_brand").alias("hx"),
    )


@query("""SELECT o_orderkey, abs(o_totalprice - 1000) AS a, CAST(sign(o_totalprice - 1000) AS BIGINT) AS sg, round(o_totalprice / 7, 1) AS rd, trunc(-o_totalprice / 7) AS tr, CAST(floor(-o_totalprice / 7) AS BIGINT) AS fl, CAST(ceil(o_totalprice / 7) AS BIGINT) AS ce,
 round(sqrt(o_totalprice), 6) AS sq, round(cbrt(o_totalprice), 6) AS cb, round(log10(o_totalprice), 8) AS lg, round(ln(o_totalprice), 8) AS l, round(log2(o_totalprice), 8) AS l2, o_orderkey % 7 AS md, round(sin(o_orderkey), 8) AS sn, round(atan2(o_orderkey, 3), 8) AS at,
 round(degrees(1.5) + radians(o_orderkey) + pi(), 6) AS dg, round(power(o_orderkey, 1.5), 2) AS pw, greatest(o_orderkey, o_custkey, 500) AS gr, least(o_orderkey, o_custkey, 500) AS le FROM orders""")
def fn_math(spark, sf_dir):
    p = C("o_totalprice")
    rd = lambda c, d: F.round(c, d)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.abs(p - 1000).alias("a"), numbers.sign(p - 1000).alias("sg"), numbers.round_half_away(p / 7, 1).alias("rd"), numbers.trunc(-p / 7).alias("tr"), F.floor(-p / 7).alias("fl"), F.ceil(p / 7).alias("ce"),
        rd(F.sqrt(p), 6).alias("sq"), rd(F.cbrt(p), 6).alias("cb"), rd(numbers.log(p), 8).alias("lg"), rd(F.ln(p), 8).alias("l"), rd(F.log2(p), 8).alias("l2"), numbers.mod(C("o_orderkey"), F.lit(7)).alias("md"),
        rd(F.sin("o_orderkey"), 8).alias("sn"), rd(F.atan2(C("o_orderkey"), F.lit(3)), 8).alias("at"), rd(F.degrees(F.lit(1.5)) + F.radians("o_orderkey") + F.pi(), 6).alias("dg"), rd(F.pow("o_orderkey", F.lit(1.5)), 2).alias("pw"),
        F.greatest("o_orderkey", "o_custkey", F.lit(500)).alias("gr"), F.least("o_orderkey", "o_custkey", F.lit(500)).alias("le"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, strftime(ts, '%Y/%j %w') AS f, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(quarter(ts) AS BIGINT) AS q,
 CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(dayofweek(ts) AS BIGINT) AS dow, CAST(floor(epoch(ts)) AS BIGINT) AS ep, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 86400000000) AS BIGINT) AS days FROM events""")
def fn_datetime(spark, sf_dir):
    t = C("ts")
    long = lambda c: c.cast("long")
    return load(spark, sf_dir, "events").select(
        "event_id", dates.datetime(t).alias("dt"), dates.strftime("%Y/%j %w", t).alias("f"), long(F.year(t)).alias("y"), long(F.month(t)).alias("m"), long(F.day(t)).alias("d"), long(F.hour(t)).alias("h"), long(F.quarter(t)).alias("q"),
        long(F.dayofyear(t)).alias("doy"), long(dates.weekday(t)).alias("dow"), dates.unixepoch(t).alias("ep"), dates.diff(t, F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).alias("days"),
    )


@query("""SELECT event_id, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH + (ts - date_trunc('month', ts)), '%Y-%m-%d %H:%M:%S') AS month_later, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month_start,
 strftime(ts - INTERVAL 3 DAY, '%Y-%m-%d') AS before, strftime(date_trunc('day', ts) + INTERVAL 90 MINUTE, '%H:%M:%S') AS half_two, strftime(ts + to_days(CAST((7 - dayofweek(ts)) % 7 AS INTEGER)), '%Y-%m-%d') AS sunday FROM events""")
def fn_date_modifiers(spark, sf_dir):
    """A month later is that many days into the next month, also past its end."""
    t = C("ts")
    return load(spark, sf_dir, "events").select("event_id", dates.datetime(t, "+1 month").alias("month_later"), dates.date(t, "start of month").alias("month_start"), dates.date(t, "-3 days").alias("before"), dates.time(t, "start of day", "+90 minutes").alias("half_two"), dates.date(t, "weekday 0").alias("sunday"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok, CAST(coalesce(json_array_length('[1,2,' || event_id || ']'), 0) AS BIGINT) AS n, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' AS made FROM events")
def fn_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", documents.json_extract(C("props"), "$.k", "bigint").alias("k"), documents.json_valid(C("props")).alias("ok"), documents.json_array_length(F.concat(F.lit("[1,2,"), C("event_id").cast("string"), F.lit("]"))).cast("long").alias("n"),
        F.to_json(F.struct(C("event_id").alias("a"), C("event_type").alias("b"))).alias("made"),
    )


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS first, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS every, nullif(regexp_extract(p_name, '[m-z]+'), '') AS run, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS n, regexp_matches(p_type, '^s', 'i') AS s FROM part")
def fn_regex(spark, sf_dir):
    n = C("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", documents.regexp_replace_first(n, "[aeiou]", "*").alias("first"), documents.regexp_replace_first(n, "([aeiou])", r"<\1>", "g").alias("every"), documents.regexp_substr(n, "[m-z]+").alias("run"),
        F.regexp_count(n, F.lit("[aeiou]")).cast("long").alias("n"), C("p_type").rlike("(?i)^s").alias("s"),
    )


by_sql("fn_array", "SELECT p_partkey, element_at(split(p_type, ' '), 1) AS first, CAST(size(split(p_type, ' ')) AS BIGINT) AS n, array_contains(array(1, 2, 3), p_size) AS in_it, array_join(array(p_brand, p_type), '/') AS joined FROM part",
       "SELECT p_partkey, str_split(p_type, ' ')[1] AS first, CAST(len(str_split(p_type, ' ')) AS BIGINT) AS n, list_contains([1, 2, 3], p_size) AS in_it, array_to_string([p_brand, p_type], '/') AS joined FROM part")
by_sql("fn_conditional", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS c, if(o_totalprice > 1000, 'hi', NULL) AS i, ifnull(NULL, o_custkey) AS n, greatest(o_orderkey, NULL, 5) AS g FROM orders",
       "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS c, if(o_totalprice > 1000, 'hi', NULL) AS i, ifnull(NULL, o_custkey) AS n, greatest(o_orderkey, NULL, 5) AS g FROM orders")
