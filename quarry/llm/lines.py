"""Line dedup with per-document keep bitmaps, in DataFrame functions only (operator 1).

Lines become (128-bit hash of the key, document, position).  They are dealt by ranges of (hash, document) and sorted by
document and position within; a key that many documents share thus covers several ranges instead of one task.  A stream
over that order marks each document's first occurrence, partial aggregates count a key's documents and find its first
line, and only keys that are common enough are joined back, the hottest of them dealt to many tasks.  The result is a
bitmap per document, found without moving a text; :func:`apply_bitmaps` then joins texts and bitmaps once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def _keys(text: Column, least: int) -> Column:
    """Array of each line's key hash, null where the key has fewer than ``least`` code points."""
    line = F.transform(F.split(common.ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)))
    return F.transform(line, lambda x: F.when(F.length(x) >= least, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, row, text``: row is a hash of the text, so that rows of the same or no id are told apart unless they are equal."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b")).alias("row"), body.alias("text"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, row, n_dropped, bitmap`` of every document that loses lines.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose all lines (``keep="none"``) or all but the first by document and
    position (``keep="first"``; ``min_docs=1`` then also drops repeats within one document).
    ``bitmap`` is compressed: (word, bits) for each 64 lines that aren't all kept, bit i set if line 64 * word + i stays.

    * null and empty texts are one empty line, which has no key;
    * rows equal in id and text are one document with the same bitmap for each of them; others are told apart;
    * a null id sorts before all others; an empty table gives no rows; other columns are not read.
    """
    rows = _rows(docs, doc_id, text)
    lines = rows.select("doc", "row", F.posexplode(_keys(F.col("text"), min_chars)).alias("pos", "key")).filter("key IS NOT NULL").select("key.h1", "key.h2", "doc", "row", "pos")
    dealt = lines.repartitionByRange("h1", "h2", "doc", "row").sortWithinPartitions("h1", "h2", "doc", "row", "pos")
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "doc", "row").orderBy("pos")))
    stored = common.materialize(ranked, "lines")
    first = [F.min(F.struct("doc", "row", "pos")).alias("first")] if keep == "first" else []
    found = stored.groupBy("h1", "h2").agg(F.count_if(F.col("nth") == 1).alias("n_docs"), F.count(F.lit(1)).alias("n"), *first)
    common_keys = common.materialize(found.filter(F.col("n_docs") >= min_docs).drop("n_docs"), "keys")
    hits = common.join_counted(stored, common_keys, ["h1", "h2"], ["doc", "row", "pos"])
    if keep == "first":
        hits = hits.filter(~F.struct("doc", "row", "pos").eqNullSafe(F.col("first")))
    words = hits.groupBy("doc", "row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmap = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))
    return words.groupBy("doc", "row").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), bitmap.alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_kept`` (the kept lines joined by line ends), ``_lines`` and ``_dropped``, which replace columns of those names.

    All other columns stay, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = {k: common.fresh(f"_{k}", docs) for k in ("hash_a", "hash_b", "map", "dense", "drops")}
    own = docs.drop("_kept", "_lines", "_dropped").withColumns({names["hash_a"]: F.xxhash64(body), names["hash_b"]: F.xxhash64(F.lit(1), body)})
    maps = bitmaps.select(F.col("doc").alias("d"), F.col("row.a").alias("a"), F.col("row.b").alias("b"), F.col("n_dropped").alias("drops"), F.col("bitmap").alias("map")).select(F.struct("*").alias(names["map"]))
    of = lambda field: F.col(names["map"])[field]
    both = own.join(maps, (F.col(names["hash_a"]) == of("a")) & (F.col(names["hash_b"]) == of("b")) & F.col(doc_id).cast("long").eqNullSafe(of("d")), "left")
    parts = F.split(body, "\n")
    sparse = F.map_from_entries(of("map"))
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 64).cast("int")), lambda w: F.coalesce(F.try_element_at(sparse, w), F.lit(-1).cast("long")))
    both = both.withColumn(names["dense"], F.when(F.col(names["map"]).isNotNull(), dense)).withColumn("_lines", F.size(parts).cast("long"))
    # written as SQL: the shift by a column has no Python function
    kept = F.expr(f"array_join(filter(split(coalesce(`{text}`, ''), '\\n'), (x, i) -> (shiftrightunsigned(`{names['dense']}`[i div 64], i % 64) & 1) = 1), '\\n')")
    out = both.withColumn("_kept", F.when(F.col(names["map"]).isNull(), body).otherwise(kept)).withColumn("_dropped", F.coalesce(of("drops"), F.lit(0).cast("long")))
    return out.drop(*names.values())


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(str_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
