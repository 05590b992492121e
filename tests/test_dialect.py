"""The SQL front end."""

import random

import pytest

from quarry.dialect import DialectError, to_spark
from quarry.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("c", spark.createDataFrame([(1, "ana", "rio"), (2, "bia", "sp"), (3, "caio", "rio"), (4, "duda", None)], "id long, name string, city string"))
    e.register("o", spark.createDataFrame([(10, 1, 50.0), (11, 1, 150.0), (12, 2, 20.0), (13, 9, 99.0)], "id long, cid long, total double"))
    return e


CASES = [
    ("SELECT name FROM c WHERE name LIKE 'A%' OR city LIKE '_P' ORDER BY id", ["ana", "bia"]),
    ("SELECT name FROM c WHERE name GLOB '[ab]*' ORDER BY 1", ["ana", "bia"]),
    ("SELECT name FROM c WHERE name ~ '^c' OR name ~* 'DUD' ORDER BY 1", ["caio", "duda"]),
    ("SELECT name FROM c WHERE name !~ 'a$'", ["caio"]),
    ("SELECT '3.9'::int + 1", [4]),
    ("SELECT CAST(id AS TEXT) || 'x' FROM c WHERE id = 2", ["2x"]),
    ("SELECT id FROM c ORDER BY id LIMIT 1, 2", [2, 3]),
    ("SELECT id FROM c ORDER BY id DESC FETCH FIRST 1 ROWS ONLY", [4]),
    ("SELECT 1 AS v UNION SELECT 2 INTERSECT SELECT 2", [2]),
    ("SELECT id FROM c EXCEPT SELECT cid FROM o ORDER BY id DESC", [4, 3]),
    ("SELECT id FROM c WHERE id = ANY (SELECT cid FROM o) ORDER BY id", [1, 2]),
    ("SELECT id FROM c WHERE id <> ALL (SELECT cid FROM o) ORDER BY id", [3, 4]),
    ("SELECT count(*) FROM c WHERE id IN ()", [0]),
    ('SELECT "name" FROM [c] WHERE `id` = 1', ["ana"]),
    ("SELECT concat('a', NULL, 'b')", ["ab"]),
    ("SELECT log(100)", [2.0]),
    ("SELECT substr('hello', 0, 3)", ["he"]),
    ("SELECT regexp_replace('banana', 'a', 'o')", ["bonana"]),
    ("SELECT regexp_replace('banana', '(a)', '<\\1>', 'g')", ["b<a>n<a>n<a>"]),
    ("SELECT 7 / 0", [None]),
    ("SELECT 7 % 0", [None]),
    ("SELECT ARRAY[5, 6][2]", [6]),
    ("SELECT sum(total) FROM (SELECT total FROM o WHERE total / 2 > 20) t", [299.0]),
    ("WITH t AS (SELECT id FROM c UNION ALL SELECT id FROM c) SELECT count(*) FROM t", [8]),
    ("SELECT ARRAY[3.0, 4.0] <-> ARRAY[0.0, 0.0]", [5.0]),
    ("SELECT count(*) FROM generate_series(1, 10, 3)", [4]),
    ("SELECT 'it''s -- no comment' -- a comment", ["it's -- no comment"]),
    ("SELECT total(id) FROM c WHERE id > 99", [0.0]),
    ("SELECT c.name FROM c LEFT JOIN o ON o.cid = c.id WHERE o.id IS NULL ORDER BY c.name", ["caio", "duda"]),
    ("SELECT 7 / 2", [3]),
    ("SELECT -7 / 2", [-3]),
    ("SELECT 7 / 2.0", [3.5]),
    ("SELECT o.id / 4 FROM o ORDER BY 1", [2, 2, 3, 3]),
    ("SELECT total / 4 FROM o WHERE id = 10", [12.5]),
    ("SELECT x / 2 FROM (SELECT total AS x FROM o WHERE id = 13) t", [49.5]),
    ("SELECT id / 2 FROM (SELECT total AS id FROM o WHERE id = 13) t", [49.5]),
    ("SELECT 1 << 65", [0]),
    ("SELECT 1 << 40", [1 << 40]),
    ("SELECT 256 >> 4", [16]),
    ("SELECT 1 << -1", [0]),
    ("SELECT initcap('ola-mundo É1a')", ["Ola-Mundo É1a"]),
    ("SELECT split_part('a,b', ',', -9)", ["a"]),
    ("SELECT split_part('a,b', ',', 2)", ["b"]),
    ("SELECT split_part('a.b.c', '.', -1)", ["c"]),
    ("SELECT split_part('a,b', ',', 5)", [""]),
    ("SELECT chr(300)", ["\u012c"]),
    ("SELECT typeof(1)", ["integer"]),
    ("SELECT typeof('x') || typeof(1.5) || typeof(NULL)", ["textrealnull"]),
    ("SELECT round(1.005, 2)", [1.0]),
    ("SELECT round(-2.5)", [-3.0]),
    ("SELECT quote_literal('it''s')", ["'it''s'"]),
    ("SELECT id FROM c WHERE id > ALL (SELECT cid FROM o WHERE cid < 3) ORDER BY id", [3, 4]),
    ("SELECT id FROM c WHERE id >= ANY (SELECT cid FROM o WHERE cid > 1) ORDER BY id", [2, 3, 4]),
    ("SELECT id FROM c WHERE id < ALL (SELECT cid FROM o WHERE cid > 99) ORDER BY id", [1, 2, 3, 4]),
    ("SELECT id FROM c WHERE id <> ANY (SELECT cid FROM o) ORDER BY id", [1, 2, 3, 4]),
    ("SELECT id FROM c WHERE id = ALL (SELECT cid FROM o WHERE cid = 1)", [1]),
    ("SELECT count(*) FROM c WHERE id > ALL (SELECT nullif(cid, 9) FROM o)", [0]),
    ("SELECT count(*) FROM c WHERE id > ANY (ARRAY[2, 3])", [2]),
    ("SELECT trim('\t x '), weekday('2024-01-07')", ["x"]),
]


@pytest.mark.parametrize("sql, want", CASES)
def test_statements(engine, sql, want):
    assert [r[0] for r in engine.sql(sql).collect()] == want


def test_parameters_and_scripts(engine):
    assert [r[0] for r in engine.sql("SELECT name FROM c WHERE id = ? OR name = ?", 1, "bia").collect()] == ["ana", "bia"]
    assert [r[0] for r in engine.sql("SELECT $2 - $1", 1, 5).collect()] == [4]
    assert [d.first()[0] for d in engine.script("SELECT 1; SELECT ';' ;")] == [1, ";"]
    assert engine.tables().filter("table_name = 'c'").count() == 3


def test_what_has_no_rewriting_says_so():
    for sql in ("", "SELECT (1", "SELECT 1)", "SELECT 1 > ALL 2", "SELECT a::blob"):
        with pytest.raises(DialectError):
            to_spark(sql)


def test_mutated_text_never_breaks_the_rewriter():
    rnd, seeds = random.Random(7), [s for s, _ in CASES]
    for _ in range(3000):
        s = list(rnd.choice(seeds))
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randrange(3)] = rnd.choice(["", "(", ")", "'", " FROM ", "::", "[", "]", "?", "/", "~", " LIKE ", "ANY"])
        try:
            to_spark("".join(s))
        except DialectError:
            pass
