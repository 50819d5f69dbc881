import math

import pytest

from graphloom.cypher.lower import MissingParameter, UnionMismatch, UnknownVariable, Unsupported
from graphloom.cypher.parser import CypherSyntaxError
from graphloom.engine import Engine
from graphloom.functions.scalar import InvalidFunctionCall, TypeMismatch

from .graphs import parity, plain


@pytest.fixture(scope="module")
def e(spark):
    return Engine(parity(spark))


def rows(engine, text, **params):
    return [tuple(r) for r in engine.cypher(text, params).collect()]


READS = [
    ("MATCH (p:Person) RETURN count(*) AS n", [(3,)]),
    ("MATCH (p:Person) RETURN avg(p.age) AS a", [(32.0,)]),
    ("MATCH (t:Task) RETURN sum(t.priority) AS s, min(t.priority) AS lo, max(t.priority) AS hi", [(6, 1, 3)]),
    ("MATCH (t:Task) RETURN t.done AS d, count(*) AS n ORDER BY d", [(False, 2), (True, 1)]),
    ("MATCH (p:Person) WHERE p.age > 28 RETURN p.name AS n ORDER BY n", [("Alice",), ("Carol",)]),
    ("MATCH (t:Task) RETURN t.title AS t ORDER BY t.priority SKIP 1 LIMIT 1", [("Write docs",)]),
    ("MATCH (t:Task {title: 'Fix parser'})-[:BLOCKS*1..2]->(x) RETURN x.title", [("Write docs",)]),
    ("MATCH (p:Person) OPTIONAL MATCH (p)-[:OWNS]->(x) RETURN p.name AS n, x.name AS x ORDER BY n", [("Alice", "Drum"), ("Bob", None), ("Carol", None)]),
    ("MATCH (p:Person)-[a:ASSIGNED]->(t:Task) WHERE a.hours >= 5 RETURN p.name, t.title, a.hours ORDER BY p.name", [("Alice", "Fix parser", 5), ("Carol", "Write docs", 8)]),
    ("MATCH (t:Task)<-[:HAS_TASK]-(pr:Project)<-[:OWNS]-(o) RETURN o.name AS o, count(t) AS n", [("Alice", 3)]),
    ("MATCH (a)--(b:Task {title: 'Write docs'}) RETURN count(*) AS n", [(3,)]),
    ("MATCH (p:Person), (q:Project) RETURN count(*) AS n", [(3,)]),
    ("MATCH (p:Person) WITH p.active AS act, collect(p.name) AS names RETURN act, size(names) AS n ORDER BY act", [(False, 1), (True, 2)]),
    ("MATCH (p:Person) WITH p ORDER BY p.age DESC RETURN collect(p.name) AS names", [(["Carol", "Alice", "Bob"],)]),
    ("MATCH (p:Person) WITH p, p.age AS age WHERE age < 40 RETURN p.name AS n ORDER BY n", [("Alice",), ("Bob",)]),
    ("UNWIND [1, 2, null, 2] AS x RETURN count(x) AS n, count(DISTINCT x) AS d, sum(x) AS s", [(3, 2, 5)]),
    ("UNWIND [] AS x RETURN count(*) AS n, sum(x) AS s, collect(x) AS c", [(0, 0, [])]),
    ("MATCH (n:Nope) RETURN sum(n.x) AS s, stDev(n.x) AS d, collect(n.x) AS c, avg(n.x) AS a", [(0, 0.0, [], None)]),
    ("RETURN 1 AS x UNION RETURN 1 AS x UNION RETURN 2 AS x", [(1,), (2,)]),
    ("RETURN 1 AS x UNION ALL RETURN 1 AS x", [(1,), (1,)]),
    ("MATCH (p:Person) WHERE (p)-[:OWNS]->() RETURN p.name", [("Alice",)]),
    ("MATCH (p:Person) WHERE NOT (p)-[:OWNS]->() RETURN p.name AS n ORDER BY n", [("Bob",), ("Carol",)]),
    ("MATCH (p:Person) WHERE EXISTS { (p)-[a:ASSIGNED]->(t) WHERE a.hours < p.age - 35 } RETURN p.name", []),
    ("MATCH (p:Person) RETURN p.name AS n, COUNT { (p)-->() } AS c, EXISTS { (p)-[:OWNS]->(:Project) } AS o ORDER BY n", [("Alice", 2, True), ("Bob", 1, False), ("Carol", 1, False)]),
    ("MATCH (p:Project) RETURN [(p)-[:HAS_TASK]->(t) WHERE t.priority > 1 | t.title] AS ts", [(["Fix parser", "Write docs"],)]),
    ("MATCH (p:Person) RETURN p.name AS n, [(p)-[:OWNS]->(x) | x.name] AS xs ORDER BY n", [("Alice", ["Drum"]), ("Bob", []), ("Carol", [])]),
    ("MATCH q = (a:Task {title:'Fix parser'})-[:BLOCKS]->(b) RETURN length(q) AS l, nodes(q) AS ns", [(1, [5, 7])]),
    ("MATCH (p:Person {name: $who}) RETURN p.age", [(30,)]),
    ("MATCH (p:Person) RETURN p {.name, years: p.age} AS m ORDER BY p.age LIMIT 1", [(("Bob", 25),)]),
    ("MATCH (n) RETURN DISTINCT labels(n) AS l ORDER BY l", [(["Person"],), (["Project"],), (["Task"],)]),
    ("MATCH (n:Person|Project) RETURN count(*) AS n", [(4,)]),
    ("MATCH (n:!Person) RETURN count(*) AS n", [(4,)]),
    ("MATCH (n:%) WHERE n:Task RETURN count(n) AS n", [(3,)]),
    ("MATCH (n) WHERE id(n) IN [1, 4] RETURN n.name AS n ORDER BY n", [("Alice",), ("Drum",)]),
    ("MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n ORDER BY n DESC, t", [("ASSIGNED", 3), ("HAS_TASK", 3), ("BLOCKS", 1), ("OWNS", 1)]),
    ("MATCH p = shortestPath((a:Person {name: 'Alice'})-[*..4]->(b:Task {title: 'Write docs'})) RETURN length(p) AS l", [(2,)]),
    ("MATCH p = allShortestPaths((a:Person {name: 'Alice'})-[*..4]->(b:Task {title: 'Write docs'})) RETURN count(p) AS n", [(2,)]),
    ("MATCH (p:Person) RETURN CASE p.active WHEN true THEN 'on' ELSE 'off' END AS s, count(*) AS n ORDER BY s", [("off", 1), ("on", 2)]),
    ("MATCH (p:Person) RETURN max(p.age) - min(p.age) AS spread, count(*) * 2 AS twice", [(16, 6)]),
    ("MATCH (t:Task) RETURN percentileCont(t.priority, 0.5) AS c, percentileDisc(t.priority, 0.5) AS d, stDevP(t.priority) AS s", [(2.0, 2, pytest.approx(0.816496580927726))]),
]


@pytest.mark.parametrize(("text", "want"), READS)
def test_reads(e, text, want):
    got = rows(e, text, who="Alice")
    assert (sorted(got) if "ORDER" not in text else got) == want


SCALARS = [
    ("1 + 2 * 3", 7), ("-2 ^ 3", -8.0), ("7 / 2", 3), ("7.0 / 2", 3.5), ("7 % 3", 1), ("'a' + 'b'", "ab"), ("[1] + [2]", [1, 2]), ("1.0 / 0.0", math.inf), ("isNaN(0.0 / 0.0)", True),
    ("null = null", None), ("1 = 1.0", True), ("1 = 'a'", False), ("true XOR null", None), ("false AND null", False), ("1 IN [1, null]", True), ("2 IN [1, null]", None), ("null IN []", False), ("'Hello' =~ '(?i)hello'", True), ("'Hello' =~ 'ell'", False),
    ("'abc' STARTS WITH 'ab' AND 'abc' ENDS WITH 'c' AND 'abc' CONTAINS 'b'", True), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3][1..]", [2, 3]), ("[1, 2, 3][..-1]", [1, 2]),
    ("[x IN range(1, 5) WHERE x % 2 = 1 | x * x]", [1, 9, 25]), ("all(x IN [] WHERE x > 0)", True), ("any(x IN [1, null] WHERE x > 5)", None), ("none(x IN [1] WHERE x > 5)", True), ("single(x IN [1, 2, 3] WHERE x = 2)", True), ("single(x IN [1, null] WHERE x = 1)", None),
    ("reduce(s = 0, x IN [1, 2, 3] | s + x)", 6), ("substring('hello', 1, 3)", "ell"), ("split('a.b.c', '.')", ["a", "b", "c"]), ("toInteger('4.7')", 4), ("toInteger('x')", None), ("toBoolean('t')", None), ("toBoolean('TRUE')", True), ("toString(12)", "12"),
    ("round(1.255, 2)", 1.26), ("round(2.5, 0, 'HALF_EVEN')", 2.0), ("round(-1.5)", -2.0), ("round(1234.5, -2)", 1200.0), ("ceil(1.2)", 2.0), ("sign(-3)", -1), ("log(0)", -math.inf), ("isNaN(log(-1))", True), ("isNaN(null)", None), ("size('abc')", 3), ("range(5, 1)", []), ("range(5, 1, -2)", [5, 3, 1]),
    ("head([])", None), ("tail([1, 2])", [2]), ("last([1, 2])", 2), ("coalesce(null, 3)", 3), ("toIntegerList(['1', 'x', null])", [1, None, None]), ("toStringOrNull([1])", None), ("reverse('abc')", "cba"), ("cosine_similarity([1.0, 0.0], [1.0, 0.0])", 1.0), ("similar([1.0, 0.0], [0.0, 1.0], 0.5)", False),
    ("any.entity.normalise('А. С. Пушкин')", "а с пушкин"), ("ns.entity.normalise('Émile  Zola')", "emile zola"), ("apoc.text.levenshteinDistance('kitten', 'sitting')", 3), ("apoc.text.levenshteinSimilarity('', '')", 1.0), ("size(keys({b: 1, a: 2}))", 2), ("{a: 1}.a", 1), ("CASE WHEN null THEN 1 ELSE 2 END", 2), ("left('abc', 2) + right('abc', 1)", "abc"), ("trim('  x ')", "x"), ("haversin(0)", 0.0), ("0x1F", 31),
]


def test_scalars(e):
    got = e.cypher("RETURN " + ", ".join(f"{t} AS c{k}" for k, (t, _) in enumerate(SCALARS))).first()
    for k, (text, want) in enumerate(SCALARS):
        assert got[k] == want and type(got[k]) is type(want), (text, got[k], want)


@pytest.mark.parametrize(
    ("text", "error"),
    [("RETURN 1 + '2'", TypeMismatch), ("RETURN x", UnknownVariable), ("RETURN $none AS x", MissingParameter), ("RETURN nope(1)", Unsupported), ("RETURN toUpper(1)", InvalidFunctionCall), ("RETURN 1 AS a UNION RETURN 2 AS b", UnionMismatch), ("MATCH (n RETURN n", CypherSyntaxError), ("RETURN 1 LIMIT -1", TypeMismatch), ("UNWIND 3 AS x RETURN x", TypeMismatch), ("MATCH (n) WHERE n.age RETURN n.age", TypeMismatch), ("RETURN 1 AS a UNION RETURN 1 AS a UNION ALL RETURN 1 AS a", CypherSyntaxError), ("CALL no.such()", Unsupported), ("RETURN " + "(" * 80 + "1" + ")" * 80, CypherSyntaxError)],
)
def test_errors(e, text, error):
    with pytest.raises(error):
        e.cypher(text)


def test_trails_and_self_loops(spark):
    engine = Engine(plain(spark, [(0, 0), (0, 1), (1, 2), (2, 0)]))
    assert rows(engine, "MATCH (a)--(b) WHERE id(a) = 0 RETURN id(b) AS b ORDER BY b") == [(0,), (1,), (2,)]
    assert rows(engine, "MATCH (a)-[r*1..5]->(b) WHERE id(a) = 1 RETURN id(b) AS b, size(r) AS n ORDER BY n, b") == [(2, 1), (0, 2), (0, 3), (1, 3), (1, 4)]
    assert rows(engine, "MATCH (a)-[x]->(b)-[y]->(c) WHERE id(a) = 0 RETURN id(b) AS b, id(c) AS c ORDER BY b, c") == [(0, 1), (1, 2)]


def test_order_puts_nulls_last_then_first(spark, e):
    assert rows(e, "UNWIND [2, null, 1] AS x RETURN x ORDER BY x") == [(1,), (2,), (None,)]
    assert rows(e, "UNWIND [2, null, 1] AS x RETURN x ORDER BY x DESC") == [(None,), (2,), (1,)]


def test_whole_nodes_travel(e):
    (r,) = rows(e, "MATCH (p:Person) WITH collect(p) AS ps UNWIND ps AS q WITH q WHERE q.age = 41 RETURN q.name, q")
    assert r[0] == "Carol" and r[1].id == 3 and r[1].properties.age == 41


def test_explicit_hop_bounds_hold(spark):
    """Only an open upper bound is capped."""
    engine = Engine(plain(spark, [(i, i + 1) for i in range(18)]))
    assert rows(engine, "MATCH (a)-[r*16..17]->(b) RETURN count(*) AS n") == [(5,)]


COUNTED = [
    "MATCH (a:N)-[:R]->(h), (b:N)-[:S]->(h) RETURN h.name AS h, count(*) AS n, count(h.size) AS k, max(h.size) AS m, count(DISTINCT h) AS d",
    "MATCH (a)-[:R]->(h)<-[:S]-(b)-[:R]->(c) RETURN c.name AS c, count(*) AS n, count(a) AS k",
    "MATCH (a)-[:R]->(h), (b)-[:R]->(h) RETURN h.name AS h, count(*) AS n",
    "MATCH (a)-[:R]->(h), (b)-[:S]->(h), (c)-[]->(h) RETURN h.size AS s, count(*) + 1 AS n",
    "MATCH (a)-[:R]->(h), (b)-[:S]->(h) WHERE b.size > 1 WITH h, count(*) AS n WHERE n > 1 RETURN h.name AS h, n",
    "MATCH (a)-[:R]->(h), (b {size: a.size})-[:S]->(h) RETURN count(*) AS n",
    "MATCH (a {name: 'n1'})-[:R]->(), (b)-[:S]->(), (c) RETURN c.size AS s, count(*) AS n",
    "MATCH (a {name: 'nobody'})-[:R]->(h), (b) RETURN count(*) AS n",
    "MATCH (a {name: 'nobody'})-[:R]->(h), (b) RETURN b.size AS s, count(*) AS n",
    "MATCH (a)-[r:R]->(h), (b)-[:S]->(h) RETURN type(r) AS t, count(*) AS n",
    "MATCH (a)-[:R]->(h), (b)-[:S]->(h) RETURN h.name AS h, sum(b.size) AS s",
]


def test_counts_without_the_pairs(spark, monkeypatch):
    """The same counts as of the matches one by one."""
    from graphloom.catalog import Graph
    from graphloom.cypher.lower import Lowering

    edges = [(k, k * 7 % 11, k * 5 % 9, "RS"[k % 2]) for k in range(40)]
    nodes = [(i, ["N"] if i % 3 else ["M"], f"n{i}", i % 4 if i % 5 else None) for i in range(11)]
    graph = Graph.from_frames(spark.createDataFrame(nodes, "id long, labels array<string>, name string, size long"), spark.createDataFrame(edges, "id long, src long, dst long, type string"))
    got = [sorted(rows(Engine(graph), q), key=str) for q in COUNTED]
    monkeypatch.setattr(Lowering, "counted", lambda *_: None)
    assert got == [sorted(rows(Engine(graph), q), key=str) for q in COUNTED]
    assert all(got[:3])


def test_counts_more_pairs_than_could_be_made(spark):
    from pyspark.sql import functions as F

    from graphloom.catalog import Graph

    n = 300_000
    ids = spark.range(2 * n + 1)
    nodes = ids.select("id", F.array(F.lit("N")).alias("labels"), F.lit("x").alias("name"))
    edges = ids.filter("id > 0").select("id", F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.when(F.col("id") > n, "R").otherwise("S").alias("type"))
    assert rows(Engine(Graph.from_frames(nodes, edges)), "MATCH (a)-[:R]->(h), (b)-[:S]->(h) RETURN h.name AS h, count(*) AS n") == [("x", n * n)]
