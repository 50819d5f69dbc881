"""Queries over the test graph, one or more for each operator, and their SQL twins.

CYPHER holds query text beside SQL; BUILT holds operators that are called as
functions.  Column names, types and roundings agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.keywords import STOPWORDS
from .operators import centrality, entities, groups, memory, rag, search, traverse
from .operators.iterate import bounded, materialize
from .plans.testgraph import star

FLAGSHIP = """
MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part)
WHERE p.brand = 'Brand#2'
RETURN c.nation AS nation, count(*) AS n, round(sum(l.price), 2) AS revenue
ORDER BY revenue DESC LIMIT 10
"""

CYPHER: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "SELECT c_nationkey AS nation, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2' GROUP BY 1 ORDER BY revenue DESC LIMIT 10"),
    "all_nodes_scan": ("MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM conversations) AS n"),
    "label_scan": ("MATCH (c:Customer) RETURN c.key AS key, c.name AS name, c.segment AS segment", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer"),
    "index_seek": ("MATCH (c:Customer {segment: 'BUILDING'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "range_seek": ("MATCH (p:Part) WHERE p.size >= 10 AND p.size < 20 RETURN p.key AS key, p.size AS size", "SELECT p_partkey AS key, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 20"),
    "id_seek": ("MATCH (n:Nation) WHERE id(n) IN [562949953421312, 562949953421313] RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (0, 1)"),
    "expand_one_hop": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(n) AS nations", "SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "expand_incoming": ("MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer) RETURN n.name AS nation, count(*) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "expand_undirected": ("MATCH (n:Nation)--(x) RETURN n.name AS nation, count(x) AS degree", "SELECT n_name AS nation, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS degree FROM nation"),
    "type_disjunction": ("MATCH (x)-[r:IN_NATION|BASED_IN]->(n:Nation) RETURN type(r) AS kind, n.name AS nation, count(*) AS n", "SELECT * FROM (SELECT 'IN_NATION' AS kind, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'BASED_IN', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"),
    "label_expression": ("MATCH (n:(Nation|Region)&!Customer) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region"),
    "cartesian_and_shared": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "relationship_uniqueness": ("MATCH (a:Nation)-[:IN_REGION]->(:Region)<-[:IN_REGION]-(b:Nation) RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 200000 RETURN c.key AS key, count(o) AS big", "SELECT c_custkey AS key, count(o_orderkey) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1"),
    "variable_length": ("MATCH (a:Turn)-[r:NEXT*1..3]->(b:Turn) RETURN a.conv AS conv, size(r) AS hops, count(*) AS n", "WITH RECURSIVE w AS (SELECT conv_id, turn AS a, turn AS b, 0 AS h FROM conversations UNION ALL SELECT w.conv_id, a, c.turn, h + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = b + 1 WHERE h < 3) SELECT conv_id AS conv, h::BIGINT AS hops, count(*) AS n FROM w WHERE h > 0 GROUP BY ALL"),
    "named_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r:Region) RETURN r.name AS region, length(p) AS hops, size(nodes(p)) AS visited, count(*) AS n", "SELECT r_name AS region, 2::BIGINT AS hops, 3::BIGINT AS visited, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "shortest_path": ("MATCH (a:Nation {name: 'NATION_3'}), (b:Nation) WHERE a.key <> b.key MATCH p = shortestPath((a)-[:IN_REGION*..2]-(b)) RETURN b.name AS nation, length(p) AS hops", "SELECT b.n_name AS nation, 2::BIGINT AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_name = 'NATION_3'"),
    "pattern_predicate": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "anti_pattern": ("MATCH (t:Turn) WHERE NOT (t)-[:NEXT]->() RETURN t.conv AS conv, t.turn AS turn", "SELECT conv_id AS conv, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.total > c.balance * 50 } RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)"),
    "count_subquery": ("MATCH (n:Nation) RETURN n.name AS nation, COUNT { (n)<-[:IN_NATION]-(:Customer) } AS customers", "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation"),
    "pattern_comprehension": ("MATCH (r:Region) RETURN r.name AS region, reduce(s = '', x IN [(r)<-[:IN_REGION]-(n) | n.name] | s + x + ';') AS nations", "SELECT r_name AS region, (SELECT string_agg(n_name || ';', '' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n, sum(o.total) AS total WHERE n > 12 RETURN c.key AS key, n, round(total, 2) AS total", "SELECT c_custkey AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 12"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size % 5 AS m", "SELECT DISTINCT p_brand AS brand, (p_size % 5)::BIGINT AS m FROM part"),
    "unwind": ("UNWIND [3, 1, null, 2] AS x UNWIND range(1, x) AS y RETURN x, y", "SELECT x::BIGINT AS x, y::BIGINT AS y FROM (VALUES (3), (1), (2)) t(x), LATERAL (SELECT unnest(range(1, x + 1)) AS y)"),
    "case": ("MATCH (o:Order) RETURN CASE WHEN o.total < 50000 THEN 'low' WHEN o.total < 150000 THEN 'mid' ELSE 'high' END AS band, CASE o.status WHEN 'F' THEN 1 ELSE 0 END AS done, count(*) AS n", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END::BIGINT AS done, count(*) AS n FROM orders GROUP BY ALL"),
    "map_projection": ("MATCH (p:Part) WITH p {.brand, double: p.size * 2} AS m RETURN m.brand AS brand, sum(m.double) AS s", "SELECT p_brand AS brand, sum(p_size * 2)::BIGINT AS s FROM part GROUP BY 1"),
    "aggregates": ("MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN l.flag AS flag, count(*) AS n, count(DISTINCT l.line) AS d, round(sum(l.qty), 2) AS s, round(avg(l.price), 4) AS a, min(l.discount) AS lo, max(l.discount) AS hi", "SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_linenumber) AS d, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1"),
    "statistical_aggregates": ("MATCH (o:Order) RETURN o.status AS status, round(stDev(o.total), 3) AS sd, round(stDevP(o.total), 3) AS sp, round(percentileCont(o.total, 0.9), 3) AS pc, percentileDisc(o.total, 0.5) AS pd", "SELECT o_orderstatus AS status, round(stddev_samp(o_totalprice), 3) AS sd, round(stddev_pop(o_totalprice), 3) AS sp, round(quantile_cont(o_totalprice, 0.9), 3) AS pc, quantile_disc(o_totalprice, 0.5) AS pd FROM orders GROUP BY 1"),
    "collect": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, n ORDER BY n.name DESC RETURN r.name AS region, reduce(s = '', x IN collect(n.name) | s + x + ',') AS nations", "SELECT r_name AS region, string_agg(n_name || ',', '' ORDER BY n_name DESC) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "order_skip_limit": ("MATCH (o:Order) RETURN o.key AS key, o.total AS total ORDER BY o.total DESC, o.key SKIP 5 LIMIT 20", "SELECT o_orderkey AS key, o_totalprice AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5"),
    "union": ("MATCH (c:Customer) RETURN c.nation AS k UNION MATCH (s:Supplier) RETURN s.nation AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "string_functions": ("MATCH (p:Part) RETURN p.key AS key, toUpper(p.name) AS u, substring(p.name, 1, 3) AS s, replace(p.brand, '#', '-') AS r, size(p.type) AS n, left(p.type, 2) + right(p.type, 2) AS e, reverse(p.brand) AS v, split(p.brand, '#')[1] AS b", "SELECT p_partkey AS key, upper(p_name) AS u, substr(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, length(p_type) AS n, left(p_type, 2) || right(p_type, 2) AS e, reverse(p_brand) AS v, string_split(p_brand, '#')[2] AS b FROM part"),
    "math_functions": ("MATCH (p:Part) RETURN p.key AS key, round(sqrt(p.price), 6) AS q, round(log(p.price), 6) AS l, ceil(p.price) AS c, floor(p.price) AS f, abs(p.size - 25) AS a, sign(p.size - 25) AS g, round(sin(p.size) + atan2(p.size, 2), 6) AS t, p.size / 7 AS d, p.size % 7 AS m, round(p.price ^ 0.5, 6) AS w", "SELECT p_partkey AS key, round(sqrt(p_retailprice), 6) AS q, round(ln(p_retailprice), 6) AS l, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, abs(p_size - 25)::BIGINT AS a, sign(p_size - 25)::BIGINT AS g, round(sin(p_size) + atan2(p_size, 2), 6) AS t, (p_size // 7)::BIGINT AS d, (p_size % 7)::BIGINT AS m, round(pow(p_retailprice, 0.5), 6) AS w FROM part"),
    "list_functions": ("MATCH (n:Nation) WITH n.key AS k, range(0, n.key) AS xs RETURN k, size([x IN xs WHERE x % 2 = 0 | x * x]) AS evens, reduce(s = 0, x IN xs | s + x) AS total, any(x IN xs WHERE x > 20) AS big, all(x IN xs WHERE x < 20) AS small, single(x IN xs WHERE x = 3) AS three, last(xs) AS l, size(xs[1..3]) AS mid", "SELECT n_nationkey AS k, (n_nationkey // 2 + 1)::BIGINT AS evens, (n_nationkey * (n_nationkey + 1) // 2)::BIGINT AS total, n_nationkey > 20 AS big, n_nationkey < 20 AS small, n_nationkey >= 3 AS three, n_nationkey::BIGINT AS l, least(n_nationkey, 2)::BIGINT AS mid FROM nation"),
    "text_predicates": ("MATCH (p:Part) WHERE p.name STARTS WITH 'p' OR p.type CONTAINS 'STEEL' OR p.brand =~ '(?i)BRAND#[13]' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'p') OR contains(p_type, 'STEEL') OR regexp_full_match(p_brand, 'BRAND#[13]', 'i')"),
    "null_logic": ("UNWIND [1, null, 3] AS x RETURN x, x = 1 AS eq, x IN [3, null] AS i, x IS NULL AS nul, coalesce(x, 0) AS c, x > 2 OR x IS NULL AS o", "SELECT x::BIGINT AS x, x = 1 AS eq, x IN (3, NULL) AS i, x IS NULL AS nul, coalesce(x, 0)::BIGINT AS c, x > 2 OR x IS NULL AS o FROM (VALUES (1), (NULL), (3)) t(x)"),
    "edit_distance": ("MATCH (a:Nation), (b:Nation) WHERE a.key < b.key RETURN a.name AS a, b.name AS b, text.levenshteinDistance(a.name, b.name) AS d", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "two_hop_supply": ("MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier)-[:SUPPLIES]->(p:Part) RETURN n.name AS nation, count(DISTINCT p) AS parts", "SELECT n_name AS nation, count(DISTINCT l_partkey) AS parts FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1"),
    "user_events": ("MATCH (u:User)-[:DID]->(e:Event) WHERE e.value > 10 RETURN u.key AS user, e.type AS type, count(*) AS n, round(sum(e.value), 4) AS v", "SELECT user_id AS user, event_type AS type, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE value > 10 GROUP BY ALL"),
    "catalog_labels": ("CALL db.labels() YIELD label RETURN label", "SELECT * FROM (VALUES ('Customer'), ('Document'), ('Event'), ('Nation'), ('Order'), ('Part'), ('Region'), ('Supplier'), ('Turn'), ('User'), ('Vec')) t(label)"),
}


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its edges (src, dst), one for each line item."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))


def _supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole graph of suppliers (negative) and the parts that their line items hold: nodes id, edges src, dst, weight."""
    line = _supplied(spark, sf_dir)
    with bounded(spark, line.count()):
        edges = materialize(line.distinct())
    edges = edges.select(F.xxhash64("src", "dst").alias("id"), "src", "dst", F.lit("S").alias("type"), F.lit(1.0).alias("weight"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.withColumn("labels", F.array(F.lit("N"))), edges


def _busy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations that trade much: customer's nation -> supplier's nation where all orders have more line items than the mean pair."""
    r = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = r("orders").join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("k"))
    pairs = counted.crossJoin(F.broadcast(counted.agg(F.count("*").alias("pairs"), F.sum("k").alias("total")))).filter("k * pairs > total")  # one row beside at most 625
    edges = pairs.select((F.col("src") * 100 + F.col("dst")).alias("id"), "src", "dst", F.lit("T").alias("type"), F.lit(1.0).alias("weight"))
    return r("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.lit("N")).alias("labels"), F.col("n_name").alias("name")), edges


def _traders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations that trade, whole: customer's nation -> supplier's nation on any line item of any order (for queries without SQL)."""
    r = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = r("orders").join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).distinct()
    edges = pairs.select((F.col("src") * 100 + F.col("dst")).alias("id"), "src", "dst", F.lit("T").alias("type"), F.lit(1.0).alias("weight"))
    return r("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.lit("N")).alias("labels"), F.col("n_name").alias("name")), edges


_PAIRS = "SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"
_NATIONS = "n AS (SELECT n_nationkey::BIGINT AS id FROM nation)"
BUSY_SQL = f"WITH RECURSIVE q AS ({_PAIRS}), e AS (SELECT src, dst FROM q WHERE k * (SELECT count(*) FROM q) > (SELECT sum(k) FROM q)), {_NATIONS}"
TRADERS_SQL = f"WITH RECURSIVE e AS (SELECT src, dst FROM ({_PAIRS})), {_NATIONS}"
SUPPLY_SQL = "WITH RECURSIVE e AS (SELECT DISTINCT -1 - l_suppkey AS src, l_partkey AS dst FROM lineitem), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def _pagerank_sql(graph: str, rounds: int, teleport: str, keep: str = "") -> str:
    """Unrolled rounds over e and n; teleport: a node's share of what is handed out anew."""
    steps = f", o AS (SELECT src, count(*) AS k FROM e GROUP BY 1), v AS (SELECT id, {teleport} AS tele FROM n), p0 AS (SELECT id, tele AS s FROM v)"
    for i in range(1, rounds + 1):
        steps += f", p{i} AS (SELECT v.id, 0.15 * tele + 0.85 * (coalesce(f.x, 0) + tele * (SELECT coalesce(sum(s), 0) FROM p{i - 1} WHERE id NOT IN (SELECT src FROM o))) AS s FROM v LEFT JOIN (SELECT e.dst AS id, sum(p.s / o.k) AS x FROM e JOIN p{i - 1} p ON p.id = e.src JOIN o ON o.src = e.src GROUP BY 1) f ON f.id = v.id)"
    return f"{graph}{steps} SELECT id AS node, round(s, 6) AS score FROM p{rounds}{keep}"


def _normal_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _bm25_sql(query: str, k: int) -> str:
    """Common tables c, s and f (node, score: the k best) of a query whose trigrams don't overlap themselves."""
    grams = search.query_grams(query)
    tf = ", ".join(f"(length(t) - length(replace(t, '{g}', ''))) // 3 AS f{i}" for i, g in enumerate(grams))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(grams)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))" for i in range(len(grams)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(grams)))
    return f"c AS (SELECT doc_id AS id, greatest(length(t) - 2, 0) AS dl, {tf} FROM (SELECT doc_id, {_normal_sql("coalesce(text, '')")} AS t FROM documents)), s AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM c), f AS (SELECT id AS node, {score} AS score FROM c, s WHERE {every} ORDER BY score DESC, node LIMIT {k})"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.filter("id = 0").first()["v"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _graph(build, source=_busy):
    return lambda spark, sf_dir: _rounded(build(*source(spark, sf_dir)))


def _facts(spark, sf_dir):
    """Order status as facts over time: a new status of a customer closes the one before; a day's orders follow their keys."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    log = o.select(F.col("o_custkey").cast("string").alias("subject"), F.lit("STATUS").alias("relation"), F.col("o_orderstatus").alias("object"), F.lit("assert").alias("op"), F.lit(True).alias("exclusive"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderkey").alias("seq"))
    return memory.facts(log)


def _turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null and role is not null")
    return c.select((F.col("conv_id") * 65536 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "role", "text", F.col("turn").cast("string").alias("created_at"))


def _people(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # the type narrows blocks: customers of a nation, a segment and a band of balances
    kind = F.concat_ws("-", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 200))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), kind.alias("type"))


def _weighted(spark, sf_dir):
    nodes, edges = _supply(spark, sf_dir)
    return traverse.reachable(nodes, edges.withColumn("weight", (F.col("dst") - 1 - F.col("src")) % 13 + 1.0), -2, 20.0, direction="both").select("node", "cost")


def _points(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    points = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 170 - 85.0).alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180.0).alias("lon"))
    return _rounded(traverse.nearest(points, 42.7, 23.3, 10), 3)


def _fuzzy(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("value"))
    return search.fuzzy(n, "NATION_21", 1)


def _hybrid(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return _rounded(search.hybrid(_docs(spark, sf_dir), v, "the", q, 10))


BUILT: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pagerank": _graph(lambda n, e: centrality.pagerank(n, e, iterations=5, tolerance=0.0), _supply),
    "pagerank_personalized": lambda s, d: (lambda n, e: _rounded(centrality.pagerank(n, e, iterations=4, tolerance=0.0, seeds=s.createDataFrame([(3, 1.0)], "id long, weight double"))))(*_traders(s, d)),
    "wcc": _graph(groups.wcc, _supply), "scc": _graph(groups.scc), "triangles": _graph(centrality.triangles), "closeness": _graph(centrality.closeness), "betweenness": _graph(centrality.betweenness, _traders),
    "louvain": _graph(groups.louvain, _traders), "ricci_curvature": _graph(lambda n, e: groups.ricci(e), _traders),
    "bfs": lambda s, d: traverse.bfs(_supplied(s, d), [-2], 3, direction="both"), "reachable": _weighted, "weighted_path": lambda s, d: traverse.weighted_path(_traders(s, d)[1], 3, 21),
    "graph_expand": lambda s, d: traverse.expand(*_busy(s, d), [3], 2).select("node", "distance"),
    "spatial_nearest": _points, "fts_bm25": lambda s, d: _rounded(search.fts(_docs(s, d), "license", 20)), "text_fuzzy": _fuzzy,
    "vector_query": lambda s, d: (lambda v, q: _rounded(search.vector_query(v, q, 10)))(*_vectors(s, d)), "hybrid_search": _hybrid,
    "keywords": lambda s, d: _rounded(search.keywords(_docs(s, d), 3), 4).select("id", "rank", "term", "score"),
    "entity_candidates": lambda s, d: _rounded(entities.candidates(_people(s, d), threshold=0.97, max_pairs=10**8), 6).select("a", "b", "score"),
    "memory_facts": _facts, "memory_next": lambda s, d: memory.next_edges(_turns(s, d)),
    "rag_retrieve": lambda s, d: _rounded(rag.retrieve(*_traders(s, d), "NATION_3", k=2)[0]).select("node", "distance", "rank"),
    "extract_chunks": lambda s, d: rag.chunks(_docs(s, d)).select("id", "position", "offset", "length"),
}

BUILT_SQL: dict[str, str] = {
    "bfs": SUPPLY_SQL + ", w AS (SELECT -2::BIGINT AS node, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN b ON src = node WHERE d < 3) SELECT node, min(d)::INTEGER AS distance FROM w GROUP BY node HAVING node <> -2",
    "triangles": BUSY_SQL + ", u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), k AS (SELECT id, (SELECT count(*) FROM t WHERE id IN (a, b, c)) AS t, (SELECT count(*) FROM u WHERE id IN (a, b)) AS d FROM n) SELECT id AS node, t AS triangles, round(CASE WHEN d >= 2 THEN 2.0::DOUBLE * t / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM k",
    "closeness": BUSY_SQL + ", w AS (SELECT id AS s, id AS node, 0 AS d FROM n UNION SELECT s, dst, d + 1 FROM w JOIN e ON src = node AND src <> dst WHERE d < 12), m AS (SELECT s, node, min(d) AS d FROM w GROUP BY ALL) SELECT s AS node, round(coalesce(sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d END), 0), 6) AS score FROM m GROUP BY s",
    "scc": BUSY_SQL + ", w AS (SELECT id AS s, id AS node FROM n UNION SELECT s, dst FROM w JOIN e ON src = node), r AS (SELECT x.s AS node, min(x.node) AS root FROM w x JOIN w y ON x.s = y.node AND x.node = y.s GROUP BY 1) SELECT node, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS component FROM r",
    "wcc": "WITH RECURSIVE e AS (SELECT DISTINCT -1 - l_suppkey AS src, l_partkey AS dst FROM lineitem), s AS (SELECT DISTINCT a.src AS x, b.src AS y FROM e a JOIN e b ON a.dst = b.dst), w AS (SELECT src AS x, src AS y FROM e UNION SELECT w.x, s.y FROM w JOIN s ON w.y = s.x), r AS (SELECT x AS node, min(y) AS root FROM w GROUP BY 1), a AS (SELECT * FROM r UNION ALL SELECT dst, min(root) FROM e JOIN r ON src = node GROUP BY 1) SELECT node, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS component FROM a",
    "pagerank": _pagerank_sql(SUPPLY_SQL, 5, "1.0::DOUBLE / (SELECT count(*) FROM n)"),
    "pagerank_personalized": _pagerank_sql(TRADERS_SQL, 4, "CASE WHEN id = 3 THEN 1.0::DOUBLE ELSE 0 END", " WHERE s > 0"),
    "reachable": SUPPLY_SQL + ", w AS (SELECT -2::BIGINT AS node, 0.0::DOUBLE AS c UNION SELECT dst, c + (greatest(src, dst) - 1 - least(src, dst)) % 13 + 1 FROM w JOIN b ON src = node WHERE c + (greatest(src, dst) - 1 - least(src, dst)) % 13 + 1 <= 20) SELECT node, min(c) AS cost FROM w GROUP BY 1",
    "memory_facts": "WITH l AS (SELECT o_custkey::VARCHAR AS subject, o_orderstatus AS object, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderkey AS k FROM orders), c AS (SELECT *, lag(object) OVER (PARTITION BY subject ORDER BY ts, k) AS p FROM l) SELECT subject, 'STATUS' AS relation, object, ts AS valid_from, lead(ts) OVER (PARTITION BY subject ORDER BY ts, k) AS valid_until FROM c WHERE p IS NULL OR p <> object",
    "fts_bm25": "WITH " + _bm25_sql("license", 20) + " SELECT node, round(score, 6) AS score FROM f",
    "hybrid_search": "WITH " + _bm25_sql("the", 20) + ", v AS (SELECT vec_id AS node, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings ORDER BY score DESC, node LIMIT 20), a AS (SELECT node, row_number() OVER (ORDER BY score DESC, node) AS r FROM f WHERE score > 0), z AS (SELECT node, row_number() OVER (ORDER BY score DESC, node) AS r FROM v WHERE score > 0), j AS (SELECT node, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + z.r), 0) AS score, a.r AS x, z.r AS y FROM a FULL JOIN z USING (node)) SELECT node, round(score, 6) AS score, x::INTEGER AS \"ftsRank\", y::INTEGER AS \"vectorRank\", 'hybrid' AS mode FROM j ORDER BY j.score DESC, (x IS NOT NULL AND y IS NOT NULL) DESC, node LIMIT 10",
    "keywords": f"WITH w AS (SELECT doc_id AS id, unnest(string_split({_normal_sql('text')}, ' ')) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE length(term) > 1 AND term NOT IN ({', '.join(repr(x) for x in STOPWORDS)}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT id, term, tf * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS score FROM tf JOIN df USING (term)), k AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY score DESC, term))::INTEGER AS rank FROM r) SELECT id, rank, term, round(score, 4) AS score FROM k WHERE rank <= 3",
    "spatial_nearest": "SELECT s_suppkey AS node, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(s_suppkey % 170 - 85.0::DOUBLE) - radians(42.7::DOUBLE)) / 2), 2) + cos(radians(s_suppkey % 170 - 85.0::DOUBLE)) * cos(radians(42.7::DOUBLE)) * pow(sin((radians(s_suppkey * 7 % 360 - 180.0::DOUBLE) - radians(23.3::DOUBLE)) / 2), 2)))), 3) AS meters FROM supplier ORDER BY meters, node LIMIT 10",
    "text_fuzzy": "SELECT n_nationkey::BIGINT AS node, levenshtein(n_name, 'NATION_21') AS distance FROM nation WHERE levenshtein(n_name, 'NATION_21') <= 1",
    "vector_query": "SELECT vec_id AS node, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10",
    "memory_next": "SELECT * FROM (SELECT conv_id * 65536 + turn AS src, lead(conv_id * 65536 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) WHERE dst IS NOT NULL",
    "graph_expand": BUSY_SQL + ", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT 3::BIGINT AS node, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN b ON src = node WHERE d < 2) SELECT node, min(d)::INTEGER AS distance FROM w GROUP BY 1",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(star(spark, sf_dir)).cypher(FLAGSHIP)


def _run(text: str):
    return lambda spark, sf_dir: Engine(star(spark, sf_dir)).cypher(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(text) for name, (text, _) in CYPHER.items()} | BUILT


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CYPHER.items()} | BUILT_SQL
