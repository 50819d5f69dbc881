"""Queries without SQL take their whole input: held against brute force on small fixtures."""

import random

from pyspark.sql import functions as F

from graphloom import queries
from graphloom.operators import memory


def brute_facts(log):
    """log: (subject, relation, object, op, exclusive, ts, seq)."""
    out, log = [], sorted(log, key=lambda r: (r[5], r[6]))
    held = {}
    for subject, relation, thing, op, exclusive, ts, _ in log:
        closed = [k for k in held if k[:2] == (subject, relation) and (k[2] == thing if op == "retract" else exclusive and k[2] != thing)]
        out += [(*k, held.pop(k), ts) for k in closed]
        if op == "assert":
            held.setdefault((subject, relation, thing), ts)
    return sorted(out + [(*k, ts, None) for k, ts in held.items()], key=str)


def test_facts_at_equal_times(spark):
    r = random.Random(4)
    log = [(r.choice("st"), r.choice("RQ"), r.choice("xyz"), r.choice(["assert"] * 4 + ["retract"]), r.random() < 0.6, f"2024-01-{r.randint(1, 9):02}", i) for i in range(400)]
    df = spark.createDataFrame(log, "subject string, relation string, object string, op string, exclusive boolean, ts string, seq long")
    assert sorted(map(tuple, memory.facts(df).collect()), key=str) == brute_facts(log)


def test_memory_facts_takes_every_order(spark, tmp_path):
    rows = [(9, 1, "O", "2024-01-01"), (2, 1, "F", "2024-01-01"), (5, 1, "P", "2024-01-01"), (7, 1, "P", "2024-01-02"), (8, 2, "F", "2024-01-01")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, d string").withColumn("o_orderdate", F.to_timestamp("d")).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, queries.BUILT["memory_facts"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute_facts([(str(c), "STATUS", s, "assert", True, d, k) for k, c, s, d in rows])
    assert ("1", "STATUS", "O", "2024-01-01", "2024-01-02") in got and len(got) == 5


def test_trade_graph_of_every_order(spark, tmp_path):
    r = random.Random(8)
    tables = {
        "nation": ([(n, f"NATION_{n}") for n in range(25)], "n_nationkey int, n_name string"),
        "customer": ([(c, c % 25) for c in range(50)], "c_custkey long, c_nationkey int"),
        "supplier": ([(s, r.randrange(25)) for s in range(40)], "s_suppkey long, s_nationkey int"),
        "orders": ([(k, r.randrange(50), r.choice([100.0, 200_000.0])) for k in range(60)], "o_orderkey long, o_custkey long, o_totalprice double"),
        "lineitem": ([(r.randrange(60), r.randrange(40)) for _ in range(90)], "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    customer, supplier, orders = dict(tables["customer"][0]), dict(tables["supplier"][0]), {k: c for k, c, _ in tables["orders"][0]}
    want = {(customer[orders[k]], supplier[s]) for k, s in tables["lineitem"][0]}
    assert {(e.src, e.dst) for e in queries._traders(spark, str(tmp_path))[1].collect()} == want
    steps = {3: 0}  # breadth first, both directions, two hops: what retrieval expands to
    for d in (1, 2):
        steps |= {y: d for x, y in want | {(b, a) for a, b in want} if steps.get(x) == d - 1 and y not in steps}
    got = {row.node: row.distance for row in queries.BUILT["rag_retrieve"](spark, str(tmp_path)).collect()}
    assert got[3] == 0 and all(steps[n] == d for n, d in got.items())
    score = {n: 1.0 * (n == 3) for n in range(25)}
    for _ in range(4):
        lost = sum(v for n, v in score.items() if all(a != n for a, _ in want))
        score = {n: (n == 3) * (0.15 + 0.85 * lost) + 0.85 * sum(score[a] / sum(x == a for x, _ in want) for a, b in want if b == n) for n in range(25)}
    got = {row.node: row.score for row in queries.BUILT["pagerank_personalized"](spark, str(tmp_path)).collect()}
    assert set(got) <= set(score) and all(abs(got.get(n, 0.0) - v) < 2e-6 for n, v in score.items())
