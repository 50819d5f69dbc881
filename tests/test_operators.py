import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import centrality, entities, groups, memory, rag, search, traverse

from .graphs import plain


def rnd(seed, n, m):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


EDGES = rnd(2, 14, 26)
N = 14


@pytest.fixture(scope="module")
def g(spark):
    nodes, edges = plain(spark, EDGES, N).frames()
    return nodes.cache(), edges.cache()


def got(df):
    return {r[0]: r[1] for r in df.collect()}


def hops(edges, s, n=N):
    d, front = {s: 0}, [s]
    while front:
        nxt = []
        for a, b in edges:
            if a in front and b not in d:
                d[b] = d[a] + 1
                nxt.append(b)
        front = nxt
    return d


def test_pagerank_against_loop(g):
    out = {a: sorted({b for x, b in EDGES if x == a}) for a in range(N)}
    p = [1 / N] * N
    for _ in range(100):
        q = [0.15 / N + 0.85 * sum(p[i] for i in range(N) if not out[i]) / N] * N
        for a in range(N):
            for b in out[a]:
                q[b] += 0.85 * p[a] / len(out[a])
        if sum(abs(x - y) for x, y in zip(p, q)) < 1e-6:
            p = q
            break
        p = q
    mine = got(centrality.pagerank(*g))
    assert math.isclose(sum(mine.values()), 1, abs_tol=1e-9)
    assert all(math.isclose(mine[i], p[i], abs_tol=1e-9) for i in range(N))


def test_components(g):
    label = list(range(N))
    for _ in range(N):
        for a, b in EDGES:
            label[a] = label[b] = min(label[a], label[b])
    roots = sorted(set(label))
    assert got(groups.wcc(*g)) == {i: roots.index(label[i]) for i in range(N)}
    reach = [set(hops(EDGES, i)) for i in range(N)]
    strong = {i: min(j for j in range(N) if j in reach[i] and i in reach[j]) for i in range(N)}
    roots = sorted(set(strong.values()))
    assert got(groups.scc(*g)) == {i: roots.index(strong[i]) for i in range(N)}


def test_closeness_betweenness_triangles(g):
    loopless = [e for e in EDGES if e[0] != e[1]]
    close = got(centrality.closeness(*g))
    assert all(math.isclose(close[s], sum(1 / d for d in hops(loopless, s).values() if d)) for s in range(N))
    score = [0.0] * N
    dist = [hops(loopless, s) for s in range(N)]
    def count(s, t, memo={}):
        return 1 if s == t else sum(count(s, a) for a, b in loopless if b == t and dist[s].get(a, 99) + 1 == dist[s].get(t, -9))
    for s, t in itertools.permutations(range(N), 2):
        if t in dist[s]:
            for v in range(N):
                if v not in (s, t) and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    score[v] += count(s, v) * count(v, t) / count(s, t)
    mine = got(centrality.betweenness(*g))
    assert all(math.isclose(mine[v], score[v], abs_tol=1e-9) for v in range(N))
    und = {frozenset(e) for e in loopless}
    tri = [sum(1 for a, b in itertools.combinations(range(N), 2) if v not in (a, b) and {frozenset((v, a)), frozenset((v, b)), frozenset((a, b))} <= und) for v in range(N)]
    assert got(centrality.triangles(*g)) == dict(enumerate(tri))


def test_louvain_splits_two_cliques(spark):
    two = list(itertools.combinations(range(5), 2)) + list(itertools.combinations(range(5, 10), 2)) + [(4, 5)]
    nodes, edges = plain(spark, two).frames()
    found = groups.louvain(nodes, edges)
    assert got(found) == {i: int(i > 4) for i in range(10)}
    assert groups.modularity(edges, found) == pytest.approx(20 / 21 - 2 * (21 / 42) ** 2)


def test_ricci_and_matching(spark):
    nodes, edges = plain(spark, [(0, 1), (1, 2), (0, 2)]).frames()
    assert {(r[0], r[1]): round(r[2], 9) for r in groups.ricci(edges).collect()} == {(0, 1): 0.75, (0, 2): 0.75, (1, 2): 0.75}
    prefs = spark.createDataFrame([(1, 11, 1, 2), (1, 12, 2, 1), (2, 11, 1, 1), (2, 12, 2, 2)], "proposer long, acceptor long, pr int, ar int")
    assert sorted((r[0], r[1]) for r in groups.stable_matching(prefs).collect()) == [(1, 12), (2, 11)]


def test_traversal(g, spark):
    nodes, edges = g
    d = hops(EDGES, 0)
    assert got(traverse.bfs(edges, [0], 3)) == {k: v for k, v in d.items() if 0 < v <= 3}
    both = hops([*EDGES, *[(b, a) for a, b in EDGES]], 0)
    sub = traverse.subgraph(nodes, edges, 0, 2)
    inside = {k for k, v in both.items() if v <= 2}
    assert {r.id for r in sub[0].collect()} == inside and sub[1].count() == sum(a in inside and b in inside for a, b in EDGES)
    grown = {r.node: r.distance for r in traverse.expand(nodes, edges, [0], 2).collect()}
    assert grown == {k: v for k, v in both.items() if v <= 2}
    assert traverse.expand(nodes, edges, [0], 2, max_nodes=3).count() == 3


def test_partitions_follow_the_edges(spark, g, monkeypatch):
    """Iterations over more edges use more partitions, not larger ones; the session's settings are as before afterwards."""
    from graphloom.operators import iterate

    used = []
    real = iterate.materialize

    def noted(df):
        used.append((int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")))
        return real(df)

    monkeypatch.setattr(iterate, "PARTITION_ROWS", 5)
    for module in (centrality, groups, traverse):
        monkeypatch.setattr(module, "materialize", noted)
    nodes, edges = g
    twice = edges.union(edges)
    before = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")]
    want = [got(traverse.bfs(edges, [0], 3)), got(groups.wcc(nodes, edges))]
    for run in (lambda: traverse.bfs(twice, [0], 3), lambda: groups.wcc(nodes, twice), lambda: centrality.pagerank(nodes, twice, iterations=2), lambda: traverse.reachable(nodes, twice, 0, 5.0)):
        used.clear()
        out = run()
        if want:
            assert got(out) == want.pop(0)
        assert max(n for n, _ in used) >= edges.count() * 2 // 5 > int(before[0]) and used[-1][1] == str(8 << 20)
        assert before == [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")]


def test_weighted_paths(spark):
    w = [(0, 1, 60), (1, 2, 60), (0, 2, 150), (2, 3, 500)]
    nodes, edges = plain(spark, w).frames()
    assert [tuple(r) for r in traverse.weighted_path(edges, 0, 2).collect()] == [([0, 1, 2], 120.0)]
    assert [tuple(r) for r in traverse.reachable(nodes, edges, 0, 200, path=True).collect()] == [(0, 0.0, [0]), (1, 60.0, [0, 1]), (2, 120.0, [0, 1, 2])]
    assert traverse.weighted_path(edges, 3, 0).count() == 0
    points = spark.createDataFrame([(1, 42.0, 23.0), (2, 42.001, 23.0), (3, None, 23.0)], "id long, lat double, lon double")
    near = traverse.nearest(points, 42.0009, 23.0, 2).collect()
    assert [r.node for r in near] == [2, 1] and near[0].meters == pytest.approx(11.12, abs=0.05)
    assert traverse.nearest(points, 42.0009, 23.0, 2, 50).count() == 1


def test_timetable(spark):
    hop = spark.createDataFrame([(1, 2, [100, 400], [200, 500], ["a", "b"], ["wk", "wk"]), (2, 3, [210, 510], [300, 600], ["a", "b"], ["wk", "wk"]), (2, 4, [230, 530], [240, 540], ["c", "d"], ["wk", "wk"])], "src long, dst long, dep array<long>, arr array<long>, trip array<string>, service array<string>")
    foot = spark.createDataFrame([(3, 4, 30)], "src long, dst long, walk long")
    t = traverse.Timetable.from_hops(hop, foot)
    rows = t.earliest({1: 0}, {4: 0}, 50, min_transfer=10).collect()
    assert [(r.arriveAt, r.departAt, r.transfers) for r in rows] == [(330, 100, 0), (240, 100, 1)]


def test_full_text_and_vectors(spark):
    docs = spark.createDataFrame([(1, "Sourdough bread starter"), (2, "the sour grapes"), (3, "bread and butter"), (4, None)], "id long, text string")
    hit = search.fts(docs, "sourdough", 5).collect()
    assert [r.node for r in hit] == [1]
    t = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    texts = {1: t("Sourdough bread starter"), 2: t("the sour grapes"), 3: t("bread and butter"), 4: ""}
    gr = {i: [x[k : k + 3] for k in range(len(x) - 2)] for i, x in texts.items()}
    avg = sum(map(len, gr.values())) / 4
    want = {}
    for i in (1, 3):
        want[i] = sum(math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(gr[i]) / avg)) for q in {"bre", "rea", "ead"} for tf in [gr[i].count(q)] for df in [sum(q in x for x in gr.values())])
    mine = got(search.fts(docs, "bread", 5))
    assert mine == {i: pytest.approx(x) for i, x in want.items()}
    assert [tuple(r) for r in search.fuzzy(docs.select("id", F.lit("abc").alias("value")).limit(1), "abd", 1).collect()] == [(1, 1)]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [0.0, 0.0])], "id long, v array<double>")
    assert [r.node for r in search.vector_query(vec, [1.0, 0.1], 3).collect()] == [1, 3, 2]
    fused = search.hybrid(docs, vec, "bread", [1.0, 1.0], 3).collect()
    assert [r.node for r in fused][:2] == [3, 1] and fused[0].ftsRank is not None and fused[0].vectorRank is not None
    import numpy as np

    assert search.mmr([1, 2, 3], np.array([[1, 0], [1, 0.01], [0, 1.0]]), np.array([1.0, 0.99, 0.5]), 2) == [1, 3]
    assert {r.term: r.facet for r in search.facets(spark.createDataFrame([("anxious",), ("anxiously",), ("bread",)], "term string")).collect()} == {"anxious": "anxious", "anxiously": "anxious", "bread": "bread"}


def test_stems_and_keywords(spark):
    from graphloom.functions.keywords import porter

    assert [porter(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "connection", "running", "sky")] == ["caress", "poni", "relat", "hop", "happi", "connect", "run", "sky"]
    docs = spark.createDataFrame([(1, "cats cats dogs the the"), (2, "dogs birds")], "id long, text string")
    assert [(r.id, r.term) for r in search.keywords(docs, 1).orderBy("id").collect()] == [(1, "cats"), (2, "birds")]


def test_keywords_against_loop(spark, monkeypatch):
    """Rare and common terms, ties, empty and missing texts, repeated and missing ids."""
    r = random.Random(6)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(pool, [1 / (i + 1) for i in range(40)], k=r.randint(1, 60))) for _ in range(80)] + ["", None, "the of", "Ünique ünique émile"]
    monkeypatch.setattr(search, "HEAD_TERMS", 15)
    monkeypatch.setattr(search, "RATED_ROWS", 7)
    for ids in (list(range(len(texts))), [None, *range(1, len(texts))], [i // 2 if i % 5 else None for i in range(len(texts))]):
        tf = {}
        for i, t in zip(ids, texts):
            for x in (t or "").lower().split():
                if x not in ("the", "of"):
                    tf.setdefault(i, {}).setdefault(x, 0)
                    tf[i][x] += 1
        df = {x: sum(x in d for d in tf.values()) for d in tf.values() for x in d}
        score = lambda c, x: c * math.log(1 + (len(texts) - df[x] + 0.5) / (df[x] + 0.5))  # noqa: E731, B023
        want = {(i, n + 1, x) for i, d in tf.items() for n, (_, x) in enumerate(sorted((-round(score(c, x), 9), x) for x, c in d.items())[:3])}
        found = search.keywords(spark.createDataFrame(list(zip(ids, texts)), "id long, text string"), 3)
        assert {(row.id, row["rank"], row.term) for row in found.collect()} == want
        if len(set(ids)) == len(ids):  # no term is shuffled with its document to be counted
            assert "id#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x and "term" in x.split("hashpartitioning")[1].split(")")[0])


def test_entities(spark):
    n = spark.createDataFrame([(1, "Пушкин", "PERSON"), (2, "А. С. Пушкин", "PERSON"), (3, "Пушкина", "LOCATION"), (4, "анна петровна смирнова", "PERSON"), (5, "а п смирнова", "PERSON")], "id long, name string, type string")
    rows = entities.candidates(n, blocking="token").collect()
    assert [(r.a, r.b, r.nameScore) for r in rows] == [(1, 2, 1.0), (4, 5, 1.0)] and rows[0].reasons == ["name:1.00", "shared_token:пушкин"]
    assert entities.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert entities.name_score("а с пушкин", "л н пушкин") < 1
    with pytest.raises(ValueError, match="maxPairs"):
        entities.candidates(n, blocking="none", max_pairs=1)
    nodes = spark.createDataFrame([(1, ["P"], "A", "x", None), (2, ["P"], "B", "y", 5), (3, ["P"], "C", None, None)], "id long, labels array<string>, name string, text string, age long")
    edges = spark.createDataFrame([(10, 2, 3, "R", 1.0), (11, 1, 3, "R", 1.0), (12, 1, 2, "POSSIBLY_SAME", 1.0), (13, 3, 2, "S", 1.0)], "id long, src long, dst long, type string, weight double")
    m = spark.createDataFrame([(1, 2, 0)], "keep long, drop long, place int")
    a, b, c = entities.merge(nodes, edges, m)
    kept = {r.id: r for r in a.collect()}
    assert set(kept) == {1, 3} and kept[1].text == "x" and kept[1].age == 5 and kept[1].aliases == ["B"] and kept[1].merged_ids == [2]
    assert sorted(r.id for r in b.collect()) == [11, 13]
    assert [r.entity for r in entities.aliases(a, "b").collect()] == [1]


def test_entities_of_equal_names(spark):
    """Names are compared once: 300 nodes of two names need one comparison, not 44,850, and give the pairs of every two nodes."""
    r = random.Random(5)
    pool = ["anna petrova", "anna petrowa", "a petrova", "ann petrova", "petrova anna maria", "petr", "p"]
    rows = [(i, r.choice(pool), r.choice(["P", "Q", None])) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id long, name string, type string")
    for blocking in ("prefix3", "token", "none"):
        blocks = {"prefix3": lambda n: {" ".join([w for w in n.split() if len(w) > 1] or n.split())[:3]}, "token": lambda n: {w for w in n.split() if len(w) > 2}, "none": lambda n: {""}}[blocking]
        want = {(i, j): entities.name_score(a, b) for i, a, s in rows for j, b, t in rows if i < j and s == t and blocks(a) & blocks(b)}
        found = entities.candidates(nodes, 0.9, blocking=blocking).collect()
        assert {(x.a, x.b): x.nameScore for x in found} == {k: v for k, v in want.items() if v >= 0.9} and len(found) == len({(x.a, x.b) for x in found}) > 0
    twins = spark.createDataFrame([(i, ["anna petrova", "anna petrowa"][i % 2], "P") for i in range(300)], "id long, name string, type string")
    assert entities.candidates(twins, 0.9, max_pairs=1).count() == 300 * 299 // 2


def test_memory(spark):
    log = spark.createDataFrame([("d", "AT", "acme", "assert", True, "2024-01-01"), ("d", "AT", "acme", "assert", True, "2024-02-01"), ("d", "AT", "globex", "assert", True, "2024-03-01"), ("d", "LIKES", "tea", "assert", False, "2024-01-01"), ("d", "LIKES", "tea", "retract", False, "2024-05-01")], "subject string, relation string, object string, op string, exclusive boolean, ts string")
    f = memory.facts(log)
    assert sorted((r.object, r.valid_from, r.valid_until) for r in f.collect()) == [("acme", "2024-01-01", "2024-03-01"), ("globex", "2024-03-01", None), ("tea", "2024-01-01", "2024-05-01")]
    assert sorted(r.object for r in memory.facts_at(f, "d", "2024-03-01T02:00:00+02:00").collect()) == ["globex", "tea"]
    with pytest.raises(ValueError, match="asOf"):
        memory.facts_at(f, "d", "soon")
    old = spark.createDataFrame([(1, "s", 1, "user", "the deploy port is 7688", "t0")], "id long, session string, seq long, role string, text string, created_at string")
    new = spark.createDataFrame([("s", "bot", "ok noted", "t1"), ("z", "user", "hi", "t1")], "session string, role string, text string, created_at string")
    m = memory.add_messages(old, new).cache()
    assert [(r.seq, r.role) for r in memory.conversation(m, "s", 5).collect()] == [(1, "user"), (2, "bot")]
    assert memory.next_edges(m).count() == 1
    assert [r.node for r in memory.recall(m, "s", "deploy port", 3).collect()] == [1]


def test_rag(spark):
    nodes = spark.createDataFrame([(1, ["Person"], "Anna", "Keeps a journal"), (2, ["Thought"], "I will fail", None), (3, ["Distortion"], "Catastrophizing", "Expecting the worst"), (4, ["Message"], "hidden", None)], "id long, labels array<string>, name string, description string")
    edges = spark.createDataFrame([(1, 1, 2, "HAD", 1.0), (2, 2, 3, "IS_A", 1.0), (3, 1, 4, "SAID", 1.0)], "id long, src long, dst long, type string, weight double")
    out = rag.context(nodes, edges, "journal", fmt="triples")
    assert out["text"].split("\n")[0] == "Anna | Person | Keeps a journal" and "I will fail | IS_A | Catastrophizing" in out["text"] and "hidden" not in out["text"]
    md = rag.context(nodes, edges, "journal")
    assert md["text"].startswith("## Seeds\n- Anna (kind=Person, id=1): Keeps a journal\n\n## Neighbours\n")
    assert md["tokens"] == math.ceil(len(md["text"]) / 4) and md == rag.context(nodes, edges, "journal")
    small = rag.context(nodes, edges, "journal", budget=50)
    assert small["truncated"] and small["tokens"] <= 50
    exp = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "question int, node long")
    ret = spark.createDataFrame([(1, 9, 1), (1, 5, 2), (2, 8, 1)], "question int, node long, rank int")
    assert {r.question: (r.hit, r.recall, r.precision, r.mrr) for r in rag.evaluate(exp, ret, 3).collect()} == {1: (True, 0.5, 0.5, 0.5), 2: (False, 0.0, 0.0, 0.0)}
    pieces = rag.chunk("One sentence here. Two sentences here. Three." * 3, 40)
    assert all(p[2] <= 40 for p in pieces) and pieces[0][3].endswith(". ")


def test_pieces_are_handed_on(spark):
    """Pieces of many texts leave in small batches, and are those of each text."""
    texts = [None, "", *["Wörter und mehr. " * n for n in (1, 90, 200, 7000)], "😀 " * 900] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(1)
    whole = rag.chunks(docs)
    got = sorted(map(tuple, whole.collect()))
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in rag.chunk(t or ""))
    made = []
    fake = type("D", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: made.append(run)})()
    rag.chunks(fake)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    sizes = [sum(b.column(3).to_pylist()) for b in made[0](iter([batch]))]
    assert sum(sizes) == sum(g[3] for g in got) and max(sizes) < rag.PIECES + 1500 < sum(sizes)


def test_procedures_in_queries(spark):
    e = Engine(plain(spark, EDGES, N))
    top = e.cypher("CALL any.pagerank({maxIterations: 5}) YIELD node, score RETURN node.name AS n, score ORDER BY score DESC LIMIT 1").collect()
    assert len(top) == 1
    assert e.cypher("MATCH (n) WHERE id(n) = 0 CALL ns.graph.expand(n, {hops: 1}) YIELD node, distance WHERE distance = 1 RETURN count(*) AS c").first()[0] == len({b for a, b in EDGES if a == 0} | {a for a, b in EDGES if b == 0} - {0}) - ((0, 0) in EDGES)
    assert [r[0] for r in e.cypher("CALL db.labels()").collect()] == ["N"]
    assert e.cypher("CALL wcc() YIELD node, component RETURN count(DISTINCT component) AS c").first()[0] >= 1


def test_writes(spark):
    from graphloom.writes import ConstraintViolation, DeleteConnectedNode

    e = Engine(plain(spark, [(0, 1)]))
    one = lambda q, **p: e.cypher(q, p).first()[0]
    e.cypher("CREATE (a:City {name: 'Sofia', pop: 1})-[:IN {since: 3}]->(b:Country {name: 'BG'})")
    assert one("MATCH (a:City)-[r:IN]->(b) RETURN a.name + b.name + toString(r.since) AS x") == "SofiaBG3"
    e.cypher("UNWIND ['Sofia', 'Varna', 'Varna'] AS n MERGE (c:City {name: n}) ON CREATE SET c.fresh = true ON MATCH SET c.pop = 2")
    assert sorted(map(tuple, e.cypher("MATCH (c:City) RETURN c.name, c.pop, c.fresh").collect()), key=str) == [("Sofia", 2, None), ("Varna", None, True)]
    e.cypher("MATCH (c:City {name: 'Varna'}) SET c.pop = 7, c:Port REMOVE c.fresh")
    assert one("MATCH (c:Port) WHERE c.fresh IS NULL RETURN c.pop") == 7
    with pytest.raises(DeleteConnectedNode):
        e.cypher("MATCH (c:City {name: 'Sofia'}) DELETE c")
    e.cypher("MATCH (c:City {name: 'Sofia'}) DETACH DELETE c")
    assert one("MATCH (c:City) RETURN count(*)") == 1
    e.cypher("CREATE CONSTRAINT u FOR (c:City) REQUIRE c.name IS UNIQUE")
    with pytest.raises(ConstraintViolation):
        e.cypher("CREATE (:City {name: 'Varna'})")
    assert one("MATCH (c:City) RETURN count(*)") == 1
    e.cypher("MATCH (c:Port) FOREACH (x IN [1, 2] | CREATE (c)-[:HAS]->(:Item {k: x}))")
    assert one("MATCH (:Port)-[:HAS]->(i:Item) RETURN sum(i.k)") == 3
    assert e.cypher("CREATE (n:Z {v: 5}) RETURN n.v AS v").first()[0] == 5


def test_memory_procedures(spark):
    e = Engine(plain(spark, [(0, 1)]), embedder=lambda t: [float(len(t)), 1.0])
    e.cypher("CALL ns.memory.addMessage('s', 'user', 'the deploy port is 7688') YIELD node RETURN node.seq")
    assert e.cypher("CALL ns.memory.addMessage('s', 'bot', 'noted') YIELD node RETURN node.seq AS q, node.text AS t").collect() == [(2, "noted")]
    assert [r[0] for r in e.cypher("CALL memory.getConversation('s', 5) YIELD node RETURN node.text AS t ORDER BY node.seq").collect()] == ["the deploy port is 7688", "noted"]
    assert e.cypher("CALL memory.recall('s', 'deploy', 3) YIELD node, score RETURN node.seq AS q").first()[0] == 1
    assert e.cypher("MATCH (:Message)-[:NEXT]->(m) RETURN m.text AS t").first()[0] == "noted"
    for n, t in (("Dana", "person"), ("Acme", "organization"), ("Globex", "organization")):
        e.cypher(f"CALL memory.rememberEntity(null, '{n}', '{t}', null) YIELD node RETURN node.name")
    e.cypher("CALL memory.assertFact('Dana', 'WORKS_AT', 'Acme', true) YIELD rel RETURN rel.relation")
    e.cypher("CALL memory.assertFact('Dana', 'WORKS_AT', 'Globex', true) YIELD rel RETURN rel.relation")
    assert [(r.object, r.valid_until) for r in e.cypher("CALL memory.factsAt('Dana', null) YIELD object, valid_until RETURN object, valid_until").collect()] == [("Globex", None)]
    assert e.cypher("CALL semantic.reindex('Message', 'text', 'embedding') YIELD embedded RETURN embedded").first()[0] == 2
    assert e.cypher("CALL memory.recallSemantic('s', 'noted', 1) YIELD node RETURN node.seq AS q").first()[0] == 2


def test_arrow_batches(spark):
    from graphloom.sources.arrow import record_batches

    got = list(record_batches(spark.range(20_000)))
    assert [b.num_rows for b in got] == [8192, 8192, 3616]
