"""CALL procedures: each takes the engine and driver-side arguments and returns (DataFrame, kinds of columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import InvalidFunctionCall
from .operators import centrality, entities, groups, rag, search, traverse

NODE = {"node": "node"}


def _frames(engine):
    return engine.graph.frames()


def _options(config, allowed: dict[str, str]) -> dict:
    """Renamed options; an unknown key is an error that names it."""
    config = config or {}
    if not isinstance(config, dict):
        raise InvalidFunctionCall("the config is a map")
    for key in config:
        if key not in allowed:
            raise InvalidFunctionCall(f"unknown config key {key}")
    return {allowed[k]: v for k, v in config.items() if v is not None}


def _of_types(edges: DataFrame, types) -> DataFrame:
    return edges.filter(F.col("type").isin(types)) if types else edges


def _pagerank(engine, config=None):
    nodes, edges = _frames(engine)
    o = _options(config, {"dampingFactor": "damping", "damping": "damping", "maxIterations": "iterations", "tolerance": "tolerance", "direction": "direction", "relTypes": "types", "limit": "limit", "minScore": "least"})
    limit, least = o.pop("limit", None), o.pop("least", 0)
    df = centrality.pagerank(nodes, _of_types(edges, o.pop("types", None)), **o).filter(F.col("score") >= least).orderBy(F.desc("score"), "node")
    return (df.limit(limit) if limit is not None else df), NODE


def _personalized(engine, sources, config=None):
    nodes, edges = _frames(engine)
    o = _options(config, {"dampingFactor": "damping", "damping": "damping", "maxIterations": "iterations", "tolerance": "tolerance", "direction": "direction", "relTypes": "types", "limit": "limit", "sourceWeights": "weights"})
    ids = sources if isinstance(sources, list) else [sources]
    weights = o.pop("weights", None) or [1.0] * len(ids)
    limit = o.pop("limit", None)
    seeds = engine.spark.createDataFrame([(int(i), float(w)) for i, w in zip(ids, weights)], "id long, weight double")
    df = centrality.pagerank(nodes, _of_types(edges, o.pop("types", None)), seeds=seeds, **{"iterations": 20, **o}).orderBy(F.desc("score"), "node")
    return (df.limit(limit) if limit is not None else df), NODE


def _simple(build, order=("node",)):
    def go(engine):
        nodes, edges = _frames(engine)
        return build(nodes, edges).orderBy(*order), NODE

    return go


def _matching(engine, proposers, acceptors, rel, prop):
    """Mutual ranks: proposer -> acceptor and acceptor -> proposer relationships with a numeric rank."""
    nodes, edges = _frames(engine)
    of = lambda label: nodes.filter(F.array_contains("labels", label)).select("id")
    e = edges.filter(F.col("type") == rel)
    r = F.coalesce(F.col(prop).cast("double"), F.lit(1e18))
    there = e.join(of(proposers).withColumnRenamed("id", "src"), "src").join(of(acceptors).withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("proposer"), F.col("dst").alias("acceptor")).agg(F.min(r).alias("pr"))
    back = e.join(of(acceptors).withColumnRenamed("id", "src"), "src").join(of(proposers).withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("acceptor"), F.col("dst").alias("proposer")).agg(F.min(r).alias("ar"))
    return groups.stable_matching(there.join(back, ["proposer", "acceptor"])), {"proposer": "node", "acceptor": "node"}


def _vectors(engine, label, prop) -> DataFrame:
    nodes, _ = _frames(engine)
    own = nodes.filter(F.array_contains("labels", label)) if label else nodes
    return own.select("id", F.col(prop).alias("v"))


def _vector_query(engine, label, prop, vector, k):
    return search.vector_query(_vectors(engine, label, prop), vector, k), NODE


def _vector_index(engine, index, k, vector):
    label, prop = engine.graph.vector_indexes.get(index) or tuple(index.split(".", 1))
    return _vector_query(engine, label, prop, vector, k)


def _rel_vectors(engine, index, k, vector):
    kind, prop = engine.graph.vector_indexes[index]
    edges = _frames(engine)[1]
    return search.vector_query(edges.filter(F.col("type") == kind).select("id", F.col(prop).alias("v")), vector, k).withColumnRenamed("node", "rel"), {"rel": "rel"}


def _fts(engine, query, k):
    return search.fts(rag.documents(_frames(engine)[0]), query, k), NODE


def _edge_texts(edges: DataFrame) -> DataFrame:
    strings = [f"`{n}`" for n, t in edges.dtypes if t == "string" and n != "type"]
    lists = [f"`{n}`" for n, t in edges.dtypes if t == "array<string>"]
    return edges.select("id", F.concat_ws(" ", *strings, *lists).alias("text") if strings or lists else F.lit("").alias("text"))


def _fts_rels(engine, query, k):
    return search.fts(_edge_texts(_frames(engine)[1]), query, k).withColumnRenamed("node", "rel"), {"rel": "rel"}


def _fuzzy(engine, index, query, edits):
    label, props = engine.graph.text_indexes.get(index) or (index.split(".", 1)[0], [index.split(".", 1)[1]])
    nodes = _frames(engine)[0].filter(F.array_contains("labels", label))
    return search.fuzzy(nodes.select("id", F.col(props[0]).alias("value")).filter("value is not null"), query, edits), NODE


def _embed(engine, text: str) -> list[float]:
    if engine.embedder is None:
        raise InvalidFunctionCall("no embedder is set")
    return engine.embedder(text)


def _hybrid(engine, query, label, prop, k, config=None):
    o = _options(config, {"candidates": "candidates", "rrfK": "rrf_k", "mode": "mode", "weights": "weights", "vector": "vector"})
    vector = o.pop("vector", None) or (engine.embedder(query) if engine.embedder else None)
    if "weights" in o:
        w = o["weights"]
        o["weights"] = (w.get("fts", 1.0), w.get("vector", 1.0)) if isinstance(w, dict) else tuple(w)
    nodes = _frames(engine)[0]
    own = nodes.filter(F.array_contains("labels", label)) if label else nodes
    vectors = _vectors(engine, label, prop) if prop and prop in nodes.columns else None
    return search.hybrid(rag.documents(own), vectors, query, vector, k, **o), NODE


def _semantic_query(engine, label, prop, text, k):
    return _vector_query(engine, label, prop, _embed(engine, text), k)


EXPAND = {"hops": "hops", "direction": "direction", "relTypes": "types", "perNodeLimit": "per_node", "maxNodes": "max_nodes", "labels": "labels", "excludeLabels": "exclude", "includeSeeds": "include_seeds", "asOf": "as_of"}


def _expand(engine, seeds, config=None):
    nodes, edges = _frames(engine)
    ids = seeds if isinstance(seeds, list) else [seeds]
    return traverse.expand(nodes, edges, [int(i) for i in ids], **_options(config, EXPAND)), NODE


def _weighted(engine, a, b, config=None):
    o = _options(config, {"relTypes": "types", "direction": "direction", "cost": "cost", "maxCost": "max_cost", "heuristic": "heuristic"})
    o.pop("heuristic", None)  # it only speeds a search up
    return traverse.weighted_path(_frames(engine)[1], a, b, **o), {}


def _reachable(engine, a, config=None):
    o = _options(config, {"relTypes": "types", "direction": "direction", "cost": "cost", "maxCost": "max_cost", "targets": "targets", "target": "targets", "limit": "limit", "path": "path"})
    if "max_cost" not in o:
        raise InvalidFunctionCall("maxCost is required")
    nodes, edges = _frames(engine)
    return traverse.reachable(nodes, edges, a, **o), NODE


def _nearest(engine, label, point, config=None):
    o = _options(config, {"k": "k", "maxMeters": "max_meters", "where": "where"})
    nodes = _frames(engine)[0].filter(F.array_contains("labels", label))
    for key, value in (o.pop("where", None) or {}).items():
        nodes = nodes.filter(F.col(key) == F.lit(value))
    return traverse.nearest(nodes.select("id", "lat", "lon"), point["lat"], point["lon"], **o), NODE


def _timetable(engine, starts, ends, config):
    o = _options(config, {"departAt": "depart", "hopType": "hop", "walkType": "walk", "services": "services", "minTransfer": "min_transfer", "maxTransfers": "max_transfers", "maxWalk": "max_walk", "departures": "dep", "arrivals": "arr", "trips": "trip", "service": "svc", "walkCost": "walk_cost"})
    edges = _frames(engine)[1]
    hop, walk = o.pop("hop", "HOP"), o.pop("walk", "WALK")
    lists = {n: o.pop(n, n if n != "svc" else "service") for n in ("dep", "arr", "trip", "svc")}
    hops = edges.filter(F.col("type") == hop).select("src", "dst", *[F.col(lists[n]).alias("service" if n == "svc" else n) for n in ("dep", "arr", "trip", "svc")])
    foot = edges.filter(F.col("type") == walk).select("src", "dst", F.col(o.pop("walk_cost", "weight")).cast("long").alias("walk"))
    both = foot.union(foot.select("dst", "src", "walk"))
    stops = lambda x: {int(s["id"] if isinstance(s, dict) else s): int(s.get("walk", 0)) if isinstance(s, dict) else 0 for s in (x if isinstance(x, list) else [x])}
    return traverse.Timetable.from_hops(hops, both).earliest(stops(starts), stops(ends), **o), {}


def _candidates(engine, label, config=None):
    o = _options(config, {"nameProperty": "name", "typeProperty": "type", "embeddingProperty": "embedding", "threshold": "threshold", "nameWeight": "name_weight", "vectorWeight": "vector_weight", "blocking": "blocking", "maxPairs": "max_pairs", "normalise": "normalise"})
    nodes = _frames(engine)[0].filter(F.array_contains("labels", label))
    name, kind = o.pop("name", "name"), o.pop("type", "type")
    columns = [F.col("id"), F.col(name).alias("name"), F.col(kind).alias("type") if kind in nodes.columns else F.lit(None).cast("string").alias("type")]
    vector = o.pop("embedding", None)
    if vector:
        columns.append(F.col(vector).alias("embedding"))
        o["embedding"] = "embedding"
    return entities.candidates(nodes.select(*columns), **o), {"a": "node", "b": "node"}


def _merge(engine, keep, drop, config=None):
    from .catalog import Graph

    o = _options(config, {"strategy": "strategy", "force": "force", "nameProperty": "name", "typeProperty": "type"})
    o.pop("name", None), o.pop("type", None)
    ids = drop if isinstance(drop, list) else [drop]
    nodes, edges = _frames(engine)
    mapping = engine.spark.createDataFrame([(int(keep), int(d), k) for k, d in enumerate(dict.fromkeys(ids))], "keep long, drop long, place int")
    touched = edges.filter(F.col("src").isin(ids) | F.col("dst").isin(ids)).count() if ids else 0
    new_nodes, new_edges, summary = entities.merge(nodes, edges, mapping, **o)
    from .operators.iterate import materialize

    engine.publish(Graph.from_frames(materialize(new_nodes), materialize(new_edges)))
    return summary.withColumns({"relationshipsMoved": F.lit(touched).cast("long")}), {"kept": "node"}


def _aliases(engine, name):
    return entities.aliases(_frames(engine)[0], name), {"entity": "node"}


RAG = {"k": "k", "hops": "hops", "rank": "rank", "direction": "direction", "relTypes": "types", "labels": "labels", "perNodeLimit": "per_node", "maxNodes": "max_nodes", "asOf": "as_of", "mode": "mode"}


def _retrieve(engine, query, config=None):
    return rag.retrieve(*_frames(engine), query, **_options(config, RAG))[0].orderBy("rank"), NODE


def _context(engine, query, config=None):
    o = _options(config, RAG | {"tokenBudget": "budget", "format": "fmt", "tokenizer": "tokenizer", "maxBodyChars": "most", "includeProvenance": "provenance"})
    out = rag.context(*_frames(engine), query, **o)
    return engine.spark.createDataFrame([(out["text"], out["tokens"], out["format"], out["nodeIds"], out["relIds"], out["truncated"])], "text string, tokens int, format string, nodeIds array<long>, relIds array<long>, truncated boolean"), {}


def _summarize(engine, config=None):
    o = _options(config, {"algorithm": "method", "method": "method", "gamma": "gamma", "minSize": "min_size", "maxMembers": "members", "tokenBudget": "budget", "keywords": "terms"})
    return rag.communities(*_frames(engine), **o), {}


def _chunks(engine, text, config=None):
    o = _options(config, {"chunkChars": "size", "overlap": "overlap"})
    return engine.spark.createDataFrame(rag.chunk(text, **o), "position int, offset int, length int, text string"), {}


def _names(get, column):
    def go(engine):
        return engine.spark.createDataFrame([(n,) for n in get(engine.graph)], f"{column} string"), {}

    return go


def _sequence(engine, name):
    return engine.spark.createDataFrame([(engine.sequence_next(name),)], "value long"), {}


# Agent memory: messages are (:Message)-[:NEXT]-> chains, entities (:Entity), facts RELATED_TO relationships.
POLE = ("PERSON", "OBJECT", "LOCATION", "EVENT", "ORGANIZATION")


def _now(engine) -> str:
    return engine.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]


def _column(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _one(engine, id, column="node"):
    return engine.spark.createDataFrame([(id,)] if id is not None else [], f"{column} long"), {column: "node" if column == "node" else "rel"}


def _last_message(engine, session):
    rows = engine.cypher("MATCH (m:Message {session: $s}) RETURN id(m) AS id, m.seq AS seq ORDER BY m.seq DESC LIMIT 1", {"s": session}).collect()
    return (rows[0]["id"], rows[0]["seq"]) if rows else (None, 0)


def _add_message(engine, session, role, text):
    before, seq = _last_message(engine, session)
    made = engine.cypher("CREATE (m:Message {session: $s, seq: $q, role: $r, text: $t, body: $t, created_at: $n}) RETURN id(m) AS id", {"s": session, "q": int(seq) + 1, "r": role, "t": text, "n": _now(engine)}).first()["id"]
    if before is not None:
        engine.cypher("MATCH (a) WHERE id(a) = $a MATCH (b) WHERE id(b) = $b CREATE (a)-[:NEXT]->(b)", {"a": before, "b": made})
    return _one(engine, made)


def _record(engine, session, step, tool, outcome):
    last, _ = _last_message(engine, session)
    made = engine.cypher("CREATE (t:ReasoningTrace {session: $s, step: $p, tool: $t, outcome: $o, created_at: $n}) RETURN id(t) AS id", {"s": session, "p": step, "t": tool, "o": outcome, "n": _now(engine)}).first()["id"]
    if last is not None:
        engine.cypher("MATCH (a) WHERE id(a) = $a MATCH (b) WHERE id(b) = $b CREATE (a)-[:INITIATED_BY]->(b)", {"a": made, "b": last})
    return _one(engine, made)


def _messages(engine, session):
    nodes = _frames(engine)[0]
    if "session" not in nodes.columns:
        return nodes.limit(0).select("id", F.lit("").alias("text"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("array<double>").alias("embedding"))
    own = nodes.filter(F.array_contains("labels", "Message") & (F.col("session") == session))
    return own.select("id", "text", "seq", F.col("embedding") if "embedding" in nodes.columns else F.lit(None).cast("array<double>").alias("embedding"))


def _conversation(engine, session, limit):
    return _messages(engine, session).orderBy(F.desc("seq")).limit(limit).orderBy("seq").select(F.col("id").alias("node")), NODE


def _remember(engine, session, name, kind, description):
    if str(kind).upper() not in POLE:
        raise InvalidFunctionCall(f"type is one of {POLE}")
    kind = kind.upper()
    known = engine.cypher("MATCH (e:Entity {name: $n, type: $t}) RETURN id(e) AS id", {"n": name, "t": kind}).collect()
    if known:
        id = known[0]["id"]
        if description is not None:
            engine.cypher("MATCH (e) WHERE id(e) = $i SET e.description = $d", {"i": id, "d": description})
    else:
        id = engine.cypher(f"CREATE (e:Entity:{kind.title()} {{name: $n, type: $t, description: $d, created_at: $c}}) RETURN id(e) AS id", {"n": name, "t": kind, "d": description, "c": _now(engine)}).first()["id"]
    last = _last_message(engine, session)[0] if session is not None else None
    if last is not None:
        engine.cypher("MATCH (m) WHERE id(m) = $a MATCH (e) WHERE id(e) = $b MERGE (m)-[:MENTIONS]->(e)", {"a": last, "b": id})
    return _one(engine, id)


def _current(engine) -> DataFrame:
    """Facts with the names of their ends."""
    nodes, edges = _frames(engine)
    facts = edges.filter(F.col("type") == "RELATED_TO")
    cols = {c: _column(edges, c) for c in ("relation", "valid_from", "valid_until", "source_id", "quote")}
    names = nodes.select("id", _column(nodes, "name").alias("name"))
    facts = facts.select("id", "src", "dst", *[c.alias(n) for n, c in cols.items()])
    return facts.join(names.withColumnsRenamed({"id": "src", "name": "subject"}), "src").join(names.withColumnsRenamed({"id": "dst", "name": "object"}), "dst")


def _close(engine, ids: list[int]) -> None:
    if ids:
        engine.cypher("MATCH ()-[r:RELATED_TO]->() WHERE id(r) IN $ids SET r.valid_until = $n", {"ids": ids, "n": _now(engine)})


def _assert_fact(engine, subject, relation, object, exclusive):
    open_ = [r.asDict() for r in _current(engine).filter((F.col("subject") == subject) & (F.col("relation") == relation) & F.col("valid_until").isNull()).collect()]
    same = [r["id"] for r in open_ if r["object"] == object]
    if exclusive:
        _close(engine, [r["id"] for r in open_ if r["object"] != object])
    if same:
        return _one(engine, same[0], "rel")
    made = engine.cypher("MATCH (a:Entity {name: $s}) MATCH (b:Entity {name: $o}) WITH a, b LIMIT 1 CREATE (a)-[r:RELATED_TO {relation: $r, valid_from: $n, created_at: $n}]->(b) RETURN id(r) AS id", {"s": subject, "o": object, "r": relation, "n": _now(engine)}).collect()
    if not made:
        raise InvalidFunctionCall("both ends of a fact are remembered first")
    return _one(engine, made[0]["id"], "rel")


def _retract_fact(engine, subject, relation, object):
    ids = [r["id"] for r in _current(engine).filter((F.col("subject") == subject) & (F.col("relation") == relation) & (F.col("object") == object) & F.col("valid_until").isNull()).collect()]
    _close(engine, ids)
    return _one(engine, ids[0] if ids else None, "rel")


def _facts_at(engine, name, at):
    from .operators.memory import facts_at

    held = facts_at(_current(engine), name, at)
    return held.select("subject", "relation", "object", "valid_from", "valid_until", F.col("source_id").alias("source"), "quote"), {}


def _reindex(engine, label, prop, target):
    """Embeddings of a text property: the engine's embedder in Arrow batches, or hashed words without one."""
    from .catalog import Graph
    from .operators.iterate import materialize

    nodes, edges = _frames(engine)
    if engine.embedder is None:
        value = search.hash_embed(F.col(prop)).cast("array<double>")
    else:
        import pandas as pd

        embed = engine.embedder
        value = F.pandas_udf(lambda s: pd.Series([None if t is None else list(map(float, embed(t))) for t in s]), "array<double>")(F.col(prop))
    hit = F.array_contains("labels", label) & F.col(prop).isNotNull()
    old = F.col(target).cast("array<double>") if target in nodes.columns else F.lit(None).cast("array<double>")
    new = materialize(nodes.withColumn(target, F.when(hit, value).otherwise(old)))
    n = new.filter(hit).count()
    engine.publish(Graph.from_frames(new, edges))
    return engine.spark.createDataFrame([(label, n)], "label string, embedded long"), {}


PROCEDURES = {
    "memory.addmessage": _add_message, "memory.recordreasoning": _record, "memory.getconversation": _conversation,
    "memory.recall": lambda e, s, q, k: (search.fts(_messages(e, s), q, k), NODE),
    "memory.recallvector": lambda e, s, v, k: (search.vector_query(_messages(e, s).select("id", F.col("embedding").alias("v")), v, k), NODE),
    "memory.recallsemantic": lambda e, s, q, k: (search.vector_query(_messages(e, s).select("id", F.col("embedding").alias("v")), _embed(e, q), k), NODE),
    "memory.rememberentity": _remember, "memory.assertfact": _assert_fact, "memory.retractfact": _retract_fact, "memory.factsat": _facts_at,
    "semantic.reindex": _reindex,
    "pagerank": _pagerank, "pagerank.personalized": _personalized,
    "wcc": _simple(groups.wcc), "scc": _simple(groups.scc), "louvain": _simple(groups.louvain), "triangles": _simple(centrality.triangles),
    "closeness": lambda e: (centrality.closeness(*_frames(e)).orderBy(F.desc("score"), "node"), NODE),
    "betweenness": lambda e: (centrality.betweenness(*_frames(e)).orderBy(F.desc("score"), "node"), NODE),
    "riccicurvature": lambda e: (groups.ricci(_frames(e)[1]).orderBy("from", "to"), {}),
    "stablematching": _matching,
    "vector.query": _vector_query, "index.vector.querynodes": _vector_index, "index.vector.queryrelationships": _rel_vectors,
    "fts.search": _fts, "fts.searchrelationships": _fts_rels, "index.fulltext.querynodes": lambda e, index, q, k=10: _fts(e, q, k), "text.fuzzy": _fuzzy,
    "search.hybrid": _hybrid, "semantic.query": _semantic_query,
    "semantic.embed": lambda e, text: (e.spark.createDataFrame([(_embed(e, text),)], "embedding array<double>"), {}),
    "graph.expand": _expand, "path.weighted": _weighted, "path.reachable": _reachable, "path.timetable": _timetable, "spatial.nearest": _nearest,
    "entity.candidates": _candidates, "entity.merge": _merge, "entity.aliases": _aliases,
    "rag.retrieve": _retrieve, "rag.context": _context, "community.summarize": _summarize, "extract.chunks": _chunks,
    "labels": _names(lambda g: g.all_labels(), "label"), "relationshiptypes": _names(lambda g: g.all_types(), "relationshipType"), "propertykeys": _names(lambda g: g.all_keys(), "propertyKey"),
    "sequence.next": _sequence, "sequence.current": lambda e, n: (e.spark.createDataFrame([(e.sequences.get(n, 0),)], "value long"), {}),
}
