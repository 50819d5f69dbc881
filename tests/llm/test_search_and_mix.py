import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, topk
from graphloom.plans.oracle import compare


def brute_topk(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-3, 3) for _ in range(7)]) for i in range(160)]
    rows += [(200 + i, [0.0] * 7) for i in range(12)] + [(300, None), (350, []), (400, [1.0, None]), (450, [float("nan")] * 7), (500, [float("inf")] * 7), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (600, [1e6] * 7), (601, [2e6] * 7), (5, [1.0] * 7), (5, [1.0] * 7), (None, [1.0] * 7)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_topk(rows)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_query_against_sql(spark):
    from graphloom.llm import queries

    assert compare(spark, queries.op6_exact_topk, queries.OP6_SQL, "/root/testdata/sf0.001") is None


def water(budget, children):
    """children: name -> (weight, supply); what a child can't use goes to the rest by weight."""
    got, left, open_ = {}, budget, dict(children)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [n for n, (w, s) in open_.items() if w > 0 and s <= left * w / weight + 1e-9] if weight else []
        if not full:
            return got | {n: left * w / weight if weight else 0.0 for n, (w, _) in open_.items()}
        worst = min(full, key=lambda n: open_[n][1] / open_[n][0])
        got[worst] = open_.pop(worst)[1]
        left -= got[worst]
    return got


def brute_mix(rows, share, weights, epochs, seed):
    key = lambda v: "∅" if v is None else v
    docs = [(d, (key(dom), key(lang), key(src)), len((t or "").split(" ")) if (t or "") else 0) for d, dom, lang, src, t in rows]
    leaves = {}
    for _, leaf, n in docs:
        leaves[leaf] = leaves.get(leaf, 0) + n
    weight = lambda path: weights.get(path, weights.get((path[-1],), 1.0))
    budgets = {(): float(int(share * sum(leaves.values())))}
    for depth in range(1, 4):
        new = {}
        for parent, b in budgets.items():
            names = {x[:depth] for x in leaves if x[: depth - 1] == parent}
            new |= water(b, {p: (weight(p), epochs * sum(t for x, t in leaves.items() if x[:depth] == p)) for p in names})
        budgets = new
    out = []
    for leaf, total in leaves.items():
        give = math.floor(budgets[leaf] + 1e-6)
        whole = math.floor((budgets[leaf] + 1e-6) / total) if total else 0
        left = give - whole * total
        own = sorted((hashlib.md5(f"{seed}:{whole}:{'null' if d is None else d}".encode()).hexdigest(), d, n) for d, x, n in docs if x == leaf)
        run, at = 0, 0
        while at < len(own):
            tie = [o for o in own if o[0] == own[at][0]]
            run += sum(o[2] for o in tie)
            more = whole < epochs and run <= left
            out += [(d, n, min(whole, epochs) + int(more)) for _, d, n in tie]
            at += len(tie)
    return sorted(out, key=str)


WEIGHTS = {("d0",): 2.0, ("en",): 3.0, ("d1", "fr"): 2.0, ("s9",): 0.0}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.5, 2), (1.7, 2), (0.01, 3)])
def test_mixing_against_brute_force(spark, share, epochs):
    r = random.Random(6)
    rows = [(i, r.choice(["d0", "d1", None]), r.choice(["en", "en", "fr", None]), r.choice(["s0", "s0", "s0", "s1", "s9", None]), " ".join(["w"] * r.randint(0, 40)) or None) for i in range(300)]
    rows += [rows[3], rows[3], (None, "d0", "en", "s0", "a b")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, dom string, lang string, source string, text string, n_tokens int")
    got = mixing.mix(df, F.col("dom"), share=share, weights=WEIGHTS, max_epochs=epochs)
    assert sorted(((x.doc_id, x["__tokens"], x["__copies"]) for x in got.collect()), key=str) == brute_mix(rows, share, WEIGHTS, epochs, 11)
    used = sum(x["__tokens"] * x["__copies"] for x in got.collect())
    assert used <= share * sum(x["__tokens"] for x in got.collect()) + 1
    taken = mixing.apply(df, F.col("dom"), share=share, weights=WEIGHTS, max_epochs=epochs)
    assert taken.columns == df.columns and taken.count() == sum(x["__copies"] for x in got.collect())
    assert mixing.mix(df.limit(0), F.col("dom")).count() == 0


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a b\n\tc ", "\x1fa\x0bb é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(mixing.n_words(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 3]
