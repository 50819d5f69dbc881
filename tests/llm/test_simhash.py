import re

import xxhash

from graphloom.llm import simhash
from graphloom.llm.common import written

DOCS = "doc_id long, text string"


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    fps = [brute_fp(t) for _, t in docs]
    label = list(range(len(docs)))
    todo = True
    while todo:
        todo = False
        for i in range(len(docs)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    todo = True
    least = {}
    for (d, _), g in zip(docs, label):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((-1 if d is None else d), f"{f:016x}", -1 if least.get(g) is None else least[g]) for (d, _), f, g in zip(docs, fps, label))


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_fingerprints_and_components(spark):
    base = " ".join(f"word{i}" for i in range(300))
    docs = [(10, None), (4, ""), (9, " \n\t"), (5, "One"), (6, "one"), (7, "one two"), (8, "ÀB c \x1fd e f"), (None, base), (20, base), (20, base), (3, base.replace("word7 ", "wordx ")), (2, base.replace("word9 ", "")), (30, "a b c d " * 5000)]
    docs += [(100 + i, base + f" extra{i}") for i in range(40)]
    got = rows(simhash.near_duplicates(spark.createDataFrame(docs, DOCS)))
    assert got == brute(docs)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_against_all_pairs(spark):
    import random

    r = random.Random(5)
    fps = [0, -1] + [r.getrandbits(64) - (1 << 63) for _ in range(150)]
    for f in list(fps):
        for k in (1, 2, 4, 5):
            g = f
            for b in r.sample(range(64), k):
                g ^= 1 << b
            fps.append(g - (1 << 64) if g >= 1 << 63 else g + (1 << 64) if g < -(1 << 63) else g)
    fps = list(set(fps))
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    wide = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 8}
    assert {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius=8).collect()} == wide
    for segments in (2, 3):
        got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), segments=segments).collect()}
        assert got == want


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(simhash.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_keep_first_keeps_columns_and_rows_without_id(spark):
    docs = spark.createDataFrame([(2, "a b", "x"), (1, "a b", "y"), (1, "a b", "y"), (None, "a b", "z")], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.keep_first(docs).collect()), key=str) == [(1, "a b", "y"), (None, "a b", "z")]


def test_keep_first_tells_clashing_ids_apart(spark):
    a, b, c = ("one two three four five", "red green blue pink grey", "salt oil bread rice beans")
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (0, b), (2, a), (3, None), (1, c), (4, c)], "doc_id long, text string")
    got = sorted(map(tuple, simhash.keep_first(docs).collect()), key=str)
    assert got == sorted([(0, b), (1, a), (1, c), (3, None)], key=str)


def test_wide_links_against_all_pairs(spark):
    """Near pairs, equal segments, single flips in either half, and hubs: each pair once, none lost."""
    import random

    import numpy as np

    r = random.Random(9)
    fps = [[r.getrandbits(64) for _ in range(5)] for _ in range(60)]
    for f in list(fps):
        for k in (1, 20, 50, 64, 65):
            g = list(f)
            for b in r.sample(range(320), k):
                g[b // 64] ^= 1 << b % 64
            fps.append(g)
    fps += [[fps[0][0], *f[1:]] for f in fps[:40]]  # unlike ones of which whole segments are equal
    fps = np.unique(np.array(fps, np.uint64), axis=0)
    cuts = [(p, s) for p in range(5) for s in (0, 20, 40)]
    want = set()
    for i, a in enumerate(fps.tolist()):
        for b in fps[:i].tolist():
            flips = [x ^ y for x, y in zip(a, b)]
            if sum(f.bit_count() for f in flips) <= 64 and any((flips[p] >> s & (1 << 20) - 1).bit_count() <= 1 for p, s in cuts):
                want.add(tuple(sorted(simhash._name(np.array(x, np.uint64).view(np.int64)) for x in (a, b))))
    table = [(simhash._name(f), f.tolist()) for f in fps.view(np.int64)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "10000"):  # places that span batches, and many places in one
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [(x.a, x.b) for x in simhash.wide_links(spark.createDataFrame(table, "fp long, words array<long>"), 5, 64).collect()]
            assert len(want) > 200 and len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_wide_links_send_no_pairs(spark):
    """Random fingerprints that meet in one segment: what is shuffled grows with the fingerprints, not with their pairs."""
    import numpy as np

    r = np.random.default_rng(4)

    def sent(n):
        fps = r.integers(-(1 << 62), 1 << 62, (n, 5))
        fps[:, 0] = fps[:, 0] >> 20 << 20
        df = spark.createDataFrame([(simhash._name(f), f.tolist()) for f in fps], "fp long, words array<long>")
        context = spark.sparkContext._jsc.sc()
        total = lambda: sum(e.totalShuffleWrite() for e in [context.statusStore().executorSummary("driver")])
        before = total()
        assert simhash.wide_links(df, 5, 64).count() == 0
        context.listenerBus().waitUntilEmpty()
        return total() - before

    small, large = sent(500), sent(2000)
    assert 0 < large < 5 * small


def test_verification_of_large_groups(spark, monkeypatch):
    """Groups of many near copies: the classes of all pairs, and sets are sent for few of them."""
    import random

    def group(r, n):
        words = [f"w{r.getrandbits(30)}" for _ in range(300)]
        docs = [list(words)]
        while len(docs) < n:
            docs.append(list(r.choice(docs[-3:])))  # a chain of copies: its ends have little in common
            for i in r.sample(range(300), 2):
                docs[-1][i] = f"w{r.getrandbits(30)}"
        return [" ".join(d) for d in docs]

    def run(n):
        r = random.Random(n)
        docs = list(enumerate(group(r, n) + group(r, n) + [" ".join(f"w{r.getrandbits(30)}" for _ in range(300)) for _ in range(20)]))
        table = spark.createDataFrame(docs, DOCS)
        rows = simhash.fingerprints(table, 5, 5).collect()
        reps = spark.createDataFrame([(x.fp, x.doc_id) for x in rows], "fp long, rep long")
        pairs = [tuple(sorted((x.fp, y.fp))) for k in (0, n) for i, x in enumerate(rows[k : k + n]) for y in rows[k : k + i]]
        near = written(spark.createDataFrame(pairs, "a long, b long"), "test-near")
        context = spark.sparkContext._jsc.sc()
        total = lambda: context.statusStore().executorSummary("driver").totalShuffleWrite()
        before = total()
        got = [(x.a, x.b) for x in simhash.verified(table, reps, near, 5, 0.8, 5).collect()]
        context.listenerBus().waitUntilEmpty()
        sent = total() - before
        sets = {x.fp: set(simhash.shingles(docs[x.doc_id][1].encode(), 5)) for x in rows}
        want = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        assert set(got) <= set(want) and classes(sets, got) == classes(sets, want) and len(want) < len(pairs)
        return sent

    small, large = run(30), run(90)
    assert large < 5 * small
    monkeypatch.setattr(simhash, "BLOCK", 20_000)  # several blocks a class
    run(30)


def classes(nodes, pairs):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
