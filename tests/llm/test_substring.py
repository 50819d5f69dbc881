import hashlib
import random
import re

from graphloom.llm import substring

DOCS = "doc_id long, text string"


def brute(docs):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    seen, out = {}, []
    for d, w in sorted(set((d, tuple(w)) for d, w in words)):
        for s in range(len(w) - 19):
            seen.setdefault(w[s : s + 20], (d, w, s))
    for d, w in words:
        gone = set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] != (d, tuple(w), s):
                gone |= set(range(s, s + 20))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice("ab") * r.randint(1, 9) + r.choice("xyz")
    passages = [[word() for _ in range(r.choice([19, 20, 21, 60]))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randint(1, 30))]
        docs.append((i * 3, r.choice([" ", "\n", " \t"]).join(w)))
    docs += [(500 + i, docs[7][1]) for i in range(5)] + [(1, "a b c " * 30), (2, "b c a " * 9), (4, "x " * 24), (5, "y " * 24 + "z"), (900, None), (901, "é\x1c  " * 40), (6, " ".join(passages[3]))]
    df = spark.createDataFrame(docs, DOCS)
    assert rows(substring.deduplicate(df)) == brute(docs)
    assert rows(substring.deduplicate(df, batches=3, fanout=1)) == brute(docs)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(substring.deduplicate(df)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(5, text, 1), (5, text, 1), (None, text, 2)], "doc_id long, text string, start int")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.deduplicate(df).collect()) == [(0, 0), (5, 25), (5, 25)]
    assert substring.deduplicate(df.limit(0)).count() == 0


def test_an_index_that_stays_goes_on(spark, tmp_path):
    r = random.Random(9)
    word = lambda: r.choice("abcdef") * r.randint(1, 6)
    passages = [[word() for _ in range(r.choice([20, 33]))] for _ in range(4)]
    docs = [(i, " ".join(sum([r.choice(passages) if r.random() < 0.4 else [word() for _ in range(12)] for _ in range(4)], []))) for i in range(30)]
    docs += [(30, docs[3][1]), (31, docs[12][1])]
    whole, folder, got = spark.createDataFrame(docs, DOCS), f"file://{tmp_path}/index", []
    for low, high in ((0, 9), (10, 24), (25, 40)):
        part = spark.createDataFrame([d for d in docs if low <= d[0] <= high], DOCS)
        got += rows(substring.deduplicate(part, batches=1, folder=folder, corpus=whole))
    assert sorted(got) == brute(docs)
    index = substring.Index(spark, folder)
    assert len(index.runs) == 2 and index.past("windows")[0].count() > 0
    index.close()


def test_history_is_merged_without_shuffle_or_sort(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(8)], DOCS)
    index = substring.Index(spark, f"file://{tmp_path}/index", fanout=5)
    for k in range(2):
        index.ingest(docs.filter(f"doc_id % 2 = {k}"))
    with substring._ordered(spark, index.buckets):
        one, two = index.past("cold")
        plan = one.hint("merge").join(two, "a")._jdf.queryExecution().executedPlan().toString()
    index.close()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_windows_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    """With anchors and hashes of 2 bits most windows collide; words decide, and nothing clean goes."""
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("abcdefgh") * 3 + str(r.randint(0, 99)) for _ in range(30))) for i in range(12)]
    words = [t.split() for _, t in docs]
    table = [{"id": i, "s": s, "n": 1, "id0": 0, "s0": 0} for i in range(1, 12) for s in range(3)]
    segments = spark.createDataFrame(table, "id long, s int, n int, id0 long, s0 int")
    marked = spark.createDataFrame([(d, substring._key(" ".join(w).encode()), len(w), hashlib.sha256(" ".join(w).encode()).digest(), False, None) for (d, _), w in zip(docs, words)], "id long, key long, n_words long, sha binary, copy boolean, inner array<long>")
    got = substring.cut(spark.createDataFrame(docs, DOCS), marked, segments)
    assert rows(got) == brute(docs) and all(x[2] == 0 for x in rows(got))


def test_ids_that_clash_and_many_copies(spark):
    r = random.Random(5)
    base = [" ".join(f"v{r.randint(0, 400)}" for _ in range(45)) for _ in range(5)]
    docs = [(7, base[0]), (7, base[1] + " " + base[4]), (8, base[0]), (9, base[1]), (7, base[0])] + [(100 + i, base[2]) for i in range(300)] + [(3, base[3] + " x " + base[3])]
    assert rows(substring.deduplicate(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_a_long_text_and_clashing_columns(spark):
    r = random.Random(6)
    long = " ".join(f"u{r.randint(0, 30)}" for _ in range(60_000))
    docs = [(1, long), (2, "tail " + long[5000:9000])]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, id int, a int, inner string")
    assert rows(substring.deduplicate(df)) == brute(docs)


def test_batches_read_their_own_ids_and_entries_are_written_once(spark, tmp_path, monkeypatch):
    """A batch's ids reach the Parquet scan, null ids are in the first, and leaving copies out doesn't write the entries again."""
    docs = [(i, " ".join(f"w{i % 7}x{j}" for j in range(30))) for i in range(40)] + [(None, "a b"), (None, " ".join(f"w3x{j}" for j in range(30)))]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/docs")
    plans, labels, counts = [], [], []
    ingest, written = substring.Index.ingest, substring.written

    def seen(self, batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        counts.append((batch.count(), batch.filter("doc_id is null").count()))
        return ingest(self, batch)

    monkeypatch.setattr(substring.Index, "ingest", seen)
    monkeypatch.setattr(substring, "written", lambda df, label, *rest: labels.append(label) or written(df, label, *rest))
    got = substring.deduplicate(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(map(str, rows_of(got))) == sorted(map(str, ((None if d == -1 else d, *rest) for d, *rest in brute([(-1 if d is None else d, t) for d, t in docs]))))
    assert len(plans) == 3 and sum(n for n, _ in counts) == len(docs) and [n for _, n in counts] == [2, 0, 0]
    assert all("LessThanOrEqual(doc_id" in p for p in plans[:2]) and all("GreaterThan(doc_id" in p for p in plans[1:])
    assert labels.count("lsm-rows") == 3 and "lsm-own" not in labels


def rows_of(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()]


def test_many_copies_are_met_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 1)
    base = [" ".join(f"v{k}x{j}" for j in range(45)) for k in range(4)]
    docs = [(i, base[i % 4] + (" z" * 3 if i % 5 == 0 else "")) for i in range(40)]
    assert rows(substring.deduplicate(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_windows_repeated_in_a_text_count_from_their_first_place():
    """Of windows that a text repeats, all but the first are named, whatever the sort of the hashes does with equals."""
    r = random.Random(21)
    base = [f"q{r.randint(0, 9)}".encode() for _ in range(30)]
    texts = [base * k + [b"end"] for k in (1, 3, 9)] + [[], [b"x"] * 400]
    *_, inner, upto = substring.fingerprints(texts)
    for k, t in enumerate(texts):
        seen, want = set(), []
        for s in range(len(t) - 19):
            w = tuple(t[s : s + 20])
            want += [s] if w in seen else []
            seen.add(w)
        assert inner[upto[k] : upto[k + 1]].tolist() == want


def test_few_wide_rows_are_held_at_once(spark, tmp_path):
    """Batches to Python are bounded by rows and by bytes while a batch is indexed, whatever the session's are; its settings come back."""
    names = ("arrow.maxRecordsPerBatch", "arrow.maxBytesPerBatch")
    names = ("spark.sql.parquet.columnarReaderBatchSize", *(f"spark.sql.execution.{n}" for n in names))
    before = [spark.conf.get(n) for n in names]
    docs = [(i, f"a{i} b") for i in range(3000)] + [(5000 + i, f"{i} " + "x" * 300_000) for i in range(30)]
    folder = str(tmp_path)

    def seen(batches):
        for k, batch in enumerate(batches):
            with open(f"{folder}/{k}-{batch.column(0)[0]}", "w") as out:
                out.write(f"{batch.num_rows} {batch.nbytes}")
            yield batch

    df = spark.createDataFrame(docs, DOCS).coalesce(1).mapInArrow(seen, DOCS)
    index = substring.Index(spark, f"file://{tmp_path}/index/of")
    marked, _ = index.ingest(df)
    assert marked.count() == len(docs)
    index.close()
    got = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir() if p.is_file()]
    assert sum(n for n, _ in got) == len(docs)
    assert max(n for n, _ in got) <= 1000 and max(b for _, b in got) < 4 << 20
    assert [spark.conf.get(n) for n in names] == before
