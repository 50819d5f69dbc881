"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import importlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import mixing, queries, ranking, simhash
from graphloom.llm.common import written

from .test_pii import brute as spans

SF = "/root/testdata/sf0.001"


def linked(a, b, radius):
    """At most radius bits apart in all, and at most one in some segment of 20."""
    flips = [(x ^ y) & (1 << 64) - 1 for x, y in zip(a, b)]
    return sum(f.bit_count() for f in flips) <= radius and any((f >> s & (1 << 20) - 1).bit_count() <= 1 for f in flips for s in (0, 20, 40))


def brute_groups(docs):
    """The least id of each class: exact copies by fingerprint, near ones by bits and Jaccard over all pairs."""
    near = corpus_pipeline.NEAR
    fps = [simhash.fingerprint_words(t.encode(), near["width"], near["parts"]).tolist() for _, t in docs]
    sets = [set(simhash.shingles(t.encode(), near["width"])) for _, t in docs]
    label = [d for d, _ in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if fps[i] == fps[j] or (linked(fps[i], fps[j], near["radius"]) and len(sets[i] & sets[j]) >= near["least"] * len(sets[i] | sets[j]))]
    for _ in docs:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return sorted(set(label))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources", "BPE encoding"]
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    want = {r.doc_id for r in ranking.classify(docs, labels).filter("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want
    one = corpus_pipeline.near_dedup(spark, good, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == brute_groups([(r.doc_id, r.text) for r in good.collect()])
    clean = corpus_pipeline.redact_pii(spark, one, SF).cache()
    assert clean.columns == docs.columns and clean.count() == one.count()
    for r in clean.collect():
        assert not spans(r.text) and r.n_chars == len(r.text)
    mixed = corpus_pipeline.mix_sources(spark, clean, SF).cache()
    assert mixed.columns == docs.columns
    plan = {r.doc_id: r["__copies"] for r in mixing.mix(clean, queries.domain(clean["source"]), **queries.MIX).collect()}
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: n for d, n in plan.items() if n}
    last = corpus_pipeline.encode(spark, mixed, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(last) == sum(seen.values())
    for r in last:
        assert [int(i) for i in r.ids.split()] == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_and_registration(spark):
    entry = importlib.import_module("__spark_entry__")
    assert len([n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]) == 10 and "pipeline" in entry.queries()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0


def test_near_copies_are_found(spark):
    """Pairs of all similarities from 0.8: nine in ten at least are found, none of less."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    docs, pairs = [], {}
    for i in range(150):
        words = [word() for _ in range(r.choice([60, 150, 400]))]
        other = [word() if r.random() < r.choice([0.005, 0.015, 0.022, 0.03]) else w for w in words]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = (set(simhash.shingles(t.encode(), 5)) for _, t in docs[-2:])
        pairs[2 * i + 1] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string"), **corpus_pipeline.NEAR).collect()}
    near = [d for d, j in pairs.items() if j >= 0.8]
    assert len(near) > 60 and sum(d not in kept for d in near) >= 0.9 * len(near)
    assert all(d in kept for d, j in pairs.items() if j < 0.8) and {d for d, _ in docs if d % 2 == 0} <= kept


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names, and no rows at all."""
    text = " ".join(f"word{i} is here and there" for i in range(40))
    rows = [(1, text, "en", "src_1"), (1, text, "en", "src_1"), (2, None, None, None), (3, "", "fr", "x"), (None, text, "en", "src_2"), (4, "mail me@mail.example.com now " * 4000, "en", "src_1"), (5, text + " end", "en", "src_1")]
    docs = spark.createDataFrame([(*r, 5, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long, __id int, added int")
    for make in (docs, docs.limit(0)):
        got = make
        for _, stage in corpus_pipeline.STAGES[1:4]:
            before, got = got, stage(spark, got, SF)
            assert got.columns == docs.columns
            got = written(got, "odd-rows")
            assert before.count() == 0 or got.count() <= 2 * before.count()
        last = corpus_pipeline.encode(spark, got, SF)
        assert last.count() == got.count()
    ids = sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert [d for null, d in ids if not null] == [1, 2, 4] and sum(null for null, _ in ids) == 1
