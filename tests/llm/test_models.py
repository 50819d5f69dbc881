"""Held-out accuracy, contracts and edge cases of the fitted operators."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, ranking, rules, secrets

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_languages_of_held_out_documents(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_edge_cases_of_languages(spark, docs):
    model = langid.fit(docs)
    en, de = (docs.filter((F.col("lang") == x) & (F.length("text") > 3000)).orderBy("doc_id").first()["text"][:3000] for x in ("en", "de"))
    (a, p), (b, q) = model.mixture(en + " " + de)[:2]
    assert {a, b} == {"en", "de"} and abs(p - 0.5) < 0.1 and abs(q - 0.5) < 0.1
    assert [x for x, _ in model.mixture(en)] == ["en"]
    odd = spark.createDataFrame([(1, None, None, None, 1.0), (1, None, None, None, 1.0), (None, "12 .", None, None, 1.0), (3, "", "en", None, 1.0), (4, en * 50, None, None, 1.0)], DOCS)
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score > 0) for r in langid.predict(odd, model).collect()))
    assert got == [(0, "und", False), (1, "und", False), (1, "und", False), (3, "und", False), (4, "en", True)]
    assert {r.lang_pred for r in langid.identify(odd.filter("lang is null")).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


def test_quality_of_held_out_documents(docs, labels):
    rows = ranking.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95


def test_quality_edge_cases(spark, docs, labels):
    odd = spark.createDataFrame([(1, None, None, None, 1.0), (1, None, None, None, 1.0), (None, "", None, None, 1.0), (4, "word " * 200_000, None, None, 1.0)], DOCS)
    model = ranking.fit(docs, labels)
    got = ranking.score(odd, model)
    assert got.columns == [*odd.columns, "__score"] and got.count() == 4 and all(0 <= r[-1] <= 1 for r in got.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in ranking.classify(odd, none).collect()} == {0.5}
    assert ranking.classify(odd.limit(0), labels).count() == 0
    assert ranking.keep_good(docs, labels).columns == docs.columns


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_rule_counts_against_brute_force(spark, docs, labels):
    rows = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(d.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    for text in (None, "", "a\x1fb é c\r\nd", "x y z x y z\nx y z\n\n \n", "|<>" * 9, "a b " * 70):
        assert rules.counts(text)[:5] == brute_counts(text)


def test_cutoffs_keep_the_risk(spark):
    import numpy as np

    assert math.isclose(rules.upper_bound(0, 100, 0.05), 1 - 0.05 ** (1 / 100), rel_tol=1e-6)
    r = np.random.default_rng(1)
    values = np.column_stack([r.random(8000) ** 12 for _ in rules.RULES])
    got = rules.cutoffs(np.zeros(8000, int), values)
    assert got and all(s == 0 for _, s in got)
    for (rule, _), cut in got.items():
        k = rules.RULES.index(rule)
        fresh = r.random(50_000) ** 12
        assert (fresh > cut).mean() <= 0.01 and (values[:, k] > cut).mean() <= 0.01
    assert rules.cutoffs(np.zeros(0, int), np.zeros((0, 5))) == {}
    odd = spark.createDataFrame([(None, None, 1), (None, None, 1), (2, "w " * 100_000, 2)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = rules.judge(odd, none).collect()
    assert sorted((r.doc_id or 0, r.base_failed) for r in out) == [(0, True), (0, True), (2, True)]


def test_cutoffs_come_from_all_labelled_rows(spark):
    """22,000 good rows, of which the 2,000 of the greatest hash have one ! for two words."""
    ids = spark.range(22_000).withColumnRenamed("id", "doc_id")
    late = ids.orderBy(F.xxhash64("doc_id").desc(), F.desc("doc_id")).limit(2000).withColumn("late", F.lit(1))
    text = "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', x, if(late = 1 and x % 2 = 0, '!', ''))))"
    docs = ids.join(late, "doc_id", "left").selectExpr("doc_id", f"{text} as text")
    got = rules.learn(docs, ids.withColumn("quality", F.lit(1)))
    assert got == {(rule, 0): 0.5 if rule == "exclaim_ratio" else 0.002 for rule in rules.RULES}


def test_secrets_against_held_out_findings(spark):
    model = secrets.fit(secrets.labelled_findings(spark))
    fresh = secrets.labelled_findings(spark, 2000, seed=99)
    right = model.transform(secrets.featured(fresh)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.93
    key = "3f9ad1c07be2448f9a6d0c5e7b1f20aa93d4e5f6"
    rows = [(1, f'x token = "{key}" y', 1), (2, f"see commit {key} fixed", 2), (3, None, 3), (3, None, 3), (None, "", 4), (5, "a" * 100_000, 5), (6, f'token = "{key}" ' * 500, 6)]
    got = sorted(((r.doc_id or 0, r.n_candidates, r.n_secrets, r.spans[:6]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()))
    assert got[0] == (0, 0, 0, "") and got[1] == (1, 1, 1, "11:51:") and got[2][:3] == (2, 1, 0) and got[3] == got[4] == (3, 0, 0, "") and got[5][1] == 1 and got[6][:3] == (6, 500, 500)


def test_secrets_directly_after_an_equals_sign(spark):
    key, name = "3f9ad1c07be2448f9a6d0c5e7b1f20aa93d4e5f6", "AWS_SECRET_ACCESS_KEY"
    texts = [f"secret={key}", f"x\ntoken={key}\ny", f"{name}={key}", f"https://x/?access_token={key}&z=1", f'{name}="{key}"', f"token=={key[:30]}==", f"{key[:38]}==", f"digest={key}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in secrets.candidates(docs).collect():
        assert texts[r["__id"]][r.start : r.end] == r.value
        got.setdefault(r["__id"], {})[r.value] = r.before
    assert [set(got[i]) for i in range(8)] == [{key}, {key}, {name, key}, {key}, {name + "=", key}, {key[:30] + "=="}, {key[:38] + "=="}, {key}]
    assert got[2][key] == f"{name}=" and got[3][key].endswith("access_token=") and got[4][key] == f'{name}="'
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    for i in range(5):
        at = texts[i].index(key)
        assert f"{at}:{at + len(key)}:" in found[i], (texts[i], found[i])
    assert "7:47:" not in found[7]
