import hashlib
import re

from graphloom.llm import pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def check(docs, rows):
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for d in docs:
        want, r = brute(d[1]), got[d[0]]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS], d
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (d, joined, r)
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined


def test_base_spans_match_brute_force(spark):
    texts = [
        None, "", "plain", "a@b.c%d@e.f x@y", "é😀 me@mail1.example.com, 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.1.02.255",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (743) 555-3824 +49.30.1234567 +1 2", "9" * 50_000, "a." * 20_000 + "@b", "a@b" + ".c" * 20_000,
        "1-" * 20_000 + "1", "+1 " + "(" * 9_000, "10.0.0.1 " * 3_000, "@@@ a@@b.c ..@a.b", "12345678901234567890.1.1.1 +12345678", "+1234567 8 ٠5@a.bc",
    ]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    check(docs, pii.detect(spark.createDataFrame(docs, DOCS)).collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([tuple(r) for r in docs.collect()], pii.detect(docs).collect())


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"please call cell +1 (743) 555-{1000 + i} today ok", None, None, None) for i in range(12)]
    hidden = [(100, "please call cell 743/555/9999x today ok", None, None, None), (101, "the value 743/555/1111x is odd", None, None, None)]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(seeds + hidden, DOCS)).collect()}
    assert got[100].spans == "phone:17:30" and got[100].n_phone == 0 and got[100].n_added == 1
    assert got[101].spans == ""


def test_repeats_nulls_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "x@y.zz", 1), (None, "x@y.zz", 1), (7, "1.1.1.1", 2), (7, "nothing", 3)], "doc_id long, text string, spans int")
    assert sorted((r.doc_id or -1, r.n_email, r.n_ip) for r in pii.detect(docs).collect()) == [(-1, 1, 0), (-1, 1, 0), (7, 0, 0), (7, 0, 1)]
    red = pii.redact(docs)
    assert red.columns == docs.columns
    assert sorted(r.text for r in red.collect()) == ["<EMAIL>", "<EMAIL>", "<IP>", "nothing"]
    assert pii.detect(docs.limit(0)).count() == 0


def test_grouped_numbers_are_candidates(spark):
    seeds = [(i, f"please call cell +1 (743) 555-{1000 + i} today ok", None, None, None) for i in range(12)]
    texts = ["(743) 555-1234", "743 555 12 34", "0743-555.1234"]
    hidden = [(100 + i, f"please call cell {t} today ok", None, None, None) for i, t in enumerate(texts)]
    odd = [(200, "the value (743) 555-1111 is odd", None, None, None), (201, "10.0.0.1 5551234 x", None, None, None), (202, "in 1999. 12 345 6th", None, None, None)]
    docs = spark.createDataFrame(seeds + hidden + odd, DOCS)
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[100 + i].spans, got[100 + i].n_added) == (f"phone:17:{17 + len(t)}", 1)
    assert got[200].spans == ""
    free = {(r["__id"], r.value) for r in pii._occurrences(pii.base_spans(docs))[1].collect()}
    assert {v for d, v in free if d > 200} == {"5551234", "12 345"}  # the run over a seed gives its free tokens; a sentence's end parts groups


def test_redact_cuts_overlapping_spans_as_one(spark):
    seeds = [(i, f"please call cell +1 (743) 555-{1000 + i} today ok", None, None, None) for i in range(12)]
    docs = seeds + [(100, "é😀 tel +33.1.23.45.67.89, 10.0.0.1 end", None, None, None), (101, "please call cell 743/555/9999x today, me.743/555/9999x@mail.example.com or 743/555/9999x, ok", None, None, None), (102, "a@b.c1.2.3.4", None, None, None), (103, None, None, None, None), (104, "10.0.0.1" + " 10.0.0.2" * 3000, None, None, None)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[0] == "please call cell <PHONE> today ok"
    assert got[100] == "é😀 tel <PHONE>, <IP> end"
    assert got[101] == "please call cell <PHONE> today, me.743/555/<EMAIL> or <PHONE>, ok"
    assert got[102] == "<EMAIL>" and got[103] is None and got[104] == "<IP>" + " <IP>" * 3000


def test_redact_is_detect_cut_once(spark):
    """Base and added spans of detect, merged and cut by plain Python, columns that clash included."""
    seeds = [(i, f"please call cell +1 (743) 555-{1000 + i} today ok") for i in range(12)]
    texts = ["bob7435559999x.smith@mail.com please call cell 7435559999x today ok A7435559999xB", "please call cell (743) 555-1234 today ok a@b.cc1.2.3.4", "", None, "no data", "10.0.0.1 " * 700 + "x"]
    docs = spark.createDataFrame([(*d, 1, 2, 3, "t") for d in seeds + [(50 + i, t) for i, t in enumerate(texts)]], "doc_id long, text string, added int, __id int, email_hit int, __row string")
    want = {}
    for r in pii.detect(docs).collect():
        spans = sorted((int(s), int(e), pii.KINDS.index(k)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x))
        cuts = []
        for s, e, k in spans:
            if cuts and s < cuts[-1][1]:
                cuts[-1][1] = max(cuts[-1][1], e)
                cuts[-1][2] = max(cuts[-1][2], (e - s, -k))
            else:
                cuts.append([s, e, (e - s, -k)])
        want[r.doc_id] = cuts
    red = pii.redact(docs)
    assert red.columns == docs.columns
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in red.collect():
        text, out, at = source[r.doc_id], "", 0
        if text is None:
            assert r.text is None
            continue
        for s, e, (_, k) in want[r.doc_id]:
            out, at = out + text[at:s] + f"<{pii.KINDS[-k].upper()}>", e
        assert r.text == out + text[at:], r.doc_id
        assert (r.added, r["__id"], r.email_hit, r["__row"]) == (1, 2, 3, "t")
    got = {r.doc_id: r.text for r in red.collect()}
    assert got[50] == "<EMAIL> please call cell <PHONE> today ok A7435559999xB"
    assert pii.redact(docs.limit(0)).count() == 0
