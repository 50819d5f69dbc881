"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

1. Base rules find seed entities (email, ip, card, phone) with code-point spans.
2. The words beside each seed induce lexical patterns: ``L|word``, ``R|word`` and
   ``LR|word|word``.  Identifier-like tokens and runs of digit groups (joined by
   blanks, brackets, dots and dashes) that no rule matched are the candidates; they
   share the same patterns.  A token inside a free run gives way to it.
3. Patterns and instances form a bipartite graph.  In each round a pattern's
   score for a kind is the mean score of its instances (smoothed), an
   instance's score is the noisy-or of its patterns; seeds stay at 1.
4. Candidates of high score are added to the base spans.

Defined cases: null or empty text gives zero counts and empty strings; a repeated
row is returned as often as it occurs, each time with the same result; columns
beyond doc_id and text are ignored by ``detect`` and kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, prefix_sums, written

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the rules: the same leftmost matches, without backtracking or
# recursion, so a very long token costs linear time.  \G admits a match that begins
# where the last one ended; elsewhere a run is entered at its first character only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<!\S)(?=\S*[0-9@])\S{6,}+"
# Two digit groups or more; a group with letters attached ends the run before it, and so does the end of a sentence.
RUN = r"(?<!\S)[(+]{0,2}+[0-9]++(?![^\s().,;:!?\]\"'>-])(?:(?:(?!\.\s)[\x20().-]){1,3}+[0-9]++(?![^\s().,;:!?\]\"'>-]))++"
SALTS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^0*([0-9]{1,3})$", 1).try_cast("int"), F.lit(999)) <= 255)
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(value))
    return n.between(8, 15)


def _span_test(kind: str):
    return lambda s: _valid(kind, s["value"])


def _as_span(n: int):
    fields = ("start", "end", "value", "left", "right")
    return lambda s: F.struct(F.lit(n).alias("kind"), *[s[f].alias(f) for f in fields])


def _as_cand(run: bool):
    return lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "value", "left", "right")], F.lit(run).alias("run"))


def _maybe(kind: str, text: Column) -> Column:
    """A cheap necessary condition, so that most texts never meet the rule itself."""
    if kind == "email":
        return text.contains("@")
    return text.contains("+") if kind == "phone" else text.rlike(r"[0-9]")


def _pieces(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Columns <name>_hit and <name>_gap: the matches and the text around them."""
    empty = F.array().cast("array<string>")
    return df.withColumns({
        f"{name}_hit": F.when(when, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(empty),
        f"{name}_gap": F.when(when, F.split("__text", pattern, -1)).otherwise(empty),
    })


def _starts(name: str) -> Column:
    hit, gap = F.col(f"{name}_hit"), F.col(f"{name}_gap")
    return prefix_sums(F.zip_with(hit, F.slice(gap, F.lit(1), F.size(hit)), lambda h, g: (F.length(g) + F.length(h)).cast("long")))


def _located(df: DataFrame, name: str, beside: bool = True) -> DataFrame:
    """Column <name>_at: structs of a match with start, end and, if asked for, the words beside it."""
    hit, gap = F.col(f"{name}_hit"), F.col(f"{name}_gap")
    df = df.withColumn(f"{name}_pre", F.when(F.size(hit) > 0, _starts(name)).otherwise(F.array().cast("array<long>")))
    word = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    return df.withColumn(
        f"{name}_at",
        F.transform(
            hit,
            lambda h, i: F.struct(
                h.alias("value"),
                (F.get(f"{name}_pre", i) + F.length(F.get(gap, i))).alias("start"),
                (F.get(f"{name}_pre", i) + F.length(F.get(gap, i)) + F.length(h)).alias("end"),
                *([
                    word(F.regexp_extract(F.right(F.get(gap, i), F.lit(60)), r"(\S+)\s*$", 1)).alias("left"),
                    word(F.regexp_extract(F.left(F.get(gap, i + 1), F.lit(60)), r"^\s*(\S+)", 1)).alias("right"),
                ] if beside else []),
            ),
        ),
    ).drop(f"{name}_pre", f"{name}_hit", f"{name}_gap")


def _keys(df: DataFrame) -> DataFrame:
    """A row's key: doc_id with a hash of its text, so that clashing ids don't mix."""
    return df.withColumns({"__id": F.col("doc_id"), "__hash": F.xxhash64(F.col("text"))})


def base_spans(docs: DataFrame) -> DataFrame:
    """One narrow row per document: key, base spans as an array, candidates as an array."""
    df = _keys(docs.select("doc_id", "text")).withColumn("__text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        df = _located(_pieces(df, kind, PATTERNS[kind], _maybe(kind, F.col("__text"))), kind)
        df = df.withColumn(f"{kind}_at", F.filter(f"{kind}_at", _span_test(kind)))
    df = _located(_pieces(df, "cand", CANDIDATE, F.col("__text").rlike("[0-9@]")), "cand")
    df = _located(_pieces(df, "run", RUN, F.col("__text").rlike(r"[0-9][\x20().-]")), "run")
    cands = F.concat(*[F.transform(f"{c}_at", _as_cand(c == "run")) for c in ("run", "cand")])
    spans = F.flatten(F.array(*[F.transform(f"{k}_at", _as_span(n)) for n, k in enumerate(KINDS)]))
    return df.select("__id", "__hash", *[F.size(f"{k}_at").cast("long").alias(f"n_{k}") for k in KINDS], spans.alias("spans"), cands.alias("cands"))


def _free(row, blocks: Column) -> Column:
    """By place within a document: the blocking rows before it end, and those after it begin, beyond it."""
    before = F.max(F.when(blocks, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(blocks, F.col("start"))).over(row.rowsBetween(1, Window.unboundedFollowing))
    return (before.isNull() | (before <= F.col("start"))) & (after.isNull() | (after >= F.col("end")))


def _occurrences(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds, and candidates of five digits or an @ that overlap no seed: runs, and tokens outside these runs."""
    seeds = base.select("__id", "__hash", F.explode("spans").alias("s")).select("__id", "__hash", "s.*")
    shape = F.filter("cands", lambda c: (F.length(_digits(c["value"])) >= 5) | c["value"].contains("@"))
    cands = base.filter(F.size("cands") > 0).select("__id", "__hash", F.explode(shape).alias("s")).select("__id", "__hash", F.lit(None).cast("int").alias("kind"), "s.start", "s.end", "s.value", "s.left", "s.right", "s.run")
    row = Window.partitionBy("__id", "__hash").orderBy("start", F.col("kind").asc_nulls_last(), F.desc("run"))
    placed = seeds.withColumn("run", F.lit(False)).unionByName(cands)
    placed = placed.withColumn("__seedless", _free(row, F.col("kind").isNotNull()))
    placed = placed.withColumn("__outside", _free(row, F.col("run") & F.col("__seedless")))
    return seeds, placed.filter("kind is null and __seedless and (run or __outside)").select(seeds.columns)


def _patterns(df: DataFrame) -> DataFrame:
    left, right = F.nullif("left", F.lit("")), F.nullif("right", F.lit(""))
    each = F.filter(F.array(F.concat(F.lit("L|"), left), F.concat(F.lit("R|"), right), F.concat_ws("|", F.lit("LR"), left, right)), lambda p: p.isNotNull() & (p != "LR"))
    return df.withColumn("pattern", F.explode(each))


def discover(base: DataFrame, rounds: int = 3, threshold: float = 0.9, support: int = 5, smoothing: float = 1.0) -> DataFrame:
    """Spans that the graph adds: __id, __hash, kind (index into KINDS), start, end, value.

    A pattern counts only if ``support`` distinct instances carry it.  Every join is
    on a side of one row per key; the other side is salted, so a pattern or an
    instance that holds a third of all rows is spread over tasks.
    """
    seeds, cands = _occurrences(base)
    links = _patterns(seeds.unionByName(cands)).groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    links = written(links, "pii-links")
    one = [F.coalesce(F.col("kind") == n, F.lit(False)).cast("double").alias(f"s{n}") for n in range(4)]
    fan = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    scores = links.groupBy("value").agg(F.max("kind").alias("kind")).select("value", *one)
    for _ in range(rounds):
        by_value = links.withColumn("salt", F.pmod(F.hash("pattern"), F.lit(SALTS))).join(scores.withColumn("salt", fan).hint("merge"), ["value", "salt"])
        rated = by_value.groupBy("pattern").agg(F.count("*").alias("n"), *[(F.sum(f"s{n}") / (F.count("*") + smoothing)).alias(f"p{n}") for n in range(4)]).filter(F.col("n") >= support)
        by_pattern = links.withColumn("salt", F.pmod(F.hash("value"), F.lit(SALTS))).join(rated.withColumn("salt", fan).hint("merge"), ["pattern", "salt"], "left")
        miss = lambda n: F.log(1 - F.least(F.coalesce(f"p{n}", F.lit(0.0)), F.lit(0.999)))
        scores = by_pattern.groupBy("value").agg(F.max("kind").alias("kind"), *[(1 - F.exp(F.sum(miss(n)))).alias(f"q{n}") for n in range(4)])
        scores = scores.select("value", *[F.when(F.col("kind").isNull(), F.col(f"q{n}")).when(F.col("kind") == n, 1.0).otherwise(0.0).alias(f"s{n}") for n in range(4)])
        scores = written(scores, "pii-scores")
    best = F.greatest(*[F.col(f"s{n}") for n in range(4)])
    kind = reduce(lambda rest, n: F.when(F.col(f"s{n}") == best, n).otherwise(rest), (2, 1, 0), F.lit(3))
    found = scores.select("value", best.alias("score"), kind.cast("int").alias("found")).filter(F.col("score") >= threshold)
    salted = cands.withColumn("salt", F.pmod(F.hash("__id", "start"), F.lit(SALTS)))
    return salted.join(found.withColumn("salt", fan).hint("merge"), ["value", "salt"]).select("__id", "__hash", F.col("found").alias("kind"), "start", "end", "value").distinct()


def _by_row(found: DataFrame) -> DataFrame:
    """Added spans by row key.  The list is bounded by the length of one document."""
    return found.groupBy("__id", "__hash").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("added"))


def _match(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"__id": "__id2", "__hash": "__hash2"})
    return left.join(right, (F.col("__hash") == F.col("__hash2")) & F.col("__id").eqNullSafe(F.col("__id2")), "left").drop("__id2", "__hash2")


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base counts per kind, base_sha256 and all spans of every document."""
    base = written(base_spans(docs), "pii-base")
    rows = _match(base, _by_row(discover(base, **options)))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.concat(plain(F.col("spans")), F.coalesce(plain(F.col("added")), F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    return rows.select(
        F.col("__id").alias("doc_id"), *[f"n_{k}" for k in KINDS],
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(both).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


_CUT = "array<struct<start:bigint,end:bigint,kind:int>>"
BLOCK = 256


def _running_max(ends: Column) -> Column:
    """Of each element the greatest so far, itself included; in blocks, as prefix_sums."""
    blocks = lambda e: F.transform(F.sequence(F.lit(0), ((F.size(e) - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(e, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda m: F.transform(m, lambda _, b: F.array_max(F.slice(m, F.lit(1), b)))
    inner = lambda e, pre: F.transform(e, lambda _, i: F.greatest(F.get(pre, (i / BLOCK).cast("int")), F.array_max(F.slice(e, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))
    return let(ends, lambda e: let(blocks(e), lambda m: let(before(m), lambda pre: inner(e, pre))))


def merged(spans: Column) -> Column:
    """Spans of one text in order, overlapping ones as one, of the kind of the longest (the first kind on a tie)."""

    def one(own: Column) -> Column:
        longest = F.array_max(F.transform(own, lambda s: F.struct((s["end"] - s["start"]).alias("size"), (-s["kind"]).alias("kind"))))
        return F.struct(own[0]["start"].alias("start"), F.array_max(F.transform(own, lambda s: s["end"])).alias("end"), (-longest["kind"]).cast("int").alias("kind"))

    def islands(s: Column, top: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(top, i - 1) <= x["start"]), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda at, k: one(F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at))))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["kind"].cast("int").alias("kind"))))
    whole = let(ordered, lambda s: let(_running_max(F.transform(s, lambda x: x["end"])), lambda top: islands(s, top)))
    return F.when(F.size(spans) > 0, whole).otherwise(F.array().cast(_CUT))


def cut(text: Column, cuts: Column, values: Column | None = None) -> Column:
    """text with every cut replaced by <KIND>; values: structs (n, value, kind) that go elsewhere too, where they stand as whole tokens.

    The text is taken apart BLOCK cuts at a time, so that a long text of many cuts isn't
    read from its beginning for each.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def clean(gap: Column) -> Column:
        if values is None:
            return gap
        quoted = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
        return F.aggregate(values, gap, lambda t, s: F.regexp_replace(t, quoted(s["value"]), F.get(names, s["kind"])))

    def block(b: Column) -> Column:
        own = F.slice(cuts, b * BLOCK + 1, F.lit(BLOCK))
        begin = F.coalesce(F.get(cuts, b * BLOCK - 1)["end"], F.lit(0).cast("long"))
        end = F.element_at(own, -1)["end"]
        piece = text.substr((begin + 1).cast("int"), (end - begin).cast("int"))

        def at(own: Column, begin: Column, piece: Column) -> Column:
            def each(c: Column, i: Column) -> Column:
                left = F.coalesce(F.get(own, i - 1)["end"], begin)
                return F.concat(clean(piece.substr((left - begin + 1).cast("int"), (c["start"] - left).cast("int"))), F.get(names, c["kind"]))

            return F.array_join(F.transform(own, each), "")

        return let(own, lambda o: let(begin, lambda s: let(piece, lambda p: at(o, s, p))))

    last = F.coalesce(F.element_at(cuts, -1)["end"], F.lit(0).cast("long"))
    heads = F.transform(F.sequence(F.lit(0), ((F.size(cuts) - 1) / BLOCK).cast("int")), block)
    return F.when(F.size(cuts) > 0, F.concat(F.array_join(heads, ""), clean(text.substr((last + 1).cast("int"), F.length(text))))).otherwise(text)


#: Documents with added spans that are broadcast; beyond that they meet the texts in a shuffle.
BROADCAST_DOCS = 100_000


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of ``detect`` replaced by <KIND>; other columns, null texts and row counts stay.

    Base and added spans that overlap are cut as one, at the offsets of the text as it was.
    An added value that stands elsewhere in its document as a whole token goes there too.
    Texts go through one narrow pass, which finds the base spans again, and aren't
    shuffled: the few documents with added spans are broadcast, if BROADCAST_DOCS bounds them.
    """
    base = written(base_spans(docs), "pii-base")
    added = written(_by_row(discover(base, **options)), "pii-added")
    few = added.count() <= BROADCAST_DOCS
    mine = added.withColumnsRenamed({"__id": "__id2", "__hash": "__hash2", "added": "__added"})
    # one struct column: no name of docs can clash with the columns worked with
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    df = packed.select("__row", F.col("__row")["doc_id"].alias("__id"), F.xxhash64(F.col("__row")["text"]).alias("__hash"), F.coalesce(F.col("__row")["text"].cast("string"), F.lit("")).alias("__text"))
    df = df.join(F.broadcast(mine) if few else mine, (F.col("__hash") == F.col("__hash2")) & F.col("__id").eqNullSafe(F.col("__id2")), "left").drop("__id2", "__hash2")
    for n, kind in enumerate(KINDS):
        df = _located(_pieces(df, kind, PATTERNS[kind], _maybe(kind, F.col("__text"))), kind, beside=False)
        df = df.withColumn(f"{kind}_at", F.filter(f"{kind}_at", _span_test(kind)))
    plain = lambda s, n: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), (F.lit(n) if n is not None else s["kind"]).cast("int").alias("kind"))
    of_kind = lambda n: lambda s: plain(s, n)
    own = [F.transform(f"{k}_at", of_kind(n)) for n, k in enumerate(KINDS)]
    more = F.coalesce(F.transform("__added", lambda s: plain(s, None)), F.array().cast(_CUT))
    df = df.select("__row", "__text", "__added", merged(F.concat(*own, more)).alias("__cuts"))
    also = F.array_sort(F.array_distinct(F.transform("__added", lambda s: F.struct((-F.length(s["value"])).alias("n"), s["value"].alias("value"), s["kind"].alias("kind")))))
    text = F.when(F.col("__added").isNull(), cut(F.col("__text"), F.col("__cuts"))).otherwise(cut(F.col("__text"), F.col("__cuts"), also))
    text = F.when(F.col("__row")["text"].isNotNull(), text)
    return df.select(*[(text if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns])
