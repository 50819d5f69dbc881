"""Secret scans: candidates by shape, false positives removed by a random forest (DataFrame functions only).

Candidates are maximal runs of 16 or more key characters.  Features: length, runs of
one character class for each character, shares of digits, capitals, vowels and distinct
characters, coverage by dictionary words, path shape, an assignment before it, and
words beside it that speak for a secret or for a plain hash or id.  The forest (JVM
library, built on DataFrames) is fitted on labelled findings; ``labelled_findings``
makes a bounded set of them, others may be passed.

Defined cases: a null or empty text has no candidate; repeated rows are returned as
often as they occur.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, written

# '=' belongs to a candidate as trailing padding only: NAME=value gives the value (and a long NAME without its '=').
CANDIDATE = r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+(?:={1,2}+(?![A-Za-z0-9+/_.-]))?"
DICTIONARY = "the|and|ing|tion|ment|able|ough|with|from|this|that|have|will|your|example|test|sample|string|value|config|data|user|name|path|file|http|www|com|org|net|src|lib|bin|usr|home|main|class|public|static|index|image|version|release|package|module|service|server|client|table|column|model|ation|ness|ible|less|ther|tho|ere|ent|ion|her|tha|nth|int|ver|sch|cht|ung|eit|que|les|est|eur|aux|los|con|cion|ado|ara|end|ous|pre|pro|inter|over|under|trans|super|auto|self"
SPEAKS_FOR = r"(?i)(token|secret|passw|passwd|api.?key|access.?key|private|credential|auth|bearer|pwd)"
SPEAKS_AGAINST = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|fingerprint|page|isbn|order|invoice)"
FEATURES = ("length", "runs", "digits", "capitals", "vowels", "distinct", "hex", "dictionary", "path", "dashes", "assigned", "for", "against")


def _share(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)


def featured(df: DataFrame, value: str = "value", before: str = "before", after: str = "after") -> DataFrame:
    """df with the vector column ``features``."""
    v, b, a = F.col(value), F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    columns = {
        "length": F.least(F.length(v), F.lit(200)),
        "runs": F.size(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) / F.length(v),
        "digits": _share(v, "0-9"), "capitals": _share(v, "A-Z"), "vowels": _share(F.lower(v), "aeiou"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(64)),
        "hex": v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / F.length(v),
        "path": (v.rlike(r"[/.][a-z]{2,}") | b.rlike(r"(://|[/\\.])$")).cast("int"),
        "dashes": _share(v, r"_.\-"),
        "assigned": b.rlike(r"[=:]\s*[\"'`]?$").cast("int"),
        "for": b.rlike(SPEAKS_FOR).cast("int"),
        "against": (b.rlike(SPEAKS_AGAINST) | a.rlike(SPEAKS_AGAINST)).cast("int"),
    }
    names = [f"__f_{n}" for n in FEATURES]
    df = df.withColumns({f"__f_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in columns.items()})
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).drop(*names)


def labelled_findings(spark: SparkSession, rows: int = 8000, seed: int = 3) -> DataFrame:
    """A bounded set of labelled findings: value, before, after, label (1: a secret)."""
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(f"{seed}-{salt}"), F.col("id")), 256)
    base64 = F.translate(F.base64(F.unhex(h("b"))), "=", "")
    pick = lambda salt, *options: F.get(F.array(*map(F.lit, options)), F.pmod(F.hash(h(salt)), F.lit(len(options))))
    words = F.concat_ws("", *[pick(f"w{k}", "the", "tion", "ment", "schung", "ing", "ciones", "version", "config", "reading", "un", "est", "over", "keit") for k in range(5)])
    values = [
        (1, F.substring(h("a"), 1, 40), ('token = "', "api_key: ", "secret=", "password is ", "Bearer ", "note "), ('"', " ", ";")),
        (1, F.substring(base64, 1, 32), ("access_key = ", "auth token ", 'private_key="', "credential: "), ('"', "", " ")),
        (1, F.concat(pick("p", "sk_live_", "ghp_", "AKIA", "xoxb-"), F.substring(base64, 1, 24)), ("uses ", "key ", "= ", "the "), (" ", ".")),
        (0, F.substring(h("a"), 1, 40), ("commit ", "sha1: ", "checksum ", "digest=", "revision "), (" ", " fixes", ".")),
        (0, F.concat_ws("-", *[F.substring(h("u"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), ("uuid ", "id=", "guid: ", "the "), (" ", ",")),
        (0, words, ("the ", "and ", ". ", "with ", ""), (" the", ".", ",", "")),
        (0, F.concat(F.initcap(words), pick("i", "", ".", ".")), (". ", "\n", ""), (" the", " ", "")),
        (0, F.upper(words), ("!! ", " ", "THE "), ("!!", " ", ".")),
        (0, F.concat_ws("/", pick("d", "usr", "home", "src", "www.example.com"), words, pick("e", "index.html", "main.py", "data.json")), ("see ", "https://", "/", "in "), (" ", ".")),
        (0, F.substring(F.conv(F.substring(h("n"), 1, 15), 16, 10), 1, 17), ("order ", "call ", "card ", "no. ", "with "), (" ", ".")),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(values)))
    choose = lambda column: F.coalesce(*[F.when(kind == n, column(v)) for n, v in enumerate(values)])
    return spark.range(rows).select(choose(lambda v: v[1]).alias("value"), choose(lambda v: pick("x", *v[2])).alias("before"), choose(lambda v: pick("y", *v[3])).alias("after"), choose(lambda v: F.lit(float(v[0]))).alias("label"))


def fit(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 5) -> RandomForestClassificationModel:
    """The forest; findings: value, before, after, label.  Bounded by the number of labelled findings."""
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(featured(findings))


def _named(hit: Column, i: Column) -> Column:
    """The candidate before, if it is the name that this one is assigned to; else empty."""
    name, gap = F.get("hit", i - 1), F.get("gap", i)
    return F.when((F.length(gap) <= 12) & gap.rlike(r"^[\"'`]?\s*[=:]?\s*[\"'`]?$") & F.concat(name, gap).rlike(r"[=:]\s*[\"'`]?$"), name).otherwise(F.lit(""))


def candidates(docs: DataFrame) -> DataFrame:
    """__id, __hash, start, end, value, before, after of every candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), text.alias("t")).filter(F.col("t").rlike(CANDIDATE))
    df = df.select("__id", "__hash", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("hit"), F.split("t", CANDIDATE, -1).alias("gap"))
    df = df.withColumn("pre", prefix_sums(F.zip_with("hit", F.slice("gap", F.lit(1), F.size("hit")), lambda h, g: (F.length(g) + F.length(h)).cast("long"))))
    # one array that holds all, exploded at once: lambdas see each element with its number
    each = F.transform(F.arrays_zip("hit", "pre", F.slice("gap", F.lit(1), F.size("hit")).alias("left"), F.slice("gap", F.lit(2), F.size("hit")).alias("right"), F.transform("hit", _named).alias("name")), lambda x: x)
    df = df.select("__id", "__hash", F.explode(each).alias("x"))
    start = (F.col("x.pre") + F.length("x.left")).cast("long")
    return df.select("__id", "__hash", start.alias("start"), (start + F.length("x.hit")).alias("end"), F.col("x.hit").alias("value"), F.right(F.concat("x.name", "x.left"), F.lit(40)).alias("before"), F.left("x.right", F.lit(40)).alias("after"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end:probability, comma-joined) of every row."""
    spark = docs.sparkSession
    model = fit(labelled_findings(spark) if findings is None else findings)
    found = written(candidates(docs), "secrets-candidates")
    rated = model.transform(featured(found)).withColumn("p", F.get(vector_to_array("probability"), 1))
    hit = F.when(F.col("p") >= threshold, F.struct("start", "end", F.round("p", 3).alias("p")))
    # the list is bounded by the length of one document
    by_row = rated.dropDuplicates(["__id", "__hash", "start"]).groupBy("__id", "__hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(hit)).alias("hits"))
    by_row = by_row.withColumnsRenamed({"__id": "id2", "__hash": "hash2"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__hash"))
    joined = rows.join(by_row, (F.col("__hash") == F.col("hash2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
    return joined.select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce(F.array_join(F.transform("hits", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["p"].cast("string"))), ","), F.lit("")).alias("spans"),
    )
