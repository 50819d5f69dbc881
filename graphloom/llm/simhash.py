"""SimHash near-duplicates by multi-index hashing.

Fingerprint: lower-case A-Z, words, 4-word shingles (repeats included), XXH64
with seed 42 of each; a bit is 1 if set in over half of the hashes.  Fewer than
four words: the whole sequence is one shingle; no word: fingerprint zero.

Linking: fingerprints of at most ``radius`` differing bits.  A fingerprint is cut
into ``segments``; two that differ in at most 4 bits differ in at most
4 // segments bits in some segment.  Each distinct fingerprint is put in one table
per segment under the segment's value, and looks up the Hamming ball around its
own value.  For distance 1 only 0 -> 1 flips are looked up: of two values one bit
apart, one has the 0.  Candidates are verified over all 64 bits.  Copies share a
fingerprint and never meet as pairs; a hot fingerprint is one row here.

With a radius of 6 to 8 and three segments, the balls have two bits; then either side
looks up what is one bit away and they meet half-way.  ``least`` keeps only links
whose texts share that part of their shingles.

``parts`` > 1 makes fingerprints of 64 * parts bits (further bits from remixed hashes).
Texts that share 0.8 of their shingles differ in about 15 % of the bits, which no
64-bit table finds; of 15 segments of 20 bits in 320, one is within one bit with
probability 0.94 at a similarity of 0.8, 0.99 at 0.85 and 1.00 at 0.9.

Three segments of 64 bits suit up to some 10^9 distinct fingerprints; use two beyond
that (ball of radius 2, fewer candidates for each look-up).  With wide fingerprints
``bits`` should be two over the binary logarithm of the number of documents, and
``parts`` grow as the segments needed for the same recall.

Defined cases: a null text has no word; repeated rows are returned as often as
they occur; a null doc_id has a fingerprint and takes its group's component, but
is never the smallest id (a group of null ids only has component null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import hit_rows, let, slices, written

CHUNK = 1 << 16
BROADCAST_IDS = 500_000
#: Bytes of sets, counted as 2 KB at least, of one block of a class.
BLOCK = 4 << 20


def _remixed(h: np.ndarray, part: int) -> np.ndarray:
    """Further bits of the same hashes; part 0 is the hashes."""
    if part == 0:
        return h
    h = h + np.uint64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return int(fingerprint_words(text, width, 1)[0])


def fingerprint_words(text: bytes | None, width: int, parts: int) -> np.ndarray:
    """The fingerprint of 64 * parts bits as signed 64-bit integers."""
    words = (text or b"").lower().split()  # bytes.split() and lower(): exactly the ASCII blanks and letters
    if not words:
        return np.zeros(parts, np.int64)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    values, out = np.array(hashes, np.uint64), []
    for p in range(parts):
        total = np.zeros(64, np.int64)
        for k in range(0, len(values), CHUNK):
            part = _remixed(values[k : k + CHUNK], p).view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * total > len(values), bitorder="little").view(np.int64)[0])
    return np.array(out, np.int64)


def _name(fp: np.ndarray) -> int:
    """One number for a fingerprint: itself, or a hash of its parts."""
    return int(fp[0]) if len(fp) == 1 else xxhash.xxh64_intdigest(fp.tobytes(), 42) - (1 << 63)


def fingerprints(docs: DataFrame, width: int = 4, parts: int = 1) -> DataFrame:
    """doc_id, fp (long, see _name) and, of several parts, words for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint_words(t.as_buffer().to_pybytes() if t.is_valid else None, width, parts) for t in batch.column(1).cast(pa.binary())]
            columns = [batch.column(0), pa.array(map(_name, fps), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp"]) if parts == 1 else pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp", "words"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long" + (", words array<long>" if parts > 1 else ""))


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Pairs a < b (signed order) of distinct fingerprints at most ``radius`` bits apart.  fps: distinct, column fp."""
    reach = radius // segments
    # a ball of two bits is met half-way: each side looks up what is one bit away
    own, far = (reach // 2, reach - reach // 2) if reach > 1 else (0, reach)
    index, probe = [], []
    for n, (shift, width) in enumerate(_cuts(segments)):
        mask = (1 << width) - 1
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask))
        index.append(let(value, _around(_ball(width, own), n, False)))
        probe.append(let(value, _around(_ball(width, far), n, reach == 1)))
    table = fps.select(F.col("fp").alias("b"), F.inline(F.flatten(F.array(*index))))
    wanted = fps.select(F.col("fp").alias("a"), F.inline(F.flatten(F.array(*probe))))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = wanted.join(table, ["seg", "val"]).filter(near & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def wide_links(fps: DataFrame, parts: int, radius: int, bits: int = 20) -> DataFrame:
    """Pairs a < b of fingerprints (fp, words) at most ``radius`` bits apart of which a segment is at most one bit apart.

    Two such segments agree in their lower or in their upper half, so a fingerprint is sent
    whole to one place for each half; who meets there is compared at once, and pairs of
    random fingerprints, whose number grows with the square of the documents, are never
    written or sent on.
    """
    half, mask, sent = bits // 2, (1 << bits) - 1, []
    for n, (p, shift) in enumerate(_segments(parts, bits)):
        value = F.shiftrightunsigned(F.get("words", F.lit(p)), shift).bitwiseAND(F.lit(mask))
        sent += [value.bitwiseAND(F.lit((1 << half) - 1)) + (2 * n << bits), F.shiftrightunsigned(value, half) + (2 * n + 1 << bits)]
    words = [F.get("words", F.lit(p)).alias(f"w{p}") for p in range(parts)]
    rows = fps.select(F.explode(F.array(*sent)).alias("place"), *words).repartition("place").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_places(batches):
            for x, y in _meetings(group[:, 0], np.ascontiguousarray(group[:, 1:]), radius, bits):
                pairs = [sorted((_name(v), _name(w))) for v, w in zip(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _segments(parts: int, bits: int) -> list[tuple[int, int]]:
    """(part, shift) of each segment of a wide fingerprint."""
    return [(p, s) for p in range(parts) for s in range(0, 65 - bits, bits)]


def _whole_places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows sorted by their first column, in arrays that hold all rows of the places in them."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([c.to_numpy() for c in batch.columns])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last == 0 and held and held[-1][-1, 0] == rows[0, 0]:
            held.append(rows)
            continue
        if last == 0 and held:
            yield np.concatenate(held)
        elif last:
            yield np.concatenate([*held, rows[:last]])
        held = [rows[last:].copy()]
    if held:
        yield np.concatenate(held)


def _meetings(place: np.ndarray, words: np.ndarray, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of both sides of each pair within radius that meets here in its first segment; a pair meets once in a segment."""
    half, cuts = bits // 2, _segments(words.shape[1], bits)
    segment, side = place >> bits + 1, place >> bits & 1
    part, shift = np.array(cuts, np.int64).T
    value = words[np.arange(len(words)), part[segment]] >> shift[segment] & (1 << bits) - 1
    rest = np.where(side == 0, value >> half, value & (1 << half) - 1)  # what needn't agree
    code = (place << bits) + rest
    order = np.argsort(code)
    code, rest, side, segment, words = code[order], rest[order], side[order], segment[order], words.view(np.uint64)[order]
    for flip in [0, *[1 << b for b in range(max(half, bits - half))]]:
        # equal segments meet by their lower half only; of two one bit apart, the one with the 0 looks up
        at = np.flatnonzero(side == 0) if flip == 0 else np.flatnonzero(rest & flip == 0)
        begin = at + 1 if flip == 0 else np.searchsorted(code, code[at] + flip)
        number = np.searchsorted(code, code[at] + flip, "right") - begin
        at, begin, number = at[number > 0], begin[number > 0], number[number > 0]
        ends = np.cumsum(number)
        done = 0
        while done < len(at):
            base = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            count = number[done:stop]
            i = np.repeat(at[done:stop], count)
            j = np.arange(len(i)) + np.repeat(begin[done:stop] - (ends[done:stop] - count - base), count)
            apart = words[i] ^ words[j]
            near = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= radius
            i, j, apart = i[near], j[near], apart[near]
            close = np.column_stack([np.bitwise_count(apart[:, p] >> np.uint64(s) & np.uint64((1 << bits) - 1)) <= 1 for p, s in cuts])
            first = close.argmax(axis=1) == segment[i]
            if first.any():
                yield words[i[first]].view(np.int64), words[j[first]].view(np.int64)
            done = stop


def _ball(width: int, reach: int) -> Column:
    flips = [sum(1 << b for b in bits) for r in range(reach + 1) for bits in combinations(range(width), r)]
    return F.array(*map(F.lit, flips)).cast("array<bigint>")


def _around(ball: Column, n: int, upwards: bool):
    """Structs (segment, value) of the ball around a value; upwards: of two values one bit apart only the one with the 0 looks up."""

    def body(v: Column) -> Column:
        moved = F.transform(ball, lambda x: v.bitwiseXOR(x))
        if upwards:
            moved = F.filter(moved, lambda m: m >= v)
        return F.transform(moved, lambda m: F.struct(F.lit(n).alias("seg"), m.alias("val")))

    return body


def shingles(text: bytes | None, width: int) -> list[int]:
    """Distinct hashes of the word shingles of a text, lower-cased."""
    words = (text or b"").lower().split()
    lines = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return sorted({xxhash.xxh64_intdigest(x, 7) - (1 << 63) for x in lines})


def verified(docs: DataFrame, reps: DataFrame, near: DataFrame, width: int, least: float, parts: int = 1) -> DataFrame:
    """Pairs (a, b) of near whose texts share ``least`` of their shingles (Jaccard), enough to give the classes that all such pairs give.

    Only texts on a pair are read into sets.  Their ids are broadcast up to
    BROADCAST_IDS, beyond that joined by shuffle.  A group of k near copies has up to
    k^2 pairs, so no pair takes a set along: sets and pairs go to a place for each class
    of near, or for two blocks of a class of more than BLOCK bytes.  There a pair that
    is joined already by pairs compared before it isn't compared, as it decides nothing.
    """
    ids = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(reps, "fp").select(F.col("rep").alias("id")).distinct()
    ids = written(ids, "simhash-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=0):
            raw = [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_name(fingerprint_words(t, width, parts)) for t in raw], pa.int64()), pa.array([shingles(t, width) for t in raw], pa.list_(pa.int64()))], names=["fp", "set"])

    sets = written(texts.select("text").mapInArrow(run, "fp long, set array<long>").dropDuplicates(["fp"]), "simhash-sets")
    classes = written(connected_components(near, "a", "b", lambda df: written(df, "simhash-near")).withColumnRenamed("node", "fp"), "simhash-near")
    weight = F.sum(F.greatest(F.lit(8) * F.col("n"), F.lit(2048)))
    blocks = sets.select("fp", F.size("set").cast("long").alias("n")).join(classes, "fp").groupBy("component").agg(F.ceil(weight / BLOCK).cast("int").alias("blocks"))
    placed = written(classes.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "simhash-placed")
    copies = placed.select("fp", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    copies = copies.select("fp", F.col("component").alias("c"), F.least("block", "k").alias("x"), F.greatest("block", "k").alias("y"))
    side = lambda c: placed.select(F.col("fp").alias(c), *(["component"] if c == "a" else []), F.col("block").alias(f"k{c}"))
    pairs = near.join(side("a"), "a").join(side("b"), "b").select(F.col("component").alias("c"), F.least("ka", "kb").alias("x"), F.greatest("ka", "kb").alias("y"), "a", "b")

    def compare(own: pa.Table, pairs: pa.Table) -> pa.Table:
        of = {fp: set(values) for fp, values in zip(own.column("fp").to_pylist(), (v.values.to_numpy().tolist() for c in own.column("set").chunks for v in c))} if pairs.num_rows else {}
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        out = []
        for a, b in zip(pairs.column("a").to_numpy().tolist(), pairs.column("b").to_numpy().tolist()):
            ra, rb = root(a), root(b)
            if ra != rb and a in of and b in of:
                shared = len(of[a] & of[b])
                if shared >= least * (len(of[a]) + len(of[b]) - shared):
                    above[ra] = rb
                    out.append((a, b))
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})

    place = ["c", "x", "y"]
    return copies.join(sets, "fp").groupBy(*place).cogroup(pairs.groupBy(*place)).applyInArrow(compare, "a long, b long")


def components(docs: DataFrame, radius: int = 4, segments: int = 3, width: int = 4, least: float | None = None, parts: int = 1, bits: int = 20) -> DataFrame:
    """doc_id, fp, component_id, class (one value for each component, even if ids clash) for every row of docs; least: links need that Jaccard similarity too."""
    rows = written(fingerprints(docs, width, parts), "simhash-rows")
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), *([F.first("words").alias("words")] if parts > 1 else [])), "simhash-reps")
    near = written(links(reps.select("fp"), radius, segments) if parts == 1 else wide_links(reps, parts, radius, bits), "simhash-links")
    if least is not None:
        near = written(verified(docs, reps, near, width, least, parts), "simhash-verified")
    # Classes are worked out between fingerprints; the label is the least representative of the class.
    classes = connected_components(near, "a", "b", lambda df: written(df, "simhash-classes"))
    joined = reps.join(classes.withColumnsRenamed({"node": "fp"}), "fp", "left")
    least = joined.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    of_fp = joined.join(least, "component", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "fp").alias("class"))
    of_fp = written(of_fp, "simhash-of-fp")
    salted = rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(8)))
    spread = of_fp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return salted.join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id", "class")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    got = components(docs, **options)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the one whose doc_id is the component's id.

    Rows that repeat the doc_id and text of the kept document give one row; of rows
    that share a doc_id but not the text, each stands for its own group.  A document
    without an id stays, as nothing names its group.
    """
    named = docs.filter("doc_id is not null")
    groups = written(components(named, **options), "simhash-groups")
    per_id = groups.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("__clash"), (F.count("*") > 1).alias("__many"), F.max(F.col("doc_id") == F.col("component_id")).alias("__own"))
    per_id = written(per_id, "simhash-ids")
    own = groups.filter("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("fp").alias("fp"))
    own = own.groupBy("doc_id").agg(F.collect_set("fp").alias("__fps")).join(per_id.select("doc_id", "__clash"), "doc_id").withColumnRenamed("doc_id", "__kept")
    own = written(own, "simhash-kept")
    # most documents have one row and stay: a fixed bitmap tells so, and their texts aren't shuffled
    look = per_id.filter("__many or not __own").select("doc_id")
    sure, named = hit_rows(named, "doc_id", look, invert=True), hit_rows(named, "doc_id", look)
    same = F.col("doc_id") == F.col("__kept")
    out = sure.unionByName(named.join(own.filter("not __clash"), same, "left_semi").dropDuplicates(["doc_id"]))
    if not own.filter("__clash").isEmpty():
        width, parts = options.get("width", 4), options.get("parts", 1)

        @F.pandas_udf("long")
        def fp(texts: pd.Series) -> pd.Series:
            return pd.Series([_name(fingerprint_words(None if t is None else t.encode(), width, parts)) for t in texts], dtype="int64")

        rows = named.join(own.filter("__clash"), same).withColumn("__fp", fp(F.col("text").cast("string")))
        out = out.unionByName(rows.filter("array_contains(__fps, __fp)").dropDuplicates(["doc_id", "__fp"]).select(docs.columns))
    return out.unionByName(docs.filter("doc_id is null"))
