"""Homomorphic fingerprints of documents, in DataFrame operations only.

A document is a multiset of paragraphs. Each paragraph is hashed to a wide vector of LANES counters and the
fingerprint is the sum of the vectors, each lane modulo 2**16: it doesn't depend on the paragraphs' order, and
a paragraph is added or removed by adding or subtracting its vector. A paragraph's vector is itself a sum,
over the paragraph as a whole and its word triples, of hashed bits, one for each lane; so what two documents
share shows in their fingerprints, and the cosine of the centred lanes estimates how much that is. Unequal
multisets get equal sums with a chance of about 2**-128 a pair. The hashes aren't cryptographic: against somebody
who looks for equal sums, compare the texts' digests.

Sums are made in two steps. Up to CHUNK units of a text are added with eight lanes to a long, which can't overflow,
and these sums with two lanes to a long (bits 0-31 and 32-63). What two texts share is summed once and combined.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES = 128
SUMS = LANES // 2
#: Units that are added with eight bits for each lane: the highest lane must not reach the sign.
CHUNK = 127
BYTES = 0x0101_0101_0101_0101
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS = 4


def units(text: Column) -> Column:
    """The hashes that a text's vector is made of: two independent ones of each paragraph that isn't empty, and one of each
    of its word triples (at its end shorter ones)."""

    def of(p: Column) -> Column:
        # the outer transform is over a single element: it binds the array of words, which is then made only once
        triples = F.transform(F.array(F.split(p, " ")), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))))
        return F.concat(F.array(F.xxhash64(p, F.lit("paragraph")), F.xxhash64(F.lit("second"), p)), F.flatten(triples))

    return F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), of))


def summed(rows: DataFrame, keys: Sequence[str], units: Column) -> DataFrame:
    """The keys, s0.. and n, the sums of the hashed bits of the units of each row; rows without units give zeros. The keys
    have to tell rows apart."""
    listed = rows.select(*keys, F.posexplode_outer(units).alias("pos", "unit")).select(*keys, F.floor(F.col("pos") / CHUNK).alias("chunk"), "unit")
    again = F.xxhash64("unit", F.lit(1))
    bits = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BYTES)) for h in (F.col("unit"), again) for s in range(8)]
    n = F.count("unit")  # a text without units has one null row
    chunks = listed.groupBy(*keys, "chunk").agg(*(F.when(n == 0, 0).otherwise(F.sum(b)).alias(f"b{i}") for i, b in enumerate(bits)), n.alias("m"))

    def lane(i: int, byte: int) -> Column:
        return F.shiftrightunsigned(F.col(f"b{i}"), 8 * byte).bitwiseAND(F.lit(0xFF))

    pairs = [lane(i, k).bitwiseOR(F.shiftleft(lane(i, k + 4), 32)) for i in range(len(bits)) for k in range(4)]
    return chunks.groupBy(*keys).agg(*(F.sum(p).alias(f"s{i}") for i, p in enumerate(pairs)), F.sum("m").alias("n"))


def vector() -> Column:
    """What summed() gives as one struct: lanes (an array of SUMS longs) and n."""
    return F.struct(F.array(*(F.col(f"s{i}") for i in range(SUMS))).alias("lanes"), F.col("n").alias("n"))


def _wrapped(s: Column) -> Column:
    return s.bitwiseAND(F.lit(0xFFFF_0000_FFFF))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets together, or with sign -1 of a without b. Lanes stay modulo 2**16."""
    return F.struct(F.zip_with(a["lanes"], b["lanes"], lambda x, y: _wrapped(_wrapped(x) + (_wrapped(y) if sign > 0 else F.lit(0x1_0000_0001_0000) - _wrapped(y)))).alias("lanes"), (a["n"] + F.lit(sign) * b["n"]).alias("n"))


def as_hex(v: Column) -> Column:
    """Eight hex digits for each two lanes, and eight for the number of units."""
    pairs = F.transform(v["lanes"], lambda s: F.lpad(F.hex(F.shiftright(_wrapped(s), 16).bitwiseOR(s.bitwiseAND(F.lit(0xFFFF)))), 8, "0"))
    return F.lower(F.concat(F.array_join(pairs, ""), F.lpad(F.hex(v["n"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the centred lanes. Equal vectors give 1, an empty one and another give 0."""

    def centred(s: Column, n: Column) -> tuple[Column, Column]:
        def one(lane: Column) -> Column:
            off = (F.lit(2) * lane - n).bitwiseAND(F.lit(0x1FFFF))  # lanes are known modulo 2**16, so this is modulo 2**17
            return F.when(off >= 0x10000, off - 0x20000).otherwise(off).cast("double")

        return one(s.bitwiseAND(F.lit(0xFFFF))), one(F.shiftright(s, 32).bitwiseAND(F.lit(0xFFFF)))

    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("ab", "aa", "bb")))

    def add(acc: Column, p: Column) -> Column:
        (x, u), (y, v) = centred(p["x"], a["n"]), centred(p["y"], b["n"])
        return F.struct((acc["ab"] + x * y + u * v).alias("ab"), (acc["aa"] + x * x + u * u).alias("aa"), (acc["bb"] + y * y + v * v).alias("bb"))

    sums = F.aggregate(F.arrays_zip(a["lanes"].alias("x"), b["lanes"].alias("y")), zero, add, lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["ab"] / F.sqrt(s["aa"] * s["bb"])))).otherwise(F.lit(0.0)))
    same = (a["n"] == b["n"]) & (a["lanes"] == b["lanes"])
    return F.when(same, F.lit(1.0)).otherwise(sums)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, vector) of each document; rows with the same id count as one document. Null counts as empty."""
    named = docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = summed(named, ["id", "row"], units(F.col("text")))
    whole = rows.groupBy("id").agg(*(F.sum(_wrapped(F.col(f"s{i}"))).alias(f"s{i}") for i in range(SUMS)), F.sum("n").alias("n"))
    return whole.select(F.col("id").alias(id), vector().alias("vector"))


def id_buckets(id: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are at most id, looked up in two steps of about sqrt(len(bounds)) each; null ids come last."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]

    def constant(values: list, kind: str) -> Column:  # one literal, folded by the optimizer, however long
        return F.from_json(F.lit(json.dumps(values)), kind)

    coarse = F.size(F.filter(constant([b[0] for b in blocks[1:]], "array<bigint>"), lambda x: x <= id))
    fine = F.size(F.filter(F.element_at(constant(blocks, "array<array<bigint>>"), coarse + 1), lambda x: x <= id))
    return F.coalesce(F.when(id.isNotNull(), coarse * step + fine), F.lit(len(bounds)))


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in order of id within buckets: bucket, guest, rn, id, text, next_text.

    Ids, which have to be integers, are cut into buckets of about equal counts. The first rows of a bucket
    also stand, as guests, at the end of the bucket before it (those of the first at the end of the last), so
    each row's successor is in its own bucket and texts are shuffled once. Rows with a null id come last, and
    rows with equal ids in the order of their texts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = base.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n - 1)], 50 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(found or []))
    bucket = id_buckets(F.col("id"), bounds)
    firsts = sorted(base.groupBy(bucket.alias("b")).agg(F.min("id").alias("first")).collect(), key=lambda r: r["b"])  # a row for each bucket at most
    before = [(r["first"], firsts[i - 1]["b"]) for i, r in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(before, "first bigint, bucket int"))
    moved = base.join(guests, F.col("id").eqNullSafe(F.col("first"))).select("bucket", F.lit(1).alias("guest"), "id", "text")
    placed = base.select(bucket.cast("int").alias("bucket"), F.lit(0).alias("guest"), "id", "text").unionByName(moved)
    order = W.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_last(), "text")
    return placed.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def fingerprint_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by as many (or all) of the next document's
    first ones; the last document's next is the first. Equal texts have equal fingerprints; empty ones all zeros.
    """
    placed = with_next(docs, id, text).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    head = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = F.concat(head, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    # whole paragraphs of the first half are in both texts: they are summed once, and then what follows in each
    shared = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))
    cut = placed.select("bucket", "guest", "rn", "id", "n_chars", "text", edited.alias("edited"), shared.alias("shared"))
    parts = [F.substring("text", F.lit(1), F.col("shared")), F.expr("substring(text, shared + 1)"), F.when(F.col("guest") == 0, F.expr("substring(edited, shared + 1)")), F.lit(None)]
    digest = F.when(F.col("guest") == 0, F.sha2(F.col("edited").cast("binary"), 256))
    several = cut.select("bucket", "guest", "rn", "id", "n_chars", digest.alias("digest"), F.posexplode(F.array(*parts)).alias("part", "part_text"))
    # the rows without a text carry the digest, so that units are grouped by short keys
    rows = several.select("bucket", "guest", "rn", "part", "id", "n_chars", F.when(F.col("part") == 3, F.col("digest")).alias("edited_sha256"), "part_text")
    keys = ["bucket", "guest", "rn", "part", "id", "n_chars", "edited_sha256"]
    vectors = summed(rows, keys, units(F.col("part_text"))).select(*keys, vector().alias("v"))
    order = W.partitionBy("bucket").orderBy("guest", "rn", "part")
    near = {"a": F.lag("v", 3), "b": F.lag("v", 2), "c": F.lag("v", 1), "x": F.lead("v", 1), "y": F.lead("v", 2)}
    seen = vectors.select("*", *(f.over(order).alias(k) for k, f in near.items())).filter("part = 3 and guest = 0")
    both = seen.select("id", "n_chars", "edited_sha256", *(combine(F.col(p), F.col(q)).alias(k) for k, p, q in (("v", "a", "b"), ("e", "a", "c"), ("next", "x", "y"))))
    v, e, nxt = F.col("v"), F.col("e"), F.col("next")
    return both.select(F.col("id").alias(id), "n_chars", "edited_sha256", as_hex(v).alias("fingerprint"), as_hex(e).alias("edited_fingerprint"), likeness(v, e).alias("near_edited"), likeness(v, nxt).alias("near_next"))
