"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, a join on blocks and a check of the Hamming distance.

Two fingerprints with at most ``max_distance`` differing bits agree in at least ``blocks - max_distance`` of
any ``blocks`` disjoint blocks. Each distinct fingerprint is listed under every combination of that many
blocks (35 keys of about 27 bits for seven blocks and four bits), and only fingerprints that share a key are
compared. Equal fingerprints are one row throughout, however many documents have them.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import in_batches, materialised
from lattica.llm.components import connected_components

BITS = 64
SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of word shingles (repeats included) as a signed 64-bit number; zero if there is no word.

    A-Z is lower-cased; words are split at space and \\t to \\r only. With fewer words than a shingle has, the
    whole sequence is one.
    """
    tokens = (text or "").encode().lower().split()  # bytes: ASCII only, in both steps
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    n = min(words, len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))
    ones = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): one row per document; null texts count as empty."""
    kind = docs.schema[id].dataType.simpleString()
    return in_batches(docs, [id, text], lambda texts: {"fp": np.array([fingerprint(t, words) for t in texts], dtype=np.int64)}, f"`{id}` {kind}, fp bigint", passed=[id])


def block_masks(blocks: int, share: int) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), share)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _listed(prints: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))
    return prints.select("*", F.posexplode(keys).alias("combo", "key"))


#: With more members than this that aren't all connected, a key's near pairs come from balls in place of pairs.
HEAVY = 4096


def neighbours(prints: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """(rep, fp, combo, key, b, fp_b): every fingerprint under those of its keys that another one has too, with the one before it in order, if any."""
    listed = _listed(prints.select("rep", "fp"), block_masks(blocks, blocks - max_distance))
    order = W.partitionBy("combo", "key").orderBy("fp")
    beside = listed.select("*", F.lag("rep").over(order).alias("b"), F.lag("fp").over(order).alias("fp_b"), F.lead("rep").over(order).alias("after"))
    return beside.filter("b is not null or after is not null").drop("after")


def cross_links(members: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """(a, b): the components that a near pair of fingerprints under one key connects. A pair is met under the first combination that it shares only."""
    masks = block_masks(blocks, blocks - max_distance)
    left, right = (members.select(F.col("component").alias(s), F.col("fp").alias(f"fp_{s}"), "combo", "key") for s in ("a", "b"))
    differ: Column = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)))
    return left.join(right, ["combo", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_distance) & (first == F.col("combo"))).select("a", "b").distinct()


def ball_links(members: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): components, a column of members beside fp, connected by pairs of at most that distance, in work that is linear in the members.

    Two fingerprints are near if and only if they meet: one changed in half of the bits at most and the other in the
    rest. Each lists what it becomes by so many changes (2081 values for four bits) and is linked with the least
    component that lists the same. For an odd distance the last of the changes is made on one side only.
    """
    core = max_distance // 2
    changes = [sum(1 << i for i in flips) for n in range(max_distance - core + 1) for flips in combinations(range(BITS), n)]
    inner = sum(1 for c in changes if c.bit_count() <= core)
    flipped = F.from_json(F.lit(json.dumps([_signed(c) for c in changes])), "array<bigint>")
    points = members.select("component", F.posexplode(F.transform(flipped, lambda c: c.bitwiseXOR(F.col("fp")))).alias("pos", "point"))
    points = points.groupBy("point", "component").agg(F.min("pos").alias("pos"))
    least = points.groupBy("point").agg(F.min(F.when(F.col("pos") < inner, F.col("component"))).alias("a"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("point", "a")
    return points.join(least, "point").filter("a != component").select("a", F.col("component").alias("b")).distinct()


def _labelled(prints: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """prints with component: what links connect the column by to, or that itself."""
    found = connected_components(links).withColumnRenamed("component", "_to")
    joined = prints.join(found, F.col(by) == F.col("node"), "left").select("rep", "fp", F.coalesce("_to", by).alias("component"))
    return materialised(joined, "labelled")


def near_components(prints: DataFrame, max_distance: int = 4, blocks: int = 7, heavy: int = HEAVY) -> DataFrame:
    """(rep, fp, component) of prints, distinct fingerprints with an id: the least id that links of at most max_distance bits lead to.

    Keys that one fingerprint has alone go at once. Links between neighbours in the order of fingerprints, fewer
    than rows for each key, come first; they join most of a dense group. What is left are links between different
    components of these, looked for under the keys that hold several: by pairs, or by balls under a key with more
    than ``heavy`` members, so that no key costs more than ``heavy`` rows for each member. No link is lost.
    """
    shared = materialised(neighbours(prints, max_distance, blocks), "neighbours")
    beside = shared.filter(F.col("b").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= max_distance))
    joined = _labelled(prints, beside.select(F.col("rep").alias("a"), "b"), "rep")
    members = shared.select("fp", "combo", "key").join(joined.select("fp", "component"), "fp")
    keys = members.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("combo", "key", "n")
    mixed = materialised(members.join(keys, ["combo", "key"]), "mixed")
    links = cross_links(mixed.filter(F.col("n") <= heavy), max_distance, blocks)
    dense = mixed.filter(F.col("n") > heavy).select("fp", "component").distinct()
    if dense.limit(1).count():
        links = links.unionByName(ball_links(dense, max_distance))
    return _labelled(joined, links, "component")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, max_distance: int = 4, blocks: int = 7) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the least id that links lead to).

    Null, empty and blank texts have fingerprint zero and are linked like any other. A null id takes part as
    a member but never names a group unless it is alone with its fingerprint. An empty table gives no rows.
    """
    prints = materialised(fingerprints(docs, id, text, words), "simhash")
    reps = materialised(prints.groupBy("fp").agg(F.min(id).alias("rep")), "reps")
    joined = near_components(reps.filter("rep is not null"), max_distance, blocks)
    named = joined.select("fp", F.col("component").alias("component_id"))
    named = materialised(named.unionByName(reps.filter("rep is null").select("fp", F.col("rep").alias("component_id"))), "named")
    return prints.join(named, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _digest(text: str | None) -> int:
    """A signed 64-bit number for the sequence of words."""
    return xxhash.xxh64_intdigest(b" ".join(_tokens(text)), SEED) - (1 << 63)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of word shingles, sorted; a text without words has one of its own."""
    tokens = _tokens(text)
    n = max(1, min(words, len(tokens)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i : i + n]), SEED) for i in range(max(1, len(tokens) - n + 1))), dtype="<u8"))


#: The wide fingerprints of near_links(): WORDS words of 64 bits, from as many hashes of each shingle.
WORDS = 8
WIDE = WORDS * BITS
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The share of pairs at the least similarity that have no block in common, by the formula in block_plan().
MISSED = 0.002
#: Under keys with at most so many members, only those with a near one beside them go on.
CROWD = 256


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of distinct shingles, WIDE bits: the first word's bits come first."""
    ones = np.zeros(WIDE, dtype=np.int64)
    for part in range(0, len(hashes), 255):  # so that bytes can hold the sums
        x = hashes[part : part + 255, None] * FACTORS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))).view(np.uint8)
        ones += np.add.reduce(np.unpackbits(x, axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def differing(similarity: float) -> float:
    """The share of bits in which the SimHashes of sets of that Jaccard similarity differ on average, at most: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Words of 64 bits of the parity bitmaps of shingle sets.
PARITY = 16


def parity_words(hashes: np.ndarray) -> np.ndarray:
    """A bitmap in which each shingle turns one bit over. Two bitmaps differ in no more bits than their sets do in shingles."""
    bits = np.bincount(hashes.view(np.uint64) & np.uint64(64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def block_plan(rows: int, similarity: float) -> tuple[int, int]:
    """(bits of a block, number of blocks).

    Bits grow with half the logarithm of the rows, which keeps chance pairs few. Bits differ independently, so
    a pair shares a block of b bits with probability (1 - differing) ** b, and the number of blocks follows
    from MISSED, alike at every size: 102 blocks of 17 bits for 10**4 rows, 167 of 20 for 10**6, 525 of 27 for 10**10.
    """
    bits = min(48, 10 + round(math.log2(max(2, rows)) / 2))
    return bits, math.ceil(-math.log(MISSED) / (1 - differing(similarity)) ** bits)


def block_places(bits: int, blocks: int) -> np.ndarray:
    """Which bits of a wide fingerprint make each block, drawn at random once."""
    draw = np.random.default_rng(SEED)
    return np.stack([draw.choice(WIDE, bits, replace=False) for _ in range(blocks)])


def block_keys(prints: list[bytes], places: np.ndarray) -> np.ndarray:
    """The key of each block of each fingerprint, as rows of 64-bit numbers: the block's bits and its number."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1), axis=1)
    powers = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    keys = np.empty((len(prints), len(places)), dtype=np.int64)
    for k, chosen in enumerate(places):
        keys[:, k] = bits[:, chosen] @ powers
    return keys | (np.arange(len(places), dtype=np.int64) << np.int64(places.shape[1]))


#: Tables of ids of at most so many rows are broadcast.
SENT = 1 << 20


def _narrow(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few; they have to be written."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have that Jaccard similarity, exactly."""
    left, right = (sets.select(F.col("rep").alias(s), F.col("hashes").alias(f"_{s}")) for s in ("a", "b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return materialised(pairs.join(left, "a").join(right, "b").filter(common / (F.size("_a") + F.size("_b") - common) >= similarity).select("a", "b"), "alike")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links).withColumnRenamed("node", "rep")
    return materialised(nodes.join(found, "rep", "left").select("rep", "n", "own", F.coalesce("component", "rep").alias("component")), "alike-components")


BITMAP = [f"x{i}" for i in range(PARITY)]


def _most_bits(similarity: float) -> int:
    """In how many of 128 bits sets of that similarity may differ: the mean and 3.6 standard deviations."""
    share = differing(similarity)
    return math.ceil(2 * BITS * share + 3.6 * math.sqrt(2 * BITS * share * (1 - share)))


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether the first 128 bits of two wide fingerprints differ in no more places than sets of that similarity make likely."""
    return F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) + F.bit_count(F.col(f"{a}.gp").bitwiseXOR(F.col(f"{b}.gp"))) <= _most_bits(similarity)


def block_members(distinct: DataFrame, similarity: float) -> DataFrame:
    """(key, rep, fp, gp): the wide fingerprints, by rep and wide, that meet a near one under a block's key, or a crowd of more than CROWD."""
    places = block_places(*block_plan(distinct.count(), similarity))

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounded memory
                part = batch.slice(at, 512)
                wide = part.column("wide").to_pylist()
                reps = np.repeat(part.column("rep").to_numpy(), len(places))
                short = np.repeat(np.frombuffer(b"".join(w[:16] for w in wide), dtype=np.int64).reshape(-1, 2), len(places), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block_keys(wide, places).ravel(), reps, short[:, 0], short[:, 1])], names=["key", "rep", "fp", "gp"])

    most = _most_bits(similarity)

    def chosen(part: list[np.ndarray], crowd: int | None) -> pa.RecordBatch:
        """Those rows, sorted by key, that are under a key with more than CROWD, or near another one under theirs."""
        key, fp, gp = part[0], part[2].view(np.uint64), part[3].view(np.uint64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
        met = size > CROWD if crowd is None else (size > CROWD) | (key == crowd)
        alive, step = np.flatnonzero(~met), 1
        while len(alive := alive[alive + step < len(key)]) and len(alive := alive[key[alive] == key[alive + step]]):
            there = alive + step
            hit = np.bitwise_count(fp[alive] ^ fp[there]).astype(np.int64) + np.bitwise_count(gp[alive] ^ gp[there]) <= most
            met[alive[hit]] = met[there[hit]] = True
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(c[met]) for c in part], names=["key", "rep", "fp", "gp"])

    def beside(batches):
        held, crowd = None, None  # the rows of the last key so far, or the key whose rows were too many to hold
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part = part if held is None else [np.concatenate(pair) for pair in zip(held, part, strict=True)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            whole = len(part[0]) - last > CROWD or part[0][-1] == crowd
            held = None if whole else [c[last:] for c in part]
            if whole or last:
                yield chosen(part if whole else [c[:last] for c in part], crowd)
            crowd = int(part[0][-1]) if whole else None
        if held is not None:
            yield chosen(held, crowd)

    schema = "key bigint, rep bigint, fp bigint, gp bigint"
    listed = distinct.select("rep", "wide").mapInArrow(keys, schema)
    return materialised(listed.repartition("key").sortWithinPartitions("key").mapInArrow(beside, schema), "shared")


def shingle_sets(docs: DataFrame, suspects: DataFrame, words: int) -> DataFrame:
    """(rep, hashes, x0..): the shingle sets of the suspects, texts (rep) and a document (node) of each, with parity bitmaps."""
    kind = docs.schema["id"].dataType.simpleString()

    def hashed(texts):
        each = [shingles(t, words) for t in texts]
        parity = np.stack([parity_words(h) for h in each])
        return {"rep": [_digest(t) for t in texts], "hashes": [h.view(np.int64).tolist() for h in each], **{x: parity[:, i] for i, x in enumerate(BITMAP)}}

    nodes = materialised(suspects.select(F.col("node").alias("id")).distinct(), "suspect-ids")
    found = docs.join(_narrow(nodes), "id", "left_semi")
    sets = in_batches(found, ["id", "text"], hashed, f"id {kind}, rep bigint, hashes array<bigint>, {', '.join(f'{x} bigint' for x in BITMAP)}", passed=["id"])
    return materialised(sets.join(suspects.select("rep"), "rep", "left_semi").drop("id").dropDuplicates(["rep"]), "shingles")


def near_links(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component): ids of documents that pairs of at least that Jaccard similarity of word shingles connect.

    Similar sets have SimHashes that differ in few bits, about 15 in 100 at 0.8, too many for the blocks of a
    64-bit fingerprint. So the fingerprints have 512 bits, texts with an equal block are candidates (see
    block_plan() for how many pairs share none), their first 128 bits have to be near, and then the similarity of
    their shingles is computed exactly. Equal texts are one throughout. A text of which more than 1 - similarity of
    the shingles occur in no other candidate has no partner and goes first. Each one is compared with the member of
    its blocks that has the fewest such shingles, and then only pairs across the components so found are, unless
    their own shingles or their parity bitmaps show that they can't have enough in common.

    Rows without an id take no part; rows with one id are one document with the links of all its texts.
    """
    kind = docs.schema[id].dataType.simpleString()
    named = docs.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))

    def prints(texts):
        return {"rep": [_digest(t) for t in texts], "wide": pa.array([wide_fingerprint(shingles(t, words)) for t in texts], pa.binary())}

    rows = materialised(in_batches(named, ["id", "text"], prints, f"id {kind}, rep bigint, wide binary", passed=["id"]), "wide")
    first = rows.groupBy("rep").agg(F.min(F.struct("id", "wide")).alias("first"))
    distinct = materialised(first.select("rep", F.col("first.id").alias("node"), "first.wide"), "distinct")
    names = distinct.select("rep", "node")
    same = rows.select("id", "rep").join(names, "rep").filter("id != node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    shared = block_members(distinct, similarity)
    sets = shingle_sets(named, materialised(names.join(shared.select("rep").distinct(), "rep"), "suspects"), words)
    single = sets.select("rep", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).filter("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    nodes = sets.select("rep", F.size("hashes").alias("n")).join(single, "rep", "left").select("rep", "n", F.coalesce("own", F.lit(0)).alias("own"))
    nodes = materialised(nodes.filter((F.col("n") - F.col("own")) / F.col("n") >= similarity), "nodes")
    members = materialised(shared.join(nodes, "rep"), "members")
    centres = members.groupBy("key").agg(F.min(F.struct(F.col("own") / F.col("n"), F.col("rep"), F.col("fp"), F.col("gp"))).alias("c"))
    to_centre = members.alias("m").join(centres, "key").filter((F.col("c.rep") != F.col("m.rep")) & _near("m", "c", similarity))
    links = _alike(to_centre.groupBy(F.col("m.rep").alias("b")).agg(F.min("c").alias("c")).select(F.col("c.rep").alias("a"), "b"), sets, similarity)
    nodes = _components(nodes, links)
    members = materialised(members.select("rep", "key", "fp", "gp").join(nodes, "rep"), "members")
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    members = materialised(members.join(mixed, "key").join(sets.select("rep", *BITMAP), "rep"), "mixed")
    apart = " + ".join(f"bit_count(a.{x} ^ b.{x})" for x in BITMAP)
    most_common = F.expr(f"least(a.n - a.own, b.n - b.own, floor((a.n + b.n - ({apart})) / 2))")  # an upper bound of what is common
    enough = most_common / (F.expr("a.n + b.n") - most_common) >= similarity
    across = members.alias("a").join(members.alias("b"), "key").filter(F.expr("a.component < b.component") & _near("a", "b", similarity) & enough)
    links = links.unionByName(_alike(across.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct(), sets, similarity))
    ends = [names.select(F.col("rep").alias(c), F.col("node").alias(f"_{c}")) for c in ("a", "b")]
    named_links = links.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return connected_components(named_links.unionByName(same))


def drop_near(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group that pairs of at least that Jaccard similarity of word shingles make: the one
    with the least id, and all rows without an id. Null and blank texts are one group. An empty table gives no rows."""
    drop = materialised(near_links(docs, id, text, words, similarity).filter("node != component").select(F.col("node").alias("gone_")), "drop")
    return docs.join(_narrow(drop), docs[id] == drop["gone_"], "left_anti")
