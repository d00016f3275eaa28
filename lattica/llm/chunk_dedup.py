"""Removal of repeated passages by content-defined chunking.

A gear hash rolls over the code points of a text; a chunk ends where the hash of the last 16 of them has its
upper bits clear, within a least and a greatest length. Cuts depend on what stands near, so they find each
other again soon after an insertion. Chunks are compared by digest over the whole corpus: of equal chunks the
first (least id, null before all others, then position) is the original. Digests have 64 bits: over 10**12 chunks, one in 10**7 is
taken for a repeat by accident, and a stretch needs several of them in a row. A stretch of neighbouring chunks that all occur elsewhere
counts as a repeat if it has ``MIN_RUN`` characters; single chunks that are alike by chance are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import in_batches, join_groups, materialised

#: A chunk ends at one of 2**CUT_BITS places on average, and has LEAST to GREATEST code points.
CUT_BITS, LEAST, GREATEST = 5, 16, 256
MIN_RUN = 100
GEAR_SIZE = 4096
PIECE = 1 << 20


def gear_table() -> np.ndarray:
    """One 32-bit number for each code point modulo GEAR_SIZE, from SHA-256 of its index."""
    return np.frombuffer(b"".join(hashlib.sha256(i.to_bytes(4, "little")).digest()[:4] for i in range(GEAR_SIZE)), dtype="<u4")


GEAR = gear_table()


def cut_points(text: str) -> list[int]:
    """The ends of the chunks, in code points; the last one is the text's length."""
    ends: list[int] = []
    start, n = 0, len(text)
    for at in range(0, n, PIECE):
        lead = min(at, 15)
        points = np.frombuffer(text[at - lead : at + PIECE].encode("utf-32-le", "replace"), dtype="<u4")
        h = GEAR[points % GEAR_SIZE]
        for step in (1, 2, 4, 8):  # after each, h covers twice as many code points
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        marks = np.nonzero((h[lead:] >> np.uint32(11)) & np.uint32((1 << CUT_BITS) - 1) == 0)[0] + at + 1
        for end in marks.tolist():
            while end - start > GREATEST:
                start += GREATEST
                ends.append(start)
            if end - start >= LEAST:
                ends.append(end)
                start = end
    while n - start > GREATEST:
        start += GREATEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_rows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, start, length, digest) of every chunk. A text shorter than a chunk is one; null and empty texts have none."""
    kind = docs.schema[id].dataType
    arrow = to_arrow_type(kind)

    def run(ids, hashes, texts):
        owner, marks, starts, lengths, digests, signed = [], [], [], [], [], int.from_bytes
        for i, h, t in zip(ids, hashes, texts, strict=True):
            start = 0
            for end in cut_points(t) if t else ():
                owner.append(i)
                marks.append(h)
                starts.append(start)
                lengths.append(end - start)
                digests.append(signed(xxhash.xxh3_64_digest(t[start:end].encode("utf-8", "surrogatepass")), "big", signed=True))
                start = end
        return {"id": pa.array(owner, arrow), "text_hash": pa.array(marks, pa.int64()), "start": pa.array(starts, pa.int32()), "length": pa.array(lengths, pa.int32()), "digest": pa.array(digests, pa.int64())}

    named = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return in_batches(named, ["id", "text_hash", "text"], run, f"id {kind.simpleString()}, text_hash bigint, start int, length int, digest bigint")


def repeat_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(id, text_hash, copies, spans): the repeats of the documents that have any; spans are (start, end, first), in order, and first
    tells that no chunk of it stands earlier in the corpus.

    Rows with the same id but other texts are documents of their own. Rows that are equal in both are one document with copies here,
    all of whose chunks occur more than once; without_repeats() keeps the first of them.
    """
    chunks = materialised(chunk_rows(docs, id, text), "chunks")
    place = F.struct("id", "text_hash", "start")
    groups = materialised(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).filter("n > 1"), "repeated")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = join_groups(chunks, groups, "digest", "n", total)
    # a null id sorts as the least in min() and has to be equal to itself here
    first = F.col("origin.id").eqNullSafe(F.col("id")) & (F.col("origin.text_hash") == F.col("text_hash")) & (F.col("origin.start") == F.col("start"))
    lists = hits.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "length", first.alias("first")))).alias("hits"), F.count_if(F.col("start") == 0).alias("copies"))

    def runs(hits):
        out = []
        for chunks_ in hits:
            spans: list[list] = []
            for c in chunks_:
                a, b, own = c["start"], c["start"] + c["length"], c["first"]
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                    spans[-1][2].append((a, b, own))
                else:
                    spans.append([a, b, [(a, b, own)]])
            done = []
            for a, b, parts in spans:
                if b - a >= min_run:
                    for x, y, own in parts:
                        if done and done[-1][1] == x and done[-1][2] == own:
                            done[-1][1] = y
                        else:
                            done.append([x, y, own])
            out.append([{"start": a, "end": b, "first": own} for a, b, own in done])
        return {"spans": pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.bool_())])))}

    kind = docs.schema[id].dataType.simpleString()
    return in_batches(lists, ["id", "text_hash", "copies", "hits"], runs, f"id {kind}, text_hash bigint, copies bigint, spans array<struct<start:int,end:int,first:boolean>>", passed=["id", "text_hash", "copies"]).filter("size(spans) > 0")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, into: str = "repeats") -> DataFrame:
    """docs with their texts freed of repeats (the first occurrence stays), and the spans found in the column ``into``, in place of one of that name.

    Of rows equal in id and text, one keeps what is first in it; in the others the whole text is a repeat if it has
    min_run characters. Only such rows are shuffled for that. Null and empty texts stay as they are.
    """
    spans = materialised(repeat_spans(docs, id, text, min_run), "spans")
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(text).alias("mark"))  # so that no name of theirs clashes
    key, body = F.col("doc").getField(id), F.col("doc").getField(text)
    same = key.eqNullSafe(F.col("id")) & (F.col("mark") == F.col("text_hash"))
    joined = held.join(spans, same, "left").select("doc", "mark", "spans", "copies")
    size = F.char_length(body)
    if spans.filter("copies > 1").limit(1).count():
        nth = F.row_number().over(W.partitionBy(key, "mark").orderBy(F.lit(1)))
        whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end"), F.lit(False).alias("first")))
        of_copy = F.when(F.col("nth") == 1, F.col("spans")).when(size >= min_run, whole)
        copies = joined.filter("copies > 1").withColumn("nth", nth).select("doc", of_copy.alias("spans"))
        joined = joined.filter("coalesce(copies, 0) <= 1").select("doc", "spans").unionByName(copies)
    cuts = F.filter("spans", lambda s: ~s["first"])
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"]))
    ends = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(size))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substring(body, s["a"] + 1, s["b"] - s["a"])), "")
    freed = F.when(F.size(F.coalesce(cuts, F.array())) > 0, kept).otherwise(body)
    return joined.select(*(freed.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns if c != into), F.col("spans").alias(into))
