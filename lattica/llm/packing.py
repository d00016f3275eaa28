"""Packing documents into training sequences of several permitted lengths by best fit.

Documents are dealt into shards by a hash of their id, so that a shard has about SHARD rows whatever the
input; each shard is packed on its own, by decreasing length. A piece goes into the open bin that it leaves
the least room in. Where none fits, a bin opens in the permitted size whose expected cost for each token held
is least, judged by what is still to be packed. At the end each bin is cut down to the least permitted size
that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import materialised

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 20_000
#: What opening a bin costs beside its tokens.
OPENING = 16


def bin_size(length: int, waiting: dict[int, int], capacities: Sequence[int]) -> int:
    """The permitted size with the least cost for each token that the bin is likely to hold.

    waiting: how many tokens are still to be packed in pieces of at most each permitted size's length.
    """
    best, least = capacities[-1], float("inf")
    for c in capacities:
        if c >= length:
            room = c - length
            fills = min(room, max((waiting[k] for k in capacities if k <= room), default=0) or min(room, waiting[capacities[0]] if room >= capacities[0] // 4 else 0))
            cost = (c + OPENING) / (length + fills)
            if cost < least:
                best, least = c, cost
    return best


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> list[list[tuple[int, int, int, int, int]]]:
    """For each item its pieces: (offset in the item, length, bin, offset in the bin, the bin's final size).

    An item longer than the largest size is cut into pieces of that size and a rest; one of length zero has no piece.
    """
    capacities = sorted(capacities)
    largest = capacities[-1]
    pieces = [(min(largest, n - at), item, at) for item, n in enumerate(lengths) for at in range(0, n, largest)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    waiting = {c: sum(n for n, _, _ in pieces if n <= c) for c in capacities}
    room: list[tuple[int, int]] = []  # (free, bin) of open bins, ascending
    used: list[int] = []
    placed = []
    for n, item, at in pieces:
        for c in capacities:
            if n <= c:
                waiting[c] -= n
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = bin_size(n, waiting, capacities), len(used)
            used.append(0)
        placed.append((item, at, n, b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    final = [next(c for c in capacities if c >= u) for u in used]
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in lengths]
    for item, at, n, b, offset in placed:
        out[item].append((at, n, b, offset, final[b]))
    return [sorted(p) for p in out]


def word_count(text: str = "text") -> Column:
    """Words between runs of ASCII white space; null and blank texts have none."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def best_fit(docs: DataFrame, length: Column, id: str = "doc_id", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """(id, piece, piece_start, n_tokens, bin_id, bin_offset, capacity): at least one row per document.

    A document of length zero or null has one row with n_tokens 0 and no bin. Bin ids are shard * 2**32 + number.
    Rows with the same id, or with none, are packed singly; only ids and lengths are shuffled. Where rows with one id
    and length would fill a shard, all are dealt by their place in the table as well.
    """
    sized = materialised(docs.select(F.col(id).alias("id"), F.coalesce(length, F.lit(0)).cast("int").alias("n")), "lengths")
    shards = max(1, -(-sized.count() // shard))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("id", "n"), F.lit(shards)))
    if shards > 1 and dealt.groupBy("shard").count().filter(F.col("count") > 2 * shard).limit(1).count():
        dealt = sized.withColumn("shard", F.pmod(F.xxhash64("id", "n", F.monotonically_increasing_id()), F.lit(shards)))
    kind = docs.schema[id].dataType
    kinds = (to_arrow_type(kind), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    names = ("id", "piece", "piece_start", "n_tokens", "bin_id", "bin_offset", "capacity")

    def run(key, table):
        table = table.sort_by([("n", "descending"), ("id", "ascending")])
        base = key[0].as_py() << 32
        rows: list[tuple] = []
        for i, n, pieces in zip(table["id"].to_pylist(), table["n"].to_pylist(), pack(table["n"].to_pylist(), capacities), strict=True):
            rows += [(i, k, at, size, base + b, offset, c) for k, (at, size, b, offset, c) in enumerate(pieces)] or [(i, 0, 0, n, None, None, None)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

    packed = dealt.groupBy("shard").applyInArrow(run, f"id {kind.simpleString()}, piece int, piece_start int, n_tokens int, bin_id bigint, bin_offset int, capacity int")
    return packed.withColumnRenamed("id", id)
