"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Every text has one 64-bit word of the filter and PROBES bits in it, from a hash of its SHA-256. Pass 1 counts
how many rows set the same bits of the same word, within each task first, and keeps the bits that two or more
rows set: the filter, of which only words with such bits are stored. Pass 2 tests each row against it: a row
whose bits aren't all set has no equal and passes straight through; only the others are shuffled and compared
by SHA-256. The filter gives false positives, which cost a little shuffling, and no false negatives, so the
result is exact at any fill.

The filter has about SLOTS_A_ROW bits for each row of the input, so its rate of false positives is the same at
every size. It is written partitioned by word. Up to WORDS_SENT stored words (16 MB) it is broadcast; a larger
one is joined by its word, for which ids and digests are shuffled, and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import join_groups, materialised

PROBES = 2
SLOTS_A_ROW = 16
WORDS_SENT = 1 << 20


def filter_words(rows: int) -> int:
    """How many 64-bit words a filter for so many rows has: a power of two."""
    return 1 << max(10, (rows * SLOTS_A_ROW // 64).bit_length())


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def _mask(digest: Column) -> Column:
    """The bits that a digest sets in its word."""
    h = F.xxhash64(digest, F.lit("mask"))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def digests(docs: DataFrame, text: str = "text", normalise=None) -> DataFrame:
    """docs with text_sha256 of the text, null as empty; normalise: a Column function applied first."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("text_sha256", F.sha2((normalise(value) if normalise else value).cast("binary"), 256))


def repeat_filter(digested: DataFrame, words: int) -> DataFrame:
    """(word, bits): the bits that two or more rows set alike, of the words that have any."""
    set_ = digested.select(_word(F.col("text_sha256"), words).alias("word"), _mask(F.col("text_sha256")).alias("mask"))
    return set_.groupBy("word", "mask").count().filter("count > 1").groupBy("word").agg(F.bit_or("mask").alias("bits"))


class Filter:
    """A written filter, of about SLOTS_A_ROW bits a row unless slots says how many: its table, its number of words and
    whether it is small enough to be sent to all executors."""

    def __init__(self, digested: DataFrame, slots: int | None = None, sent: int = WORDS_SENT):
        self.words = filter_words(digested.count()) if slots is None else max(1, slots // 64)
        self.table = materialised(repeat_filter(digested, self.words), "bloom")
        self.small = self.table.count() <= sent

    def tested(self, rows: DataFrame) -> DataFrame:
        """rows, which have text_sha256, with maybe_: false where a row has no equal for sure."""
        table = self.table.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        joined = rows.join(F.broadcast(table) if self.small else table, _word(F.col("text_sha256"), self.words) == F.col("_word"), "left")
        mask = _mask(F.col("text_sha256"))
        return joined.withColumn("maybe_", F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_word", "_bits")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int | None = None, normalise=None, sent: int = WORDS_SENT) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays.

    Null and empty texts are equal. A null id is below all others; rows with the same text and the same id
    count singly in group_size and are all marked as kept (drop_exact() keeps one). An empty table gives no rows.
    """
    base = materialised(digests(docs.select(id, text), text, normalise).select(id, "text_sha256"), "digests")
    tested = Filter(base, slots, sent).tested(base)
    alone, maybe = tested.filter("not maybe_").drop("maybe_"), materialised(tested.filter("maybe_").drop("maybe_"), "maybe")
    groups = materialised(maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(id).alias("keep_id")), "groups")
    joined = join_groups(maybe, groups, "text_sha256", "group_size", maybe.count())
    single = alone.withColumns({"keep_id": F.col(id), "group_size": F.lit(1).cast("long")})
    return single.unionByName(joined).select(id, "keep_id", "group_size", F.col(id).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int | None = None, sent: int = WORDS_SENT) -> DataFrame:
    """docs without the copies: of rows with equal texts the one with the largest id stays, with all its columns.

    What stays is decided on ids and digests. Texts that the filter finds unique are not shuffled, and neither
    are the others while those that stay of them are at most ``sent`` rows; beyond, the possible copies are
    joined with them by digest. Nulls and ties as in exact_groups(); of rows with equal text and id one stays,
    for which only such rows are shuffled.
    """
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    base = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id).alias("_id"), sha.alias("text_sha256"))
    keys = materialised(base.select("_id", "text_sha256"), "digests")
    bloom = Filter(keys, slots, sent)
    same = bloom.tested(keys).filter("maybe_").groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("rows"))
    last = F.max(F.struct(F.col("_id"), F.col("rows")))
    stay = materialised(same.groupBy("text_sha256").agg(last.alias("last")).select(F.col("text_sha256").alias("_sha"), F.col("last._id").alias("_keep"), F.col("last.rows").alias("_rows")), "stay")
    tested = bloom.tested(base)
    mine = (F.col("text_sha256") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("_keep"))
    if stay.count() <= sent:  # one pass over the texts
        kept = tested.join(F.broadcast(stay), mine, "left").filter("not maybe_ or _sha is not null")
    else:
        kept = tested.filter("maybe_").join(stay, mine).unionByName(tested.filter("not maybe_"), allowMissingColumns=True)
    out = kept.filter("coalesce(_rows, 1) = 1").select("_doc.*")
    if not stay.filter("_rows > 1").limit(1).count():
        return out
    nth = F.row_number().over(W.partitionBy("text_sha256", "_id").orderBy(F.lit(1)))
    return out.unionByName(kept.filter("_rows > 1").withColumn("_nth", nth).filter("_nth = 1").select("_doc.*"))
