"""Shards of near equal bytes from sampled splitters."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhand.llm.common import written
from tallyhand.llm.ranges import constants, offsets, range_of, sortable, split_ranges

#: What a record takes besides its text.
OVERHEAD = 16
#: A range is the work of one window; it never holds more than about twice so many bytes of text.
RANGE_BYTES = 4 << 30
#: A record of over this part of a shard is dealt out by itself.
GRAIN = 100


def _levels(heavy: list[int], rest: int) -> list[int]:
    """How much of ``rest`` each shard takes so that all come as near as can be to one level."""
    full = sorted(heavy)
    level, below = 0, 0
    for i, held in enumerate(full, 1):
        below += held
        level = (rest + below) // i
        if i == len(full) or level <= full[i]:
            break
    return [max(0, level - held) for held in heavy]


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's shard, and its slot in it, so that all shards hold near equal bytes.

    Documents are put in order of (hash of the text, doc_id, row): equal texts lie together
    and a group of copies of any size can still be cut. Splitters drawn by size cut that order
    into ranges, overfull ranges are subdivided, and exact running sums over the ranges tell
    where in the order each record lies; the order is cut into shards. Records of over a
    ``GRAIN``-th of a shard, which no range can subdivide, are dealt out first, the largest
    to the emptiest shard; there are at most ``shards * GRAIN`` of them. So shards differ by
    about a ``GRAIN``-th, unless single records are larger than a shard.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each
    shard), grown_shard (null: under this law one more shard moves records anyhow). A null
    text counts as empty; null or repeated doc_ids and repeated rows get slots of their own;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_hash"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sizes",
    ).select("doc_id", "size", "text_crc32", sortable(F.col("_hash"), F.col("doc_id"), F.col("_row")).alias("_key"))
    total = narrow.agg(F.sum("size")).first()[0] or 1
    heavy = F.col("size") > F.lit(total / (shards * GRAIN))

    filled, count = [0] * shards, [0] * shards
    dealt: dict[str, tuple[int, int]] = {}
    for key, size in sorted(narrow.where(heavy).select("_key", "size").collect(), key=lambda r: (-r[1], r[0])):
        shard = min(range(shards), key=filled.__getitem__)
        dealt[key] = (shard, count[shard])
        filled[shard] += size
        count[shard] += 1
    keys = sorted(dealt)
    at = range_of(F.col("_key"), keys) - 1
    first = narrow.where(heavy).select(
        "doc_id",
        "size",
        "text_crc32",
        F.get(constants([dealt[k][0] for k in keys], "int"), at).alias("shard"),
        F.get(constants([dealt[k][1] for k in keys], "bigint"), at).alias("slot"),
    )

    light = narrow.where(~heavy)
    rest = total - sum(filled)
    bounds, sizes = split_ranges(light, "_key", "size", min(total / (8 * shards), RANGE_BYTES))
    rows_before, bytes_before = offsets(sizes)
    ends = list(accumulate(_levels(filled, rest)))[:-1]
    order = Window.partitionBy("_range").orderBy("_key")
    placed = (
        light.withColumn("_range", range_of(F.col("_key"), bounds))
        .withColumn("_bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.floor(F.col("size") / 2))
        .withColumn("_rank", F.row_number().over(order) - 1)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.get(constants(bytes_before, "bigint"), F.col("_range")) + F.col("_bytes")).alias("_bytes"),
            (F.get(constants(rows_before, "bigint"), F.col("_range")) + F.col("_rank")).alias("_rank"),
        )
        .withColumn("shard", F.size(F.filter(constants(ends, "bigint"), lambda end: end <= F.col("_bytes"))))
    )
    lowest = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # at most one row for each shard
    then = placed.join(F.broadcast(lowest), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("_rank") - F.col("_first") + F.get(constants(count, "bigint"), F.col("shard"))).alias("slot"),
    )
    return first.unionByName(then).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
