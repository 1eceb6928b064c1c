"""Power-of-two packing: documents fall into pieces of binary lengths, and equal lengths share a bucket."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhand.llm import words
from tallyhand.llm.common import written
from tallyhand.llm.words import VOCABULARY

#: Tokens of the longest sequence, a power of two.
LONGEST = 4096
#: The id that ends each document.
END = 2
#: Bytes of text that are tokens in memory at a time; one text is never parted.
SLICE_BYTES = 4 << 20
#: A sequence id is its bucket, shifted by so many bits, and its place in the bucket.
PLACE_BITS = 48

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, part int, nth long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("nth", pa.int64())])


class Encoder:
    """The library's ids of texts as little-endian 32-bit integers; chunks and words are remembered."""

    def __init__(self, file: str):
        self._splitter, self._model = words.Splitter(file), words.library(file).model
        self._words = words.Remembered(self._word)
        self._chunks = words.Chunks(self._chunk, self._words)

    def _word(self, word: str) -> bytes:
        ids = [token.id for token in self._model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([part.to_bytes(4, "little") if isinstance(part, int) else self._words[part] for part in self._splitter.split(chunk)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._chunks.__getitem__, words.chunks(text)))


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One encoder for each worker."""
    return Encoder(file)


def lengths(total: int, longest: int) -> list[int]:
    """Powers of two that add up to the total: as many of the longest as fit, then its binary digits."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``SLICE_BYTES`` of text each."""
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def decompose(docs: DataFrame, file: str = VOCABULARY, longest: int = LONGEST, end: int = END) -> DataFrame:
    """One row for each piece of each document, in one pass without a shuffle.

    doc_id, start (ids of the document before the piece), length, ids (little-endian 32-bit),
    doc_tokens, bucket (the length's power of two), and ``part`` and ``nth``: which task made the
    piece, and how many of the same bucket it had made before. A document is its ids and one
    ``end``. It falls into as many pieces of ``longest`` as fit and one for each binary digit of
    the rest, the longer ones first, so no piece needs padding and none holds two documents.

    A null text counts as empty: its one id is ``end``. Rows repeat as they come, null ids
    included; an empty table gives no rows; other columns are ignored. A task holds one Arrow
    batch, and the tokens of ``SLICE_BYTES`` of text or of one longer text.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last, part = encoder(file), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * longest.bit_length()
        for batch in batches:
            for run in _runs(batch):
                rows = []
                for doc_id, text in zip(run["doc_id"].to_pylist(), run["text"].to_pylist()):
                    ids = made.encode(text) + last
                    total, start = len(ids) // 4, 0
                    for length in lengths(total, longest):
                        bucket = length.bit_length() - 1
                        rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total, bucket, part, seen[bucket]))
                        seen[bucket] += 1
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(cut, _SCHEMA)


def numbered(pieces: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset in place of ``part`` and ``nth``: every piece is a sequence of its own.

    A sequence id is the bucket and, in its low ``PLACE_BITS`` bits, the place in the bucket, which has
    no gaps: place p of a bucket of n sequences is in batch p // b of its n / b batches of equal
    length. The pieces are written once; what is counted and summed is one row for each task and bucket.
    """
    held = written(pieces, "pieces")
    counts = held.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.shiftleft(F.col("bucket").cast("long"), PLACE_BITS) + F.col("before") + F.col("nth")
    joined = held.join(before, ["bucket", "part"])
    return joined.withColumns({"sequence_id": place, "offset": F.lit(0).cast("long")}).drop("part", "nth", "before")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket for each piece of each document."""
    pieces = decompose(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return numbered(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Sequences in one folder for each bucket, so that a trainer reads batches of equal length; large buckets are many files."""
    sequences.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
