"""Best-fit packing of documents into bins under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhand.llm.common import written
from tallyhand.llm.exact_dedup import normalised

#: Tokens (words between blanks) of a bin.
CAPACITY = 2048
#: Pieces that one task packs together, and the empty share of a bin above which its pieces are packed again with those of other tasks.
GROUP, SLACK = 8192, 0.02
#: Another round is worth it while it has at most this share of the last one's pieces.
SHRINK = 0.7
_BLOCK = 64


class Bins:
    """Open bins in order of residual, in blocks that know which conflicts all their bins have."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.masks: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []
        self.common: list[int] = []

    def place(self, size: int, mask: int) -> tuple[int, int]:
        """(bin, offset) of the tightest bin that has room and no conflict, a new one if there is none."""
        least = (size, -1)
        for b in range(bisect_left(self.tops, least), len(self.blocks)):
            if self.common[b] & mask:
                continue  # every bin of the block has the conflict
            block = self.blocks[b]
            for i in range(bisect_left(block, least), len(block)):
                residual, k = block[i]
                if not self.masks[k] & mask:
                    del block[i]
                    self._renew(b)
                    return self._put(k, residual, size, mask)
        self.masks.append(0)
        self.n += 1
        return self._put(self.n - 1, self.capacity, size, mask)

    def _put(self, k: int, residual: int, size: int, mask: int) -> tuple[int, int]:
        self.masks[k] |= mask
        entry = (residual - size, k)
        b = min(bisect_left(self.tops, entry), len(self.blocks) - 1)
        if b < 0:
            self.blocks.append([])
            self.tops.append(entry)
            self.common.append(0)
            b = 0
        block = self.blocks[b]
        insort(block, entry)
        if len(block) > _BLOCK:
            self.blocks.insert(b + 1, block[_BLOCK // 2 :])
            del block[_BLOCK // 2 :]
            self.tops.insert(b + 1, entry)
            self.common.insert(b + 1, 0)
            self._renew(b + 1)
        self._renew(b)
        return k, self.capacity - residual

    def _renew(self, b: int) -> None:
        block = self.blocks[b]
        if not block:
            del self.blocks[b], self.tops[b], self.common[b]
            return
        common = -1
        for _, k in block:
            common &= self.masks[k]
        self.tops[b], self.common[b] = block[-1], common


_PLACED = "row bigint, piece int, source string, cluster bigint, size int, bin bigint, bin_offset int, free int"


def _pack(group: pd.DataFrame, capacity: int, turn: int) -> pd.DataFrame:
    """Bins for one group of pieces, the longest first, and what is free in a piece's bin."""
    group = group.sort_values(["size", "row", "piece"], ascending=[False, True, True], ignore_index=True)
    sources = {s: i for i, s in enumerate(dict.fromkeys(group["source"].dropna()))}
    repeated = group["cluster"].value_counts()
    clusters = {c: len(sources) + i for i, c in enumerate(repeated.index[repeated > 1])}
    bins, placed = Bins(capacity), []
    for size, source, cluster in zip(group["size"].tolist(), group["source"], group["cluster"]):
        mask = (1 << sources[source] if source in sources else 0) | (1 << clusters[cluster] if cluster in clusters else 0)
        placed.append(bins.place(size, mask))
    group["bin"] = [k for k, _ in placed]
    group["bin_offset"] = [at for _, at in placed]
    group["free"] = capacity - group.groupby("bin")["size"].transform("sum")
    group["bin"] += group["part"].astype("int64") * (1 << 24) + (turn << 56)
    return group[["row", "piece", "source", "cluster", "size", "bin", "bin_offset", "free"]]


def _packer(capacity: int, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fill(group: pd.DataFrame) -> pd.DataFrame:
        return _pack(group, capacity, turn)

    return fill


def pieces(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """row, doc_id, source, cluster, piece, start, size: whole documents, cut only where longer than a bin.

    ``cluster`` names a column that tells which documents are copies, as ``near_dup.near_groups``
    does; without it documents are copies if their texts are equal, case and blanks aside.
    """
    body = normalised(F.col("text"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.xxhash64(F.lower(F.trim(body))) if cluster is None else F.xxhash64(F.col(cluster))).alias("cluster"),
        words.alias("n_words"),
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("n_words") / capacity) - 1).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    return cut.select("row", "doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_words") - start).cast("int").alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """One row for each piece of each document: doc_id, source, cluster, piece, start, size, bin, bin_offset.

    A bin holds at most ``capacity`` words, at most one piece of a source and at most one of a
    cluster (see ``pieces``). In each group of about ``GROUP`` pieces, dealt out by row so that
    no source or cluster gathers in one, pieces go longest first to the tightest bin that has
    room and no conflict. The pieces of bins that stay emptier than ``SLACK`` are then dealt and
    packed again together, in rounds, until they are one group or no fewer. A document longer
    than a bin is cut into full pieces and a rest; nothing is dropped.

    A null text counts as empty and takes a place of size 0; a null source conflicts with
    none; repeated rows are packed each (apart, as they are of one cluster); an empty table
    gives no rows; other columns are ignored.
    """
    held = written(pieces(docs, capacity, cluster), "pieces")
    todo, done, turn = held.select("row", "source", "cluster", "piece", "size"), None, 0
    left = todo.count()
    while True:
        parts = max(1, -(-left // GROUP))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
        placed = written(dealt.groupBy("part").applyInPandas(_packer(capacity, turn), _PLACED), "bins")
        half = F.col("free") > int(capacity * SLACK)
        again = placed.where(half).count() if parts > 1 else 0
        last = again == 0 or again > SHRINK * left
        bins = (placed if last else placed.where(~half)).select("row", "piece", "bin", "bin_offset")
        done = bins if done is None else done.unionByName(bins)
        if last:
            return held.join(done, ["row", "piece"]).drop("row")
        todo, left, turn = placed.where(half).select(*todo.columns), again, turn + 1
