"""Sampled splitters: ranges of a sortable key that hold about equal weight."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys drawn for each target weight; the quantiles of so many keys are off by about a fifth.
PER_RANGE = 32
_LOWEST = -(1 << 63)


def sortable(*parts: Column) -> Column:
    """Long columns as one string that sorts as the longs do, part by part; null sorts first."""
    return F.concat(*[F.lpad(F.hex(F.coalesce(p.cast("long"), F.lit(_LOWEST)).bitwiseXOR(F.lit(_LOWEST))), 16, "0") for p in parts])


def constants(values: list, kind: str) -> Column:
    """A list as one folded array literal: no join is needed to look a range up."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below the key, by binary search in a literal array."""
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    if not steps:
        return F.lit(0)
    held = constants(bounds, "string")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(held, at + step - F.lit(1)) <= key, at + step).otherwise(at),
    )


def split_ranges(rows: DataFrame, key: str, weight: str, target: float) -> tuple[list[str], list[tuple[int, int]]]:
    """Bounds between ranges of about ``target`` weight, and the exact (rows, weight) of each range.

    ``rows`` must be a written table and ``key`` unique in it. Keys are drawn with a chance in
    proportion to their weight, and the quantiles of the drawn keys become bounds. Weights are
    then summed exactly, and each range that still holds over twice the target besides its
    heaviest row is subdivided by keys drawn inside it, until none is left. The driver sees
    about ``PER_RANGE`` keys for each range, however many rows there are.
    """
    bounds: list[str] = []
    turn = 0
    while True:
        ranged = rows.select(key, weight, range_of(F.col(key), bounds).alias("_range"))
        sums = {
            r[0]: (r[1], r[2], r[3])
            for r in ranged.groupBy("_range").agg(F.count("*"), F.sum(weight), F.max(weight)).collect()
        }
        sizes = [sums.get(i, (0, 0, 0))[:2] for i in range(len(bounds) + 1)]
        over = {i: w for i, (n, w, most) in sums.items() if n > 1 and w - most > 2 * target}
        if not over:
            return bounds, sizes
        turn += 1
        draw = F.pmod(F.xxhash64(F.lit(turn), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        inside = ranged.where(F.get(constants([int(i in over) for i in range(len(sizes))], "int"), F.col("_range")) == 1)
        drawn: dict[int, list[str]] = {}
        for r in inside.where(draw < F.col(weight) * F.lit(PER_RANGE / target)).select("_range", key).collect():
            drawn.setdefault(r[0], []).append(r[1])
        new = set()
        for i, keys in drawn.items():
            keys.sort()
            pieces = int(over[i] / target) + 1
            new |= {keys[j * len(keys) // pieces] for j in range(1, pieces)}
        bounds = sorted(new | set(bounds))


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that hash partitioning into ``n`` sends there, so that ranges share none."""
    held = spark.range(n * max(8, 4 * n.bit_length())).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in held.collect()}
    return [found.get(i, i) for i in range(n)]


def offsets(sizes: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Rows and weight that lie before each range."""
    rows, weights = [0], [0]
    for n, w in sizes[:-1]:
        rows.append(rows[-1] + n)
        weights.append(weights[-1] + w)
    return rows, weights


def find(bounds: list[str], key: str) -> int:
    """``range_of`` for one key on the driver."""
    return bisect.bisect_right(bounds, key)
