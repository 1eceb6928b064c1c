"""The state of runs as tables that merge in any order.

A run's state is rows keyed by run and month, with a version. Merging states keeps, for each
run and month, the rows of its highest version: that is associative, commutative and
idempotent, so states may be merged pairwise, all at once, again, or month by month as runs are
repeated. What the runs add up to is derived from the merged rows.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tallyhand.operators.cube import add_up
from tallyhand.operators.months import joined_by


class RunState(NamedTuple):
    """``cube``: month, grp, stat_id, opportunities, attempts; ``discards``: month, reason, hands; ``ids``: month, grp, hand_id."""

    cube: DataFrame
    discards: DataFrame
    ids: DataFrame


def run_state(run: str, version: int, cube: DataFrame, discards: DataFrame, ids: DataFrame) -> RunState:
    """One run's tables, marked with the run and the version of its months."""
    mark = lambda df, *cols: df.select(F.lit(run).alias("run"), F.lit(version).cast("long").alias("version"), *cols)
    return RunState(
        mark(cube, "month", "grp", "stat_id", F.col("opportunities").cast("long").alias("opportunities"), F.col("attempts").cast("long").alias("attempts")),
        mark(discards, "month", "reason", F.col("hands").cast("long").alias("hands")),
        mark(ids, "month", "grp", "hand_id").distinct(),
    )


def merge_states(*states: RunState) -> RunState:
    """Of each run and month the rows of the highest version that any of the tables has.

    Rows that several states hold are the same rows: they count once, by their key.
    """
    united = [reduce(DataFrame.unionByName, tables) for tables in zip(*states)]
    keys = ["run", "month"]
    versions = reduce(DataFrame.unionByName, [t.select(*keys, "version").distinct() for t in united])
    newest = versions.groupBy(*keys).agg(F.max("version").alias("version"))
    kept = [joined_by(t, newest, [*keys, "version"]) for t in united]
    cube, discards, ids = kept
    return RunState(
        cube.dropDuplicates([*keys, "version", "grp", "stat_id"]), discards.dropDuplicates([*keys, "version", "reason"]), ids.distinct()
    )


def without_months(state: RunState, run: str, months: list[str]) -> RunState:
    """The state without some months of a run; what a repeated run gives for them may then be merged in."""
    rest = ~((F.col("run") == run) & F.col("month").isin(months))
    return RunState(*[t.where(F.coalesce(rest, F.lit(True))) for t in state])


def counters(state: RunState) -> DataFrame:
    """The counters of all runs added up."""
    return add_up(state.cube, ["month", "grp", "stat_id"])


def hands(state: RunState, months: list[str] | None = None) -> DataFrame:
    """(name, hands): distinct valid hands of each group and in all, discards by reason and in all, and the total.

    A hand that several runs have counts once; discarded hands have no identity and add up.
    """
    chosen = lambda t: t if months is None else t.where(F.col("month").isin(months))
    per_hand = chosen(state.ids).select("hand_id", "grp").distinct()
    sets = per_hand.groupingSets([[F.col("grp")], []], F.col("grp")).agg(F.grouping_id().alias("_all"), F.count_distinct("hand_id").alias("hands"))
    valid = sets.select(F.when(F.col("_all") == 1, "valid").otherwise(F.concat(F.lit("group:"), "grp")).alias("name"), "hands")
    dropped = chosen(state.discards).groupingSets([[F.col("reason")], []], F.col("reason")).agg(
        F.grouping_id().alias("_all"), F.coalesce(F.sum("hands"), F.lit(0)).cast("long").alias("hands")
    )
    lost = dropped.select(F.when(F.col("_all") == 1, "discarded").otherwise(F.concat(F.lit("discard:"), "reason")).alias("name"), "hands")
    both = valid.unionByName(lost)
    total = both.where(F.col("name").isin("valid", "discarded")).agg(F.sum("hands").cast("long").alias("hands"))
    return both.unionByName(total.select(F.lit("total").alias("name"), "hands"))
